"""MinHash near-duplicates of weighted shingles by ProbMinHash, banding and verification.

A document is its shingles of five words, each weighted by how often it occurs. A
shingle's arrivals are a Poisson process of that rate, drawn from its hash; each
arrival falls into one register, and a register keeps the shingle that came first.
A shingle stops as soon as its next arrival is later than all registers of its
document (Ertl, "ProbMinHash", 2020). Two documents agree in a register with the
probability that is their probability Jaccard similarity, so bands of registers
find candidates; each candidate is then verified on the shingles themselves.

No bucket is expanded into pairs. Documents of equal words are one representative.
In a bucket each member is first held against the bucket's smallest member, and
links are joined to components. Only where a bucket still has several components are
its members held against each other, in tiles of bounded size that return a
spanning forest, so no link within a bucket is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import FOLDED, Words, arrow_map, bounded_batches, grams, id_filter, ids_and_texts, in_filter, mix64, remove, stored, text_bytes
from granary.llm.components import components, forest

SHINGLE, THRESHOLD = 5, 0.8
#: At 0.8 a pair is missed by all bands with a probability of 3e-5.
BANDS, BAND_ROWS = 20, 4
#: Members of a bucket in one block of a tile.
BLOCK = 256

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, hash, count)`` of the different shingles, by document and hash.

    A text of fewer words, but not none, is one shingle.
    """
    words = Words(texts, FOLDED)
    n = np.diff(words.first)
    at = np.flatnonzero(words.whole(size))
    docs, hashes = [words.doc[at]], [grams(words.hash, size)[at]]
    for few in range(1, size):
        short = np.flatnonzero(n == few)
        if len(short):
            docs.append(short)
            hashes.append(mix64(grams(words.hash, few)[words.first[short]] + np.uint64(few)))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], value[starts], np.diff(np.append(starts, len(doc)))


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n x m`` registers: the element that arrives first. Rows of documents without elements are 0."""
    first = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    time = np.zeros(len(doc))
    latest = np.full(n, np.inf)
    k = np.uint64(0)
    active = np.arange(len(doc))
    with np.errstate(over="ignore"):
        while len(active):
            k += np.uint64(1)
            draw = mix64(value[active] + k * _STEP)
            uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            t = time[active] - np.log(uniform) / weight[active]
            time[active] = t
            early = t < latest[doc[active]]  # any later arrival of the others is later still
            active, t = active[early], t[early]
            place = doc[active] * m + (mix64(draw[early] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, place, t)
            won = first[place] == t
            kept[place[won]] = value[active[won]]
            latest = first.reshape(n, m).max(axis=1) if n else latest
    return kept.reshape(n, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two sets of sorted hashes with counts."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    base = int(max(x.max(), y.max())) + 1
    both = x[i].astype(np.int64) * base + y[j]
    left, right = np.delete(x, i).astype(np.int64) * base, np.delete(y, j).astype(np.int64)
    common, times = np.unique(both, return_counts=True)
    pairs, many = np.unique(np.concatenate((both, left, right)), return_counts=True)
    px, py = (pairs // base).astype(float), (pairs % base).astype(float)
    cx, cy = (common // base).astype(float), (common % base).astype(float)
    below = (np.maximum(px[None, :] / cx[:, None], py[None, :] / cy[:, None]) * many[None, :]).sum(axis=1)
    return float((times / below).sum())


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(1))
        n = len(texts)
        doc, value, count = shingles(texts, size)
        registers = prob_minhash(doc, value, count.astype(float), n, bands * rows)
        keys = np.stack([mix64(grams(registers[:, b * rows : (b + 1) * rows].reshape(-1), rows)[::rows] + np.uint64((b + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for b in range(bands)], axis=1).view(np.int64)
        same = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if (w := t.translate(FOLDED).split()) else None for t in texts]
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), out], names=["doc_id", "same", "bands"])

    return arrow_map(docs, "doc_id long, same binary, bands array<long>", lambda: step)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, hashes, counts``: the shingles' sorted 64-bit hashes and unsigned 32-bit counts, empty where all are 1."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, value, count = shingles(text_bytes(batch.column(1)), size)
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
        hashes = [value[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        counts = [count[a:b].astype("<u4").tobytes() if (count[a:b] > 1).any() else b"" for a, b in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "hashes", "counts"])

    return arrow_map(docs, "doc_id long, hashes binary, counts binary", lambda: step)


def _set(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    value = np.frombuffer(hashes, "<u8")
    return value, np.frombuffer(counts, "<u4") if counts else np.ones(len(value), "<u4")


def _stars(stars: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """The links ``(src, dst)`` among the pairs of a hub and a member.

    A hub's members are dealt to blocks of bounded size and only the hub's own set
    is repeated, once for each block, so a hub of very many members is many tasks.
    """
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = stars.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("rep"))

    def star(table: pa.Table) -> pa.Table:
        hub, rep = table.column("hub")[0].as_py(), table.column("rep").to_pylist()
        sets_ = [_set(h, c) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        own = [x for r, x in zip(rep, sets_, strict=True) if r == hub]
        near = [r for r, x in zip(rep, sets_, strict=True) if r != hub and any(probability_jaccard(*h, *x) >= threshold for h in own)]
        return pa.table({"src": pa.array(near, pa.int64()), "dst": pa.array([hub] * len(near), pa.int64())})

    return members.unionByName(hubs).join(sets.withColumnRenamed("doc_id", "rep"), "rep").groupBy("hub", "block").applyInArrow(star, "src long, dst long")


def _across(buckets: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between different components of a bucket: a spanning forest of each tile's.

    ``buckets``: ``bucket, rep, component, major`` (the component is that of the
    bucket's smallest member). Members of other components are held against all
    members, those of the major one aren't held against each other.
    """
    sizes = buckets.groupBy("bucket", "major").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wide = sizes.groupBy("bucket").agg(F.coalesce(F.max(F.when(F.col("major"), F.col("blocks"))), F.lit(0)).alias("majors"), F.coalesce(F.max(F.when(~F.col("major"), F.col("blocks"))), F.lit(0)).alias("minors"))
    placed = buckets.join(wide, "bucket").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    minor = F.sequence(F.lit(0), F.col("minors") - 1)
    # A tile is named by its minor block and the other block, which is minor (y >= 0) or major (y < 0).
    of_major = F.transform(minor, lambda x: F.struct(x.alias("x"), (-1 - F.col("own")).alias("y"), F.lit(False).alias("first")))
    to_minor = F.transform(minor, lambda z: F.struct(F.least(z, F.col("own")).alias("x"), F.greatest(z, F.col("own")).alias("y"), (F.col("own") <= z).alias("first")))
    to_major = F.transform(F.filter(F.sequence(F.lit(0), F.col("majors")), lambda z: z < F.col("majors")), lambda z: F.struct(F.col("own").alias("x"), (-1 - z).alias("y"), F.lit(True).alias("first")))
    tiles = placed.withColumn("t", F.explode(F.when(F.col("major"), of_major).otherwise(F.concat(to_minor, to_major)))).select("bucket", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.first").alias("first"), "rep", "component")

    def tile(table: pa.Table) -> pa.Table:
        rep, part = table.column("rep").to_numpy(), table.column("component").to_numpy()
        first = np.array(table.column("first").to_pylist(), bool)
        same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        sets_ = [_set(h, c) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        share = _least_shares(sets_)
        a = np.arange(len(rep)) if same else np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        i, j = np.nonzero((share[np.ix_(a, b)] >= threshold - 1e-9) & (part[a][:, None] != part[b][None, :]))
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        keep = np.array([probability_jaccard(*sets_[p], *sets_[q]) >= threshold for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
        one, root = forest(i[keep], j[keep], len(rep))
        return pa.table({"src": rep[one], "dst": rep[root]})

    return tiles.join(sets.withColumnRenamed("doc_id", "rep"), "rep").groupBy("bucket", "x", "y").applyInArrow(tile, "src long, dst long")


def _least_shares(sets_: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the smaller of both documents' shares of each shingle, an upper bound of the probability Jaccard similarity.

    A register shows a shingle with its share of the document's weight, and two
    variables agree at most with the overlap of their distributions. The overlap is
    bounded by the smaller share of weight that the common shingles have in either.
    """
    n = len(sets_)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in sets_])
    value = np.concatenate([h for h, _ in sets_]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([c / max(1, c.sum()) for _, c in sets_]) if n else np.zeros(0)
    order = np.argsort(value, kind="stable")
    doc, value, weight = doc[order], value[order], weight[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    doc, weight, column = doc[shared], weight[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((n, n))
    width = int(column.max()) + 1 if len(column) else 0
    for at in range(0, width, 8192):
        here = (column >= at) & (column < at + 8192)
        present, heavy = np.zeros((n, 8192), np.float32), np.zeros((n, 8192), np.float32)
        present[doc[here], column[here] - at] = 1
        heavy[doc[here], column[here] - at] = weight[here]
        total += heavy @ present.T
    return np.minimum(total, total.T) * (1 + 1e-5)


def near_documents(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, kept``: one row for each input row.

    ``class_id`` is the smallest id that links reach, ``kept`` is doc_id = class_id.
    Texts of equal words link; others link at a similarity of ``threshold`` or more
    that their bands found. Words are as for decontamination (A-Z folded). Texts
    without words (null, empty, marks only) and rows with a null id link with nothing.
    Rows that repeat an id belong together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = ids_and_texts(docs, id_col, text_col)
    signed, signed_path = stored(_signatures(narrow, size, bands, rows), "minhash-signatures")
    reps, reps_path = stored(signed.where("doc_id is not null and same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "minhash-reps")
    places = reps.select("rep", F.explode("bands").alias("bucket"))
    # Written, so that the join with them is between two plain exchanges, which Spark can split where a bucket is large.
    buckets, buckets_path = stored(places.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub"), "minhash-buckets")
    members, members_path = stored(places.join(buckets, "bucket"), "minhash-members")
    stars, stars_path = stored(members.where("rep <> hub").select("hub", "rep").distinct(), "minhash-stars")
    # No text leaves its place: a filter of bounded size finds the documents that some bucket has.
    bits, bits_path = stored(id_filter(members.select("rep").distinct(), "rep"), "minhash-filter")
    sets, sets_path = stored(_sets(in_filter(narrow, "doc_id", bits, "_granary_in").where("_granary_in").select("doc_id", "text"), size), "minhash-sets")
    edges, edges_path = stored(_stars(stars, sets, threshold, block), "minhash-links")
    roots, roots_path = components(edges)
    # Buckets that still hold several components.
    known = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    mixed, mixed_path = stored(known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("component"))).alias("main")).where("low <> high").select("bucket", "main"), "minhash-mixed")
    open_, open_path = stored(known.join(mixed, "bucket").select("bucket", "rep", "component", (F.col("component") == F.col("main")).alias("major")), "minhash-open")
    if not open_.isEmpty():
        more, more_path = stored(_across(open_, sets, threshold, block), "minhash-more")
        if not more.isEmpty():
            remove(spark, roots_path)
            roots, roots_path = components(edges.unionByName(more))
        remove(spark, more_path)
    classes = reps.select("same", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class"))
    out = signed.select("doc_id", "same").join(classes, "same", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"))
    result, _ = stored(out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")), "minhash-classes")
    remove(spark, signed_path, reps_path, buckets_path, members_path, stars_path, bits_path, sets_path, edges_path, roots_path, mixed_path, open_path)
    return result


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all of their columns.

    One row of each class stays: that of the smallest id, and of rows that repeat
    this id the one of the smallest text. Rows with a null id, and texts without words
    (null, empty, marks only), link with nothing and stay. An empty table gives none.
    Extra columns may have any name.

    A filter of bounded size finds the rows that may go: those of ids that aren't
    kept or are repeated. Only these are moved, to be settled exactly.
    """
    classes = near_documents(docs, id_col=id_col, text_col=text_col)
    by_id = classes.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    odd, _ = stored(by_id.where("not kept or n > 1").select("doc_id", "kept"), "minhash-odd")
    bits, _ = stored(id_filter(odd, "doc_id"), "minhash-odd-filter")
    marked = in_filter(docs, id_col, bits, "_granary_in")
    fine = marked.where("not _granary_in").select(*docs.columns)
    maybe = marked.where("_granary_in").withColumn("_granary_id", F.col(id_col).cast("long")).join(odd.select(F.col("doc_id").alias("_granary_id"), F.col("kept").alias("_granary_kept")), "_granary_id", "left")
    passed = maybe.where("_granary_kept is null").select(*docs.columns)
    if odd.where("kept").isEmpty():
        return fine.unionByName(passed)
    repeated = maybe.where("_granary_kept").groupBy("_granary_id").agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("r"))
    return fine.unionByName(passed).unionByName(repeated.select("r.*"))
