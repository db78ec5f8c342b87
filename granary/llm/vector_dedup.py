"""Embedding near-duplicates by int8 quantised tile products with error bounds.

Vectors are scaled to unit length and quantised to int8 with a scale of their own.
With a = s q + e the product of two vectors differs from that of their
quantised forms by at most |ea| |b| + |sb qb| |ea| ... <= |ea| + |eb| + |ea||eb| (unit
vectors), where |e| is known for each vector. So most pairs are below the threshold,
or reach it, for certain by the quantised product alone. Codes, scales and bounds are
all that goes to the tiles. Vectors with a pair that the bounds leave open get their
components there in a second pass, which recomputes those pairs in double precision.

Equal vectors of a label are one representative. Representatives of a label are
dealt to blocks of bounded size by a hash, and each pair of blocks is a task of its
own, so a label with a third of all vectors is many tasks. A tile returns each
vector's number of links and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import bounded_batches, remove, stored
from granary.llm.components import components, forest

THRESHOLD = 0.98
#: Representatives in a block.
BLOCK = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and a bound of the error's length for each row of unit vectors."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
    codes = np.rint(unit / scale).astype(np.int8)
    error = np.sqrt(((unit - codes * scale) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale[:, 0], error


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is about 1: exact, and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -exponent[:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def bounds(a: tuple, b: tuple, threshold: float, step: int = 512):
    """``(i, j, sure)`` of the pairs that may reach the threshold, in parts; ``sure`` are those that reach it for certain.

    ``a`` and ``b`` are codes, scales and error bounds. Integer products of 127 x 127 a
    component are exact in 32-bit floats for 1,040 dimensions; beyond that doubles hold them.
    """
    qa, sa, ea = a
    qb, sb, eb = b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    wide = qb.astype(kind).T
    for at in range(0, len(qa), step):
        s = slice(at, at + step)
        dots = (qa[s].astype(kind) @ wide).astype(np.float64) * sa[s, None] * sb[None, :]
        slack = ea[s, None] + eb[None, :] + ea[s, None] * eb[None, :] + 1e-9
        i, j = np.nonzero(dots + slack >= threshold)
        yield i + at, j, dots[i, j] - slack[i, j] >= threshold


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of ``threshold`` or more in double precision; ``a`` and ``b`` are scaled."""
    na, nb = norms(a), norms(b)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        keep[s] = (a[i[s]] * b[j[s]]).sum(axis=1) / (na[i[s]] * nb[j[s]]) >= threshold
    return keep


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each input row.

    Rows are compared only when labels are equal and not null, and dimensions too.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. ``n_links`` counts other rows linked directly (repeated rows and ids
    are rows of their own), ``component_id`` is the smallest id reachable, ``kept`` is
    vec_id = component_id. Rows with a null id or label link with nothing. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = rows.select("vec_id", "label", "v", F.coalesce(sound, F.lit(False)).alias("sound")).withColumn("key", F.when(F.col("sound"), F.sha2(F.concat_ws("|", "label", F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string")))), 256)))
    # Equal vectors: the smallest id stands for them, by a grouped minimum, so a very common vector is summed up where it is read.
    reps = keyed.where("sound").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("label", "vec_id").alias("label"), F.min_by("v", "vec_id").alias("v"))
    reps, reps_path = stored(reps, "vector-reps")
    kinds = reps.withColumn("kind", F.concat_ws("|", "label", F.size("v"))).select("kind", "rep", "copies", "v")
    bounded_batches(spark)

    def code(batches):
        for batch in batches:
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            codes, scales, errors = [], np.zeros(len(sizes)), np.zeros(len(sizes))
            flat = np.split(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
            for n, v in enumerate(flat):
                unit = scaled(v[None, :])
                q, scales[n : n + 1], errors[n : n + 1] = quantise(unit / norms(unit)[:, None])
                codes.append(q.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), pa.array(scales), pa.array(errors)], names=["kind", "rep", "copies", "codes", "scale", "error"])

    coded, coded_path = stored(kinds.mapInArrow(code, "kind string, rep long, copies long, codes binary, scale double, error double"), "vector-codes")
    counts = coded.groupBy("kind").agg(F.count("*").alias("n")).select("kind", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = coded.join(counts, "kind").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block meets each block of its label: as first of the pair where its number is smaller. One byte a component moves.
    each = placed.select("kind", "rep", "copies", "codes", "scale", "error", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = each.select("kind", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "copies", "codes", "scale", "error", (F.col("own") <= F.col("other")).alias("first"))

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if table.column("x")[0].as_py() == table.column("y")[0].as_py():
            return (np.arange(table.num_rows),) * 2
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        return np.flatnonzero(first), np.flatnonzero(~first)

    def coded_of(table: pa.Table, at: np.ndarray) -> tuple:
        q = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(table.num_rows, -1)
        return q[at], table.column("scale").to_numpy()[at], table.column("error").to_numpy()[at]

    def summed(table: pa.Table, i: np.ndarray, j: np.ndarray, unsure: np.ndarray) -> pa.Table:
        """Links of each vector by count and spanning forest, and vectors with a pair that the bounds leave open."""
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        one, root = forest(i, j, len(rep))
        some = np.flatnonzero(links)
        n, m, u = len(some), len(one), len(unsure)
        label = lambda c, kind: pa.array([table.column(c)[0].as_py()] * (n + m + u), kind)
        return pa.table({
            "kind": label("kind", pa.string()), "x": label("x", pa.int32()), "y": label("y", pa.int32()), "a": np.concatenate((rep[some], rep[one], rep[unsure])), "b": np.concatenate((np.full(n, -1), rep[root], np.full(u, -1))).astype(np.int64),
            "links": np.concatenate((links[some], np.zeros(m + u))).astype(np.int64), "what": pa.array(["links"] * n + ["edge"] * m + ["open"] * u, pa.string()), "first": pa.array(np.concatenate((np.zeros(n + m, bool), table.column("first").to_numpy(zero_copy_only=False).astype(bool)[unsure]))),
        })

    def pairs(table: pa.Table, a: np.ndarray, b: np.ndarray, codes: tuple, codes_b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of a tile once."""
        found = [(a[i], b[j], sure) for i, j, sure in bounds(codes, codes_b, threshold)] if len(a) and len(b) else []
        i, j, sure = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else ((),) * 3, (np.int64, np.int64, bool)))
        once = i < j if a is b else np.ones(len(i), bool)
        return i[once], j[once], sure[once]

    def tile(table: pa.Table) -> pa.Table:
        a, b = parts(table)
        i, j, sure = pairs(table, a, b, coded_of(table, a), coded_of(table, b))
        return summed(table, i[sure], j[sure], np.unique(np.concatenate((i[~sure], j[~sure]))))

    def exact_tile(table: pa.Table) -> pa.Table:
        """The pairs that the bounds left open among a tile's open vectors, on their components."""
        a, b = parts(table)
        v = scaled(_matrix(table.column("v")))
        i, j, sure = pairs(table, a, b, coded_of(table, a), coded_of(table, b))
        i, j = i[~sure], j[~sure]
        keep = exact(v, v, i, j, threshold)
        return summed(table, i[keep], j[keep], np.zeros(0, np.int64))

    schema = "kind string, x int, y int, a long, b long, links long, what string, first boolean"
    sure, sure_path = stored(tiles.groupBy("kind", "x", "y").applyInArrow(tile, schema), "vector-sure")
    still = sure.where("what = 'open'").select("kind", "x", "y", F.col("a").alias("rep"), "first").join(reps.select("rep", "v"), "rep").join(coded.select("rep", "copies", "codes", "scale", "error"), "rep")
    checked = still.groupBy("kind", "x", "y").applyInArrow(exact_tile, schema)
    found, found_path = stored(sure.where("what <> 'open'").unionByName(checked), "vector-links")
    links = found.where("what = 'links'").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    roots, _ = components(found.where("what = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # Written, so that rows meet it in a join that Spark can split where a vector is very common.
    by_key = reps.select("key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    known, _ = stored(by_key, "vector-classes")
    remove(spark, reps_path, coded_path, sure_path, found_path)
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))
