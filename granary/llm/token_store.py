"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's ids into chunks, so that
equal passages give equal chunks wherever they start. A chunk's address is the hash
of its ids. The store keeps a chunk's ids once, in the row of one of the documents
that have it (its keeper); every other occurrence is only its address. Layout below
``path``:

* ``ids/``: one row a document in ascending doc_id order over the files, range
  partitioned: ``doc_id, row`` (a number of its own), ``n_tokens, before`` (ids of the
  part's documents before it), ``hashes`` (the recipe: 16 bytes for each chunk),
  ``lengths, foreign`` (places of chunks that another row keeps), ``lent`` (places of
  chunks that other rows refer to), ``data`` (the ids of the kept chunks, each chunk
  once, and a byte that says how many bytes an id takes), ``root`` (Merkle root of the
  chunk hashes), ``part``;
* ``manifest/``: for each part its rows, ids and the Merkle root over its documents.

Reading joins only what is foreign with what is lent; a document that keeps all of
its chunks is read as it is. Each chunk is checked against its address, each recipe
against its root and each part against the manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, give_back, ids_and_texts, mix64, remove, stored, text_bytes
from granary.llm.tokens import JsonTokenizer, loaded

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids that the rolling hash looks back over, mean ids of a chunk (a power of two), least and most.
LOOK_BACK, MEAN, LEAST, MOST = 8, 256, 32, 2048

_SIZE = 16
_IDS = "doc_id long, row long, n_tokens long, before long, hashes binary, lengths array<int>, foreign array<int>, lent array<int>, data binary, root binary, part long"
_IDS_ARROW = {
    "doc_id": pa.int64(), "row": pa.int64(), "n_tokens": pa.int64(), "before": pa.int64(), "hashes": pa.binary(), "lengths": pa.list_(pa.int32()),
    "foreign": pa.list_(pa.int32()), "lent": pa.list_(pa.int32()), "data": pa.binary(), "root": pa.binary(), "part": pa.int64(),
}
_STAGE = "doc_id long, row long, n_tokens long, hashes binary, lengths array<int>, data binary"


def _marks(ids: np.ndarray, mean: int) -> np.ndarray:
    """Places after which the rolling hash would cut."""
    mixed = mix64(ids.astype(np.uint64) + np.uint64(0x9E37))
    rolled = mixed.copy()
    for back in range(1, min(LOOK_BACK, len(ids))):
        rolled[back:] += mixed[: len(ids) - back] << np.uint64(back)
    return np.flatnonzero((mix64(rolled) & np.uint64(mean - 1)) == 0) + 1


def _ends(marks: list[int], n: int, least: int, most: int) -> list[int]:
    if n <= least:
        return [n] if n else []
    ends, at = [], 0
    for mark in marks:
        while mark - at > most:
            at += most
            ends.append(at)
        if mark - at >= least:
            ends.append(mark)
            at = mark
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def cut_points(documents: list[np.ndarray], mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each document. They depend on the ids around a cut only, up to ``least`` and ``most``.

    The documents are hashed in one run: a hash that looks back into the one before
    lies in the first ``least`` ids, where nothing is cut.
    """
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in documents])))
    marks = _marks(np.concatenate(documents), mean) if bounds[-1] else np.zeros(0, np.int64)
    at = np.searchsorted(marks, bounds, "right").tolist()
    return [_ends((marks[a:b] - bounds[i]).tolist(), len(documents[i]), least, most) for i, (a, b) in enumerate(zip(at, at[1:]))]


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; the last of an odd level moves up alone. No leaves: 16 zero bytes."""
    level = list(leaves) or [bytes(16)]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def addresses(raw: bytes, ends: list[int], size: int) -> list[bytes]:
    return [digest(raw[a * size : b * size]) for a, b in zip([0, *ends], ends)]


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with the end id, cut into chunks. ``data`` has one width byte at its end, the same in all rows."""
    end = np.array([end_id], "<u4")

    def make():
        tokenizer = loaded(JsonTokenizer, tokenizer_file)
        size = 2 if max(tokenizer.vocabulary, end_id + 1) <= 1 << 16 else 4
        row = TaskContext.get().partitionId() << 36

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            documents = [np.concatenate((x, end)) for x in tokenizer.encode(text_bytes(batch.column(1)))]
            n = len(documents)
            cuts = cut_points(documents)
            raw = [x.astype(f"<u{size}").tobytes() for x in documents]
            hashes = [b"".join(addresses(x, ends, size)) for x, ends in zip(raw, cuts, strict=True)]
            sizes = [list(map(int.__sub__, ends, [0, *ends])) for ends in cuts]
            columns = (pa.array(range(row, row + n), pa.int64()), pa.array([len(x) for x in documents], pa.int64()), pa.array(hashes, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array([x + bytes([size]) for x in raw], pa.binary()))
            row += n
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "row", "n_tokens", "hashes", "lengths", "data"])

        return step

    return arrow_map(ids_and_texts(docs, id_col, text_col), _STAGE, make)


def _addresses(rows: DataFrame, keep: list[str], places: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``hash``: the different chunks of each row, or those at the listed places."""
    every = F.filter(F.sequence(F.lit(0), F.size("lengths")), lambda i: i < F.size("lengths")) if places is None else F.col(places)
    return rows.select(*keep, F.explode(F.array_distinct(F.transform(every, lambda i: F.substring("hashes", i * _SIZE + 1, F.lit(_SIZE))))).alias("hash"))


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the store; see the module's docstring for the layout.

    The texts are encoded once, to a staging folder beside the store. A chunk's
    keeper is the least row that has it, found by a grouped minimum, so a chunk that
    a third of all documents share is one partial row for each task; the keepers are
    written, and the join of places with them is one that Spark can split. Marks and
    ids then meet by one range exchange on doc_id. Null ids come first, null texts
    are empty (their end id alone), repeated rows are documents of their own. An
    empty table makes an empty store.
    """
    spark = docs.sparkSession
    stage = f"{path}-stage"
    encode_documents(docs, tokenizer_file, end_id, id_col, text_col).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.schema(_STAGE).parquet(stage)
    places = _addresses(staged, ["doc_id", "row"])
    keepers, keepers_path = stored(places.groupBy("hash").agg(F.min("row").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("hash", "keeper"), "token-store-keepers")
    marks = places.join(keepers, "hash").groupBy("doc_id", "row").agg(F.collect_list(F.when(F.col("keeper") != F.col("row"), F.col("hash"))).alias("foreign"), F.collect_list(F.when(F.col("keeper") == F.col("row"), F.col("hash"))).alias("lent"))
    kinds = {"n_tokens": "long", "hashes": "binary", "lengths": "array<int>", "data": "binary"}
    none = F.lit(None).cast("array<binary>")
    of_data = staged.select("doc_id", "row", F.lit(1).alias("kind"), *kinds, none.alias("foreign"), none.alias("lent"))
    of_marks = marks.select("doc_id", "row", F.lit(0).alias("kind"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()), "foreign", "lent")
    dealt = of_data.unionByName(of_marks).repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "row").sortWithinPartitions("doc_id", "row", "kind")
    dealt.mapInArrow(_kept_only, _IDS).write.option("compression", "zstd").parquet(f"{path}/ids")
    remove(spark, stage, keepers_path)
    _part_roots(spark.read.schema(_IDS).parquet(f"{path}/ids")).coalesce(1).write.parquet(f"{path}/manifest")


def _kept_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's marks with its row and take out the ids of foreign chunks, and of those that the row has already."""
    part = TaskContext.get().partitionId()
    mark: tuple = (None, set(), set())
    before = 0
    for batch in batches:
        out: list[list] = [[] for _ in _IDS_ARROW]
        for doc, row, kind, n, hashes, lengths, data, away, lent in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "kind", "n_tokens", "hashes", "lengths", "data", "foreign", "lent"))):
            if kind == 0:
                mark = (row, set(away), set(lent))
                continue
            away, lent = mark[1:] if mark[0] == row else (set(), set())
            each = [hashes[i : i + _SIZE] for i in range(0, len(hashes), _SIZE)]
            foreign, own, kept, at, size = [], [], [], 0, data[-1]
            seen: set[bytes] = set()
            for i, (h, k) in enumerate(zip(each, lengths, strict=True)):
                if h in away:
                    foreign.append(i)
                elif h not in seen:
                    seen.add(h)
                    kept.append(data[at * size : (at + k) * size])
                    if h in lent:
                        own.append(i)
                at += k
            values = (doc, row, n, before, hashes, lengths, foreign, own, b"".join(kept) + data[-1:] if len(kept) < len(each) else data, merkle(each), part)
            before += n
            for column, value in zip(out, values, strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _IDS_ARROW.values(), strict=True)], names=list(_IDS_ARROW))
    give_back()


def _kept(hashes: bytes, lengths: list[int], foreign: list[int], data: bytes) -> tuple[list[bytes], dict[bytes, bytes]]:
    """The recipe, and the chunks that the row keeps by address."""
    each = [hashes[i : i + _SIZE] for i in range(0, len(hashes), _SIZE)]
    found: dict[bytes, bytes] = {}
    away, at, size = {each[i] for i in foreign}, 0, data[-1]
    for h, k in zip(each, lengths, strict=True):
        if h not in away and h not in found:
            found[h] = data[at : at + k * size]
            at += k * size
    return each, found


def _part_roots(held: DataFrame) -> DataFrame:
    """``part, rows, ids, part_root``: the last is the Merkle root over the roots of a part's documents, of 1,024 children at most on two levels."""
    level = held.select("part", "n_tokens", F.hex("root").alias("hash"), F.row_number().over(Window.partitionBy("part").orderBy("before", "row")).alias("at"))
    level = level.withColumn("rows", F.lit(1).cast("long"))
    for width in (1024, 1024, None):
        block = F.floor((F.col("at") - 1) / width) + 1 if width else F.lit(1)
        ordered = F.array_sort(F.collect_list(F.struct("at", "hash")))
        level = level.groupBy("part", block.cast("long").alias("block")).agg(F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("hash")).withColumnRenamed("block", "at")
    return level.select("part", "rows", F.col("n_tokens").alias("ids"), F.col("hash").alias("part_root"))


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, verified`` of each document, read back from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is of the ids
    as they were put together again. ``verified`` says that every chunk has the hash
    that is its address, the recipe has its Merkle root and its length, and the
    document's part is as the manifest says. ``with_ids`` adds ``ids`` (binary,
    little-endian unsigned 32-bit). A store of an empty table gives no rows; a
    document with a lost chunk comes without it and unverified.
    """
    held = spark.read.schema(_IDS).parquet(f"{path}/ids")
    # One row a part: as many as the files, whatever the documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")).join(verify_manifest(spark, path).withColumnRenamed("verified", "sound"), "part", "full")
    lent = arrow_map(held.where(F.size("lent") > 0).select("hashes", "lengths", "foreign", "lent", "data"), "hash binary, chunk binary", lambda: _lend, column=4)
    wanted = _addresses(held.where(F.size("foreign") > 0), ["row"], "foreign")
    borrowed = wanted.join(lent, "hash").groupBy("row").agg(F.collect_list("chunk").alias("borrowed"))
    columns = ("doc_id", "part", "before", "n_tokens", "hashes", "lengths", "foreign", "data", "root")
    own = held.where(F.size("foreign") == 0).select(*columns, F.lit(None).cast("array<binary>").alias("borrowed"))
    mended = held.where(F.size("foreign") > 0).select("row", *columns).join(borrowed, "row", "left").select(*columns, "borrowed")

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sums, sound, ids = [], [], [], []
        for n, hashes, lengths, foreign, data, root, chunks in zip(*(batch.column(i).to_pylist() for i in range(3, 10))):
            each, found = _kept(hashes, lengths, foreign, data)
            good = all(digest(x) == h for h, x in found.items()) and merkle(each) == root
            for chunk in chunks or ():
                found[digest(chunk)] = chunk
            good &= all(h in found for h in each)
            # Nothing was taken out of the data where all chunks are there once.
            whole = data[:-1] if not foreign and len(found) == len(each) else b"".join([found.get(h, b"") for h in each])
            wide = np.frombuffer(whole, f"<u{data[-1]}").astype("<u4").tobytes()
            counts.append(len(wide) // 4)
            sums.append(zlib.crc32(wide))
            sound.append(good and len(wide) == 4 * n)
            ids.append(wide if with_ids else None)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(sound, pa.bool_()), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32", "verified", "ids"])

    schema = "doc_id long, part long, before long, n_tokens long, ids_crc32 long, verified boolean, ids binary"
    rows = arrow_map(own, schema, lambda: rebuilt, column=7).unionByName(arrow_map(mended, schema, lambda: rebuilt, column=7)).join(bases, "part")
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", (F.col("verified") & F.col("sound")).alias("verified"), *["ids"] * with_ids)


def _lend(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, chunks = [], []
    for own, lengths, foreign, lent, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
        each, found = _kept(own, lengths, foreign, data)
        hashes += [each[i] for i in lent]
        chunks += [found[each[i]] for i in lent]
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(chunks, pa.binary())], names=["hash", "chunk"])


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, verified``: whether each part has the rows, ids and Merkle root that the manifest says."""
    now = _part_roots(spark.read.schema(_IDS).parquet(f"{path}/ids")).toDF("part", "rows_now", "ids_now", "root_now")
    same = F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("ids").eqNullSafe(F.col("ids_now")) & F.col("part_root").eqNullSafe(F.col("root_now"))
    return spark.read.parquet(f"{path}/manifest").join(now, "part", "full").select("part", same.alias("verified"))
