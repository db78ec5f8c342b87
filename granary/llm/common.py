"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch, for all operators alike: texts may be very long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch to ours, where they are higher.

    Spark has these bounds for a session only and reads them when a plan is made. They
    are the same for all operators and are never raised, so plans that run later keep
    theirs; what a task works on at once is bounded by :func:`sliced` all the same.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``most`` bytes of that column, or of one row; empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        values = values if pa.types.is_string(values.type) or pa.types.is_binary(values.type) else values.cast(pa.binary())
        if values.nbytes <= most:
            yield batch
            continue
        ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Return scratch memory to the system: a Python worker outlives its task and runs those of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Executors and driver see that folder alike. Where the setting is missing (a
    local session, as in tests) a temporary folder takes its place; on a cluster
    without it the call fails, since a machine's own folder would lose files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.gettempdir() + "/granary-shared"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Folders that this driver named and hasn't removed. Results that read their folder leave it there.
_MADE: list[str] = []


def scratch_mark() -> int:
    return len(_MADE)


def remove_scratch(spark: SparkSession, mark: int, keep: str) -> None:
    """Delete all folders named since :func:`scratch_mark` but ``keep``; nothing may read them any more."""
    remove(spark, *[p for p in _MADE[mark:] if p != keep])


def stored(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bits of a filter: 4 MB, in blocks of 4 KB, whatever the number of ids.
FILTER_BITS, _BLOCK_BITS = 25, 15


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """``block, bits``: a filter of ``FILTER_BITS`` bits for :func:`in_filter`. Only the ids are shuffled; it is 4 MB at most."""
    h = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << FILTER_BITS))
    placed = ids.select(F.shiftright(h, _BLOCK_BITS).alias("block"), h.bitwiseAND((1 << _BLOCK_BITS) - 1).alias("at")).repartition("block")
    return placed.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def in_filter(df: DataFrame, column: str, bits: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: false only where the id isn't among those of the filter (null ids: false).

    The filter has a proven bound, so it is broadcast; the rows stay where they are. It lets
    through a share of other ids that grows with the number of its ids, so what
    it lets through is then joined exactly where that matters.
    """
    h = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << FILTER_BITS))
    at = h.bitwiseAND((1 << _BLOCK_BITS) - 1)
    marked = df.withColumn("_granary_block", F.when(F.col(column).isNotNull(), F.shiftright(h, _BLOCK_BITS)))
    joined = marked.join(F.broadcast(bits.select(F.col("block").alias("_granary_block"), F.col("bits").alias("_granary_bits"))), "_granary_block", "left")
    byte = F.conv(F.hex(F.substring("_granary_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def remove(spark: SparkSession, *paths: str | None) -> None:
    """Delete intermediate folders that no later plan reads."""
    for path in filter(None, paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def arrow_map(df: DataFrame, schema, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], column: int = 1, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over :func:`sliced` batches with per-task state: ``make`` runs once in each task, before its first row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        try:
            for batch in sliced(batches, column, most):
                step = step or make()
                if (out := step(batch)) is not None:
                    yield out
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table256(keep: Callable[[int], bool], fold: bool) -> bytes:
    """A ``bytes.translate`` table: bytes that aren't kept become a space."""
    return bytes((b + 32 if fold and 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


#: Letters, digits and everything beyond ASCII, A-Z folded: words of op6 and op9.
FOLDED = table256(lambda b: b >= 128 or chr(b).isalnum(), True)
#: White space 9-13 and 32 separates, all else is kept: words of op8.
SPACED = table256(lambda b: not (b == 32 or 9 <= b <= 13), False)


class Words:
    """The words of a batch of texts, found and hashed without a Python loop over words.

    ``texts`` (bytes, None as empty) are translated by ``to``, in which a space
    ends a word. ``hash`` has one well mixed 64-bit value for each word, ``doc``
    the index of its text and ``first`` the index of each text's first word
    (with the total as its last entry). A word's hash is a polynomial over its
    bytes modulo 2^64, taken from prefix sums.
    """

    def __init__(self, texts: list[bytes], to: bytes):
        joined = b" ".join(texts).translate(to) + b" "
        self.bytes = joined
        raw = np.frombuffer(joined, np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = span_hashes(prefix_hashes(raw), self.start, self.end)

    def grams(self, k: int) -> np.ndarray:
        """A hash for the ``k`` words that start at each word, whatever their text."""
        return grams(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Which words start ``k`` consecutive words of one text."""
        n = len(self.doc)
        ok = np.zeros(n, bool)
        if n >= k:
            ok[: n - k + 1] = self.doc[k - 1 :] == self.doc[: n - k + 1]
        return ok


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 << 20:  # those of a very long text aren't kept
            _POWERS[base] = have
    return have[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over bytes, modulo 2^64, up to each place."""
    out = np.zeros(len(raw) + 1, np.uint64)
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers(_BASE, len(raw))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
    """A well mixed hash, never 0, of the bytes from each ``start`` to its ``end``, wherever they are, and of ``kind``."""
    out = sums[end] - sums[start]
    out *= _powers(pow(_BASE, -1, 1 << 64), len(sums))[start]
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out += np.asarray(kind, np.uint64) * np.uint64(0xA0761D6478BD642F)
    return np.maximum(mix64(out), np.uint64(1))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of each run of ``k`` values; the last k - 1 are 0."""
    n = len(values)
    out = np.zeros(n, np.uint64)
    if n < k:
        return out
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc *= np.uint64(0xC2B2AE3D27D4EB4F)
        acc += values[i : n - k + 1 + i]
    out[: n - k + 1] = mix64(acc)
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
