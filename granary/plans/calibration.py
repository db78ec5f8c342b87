"""Calibration pairs: batches of documents, every question against each batch, resumable."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import retrieval
from granary.operators.repeats import numbered
from granary.sources.candidates import TRIES, with_retries
from granary.sources.store import JsonFile
from granary.workspace import bounded_batches

BATCH = 10
# The columns of the pairs and, below, the keys of the state file.
PAIR_COLUMNS = ("dimension_id", "category_id", "batch_number", "question_number", "question", "rank", "document", "document_id", "chunk_id", "page", "chunk_number", "retrieval_score", "chunk_text", "related")


def document_batches(documents: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """``documents`` (with ``dimension_id``) with ``position`` and ``batch_number`` from 1; no dimension's documents meet in one task."""
    placed = numbered(documents, ["dimension_id"], order, "position")
    return placed.withColumn("batch_number", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))


def jobs(batches: DataFrame, questions: DataFrame) -> DataFrame:
    """``dimension_id, batch_number, documents, questions``: a job for each batch, documents in order. A dimension without documents fails."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "document_id"))), lambda d: d["document_id"])
    asked = questions.groupBy("dimension_id").agg(F.array_sort(F.collect_list(F.struct("category_no", "question_no", "category_id", "question"))).alias("questions"))
    made = asked.join(batches.groupBy("dimension_id", "batch_number").agg(listed.alias("documents")), "dimension_id", "left")
    checked = F.when(F.col("batch_number").isNull(), F.raise_error(F.concat(F.lit("No documents found for dimension "), "dimension_id"))).otherwise(F.col("batch_number"))
    return made.select("dimension_id", checked.alias("batch_number"), "documents", "questions")


#: Pairs of a chunk and a question that are scored at once.
PAIRS_AT_ONCE = 1 << 18


def scored_chunks(weighted: DataFrame, asked: list[tuple[str, list[int]]]) -> DataFrame:
    """``weighted`` (``dimension_id`` and, last, ``terms, weights``) with ``found``, the places in ``asked`` of the questions met, and their ``scores``, in place of these two.

    ``asked``: dimension and different terms of each question; a question meets the chunks of its own dimension only.
    """
    spark = weighted.sparkSession
    bounded_batches(spark)
    dimensions = sorted({d for d, _ in asked if d is not None})
    code = {d: i for i, d in enumerate(dimensions)}
    width = 1 + max((t for _, terms in asked for t in terms), default=0)
    pairs = np.array(sorted((code[d] * width + t, q) for q, (d, terms) in enumerate(asked) if d is not None for t in terms), np.int64).reshape(-1, 2)
    most = max(Counter(d for d, _ in asked).values(), default=1)
    sent = spark.sparkContext.broadcast((dimensions, pairs))
    at = weighted.columns.index("dimension_id")
    names = [*weighted.columns[:-2], "found", "scores"]

    def run(batches):
        known, (place, question) = sent.value[0], sent.value[1].T
        step = max(1, PAIRS_AT_ONCE // most)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists, weight = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).flatten().to_numpy()
                own = pc.fill_null(pc.index_in(batch.column(at), value_set=pa.array(known, batch.column(at).type)), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                # Chunks of a dimension without questions have places below all others.
                wanted = own[row] * width + np.where(own[row] < 0, 0, lists.flatten().to_numpy())
                wanted[own[row] < 0] = -1
                first = np.searchsorted(place, wanted)
                times = np.searchsorted(place, wanted, "right") - first
                to = np.cumsum(times)
                which = question[np.repeat(first - (to - times), times) + np.arange(to[-1] if len(to) else 0)]
                every, of = np.unique(np.repeat(row, times) * len(asked) + which, return_inverse=True)
                score = np.bincount(of, np.repeat(weight, times), len(every))
                ends = pa.array(np.searchsorted(every, np.arange(batch.num_rows + 1) * len(asked)), pa.int32())
                lists_of = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists_of(every % len(asked), pa.int32()), lists_of(score, pa.float64())], names=names)

    schema = T.StructType([*weighted.schema.fields[:-2], T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return weighted.mapInArrow(run, schema)


def batch_pairs(chunks: DataFrame, batches: DataFrame, questions: DataFrame, k: int = 20, texts: bool = True) -> DataFrame:
    """``PAIR_COLUMNS`` of sparse retrieval: each question against each batch of its dimension, the ``k`` best of each.

    ``chunks``: ``document_id, chunk_id, text, source, page, number``. A batch is a scope, so
    the rank is within batch and question; document frequencies are the collection's. Pairs
    are scored by chunk before anything is shuffled, and dealt by dimension and batch. ``texts=False``
    leaves out ``chunk_text``, which a pair repeats for each question: :func:`batch_texts` has each once.
    """
    spark = chunks.sparkSession
    asked = questions.select("dimension_id", "category_id", F.col("question_no").alias("question_number"), "question")
    weighted, terms = retrieval.weighted_terms(chunks, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), ["document_id", "source", "page", "number"])
    place = {t: i for i, t in enumerate(terms)}
    # The questions are a stated set, whose terms the driver holds already.
    rows = asked.withColumn("_terms", F.array_distinct(retrieval.terms(F.col("question")))).collect()
    named = spark.createDataFrame([(i, *r[1:-1]) for i, r in enumerate(rows)], T.StructType([T.StructField("_asked", T.IntegerType()), *asked.schema.fields[1:]]))
    placed = weighted.join(batches.select("document_id", "dimension_id", "batch_number"), "document_id")
    small = ["dimension_id", "batch_number", "chunk_id", "document_id", "source", "page", "number"]
    scored = scored_chunks(placed.select(*small, "terms", "weights"), [(r["dimension_id"], [place[t] for t in r["_terms"] or ()]) for r in rows]).where("size(found) > 0")
    each = scored.repartition("dimension_id", "batch_number").select(*small, F.inline(F.arrays_zip(F.col("found").alias("_asked"), F.col("scores").alias("score")))).withColumn("score", F.round("score", retrieval.DIGITS))
    order = Window.partitionBy("dimension_id", "batch_number", "_asked").orderBy(F.col("score").desc(), "chunk_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = ranked.join(F.broadcast(named), "_asked")
    out = best.select(
        "dimension_id", "category_id", "batch_number", "question_number", "question", "rank", F.col("source").alias("document"), "document_id", "chunk_id", "page", F.col("number").alias("chunk_number"),
        F.col("score").alias("retrieval_score"), F.lit("").alias("related"),
    )
    return out.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").select(*PAIR_COLUMNS) if texts else out


def batch_texts(chunks: DataFrame, batches: DataFrame) -> DataFrame:
    """``dimension_id, batch_number, chunk_id, text``: the texts of each batch, once."""
    return chunks.select("document_id", "chunk_id", "text").join(batches.select("document_id", "dimension_id", "batch_number"), "document_id").drop("document_id")


def signature(configuration: dict, ontology: bytes, files: list[tuple[str, int, int]]) -> str:
    """Of the settings, the ontology's bytes and each file's path, size and time: work is resumed only where it is equal."""
    manifest = {"configuration": configuration, "ontology_sha256": hashlib.sha256(ontology).hexdigest(), "documents": [{"path": p, "size": s, "modified_ns": t} for p, s, t in files]}
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def state(signature_: str, completed: int, total: int, last: dict | None = None, error: str | None = None) -> dict:
    """What the state file holds."""
    status = "failed" if error else "completed" if completed == total else "running"
    return {"version": 1, "signature": signature_, "status": status, "completed_batches": completed, "total_batches": total, "last_completed": last, "error": error}


def pending_jobs(made: DataFrame, done: DataFrame, known_signature: str | None, signature_: str) -> DataFrame:
    """Jobs that ``done`` (``dimension_id, batch_number``) lacks.

    Another signature, or finished work that isn't the first part of the jobs, is an error.
    """
    if known_signature is not None and known_signature != signature_:
        raise ValueError("The checkpoint belongs to other inputs or settings.")
    keys = ["dimension_id", "batch_number"]
    finished = done.select(*keys).distinct().withColumn("done", F.lit(True))
    marked = made.join(finished, keys, "left")
    unknown = finished.join(made.select(*keys), keys, "left_anti").count()
    last_done = marked.where("done").agg(F.max(F.struct(*keys)).alias("x"))
    gaps = marked.where("done is null").crossJoin(F.broadcast(last_done)).where(F.struct(*keys) < F.col("x")).count()
    if unknown or gaps:
        raise ValueError("The checkpoint is not a contiguous prefix of the jobs.")
    return marked.where("done is null").drop("done")


RESULTS = "array<struct<question:string,matches:array<struct<document_id:string,chunk_id:string,rank:int,score:double>>>>"


def check_results(jobs_: DataFrame, results: DataFrame) -> DataFrame:
    """``dimension_id, batch_number, error`` of each job: null, or the first rule that its results break.

    ``results``: ``dimension_id, batch_number, results`` (``RESULTS``), a result for each
    question, in the job's order, with documents of the batch only. One join on the job's key.
    """
    keys = ["dimension_id", "batch_number"]
    both = jobs_.join(results, keys, "left")
    order = F.exists(F.zip_with("questions", "results", lambda q, r: ~q["question"].eqNullSafe(r["question"])), lambda x: x)
    stray = F.exists("results", lambda r: F.exists(F.coalesce(r["matches"], F.array().cast("array<struct<document_id:string,chunk_id:string,rank:int,score:double>>")), lambda m: ~F.array_contains("documents", m["document_id"])))
    error = F.when(F.col("results").isNull() | (F.size("results") != F.size("questions")), "wrong question count").when(order, "changed question order").when(stray, "result escaped document batch")
    return both.select(*keys, error.alias("error"))


def zipped_results(jobs_: DataFrame, results: DataFrame) -> DataFrame:
    """``dimension_id, batch_number, category_id, question_number, question`` and the match's columns: results by their place beside the questions."""
    both = jobs_.join(results, ["dimension_id", "batch_number"])
    each = both.select("dimension_id", "batch_number", F.inline(F.arrays_zip("questions", "results"))).select("dimension_id", "batch_number", F.col("questions.category_id").alias("category_id"), F.col("questions.question_no").alias("question_number"), F.col("questions.question").alias("question"), F.explode("results.matches").alias("m"))
    return each.select("dimension_id", "batch_number", "category_id", "question_number", "question", "m.*")


class Checkpoint:
    """Finished rows in job order and the state beside them, in one folder.

    A group of jobs is a Parquet part of its own, so a commit never rewrites what was
    committed before; the state is replaced by one rename.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.file = JsonFile(spark, f"{self.path}/state.json")

    def rows(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/rows")

    def commit(self, rows: DataFrame, before: int, state_: dict) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/from-{before:09d}")
        self.file.write(state_)


def ordered_jobs(jobs_: DataFrame) -> DataFrame:
    """``jobs_`` with ``job_no`` from 1, by dimension and batch."""
    return numbered(jobs_.withColumn("_all", F.lit(1)), ["_all"], ["dimension_id", "batch_number"], "job_no").drop("_all")


def run_jobs(jobs_: DataFrame, request: Callable[[DataFrame], DataFrame], checkpoint: Checkpoint, signature_: str, group: int = 8, tries: int = TRIES, first_delay: float = 1.0, **patience) -> int:
    """Run what ``checkpoint`` lacks, in job order, and return how many jobs are finished.

    ``request`` makes the rows (with ``dimension_id, batch_number``) of some jobs; ``group`` jobs
    run at once, as one Spark job, and are committed together with the state. A failing
    group is tried again after growing delays, unless it was refused; then the state
    says so and the error is raised. Finished rows without a state are adopted; a state
    that counts finished jobs without their rows, another signature, and rows that
    aren't the first jobs' are errors.
    """
    known, done = checkpoint.file.read(), checkpoint.rows()
    if done is None and known and known["completed_batches"]:
        raise ValueError("The state counts finished batches, but their rows are missing.")
    numbered_jobs = ordered_jobs(jobs_)
    total = numbered_jobs.count()
    left = pending_jobs(numbered_jobs, done if done is not None else numbered_jobs.limit(0), known["signature"] if known else None, signature_)
    completed = total - left.count()
    while completed < total:
        now = left.where(F.col("job_no").between(completed + 1, completed + group))
        after = min(total, completed + group)
        last = now.orderBy(F.col("job_no").desc()).select("dimension_id", "batch_number").first().asDict()
        try:
            with_retries(lambda: checkpoint.commit(request(now), completed, state(signature_, after, total, last)), tries, first_delay, **patience)
        except Exception as error:
            checkpoint.file.write(state(signature_, completed, total, known["last_completed"] if known else None, str(error)[:500]))
            raise
        completed, known = after, {"last_completed": last}
    return completed
