"""Top-k retrieval: exact dense cosine, BM25 over postings, reciprocal rank fusion, reranking.

Queries are a small table, the collection is large. Dense scores come from blocks of
queries (bounded, sent to the tasks) held against batches of vectors, each task
keeping its best k only. BM25 counts the queries' terms where a text is read and scores
the counts against blocks of queries in the same way. Ties are settled by id, so
results are the same on every run.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.functions.text import sigmoid, tokens
from granary.functions.words import terms_of
from granary.operators.models import BatchScorer
from granary.workspace import bounded_batches, shared_dir, written

#: Query vectors in one block: 4,096 of 1,024 doubles are 32 MB.
QUERY_BLOCK = 4096
#: Different terms of all queries of one search, which the driver and each task hold.
TERMS = 1_000_000
#: Digits that scores are rounded to before ranking, so that the order of a sum doesn't matter.
DIGITS = 6
# English stop words that sparse search leaves out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def in_scope(chunks: DataFrame, document_ids: DataFrame | list[str] | None = None, fingerprints: DataFrame | list[str] | None = None, include_auxiliary: bool = False) -> DataFrame:
    """The chunks of a scope, by document and by index state; auxiliary ones only where asked for.

    Lists given but empty leave nothing. A DataFrame of ids is a semi join, which
    Spark broadcasts where it is small. A chunk without a role is kept.
    """
    out = chunks
    for name, wanted, key in (("document_id", document_ids, F.col("document_id")), ("fingerprint", fingerprints, F.col("metadata.index_fingerprint"))):
        if isinstance(wanted, DataFrame):
            out = out.join(wanted.select(F.col(wanted.columns[0]).alias(f"_{name}")).distinct(), key == F.col(f"_{name}"), "left_semi")
        elif wanted is not None:
            out = out.where(key.isin(*set(wanted))) if len(wanted) else out.where(F.lit(False))
    return out if include_auxiliary else out.where(~F.col("metadata.retrieval_role").eqNullSafe("auxiliary"))


def best(scored: DataFrame, k: int, by: Column | None = None, group: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """``scored`` with ``rank`` from 1, the ``k`` best of each query; Spark cuts each partition to k before the exchange."""
    order = Window.partitionBy(group).orderBy(by if by is not None else F.col("score").desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, null for a zero vector: for few pairs; searches use :func:`dense_search`."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class _Best:
    """The ``k`` best of each query that a task has seen: the larger score, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)  # the k-th best score so far

    def offer(self, query: int, scores: np.ndarray, ids: list, carried: list[list]) -> None:
        """New candidates of one query, at their places in ``ids`` and in the columns of ``carried``."""
        at = np.flatnonzero(scores >= self.floor[query])
        if len(at) > self.k:  # all that equal the k-th stay, to be told apart by id
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        if not len(at):
            return
        rows = self.rows[query] + [(-scores[i], ids[i], *(c[i] for c in carried)) for i in at.tolist()]
        rows.sort(key=lambda r: r[:2])
        self.rows[query] = rows[: self.k]
        if len(rows) >= self.k:
            self.floor[query] = -rows[self.k - 1][0]

    def batch(self, names: list, fields: list[pa.Field]) -> pa.RecordBatch:
        each = [(name, *row) for name, rows in zip(names, self.rows, strict=True) for row in rows]
        columns = list(zip(*each)) if each else [()] * len(fields)
        columns[1], columns[2] = columns[2], [-x for x in columns[1]]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, same_too: bool = True, block: int = QUERY_BLOCK, digits: int = DIGITS) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` vectors of the largest cosine for each query, exactly.

    ``vectors``: ``chunk_id, dense``; ``queries``: ``query_id, dense``. Null, zero and non-finite
    vectors and other dimensions match nothing. Queries go to the tasks in blocks of
    ``block``; a task returns its k best of each. ``same_too=False`` leaves out the
    vector whose id is the query's.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    sound = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    asked = queries.select("query_id", F.col("dense").cast("array<double>").alias("dense")).where(sound(F.col("dense")))
    total = asked.count()
    parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total // block))) == b) for b in range(-(-total // block))]
    held = vectors.select("chunk_id", F.col("dense").cast("array<double>").alias("dense")).where(sound(F.col("dense")))
    fields = T.StructType([queries.schema["query_id"], vectors.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    kept = k + 1 - same_too
    found = None
    for part in parts:
        rows = part.collect()  # one block
        by_size: dict[int, tuple[list[int], np.ndarray]] = {}
        for n in {len(r["dense"]) for r in rows}:
            own = [i for i, r in enumerate(rows) if len(r["dense"]) == n]
            m = np.array([rows[i]["dense"] for i in own])
            by_size[n] = (own, m / np.linalg.norm(m, axis=1, keepdims=True))
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], by_size))

        def run(batches, sent=sent):
            names, sizes_ = sent.value
            best_ = _Best(len(names), kept)
            for batch in batches:
                ids, column = batch.column(0), batch.column(1)
                offsets = column.offsets.to_numpy()
                flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
                for n, (own, unit) in sizes_.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    m = flat[offsets[at][:, None] - offsets[0] + np.arange(n)]
                    scores = np.round(unit @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, digits)
                    here = ids.take(pa.array(at)).to_pylist()
                    for q, row in zip(own, scores):
                        best_.offer(q, row, here, [])
            yield best_.batch(names, _arrow_fields(fields))

        one = held.mapInArrow(run, fields)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return held.select(F.lit(None).cast(fields["query_id"].dataType).alias("query_id"), "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    return best(found if same_too else found.where("query_id <> chunk_id"), k)


def _arrow_fields(fields: T.StructType) -> list[pa.Field]:
    return list(to_arrow_schema(fields))


def terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(*stop_words)) if stop_words else tokens(text)


def term_counts(chunks: DataFrame, wanted: list[str], carry: list[str] = [], stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``chunk_id, dl, terms, tfs`` and the carried columns: counts of the ``wanted`` terms (by place) in each chunk.

    One narrow pass: the words of a chunk are counted where it is read and only wanted ones leave it. ``dl`` is its
    number of terms without stop words.
    """
    spark = chunks.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((wanted, stop_words))

    def run(batches):
        value_set = pa.array([*sent.value[0], *sent.value[1]], pa.large_string())
        n_wanted = len(sent.value[0])
        for batch in batches:
            found, ends = terms_of([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            code = pc.fill_null(pc.index_in(found, value_set=value_set), -1).to_numpy()
            doc = np.searchsorted(ends, np.arange(len(code)), "right")
            length = np.bincount(doc[code < n_wanted], minlength=batch.num_rows)
            hit = (code >= 0) & (code < n_wanted)
            key, tf = np.unique(doc[hit].astype(np.int64) * (n_wanted + 1) + code[hit], return_counts=True)
            at = np.searchsorted(key // (n_wanted + 1), np.arange(batch.num_rows + 1))
            of = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(length, pa.int32()), of(key % (n_wanted + 1)), of(tf)], names=[*names, "dl", "terms", "tfs"])

    names = ["chunk_id", *carry]
    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", dl int, terms array<int>, tfs array<int>"
    return chunks.select(*names, "text").mapInArrow(run, schema)


def weighted_terms(chunks: DataFrame, queries: DataFrame, carry: list[str] = [], k1: float = 1.2, b: float = 0.75, average: float = 100.0) -> tuple[DataFrame, list[str]]:
    """``chunk_id, terms, weights`` and the carried columns of the chunks with some query's term, and the terms.

    Weights are BM25's with the collection's document frequencies: one narrow scan of the texts, whose
    counts are written, and one grouped sum that shuffles a row for each term and task. The queries' terms
    are a stated set and reach the driver: at most ``TERMS``.
    """
    spark = chunks.sparkSession
    wanted = sorted(r["term"] for r in queries.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct().limit(TERMS + 1).collect())
    if len(wanted) > TERMS:
        raise ValueError(f"The queries have more than {TERMS} different terms: ask in parts.")
    path = shared_dir(spark, "term-counts")
    term_counts(chunks, wanted, carry).write.parquet(path)
    counted = spark.read.parquet(path)
    rows = counted.where(F.size("terms") > 0).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    n = counted.count()
    idf = np.zeros(len(wanted))
    for r in rows:
        idf[r["term"]] = math.log1p((n - r["df"] + 0.5) / (r["df"] + 0.5))
    table = F.split(F.lit(",".join(repr(float(x)) for x in idf)), ",").cast("array<double>")
    norm = k1 * (1 - b + b * F.col("dl") / average)
    weights = F.zip_with("terms", "tfs", lambda t, tf: F.get(table, t) * tf * (k1 + 1) / (tf + norm))
    return counted.where(F.size("terms") > 0).select("chunk_id", *carry, "terms", weights.alias("weights")), wanted


def sparse_search(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, average: float = 100.0, digits: int = DIGITS, carry: list[str] = [], block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, chunk_id, score, rank``: BM25 with a constant average length and the collection's document frequencies.

    ``chunks``: ``chunk_id, text``; ``queries``: ``query_id, text``. Each different term of a query
    counts once. Two narrow passes, :func:`weighted_terms` and the scoring of its rows against blocks of queries:
    no text and no posting is shuffled, a task returns its k best of each query. Small columns of ``chunks`` can be
    carried along.
    """
    spark = chunks.sparkSession
    weighted, wanted = weighted_terms(chunks, queries, carry, k1, b, average)
    place = {t: i for i, t in enumerate(wanted)}
    asked = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms"))
    total = asked.count()
    n_blocks = max(1, -(-total // block))
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType()), *(chunks.schema[c] for c in carry)])
    found = None
    for part in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == part).collect()  # one block
        # Which queries ask for each term.
        pairs = sorted((place[t], q) for q, r in enumerate(rows) for t in r["terms"] or ())
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array(pairs, np.int64).reshape(-1, 2)))

        def run(batches, sent=sent):
            names, pairs_ = sent.value
            at = np.searchsorted(pairs_[:, 0], np.arange(len(wanted) + 1))
            best_ = _Best(len(names), k)
            for batch in batches:
                lists, weight = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).flatten().to_numpy()
                term = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                times = at[term + 1] - at[term]
                to = np.cumsum(times)
                if not len(to) or not to[-1]:
                    continue
                query = pairs_[np.repeat(at[term] - (to - times), times) + np.arange(to[-1]), 1]
                key = query * batch.num_rows + np.repeat(doc, times)
                every, of = np.unique(key, return_inverse=True)
                score = np.round(np.bincount(of, np.repeat(weight, times)), digits)
                who = every // batch.num_rows
                ids, carried = batch.column(0).to_pylist(), [batch.column(i).to_pylist() for i in range(1, 1 + len(carry))]
                bounds = np.flatnonzero(np.diff(who, prepend=-1)).tolist()
                for x, y in zip(bounds, [*bounds[1:], len(who)]):
                    q = int(who[x])
                    good = np.flatnonzero(score[x:y] >= best_.floor[q])
                    if len(good):
                        docs = (every[x:y][good] % batch.num_rows).tolist()
                        best_.offer(q, score[x:y][good], [ids[d] for d in docs], [[c[d] for d in docs] for c in carried])
            yield best_.batch(names, _arrow_fields(schema))

        one = weighted.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    # At most k rows a query: written, so that what is joined to them knows how few they are.
    return written(best(found, k), "search")


def fuse(legs: list[DataFrame], k: int, rrf_k: int = 60, rank_base: int = 1, digits: int = 9) -> DataFrame:
    """``query_id, chunk_id, score, rank``: reciprocal rank fusion of ranked legs; a leg without a chunk adds nothing."""
    every = legs[0].select("query_id", "chunk_id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "chunk_id", "rank"))
    every = every.repartition("query_id", "chunk_id")
    share = 1 / (F.col("rank") - 1 + rank_base + F.lit(float(rrf_k)))
    return best(every.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), digits).alias("score")), k)


Scorer = Callable[[Column, Column], Column]


def overlap_logit(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: a logit of the share of the question's different tokens that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(text))) * 6.0, F.size(asked)), F.lit(0.0)) - 3.0, 9)


def rerank(results: DataFrame, k: int, scorer: Scorer | BatchScorer = overlap_logit, question_col: str = "question", text_col: str = "text") -> DataFrame:
    """``results`` (with ``rank``) ordered anew by the scorer's probability; equal ones keep their order. ``score`` is replaced.

    The scorer is a column expression or a model that takes batches of pairs.
    """
    given = results.withColumnRenamed("rank", "prior_rank")
    given, logit = (scorer.logits(given, question_col, text_col), F.col("_logit")) if isinstance(scorer, BatchScorer) else (given, scorer(F.col(question_col), F.col(text_col)))
    scored = given.withColumn("score", F.round(sigmoid(logit), 9)).drop("_logit")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "prior_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def above_floor(results: DataFrame, minimum: float) -> DataFrame:
    """A score floor, applied to what the top-k left."""
    return results.where(F.col("score") >= minimum)
