"""Where models plug in, with deterministic stand-ins: embedder, generator, analyzer, recogniser.

A model is a DataFrame function, so an Arrow batch function or a column expression
serves alike. The stand-ins need no files and give the same values everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import QUERY_PREFIX
from granary.functions.text import sentences
from granary.functions.words import terms_of
from granary.workspace import bounded_batches

#: Hashes of terms that a task remembers, before it begins anew.
KNOWN_TERMS = 500_000


class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """``dense array<float>`` beside the columns of ``texts`` (with ``text``)."""

    def embed_queries(self, queries: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def generate(self, prompts: DataFrame) -> DataFrame:
        """``query_id, answer`` of ``query_id, question, context``."""


class Analyzer(Protocol):
    def match(self, questions: DataFrame) -> DataFrame:
        """``question_id, content`` (JSON) of ``question_id, query, results array<struct<rank,chunk_id,text>>``."""


class HashingEmbedder:
    """Signed counts of hashed tokens, scaled to unit length."""

    def __init__(self, size: int = 64, prefix: str = QUERY_PREFIX):
        self.size, self.prefix = size, prefix

    def embed(self, texts: DataFrame) -> DataFrame:
        size, at = self.size, texts.columns.index("text")
        bounded_batches(texts.sparkSession)
        schema = T.StructType([*texts.schema.fields, T.StructField("dense", T.ArrayType(T.FloatType()))])

        def run(batches):
            known: dict[str, int] = {}
            for batch in batches:
                found, ends = terms_of([t or "" for t in batch.column(at).to_pylist()])
                coded = found.dictionary_encode()
                different = coded.dictionary.to_pylist()
                if len(known) > KNOWN_TERMS:
                    known.clear()
                # The first 32 bits of a term's MD5: the lowest digits choose the place, the highest bit the sign.
                new = [t for t in different if t not in known]
                known.update(zip(new, (int.from_bytes(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:4], "big") for t in new)))
                h = np.array([known[t] for t in different], np.int64)[coded.indices.to_numpy()]
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
                v = np.bincount(row * size + h % size, np.where(h >> 31, -1, 1), batch.num_rows * size).reshape(-1, size).astype(np.float32)
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = v / np.where(norm, norm, np.float32(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * size, pa.int32()), pa.array(v.reshape(-1)))], names=schema.fieldNames())

        return texts.mapInArrow(run, schema)

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        prefixed = queries.withColumn("text", F.concat(F.lit(self.prefix), "text"))
        return self.embed(prefixed).withColumn("text", F.substring("text", len(self.prefix) + 1, 1 << 30))


class FirstSentences:
    """Answers with the first sentence of the context."""

    def generate(self, prompts: DataFrame) -> DataFrame:
        body = F.regexp_replace("context", r"^[^\n]*\n", "")
        return prompts.select("query_id", F.coalesce(F.get(sentences(body), F.lit(0)), F.lit("")).alias("answer"))


class FirstQuotes:
    """Proposes of each of the first three passages its first sentence as evidence, and the first passage's twice."""

    def match(self, questions: DataFrame) -> DataFrame:
        first = F.slice(F.array_sort("results"), 1, 3)
        one = lambda r: F.struct(F.lit("explicit").alias("explicitness"), F.lit("first sentence").alias("reason"), F.array(F.struct(r["chunk_id"].alias("chunkId"), F.substring(F.get(sentences(r["text"]), F.lit(0)), 1, 600).alias("quote"))).alias("evidence"))
        matches = F.transform(F.concat(first, F.slice(first, 1, 1)), one)
        return questions.select("question_id", F.to_json(F.struct(matches.alias("matches"))).alias("content"))


_MODELS: dict[str, Callable] = {}


def loaded_model(name: str, load: Callable[[], Callable]) -> Callable:
    """``load()``, once for each name in a Python worker, whatever the number of tasks it runs."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


class BatchScorer:
    """A cross-encoder in Arrow batches: ``load()`` gives ``(questions, texts) -> logits``, a forward pass for a list of pairs.

    The model is loaded once in a Python worker, under ``name``, and gets at most ``batch`` pairs at a time.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], batch: int = 32):
        self.name, self.load, self.batch = name, load, batch

    def logits(self, results: DataFrame, question_col: str, text_col: str) -> DataFrame:
        """``results`` with ``_logit``; null texts are empty."""
        bounded_batches(results.sparkSession)
        given = results.columns
        schema = T.StructType([*results.schema.fields, T.StructField("_logit", T.DoubleType())])
        at, name, load, size = (given.index(question_col), given.index(text_col)), self.name, self.load, self.batch

        def run(batches):
            model = loaded_model(name, load)
            for batch in batches:
                asked, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in at)
                out = [float(x) for i in range(0, len(asked), size) for x in model(asked[i : i + size], texts[i : i + size])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=schema.fieldNames())

        return results.mapInArrow(run, schema)


class PromptedModel:
    """A generator and analyzer behind a chat service: ``call`` answers a list of requests (JSON) with a list of texts.

    A request has the model's name, a temperature, a system and a user message and,
    for matches, the JSON schema that the answer must have.
    """

    ANSWER = "Answer the question from the passages alone, and say so where they don't hold the answer."
    MATCH = "Find the passages that answer the question. Quote them word for word, name the chunk, and give a reason."
    SCHEMA = '{"type":"object","required":["matches"],"properties":{"matches":{"type":"array","items":{"type":"object","required":["explicitness","reason","evidence"],"properties":{"explicitness":{"enum":["explicit","implicit"]},"reason":{"type":"string"},"evidence":{"type":"array","items":{"type":"object","required":["chunkId","quote"],"properties":{"chunkId":{"type":"string"},"quote":{"type":"string"}}}}}}}}}'

    def __init__(self, call: Callable[[list[str]], list[str]], model: str = "model", temperature: float = 0.0):
        self.call, self.model, self.temperature = call, model, temperature

    def requests(self, rows: DataFrame, key: str, system: str, user, schema: str | None = None) -> DataFrame:
        """``key, request``."""
        message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        fields = [F.lit(self.model).alias("model"), F.lit(self.temperature).alias("temperature"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages")]
        return rows.select(key, F.to_json(F.struct(*fields, *([F.lit(schema).alias("format")] if schema else []))).alias("request"))

    def _called(self, requests: DataFrame, out: str) -> DataFrame:
        bounded_batches(requests.sparkSession)
        call, names = self.call, [requests.columns[0], out]

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(call(batch.column(1).to_pylist()), pa.string())], names=names)

        return requests.mapInArrow(run, f"{names[0]} {requests.dtypes[0][1]}, {out} string")

    def generate(self, prompts: DataFrame) -> DataFrame:
        user = F.concat(F.lit("Passages:\n"), "context", F.lit("\n\nQuestion: "), "question")
        return self._called(self.requests(prompts, "query_id", self.ANSWER, user), "answer")

    def match(self, questions: DataFrame) -> DataFrame:
        passages = F.array_join(F.transform("results", lambda r: F.concat(F.lit("[Chunk "), r["chunk_id"].cast("string"), F.lit("]\n"), r["text"])), "\n\n")
        return self._called(self.requests(questions, "question_id", self.MATCH, F.concat("query", F.lit("\n\nPassages:\n"), passages), self.SCHEMA), "content")
