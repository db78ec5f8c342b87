"""Quality classifier by hierarchical empirical Bayes.

Document evidence comes from two logistic models (quality and toxicity) over
shares of character classes, repetition of words and lines, and hits of listed
fragments (six bytes of folded text) that are themselves learned from the labels. The sites then have their say: the
scores of a host's documents are summed by a grouped aggregation, a host's mean
is shrunk towards the global mean, and the mean of each of its paths towards
that of the host. How far is estimated from the data (moments of a
beta-binomial model), so a site of few documents has the mean of those above it.
A document's posterior odds are the odds of its path without itself, times its
own likelihood ratio.

``source`` is read as ``[scheme://]host[/path]``; where it has no path, a host's
language sections stand for its paths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import FOLDED, SPACED, Words, arrow_map, remove, stored, text_bytes

#: Labelled documents that the models are fitted on; more labels are thinned by a hash of the id.
SAMPLE = 4096
#: Bytes of a fragment; one that a text has twice or more is a fragment of its own besides. A listed fragment is this many times as common in documents of its class, and in this share (and number) of them at least.
FRAGMENT = 6
LIFT, SHARE, LEAST, LISTED = 30.0, 0.02, 3, 1024
#: Bytes of text that are worked on at once: each has a fragment of its own, and a fragment takes dozens of bytes.
SLICE = 1 << 20
KEPT_QUALITY, KEPT_TOXICITY = 0.5, 0.5
_EDGE = 1e-6

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([chr(b) in ".,;:'\"-?()" for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()" for b in range(256)])
FEATURES = ("upper", "digit", "mark", "symbol", "word_length", "words", "distinct", "most_common", "repeated_next", "distinct_lines", "bad_fragments", "toxic_fragments")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def fragments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(document, fragment)`` at each byte of the folded texts; a fragment is a number of ``FRAGMENT`` bytes, and none crosses texts."""
    gap = b" " * FRAGMENT
    raw = np.frombuffer((b" " + gap.join(texts) + gap).translate(FOLDED), np.uint8).astype(np.uint64)
    n = len(raw) - FRAGMENT + 1
    value = np.zeros(n, np.uint64)
    for i in range(FRAGMENT):
        value = (value << np.uint64(8)) | raw[i : i + n]
    sizes = np.array([len(t) + FRAGMENT for t in texts], np.int64)
    # The last places of a text's gap would reach into the text after it.
    inside = np.ones(int(sizes.sum()), bool)
    for back in range(1, FRAGMENT):
        inside[np.cumsum(sizes) - back] = False
    inside = inside[:n]
    return np.repeat(np.arange(len(texts)), sizes)[:n][inside], value[inside]


#: Marks a fragment that a text has twice or more.
_TWICE = np.uint64(1 << 8 * FRAGMENT)


def different(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of document and fragment, and then those that occur twice or more, marked."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    twice = np.flatnonzero(new[:-1] & ~new[1:])
    return np.concatenate((doc[new], doc[twice])), np.concatenate((value[new], value[twice] | _TWICE))


class Listed:
    """Fragments to look for: a table of hashed fragments sorts out nearly all others."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.table = np.zeros(1 << 20, bool)
        self.plain = np.unique(self.values & ~_TWICE)
        self.table[self._place(self.plain)] = True

    @staticmethod
    def _place(value: np.ndarray) -> np.ndarray:
        return (value ^ (value >> np.uint64(20))) & np.uint64((1 << 20) - 1)

    def hits(self, doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Different listed fragments of each text, 8 at most."""
        maybe = np.flatnonzero(self.table[self._place(value)]) if len(self.values) else np.zeros(0, int)
        maybe = maybe[np.isin(value[maybe], self.plain)]
        doc, value = different(doc[maybe], value[maybe])
        return np.minimum(np.bincount(doc[np.isin(value, self.values)], minlength=n), 8)


def features(texts: list[bytes], bad: Listed, toxic: Listed) -> np.ndarray:
    """``len(texts) x len(FEATURES)`` values. Hits of fragments count 8 at most, a mean word length 50 at most."""
    n = len(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    size = np.maximum(np.diff(bounds), 1)
    words = Words(texts, SPACED)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    order = np.lexsort((words.hash, words.doc))
    doc, value = words.doc[order], words.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    distinct = np.bincount(doc[starts], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc[starts], np.diff(np.append(starts, len(doc))))
    after = np.zeros(len(words.hash), bool)
    after[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    lines = [len(set(x)) / len(x) for x in (t.split(b"\n") for t in texts)]
    pieces = fragments(texts)
    columns = (
        _per_text(_UPPER[raw], bounds) / size, _per_text(_DIGIT[raw], bounds) / size, _per_text(_MARK[raw], bounds) / size, _per_text(_SYMBOL[raw], bounds) / size,
        np.minimum(size / some, 50.0), np.log1p(count), distinct / some, most / some, np.bincount(words.doc[after], minlength=n) / some, lines,
        bad.hits(*pieces, n), toxic.hits(*pieces, n),
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight[1:] + self.weight[0]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), _EDGE, 1 - _EDGE)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
    """Ridge logistic regression by Newton steps over standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


@dataclass(frozen=True)
class Model:
    """``quality`` and ``toxic`` are None where the labels lack one of the two classes; their rates stand in then."""

    bad: Listed
    toxic_list: Listed
    quality: Logistic | None
    toxic: Logistic | None
    quality_rate: float
    toxic_rate: float

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x = features(texts, self.bad, self.toxic_list)
        of = lambda part, rate: part.probability(x) if part else np.full(len(texts), min(max(rate, _EDGE), 1 - _EDGE))
        return of(self.quality, self.quality_rate), of(self.toxic, self.toxic_rate)


def listed_fragments(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fragments that mark documents of low quality, and those that mark toxic ones.

    Counted by a grouped aggregation over the sample ``text, quality, toxic``; the
    ``LISTED`` best of either kind reach the driver.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bad, toxic = (np.asarray(batch.column(i).to_pylist(), np.int64) for i in (1, 2))
        doc, value = different(*fragments(text_bytes(batch.column(0))))
        each, of = np.unique(value, return_inverse=True)
        sums = [np.bincount(of, w, minlength=len(each)).astype(np.int64) for w in (np.ones(len(doc)), (bad <= 0)[doc], (toxic > 0)[doc])]
        return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), *map(pa.array, sums)], names=["fragment", "n", "bad", "toxic"])

    counts = arrow_map(sample, "fragment long, n long, bad long, toxic long", lambda: step, column=0, most=SLICE).groupBy("fragment").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic")))
    sizes = sample.agg(F.count("*").alias("n"), F.count_if(F.col("quality") <= 0).alias("bad"), F.count_if(F.col("toxic") > 0).alias("toxic")).first()
    usable, path = stored(counts.where(" or ".join(f"{c} >= {max(LEAST, SHARE * sizes[c])}" for c in ("bad", "toxic"))), "quality-fragments")
    out = []
    for c in ("bad", "toxic"):
        lift = ((F.col(c) + 0.5) / (sizes[c] + 1)) / ((F.col("n") - F.col(c) + 0.5) / (sizes["n"] - sizes[c] + 1))
        good = usable.withColumn("lift", lift).where((F.col("lift") >= LIFT) & (F.col(c) >= max(LEAST, SHARE * sizes[c])))
        best = good.orderBy((F.col(c) * F.log("lift")).desc(), "fragment").limit(LISTED).collect()
        out.append(np.array([r["fragment"] for r in best], np.int64).astype(np.uint64))
    remove(sample.sparkSession, path)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on ``sample`` labelled documents, or on all where there are fewer.

    Of an id with several labels the worse counts; labels with nulls and labels of
    unknown documents count for nothing, nor for the sample's size. Of an id with
    several documents the least text is taken. What reaches the driver is ``sample`` rows of
    features and two lists of ``LISTED`` fragments, whatever the corpus.
    """
    spark = docs.sparkSession
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and quality is not null and toxic is not null")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample``: the labels' side is broadcast, of the texts only those of the sample move.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    taken, path = stored(found.select("text", "quality", "toxic"), "quality-sample")
    bad, toxic_list = map(Listed, listed_fragments(taken))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(text_bytes(batch.column(0)), bad, toxic_list)
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "toxic", "x"])

    rows = arrow_map(taken, "quality int, toxic int, x array<double>", lambda: step, column=0, most=SLICE).collect()
    remove(spark, path)
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    good, toxic = np.array([r["quality"] > 0 for r in rows], bool), np.array([r["toxic"] > 0 for r in rows], bool)
    of = lambda y: fit_logistic(x, y.astype(float)) if 0 < y.sum() < len(y) else None
    return Model(bad, toxic_list, of(good), of(toxic), float(good.mean()) if len(rows) else 1.0, float(toxic.mean()) if len(rows) else 0.0)


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a source; empty host: no site."""
    clean = F.regexp_replace(F.lower(F.coalesce(source.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    path = F.regexp_extract(clean, r"^[^/]*/([^/?#]+)", 1)
    return F.regexp_extract(clean, r"^([^/?#]*)", 1), F.when(path != "", path).otherwise(F.coalesce(lang.cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``_granary_quality`` and ``_granary_toxic``, the document's own evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_granary_quality", T.DoubleType()), T.StructField("_granary_toxic", T.DoubleType())])

    # A text that is kept is sent once.
    own = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    taken = docs.select(*keep) if own else docs.select(*keep, F.col(text_col).cast("string").alias("_granary_text"))
    at = keep.index(text_col) if own else len(keep)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, t = sent.value.scores(text_bytes(batch.column(at)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(q), pa.array(t)], names=schema.fieldNames())

    return arrow_map(taken, schema, lambda: step, column=at, most=SLICE)


def strength(groups: DataFrame, value: str, above: Column | float) -> float:
    """Pseudo-observations of a group's prior: the moment estimator of a beta-binomial model.

    ``groups``: ``n`` and the sum ``value``; ``above`` is the mean of the level above. One row reaches the driver.
    """
    above = above if isinstance(above, Column) else F.lit(above)
    mean = F.col(value) / F.col("n")
    row = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (mean - above) ** 2).alias("between"), F.sum(F.col("n") * above * (1 - above)).alias("within")).first()
    if not row["k"] or not row["within"]:
        return 1.0
    # E[between] = within / n * (k + (n - k) / (1 + strength))
    extra = (row["between"] * row["n"] / row["within"] - row["k"]) / max(row["n"] - row["k"], 1)
    return float(min(max(1 / extra - 1, 1.0), 1000.0)) if extra > 0 else 1000.0


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (with ``_granary_host, _granary_path``) with ``_granary_posterior_quality`` and ``..._toxic``.

    Only sums by path are shuffled. The sites' table is written, so its size is
    known: Spark broadcasts it where it is small and else joins by host and path,
    splitting large hosts.
    """
    by_path = scored.groupBy("_granary_host", "_granary_path").agg(F.count("*").alias("n"), F.sum("_granary_quality").alias("q"), F.sum("_granary_toxic").alias("t"))
    paths, paths_path = stored(by_path, "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")).first()
    known = max(total["n"] or 0, 1)
    rates = {c: min(max((total[c] or 0.0) / known, _EDGE), 1 - _EDGE) for c in "qt"}
    paths = paths.where("_granary_host <> ''")
    hosts, hosts_path = stored(paths.groupBy("_granary_host").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")), "quality-hosts")
    host_strength = {c: strength(hosts, c, rates[c]) for c in "qt"}
    shrunk = lambda total, n, k, above: (total + k * above) / (n + k)
    both = paths.join(hosts.select("_granary_host", *(F.col(c).alias(f"host_{c}") for c in "nqt")), "_granary_host")
    sites, _ = stored(both, "quality-sites")
    remove(scored.sparkSession, paths_path, hosts_path)
    path_strength = {c: strength(sites, c, shrunk(F.col(f"host_{c}"), F.col("host_n"), host_strength[c], F.lit(rates[c]))) for c in "qt"}
    # Under names that no column of the documents has.
    site = {c: f"_granary_site_{c}" for c in ("n", "q", "t", "host_n", "host_q", "host_t")}
    out = scored.join(sites.withColumnsRenamed(site), ["_granary_host", "_granary_path"], "left")
    logit = lambda p: F.log(p) - F.log(1 - p)
    for c, name in (("q", "quality"), ("t", "toxic")):
        own = F.col(f"_granary_{name}")
        # Host and path without this document, so that its evidence counts once.
        host = shrunk(F.col(site[f"host_{c}"]) - own, F.col(site["host_n"]) - 1, host_strength[c], F.lit(rates[c]))
        path = shrunk(F.col(site[c]) - own, F.col(site["n"]) - 1, path_strength[c], host)
        prior = F.least(F.greatest(F.coalesce(path, F.lit(rates[c])), F.lit(_EDGE)), F.lit(1 - _EDGE))
        odds = logit(prior) + logit(own) - F.lit(float(np.log(rates[c]) - np.log(1 - rates[c])))
        out = out.withColumn(f"_granary_posterior_{name}", 1 / (1 + F.exp(-odds))).withColumn(f"_granary_prior_{name}", prior)
    return out


def _judged(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int, id_col: str, text_col: str, source_col: str, lang_col: str, model: Model | None) -> DataFrame:
    model = model or fit(docs, labels, sample, id_col, text_col)
    host, path = site(F.col(source_col), F.col(lang_col))
    named = docs.withColumn("_granary_host", host).withColumn("_granary_path", path)
    scored, _ = stored(score(named, model, [*keep, "_granary_host", "_granary_path"], text_col), "quality-scored")
    return posteriors(scored)


def kept() -> Column:
    return (F.col("_granary_posterior_quality") >= KEPT_QUALITY) & (F.col("_granary_posterior_toxic") < KEPT_TOXICITY)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``doc_id, host, path, evidence, site_prior, quality, toxicity, kept`` for each row of ``docs``.

    ``evidence`` is the document's own score, ``site_prior`` the shrunk mean of its path
    without it, ``quality`` and ``toxicity`` are posteriors; a document is kept if its
    quality is 0.5 or more and its toxicity below. Null and empty texts are judged by
    their features (no words), a null source has the global prior, null ids stay
    null, repeated rows are judged alike. Without labels of both classes nothing is
    rejected for that reason alone. An empty table gives no rows.
    """
    out = _judged(docs, labels, [id_col], sample, id_col, text_col, source_col, lang_col, model)
    return out.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("_granary_host").alias("host"), F.col("_granary_path").alias("path"), F.col("_granary_quality").alias("evidence"), F.col("_granary_prior_quality").alias("site_prior"),
        F.col("_granary_posterior_quality").alias("quality"), F.col("_granary_posterior_toxic").alias("toxicity"), kept().alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all of their columns.

    Null, empty and very long texts, null sources and ids, repeated rows and tables
    without labels or rows are judged as by :func:`judge`. Extra columns may have any name
    (but for those that start with ``_granary_``). The scored rows stay in the shared
    folder, since the result reads them.
    """
    return _judged(docs, labels, docs.columns, sample, id_col, text_col, source_col, lang_col, None).where(kept()).select(*docs.columns)
