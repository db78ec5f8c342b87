"""Building a corpus of files: candidates by turns, screening, content de-duplication, caps and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.repeats import by_turns, first_by, numbered, unseen

PER_DIMENSION, MAX_CANDIDATES = 100, 1000
SCREEN_VERSION = 1


def interleaved(candidates: DataFrame, seen: DataFrame | None = None, dimension: str = "dimension") -> DataFrame:
    """``candidates`` (``dimension, source_no, position, url``) in the order in which sources take turns, each new URL once.

    ``order`` counts from 1 in a dimension. URLs of ``seen`` are left out.
    """
    turned = by_turns(candidates.withColumn("_source", F.concat_ws("#", dimension, "source_no")), "_source", ["position"]).drop("_source")
    once = first_by(turned, [dimension, "url"], [F.col("turn"), F.col("source_no")])
    fresh = unseen(once, seen, [dimension, "url"]) if seen is not None else once
    return numbered(fresh, [dimension], ["turn", "source_no"], "order")


def accept(fetched: DataFrame, known: DataFrame | None = None, most: int = PER_DIMENSION, tries: int = MAX_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """``accepted`` and ``rejected`` of ``fetched``: ``dimension, order, url, sha256, reason``.

    A reason rejects; of equal contents the first in order is accepted, the later are
    ``duplicate PDF``, as are contents in ``known`` (``dimension, sha256``). Only the first
    ``tries`` candidates count and the first ``most`` are accepted, numbered from 1 after
    the known ones; what comes after the cap is in neither.
    """
    tried = fetched.where(F.col("order") <= tries)
    good = tried.where("reason is null")
    firsts = good.groupBy("dimension", "sha256").agg(F.min("order").alias("first"))
    if known is not None:
        firsts = firsts.join(known.select("dimension", "sha256", F.lit(True).alias("known")).distinct(), ["dimension", "sha256"], "left")
        have = known.groupBy("dimension").agg(F.count("*").alias("have"))
    else:
        firsts = firsts.withColumn("known", F.lit(None).cast("boolean"))
        have = None
    marked = good.join(firsts, ["dimension", "sha256"])
    fresh = numbered(marked.where("order = first and known is null").select("dimension", "order", "url", "sha256"), ["dimension"], ["order"])
    fresh = fresh.join(have, "dimension", "left").withColumn("number", F.col("number") + F.coalesce("have", F.lit(0))).drop("have") if have is not None else fresh
    accepted = fresh.where(F.col("number") <= most)
    full = accepted.groupBy("dimension").agg(F.count("*").alias("n"), F.max("number").alias("last"), F.max("order").alias("end")).where(F.col("last") >= most).select("dimension", "end")
    reasons = tried.where("reason is not null").select("dimension", "order", "url", "reason").unionByName(marked.where("order > first or known").select("dimension", "order", "url", F.lit("duplicate PDF").alias("reason")))
    rejected = reasons.join(full, "dimension", "left").where("end is null or order < end").drop("end")
    return accepted, rejected


def shortfalls(fetched: DataFrame, accepted: DataFrame, most: int = PER_DIMENSION, tries: int = MAX_CANDIDATES) -> DataFrame:
    """``dimension, message`` of the dimensions that stayed short."""
    tried = fetched.groupBy("dimension").agg(F.count("*").alias("tried"))
    saved = accepted.groupBy("dimension").agg(F.max("number").alias("saved"))
    out = tried.join(saved, "dimension", "left").withColumn("saved", F.coalesce("saved", F.lit(0))).where(F.col("saved") < most)
    tail = F.concat(F.lit(" ("), F.col("saved").cast("string"), F.lit(f"/{most} saved)"))
    return out.select("dimension", F.when(F.col("tried") >= tries, F.concat(F.lit(f"gave up after trying {tries} links"), tail)).otherwise(F.concat(F.lit("sources ran out"), tail)).alias("message"))


def audit(links: DataFrame, files: DataFrame, failures: DataFrame, screened: DataFrame, version: int = SCREEN_VERSION) -> tuple[DataFrame, DataFrame]:
    """``kept`` (renumbered) and ``quarantined`` of accepted ``links`` (``dimension, number, url, sha256, version``).

    ``files``: ``dimension, number, sha256`` as on disk; links without a file go. A failure
    recorded for the same content quarantines; content already screened by this version
    stays; all else follows ``screened`` (``sha256, reason``).
    """
    there = links.withColumnRenamed("sha256", "link_sha256").join(files, ["dimension", "number"])
    judged = there.join(failures.select("sha256", F.col("reason").alias("failure")), "sha256", "left").join(screened.select("sha256", F.col("reason").alias("screen")), "sha256", "left")
    current = (F.col("link_sha256") == F.col("sha256")) & (F.col("version") == version)
    reason = F.when(F.col("failure").isNotNull(), F.concat(F.lit("application extractor: "), "failure")).when(~F.coalesce(current, F.lit(False)), F.col("screen"))
    marked = judged.withColumn("reason", reason)
    kept = numbered(marked.where("reason is null").select("dimension", F.col("number").alias("old"), "url", "sha256", F.lit(version).alias("version")), ["dimension"], ["old"])
    return kept, marked.where("reason is not null").select("dimension", F.col("number").alias("old"), "url", "reason")


def recovered(rejected: DataFrame, screened: DataFrame, accepted: DataFrame, most: int = PER_DIMENSION) -> DataFrame:
    """Files rejected for joined words that the present screening passes, numbered after the accepted ones up to ``most``."""
    again = rejected.where(F.contains("reason", F.lit("probable joined words"))).join(screened.where("reason is null").select("sha256"), "sha256", "left_semi")
    have = accepted.groupBy("dimension").agg(F.max("number").alias("have"))
    placed = numbered(again.select("dimension", "order", "url", "sha256"), ["dimension"], ["order"]).join(have, "dimension", "left")
    return placed.withColumn("number", F.col("number") + F.coalesce("have", F.lit(0))).where(F.col("number") <= most).drop("have")
