"""Question hierarchies: reading an ontology, grounding proposed quotes, de-duplicating and counting them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import category_query, evidence_form, squeeze, trim

MAX_DIMENSIONS, MAX_CATEGORIES = 20, 100
UNGROUNDED = "A cited chunk or verbatim evidence quote was not present in retrieval."
REPEATED = "Duplicate quoted passage for this question."
RESPONSE = "struct<matches:array<struct<explicitness:string,reason:string,evidence:array<struct<chunkId:string,quote:string>>>>>"
ONTOLOGY = "dimension_no int, dimension_id string, dimension string, dimension_definition string, category_no int, category_id string, category string, definition string, include array<string>, exclude array<string>, questions array<string>"


def _text(value: Any, where: str, most: int = 2000) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{where} must be a non-empty string.")
    if len(value.strip()) > most:
        raise ValueError(f"{where} must be {most} characters or fewer.")
    return value.strip()


def _list(value: Any, where: str) -> list[str] | None:
    if value is None:
        return None
    if not isinstance(value, list):
        raise ValueError(f"{where} must be an array of strings.")
    return [_text(x, f"{where}[{i}]", 500) for i, x in enumerate(value)]


def _unique(kind: str, ids: list[str]) -> None:
    for i, x in enumerate(ids):
        if x in ids[:i]:
            raise ValueError(f'{kind} id "{x}" is duplicated.')


def read_ontology(value: Any) -> list[tuple]:
    """Checked rows of ``ONTOLOGY`` from a parsed JSON value; the first broken rule is told. At most 100 categories, so the driver holds them."""
    if not isinstance(value, dict) or not isinstance(value.get("dimensions"), list):
        raise ValueError("Ontology must contain a dimensions array.")
    if not value["dimensions"]:
        raise ValueError("Ontology must contain at least one dimension.")
    if len(value["dimensions"]) > MAX_DIMENSIONS:
        raise ValueError(f"Ontology must contain no more than {MAX_DIMENSIONS} dimensions.")
    rows: list[tuple] = []
    for d, dimension in enumerate(value["dimensions"]):
        at = f"dimensions[{d}]"
        if not isinstance(dimension, dict) or not isinstance(dimension.get("categories"), list) or not dimension["categories"]:
            raise ValueError(f"{at}.categories must contain at least one category.")
        head = tuple(_text(dimension.get(k), f"{at}.{k}", most) for k, most in (("id", 100), ("name", 200), ("definition", 2000)))
        for c, category in enumerate(dimension["categories"]):
            here = f"{at}.categories[{c}]"
            if not isinstance(category, dict):
                raise ValueError(f"{here} must be an object.")
            if not isinstance(category.get("questions"), list) or not category["questions"]:
                raise ValueError(f"{here}.questions must contain at least one question.")
            own = tuple(_text(category.get(k), f"{here}.{k}", most) for k, most in (("id", 100), ("name", 200), ("definition", 2000)))
            questions = [_text(q, f"{here}.questions[{i}]") for i, q in enumerate(category["questions"])]
            rows.append((d, *head, c, *own, _list(category.get("include"), f"{here}.include"), _list(category.get("exclude"), f"{here}.exclude"), questions))
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"Ontology must contain no more than {MAX_CATEGORIES} categories.")
    _unique("Dimension", [i for _, i in dict.fromkeys((r[0], r[1]) for r in rows)])
    _unique("Category", [r[5] for r in rows])
    return rows


def ontology_table(spark: SparkSession, value: Any) -> DataFrame:
    return spark.createDataFrame(read_ontology(value), ONTOLOGY)


def questions_of(ontology: DataFrame) -> DataFrame:
    """``question_id, dimension_no, category_no, question_no`` (from 1), ids, ``question`` and the category's full ``query``."""
    out = ontology.select("*", F.posexplode("questions").alias("at", "question"))
    query = category_query(F.col("dimension"), F.col("dimension_definition"), F.col("category"), F.col("definition"), F.col("include"), F.col("exclude"), F.col("question"))
    number = F.col("at") + 1
    return out.select(F.concat_ws("/", "dimension_id", "category_id", number.cast("string")).alias("question_id"), "dimension_no", "dimension_id", "category_no", "category_id", number.alias("question_no"), "question", query.alias("query"))


def parsed_responses(responses: DataFrame) -> DataFrame:
    """``responses`` (``question_id, content``) with ``matches`` and ``error``: one bad match fails the whole response."""
    value = F.from_json("content", RESPONSE)
    empty = lambda c: trim(F.coalesce(c, F.lit(""))) == ""
    known = responses.withColumn("value", value).withColumn("matches", F.col("value.matches"))
    valid_json = F.try_parse_json("content").isNotNull()
    first_error = F.get(
        F.filter(
            F.transform(
                "matches",
                lambda m: F.when(m.isNull() | (F.size(F.coalesce(m["evidence"], F.array())) == 0), "The hierarchy model returned a match without evidence.")
                .when(~F.coalesce(m["explicitness"].isin("explicit", "implicit"), F.lit(False)), "The hierarchy model returned an invalid match explicitness.")
                .when(empty(m["reason"]), "The hierarchy model returned an invalid match reason.")
                .when(F.exists(m["evidence"], lambda e: e.isNull()), "The hierarchy model returned invalid match evidence.")
                .when(F.exists(m["evidence"], lambda e: empty(e["chunkId"])), "The hierarchy model returned an invalid evidence chunkId.")
                .when(F.exists(m["evidence"], lambda e: empty(e["quote"])), "The hierarchy model returned an invalid evidence quote."),
            ),
            lambda e: e.isNotNull(),
        ),
        F.lit(0),
    )
    error = F.when(~valid_json, "The hierarchy model returned invalid JSON.").when(F.col("matches").isNull(), "The hierarchy model omitted matches.").otherwise(first_error)
    return known.withColumn("error", error).drop("value")


def match_rows(parsed: DataFrame) -> DataFrame:
    """``question_id, position, explicitness, reason, evidence`` of the responses without an error, texts trimmed."""
    out = parsed.where("error is null").select("question_id", F.posexplode("matches").alias("position", "m"))
    clean = F.transform("m.evidence", lambda e: F.struct(trim(e["chunkId"]).alias("chunk_id"), trim(e["quote"]).alias("quote")))
    return out.select("question_id", "position", "m.explicitness", trim(F.col("m.reason")).alias("reason"), clean.alias("evidence"))


def judged_matches(matches: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``matches`` with ``evidence`` enriched and ``rejected``: null, or why.

    A match is grounded if each quote, white space and case apart, is part of the
    cited passage among the question's ``retrieved`` (``question_id, chunk_id, text,
    source, page, number, score``). Of grounded matches with the same quoted passages the
    first is accepted. Joins are by question and chunk, grouped by match.
    """
    each = matches.select("question_id", "position", F.posexplode("evidence").alias("at", "e")).select("question_id", "position", "at", "e.chunk_id", "e.quote")
    found = each.join(retrieved.select("question_id", "chunk_id", "text", "source", "page", "number", "score"), ["question_id", "chunk_id"], "left")
    quote = evidence_form(F.col("quote"))
    grounded = F.col("text").isNotNull() & (quote != "") & F.contains(evidence_form(F.col("text")), quote)
    enriched = F.struct("at", "chunk_id", "source", "page", "number", F.col("score").alias("retrieval_score"), "quote")
    key = F.concat_ws(":", "chunk_id", F.lower(squeeze(F.col("quote"))))
    by_match = found.groupBy("question_id", "position").agg(
        F.bool_and(F.coalesce(grounded, F.lit(False))).alias("grounded"), F.array_sort(F.collect_list(enriched)).alias("cited"), F.array_join(F.array_sort(F.collect_list(key)), "|").alias("key")
    )
    firsts = by_match.where("grounded").groupBy("question_id", "key").agg(F.min("position").alias("first"))
    judged = matches.drop("evidence").join(by_match, ["question_id", "position"], "left").join(firsts, ["question_id", "key"], "left")
    reason = F.when(~F.coalesce("grounded", F.lit(False)), UNGROUNDED).when(F.col("position") != F.col("first"), REPEATED)
    cited = F.transform("cited", lambda c: c.dropFields("at"))
    return judged.select("question_id", "position", "explicitness", "reason", cited.alias("evidence"), reason.alias("rejected"))


def question_counts(questions: DataFrame, retrieved: DataFrame, judged: DataFrame) -> DataFrame:
    """Of every question, those without results too: chunks retrieved, candidates generated and accepted."""
    chunks = retrieved.groupBy("question_id").agg(F.count("*").alias("retrieved"))
    matched = judged.groupBy("question_id").agg(F.count("*").alias("generated"), F.count_if(F.col("rejected").isNull()).alias("accepted"))
    out = questions.join(chunks, "question_id", "left").join(matched, "question_id", "left")
    return out.select("question_id", "category_id", "question", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("retrieved", "generated", "accepted")))


def category_diagnostics(questions: DataFrame, retrieved: DataFrame, judged: DataFrame) -> DataFrame:
    """Of every category: different chunks retrieved, different question texts matched, candidates accepted, and the rejected ones in order."""
    chunks = retrieved.join(questions.select("question_id", "category_id"), "question_id").groupBy("category_id").agg(F.countDistinct("chunk_id").alias("retrieved_chunks"))
    named = judged.join(questions.select("question_id", "category_id", "question_no", "question"), "question_id")
    rejected = F.transform(F.array_sort(F.collect_list(F.when(F.col("rejected").isNotNull(), F.struct("question_no", "position", "question", F.col("rejected").alias("reason"))))), lambda r: F.struct(r["question"].alias("question"), r["reason"].alias("reason")))
    good = F.col("rejected").isNull()
    counts = named.groupBy("category_id").agg(F.countDistinct(F.when(good, F.col("question"))).alias("matched_questions"), F.count_if(good).alias("matched_candidates"), rejected.alias("rejected"))
    base = questions.select("dimension_no", "category_no", "category_id").distinct()
    out = base.join(chunks, "category_id", "left").join(counts, "category_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("dimension_no", "category_no", "category_id", zero("retrieved_chunks"), zero("matched_questions"), zero("matched_candidates"), F.coalesce("rejected", F.array().cast("array<struct<question:string,reason:string>>")).alias("rejected"))


def framework_tree(ontology: DataFrame, questions: DataFrame, judged: DataFrame) -> DataFrame:
    """One row a dimension, in order, with its categories and their accepted matches; empty ones stay."""
    accepted = judged.where("rejected is null").join(questions.select("question_id", "category_id", "question_no", "question"), "question_id")
    match = F.struct("question_no", "position", "question", "explicitness", "reason", "evidence")
    by_category = accepted.groupBy("category_id").agg(F.transform(F.array_sort(F.collect_list(match)), lambda m: m.dropFields("question_no", "position")).alias("matches"))
    nested = ontology.join(by_category, "category_id", "left")
    empty = F.array().cast(dict(by_category.dtypes)["matches"])
    category = F.struct("category_no", "category_id", "category", "definition", "include", "exclude", "questions", F.coalesce("matches", empty).alias("matches"))
    out = nested.groupBy("dimension_no", "dimension_id", "dimension", "dimension_definition").agg(F.transform(F.array_sort(F.collect_list(category)), lambda c: c.dropFields("category_no")).alias("categories"))
    return out


def totals(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.sum("matched_questions").alias("matched_questions"), F.sum("matched_candidates").alias("matched_candidates"))
