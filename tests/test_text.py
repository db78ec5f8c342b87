"""Scalar text functions, keys, quality and settings on hand-written cases."""

import hashlib
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from granary import oracles, queries
from granary.config import CalibrationConfiguration, ChunkConfiguration, HierarchyConfiguration, ServiceConfiguration
from granary.functions import identity, text
from granary.operators import hierarchy, pages
from granary.sources import candidates, files, store
from granary.workspace import shared_dir


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_cleaning(spark):
    given = ["a\0b", "x <latexit id=1>\nfoo</latexit> y", "popu-\nlation and well-known", "  a  b﻿ ", "", "é-\r\na"]
    assert one(spark, text.clean_text, *given) == ["a b", "x y", "population and well-known", "a b", "", "é- a"]


def test_sentences_and_labels(spark):
    assert one(spark, text.sentences, 'One. Two! "Three" he said? (Four) five. six 7. 8') == [["One.", "Two!", '"Three" he said?', "(Four) five. six 7.", "8"]]
    assert one(spark, text.section_label, "Results of 2020", "a_b c", "", "12 34 ab", None) == ["Results of 2020", None, None, None, None]
    assert one(spark, text.dedup_form, "A-B  c’D 9!") == ["a b c d 9"]


def test_headings(spark):
    yes = ["1.2 Methods and data", "INTRODUCTION TO WATER", "Results", "References", "3. Bibliografía", "СПИСОК ЛІТЕРАТУРИ", "Références bibliographiques"]
    no = ["1. This is a sentence that ends.", "A B C D E F", "SHOUTING.", "plain words here", "12", "AB_CD EF", "2 lower case start", "1 One two three four five six seven eight nine ten eleven"]
    assert one(spark, text.is_heading, *yes, *no) == [True] * len(yes) + [False] * len(no)
    assert one(spark, text.is_caption, "Figure 3. X", "Table 2", "fig 1:", "Tables 2", "Figure X") == [True, True, True, False, False]


def test_tables_of_prose(spark):
    assert one(spark, text.prose_of_table, "1. | The budget grows\n2. | It falls", "a | b | c\nd | e | f", "one two three four five | six seven eight nine ten") == ["1. The budget grows 2. It falls", None, "one two three four five six seven eight nine ten"]
    assert one(spark, lambda c: text.joined_lines(F.split(c, "\n")), "popu-\nlation grows\nA-\nB") == ["population grows A- B"]
    assert one(spark, text.edge_key, "Page 12 of  30", "page 3 of 4") == ["page#of#", "page#of#"]


def test_keys(spark):
    assert one(spark, identity.point_id, "abc", "x" * 40) == [str(uuid.uuid5(uuid.UUID(identity.POINT_NAMESPACE), s)) for s in ("abc", "x" * 40)]
    assert one(spark, identity.extension_of, "A.B.PDF", "README") == ["pdf", "readme"]
    digest = hashlib.sha1(b"name.txt:h").hexdigest()
    assert one(spark, lambda c: identity.document_id(c, F.lit("h")), "NAME.txt") == [digest]


def test_page_quality(spark):
    given = [None, " \n", "#REF! #N/A", "ok ��� text", "a" * 40, "x" * 150, "fine words on a page"]
    assert one(spark, pages.quality_reason, *given) == ["no extractable text"] * 2 + ["spreadsheet error in place of page text", "too many replacement characters", "probable joined words", "probable joined words", None]
    assert one(spark, pages.quality_reason, "abcdefghi1" * 11) == ["too few word boundaries"]


def test_settings():
    for bad, told in (((0, 0), "wordSize"), ((5, -1), "overlapWords"), ((5, 5), "strictly smaller"), ((5, 1, "x"), "assembly")):
        with pytest.raises(ValueError, match=told):
            ChunkConfiguration(*bad)
    with pytest.raises(ValueError, match="minimumRetrievalScore"):
        HierarchyConfiguration(minimum_score=2)
    assert CalibrationConfiguration.parse({"retrieval": {"topK": 30}}).reranking.candidates == 30
    for bad in ([], {"retrieval": {"topK": 0}}, {"reranking": {"candidates": 5}}, {"reranking": {"strategy": "lexical"}}, {"chunk": 3}):
        with pytest.raises(ValueError):
            CalibrationConfiguration.parse(bad)
    assert ServiceConfiguration.from_mapping({"COLLECTION": " x "}).collection == "x"
    with pytest.raises(ValueError, match="API_KEY"):
        ServiceConfiguration.from_mapping({"STORE_URL": "https://h"})


def test_ontology_rules():
    category = {"id": "c", "name": "C", "definition": "d", "questions": [" q "]}
    good = {"dimensions": [{"id": "d", "name": "D", "definition": "x", "categories": [category]}]}
    assert hierarchy.read_ontology(good)[0][-1] == ["q"]
    for bad, told in (({}, "dimensions array"), ({"dimensions": []}, "at least one dimension"), ({"dimensions": good["dimensions"] * 2}, "Dimension id"), ({"dimensions": [{"id": "d", "name": "D", "definition": "x", "categories": [category, category]}]}, "Category id"), ({"dimensions": [{"categories": [{"questions": []}]}]}, "non-empty string")):
        with pytest.raises(ValueError, match=told):
            hierarchy.read_ontology(bad)


def test_selection(spark):
    def told(rows):
        return files.selection_errors(spark.createDataFrame(rows, "ordinal int, name string, size long")).first()[0]

    assert told([(1, "a.pdf", 5)]) is None
    assert told([(i, "a.pdf", 5) for i in range(11)]) == "Select no more than 10 documents at once."
    assert told([(1, "a.csv", 5), (2, "b.exe", 0)]) == "b.exe is not a supported document type."
    assert told([(1, "a.csv", 5), (2, "b.pdf", 0)]) == "b.pdf is empty."
    assert told([(1, "a.csv", 5)]).startswith("a.csv is accepted for upload")
    assert files.selection_errors(spark.createDataFrame([], "ordinal int, name string, size long")).first()[0] == "Select at least one document."


def test_text_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfone  two")
    (tmp_path / "b.md").write_bytes(b"\xc3\x28")
    found = {r["error"]: r["text"] for r in files.text_pages(files.identified(files.read_files(spark, str(tmp_path)))).collect()}
    assert found == {None: "one two", "b.md is not valid UTF-8 text.": None}


def test_candidate_links(spark):
    def fetch(service, query, cursor):
        if query == "bad":
            raise candidates.Refused
        at = int(cursor or 0)
        return [f"{query}-{at}", None, ""], str(at + 1) if at < 2 else None

    queries = spark.createDataFrame([(0, "x", "a"), (1, "x", "bad")], "source_no int, service string, query string")
    assert [tuple(r) for r in candidates.candidate_links(queries, fetch).orderBy("position").collect()] == [(0, i, f"a-{i}") for i in range(3)]
    tried = []
    with pytest.raises(OSError):
        candidates.with_retries(lambda: tried.append(1) or (_ for _ in ()).throw(OSError()), sleep=lambda s: None)
    assert len(tried) == 3


def test_collection(spark):
    c = store.Collection(spark, shared_dir(spark, "test-collection"))
    assert not c.exists()
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, dense array<double>")
    c.upsert(rows)
    c.upsert(spark.createDataFrame([("a", [9.0, 9.0], 1), ("a", [7.0, 7.0], 2)], "chunk_id string, dense array<double>, _order int"))
    assert {r["chunk_id"]: r["dense"] for r in c.points().collect()} == {"a": [7.0, 7.0], "b": [3.0, 4.0]}
    for bad in (rows.limit(0), rows.select("chunk_id", F.array().cast("array<double>").alias("dense")), rows.select("chunk_id", F.lit(None).cast("array<double>").alias("dense")), spark.createDataFrame([("c", [1.0])], "chunk_id string, dense array<double>")):
        with pytest.raises(ValueError):
            c.upsert(bad)
    c.ensure(5, recreate=True)
    with pytest.raises(ValueError):
        c.check_size(2)


@pytest.mark.parametrize("name", ["t04_line_labels", "t10_line_keys"])
def test_queries_of_every_line(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(oracles.ORACLES[name]).fetchall()
    found = [tuple(r) for r in queries.queries()[name](spark, folder).collect()]
    assert sorted(found, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert all(r[1] == texts[r[0]].count("\n") + 1 for r in found) and any(r[1] > 2 for r in found)
