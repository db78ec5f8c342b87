"""Blocks, layout, passages and plans on small fixtures."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from granary import queries
from granary.config import ChunkConfiguration
from granary.operators import blocks, layout, models, passages, retrieval
from granary.operators import pages as quality
from granary.operators.passages import Piece, Run, first_of_each, packed, pieces_of, runs_of, table_groups
from granary.plans import calibration
from granary.sources import files, store
from granary.operators.repeats import numbered


def structured(spark, *texts):
    df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "document_id string, page int, text string")
    return [(r["page"], r["type"], r["text"], r["section"]) for r in blocks.structure_blocks(df).orderBy("page", "block_no").collect()]


def test_blocks(spark):
    got = structured(
        spark,
        "Annual report 1\n1 Scope and aims\nFirst line popu-\nlation goes on.\nNext starts here\n\na\tb\tc\nd\te\tf\nTable 1. The numbers\n17",
        "Annual report 2\nGoes on under the section\nREFERENCES\nSmith, J. A book\n3\n4",
    )
    assert got == [
        (1, "header", "Annual report 1", None), (1, "heading", "1 Scope and aims", "1 Scope and aims"), (1, "paragraph", "First line population goes on.", "1 Scope and aims"), (1, "paragraph", "Next starts here", "1 Scope and aims"),
        (1, "table", "a | b | c\nd | e | f", "1 Scope and aims"), (1, "caption", "Table 1. The numbers", "1 Scope and aims"), (1, "footer", "17", "1 Scope and aims"),
        (2, "header", "Annual report 2", "1 Scope and aims"), (2, "paragraph", "Goes on under the section", "1 Scope and aims"), (2, "heading", "REFERENCES", "REFERENCES"), (2, "reference", "Smith, J. A book 3", "REFERENCES"), (2, "footer", "4", "REFERENCES"),
    ]


def test_a_caption_that_is_a_row_stands_before_the_pending_table(spark):
    assert [x[:3] for x in structured(spark, "a\tb\nTable 1\tThe rows\nc\td\ntext")] == [(1, "caption", "Table 1 The rows", ), (1, "table", "a | b\nc | d"), (1, "paragraph", "text")]


def item(x, y, raw, width=None, height=10.0):
    return layout.Item(x, y, width if width is not None else 5.0 * len(raw.strip()), height, raw.strip(), raw)


def test_layout():
    assert layout.line_text([item(0, 0, "pop"), item(15, 0, "ulation"), item(54, 0, "grew"), item(54.5, 0, "grew"), item(120, 0, "far")]) == "population grew\tfar"
    assert layout.page_text([item(0, 0, "one"), item(0, 40, "two"), item(40, 41, "side")], 600) == "one\n\ntwo\tside"
    rows = [item(x, 14.0 * i, f"{side} line number {i} here", 180.0) for i in range(9) for x, side in ((20.0, "left"), (340.0, "right"))]
    text = layout.page_text(rows, 600.0).split("\n")
    assert [t.split()[0] for t in text if t] == ["left"] * 9 + ["right"] * 9
    assert layout.simple_line_text([item(0, 0, "a"), item(8, 0, "b"), item(60, 0, "c")]) == "a b\tc"


def test_word_windows(spark):
    def starts(n, size, overlap):
        df = spark.createDataFrame([("d", 1, " ".join(f"word{i}" for i in range(n)))], "document_id string, page int, text string")
        return [(r["word_start"], r["word_count"]) for r in passages.word_windows(df, ChunkConfiguration(size, overlap)).orderBy("word_start").collect()]

    assert len(starts(1000, 100, 20)) == 13 and starts(1000, 100, 20)[-1] == (960, 40)
    assert starts(201, 200, 50) == [(0, 200), (150, 51)] and len(starts(7, 4, 2)) == 3 and starts(0, 4, 2) == [] and starts(4, 4, 3) == [(0, 4)]


def block(kind, text, page=1, section=None, following=None, start=0):
    return {"type": kind, "text": text, "page": page, "section": section, "start": start, "next_type": following}


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


def test_runs():
    config = ChunkConfiguration(50, 10)
    long, short = words(20), words(3)
    families = lambda *b: [(r.family, r.section, len(r.pieces)) for r in runs_of(list(b), config)]
    assert families(block("paragraph", long, section="A"), block("paragraph", long, section="A")) == [("prose", "A", 2)]
    assert families(block("paragraph", long, section="A"), block("heading", "B"), block("paragraph", long, section="A")) == [("prose", "A", 1), ("prose", "A", 1)]
    assert families(block("paragraph", short, section="A"), block("heading", "B"), block("table", "h\n" + long, section="B")) == [("prose", "A", 3)]
    assert families(block("caption", long, following="table"), block("table", "h\n" + long)) == [("table", None, 2)]
    page = ChunkConfiguration(50, 10, "page")
    assert len(runs_of([block("paragraph", long), block("paragraph", long, page=2)], page)) == 2
    assert runs_of([block("header", "x"), block("paragraph", "123")], config) == []


def test_pieces_and_packing():
    config = ChunkConfiguration(10, 4)
    assert table_groups("h\na b c\nd e f\ng", 7) == ["h\na b c\nd e f", "h\ng"]
    cut = pieces_of("paragraph", words(23), 1, "prose", 5, config)
    assert [(p.start, p.words) for p in cut] == [(5, 10), (13, 10), (21, 7)]
    assert [p.text for p in pieces_of("paragraph", "One two. Three.", 1, "prose", 0, config)] == ["One two.", "Three."]
    sizes = lambda run, c=config: [[p.words for p in g] for g in packed(run, c)]
    run = lambda family, *n: Run(family, None, [Piece(words(k), 1, 0, k, family) for k in n])
    assert sizes(run("prose", 4, 4, 3, 5)) == [[4, 4], [4, 3], [3, 5]]
    assert sizes(run("table", 4, 4, 3, 5)) == [[4, 4], [3, 5]]
    assert sizes(run("prose", 9, 3, 8)) == [[9], [3], [8]]
    assert sizes(run("prose", 6, 4, 1)) == [[6, 4, 1]]  # a short tail joins the group before


def test_near_duplicates_are_greedy():
    base = [f"t{i}" for i in range(100)]
    a, b, c = " ".join(base), " ".join(base[3:] + ["x1", "x2", "x3"]), " ".join(base[6:] + [f"y{i}" for i in range(6)])
    assert first_of_each([a, b, c, a, "", "short text", "short text", "short text too"]) == [0, 2, 5, 7]


def test_packed_words_stay_within_bounds(spark, sf_dir):
    rows = passages.packed_groups(queries._blocks(spark, sf_dir)).collect()
    assert rows and all(len(r["body"].split()) <= 240 for r in rows if r["family"] == "prose")


def test_dense_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, "chunk_id long, dense array<double>")
    asked = vectors.where("chunk_id % 50 = 0").toDF("query_id", "dense")
    one, many = ({(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.dense_search(vectors, asked, 7, block=n).collect()} for n in (4096, 2))
    assert one == many and len(one) == 42 and all(one[q, 1] == q for q in range(0, 300, 50))
    assert retrieval.dense_search(vectors, asked.limit(0), 7).count() == 0


def test_numbering(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "cold").alias("g"), ((F.col("id") * 7) % 1000).alias("k"))
    found = sorted(((r["g"] or "", r["k"], r["number"]) for r in numbered(rows, ["g"], ["k"]).collect()))
    assert [n for g, _, n in found if g == "hot"] == list(range(1, 901)) and [n for g, _, n in found if g == ""] == list(range(1, 11))


def test_resume(spark):
    made = spark.createDataFrame([("a", i) for i in range(1, 5)], "dimension_id string, batch_number long")
    done = made.where("batch_number <= 2")
    assert [r["batch_number"] for r in calibration.pending_jobs(made, done, "s", "s").orderBy("batch_number").collect()] == [3, 4]
    for bad in (lambda: calibration.pending_jobs(made, done, "x", "s"), lambda: calibration.pending_jobs(made, made.where("batch_number = 2"), "s", "s")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    assert calibration.signature({"a": 1}, b"x", [("p", 1, 2)]) != calibration.signature({"a": 1}, b"x", [("p", 1, 3)])


def test_layout_of_many_pages_is_that_of_each(spark):
    """Pages laid out together against the rule for one page: two columns, crossing lines, copies, parts of words, odd white space; one page of many lines."""
    dice = random.Random(3)
    rows = []
    for doc in range(40):
        for i in range(12 * dice.randint(1, 15)):
            x = (20.0 if i % 12 < 6 else 420.0) + i % 6 * 50.0 + dice.random()
            wide = dice.random() < 0.004
            word = dice.choice(["ab", "cd", "é f", "ghij", "ab"] + ["\tq"] * (doc % 9 == 0))
            rows.append((doc, 1, i, 350.0 if wide else x, i // 12 * 14.0 + (dice.random() < 0.03) * 1.5, 100.0 if wide else dice.choice([30.0, 49.9, 54.0]), 10.0, dice.choice(["", "", " "]) + word + dice.choice(["", " "]), 760.0))
    rows += [(99, 1, i, i % 8 * 60.0, i // 8 * 14.0, 40.0, 10.0, "word", 480.0) for i in range(40_000)]
    items = spark.createDataFrame(rows, "document_id long, page int, item_no int, x double, y double, width double, height double, raw string, page_width double")
    for columns in (True, False):
        got = {r["document_id"]: r["text"] for r in layout.layout_pages(items, columns).collect()}
        for doc in range(40):
            own = [layout.Item(*r[3:7], r[7].strip(" "), r[7]) for r in rows if r[0] == doc]
            assert got[doc] == layout.page_text(own, 760.0, columns, layout.line_text if columns else layout.simple_line_text)
        assert got[99] == "\n".join(["\t".join(["word"] * 8)] * 5000)


def test_csv_keeps_every_character(spark, tmp_path):
    """White space at the ends, empty texts, all line ends, quotes beside NUL and backslashes come back as they were."""
    texts = ["", " lead", "trail ", "\tx\t", "a\rb", "a\r\nb", "\r", "\n", "a\n", '"', '"a"', 'x"\0', "\0", '"\0"', "\\", '\\"', ",", '",\n"', "#c", "\x01", 'q"\r\n"q', "null", "y" * 1_100_000 + '\r\n"']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("lpad(cast(id as string), 4, '0') as id", "text")
    for name, write in (("plain", store.plain_csv), ("ordered", lambda r, p: store.write_csv(r, p, ["id"], 3))):
        write(rows, f"{tmp_path}/{name}")
        got = files.read_checked_csv(spark, f"{tmp_path}/{name}", ["id", "text"])
        assert [r["text"] for r in sorted(got.collect())] == texts


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(100).selectExpr("'g' as g", "id").mapInArrow(run, "g string, id long")
    assert sorted((r["id"], r["number"]) for r in numbered(rows, ["g"], ["id"]).collect()) == [(i, i + 1) for i in range(100)]
    assert made.value == 100


def test_nothing_is_made_twice(spark):
    """Kept passages come without a join to all passages, pages without a recogniser without a join or a second pass; plain lines have no cells."""
    pages_ = spark.createDataFrame([(1, 1, "REFERENCES\n\nA plain line.\na  b\tc   d\n\n\x00\nEnd."), (1, 2, "A plain line.")], "document_id long, page int, text string")
    groups = passages.packed_groups(blocks.structure_blocks(pages_))
    assert "Join" not in _plan(passages.without_repeats(groups))
    checked = _plan(quality.recognised(pages_.withColumn("blank", F.lit(False))))
    assert "Join" not in checked and "Union" not in checked
    cells = {r["line"]: r["cells"] for r in blocks.classified_lines(pages_).collect()}
    assert cells["A plain line."] is None and cells["a  b\tc   d"] == ["a b", "c", "d"]
    assert [(r["block_no"], r["text"]) for r in blocks.structure_blocks(pages_).where("page = 1").orderBy("block_no").collect()] == [(1, "REFERENCES"), (2, "A plain line."), (3, "a b | c | d"), (4, "End.")]


def embedded_chunks(spark, monkeypatch):
    """An accumulator of the chunks that the stand-in embedder gets."""
    seen, embed = spark.sparkContext.accumulator(0), models.HashingEmbedder.embed

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(models.HashingEmbedder, "embed", lambda self, texts: embed(self, texts.mapInArrow(run, texts.schema) if "chunk_id" in texts.columns else texts))
    return seen


def test_answers_embed_each_chunk_once(spark, sf_dir, monkeypatch):
    seen = embedded_chunks(spark, monkeypatch)
    asked = queries.table(spark, sf_dir, "benchmark").count()
    assert len(queries.k05_answers(spark, sf_dir).collect()) == asked
    assert seen.value == queries.table(spark, sf_dir, "documents").count()


def test_framework_embeds_each_chunk_once(spark, sf_dir, monkeypatch):
    seen = embedded_chunks(spark, monkeypatch)
    assert len(queries.a06_framework(spark, sf_dir).collect()) == 3
    assert seen.value == queries.table(spark, sf_dir, "documents").count()


def test_hashed_vectors(spark):
    texts = ["one two One", None, "", "...", "caf\u00e9 \u212a9 \u0130x", "x" * 70000 + " y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    got = {r["n"]: r["dense"] for r in models.HashingEmbedder(8).embed(rows).collect()}
    for n, t in enumerate(texts):
        v = [0.0] * 8
        for term in re.findall("[a-z0-9]+", (t or "").lower()):
            h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            v[h % 8] += -1 if h >> 31 else 1
        norm = sum(x * x for x in v) ** 0.5 or 1
        assert all(abs(x / norm - y) < 1e-6 for x, y in zip(v, got[n], strict=True))


def test_calibration_texts_are_moved_once(spark, monkeypatch):
    monkeypatch.setattr(calibration, "PAIRS_AT_ONCE", 4)
    words = ["red fox", "red red hen", "blue fox", "", "green hen fox", "red"]
    rows = [(str(i), i, words[i % 6], f"s{i % 2}", 1, 1) for i in range(40)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id long, text string, source string, page int, number int").coalesce(2)
    # Of 40 documents 38 are in batches; those of dimension "c" have no question.
    placed = [(str(i), "abc"[i // 2 % 3], i // 12 + 1) for i in range(38)]
    batches = spark.createDataFrame(placed, "document_id string, dimension_id string, batch_number long")
    asked = [(1, "a", "k", 1, "red fox?"), (2, "a", "k", 2, "The hen"), (3, "b", "j", 1, "fox fox green"), (4, None, "j", 2, "red"), (5, "b", "k", 1, "none such"), (6, "b", "j", 3, None)]
    questions = spark.createDataFrame(asked, "question_id int, dimension_id string, category_id string, question_no int, question string")
    pairs = calibration.batch_pairs(chunks, batches, questions, 3, texts=False)
    assert set(pairs.columns) == set(calibration.PAIR_COLUMNS) - {"chunk_text"}

    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in retrieval.sparse_search(chunks, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), 100).collect()}
    wanted = {}
    for q, dimension, category, no, _ in asked:
        for batch in range(1, 5):
            found = sorted((-scores[q, int(d)], int(d)) for d, x, b in placed if x == dimension and b == batch and (q, int(d)) in scores)[:3]
            wanted |= {(dimension, batch, category, no, rank): (c, -score) for rank, (score, c) in enumerate(found, 1)}
    got = {(r["dimension_id"], r["batch_number"], r["category_id"], r["question_number"], r["rank"]): (r["chunk_id"], r["retrieval_score"]) for r in pairs.collect()}
    assert got == wanted and len(wanted) > 10
    whole = calibration.batch_pairs(chunks, batches, questions, 3)
    assert whole.columns == list(calibration.PAIR_COLUMNS) and {(r["chunk_id"], r["chunk_text"]) for r in whole.collect()} == {(c, words[c % 6]) for c, _ in wanted.values()}

    told = store.calibration_response(pairs, calibration.batch_texts(chunks, batches)).collect()
    assert {(r["dimension_id"], r["batch_number"]) for r in told} == {key[:2] for key in wanted} and len(told) == len({key[:2] for key in wanted})
    for r in told:
        answer = json.loads(r["response"])
        own = [(no, rank, *v) for (d, b, c, no, rank), v in sorted(wanted.items(), key=lambda x: str(x[0])) if (d, b) == (r["dimension_id"], r["batch_number"])]
        matches = [m for x in answer["results"] for m in x["matches"]]
        assert answer["ok"] and [(m["rank"], m["chunkId"], m["score"]) for m in matches] == [x[1:] for x in own]
        assert all(list(m) == ["rank", "source", "documentId", "chunkId", "page", "chunk", "score", "text"] and m["text"] == words[m["chunkId"] % 6] for m in matches)
