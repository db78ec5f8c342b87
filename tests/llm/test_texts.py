"""op1, op2, op5 and op10 against the libraries and plain Python."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import packing, queries, secrets, token_counts, token_store
from granary.llm.common import shared_dir
from granary.llm.tokens import PieceTokenizer, tokenizer_path

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_spans(odd_documents):
    rows = secrets.scan_secrets(odd_documents).join(odd_documents.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == odd_documents.where("doc_id is not null").count()
    for r in rows:
        found = [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]]
        assert [s for s in found if s[3] != "markov"] == base_spans(r["text"] or "")
        assert found == sorted(found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_secret_query(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op1_secret_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        counts = Counter(s[3] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_markov_model(spark):
    tokens = ["kX9vQ2mZt7Lp4RwB8nYc", "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffee", "get_user_name_value", "parseDocumentRecord", "development-environment"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id long, text string")
    found = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in secrets.scan_secrets(df).collect()}
    assert "markov" in found[0] and all("markov" not in found[i] for i in (2, 3, 4))


def test_joined_secrets_and_rules(spark):
    key = "kX9vQ2mZt7Lp4RwB8nYc"
    joined = [f"aws_access_credentials_production={key}", f"com/api/v1/webhooks/services/callbacks/{key}", f"aws_access_credentials_production_{key}", f"{key}=get_user_name_value_list/{key[::-1]}", f"x {'-' * 200}{key}"]
    ordinary = [c * n for c in "-_=+/aAexz0Q9" for n in (16, 40)] + ["-=" * 20, "+/" * 20, "_-" * 20, "----------------/====", "github/org/repository/blob/main/src/components/Button", "MAX_BUFFER_SIZE_LIMIT=4096"]
    df = spark.createDataFrame(list(enumerate(joined + ordinary)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"] for r in secrets.scan_secrets(df).collect()}
    for i, text in enumerate(joined):
        for k in (key, key[::-1]) if i == 3 else (key,):
            assert any(a <= text.index(k) and text.index(k) + len(k) <= b for a, b in found[i]), text
    assert found[0] == [(joined[0].index(key), len(joined[0]))] and len(found[3]) == 2
    assert [t for i, t in enumerate(ordinary, len(joined)) if found[i]] == []
    left = [r["text"] for r in secrets.redacted_documents(df).where(F.col("doc_id") < len(joined)).collect()]
    assert not any(key in t or key[::-1] in t for t in left)


def test_redaction(spark, odd_documents):
    out = secrets.redacted_documents(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert "abcdEFGH1234" not in by_id[13 * 3]["text"] and "[REDACTED]" in by_id[13 * 3]["text"]
    assert by_id[0]["text"] is None and by_id[13 * 3]["n_chars"] == len(by_id[13 * 3]["text"])
    again = out.select(F.size(secrets.secret_spans(F.col("text"), secrets.default_ratios(spark))).alias("n")).agg(F.sum("n")).first()[0]
    assert again == 0


def test_secrets_of_very_long_texts(spark):
    """Half a million characters without a space, 20,000 matches, and overlapping spans over block ends: in seconds, and as plain Python has them."""
    rng = random.Random(9)
    blob = base64.b64encode(rng.randbytes(400_000)).decode()
    many = " ".join(f"token={rng.randrange(16**12):012x} {rng.randrange(16**33):033x}" for _ in range(10_000))
    mixed = "".join(f"é secret=deadbeefdeadbeefdeadbeefdeadbeef{i} \U0001f600 x" for i in range(300))
    df = spark.createDataFrame([(0, blob), (1, many), (2, mixed)], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan_secrets(df).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redacted_documents(df).collect()}
    assert time.time() - began < 120
    for i, text in ((0, blob), (1, many), (2, mixed)):
        assert [s for s in found[i] if s[3] != "markov"] == base_spans(text)
        want, at = "", 0
        for start, _, end, _ in found[i]:
            want, at = (want + text[at:start] + "[REDACTED]" if start >= at else want), max(at, end)
        assert out[i] == want + text[at:]
    assert (0, 3, len(blob), "markov") in found[0] and len(found[1]) > 20_000


def test_markov_ratios_against_plain_python(spark):
    random_, ordinary = ["aZ9xQ", "k2-9", "zz zz", "a", ""], ["get_name", "name", "get/", "éa"]
    found = secrets.markov_ratios(*(spark.createDataFrame([(t,) for t in x], "text string") for x in (random_, ordinary)))
    letters = secrets._ALPHABET
    counts = [Counter(t[i : i + 2] for t in x for i in range(len(t) - 1) if set(t[i : i + 2]) <= set(letters)) for x in (random_, ordinary)]
    for i, a in enumerate(letters):
        for j, b in enumerate(letters):
            r, o = ((c[a + b] + 1) / sum(c[a + d] + 1 for d in letters) for c in counts)
            ratio = np.log(r) - np.log(o)
            plain = a == b or (a in "+/_=-" and b in "+/_=-") or a in "=/" or b in "=/"
            assert abs(found[i][j] - (min(ratio, 0) if plain else ratio)) < 1e-9
    row = spark.createDataFrame([("aZ9xQget_name",)], "t string").select(secrets.mean_ratio(F.col("t"), found)).first()[0]
    t = "aZ9xQget_name"
    assert abs(row - np.mean([float(f"{found[letters.index(x)][letters.index(y)]:.5g}") for x, y in zip(t, t[1:])])) < 1e-6


def library(name: str):
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, texts):
    ids_of = library(packing.TOKENIZER)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = Counter(i for i, _ in texts)
    total = padding = 0
    for doc, text in texts:
        ids = np.array([*ids_of(text), 2], "<u4")
        at = 0
        if want[doc] > 1:
            assert sum(p["length"] for p in pieces[doc]) == sum(len(ids_of(t)) + 1 for i, t in texts if i == doc)
            continue
        for p in sorted(pieces[doc], key=lambda p: p["start"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * total


def test_packing(odd_documents, spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    check_pieces(packing.pack(odd_documents, tokenizer_path(packing.TOKENIZER)).collect(), texts)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_pieces(queries.op2_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def plain_differencing(sizes: list[int], k: int) -> list[int]:
    """Window sums by the textbook form: always merge the two partial partitions of the largest spread."""
    parts = [[s] + [0] * (k - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p) - min(p))
        a, b = parts.pop(), parts.pop()
        parts.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True), strict=True)])
    return sorted(parts[0])


def test_differencing_is_the_textbook_one_and_rises():
    sizes = [701, 653, 407, 401, 383, 307, 293, 127, 61, 11]
    windows = packing.differencing(sizes, 3)
    assert sorted(i for w in windows for i in w) == list(range(10))
    assert sorted(sum(sizes[i] for i in w) for w in windows) == plain_differencing(sizes, 3)
    assert all(sum(x) <= 1000 for x in ([700 for _ in w] for w in packing.windows_within([700] * 3, 1000)))
    assert packing.windows_within([], 10) == [] and packing.pack_sizes([], 10) == []


def test_token_store(odd_documents, spark, sf_dir):
    ids_of = library(token_store.TOKENIZER)
    for docs in (odd_documents, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        path = shared_dir(spark, "test-store")
        token_store.write_store(docs, path, tokenizer_path(token_store.TOKENIZER), parts=3)
        rows = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        assert all(r["verified"] for r in rows) and all(r["verified"] for r in token_store.verify_manifest(spark, path).collect())
        at, order = 0, []
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r["doc_id"]].append(r["text"])
        for r in rows:
            want = {np.array([*ids_of(t), 2], "<u4").tobytes() for t in texts[r["doc_id"]]}
            assert bytes(r["ids"]) in want and r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
            at += r["n_tokens"]
            order.append(-(1 << 62) if r["doc_id"] is None else r["doc_id"])
        assert order == sorted(order) and len(rows) == docs.count()


def test_shared_chunks_are_stored_once(spark):
    text = " ".join(f"word{i} of the common passage" for i in range(3000))
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    path = shared_dir(spark, "test-shared")
    token_store.write_store(docs, path, tokenizer_path(token_store.TOKENIZER), parts=2)
    sizes = sorted(len(r["data"]) for r in spark.read.parquet(f"{path}/ids").collect())
    assert sizes[:5] == [1] * 5 and sizes[5] > 1000
    assert len({r["ids_crc32"] for r in token_store.read_store(spark, path).collect()}) == 1


def test_corrupt_stores_are_found(spark):
    """A changed chunk, root, recipe and manifest, and a lost chunk: each leaves its documents unverified, and only those."""
    text = " ".join(f"word{i} of the common passage" for i in range(900))
    docs = spark.createDataFrame([(0, text), (1, f"{text} more"), (2, "by itself"), (3, "another one " * 300), (4, None)], "doc_id long, text string")
    good = shared_dir(spark, "test-good")
    token_store.write_store(docs, good, tokenizer_path(token_store.TOKENIZER), parts=1)
    assert {r["doc_id"]: r["verified"] for r in token_store.read_store(spark, good).collect()} == dict.fromkeys(range(5), True)
    held, manifest = spark.read.parquet(f"{good}/ids"), spark.read.parquet(f"{good}/manifest")
    first = F.col("doc_id") == held.where(F.size("lent") > 0).first()["doc_id"]
    other = lambda c: F.concat(F.unhex(F.lit("ffff")), F.substring(c, 3, 1 << 30))
    cases = {
        "data": (held.withColumn("data", F.when(first, other("data")).otherwise(F.col("data"))), manifest, {2, 3, 4}),
        "alone": (held.withColumn("data", F.when(F.col("doc_id") == 2, other("data")).otherwise(F.col("data"))), manifest, {0, 1, 3, 4}),
        "recipe": (held.withColumn("hashes", F.when(F.col("doc_id") == 3, other("hashes")).otherwise(F.col("hashes"))), manifest, {0, 1, 2, 4}),
        "root": (held.withColumn("root", F.when(F.col("doc_id") == 2, other("root")).otherwise(F.col("root"))), manifest, set()),
        "manifest": (held, manifest.withColumn("ids", F.col("ids") + 1), set()),
        "lent": (held.withColumn("lent", F.slice("lent", 2, 1 << 20)), manifest, {2, 3, 4} | ({0, 1} & {r["doc_id"] for r in held.where(F.size("foreign") == 0).collect()})),
    }
    for name, (ids, parts, fine) in cases.items():
        path = shared_dir(spark, f"test-{name}")
        ids.write.parquet(f"{path}/ids")
        parts.write.parquet(f"{path}/manifest")
        rows = token_store.read_store(spark, path).collect()
        assert {r["doc_id"] for r in rows if r["verified"]} == fine and len(rows) == 5, name


def test_token_counts(odd_documents, spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    for docs in (odd_documents, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect())
        rows = token_counts.token_counts(docs, tokenizer_path(token_counts.MODEL)).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def test_longest_prefix_without_the_whole_table(odd_texts):
    counter = token_counts.PrefixCounter(PieceTokenizer(tokenizer_path(token_counts.MODEL)))
    for text in [t or "" for t in odd_texts] + ["  two", " ", "東京" * 90, "x" * 300 + " " + "y" * 300, "a  b", "\n \n"]:
        found = counter.prefixes(text)
        for budget in (-1, 0, 1, 2, 3, 7, 50, 100, found.total() - 1, found.total(), 10_000):
            chars = found.longest(budget)
            assert counter.longest(text, budget) == (chars, found.at(chars)), (text[:40], budget)


def test_query_reads_prefix_tables(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op10_token_counts(spark, folder).collect()
    over = [r for r in rows if r["over_limit"]]
    assert len(rows) == len(texts) and all(r["limit_chars"] == len(texts[r["doc_id"]]) for r in rows if not r["over_limit"])
    assert over
    for r in over:
        text, at = texts[r["doc_id"]], r["limit_chars"]
        assert len(model.encode(text[:at])) <= 4096 and all(len(model.encode(text[:i])) > 4096 for i in range(at + 1, min(at + 12, len(text)) + 1))


def test_prefix_counts(odd_texts, spark):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    counter = token_counts.PrefixCounter(PieceTokenizer(tokenizer_path(token_counts.MODEL)))
    for text in [t for t in odd_texts if t and len(t) < 1500]:
        found = counter.prefixes(text)
        assert found.counts.tolist() == [len(model.encode(text[:i])) for i in range(len(text) + 1)], text
        for budget in (0, 1, 7, 100):
            assert found.longest(budget) == max(i for i in range(len(text) + 1) if len(model.encode(text[:i])) <= budget)
    rows = token_counts.truncate_to_budget(spark.createDataFrame([(1, None), (2, "a few words of text")], "doc_id long, text string"), tokenizer_path(token_counts.MODEL), 3).collect()
    assert [(r["doc_id"], r["n_tokens"] <= 3) for r in rows] == [(1, True), (2, True)]


def test_prefix_counts_of_long_segments(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    rng = random.Random(3)
    pieces = ["function", "return", ".length", "ation", "{", "}", "\n", "\t", "é", "é", "\U0001f600", "東", "京", "データ", "<0x09>", "---", "00", "q", "Zx9"]
    code = "".join(rng.choice(pieces) for _ in range(60_000))[:100_000]
    texts = [code[:1500], "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(800)), base64.b64encode(rng.randbytes(900)).decode(), " " * 300 + "word" * 60, "a" * 500]
    encoded = []
    counted = PieceTokenizer.count_segments
    monkeypatch.setattr(PieceTokenizer, "count_segments", lambda self, segments: encoded.append(sum(map(len, segments))) or counted(self, segments))
    counter = token_counts.PrefixCounter(PieceTokenizer(tokenizer_path(token_counts.MODEL)))
    for text in texts:
        assert counter.prefixes(text).counts.tolist() == [len(model.encode(text[:i])) for i in range(len(text) + 1)], text[:50]
    assert sum(encoded) < 100 * sum(map(len, texts))
    found = counter.prefixes(code)
    assert len(found.counts) == len(code) + 1 and all(found.at(i) == len(model.encode(code[:i])) for i in [*range(0, len(code), 9973), len(code)])
    row = token_counts.truncate_to_budget(spark.createDataFrame([(1, code)], "doc_id long, text string"), tokenizer_path(token_counts.MODEL), 4096).first()
    assert row["text"] == code[: found.longest(4096)] and row["n_tokens"] == len(model.encode(row["text"])) <= 4096 < len(model.encode(code))


def test_empty_tables(no_documents):
    assert secrets.scan_secrets(no_documents).count() == 0
    assert packing.pack(no_documents, tokenizer_path(packing.TOKENIZER)).count() == 0
    assert token_counts.token_counts(no_documents, tokenizer_path(token_counts.MODEL)).count() == 0
    path = shared_dir(no_documents.sparkSession, "none")
    token_store.write_store(no_documents, path, tokenizer_path(token_store.TOKENIZER))
    assert token_store.read_store(no_documents.sparkSession, path).count() == 0
