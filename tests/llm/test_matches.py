"""op3, op4, op6, op7, op8, op9 and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import chat, components, decontaminate, minhash_dedup, packing, quality, queries, secrets, substring_dedup, vector_dedup
from granary.llm.tokens import tokenizer_path
from tests.llm.test_texts import check_pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded(text):
    return WORD.findall((text or "").translate(FOLD))


def contaminated(text, items):
    words = folded(text)
    hit, named = set(), set()
    for item, item_text in items:
        own = folded(item_text)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                named.add(str(item))
    return len(words), len(hit), sorted(named)


def test_decontamination(spark, odd_documents, odd_texts, no_documents):
    items = [(1, odd_texts[10]), (2, "Word"), (3, None), (4, "!!!"), (5, "two words"), (10, " ".join(odd_texts[7].split(" ")[3:13])), (11, " ".join(odd_texts[7].split(" ")[3:12])), (12, odd_texts[17])]
    bench = spark.createDataFrame([*items, items[0], (None, "word")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = Counter()
    for r in odd_documents.collect():
        n, hit, named = contaminated(r["text"], items)
        want[r["doc_id"], n, hit, tuple(named), hit > 0] += 1
    for block in (decontaminate.BLOCK_BYTES, 300):
        rows = decontaminate.contaminated_words(odd_documents, bench, block_bytes=block).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows) == want
        clean = decontaminate.clean_documents(odd_documents, bench, block_bytes=block)
        assert clean.columns == odd_documents.columns
        assert Counter(r["doc_id"] for r in clean.collect()) == Counter({k[0]: n for k, n in want.items() if not k[4]})
    assert decontaminate.contaminated_words(no_documents, bench).count() == 0
    assert decontaminate.contaminated_words(odd_documents, bench.limit(0)).where("contaminated").count() == 0


def test_substring_removal(spark, odd_documents, no_documents):
    rows = odd_documents.collect()
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w] for r in rows]
    least: dict = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - 12) if r["doc_id"] is not None else ():
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - 12) if r["doc_id"] is not None and least[tuple(w[i : i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[r["doc_id"], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for size in (substring_dedup.GROUP_BYTES, 2000):
        assert Counter(map(tuple, substring_dedup.remove_repeats(odd_documents, group_bytes=size).collect())) == want
    assert sum(n * k[2] for k, n in want.items()) > 300
    assert substring_dedup.remove_repeats(no_documents).count() == 0


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        c = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2])
        rows.append((i * 2, [float(np.float32(x)) for x in c * rng.uniform(0.1, 9)], int(rng.integers(3)) if i % 11 else None))
    chain = [np.cos(t * 0.15) * np.eye(16)[0] + np.sin(t * 0.15) * np.eye(16)[1] for t in range(20)]
    rows += [(2001 + 2 * i, [float(np.float32(x)) for x in c], 1) for i, c in enumerate(chain)]
    rows += [(5, None, 1), (7, [], 1), (9, [0.0] * 16, 1), (11, [1.0] * 15 + [None], 1), (13, [float("nan")] * 16, 1), (15, [float("inf")] + [1.0] * 15, 1), (17, [1.0, 2.0], 1), (19, [2.0, 4.0], 1), (21, [1e-30] * 16, 2), (23, [1e30] * 16, 2), (25, [1e-38, 2e-38], 1), (27, [3e38, 1e38], 1)]
    rows += [(3001 + i, rows[1][1], rows[1][2]) for i in range(3)]
    return spark.createDataFrame([(i, v, n, "x") for i, v, n in rows], "vec_id long, embedding array<float>, label int, kept string")


def test_vector_links(odd_vectors):
    rows = odd_vectors.collect()
    fine = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in rows if r["embedding"] and r["label"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    links = [(a[0], b[0]) for i, a in enumerate(fine) for b in fine[i + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (math.sqrt(a[1] @ a[1]) * math.sqrt(b[1] @ b[1])) >= 0.98]
    count = Counter(x for pair in links for x in pair)
    root = roots([r["vec_id"] for r in rows], links)
    assert len(links) > 300
    for block in (vector_dedup.BLOCK, 32):
        found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(odd_vectors, block=block).collect()}
        assert found == {i: (count[i], root[i], root[i] == i) for i in root}
    assert vector_dedup.near_vectors(odd_vectors.limit(0)).count() == 0


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [2e300, 4e300]), (4, [5e-324, 1e-323]), (5, [2.0, -1.0])]
    found = vector_dedup.near_vectors(spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string"))
    apart = vector_dedup.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "b")], "vec_id long, embedding array<double>, label string"))
    assert sorted(map(tuple, apart.collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 48)) * rng.exponential(size=(200, 48)) ** 4
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    codes, scale, error = vector_dedup.quantise(a)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - a @ a.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :]).all()


def shingle_counts(text):
    w = folded(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_similarity(a, b):
    ta, tb = sum(a.values()), sum(b.values())
    return sum(1 / sum(max(a[j] / ta / (a[i] / ta), b[j] / tb / (b[i] / tb)) for j in a.keys() | b.keys()) for i in a.keys() & b.keys()) if a and b else 0.0


def near_groups(rows):
    first: dict = {}
    for r in rows:
        if r["doc_id"] is not None and folded(r["text"]):
            key = tuple(folded(r["text"]))
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    kinds = [(i, shingle_counts(" ".join(k))) for k, i in first.items()]
    links = [(a, b) for n, (a, x) in enumerate(kinds) for b, y in kinds[n + 1 :] if x.keys() & y.keys() and plain_similarity(x, y) >= 0.8]
    root = roots([i for i, _ in kinds], links)
    return {r["doc_id"]: root[first[tuple(folded(r["text"]))]] if folded(r["text"]) else r["doc_id"] for r in rows if r["doc_id"] is not None}, len(links)


@pytest.fixture(scope="module")
def near_documents(spark):
    """Groups of near copies at all distances, chains of small changes, and copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
    texts += texts[:5] + ["same words twice " * 30, "same words twice " * 31, "a b", "A, b!", "a b c"]
    return spark.createDataFrame([(7 * i % 1009, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_documents(odd_documents, near_documents, no_documents):
    for docs in (odd_documents, near_documents):
        rows = docs.collect()
        want, links = near_groups(rows)
        assert links > 0
        for block in (minhash_dedup.BLOCK, 4):
            found = minhash_dedup.near_documents(docs, block=block).collect()
            assert len(found) == len(rows)
            assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None} == want
            assert all(r["kept"] == (r["doc_id"] in (None, r["class_id"])) for r in found)
        left = minhash_dedup.one_of_each(docs)
        assert left.columns == docs.columns
        assert Counter(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == Counter(set(want.values()))
    assert minhash_dedup.near_documents(no_documents).count() == 0 and minhash_dedup.one_of_each(no_documents).count() == 0


def test_minhash_estimates_the_similarity():
    rng = random.Random(2)
    a = Counter({("w", i): rng.randint(1, 6) for i in range(60)})
    b = Counter({("w", i): rng.randint(1, 6) for i in range(15, 75)})
    number = {k: int.from_bytes(hashlib.blake2b(repr(k).encode(), digest_size=8).digest(), "little") for k in a | b}
    doc = np.array([0] * len(a) + [1] * len(b))
    value = np.array([number[k] for c in (a, b) for k in c], np.uint64)
    weight = np.array([n for c in (a, b) for n in c.values()], float)
    signs = minhash_dedup.prob_minhash(doc, value, weight, 2, 4096)
    exact = plain_similarity(a, b)
    assert abs((signs[0] == signs[1]).mean() - exact) < 0.03
    order = [np.argsort(value[doc == i]) for i in (0, 1)]
    parts = [(value[doc == i][o], weight[doc == i][o].astype("<u4")) for i, o in enumerate(order)]
    assert abs(minhash_dedup.probability_jaccard(*parts[0], *parts[1]) - exact) < 1e-9


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(500)] + [(1, 1)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "src long, dst long"))[0].collect()}
    root = roots({x for p in links for x in p}, links)
    assert {n: found.get(n, n) for n in root} == root
    assert components.components(spark.createDataFrame([], "src long, dst long"))[0].count() == 0


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for_fit = labels.where(F.pmod(F.hash("doc_id"), F.lit(2)) == 0)
    judged = quality.judge(docs, for_fit).join(labels.join(for_fit, "doc_id", "left_anti").withColumnRenamed("quality", "good"), "doc_id").toPandas()
    assert len(judged) > 1000
    assert ((judged.quality >= 0.5) == (judged.good == 1)).mean() > 0.99
    clean = judged[(judged.good == 1) & (judged.toxic == 0)]
    assert clean.kept.mean() > 0.99 and judged[judged.good == 0].kept.mean() < 0.02 and judged[judged.toxic == 1].kept.mean() < 0.15


def plain_features(text, lists):
    t = (text or "").encode()
    size, words, lines = max(len(t), 1), [w for w in re.split(rb"[ \x09-\x0d]+", t) if w], t.split(b"\n")
    n, counts = max(len(words), 1), Counter(words)
    marks = b".,;:'\"-?()"
    share = lambda good: sum(map(good, t)) / size
    folded_ = b" " + bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in t) + b" " * 6
    seen = Counter(int.from_bytes(folded_[i : i + 6], "big") for i in range(len(t) + 1))
    marked = set(seen) | {v | 1 << 48 for v, k in seen.items() if k > 1}
    return [
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in marks), share(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in marks), min(size / n, 50), math.log1p(len(words)), len(counts) / n,
        max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines), *(min(8, len(marked & set(x))) for x in lists),
    ]


def test_quality_against_plain_python(spark):
    """Evidence, the site's prior and the posterior of every document, recomputed one by one."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://"), "source", F.lit("/p"), (F.col("doc_id") % 4).cast("string"))).otherwise(F.col("source")))
    model = quality.fit(docs, labels)
    lists = [set(x.values.tolist()) for x in (model.bad, model.toxic_list)]
    sigmoid = lambda z: min(max(1 / (1 + math.exp(-min(max(z, -30), 30))), 1e-6), 1 - 1e-6)
    own, rows = {}, docs.collect()
    for r in rows:
        x = plain_features(r["text"], lists)
        own[r["doc_id"]] = [sigmoid(m.weight[0] + sum(w * (a - b) / c for w, a, b, c in zip(m.weight[1:], x, m.mean, m.scale))) for m in (model.quality, model.toxic)]
    site = {}
    for r in rows:
        clean = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (r["source"] or "").lower())
        host, _, path = clean.partition("/")
        site[r["doc_id"]] = (host, re.split("[/?#]", path)[0] or r["lang"] or "")
    want = {i: [] for i in own}
    for c in (0, 1):
        rate = sum(x[c] for x in own.values()) / len(own)

        def grouped(key):
            out = defaultdict(lambda: [0, 0.0])
            for i, x in own.items():
                if site[i][0]:
                    out[key(i)][0] += 1
                    out[key(i)][1] += x[c]
            return out

        def strength(groups, above):
            n, k = sum(g[0] for g in groups.values()), len(groups)
            between = sum(g[0] * (g[1] / g[0] - above(s)) ** 2 for s, g in groups.items())
            within = sum(g[0] * above(s) * (1 - above(s)) for s, g in groups.items())
            extra = (between * n / within - k) / max(n - k, 1)
            return min(max(1 / extra - 1, 1.0), 1000.0) if extra > 0 else 1000.0

        hosts, paths = grouped(lambda i: site[i][0]), grouped(lambda i: site[i])
        kh = strength(hosts, lambda s: rate)
        shrunk = lambda total, n, k, above: (total + k * above) / (n + k)
        kp = strength(paths, lambda s: shrunk(hosts[s[0]][1], hosts[s[0]][0], kh, rate))
        for i, x in own.items():
            host, path = hosts.get(site[i][0]), paths.get(site[i])
            prior = shrunk(path[1] - x[c], path[0] - 1, kp, shrunk(host[1] - x[c], host[0] - 1, kh, rate)) if host else rate
            prior = min(max(prior, 1e-6), 1 - 1e-6)
            odds = prior / (1 - prior) * x[c] / (1 - x[c]) / (rate / (1 - rate))
            want[i] += [x[c], prior, odds / (1 + odds)]
    found = quality.judge(docs, labels, model=model).collect()
    assert len(found) == len(rows) == len(own)
    for r in found:
        w = want[r["doc_id"]]
        assert (r["host"], r["path"]) == site[r["doc_id"]]
        assert np.allclose([r["evidence"], r["site_prior"], r["quality"], r["toxicity"]], [w[0], w[1], w[2], w[5]], rtol=1e-6, atol=1e-9)
        assert r["kept"] == (r["quality"] >= 0.5 and r["toxicity"] < 0.5)


def test_quality_sample_size(spark, monkeypatch):
    sizes = []
    listed = quality.listed_fragments
    monkeypatch.setattr(quality, "listed_fragments", lambda taken: sizes.append((taken.count(), taken.where("quality = 0").count())) or listed(taken))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    own = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    repeated = own.crossJoin(spark.range(60)).drop("id")
    foreign = spark.range(1000, 9000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    many = docs.unionByName(docs.where("doc_id = 6").crossJoin(spark.range(500)).drop("id"))
    for table, labels in ((docs, own), (docs, repeated), (docs, own.unionByName(foreign)), (many, own)):
        quality.fit(table, labels, sample=100)
        quality.fit(table, labels, sample=1000)
    assert [n for n, _ in sizes] == [100, 200] * 4 and len(set(sizes)) == 2


def test_quality_of_odd_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(3 * i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(50)] + [(3, 0, 1), (None, 1, 1), (9, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["quality"] <= 1 and r["kept"] is not None for r in rows)
    assert quality.kept_documents(odd_documents, labels).columns == odd_documents.columns
    assert quality.judge(no_documents, labels).count() == 0
    # Without labels nothing is rejected.
    assert quality.judge(odd_documents, labels.limit(0)).where("not kept").count() == 0
    assert quality.judge(odd_documents, labels.where("quality = 1 and toxic = 0")).where("not kept").count() == 0


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "a", 0.2)] * 400 + [("big", "b", 0.9)] * 400 + [("fine", "a", 0.9)] * 400 + [("tiny", "a", 0.2)]
    scored = spark.createDataFrame(rows, "_granary_host string, _granary_path string, _granary_quality double").withColumn("_granary_toxic", F.lit(0.01))
    prior = {(r["_granary_host"], r["_granary_path"]): r["_granary_prior_quality"] for r in quality.posteriors(scored).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert abs(prior["tiny", "a"] - mean) < 0.05 and prior["big", "a"] < 0.25 and prior["big", "b"] > 0.85
    assert quality.site(F.lit("x"), F.lit("y")) is not None
    sites = spark.createDataFrame([("https://Example.org/blog/1?x=2", "en"), ("src1", "fr"), (None, "en"), ("host/", None)], "s string, l string")
    host, path = quality.site(F.col("s"), F.col("l"))
    assert [tuple(r) for r in sites.select(host, path).collect()] == [("example.org", "blog"), ("src1", "fr"), ("", "en"), ("host", "")]


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<<SYS>>\n", "\\", "\\\\<s>", "<|end|> <|x|>", "", None, "plain\n text", "[INST] [/INST]\n", "<\\s>", "<<|", "</s>\n"]
    roles = ["system", "user", "assistant", "tool|>", None, "</s>\n", ">x", "|>", ">"]
    rng = random.Random(8)
    rows = [(c, t, rng.choice(roles), rng.choice(said), "x") for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "system", "s", "x"), (100, 1, "user", "u", "x"), (100, 2, "assistant", "a", "x"), (101, 0, "user", "u", "x"), (101, 1, "user", "u", "x"), (None, 0, "user", "u", "x"), (102, 0, "user", "q", "x"), (102, 0, "user", "q", "x")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r["conv_id"]: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in sorted(turns)]
        assert all(t["loss"] == (t["role"] == "assistant") for t in got[c]["turns"])
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    assert got[100]["valid"] and not got[101]["valid"]


def test_chat_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op4_chat_format(spark, sf_dir).collect()}
    rows = sorted((r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, text))
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert len(got) == len(by)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    state = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(list(state.values()), docs.schema), sf_dir)
        assert out.columns == docs.columns
        now = {r["doc_id"]: r for r in out.collect()}
        if name == "quality_classifier":
            want = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
        elif name == "minhash_near_dedup":
            want = set(near_groups(list(state.values()))[0].values())
        elif name == "benchmark_decontamination":
            want = {i for i, r in state.items() if not contaminated(r["text"], items)[1]}
        else:
            want = set(state)
            spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(list(state.values()), docs.schema)).collect()}
            for i, r in state.items():
                text = list(r["text"] or "")
                covered = [False] * (len(text) + 1)
                for s in spans[i]:
                    covered[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
                starts = {s["start"] for s in spans[i] if not s["start"] or not covered[s["start"] - 1] or s["start"] in {x["end"] for x in spans[i]}}
                assert now[i]["text"].count("[REDACTED]") >= 1 if starts else now[i]["text"] == r["text"]
                assert all("".join(text[s["start"] : s["end"]]) not in now[i]["text"] for s in spans[i])
        assert set(now) == want, name
        assert all(tuple(r) == tuple(state[i]) for i, r in now.items()) or name == "secret_scans"
        state = now
    final = corpus_pipeline.run(spark, sf_dir).collect()
    check_pieces(final, [(i, r["text"]) for i, r in state.items()])
    ids_of = {(r["sequence_id"], r["offset"]): r["ids"] for r in final}
    assert all(len(x) > 0 for x in ids_of.values())
    assert packing.TOKENIZER in tokenizer_path(packing.TOKENIZER)


def test_pipeline_stages_on_odd_tables(spark, odd_documents, no_documents, sf_dir):
    """Null values, empty and long texts, repeats, clashing columns, and no rows at all, through every stage."""
    odd = odd_documents.withColumn("kept", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("class_id", F.lit(2.5)).withColumn("item_id", F.lit(None).cast("long"))
    for docs in (odd, no_documents.withColumn("n", F.lit(1))):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            found = out.collect()
            assert len(found) == rows if name == "secret_scans" else len(found) <= rows, name
            if rows and name != "quality_classifier":
                assert sum(r["text"] is None for r in found) == 1, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        check_pieces(packed, [(r["doc_id"], r["text"]) for r in docs.collect()])
