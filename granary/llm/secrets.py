"""Secret scans with character Markov models, in DataFrame expressions only.

Base spans are those of three patterns. Beside them, tokens of 16 or more
characters are scored by the log-likelihood ratio of two first-order character
Markov models, one of random strings and one of ordinary identifiers, both
counted by a grouped aggregation over labelled samples. A token over the
threshold is a span of kind ``markov``. Of any other token its stretches of 16
or more characters that are over the threshold are found (a secret joined to a
name or path), and the pieces between ``=`` and ``/`` that they lie in are spans.

Spark has no expression for the place of a match. So matches are marked instead:
each is put between two control characters, the text is split there, and the
lengths of the parts give the places. (Those control characters in a text are
first replaced by another, which no pattern matches either, so nothing moves.)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
_KEY = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api")
ASSIGN = rf"""({_KEY}_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A key of fewer than 16 characters fails with all that follows in its run, so the length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
_ANY_ASSIGN = r"(?:[Ss][Ss][Ww][Oo]?[Rr]?[Dd]|[Ee][Cc][Rr][Ee][Tt]|[Oo][Kk][Ee][Nn]|[Kk][Ee][Yy])[\"']?\x20*[:=]"
_SEP, _PART, _STAND_IN = "\x01", "\x02", "\x03"

#: A token is a secret where the mean log-likelihood ratio of its character pairs is over this many nats.
THRESHOLD = 1.0
#: The shortest stretch of a token that is scored by itself, as the shortest token is.
SHORTEST = 16
#: Samples of each random form and of each identifier form that the models are counted from.
SAMPLES = 1500
_MARKS = "+/_=-"
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

_VERBS = "get set is has add remove create delete update find read write open close load save parse format render build make init start stop send receive handle process validate compute merge split join filter sort map reduce encode decode check apply register resolve convert insert select count print fetch store".split()
_NOUNS = "user name value index count list item data file path config option result error message request response session table column row key query string number buffer stream token parser handler manager factory service client server context state event listener element node tree graph model view controller document field record window position length size type class object instance method function parameter argument variable property attribute".split()
_WORDS = "the of and that with from this have which their would about there other information university international development understanding government administration responsibility communication characteristics environment organization relationship management experience performance particularly nevertheless significantly entwicklung verantwortung gesellschaft wissenschaft connaissance gouvernement developpement responsabilidad comunicacion universidad".split()


def random_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text``: strings of uniform characters, from hashes of a counter: hex, Base64 and upper-case letters with digits."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base = spark.range(n)
    return base.select(
        F.explode(
            F.array(
                F.substring(digest("a"), 1, 40),
                F.translate(F.base64(F.unhex(digest("b"))), "=", ""),
                F.translate(F.base64(F.unhex(digest("c"))), "+/=", "-_"),
                F.translate(F.upper(F.base64(F.unhex(digest("d")))), "+/=", "09"),
            )
        ).alias("text")
    )


def identifier_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text``: identifiers as programs have them (camelCase, snake_case, paths, constants, with numbers) and long words."""
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.lit(by), F.col("id")), F.lit(len(words))) + 1).cast("int"))
    a, b, c, w = pick(_VERBS, "a"), pick(_NOUNS, "b"), pick(_NOUNS, "c"), pick(_WORDS, "w")
    number = F.pmod(F.xxhash64(F.lit("n"), F.col("id")), F.lit(2100)).cast("string")
    forms = F.array(F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("_", a, b, c), F.concat_ws("-", b, c, number), F.upper(F.concat_ws("_", b, c)), F.concat(F.initcap(b), F.initcap(c), number), F.concat_ws("/", a, b, c), F.concat(w, c, w), w)
    return spark.range(n).select(F.explode(forms).alias("text"))


def markov_ratios(random: DataFrame, ordinary: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios, random over ordinary, of each character after each other.

    Both models are counted by a grouped aggregation over the samples' pairs and
    smoothed by one for each character of the alphabet; pairs with other
    characters count for nothing. At most 67 x 67 counts reach the driver.

    Rules, repeated characters and joints are ordinary however rare they are in
    the samples: a pair of equal characters, of two marks or with ``=`` or ``/``
    speaks for no random string (a ratio of 0 at most).
    """
    pairs = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    usable = lambda df: df.where(F.length("text") > 1)
    counted = pairs(usable(random), 1).unionByName(pairs(usable(ordinary), 0)).groupBy("kind", "pair").count()
    n = len(_ALPHABET)
    counts = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for row in counted.where(F.translate("pair", _ALPHABET, "") == "").collect():
        x, y = map(_ALPHABET.index, row["pair"])
        counts[row["kind"]][x][y] += row["count"]
    ratio = lambda x, y: math.log(counts[1][x][y] / sum(counts[1][x])) - math.log(counts[0][x][y] / sum(counts[0][x]))
    plain = lambda a, b: a == b or (a in _MARKS and b in _MARKS) or a in "=/" or b in "=/"
    return [[min(ratio(x, y), 0.0) if plain(_ALPHABET[x], _ALPHABET[y]) else ratio(x, y) for y in range(n)] for x in range(n)]


_MODEL: list[list[float]] = []


def default_ratios(spark: SparkSession) -> list[list[float]]:
    """The model of the built-in samples, counted once in a driver."""
    if not _MODEL:
        _MODEL.extend(markov_ratios(random_samples(spark), identifier_samples(spark)))
    return _MODEL


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is found once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair_ratios(token: Column, ratios: list[list[float]]) -> Column:
    """``array<double>``: the log-likelihood ratio of each two characters of ``token`` that follow each other.

    The pair's place in the table is read by number, so a pair costs the same
    whatever the size of the alphabet.
    """
    n = len(_ALPHABET)
    flat = F.split(F.lit(",".join(f"{x:.5g}" for row in ratios for x in row)), ",").cast("array<double>")  # folded to a constant
    # An alphabet's place is looked up by instr; 0 (no such character) never occurs in a candidate.
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    return _bound(codes, lambda cs: F.transform(F.slice(cs, 1, F.greatest(F.length(token) - 1, F.lit(0))), lambda c, i: F.get(flat, (c - 1) * n + F.get(cs, i + 1) - 1)))


def _mean(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x) / F.size(pairs)).otherwise(0.0)


def mean_ratio(token: Column, ratios: list[list[float]]) -> Column:
    """Mean log-likelihood ratio of the character pairs of ``token``; 0 for fewer than two characters."""
    return _bound(pair_ratios(token, ratios), _mean)


_STRETCHES = "array<struct<start:int,end:int>>"


def _stretches(pairs: Column, threshold: float) -> Column:
    """The stretches of ``SHORTEST`` or more characters whose mean is over ``threshold``, each to its best end.

    One pass over the sums of what each pair is over the threshold: a stretch is
    one from the lowest sum at least ``SHORTEST`` characters back. It grows while
    the sum rises over that at its end, and the next one starts at or after it. A
    head too short for a stretch is left off where the sum is still lower after it.
    """
    least = SHORTEST - 1
    zero = F.struct(
        F.lit(0).alias("k"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("back"), F.lit(float("inf")).alias("low"), F.lit(-1).alias("at"),
        F.lit(-1).alias("start"), F.lit(0.0).alias("base"), F.lit(-1).alias("end"), F.array().cast(_STRETCHES).alias("out"),
    )
    done = lambda acc: F.when(acc["start"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), (acc["end"] + 1).alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        k = acc["k"] + 1
        now = acc["sum"] + x - threshold
        # The sum before the pair at place k - least, which starts the shortest stretch that ends here.
        back = F.when(k > least, acc["back"] + F.get(pairs, k - least - 1) - threshold).otherwise(acc["back"])
        lower = (k >= least) & (k - least >= acc["end"]) & (back < acc["low"])
        low, at = F.when(lower, back).otherwise(acc["low"]), F.when(lower, k - least).otherwise(acc["at"])
        seen = F.struct(k.alias("k"), now.alias("sum"), back.alias("back"), low.alias("low"), at.alias("at"))

        def hit(s: Column) -> Column:
            found, grows = s["sum"] > s["low"], s["at"] == acc["end"]
            first = s["k"] - least
            headless = (acc["start"] >= 0) & (first > acc["start"]) & (first < acc["start"] + least) & (first < acc["end"]) & (s["back"] < acc["base"])
            return F.struct(
                s["k"].alias("k"), s["sum"].alias("sum"), s["back"].alias("back"),
                F.when(found, s["sum"]).otherwise(s["low"]).alias("low"), F.when(found, s["k"]).otherwise(s["at"]).alias("at"),
                F.when(found & ~grows, s["at"]).when(headless, first).otherwise(acc["start"]).alias("start"),
                F.when(found & ~grows, s["low"]).when(headless, s["back"]).otherwise(acc["base"]).alias("base"), F.when(found, s["k"]).otherwise(acc["end"]).alias("end"),
                F.when(found & ~grows, done(acc)).otherwise(acc["out"]).alias("out"),
            )

        return _bound(seen, hit)

    return F.aggregate(pairs, zero, step, done)


def _pieces(token: Column, stretches: Column) -> Column:
    """What each stretch lies in, out to the next ``=`` or ``/`` on both sides; those that then meet become one."""

    def step(out: Column, s: Column) -> Column:
        inner = token.substr(s["start"] + 1, s["end"] - s["start"])
        head = token.substr(F.lit(1), s["start"] + F.length(inner) - F.length(F.regexp_replace(inner, "^[=/]+", "")))
        tail = token.substr(s["end"] + 1 - F.length(inner) + F.length(F.regexp_replace(inner, "[=/]+$", "")), F.length(token))
        wide = F.struct(F.length(F.regexp_replace(head, "[^=/]+$", "")).alias("start"), (F.length(token) - F.length(F.regexp_replace(tail, "^[^=/]+", ""))).alias("end"))
        last = F.get(out, F.size(out) - 1)

        def put(w: Column) -> Column:
            meets = (F.size(out) > 0) & (last["end"] >= w["start"])
            both = F.struct(F.least(last["start"], w["start"]).alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
            return F.when(meets, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(w)))

        return _bound(wide, put)

    return F.aggregate(stretches, F.array().cast(_STRETCHES), step)


def random_pieces(token: Column, ratios: list[list[float]], threshold: float = THRESHOLD) -> Column:
    """``array<struct<start,end>>``: all of a token that is over the threshold, otherwise the pieces with a stretch that is."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(token).alias("end")))
    return _bound(pair_ratios(token, ratios), lambda pairs: F.when(_mean(pairs) > threshold, whole).otherwise(_pieces(token, _stretches(pairs, threshold))))


def _parts(text: Column, pattern: str, kept: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{_SEP}{kept}{_SEP}"), _SEP)


def _blocks(values: Column, size: int) -> Column:
    """``values`` in arrays of ``size``: folds over a block copy no more than a block, so long lists cost in proportion."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values), F.lit(size)), lambda k: k < F.size(values))
    return F.transform(starts, lambda k: F.slice(values, k + 1, F.lit(size)))


def _running(values: Column, zero: Column, add) -> Column:
    """For each of ``values`` what ``add`` makes of all before it."""
    pair = F.struct(zero.alias("now"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, pair, lambda acc, x: F.struct(add(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))["out"]


def _spans(parts: Column, kind: str, rank: int, within) -> Column:
    """``array<struct<start,rank,end,kind>>`` of what ``within`` finds in the odd parts.

    ``within`` gives places in its match. The running start is a fold over the parts, which alternate between what lies
    outside and a match; a match may carry a second field, which doesn't count. Parts are folded in blocks, each from
    where the blocks before it end.
    """
    match = lambda p: F.element_at(F.split(p, _PART), 1)

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(match(p))
        new = F.transform(within(p), lambda s: F.struct((acc["at"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + s["end"]).alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    def of_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(match(p))))
        zero = lambda at: F.struct(at.alias("at"), F.lit(False).alias("odd"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("out"))
        return F.flatten(F.zip_with(blocks, _running(sizes, F.lit(0), lambda a, n: a + n), lambda b, at: F.aggregate(b, zero(at), step)["out"]))

    return _bound(_blocks(parts, 256), of_blocks)  # an even number, so that each block begins outside


def secret_spans(text: Column, ratios: list[list[float]], threshold: float = THRESHOLD) -> Column:
    """``array<struct<start,rank,end,kind>>`` of a text's secrets, by start and then kind; code points, end exclusive.

    Null and empty texts have none.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), _SEP + _PART, _STAND_IN * 2)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    always = lambda p: F.array(F.struct(F.lit(0).alias("start"), F.length(F.element_at(F.split(p, _PART), 1)).alias("end")))
    group = lambda p: F.filter(always(p), lambda s: F.length(F.element_at(F.split(p, _PART), 2)) >= 8)
    found = [
        F.when(clean.rlike(_ANY_ASSIGN), _spans(_parts(clean, ASSIGN, f"$0{_PART}$2"), "assign", 0, group)).otherwise(none),
        F.when(F.contains(clean, F.lit("AKIA")), _spans(_parts(clean, ACCESS, "$0"), "access", 1, always)).otherwise(none),
        F.when(clean.rlike(HEX), _spans(_parts(clean, HEX, "$0"), "hex", 2, always)).otherwise(none),
        F.when(clean.rlike(CANDIDATE), _spans(_parts(clean, CANDIDATE, "$0"), "markov", 3, lambda p: random_pieces(p, ratios, threshold))).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[list[float]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, spans``: the secrets of every whole text.

    One row for each input row; null and empty texts have no spans. Narrow: the
    only exchange is that of the samples' few pair counts.
    """
    model = ratios or default_ratios(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), secret_spans(F.col(text_col).cast("string"), model, threshold).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each stretch that spans cover replaced by one ``mark``; overlapping spans count as one.

    The text is cut where blocks of spans end, so that what is looked up and joined for a
    span is its block's stretch and not the whole text.
    """

    def of_blocks(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        before = _running(ends, F.lit(0), lambda a, e: F.greatest(a, e))

        def of_block(block: Column, at: Column) -> Column:
            to = F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))

            def fold(stretch: Column) -> Column:
                def step(acc: Column, s: Column) -> Column:
                    fresh = s["start"] >= acc["at"]
                    put = F.concat(acc["out"], stretch.substr(acc["at"] - at + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
                    return F.struct(F.when(fresh, put).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

                return F.aggregate(block, F.struct(F.lit("").alias("out"), at.alias("at")), step)["out"]

            return _bound(text.substr(at + 1, to - at), fold)

        return F.concat(F.array_join(F.zip_with(blocks, before, of_block), ""), text.substr(F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _bound(_blocks(spans, 64), of_blocks)).otherwise(text)


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of its texts replaced; all columns and rows stay, ``length_col`` follows the text.

    Null and empty texts stay as they are, repeated rows are treated alike, an empty table
    gives none; extra columns may have any name but ``_granary_spans``.
    """
    spans = secret_spans(F.col(text_col).cast("string"), default_ratios(docs.sparkSession))
    out = docs.withColumn("_granary_spans", spans).withColumn(text_col, redact(F.col(text_col), F.col("_granary_spans")))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size("_granary_spans") > 0, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
