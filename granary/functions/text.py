"""Column builders for text: cleaning, counting, labels and keys. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode; Java's ``\\s`` is ASCII only.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_BOILERPLATE = r"(?i)^(?:abstract|introduction|references|bibliography)$"
# Headings of reference lists.
_REFERENCE = r"(?iu)^(?:\d+(?:\.\d+)*\.?\s*)?(?:references|bibliography|works cited|literature cited|bibliograf[ií]a|r[ée]f[ée]rences(?: bibliographiques)?|литература|література|список літератури|список литературы|список використаних джерел)(?=$|[\s(:])"
# Headings that need no capitals.
_NAMED = r"(?i)^(?:abstract|introduction|conclusions?|methods?|results?|discussion)$"
_LETTER_SPACED = r"(?:^|\s)(?:\p{L}\s){3,}\p{L}(?:\s|$)"
_SENTENCE = r"(?<=[.!?])" + WS + r"+(?=[\p{Lu}\p{N}\"“(])"
_MARKER = r"^(?:\(?[\dA-Za-z]{1,3}[.)]|[•▪◦\-–])$"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(_WS_CHARS))


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"{WS}+", " "))


def clean_text(text: Column) -> Column:
    """NUL and inline LaTeX as a space, words joined over a hyphenated line end, white space squeezed."""
    out = F.replace(text, F.lit("\0"), F.lit(" "))
    out = F.regexp_replace(out, r"(?is)<latexit\b.*?</latexit>", " ")
    return squeeze(F.regexp_replace(out, r"-(?<=\w-)\r?\n(?=\w)", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def letter_ratio(text: Column) -> Column:
    """Letters by characters; null for an empty text."""
    return F.try_divide(F.regexp_count(text, F.lit(r"\p{L}")), F.length(text))


def heading_like(text: Column) -> Column:
    return (word_count(text) <= 12) & (letter_ratio(text) >= 0.6) & text.rlike(r"\p{L}{3,}") & ~F.contains(text, F.lit("_"))


def section_label(section: Column) -> Column:
    """A section's name where it reads like a heading, else null."""
    return F.when((section != "") & heading_like(section), section)


def dedup_form(text: Column) -> Column:
    """Lower-case letters and numbers, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    return F.split(text, _SENTENCE)


def row_cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\t+| {3,}"), clean_text), lambda c: c != "")


def edge_key(line: Column) -> Column:
    """What running headers and footers have in common: numbers and white space don't count."""
    return F.regexp_replace(F.regexp_replace(F.lower(clean_text(line)), r"\d[\d\s]*", "#"), f"{WS}+", "")


def is_caption(line: Column) -> Column:
    return line.rlike(r"(?i)^(?:fig(?:ure)?|table)\s*\d+(?:[.:\s-]|$)")


def is_reference_heading(line: Column) -> Column:
    return line.rlike(_REFERENCE)


def is_heading(line: Column) -> Column:
    """Numbered, named or all-capital lines; debris, letter-spaced and joined words are none."""
    sound = line.rlike(r"\p{L}{3,}") & (letter_ratio(line) >= 0.6) & ~line.rlike(_LETTER_SPACED) & ~line.rlike(r"\p{L}{20,}") & ~F.contains(line, F.lit("_"))
    numbered = line.rlike(r"^\d+(?:\.\d+)*\.?\s+\p{Lu}[^.!?]{2,100}$") & (F.regexp_count(line, F.lit(r"\p{L}{2,}")) <= 10) & ~line.rlike(r"[,;]$")
    capitals = F.length(line).between(4, 100) & (line == F.upper(line)) & line.rlike(r"\p{Lu}") & ~line.rlike(r"[.!?]$")
    # Few lines have the form, which costs little to see; only those are looked at as a whole.
    return (is_reference_heading(line) | F.when(line.rlike(r"^\d+(?:\.\d+)*\.?\s+"), numbered).otherwise(line.rlike(_NAMED) | capitals)) & sound


def is_boilerplate_heading(text: Column) -> Column:
    return text.rlike(_BOILERPLATE)


def joined_lines(lines: Column) -> Column:
    """A paragraph of its lines: a word hyphenated over a line end is one again."""
    # Only the end of what is joined so far is looked at.
    rejoin = lambda text, line: F.when(F.substring(text, -6, 6).rlike(r"\p{Ll}\s?-$") & line.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(text, r"\s?-$", ""), line)).otherwise(F.concat(text, F.lit(" "), line))
    return clean_text(F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.get(lines, F.lit(0)), rejoin))


def prose_of_table(text: Column) -> Column:
    """A table that is really prose (list markers, or sentences in at most two cells) as one line, else null."""

    def of(rows: Column, cells: Column) -> Column:
        marked = F.size(F.filter(rows, lambda r: (F.size(r) == 2) & trim(F.get(r, F.lit(0))).rlike(_MARKER)))
        long_cells = F.size(F.filter(cells, lambda c: word_count(c) >= 5))
        prose = (marked * 2 >= F.size(rows)) | (F.forall(rows, lambda r: F.size(r) <= 2) & (long_cells * 2 >= F.size(cells)))
        return F.when(prose, F.array_join(cells, " "))

    return let(F.transform(F.split(text, "\n"), lambda r: F.split(r, r" \| ")), lambda rows: let(F.flatten(rows), lambda cells: of(rows, cells)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shared_tokens(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; null for two empty ones."""
    both = F.size(F.array_intersect(left, right))
    return F.try_divide(both, F.size(F.array_distinct(left)) + F.size(F.array_distinct(right)) - both)


def evidence_form(text: Column) -> Column:
    return F.lower(squeeze(text))


def topic_of_source(source: Column) -> Column:
    return F.regexp_replace(source, r"\.[^.]+$", "")


def context_label(source: Column, page: Column, content_type: Column, row_start: Column, row_end: Column) -> Column:
    """Where a passage comes from, as the context for a model names it."""
    safe = F.replace(F.replace(source, F.lit("]"), F.lit("")), F.lit("\n"), F.lit(" "))
    first = F.coalesce(row_start, F.lit(1))
    last = F.coalesce(row_end, first)
    rows = F.when(first == last, F.concat(F.lit("Row "), first.cast("string"))).otherwise(F.concat(F.lit("Row "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.when(content_type.eqNullSafe("csv"), F.concat(rows, F.lit(" | Source: "), safe)).otherwise(F.concat(F.lit("[Page "), page.cast("string"), F.lit("] [Source: "), safe, F.lit("]")))


def category_query(dimension: Column, dimension_definition: Column, category: Column, definition: Column, include: Column, exclude: Column, question: Column) -> Column:
    listed = lambda name, values: F.when(F.size(F.coalesce(values, F.array())) > 0, F.concat(F.lit(f"\n{name}: "), F.array_join(values, "; "), F.lit("."))).otherwise("")
    return F.concat(F.lit("Dimension: "), dimension, F.lit(". "), dimension_definition, F.lit("\nCategory: "), category, F.lit(". "), definition, listed("Include", include), listed("Exclude", exclude), F.lit("\nQuestion: "), question)


def format_bytes(size: Column) -> Column:
    tenth = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(tenth(size / 1024), F.lit(" KB"))).otherwise(F.concat(tenth(size / (1024 * 1024)), F.lit(" MB")))


def question_error(question: Column) -> Column:
    """What is wrong with a question, or null."""
    return F.when(trim(F.coalesce(question, F.lit(""))) == "", F.lit("Enter a question about the selected documents.")).when(F.length(question) > 2000, F.lit("Question must be 2,000 characters or fewer."))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
