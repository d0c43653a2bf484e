"""Scalar text functions as Column expressions (all evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# Characters Python's str.strip and \s treat as whitespace, as a regex class
# body that Java and RE2 both read, and as a plain set for trim().
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
SENTENCE_END = rf"(?:[.!?。！？]+(?:[{SPACE_CLASS}]+|\z)|\n{{2,}})"
# One piece of text up to and including its sentence end, for Java: possessive,
# so that every character is read once. Latin characters come first and singly,
# which Java looks up in a bit table instead of testing range after range.
_LATIN = "".join(f"\\x{{{code:x}}}" for code in range(256) if chr(code) not in ".!?\n")
SENTENCE_PIECE = (
    rf"(?:[{_LATIN}]++|[^.!?。！？\n]++|[.!?。！？]++(?![{SPACE_CLASS}]|\z)|\n(?!\n))*+"
    rf"(?:[.!?。！？]++[{SPACE_CLASS}]*+|\n{{2,}}+|\z)"
)
TOKEN = "[0-9a-z가-힣:,.]+"
FACT = (
    r"(?i)\b(?:\d[\d,]*(?:\.\d+)?\s*(?:won|days?|hours?|months?|years?|characters?)"
    r"|\d{1,2}:\d{2}"
    r"|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September"
    r"|October|November|December)"
    r"|(?:three|four|five|six|seven|eight|nine|ten|sixteen|sixty|ninety)\s+"
    r"(?:days?|hours?|months?|years?|characters?))\b"
)
ABSTENTION = "not stated"
PROMPT_HEAD = (
    "Answer the question using only the context. If the context does not "
    "contain the answer, say \"not stated\".\nContext: "
)
# --------------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, Hangul and number punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def saturation(frequency: Column, k1: float = 1.5) -> Column:
    return frequency * (k1 + 1) / (frequency + k1)


def idf(total: Column, frequency: Column) -> Column:
    """Smoothed inverse document frequency; never negative."""
    return F.log1p((total - frequency + 0.5) / (frequency + 0.5))


def facts(sentence: Column) -> Column:
    """Every amount, time, date or spelled-out quantity in a sentence."""
    return F.regexp_extract_all(sentence, F.lit("(?U)" + FACT), F.lit(0))


def normalize_answer(text: Column) -> Column:
    """Lower-case, drop articles and punctuation, keep punctuation inside tokens."""
    lowered = strip(F.lower(text))
    word = r"[\p{L}\p{N}_]"
    no_articles = F.regexp_replace(lowered, rf"(?<!{word})(?:a|an|the)(?!{word})", " ")
    plain = F.regexp_replace(no_articles, rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}:,./-]", " ")
    words = F.split(plain, f"[{SPACE_CLASS}]+")
    trimmed = F.transform(words, lambda word: F.trim(word, F.lit(".,/-")))
    return F.array_join(F.filter(trimmed, lambda word: word != ""), " ")


def answer_is_correct(generated: Column, expected: Column) -> Column:
    return F.contains(normalize_answer(generated), normalize_answer(expected))


def abstained(generated: Column) -> Column:
    return F.contains(F.lower(generated), F.lit(ABSTENTION))


def terse_but_right(generated: Column, expected: Column) -> Column:
    """The expected fact, stated more briefly than expected."""
    short, full = normalize_answer(generated), normalize_answer(expected)
    return ~F.contains(short, full) & F.contains(full, short) & (short != "")


def line_number(text: Column, offset: Column) -> Column:
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_number(text: Column, offset: Column) -> Column:
    before = F.substring(text, F.lit(1), offset)
    return F.length(F.substring_index(before, "\n", -1)) + 1


def line_column(text: Column, offset: Column) -> Column:
    """1-based line and column of a code-point offset; other offsets fail."""
    inside = (offset >= 0) & (offset <= F.length(text))
    place = F.struct(
        line_number(text, offset).cast("int").alias("line"),
        column_number(text, offset).cast("int").alias("column"),
    )
    message = F.concat(F.lit("offset outside the text: "), offset.cast("string"))
    return F.when(inside, place).otherwise(F.raise_error(message))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD), context, F.lit("\nQuestion: "), question, F.lit("\nAnswer:")
    )


def markdown_table(text: Column) -> Column:
    """``struct(header, alignment, rows)`` of a markdown table, else NULL."""
    lines = F.filter(F.split(strip(text), "\n"), lambda line: strip(line) != "")
    header, alignment = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    is_table = (
        (F.size(lines) >= 3)
        & F.startswith(lstrip(header), F.lit("|"))
        & strip(alignment).rlike(rf"^\|([{SPACE_CLASS}]*:?-{{2,}}:?[{SPACE_CLASS}]*\|)+\z")
    )
    table = F.struct(
        header.alias("header"),
        alignment.alias("alignment"),
        F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))).alias("rows"),
    )
    return F.when(is_table, table)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Rescale to [0, 1]; a list without spread maps to 1."""
    return F.when(high - low < 1e-12, F.lit(1.0)).otherwise((score - low) / (high - low))
