"""Chunkers for structured text: markdown tables and Python source."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T


def with_table_chunks(frame: DataFrame, text: str, out: str, rows_per_chunk: int = 4) -> DataFrame:
    """Add ``out``: groups of table rows, each under the repeated header.

    Offsets span the body rows. A row's offset is its own place in the text,
    also when an equal row comes earlier. Text that is no table fails.
    """
    if rows_per_chunk < 1:
        raise ValueError(f"rows_per_chunk must be at least 1, got {rows_per_chunk}")
    whole = F.col(text)
    table = F.coalesce(
        T.markdown_table(whole), F.raise_error(F.lit("this does not look like a markdown table"))
    )
    # Lines with their offsets; blank lines carry no row.
    begin = F.length(whole) - F.length(T.lstrip(whole))

    def placed(given, begin):
        def entries(ends):
            every = F.zip_with(
                given, ends,
                lambda line, end: F.struct(
                    (begin + end - 1 - F.length(line)).cast("int").alias("start"),
                    (begin + end - 1).cast("int").alias("end"),
                    line.alias("line"),
                ),
            )
            return F.filter(every, lambda entry: T.strip(entry["line"]) != "")

        return A.let(A.running_sums(F.transform(given, lambda line: F.length(line) + 1)), entries)

    split = F.struct(F.split(T.strip(whole), "\n").alias("lines"), begin.alias("begin"))
    lines = A.let(split, lambda s: placed(s["lines"], s["begin"]))
    parts = F.struct(table.alias("table"), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))).alias("rows"))

    def chunks(part):
        rows = part["rows"]
        groups = F.sequence(F.lit(0), F.ceil(F.size(rows) / F.lit(rows_per_chunk)).cast("int") - 1)

        def chunk(group):
            members = F.slice(rows, group * rows_per_chunk + 1, F.lit(rows_per_chunk))
            body = F.array_join(F.transform(members, lambda row: row["line"]), "\n")
            return F.struct(
                F.concat_ws("\n", part["table"]["header"], part["table"]["alignment"], body).alias("text"),
                F.get(members, F.lit(0))["start"].alias("start"),
                F.element_at(members, -1)["end"].alias("end"),
                group.alias("chunk_index"),
            )

        return F.transform(groups, chunk)

    return frame.withColumn(out, F.get(F.transform(F.array(parts), chunks), F.lit(0)))


def _parses(source: str) -> bool:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def parses_as_python(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(_parses, na_action="ignore")

    return apply(text)


def _top_level(source: str) -> list[dict]:
    """Spans of top-level statements, each reaching to the start of the next."""
    text = unicodedata.normalize("NFC", source)
    try:
        body = ast.parse(text).body
    except SyntaxError as error:
        raise ValueError(f"source does not parse, so it cannot be split: {error}") from error
    ends = [0]
    for line in text.splitlines(keepends=True):
        ends.append(ends[-1] + len(line))
    heads = [
        min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
        for node in body
    ]
    cuts = [ends[head] for head in heads] + [len(text)]
    spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]
    return [
        {"text": text[a:b], "start": a, "end": b, "chunk_index": i}
        for i, (a, b) in enumerate(spans)
    ]


def python_chunks(source: Column) -> Column:
    """One chunk per top-level statement; source that does not parse fails."""

    @F.pandas_udf("array<struct<text:string,start:int,end:int,chunk_index:int>>")
    def apply(sources: pd.Series) -> pd.Series:
        return sources.map(_top_level, na_action="ignore")

    return apply(source)
