import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as C
from lodestone.operators import citations, structured
from lodestone.sources import handbook as H


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Meals: up to 35,000 won"))) == [
        "meals:", "up", "to", "35,000", "won",
    ]


def test_saturation_and_idf(spark):
    assert round(one(spark, T.saturation(F.lit(100))), 3) == 2.463
    values = [round(one(spark, T.idf(F.lit(4), F.lit(df))), 3) for df in (4, 3, 1)]
    assert values == [0.105, 0.357, 1.204]


def test_normalize_answer(spark):
    cases = {
        "The 10:00 to 16:00.": "10:00 to 16:00",
        "  An apple, (a day)! ": "apple day",
        "1.75 days - per/month": "1.75 days per/month",
        "Theory of the café": "theory of café",
    }
    for raw, expected in cases.items():
        assert one(spark, T.normalize_answer(F.lit(raw))) == expected


def test_answer_checks(spark):
    assert one(spark, T.answer_is_correct(F.lit("core hours: 10:00 to 16:00."), F.lit("10:00 to 16:00")))
    assert one(spark, T.abstained(F.lit("Not Stated.")))
    assert one(spark, T.terse_but_right(F.lit("1.75"), F.lit("1.75 days per month")))
    assert not one(spark, T.terse_but_right(F.lit("."), F.lit("1.75 days per month")))


def test_facts(spark):
    assert one(spark, T.facts(F.lit("Meals are reimbursed up to 35,000 won per day."))) == ["35,000 won"]
    assert one(spark, T.facts(F.lit("from 22:00 on 31 december, Three Days"))) == [
        "22:00", "31 december", "Three Days",
    ]


def test_markdown_tables(spark):
    docs = H.text_documents(spark, H.EXPENSE_TABLE)
    table = docs.select(T.markdown_table(F.col("text")).alias("t")).first()["t"]
    assert len(table["rows"]) == 12
    for bad in ("plain", "| a |\n| - |\n| 1 |", "| a |\n| -- |", "a\n| -- |\n| 1 |"):
        assert one(spark, T.markdown_table(F.lit(bad))) is None
    header = table["header"]
    seen = []
    for rows in (2, 4, 6):
        frame = structured.with_table_chunks(docs, "text", "c", rows)
        chunks = frame.select("c").first()["c"]
        body = [line for c in chunks for line in c["text"].split("\n")[2:]]
        assert body == table["rows"]
        assert all(
            H.EXPENSE_TABLE[c["start"] : c["end"]] == "\n".join(c["text"].split("\n")[2:]) for c in chunks
        )
        row = frame.select(
            C.header_retention(F.col("c"), F.lit(header)),
            F.round(C.index_growth(F.length("text"), F.col("c")), 2),
        ).first()
        seen.append(tuple(row))
    assert seen == [(1.0, 1.57), (1.0, 1.23), (1.0, 1.11)]
    fixed = C.with_fixed_chunks(docs, "text", "c", 120)
    assert fixed.select(C.header_retention(F.col("c"), F.lit(header))).first()[0] == 0.25


def test_duplicate_table_rows_keep_their_own_offsets(spark):
    text = "\n| a |\n| -- |\n| 1 |\n\n| 1 |\n"
    docs = H.text_documents(spark, text)
    chunks = structured.with_table_chunks(docs, "text", "c", 1).select("c").first()["c"]
    assert [c["start"] for c in chunks] == [text.index("| 1 |"), text.rindex("| 1 |")]


def test_python_chunks(spark):
    docs = H.text_documents(spark, H.POLICY_CODE, "# lost\n@a\n@b\ndef f():\n    pass\nx = 1\n")
    frame = docs.select("doc_id", structured.python_chunks(F.col("text")).alias("c"))
    rows = {r["doc_id"]: r["c"] for r in frame.collect()}
    assert "".join(c["text"] for c in rows["d0"]) == H.POLICY_CODE
    assert [c["text"] for c in rows["d1"]] == ["@a\n@b\ndef f():\n    pass\n", "x = 1\n"]
    assert one(spark, structured.parses_as_python(F.lit("x = 1")))
    assert not one(spark, structured.parses_as_python(F.lit("    return x")))
    with pytest.raises(Exception, match="does not parse"):
        H.text_documents(spark, "def").select(structured.python_chunks(F.col("text"))).collect()


@pytest.mark.parametrize("strategy,size", [("fixed", 7), ("fixed", 40), ("sentence", 30)])
def test_citations_verify_on_decomposed_text(spark, strategy, size):
    docs = H.multilingual_documents(spark)
    chunks = C.chunk_documents(docs, size, strategy=strategy)
    assert citations.verify(chunks, docs).where("NOT verified").count() == 0


def test_unmapped_offsets_fail_only_on_decomposed_text(spark):
    docs = H.multilingual_documents(spark)
    checked = citations.verify(C.chunk_documents(docs, 20, mapped=False), docs)
    bad = {r["doc_id"] for r in checked.where("NOT verified").select("doc_id").collect()}
    assert bad == {"handbook-ko", "notes-fr"}


def test_quotes(spark):
    docs = H.documents(spark)
    chunks = C.build_index(docs, 80)
    for row in citations.cite(chunks, docs).collect():
        text, cited = H.HANDBOOK[row["doc_id"]], row["citation"]
        before = text[: row["start"]]
        assert cited["line"] == before.count("\n") + 1
        assert cited["column"] == len(before) - (before.rfind("\n") + 1) + 1
        span = text[row["start"] : row["end"]]
        assert cited["quote"] == (span if len(span) <= 60 else span[:60].rstrip() + "...")
        assert cited["uri"] == f"handbook/{row['doc_id']}.md"
