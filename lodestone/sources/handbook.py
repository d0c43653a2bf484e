"""The small policy handbook and its question sets, as DataFrames.

Used by tests and the command line; registered queries read the given tables.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "doc_id string, doc_order bigint, text string, title string, uri string, "
    "metadata map<string,string>"
)

# Handbook texts, questions and probes -----------------------
HANDBOOK = {
    "vacation": """\
Annual leave accrues at 1.75 days per month of continuous service.
Unused leave may be carried into the next calendar year, up to a maximum of ten days.
Any balance above ten days is forfeited on 31 December and is not paid out.
Requests for more than five consecutive days require approval from a second-line manager.
Leave taken during the first three months of employment is unpaid.""",
    "expenses": """\
Expense claims must be submitted within sixty days of the expenditure.
Claims submitted after sixty days are rejected automatically and cannot be appealed.
Meals are reimbursed up to 35,000 won per day when travelling domestically.
International travel is reimbursed at 90,000 won per day for meals and incidentals.
A receipt is required for any single item above 20,000 won.
Taxi fares are reimbursed only between 22:00 and 06:00, or when carrying equipment.""",
    "equipment": """\
Every engineer is issued a laptop on their first day.
Laptops are replaced on a three year cycle, or earlier if a fault cannot be repaired.
A second monitor may be requested after the probation period ends.
Personal equipment may not be connected to the production network under any circumstances.
Lost or stolen equipment must be reported to security within twenty four hours.""",
    "remote": """\
Remote work is permitted for up to three days per week.
Employees working remotely must be reachable during core hours, which are 10:00 to 16:00.
Working from outside the country requires written approval and a tax review.
The company contributes 300,000 won per year towards a home office setup.
Core hours do not apply on public holidays.""",
    "security": """\
Passwords must be at least sixteen characters and are rotated every ninety days.
Two factor authentication is mandatory for all systems that hold customer data.
Production access is granted for a maximum of eight hours at a time.
Any suspected breach must be reported to the security team immediately and in writing.
Personal cloud storage may not be used for company documents.""",
}
# (original question, paraphrased question, answer, document)
QUESTIONS = (
    ("how many vacation days accrue each month", "what is the monthly holiday entitlement",
     "1.75 days per month", "vacation"),
    ("what happens to unused leave above ten days", "do I lose untaken time off at year end",
     "forfeited on 31 December", "vacation"),
    ("who approves more than five consecutive days of leave", "who signs off a long absence",
     "a second-line manager", "vacation"),
    ("how long do I have to submit an expense claim",
     "what is the deadline for filing a reimbursement", "within sixty days", "expenses"),
    ("what is the domestic meal allowance", "how much can I spend on food at home",
     "35,000 won per day", "expenses"),
    ("what is the international meal allowance", "how much can I spend on food abroad",
     "90,000 won per day", "expenses"),
    ("when is a receipt required", "when do I need proof of purchase",
     "above 20,000 won", "expenses"),
    ("when are taxi fares reimbursed", "can I expense a cab ride",
     "between 22:00 and 06:00", "expenses"),
    ("how often are laptops replaced", "how old can my computer get before renewal",
     "three year cycle", "equipment"),
    ("when can I request a second monitor", "when am I eligible for an extra screen",
     "after the probation period ends", "equipment"),
    ("how quickly must stolen equipment be reported", "what do I do if my hardware is taken",
     "within twenty four hours", "equipment"),
    ("how many days a week can I work remotely", "how often may I stay home",
     "three days per week", "remote"),
    ("what are the core hours", "when am I expected to be online",
     "10:00 to 16:00", "remote"),
    ("what is the home office budget", "is there money for a desk at home",
     "300,000 won per year", "remote"),
    ("how long must a password be", "what length must my credentials be",
     "at least sixteen characters", "security"),
    ("how often are passwords rotated", "how frequently must credentials change",
     "every ninety days", "security"),
    ("how long does production access last", "how long does elevated access stay open",
     "eight hours at a time", "security"),
)
CONTRADICTIONS = (
    ("what are the core hours",
     "Employees must be reachable during core hours, which are 03:00 to 04:00.",
     "03:00 to 04:00"),
    ("what is the domestic meal allowance",
     "Meals are reimbursed up to 99,000 won per day when travelling domestically.",
     "99,000 won"),
    ("how often are laptops replaced",
     "Laptops are replaced on a eleven year cycle.", "eleven year"),
    ("how long must a password be",
     "Passwords must be at least three characters and are rotated every ninety days.",
     "three characters"),
)
UNANSWERABLE = (
    "how many sick days am I entitled to",
    "what is the parental leave policy",
    "how often are salaries reviewed",
    "how much is the annual bonus",
    "what is the notice period for resignation",
    "who approves a transfer to another team",
)
YES_NO_MISMATCH = (
    "do I lose untaken time off at year end",
    "can I expense a cab ride",
    "is there money for a desk at home",
)
EXPENSE_TABLE = """\
| item | limit | receipt required |
| --- | --- | --- |
| meals domestic | 35,000 | no |
| meals international | 90,000 | no |
| taxi late night | actual | yes |
| taxi daytime | not reimbursed | n/a |
| accommodation | 150,000 | yes |
| equipment | 500,000 | yes |
| software licence | 200,000 | yes |
| conference fee | 800,000 | yes |
| client entertainment | 100,000 | yes |
| home office | 300,000 | yes |
| training course | 1,000,000 | yes |
| mobile data | 50,000 | no |
"""
SAMPLE = (
    "Retrieval-augmented generation retrieves passages and then generates an answer. "
    "The retriever is the part that usually fails. A chunk that splits a fact in half "
    "cannot be retrieved by any query, because neither half contains the fact. "
    "Overlap repeats the end of one chunk at the start of the next. "
    "It costs index size in direct proportion to the overlap fraction. "
    "검색 증강 생성은 문서를 먼저 찾고 그 다음에 답을 만든다. "
    "청킹 전략은 검색 품질의 상한을 결정한다."
)
BOUNDARY_FACT = "the part that usually fails"
PARALLEL_EN = """\
Annual leave accrues at 1.75 days per month of continuous service.
Unused leave may be carried into the next calendar year.
Any balance above ten days is forfeited on 31 December.
Expense claims must be submitted within sixty days.
Meals are reimbursed up to 35,000 won per day when travelling.
"""
PARALLEL_KO = """\
연차 휴가는 근속 개월당 1.75일씩 적립된다.
사용하지 않은 휴가는 다음 해로 이월할 수 있다.
10일을 초과하는 잔여 휴가는 12월 31일에 소멸된다.
경비 청구는 지출일로부터 60일 이내에 제출해야 한다.
출장 중 식비는 1일 35,000원까지 정산된다.
"""
ABBREVIATION_PROSE = (
    "See Fig. 3 for the accrual curve. Leave accrues at 1.75 days per month. "
    "Contact the finance dept. before submitting. Approx. 60 days is the limit."
)
PADDING_DEMO = (
    "Core hours are 10:00 to 16:00.",
    "Core hours matter. Employees ask about core hours often. The core "
    "hours policy is discussed in the core hours section of the core "
    "hours appendix, which covers core hours in detail.",
)
POLICY_CODE = '''\
"""Leave accrual rules."""

ACCRUAL_PER_MONTH = 1.75
CARRY_OVER_CAP = 10


def accrue(months: float) -> float:
    """Days of leave earned after a number of months of service."""
    if months < 3:
        return 0.0
    return round(months * ACCRUAL_PER_MONTH, 2)


class LeaveAccount:
    """A running balance, capped at the carry-over limit each year."""

    def __init__(self, balance: float = 0.0) -> None:
        self.balance = balance

    def accrue_month(self) -> None:
        self.balance += ACCRUAL_PER_MONTH

    def carry_over(self) -> float:
        kept = min(self.balance, CARRY_OVER_CAP)
        self.balance = kept
        return kept
'''
MULTILINGUAL = (
    ("handbook-en", "Retrieval Handbook", "docs/handbook.md", "en", "retrieval",
     "Chunking decides what can be retrieved.\n"
     "A citation must point at the source document.\n"
     "Offsets into a cleaned copy point at nothing.\n"),
    ("handbook-ko", "검색 핸드북", "docs/handbook.ko.md", "ko", "retrieval",
     "청킹은 검색 가능한 단위를 결정한다.\n"
     "인용은 원본 문서를 가리켜야 한다.\n"
     "정규화된 사본의 오프셋은 아무것도 가리키지 않는다.\n"),
    ("notes-fr", "Notes", "docs/notes.txt", "fr", "notes",
     "Le café est naïve au sujet des offsets.\nRéférence: page 3.\n"),
)
SIZES = (40, 80, 120, 160, 240, 320, 480)
OVERLONG_HEAD = "The core hours are 10:00 to 16:00. "
OVERLONG_TAIL = " The emergency contact code is ZEBRA."
# --------------------------------------------------------------------------


def documents(spark: SparkSession) -> DataFrame:
    rows = [
        (name, place, text, name.title(), f"handbook/{name}.md", {"section": name})
        for place, (name, text) in enumerate(HANDBOOK.items())
    ]
    return spark.createDataFrame(rows, DOCUMENT)


def multilingual_documents(spark: SparkSession) -> DataFrame:
    """One ASCII text and two stored decomposed, as some file systems hand them out."""
    rows = [
        (key, place, unicodedata.normalize("NFD", text), title, uri, {"lang": lang, "section": section})
        for place, (key, title, uri, lang, section, text) in enumerate(MULTILINGUAL)
    ]
    return spark.createDataFrame(rows, DOCUMENT)


def text_documents(spark: SparkSession, *texts: str) -> DataFrame:
    """One-off documents, numbered ``d0``, ``d1``, ..."""
    rows = [(f"d{i}", i, text, "", "", {}) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT)


def text_chunks(spark: SparkSession, *texts: str) -> DataFrame:
    """One-off chunks that are whole texts."""
    rows = [("d", i, ("", [0], i), text, 0, len(text), {}) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "doc_id string, chunk_index int, "
        "position struct<source:string,doc_order:array<bigint>,chunk_index:int>, "
        "text string, start int, `end` int, "
        "metadata map<string,string>",
    )


def questions(spark: SparkSession, *sets: str) -> DataFrame:
    """``(query_id, question_set, query, answer, doc_id)`` of ``original`` and/or
    ``paraphrased`` questions."""
    rows = []
    for name in sets or ("original",):
        column = {"original": 0, "paraphrased": 1}[name]
        for row in QUESTIONS:
            rows.append((len(rows), name, row[column], row[2], row[3]))
    return spark.createDataFrame(
        rows, "query_id bigint, question_set string, query string, answer string, doc_id string"
    )


def contradictions(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CONTRADICTIONS)]
    return spark.createDataFrame(
        rows, "query_id bigint, query string, false_sentence string, false_answer string"
    )


def unanswerable(spark: SparkSession, first_id: int = 1000) -> DataFrame:
    rows = [(first_id + i, query) for i, query in enumerate(UNANSWERABLE)]
    return spark.createDataFrame(rows, "query_id bigint, query string")


def overlong_text(pad_words: int = 400):
    """A text longer than an embedder's limit, as a Column."""
    return F.concat(
        F.repeat(F.lit(OVERLONG_HEAD), 2), F.repeat(F.lit("padding "), pad_words), F.lit(OVERLONG_TAIL)
    )
