"""License scans: ordered signature rules, and which detections survive.

A text is searched in steps, each only where the one before found something:
cheap substrings of the lower-cased text, the text as words joined by one space,
the keyword of each rule, the rule's pattern. A match becomes an interval of
words. An interval inside another of the same or a higher rank is dropped. All of
it is one expression over the row: nothing is shuffled.

Defined cases: null and empty texts have no words and no places; rows are judged
one by one, so repeated rows give equal rows; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Separators of the word contract, its phrases and their labels.
_SEPARATORS = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum())
GAP = f"[{_SEPARATORS}]++"
TOKEN = f"[^{_SEPARATORS}]++"
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# License families as (label, name as words, keyword every form has).
FAMILIES = (
    ("mit", "mit", "mit"),
    ("apache-2", "apache(?: license)?(?: version)? 2(?: 0)?", "apache"),
    ("apache-1.1", "apache(?: license)?(?: version)? 1 1", "apache"),
    ("apache", "apache", "apache"),
    ("bsd-2-clause", "(?:bsd 2 clause|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|original bsd)", "bsd"),
    ("0bsd", "(?:0bsd|bsd zero clause)", "bsd"),
    ("bsd", "bsd", "bsd"),
    ("gpl-1", "(?:gpl|gnu general public license)(?: version| v)? 1(?: 0)?", "1"),
    ("gpl-2", "(?:gpl|gnu gpl|gnu general public license)(?: version)? v?2(?: 0)?", "2"),
    ("gpl-3", "(?:gpl|gnu gpl|gnu general public license)(?: version)? v?3(?: 0)?", "3"),
    ("gpl", "(?:gpl|gnu gpl|gnu general public)", "g"),
    ("lgpl-2.1", "(?:lgpl|gnu lesser general public license)(?: version)? v?2 1", "l"),
    ("lgpl-3", "(?:lgpl|gnu lesser general public license)(?: version)? v?3(?: 0)?", "l"),
    ("lgpl", "(?:lgpl|gnu lesser general public|gnu library general public)", "l"),
    ("agpl-3", "(?:agpl|gnu affero general public license)(?: version)? v?3(?: 0)?", "a"),
    ("agpl", "(?:agpl|gnu affero general public)", "a"),
    ("mpl-1.1", "(?:mpl|mozilla public license)(?: version)? 1 1", "1 1"),
    ("mpl-2", "(?:mpl|mozilla public license)(?: version)? 2(?: 0)?", "2"),
    ("mpl", "(?:mpl|mozilla public)", "m"),
    ("epl-1", "(?:epl|eclipse public license)(?: version| v)? 1(?: 0)?", "1"),
    ("epl-2", "(?:epl|eclipse public license)(?: version| v)? 2(?: 0)?", "2"),
    ("cddl", "(?:cddl|common development and distribution)", "c"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("boost-1", "boost software", "boost"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "w"),
    ("artistic-2", "artistic(?: license)? 2(?: 0)?", "artistic"),
    ("artistic", "artistic", "artistic"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2", "(?:psf|python software foundation)", "p"),
    ("openssl", "openssl", "openssl"),
    ("eupl", "(?:eupl|european union public)", "eu"),
    ("ofl", "(?:ofl|sil open font)", "o"),
    ("ms-pl", "(?:ms pl|microsoft public)", "m"),
    ("proprietary", "proprietary", "proprietary"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", "c"),
    ("cc-by-nc-nd", "(?:cc by nc nd|attribution noncommercial noderivatives)", "n"),
    ("cc-by-nc-sa", "(?:cc by nc sa|attribution noncommercial sharealike)", "n"),
    ("cc-by-nc", "(?:cc by nc|attribution noncommercial)", "n"),
    ("cc-by-nd", "(?:cc by nd|attribution noderivatives)", "n"),
    ("cc-by-sa", "(?:cc by sa|attribution sharealike)", "s"),
    ("cc-by", "(?:cc by|creative commons attribution)", "c"),
    ("odbl", "(?:odbl|open database)", "o"),
)
# Wordings around a name as (words before, words after, keyword, rank, score).
# The lower the rank, the stronger the wording.
FORMS = (
    ("spdx license identifier ", "", "spdx license identifier", 1, 1.0),
    ("licensed under (?:the )?(?:terms of (?:the )?)?", "(?: license)?", "licensed under", 1, 0.95),
    ("released under (?:the )?(?:terms of (?:the )?)?", "(?: license)?", "released under", 1, 0.95),
    ("distributed under (?:the )?(?:terms of (?:the )?)?", "(?: license)?", "distributed under", 1, 0.95),
    ("available under (?:the )?(?:terms of (?:the )?)?", "(?: license)?", "available under", 1, 0.9),
    ("subject to (?:the )?(?:terms of (?:the )?)?", " license", "subject to", 2, 0.85),
    ("under (?:the )?", " licen[cs]e", "under", 2, 0.8),
    ("", " licen[cs]e(?: version [0-9]+(?: [0-9]+)?)?", "licen", 3, 0.6),
)
# Wordings without a family name.
OTHERS = (
    ("public-domain", "(?:dedicated to|in|into) the public domain", "public domain", 2, 0.8),
    ("copyright", "all rights reserved", "all rights reserved", 3, 0.5),
    ("copyright", "copyright(?: c)? [0-9]{4}", "copyright", 3, 0.5),
    ("no-warranty", "without warranty of any kind", "without warranty", 3, 0.3),
    ("cc", "creative commons license", "creative commons", 3, 0.5),
)
#: A text without any of these substrings meets no keyword of any rule or phrase.
STEMS = ("licen", "public domain", "rights", "copyright", "warranty", "commons", "released", "distributed", "available", "spdx", "public")


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, str]
    rank: int
    score: float


def rules() -> list[Rule]:
    """Every family in every form, then the wordings without a family, in order."""
    found = [
        Rule(label, before + name + after, (keyword, key), rank, score)
        for before, after, keyword, rank, score in FORMS
        for label, name, key in FAMILIES
    ]
    return found + [Rule(label, p, (key, key), rank, s) for label, p, key, rank, s in OTHERS]


def _literal(table: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(rf"(?<![^ ]){r.pattern}(?![^ ])").alias("pattern"),
                F.lit(r.keywords[0]).alias("k0"),
                F.lit(r.keywords[1]).alias("k1"),
                F.lit(r.rank).alias("rank"),
                F.lit(i).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(r.score).alias("score"),
            )
            for i, r in enumerate(table)
        ]
    )


def _places(norm: Column, pattern: Column) -> Column:
    """``array<struct<start, end>>`` in words of all matches of one pattern.

    Marks are put around the matches; a mark cannot occur in the words, so the
    marked words tell the places in one pass over the text.
    """

    def spans(words: Column) -> Column:
        starts = F.filter(
            F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull()
        )
        ends = F.filter(
            F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit("\x02")), i)), lambda i: i.isNotNull()
        )
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return let(F.split(F.regexp_replace(norm, pattern, F.lit("\x01$0\x02")), " "), spans)


def _running_max(values: Column) -> Column:
    """Largest value before each entry (-1 for none): doubling steps, linear each."""
    shifted = F.transform(values, lambda _, i: F.coalesce(F.get(values, i - 1), F.lit(-1)))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))
    return F.aggregate(
        steps,
        shifted,
        lambda acc, r: F.transform(
            acc, lambda x, i: F.greatest(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), r).cast("int")), F.lit(-1)))
        ),
    )


def survivors(found: Column) -> Column:
    """Detections that no earlier one of the same or a higher rank contains."""

    def kept(ordered: Column) -> Column:
        def inside(rank: int) -> Column:
            return let(
                F.transform(ordered, lambda d: F.when(d["rank"] <= rank, d["end"]).otherwise(F.lit(-1))),
                _running_max,
            )

        return let(
            F.struct(*[inside(r).alias(f"m{r}") for r in (1, 2, 3)]),
            lambda m: F.filter(
                F.transform(
                    ordered,
                    lambda d, i: F.when(
                        F.when(d["rank"] == 1, F.get(m["m1"], i))
                        .when(d["rank"] == 2, F.get(m["m2"], i))
                        .otherwise(F.get(m["m3"], i))
                        < d["end"],
                        d,
                    ),
                ),
                lambda d: d.isNotNull(),
            ),
        )

    return let(F.sort_array(found), kept)


def detections(norm: Column, table: list[Rule] | None = None) -> Column:
    """Surviving detections of a normalized text, in order of their places."""
    gated = F.filter(
        _literal(table or rules()), lambda r: F.contains(norm, r["k0"]) & F.contains(norm, r["k1"])
    )
    found = F.flatten(
        F.transform(
            gated,
            lambda r: F.transform(
                _places(norm, r["pattern"]),
                lambda p: F.struct(
                    p["start"].alias("start"),
                    (-p["end"]).alias("longest"),
                    r["rank"].alias("rank"),
                    r["rule"].alias("rule"),
                    p["end"].alias("end"),
                    r["label"].alias("label"),
                    r["score"].alias("score"),
                ),
            ),
        )
    )
    return let(found, lambda f: F.when(F.size(f) > 0, survivors(f)))


def normalized(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text, joined by one space."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, GAP, " "))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words`` and ``found``: base places and surviving detections."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    of = let(F.lower(plain), lambda low: F.when(_any(low), let(normalized(plain), _report)))
    words = F.size(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)))
    return docs.select("doc_id", words.cast("long").alias("n_words"), of.alias("found"))


def _any(low: Column) -> Column:
    hinted = F.contains(low, F.lit("nc")) & F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by"))
    for stem in STEMS:
        hinted = hinted | F.contains(low, F.lit(stem))
    return hinted


def _report(norm: Column) -> Column:
    def base(phrase: str, label: str) -> Column:
        hits = F.when(
            F.contains(norm, F.lit(phrase)), _places(norm, F.lit(rf"(?<![^ ]){phrase}(?![^ ])"))
        ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(hits, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(label).alias("label")))

    return F.struct(
        F.concat(*[base(p, label) for p, label in PHRASES]).alias("base"),
        F.coalesce(
            detections(norm),
            F.array().cast("array<struct<start:int,longest:int,rank:int,rule:int,end:int,label:string,score:double>>"),
        ).alias("rules"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: counts, places, labels and score."""
    base, more = F.col("found.base"), F.col("found.rules")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform(base, lambda d: d["label"]), none)
    labels = F.concat(base_labels, F.coalesce(F.transform(more, lambda d: d["label"]), none))
    strongest = F.coalesce(F.array_max(F.transform(more, lambda d: d["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.coalesce(F.size(base), F.lit(0)) > 0, F.lit(1.0)).otherwise(strongest).alias("score"),
    )
