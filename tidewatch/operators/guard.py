"""Wording a reply claims to have copied, checked against the page it was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import ARABIC, fold_title, let, normalise_arabic, strip

# One class, so that a text is cut in one pass.
TITLE_SEPARATORS = f"[{L.WS[1:-1]}،,.:;()\\[\\]\"'«»\\-–—/|]+"

#: Title words searched for one by one.
_FEW_WORDS = 12


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def invented_wording(
    page: Column,
    title: Column,
    quote: Column,
    opens_raw: Column,
    closes_raw: Column,
    majors: Column,
    cities: Column,
    states_rule: Column,
) -> Column:
    """Claims the page does not carry, as ``array<string>``; empty means faithful.

    A title is checked word by word, everything else as a phrase.  A rule that is
    asserted must come with the words that state it.
    """

    def check(hay: Column) -> Column:
        def phrase(label: Column, value: Column) -> Column:
            trimmed = strip(value)
            absent = (trimmed != "") & ~F.contains(hay, normalise_arabic(trimmed))
            return F.when(
                absent, F.concat(label, F.lit("="), _quoted(F.substring(trimmed, 1, 40)))
            )

        def listed(label: str, values: Column) -> Column:
            return F.transform(
                values,
                lambda v, i: phrase(F.concat(F.lit(f"{label}["), i.cast("string"), F.lit("]")), v),
            )

        def words_of(text: Column) -> Column:
            # Without Arabic letters and marks, one spelling is lower case.
            plain = F.split(F.lower(text), TITLE_SEPARATORS)
            spelled = F.transform(F.split(text, TITLE_SEPARATORS), normalise_arabic)
            return F.filter(F.when(text.rlike(ARABIC), spelled).otherwise(plain), lambda w: F.length(w) >= 3)

        words = let(F.coalesce(title, F.lit("")), words_of)

        def absent(some: Column) -> Column:
            return F.filter(some, lambda w: ~F.contains(hay, w))

        def set_aside(given: Column) -> Column:
            # A long title: words that stand on the page as words are found by hash, and only the rest is searched for.
            missing = absent(F.array_except(given, F.split(hay, TITLE_SEPARATORS)))
            return let(missing, lambda m: F.when(F.size(m) > 0, F.filter(given, lambda w: F.array_contains(m, w))).otherwise(F.slice(given, 1, 0)))

        stray = let(words, lambda given: F.when(F.size(given) > _FEW_WORDS, set_aside(given)).otherwise(absent(given)))
        about_title = let(
            stray,
            lambda s: F.when(
                F.size(s) > 0,
                F.concat(
                    F.lit("titleAr has "),
                    F.size(s).cast("string"),
                    F.lit(" word(s) the page never printed: "),
                    _quoted(F.array_join(F.slice(s, 1, 4), " ")),
                ),
            ),
        )
        unquoted = F.when(
            F.coalesce(states_rule, F.lit(False)) & (F.coalesce(strip(quote), F.lit("")) == ""),
            F.lit("statesZeroCoursesRule=true with nothing quoted"),
        )
        no_strings = F.array().cast("array<string>")
        return F.array_compact(
            F.concat(
                F.array(
                    about_title,
                    phrase(F.lit("zeroCoursesQuote"), quote),
                    phrase(F.lit("opensRaw"), opens_raw),
                    phrase(F.lit("closesRaw"), closes_raw),
                ),
                F.coalesce(listed("majors", majors), no_strings),
                F.coalesce(listed("cities", cities), no_strings),
                F.array(unquoted),
            )
        )

    return let(normalise_arabic(page), check)


def verdict_offences(page: Column, verdict: Column) -> Column:
    """The guard over a verdict struct."""
    return invented_wording(
        page, verdict["titleAr"], verdict["zeroCoursesQuote"], verdict["opensRaw"],
        verdict["closesRaw"], verdict["majors"], verdict["cities"], verdict["statesZeroCoursesRule"],
    )


CLAIMS = ["title", "zero_courses_quote", "majors", "cities", "states_zero_courses_rule"]


def record_offences(page: Column, of=F.col) -> Column:
    """The guard over a stored record's own columns; a placeholder claims no title."""
    title = F.when(of("title") != L.UNJUDGED_TITLE, of("title"))
    nothing = F.lit(None).cast("string")
    return invented_wording(
        page, title, of("zero_courses_quote"), nothing, nothing, of("majors"), of("cities"), of("states_zero_courses_rule"),
    )


def claims_by_page(records: DataFrame) -> DataFrame:
    """``url, claims``: what the judged records of a page say it says; a page has few records."""
    judged = records.where(F.col("title") != L.UNJUDGED_TITLE)
    return judged.groupBy("url").agg(F.collect_list(F.struct(*CLAIMS)).alias("claims"))


def disproved(page: Column, claims: Column) -> Column:
    """Whether some claim is not on the page."""
    wrong = F.exists(claims, lambda c: F.size(record_offences(page, lambda name: c[name])) > 0)
    return F.coalesce(wrong, F.lit(False))


def stale_wording(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Records whose wording is no longer on the page read this round: ``url, offences``."""
    judged = records.where(F.col("title") != L.UNJUDGED_TITLE)
    return (
        judged.join(texts.select("url", F.col("text").alias("_page")), "url")
        .withColumn("offences", record_offences(F.col("_page")))
        .where(F.size("offences") > 0)
        .select("id", "url", "offences")
    )


def announcement_key(org: Column, title: Column, closes: Column, url: Column) -> Column:
    """Which announcement a record is about.  Without a closing day it stands alone."""
    return F.when(closes.isNull(), F.concat_ws("|", org, url)).otherwise(
        F.concat_ws("|", org, fold_title(title), closes.cast("string"))
    )


def acceptance(judged: DataFrame, by: str = "model") -> DataFrame:
    """Share of verdicts the guard accepts, per model."""
    return judged.groupBy(by).agg(
        F.count("*").alias("verdicts"),
        F.count_if(F.size("offences") == 0).alias("accepted"),
        F.avg(F.when(F.size("offences") == 0, 1.0).otherwise(0.0)).alias("acceptance"),
    )
