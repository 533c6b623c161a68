"""Which field of study a text names, and who a reader is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import let, matches, normalise_arabic


def _names(text: Column) -> Column:
    """Which lexicons a text touches, each tried once."""
    return F.struct(
        matches(text, L.any_of(L.CYBER)).alias("cyber"),
        matches(text, L.any_of(L.NON_COMPUTING)).alias("other"),
        (matches(text, L.any_of(L.IT)) | matches(text, L.IT_ACRONYM)).alias("it"),
        matches(text, L.any_of(L.SUPPORT)).alias("support"),
        matches(text, L.any_of(L.GENERAL)).alias("general"),
    )


def _field(named: Column) -> Column:
    return (
        F.when(named["cyber"], "cyber")
        .when(named["other"] & ~named["it"], "none")
        .when(named["support"], "general")
        .when(named["it"], "it")
        .when(named["general"], "general")
        .otherwise("none")
    )


def _any(named: Column) -> Column:
    return named["cyber"] | named["other"] | named["it"] | named["support"] | named["general"]


def field_of(text: Column) -> Column:
    """cyber, it, general or none.  An unrelated trade wins unless IT is named beside it."""
    return let(_names(text), _field)


def names_a_field(text: Column) -> Column:
    return let(_names(text), _any)


def field_facts(text: Column) -> Column:
    """``struct<announced, names_any, all_majors>`` of an announcement's own words."""
    everyone = matches(normalise_arabic(text), "(?i)" + L.ALL_MAJORS)
    return let(
        F.struct(_names(text).alias("named"), everyone.alias("everyone")),
        lambda f: F.struct(
            _field(f["named"]).alias("announced"),
            _any(f["named"]).alias("names_any"),
            f["everyone"].alias("all_majors"),
        ),
    )


def field_label(field: Column) -> Column:
    return (
        F.when(field == "cyber", L.FIELD_LABELS["cyber"])
        .when(field == "it", L.FIELD_LABELS["it"])
        .when(field == "general", L.FIELD_LABELS["general"])
    )


def graduated(profile_text: Column) -> Column:
    """False, true, or NULL when the profile does not say."""
    not_yet = matches(profile_text, "(?i)not\\s+yet\\s+graduated|لم\\s*(?:يتخرّ?ج|أتخرّ?ج|اتخرّ?ج|تتخرّ?ج)")
    yes = matches(
        profile_text,
        "(?i)(?<![A-Za-z0-9_])graduated(?![A-Za-z0-9_])|تخرّ?ج\\s*فعلي|حاصل\\s*على\\s*وثيقة\\s*التخرج",
    )
    return F.when(not_yet, F.lit(False)).when(yes, F.lit(True))


def reader_cities(profile_text: Column) -> Column:
    cities = F.array(*[F.lit(city) for city in L.READER_CITIES])
    return F.filter(cities, lambda city: F.contains(profile_text, city))


def score_band(score: Column, flags: Column) -> Column:
    return (
        F.when(F.array_contains(flags, "needs_manual_review") | score.isNull(), "review")
        .when(score >= 85, "high")
        .when(score >= 60, "mid")
        .otherwise("low")
    )
