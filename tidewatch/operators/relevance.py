"""How near an announcement is to a reader, computed from what both state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fields
from tidewatch.functions import lexicon as L
from tidewatch.functions.text import let
from tidewatch.operators.extract import settled
from tidewatch.operators.spread import dealt, top_k
from tidewatch.session import cut


def read_profiles(profiles: DataFrame, text: str = "profile") -> DataFrame:
    """Profile text to ``field, cities, graduated, field_label``; no field, no profile."""
    col = F.col(text)
    return (
        dealt(profiles).withColumn("field", settled(fields.field_of(col)))
        .where("field <> 'none'")
        .withColumn("reader_cities", fields.reader_cities(col))
        .withColumn("graduated", fields.graduated(col))
        .withColumn("field_label", fields.field_label(F.col("field")))
    )


def announced_facts(title: Column, majors: Column) -> Column:
    """What an announcement itself says about fields; it does not depend on any reader."""
    return fields.field_facts(F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), majors), " "))


def relevance(
    product: Column,
    title: Column,
    majors: Column,
    cities: Column,
    field: Column,
    reader_cities: Column,
    graduated: Column,
    label: Column,
    facts: Column | None = None,
) -> Column:
    """``struct<score, reason>``; NULL when the announcement names nothing to measure by.

    ``facts`` may be computed beforehand, once per announcement instead of once
    per reader of it.
    """

    def judge(seen: Column) -> Column:
        announced, all_majors = seen["announced"], seen["all_majors"]
        base = F.create_map(*[F.lit(x) for pair in L.FIELD_BASE.items() for x in pair])
        unmeasurable = (
            (announced == "none") & ~all_majors & (F.size(majors) == 0) & ~seen["names_any"]
        )
        base_score = (
            F.when((announced == "none") & all_majors, F.element_at(base, field))
            .when(announced == "none", F.lit(L.UNRELATED_SCORE))
            .otherwise(F.try_element_at(base, announced))
        )
        scorable = (announced != "none") & (base_score > L.UNRELATED_SCORE)
        has_cities = scorable & (F.size(reader_cities) > 0)
        mine = F.filter(
            cities,
            lambda city: F.exists(reader_cities, lambda r: F.contains(F.lower(city), F.lower(r))),
        )
        in_city = has_cities & (F.size(mine) > 0)
        fit = (
            F.when((announced == "none") & all_majors, L.REASONS["all_majors"])
            .when(announced == "none", L.REASONS["unrelated"])
            .when(announced == field, F.concat(F.lit("يذكر "), label, F.lit("، وهو تخصّصك")))
            .when((announced == "it") & (field == "cyber"), L.REASONS["near"])
            .when((announced == "cyber") & (field != "cyber"), L.REASONS["broader"])
            .otherwise(L.REASONS["general"])
        )
        place = F.when(in_city, F.concat(F.lit("وفي "), mine[0])).when(
            has_cities & (F.size(cities) > 0),
            F.concat(F.lit("وفي "), F.array_join(cities, "، "), F.lit("، خارج مدينتك")),
        )
        graduate = product == "graduate_dev"
        clauses = F.array(
            F.when(graduate & graduated.isNull(), L.REASONS["graduate_unknown"]), fit, place
        )
        total = base_score + F.when(in_city, L.CITY_BONUS).otherwise(0)
        scored = F.struct(
            F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("score"),
            F.concat(F.array_join(F.array_compact(clauses), "، "), F.lit(".")).alias("reason"),
        )
        refused = F.struct(
            F.lit(0).alias("score"), F.lit(L.REASONS["graduate_zero"]).alias("reason")
        )
        return F.when(
            graduate & F.coalesce(~graduated, F.lit(False)), refused
        ).when(~unmeasurable, scored)

    return let(announced_facts(title, majors) if facts is None else facts, judge)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Scores of (reader, announcement) rows brought together by an equi-join.

    Needs ``product, title, majors, cities`` and ``field, reader_cities,
    graduated, field_label``; a ``facts`` column made before the join is used.
    """
    facts = F.col("facts") if "facts" in pairs.columns else None
    fit = relevance(
        F.col("product"), F.col("title"), F.col("majors"), F.col("cities"), F.col("field"),
        F.col("reader_cities"), F.col("graduated"), F.col("field_label"), facts,
    )
    return (
        pairs.withColumn("_fit", fit)
        .withColumn("score", F.col("_fit.score"))
        .withColumn("reason", F.coalesce(F.col("_fit.reason"), F.lit(L.REASONS["no_field"])))
        .drop("_fit")
    )


def _class_of(*facts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*facts)), 256)


def reader_classes(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``reader_class``: readers of one class have the same score and reason everywhere."""
    facts = ["field", "reader_cities", "graduated", "field_label"]
    return profiles.withColumn("reader_class", _class_of(*[F.col(c) for c in facts]))


def announcement_classes(announcements: DataFrame) -> DataFrame:
    """``announcements`` with their ``facts`` and ``announcement_class``: all that a score or reason takes from them."""
    known = dealt(announcements).withColumn("facts", settled(announced_facts(F.col("title"), F.col("majors"))))
    graduate, unnamed = F.coalesce(F.col("product") == "graduate_dev", F.lit(False)), F.size("majors") == 0
    return known.withColumn(
        "announcement_class", _class_of(F.col("facts"), graduate.alias("graduate"), unnamed.alias("unnamed"), F.col("cities"))
    )


def class_scores(readers: DataFrame, announcements: DataFrame) -> DataFrame:
    """Scores of every class of readers for every class of announcements, both as made above.

    ``reader_class, announcement_class, field, graduated, readers, announcements, score,
    reason``: a row stands for ``readers * announcements`` pairs, none of which is made.
    Work follows the number of classes, which few facts make up, not that of readers.
    A class of announcements is offered to each field once and meets the readers of it.
    """
    of = ["field", "reader_cities", "graduated", "field_label"]
    who = readers.groupBy("reader_class").agg(F.count("*").alias("readers"), *[F.any_value(c).alias(c) for c in of])
    said = ["product", "title", "majors", "cities", "facts"]
    what = announcements.groupBy("announcement_class").agg(F.count("*").alias("announcements"), *[F.any_value(c).alias(c) for c in said])
    offered = what.withColumn("field", F.explode(F.array(*[F.lit(f) for f in L.FIELD_BASE])))
    return score_pairs(offered.join(who, "field")).select(
        "reader_class", "announcement_class", "field", "graduated", "readers", "announcements", "score", "reason"
    )


def reader_board(readers: DataFrame, announcements: DataFrame, k: int, reader: str = "reader_id", of: str = "id") -> DataFrame:
    """The ``k`` announcements nearest to every reader, by score, then by ``of``: ``reader, of, score, rank``.

    Ranked once for each class of readers, from the first ``k`` of each class of
    announcements; a reader only takes over the board of their class. What cannot be
    measured is on no board. Both tables are used twice and written before, so that each
    profile and each announcement is read once.
    """
    readers = cut(readers.select(reader, "reader_class", "field", "reader_cities", "graduated", "field_label"))
    announcements = cut(announcements.select(of, "announcement_class", "product", "title", "majors", "cities", "facts"))
    scores = class_scores(readers, announcements).where("score IS NOT NULL").select("reader_class", "announcement_class", "score")
    first = top_k(announcements.select("announcement_class", of), ["announcement_class"], [F.col(of)], k, "_n").drop("_n")
    board = top_k(scores.join(first, "announcement_class").drop("announcement_class"), ["reader_class"], [F.desc("score"), F.col(of)], k)
    return readers.select(reader, "reader_class").join(board, "reader_class").select(reader, of, "score", "rank")


def visible(records: DataFrame, ignored: DataFrame, threshold: int) -> DataFrame:
    """What a reader sees: unscored records count as wanted, ignored ones are gone."""
    return records.where(F.coalesce(F.col("score"), F.lit(100)) >= threshold).join(
        ignored.select("id"), "id", "left_anti"
    )


def score_basis(scores: DataFrame, computed_at: Column) -> DataFrame:
    """Which profile stands behind the scores: its label and the time, nothing else of it."""
    return (
        scores.select("profile_id", "field_label").distinct().withColumn("computed_at", computed_at)
    )
