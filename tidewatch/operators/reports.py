"""What a reader asks of the tables: lists, lanes, facets, honesty, and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.functions.text import matches
from tidewatch.operators.guard import announcement_key
from tidewatch.operators.health import coverage
from tidewatch.operators.selection import medians
from tidewatch.operators.spread import first_per_key, spread_join


def collapse(records: DataFrame) -> DataFrame:
    """Pages of one announcement under the reading that says most.

    Every record stays, with ``announcement``, ``lead_id``, ``is_lead`` and the
    number of pages; nothing is gathered into a list.
    """
    keyed = records.withColumn(
        "announcement", announcement_key(F.col("org_id"), F.col("title"), F.col("closes"), F.col("url"))
    )
    best = F.struct((-F.coalesce(F.col("score"), F.lit(-1))).alias("s"), F.col("id").alias("i"))
    leads = keyed.groupBy("announcement").agg(F.min(best).alias("_b"), F.count("*").alias("pages"))
    slim = leads.select("announcement", F.col("_b.i").alias("lead_id"), "pages")
    return spread_join(keyed, slim, "announcement", "inner").withColumn(
        "is_lead", F.col("id") == F.col("lead_id")
    )


def open_now(records: DataFrame, as_of: Column) -> DataFrame:
    """Open windows, nearest deadline first, undated last."""
    live = records.where(F.col("status").isin("open", "closing_soon"))
    return live.withColumn("days_left", D.days_left(F.col("closes"), as_of)).orderBy(
        F.asc_nulls_last("days_left"), "id"
    )


def status_groups(records: DataFrame) -> DataFrame:
    """How many announcements, and pages, each status holds."""
    return (
        collapse(records)
        .groupBy("status")
        .agg(F.count_if(F.col("is_lead")).alias("announcements"), F.count("*").alias("pages"))
    )


def dedicated_channel(method: Column, target: Column) -> Column:
    """A mailbox whose own name says it is for training."""
    return F.coalesce(method == "email", F.lit(False)) & matches(
        F.substring_index(target, "@", 1), L.DEDICATED_CHANNEL
    )


def lane_rank(status: Column, rolling: Column, health: Column) -> Column:
    return (
        F.when(status == "closing_soon", 0)
        .when(status == "open", 1)
        .when(status == "announced_not_open", 2)
        .when(rolling, 3)
        .when(health.isin("broken", "degraded"), 5)
        .otherwise(4)
    )


def season_lanes(orgs: DataFrame, visible: DataFrame, health: DataFrame, as_of: Column) -> DataFrame:
    """A lane per watched organisation: its first visible record, health, and place in the season.

    ``orgs``: ``org_id, name, method, target``; ``health``: ``org_id, health``.
    ``shown`` lanes carry a date or take applications all year.
    """
    first = first_per_key(visible.select("org_id", "id", "status", "opens", "closes"), ["org_id"], F.col("id"))
    joined = orgs.join(first, "org_id", "left").join(health.select("org_id", "health"), "org_id", "left")
    rolling = dedicated_channel(F.col("method"), F.col("target")) & F.col("id").isNull()
    opening, closing = D.opening_instant(F.col("opens")), D.deadline_instant(F.col("closes"))
    return (
        joined.withColumn("health", F.coalesce("health", F.lit("unwatched")))
        .withColumn("rolling", rolling)
        .withColumn("rank", lane_rank(F.col("status"), F.col("rolling"), F.col("health")))
        .withColumn("from_pos", F.when(F.col("opens").isNotNull(), D.season_position(opening, as_of)))
        .withColumn("to_pos", F.when(F.col("closes").isNotNull(), D.season_position(closing, as_of)))
        .withColumn("shown", F.col("rolling") | F.col("opens").isNotNull() | F.col("closes").isNotNull())
    )


def lane_summary(lanes: DataFrame) -> DataFrame:
    """Lanes drawn and hidden, organisations silent and organisations unread."""
    unread = F.col("health").isin("unwatched", "broken")
    return lanes.agg(
        F.count("*").alias("lanes"),
        F.count_if(F.col("shown")).alias("shown"),
        F.count_if(~F.col("shown")).alias("hidden"),
        F.count_if(~F.col("shown") & unread).alias("hidden_unreadable"),
        F.count_if(F.col("id").isNull() & ~unread).alias("silent"),
        F.count_if(unread).alias("unread"),
    )


def facet_search(
    orgs: DataFrame, sector: str = "", query: str = "", tier: str = "", city: str = "",
    no_zero_courses: bool = False, with_stipend: bool = False, accepts_major: bool = False,
) -> DataFrame:
    """Organisations passing every chosen facet, by tier then name."""
    out = orgs
    if sector:
        out = out.where(F.col("sector") == sector)
    if query:
        out = out.where(
            F.contains("name", F.lit(query)) | F.contains(F.lower("name_en"), F.lit(query.lower()))
        )
    if tier:
        out = out.where(F.col("tier") == tier)
    if city:
        out = out.where(F.array_contains("cities", city))
    if no_zero_courses:
        out = out.where(F.col("requires_zero_courses") == F.lit(False))
    if with_stipend:
        out = out.where(F.col("stipend_sar") > 0)
    if accepts_major:
        out = out.where(F.col("accepts_major"))
    return out.orderBy(tier_rank(F.col("tier")), "name", "org_id")


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in L.TIERS]), tier), F.lit(99))


def facet_counts(orgs: DataFrame) -> DataFrame:
    """Organisations per sector, tier and city, and those without a city."""

    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))

    # One explode per organisation: its facets are few, so one pass serves them all.
    cities = F.transform(F.array_distinct("cities"), lambda c: facet("city", c))
    tags = F.concat(
        F.array(facet("sector", F.col("sector")), facet("tier", F.col("tier"))),
        F.when(F.size("cities") > 0, cities).otherwise(F.array(facet("no_city", F.lit("")))),
        F.array_compact(
            F.array(
                F.when(F.col("requires_zero_courses") == F.lit(False), facet("chip", F.lit("no_zero_courses"))),
                F.when(F.col("stipend_sar") > 0, facet("chip", F.lit("stipend"))),
                F.when(F.col("accepts_major"), facet("chip", F.lit("accepts_major"))),
            )
        ),
    )
    return orgs.select(F.explode(tags).alias("t")).groupBy("t.facet", "t.value").agg(
        F.count("*").alias("orgs")
    )


def honesty(orgs: DataFrame, configured: DataFrame, health: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """What the screen admits: sources read of all, organisations unread, what awaits a person."""
    owner = configured.select("url", "org_id").distinct()
    troubled = health.where("state <> 'healthy'").join(owner, "url")
    top = spread_join(troubled, orgs.select("org_id", "tier"), "org_id", "inner").where(
        F.col("tier").isin("S", "A")
    )
    return (
        coverage(configured, health)
        .withColumn("needs_hand_check", health.where("state <> 'healthy'").agg(F.count("*")).scalar())
        .withColumn(
            "unjudged",
            records.where(F.array_contains("flags", "needs_manual_review")).agg(F.count("*")).scalar(),
        )
        .withColumn("top_tier_orgs_blocked", top.agg(F.countDistinct("org_id")).scalar())
        .withColumn("last_check", health.agg(F.max("last_attempt")).scalar())
        .withColumn("last_check_age", D.time_ago(F.col("last_check"), as_of))
    )


def silent_and_unread(orgs: DataFrame, org_states: DataFrame, visible: DataFrame) -> DataFrame:
    """Organisations that were read and announced nothing, and those never read."""
    quiet = orgs.select("org_id").join(visible.select("org_id").distinct(), "org_id", "left_anti")
    joined = orgs.select("org_id").join(org_states.select("org_id", "health"), "org_id", "left")
    unread = F.coalesce("health", F.lit("unwatched")).isin("unwatched", "broken")
    return (
        joined.join(quiet.withColumn("_quiet", F.lit(True)), "org_id", "left")
        .withColumn(
            "standing", F.when(unread, "unread").when(F.col("_quiet"), "silent").otherwise("announcing")
        )
        .select("org_id", "standing")
    )


def status_screen(
    configured: DataFrame, health: DataFrame, records: DataFrame, snapshots: DataFrame,
    queue: DataFrame, as_of: Column,
) -> DataFrame:
    """Is it working: what it sees, judges and delivers, as ``section, measure, value``."""

    def measures(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns
        ]
        return df.select(F.lit(section).alias("section"), F.explode(F.array(*pairs)).alias("m")).select(
            "section", "m.*"
        )

    see = coverage(configured, health).withColumn(
        "hours_since_check",
        D.hours_between(as_of, health.agg(F.max("last_attempt")).scalar()),
    )
    judge = records.agg(
        F.count_if(F.col("score").isNotNull()).alias("judged"),
        F.count_if(F.array_contains("flags", "needs_manual_review")).alias("in_review"),
        F.count_if(F.col("status").isin("open", "closing_soon")).alias("open_now"),
    )
    waiting = snapshots.agg(
        F.count_if(F.col("pending")).alias("queued"),
        F.count_if(F.col("settled_without_verdict").isNotNull()).alias("settled"),
        F.count_if(F.col("settled_without_verdict") == "no_training_word").alias("no_training_word"),
    )
    reach = queue.agg(F.count("*").alias("held"))
    return (
        measures(see, "see", ["total", "read", "orgs_unread", "hours_since_check"])
        .unionByName(measures(judge, "judge", ["judged", "in_review", "open_now"]))
        .unionByName(measures(waiting, "judge", ["queued", "settled", "no_training_word"]))
        .unionByName(measures(reach, "reach", ["held"]))
    )


def coverage_report(orgs: DataFrame) -> DataFrame:
    """How much of the list is verified and known, by tier and origin.

    ``orgs``: ``org_id, tier, origin`` and boolean facts.
    """
    facts = ["has_verified_source", "has_lead", "has_manual_check", "has_channel", "rule_known",
             "major_known", "product_known", "stipend_known", "has_windows"]
    sums = [F.count_if(F.col(f)).alias(f) for f in facts]
    return (
        orgs.groupBy("tier", "origin")
        .agg(F.count("*").alias("orgs"), *sums)
        .withColumn("verified_percent", F.round(F.col("has_verified_source") * 100 / F.col("orgs")).cast("int"))
    )


def verification_rounds(attempts: DataFrame, targets: DataFrame) -> DataFrame:
    """Attempts by outcome, and targets nobody has tried."""
    untouched = targets.select("target_id").distinct().join(
        attempts.select("target_id").distinct(), "target_id", "left_anti"
    )

    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return attempts.agg(
        n("verified").alias("verified"), n("rejected").alias("rejected"),
        n("not_found").alias("not_found"), n("unreachable").alias("unreachable"),
    ).withColumn("untouched", untouched.agg(F.count("*")).scalar())


def work_queue(orgs: DataFrame, k: int | None = 10) -> DataFrame:
    """Organisations nearest the reader's field that still lack a verified link."""
    sectors = F.array(*[F.lit(s) for s in L.SECTOR_WORK_ORDER])
    rank = F.when(F.array_contains(sectors, F.col("sector")), F.array_position(sectors, F.col("sector"))).otherwise(0)
    held = F.when(F.col("n_sources") > 0, "lead").when(F.col("has_channel"), "email").otherwise("nothing")
    queue = orgs.where(~F.col("has_manual_check")).withColumn("held", held).orderBy(tier_rank(F.col("tier")), rank, "org_id")
    return (queue if k is None else queue.limit(k)).select("org_id", "tier", "sector", "held")


def benchmark_replay(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Labelled cases against the records replayed for them: each check, and whether all hold.

    ``cases``: ``case_id, band, expect_announcement, expect_product, min_score,
    max_score, expect_closes``; ``records``: ``case_id, is_announcement, product,
    score, closes, flags``.
    """
    joined = cases.join(records, "case_id", "left")
    says = F.col("is_announcement").eqNullSafe(F.col("expect_announcement"))
    product = F.col("expect_product").isNull() | F.col("product").eqNullSafe(F.col("expect_product"))
    low = F.col("min_score").isNull() | F.coalesce(F.col("score") >= F.col("min_score"), F.lit(False))
    high = F.col("max_score").isNull() | F.coalesce(F.col("score") <= F.col("max_score"), F.lit(False))
    closes = F.col("expect_closes").isNull() | F.col("closes").eqNullSafe(F.col("expect_closes"))
    flagged = F.col("score").isNotNull() | ~F.col("is_announcement") | F.array_contains(
        "flags", "needs_manual_review"
    )
    return joined.select(
        "case_id", "band",
        says.alias("announcement_ok"), product.alias("product_ok"), (low & high).alias("score_ok"),
        closes.alias("closes_ok"), F.coalesce(flagged, F.lit(False)).alias("flags_ok"),
    ).withColumn(
        "passed",
        F.col("announcement_ok") & F.col("product_ok") & F.col("score_ok") & F.col("closes_ok") & F.col("flags_ok"),
    )


def benchmark_bands(replay: DataFrame) -> DataFrame:
    return replay.groupBy("band").agg(
        F.count("*").alias("cases"), F.count_if(F.col("passed")).alias("passed")
    )


def triage_quality(answers: DataFrame) -> DataFrame:
    """Per model: of what matters how much passed, of the ordinary how much was dropped, how fast.

    ``answers``: ``model, id, expected, passed_on, ms``.
    """
    expected, passed = F.col("expected"), F.col("passed_on")
    told = answers.groupBy("model").agg(
        F.count_if(expected).alias("positives"),
        F.count_if(expected & passed).alias("recalled"),
        F.count_if(~expected).alias("ordinary"),
        F.count_if(~expected & ~passed).alias("dropped"),
        F.count_if(expected & ~passed).alias("missed"),
        F.count_if(~expected & passed).alias("false_alarms"),
        F.max("ms").alias("max_ms"),
    )
    middle = medians(answers, "model", "ms").select(F.col("model").alias("_model"), F.col("median").alias("median_ms"))
    return told.join(middle, F.col("model").eqNullSafe(F.col("_model"))).drop("_model")


def triage_errors(answers: DataFrame) -> DataFrame:
    """The cases each model got wrong, by kind."""
    kind = F.when(F.col("expected") & ~F.col("passed_on"), "missed").when(
        ~F.col("expected") & F.col("passed_on"), "false_alarm"
    )
    return answers.withColumn("kind", kind).where("kind IS NOT NULL").select("model", "kind", "id")


def vantage_comparison(probes: DataFrame, vantages: list[str]) -> DataFrame:
    """Each target's verdict from every vantage, and whether they disagree."""
    wide = probes.groupBy("url").pivot("vantage", vantages).agg(F.max("verdict"))
    verdicts = F.array_compact(F.array(*[F.col(v) for v in vantages]))
    return wide.withColumn("disagree", F.size(F.array_distinct(verdicts)) > 1)


def vantage_counts(probes: DataFrame) -> DataFrame:
    return probes.groupBy("vantage", "verdict").agg(F.count("*").alias("targets"))


def organisation_detail(orgs: DataFrame, sources: DataFrame, health: DataFrame, records: DataFrame) -> DataFrame:
    """One row per organisation: the rule's wording, how much of it is read, what is confirmed.

    ``orgs``: ``org_id, name, tier, rule, rule_quote, past_windows``; ``sources``
    are verified ones: ``org_id, url, type, coop_confirmed``.
    """
    read = health.select("url", "last_success")
    watched = (
        sources.join(read, "url", "left")
        .groupBy("org_id")
        .agg(
            F.count("*").alias("watched"),
            F.count_if(F.col("last_success").isNotNull()).alias("read"),
            F.max("last_success").alias("newest_success"),
            F.max(F.coalesce("coop_confirmed", F.lit(False))).alias("confirmed"),
            F.bool_and(F.col("type") == "site_root").alias("homepage_only"),
        )
    )
    first = first_per_key(
        records.select("org_id", "id", "states_zero_courses_rule", "zero_courses_quote"), ["org_id"], F.col("id")
    )
    quote = F.when(F.col("rule"), F.col("rule_quote")).when(
        F.col("states_zero_courses_rule"), F.col("zero_courses_quote")
    )
    return (
        orgs.join(watched, "org_id", "left")
        .join(first.drop("id"), "org_id", "left")
        .select(
            "org_id", "name", "tier", quote.alias("quote"),
            F.coalesce("watched", F.lit(0)).alias("watched"),
            F.coalesce("read", F.lit(0)).alias("read"),
            "newest_success",
            F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
            F.coalesce("homepage_only", F.lit(False)).alias("homepage_only"),
            "past_windows",
        )
    )


