"""Which changed pages deserve the expensive question, in what order, within what budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.messages import verdict_failure
from tidewatch.functions.text import fingerprint, matches, mentions_training
from tidewatch.operators.guard import verdict_offences
from tidewatch.operators.probe import known_to
from tidewatch.operators.spread import first_row_per_key, running_total, spread_join


def always_judge(coop_confirmed: Column, source_type: Column) -> Column:
    """Sources whose pages are never filtered out cheaply."""
    return F.coalesce(coop_confirmed, F.lit(False)) | F.coalesce(
        source_type.isin("careers_page", "portal"), F.lit(False)
    )


def source_rank(coop_confirmed: Column, source_type: Column) -> Column:
    return (
        F.when(F.coalesce(coop_confirmed, F.lit(False)), 0)
        .when(source_type.isin("careers_page", "portal"), 1)
        .when(source_type == "announcement_page", 2)
        .otherwise(3)
    )


def owed(readings: DataFrame, sources: DataFrame, key: str = "url") -> DataFrame:
    """Pending pages read this round with ``rank``, ``always`` and their fingerprint.

    ``readings``: ``key, payload, pending``; ``sources``: ``key, coop_confirmed, type``.
    """
    standing = sources.groupBy(key).agg(
        F.min(source_rank(F.col("coop_confirmed"), F.col("type"))).alias("rank"),
        F.max(always_judge(F.col("coop_confirmed"), F.col("type"))).alias("always"),
    )
    return (
        readings.where("pending AND payload IS NOT NULL")
        .join(standing, key, "left")
        .withColumn("rank", F.coalesce("rank", F.lit(3)))
        .withColumn("always", F.coalesce("always", F.lit(False)))
        .withColumn("fingerprint", fingerprint(F.col("payload")))
    )


def cheap_filter(pages: DataFrame) -> DataFrame:
    """``settled`` = why a page needs no verdict at all, NULL when it does."""
    no_word = ~F.col("always") & ~mentions_training(F.col("payload"))
    return pages.withColumn("settled", F.when(no_word, "no_training_word"))


def within_budget(pages: DataFrame, budget: int, key: str = "url", cost: Column | None = None) -> DataFrame:
    """Mark the prefix, by rank, that fits a budget; the page that crosses it is the last paid.

    Cost is the length of the text, the one price that repeats exactly.  Charge
    questions, one row per text to be asked: pages settled without asking are free.
    """
    priced = pages.withColumn("cost", F.length("payload").cast("long") if cost is None else cost)
    spent = running_total(priced, "rank", key, "cost", "spent")
    return spent.withColumn("in_budget", F.col("spent") - F.col("cost") < F.lit(budget))


def usable_memory(memory: DataFrame, model: str) -> DataFrame:
    """Verdicts written by the current model; anything unstamped or older is ignored."""
    return memory.where(F.col("model") == model)


def remember(pages: DataFrame, memory: DataFrame) -> DataFrame:
    """Pages beside what memory says of their exact text.

    ``remembered`` is hit, no (a remembered "not an announcement"), poisoned (the
    remembered wording is not on this page) or miss. Pages whose text the memory cannot
    hold are told apart where they lie and never move; ``pages`` must be cheap to read twice.
    """
    known = known_to(memory, "fingerprint")
    held, new = pages.where(known(F.col("fingerprint"))), pages.where(~known(F.col("fingerprint")))
    slim = memory.select("fingerprint", F.col("verdict").alias("_verdict"), F.lit(True).alias("_known"))
    joined = spread_join(held, slim, "fingerprint", "left")
    verdict = F.col("_verdict")
    offences = F.when(verdict.isNotNull(), verdict_offences(F.col("payload"), verdict))
    state = (
        F.when(F.col("_known").isNull(), "miss")
        .when(verdict.isNull(), "no")
        .when(F.size("_offences") > 0, "poisoned")
        .otherwise("hit")
    )
    looked = (
        joined.withColumn("_offences", offences)
        .withColumn("remembered", state)
        .withColumn("verdict", F.when(F.col("remembered") == "hit", verdict))
        .drop("_verdict", "_known", "_offences")
    )
    none = F.lit(None).cast(memory.schema["verdict"].dataType)
    return looked.unionByName(new.withColumn("remembered", F.lit("miss")).withColumn("verdict", none))


def evict(memory: DataFrame, remembered: DataFrame) -> DataFrame:
    """Memory without the verdicts a page has just proved wrong."""
    poisoned = remembered.where("remembered = 'poisoned'").select("fingerprint").distinct()
    return memory.join(poisoned, "fingerprint", "left_anti")


def bound_memory(memory: DataFrame, keep: int | None = L.MAX_REMEMBERED_VERDICTS) -> DataFrame:
    """The newest verdicts only, all for None; a top-k, so nothing is sorted whole."""
    if keep is None:
        return memory
    return memory.orderBy(F.desc("written_at"), "fingerprint").limit(keep)


def forgotten(memory: DataFrame, keep: int | None = L.MAX_REMEMBERED_VERDICTS) -> DataFrame:
    """The verdicts that ``bound_memory`` leaves out; ``memory`` has one row per fingerprint."""
    kept = bound_memory(memory, keep).select(F.col("fingerprint").alias("_kept"))
    return memory.join(kept, F.col("fingerprint").eqNullSafe(F.col("_kept")), "left_anti")


def distinct_questions(pages: DataFrame, key: str = "url") -> DataFrame:
    """Each text asked once: ``fingerprint, rank, payload`` of the best-ranked page carrying it.

    The page is chosen on slim rows; texts are only looked up for the chosen ones.
    """
    slim = pages.select("fingerprint", "rank", key, "payload")
    return first_row_per_key(slim, ["fingerprint"], ["rank", key]).drop(key)


def settle(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Give every page the answer its text received."""
    return spread_join(pages, answers, "fingerprint", "left")


def give_up(snapshots: DataFrame, failed: DataFrame, key: str = "url") -> DataFrame:
    """Count failed verdicts; after three on unchanged text a page stops asking."""
    hit = failed.select(key).distinct().withColumn("_failed", F.lit(True))
    failures = F.coalesce(F.col("judge_failures"), F.lit(0)) + 1
    return (
        snapshots.join(hit, key, "left")
        .withColumn(
            "judge_failures",
            F.when(F.col("_failed"), failures).otherwise(F.col("judge_failures")),
        )
        .withColumn(
            "pending",
            F.when(F.col("_failed"), F.col("judge_failures") < L.MAX_JUDGE_FAILURES).otherwise(
                F.col("pending")
            ),
        )
        .drop("_failed")
    )


def settled_report(snapshots: DataFrame) -> DataFrame:
    """Pages closed without a verdict, by reason."""
    return (
        snapshots.where("settled_without_verdict IS NOT NULL")
        .groupBy(F.col("settled_without_verdict").alias("reason"))
        .agg(F.count("*").alias("pages"))
    )


def usage_totals(
    replies: DataFrame,
    by: str = "model",
    input_price: float = 0.0,
    output_price: float = 0.0,
    write_factor: float = 1.25,
    read_factor: float = 0.1,
) -> DataFrame:
    """Tokens and what they cost, with the cache and as if there were none.

    ``replies``: ``by, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens``.
    Prices are per million tokens.
    """
    written = F.coalesce(F.col("cache_write_tokens"), F.lit(0))
    read = F.coalesce(F.col("cache_read_tokens"), F.lit(0))
    totals = replies.groupBy(by).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(written).alias("cache_write_tokens"),
        F.sum(read).alias("cache_read_tokens"),
    )
    out_cost = F.col("output_tokens") * output_price
    cached = (
        F.col("input_tokens") * input_price
        + F.col("cache_write_tokens") * (input_price * write_factor)
        + F.col("cache_read_tokens") * (input_price * read_factor)
        + out_cost
    )
    plain = (
        F.col("input_tokens") + F.col("cache_write_tokens") + F.col("cache_read_tokens")
    ) * input_price + out_cost
    return totals.withColumn("cost", cached / 1e6).withColumn("uncached_cost", plain / 1e6)


def reopen_unjudged(records: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unjudged records still showing a raw diagnostic: reason rewritten, page queued again."""
    diagnostic = F.col("score").isNull() & matches(F.col("reason"), L.DIAGNOSTIC_LATIN)
    urls = records.where(diagnostic).select("url").distinct().withColumn("_open", F.lit(True))
    rewritten = F.concat(F.lit(L.REASONS["unjudged_prefix"]), verdict_failure(F.col("reason")))
    fixed = records.withColumn("reason", F.when(diagnostic, rewritten).otherwise(F.col("reason")))
    queued = (
        snapshots.join(urls, "url", "left")
        .withColumn("pending", F.col("pending") | F.coalesce("_open", F.lit(False)))
        .drop("_open")
    )
    return fixed, queued


def unscore_stale(records: DataFrame, snapshots: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Scores a retired model gave: removed, flagged, and their pages queued again."""
    stale = F.col("score").isNotNull() & (F.col("last_confirmed") < before)
    urls = records.where(stale).select("url").distinct().withColumn("_stale", F.lit(True))
    hit = F.coalesce(F.col("_stale"), F.lit(False)) & F.col("score").isNotNull()
    marked = records.join(urls, "url", "left").withColumn("_hit", hit)
    cleared = (
        marked.withColumn("score", F.when(~F.col("_hit"), F.col("score")))
        .withColumn(
            "reason", F.when(F.col("_hit"), F.lit(L.REASONS["stale_model"])).otherwise(F.col("reason"))
        )
        .withColumn(
            "flags",
            F.when(
                F.col("_hit"), F.array_union("flags", F.array(F.lit("needs_manual_review")))
            ).otherwise(F.col("flags")),
        )
        .drop("_stale", "_hit")
    )
    queued = (
        snapshots.join(urls, "url", "left")
        .withColumn("pending", F.col("pending") | F.coalesce("_stale", F.lit(False)))
        .drop("_stale")
    )
    return cleared, queued
