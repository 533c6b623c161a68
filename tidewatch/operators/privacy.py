"""Personal data in text: whole-text scans, and what a version newly introduced."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import let, matches


def scan(
    texts: DataFrame, keys: list[str], text: str = "text", origin: str | None = None, rules=None,
    samples: int | None = 3,
) -> DataFrame:
    """Hits per text and rule: ``keys, rule, hits, first_line, samples``.

    ``samples`` are the first so many hits, all for None; ``hits`` counts all of them.
    A rule may exempt origins (files it is expected in).  Every text is read once
    for all rules.
    """
    rules = L.PRIVACY_RULES if rules is None else rules
    body = F.col(text)

    def one(name: str, pattern: str, exempt: str | None):
        def describe(found):
            before = F.call_function("substring_index", body, found[0], F.lit(1))
            return F.struct(
                F.lit(name).alias("rule"),
                F.size(found).alias("hits"),
                (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("first_line"),
                (found if samples is None else F.slice(found, 1, samples)).alias("samples"),
            )

        applies = body.rlike(pattern)
        needles = [F.contains(body, F.lit(needle)) for needle in L.PRIVACY_NEEDLES.get(name, [])]
        if needles:
            applies = reduce(or_, needles) & applies
        if exempt and origin:
            applies = applies & ~matches(F.col(origin), exempt)
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return F.when(applies, let(found, describe))

    hits = F.array_compact(F.array(*[one(*rule) for rule in rules]))
    return texts.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def rules_with_account(account: str | None, rules=None) -> list[tuple[str, str, str | None]]:
    """The rules, and one for an account name, which no origin may show; None adds nothing."""
    rules = list(L.PRIVACY_RULES if rules is None else rules)
    if account:
        rules.append(("account_name", f"{L.NOT_WORD_BEFORE}{re.escape(account)}{L.NOT_WORD_AFTER}", None))
    return rules


def scan_reasons(records: DataFrame) -> DataFrame:
    """Published reasons that say something about the reader: ``id, rule``."""
    hits = F.array_compact(
        F.array(*[F.when(matches(F.col("reason"), pattern), F.lit(name)) for name, pattern in L.REASON_PRIVACY])
    )
    return records.select("id", F.explode(hits).alias("rule"))


def introduced(versions: DataFrame, previous: DataFrame, keys: list[str], text: str = "text", rules=None) -> DataFrame:
    """Hits in lines a version added over the one before it, by rule.

    Lines are compared as a set per text, by hash, so line order and repetition
    do not matter and only added lines are scanned.
    """
    rules = L.PRIVACY_RULES if rules is None else rules
    split = F.explode(F.split(F.col(text), "\n"))
    now = versions.select(*keys, split.alias("line")).withColumn("_h", F.md5("line"))
    was = previous.select(*keys, split.alias("line")).select(*keys, F.md5("line").alias("_h")).distinct()
    added = now.join(was, [*keys, "_h"], "left_anti").select(*keys, "line")
    return scan(added, keys, "line", rules=rules).groupBy(*keys, "rule").agg(
        F.sum("hits").cast("long").alias("hits")
    )


def introduced_by_version(
    versions: DataFrame, keys: list[str], version: str, text: str = "text", rules=None
) -> DataFrame:
    """Hits in lines each version of a text added over the version before it: ``keys, version, rule, hits``.

    The first version adds all its lines.  Versions are put in order on slim rows;
    lines are compared by hash, one set per version, so no history is gathered.
    """
    order = Window.partitionBy(*keys).orderBy(version)
    before = versions.select(*keys, version).distinct().withColumn("_before", F.lag(version).over(order))
    lines = versions.select(*keys, version, F.explode(F.split(F.col(text), "\n")).alias("line")).withColumn("_h", F.md5("line"))
    was = lines.select(*keys, F.col(version).alias("_before"), "_h").distinct()
    now = lines.join(before, [*keys, version])
    added = now.join(was, [*keys, "_before", "_h"], "left_anti").select(*keys, version, "line")
    return scan(added, [*keys, version], "line", rules=rules).groupBy(*keys, version, "rule").agg(
        F.sum("hits").cast("long").alias("hits")
    )
