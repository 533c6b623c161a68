"""Links worth following, evidence on a page, and the attempts made to verify sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import html as H
from tidewatch.functions import lexicon as L
from tidewatch.functions import text as X
from tidewatch.operators.spread import first_per_key, top_k


def harvest(pages: DataFrame, owner: str = "org_id") -> DataFrame:
    """Links a page publishes on its own domain: ``owner, page_url, url, title, label``."""
    kept = F.filter(H.anchors(F.col("html")), lambda a: ~X.matches(a["href"], L.REJECTED_HREF))
    found = (
        pages.select(owner, F.col("url").alias("page_url"), F.explode(kept).alias("a"))
        .withColumn("url", A.without_fragment(A.resolve(F.col("a.href"), F.col("page_url"))))
        .where("url IS NOT NULL")
    )
    same_house = A.registered_domain(F.col("url")) == A.registered_domain(F.col("page_url"))
    social = X.matches(A.hostname(F.col("url")), L.SOCIAL_HOST)
    return found.where(same_house & ~social).select(
        owner, "page_url", "url", F.col("a.title").alias("title"), F.col("a.label").alias("label")
    )


def signal(words: Column) -> Column:
    """``struct<score, type>`` of the first signal the words carry."""
    out = None
    for pattern, score, kind in L.LINK_SIGNALS:
        one = F.struct(F.lit(score).alias("score"), F.lit(kind).alias("type"))
        hit = X.matches(words, pattern)
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out


def score_links(links: DataFrame, owner: str = "org_id", label_chars: int | None = 60) -> DataFrame:
    """Links with a signal, the best of each url.

    A weak signal needs a real label and a path that is a section, not one story.
    Labels are cut at ``label_chars``, nowhere for None.
    """
    words = F.concat_ws(" ", "label", F.coalesce("title", F.lit("")), A.decoded(A.path(F.col("url"))))
    weak = F.col("_s.score") < 60
    told = A.is_one_story(F.col("url")) | (F.length("label") < 3)
    scored = (
        links.withColumn("_s", signal(words))
        .where("_s IS NOT NULL")
        .where(~(weak & told))
        .select(
            owner, "url",
            F.col("_s.score").alias("score"),
            F.col("_s.type").alias("type"),
            (F.col("label") if label_chars is None else F.substring("label", 1, label_chars)).alias("label"),
        )
    )
    return first_per_key(scored, [owner, "url"], -F.col("score"), F.col("label"))


def best_new_links(scored: DataFrame, known: DataFrame, owner: str = "org_id", k: int | None = L.LINKS_PER_ORG) -> DataFrame:
    """The best links per organisation among addresses it does not list yet."""
    address = A.canonical(F.col("url"))
    listed = known.select(owner, A.canonical(F.col("url")).alias("_address")).distinct()
    fresh = scored.withColumn("_address", address).join(listed, [owner, "_address"], "left_anti")
    return top_k(fresh.drop("_address"), [owner], [F.desc("score"), F.col("url")], k)


def add_sources(sources: DataFrame, candidates: DataFrame, owner: str = "org_id") -> DataFrame:
    """Candidates that are new addresses for their organisation, one per address."""
    have = sources.select(owner, A.canonical(F.col("url")).alias("_address")).distinct()
    fresh = candidates.withColumn("_address", A.canonical(F.col("url"))).join(
        have, [owner, "_address"], "left_anti"
    )
    return first_per_key(fresh, [owner, "_address"], F.col("url")).drop("_address")


def evidence(text: Column) -> Column:
    """``struct<result, marker, quote>``: what a page says about cooperative training.

    The first marker in list order decides; without one the page is watchable if
    it has enough text to watch, else rejected.
    """
    lowered = F.lower(text)
    marker = None
    for phrase in L.EVIDENCE_MARKERS:
        hit = F.contains(lowered, F.lit(phrase))
        marker = F.when(hit, phrase) if marker is None else marker.when(hit, phrase)

    def describe(found: Column) -> Column:
        at = F.instr(lowered, found) - 1
        start = F.greatest(F.lit(0), at - L.EVIDENCE_BEFORE)
        stop = F.least(F.length(text), at + F.length(found) + L.EVIDENCE_AFTER)
        quote = F.concat(
            F.when(start > 0, "…").otherwise(""),
            F.trim(F.substring(text, start + 1, stop - start)),
            F.when(stop < F.length(text), "…").otherwise(""),
        )
        return F.struct(
            F.when(found.isNotNull(), "verified")
            .when(F.length(text) < L.THIN_CHARS, "rejected")
            .otherwise("watchable")
            .alias("result"),
            found.alias("marker"),
            F.when(found.isNotNull(), quote).alias("quote"),
        )

    return X.let(marker, describe)


def candidate_addresses(sources: DataFrame, url: str = "url") -> DataFrame:
    """Every address worth trying for a source, in order: ``position, candidate``."""
    return sources.select("*", F.posexplode(A.address_candidates(F.col(url))).alias("position", "candidate"))


def candidate_outcome(attempts: DataFrame) -> DataFrame:
    """What trying a source's addresses came to.

    ``attempts``: ``org_id, source_url, position, candidate, allowed, refusal, ok,
    status, error, final_url``.  The first address that answers wins, but a source
    that failed without being gone keeps its own address and stays watched.
    """
    at = F.struct("position", "candidate")
    answered = F.col("allowed") & F.col("ok")
    own = F.col("candidate") == F.col("source_url")
    folded = attempts.groupBy("org_id", "source_url").agg(
        F.min_by(F.when(answered, F.coalesce("final_url", "candidate")), F.when(answered, at)).alias("answer"),
        F.min_by(F.when(~F.col("allowed"), F.col("refusal")), F.when(~F.col("allowed"), at)).alias("refusal"),
        F.max_by(F.when(F.col("allowed"), F.col("error")), F.when(F.col("allowed") & ~F.col("ok"), at)).alias("error"),
        F.bool_or(own & F.col("allowed") & ~F.col("ok")).alias("_own_failed"),
        F.max(F.when(own & F.col("allowed") & ~F.col("ok"), F.col("status"))).alias("_own_status"),
        F.bool_or(F.col("allowed")).alias("_tried"),
    )
    gone = F.coalesce(F.col("_own_status").isin(404, 410), F.lit(False))
    transient = F.col("_own_failed") & ~gone
    elsewhere = A.canonical(F.col("answer")) != A.canonical(F.col("source_url"))
    result = (
        F.when(F.col("answer").isNotNull() & transient & elsewhere, "kept_and_added")
        .when(F.col("answer").isNotNull(), "answered")
        .when(~F.col("_tried"), "robots")
        .otherwise("unreachable")
    )
    return folded.withColumn("result", result).drop("_own_failed", "_own_status", "_tried")


def strongest_sources(sources: DataFrame) -> DataFrame:
    """One source per (organisation, address): the verified and confirmed one."""
    strength = F.when(F.col("verified_at").isNotNull(), 2).otherwise(0) + F.when(
        F.coalesce(F.col("coop_confirmed"), F.lit(False)), 1
    ).otherwise(0)
    return first_per_key(
        sources.withColumn("address", A.canonical(F.col("url"))).withColumn("strength", strength),
        ["org_id", "address"], -F.col("strength"), F.col("url"),
    )


def bound_attempts(attempts: DataFrame, k: int | None = L.ATTEMPTS_PER_TARGET) -> DataFrame:
    """The newest attempts of each target."""
    return top_k(attempts, ["target_id"], [F.desc("checked_at"), F.col("url_tried")], k, "_n").drop("_n")


def correct_sources(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply a table of corrections; applying it twice changes nothing.

    ``patches``: ``org_id, url, action`` (add or remove) and the columns an added
    source needs.
    """
    gone = patches.where("action = 'remove'").select("org_id", A.canonical(F.col("url")).alias("_address")).distinct()
    kept = sources.withColumn("_address", A.canonical(F.col("url"))).join(
        gone, ["org_id", "_address"], "left_anti"
    ).drop("_address")
    added = add_sources(kept, patches.where("action = 'add'").drop("action"))
    return kept.unionByName(added.select(*[c for c in kept.columns if c in added.columns]), allowMissingColumns=True)
