"""Landed sitemaps: what a site declares, what of it is new, why nothing came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import html as H
from tidewatch.functions import lexicon as L
from tidewatch.functions.text import blank_to_null, squash
from tidewatch.operators.spread import first_per_key, top_k
from tidewatch.session import cut


def _entries(xml: Column, tag: str) -> Column:
    """``array<struct<loc, lastmod>>`` of the ``tag`` elements that carry a location."""
    elements = F.regexp_extract_all(
        xml, F.lit(f"(?is)<(?:\\w+:)?{tag}\\b[^>]*>(.*?)</(?:\\w+:)?{tag}\\s*>"), F.lit(1)
    )

    def value(element: Column, name: str) -> Column:
        raw = F.regexp_extract(element, f"(?is)<(?:\\w+:)?{name}\\b[^>]*>(.*?)</(?:\\w+:)?{name}\\s*>", 1)
        bare = F.regexp_replace(raw, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1")
        return blank_to_null(squash(H.decode_entities(bare)))

    described = F.transform(
        elements,
        lambda e: F.struct(value(e, "loc").alias("loc"), value(e, "lastmod").alias("lastmod")),
    )
    return F.filter(described, lambda e: e["loc"].isNotNull())


def parse(files: DataFrame) -> DataFrame:
    """Landed files (``url, ok, refused, body``) with ``outcome, urls, children``."""
    body = F.col("body")
    is_set = F.coalesce(body.rlike("(?i)<(?:\\w+:)?urlset"), F.lit(False))
    is_index = F.coalesce(body.rlike("(?i)<(?:\\w+:)?sitemapindex"), F.lit(False))
    closed = F.coalesce(body.rlike("(?i)</(?:\\w+:)?(?:urlset|sitemapindex)\\s*>\\s*$"), F.lit(False))
    outcome = (
        F.when(F.col("refused"), "robots_blocked")
        .when(~F.col("ok"), "unreachable")
        .when(~(is_set | is_index), "no_sitemap_published")
        .when(~closed, "malformed")
        .otherwise("read")
    )
    none = F.array().cast("array<struct<loc:string,lastmod:string>>")
    read = F.col("outcome") == "read"
    return (
        files.withColumn("outcome", outcome)
        .withColumn("urls", F.when(read & is_set, _entries(body, "url")).otherwise(none))
        .withColumn("children", F.when(read & is_index, _entries(body, "sitemap")).otherwise(none))
        .drop("body")
    )


def expand(
    roots: DataFrame, files: DataFrame, most: int | None = L.MAX_URLS_PER_SITEMAP
) -> tuple[DataFrame, DataFrame]:
    """Follow indexes two levels down over landed files.

    ``roots``: ``origin, url`` of each origin's own sitemaps.  Returns the declared
    entries ``origin, loc, lastmod`` (distinct, at most ``most`` an origin, None: all)
    and one outcome per origin with ``declared`` and ``left_out``, how many of its
    entries stand and how many the bound leaves out.

    Which file names which is parsed once and kept as slim edges; a frontier of files
    walks over them, and entries are only read of files it reached.
    """
    parsed = parse(files)
    edges = cut(parsed.select("url", F.transform("children", lambda c: c["loc"]).alias("children")).where(F.size("children") > 0))
    level = roots.select("origin", "url").distinct()
    walked = level.withColumn("depth", F.lit(0))
    for depth in range(1, L.MAX_SITEMAP_DEPTH + 1):
        level = level.join(edges, "url").select("origin", F.explode("children").alias("url")).distinct()
        walked = walked.unionByName(level.withColumn("depth", F.lit(depth)))
    # A file reached twice is read once.
    reached = walked.select("origin", "url").distinct()
    seen = reached.join(parsed.drop("children"), "url", "left").select(
        "origin", "url", F.coalesce("outcome", F.lit("unreachable")).alias("outcome"), "urls"
    )
    listed = seen.select("origin", "url", F.posexplode("urls").alias("position", "e")).select(
        "origin", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("lastmod"), "url", "position"
    )
    distinct = first_per_key(listed, ["origin", "loc"], F.col("url"), F.col("position"))
    bounded = distinct if most is None else top_k(distinct, ["origin"], [F.col("url"), F.col("position")], most, "_n")
    declared = distinct.groupBy("origin").agg(F.count("*").alias("declared"))
    over = F.lit(0) if most is None else F.greatest(F.col("declared") - most, F.lit(0))
    told = outcomes(seen).join(declared, "origin", "left").withColumn("declared", F.coalesce("declared", F.lit(0)))
    return bounded.select("origin", "loc", "lastmod"), told.withColumn("left_out", over.cast("long"))


def outcomes(read_files: DataFrame) -> DataFrame:
    """Why an origin yielded what it did: anything listed is ``read``, else the gravest reason."""
    listed = F.bool_or(F.coalesce(F.size("urls"), F.lit(0)) > 0)

    def seen(name: str) -> Column:
        return F.bool_or(F.col("outcome") == name)

    return read_files.groupBy("origin").agg(
        F.when(listed, "read")
        .when(seen("robots_blocked"), "robots_blocked")
        .when(seen("unreachable"), "unreachable")
        .when(seen("malformed"), "malformed")
        .otherwise("no_sitemap_published")
        .alias("outcome")
    )


def feeds(pages: DataFrame) -> DataFrame:
    """The first feed each origin's page declares, absolute."""
    found = (
        pages.select(A.origin(F.col("url")).alias("origin"), "url", F.posexplode(H.feed_links(F.col("html"))).alias("position", "href"))
        .withColumn("feed_url", A.resolve(F.col("href"), F.col("url")))
        .where("feed_url IS NOT NULL")
    )
    return first_per_key(
        found.select("origin", "feed_url", "url", "position"), ["origin"], F.col("url"), F.col("position")
    ).select("origin", "feed_url")


def url_fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def novelty(
    entries: DataFrame, seen: DataFrame, known: DataFrame, most: int | None = L.MAX_NEW_PER_ORG
) -> DataFrame:
    """Training urls with what becomes of each: baseline, carried, surfaced or held.

    ``entries``: ``org_id, origin, loc``; ``seen``: ``org_id, origin,
    fingerprint``; ``known``: ``org_id, origin`` read before.  A first reading is
    only a baseline; later at most ``most`` unseen urls surface (None: all), and the
    ones held back stay unseen and are returned as held.
    """
    keys = ["org_id", "origin"]
    training = (
        entries.where(A.looks_like_training(F.col("loc")))
        .withColumn("fingerprint", url_fingerprint(F.col("loc")))
        .select(*keys, "loc", "fingerprint")
        .distinct()
    )
    before = seen.select(*keys, "fingerprint").distinct().withColumn("_seen", F.lit(True))
    read = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = training.join(before, [*keys, "fingerprint"], "left").join(read, keys, "left")
    unseen = marked.where("_known AND _seen IS NULL").select(*keys, "loc")
    surfaced = top_k(unseen, keys, [F.col("loc")], most, "_n").select(
        *keys, "loc", F.lit(True).alias("_surfaced")
    )
    fate = (
        F.when(F.col("_known").isNull(), "baseline")
        .when(F.col("_seen"), "carried")
        .when(F.col("_surfaced"), "surfaced")
        .otherwise("held")
    )
    return (
        marked.join(surfaced, [*keys, "loc"], "left")
        .withColumn("fate", fate)
        .drop("_seen", "_known", "_surfaced")
    )


def seen_after(fates: DataFrame) -> DataFrame:
    """The seen set to remember: still declared and seen, or surfaced now."""
    return fates.where("fate <> 'held'").select("org_id", "origin", "fingerprint")
