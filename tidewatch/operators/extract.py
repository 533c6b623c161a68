"""Pages to text: title, body, chosen text, blocks, hashes, and whether it reads at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import html as H
from tidewatch.functions import lexicon as L
from tidewatch.functions import text as X


def settled(column: Column) -> Column:
    """The same value, as an expression that nothing is pushed through.

    The optimizer moves filters, also ones it infers, below the projection that
    computes a column and computes it again there.  An id that is never negative
    stops that, so what is expensive runs once per row.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def extract(pages: DataFrame, html: str = "html", once: bool = True) -> DataFrame:
    """Replace the markup column by what a reader would see.

    The hash and the blocks come from the whole body, whichever text is chosen,
    so "did the page move" never depends on how it was read. Without ``once`` nothing
    stops a filter from reading a page again; streams know no such stop.
    """
    markup = pages.withColumn("title", H.page_title(F.col(html))).withColumn(
        "_markup", H.visible_markup(F.coalesce(F.col(html), F.lit("")))
    )
    texts = markup.withColumn("body", H.markup_text(F.col("_markup"))).withColumn(
        "_article", H.article_text(F.col("_markup"))
    )
    body, article = F.col("body"), F.col("_article")
    takes_article = (F.length(article) >= L.MIN_ARTICLE_CHARS) & ~(
        (F.length(body) > F.length(article) * L.BODY_WINS_FACTOR)
        & (F.length(body) > L.MIN_ARTICLE_CHARS)
    )
    read = (
        texts.withColumn("method", F.when(takes_article, "article").otherwise("body_fallback"))
        .withColumn("text", F.when(F.col("method") == "article", article).otherwise(body))
        .withColumn("chars", F.length("text"))
        .withColumn("hash", X.content_hash(body))
        .withColumn("blocks", H.blocks(body))
        .drop(html, "_markup", "_article")
    )
    if not once:
        return read
    made = ["title", "body", "method", "text", "chars", "hash", "blocks"]
    return read.withColumns({c: settled(F.col(c)) for c in made})


def exploded_blocks(extracts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: ``keys, position, block, block_hash``."""
    return extracts.select(
        *keys, F.posexplode("blocks").alias("position", "block")
    ).withColumn("block_hash", X.block_hash(F.col("block")))


def readability(ok: Column, error: Column, refused: Column, title: Column, text: Column) -> Column:
    """``struct<outcome, error>``: the first reason a fetch is not a reading."""
    chars = F.length(text)

    def outcome(name: str, why: Column) -> Column:
        return F.struct(F.lit(name).alias("outcome"), why.cast("string").alias("error"))

    return (
        F.when(~ok, outcome("failed", X.redact_paths(error)))
        .when(refused.isNotNull(), outcome("robots_skip", F.concat(F.lit("robots.txt: "), refused)))
        .when(H.is_soft_404(title), outcome("failed", F.concat(F.lit("soft_404: "), title)))
        .when(H.is_banner_only(text), outcome("unreadable", F.lit("banner_only")))
        .when(
            chars < L.MIN_USABLE_CHARS,
            outcome("unreadable", F.concat(F.lit("extracted only "), chars.cast("string"), F.lit(" chars"))),
        )
        .otherwise(outcome("ok", F.lit(None)))
    )


def reachability(ok: Column, allowed: Column, title: Column, chars: Column) -> Column:
    """The coarse class of one probe of a source."""
    return (
        F.when(~allowed, "ROBOTS_BLOCKED")
        .when(~ok, "UNREACHABLE")
        .when(H.is_soft_404(title), "SOFT_404")
        .when(chars < L.MIN_USABLE_CHARS, "EMPTY")
        .when(chars < L.THIN_PROBE_CHARS, "THIN")
        .otherwise("READ")
    )


def reachability_counts(probes: DataFrame) -> DataFrame:
    return probes.groupBy("reach").agg(F.count("*").alias("sources"))


def misreported(probes: DataFrame, health: DataFrame) -> DataFrame:
    """Sources whose recorded state contradicts today's probe.

    ``false_green`` is recorded healthy and does not read; ``false_red`` is
    recorded otherwise and does.
    """
    joined = probes.join(health.select("url", "state"), "url")
    reads = F.col("reach") == "READ"
    verdict = F.when((F.col("state") == "healthy") & ~reads, "false_green").when(
        (F.col("state") != "healthy") & reads, "false_red"
    )
    return joined.withColumn("misreport", verdict).where("misreport IS NOT NULL")


def unreadable_owners(probes: DataFrame) -> DataFrame:
    """Owners none of whose sources reads today."""
    return (
        probes.groupBy("org_id")
        .agg(F.bool_and(F.col("reach") != "READ").alias("blind"), F.count("*").alias("sources"))
        .where("blind")
        .drop("blind")
    )


def first_difference(a: Column, b: Column) -> Column:
    """Zero-based position of the first differing character; NULL when equal or when either is.

    The common beginning is measured in bytes by halving steps, each of which compares only
    the bytes that come next, so the work is linear in the text. The characters that begin
    in it are then counted; a character of which only the first bytes agree is not among them.
    """

    def place(both: Column) -> Column:
        x, y = both["x"], both["y"]
        shorter = F.least(F.octet_length(x), F.octet_length(y))

        def longer(known: Column, power: Column) -> Column:
            step = F.pow(F.lit(2), power).cast("int")
            same = F.substring(x, known + 1, step) == F.substring(y, known + 1, step)
            return F.when((known + step <= shorter) & same, known + step).otherwise(known)

        powers = F.sequence(F.floor(F.log2(F.greatest(shorter, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

        def characters(common: Column) -> Column:
            inside = F.substring(x, common + 1, F.lit(1)).between(F.unhex(F.lit("80")), F.unhex(F.lit("BF")))
            return F.char_length(F.substring(x, F.lit(1), common).cast("string")) - inside.cast("int")

        return X.let(F.reduce(powers, F.lit(0), longer), characters)

    return F.when(a != b, X.let(F.struct(a.cast("binary").alias("x"), b.cast("binary").alias("y")), place))


def version_difference(versions: DataFrame, before: str = "text_before", after: str = "text_after") -> DataFrame:
    """Where two readings of one page part, with a window of each side."""
    at = F.col("differs_at")
    window_start = F.greatest(at - 40, F.lit(0)) + 1
    window = F.least(at, F.lit(40)) + 140
    return versions.withColumn("differs_at", settled(first_difference(F.col(before), F.col(after)))).select(
        "*",
        F.substring(F.col(before), window_start, window).alias("before_window"),
        F.substring(F.col(after), window_start, window).alias("after_window"),
    )
