"""Table scans, admission of fetches, versions and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file holding one JSON array of records; a byte-order mark is tolerated."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )


def read_landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines; a broken line becomes a row carrying it as ``_corrupt_record``.

    A byte-order mark in front of a file's first line is dropped, lines of white space are
    no rows. Fields that are not in ``schema`` are not read, fields a line lacks are NULL.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line")).where(F.trim("line") != "")
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json("line", f"{schema}, _corrupt_record string", settings).alias("r")).select("r.*")


def admit(fetches: DataFrame) -> DataFrame:
    """Fetches with ``ok`` and ``error`` settled; refused bodies are dropped, not carried on."""
    size = F.coalesce("bytes", F.octet_length("html").cast("long"))
    odd_type = F.col("content_type").isNotNull() & (F.col("content_type") != "") & ~F.col(
        "content_type"
    ).rlike("(?i)html|xml|text/plain")
    error = (
        F.when(~F.col("ok"), F.coalesce("error", F.lit("fetch failed")))
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(
            odd_type,
            F.concat(
                F.lit('unexpected content-type "'), F.substring_index("content_type", ";", 1), F.lit('"')
            ),
        )
        .when(size > L.MAX_PAGE_BYTES, F.lit("page exceeded the 5 MB ceiling while downloading"))
    )
    return (
        fetches.withColumn("error", error)
        .withColumn("ok", F.col("error").isNull())
        .withColumn("html", F.when(F.col("ok"), F.col("html")))
        .withColumn("bytes", size)
    )


def publish(df: DataFrame, path: str, run_id: str) -> None:
    """Write one run's partition.  Spark commits it whole or not at all."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_version(spark: SparkSession, path: str, run_id: str, schema: str) -> DataFrame:
    """One run's rows; partition pruning reads nothing else."""
    return (
        spark.read.schema(f"{schema}, run_id string").parquet(path).where(F.col("run_id") == run_id)
    ).drop("run_id")


def previous_version(versions: DataFrame, current: str) -> DataFrame:
    """The rows of the newest run before ``current``; none on a first run."""
    newest = versions.where(F.col("run_id") < current).agg(F.max("run_id")).scalar()
    return versions.where(F.col("run_id") == newest)


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that appeared and disappeared between two versions of one table.

    Counting signed copies of whole rows needs one shuffle, pre-combined, where
    two set differences would need two.
    """
    columns = before.columns
    signed = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1)))
    net = signed.groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_n", F.lit(0))), F.lit(0)).cast("long").alias("added"),
        F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).cast("long").alias("removed"),
    )


def worth_publishing(summaries: dict[str, DataFrame], reader_tables: list[str], last_published: Column, as_of: Column) -> DataFrame:
    """Publish at once when a table readers see changed, else every 15 minutes."""
    named = [df.withColumn("table", F.lit(name)) for name, df in summaries.items()]
    union = named[0]
    for df in named[1:]:
        union = union.unionByName(df)
    visible = F.col("table").isin(reader_tables) & (F.col("added") + F.col("removed") > 0)
    waited = F.unix_micros(as_of) - F.unix_micros(last_published) >= 15 * 60_000_000
    return union.agg(
        F.bool_or(visible).alias("reader_visible"),
        F.bool_or(F.col("added") + F.col("removed") > 0).alias("any_change"),
    ).withColumn("publish", F.col("reader_visible") | (F.col("any_change") & waited))


def sources_of(orgs: DataFrame) -> DataFrame:
    """One row per (organisation, source), tri-state columns kept as they are."""
    return orgs.select(
        F.col("id").alias("org_id"), "tier", F.posexplode("sources").alias("position", "s")
    ).select("org_id", "tier", "position", "s.*")


def targets(
    orgs: DataFrame, aggregators: DataFrame, only: str | None = None, limit: int | None = None,
    urls: DataFrame | None = None,
) -> DataFrame:
    """Verified organisation sources and aggregator links, narrowed as asked."""
    own = sources_of(orgs).where("verifiedAtISO IS NOT NULL").select(
        "url", F.col("org_id").alias("owner_id"), "renderMode",
        F.coalesce("browserRetryInCI", F.lit(False)).alias("browser_retry"),
    )
    others = aggregators.where("link IS NOT NULL AND link.verifiedAtISO IS NOT NULL").select(
        F.col("link.url").alias("url"), F.col("id").alias("owner_id"),
        F.lit("static").alias("renderMode"), F.lit(False).alias("browser_retry"),
    )
    every = own.unionByName(others)
    if only is not None:
        every = every.where(F.col("owner_id") == only)
    if urls is not None:
        every = every.join(urls.select("url").distinct(), "url", "left_semi")
    return every if limit is None else every.orderBy("owner_id", "url").limit(limit)


def cap_rendered(watched: DataFrame, cap: int | None = L.MAX_RENDERED_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Rendered targets inside the cap (None: all), and the rest as failures that say why."""
    rendered = watched.where("renderMode = 'browser'")
    if cap is None:
        return rendered, rendered.where("false").withColumn("error", F.lit(None).cast("string"))
    inside = rendered.orderBy("url", "owner_id").limit(cap)
    total = rendered.agg(F.count("*")).scalar()
    overflow = rendered.join(inside.select("url", "owner_id"), ["url", "owner_id"], "left_anti").withColumn(
        "error",
        F.concat(
            F.lit("not read this run: "), total.cast("string"),
            F.lit(f" sources need a real browser and the cap is {cap}"),
        ),
    )
    return inside, overflow
