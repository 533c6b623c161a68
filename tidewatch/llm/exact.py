"""Exact duplicates, with the very frequent digests taken out before the shuffle.

A Misra-Gries pass over the digests (Spark's ``freqItems``) names every digest that
more than a given share of the rows has, and some that have less. Exact counts keep
the real ones; their winners, at most ``1 / support`` rows, are broadcast, so all
copies of a frequent text are settled where they lie. What is left has no frequent
digest, and is grouped and joined by digest in the ordinary way. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANKS, stored


def without_blanks(text: Column) -> Column:
    """The text with every white space character of the contract deleted."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def winners(slim: DataFrame) -> DataFrame:
    """Per digest: the row that stays (most code points, then smallest doc_id) and the group's size.

    A doc_id of NULL counts as the largest.
    """
    better = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    return slim.groupBy("digest").agg(F.min(better).alias("_best"), F.count("*").alias("group_size")).select(
        "digest", F.col("_best.doc_id").alias("keep_id"), "group_size"
    )


def frequent_digests(slim: DataFrame, support: float) -> DataFrame:
    """Candidates for digests of more than ``support`` of the rows; about 1 / support of them at most.

    The pass counts 64-bit hashes of the digests (it cannot compare binary values);
    a hash stands for every digest that has it, and exact counts follow.
    """
    found = slim.select(F.xxhash64("digest").alias("h")).stat.freqItems(["h"], support)
    return found.select(F.explode(F.col("h_freqItems")).alias("h")).distinct()


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.005
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, dropped ones too.

    Texts are equal when they are identical without white space; a null text equals
    an empty one. ``support`` only moves work between the two ways, never the result.
    Rows that repeat a doc_id within a group are all marked as the row that stays.
    An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(without_blanks(text), 256)).alias("digest"),
            F.char_length(text).alias("chars"),
        ),
        "digests",
    )
    candidates = stored(frequent_digests(slim, support), "candidates")
    heavy = stored(winners(slim.withColumn("h", F.xxhash64("digest")).join(F.broadcast(candidates), "h")), "heavy")
    settled = slim.join(F.broadcast(heavy), "digest")
    rest = slim.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    ordinary = rest.join(winners(rest), "digest")
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return settled.select(columns).unionByName(ordinary.select(columns)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
