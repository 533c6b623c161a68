"""Mixing sources to target weights by balanced sampling (the cube method).

A source's documents are all taken at the same rate: as many whole copies as it has,
and one more with the probability of its fraction. Which documents get the extra copy
is settled by the flight phase of the cube method: probabilities move along directions
that leave the source's words and its number of documents unchanged, until they are
zero or one. Three open documents and two totals always leave a direction, so a block
of documents ends with two open ones at most. Blocks of a source fly apart, their
remainders meet in fewer blocks, and so on until two at most are left of a source;
these are the landing, settled by whichever choice comes nearest to the totals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, unused

#: Weights by the rank of a source, repeating, and how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
_BLOCK = 1024
_TINY = 1e-9
_SCHEMA = "source_no int, n long, doc_id long, size long, chance double, draw double, last boolean, taken boolean"


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_no, source_size, docs, target`` from ``source, size``.

    Sources share all words by weight; what a source cannot use, being ``most`` times
    its own size, is shared by the others again. Closed form: in order of limit over
    weight, sources are full until the level the rest would reach is within their own
    limit. The windows run over one row per source.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("source_no", F.row_number().over(named)).withColumn(
        "weight", F.element_at(table, F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1)
    )
    limit = (F.col("source_size") * most).cast("double")
    each = each.withColumn("limit", limit).withColumn("reach", F.col("limit") / F.col("weight"))
    order = Window.orderBy("reach", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    each = each.withColumn("level", level)
    within = F.when(F.col("level") <= F.col("reach"), F.struct("reach", "source_no", "level"))
    each = each.withColumn("level", F.min(within).over(everything)["level"])
    target = F.least("limit", F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return each.select("source", "source_no", "source_size", "docs", target.alias("target"))


def _direction(size: list[float]) -> list[float]:
    """A move that keeps both totals: the cross product of the sizes and of ones."""
    if len(size) == 2:
        return [1.0, -1.0] if size[0] == size[1] else []
    a, b, c = size
    if a == b:
        return [1.0, -1.0, 0.0]
    return [b - c, c - a, a - b]


def flight(size: np.ndarray, chance: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Chances after the flight: zero or one but for two documents at most.

    Documents come in the order given, so the last ones are those left open. ``draw``
    (0 to 1, one per document) decides which way a move goes, in such proportion that
    every document keeps its chance.
    """
    out = chance.astype(float).copy()
    held: list[int] = []
    for i in range(len(out)):
        if _TINY < out[i] < 1 - _TINY:
            held.append(i)
        else:
            out[i] = round(out[i])
            continue
        while held:
            if len(held) < 2 or (len(held) == 2 and size[held[0]] != size[held[1]]):
                break
            step = _direction([float(size[k]) for k in held])
            up = down = np.inf
            for k, u in zip(held, step):
                if u > 0:
                    up, down = min(up, (1 - out[k]) / u), min(down, out[k] / u)
                elif u < 0:
                    up, down = min(up, out[k] / -u), min(down, (1 - out[k]) / -u)
            by = up if draw[i] < down / (up + down) else -down
            for k, u in zip(held, step):
                out[k] += by * u
            for k in list(held):
                if out[k] <= _TINY or out[k] >= 1 - _TINY:
                    out[k] = round(out[k])
                    held.remove(k)
    return out


def landing(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Zero or one for the few documents left: nearest in words, then in number, then fewest."""
    k = len(size)
    choices = [[(m >> i) & 1 for i in range(k)] for m in range(1 << k)]
    off = lambda c: (abs(float(np.dot(c - chance, size))), abs(float(np.sum(c - chance))), float(np.sum(c)))
    return np.array(min((np.array(c, float) for c in choices), key=lambda c: (*off(c), *c)))


def _fly(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
    size = rows["size"].to_numpy(float)
    out = flight(size, rows["chance"].to_numpy(float), rows["draw"].to_numpy(float))
    if rows["last"].iloc[0]:
        open_ = np.flatnonzero((out > 0) & (out < 1))
        out[open_] = landing(size[open_], out[open_])
    done = (out == 0) | (out == 1)
    taken = [bool(v) if d else None for v, d in zip(out, done)]
    return rows.assign(chance=out, taken=pd.array(taken, "boolean"))[["source_no", "n", "doc_id", "size", "chance", "draw", "last", "taken"]]


def balanced(rows: DataFrame, blocks: int) -> DataFrame:
    """Settle every row's chance; ``rows``: source_no, n (rows of the source), doc_id, size, chance, draw.

    ``blocks`` is the number of blocks the largest source needs; each level leaves
    two rows of a block, so levels are few however many rows there are.
    """
    settled, level = None, 0
    while True:
        level += 1
        parts = F.ceil(F.col("n") / _BLOCK)
        dealt = rows.withColumns({
            "last": parts == 1, "block": F.pmod(F.xxhash64("doc_id", "draw", F.lit(level)), parts),
        })
        flown = stored(dealt.groupBy("source_no", "block").applyInPandas(_fly, _SCHEMA), f"flight{level}")
        done = flown.where("taken IS NOT NULL")
        settled = done if settled is None else settled.unionByName(done)
        if blocks == 1:
            return settled
        # A block leaves two rows at most, so this bounds what is left of each source.
        left = flown.where("taken IS NULL").withColumn("n", 2 * F.ceil(F.col("n") / _BLOCK))
        rows, blocks = left.drop("taken", "last"), -(-2 * blocks // _BLOCK)


def mixture(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row.

    ``size`` counts words; null texts have none. ``taken`` is ``copies`` times the
    size. Reruns agree: draws are hashes of the doc_id. Rows that repeat a doc_id are
    documents of their own. An empty table, or texts without words, take nothing.
    Other columns are not read.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", words.alias("size")), "sizes")
    goal = stored(targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _TINY))
    goal = goal.withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    beside = sized.withColumnRenamed("source", "_s").join(goal, F.col("_s").eqNullSafe(F.col("source")))
    rows = beside.select("source_no", F.col("docs").alias("n"), "doc_id", "size", "chance", draw.alias("draw"))
    most = goal.agg(F.max("docs")).first()[0] or 1
    settled = balanced(rows, -(-most // _BLOCK))
    copies = F.col("whole") + F.col("taken").cast("long")
    return settled.join(goal.select("source_no", "source_size", "target", "whole"), "source_no").select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents the mix takes, with ``size, source_size, target, taken, copies`` after their columns.

    A document stands once, ``copies`` says how often it is taken. Rows that repeat a
    doc_id are taken alike, as often as any of them is. Given columns of one of these names
    are kept as ``given_<name>``.
    """
    extra = ["size", "source_size", "target", "taken", "copies"]
    given = {c: unused([*docs.columns, *extra], f"given_{c}")[0] for c in docs.columns if c.lower() in extra}
    docs = docs.withColumnsRenamed(given)
    row, figures = unused([*docs.columns, *extra], "row", "figures")
    found = mixture(docs, seed).where("copies > 0").withColumnRenamed("doc_id", row)
    each = found.groupBy(row).agg(F.max(F.struct("copies", *[c for c in extra if c != "copies"])).alias(figures))
    joined = docs.join(each, F.col("doc_id").eqNullSafe(F.col(row)))
    return joined.select(*docs.columns, *[F.col(figures)[c].alias(c) for c in extra])
