"""The one place Python runs per row: asking a judge, and reading its reply.

A judge is any callable over a batch of excerpts.  Asking is expensive and does
not repeat, so replies are checkpointed; parsing and checking them is not, and
stays in expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import focused_excerpt, let, matches, strip, triage_excerpt
from tidewatch.operators.guard import verdict_offences
from tidewatch.session import cut

# judge(excerpts, insist) -> one reply per excerpt; a reply of None is a failed call.
Judge = Callable[[list[str], bool], list[str | None]]

VERDICT_TYPE = (
    "struct<isTrainingAnnouncement:boolean,product:string,titleAr:string,opensISO:string,"
    "closesISO:string,opensRaw:string,closesRaw:string,moreOnPage:boolean,majors:array<string>,"
    "seats:double,stipendSAR:double,durationWeeks:double,cities:array<string>,"
    "statesZeroCoursesRule:boolean,zeroCoursesQuote:string,applyUrl:string>"
)

_TEXT, _TEXTS, _NUMBER, _TRUTH = "^(VOID|STRING)$", "^ARRAY<(VOID|STRING)>$", "^(VOID|BIGINT|DOUBLE|DECIMAL.*)$", "^BOOLEAN$"
# The kind of value each key must hold, as the type a parsed reply reports.
_JSON_KINDS = {
    **dict.fromkeys(["isTrainingAnnouncement", "moreOnPage", "statesZeroCoursesRule"], _TRUTH),
    **dict.fromkeys(["majors", "cities"], _TEXTS),
    **dict.fromkeys(["seats", "stipendSAR", "durationWeeks"], _NUMBER),
    **dict.fromkeys(["titleAr", "opensISO", "closesISO", "opensRaw", "closesRaw", "zeroCoursesQuote", "applyUrl"], _TEXT),
    "product": "^STRING$",
}


def unfence(reply: Column) -> Column:
    return strip(F.regexp_replace(strip(reply), "(?s)^```(?:json)?\\s*(.*?)\\s*```$", "$1"))


def parse_reply(reply: Column, page: Column, error: Column | None = None) -> Column:
    """``struct<ok, stage, reason, verdict>`` of a raw reply; ``error`` says why there is none.

    Exactly the known keys must be present, each of its own kind; an announcement
    needs a title; and everything it copies must be on the page.
    """
    wanted = F.array(*[F.lit(k) for k in L.VERDICT_KEYS])

    def result(stage: str | None, reason: Column, verdict: Column | None = None) -> Column:
        return F.struct(
            F.lit(stage is None).alias("ok"),
            F.lit(stage).cast("string").alias("stage"),
            reason.cast("string").alias("reason"),
            (F.lit(None) if verdict is None else verdict).cast(VERDICT_TYPE).alias("verdict"),
        )

    def against_page(verdict: Column) -> Column:
        return let(
            verdict_offences(page, verdict),
            lambda offences: F.when(
                F.size(offences) > 0,
                result(
                    "schema",
                    F.concat(
                        F.lit("not on the page: "),
                        F.array_join(offences, "; "),
                    ),
                ),
            ).otherwise(result(None, F.lit(None), verdict)),
        )

    def read(parsed: Column) -> Column:
        text, verdict, keys = parsed["text"], parsed["verdict"], parsed["keys"]
        missing, extra = F.array_except(wanted, keys), F.array_except(keys, wanted)
        kinds_ok = F.lit(True)
        for key, kind in _JSON_KINDS.items():
            held = F.schema_of_variant(F.try_variant_get(parsed["tree"], f"$.{key}", "variant"))
            kinds_ok = kinds_ok & F.coalesce(held.rlike(kind), F.lit(False))
        seats, stipend, weeks = verdict["seats"], verdict["stipendSAR"], verdict["durationWeeks"]
        numbers_ok = (
            F.coalesce((seats >= 0) & (seats == F.floor(seats)), F.lit(True))
            & F.coalesce(stipend >= 0, F.lit(True))
            & F.coalesce(weeks >= 0, F.lit(True))
        )
        strings_only = F.coalesce(
            ~F.exists(verdict["majors"], lambda v: v.isNull())
            & ~F.exists(verdict["cities"], lambda v: v.isNull()),
            F.lit(False),
        )
        product_ok = F.coalesce(verdict["product"].isin(L.PRODUCTS), F.lit(False))
        titled = ~verdict["isTrainingAnnouncement"] | (
            F.coalesce(strip(verdict["titleAr"]), F.lit("")) != ""
        )
        return (
            F.when(
                keys.isNull() | verdict.isNull(),
                result("parse", F.concat(F.lit("reply was not JSON: "), F.substring(text, 1, 160))),
            )
            .when(
                F.size(missing) > 0,
                result("schema", F.concat(F.lit("missing "), F.array_join(missing, ", "))),
            )
            .when(
                F.size(extra) > 0,
                result("schema", F.concat(F.lit("unknown "), F.array_join(extra, ", "))),
            )
            .when(
                ~(kinds_ok & numbers_ok & strings_only & product_ok),
                result("schema", F.lit("a value of the wrong kind")),
            )
            .when(
                ~titled,
                result("schema", F.lit("an announcement without a title")),
            )
            .otherwise(let(verdict, against_page))
        )

    def parse(text: Column) -> Column:
        return F.struct(
            text.alias("text"),
            F.from_json(text, VERDICT_TYPE).alias("verdict"),
            F.json_object_keys(text).alias("keys"),
            F.try_parse_json(text).alias("tree"),
        )

    silent = F.lit("the judge did not answer")
    why = silent if error is None else F.coalesce(error, silent)
    return F.when(reply.isNull(), result("api", why)).otherwise(
        let(let(unfence(reply), parse), read)
    )


def ask(questions: DataFrame, judge: Judge, insist: bool, batch: int = 64) -> DataFrame:
    """``fingerprint, excerpt, reply, error``: the judge over Arrow batches, one call per batch.

    A call that raises, or answers another number of questions than it was asked, is
    a NULL reply with its reason, never a failed job.

    The judge's own module travels with it, so executors need not have it installed.
    """
    home = sys.modules.get(getattr(judge, "__module__", None))
    if home is not None and home.__name__ != "__main__":
        register_pickle_by_value(home)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                error = None
                try:
                    replies = list(judge(part["excerpt"].tolist(), insist))
                    if len(replies) != len(part):
                        error = f"{len(replies)} replies to {len(part)} questions"
                except Exception as cause:
                    error = f"{type(cause).__name__}: {cause}"
                if error is not None:
                    replies = [None] * len(part)
                yield part.assign(
                    reply=pd.Series(replies, index=part.index, dtype="object"),
                    error=pd.Series([error] * len(part), index=part.index, dtype="object"),
                )

    return questions.select("fingerprint", "excerpt").mapInPandas(
        run, "fingerprint string, excerpt string, reply string, error string"
    )


def judge_pages(questions: DataFrame, judge: Judge | None, has_profile: bool = True) -> DataFrame:
    """One answer per fingerprint: ``ok, stage, reason, verdict, attempts``.

    The second attempt goes only to what the first got wrong, and insists on the
    format.  Both rounds of replies are checkpointed before they are read, so a
    lost executor never asks again.
    """
    base = questions.select("fingerprint", focused_excerpt(F.col("payload")).alias("excerpt"))
    if judge is None or not has_profile:
        stage = "no_credentials" if judge is None else "no_profile"
        return base.select(
            "fingerprint",
            F.lit(False).alias("ok"),
            F.lit(stage).alias("stage"),
            F.lit("nothing was judged").alias("reason"),
            F.lit(None).cast(VERDICT_TYPE).alias("verdict"),
            F.lit(0).alias("attempts"),
        )

    def read(replies: DataFrame, attempt: int) -> DataFrame:
        return replies.withColumn("_r", parse_reply(F.col("reply"), F.col("excerpt"), F.col("error"))).select(
            "fingerprint", "excerpt", "_r.*", F.lit(attempt).alias("attempts")
        )

    first = read(cut(ask(base, judge, insist=False)), 1)
    again = first.where("NOT ok").select("fingerprint", "excerpt")
    second = read(cut(ask(again, judge, insist=True)), 2)
    return first.where("ok").unionByName(second).drop("excerpt")


def reads_as_no(answer: Column) -> Column:
    """Only a clear "no" drops a page; anything unreadable lets it through."""
    said = F.lower(F.regexp_extract(answer, "(?is)\\{.*?\"candidate\"\\s*:\\s*(true|false).*?\\}", 1))
    bare = matches(answer, f"(?i)^{L.WS}*(?:لا{L.WS}*(?:[.،,!؟]|\\z)|no(?![A-Za-z0-9_])|false)")
    return F.when(said != "", said == "false").otherwise(bare)


def triage(questions: DataFrame, judge: Judge) -> DataFrame:
    """The one-word question first: ``fingerprint, triaged_out``."""
    base = questions.select("fingerprint", triage_excerpt(F.col("payload")).alias("excerpt"))
    replies = cut(ask(base, judge, insist=False))
    return replies.select("fingerprint", F.coalesce(reads_as_no(F.col("reply")), F.lit(False)).alias("triaged_out"))


def stored_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """A judge that replays stored replies: a join, with a failed call where none is stored."""
    base = questions.select("fingerprint", focused_excerpt(F.col("payload")).alias("excerpt"))
    replies = base.join(answers.select("fingerprint", "reply"), "fingerprint", "left")
    return replies.withColumn("_r", parse_reply(F.col("reply"), F.col("excerpt"))).select(
        "fingerprint", "_r.*", F.lit(1).alias("attempts")
    )
