"""Conversations of many layouts as one chat template, with the spans that carry loss.

A record's layout is known by a fingerprint: the hash of the sorted paths of its
fields that hold something. Fingerprints select declarative mappings, which say where
the turns are; a record whose fingerprint no mapping has keeps its row with NULL
turns, so unknown layouts are seen and not lost. DataFrame functions only.

Inside texts control strings are escaped: a backslash goes between ``<`` and ``|``,
and where backslashes stand there already one more is added, so unescaping is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


def field_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, list[str]]]:
    """Every leaf of a schema: its path, and its steps; ``[]`` steps into an array."""
    out = []

    def walk(kind: T.DataType, steps: list[str]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, [*steps, f.name])
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            walk(kind.elementType, [*steps, "[]"])
        else:
            out.append((".".join(steps).replace(".[]", "[]"), steps))

    walk(schema, [prefix] if prefix else [])
    return out


def _holds(value: Column, steps: list[str]) -> Column:
    """Whether anything but NULL is found along the steps."""
    if not steps:
        return value.isNotNull()
    head, rest = steps[0], steps[1:]
    if head == "[]":
        return F.coalesce(F.exists(value, lambda x: _holds(x, rest)), F.lit(False))
    return _holds(value.getField(head), rest)


def paths_of(record: str, schema: T.StructType) -> Column:
    """The sorted paths a record holds, as one string."""
    leaves = sorted(field_paths(schema))
    held = [F.when(_holds(F.col(record), steps), F.lit(path)) for path, steps in leaves]
    return F.concat_ws("|", *held)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def turn(role, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def said(role: str, text: Column) -> Column:
    """An array of one turn."""
    return F.array(turn(role, text))


@dataclass(frozen=True)
class Mapping:
    """``needs``: paths a layout always has; ``may``: paths it can lack; ``turns``: the canonical turns."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Column], Column]

    def fingerprints(self) -> list[str]:
        optional = (c for n in range(len(self.may) + 1) for c in combinations(self.may, n))
        return [fingerprint_of([*self.needs, *some]) for some in optional]


def _listed(field: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    def turns(r: Column) -> Column:
        def one(m: Column) -> Column:
            who = m.getField(role)
            for old, new in (names or {}).items():
                who = F.when(m.getField(role) == old, F.lit(new)).otherwise(who)
            return turn(who, m.getField(text))

        return F.transform(r.getField(field), one)

    return turns


def _instruction(r: Column) -> Column:
    extra = r.getField("input")
    asked = F.concat(r.getField("instruction"), F.when(extra.isNotNull(), F.concat(F.lit("\n\n"), extra)).otherwise(""))
    system = F.when(r.getField("system").isNotNull(), said("system", r.getField("system"))).otherwise(F.array().cast(TURN))
    return F.concat(system, said("user", asked), said("assistant", r.getField("output")))


MAPPINGS = (
    Mapping(
        "prompt", ("prompt", "completion"), (),
        lambda r: F.concat(said("user", r.getField("prompt")), said("assistant", r.getField("completion"))),
    ),
    Mapping("instruction", ("instruction", "output"), ("system", "input"), _instruction),
    Mapping("messages", ("messages[].role", "messages[].content"), (), _listed("messages", "role", "content")),
    Mapping(
        "shares", ("conversations[].from", "conversations[].value"), (),
        _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    ),
)
#: The schema that holds every known layout; a reader of JSON lines makes the same one.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "completion", "system", "instruction", "input", "output")]
    + [
        T.StructField(n, T.ArrayType(T.StructType([T.StructField(a, T.StringType()), T.StructField(b, T.StringType())])))
        for n, a, b in (("messages", "role", "content"), ("conversations", "from", "value"))
    ]
)


def canonical_turns(records: DataFrame, record: str, mappings=MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` and ``turns``; an unknown layout has NULL in both.

    ``record`` is a struct column. Only mappings whose fields the struct has are tried.
    """
    schema = records.schema[record].dataType
    there = {path for path, _ in field_paths(schema)}
    fingerprint = F.sha2(paths_of(record, schema), 256)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for m in mappings:
        if there.issuperset([*m.needs, *m.may]):
            known = F.col("_fingerprint").isin(m.fingerprints())
            layout = F.when(known, F.lit(m.name)).otherwise(layout)
            turns = F.when(known, m.turns(F.col(record))).otherwise(turns)
    return records.withColumn("_fingerprint", fingerprint).withColumns({"layout": layout, "turns": turns}).drop("_fingerprint")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role stands on its line: line breaks in it are written as ``\\n``, backslashes doubled."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(text: Column) -> Column:
    plain = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    return unescaped(F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\")))


def formatted(records: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``records`` with ``formatted`` and ``loss_spans`` in place of ``turns``.

    A span is ``turn, start, stop``: code points inside the turn's own segment of the
    output (from its start mark to before its end mark), the text of one turn whose
    role is in ``learn``. NULL turns give NULL.
    """
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"),
            escaped(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn"),
        ),
    )
    spans = F.filter(
        F.transform(
            "_segments",
            lambda s, i: F.struct(
                i.alias("turn"), F.char_length(s["head"]).alias("start"),
                (F.char_length(s["head"]) + F.char_length(s["body"])).alias("stop"), s["learn"].alias("learn"),
            ),
        ),
        lambda s: s["learn"],
    )
    whole = F.array_join(F.transform("_segments", lambda s: F.concat(s["head"], s["body"], F.lit(END + "\n"))), "")
    return (
        records.withColumn("_segments", segments)
        .withColumns({
            "formatted": whole,
            "loss_spans": F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["stop"].alias("stop"))),
        })
        .drop("_segments", "turns")
    )


def _segments(text: Column) -> Column:
    """The turns' segments; an escaped text holds no end mark, so a split finds only real ones."""
    parts = F.split(text, r"<\|im_end\|>\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def parsed(text: Column) -> Column:
    """The turns read back from formatted output."""

    def one(segment: Column) -> Column:
        line = F.substring_index(segment, "\n", 1)
        body = F.substring(segment, F.char_length(line) + F.lit(2), F.char_length(segment))
        role = F.substring(line, F.lit(len(START) + 1), F.char_length(line))
        return F.struct(_role_in(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(_segments(text), one)


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one array entry per span."""
    segments = _segments(text)
    return F.transform(
        spans,
        lambda s: unescaped(F.substring(F.element_at(segments, s["turn"] + 1), s["start"] + 1, s["stop"] - s["start"])),
    )


def by_rows(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, record`` from one row per turn: turns in order, NULL order last, ties by role and text.

    A user asking once is a prompt record, a system note before that an instruction
    record, everything else a list of messages. One conversation becomes one record,
    as long as it is.
    """
    t = F.struct(
        F.col("turn").isNull().alias("none"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(t)).alias("_t"))
    roles = F.transform("_t", lambda x: x["role"])
    text = lambda i: F.get("_t", F.lit(i))["text"]
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    noted = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    many = F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    fields = {
        "prompt": F.when(pair, text(0)), "completion": F.when(pair, text(1)),
        "system": F.when(noted, text(0)), "instruction": F.when(noted, text(1)), "output": F.when(noted, text(2)),
        "messages": F.when(~pair & ~noted, many),
    }
    made = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]
    return rows.select(key, F.struct(*made).alias("record"))


def report(output: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from ``formatted`` and ``loss_spans``: counts and digests of turns and of the text that carries loss."""
    read = output.withColumn("_turns", parsed(F.col("formatted"))).withColumn(
        "_loss", F.array_join(masked_text(F.col("formatted"), F.col("loss_spans")), "")
    )
    joined = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key, F.size("_turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, layout, formatted, loss_spans`` from rows ``conv_id, turn, role, text``.

    Null role and text are empty. Rows without a conv_id are one conversation. Rows
    that repeat a turn are all kept, in order of role and text. Other columns are not read.
    """
    return formatted(canonical_turns(by_rows(turns), "record")).drop("record")
