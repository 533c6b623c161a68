"""Text scalars: squashing, folding, hashing, excerpts, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L


#: Letters and marks that spelling may change.
ARABIC = f"[\\u0600-\\u06FF]|{L.ZERO_WIDTH}"


def matches(col: Column, pattern: str) -> Column:
    """Pattern found anywhere in the text; NULL text is simply not a match."""
    return F.coalesce(col.rlike(pattern), F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def squash(col: Column) -> Column:
    # Printable ASCII is skipped on one range test and a lone space stays as it is,
    # so ordinary prose is hardly looked at and never rewritten.
    return F.trim(F.regexp_replace(col, f"(?![!-~])(?: {{2,}}|(?! ){L.WS}+ *| {L.WS}+)(?:{L.WS}+)?", " "))


def strip(col: Column) -> Column:
    """Trim the same white space a browser trims, at both ends."""
    return F.regexp_replace(col, f"^{L.WS}+|{L.WS}+$", "")


def blank_to_null(col: Column) -> Column:
    return let(col, lambda value: F.when(value != "", value))


def western_digits(col: Column) -> Column:
    """Arabic-Indic and Persian digits become ASCII digits."""
    return F.translate(col, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def fold_letters(col: Column) -> Column:
    """Alef forms, final ya and ta marbuta written one way."""
    return F.translate(col, "أإآٱىة", "اااايه")


def normalise_arabic(col: Column) -> Column:
    """One spelling for wording that a page and a reply may write differently.

    Short vowels and elongation go, letter variants fold, invisible marks go, and
    a preposition or conjunction glued to the article is dropped so the word
    compares equal with and without it. Text without Arabic letters and invisible marks
    only has its white space and case to be settled.
    """

    def spelled(text: Column) -> Column:
        out = F.regexp_replace(text, "[\\u064B-\\u0652\\u0670\\u0640]", "")
        out = fold_letters(out)
        out = F.regexp_replace(out, L.ZERO_WIDTH, "")
        out = F.regexp_replace(out, f"(^|{L.WS})لل", "$1ال")
        out = F.regexp_replace(out, f"(^|{L.WS})[وف]?[بكل]ال", "$1ال")
        return F.lower(squash(out))

    return let(col, lambda text: F.when(text.rlike(ARABIC), spelled(text)).otherwise(F.lower(squash(text))))


def fold_title(col: Column) -> Column:
    """A title reduced to its letters and digits, for grouping announcements."""
    out = F.regexp_replace(col, "[\\u064B-\\u0652\\u0640]", "")
    out = fold_letters(out)
    out = F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " ")
    return F.lower(F.trim(out))


def fold_name(col: Column) -> Column:
    """An organisation's name without its word-initial articles."""
    out = F.regexp_replace(col, "[\\u064B-\\u0652\\u0640]", "")
    out = fold_letters(out)
    out = F.regexp_replace(out, "(^| )ال", "$1")
    return squash(out)


def count_of(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def arabic_letters(col: Column) -> Column:
    return count_of(col, "[\\u0600-\\u06FF]")


def latin_letters(col: Column) -> Column:
    return count_of(col, "[A-Za-z]")


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def block_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, L.BLOCK_HASH_HEX)


def fingerprint(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, L.FINGERPRINT_HEX)


def mentions_training(col: Column) -> Column:
    return matches(col, L.any_of(L.TRAINING_WORDS))


def position_of(text: Column, pattern: str) -> Column:
    """Zero-based position of the first match, -1 when there is none."""
    return F.coalesce(F.regexp_instr(text, F.lit(pattern)) - 1, F.lit(-1))


EXCERPT_WORD = L.any_of(L.EXCERPT_WORDS)
DATE_SHAPED = L.any_of(
    [
        f"[0-9]{{1,4}}{L.WS}*[/\\-.]{L.WS}*[0-9]{{1,2}}{L.WS}*[/\\-.]{L.WS}*[0-9]{{1,4}}",
        f"[0-9]{{1,2}}{L.WS}*(?:[-/]|{L.WS}){L.WS}*(?:" + "|".join(L.EXCERPT_MONTHS) + ")",
        *map(L.spaced, L.DEADLINE_PHRASES),
    ]
)


def triage_excerpt(text: Column, head_chars: int = L.TRIAGE_HEAD, around_chars: int = L.TRIAGE_AROUND) -> Column:
    """The head of a page, plus a window round its training word when that is deeper."""
    head = F.substring(text, 1, head_chars)

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - around_chars // 2)
        around = F.substring(text, start + 1, F.lit(around_chars))
        return F.when(at < head_chars, head).otherwise(
            F.concat(head, F.lit(L.EXCERPT_SEPARATOR), around)
        )

    return let(position_of(text, EXCERPT_WORD), cut)


def focused_excerpt(text: Column, budget: int = L.MAX_EXCERPT_CHARS) -> Column:
    """At most ``budget`` characters, spent where an announcement states itself.

    Half the budget goes to the head when a date-shaped passage exists, two
    thirds when none does; what is left is shared by windows round the first
    training word and the first date the head does not already cover.
    """
    sep = len(L.EXCERPT_SEPARATOR)

    def plan(found: Column) -> Column:
        word, date = found["word"], found["date"]
        head = F.when(date >= 0, F.lit(int(budget * 0.5))).otherwise(F.lit(int(budget * 0.66)))
        wants_word, wants_date = word >= head, date >= head
        first = F.floor((budget - head - sep) / F.when(wants_word & wants_date, 2).otherwise(1))
        rest = F.when(wants_word, budget - head - first - 2 * sep).otherwise(budget - head - sep)
        return F.struct(
            word.alias("word"), date.alias("date"), head.cast("int").alias("head"),
            F.when(wants_word, first).otherwise(0).cast("int").alias("word_share"),
            F.when(wants_date, rest).otherwise(0).cast("int").alias("date_share"),
        )

    def window(head: Column, at: Column, size: Column) -> Column:
        start = F.greatest(head, at - F.floor(size / 3).cast("int"))
        piece = F.concat(F.lit(L.EXCERPT_SEPARATOR), F.substring(text, start + 1, size))
        return F.when(size > 0, piece).otherwise("")

    def cut(p: Column) -> Column:
        whole = F.concat(
            F.substring(text, F.lit(1), p["head"]),
            window(p["head"], p["word"], p["word_share"]),
            window(p["head"], p["date"], p["date_share"]),
        )
        plain = (p["word"] < 0) & (p["date"] < 0)
        return F.when(plain, F.substring(text, 1, budget)).otherwise(whole)

    found = F.struct(
        position_of(text, EXCERPT_WORD).alias("word"), position_of(text, DATE_SHAPED).alias("date")
    )
    return F.when(F.length(text) <= budget, text).otherwise(let(let(found, plan), cut))


# Each captures the last segment of the path it matches.
_LOCAL_PATHS = [
    "(?<![A-Za-z0-9])[A-Za-z]:[\\\\/]+(?:([^\\s\\\\/:*?\"<>|]++)[\\\\/]*+)*+",
    "(?<![A-Za-z0-9_\\\\])\\\\\\\\(?:([^\\s\\\\]++)(?:\\\\(?=[^\\s\\\\]))?+)++",
    "(?<![A-Za-z0-9_/:])/(?:home|Users|root)/(?:/*+([^\\s:\"'/]++))++/*+",
]


def redact_paths(col: Column) -> Column:
    """Local file paths keep only their last segment; web addresses are untouched."""
    out = col
    for pattern in _LOCAL_PATHS:
        out = F.regexp_replace(out, pattern, f"{L.REDACTED}/$1")
    return F.regexp_replace(out, "(\\[مسار محلي\\])/(?=[\\s:\"']|$)", "$1")


def names_local_path(col: Column) -> Column:
    found = F.lit(False)
    for pattern in _LOCAL_PATHS:
        found = found | matches(col, pattern)
    return found


def counted(n: Column, one: str, two: str, many: str) -> Column:
    """A count in words: one, two, a few and many take different forms."""
    return (
        F.when(n == 1, F.lit(f"{one} واحدة"))
        .when(n == 2, F.lit(two))
        .when(n.between(3, 10), F.concat(n.cast("string"), F.lit(f" {many}")))
        .otherwise(F.concat(n.cast("string"), F.lit(f" {one}")))
    )


def shorten(col: Column, limit: int) -> Column:
    """Cut on a word boundary and mark the cut."""
    cut = F.substring(col, 1, limit)
    last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    kept = F.when(last_space > limit * 0.5, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.rtrim(kept), F.lit("…")))
