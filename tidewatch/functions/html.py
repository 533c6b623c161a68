"""Page markup to text, as one chain of JVM-side expressions per page."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import blank_to_null, let, matches, squash, strip


def _without(col: Column, tags: list[str], to_end: bool = False) -> Column:
    """Drop elements with their content; raw text runs to the end if never closed."""
    end = "|\\z" if to_end else ""
    return F.regexp_replace(col, f"(?is)<({'|'.join(tags)})\\b[^>]*>.*?(?:</\\1\\s*>{end})", "")


_FOLD = "struct<out:array<string>,kinds:array<string>,at:array<int>>"


def without_elements(col: Column, tags: list[str]) -> Column:
    """Drop elements with their content, each up to its own closing tag however they are nested.

    The markup is cut at the tags of these kinds and folded once: a start tag remembers
    how much stands before it, a closing tag of a kind that is open takes away all that
    has come since the innermost one began (and closes what is open inside it). A closing
    tag of nothing open is ignored; an element that is never closed hides nothing.
    """
    names = "|".join(tags)
    pieces = F.transform(
        F.split(col, f"(?i)(?=</?(?:{names})(?![\\w-]))"),
        lambda piece: F.struct(
            F.lower(F.regexp_extract(piece, f"(?i)^</?({names})(?![\\w-])", 1)).alias("kind"),
            piece.startswith("</").alias("closes"),
            piece.rlike("(?i)^<svg[^>]*/>").alias("empty"),
            piece.alias("piece"),
        ),
    )

    def step(done: Column, piece: Column) -> Column:
        out, kinds, at = done["out"], done["kinds"], done["at"]
        back = F.array_position(F.reverse(kinds), piece["kind"])
        last = (F.size(kinds) - back + 1).cast("int")
        shut = piece["closes"] & (back > 0)
        opened = (piece["kind"] != "") & ~piece["closes"] & ~piece["empty"]
        rest = F.when(piece["kind"] == "", piece["piece"]).otherwise(F.regexp_replace(piece["piece"], "^</?[a-zA-Z]+[^>]*>", ""))
        before = F.when(shut, F.slice(out, F.lit(1), F.get(at, last - 1))).otherwise(out)
        return F.struct(
            F.concat(before, F.array(rest)).alias("out"),
            F.when(shut, F.slice(kinds, F.lit(1), last - 1)).when(opened, F.array_append(kinds, piece["kind"])).otherwise(kinds).alias("kinds"),
            F.when(shut, F.slice(at, F.lit(1), last - 1)).when(opened, F.array_append(at, F.size(out))).otherwise(at).alias("at"),
        ).cast(_FOLD)

    nothing = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("kinds"), F.array().cast("array<int>").alias("at"))
    folded = F.array_join(F.aggregate(pieces, nothing.cast(_FOLD), step, lambda done: done["out"]), "")
    return F.when(col.rlike(f"(?i)</(?:{names})(?![\\w-])"), folded).otherwise(col)


# Every named reference of the standard, from Python's own table; names do not overlap
# with their characters, so two joined strings make one constant map.
_NAMES = sorted(n for n in html5 if n.endswith(";"))
_COMMON = ["amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "middot;"]


def _named(token: Column) -> Column:
    """The characters a name stands for, NULL for an unknown one; the usual names are tried first."""

    def table(names: list[str]) -> Column:
        return F.map_from_arrays(
            F.split(F.lit(" ".join(names)), " "), F.split(F.lit("\x01".join(html5[n] for n in names)), "\x01")
        )

    return F.coalesce(F.try_element_at(table(_COMMON), token), F.try_element_at(table(_NAMES), token))


def decode_entities(col: Column) -> Column:
    """Named and numeric character references, each decoded once."""

    def piece(part: Column, i: Column) -> Column:
        token = F.regexp_extract(part, "^(?:#?[A-Za-z0-9]{1,31};|amp)", 0)
        named = F.when(token == "amp", "&").when(token.startswith("#"), None).when(token != "", _named(token))
        rest = F.substring(part, F.length(token) + 1, F.length(part))
        decoded = F.concat(F.coalesce(named, _numeric(token)), rest)
        return F.when(i == 0, part).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), part)))

    def decode(text: Column) -> Column:
        full = F.array_join(F.transform(F.split(text, "&"), piece), "")
        return F.when(F.contains(text, F.lit("&")), full).otherwise(text)

    return let(col, decode)


def _numeric(token: Column) -> Column:
    """The character of ``#1576;`` or ``#x628;``, NULL for anything else."""
    hexed = F.conv(F.regexp_extract(token, "^#[xX]([0-9a-fA-F]{1,6});$", 1), 16, 10)
    code = F.coalesce(hexed, F.regexp_extract(token, "^#([0-9]{1,7});$", 1)).try_cast("long")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def drop_tags(col: Column) -> Column:
    """Markup goes and leaves nothing in its place, as an element's text content does."""
    out = F.regexp_replace(col, "<[a-zA-Z/!?][^>]*>", "")
    return F.regexp_replace(out, "<[a-zA-Z/!?][^>]*$", "")


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, "(?is)<title\\b[^>]*>(.*?)</title\\s*>", 1)
    return blank_to_null(squash(decode_entities(raw)))


def visible_markup(html: Column) -> Column:
    """The body without comments and page chrome; headers and asides stay.

    Scripts go first: a string inside one may look like a closing tag.  A page
    that never opens a body is read whole, minus its head.
    """
    out = _without(html, L.RAW_TEXT_TAGS, to_end=True)
    out = F.regexp_replace(out, "(?s)<!--.*?(?:-->|\\z)", "")
    out = let(out, lambda markup: without_elements(markup, L.CHROME_TAGS))

    def inside(markup: Column) -> Column:
        body = F.regexp_replace(
            F.regexp_replace(markup, "(?is)\\A.*?<body\\b[^>]*>", ""), "(?is)</body\\s*>.*\\z", ""
        )
        headless = F.regexp_replace(
            F.regexp_replace(markup, "(?is)<head\\b[^>]*>.*?</head\\s*>", ""),
            "(?is)<title\\b[^>]*>.*?</title\\s*>",
            "",
        )
        return F.when(matches(markup, "(?i)<body\\b"), body).otherwise(headless)

    return let(out, inside)


def markup_text(markup: Column) -> Column:
    return squash(decode_entities(drop_tags(markup)))


def article_text(markup: Column) -> Column:
    """The text of the first article, or of the main region where there is none."""

    def region(m: Column) -> Column:
        article = F.regexp_extract(m, "(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)", 1)
        main = F.regexp_extract(m, "(?is)<main\\b[^>]*>(.*?)(?:</main\\s*>|\\z)", 1)
        return F.coalesce(F.nullif(article, F.lit("")), main)

    return markup_text(let(markup, region))


def blocks(text: Column) -> Column:
    """Sentence-sized pieces in order, those too short to say anything left out."""
    # The guard passes over every printable ASCII character but the bar.
    breaks = f"(?![!-{{}}~])(?:(?<=[.!?۔؟]){L.WS}+|{L.WS}*[|·•]{L.WS}*)"
    return F.filter(
        F.split(strip(text), breaks), lambda piece: F.length(piece) >= L.MIN_BLOCK_CHARS
    )


def is_soft_404(title: Column) -> Column:
    return matches(title, L.SOFT_404)


def is_banner_only(text: Column) -> Column:
    """Short enough that the official-site banner is the page, and two of its phrases present."""
    hits = sum((matches(text, phrase).cast("int") for phrase in L.BANNER_PHRASES), F.lit(0))
    return (F.length(text) <= L.BANNER_MAX_CHARS) & (hits >= 2)


def anchors(html: Column) -> Column:
    """Every anchor of a page as ``array<struct<href, title, label>>``."""
    found = F.regexp_extract_all(
        html, F.lit("(?is)<a\\b[^>]*\\bhref\\s*=[^>]*>.*?(?=</a\\s*>|<a\\b|\\z)"), F.lit(0)
    )

    def attribute(tag: Column, name: str) -> Column:
        value = F.regexp_extract(
            tag, f"(?is)(?<![\\w-]){name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1
        )
        return decode_entities(F.regexp_replace(value, "^[\"']|[\"']$", ""))

    def describe(found_anchor: Column) -> Column:
        tag = F.regexp_extract(found_anchor, "(?is)^<a\\b[^>]*>", 0)
        return F.struct(
            attribute(tag, "href").alias("href"),
            attribute(tag, "title").alias("title"),
            squash(decode_entities(drop_tags(found_anchor))).alias("label"),
        )

    return F.transform(found, describe)


def feed_links(html: Column) -> Column:
    """Hrefs of alternate RSS or Atom feeds the page declares, in page order."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<link\\b[^>]*>"), F.lit(0))
    feeds = F.filter(
        tags,
        lambda tag: tag.rlike("(?i)\\brel\\s*=\\s*[\"']?(?:[^\"'>]*\\s)?alternate\\b")
        & tag.rlike("(?i)\\btype\\s*=\\s*[\"']?[^\"'>]*application/(?:rss|atom)\\+xml")
        & tag.rlike("(?i)\\bhref\\s*=\\s*[\"']?[^\"'\\s>]+"),
    )
    return F.transform(
        feeds, lambda tag: F.regexp_extract(tag, "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    )
