"""SQL fragments the oracle queries share."""

from __future__ import annotations


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def ws() -> str:
    """Browser white space as an RE2 class."""
    return (
        "[ \\t\\n\\x0B\\f\\r\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
        "\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
    )


def chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"
    return expr


def squashed(expr: str) -> str:
    return f"trim({chain(expr, [(ws() + '+', ' ')])})"


def decoded(expr: str) -> str:
    for name, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]:
        expr = f"replace({expr}, {q(name)}, {q(char)})"
    return chain(expr, [("&amp;?", "&")])


def tagless(expr: str) -> str:
    return chain(expr, [("<[a-zA-Z/!?][^>]*>", ""), ("<[a-zA-Z/!?][^>]*$", "")])


def _markup(html: str) -> str:
    return chain(
        html,
        [
            ("(?is)<script\\b[^>]*>.*?(?:</script\\s*>|\\z)", ""),
            ("(?is)<style\\b[^>]*>.*?(?:</style\\s*>|\\z)", ""),
            ("(?s)<!--.*?(?:-->|\\z)", ""),
            ("(?is)<nav\\b[^>]*>.*?</nav\\s*>", ""),
            ("(?is)<footer\\b[^>]*>.*?</footer\\s*>", ""),
            ("(?is)^.*?<body\\b[^>]*>", ""),
            ("(?is)</body\\s*>.*$", ""),
        ],
    )


def BODY_OF(html: str, part: str = "body") -> str:
    markup = _markup(html)
    if part == "article":
        markup = f"regexp_extract({markup}, {q('(?is)<article' + chr(92) + 'b[^>]*>(.*?)(?:</article' + chr(92) + 's*>|' + chr(92) + 'z)')}, 1)"
    return squashed(decoded(tagless(markup)))


def TITLE_OF(html: str) -> str:
    raw = f"regexp_extract({html}, {q('(?is)<title' + chr(92) + 'b[^>]*>(.*?)</title' + chr(92) + 's*>')}, 1)"
    return f"nullif({squashed(decoded(raw))}, '')"


BODY_CTE = f"bodies AS (SELECT page_id, url, html, {BODY_OF('html')} AS body, {BODY_OF('html', 'article')} AS article FROM pages)"

TEXT_OF = f"""texts AS (SELECT page_id, url, body, title, method, CASE WHEN method = 'article' THEN article ELSE body END AS txt FROM (
  SELECT *, {TITLE_OF('html')} AS title, CASE WHEN length(article) >= 200 AND NOT (length(body) > length(article) * 5 AND length(body) > 200)
            THEN 'article' ELSE 'body_fallback' END AS method FROM bodies))"""

PRIOR_HTML = "regexp_replace(html, '</p><p>[^<]{0,60}</p>', '</p>', 'g')"


def BLOCKS_OF(text: str) -> str:
    marked = f"regexp_replace({text}, {q('([.!?۔؟])' + ws() + '+')}, {q(chr(92) + '1' + chr(1))}, 'g')"
    marked = f"regexp_replace({marked}, {q(ws() + '*[|·•]' + ws() + '*')}, chr(1), 'g')"
    strip = q("^" + ws() + "+|" + ws() + "+$")
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        f"lambda x: regexp_replace(x, {strip}, '', 'g')), lambda x: length(x) >= 25)"
    )


def HOST(url: str) -> str:
    return f"lower(regexp_extract({url}, '^https?://([^/?#]+)', 1))"


def REGISTERED(url: str) -> str:
    """Last two labels; three under a generic second level."""
    parts = f"string_split({HOST(url)}, '.')"
    return (
        f"CASE WHEN len({parts}) > 2 AND {parts}[-2] IN ('gov', 'com', 'edu', 'org', 'net') "
        f"THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END"
    )


def CANONICAL(url: str) -> str:
    """All given fragments are bare anchors, so the fragment is dropped."""
    return f"lower(regexp_replace(split_part({url}, '#', 1), '/+$', ''))"
