"""Main text of web pages, by paths that the pages of a host agree on.

Each page's containers are scored, and the best ones vote for their path: the tags,
classes and ids from the root down, digits made alike. Votes are counted per host in Spark;
then every page is read again and the best path of its host that it has is its
article. A page with none of its host's paths is read by its own best container.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored
from tidewatch.operators.spread import top_k

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends when it is open, and what bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: Elements that never hold article text.
CHROME_TAGS = frozenset(
    "head nav footer aside form button select datalist template object svg canvas video audio map dialog search menu math script style "
    "textarea title noscript iframe noembed noframes xmp input embed".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of a class or id that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion promoted dfp adsense adslot "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination paginator "
    "sidebar sidebars sidenav side rail aside widget widgets "
    "footer foot colophon copyright legal imprint masthead topbar toolbar header "
    "notice notices notification notifications cookie cookies consent gdpr popup modal overlay lightbox toast alert alerts disclaimer interstitial paywall "
    "newsletter subscribe subscription signup login signin register "
    "comment comments commentlist respond responses reply replies disqus discussion feedback "
    "share sharing social related recommended recommendations recirc trending teaser teasers "
    "form search searchbox skip hidden".split()
)
#: Words of a class or id that speak for the article.
MAIN_WORDS = frozenset("article articlebody body content contents entry main maincontent post posts story storybody text".split())
_GOOD_TAG = {"article": 2.0, "main": 1.6, "body": 0.7, "html": 0.7}
_CONTAINERS = frozenset("article main section div td body html center table".split())
#: An article element is chrome only by these; the others are plausible names of an article.
_BAD_ARTICLE = CHROME_WORDS - frozenset("alert alerts notice notices discussion form search foot promoted register".split())
#: A quote begins a value only after the equals sign; anywhere else it is a character like others.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
_ATTR = re.compile(rf"([^\s/>=]++)(?:{_VALUE})?")
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)>"""
)
_COMMENT_END = re.compile("--!?>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")
#: Attributes that say something about an element's part on the page.
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.I)
#: Inline elements that, without such an attribute, change nothing about their text.
_PLAIN = frozenset("b i em strong u s small big sub sup span font code kbd samp var tt q cite abbr mark ins del time dfn bdi bdo wbr".split())
_STARTED = re.compile(r"</?[a-zA-Z]")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
#: Words run together that begin or end with a telling one, as in mainnav or cookiebar.
_STEMS = re.compile(
    "^(nav|menu|sidebar|footer|cookie|advert|comments|sponsor|newsletter|breadcrumb)|"
    "(nav|navbar|menu|sidebar|footer|header|cookie|cookies|comment|comments|banner|advert|advertisement)$"
)
#: Containers a page votes for, and paths kept of a host.
_VOTES, _KEPT = 3, 5


def _attributes(text: str) -> dict[str, str]:
    if not text or not _TELLING.search(text):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _marks(attrs: dict[str, str]) -> set[str]:
    """The words of class and id; names like has-sidebar or no-comments only describe a layout."""
    out: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [p for p in _SPLIT.split(_CAMEL.sub("-", name).lower()) if p]
        if parts and parts[0] not in ("has", "with", "no", "without", "is"):
            out.update(parts)
            for part in parts:
                if found := _STEMS.search(part):
                    out.add(found[0])
    return out


class Page:
    """A page's elements and texts, in order; parents come before their children.

    Elements that look alike in the same surroundings share a state: tag, number of the
    path, whether it is chrome, its weight, whether it is in a link, whether in a header.
    A path is held as its last step and the path above, so a deep page takes no more room
    than a flat one.
    """

    def __init__(self, html: str):
        self.states: list[tuple[str, int, bool, float, bool, bool]] = [("#root", 0, False, 1.0, False, False)]
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.lengths = [0]
        self._numbers: dict[tuple[int, str], int] = {}
        self.parent, self.state = [-1], [0]
        self.texts: list[tuple[int, str]] = []
        #: Where a block begins or ends: the number of texts before it.
        self.cuts: set[int] = set()
        self._made: dict[tuple[int, str, str], int] = {}
        self._read(html)

    def _look(self, tag: str, attrs: dict[str, str], above: int) -> tuple[str, int, bool, float, bool, bool]:
        _, path, chrome, _, link, header = self.states[above]
        marks = _marks(attrs)
        style = attrs.get("style", "").replace(" ", "").lower()
        role = attrs.get("role", "").lower()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        bad = marks & CHROME_WORDS
        if tag in HEADINGS or tag == "p":
            bad -= {"header", "banner", "masthead"}
        is_header = tag == "header" or bool(bad) and bad <= {"header", "masthead"}
        bad -= {"header", "masthead"}
        if tag == "article":
            bad &= _BAD_ARTICLE
        elif tag in ("html", "body", "main"):
            bad = set()
        if tag not in ("html", "body"):
            chrome = chrome or hidden or bool(bad) or tag in CHROME_TAGS or role in CHROME_ROLES
        good = _GOOD_TAG.get(tag, 1.0)
        if role == "main" or "articlebody" in attrs.get("itemprop", "").lower():
            good = max(good, 1.6)
        elif good == 1.0 and marks & MAIN_WORDS:
            good = 1.4
        names = sorted({re.sub(r"\d+", "0", c) for c in attrs.get("class", "").split()})
        if attrs.get("id"):
            names.append("#" + re.sub(r"\d+", "0", attrs["id"]))
        return (tag, self._step(path, ".".join([tag, *names])), chrome, good, link or tag == "a", header or is_header)

    def _step(self, above: int, step: str) -> int:
        number = self._numbers.setdefault((above, step), len(self.steps))
        if number == len(self.steps):
            self.steps.append((above, step))
            self.lengths.append(self.lengths[above] + 1 + len(step))
        return number

    def path(self, number: int) -> str:
        """The text of a path."""
        out = []
        while number:
            number, step = self.steps[number]
            out.append(f"/{step}")
        return "".join(reversed(out))

    def place(self, path: str) -> int | None:
        """The number of a path, None if the page has none like it."""
        if not path:
            return 0
        step = path.rpartition("/")[2]
        for number, (_, last) in enumerate(self.steps):
            if self.lengths[number] == len(path) and number and last.endswith(step) and self.path(number) == path:
                return number
        return None

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        if attrs and not _TELLING.search(attrs):
            attrs = ""
        above = self.state[parent]
        key = (above, tag, attrs)
        state = self._made.get(key)
        if state is None:
            state = self._made[key] = len(self.states)
            self.states.append(self._look(tag, _attributes(attrs), above))
        self.parent.append(parent)
        self.state.append(state)
        return len(self.state) - 1

    def tag(self, node: int) -> str:
        return self.states[self.state[node]][0]

    def _read(self, html: str) -> None:
        stack, tags, at, end = [0], ["#root"], 0, len(html)
        texts, cuts = self.texts, self.cuts
        while at < end:
            here = html.find("<", at)
            if here < 0:
                here = end
            if here > at:
                raw = html[at:here]
                texts.append((stack[-1], unescape(raw) if "&" in raw else raw))
                if here == end:
                    break
            tag = _TAG.match(html, here)
            if not tag:
                if html.startswith(("<!-->", "<!--->"), here):
                    at = html.index(">", here) + 1
                elif html.startswith("<!--", here):
                    close = _COMMENT_END.search(html, here + 4)
                    at = close.end() if close else end
                elif html.startswith(("<!", "<?"), here):
                    close = html.find(">", here)
                    at = end if close < 0 else close + 1
                elif tag := _LOOSE.match(html, here):
                    pass
                elif _STARTED.match(html, here):  # a tag cut off by the end of the page
                    break
                else:
                    texts.append((stack[-1], "<"))
                    at = here + 1
                if not tag:
                    continue
            at = tag.end()
            closing, name, attrs = tag.groups()
            name = name.lower()
            if name in BLOCK:
                cuts.add(len(texts))
            elif name in _PLAIN and (tags[-1] != name if closing else not (attrs and _TELLING.search(attrs))):
                continue
            if closing:
                self._close(name, stack, tags)
                continue
            if name in BLOCK or name in ENDS:
                self._imply(name, stack, tags)
            if name == "br":
                texts.append((stack[-1], " "))
                continue
            if name in ("html", "body") and name in tags:
                continue
            if name == "body":
                while tags[-1] == "head":
                    stack.pop()
                    tags.pop()
            if name in VOID or (attrs.endswith("/") and name not in BLOCK and name not in RAW and name != "a"):
                continue
            node = self._open(name, attrs, stack[-1])
            if name in RAW:
                # Its text is never read: the element is skipped whole.
                close = _RAW_END[name].search(html, at)
                if close is None:
                    break
                shut = html.find(">", close.end())
                at = end if shut < 0 else shut + 1
                continue
            stack.append(node)
            tags.append(name)

    def _imply(self, name: str, stack: list[int], tags: list[str]) -> None:
        """End what a start tag ends without saying so."""
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if tags[k] == "p":
                    del stack[k:], tags[k:]
                    break
                if tags[k] in BLOCK and tags[k] not in HEADINGS:
                    break
            if name in HEADINGS and tags[-1] in HEADINGS:
                stack.pop()
                tags.pop()
        if name in ENDS:
            closes, bound = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if tags[k] in bound:
                    break
                if tags[k] in closes:
                    del stack[k:], tags[k:]
                    if name not in ("tr", "tbody"):
                        break

    def _close(self, name: str, stack: list[int], tags: list[str]) -> None:
        """End the innermost open element of the name, unless something stronger is between."""
        if name in ("body", "html"):
            return
        for k in range(len(stack) - 1, 0, -1):
            if tags[k] == name:
                del stack[k:], tags[k:]
                return
            if name not in BLOCK and tags[k] in BLOCK and tags[k] != "p" and name not in ("a", "span"):
                return
            if tags[k] in ("table", "article", "main") and name in ("p", "li", "dd", "dt", "a", "span"):
                return

    def scored(self) -> list[tuple[str, float]]:
        """Paths of the best containers with their shares of the best score, best first.

        A container scores its text outside links and chrome, weighed by what its tag
        and names say. Elements on one path score together.
        """
        n, parent = len(self.state), self.parent
        looks = [self.states[s] for s in self.state]
        plain, linked = [0] * n, [0] * n
        for node, text in self.texts:
            _, _, chrome, _, link, header = looks[node]
            if not chrome and not header:
                size = len(text.strip())
                plain[node] += size
                if link:
                    linked[node] += size
        for node in range(n - 1, 0, -1):
            if plain[node]:
                plain[parent[node]] += plain[node]
                linked[parent[node]] += linked[node]
        best: dict[int, float] = {}
        for node in range(1, n):
            if plain[node]:
                tag, path, chrome, good, _, _ = looks[node]
                if tag in _CONTAINERS and not chrome:
                    score = max(plain[node] - 1.5 * linked[node], 0.1) * good
                    best[path] = best.get(path, 0.0) + score
        rank = lambda x: (-x[1], -self.lengths[x[0]])
        top = sorted(best.items(), key=rank)
        # The texts decide only between paths of one score and length.
        tied = [x for x in top if rank(x) <= rank(top[min(_VOTES, len(top)) - 1])]
        named = sorted(((*rank(x), self.path(x[0])) for x in tied))[:_VOTES]
        return [(path, score / named[0][0]) for score, _, path in named]

    def has(self, paths: list[str]) -> bool:
        return any(self.place(p) is not None for p in paths)

    def text_of(self, paths: list[str]) -> str:
        """Blocks of the elements on the first path that the page has text on; of the whole page if there is none."""
        for path in [*paths, ""]:
            own_path = self.place(path)
            if own_path is None:
                continue
            inside = [path == ""] * len(self.state)
            # Inside an article the headings of a header stay; on a whole page a header is the site's.
            wide = path.rpartition("/")[2].partition(".")[0] in ("", "body", "html")
            for node in range(1, len(inside)):
                if not inside[node]:
                    _, own, chrome, _, _, _ = self.states[self.state[node]]
                    inside[node] = inside[self.parent[node]] or (own == own_path and not chrome)
            blocks: list[str] = []
            block: list[str] = []
            for i, (node, text) in enumerate(self.texts):
                if i in self.cuts and block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
                if inside[node]:
                    tag, _, chrome, _, _, header = self.states[self.state[node]]
                    if not chrome and (not header or self._headed(node, wide)):
                        block.append(text)
            blocks.append(" ".join("".join(block).split()))
            out = "\n\n".join(b for b in blocks if b)
            if out:
                return out
        return ""

    def _headed(self, node: int, wide: bool) -> bool:
        """Whether a text in a header belongs to a heading that stays."""
        while not wide and node > 0:
            if self.tag(node) in HEADINGS:
                return True
            node = self.parent[node]
        return False


_VOTE = T.ArrayType(T.StructType().add("path", T.StringType()).add("score", T.DoubleType()))


@F.arrow_udf(_VOTE)
def votes(pages: pa.Array) -> pa.Array:
    """The paths a page votes for, with their scores."""
    out = [[{"path": p, "score": s} for p, s in Page(h.as_py()).scored()] if h.is_valid else [] for h in pages]
    return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64())])))


@F.arrow_udf(T.StringType())
def article_text(pages: pa.Array, paths: pa.Array) -> pa.Array:
    """A page's text on the first of the paths it has, else on its own best path."""
    out = []
    for html, ranked in zip(pages, paths):
        page = Page(html.as_py() or "")
        given = ranked.as_py() or []
        if not page.has(given):
            given = [p for p, _ in page.scored()]
        out.append(page.text_of(given))
    return pa.array(out, pa.string())


def host(url: Column) -> Column:
    """The host of a url in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: the paths with most votes of each host, best first.

    Votes are added up where the pages lie before they move, so a host with a large
    share of all pages sends a few rows from each task.
    """
    voted = pages.select(host(F.col("url")).alias("host"), F.explode(votes(F.col("html"))).alias("v"))
    counted = voted.groupBy("host", F.col("v.path").alias("path")).agg(
        F.count_if(F.col("v.score") >= 1).alias("first"), F.sum(F.round("v.score", 6).cast("decimal(20,6)")).alias("score")
    )
    # First places before sums: what holds every page's article is no page's best container.
    order = [F.col("first").desc(), F.col("score").desc(), F.length("path").desc(), F.col("path")]
    best = top_k(counted, ["host"], order, _KEPT)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return best.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    Null and empty html have an empty text. Rows that repeat a page_id are each
    returned. Pages without a url or host are one host. Other columns are not read.
    """
    paths = stored(host_paths(pages), "host-paths").withColumnRenamed("host", "_host")
    slim = pages.select("page_id", "url", "html")
    joined = slim.join(paths, host(F.col("url")) == F.col("_host"), "left")
    read = joined.select("page_id", "url", article_text(F.col("html"), F.col("paths")).alias("text"))
    return read.withColumn("n_chars", F.char_length("text").cast("long"))
