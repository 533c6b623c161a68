"""Address scalars: what makes two urls one page, and what a path says about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import let, matches, squash


def canonical(url: Column) -> Column:
    """The address a page is known by.

    Trailing slashes and case do not count.  A fragment that is a bare anchor is
    dropped; one that is a route of a hash-routed site is part of the address.
    """
    has_hash = F.contains(url, F.lit("#"))
    base = F.lower(F.regexp_replace(F.substring_index(url, "#", 1), "/+$", ""))
    fragment = F.substring(url, F.length(F.substring_index(url, "#", 1)) + 2, F.length(url))
    route = F.lower(F.regexp_replace(fragment, "/+$", ""))
    plain = ~has_hash | fragment.rlike("^[A-Za-z0-9_:.-]*$")
    return F.when(plain, base).otherwise(F.concat(base, F.lit("#"), route))


def origin(url: Column) -> Column:
    """Scheme and host with any unusual port, lower case; NULL for what is no web address."""
    found = F.lower(F.regexp_extract(url, "(?i)^https?://[^/?#\\s]+", 0))
    bare = F.regexp_replace(found, "^(https?://)[^@]*@", "$1")
    return F.nullif(
        F.regexp_replace(bare, "^(http://[^:]+):80$|^(https://[^:]+):443$", "$1$2"), F.lit("")
    )


def host(url: Column) -> Column:
    """Host with any unusual port, as two urls must share it to be one site."""
    return F.regexp_replace(origin(url), "^https?://", "")


def hostname(url: Column) -> Column:
    return F.regexp_replace(host(url), ":[0-9]+$", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def decoded(col: Column) -> Column:
    """Percent-decoded text, or the text as written when it does not decode."""
    plus_kept = F.replace(col, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus_kept), col)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda part: part != "")


def is_home_path(url: Column) -> Column:
    return F.forall(
        segments(url),
        lambda part: F.lower(part).isin(L.HOME_SEGMENTS) | part.rlike("^[0-9]+$"),
    )


def is_dated_article(url: Column, this_year: Column) -> Column:
    """A plausible publication year stands as its own path segment."""
    return F.exists(
        segments(url),
        lambda part: part.rlike("^(?:19|20)[0-9]{2}$")
        & part.try_cast("int").between(F.lit(1990), this_year + 1),
    )


def is_careers_host(url: Column) -> Column:
    return matches(F.substring_index(hostname(url), ".", 1), L.CAREERS_HOST)


def source_type(url: Column, current: Column, this_year: Column) -> Column:
    """The type an address has earned; otherwise the one it already carries."""
    names_careers = matches(decoded(url), L.CAREERS_ADDRESS)
    home = is_home_path(url)
    dated = is_dated_article(url, this_year)
    return (
        F.when(names_careers & (~home | is_careers_host(url)) & ~dated, "careers_page")
        .when(home, "site_root")
        .when(dated, "announcement_page")
        .when(current == "site_root", "announcement_page")
        .otherwise(current)
    )


def looks_like_training(url: Column) -> Column:
    """The path, not the host, speaks of training."""
    target = F.when(host(url).isNotNull(), decoded(path(url))).otherwise(url)
    return matches(target, L.TRAINING_PATH)


def registered_domain(url: Column) -> Column:
    """The last two labels of a host, or three under a generic second level."""
    # Drop every leading label that still leaves two, or three under such a level.
    return F.regexp_replace(
        hostname(url),
        "^(?:[^.]+\\.)+?(?=[^.]+\\.(?:gov|com|edu|org|net)\\.[^.]+$|(?!(?:gov|com|edu|org|net)\\.)[^.]+\\.[^.]+$)",
        "",
    )


def is_one_story(url: Column) -> Column:
    """A path that names a single article rather than a section."""

    def story(last: Column) -> Column:
        words = F.size(F.filter(F.split(last, "-"), lambda word: F.length(word) > 1))
        return (F.length(last) > 40) | last.rlike("^[0-9]{4,}$") | (words >= 4)

    last = decoded(F.regexp_extract(path(url), "([^/]*)/*$", 1))
    return let(last, story) | decoded(path(url)).rlike("[0-9]{4}[-/][0-9]{2}")


def resolve(href: Column, base: Column) -> Column:
    """An href read against the page it stands on; NULL when it is not http(s)."""
    known = F.struct(
        F.regexp_replace(href, f"^{L.WS}+|{L.WS}+$", "").alias("href"),
        origin(base).alias("origin"),
        path(base).alias("path"),
        F.substring_index(base, "#", 1).alias("page"),
    )

    def absolute(k: Column) -> Column:
        bare = k["href"]
        directory = F.regexp_replace(k["path"], "[^/]*$", "")
        return (
            F.when(bare.rlike("(?i)^https?://[^/?#\\s]"), bare)
            .when(bare.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(
                bare.startswith("//"),
                F.concat(F.substring_index(k["origin"], "//", 1), bare),
            )
            .when(bare.startswith("/"), F.concat(k["origin"], bare))
            .when(bare.startswith("?"), F.concat(k["origin"], k["path"], bare))
            .when(bare.startswith("#"), F.concat(k["page"], bare))
            .otherwise(F.concat(k["origin"], directory, bare))
        )

    return let(let(known, absolute), _tidy)


def _tidy(url: Column) -> Column:
    """Lower-case origin, an explicit root path, and dot segments folded away."""
    pathname = F.regexp_replace(F.regexp_extract(url, "(?i)^https?://[^/?#]+([^?#]*)", 1), "^$", "/")
    rest = F.regexp_extract(url, "(?i)^https?://[^/?#]+[^?#]*(.*)$", 1)
    return F.concat(origin(url), F.when(F.contains(pathname, F.lit("/.")), _folded(pathname)).otherwise(pathname), rest)


def _folded(pathname: Column) -> Column:
    """A path read segment by segment: one dot stays, two go up, at the end both leave a slash."""
    parts = F.split(pathname, "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(none)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), none, step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def apply_url(candidate: Column, page_url: Column) -> Column:
    """An apply link worth tapping, resolved against its page; anything else is NULL.

    Sentences, placeholders and bare words are refused: a broken link on a
    deadline is worse than none.
    """
    raw = F.regexp_replace(candidate, f"^{L.WS}+|{L.WS}+$", "")
    structured = raw.rlike("(?i)^https?://") | F.contains(raw, F.lit("/")) | raw.rlike("(?i)\\.[a-z]{2,}")
    usable = (raw != "") & ~raw.rlike(L.WS) & ~raw.rlike(L.PLACEHOLDER_LINK) & structured
    return F.when(usable, resolve(raw, page_url))


def address_candidates(url: Column) -> Column:
    """Addresses to try for a source, most specific first, without repeats."""
    root = F.concat(origin(url), F.lit("/"))

    def secure(u: Column) -> Column:
        return F.when(u.rlike("(?i)^http://"), F.regexp_replace(u, "(?i)^http://", "https://"))

    def other_host(u: Column) -> Column:
        return F.when(
            u.rlike("(?i)^https?://www\\."), F.regexp_replace(u, "(?i)^(https?://)www\\.", "$1")
        ).otherwise(F.regexp_replace(u, "(?i)^(https?://)", "$1www."))

    bases = [url, other_host(url), root, other_host(root)]
    with_secure = [variant for u in bases for variant in (u, secure(u))]
    return F.array_distinct(F.array_compact(F.array(*with_secure)))


def clean_cities(cities: Column) -> Column:
    """Cities only, one spelling each, in the order written."""
    latin = F.create_map(*[F.lit(x) for pair in L.LATIN_CITIES.items() for x in pair])

    def one_spelling(city: Column) -> Column:
        key = F.regexp_replace(F.lower(city), "^al[- ]", "")
        return F.coalesce(F.try_element_at(latin, key), city)

    trimmed = F.transform(cities, squash)
    kept = F.filter(trimmed, lambda city: (city != "") & ~city.rlike(L.NOT_A_CITY))
    return F.array_distinct(F.transform(kept, one_spelling))
