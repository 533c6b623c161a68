"""Organisations listed twice, and organisations watched on someone else's domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import text as X
from tidewatch.operators.extract import settled
from tidewatch.operators.spread import dealt, first_per_key, spread_join
from tidewatch.session import cut


#: The kinds of evidence, in order.
REASONS = ("block+name", "domain+mail", "urls")
#: Edits two names may be apart, and the segments one of which then is untouched.
EDITS, SEGMENTS = 2, 3


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """Where the three segments of a name begin (from 1) and how long they are, the longer ones last."""
    base = F.floor(length / SEGMENTS).cast("int")
    more = (length % SEGMENTS).cast("int")
    out, start = [], F.lit(1)
    for i in range(SEGMENTS):
        size = base + F.when(more >= SEGMENTS - i, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def _key(length: Column, segment: int, text: Column) -> Column:
    return F.xxhash64(length, F.lit(segment), text)


def indexed_keys(name: Column) -> Column:
    """The keys a name is found under: its three segments, each with its place and the name's length."""
    length = F.length(name)
    return F.array(*[_key(length, i, F.substring(name, start, size)) for i, (start, size) in enumerate(_segments(length))])


def probed_keys(name: Column) -> Column:
    """The keys under which a name looks for names as long as itself or up to two letters shorter.

    Two edits leave one of three segments of the shorter name untouched. Where it stands
    in the longer one follows from how many letters may have come before it and after
    it: five places for names of one length, four and three for shorter ones.
    """
    length, out = F.length(name), []
    for shorter in range(EDITS + 1):
        other = length - shorter
        for i, (start, size) in enumerate(_segments(other)):
            for shift in range(max(-i, shorter - (EDITS - i)), min(i, shorter + (EDITS - i)) + 1):
                at = start + shift
                inside = (other >= 0) & (at >= 1) & (at + size - 1 <= length)
                out.append(F.when(inside, _key(other, i, F.substring(name, at, size))))
    return F.array_distinct(F.array_compact(F.array(*out)))


#: Names that one segment may bring to a name of its block, on average over the block, before the block is looked up by ends.
CROWD = 64
#: Names of a block that may end like a name, on average, and how many last letters are tried for that.
FEW, ENDS = 8, (0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 15, 19)


def _end_codes(end: int, asked: bool) -> list[int]:
    """The end keys of a name as numbers: zone, letters shorter, last letters taken, which of these is left out (0: none)."""
    last = (end + 1) // 2
    out = [(0, d, 0, 0) for d in range(EDITS + 1 if asked else 1)]
    for zone, letters in ((1, last), (2, end)):
        if not asked:
            out += [(zone, 0, letters, drop) for drop in range(letters + 1)]
            continue
        # The zone of whole ends fits names of every length, so it is asked once.
        for d in range(EDITS + 1 if zone == 1 else 1):
            out += [(zone, d, letters + 1, drop) for drop in range(1, letters + 2)]
            out += [(zone, d, letters, drop) for drop in range(1, letters + 1) if d < EDITS]
    return [((zone * 4 + d) * 32 + letters) * 32 + drop for zone, d, letters, drop in out if zone != 1 or last < end]


def _end_coded(end: Column, asked: bool) -> Column:
    """``_end_codes`` of a column that holds one more than one of ``ENDS``."""
    rows = [f"array({', '.join(map(str, _end_codes(m + 1, asked)))})" if m in ENDS else "array(0)" for m in range(max(ENDS) + 1)]
    return F.element_at(F.expr(f"array({', '.join(rows)})"), end)


def _end_key(block: Column, name: Column, end: Column, code: Column) -> Column:
    """The key ``k`` that one of ``_end_codes`` gives a name; NULL if the name is too short for it.

    Of a name and one as long or up to two letters longer, at most two edits apart, let the
    shorter be cut before its last ``end`` letters and before half of these. Either it is the
    same up to the second cut (zone 0), or else up to the first, with at most one edit after
    the second (zone 1), or it has at most one edit after the first (zone 2). Two texts are one
    edit apart only if a text is left when each loses at most one letter. So that a pair is met
    once, ``head`` tells how many first letters must differ (-1: none), as else a zone before has
    it, and ``left`` the letter left out with its place: where that is the same too, so are the ends.
    """
    last = F.floor((end + 1) / 2).cast("int")
    drop, letters = code.bitwiseAND(31), F.shiftright(code, 5).bitwiseAND(31)
    zone = F.shiftright(code, 12)
    length = F.length(name)
    short = length - F.shiftright(code, 10).bitwiseAND(3)
    cut_at = F.when(zone == 0, short - last).when(zone == 1, short - end).otherwise(0)
    start = length - letters + 1
    rest = F.concat(F.substring(name, start, F.greatest(drop - 1, F.lit(0))), F.substring(name, start + drop, letters - drop))
    left = F.substring(name, start + drop - 1, F.lit(1))
    again = (drop > 1) & (left == F.substring(name, start + drop - 2, F.lit(1)))  # leaves the same text
    fits = (short >= 0) & ~again & ((zone == 0) | ((zone == 1) & (short > last)) | ((zone == 2) & (length > end)))
    head = F.substring(name, F.lit(1), F.greatest(cut_at, F.lit(0)))
    kept_head = F.when(zone == 1, short - last).when(zone == 2, short - end).otherwise(-1)
    return F.when(fits, F.struct(
        F.xxhash64(block, zone, F.when(zone < 2, short), head, rest).alias("k"), kept_head.alias("head"),
        F.when(drop > 0, F.ascii(left).cast("long") * 32 + drop).otherwise(0).alias("left"),
    ))


def _star(members: DataFrame, group: list[str], evidence: str) -> DataFrame:
    """Every member of a group against its keeper: as many rows as members, never all pairs.

    The keeper is the member with most sources.  Any two members of a group are
    linked through it.
    """
    strength = F.struct((-F.col("n_sources")).alias("s"), F.col("org_id").alias("o"))
    keepers = members.groupBy(*group).agg(F.min(strength).alias("_k"), F.count("*").alias("_n"))
    keepers = keepers.where("_n > 1").select(*group, F.col("_k.o").alias("keep_id"))
    joined = members.withColumn("_g", F.sha2(F.concat_ws("\x01", *group), 256))
    hubs = keepers.withColumn("_g", F.sha2(F.concat_ws("\x01", *group), 256)).select("_g", "keep_id")
    return (
        spread_join(joined.select("_g", "org_id"), hubs, "_g", "inner")
        .where("org_id <> keep_id")
        .select("keep_id", F.col("org_id").alias("drop_id"), F.lit(evidence).alias("reason"))
    )


def duplicate_proposals(orgs: DataFrame, sources: DataFrame) -> DataFrame:
    """Organisations that look like one body: ``keep_id, drop_id, reasons``.

    ``orgs``: ``org_id, name, apply_target``; ``sources``: ``org_id, url``.
    Two independent signs are required: a shared domain, two or more equal urls
    (which bring the domain with them), the same mail domain, or names within two
    edits.  Members that agree in all of a kind of evidence are linked to their keeper,
    so a group of copies yields one row per copy; of names and of lists of urls that
    differ, every two that are near enough are linked through their keepers.
    """
    sources = cut(sources.select("org_id", "url").distinct())  # three steps read them
    sites = cut(site_counts(sources))
    counts = sites.groupBy("org_id").agg(F.sum(F.when(F.col("_site").isNotNull(), F.col("_n"))).alias("n_sources"))
    mail = F.lower(F.regexp_extract("apply_target", "@([^@\\s]+)$", 1))
    base = cut(
        orgs.join(counts, "org_id", "left")
        .select(
            "org_id",
            X.fold_name(F.col("name")).alias("name"),
            X.blank_to_null(mail).alias("mail"),
            F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        )
    )
    domains = cut(domain_owners(sources, sites).select("org_id", "domain").join(base, "org_id"))
    by_mail = _star(domains.where("mail IS NOT NULL"), ["domain", "mail"], "domain+mail")

    blocks = domains.select("org_id", "name", "n_sources", F.concat(F.lit("domain "), "domain").alias("block")).unionByName(
        base.where("mail IS NOT NULL").select(
            "org_id", "name", "n_sources", F.concat(F.lit("mail "), "mail").alias("block")
        )
    )
    # Equal names first: copies are linked once and one of them goes on.
    same_name = _star(blocks, ["block", "name"], "block+name")
    one_each = cut(first_per_key(blocks, ["block", "name"], -F.col("n_sources"), F.col("org_id")))
    near = _near_names(one_each)
    by_urls = _shared_urls(sources.where("url IS NOT NULL"), base.select("org_id", "n_sources"))
    return (
        by_mail.unionByName(same_name).unionByName(near).unionByName(by_urls)
        .groupBy("keep_id", "drop_id")
        .agg(*[F.max(F.col("reason") == r).alias(r) for r in REASONS])
        .select("keep_id", "drop_id", F.array_compact(F.array(*[F.when(F.col(r), r) for r in REASONS])).alias("reasons"))
    )


def _kept(a: str, b: str, reason: str) -> list[Column]:
    """Of two organisations (structs of ``n``, minus the number of sources, and ``o``) the one with more sources is kept."""
    first = F.col(a) < F.col(b)
    return [
        F.when(first, F.col(a)["o"]).otherwise(F.col(b)["o"]).alias("keep_id"),
        F.when(first, F.col(b)["o"]).otherwise(F.col(a)["o"]).alias("drop_id"), F.lit(reason).alias("reason"),
    ]


def _ends(named: DataFrame) -> DataFrame:
    """``_block, _end`` of blocks whose names share segments with many: how many last letters few others end in, and one more."""
    segments = named.select("_block", F.explode(indexed_keys(F.col("name"))).alias("_k")).groupBy("_block", "_k").agg(F.count("*").alias("_c"))
    crowded = segments.groupBy("_block").agg(F.sum(F.col("_c") * F.col("_c")).alias("_met"), F.sum("_c").alias("_n"))
    crowded = crowded.where(f"_met * {SEGMENTS} > {CROWD} * _n").select("_block")
    tried = named.join(crowded, "_block").select("_block", "name", F.explode(F.expr(f"array({', '.join(map(str, ENDS))})")).alias("_m"))
    start = F.greatest(F.length("name") - F.col("_m"), F.lit(0)) + 1
    tails = tried.select("_block", "_m", F.xxhash64(F.substring("name", start, F.col("_m"))).alias("_t")).groupBy("_block", "_m", "_t").agg(F.count("*").alias("_c"))
    alike = tails.groupBy("_block", "_m").agg((F.sum(F.col("_c") * F.col("_c")) / F.sum("_c")).alias("_alike"))
    fit = F.min(F.when(F.col("_alike") <= FEW, F.col("_m")))
    return alike.groupBy("_block").agg((F.coalesce(fit, F.lit(max(ENDS))) + 1).alias("_end"))


def _numbered(names: DataFrame) -> DataFrame:
    """Names of blocks with two or more, with ``_block``, ``_end`` (NULL: segments will do) and ``_home``.

    An organisation may stand for a name in several blocks; ``_home`` is the first of them
    if it is not this one. Two with one home are compared there.
    """
    named = names.where("name IS NOT NULL")
    blocks = cut(named.groupBy("block").agg(F.count("*").alias("_n")).where("_n > 1").select("block"))
    blocks = blocks.select("block", F.monotonically_increasing_id().alias("_block"))
    named = cut(named.join(blocks, "block").select("_block", "name", "n_sources", "org_id"))
    homes = named.groupBy("org_id", "name").agg(F.min("_block").alias("_home"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    named = named.join(homes, ["org_id", "name"], "left").withColumn("_home", F.when(F.col("_home") < F.col("_block"), F.col("_home")))
    named = cut(named)
    # A block's names come from the join in one task; some fifty keys are to be made of each.
    return cut(dealt(named.join(_ends(named), "_block", "left"), "org_id", "name"))


def _keyed(named: DataFrame, asked: bool) -> DataFrame:
    """Rows of ``_numbered`` under every key they are found or, if ``asked``, look for others by."""
    rest = ["_block", "_home", "name", "n_sources", "org_id"]
    segments = (probed_keys if asked else indexed_keys)(F.col("name"))
    by_segment = named.where("_end IS NULL").withColumn("_k", F.explode(segments))
    by_segment = by_segment.select(F.xxhash64("_block", "_k").alias("_k"), F.lit(-1).alias("_head"), F.lit(0).cast("long").alias("_left"), *rest)
    by_end = named.where("_end IS NOT NULL").withColumn("_code", F.explode(_end_coded(F.col("_end"), asked)))
    by_end = by_end.withColumn("_at", _end_key(F.col("_block"), F.col("name"), F.col("_end"), F.col("_code"))).where("_at IS NOT NULL")
    return by_segment.unionByName(by_end.select(F.col("_at.k").alias("_k"), F.col("_at.head").alias("_head"), F.col("_at.left").alias("_left"), *rest))


def _near_names(names: DataFrame) -> DataFrame:
    """Names of a block within two edits of each other, of rows ``org_id, name, n_sources, block`` that differ in (block, name).

    Shorter names are found by a segment that the edits leave untouched, about fifteen
    keys a name whatever its length. Where names of a block share segments with many others,
    they are found by their ends less a letter instead, and by what stands before these:
    some fifty keys, of which each is shared by few. Each pair found is verified.
    """
    named = _numbered(names)
    asked = _keyed(named, True).drop("_head")
    found = _keyed(named, False).toDF("_k", "head", "left", "b", "home", "short", "n", "o")
    # What costs least is asked first.
    same_left = (F.col("_left") == F.col("left")) & (F.col("left") != 0)
    elsewhere = F.col("_home").isNotNull() & F.col("home").isNotNull() & (F.col("_home") == F.col("home"))
    longer = (F.length("name") > F.length("short")) | (F.col("name") > F.col("short"))
    begins = F.substring("name", F.lit(1), F.col("head")) == F.substring("short", F.lit(1), F.col("head"))
    near = F.levenshtein("name", "short", EDITS) >= 0
    met = asked.join(found, "_k").where((F.col("_block") == F.col("b")) & ~same_left & ~elsewhere & longer & ((F.col("head") < 0) | ~begins) & near)
    who = F.struct((-F.col("n_sources")).alias("n"), F.col("org_id").alias("o")).alias("who")
    return met.select(F.struct((-F.col("n")).alias("n"), F.col("o")).alias("a"), who).select(*_kept("a", "who", "block+name"))


def _shared_urls(urls: DataFrame, strength: DataFrame, least: int = 2) -> DataFrame:
    """Organisations that list ``least`` urls in common, from distinct ``org_id, url``.

    Only urls that several list count. Organisations with the same list are one class,
    linked to its keeper. Classes are compared by prefix: of two lists with ``least``
    urls in common, each ordered from the rarest url on, the parts without the last
    ``least - 1`` have one in common. So a class is a row for each of its urls, not for
    every two of them, and what many list is a key only to those who list little else.
    """
    several = urls.groupBy("url").agg(F.count("*").alias("_n")).where("_n > 1")
    common = urls.join(several, "url").select("org_id", F.struct("_n", F.xxhash64("url").alias("h"), "url").alias("u"))
    lists = common.repartition("org_id").groupBy("org_id").agg(F.sort_array(F.collect_list("u")).alias("us")).where(F.size("us") >= least)
    listed = cut(
        lists.join(strength, "org_id").select("org_id", "n_sources", F.transform("us", lambda u: u["url"]).alias("list"))
        .withColumn("class", F.sha2(F.concat_ws("\x01", "list"), 256))
    )
    copies = _star(listed.select("org_id", "n_sources", "class"), ["class"], "urls")
    who = F.struct((-F.col("n_sources")).alias("n"), F.col("org_id").alias("o"))
    classes = cut(listed.groupBy("class").agg(F.min(who).alias("who"), F.any_value("list").alias("list")))
    prefix = classes.select("class", F.explode(F.slice("list", F.lit(1), F.size("list") - (least - 1))).alias("url"))
    met = prefix.join(prefix.select(F.col("class").alias("other"), "url"), "url").where("class < other").select("class", "other").distinct()
    of = lambda a, c: classes.select(F.col("class").alias(c), F.col("who").alias(a), F.col("list").alias(f"{a}_list"))
    both = met.join(of("a", "class"), "class").join(of("b", "other"), "other")
    shared = F.size(F.array_intersect("a_list", "b_list")) >= least
    return copies.unionByName(both.where(shared).select(*_kept("a", "b", "urls")))


def site_counts(sources: DataFrame) -> DataFrame:
    """``org_id, _site, _n``: sources by what stands before a url's third slash."""
    return sources.groupBy("org_id", F.substring_index("url", "/", 3).alias("_site")).agg(F.count("*").alias("_n"))


def domain_owners(sources: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Sources per (domain, organisation).

    A domain follows from what stands before a url's third slash. Sources are counted by
    that (``listed``, if they have been), and each distinct one is read once.
    """
    listed = site_counts(sources) if listed is None else listed
    sites = dealt(listed.select("_site").distinct(), "_site")
    named = sites.withColumn("domain", settled(A.registered_domain(F.col("_site")))).where("domain IS NOT NULL")
    return listed.join(named, "_site").groupBy("domain", "org_id").agg(F.sum("_n").alias("on_it"))


def native_owner(owners: DataFrame) -> DataFrame:
    """The organisation a domain is named after: an exact stem before a contained one."""
    stem = F.substring_index("domain", ".", 1)
    org = F.col("org_id")
    rank = F.when(org == stem, 0).when(F.contains(stem, org) | F.contains(org, stem), 1)
    return first_per_key(
        owners.withColumn("_rank", rank).where("_rank IS NOT NULL").select("domain", "org_id", "_rank"),
        ["domain"], F.col("_rank"), F.col("org_id"),
    ).select("domain", F.col("org_id").alias("native"))


def wrong_domain(sources: DataFrame, housed: DataFrame | None = None) -> DataFrame:
    """Organisations watched only on a domain that is someone else's.

    ``sources``: ``org_id, url, verified``; ``housed``: known (org_id, domain)
    exceptions.  Whether others hold as many sources is read from a histogram per
    domain, so an organisation is never paired with its neighbours.
    """
    owners = domain_owners(sources)
    natives = native_owner(owners)
    verified = domain_owners(sources.where("verified")).withColumnRenamed("on_it", "own")
    totals = (
        sources.where("verified AND url IS NOT NULL").groupBy("org_id").agg(F.count("*").alias("total"))
    )
    all_counts = owners.withColumnRenamed("on_it", "mine")
    histogram = owners.groupBy("domain", "on_it").agg(F.count("*").alias("_orgs"))
    marks = (
        verified.select("domain", F.col("own").alias("on_it")).distinct()
        .join(histogram, ["domain", "on_it"], "full_outer")
    )
    downward = Window.partitionBy("domain").orderBy(F.desc("on_it"))
    at_least = marks.select(
        "domain", F.col("on_it").alias("own"),
        F.sum(F.coalesce("_orgs", F.lit(0))).over(downward).alias("_at_least"),
    )
    native_counts = natives.join(
        owners.withColumnRenamed("org_id", "native").withColumnRenamed("on_it", "_native_on"),
        ["domain", "native"],
    )
    rows = (
        verified.join(totals, "org_id")
        .where("own = total")
        .join(all_counts, ["domain", "org_id"])
        .join(at_least, ["domain", "own"])
        .join(native_counts, "domain", "left")
        .where("native IS NULL OR native <> org_id")
    )
    others = (
        F.col("_at_least")
        - F.when(F.col("mine") >= F.col("own"), 1).otherwise(0)
        + F.when(F.col("_native_on") < F.col("own"), 1).otherwise(0)
    )
    found = rows.withColumn("others", others.cast("long")).where("others > 0").select(
        "org_id", "domain", F.col("own").alias("on_it"), "native", "others"
    )
    if housed is not None:
        found = found.join(housed.select("org_id", "domain"), ["org_id", "domain"], "left_anti")
    return found
