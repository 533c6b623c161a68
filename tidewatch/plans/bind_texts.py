"""Operators over documents and conversations: routing, memory, guard, excerpts, privacy, judging."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions import text as X
from tidewatch.functions.dates import date_mentions
from tidewatch.functions.html import is_banner_only
from tidewatch.operators import guard, judge, privacy, records, reports, routing
from tidewatch.operators.judge import VERDICT_TYPE
from tidewatch.operators.spread import first_per_key
from tidewatch.session import cut
from tidewatch.plans.registry import query, table
from tidewatch.plans.sqltext import q, squashed, ws
from tidewatch.sources import tables


def documents(spark, sf):
    """Documents as changed pages; those of every source ending in 3 speak of a student career."""
    told = F.when(F.col("source").endswith("3"), F.concat("text", F.lit(" student career page"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("url"), told.alias("payload"), "lang", "source", "n_chars",
        by_lang().alias("rank"), (F.col("lang") == "fr").alias("always"),
    )


def by_lang():
    lang = F.col("lang")
    return F.when(lang == "fr", 0).when(lang == "de", 1).when(lang == "es", 2).otherwise(3)


DOCS = """docs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS url, CASE WHEN ends_with(source, '3') THEN text || ' student career page' ELSE text END AS payload,
  lang, source, n_chars, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS rank, lang = 'fr' AS always FROM documents)"""


@query("word_filter_route", f"""
WITH {DOCS} SELECT doc_id, CASE WHEN NOT always AND NOT regexp_matches(payload, '(?i)co-?op|intern|trainee|training|career|graduate|student') THEN 'no_training_word' END AS settled FROM docs""")
def word_filter_route(spark, sf):
    return routing.cheap_filter(documents(spark, sf)).select("doc_id", "settled")


@query("budget_prefix", f"""
WITH {DOCS}, s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY rank, md5(url), url ROWS UNBOUNDED PRECEDING) AS spent FROM docs)
SELECT doc_id, CAST(spent AS BIGINT) AS spent, spent - n_chars < 500000 AS in_budget FROM s""")
def budget_prefix(spark, sf):
    paid = routing.within_budget(documents(spark, sf), 500_000, cost=F.col("n_chars"))
    return paid.select("doc_id", "spent", "in_budget")


@query("distinct_questions", f"""
WITH {DOCS} SELECT substr(sha256(payload), 1, 32) AS fingerprint, CAST(min(rank) AS INTEGER) AS rank FROM docs GROUP BY 1""")
def distinct_questions(spark, sf):
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    return routing.distinct_questions(pages).select("fingerprint", "rank")


def memory(spark, sf):
    """Labelled documents as remembered verdicts: poor ones "no", toxic ones with invented words."""
    labelled = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    s = F.lit(None).cast("string")
    title = F.when(F.col("toxic") == 1, "Zzzunprinted Programme").otherwise(F.col("payload"))
    verdict = F.struct(
        F.lit(True).alias("isTrainingAnnouncement"), F.lit("coop").alias("product"), title.alias("titleAr"),
        s.alias("opensISO"), s.alias("closesISO"), s.alias("opensRaw"), s.alias("closesRaw"), F.lit(False).alias("moreOnPage"),
        F.array().cast("array<string>").alias("majors"), F.lit(None).cast("double").alias("seats"),
        F.lit(None).cast("double").alias("stipendSAR"), F.lit(None).cast("double").alias("durationWeeks"),
        F.array().cast("array<string>").alias("cities"), F.lit(False).alias("statesZeroCoursesRule"), s.alias("zeroCoursesQuote"), s.alias("applyUrl"),
    ).cast(VERDICT_TYPE)
    rows = labelled.select(
        X.fingerprint(F.col("payload")).alias("fingerprint"), F.when(F.col("quality") == 1, verdict).alias("verdict"),
        F.lit("m1").alias("model"), F.lit("2024-01-01").cast("timestamp").alias("written_at"), "doc_id",
    )
    return cut(first_per_key(rows, ["fingerprint"], F.col("doc_id")))


MEMO = f"""{DOCS}, mem AS (SELECT substr(sha256(payload), 1, 32) AS fingerprint, arg_min(quality, d.doc_id) AS quality, arg_min(toxic, d.doc_id) AS toxic
  FROM docs d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
looked AS (SELECT doc_id, CASE WHEN m.fingerprint IS NULL THEN 'miss' WHEN quality = 0 THEN 'no' WHEN toxic = 1 THEN 'poisoned' ELSE 'hit' END AS remembered, substr(sha256(payload), 1, 32) AS fingerprint
  FROM docs d LEFT JOIN mem m ON m.fingerprint = substr(sha256(payload), 1, 32))"""


@query("memory_lookup", f"WITH {MEMO} SELECT doc_id, remembered FROM looked")
def memory_lookup(spark, sf):
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    return routing.remember(pages, memory(spark, sf)).select("doc_id", "remembered")


@query("memory_eviction", f"WITH {MEMO} SELECT fingerprint FROM mem WHERE fingerprint NOT IN (SELECT fingerprint FROM looked WHERE remembered = 'poisoned')")
def memory_eviction(spark, sf):
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    known = memory(spark, sf)
    return routing.evict(known, routing.remember(pages, known)).select("fingerprint")


@query("settled_pages", f"""
WITH {DOCS}, a AS (SELECT substr(sha256(payload), 1, 32) AS fingerprint, CAST(length(payload) AS INTEGER) % 2 = 0 AS ok, any_value(payload) AS p FROM docs GROUP BY ALL)
SELECT doc_id, CAST(length(payload) AS INTEGER) % 2 = 0 AS ok FROM docs""")
def settled_pages(spark, sf):
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    answers = routing.distinct_questions(pages).select("fingerprint", (F.length("payload") % 2 == 0).alias("ok"))
    return routing.settle(pages, answers).select("doc_id", "ok")


# ---- guard ------------------------------------------------------------------------


def replies(spark, sf):
    """Assistant turns as claims about the turn before them; in every other conversation they repeat it."""
    turns = table(spark, sf, "conversations")
    said = turns.where("role = 'assistant'").select(
        "conv_id", "turn", (F.col("turn") - 1).alias("prev"), F.col("text").alias("said"),
    )
    asked = turns.select("conv_id", F.col("turn").alias("prev"), F.col("text").alias("page"))
    none = F.array().cast("array<string>")
    s = F.lit(None).cast("string")
    copied = F.when(F.col("conv_id") % 2 == 0, F.col("page")).otherwise(F.col("said"))
    claims = said.join(asked, ["conv_id", "prev"]).withColumn("title", copied).withColumn("quote", copied)
    return claims.withColumn(
        "offences",
        guard.invented_wording(
            F.col("page"), F.col("title"), F.col("quote"), s, s, F.array(F.col("title")), none, F.col("turn") % 3 == 0
        ),
    )


def _norm(expr: str) -> str:
    """Lower case, squashed; the documents hold no Arabic and no invisible marks."""
    return f"lower({squashed(expr)})"


GUARD = f"""claims AS (SELECT a.conv_id, a.turn, CASE WHEN a.conv_id % 2 = 0 THEN p.text ELSE a.text END AS title, CASE WHEN a.conv_id % 2 = 0 THEN p.text ELSE a.text END AS quote, {_norm('p.text')} AS hay
  FROM conversations a JOIN conversations p ON a.conv_id = p.conv_id AND p.turn = a.turn - 1 WHERE a.role = 'assistant'),
guarded AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(title, {q('(?:' + ws() + '|[،,.:;()' + chr(92) + '[' + chr(92) + ']' + chr(34) + chr(39) + '«»' + chr(92) + '-–—/|])+')}, chr(1), 'g'), chr(1)),
   lambda w: {_norm('w')}), lambda w: length(w) >= 3 AND NOT contains(hay, w)) AS stray,
   {_norm('title')} <> '' AND NOT contains(hay, {_norm('title')}) AS bad_major, {_norm('quote')} <> '' AND NOT contains(hay, {_norm('quote')}) AS bad_quote,
   turn % 3 = 0 AND {_norm('quote')} = '' AS unquoted FROM claims)"""


@query("copied_guard", f"""
WITH {GUARD} SELECT conv_id, turn, CAST((len(stray) > 0)::INT + bad_major::INT + bad_quote::INT + unquoted::INT AS INTEGER) AS offences, coalesce(array_to_string(stray[1:4], ' '), '') AS stray FROM guarded""")
def copied_guard(spark, sf):
    about_title = F.filter("offences", lambda o: o.startswith("titleAr"))
    stray = F.regexp_extract(F.array_join(about_title, ""), 'printed: "(.*)"$', 1)
    return replies(spark, sf).select("conv_id", "turn", F.size("offences").alias("offences"), stray.alias("stray"))


@query("guard_acceptance", f"""
WITH {GUARD} SELECT turn % 2 AS model, count(*) AS verdicts, count(*) FILTER (WHERE len(stray) = 0 AND NOT bad_major AND NOT bad_quote AND NOT unquoted) AS accepted,
 round(avg(CASE WHEN len(stray) = 0 AND NOT bad_major AND NOT bad_quote AND NOT unquoted THEN 1.0 ELSE 0.0 END), 6) AS acceptance FROM guarded GROUP BY 1""")
def guard_acceptance(spark, sf):
    judged = replies(spark, sf).withColumn("model", F.col("turn") % 2)
    return guard.acceptance(judged).withColumn("acceptance", F.round("acceptance", 6))


# ---- excerpts and scalars ------------------------------------------------------------


@query("triage_excerpts", """
WITH d AS (SELECT doc_id, text || ' training' AS t FROM documents),
a AS (SELECT *, instr(lower(t), 'training') - 1 AS pos FROM d)
SELECT doc_id, sha256(CASE WHEN pos < 1200 THEN substr(t, 1, 1200) ELSE substr(t, 1, 1200) || chr(10) || '…' || chr(10) || substr(t, greatest(0, pos - 300) + 1, 600) END) AS excerpt_hash FROM a""")
def triage_excerpts(spark, sf):
    text = F.concat("text", F.lit(" training"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.triage_excerpt(text), 256).alias("excerpt_hash"))


@query("focused_excerpts", """
WITH d AS (SELECT doc_id, text || ' training ' || text || ' deadline' AS t FROM documents),
a AS (SELECT *, instr(lower(t), 'training') - 1 AS w, CASE WHEN regexp_matches(t, '[0-9]{1,4}\\s*[/\\-.]\\s*[0-9]{1,2}\\s*[/\\-.]\\s*[0-9]{1,4}') THEN length(regexp_extract(t, '^((?s).*?)[0-9]{1,4}\\s*[/\\-.]\\s*[0-9]{1,2}\\s*[/\\-.]\\s*[0-9]{1,4}', 1))
   ELSE instr(lower(t), 'deadline') - 1 END AS dd FROM d),
h AS (SELECT *, 500 AS head, w >= 500 AS ww, dd >= 500 AS wd FROM a),
s AS (SELECT *, CASE WHEN ww AND wd THEN 248 ELSE 497 END AS s1 FROM h),
r AS (SELECT *, CASE WHEN ww THEN 500 - s1 - 3 ELSE 500 END - 3 AS s2 FROM s)
SELECT doc_id, sha256(CASE WHEN length(t) <= 1000 THEN t ELSE substr(t, 1, 500)
  || CASE WHEN ww THEN chr(10) || '…' || chr(10) || substr(t, greatest(500, w - s1 // 3) + 1, s1) ELSE '' END
  || CASE WHEN wd THEN chr(10) || '…' || chr(10) || substr(t, greatest(500, dd - s2 // 3) + 1, s2) ELSE '' END END) AS excerpt_hash FROM r""")
def focused_excerpts(spark, sf):
    text = F.concat("text", F.lit(" training "), "text", F.lit(" deadline"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.focused_excerpt(text, 1000), 256).alias("excerpt_hash"))


@query("text_scalars", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS INTEGER) AS latin, CAST(len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06FF}}]')) AS INTEGER) AS arabic,
 sha256({_norm('text')}) AS folded_hash,
 CASE WHEN n_chars = 1 THEN 'صفحة واحدة' WHEN n_chars = 2 THEN 'صفحتان' WHEN n_chars BETWEEN 3 AND 10 THEN n_chars || ' صفحات' ELSE n_chars || ' صفحة' END AS counted,
 CAST(n_chars AS VARCHAR) AS digits FROM documents""")
def text_scalars(spark, sf):
    n = F.col("n_chars")
    arabic = F.translate(n.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return table(spark, sf, "documents").select(
        "doc_id", X.latin_letters(F.col("text")).alias("latin"), X.arabic_letters(F.col("text")).alias("arabic"),
        F.sha2(X.normalise_arabic(F.col("text")), 256).alias("folded_hash"),
        X.counted(n, "صفحة", "صفحتان", "صفحات").alias("counted"), X.western_digits(arabic).alias("digits"),
    )


@query("shortened_names", """
WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents), c AS (SELECT *, substr(t, 1, 28) AS cut FROM d),
p AS (SELECT *, length(cut) - length(string_split(cut, ' ')[-1]) - 1 AS sp FROM c)
SELECT doc_id, CASE WHEN length(t) <= 28 THEN t ELSE rtrim(CASE WHEN sp > 14 THEN substr(cut, 1, sp) ELSE cut END) || '…' END AS label FROM p""")
def shortened_names(spark, sf):
    flat = F.regexp_replace("text", "\\s+", " ")
    return table(spark, sf, "documents").select("doc_id", X.shorten(flat, 28).alias("label"))


@query("document_dates", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{2,4}\\s*[/\\-.]\\s*[0-9]{1,2}\\s*[/\\-.]\\s*[0-9]{1,4}')) AS INTEGER) AS numeric_mentions FROM documents""")
def document_dates(spark, sf):
    numeric = F.filter(date_mentions(F.col("text")), lambda m: ~m["matched"].rlike("\\p{L}"))
    return table(spark, sf, "documents").select("doc_id", F.size(numeric).alias("numeric_mentions"))


@query("redacted_paths", f"""
SELECT doc_id, sha256(text || ' failed at {L.REDACTED}/x.log: see https://a.example/home/kept and {L.REDACTED}/' || source) AS redacted_hash FROM documents""")
def redacted_paths(spark, sf):
    raw = F.concat(
        "text", F.lit(" failed at /home/"), "source", F.lit("/logs/x.log: see https://a.example/home/kept and C:\\Users\\me\\"), "source"
    )
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.redact_paths(raw), 256).alias("redacted_hash"))


@query("banner_only", """
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'How can you verify? This is an official government website. ' WHEN 1 THEN 'An official government website. ' ELSE '' END || text AS t FROM documents)
SELECT doc_id, doc_id % 3 = 0 AND length(t) <= 1200 AS banner FROM d""")
def banner_only(spark, sf):
    k = F.col("doc_id") % 3
    lead = F.when(k == 0, "How can you verify? This is an official government website. ").when(
        k == 1, "An official government website. "
    ).otherwise("")
    return table(spark, sf, "documents").select("doc_id", is_banner_only(F.concat(lead, "text")).alias("banner"))


@query("publish_decision", """
WITH n AS (SELECT count(*) FILTER (WHERE doc_id % 10 = 0) AS moved FROM documents)
SELECT 'seen' AS reader, moved > 0 AS reader_visible, moved > 0 AS any_change, moved > 0 AS publish FROM n
UNION ALL SELECT 'waited', false, moved > 0, moved > 0 FROM n UNION ALL SELECT 'fresh', false, moved > 0, false FROM n""")
def publish_decision(spark, sf):
    """Whether two versions are worth publishing: to readers of a changed table, of another after a while, and too soon."""
    before = table(spark, sf, "documents").select("doc_id", "lang")
    after = before.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")))
    summaries = {"documents": tables.change_summary(before, after), "labels": tables.change_summary(before, before)}
    now = F.lit("2024-01-31 09:00:00").cast("timestamp")
    ago = lambda minutes: F.timestamp_micros(F.unix_micros(now) - minutes * 60_000_000)
    cases = [("seen", ["documents"], 1), ("waited", ["labels"], 20), ("fresh", ["labels"], 1)]
    made = [
        tables.worth_publishing(summaries, readers, ago(minutes), now).withColumn("reader", F.lit(name))
        for name, readers, minutes in cases
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


# ---- privacy ------------------------------------------------------------------------


MAILBOX = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]{2,}"


@query("pii_scan", f"""
WITH h AS (SELECT doc_id, text, regexp_extract_all(text, {q(MAILBOX)}) AS f FROM documents WHERE regexp_matches(text, {q(MAILBOX)}))
SELECT doc_id, 'any_mailbox' AS rule, CAST(len(f) AS INTEGER) AS hits, CAST(len(string_split(split_part(text, f[1], 1), chr(10))) AS INTEGER) AS first_line, array_to_string(f[1:3], ' ') AS samples FROM h""")
def pii_scan(spark, sf):
    found = privacy.scan(table(spark, sf, "documents"), ["doc_id"])
    return found.select("doc_id", "rule", "hits", "first_line", F.array_join("samples", " ").alias("samples"))


@query("pii_introduced", f"""
WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(text, {q(MAILBOX)}, 'gone', 'g'), chr(10))) AS line FROM documents),
a AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = n.doc_id AND p.line = n.line))
SELECT doc_id, 'any_mailbox' AS rule, CAST(sum(len(regexp_extract_all(line, {q(MAILBOX)}))) AS BIGINT) AS hits FROM a WHERE regexp_matches(line, {q(MAILBOX)}) GROUP BY doc_id""")
def pii_introduced(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", "text")
    was = now.withColumn("text", F.regexp_replace("text", MAILBOX, "gone"))
    return privacy.introduced(now, was, ["doc_id"])


@query("privacy_rules", """
WITH h AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'credentials' WHEN 'de' THEN CASE WHEN source = 'src1' THEN NULL ELSE 'circumstances' END WHEN 'es' THEN 'account_name' ELSE 'local_path' END AS rule FROM documents)
SELECT doc_id, rule FROM h WHERE rule IS NOT NULL""")
def privacy_rules(spark, sf):
    """One planted trait a language; circumstances are allowed in one source."""
    rules = [r if r[0] != "circumstances" else (r[0], r[1], "^src1$") for r in privacy.rules_with_account("some.body")]
    lang = F.col("lang")
    said = F.when(lang == "fr", " First Class Honours").when(lang == "de", " free accommodation").when(lang == "es", " by some.body, yes").otherwise(" /home/xyz")
    docs = table(spark, sf, "documents").withColumn("text", F.concat("text", said))
    found = privacy.scan(docs, ["doc_id"], origin="source", rules=rules)
    return found.where("rule <> 'any_mailbox' AND rule <> 'personal_email'").select("doc_id", "rule")


@query("pii_by_version", f"""
WITH v AS (SELECT doc_id, 1 AS v, regexp_replace(text, {q(MAILBOX)}, 'gone', 'g') AS text FROM documents UNION ALL SELECT doc_id, 2, text FROM documents
  UNION ALL SELECT doc_id, 3, text || chr(10) || 'write to new@mail.example' FROM documents),
l AS (SELECT doc_id, v, unnest(string_split(text, chr(10))) AS line FROM v),
a AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.doc_id = l.doc_id AND p.v = l.v - 1 AND p.line = l.line))
SELECT doc_id, v, 'any_mailbox' AS rule, CAST(sum(len(regexp_extract_all(line, {q(MAILBOX)}))) AS BIGINT) AS hits FROM a WHERE regexp_matches(line, {q(MAILBOX)}) GROUP BY doc_id, v""")
def pii_by_version(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", "text")
    clean = F.regexp_replace("text", MAILBOX, "gone")
    more = F.concat("text", F.lit("\nwrite to new@mail.example"))
    versions = [now.select("doc_id", F.lit(i).alias("v"), text.alias("text")) for i, text in ((1, clean), (2, F.col("text")), (3, more))]
    found = privacy.introduced_by_version(versions[0].unionByName(versions[1]).unionByName(versions[2]), ["doc_id"], "v")
    return found.where("rule = 'any_mailbox'")


@query("reason_privacy", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'a mailbox' AS rule FROM documents WHERE regexp_matches(text, {q(MAILBOX)})
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'a certificate' FROM documents WHERE regexp_matches(text, '(?i)Security\\+|CCNA|CEH')""")
def reason_privacy(spark, sf):
    return privacy.scan_reasons(
        table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("reason"))
    )


# ---- judging ------------------------------------------------------------------------


@query("triage_quality", """
WITH a AS (SELECT lang AS model, d.doc_id AS id, quality = 1 AS expected, n_chars % 3 <> 0 AS passed_on, CAST(n_chars AS DOUBLE) AS ms FROM documents d JOIN labels l USING (doc_id))
SELECT model, count(*) FILTER (WHERE expected) AS positives, count(*) FILTER (WHERE expected AND passed_on) AS recalled, count(*) FILTER (WHERE NOT expected) AS ordinary,
 count(*) FILTER (WHERE NOT expected AND NOT passed_on) AS dropped, count(*) FILTER (WHERE expected AND NOT passed_on) AS missed,
 count(*) FILTER (WHERE NOT expected AND passed_on) AS false_alarms, round(quantile_cont(ms, 0.5), 6) AS median_ms, max(ms) AS max_ms FROM a GROUP BY model""")
def triage_quality(spark, sf):
    return reports.triage_quality(triage_answers(spark, sf)).withColumn("median_ms", F.round("median_ms", 6))


def triage_answers(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("model"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("expected"),
        (F.col("n_chars") % 3 != 0).alias("passed_on"), F.col("n_chars").cast("double").alias("ms"),
    )


@query("triage_errors", """
WITH a AS (SELECT lang AS model, d.doc_id AS id, CASE WHEN quality = 1 AND n_chars % 3 = 0 THEN 'missed' WHEN quality <> 1 AND n_chars % 3 <> 0 THEN 'false_alarm' END AS kind FROM documents d JOIN labels l USING (doc_id))
SELECT model, kind, id FROM a WHERE kind IS NOT NULL""")
def triage_errors(spark, sf):
    return reports.triage_errors(triage_answers(spark, sf))


def rule_judge(excerpts: list[str], insist: bool) -> list[str | None]:
    """A stand-in for a model: announces pages about a student career, fumbles the format at first."""
    out: list[str | None] = []
    for excerpt in excerpts:
        about = "student career" in excerpt
        verdict = {
            "isTrainingAnnouncement": about, "product": "coop" if about else "unknown",
            "titleAr": "student career page" if about else None, "opensISO": None, "closesISO": None,
            "opensRaw": None, "closesRaw": None, "moreOnPage": False, "majors": [], "seats": None,
            "stipendSAR": None, "durationWeeks": None, "cities": [], "statesZeroCoursesRule": False,
            "zeroCoursesQuote": None, "applyUrl": None,
        }
        text = json.dumps(verdict, ensure_ascii=False)
        if len(excerpt) % 7 == 0:
            text = f"```json\n{text}\n```"
        out.append(text if insist or len(excerpt) % 5 else "Sure! Here is the answer:")
    return out


# What the judge is shown of each distinct text, and what the stand-in judge makes of it.
JUDGED = r"""d AS (SELECT doc_id, CASE WHEN ends_with(source, '3') THEN text || ' student career page' ELSE text END AS payload FROM documents),
e AS (SELECT substr(sha256(payload), 1, 32) AS fingerprint, any_value(payload) AS p FROM d GROUP BY 1),
w AS (SELECT *, length(regexp_extract(p, '^((?s).*?)[0-9]{1,4}\s*[/\-.]\s*[0-9]{1,2}\s*[/\-.]\s*[0-9]{1,4}', 1)) AS pos,
  regexp_matches(p, '[0-9]{1,4}\s*[/\-.]\s*[0-9]{1,2}\s*[/\-.]\s*[0-9]{1,4}') AS dated FROM e),
x AS (SELECT fingerprint, CASE WHEN length(p) <= 6000 THEN p WHEN NOT dated THEN substr(p, 1, 6000) WHEN pos < 3000 THEN substr(p, 1, 3000)
  ELSE substr(p, 1, 3000) || chr(10) || '…' || chr(10) || substr(p, greatest(3000, pos - 2997 // 3) + 1, 2997) END AS x FROM w),
v AS (SELECT fingerprint, x, contains(x, 'student career') AS about, NOT contains(x, 'student career') OR contains(lower(x), 'page') AS faithful FROM x),
j AS (SELECT fingerprint, faithful AS ok, CASE WHEN NOT faithful THEN 'schema' END AS stage,
  CAST(CASE WHEN length(x) % 5 = 0 OR NOT faithful THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN faithful THEN about END AS announces FROM v)"""


@query("judged_documents", f"WITH {JUDGED} SELECT fingerprint, ok, attempts, announces FROM j")
def judged_documents(spark, sf):
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    answered = judge.judge_pages(routing.distinct_questions(pages), rule_judge)
    announces = F.col("verdict.isTrainingAnnouncement").alias("announces")
    return answered.select("fingerprint", "ok", "attempts", announces)


@query("judge_attempts", f"WITH {JUDGED} SELECT ok, stage, attempts, announces, count(*) AS texts FROM j GROUP BY ALL")
def judge_attempts(spark, sf):
    """How the judge fared: verdicts by stage, attempts and kind."""
    pages = documents(spark, sf).withColumn("fingerprint", X.fingerprint(F.col("payload")))
    answered = judge.judge_pages(routing.distinct_questions(pages), rule_judge)
    return answered.groupBy("ok", "stage", "attempts", F.col("verdict.isTrainingAnnouncement").alias("announces")).agg(
        F.count("*").alias("texts")
    )


@query("stored_answers", """
WITH d AS (SELECT doc_id, text AS payload FROM documents), e AS (SELECT substr(sha256(payload), 1, 32) AS fingerprint, min(doc_id) AS doc_id, any_value(payload) AS payload FROM d GROUP BY 1),
k AS (SELECT e.fingerprint, l.doc_id IS NOT NULL AS stored, quality, toxic FROM e LEFT JOIN labels l USING (doc_id))
SELECT fingerprint, coalesce(stored AND quality = 1 AND toxic = 0, false) AS ok, CASE WHEN NOT stored THEN 'api' WHEN toxic = 1 THEN 'parse' WHEN quality = 0 THEN 'schema' END AS stage FROM k""")
def stored_answers(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("payload"), X.fingerprint(F.col("text")).alias("fingerprint")
    )
    asked = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("payload").alias("payload"))
    good = rule_judge(["plain page"], True)[0]
    reply = F.when(F.col("toxic") == 1, "not json").when(F.col("quality") == 0, F.lit('{"product": "coop"}')).otherwise(F.lit(good))
    answers = asked.join(table(spark, sf, "labels"), "doc_id").select("fingerprint", reply.alias("reply"))
    return judge.stored_answers(asked, answers).select("fingerprint", "ok", "stage")


@query("triage_replies", """
SELECT conv_id, turn, ends_with(text, '.') AS triaged_out FROM conversations""")
def triage_replies(spark, sf):
    answer = F.when(F.endswith("text", F.lit(".")), F.lit(' {"candidate": false}')).otherwise(
        F.concat(F.lit("لا شك "), F.col("text"))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", judge.reads_as_no(answer).alias("triaged_out"))


@query("placeholder_records", f"""
WITH d AS (SELECT doc_id, text, lang, n_chars FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS url, {q(L.UNJUDGED_TITLE)} AS title, 'unknown' AS status, 'needs_manual_review' AS flags,
 {q(L.REASONS['unjudged_prefix'])} || CASE WHEN lang = 'fr' THEN 'جاء الردّ بصيغة غير متوقّعة، فلم يُقبل. الصفحة محفوظة وستُعاد قراءتها.' WHEN lang = 'de' THEN 'تعذّر الوصول إلى خدمة التصنيف. الصفحة محفوظة وستُقرأ في الجولة القادمة.'
 ELSE 'لم تُقرأ هذه الصفحة بعد. هي محفوظة في الطابور، ولم يُحكم عليها بشيء.' END AS reason,
 CASE WHEN n_chars % 2 = 0 THEN '2024-01-05' ELSE '2024-01-31' END AS first_seen_day, sha256(substr(text, 1, 400)) AS excerpt_hash FROM d""")
def placeholder_records(spark, sf):
    """Records of pages nobody could judge, some of them seen before."""
    lang = F.col("lang")
    failed = table(spark, sf, "documents").select(
        F.lit("o").alias("org_id"), F.col("doc_id").cast("string").alias("url"), "text",
        F.when(lang == "fr", "schema").when(lang == "de", "api").otherwise("else").alias("stage"),
        F.when(lang == "fr", "missing seats").when(lang == "de", "socket closed").otherwise("who knows").alias("reason"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("2024-01-05").cast("timestamp")).alias("prior_first_seen"),
        F.lit(None).cast("timestamp").alias("prior_detected"),
    )
    made = records.placeholders(failed, F.lit("2024-01-31 09:00:00").cast("timestamp"))
    return made.select(
        "url", "title", "status", F.array_join("flags", ",").alias("flags"), "reason",
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen_day"), F.sha2("excerpt", 256).alias("excerpt_hash"),
    )


@query("verdict_failures", """
SELECT CASE WHEN lang = 'fr' THEN 'جاء الردّ بصيغة غير متوقّعة، فلم يُقبل. الصفحة محفوظة وستُعاد قراءتها.' WHEN lang = 'de' THEN 'تعذّر الوصول إلى خدمة التصنيف. الصفحة محفوظة وستُقرأ في الجولة القادمة.'
 WHEN lang = 'es' THEN 'تجاوزنا حدّ الطلبات مؤقّتاً. الصفحة محفوظة وستُقرأ في الجولة القادمة.' ELSE 'لم تُقرأ هذه الصفحة بعد. هي محفوظة في الطابور، ولم يُحكم عليها بشيء.' END AS why, count(*) AS pages FROM documents GROUP BY 1""")
def verdict_failures(spark, sf):
    from tidewatch.functions.messages import verdict_failure

    lang = F.col("lang")
    raw = F.when(lang == "fr", "Schema — missing seats").when(lang == "de", "api — socket closed").when(
        lang == "es", "error 429: Rate limit exceeded"
    ).otherwise("something else")
    return table(spark, sf, "documents").groupBy(verdict_failure(raw).alias("why")).agg(F.count("*").alias("pages"))
