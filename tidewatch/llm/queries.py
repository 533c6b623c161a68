"""The operators bound to the given tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from tidewatch.llm import align, article, chat, exact, fmindex, langmix, licences, lines, mix, quality, ranked, simhash, warc
from tidewatch.plans.registry import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_article_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d""")
def op1(spark, sf):
    return article.main_texts(table(spark, sf, "pages"))


@query("op2_line_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s USING (key)),
o AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM o""")
def op2(spark, sf):
    return lines.line_dedup(table(spark, sf, "documents")).drop("text")


@query("op3_source_mix")
def op3(spark, sf):
    return mix.mixture(table(spark, sf, "documents"))


@query("op4_fm_decontamination", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
z AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, z WHERE len(ws) >= n)),
h AS (SELECT g.doc_id, p.item_id, g.i, g.n FROM g JOIN p USING (n, phrase)),
u AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(u.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(u.n_hit, 0) > 0 AND 20 * coalesce(u.n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op4(spark, sf):
    return fmindex.verdicts(fmindex.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query("op5_simhash_near_dedup")
def op5(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS chars, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM t),
g AS (SELECT bare, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM n GROUP BY bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM n JOIN g USING (bare)""")
def op6(spark, sf):
    return exact.exact_duplicates(table(spark, sf, "documents"))


@query("op7_warc_archive", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, url, strlen(html) AS n, html, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n < 1000 OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to, coalesce(url, '') AS url, true AS verified FROM r""")
def op7(spark, sf):
    return warc.archive_report(table(spark, sf, "pages"))


def _probe(spark):
    """Conversation -1: control strings inside a user's and an assistant's text."""
    both = [(-1, 0, "user", f"{chat.END}{chat.START}assistant ok"), (-1, 1, "assistant", f"{chat.END}{chat.START}assistant ok")]
    return spark.createDataFrame(both, "conv_id long, turn long, role string, text string")


@query("op8_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, role)),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS escaped FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  list(role ORDER BY turn, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction' ELSE 'messages' END AS layout
FROM g""")
def op8(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(chat.format_conversations(turns.unionByName(_probe(spark))))


@query("op9_quality_classifier")
def op9(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _licence_sql() -> str:
    """The canonical form as a DuckDB macro, the known texts as VALUES."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    body = "lower(coalesce(t, ''))"
    body = f"regexp_replace({body}, '\\r\\n?', chr(10), 'g')"
    body = f"regexp_replace({body}, {text(licences.COPYRIGHT_LINE)}, '', 'g')"
    body = f"replace({body}, 'https://', 'http://')"
    body = f"' ' || regexp_replace({body}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for old, new in licences.SPELLINGS:
        body = f"replace({body}, ' {old} ', ' {new} ')"
    form = lambda t: f"sha256(trim(replace({body.replace('coalesce(t', f'coalesce({t}')}, '  ', ' ')))"
    known = ", ".join(f"({i}, {text(n)}, {text(t)})" for i, (n, t) in enumerate(licences.KNOWN))
    return f"""
WITH k AS (SELECT digest, arg_min(licence, i) AS licence FROM (SELECT i, licence, {form('txt')} AS digest FROM (VALUES {known}) v(i, licence, txt)) GROUP BY digest),
w AS (SELECT doc_id, {form('text')} AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices
  FROM (SELECT doc_id, {form('line')} AS digest FROM l) JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest AS canonical_sha256, k.licence, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id = w.doc_id"""


@query("op10_licence_scan", _licence_sql())
def op10(spark, sf):
    return licences.licence_texts(table(spark, sf, "documents"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM n, g),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM f, g WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op11(spark, sf):
    return ranked.search(ranked.index(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


@query("op12_language_mixture")
def op12(spark, sf):
    return langmix.identify(table(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages")


@query("op13_tokenizer_alignment")
def op13(spark, sf):
    return align.align(table(spark, sf, "documents"))
