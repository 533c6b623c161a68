"""Alignment of two tokenizers against whole-text encodings and a plain double loop."""

import hashlib
import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import align as L
from tidewatch.llm.queries import QUERIES
from tidewatch.plans.registry import table


@pytest.fixture(scope="module")
def pair():
    with open(L.BYTE_BPE, encoding="utf-8") as a, open(L.PIECE_BPE, "rb") as b:
        return L.Pair(a.read(), b.read())


def ends(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at += len(names[i])
    return out


def brute(text, pair):
    """Ids, links and cuts of the text encoded whole, None without tokens."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if not b"".join(pair.a_bytes[i] for i in a) == raw == b"".join(pair.b_bytes[i] for i in b):
        return None
    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    links, first = [], 0
    for i, (s, e) in enumerate(ea):
        while eb[first][1] <= s:
            first += 1
        j = first
        while j < len(eb) and eb[j][0] < e:
            links.append((i, j))
            j += 1
    cuts = sorted({e for _, e in ea} & {e for _, e in eb})
    groups, low = [], 0
    for cut in cuts:
        groups.append((",".join(str(i) for i, (s, e) in zip(a, ea) if low <= s and e <= cut), ",".join(str(i) for i, (s, e) in zip(b, eb) if low <= s and e <= cut)))
        low = cut
    return a, b, links, ";".join("|".join(g) for g in groups)


def brute_report(texts, pair):
    made = [brute(t, pair) for t in texts]
    holders = Counter(p for m in made if m for p in {(m[0][i], m[1][j]) for i, j in m[2]})
    best = {}
    for (a, _), n in holders.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        counts = [(m[0][i], holders[m[0][i], m[1][j]]) for i, j in m[2]]
        out.append((len(m[0]), len(m[1]), m[3].count("|"), len(m[2]), sum(n == best[a] for a, n in counts), sum(n for _, n in counts),
                    hashlib.sha256(m[3].encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "\n", "a", " a", "a ", "  two  spaces   three ", "café été âge", "a  b  c  d", "x 　y\u0085 z", "tab\t end",
    "under▁score", "▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "ภาษา 中文 日本語！", "\U0001f600 emoji \U0001f468‍\U0001f469",
    "null\x00byte \x01\x1f \x7f", "don't we'll 12345 6789.01 +-=*/", "a\r\nb\n\n c", "é ﬁ Ａ", "word " * 400, "x" * 3000, " " * 500, "İ İ",
]


def test_odd_texts_are_aligned_as_if_encoded_whole(pair):
    for text in ODD:
        want = brute(text, pair)
        a, b, links, cuts = L.alignment((text or "").encode(), pair)
        if want is None:
            assert not len(a) and not len(b), text
        else:
            assert (a.tolist(), b.tolist(), list(map(tuple, links.tolist()))) == (want[0], want[1], want[2]), text
            assert cuts.sum() == want[3].count("|")


@given(st.text(alphabet=" \t\n  ▁　abcEéâß中'.,1<s>|", max_size=40))
@settings(max_examples=400, deadline=None)
def test_chunks_never_change_the_tokens(pair, text):
    want = brute(text, pair)
    a, b, links, _ = L.alignment(text.encode(), pair)
    assert (a.tolist(), b.tolist()) == ((want[0], want[1]) if want else ([], []))
    assert list(map(tuple, links.tolist())) == (want[2] if want else [])


def test_both_ways_of_encoding_agree(spark, sf, pair):
    assert pair.a_ranks
    texts = [" " + r.text for r in table(spark, sf, "documents").collect()] + [" " + t for t in ODD if t]
    assert [pair.a_ranks.encode_ordinary(t) for t in texts] == [pair.a.encode(t, add_special_tokens=False).ids for t in texts]
    with open(L.BYTE_BPE, encoding="utf-8") as f:
        held = json.load(f)
    held["model"]["merges"].reverse()
    assert L.merge_ranks(json.dumps(held)) is None


def test_texts_in_many_parts_and_lanes(spark, sf, pair, monkeypatch):
    monkeypatch.setattr(L, "PART_BYTES", 700)
    monkeypatch.setattr(L, "LANE", 5)
    for text in [r.text for r in table(spark, sf, "documents").limit(30).collect()] + ["one two " * 600, "z" * 2000 + " " + "y" * 2000]:
        a, b, links, _ = L.alignment(text.encode(), pair)
        want = brute(text, pair)
        assert (a.tolist(), b.tolist(), list(map(tuple, links.tolist()))) == want[:3]


def test_figures_against_brute_force_with_odd_and_repeated_rows(spark, pair):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(3, "tab\t end"), (3, "tab\t end"), (None, "tab\t end"), (None, None)]
    extra = "doc_id long, text string, block long, pair long, pairs string, n_a string"
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], extra)
    want = sorted(str((i, *f)) for (i, _), f in zip(rows, brute_report([t for _, t in rows], pair)))
    for parts in (1, 5):
        assert sorted(str(tuple(r)) for r in L.align(docs.repartition(parts)).collect()) == want
    assert L.align(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf, pair):
    texts = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *f)) for r, f in zip(texts, brute_report([r.text for r in texts], pair)))
    assert sorted(str(tuple(r)) for r in QUERIES["op13_tokenizer_alignment"](spark, sf).collect()) == want


def test_alignment_itself_is_given(spark, pair):
    docs = spark.createDataFrame([(1, "café au lait"), (2, None), (3, "a▁b")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.alignments(docs).collect()}
    want = brute("café au lait", pair)
    assert (got[1].a_ids, got[1].b_ids, list(zip(got[1].a_linked, got[1].b_linked))) == want[:3]
    assert sum(got[1].ends_group) == want[3].count("|") and got[1].ends_group[-1]
    assert got[2].a_ids == got[3].a_ids == []


def test_a_token_of_nearly_every_document_is_counted_once_a_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the "), F.col("id")).alias("text"))
    got = L.align(docs).agg(F.min("count_sum"), F.max("n_best")).first()
    assert got[0] >= 6000
