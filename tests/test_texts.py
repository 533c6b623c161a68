"""Extraction, filters, addresses, guard, lexicons and redaction on literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import fields, messages
from tidewatch.functions import html as H
from tidewatch.functions import lexicon as L
from tidewatch.functions import text as X
from tidewatch.operators import extract, guard, judge, links, privacy, records, routing


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def page(title, body):
    return f'<!doctype html><html lang="ar"><head><title>{title}</title></head><body>{body}</body></html>'


ANNOUNCEMENT = (
    "<article><h1>تدريب تعاوني صيفي</h1><p>يستقبل مركز البيانات طلبات التدريب التعاوني من طلبة السنة الأخيرة. "
    "المطلوب: أمن سيبراني أو هندسة برمجيات. المتاح سبعة مقاعد، ولكل متدرب ألفا ريال في الشهر. "
    "تنتهي الطلبات يوم 9 صفر 1449. مكان التدريب جدة، وتُرسل الوثائق عبر بوابة المركز.</p></article>"
)


def read(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return extract.extract(df).orderBy("i").collect()


def test_soft_404(spark):
    titles = [
        "404", "Error: that address has moved", "We are sorry, this page cannot be found", "نأسف فالصفحة غير متوفرة اليوم",
        "أيام المهنة في شركتنا", "فرص العمل لدينا", "Work with us", "كيف نصلح الأخطاء في البرامج", None,
    ]
    assert values(spark, titles, H.is_soft_404) == [True] * 4 + [False] * 5


def test_banner_needs_two_phrases_and_a_short_page(spark):
    banner = "كيف تتحقق من أن الموقع حكومي رسمي؟ جميع المواقع الحكومية الرسمية تنتهي بنطاق gov.sa."
    cases = [banner, "This is an official government website. All end with gov.sa", banner + " نص " * 600, "زر الموقع الرسمي", ""]
    assert values(spark, cases, H.is_banner_only) == [True, True, False, False, False]


def test_extraction_regions_and_hash(spark):
    rows = read(spark, [
        page("t", f"<aside>{ANNOUNCEMENT}</aside>"), page("t", f"<header>{ANNOUNCEMENT}</header>"),
        page("t", f"<nav>اتصل بنا</nav>{ANNOUNCEMENT}"), page("t", f"<nav>ب ج د</nav>{ANNOUNCEMENT}"),
        page("t", ANNOUNCEMENT.replace("9 صفر", "8 صفر")), "", "<html><head></head></html>",
        page("x", "<div>" * 500 + "نص" + "</div>" * 500), '<body><script>var t="</p>";</script><p>a&amp;lt; &#1576;&#x628; &copy;</p></body>',
    ])
    assert all("التدريب التعاوني" in r.text for r in rows[:4])
    assert "اتصل بنا" not in rows[2].text
    assert rows[2].hash == rows[3].hash != rows[4].hash
    assert rows[5].chars == 0 and rows[5].title is None and rows[6].chars == 0
    assert rows[7].text == "نص"
    assert rows[8].text == "a&lt; بب ©"


def test_fuller_reading_wins(spark):
    body = f"<article><p>{'ترتيب حسب ' * 30}</p></article><section>{'مقاعد التدريب التعاوني في الصيف. ' * 200}</section>"
    row = read(spark, [page("قائمة", body)])[0]
    assert row.method == "body_fallback" and row.chars > 2000


def test_blocks_split_on_both_scripts(spark):
    text = "This sentence is long enough to keep. وهذه جملة طويلة بما يكفي للبقاء؟ short | another piece that is long enough"
    assert values(spark, [text], H.blocks)[0] == [
        "This sentence is long enough to keep.", "وهذه جملة طويلة بما يكفي للبقاء؟", "another piece that is long enough",
    ]


REAL = [
    "استقبال طلبات التدريب التعاوني في المختبر يبدأ الأحد", "قائمة المتدربين المقبولين هذا الفصل", "انضم إلى تمهير معنا",
    "مسار جديد ضمن تطوير الخريجين", "لدينا فرص للطلاب في الصيف", "Our cooperative training starts in May",
    "Apply for COOP training by Friday", "An internship in the data team", "The graduate development track is back",
    "Two trainees wanted at the lab", "Careers and student pages", "برنامج تأهيل للمبتدئين",
]
NOISE = [
    "حصل المستشفى على جائزة الجودة للمرة الثانية", "زار الوزير مصنع التعبئة يوم الثلاثاء",
    "Shareholders met on Monday to vote on the budget", "Profits fell by a tenth in the spring",
]


def test_training_words(spark):
    assert values(spark, REAL + NOISE, X.mentions_training) == [True] * len(REAL) + [False] * len(NOISE)


def test_addresses(spark):
    same = values(spark, ["https://x.sa/a/", "https://X.sa/a#top", "https://x.sa/a#", "https://x.sa/a"], A.canonical)
    assert set(same) == {"https://x.sa/a"}
    routes = values(spark, ["https://x.sa/#/careers/coop", "https://x.sa/#/careers/graduate", "https://x.sa/#!/a/"], A.canonical)
    assert len(set(routes)) == 3 and routes[2] == "https://x.sa#!/a"
    kinds = values(
        spark,
        ["https://b.sa/en/News/2013/05/careerday", "https://b.sa/ar/careers", "https://careers.b.sa/", "https://b.sa/ar/Pages/default.aspx", "https://b.sa/careers/vision-2030-programme", "https://b.sa/about"],
        lambda u: A.source_type(u, F.lit("site_root"), F.lit(2026)),
    )
    assert kinds == ["announcement_page", "careers_page", "careers_page", "site_root", "careers_page", "announcement_page"]
    assert values(spark, ["https://a.b.gov.sa/x", "https://www.x.com", "https://a.b.example.com:8443/", "nonsense"], A.registered_domain) == ["b.gov.sa", "x.com", "example.com", None]
    assert values(spark, ["https://x.sa/co-op", "https://x.sa/cooperation", "https://training.sa/about", "https://x.sa/%D8%AA%D8%AF%D8%B1%D9%8A%D8%A8"], A.looks_like_training) == [True, False, False, True]


@pytest.mark.parametrize("written,want", [
    ("/careers/apply", "https://h.sa/careers/apply"), ("apply.aspx", "https://h.sa/c/apply.aspx"), ("N/A", None), ("TBD", None),
    ("قدّم عبر البوابة", None), ("apply", None), ("https://x.sa/التدريب", "https://x.sa/التدريب"), ("mailto:a@b.c", None), ("../up/x", "https://h.sa/up/x"), (None, None),
])
def test_apply_urls(spark, written, want):
    df = spark.createDataFrame([(written,)], "t string")
    assert df.select(A.apply_url(F.col("t"), F.lit("https://h.sa/c/page"))).first()[0] == want


def test_cities(spark):
    df = spark.createDataFrame([(["Riyadh", " الرياض ", "Saudi Arabia", "جميع أنحاء المملكة", "Al-Khobar", "رماح", ""],)], "c array<string>")
    assert df.select(A.clean_cities(F.col("c"))).first()[0] == ["الرياض", "الخبر", "رماح"]


def test_normalisation_pairs(spark):
    pairs = [("مُهندسٌ", "مهندس"), ("إدارة أعمال", "اداره اعمال"), ("مقهى", "مقهي"), ("مكتبة", "مكتبه"), ("بـــاب", "باب"), ("جدة\u200f", "جده"), ("كلمة\n\n ثانية", "كلمه ثانيه")]
    left = values(spark, [a for a, _ in pairs], X.normalise_arabic)
    assert left == values(spark, [b for _, b in pairs], X.normalise_arabic)


PAGE = "\n".join([
    "تدريب تعاوني صيفي في مركز البيانات.", "المطلوب: الأمن السيبراني أو هندسة برمجيات.",
    "المكان: الرياض. المقاعد: 7.", "على المتقدم أن ينهي كل مقرراته قبل أول يوم.", "آخر يوم للطلبات: 12 ربيع الأول 1448.",
])


@pytest.mark.parametrize("title,quote,majors,states,faithful", [
    ("تدريب تعاوني صيفي", "على المتقدم أن ينهي كل مقرراته قبل أول يوم", ["الأمن السيبراني"], True, True),
    ("كلمات ليست هنا", None, [], False, False), ("Summer training", None, [], False, False),
    ("تدريب تعاوني صيفي", None, ["Software"], False, False), ("تدريب تعاوني صيفي", None, [], True, False),
    ("تدريب تعاوني صيفي", "جملة غائبة", [], False, False), (None, None, [" "], False, True),
])
def test_guard(spark, title, quote, majors, states, faithful):
    df = spark.createDataFrame([(PAGE, title, quote, majors, states)], "p string, t string, q string, m array<string>, s boolean")
    s = F.lit(None).cast("string")
    got = df.select(guard.invented_wording(F.col("p"), F.col("t"), F.col("q"), s, F.lit("12 ربيع الأول 1448"), F.col("m"), F.array(F.lit("الرياض")), F.col("s"))).first()[0]
    assert (got == []) is faithful


def test_fields(spark):
    texts = ["طلاب الأمن السيبراني", "هندسة مدنية", "هندسة مدنية وعلوم الحاسب", "دعم فني للأجهزة", "برمجة", "المحاسب القانوني", "محاسب", "SOC analyst", "societal", "قسم لاIT", "italy", "تقنية"]
    assert values(spark, texts, fields.field_of) == ["cyber", "none", "it", "general", "it", "none", "none", "cyber", "none", "it", "none", "general"]


def test_redaction(spark):
    texts = [r"failed at C:\Users\bob\work\file.ts: no", r"\\srv\share\a.txt x", "/home/bob/x/y.log: https://a.b/home/x/y", "C:\\", "see https://x.sa/home/a"]
    assert values(spark, texts, X.redact_paths) == [
        f"failed at {L.REDACTED}/file.ts: no", f"{L.REDACTED}/a.txt x", f"{L.REDACTED}/y.log: https://a.b/home/x/y", L.REDACTED, "see https://x.sa/home/a",
    ]


def test_reads_as_no(spark):
    answers = ['{"candidate": false}', '{"candidate": true}', "لا", "لا.", "لا ريب أنه خبر", "لاحظ أن الصفحة", "No", "nothing", "ربما", ""]
    assert values(spark, answers, judge.reads_as_no) == [True, False, True, True, False, False, True, False, False, False]


def test_errors_in_words(spark):
    got = values(spark, ["HTTP 403", "HTTP 502", "robots.txt: timeout", "robots.txt: disallowed", "socket hang up", "تعذّر الوصول إلى الخادم", "who knows"], messages.fetch_error)
    assert got[0] == L.HTTP_ERRORS[403] and got[1] == L.HTTP_ERRORS["5xx"] and got[2] == L.FETCH_ERRORS[1][1]
    assert got[3] == L.FETCH_ERRORS[2][1] and got[5] == "تعذّر الوصول إلى الخادم" and got[6] == L.FETCH_ERROR_OTHER


def test_excerpts_reach_a_buried_announcement(spark):
    buried = "زار الضيوف المصنع ثم عادوا. " * 300 + "مقاعد التدريب التعاوني متاحة. تنتهي 12/03/2026. " + "انتهى. " * 900
    short = values(spark, [buried], X.triage_excerpt)[0]
    assert "التدريب" in short and len(short) < len(buried) / 3
    focused = values(spark, [buried], lambda t: X.focused_excerpt(t, 2000))[0]
    assert "التدريب" in focused and "12/03/2026" in focused and len(focused) <= 2000
    assert values(spark, ["short page"], X.focused_excerpt) == ["short page"]


def test_evidence(spark):
    text = "كلام " * 80 + "مقاعد التدريب التعاوني متاحة" + " كلام" * 80
    df = spark.createDataFrame([(text,), ("short",), ("plain text " * 40,)], "t string")
    rows = [r.e for r in df.select(links.evidence(F.col("t")).alias("e")).collect()]
    assert [r.result for r in rows] == ["verified", "rejected", "watchable"]
    assert rows[0].marker == "التدريب التعاوني" and rows[0].quote.startswith("…") and rows[0].quote.endswith("…")


def test_every_named_reference_is_decoded(spark):
    got = values(spark, ["caf&eacute; &ouml;&lt;&nosuch; &amp;eacute; &notinva;", "&#233;&copy", None], H.decode_entities)
    assert got == ["café ö<&nosuch; &eacute; ∉", "é&copy", None]


@pytest.mark.parametrize("href,want", [
    ("../../../../../../x", "https://h.sa/x"), ("./a/./b/../c/..", "https://h.sa/d/a/"), ("/a/b/c/d/e/f/../../../../../../g", "https://h.sa/g"),
    ("/a//b/.", "https://h.sa/a//b/"), ("/.hidden/x", "https://h.sa/.hidden/x"),
])
def test_dot_segments_go_whatever_their_number(spark, href, want):
    df = spark.createDataFrame([(href,)], "t string")
    assert df.select(A.resolve(F.col("t"), F.lit("https://h.sa/d/page"))).first()[0] == want


REPLY = {
    "isTrainingAnnouncement": True, "product": "coop", "titleAr": "مقاعد", "opensISO": None, "closesISO": None, "opensRaw": None,
    "closesRaw": None, "moreOnPage": False, "majors": [], "seats": 3, "stipendSAR": None, "durationWeeks": 2.5, "cities": [],
    "statesZeroCoursesRule": False, "zeroCoursesQuote": None, "applyUrl": None,
}


@pytest.mark.parametrize("change,ok", [
    ({}, True), ({"majors": [7]}, False), ({"majors": ["\"seats\": 4"], "seats": "4"}, False), ({"seats": "3"}, False), ({"seats": None}, True),
    ({"isTrainingAnnouncement": "true"}, False), ({"cities": None}, False), ({"cities": [None]}, False), ({"titleAr": 5}, False),
    ({"product": None}, False), ({"durationWeeks": 1e3}, True), ({"majors": ["مقاعد"]}, True), ({"majors": {"a": 1}}, False),
])
def test_kinds_of_reply_values(spark, change, ok):
    import json

    text = json.dumps({**REPLY, **change}, ensure_ascii=False)
    df = spark.createDataFrame([(text, 'مقاعد "seats": 4')], "r string, p string")
    got = df.select(judge.parse_reply(F.col("r"), F.col("p")).alias("x")).first().x
    assert got.ok is ok, got


def test_a_judge_of_the_wrong_length_is_a_reason(spark):
    asked = spark.createDataFrame([("f1", 0, "x"), ("f2", 0, "y")], "fingerprint string, rank int, payload string")

    def short(excerpts, insist):
        return ["one"] * (len(excerpts) + 1)

    def broken(excerpts, insist):
        raise OSError("no line")

    for bad, said in ((short, "replies to"), (broken, "OSError: no line")):
        got = judge.judge_pages(asked, bad).collect()
        assert len(got) == 2 and all(not r.ok and r.stage == "api" and said in r.reason for r in got)


def test_a_dollar_is_only_special_at_the_end_of_a_rule(spark):
    from tidewatch.sources.robots import _regex_match

    cases = [("/a$b", "/a$bc", True), ("/a$b", "/ab", False), ("/x.php$", "/x.php", True), ("/x.php$", "/x.php?a", False), ("/*.gif$", "/i/a.gif", True)]
    df = spark.createDataFrame(cases, "rule string, path string, want boolean")
    assert all(r.want == r.got for r in df.select("want", _regex_match(F.col("path"), F.col("rule")).alias("got")).collect())


def test_none_lifts_bounds_and_forgotten_verdicts_are_rows(spark):
    memory = spark.createDataFrame([(f"f{i}", i % 4) for i in range(9)], "fingerprint string, written_at int")
    kept = {r.fingerprint for r in routing.bound_memory(memory, 4).collect()}
    assert len(kept) == 4
    assert {r.fingerprint for r in routing.forgotten(memory, 4).collect()} == {f"f{i}" for i in range(9)} - kept
    assert routing.bound_memory(memory, None).count() == 9 and routing.forgotten(memory, None).count() == 0

    text = spark.createDataFrame([(1, "zz1 zz2 zz3 zz4 zz5")], "i int, text string")
    rules = [("z", "zz[0-9]", None)]
    assert [(r.hits, len(r.samples)) for r in privacy.scan(text, ["i"], rules=rules).collect()] == [(5, 3)]
    assert [(r.hits, len(r.samples)) for r in privacy.scan(text, ["i"], rules=rules, samples=None).collect()] == [(5, 5)]

    label = "التدريب التعاوني " * 10
    found = spark.createDataFrame([("o", "https://a.example/training", label, None)], "org_id string, url string, label string, title string")
    assert [len(r.label) for r in links.score_links(found).collect()] == [60]
    assert [r.label for r in links.score_links(found, label_chars=None).collect()] == [label]

    failed = spark.createDataFrame(
        [("o", "https://a.example/", None, None, "judge", "timeout", "x" * 900)],
        "org_id string, url string, prior_first_seen timestamp, prior_detected timestamp, stage string, reason string, text string",
    )
    as_of = F.lit("2027-01-01").cast("timestamp")
    assert [len(r.excerpt) for r in records.placeholders(failed, as_of).collect()] == [400]
    assert [len(r.excerpt) for r in records.placeholders(failed, as_of, None).collect()] == [900]


def brute_without(markup, kinds):
    out, stack = [], []
    for piece in re.split(rf"(?i)(?=</?(?:{'|'.join(kinds)})(?![\w-]))", markup):
        tag = re.match(rf"(?i)<(/?)({'|'.join(kinds)})(?![\w-])[^>]*>", piece)
        if tag:
            kind = tag[2].lower()
            if not tag[1] and not (kind == "svg" and tag[0].endswith("/>")):
                stack.append((kind, len(out)))
            elif tag[1] and kind in [k for k, _ in stack]:
                while (top := stack.pop())[0] != kind:
                    pass
                del out[top[1]:]
            piece = piece[tag.end():]
        out.append(piece)
    return "".join(out)


def test_nested_chrome_ends_at_its_own_closing_tag(spark):
    kinds = ["nav", "footer", "svg"]
    rnd = random.Random(4)
    bits = ["<nav>", "</nav>", "<footer a='b'>", "</FOOTER >", "<svg/>", "<svg>", "</svg>", "text ", "<b>x</b>", "<nav-bar>", "a", "\n"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    pages += ["<nav>a<nav>b</nav>c</nav>d", "<nav>never closed", "</nav>x", "", "<nav>" * 500 + "in" + "</nav>" * 500 + "out", "x<nav", "x</nav"]
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, m string")
    got = {r.n: r.t for r in rows.select("n", H.without_elements(F.col("m"), kinds).alias("t")).collect()}
    for n, page in enumerate(pages):
        bare = lambda t: re.sub(r"<[a-zA-Z/][^>]*>", "", t)
        assert bare(got[n]) == bare(brute_without(page, kinds)), page


def test_first_difference_counts_characters_in_linear_time(spark):
    rnd = random.Random(4)
    letters = "abأ漢🙂é<>"
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", "ab"), ("ab", "abc"), ("أ", "إ"), ("🙂", "🙃"), ("xé", "xè"), (None, "a"), ("a", None), (None, None)]
    for size in (1, 2, 3, 40, 255, 256, 257, 900):
        for _ in range(12):
            a = "".join(rnd.choice(letters) for _ in range(size))
            at = rnd.randrange(size)
            pairs += [(a, a[:at] + rnd.choice(letters) + a[at + 1:]), (a, a[:at]), (a[:at], a), (a, a + "z")]
    def brute(a, b):
        if a is None or b is None or a == b:
            return None
        return next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
    # Four million characters: comparing from the beginning for every chunk did not end.
    long = "é" * 4_000_000
    pairs.append((long + "a", long + "b"))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, text_before string, text_after string")
    got = {r.i: r.differs_at for r in extract.version_difference(rows).select("i", "differs_at").collect()}
    assert got == {i: brute(a, b) for i, (a, b) in enumerate(pairs)}
