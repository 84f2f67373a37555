import hashlib

import pytest
from pyspark.sql import functions as F

from pageloom.functions import dates, encoding, html, text, urls
from pageloom.search.analysis import tokens


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://example.com", "https://example.com"),
        ("chrome-extension://e/s.html?url=https%3A%2F%2Fexample.com%2Fpage", "https://example.com/page"),
        ("chrome-extension://e/s.html?url=https%253A%252F%252Fexample.com", "https://example.com"),
        ("chrome-extension://e/s.html?other=123", None),
        ("chrome-extension://e/s.html?url=nothing", None),
        ("chrome-extension://e/s.html?url=&url=http%3A%2F%2Fa.b%2Fx+y", "http://a.b/x y"),
        ("chrome-extension://e/s.html?url=http%3A%2F%2Fa.b%2F100%", "http://a.b/100%"),
        ("chrome-extension://e/s.html?t=1&url=http%25253A%25252F%25252Fa.b%25252Fc%25252Bd#x", "http://a.b/c+d"),
        ("chrome-extension://e/s.html", None),
    ],
)
def test_suspended_url_rewrite(column, url, expected):
    assert column(urls.suspended_url_rewrite, [url]) == [expected or url]


def test_domain_extract(column):
    cases = {
        "https://www.example.com/page": "example.com",
        "http://sub.domain.org": "sub.domain.org",
        "invalid": "",
        None: "",
        "http://u@www.X.com:80/a": "u@www.x.com:80",
        "http://WWW.a.com?q=1": "a.com",
        "//host/path": "host",
        "http://[::1/x": "",
        "http://[::1]:8080/x": "[::1]:8080",
        "http://a.b/ä|^": "a.b",
    }
    found = column(urls.domain_extract, list(cases))
    # NULL in gives NULL or empty; the store keeps it as empty.
    assert [f or "" for f in found] == list(cases.values())


def test_video_id_and_route(column):
    cases = ["https://www.youtube.com/watch?v=VIDEO_ID_11", "youtu.be/VIDEO_ID_11?t=3", "https://x.org/youtu.be/VIDEO_ID_11", "https://youtu.be/short"]
    assert column(urls.video_id_extract, cases) == ["VIDEO_ID_11", "VIDEO_ID_11", None, None]
    assert column(urls.site_route, ["https://www.zhihu.com/q/1", "https://example.com"]) == ["selenium", "requests"]


def test_hashes(column):
    assert column(urls.url_hash, ["https://ü.com"]) == [hashlib.sha256("https://ü.com".encode()).hexdigest()]


@pytest.mark.parametrize(
    "raw",
    ["  Hello  \n\n  World  ", "", "\n \n", "a\r\n\tb \n　c\x1f\nd e", "one", "x\x0b\ny \x85\n\n\nz", "a  b\n c"],
)
def test_clean_text_like_python(column, raw):
    expected = "\n".join(line for line in (part.strip() for part in raw.split("\n")) if line)
    assert column(text.clean_text, [raw]) == [expected]


def test_cut(column):
    assert column(lambda c: text.cut(c, 10), ["a" * 10, "a" * 11]) == ["a" * 10, "a" * 10 + "..."]


def test_date_extract(spark):
    cases = [
        ("2023-01-01T12:00:00", None, "2023-01-01"),
        ("2023-01-01T12:00:00Z", None, "2023-01-01"),
        ("2023-01-01T23:30:00-05:00", None, "2023-01-01"),
        ("2023-01-01", None, "2023-01-01"),
        (None, "2023-02-02 12:00:00", "2023-02-02"),
        (None, None, "2024-06-01"),
        ("N/A", "2023-02-02 12:00:00", "2023-02-02"),
        ("1704067207.5", "2023-02-02 12:00:00", "2023-02-02"),
        ("2023-13-45T00:00:00", None, "2024-06-01"),
        ("Tuesday", None, "2024-06-01"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, added string, crawled string, expected string")
    day = dates.date_extract(F.col("added"), F.col("crawled").cast("timestamp"), F.lit("2024-06-01"))
    assert [r[0] for r in df.orderBy("i").select(day.cast("string")).collect()] == [c[2] for c in cases]


def test_encoding_suspect(column):
    cases = ["short", "a" * 100 + "\x80", "\x80a" * 20, "\x80" * 20, "Test" + "\x80" * 12, None, "a" * 1000 + "\x80" * 2000]
    assert column(encoding.encoding_suspect, cases) == [False, False, False, True, False, False, True]


@pytest.mark.parametrize("charset, original", [("utf-8", "éàüöß" * 6), ("gbk", "中文网页内容" * 5), ("euc_jp", "日本語の頁" * 5)])
def test_encoding_repair(column, charset, original):
    garbled = original.encode(charset).decode("latin-1")
    plain = "nothing wrong with this text"
    assert column(lambda c: encoding.encoding_repair(c, charset), [garbled, plain, None]) == [original, plain, None]


def test_encoding_repair_replaces_bad_bytes(column):
    garbled = "é".encode().decode("latin-1") * 12 + "\xff" * 4
    assert column(lambda c: encoding.encoding_repair(c, "utf-8"), [garbled]) == ["é" * 12 + "�" * 4]


PAGE = """<!DOCTYPE html><html><head><title> A &amp;lt; B&#33; </title><style>p{x:1}</style>
<script>if (a < b) { t = "<p>no</p>" } // <!-- </script><meta charset="x"><link rel="y"></head>
<body><header class=h>top</header><nav><a href="/x">nav</a></nav><!-- gone <b>too</b> -->
<p title="a > b">One <b>two</b>&nbsp;</p><div>caf&eacute; &#x4e2d;&euro; &nosuch; AT&T</div><FOOTER>end</FOOTER></body></html>"""


def test_html_text_and_title(column):
    assert column(html.html_title_extract, [PAGE, "<p>x</p>", "<title> \n</title>", None]) == ["A &lt; B!", "No Title", "No Title", "No Title"]
    assert column(lambda c: text.clean_text(html.html_text_extract(c)), [PAGE]) == ["A &lt; B!\nOne\ntwo\ncafé 中€ &nosuch; AT&T"]


def test_fetched_page(column):
    page = "<html><head><title>Title</title></head><body>Content</body></html>"
    assert column(lambda c: text.clean_text(html.html_text_extract(c)), [page]) == ["Title\nContent"]


def test_article_extract(column):
    nested = '<div class="x">a</div><div id=1 class="RichText ztext"><div>one <i> two </i></div><div><div>three</div></div></div><p>rest</p>'
    cases = [
        '<html><body><div class="Post-RichText">Content</div></body></html>',
        nested,
        "<body><script>var a</script><p> all </p> <p>text</p></body>",
        "<div class='AuthorInfo'>who</div><article>later</article>",
        "<section><article>the <b>article</b></article>no</section>",
        '<span class="RichTextual">not this</span><article>this</article>',
    ]
    assert column(html.article_extract, cases) == ["Content", "onetwothree", "alltext", "who", "thearticle", "this"]
    plain = column(lambda c: html.article_extract(c, (".Post-RichText", ".RichText"), strip_nodes=False), [nested, cases[3]])
    assert plain == ["one  two three", "wholater"]


def test_search_key(spark):
    df = spark.createDataFrame(
        [(1, "g", "i", "u"), (2, "N/A", "i", "u"), (3, "N/A", "N/A", " u "), (4, "", None, None)], "n int, guid string, id string, url string"
    )
    found = df.orderBy("n").select(urls.search_key(F.col("guid"), F.col("id"), F.col("url"))).collect()
    assert [r[0] for r in found] == ["g", "i", "u", ""]


def test_tokens(column):
    cases = ["The Quick, quick fox's v1.2.3 a_b .x. I Ünïcode 中文 to", None, "", "..a..b.."]
    assert column(tokens, cases) == [["quick", "quick", "fox", "v1.2.3", "a_b", "ünïcode", "中文"], [], [], []]


def test_dropped_elements_nested_and_unclosed(column):
    cases = {
        "a<nav>x<nav>y</nav>z</nav>b": "a\nb",
        "a<header>x<nav>y</header>z</nav>b": "a\nb",
        "a<nav>x": "a",
        "a</nav>b<footer>c</footer>d": "a\nb\nd",
        "a<NAV class='n'>x<p>y</p></NAV >b<navy>c</navy>": "a\nb\nc",
        "<header><header><header>x</header></header></header>a": "a",
        "a<nav>x</nav>b<nav>y</nav>c": "a\nb\nc",
        "no tags": "no tags",
    }
    got = column(lambda c: text.clean_text(html.html_text_extract(c)), list(cases))
    assert got == list(cases.values())


def test_many_unclosed_elements_take_linear_time(column):
    import time

    page = "a" + "<nav>x" * 50_000
    start = time.time()
    assert column(lambda c: text.clean_text(html.html_text_extract(c)), [page, "<nav>" * 20_000 + "</nav>" * 20_000 + "b"]) == ["a", "b"]
    assert time.time() - start < 60


def test_charsets_are_found_row_by_row(spark):
    from pageloom.functions import charsets

    russian = "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. "
    polish = "Zażółć gęślą jaźń, pchnąć w tę łódź jeża lub ośm skrzyń fig. Ćśżźńłóęą ąęółńśćżź ŚĆŻŹŃŁÓĘĄĄĘÓŁŃŚĆŻŹ. "
    japanese = "いろはにほへとちりぬるを、わかよたれそつねならむ。うゐのおくやまけふこえて、あさきゆめみしゑひもせす。"
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜。"
    french = "Voilà où ça éèêëàâäáéèêëàâäá mène: les élèves déçus répétaient naïvement leurs leçons à Noël. "
    learned = [(t * 3,) for t in (russian, polish, japanese, chinese, french)] + [(t[5:60],) for t in (russian, polish, japanese, chinese, french)]
    model = charsets.fit_charsets(spark.createDataFrame(learned, "text string"))
    own = {"utf-8": (russian, polish, japanese, chinese, french), "cp1251": (russian,), "koi8-r": (russian,), "cp1250": (polish,), "shift-jis": (japanese,), "gb18030": (chinese,), "latin-1": (french,)}
    cases = [(charset, t, t.encode(charset).decode("latin-1")) for charset, texts in own.items() for t in texts]
    cases += [("ascii", "plain text only, nothing else in it at all", "plain text only, nothing else in it at all"), ("none", None, None)]
    df = spark.createDataFrame(cases, "charset string, good string, bad string")
    got = df.select("charset", "good", charsets.encoding_repair_any(F.col("bad"), model, df).alias("now"), charsets.charset_find(F.col("bad"), model, df).alias("found")).collect()
    wrong = [(r["charset"], r["found"], r["now"]) for r in got if r["now"] != r["good"]]
    assert not wrong, wrong
    assert all(r["found"] is None or 0 <= r["found"]["confidence"] <= 1 for r in got)
