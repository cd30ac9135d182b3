import html as stdlib_html
import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from textloom.functions import html, text

SPACES = [chr(c) for c in range(0x20000) if chr(c).isspace()]


def test_whitespace_functions_know_every_code_point(spark):
    assert len(SPACES) == 29
    samples = [f"{s}a{s}{s}b{s}" for s in SPACES] + ["", " ", "a", "  a  b\n\nc "]
    df = spark.createDataFrame([(s,) for s in samples], "c string")
    for row in df.select(
        "c",
        text.strip("c").alias("strip"),
        text.words("c").alias("words"),
        text.normalise_query("c").alias("query"),
        text.is_blank("c").alias("blank"),
    ).collect():
        assert row.strip == row.c.strip()
        assert row.words == row.c.split()
        assert row.query == " ".join(row.c.split())
        assert row.blank == (not row.c.strip())


def test_null_is_blank(spark):
    df = spark.createDataFrame([(None,)], "c string")
    assert df.select(text.is_blank("c")).first()[0] is True


def test_percent_rounds_half_even_without_thousands_separator(spark):
    values = [0.0625, 0.85, 1.0, 12.3456, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shown = [r[0] for r in df.select(text.percent("x")).collect()]
    assert shown == [f"{v:.1%}" for v in values]


def test_tokens_and_pairs(spark):
    df = spark.createDataFrame([("One é2 a two_3 x Four",), ("",), ("word",)], "c string")
    rows = [r[0] for r in df.select(text.unigrams_and_bigrams(text.tokens("c"))).collect()]
    assert rows[0] == [
        "one", "é2", "two_3", "four", "one é2", "é2 two_3", "two_3 four",
    ]
    assert rows[1] == [] and rows[2] == ["word"]


def test_entities_equal_the_standard_library(spark):
    rnd = random.Random(7)
    names = list(stdlib_html.entities.html5)
    cases = ["&notit;", "&AMPx", "&unknown; &;", "&#0;&#128;&#x1F600;&#xFEFF;&#xD800;", "&#99999999999;"]
    pieces = [
        lambda: "&" + rnd.choice(names),
        lambda: f"&#{rnd.randrange(0x110100)};",
        lambda: f"&#x{rnd.randrange(70000):x}",
        lambda: rnd.choice(["&", " ", "a", "b;", "#", "\n", "&&amp;"]),
    ]
    cases += ["".join(rnd.choice(pieces)() for _ in range(rnd.randrange(1, 8))) for _ in range(1500)]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for row in df.select("c", html.decode_entities("c").alias("d")).collect():
        assert row.d == stdlib_html.unescape(row.c), row.c


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.silent.append(tag)

    def handle_endtag(self, tag):
        if self.silent and self.silent[-1] == tag:
            self.silent.pop()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def parsed(source):
    parser = _Text()
    parser.feed(stdlib_html.unescape(source))
    parser.close()
    joined = re.sub(r"\s+", " ", " ".join(parser.parts))
    return re.sub(r"\s+([.,!?;:])", r"\1", joined).strip()


def test_clean_html_examples(spark):
    expected = {
        "<div>Weighs <em>one parcel</em> !</div>": "Weighs one parcel!",
        "salt &amp; pepper ; both": "salt & pepper; both",
        "belt\t\r\n  seven": "belt seven",
        None: "",
        "": "",
        "foo<b>bar</b>": "foo bar",
        "&lt;b&gt;x": "x",
        "&amp;amp;": "&",
        "a < b": "a < b",
        "a . , b": "a., b",
        "<script>var t='</p><!--';</script>ok<!-- <b> -->z": "ok z",
        "<p title='a>b'>q</p> , r": "q, r",
        "<title>T</title><template><i>no</i></template>x": "T x",
        "<ruby>base<rp>(</rp><rt>note</rt><rp>)</rp></ruby>": "base",
    }
    df = spark.createDataFrame([(c,) for c in expected], "c string")
    got = {r.c: r.d for r in df.select("c", html.clean_html("c").alias("d")).collect()}
    assert got == expected


def test_clean_html_equals_a_parser_on_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", html.clean_html("html").alias("d")).collect():
        assert row.d == parsed(row.html)


def test_long_attributes_do_not_exhaust_the_stack(spark):
    long = "<img src=" + "x" * 200_000 + " alt=\"" + "y>" * 100_000 + "\">z"
    df = spark.createDataFrame([(long,)], "c string")
    assert df.select(html.clean_html("c")).first()[0] == "z"


def test_contains_any_is_a_plain_substring_test(spark):
    df = spark.createDataFrame([("What SHOULD i use",), ("nothing",), ("",)], "c string")
    got = [r[0] for r in df.select(text.contains_any("c", ("what should i use", "x.y"))).collect()]
    assert got == [True, False, False]


def test_let_evaluates_the_body_on_the_value(spark):
    assert spark.range(1).select(text.let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_attributes_equal_a_parser(spark):
    """Random attributes, quotes inside unquoted values among them."""
    rnd = random.Random(7)
    names = ["href", "a", "data-x", "it's", 'q"q']
    values = ["", "=v", "=it's", '=a"b', '="x > y"', "='p > q'", "=a/b", '="it\'s"', "=\u00e9", " = w"]
    sources = []
    for _ in range(400):
        attributes = "".join(
            rnd.choice([" ", "\n", "  "]) + rnd.choice(names) + rnd.choice(values) for _ in range(rnd.randrange(4))
        )
        sources.append(f"<p{attributes}>don't stop</p> now <b{attributes} >x</b>y")
    sources += ["<a href=it's>don't stop</a> now", "<a href=it's>stop</a> now", '<p title=a"b>x</p> y']
    df = spark.createDataFrame([(s,) for s in sources], "c string")
    for row in df.select("c", html.strip_markup("c").alias("d")).collect():
        data = []
        parser = HTMLParser()
        parser.handle_data = data.append
        parser.feed(row.c)
        parser.close()
        assert "".join(row.d.split()) == "".join("".join(data).split()), row.c
