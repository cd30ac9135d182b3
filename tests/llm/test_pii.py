import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import pii, queries

KEY = b"a test key"


def done(text, key=KEY):
    return pii.replace(text.encode(), key)[0].decode()


@pytest.mark.parametrize("size", [1, 2, 10, 1000, 1771])
def test_permute_is_a_permutation(size):
    assert sorted(pii.permute(i, size, KEY) for i in range(size)) == list(range(size))


def test_values_outside_of_the_domain_are_refused(spark):
    with pytest.raises(ValueError):
        pii.permute(5, 5, KEY)
    with pytest.raises(ValueError):
        pii.pseudonymise(F.lit("x"), b"")


def test_pseudonyms_are_valid_and_linked_across_formats():
    a, b = done("card 4785380592391139.").split()[1][:-1], done("card 4785-3805-9239-1139").split()[1]
    assert a == b.replace("-", "") != "4785380592391139" and pii.luhn_digit(a[:-1]) == a[-1]
    a, b, c = done("+1 (743) 555-3824"), done("+17435553824"), done("(743) 555-3824")
    assert [x for x in a if x.isdigit()] == [x for x in b if x.isdigit()] == ["1", *(x for x in c if x.isdigit())]
    y, m, d = done("on 2024-03-05").split()[1].split("-")
    assert done("on 05.03.2024").split()[1] == f"{d}.{m}.{y}"
    iban = done("DE89 3704 0044 0532 0130 00").replace(" ", "")
    assert pii.iban_check(iban[:2], iban[4:]) == iban[2:4] and iban.startswith("DE")
    ip = done("152.143.123.131")
    assert ip != "152.143.123.131" and all(0 <= int(x) <= 255 for x in ip.split("."))
    assert done("mail ann.lee9@mail2.example.com").endswith("@mail2.example.com") and "ann" not in done("ann.lee9@x.org")
    assert done("123-45-6789") != "123-45-6789"
    assert done("4785380592391139", b"other") != done("4785380592391139")


@pytest.mark.parametrize(
    "text",
    ["4785380592391138", "7086638319846192", "999.1.1.1", "2024-13-45", "000-12-3456", "Version 2.0", "x4785380592391139",
     "DE88370400440532013000", "1.2.3", "a@b", "24be64439e3e49cf46b2d7c90f3602a3", "", "ça 12 % de 300"],
)
def test_what_is_not_valid_stays(text):
    assert done(text) == text


def test_neighbouring_values_are_told_apart():
    text = "4465758382889437 4465758382889437"
    first, second = done(text).split()
    assert first == second != "4465758382889437"


def test_edge_rows(edge_docs, no_docs):
    found = edge_docs.withColumn("x", pii.pseudonymise(F.col("text")))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[1]["x"]["text"] is None and rows[2]["x"]["text"] == "" and rows[4]["x"]["text"] == rows[4]["text"]
    assert rows[10]["x"]["n_values"] == 3 and found.count() == 13
    assert no_docs.select(pii.pseudonymise(F.col("text"))).count() == 0


def test_whole_table_against_plain_replacement(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op9_pii_pseudonyms(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        values = pii.replacements(texts[r["doc_id"]].encode(), pii.DEFAULT_KEY)
        assert r["n_values"] == len(values)
        for start, end, _, _ in values:
            assert texts[r["doc_id"]].encode()[start:end].decode() not in r["text"]


def test_dates_of_timestamps_are_linked_with_plain_dates():
    day = done("2024-05-01 10:00").split()[0]
    assert day != "2024-05-01"
    for end in ("T10:00:00Z", "T10:00:00.123+02:00", "T1000", "T10:00"):
        assert done(f"at 2024-05-01{end}.") == f"at {day}{end}."
    assert done("2024-05-01Test 2024-05-01T1x") == "2024-05-01Test 2024-05-01T1x"


@pytest.mark.parametrize(
    ("iban", "after"),
    [("ES91 2100 0418 4502 0005 1332", " BIC CAIXESBB"), ("AT611904300234573201", " BIC: GIBAATWW"),
     ("SE45 5000 0000 0583 9825 7466", " OCR"), ("SE45 5000 0000 0583 9825 7466", " 2024 OCR"),
     ("DE89 3704 0044 0532 0130 00", " BIC")],
)
def test_an_iban_ends_before_a_following_word(iban, after):
    alone = done(iban)
    assert alone != iban and done(iban + after) == alone + after


def test_a_value_after_an_iban_is_still_found():
    a, b = "SE45 5000 0000 0583 9825 7466", "AT611904300234573201"
    assert done(f"{a} {b}") == f"{done(a)} {done(b)}"
    spaced = "AT61 1904 3002 3457 3201"
    assert done(f"{a} {spaced}") == f"{done(a)} {done(spaced)}"


def test_key_of_the_session(spark):
    assert pii.session_key(spark) == pii.DEFAULT_KEY  # a local session
    spark.conf.set(pii.KEY_SETTING, "another key")
    try:
        assert pii.session_key(spark) == b"another key"
    finally:
        spark.conf.unset(pii.KEY_SETTING)

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="secret key"):
        pii.session_key(Cluster)


def test_small_dates_are_read_day_first():
    # 25 December has no other reading; 4 March and 3 April differ, so one of them is meant.
    days = [pii.replace(text, pii.DEFAULT_KEY)[0] for text in (b"04/03/2024", b"2024-03-04")]
    year_first = days[1].split(b"-")
    assert [int(x) for x in days[0].split(b"/")] == [int(x) for x in year_first[::-1]]


def test_a_cluster_without_a_key_gets_one_of_the_application(spark):
    assert pii.job_key(spark) == pii.DEFAULT_KEY  # a local session

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    class Other(Cluster):
        class sparkContext:
            master, applicationId = "yarn", "app-2"

    own = pii.job_key(Cluster)
    assert own == pii.job_key(Cluster) and 1 <= len(own) <= 64
    assert len({own, pii.job_key(Other), pii.DEFAULT_KEY}) == 3

    class Docs:
        def withColumn(self, name, column):
            raise InterruptedError

    class Setting(Cluster):
        class conf(Cluster.conf):
            get = staticmethod(lambda name, default=None: "1000" if default is None and "arrow" in name else default)

    # The stage gets as far as its column.
    with pytest.raises(InterruptedError):
        corpus_pipeline.pseudonymise(Setting, Docs(), "")


def test_bytes_that_are_no_text_stay(spark):
    raw = b"caf\xe9 \xff 2024-03-05 \xc3"
    docs = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, raw binary")
    found = docs.select("doc_id", pii.pseudonymise(F.col("raw").cast("string"), KEY).alias("x"))
    rows = {r.doc_id: r for r in found.select("doc_id", F.col("x.text").cast("binary").alias("text"), "x.n_values").collect()}
    assert bytes(rows[1].text) == pii.replace(raw, KEY)[0] != raw and rows[1].n_values == 1
    assert rows[2].text is None and rows[2].n_values == 0
