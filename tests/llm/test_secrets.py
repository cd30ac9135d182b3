import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, secrets

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def plain(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x for _, _, x in sorted(out)]


def test_whole_table_against_plain_patterns(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = queries.op8_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("crf")] == base
        assert r["n_assign"] == sum(x.startswith("assign") for x in base)


def test_patterns_on_hard_texts():
    for text in (
        'é PassWord" : \'abc/def.=-', "token = = abcdef", "token = abc", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " é AKIAAKIA" + "9" * 20,
        "0" * 23, "é" + "a" * 24 + "G" + "f" * 30, "ſecret=abcdefgh api_key=XYZabc apikey:123456", "", "tokentoken=aaaaaa",
    ):
        data = text.encode()
        spans = secrets.base_spans(data)
        places = sorted({p for a, b, _ in spans for p in (a, b)})
        at = dict(zip(places, secrets.unicode_offsets(data, places), strict=True))
        assert [f"{k}:{at[a]}:{at[b]}" for a, b, k in spans] == plain(text)


def trained(n=120):
    import random

    rng = random.Random(1)
    words = "the of and thing house garden seven light".split()

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    keyed = [f'{prose(30)} token = "{rng.randbytes(20).hex()}" {prose(30)}'.encode() for _ in range(n)]
    texts = keyed + [prose(80).encode() for _ in range(n)]
    return secrets.train(w for t in texts for w in secrets.windows_of(t)), rng, prose


def test_the_field_finds_what_no_pattern_matches():
    model, rng, prose = trained()
    hits = 0
    for _ in range(20):
        data = f'{prose(20)} token is "{rng.randbytes(20).hex().upper()}" {prose(20)}'.encode()
        found = secrets.spans(data, model)
        hits += any(k == "crf" for _, _, k in found)
    assert hits >= 15
    assert not any(secrets.spans(prose(60).encode(), model) for _ in range(30))


FRAMINGS = (
    "the deploy key is {} for now", "Authorization Bearer {} sent", "credential -> {} (rotate it)", "use {} to log in",
    'signing material "{}" was checked in', "AUTH={} in the shell",
)


@pytest.fixture(scope="module")
def large(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, secrets.fit(docs)


def test_unseen_framings_and_alphabets(large):
    """Fitted on the given table: nine of ten values that no pattern matches are found."""
    import base64
    import random

    (docs, model), rng = large, random.Random(8)
    prose = [r["text"] for r in docs.where("length(text) > 900").orderBy("doc_id").limit(40).collect()]
    for framing in FRAMINGS:
        hits = 0
        for i in range(40):
            raw = rng.randbytes(24)
            value = (raw.hex().upper(), base64.b64encode(raw).decode())[i % 2]
            before, after = prose[i][:400].rsplit(" ", 1)[0], prose[i][500:800].split(" ", 1)[-1]
            head = f"{before} {framing.split('{}')[0]}".encode()
            data = head + value.encode() + f"{framing.split('{}')[1]} {after}".encode()
            assert not any(a <= len(head) < b for a, b, _ in secrets.base_spans(data))
            hits += any(a <= len(head) and len(head) + len(value.rstrip("=")) <= b for a, b, k in secrets.spans(data, model) if k == "crf")
        assert hits >= 36, (framing, hits)


def test_clean_texts_are_left_alone(large):
    docs, model = large
    rows = docs.select(secrets.secret_spans(F.col("text"), model).alias("s"))
    clean = rows.where("NOT exists(s, x -> x.kind <> 'crf')")
    assert clean.where("size(s) > 0").count() <= max(1, clean.count() // 1000)


def test_rare_matches_are_in_the_sample(spark):
    rows = [(f"the password policy and the token of thanks number {i}" if i % 2000 else f'token = "{i:030x}" here',) for i in range(8000)]
    table = spark.createDataFrame(rows, "text string").repartition(4)
    model = secrets.fit(table, max_training=50)
    assert any(k.startswith("entropy") for k in model.names)
    data = b'number 7 token is "0011223344556677889900AABBCCDDEEFF" here'
    assert [k for _, _, k in secrets.spans(data, model)] == ["crf"]


def test_windows_mark_the_value_alone():
    window, = secrets.windows_of(b'so the Secret : "abc123" was')
    assert [w for w, t in zip(window.words, window.tags) if t] == [b'"abc123"']
    odd, = secrets.windows_of(b"one two v1.2.3 three")
    assert not any(odd.tags) and secrets.windows_of(b"") == []


def test_decoding_in_parts_equals_viterbi_over_the_whole():
    model, rng, prose = trained(60)
    for _ in range(30):
        data = f'{prose(9)} key "{rng.randbytes(12).hex()}" 12-3 = x_y {prose(9)} token: {rng.randbytes(9).hex()} {prose(5)}'.encode()
        words, tags = model.tags(data)
        own = [secrets.features_of(w) for w in words]
        emit = np.array([model.scores(f, "") for f in own]) + model.scores(secrets.file_features(data), "")
        emit[1:] += [model.scores(f, "before ") for f in own[:-1]]
        emit[:-1] += [model.scores(f, "after ") for f in own[1:]]
        assert (model.viterbi(emit) == tags).all()


def test_edge_rows(edge_docs, no_docs):
    model = secrets.fit(edge_docs)
    found = edge_docs.withColumn("spans", secrets.secret_spans(F.col("text"), model))
    by = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert by[1] == by[2] == by[3] == []
    assert [s["kind"] for s in by[11] if s["kind"] != "crf"] == ["assign", "hex"]
    empty = secrets.fit(no_docs)
    assert no_docs.select(secrets.secret_spans(F.col("text"), empty)).count() == 0
