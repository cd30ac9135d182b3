import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def shortened(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def plain_near(words):
    """Near words by every deletion of every word."""
    by_rest, near, known = defaultdict(set), defaultdict(set), set(words)
    for w in words:
        for s in shortened(w) & known:
            near[w].add(s)
            near[s].add(w)
        for i in range(len(w)):
            by_rest[w[:i], w[i + 1 :]].add(w)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(counts, ratio=5):
    near, form, out = plain_near(counts), {}, []
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def plain_counts(rows):
    upper = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def result(found):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect())


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def made_words(seed, size, letters="abé", longest=8):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([1, 2, 9, 50, 300]) for _ in range(size)}


def test_query_against_brute_force(spark, docs):
    found = queries.op13_spelling_variants(spark, SF)
    wanted = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert result(found) == wanted and len(wanted) > 100
    assert any(r[1] for r in wanted) and any(r[4] == 0 for r in wanted)


def test_larger_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op13_spelling_variants(spark, "/root/testdata/sf0.01")
    assert result(found) == plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("most", [1, 3, 40, 10_000])
def test_crowded_partitions_are_split_without_loss(spark, most):
    counts = made_words(most, 600)
    assert result(spelling.variants(table(spark, counts), most=most)) == plain_variants(counts)
    pairs = [tuple(sorted(r)) for r in spelling.near_pairs(table(spark, counts), most=most).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {tuple(sorted((w, v))) for w, near in plain_near(counts).items() for v in near}


def test_partitions_are_bounded(spark):
    counts = {f"same{a}{b}{c}": 1 for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"}
    rows = spelling.partitions(table(spark, counts), most=50)
    assert rows.groupBy("head", "tail").count().agg(F.max("count")).first()[0] <= 50


def test_acceptor_is_minimal_and_numbers_its_strings():
    words = sorted(made_words(5, 300))
    machine = spelling.Acceptor(words)
    rights = {}
    for i, word in enumerate(words):
        q, number = machine.start, 0
        for symbol in word:
            q, before = machine.arcs[q][symbol]
            number += before
        assert machine.final[q] and number == i
    for q in range(len(machine.arcs)):  # no two states have the same continuation
        key = (machine.final[q], tuple(machine.arcs[q].items()))
        assert rights.setdefault(key, q) == q
    assert machine.count[machine.start] == len(words)
    assert spelling.Acceptor([]).count == [0]


def test_edge_rows(spark, edge_docs, no_docs):
    found = spelling.variants(spelling.count_words(edge_docs, slip=199))
    assert result(found) == plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in edge_docs.collect()]))
    assert spelling.variants(spelling.count_words(no_docs)).count() == 0
    rows = [(None, 3, "x"), ("", 4, "x"), ("colour", 5, None), ("colour", 45, "y"), ("color", 2, "z"), ("colors", None, "z")]
    named = spark.createDataFrame(rows, "word string, n long, best string")
    assert result(spelling.variants(named)) == [
        ("color", "colour", "colour", 2, 2, 50), ("colors", "color", "colour", 0, 1, 2), ("colour", None, "colour", 50, 1, None),
    ]


def test_ties_and_very_long_words(spark):
    long = "ab" * 6000
    counts = {long: 60, long[:-1]: 6, long[:400] + long[401:]: 6, "cabaret": 50, "cabarot": 50, "cabarxt": 10, "aaaaaaaa": 9, "aaaaaaa": 1}
    assert result(spelling.variants(table(spark, counts))) == plain_variants(counts)
