import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p == 1 for p, y in pairs if y) / sum(y for _, y in pairs)
    false = sum(p for p, y in pairs if not y) / sum(not y for _, y in pairs)
    assert hit >= 0.85 and false <= 0.03


def test_presence_not_counts():
    once, twice = ({int(h) for part in toxicity.ngrams(t) for h in part} for t in ("ab cd", "AB  cd ab cd"))
    assert once <= twice
    assert list(toxicity.ngrams(" \n")) == []
    table = np.full(1 << toxicity.HASH_BITS, -1, np.int32)
    table[list(once)] = np.arange(len(once))
    assert len(toxicity.present("ab cd ab cd", table)) == len(once)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(5, 1, 0), (6, 0, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (8, 3, 0), (999, 1, 0), (4, 0, 0)],
        "doc_id long, toxic int, label int",
    )
    model = toxicity.fit(edge_docs, labels)
    found = edge_docs.withColumn("score", model.score(F.col("text")))
    scores = {r["doc_id"]: r["score"] for r in found.collect()}
    assert scores[1] == scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    assert no_docs.select(model.score(F.col("text"))).count() == 0


def test_one_label_or_none_gives_the_share(spark, edge_docs):
    labels = spark.createDataFrame([(5, 0), (6, 0)], "doc_id long, toxic int")
    for rows in (labels, labels.limit(0)):
        model = toxicity.fit(edge_docs, rows)
        assert len(model.features) == 0 and edge_docs.select(model.score(F.col("text")).alias("s")).where("s >= 0.3").count() == 0


def plain_grams(text):
    """Hashes of all 3- to 5-grams, by their definition."""
    padded = f" {' '.join(text.lower().split())} "
    if padded == "  ":
        return set()
    out, mask = set(), 0xFFFFFFFF
    for order in toxicity.ORDERS:
        for i in range(len(padded) - order + 1):
            h = ord(padded[i])
            for c in padded[i + 1 : i + order]:
                h = (h * 0x01000193 & mask) ^ ord(c)
            out.add(((h ^ h >> 15) * 0x9E3779B1 & mask) >> (32 - toxicity.HASH_BITS))
    return out


def test_ratios_and_scores_against_plain_python(spark):
    bad, good = ("you awful stinker number {}", "such a stinker he is {}"), ("the garden was quiet on day {}", "seven lights in house {}")
    rows = [(i, (bad if i % 3 == 0 else good)[i % 2].format(i), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    counts = {}
    for _, text, label in rows:
        for gram in plain_grams(text):
            counts.setdefault(gram, [0, 0])[label] += 1
    n = [60, 30]

    def ratio(gram):
        n0, n1 = counts[gram]
        return math.log((n1 + 1) / (n[1] + 2)) - math.log((n0 + 1) / (n[0] + 2))

    def clear(gram):
        n0, n1 = counts[gram]
        return abs(ratio(gram)) / math.sqrt(1 / (n0 + 1) + 1 / (n1 + 1))

    wanted = sorted(counts, key=lambda g: (-clear(g), g))[: max(toxicity.MIN_FEATURES, sum(clear(g) >= toxicity.CLEAR for g in counts))]
    assert sorted(wanted) == model.features.tolist()
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    # The weights are those of a stationary point of the penalised loss over the scaled features.
    for r in docs.withColumn("score", model.score(F.col("text"))).collect():
        margin = model.bias + sum(weight.get(g, 0.0) for g in plain_grams(r["text"]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), rel_tol=1e-6)
    assert all(r["score"] > 0.5 for r in docs.withColumn("score", model.score(F.col("text"))).where("text LIKE '%stinker%'").collect())
