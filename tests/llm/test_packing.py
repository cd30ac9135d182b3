import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import packing, queries, tokens


def pieces_of(rows):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        start, length = 0, len(ids) % 1024 or 1024
        for piece in range(-(-len(ids) // 1024)):
            part = ids[start : start + length]
            out.append((doc, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
            start, length = start + length, 1024
    return sorted(out, key=str)


def check(found, docs):
    rows = found.collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    wanted = pieces_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    return len(sequences), sum(r["length"] for r in rows)


def test_whole_table_is_packed_closely(docs):
    n, total = check(queries.packed_pieces(docs), docs)
    assert n <= total / 1024 * 1.02 + 1


def test_many_small_partitions_share_sequences(docs):
    n, total = check(queries.packed_pieces(docs.repartition(40)), docs)
    assert n <= total / 1024 * 1.05 + 2


def test_edge_rows(edge_docs, no_docs):
    check(queries.packed_pieces(edge_docs), edge_docs)
    assert queries.packed_pieces(no_docs).count() == 0


def test_columns_pass_and_own_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7], "x", 9), (2, None, "y", 9)], "a long, ids array<int>, offset string, piece int")
    found = packing.pack(packing.cut(rows, capacity=2), capacity=2)
    assert set(found.columns) == {"a", "ids", "piece", "start", "length", "sequence_id", "offset"}
    assert sorted((r["a"], r["piece"], list(r["ids"])) for r in found.collect()) == [(1, 0, [5]), (1, 1, [6, 7]), (2, 0, [])]


def test_one_pass_gives_the_pieces_of_the_steps(spark, docs):
    few = docs.limit(40).withColumn("tags", F.array("lang", "source")).withColumn("piece", F.lit("x"))
    ids = few.select("doc_id", "tags", tokens.token_ids(F.col("text"), end_id=7).alias("ids"))
    steps = packing.cut(ids, capacity=100).withColumn("ids_crc32", packing.ids_crc32("ids")).drop("ids")
    whole = packing.pack_texts(few, end_id=7, capacity=100).drop("lang", "source", "n_chars")
    names = ("doc_id", "tags", "piece", "start", "length", "ids_crc32")
    assert whole.columns == [*names, "sequence_id", "offset"]
    assert sorted(map(str, whole.select(*names).collect())) == sorted(map(str, steps.select(*names).collect()))


def test_best_fit_takes_the_least_space_and_closes_the_fullest():
    bins = packing.BestFit(capacity=10, open_bins=2)
    assert [bins.add(x) for x in (6, 7, 3, 8, 5)] == [(0, 0), (1, 0), (1, 7), (2, 0), (3, 0)]
    assert bins.still_open() == [(0, 6), (3, 5)]
    with pytest.raises(ValueError):
        bins.add(11)


def test_random_items_never_overflow():
    rng, bins, filled = random.Random(1), packing.BestFit(100, 5), {}
    for _ in range(3000):
        length = rng.randrange(0, 101)
        number, offset = bins.add(length)
        assert offset == filled.get(number, 0)
        filled[number] = offset + length
    assert max(filled.values()) <= 100 and bins.n_open <= 5


def test_ids_equal_those_of_the_tokenizers_library(spark):
    rng = random.Random(2)
    pool = "ab 'stx\n\t é1½中😀.\x1c\x85<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(60)) for _ in range(200)] + ["", "a<|endoftext|>b", " " * 3000]
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens.token_ids(F.col("text")).alias("ids"))
    for r in rows.collect():
        assert list(r["ids"]) == tool.encode(r["text"], add_special_tokens=False).ids
