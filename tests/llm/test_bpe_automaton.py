import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe_automaton, queries
from textloom.llm.bpe_automaton import MergeAutomaton

PATH = public_tokenizers.path("word_bpe_49k.json")


def explicit_arcs(vocab, merges):
    """All arcs by the gadgets as they are defined, in order."""
    base = [t for t in vocab if t not in {a + b for a, b in merges}]
    out = {t: set(base) for t in base}
    for a, b in merges:
        c = a + b
        behind_b = set(out[b])
        out[a].discard(b)
        out[c] = behind_b
        for arcs in out.values():
            if a in arcs:
                arcs.add(c)
    return {(s, t) for s, arcs in out.items() for t in arcs}


def test_arcs_compiled_on_demand_equal_the_explicit_construction():
    rng = random.Random(4)
    for _ in range(40):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        vocab = {t: i for i, t in enumerate(tokens)}
        machine = MergeAutomaton(vocab, merges)
        got = {(s, t) for s in tokens for t in tokens if machine.arc(vocab[s], vocab[t])}
        assert got == explicit_arcs(vocab, merges)


def test_unknown_symbols_are_left_out():
    machine = MergeAutomaton({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    assert machine.encode("axb") == [2] and machine.encode("x") == [] and machine.encode("") == []


def test_whole_table_and_edge_rows_against_the_library(spark, docs, edge_docs):
    from pyspark.sql import functions as F

    tool = Tokenizer.from_file(PATH)
    rows = docs.select("doc_id", "text").unionAll(edge_docs.select("doc_id", "text"))
    found = rows.withColumn("ids", bpe_automaton.encode(F.col("text"), PATH))
    found = found.withColumn("back", bpe_automaton.decode(F.col("ids"), PATH))
    for r in found.collect():
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids
        assert r["back"] == tool.decode(ids, skip_special_tokens=False)


def test_random_text_against_the_library():
    tool, machine, rng = Tokenizer.from_file(PATH), bpe_automaton.tokenizer(PATH), random.Random(5)
    pool = "aaabbc's TSRedllΣσς\n\t é1½中😀.\x1c\x85İ́ñǅ<|endoftext|>"
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(80)) + rng.choice(["", "<|endoftext|>", "<|startoftext|>X"])
        assert machine.encode(text).tolist() == tool.encode(text, add_special_tokens=False).ids


def test_decode_skips_unknown_ids():
    ids = pa.array([[0, -5, 10**6, 1], [], None], pa.list_(pa.int32())).fill_null([])
    assert bpe_automaton.emit(ids.slice(0), bpe_automaton.labels(PATH)).to_pylist() == ["! \"", "", ""]


def test_query_digests(spark):
    row = queries.op3_bpe_automaton(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first()["text"]
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert row["n_tokens"] == len(ids)
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_automaton.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
