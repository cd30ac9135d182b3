import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import queries
from textloom.llm.bpe_automaton import MergeAutomaton
from textloom.llm.vector_packing import Limits, VectorPacker, pack_examples, padding
from textloom.llm.word_tokens import ranks_suffice, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


TOOL = Tokenizer.from_file(PATH)


def library_ids(text):
    return TOOL.encode(text or "", add_special_tokens=False).ids


def check(rows, wanted, limits):
    """wanted: ids by example, with the first that bears loss; returns the padding."""
    ends, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids, loss_from = wanted[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert r["loss_tokens"] == sum(r["start"] + i >= loss_from for i in range(len(part)))
        ends[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["loss_tokens"]))
    for doc, (ids, _) in wanted.items():
        parts = sorted(ends[doc])
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == len(ids)
    lost = 0
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))]
        total = sum(n for _, n, _ in parts)
        assert total <= limits.tokens and len(parts) <= limits.segments and sum(x for _, _, x in parts) <= limits.loss
        lost += 0 if total & (total - 1) == 0 else limits.tokens - total
    return lost


def test_query_packs_every_id_without_padding(spark, docs):
    found = queries.op11_vector_packing(spark, SF)
    wanted = {r["doc_id"]: ([*library_ids(r["text"]), 2], 0) for r in docs.collect()}
    assert check(found.collect(), wanted, Limits()) == 0
    total = padding(found).first()
    assert total["n_tokens"] == sum(len(x) for x, _ in wanted.values()) and total["n_padding"] == 0


def test_turns_keep_the_loss_limit(spark):
    found = [r.asDict() for r in queries.vector_packing_turns(spark, SF).collect()]
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    wanted = {}
    for r in turns:
        ids = [*library_ids(r["text"]), 2]
        wanted[(r["conv_id"], r["turn"])] = (ids, 0 if r["role"] == "assistant" else len(ids) - 1)
    for r in found:
        r["doc_id"] = (r["conv_id"], r["turn"])
    assert len(wanted) == len(turns)
    check(found, wanted, Limits(segments=64, loss=2048))


def test_edge_rows(edge_docs, no_docs):
    rows = edge_docs.collect()
    found = pack_examples(edge_docs.withColumnRenamed("n_chars", "length"), end_id=2).collect()
    count = Counter()
    for r in found:
        count[r["doc_id"]] += r["length"]
    wanted = Counter()
    for r in rows:
        wanted[r["doc_id"]] += len(library_ids(r["text"])) + 1
    assert count == wanted
    assert pack_examples(no_docs, end_id=2).count() == 0
    assert padding(pack_examples(no_docs)).first() == (0, 0, 0)


def test_columns_pass_and_own_names_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 9, [1]), (2, None, "y", 9, None), (2, "", None, 9, [])],
                                 "doc_id long, text string, offset string, start int, tags array<int>")
    found = pack_examples(rows, with_ids=True).collect()
    assert [(r["doc_id"], r["tags"], r["ids"], r["offset"]) for r in found] == [(1, [1], library_ids("a b"), 0)]


def packed(items, limits, **options):
    out = []
    packer = VectorPacker(limits, lambda *x: out.append(x), **options)
    for i, (length, loss_from) in enumerate(items):
        packer.add(i, length, loss_from)
    packer.finish()
    return out


@pytest.mark.parametrize("cut", [True, False])
def test_random_examples_keep_all_limits(cut):
    rng, limits = random.Random(3), Limits(tokens=64, segments=5, loss=20)
    items = [(n := rng.choice([0, 1, 2, 7, 30, 64, 200]), rng.randint(0, n)) for _ in range(4000)]
    out = packed(items, limits, cut=cut)
    rows = [
        {"doc_id": i, "start": s, "length": n, "sequence_id": q, "offset": o, "doc_tokens": items[i][0],
         "loss_tokens": max(0, s + n - max(s, items[i][1])), "ids_crc32": zlib.crc32(struct.pack(f"<{n}I", *range(s, s + n)))}
        for i, s, n, q, o in out
    ]
    lost = check(rows, {i: (list(range(n)), a) for i, (n, a) in enumerate(items)}, limits)
    assert lost == 0 or not cut
    whole = [i for i, (n, a) in enumerate(items) if 0 < n <= 64 and n - a <= 20]
    parts = Counter(i for i, *_ in out)
    assert cut or all(parts[i] == 1 for i in whole)


def test_the_largest_product_is_taken_first():
    # Shares of what is left: after the first example only little loss is free, so the next is the
    # one with many tokens and no loss, not the equally long one with loss.
    out = packed([(6, 0), (3, 0), (3, 3), (1, 1)], Limits(tokens=10, segments=9, loss=8))
    assert [i for i, _, _, q, _ in out if q == 0][:1] == [0]
    assert {i for i, _, _, q, _ in out if q == 0} == {0, 2, 3}


def test_tiny_examples_alone_need_no_padding():
    out = packed([(3, 0)] * 1000, Limits(tokens=64, segments=5))
    filled = Counter()
    for _, _, n, q, _ in out:
        filled[q] += n
    assert all(n & (n - 1) == 0 for n in filled.values()) and sum(filled.values()) == 3000


def test_ids_equal_those_of_the_tokenizers_library():
    rng, tool, own = random.Random(2), Tokenizer.from_file(PATH), word_bpe(PATH)
    assert own.plain
    pool = "ab 'stxLMN\n\t é1½中😀.\x1c\x85<>|ΣİǅꙀ'lld"
    names = [x.removesuffix("</w>") for x in tool.get_vocab()]
    texts = ["".join(rng.choice(pool) for _ in range(60)) for _ in range(2000)]
    texts += ["".join(rng.choice(names) for _ in range(5)) for _ in range(5000)]
    texts += ["", "a<|endoftext|>b", " " * 3000, "aaaa" * 3000]
    for text in texts:
        assert own.encode(text).tolist() == tool.encode(text, add_special_tokens=False).ids


def test_merges_that_ranks_cannot_stand_for_are_seen():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    assert ranks_suffice(MergeAutomaton(vocab, [("a", "b"), ("b", "c"), ("ab", "c")]))
    # "ab" and "c" meet, yet no merge joins them: the one for "abc" names "a" and "bc".
    assert not ranks_suffice(MergeAutomaton(vocab, [("a", "b"), ("b", "c"), ("a", "bc")]))
