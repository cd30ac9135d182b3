import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(root(i), []).append(x)
    lowest = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [lowest[root(i)] for i in range(len(ids))]


def check(found, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    wanted = [
        (r["doc_id"], f"{p:016x}", c)
        for r, p, c in zip(rows, prints, plain_components([r["doc_id"] for r in rows], prints), strict=True)
    ]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_whole_table_against_brute_force(docs):
    check(simhash.near_duplicates(docs), docs)


def test_crowded_keys_are_resolved_without_pairs(docs):
    check(simhash.near_duplicates(docs, pair_limit=1), docs)


def test_edge_rows(edge_docs, no_docs):
    check(simhash.near_duplicates(edge_docs), edge_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_all_pairs_within_two_bits_share_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64)
    b = a.copy().view(np.uint64)
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b)).astype(np.uint64)
    keys_a, keys_b = simhash.golay_keys(a), simhash.golay_keys(b.view(np.int64))
    assert (keys_a[:, :, None] == keys_b[:, None, :]).any(axis=(1, 2)).all()


def test_deduplicate_keeps_one_of_each_group(edge_docs, no_docs):
    kept = simhash.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    # 1 for the texts without words, 5 to 7 and 8 for the repeated line; the null id stays.
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(edge_docs.where("doc_id IS NOT NULL")).collect()}
    assert ids == sorted([*{c for c in prints.values()}, None], key=str)
    assert simhash.deduplicate(no_docs).count() == 0


def test_xxhash_is_the_one_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("née à b"))).first()[0]
    assert row % 2**64 == xxhash.xxh64_intdigest("née à b".encode(), 42)


def test_of_rows_with_one_id_the_same_stays_for_any_order(spark):
    rows = [(1, "one two three four", "a", 5), (1, "one two three four", "b", 5), (1, "other words here now", "c", 5), (2, "more of it then", "d", 5)]
    kept = []
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string, __place string, __stay int").repartition(3)
        found = simhash.deduplicate(table)
        assert found.columns == table.columns
        kept.append(sorted(tuple(r) for r in found.collect()))
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2]
