from collections import Counter

import corpus_pipeline
from test_line_dedup import plain as plain_lines
from test_packing import pieces_of
from test_simhash import plain_components, plain_fingerprint
from textloom.llm import pii
from textloom.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, docs):
    """Language rejects nothing here; the other stages have plain counterparts."""
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {d: t for d, t, _, _ in plain_lines(list(rows.items()))}
    ids = sorted(rows)
    classes = plain_components(ids, [plain_fingerprint(rows[i]) for i in ids])
    rows = {i: rows[i] for i, c in zip(ids, classes, strict=True) if i == c}
    rows = {i: pii.replace(t.encode(), pii.DEFAULT_KEY)[0].decode() for i, t in rows.items()}
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter(pieces_of(rows.items()))


def test_stages_keep_the_columns_and_take_edge_rows(spark, edge_docs, no_docs):
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), name)
            assert docs.columns == start.columns, name
            assert docs.where("n_chars <> length(text)").count() == 0 or name in ("language_id",)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {"doc_id", "sequence_id", "offset"} <= set(last.columns)
