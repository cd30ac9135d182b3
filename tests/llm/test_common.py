import pyarrow as pa

from textloom.llm import common


def test_slices_keep_all_rows_within_rows_and_bytes():
    texts = ["a" * n for n in (0, 10, 90, 400, 3, 3, 3, 95, 5, 0)] + [None, "z" * 40]
    for batch in (pa.array(texts), pa.array(texts).slice(2, 7), pa.array([x and x.encode() for x in texts], pa.binary()), pa.array([], pa.string())):
        parts = list(common.slices(iter([batch]), rows=4, size=100))
        assert [x for p in parts for x in p.to_pylist()] == batch.to_pylist()
        for p in parts:
            assert 0 < len(p) <= 4 and (len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= 100)
    assert [len(x) for x in common.slices(iter([pa.array(range(9))]), rows=4)] == [4, 4, 1]


def test_batches_of_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, wanted in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(name, given)
            common.text_batches(spark)
            assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)
