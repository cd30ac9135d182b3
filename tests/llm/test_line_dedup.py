from collections import defaultdict

import pytest

from textloom.llm import line_dedup, queries

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_documents=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc is None else doc
        kept = [x for x in lines if len(holders[key(x)]) < min_documents or max(holders[key(x)]) == own]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(docs, **how):
    found = line_dedup.dedup_lines(docs, counts=("n_lines", "n_dropped"), **how)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_tables_against_plain_python(docs, batches):
    assert run(docs, batches=batches) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert run(edge_docs) == plain(rows)
    assert line_dedup.dedup_lines(edge_docs).columns == edge_docs.columns
    assert run(no_docs) == []


def test_count_columns_replace_those_of_the_table(edge_docs):
    found = line_dedup.dedup_lines(edge_docs, counts=("count", "h1"))
    assert sorted(found.columns) == sorted(edge_docs.columns)
    assert found.where("doc_id = 8").first()["h1"] == 1


def test_runs_are_compacted_and_anti_joined(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen = set()
    for start in (0, 5, 20, 8):
        rows = [(i, i, 100 + start) for i in range(start, start + 10)]
        added = {r["h1"] for r in runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")).collect()}
        assert added == {i for i, _, _ in rows} - seen
        seen |= added
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    runs.close()
    with pytest.raises(ValueError):
        line_dedup.LineRuns(spark, fanout=1)


def test_query_has_sql():
    assert "op5_line_dedup" in queries.SQL
