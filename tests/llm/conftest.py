import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, key string, h1 long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, and extra
    columns whose names operators might use themselves."""
    long = " ".join(f"word{i % 977} token" for i in range(40_000))
    line = "this very line is repeated in many of the documents"
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a.example.com", 0, 1, "k", 1),
        (3, " \t\n ", "xx", "", 4, 2, "k", 1),
        (4, long, "en", "b.example.com", len(long), 3, "k", 1),
        (5, f"{line}\nown words of document five, which differ", "en", "src", 1, 1, "k", 1),
        (6, f"{line}\nown words of document six, ça diffère", "fr", "src", 1, 1, "k", 1),
        (7, f"  {line.upper()} \nSeven has its own", "en", "src", 1, 1, "k", 1),
        (8, line, "en", "src", 1, 1, "k", 1),
        (9, line, "en", "src", 1, 1, "k", 1),
        (9, line, "en", "src", 1, 1, "k", 1),
        (None, line, "en", "src", 1, 1, "k", 1),
        (10, "pay 4785380592391139 by +1 (743) 555-3824 on 2024-03-05", "en", "src", 1, 1, "k", 1),
        (11, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" é', "en", "src", 1, 1, "k", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
