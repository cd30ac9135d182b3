import json

import pytest
from pyspark.sql import functions as F

from textloom import fixed
from textloom.operators.catalog import extract_operations
from textloom.sources import corpus, files, models, tables

MODEL = {
    "metadata": {"serviceFullName": "Parcel Sorting", "apiVersion": "v7", "protocol": "any"},
    "operations": {
        "WeighParcel": {"documentation": "<i>Weighs</i> one parcel", "http": {"method": "PUT"}},
        "RouteParcel": {"documentation": "Picks a belt"},
    },
}


def write_models(folder, **named):
    folder.mkdir()
    for name, model in named.items():
        (folder / f"{name}.json").write_text(model if isinstance(model, str) else json.dumps(model, indent=1))
    return str(folder)


def test_models_are_read_in_list_order(spark, tmp_path):
    folder = write_models(tmp_path / "m", example=MODEL, other=MODEL, ignored=MODEL)
    read = models.read_service_models(spark, folder, ["other", "example"])
    rows = extract_operations(read).orderBy("list_pos", "pos").collect()
    assert [(r.service, r.operation) for r in rows] == [
        ("other", "WeighParcel"), ("other", "RouteParcel"),
        ("example", "WeighParcel"), ("example", "RouteParcel"),
    ]
    assert rows[0].service_name == "Parcel Sorting"
    assert rows[0].api_version == "v7"
    assert rows[0].description == "<i>Weighs</i> one parcel"
    assert models.read_service_models(spark, folder, models.ALL_SERVICES).count() == 3
    assert models.read_service_models(spark, folder, ["other", "other"]).count() == 2 * models.read_service_models(spark, folder, ["other"]).count()
    with pytest.raises(Exception, match="FileNotFound"):
        models.read_service_models(spark, folder).count()


def test_empty_list_gives_nothing_and_missing_service_fails(spark, tmp_path):
    folder = write_models(tmp_path / "m", example=MODEL)
    assert models.read_service_models(spark, folder, []).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        models.read_service_models(spark, folder, ["example", "absent"]).count()


def parse(spark, model):
    df = spark.createDataFrame([("s", 0, model)], "service string, list_pos int, model string")
    return models.parse_service_models(df)


def test_absent_documentation_and_no_operations(spark):
    bare = {"metadata": MODEL["metadata"], "operations": {"A": {}, "B": {"documentation": None}}}
    rows = extract_operations(parse(spark, json.dumps(bare))).collect()
    assert [r.description for r in rows] == ["", ""]
    none = {"metadata": MODEL["metadata"], "operations": {}}
    assert extract_operations(parse(spark, json.dumps(none))).count() == 0


def test_repeated_json_key_keeps_its_last_value(spark):
    text = (
        '{"metadata": {"serviceFullName": "S", "apiVersion": "1"}, "operations": '
        '{"A": {"documentation": "old"}, "B": {"documentation": "b"}, "A": {"documentation": "new"}}}'
    )
    rows = extract_operations(parse(spark, text)).orderBy("pos").collect()
    assert [(r.operation, r.description) for r in rows] == [("A", "new"), ("B", "b")]
    assert {k: v["documentation"] for k, v in json.loads(text)["operations"].items()} == {"A": "new", "B": "b"}


@pytest.mark.parametrize("gone", ["serviceFullName", "apiVersion"])
def test_missing_metadata_is_an_error(spark, gone):
    broken = json.loads(json.dumps(MODEL))
    del broken["metadata"][gone]
    with pytest.raises(Exception, match=gone):
        extract_operations(parse(spark, json.dumps(broken))).collect()


def test_default_allow_list(spark):
    assert len(fixed.DEFAULT_SERVICES) == 26
    df = spark.createDataFrame([(s,) for s in (*fixed.DEFAULT_SERVICES, "extra")], "service string")
    rows = models.select_services(df).orderBy("list_pos").collect()
    assert [r.service for r in rows] == list(fixed.DEFAULT_SERVICES)
    assert models.select_services(df, []).count() == 0
    with pytest.raises(ValueError, match="absent"):
        models.select_services(df, ["s3", "absent"])


def test_parquet_contract(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("s3", "Op", "text", 1)], "service string, operation string, description string, more int").write.parquet(path)
    assert tables.load_table(spark, path).columns == ["service", "operation", "description", "more"]
    with pytest.raises(ValueError, match=r"Missing required columns: \['absent', 'other'\]"):
        tables.load_table(spark, path, ("service", "other", "absent"))


def write_csv(tmp_path, body):
    path = tmp_path / "intents.csv"
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_intent_csv(spark, tmp_path):
    path = write_csv(
        tmp_path,
        'note,service,description\nx, s3 ,"store, ""many"" files"\ny,rds,"two\nlines "\nz,S3,  plain\n',
    )
    rows = tables.load_intents(spark, path).collect()
    assert {tuple(r) for r in rows} == {
        ("s3", 'store, "many" files'), ("rds", "two\nlines"), ("S3", "plain"),
    }


@pytest.mark.parametrize(
    "body, message",
    [
        ("service\ns3\n", r"Missing intent columns: \['description'\]"),
        ("service,description\ns3,NA\n", "missing values"),
        ("service,description\ns3,\n", "missing values"),
        ('service,description\ns3,"  "\n', r"empty values in: \['description'\]"),
        ('service,description\n" ",x\ns3,null\n', "missing values"),
    ],
)
def test_intent_csv_is_validated(spark, tmp_path, body, message):
    with pytest.raises(ValueError, match=message):
        tables.load_intents(spark, write_csv(tmp_path, body))


def test_operation_sink_forces_the_schema(spark, tmp_path):
    path = str(tmp_path / "a" / "b" / "ops")
    df = spark.createDataFrame([("Op", "s3", 5)], "operation string, service string, surplus int")
    tables.write_operations(df, path)
    tables.write_operations(df, path)
    stored = spark.read.parquet(path)
    assert stored.columns == list(fixed.OPERATION_COLUMNS)
    assert [tuple(r) for r in stored.collect()] == [("s3", None, None, "Op", None)]


def test_corpus_reads_only_text_files_of_the_folder(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    for name in ("b.txt", "a b+c%20.txt", "skip.TXT", "notes.md"):
        (folder / name).write_bytes("première\r\nline".encode())
    (folder / "sub").mkdir()
    (folder / "sub" / "deep.txt").write_text("deep")
    rows = corpus.load_documents(spark, str(folder)).orderBy("source").collect()
    assert [r.source for r in rows] == ["a b+c%20.txt", "b.txt"]
    assert rows[0].text == "première\nline"


def test_hidden_names_and_empty_files_are_documents(spark, tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    for name, text in (("_notes.txt", "a"), (".hidden.txt", "b"), ("empty.txt", ""), ("plain.txt", "c")):
        (folder / name).write_text(text)
    for tasks in (1, 3, 50):
        rows = corpus.load_documents(spark, str(folder), tasks).collect()
        assert sorted(map(tuple, rows)) == [(".hidden.txt", "b"), ("_notes.txt", "a"), ("empty.txt", ""), ("plain.txt", "c")]
    assert corpus.load_documents(spark, f"file://{folder}").count() == 4


def test_only_listed_files_are_opened(spark, tmp_path):
    folder = write_models(tmp_path / "m", _example=MODEL, other=MODEL)
    (tmp_path / "m" / "broken.json").mkdir()  # would fail if it were opened
    rows = files.read_files(spark, folder, ".json", names=["other", "_example", "other"]).orderBy("list_pos").collect()
    assert [(r.name, r.list_pos) for r in rows] == [("other", 0), ("_example", 1), ("other", 2)]
    assert rows[0].text == rows[2].text and json.loads(rows[1].text) == MODEL
    assert models.read_service_models(spark, folder, models.ALL_SERVICES).count() == 2


def test_corpus_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="not found"):
        corpus.load_documents(spark, str(tmp_path / "absent"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.md").write_text("x")
    with pytest.raises(FileNotFoundError, match="No .txt documents"):
        corpus.load_documents(spark, str(tmp_path / "empty"))


def test_json_records_are_checked_one_by_one(spark):
    full = {c: c for c in fixed.OPERATION_COLUMNS}
    short = {"service": "s", "operation": None, "api_version": "1"}
    good = spark.createDataFrame([(json.dumps({**full, "more": 1}),)], "record string")
    assert [tuple(r) for r in tables.parse_records(good).collect()] == [fixed.OPERATION_COLUMNS]
    bad = spark.createDataFrame([(json.dumps(full),), (json.dumps(short),)], "record string")
    with pytest.raises(Exception, match=r"Missing required columns: \['description', 'service_name'\]"):
        tables.parse_records(bad).collect()


def test_confusion_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "confusion")

    def matrix(variant, n):
        return spark.range(1).select(
            F.lit("a").alias("actual"), F.lit("b").alias("predicted"), F.lit(n).alias("n"),
            F.lit(1.0).alias("share"), F.lit(variant).alias("variant"), F.lit("t").alias("test_set"),
        )

    for variant, n in (("pre", 1), ("post", 2), ("pre", 3)):
        tables.write_confusion(matrix(variant, n), path)
    assert {(r.variant, r.n) for r in spark.read.parquet(path).collect()} == {("pre", 3), ("post", 2)}


def test_a_task_hands_over_files_in_bounded_batches(tmp_path, monkeypatch):
    from textloom.sources import files

    monkeypatch.setattr(files, "BATCH_CHARACTERS", 3000, raising=False)
    for i in range(8):
        (tmp_path / f"{i}.txt").write_text("x" * (900 if i else 5000))
    reader = files.WholeTextFiles({"path": str(tmp_path), "suffix": ".txt"}).reader(None)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) > 3 and all(len(b) <= 3 for b in batches)
    assert sorted(n for b in batches for n in b.column(0).to_pylist()) == [f"{i}.txt" for i in range(8)]
