import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer, Tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from test_classifier import ROWS, frame
from textloom.operators import classifier, encode, scorers
from textloom.operators.ml import TextClassification, TextClassificationModel
from textloom.plans.assistant import Assistant


@pytest.fixture(scope="module")
def fitted(spark):
    return Pipeline(stages=[TextClassification(textCol="text", labelCol="label")]).fit(frame(spark, ROWS))


def probe(spark, ids=(1, 2, 3, 4)):
    texts = ("list buckets", "start the database", "  ", None)
    return spark.createDataFrame(list(zip(ids, texts)), "id int, text string")


def by_text(df):
    return {r["text"]: [(p["service"], round(p["probability"], 9)) for p in r["predictions"] or []] for r in df.collect()}


def test_estimator_adds_named_probabilities(spark, fitted):
    out = fitted.transform(probe(spark, (1, 2, 2, None)).withColumn("prediction", F.lit("x")))
    assert out.columns == ["id", "text", "probability", "prediction"]
    assert out.schema["prediction"].metadata["ml_attr"]["vals"] == ["lambda", "rds", "s3"]
    assert out.schema["probability"].metadata["ml_attr"]["num_attrs"] == 3
    rows = {r["text"]: r for r in out.collect()}
    assert len(rows) == 4 and rows["list buckets"].prediction == 2.0 and rows["start the database"].prediction == 1.0
    assert abs(sum(rows["list buckets"].probability) - 1) < 1e-9


def test_pipeline_is_written_and_read(spark, fitted, tmp_path):
    path = str(tmp_path / "pipeline")
    fitted.save(path)
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[0], TextClassificationModel) and loaded.stages[0].uid == fitted.stages[0].uid
    assert loaded.stages[0].labels == ("lambda", "rds", "s3")
    before, after = (scorers.ModelScorer(m).classify(probe(spark), "id") for m in (fitted, loaded))
    assert by_text(before) == by_text(after)
    estimator = TextClassification(textCol="t", tol=1e-4)
    estimator.save(str(tmp_path / "estimator"))
    assert TextClassification.load(str(tmp_path / "estimator")).getTextCol() == "t"


def test_a_save_that_ends_half_way_leaves_the_model_before(spark, fitted, tmp_path, monkeypatch):
    path, model = str(tmp_path / "model"), fitted.stages[0].classifier
    model.save(path)
    first = classifier.TextClassifier.load(spark, path)

    def killed(*_, **__):
        raise KeyboardInterrupt

    other = classifier.TextClassifier(first.terms, ("a", "b", "c"), first.intercepts, 1)
    with monkeypatch.context() as m:
        m.setattr(SparkSession, "createDataFrame", killed)
        with pytest.raises(KeyboardInterrupt):
            other.save(path)
    again = classifier.TextClassifier.load(spark, path)
    assert again.labels == first.labels and again.terms.count() == first.terms.count()
    other.save(path)  # a model can be saved where it was read from
    assert classifier.TextClassifier.load(spark, path).labels == ("a", "b", "c")


def foreign(spark):
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), Tokenizer(inputCol="text", outputCol="words"),
        CountVectorizer(inputCol="words", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20),
    ]
    return Pipeline(stages=stages).fit(frame(spark, ROWS))


def assistant(spark, scorer):
    store = spark.createDataFrame([("a", 1, "storage notes"), ("b", 1, "database notes")], "source string, chunk_number int, text string")
    return Assistant(
        classifier=scorer, store=store.withColumn("embedding", encode.hashed_embedding("text", 16)),
        encode=lambda c: encode.hashed_embedding(c, 16), markers=("bucket", "database"),
    )


def served(spark, scorer):
    requests = spark.createDataFrame([("r1", "List my BUCKETS and objects"), ("r2", " "), ("r3", "hello")], "request_id string, user_input string")
    return {r.request_id: r for r in assistant(spark, scorer).answer(requests).collect()}


def test_any_pipeline_with_probabilities_serves_the_assistant(spark):
    model = foreign(spark)
    pairs = scorers.ModelScorer(model).classify(probe(spark), "id", top=2).collect()
    found = {r["text"]: r.predictions for r in pairs if r["text"] != "  "}
    assert found["start the database"][0].service == "rds" and len(found["list buckets"]) == 2
    answers = served(spark, model)
    assert answers["r1"].predictions[0].service == "s3" and answers["r2"].status == "input_rejected"
    assert answers["r3"].predictions == []


def test_labels_must_be_known(spark):
    stages = foreign(spark).stages[1:]
    bare = PipelineModel(stages)
    with pytest.raises(ValueError, match="does not name its labels"):
        scorers.ModelScorer(bare).classify(probe(spark), "id")
    named = scorers.ModelScorer(bare, labels=("lambda", "rds", "s3"))
    assert served(spark, named)["r1"].predictions[0].service == "s3"


def test_a_table_of_predictions_serves_the_assistant(spark):
    rows = [("r1", "rds", 0.2), ("r1", "s3", 0.7), ("r1", "lambda", 0.1), ("r2", "s3", 1.0)]
    table = spark.createDataFrame(rows, "request_id string, service string, probability double")
    answers = served(spark, table)
    assert [p.service for p in answers["r1"].predictions] == ["s3", "rds", "lambda"]
    assert answers["r2"].predictions is None or answers["r2"].status == "input_rejected"
    assert isinstance(scorers.as_scorer(table), scorers.TableScorer) and isinstance(table, DataFrame)
