import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_features import brute_force
from textloom.operators import classifier, split
from textloom.plans.experiment import train_and_evaluate

ROWS = [
    ("Create a bucket for objects", "s3"),
    ("Delete a bucket with objects", "s3"),
    ("List buckets and objects in storage", "s3"),
    ("Start a database instance", "rds"),
    ("Stop the database instance", "rds"),
    ("Invoke a function with an event", "lambda"),
    ("Invoke a function with an event", "lambda"),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, label) for i, (t, label) in enumerate(rows)], "id int, text string, label string"
    )


def fitted(spark, rows):
    return classifier.fit_classifier(frame(spark, rows), "id")


@pytest.fixture(scope="module")
def model(spark):
    return fitted(spark, ROWS)


def optimality(rows, model):
    """Largest gradient entry of the mean objective at the fitted coefficients."""
    coefficients = {r.term: np.array(r.coefficients) for r in model.terms.collect()}
    weights = brute_force([t for t, _ in rows])
    labels, n = list(model.labels), len(rows)
    counts = {k: sum(label == k for _, label in rows) for k in labels}
    vectors = [{t: w for (j, t), w in weights.items() if j == i} for i in range(n)]
    binary = len(labels) == 2
    grad = {t: c / n for t, c in coefficients.items()}
    grad_b = np.zeros(len(model.intercepts))
    for (_, label), vector in zip(rows, vectors):
        margin = np.array(model.intercepts) + sum(w * coefficients[t] for t, w in vector.items())
        target = labels.index(label)
        if binary:
            residual = 1 / (1 + np.exp(-margin)) - target
        else:
            residual = np.exp(margin - margin.max())
            residual = residual / residual.sum()
            residual[target] -= 1
        residual = residual * n / (len(labels) * counts[label]) / n
        grad_b += residual
        for t, w in vector.items():
            grad[t] = grad[t] + residual * w
    return max(max(abs(g).max() for g in grad.values()), abs(grad_b).max())


def test_solution_is_the_optimum_of_the_stated_objective(spark, model):
    # Covers the merging of equal terms as well: the gradient is taken term by term.
    assert optimality(ROWS, model) < 1e-4


def test_two_labels(spark):
    rows = [r for r in ROWS if r[1] != "lambda"]
    two = fitted(spark, rows)
    assert two.labels == ("rds", "s3") and len(two.intercepts) == 1
    assert optimality(rows, two) < 1e-4
    predicted = two.predict(frame(spark, rows), "id")
    assert predicted.where("label <> predicted").count() == 0


def test_predictions_and_probabilities(spark, model):
    assert model.labels == ("lambda", "rds", "s3")
    seen = model.predict(frame(spark, ROWS), "id")
    assert seen.where("label <> predicted").count() == 0
    odd = frame(spark, [("zzz qqq", ""), ("  ", ""), (" stop   the database ", "")])
    rows = model.classify(odd, "id").orderBy("id").collect()
    assert rows[1].predictions is None
    assert rows[2].predictions[0].service == "rds"
    for row in (rows[0], rows[2]):
        shares = [p.probability for p in row.predictions]
        assert math.isclose(sum(shares), 1.0) and shares == sorted(shares, reverse=True)
    # Unknown words only: the intercepts decide.
    powers = np.exp(model.intercepts)
    assert np.allclose(sorted(powers / powers.sum(), reverse=True), [p.probability for p in rows[0].predictions])


def test_strict_input_check(spark):
    with pytest.raises(Exception, match="Input must not be empty"):
        classifier.require_input(frame(spark, [(" ", "")])).collect()


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "model"))
    loaded = classifier.TextClassifier.load(spark, str(tmp_path / "model"))
    assert loaded.labels == model.labels and loaded.intercepts == model.intercepts
    probe = frame(spark, ROWS)
    before = {r.id: r.predictions for r in model.classify(probe, "id").collect()}
    after = {r.id: r.predictions for r in loaded.classify(probe, "id").collect()}
    assert before.keys() == after.keys()
    for key, predictions in before.items():
        assert [p.service for p in predictions] == [p.service for p in after[key]]
        assert np.allclose(*([p.probability for p in x] for x in (predictions, after[key])))


def test_bound_on_labelled_rows_is_kept_and_reported(spark):
    rows = [(i, f"{'storage' if i % 2 else 'compute'} words {i}", f"l{i % 2}") for i in range(60)]
    table = spark.createDataFrame(rows, "id int, text string, label string")
    model = classifier.fit_classifier(table, "id", max_rows=20)
    assert model.n_rows == 20 and model.labels == ("l0", "l1")
    assert classifier.fit_classifier(table, "id").n_rows == 60


def test_every_labelled_row_enters_a_fit_however_many_there_are(spark, monkeypatch):
    table = frame(spark, ROWS)
    # Whatever a count may say, no rows are chosen.
    monkeypatch.setattr(type(table), "count", lambda self: 10**9)
    monkeypatch.setattr(split, "stratified_split", lambda *a, **k: pytest.fail("only a part of the rows is used"))
    part = classifier.prepare(table, "id")
    monkeypatch.undo()
    assert part.rows.count() == len(ROWS)
    assert classifier.fit_classifier(table, "id").n_rows == len(ROWS)


def test_labels_are_required(spark):
    with pytest.raises(ValueError, match="two labels"):
        classifier.fit_classifier(frame(spark, ROWS[:2]), "id")


def test_equal_probabilities_stay_in_label_order(spark):
    df = spark.range(1).select(
        classifier.top_predictions(F.array(*map(F.lit, [0.2, 0.3, 0.3, 0.2])), ("a", "b", "c", "d")).alias("p")
    )
    assert [x.service for x in df.first().p] == ["b", "c", "a"]


def test_experiment_scores_both_test_sets_for_both_variants(spark):
    base = [(f"{t} number {i}", label) for i in range(6) for t, label in ROWS]
    extra = [(f"please {label} thing {i}", label) for i in range(6) for label in ("s3", "rds", "lambda")]
    result = train_and_evaluate(frame(spark, base), frame(spark, extra), "id", max_iter=100)
    keys = {(r.variant, r.test_set) for r in result.metrics.collect()}
    assert keys == {(v, t) for v in ("pre_intents", "post_intents") for t in ("botocore", "intents")}
    shares = result.confusion.groupBy("variant", "test_set", "actual").agg(F.sum("share").alias("s"))
    assert all(math.isclose(r.s, 1.0) for r in shares.collect())
    sizes = {r.test_set: r.n for r in result.confusion.where("variant = 'pre_intents'").groupBy("test_set").agg(F.sum("n").alias("n")).collect()}
    assert sizes == {"botocore": math.ceil(0.2 * len(base)), "intents": math.ceil(0.2 * len(extra))}


def test_unknown_labels_stop_the_experiment(spark):
    with pytest.raises(ValueError, match="unknown services"):
        train_and_evaluate(frame(spark, ROWS), frame(spark, [("x", "eks"), ("y", "eks")]), "id")


def test_balanced_weights_enter_the_fit(spark):
    skewed = ROWS + [("Create a bucket for objects", "s3")] * 5
    assert optimality(skewed, fitted(spark, skewed)) < 1e-4
    assert split.balanced_weights(frame(spark, skewed)).count() == 3


def test_parts_count_as_their_copies(spark):
    base, extra = ROWS, [("Please stop the lambda", "lambda"), ("Please list the s3 things", "s3")]
    parts = [classifier.prepare(frame(spark, rows), "id", number=i) for i, rows in enumerate((base, extra))]
    full = base + 3 * extra
    model = classifier.fit_parts(parts, [1, 3])
    assert model.n_rows == len(full) and optimality(full, model) < 1e-4
    # The merged frequencies are those of a count of all rows with their copies.
    counted = classifier.prepare(frame(spark, full), "id").terms
    merged = classifier.combined_terms(parts, [1, 3])
    assert sorted(map(tuple, merged.select("term", "df").collect())) == sorted(map(tuple, counted.select("term", "df").collect()))
    alone = classifier.fit_parts(parts[:1])
    assert optimality(base, alone) < 1e-4
