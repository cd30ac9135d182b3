"""Text classifier: TF-IDF features and balanced, L2-regularised logistic regression.

Fitting works on a table of features, block by block (``solver``); scoring is plain SQL, a join with
the coefficient table and one aggregation per text, so a model is never copied whole into a task.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom import fixed
from textloom.functions.text import is_blank, normalise_query
from textloom.operators import features, solver, split
from textloom.session import materialize, release_shuffles


@dataclass(frozen=True)
class TextClassifier:
    """Fitted classifier; ``terms`` holds ``term, idf, frequent, coefficients``.

    ``coefficients`` has one number per label (one in all for two labels), ``intercepts`` likewise.
    ``n_rows`` is the number of labelled rows that the fit used.
    """

    terms: DataFrame
    labels: tuple[str, ...]
    intercepts: tuple[float, ...]
    n_rows: int = 0

    def margins(self, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """``id, margins``: the linear scores of texts with at least one known term."""
        found = features.lookup_terms(
            features.document_terms(texts, id_col, text_col),
            self.terms,
            ("idf", "coefficients"),
        ).withColumn("raw", features.sublinear("tf") * F.col("idf"))
        scores = range(len(self.intercepts))
        sums = found.groupBy(id_col).agg(
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"),
            *(F.sum(F.col("raw") * F.get("coefficients", F.lit(k))).alias(f"s{k}") for k in scores),
        )
        return sums.select(
            id_col, F.array(*(F.col(f"s{k}") / F.col("length") for k in scores)).alias("margins")
        )

    def probabilities(self, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """``texts`` plus ``probabilities``, one per label in label order.

        A text without known terms is scored by the intercepts alone.
        """
        known = self.margins(texts, id_col, text_col)
        intercepts = F.array(*(F.lit(float(b)) for b in self.intercepts))
        total = F.when(F.col("margins").isNull(), intercepts).otherwise(
            F.zip_with("margins", intercepts, lambda m, b: m + b)
        )
        scored = texts.join(known, id_col, "left").withColumn("margins", total)
        return scored.withColumn("probabilities", _softmax(F.col("margins"))).drop("margins")

    def classify(
        self,
        texts: DataFrame,
        id_col: str,
        text_col: str = "text",
        top: int = fixed.TOP_PREDICTIONS,
    ) -> DataFrame:
        """``texts`` plus ``predictions ARRAY<STRUCT<service, probability>>``, best first.

        Blank texts get null; use ``require_input`` where they should fail the job instead.
        """
        cleaned = texts.withColumn("_query", normalise_query(text_col))
        scored = self.probabilities(cleaned, id_col, "_query")
        best = top_predictions(F.col("probabilities"), self.labels, top)
        return scored.withColumn("predictions", F.when(F.col("_query") != "", best)).drop(
            "_query", "probabilities"
        )

    def predict(self, texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
        """``texts`` plus ``predicted``, the most probable label."""
        scored = self.probabilities(texts, id_col, text_col)
        best = top_predictions(F.col("probabilities"), self.labels, 1)
        return scored.withColumn("predicted", F.get(best, F.lit(0)).getField("service")).drop(
            "probabilities"
        )

    def save(self, path: str) -> None:
        """Add the whole model to ``path`` as its newest version.

        The term table of a version has a folder of its own; only when it is complete a small file
        that names it is added. A save that ends half-way leaves the version before in place, and a
        model can be saved where it was read from.
        """
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.terms.write.mode("errorifexists").parquet(f"{path}/terms/{version}")
        head = {"version": version, "labels": self.labels, "intercepts": self.intercepts, "n_rows": self.n_rows}
        spark = self.terms.sparkSession
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> TextClassifier:
        """The newest version at ``path``, or the one named."""
        heads = {h["version"]: h for r in spark.read.text(f"{path}/versions").collect() for h in [json.loads(r.value)]}
        head = heads[version or max(heads)]
        return cls(
            spark.read.parquet(f"{path}/terms/{head['version']}"),
            tuple(head["labels"]),
            tuple(head["intercepts"]),
            head["n_rows"],
        )


def _softmax(margins: Column) -> Column:
    """Probabilities of the labels; a single margin is the log-odds of the second label."""
    full = F.when(F.size(margins) > 1, margins).otherwise(
        F.concat(F.array(F.lit(0.0)), margins)
    )
    top = F.array_max(full)
    powers = F.transform(full, lambda m: F.exp(m - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda p: p / total)


def top_predictions(
    probabilities: Column, labels: tuple[str, ...], top: int = fixed.TOP_PREDICTIONS
) -> Column:
    """The best labels with their probabilities; equal ones stay in label order. No shuffle."""
    named = F.zip_with(
        F.lit(list(labels)),
        probabilities,
        lambda service, probability: F.struct(
            service.alias("service"), probability.alias("probability")
        ),
    )
    return rank_predictions(named, top)


def rank_predictions(predictions: Column | str, top: int = fixed.TOP_PREDICTIONS) -> Column:
    """Sort an array of ``service, probability`` by probability, then service; keep the best."""
    # Sorting on (-probability, service) is natural struct order, cheaper than a comparator.
    keyed = F.transform(
        predictions,
        lambda p: F.struct(
            (-p.getField("probability")).alias("k"),
            p.getField("service").alias("service"),
            p.getField("probability").alias("probability"),
        ),
    )
    best = F.slice(F.sort_array(keyed), 1, top)
    return F.transform(
        best,
        lambda p: F.struct(
            p.getField("service").alias("service"), p.getField("probability").alias("probability")
        ),
    )


def require_input(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Fail the job on a blank text, when it is read."""
    checked = F.when(is_blank(text_col), F.raise_error(F.lit(fixed.EMPTY_INPUT))).otherwise(
        F.col(text_col)
    )
    return texts.withColumn(text_col, checked.cast("string"))


def merge_equal_terms(postings: DataFrame, id_col: str) -> DataFrame:
    """``term, df, s1, s2``: document frequency and a 128-bit signature of each term's postings.

    Terms with the same postings (``id, tf`` pairs) have proportional feature columns, so under an
    L2 penalty the optimum gives them proportional coefficients. One merged feature of weight
    ``sqrt(number of terms)`` then leads to the same model with far fewer coefficients: terms that
    occur in a single document, most of any vocabulary, become one feature per document and count.
    """
    # Order-free and mergeable, so a frequent term is summed up in the map tasks like any other.
    return postings.groupBy("term").agg(
        F.count("*").alias("df"),
        F.bit_xor(F.xxhash64(id_col, "tf")).alias("s1"),
        F.bit_xor(F.xxhash64("tf", id_col, F.lit("second"))).alias("s2"),
    )


def add_index(stored: DataFrame) -> DataFrame:
    """Add ``idx``, dense from 0, to a table stored as Parquet files.

    The index is the row number within the file plus the rows of the files before it, so only the
    per-file counts meet in one task.
    """
    placed = stored.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_file")) - F.col("_n")
    offsets = files.select("_file", before.alias("_before"))
    return placed.join(offsets, "_file").select(
        *stored.columns, (F.col("_before") + F.col("_row")).cast("int").alias("idx")
    )


@dataclass(frozen=True)
class TrainingPart:
    """A labelled source, counted once however many models use it: written tables of its rows
    (``row, label``), their postings (``row, term, tf``) and its terms (``term, df, s1, s2``)."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame


def prepare(
    training: DataFrame, id_col: str, max_rows: int | None = None, number: int = 0
) -> TrainingPart:
    """Number and count all ``text, label`` rows with a unique ``id_col``.

    Only a caller that gives ``max_rows`` gets a model of fewer: of more rows than that the same share
    of each label, by hash order. Parts of one model need different numbers.
    """
    rows = training.select(id_col, "text", "label")
    if max_rows is not None and (total := rows.count()) > max_rows:
        rows = split.stratified_split(rows, id_col, test_share=max_rows / total).test
    rows = add_index(materialize(rows.select("text", "label"), "training-rows"))
    row = (F.col("idx") + F.lit(number << 40)).alias("row")
    rows = materialize(rows.select(row, "text", "label"), "numbered-rows")
    postings = materialize(features.document_terms(rows, "row"), "postings")
    terms = materialize(merge_equal_terms(postings, "row"), "vocabulary")
    release_shuffles(terms.sparkSession)
    return TrainingPart(rows.select("row", "label"), postings, terms)


def combined_terms(parts: Sequence[TrainingPart], copies: Sequence[int]) -> DataFrame:
    """``term, df, s1, s2`` of several parts, the rows of each counting ``copies`` times.

    Document frequencies add up and signatures combine, so no part is counted again.
    """
    if len(parts) == 1 and copies[0] == 1:
        return parts[0].terms
    scaled = [p.terms.withColumn("df", F.col("df") * n) for p, n in zip(parts, copies, strict=True)]
    every = reduce(DataFrame.unionByName, scaled)
    merged = every.groupBy("term").agg(
        F.sum("df").alias("df"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")
    )
    return materialize(merged, "vocabulary")


def fit_classifier(
    training: DataFrame,
    id_col: str,
    max_iter: int = fixed.MAX_ITERATIONS,
    max_rows: int | None = None,
    tolerance: float = solver.TOLERANCE,
    block_entries: int = solver.BLOCK_ENTRIES,
) -> TextClassifier:
    """Fit on all ``text, label`` rows with a unique ``id_col``; see ``prepare`` and ``fit_parts``."""
    part = prepare(training, id_col, max_rows)
    return fit_parts([part], max_iter=max_iter, tolerance=tolerance, block_entries=block_entries)


def fit_parts(
    parts: Sequence[TrainingPart],
    copies: Sequence[int] | None = None,
    max_iter: int = fixed.MAX_ITERATIONS,
    tolerance: float = solver.TOLERANCE,
    block_entries: int = solver.BLOCK_ENTRIES,
) -> TextClassifier:
    """Fit on all rows of the parts, those of a part counting as if they were there ``copies`` times.

    Class weights and document frequencies are those of the rows used, with their copies; the model
    reports how many. The objective is the weighted log-loss plus half the squared coefficients (a
    unit inverse penalty). The features and the fitted terms are written tables, so rounds re-read
    rather than re-compute; the driver holds the labels, their weights and the intercepts.
    """
    copies = [1] * len(parts) if copies is None else list(copies)
    spark = parts[0].rows.sparkSession
    rows = reduce(
        DataFrame.unionByName,
        [p.rows.withColumn("copies", F.lit(n)) for p, n in zip(parts, copies, strict=True)],
    )
    counts = rows.groupBy("label").agg(F.sum("copies").alias("n")).orderBy("label").collect()
    labels = tuple(r.label for r in counts)
    if None in labels:
        raise ValueError("Training rows need a label.")
    if len(labels) < 2:
        raise ValueError("A classifier needs at least two labels.")
    n_rows = sum(r.n for r in counts)

    postings = reduce(DataFrame.unionByName, [p.postings for p in parts])
    signed = combined_terms(parts, copies)
    n_postings = signed.agg(F.sum("df")).first()[0] or 0
    groups = materialize(
        signed.groupBy("df", "s1", "s2").agg(
            F.min("term").alias("representative"), F.count("*").alias("n_terms")
        ),
        "term-groups",
    )
    n_scores = 1 if len(labels) == 2 else len(labels)
    # Both lookups carry an array of scores or three numbers a term.
    term_bytes = features.TERM_BYTES + 8 * n_scores
    groups = materialize(add_index(groups), "term-index")

    representatives = features.with_weights(
        groups.select(F.col("representative").alias("term"), "df", "idx", "n_terms"),
        n_rows,
        n_postings,
        term_bytes,
    )
    found = features.lookup_terms(
        postings, representatives, ("idx", "idf", "n_terms")
    ).withColumn("raw", features.sublinear("tf") * F.col("idf") * F.sqrt("n_terms"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("row")))
    entries = materialize(found.select("row", "idx", (F.col("raw") / length).alias("value")), "features")
    release_shuffles(spark)
    # One entry per label, and the labels are on the driver already.
    targets = F.broadcast(
        spark.createDataFrame(
            [(r.label, i, n_rows / (len(labels) * r.n)) for i, r in enumerate(counts)],
            "label string, target int, weight double",
        )
    )
    targeted = rows.join(targets, "label").select(
        "row", "target", (F.col("weight") * F.col("copies")).alias("weight")
    )
    fitted = solver.fit(
        entries, materialize(targeted, "targets"), n_scores,
        tolerance=tolerance, max_iter=max_iter, block_entries=block_entries,
    )
    per_term = (
        groups.join(fitted.coefficients, "idx")
        .select(
            "df",
            "s1",
            "s2",
            F.transform("values", lambda b: b / F.sqrt("n_terms")).alias("coefficients"),
        )
    )
    terms = features.with_weights(signed, n_rows, n_postings, term_bytes).join(per_term, ["df", "s1", "s2"])
    terms = materialize(terms.select("term", "idf", "frequent", "coefficients"), "classifier")
    release_shuffles(spark)
    return TextClassifier(terms, labels, fitted.intercepts, n_rows)
