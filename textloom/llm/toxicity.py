"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import materialize, slices

ORDERS = (3, 4, 5)
HASH_BITS = 20
# At most so many labelled rows fit the model: the first ones by the hash of their id.
MAX_LABELLED = 10_000
# N-grams whose log ratio lies so many standard errors from 0 enter the linear model, but not fewer
# or more than these numbers of the clearest.
CLEAR = 5.0
MIN_FEATURES, MAX_FEATURES = 300, 1 << 14
SMOOTHING = 1.0
L2 = 1e-3
STEPS, RATE = 150, 0.1
THRESHOLD = 0.3
_CHARS_AT_ONCE = 1 << 20


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character n-grams of a text, lower-cased and with single spaces, in blocks."""
    padded = f" {' '.join(text.lower().split())} "
    if padded == "  ":
        return
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = max(ORDERS) - 1
    for start in range(0, len(codes), _CHARS_AT_ONCE):
        block = codes[start : start + _CHARS_AT_ONCE + overlap]
        rolled = block.copy()
        for order in range(2, max(ORDERS) + 1):
            rolled = rolled[: len(block) - order + 1] * np.uint32(0x01000193) ^ block[order - 1 :]
            if order in ORDERS and len(rolled):
                mixed = (rolled ^ rolled >> np.uint32(15)) * np.uint32(0x9E3779B1)
                yield mixed >> np.uint32(32 - HASH_BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass(frozen=True)
class ToxicityModel:
    """``score = sigmoid(bias + sum of the weights of the features in the text)``."""

    features: np.ndarray  # ascending n-gram hashes
    weights: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        """Place of every hash among the features, -1 for others."""
        table = np.full(1 << HASH_BITS, -1, np.int32)
        table[self.features] = np.arange(len(self.features), dtype=np.int32)
        return table

    def score(self, text: Column) -> Column:
        """Probability of label 1 as a double; null, empty and blank texts get that of no features."""
        model = self

        @arrow_udf("double")
        def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = model.places()
            for batch in slices(batches):
                sums = [model.weights[present(x.as_py(), table)].sum() for x in batch]
                yield pa.array(_sigmoid(model.bias + np.array(sums, np.float64)), pa.float64())

        return compute.asNondeterministic()(F.coalesce(text, F.lit("")))


def present(text: str, table: np.ndarray) -> np.ndarray:
    """Distinct places, in ``table``, of the n-grams of a text."""
    found = [places[places >= 0] for places in (table[h] for h in ngrams(text))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each n-gram, by label, over the rows of a task."""
    counts = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            hashes = list(ngrams(text.as_py()))
            if hashes:
                counts[label.as_py(), np.unique(np.concatenate(hashes))] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), *map(pa.array, counts[:, seen])], names=["feature", "n0", "n1"])


def _linear(present_in: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression on present-or-not features times ``scale``, by Adam on the whole sample."""
    rows = np.repeat(np.arange(len(labels)), [len(x) for x in present_in])
    rows = rows.astype(np.int32)
    columns = np.concatenate(present_in).astype(np.int32)
    values = scale[columns].astype(np.float32)
    theta = np.zeros(len(scale) + 1)
    theta[-1] = bias
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        margin = np.bincount(rows, values * theta[columns], len(labels)) + theta[-1]
        error = (_sigmoid(margin) - labels) / len(labels)
        slope = np.append(np.bincount(columns, values * error[rows], len(scale)), error.sum())
        slope[:-1] += L2 * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1] * scale, float(theta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    max_features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Fit on the rows of ``labels`` (``id_col``, ``label_col`` 0 or 1), joined to their texts.

    Rows with a null id or another label don't count; a row whose id is missing in ``docs`` has no
    effect, an id with several rows is as many examples. At most ``max_labelled`` label rows are
    used, chosen by the hash order of their id; that bound is what lets the labels be broadcast to
    the scan of the texts and the linear model be fitted on the driver. Without examples of both
    labels the model is the smoothed share of label 1.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    usable = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "id").select("text", "label"), "labelled")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    share = (n1 + 0.1) / (n0 + n1 + 1)
    bias = float(np.log(share / (1 - share)))
    if not n0 or not n1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), bias)
    counted = sample.mapInArrow(_count, "feature long, n0 long, n1 long")
    counted = counted.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a, b = F.col("n1") + SMOOTHING, F.col("n0") + SMOOTHING
    ratio = F.log(a / (n1 + 2 * SMOOTHING)) - F.log(b / (n0 + 2 * SMOOTHING))
    ranked = counted.select("feature", ratio.alias("ratio"), F.abs(ratio / F.sqrt(1 / a + 1 / b)).alias("clear"))
    kept = ranked.orderBy(F.desc("clear"), "feature").limit(max_features).toPandas()
    kept = kept[: max(MIN_FEATURES, int((kept["clear"] >= CLEAR).sum()))].sort_values("feature")
    scale = kept["ratio"].to_numpy()
    model = ToxicityModel(kept["feature"].to_numpy(), np.zeros(len(kept)), bias)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.places()
        for batch in slices(batches):
            yield pa.array([present(x.as_py(), table) for x in batch], pa.list_(pa.int32()))

    examples = sample.select(seen.asNondeterministic()("text").alias("seen"), "label").toArrow()
    present_in = [np.asarray(x.values, np.int32) for x in examples.column("seen")]
    targets = examples.column("label").to_numpy().astype(np.float64)
    weights, bias = _linear(present_in, targets, scale, bias)
    return ToxicityModel(model.features, weights, bias)
