"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from textloom.llm.common import materialize, slices

# At most so many different labelled texts of a language, chosen by hash, fit the text model; every label
# is a language.
MAX_TEXTS = 500
HASH_BITS = 16
SMOOTHING = 0.05
# N-grams of a text depend on each other; a text counts as so many independent ones at most.
MAX_EVIDENCE = 60
# Weight, in texts, of the next wider level in the prior of a host, domain or suffix.
PRIOR_WEIGHT = 20.0
UNKNOWN_PRIOR = 0.01
MIN_POSTERIOR = 0.5
UNKNOWN = "und"
_CHARS_AT_ONCE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)], bool)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character trigrams of a text's lower-cased letters, other runs being a space."""
    letters = _letters()
    data = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters[np.minimum(data, 0xFFFF)] | (data > 0xFFFF), data, 32)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    for start in range(0, max(0, len(codes) - 2), _CHARS_AT_ONCE):
        part = codes[start : start + _CHARS_AT_ONCE + 2]
        mixed = (part[:-2] * np.uint32(0x01000193) ^ part[1:-1]) * np.uint32(0x01000193) ^ part[2:]
        yield (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - HASH_BITS)


@dataclass(frozen=True)
class TextModel:
    """Log-probability of each hashed trigram by language; the last column is that of no language."""

    languages: tuple[str, ...]
    table: np.ndarray

    def evidence(self, text: Column) -> Column:
        """Log-likelihoods by language, then of no language; zeros for a text without letters."""
        table = self.table

        @arrow_udf(T.ArrayType(T.DoubleType()))
        def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in slices(batches):
                out = np.zeros((len(batch), table.shape[1]))
                for row, x in zip(out, batch, strict=True):
                    n = 0
                    for hashes in trigrams(x.as_py()):
                        counts = np.bincount(hashes, minlength=0)
                        seen = np.flatnonzero(counts)
                        row += counts[seen] @ table[seen]
                        n += len(hashes)
                    row *= min(n, MAX_EVIDENCE) / max(n, 1)
                ends = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return compute.asNondeterministic()(F.coalesce(text, F.lit("")))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            own = counts.setdefault(lang.as_py(), np.zeros(1 << HASH_BITS, np.int64))
            for hashes in trigrams(text.as_py()):
                own += np.bincount(hashes, minlength=len(own))
    for lang, own in counts.items():
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(own[seen])], names=["lang", "feature", "n"]
        )


def fit_text(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_texts: int = MAX_TEXTS) -> TextModel:
    """Trigram model of all languages in ``lang_col``; rows with a null text or label don't count. The
    table takes 256 KB a language on the driver and in each worker."""
    texts = docs.select(F.col(text_col).alias("text"), F.lower(lang_col).alias("lang")).dropna()
    hashed = texts.withColumn("h", F.xxhash64("text"))
    # Copies are one text: both the bound and the share below count distinct hashes.
    distinct = hashed.select("lang", "h").distinct()
    found = distinct.groupBy("lang").count().collect()
    languages = tuple(sorted(r["lang"] for r in found))
    # First a generous share by hash, so that what is ranked stays small whatever the input's size.
    share = F.lit(0.0)
    for r in found:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 8 * max_texts / r["count"])).otherwise(share)
    chosen = distinct.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= max_texts).select("lang", "h")
    # At most max_texts for each language.
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    counted = sample.select("text", "lang").mapInArrow(_count, "lang string, feature long, n long")
    rows = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << HASH_BITS, len(languages) + 1), -HASH_BITS * np.log(2), np.float32)
    for lang, own in rows.groupby("lang"):
        table[:, languages.index(lang)] = _log_shares(own["feature"], own["n"])
    for i in sorted(set(range(len(languages))) - {languages.index(x) for x in rows["lang"].unique()}):
        table[:, i] = _log_shares([], [])
    return TextModel(languages, table)


def _log_shares(features, numbers) -> np.ndarray:
    counts = np.full(1 << HASH_BITS, SMOOTHING)
    counts[np.asarray(features, np.int64)] += np.asarray(numbers, np.float64)
    return np.log(counts / counts.sum())


def address_parts(host: Column) -> tuple[Column, Column]:
    """(domain, suffix) of a host: its last two labels and its last; a host without a dot has no suffix."""
    domain = F.substring_index(host, ".", -2)
    return domain, F.when(host.contains("."), F.substring_index(host, ".", -1))


def _known(lang: Column, languages: tuple[str, ...]) -> Column:
    short, whole = F.lower(F.regexp_extract(lang, "^[A-Za-z]+", 0)), F.lower(lang)
    return F.when(whole.isin(*languages), whole).when(short.isin(*languages), short).when(short != "", "other")


def _argmax(scores: Column, languages: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(
    docs: DataFrame,
    model: TextModel,
    *,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    prior_weight: float = PRIOR_WEIGHT,
    min_posterior: float = MIN_POSTERIOR,
) -> DataFrame:
    """``docs`` with a struct ``language``: lang, posterior, text_lang (by the text alone) and kept.

    The posterior is the product of the text's likelihood, of the likelihood of the declared language
    and of the host's prior. Both of the latter are counts of ``text_lang`` over all rows: by declared
    language, and by host, smoothed by its domain, that by its suffix and that by all rows. A null
    declaration or host adds nothing but the wider levels. ``lang`` is "und" for a text without letters
    or unlike any language of the model. ``kept`` is false for "und" and below ``min_posterior``.
    Rows are judged one by one, repeated rows alike; an empty table stays empty, and all columns pass
    through (one named ``language`` is replaced).
    """
    languages = model.languages
    if not languages:
        none = F.struct(
            F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("posterior"), F.lit(UNKNOWN).alias("text_lang"),
            F.lit(False).alias("kept"),
        )
        return docs.withColumn("language", none)
    nothing = F.lit(None).cast("string")
    host = F.lower(host) if host is not None else nothing
    domain, suffix = address_parts(host)
    own = {"__declared": _known(declared if declared is not None else nothing, languages), "__host": host}
    rows = docs.drop("language").withColumns({"__evidence": model.evidence(text), **own})
    by_text = F.when(F.array_max(F.transform("__evidence", F.abs)) > 0, _argmax(F.col("__evidence"), languages))
    counted = rows.select(
        "__declared", "__host", F.coalesce(by_text, F.lit(UNKNOWN)).alias("lang")
    ).groupBy("__declared", "__host", "lang").count()
    counted = materialize(counted, "language-counts")

    shares = [F.sum(F.when(F.col("lang") == x, F.col("count")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    numbers = [f"n{i}" for i in range(len(languages))]
    total = counted.agg(*shares).first()
    all_rows = np.array([(total[n] or 0) + 1.0 for n in numbers])
    everywhere = all_rows / all_rows.sum()
    spoken = {r["__declared"]: r for r in counted.where("__declared IS NOT NULL").groupBy("__declared").agg(*shares).collect()}
    said = {}
    for name in (*languages, "other"):
        found = spoken.get(name)
        here = np.array([(found[n] if found else 0) + (5.0 if name == x else 0.5) for n, x in zip(numbers, languages, strict=True)])
        said[name] = here / (all_rows + 5.0)

    def smoothed(parent: Column) -> Column:
        n = F.array(*[F.col(x).cast("double") for x in numbers])
        size = sum((F.col(x) for x in numbers), F.lit(0.0))
        return F.zip_with(n, parent, lambda a, p: (a + F.lit(prior_weight) * p) / (size + prior_weight))

    def floats(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")

    hosts = counted.where("__host IS NOT NULL").withColumnRenamed("__host", "host")
    domain, suffix = address_parts(F.col("host"))
    by_host = hosts.groupBy("host", domain.alias("domain"), suffix.alias("suffix")).agg(*shares)
    by_domain = by_host.groupBy("domain", "suffix").agg(*[F.sum(n).alias(n) for n in numbers])
    by_suffix = by_domain.where("suffix IS NOT NULL").groupBy("suffix").agg(*[F.sum(n).alias(n) for n in numbers])
    by_suffix = by_suffix.select("suffix", smoothed(floats(everywhere)).alias("p"))
    by_domain = by_domain.join(by_suffix, "suffix", "left").select(
        "domain", smoothed(F.coalesce("p", floats(everywhere))).alias("p")
    )
    prior = by_host.join(by_domain, "domain").select(F.col("host").alias("__host"), smoothed(F.col("p")).alias("__prior"))
    prior = materialize(prior, "language-priors")  # its size then decides how it meets the texts

    scored = rows.join(prior, "__host", "left")
    told = [(name, np.log(values).tolist()) for name, values in said.items()]
    told = docs.sparkSession.createDataFrame(told, "__declared string, __said array<double>")
    scored = scored.join(F.broadcast(told), "__declared", "left")
    likelihood = F.coalesce("__said", floats(np.zeros(len(languages))))
    before = F.zip_with(
        F.coalesce("__prior", floats(everywhere)), likelihood, lambda p, d: F.log(p * (1 - UNKNOWN_PRIOR)) + d
    )
    # No language: any declaration is as likely as the average one.
    average = F.log(F.aggregate(likelihood, F.lit(0.0), lambda s, d: s + F.exp(d)) / len(languages))
    joint = F.zip_with("__evidence", F.concat(before, F.array(average + float(np.log(UNKNOWN_PRIOR)))), lambda e, b: e + b)
    scored = scored.withColumn("__joint", joint).withColumn("__best", F.array_max("__joint"))
    mass = F.aggregate("__joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__best")))
    silent = F.array_max(F.transform("__evidence", F.abs)) == 0
    lang = F.when(silent, F.lit(UNKNOWN)).otherwise(_argmax(F.col("__joint"), languages))
    text_lang = F.when(silent, F.lit(UNKNOWN)).otherwise(_argmax(F.col("__evidence"), languages))
    scored = scored.withColumns({"__lang": lang, "__posterior": 1 / mass, "__text": text_lang})
    kept = (F.col("__lang") != UNKNOWN) & (F.col("__posterior") >= min_posterior)
    return scored.select(
        *[c for c in docs.columns if c != "language"],
        F.struct(
            F.col("__lang").alias("lang"), F.col("__posterior").alias("posterior"), F.col("__text").alias("text_lang"),
            kept.alias("kept"),
        ).alias("language"),
    )
