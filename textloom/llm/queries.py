"""One query per operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.html import clean_html
from textloom.llm import bpe_automaton, hard_negatives, language, line_dedup, nn_graph, packing, pii, quality, secrets, simhash, spelling, toxicity, vector_packing
from textloom.llm.common import read

END_ID = 2


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    graph = nn_graph.build(vectors)
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("id"))
    return nn_graph.search(graph, queries).withColumnRenamed("id", "vec_id")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", bpe_automaton.encode(F.col("text"), path).alias("ids"))
    texts = docs.withColumn("decoded", bpe_automaton.decode(F.col("ids"), path))
    return texts.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with their language; the source is the host, ``lang`` the declared language."""
    model = language.fit_text(docs)
    return language.identify(docs, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read(spark, sf_dir, "documents")).select("doc_id", "language.*")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages: visible text, markup language, address."""
    model = language.fit_text(read(spark, sf_dir, "documents"))
    pages = read(spark, sf_dir, "pages").withColumn("visible", clean_html("html"))
    found = language.identify(
        pages,
        model,
        text=F.col("visible"),
        declared=F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1),
        host=F.try_parse_url("url", F.lit("HOST")),
    )
    return found.select("page_id", "language.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = line_dedup.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Token pieces of the texts with their places in packed sequences."""
    return packing.pack_texts(docs.select("doc_id", "text"), end_id=END_ID)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", quality.quality(F.col("text")).alias("x"))
    return docs.select("doc_id", "x.*")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = secrets.fit(docs)
    found = docs.select("doc_id", secrets.secret_spans(F.col("text"), model).alias("found"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"] != "crf")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "documents").select("doc_id", pii.pseudonymise(F.col("text"), pii.job_key(spark)).alias("x"))
    return done.select("doc_id", "x.text", "x.n_values")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.fit(docs, labels.where(part != 2))
    scored = docs.select(
        "doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return vector_packing.pack_examples(docs, end_id=END_ID)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.mine(vectors, F.pmod("id", F.lit(100)) == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), slip=199))


def vector_packing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on instruction data: only what the assistant says bears loss, and a sequence
    may hold at most half as many such tokens as tokens."""
    turns = read(spark, sf_dir, "conversations")
    spoken = F.col("role") == "assistant"
    examples = turns.select(
        "conv_id", "turn", F.when(spoken, F.col("text")).alias("text"),
        F.when(spoken, F.lit("")).otherwise(F.col("text")).alias("prompt"),
    )
    limits = vector_packing.Limits(segments=64, loss=2048)
    return vector_packing.pack_examples(examples, prompt_col="prompt", end_id=END_ID, limits=limits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_nn_descent,
        op3_bpe_automaton,
        op4_language_id,
        language_id_pages,
        op5_line_dedup,
        op6_best_fit_packing,
        op7_quality_rules,
        op8_secret_scan,
        op9_pii_pseudonyms,
        op10_toxicity,
        op11_vector_packing,
        vector_packing_turns,
        op12_hard_negatives,
        op13_spelling_variants,
    )
}

SQL: dict[str, str] = {
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, p.other_id AS positive_id,
            (row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
            n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n
            ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 10
    """,
    "op5_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(range(len(part))) AS pos, unnest(part) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents)
        ), keyed AS (
            SELECT doc_id, pos, line,
                translate(
                    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
                ) AS line_key
            FROM lines
        ), repeated AS (
            SELECT line_key, max(doc_id) AS holder
            FROM keyed WHERE length(line_key) >= 40
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT k.doc_id, k.pos, k.line, r.holder IS NULL OR r.holder = k.doc_id AS stays
            FROM keyed k LEFT JOIN repeated r USING (line_key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
