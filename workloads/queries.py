"""One query per operator, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed
from textloom.functions import html, text, vectors
from textloom.operators import (
    answer,
    catalog,
    chunking,
    classifier,
    encode,
    evaluate,
    features,
    ml,
    retrieve,
    split,
    vector_index,
)
from textloom.plans import assistant, catalog_job, experiment
from textloom.session import scratch_path, spread
from textloom.sources import corpus, models, tables
from textloom.streaming import requests as request_stream
from workloads.common import (
    ALLOW_LIST,
    DIMENSIONS,
    MARKER_WORDS,
    MODEL_BLOCK,
    ROUTE_MARKERS,
    TOP_N,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


# --- catalogue ------------------------------------------------------------------------------


def part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service models built from parts: at most MODEL_BLOCK operations per document."""
    block = F.expr(f"p_partkey div {MODEL_BLOCK}")
    operation = F.struct(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"),
        F.concat(F.lit("<p>"), F.col("p_brand"), F.lit(" &amp; <b>"), F.col("p_name"), F.lit("</b></p>")).alias("doc"),
    )
    grouped = (
        table(spark, sf_dir, "part")
        .groupBy(F.lower("p_type").alias("kind"), block.alias("block"))
        .agg(F.sort_array(F.collect_list(operation)).alias("ops"))
    )
    operations = F.map_from_entries(
        F.transform(
            "ops", lambda o: F.struct(o["name"], F.struct(o["doc"].alias("documentation")))
        )
    )
    document = F.struct(
        F.struct(
            F.concat(F.lit("Model "), F.col("kind")).alias("serviceFullName"),
            F.col("block").cast("string").alias("apiVersion"),
        ).alias("metadata"),
        operations.alias("operations"),
    )
    return grouped.select(
        F.concat_ws("-", "kind", "block").alias("service"),
        F.col("block").cast("int").alias("list_pos"),
        F.to_json(document).alias("model"),
    )


def stored_part_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "models")
    part_models(spark, sf_dir).write.parquet(path)
    return models.parse_service_models(spark.read.parquet(path))


@query
def service_models_s1_p1(spark, sf_dir):
    return catalog.extract_operations(stored_part_models(spark, sf_dir))


@query
def operations_per_service_a4(spark, sf_dir):
    return catalog.operations_per_service(stored_part_models(spark, sf_dir))


@query
def allow_list_s2(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(
        F.col("source").alias("service"), F.col("doc_id").alias("operation")
    )
    return models.select_services(records, ALLOW_LIST)


@query
def table_contract_s3(spark, sf_dir):
    return tables.load_table(spark, f"{sf_dir}/part.parquet", ("p_partkey", "p_name", "p_type"))


@query
def record_contract_f1(spark, sf_dir):
    record = F.struct(
        F.lower("p_type").alias("service"),
        F.col("p_brand").alias("service_name"),
        F.col("p_size").cast("string").alias("api_version"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("operation"),
        F.concat(F.lit('"'), "p_name", F.lit('"')).alias("description"),
        "p_retailprice",
    )
    records = table(spark, sf_dir, "part").select(F.to_json(record).alias("record"))
    return tables.parse_records(records)


@query
def intent_csv_s4_p5(spark, sf_dir):
    path = scratch_path(spark, "intents")
    padded = documents(spark, sf_dir).select(
        F.concat(F.lit("  "), "lang", F.lit(" ")).alias("service"),
        F.concat(F.lit("\t"), "text", F.lit(" \n")).alias("description"),
        "source",
    )
    padded.write.csv(
        path,
        header=True,
        quote='"',
        escape='"',
        quoteAll=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    intents = tables.load_intents(spark, path)
    return intents.select("service", F.md5("description").alias("description_md5"))


@query
def intent_problems_f3_f4(spark, sf_dir):
    """Missing and blank values of a CSV: three spellings of missing, blanks in one language."""
    path = scratch_path(spark, "intents")
    lang = F.col("lang")
    missing = F.when(lang == "de", "NA").when(lang == "fr", "").when(F.col("source") == "src3", "null")
    rows = documents(spark, sf_dir).select(
        F.when(lang == "es", F.lit(" \t")).otherwise(lang).alias("service"),
        F.coalesce(missing, F.concat(F.lit(' "'), "text", F.lit('"'))).alias("description"),
    )
    rows.write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return tables.intent_problems(tables.load_intents(spark, path, validate=False))


@query
def listing_order_o1(spark, sf_dir):
    """Models of a folder in the order of its listing: one file for every source, by name."""
    path = scratch_path(spark, "models")
    texts = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    model = F.format_string(
        '{"metadata": {"serviceFullName": "%s", "apiVersion": "1"}, "operations": {"A%d": {}}}', "source", "n"
    )
    named = texts.select(model.alias("value"), "source")
    _write_named_files(named, path)
    read = models.read_service_models(spark, path, models.ALL_SERVICES)
    return catalog.extract_operations(read).select("service", "operation", "list_pos")


def _write_named_files(named: DataFrame, folder: str) -> None:
    """A file ``<source>.json`` for every row, written by the tasks to a folder that all can reach."""

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for value, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{source}.json") as file:
                    file.write(value.encode())
            yield batch

    named.mapInArrow(write, named.schema).write.format("noop").mode("overwrite").save()


@query
def text_corpus_s5(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    documents(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 100).text(path)
    loaded = corpus.load_documents(spark, path)
    return loaded.agg(
        F.sum(F.size(text.words("text"))).alias("n_words"),
        F.sum(F.length("text")).alias("n_characters"),
    )


@query
def operation_sink_s6(spark, sf_dir):
    path = scratch_path(spark, "operations")
    records = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("operation"),
        F.col("s_nationkey").alias("service"),
        F.col("s_acctbal").alias("surplus"),
        F.lit("v1").alias("api_version"),
    )
    tables.write_operations(records, path)
    return spark.read.parquet(path)


def page_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service model per page: the host is the service, the language the operation."""
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    language = F.regexp_extract("url", "^https?://[^/]+/([^/]+)/", 1)
    document = F.struct(
        F.struct(
            F.concat(F.lit(" Host "), host, F.lit("\t")).alias("serviceFullName"),
            F.lit(" v1 ").alias("apiVersion"),
        ).alias("metadata"),
        F.create_map(
            F.concat(F.lit(" "), language, F.lit(" ")),
            F.struct(F.col("html").alias("documentation")),
        ).alias("operations"),
    )
    return spread(table(spark, sf_dir, "pages")).select(
        F.concat(F.lit("\n"), F.upper(host), F.lit(" ")).alias("service"),
        F.col("page_id").cast("int").alias("list_pos"),
        F.to_json(document).alias("model"),
    )


@query
def catalogue_job_s7(spark, sf_dir):
    source = models.parse_service_models(page_models(spark, sf_dir))
    result = catalog_job.run_catalog_job(
        source, scratch_path(spark, "raw"), scratch_path(spark, "clean")
    )
    return result.clean


@query
def catalogue_counts_a1(spark, sf_dir):
    source = models.parse_service_models(page_models(spark, sf_dir))
    result = catalog_job.run_catalog_job(
        source, scratch_path(spark, "raw"), scratch_path(spark, "clean")
    )
    counts = (result.n_raw, result.n_services, result.n_clean)
    return spark.createDataFrame([counts], "n_raw long, n_services long, n_clean long")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with blank descriptions (one language) and repeated keys (copies of a text)."""
    return documents(spark, sf_dir).select(
        F.concat(F.lit(" "), F.upper("lang")).alias("service"),
        F.lit("Corpus").alias("service_name"),
        F.lit("1").alias("api_version"),
        F.md5("text").alias("operation"),
        F.when(F.col("lang") == "es", F.lit("<p> &nbsp;</p>")).otherwise(F.col("source")).alias(
            "description"
        ),
        F.lit(0).alias("list_pos"),
        F.col("doc_id").alias("pos"),
    )


@query
def keep_first_k1_f2(spark, sf_dir):
    resolved = catalog.resolve_operations(document_records(spark, sf_dir))
    return catalog.clean_operations(resolved, extra=("pos",))


@query
def removed_records_a5(spark, sf_dir):
    return catalog.removed_operations(
        catalog.resolve_operations(document_records(spark, sf_dir))
    )


@query
def stage_counts_a1(spark, sf_dir):
    return catalog.stage_counts(catalog.resolve_operations(document_records(spark, sf_dir)))


@query
def standardise_p2(spark, sf_dir):
    records = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.upper("p_type"), F.lit(" \n")).alias("service"),
        F.concat(F.lit("\x1c"), "p_brand", F.lit(" ")).alias("service_name"),
        F.concat(F.lit("  "), F.col("p_size").cast("string")).alias("api_version"),
        F.concat("p_name", F.lit("　")).alias("operation"),
        F.concat(F.lit("<i>"), "p_name", F.lit("</i> !")).alias("description"),
        "p_partkey",
    )
    return catalog.standardise(records)


@query
def clean_html_p3(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select(
        "page_id", html.clean_html("html").alias("description")
    )


# --- words, chunks, routing -----------------------------------------------------------------


@query
def normalise_query_p6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.normalise_query("text").alias("query")
    )


@query
def word_split_p7(spark, sf_dir):
    split_words = documents(spark, sf_dir).select("doc_id", text.words("text").alias("w"))
    return split_words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.get("w", F.lit(0)).alias("first_word"),
        F.get("w", F.size("w") - 1).alias("last_word"),
    )


def document_chunks(spark: SparkSession, sf_dir: str, *window: int) -> DataFrame:
    source = documents(spark, sf_dir).select(F.col("doc_id").alias("source"), "text")
    return chunking.chunk_documents(source, *window)


@query
def chunk_documents_p9_w5(spark, sf_dir):
    return document_chunks(spark, sf_dir)


@query
def chunk_text_p8(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir, 7, 3)
    return chunks.groupBy("source").agg(
        F.count("*").alias("n_chunks"),
        F.max("chunk_number").cast("long").alias("last_number"),
        F.sum(F.size(text.words("text"))).alias("n_words"),
        F.min(F.md5("text")).alias("smallest_md5"),
        F.max(F.md5("text")).alias("largest_md5"),
    )


@query
def route_requests_p10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        answer.is_recommendation("text").alias("by_default_markers"),
        answer.is_recommendation("text", ROUTE_MARKERS).alias("by_own_markers"),
    )


@query
def reject_blank_f5(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.lit("  \n")).otherwise(F.col("text")).alias(
            "user_input"
        ),
    )
    return answer.accept_requests(requests, ROUTE_MARKERS).drop("user_input")


# --- predictions ----------------------------------------------------------------------------


def occurrences(found: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def marker_predictions(text_column: str, top: int = fixed.TOP_PREDICTIONS) -> Column:
    """Language probabilities from marker words, add-one smoothed."""

    def shares(found: Column) -> Column:
        counted = {lang: occurrences(found, words) for lang, words in MARKER_WORDS.items()}
        total = sum(counted.values(), F.lit(len(counted)))
        return F.array(
            *(
                F.struct(
                    F.lit(lang).alias("service"), ((n + 1) / total).alias("probability")
                )
                for lang, n in counted.items()
            )
        )

    found = F.split(F.lower(F.col(text_column)), " ")
    return text.let(text.let(found, shares), lambda p: classifier.rank_predictions(p, top))


class MarkerClassifier:
    """Drop-in for a fitted classifier, transparent enough to restate in SQL."""

    def classify(self, texts, id_col, text_col="text", top=fixed.TOP_PREDICTIONS):
        return texts.withColumn("predictions", marker_predictions(text_col, top))


def document_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", "lang", marker_predictions("text").alias("predictions")
    )


@query
def top_predictions_w1(spark, sf_dir):
    ranked = document_predictions(spark, sf_dir).select("doc_id", F.posexplode("predictions"))
    return ranked.select(
        "doc_id",
        (F.col("pos") + 1).alias("rank"),
        "col.service",
        F.round("col.probability", 6).alias("probability"),
    )


@query
def confidence_gate_p11_w3(spark, sf_dir):
    return document_predictions(spark, sf_dir).select(
        "doc_id",
        F.round(answer.margin("predictions"), 6).alias("margin"),
        answer.needs_clarification("predictions").alias("clarification"),
    )


@query
def reply_texts_p12_p15_p16_p17(spark, sf_dir):
    scored = document_predictions(spark, sf_dir)
    return scored.select(
        "doc_id",
        answer.clarification_reply("predictions").alias("clarification"),
        answer.classifier_output("predictions").alias("classifier_output"),
        answer.final_reply(F.col("lang") == "en", "predictions", F.lit("  Because. \n")).alias(
            "reply"
        ),
        answer.ranked_display("predictions").alias("display"),
    )


@query
def system_prompt_p14(spark, sf_dir):
    scored = document_predictions(spark, sf_dir)
    prompt = answer.system_prompt(
        F.col("lang") == "en", "predictions", F.concat(F.lit("- context of "), "doc_id")
    )
    return scored.select("doc_id", prompt.alias("system_prompt"))


# --- evaluation -----------------------------------------------------------------------------


def marker_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = document_predictions(spark, sf_dir)
    return scored.select(
        F.col("lang").alias("actual"),
        F.element_at("predictions", 1).getField("service").alias("predicted"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def metrics_a6_a7(spark, sf_dir):
    result = evaluate.metrics(marker_evaluation(spark, sf_dir))
    return _rounded(result, "accuracy", "precision", "recall", "f1_score")


@query
def classification_report_a8(spark, sf_dir):
    result = evaluate.report(marker_evaluation(spark, sf_dir))
    return _rounded(result, "precision", "recall", "f1_score")


@query
def confusion_matrix_a9(spark, sf_dir):
    labels = [*MARKER_WORDS, "xx"]
    return _rounded(
        evaluate.confusion_matrix(marker_evaluation(spark, sf_dir), labels), "share"
    )


# --- labelled data --------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.training_pairs(documents(spark, sf_dir), "text", "lang", "doc_id")


@query
def training_pairs_p4(spark, sf_dir):
    pairs = labelled(spark, sf_dir)
    return pairs.select("doc_id", F.md5("text").alias("text_md5"), "label")


@query
def distinct_labels_a2(spark, sf_dir):
    return split.distinct_labels(labelled(spark, sf_dir))


@query
def rows_per_label_a3(spark, sf_dir):
    return split.rows_per_label(labelled(spark, sf_dir)).orderBy("label")


@query
def rows_of_label_f7(spark, sf_dir):
    return split.rows_of_label(labelled(spark, sf_dir), "es").select("doc_id", "label")


@query
def balanced_weights_m6(spark, sf_dir):
    return _rounded(split.balanced_weights(labelled(spark, sf_dir)), "weight")


@query
def unknown_labels_j1_u3(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("service"))
    solvent = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    known = solvent.select(F.col("s_nationkey").alias("service"))
    return split.unknown_labels(nations, known)


@query
def stratified_split_w4(spark, sf_dir):
    return split.stratified_split(
        labelled(spark, sf_dir).select("doc_id", "label"), "doc_id"
    ).parts


@query
def weighted_union_u1(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang", "source")
    base = rows.where(F.col("lang") == "en")
    return split.weighted_union(base, rows.where(F.col("lang") != "en"))


# --- features -------------------------------------------------------------------------------


@query
def terms_m1(spark, sf_dir):
    found = documents(spark, sf_dir).select(
        "doc_id", text.tokens("text").alias("tokens"), features.terms("text").alias("terms")
    )
    return found.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.size("terms").cast("long").alias("n_terms"),
        F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"),
        F.array_max("terms").alias("last_term"),
    )


@query
def document_frequency_m2_m3(spark, sf_dir):
    model = features.fit_tfidf(documents(spark, sf_dir))
    per_value = model.vocabulary.groupBy("df", F.round("idf", 6).alias("idf")).agg(
        F.count("*").alias("n_terms"), F.min("term").alias("first_term")
    )
    return per_value


@query
def tfidf_weights_m4_m5(spark, sf_dir):
    source = documents(spark, sf_dir)
    weights = features.fit_tfidf(source).weights(source)
    per_document = weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.max("tf").cast("long").alias("largest_tf"),
        F.sum("weight").alias("total"),
        F.max("weight").alias("largest"),
        F.sum(F.col("weight") * F.col("weight")).alias("squared_length"),
    )
    return _rounded(per_document, "total", "largest", "squared_length")


# --- trained classifier ---------------------------------------------------------------------

_FITTED: dict[tuple[str, str], classifier.TextClassifier] = {}


def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text", F.col("role").alias("label")
    )


def role_classifier(spark: SparkSession, sf_dir: str) -> classifier.TextClassifier:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = classifier.fit_classifier(role_rows(spark, sf_dir), "id")
    return _FITTED[key]


def close_classifier(spark: SparkSession, sf_dir: str) -> classifier.TextClassifier:
    """Fitted so closely that shown digits do not depend on where the fit stopped."""
    return classifier.fit_classifier(role_rows(spark, sf_dir), "id", tolerance=1e-8)


@query
def fit_and_predict_m7_m8(spark, sf_dir):
    model = role_classifier(spark, sf_dir)
    return model.predict(role_rows(spark, sf_dir), "id").select("id", "label", "predicted")


@query
def class_probabilities_m9(spark, sf_dir):
    model = role_classifier(spark, sf_dir)
    scored = model.classify(role_rows(spark, sf_dir), "id", top=len(model.labels))
    total = F.aggregate("predictions", F.lit(0.0), lambda acc, p: acc + p["probability"])
    falling = F.col("predictions")[0]["probability"] >= F.col("predictions")[1]["probability"]
    return scored.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.abs(total - 1.0) > 1e-9).alias("n_bad_totals"),
        F.count_if(~falling).alias("n_bad_orders"),
    )


@query
def fitted_probabilities_m7_m9(spark, sf_dir):
    """Probabilities of the rows' own labels at the optimum, which the SQL finds in another way."""
    rows = role_rows(spark, sf_dir)
    model = close_classifier(spark, sf_dir)
    scored = model.probabilities(rows, "id")
    place = F.array_position(F.lit(list(model.labels)), F.col("label")).cast("int")
    own = scored.select("label", F.element_at("probabilities", place).alias("p"))
    return own.groupBy("label").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("p"), 5).alias("mean_probability"),
        F.round(F.min("p"), 4).alias("least_probability"),
    )


@query
def model_round_trip_s8(spark, sf_dir):
    model = role_classifier(spark, sf_dir)
    path = scratch_path(spark, "saved-model")
    model.save(path)
    loaded = classifier.TextClassifier.load(spark, path)
    rows = role_rows(spark, sf_dir)
    before = model.predict(rows, "id").select("id", F.col("predicted").alias("before"))
    after = loaded.predict(rows, "id").select("id", F.col("predicted").alias("after"))
    return before.join(after, "id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("before") != F.col("after")).alias("n_different"),
    )


def quality_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two labelled sources: English texts, and the other languages as the second one."""
    rated = (
        documents(spark, sf_dir)
        .join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
        .select("doc_id", "text", F.col("quality").cast("string").alias("label"), "lang")
    )
    english = F.col("lang") == "en"
    return rated.where(english).drop("lang"), rated.where(~english).drop("lang")


_EXPERIMENTS: dict[tuple[str, str], experiment.Experiment] = {}


def quality_experiment(spark: SparkSession, sf_dir: str) -> experiment.Experiment:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EXPERIMENTS:
        base, extra = quality_sources(spark, sf_dir)
        _EXPERIMENTS[key] = experiment.train_and_evaluate(base, extra, "doc_id")
    return _EXPERIMENTS[key]


@query
def training_experiment_m10(spark, sf_dir):
    found = quality_experiment(spark, sf_dir).metrics
    return _rounded(found, "accuracy", "precision", "recall", "f1_score")


@query
def evaluation_sink_s9(spark, sf_dir):
    path = scratch_path(spark, "confusion")
    tables.write_confusion(quality_experiment(spark, sf_dir).confusion, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("variant", "test_set").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_cells")
    )


# --- vectors --------------------------------------------------------------------------------


def hashed(df: DataFrame, text_column: str = "text") -> DataFrame:
    return df.withColumn("embedding", encode.hashed_embedding(text_column, DIMENSIONS))


def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.vector_store(
        hashed(document_chunks(spark, sf_dir)), scratch_path(spark, "store")
    )


@query
def embed_chunks_v1_v3(spark, sf_dir):
    store = chunk_store(spark, sf_dir)
    places = F.sequence(F.lit(1), F.lit(DIMENSIONS))
    weighted = F.zip_with("embedding", places, lambda x, i: x * i)
    return store.select(
        "source",
        "chunk_number",
        F.md5("text").alias("text_md5"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_slots"),
        F.round("norm", 6).alias("norm"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x), 6).alias("checksum"),
    )


@query
def custom_encoder_v1(spark, sf_dir):
    def letter_counts():
        import numpy as np

        def encoder(texts):
            return np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype=float)

        return encoder

    embedded = encode.embed(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), letter_counts
    )
    return embedded.select(
        "conv_id",
        "turn",
        *(F.round(F.col("embedding")[i].cast("double"), 4).alias(c) for i, c in enumerate("aeiou")),
    )


def scaled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by their label, so that one label (0) gives zero vectors."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("embedding"),
    )


@query
def unit_length_v2(spark, sf_dir):
    units = scaled_embeddings(spark, sf_dir).select(
        "vec_id", vectors.unit("embedding").alias("u")
    )
    return units.select(
        "vec_id",
        F.round(vectors.l2_norm("u"), 6).alias("norm"),
        F.round(F.element_at("u", 1), 6).alias("first"),
        F.round(F.element_at("u", -1), 6).alias("last"),
    )


@query
def cosine_similarity_v4(spark, sf_dir):
    scaled = scaled_embeddings(spark, sf_dir)
    following = scaled.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following")
    )
    return scaled.join(following, "vec_id").select(
        "vec_id", F.round(vectors.cosine("embedding", "following"), 6).alias("similarity")
    )


def nearest(spark: SparkSession, sf_dir: str, broadcast_values: int) -> DataFrame:
    held = scaled_embeddings(spark, sf_dir)
    queries = held.select(F.col("vec_id").alias("request_id"), "embedding")
    store = held.select(
        F.col("vec_id").alias("source"), F.lit(1).alias("chunk_number"), "embedding"
    )
    found = retrieve.top_matches(queries, store, TOP_N, broadcast_values)
    return _rounded(found, "similarity")


@query
def top_matches_v5_w2(spark, sf_dir):
    return nearest(spark, sf_dir, retrieve.BROADCAST_VALUES)


@query
def top_matches_grid_v5_j2(spark, sf_dir):
    return nearest(spark, sf_dir, 0)


@query
def top_matches_index_v5_j2(spark, sf_dir):
    held = scaled_embeddings(spark, sf_dir)
    queries = held.select(F.col("vec_id").alias("request_id"), "embedding")
    store = held.select(
        F.col("vec_id").alias("source"), F.lit(1).alias("chunk_number"), "embedding"
    )
    return _rounded(vector_index.build_index(store).search(queries, TOP_N), "similarity")


@query
def indexed_chunks_v5(spark, sf_dir):
    queries = hashed(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    )
    index = vector_index.build_index(chunk_store(spark, sf_dir))
    return _rounded(index.search(queries, TOP_N), "similarity")


@query
def empty_store_f8(spark, sf_dir):
    queries = hashed(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    )
    empty = hashed(document_chunks(spark, sf_dir)).where(F.col("text") == "")
    return retrieve.retrieve(queries, empty)


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = hashed(
        table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    )
    return retrieve.retrieve(queries, chunk_store(spark, sf_dir), TOP_N)


@query
def retrieve_chunks_v5(spark, sf_dir):
    return _rounded(benchmark_matches(spark, sf_dir), "similarity")


@query
def context_p13_a10(spark, sf_dir):
    return answer.build_context(benchmark_matches(spark, sf_dir)).drop("retrieved")


# --- request answering ----------------------------------------------------------------------


def user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as requests; system turns stand for blank input."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"),
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("text")).alias(
            "user_input"
        ),
    )


def marker_assistant(spark: SparkSession, sf_dir: str, scorer=None) -> assistant.Assistant:
    def explain(prompts: DataFrame) -> DataFrame:
        return prompts.withColumn(
            "explanation",
            F.format_string("  Based on %d chunks: %s\n", F.col("n_chunks"), F.col("user_input")),
        )

    return assistant.Assistant(
        classifier=MarkerClassifier() if scorer is None else scorer,
        store=chunk_store(spark, sf_dir),
        encode=lambda c: encode.hashed_embedding(c, DIMENSIONS),
        generate=explain,
        markers=ROUTE_MARKERS,
    )


def _answer_digest(answers: DataFrame) -> DataFrame:
    return answers.select(
        "request_id",
        "recommendation",
        "status",
        "n_chunks",
        "n_characters",
        F.md5("context").alias("context_md5"),
        F.md5("system_prompt").alias("prompt_md5"),
        F.md5("reply").alias("reply_md5"),
    )


@query
def answer_requests_q1_j3(spark, sf_dir):
    helper = marker_assistant(spark, sf_dir)
    return _answer_digest(helper.answer(user_requests(spark, sf_dir)))


@query
def answer_requests_trained_q1(spark, sf_dir):
    """The same run with a trained classifier, saved and read again."""
    path = scratch_path(spark, "served-model")
    close_classifier(spark, sf_dir).save(path)
    helper = marker_assistant(spark, sf_dir, classifier.TextClassifier.load(spark, path))
    return _answer_digest(helper.answer(user_requests(spark, sf_dir)))


@query
def answer_requests_model_q1(spark, sf_dir):
    """The same run with a Spark ML pipeline, fitted, written and read again."""
    path = scratch_path(spark, "served-pipeline")
    stages = [ml.TextClassification(textCol="text", labelCol="label", tol=1e-8)]
    Pipeline(stages=stages).fit(role_rows(spark, sf_dir)).write().overwrite().save(path)
    helper = marker_assistant(spark, sf_dir, PipelineModel.load(path))
    return _answer_digest(helper.answer(user_requests(spark, sf_dir)))


@query
def answer_stream_q2(spark, sf_dir):
    folder, answers, log, checkpoint = (
        scratch_path(spark, n) for n in ("requests", "answers", "log", "stream")
    )
    spoken = user_requests(spark, sf_dir)
    leaving = spoken.select(
        F.concat(F.lit("bye:"), "request_id").alias("request_id"), F.lit(" Quit ").alias("user_input")
    )
    spoken.unionByName(leaving).repartition(4).write.json(folder)
    stream = request_stream.answer_stream(
        request_stream.read_requests(spark, folder, max_files_per_trigger=2),
        marker_assistant(spark, sf_dir),
        answers,
        log,
        checkpoint,
    )
    stream.awaitTermination()
    tables = request_stream.answers_and_log(answers, log)
    tables.merge(spark)
    return _answer_digest(tables.first(spark))


@query
def interaction_log_s10(spark, sf_dir):
    answers = marker_assistant(spark, sf_dir).answer(user_requests(spark, sf_dir))
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    path = scratch_path(spark, "log")
    assistant.append_log(assistant.log_records(answers, at), path)
    return (
        spark.read.parquet(path)
        .groupBy("logged_at", "level", "kind", "status")
        .agg(F.count("*").alias("n"))
    )
