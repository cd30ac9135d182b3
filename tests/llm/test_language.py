import math

from pyspark.sql import functions as F

from textloom.llm import language, queries


def test_the_languages_of_the_table_are_found_and_clean_documents_kept(spark, docs):
    found = queries.op4_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", F.col("lang").alias("real")), "doc_id")
    rows = found.collect()
    assert len(rows) == docs.count()
    assert sum(r["lang"] == r["real"] for r in rows) >= 0.98 * len(rows)
    assert all(r["kept"] for r in rows)


def test_edge_rows(docs, edge_docs, no_docs):
    model = language.fit_text(docs)

    def run(rows):
        return language.identify(rows, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source"))

    found = run(edge_docs)
    assert found.columns == [*edge_docs.columns, "language"]
    kept = {r["doc_id"]: r["language"] for r in found.collect()}
    assert len(kept) == 12 and found.count() == 13
    assert [kept[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and not kept[2]["kept"]
    assert kept[5]["lang"] == "en" and kept[5]["kept"]
    assert run(no_docs).count() == 0


def test_no_labels_means_no_language(edge_docs, no_docs):
    model = language.fit_text(no_docs)
    found = language.identify(edge_docs, model, text=F.col("text"))
    assert {r["language"]["lang"] for r in found.collect()} == {"und"}


def test_declaration_and_host_decide_where_the_text_does_not(spark, docs):
    model = language.fit_text(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars > 300").collect()}
    rows = [(i, texts["fr"], "fr", "news.example.fr") for i in range(60)]
    rows += [(100, "le", "fr", "news.example.fr"), (101, "de la", None, "blog.example.fr")]
    table = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    found = language.identify(table, model, text=F.col("text"), declared=F.col("declared"), host=F.col("host"))
    best = {r["id"]: r["language"] for r in found.where("id >= 100").collect()}
    assert best[100]["lang"] == "fr" and best[101]["lang"] == "fr"


def test_pages_use_markup_and_address(spark):
    rows = queries.language_id_pages(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and all(r["kept"] for r in rows)


def test_every_label_is_a_language(spark):
    import random

    rng, names = random.Random(3), [f"{a}{b}" for a in "abcde" for b in "pqrstuvw"]
    words = {x: ["".join(rng.choice("bcdfghklmnprstvzaeiou") for _ in range(7)) for _ in range(30)] for x in names}
    rows = [(" ".join(rng.choices(words[x], k=40)), x) for i, x in enumerate(names) for _ in range(45 - i)]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit_text(table)
    assert model.languages == tuple(sorted(names)) and len(names) == 40
    found = language.identify(table, model, text=F.col("text"), declared=F.col("lang"))
    assert all(r["lang"] == r["language"]["lang"] and r["language"]["kept"] for r in found.collect())


def test_copies_do_not_thin_the_texts_of_a_label(spark):
    others = spark.range(200).select(F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    copies = spark.range(20_000).select(F.lit("one text with very many copies").alias("text"))
    lang = F.lit("en").alias("lang")
    many = language.fit_text(copies.unionAll(others).select("text", lang), max_texts=250)
    once = language.fit_text(copies.limit(1).unionAll(others).select("text", lang), max_texts=250)
    # Copies are one text, so they change nothing.
    assert (many.table == once.table).all() and len(set(many.table[:, 0])) > 2


def plain_fusion(rows, languages):
    """Posterior and language by dictionaries; rows (evidence, known declaration, host)."""
    silent = [not any(e) for e, _, _ in rows]
    by_text = ["und" if s else [*languages, "und"][max(range(len(e)), key=lambda i: (e[i], -i))] for (e, _, _), s in zip(rows, silent)]
    every = {x: by_text.count(x) + 1.0 for x in languages}
    everywhere = {x: n / sum(every.values()) for x, n in every.items()}

    def smoothed(members, parent):
        n = {x: sum(by_text[i] == x for i in members) for x in languages}
        return {x: (n[x] + language.PRIOR_WEIGHT * parent[x]) / (sum(n.values()) + language.PRIOR_WEIGHT) for x in languages}

    def where(test):
        return [i for i, (_, _, host) in enumerate(rows) if host is not None and test(host)]

    def prior(host):
        if host is None:
            return everywhere
        domain, suffix, parent = ".".join(host.split(".")[-2:]), host.split(".")[-1], everywhere
        if "." in host:
            parent = smoothed(where(lambda h: "." in h and h.split(".")[-1] == suffix), parent)
        parent = smoothed(where(lambda h: ".".join(h.split(".")[-2:]) == domain), parent)
        return smoothed(where(lambda h: h == host), parent)

    out = []
    for (evidence, declared, host), mute in zip(rows, silent):
        said = {x: 1.0 for x in languages}
        if declared is not None:
            n = {x: sum(by_text[i] == x and rows[i][1] == declared for i in range(len(rows))) for x in languages}
            said = {x: (n[x] + (5.0 if x == declared else 0.5)) / (every[x] + 5.0) for x in languages}
        before = prior(host)
        joint = [e + math.log(before[x] * (1 - language.UNKNOWN_PRIOR)) + math.log(said[x]) for e, x in zip(evidence, languages)]
        joint.append(evidence[-1] + math.log(sum(said.values()) / len(languages)) + math.log(language.UNKNOWN_PRIOR))
        best = max(joint)
        lang = "und" if mute else [*languages, "und"][joint.index(best)]
        out.append((lang, 1 / sum(math.exp(j - best) for j in joint)))
    return out


def test_posteriors_against_plain_python(spark, docs):
    """Text, declaration and dotted hosts, with nulls, unknown languages and hosts of one row."""
    model = language.fit_text(docs)
    hosts = ["a.news.de", "b.news.de", "x.org", "y.shop.fr", "z.shop.fr", "plain", None, "only.one.es"]
    n = F.col("doc_id")
    table = docs.select(
        "doc_id", F.when(n % 9 == 0, "?! 12").otherwise(F.substring("text", 1, 40)).alias("text"),
        F.when(n % 5 == 0, None).when(n % 7 == 0, "xx").when(n % 4 == 0, "EN-us").otherwise(F.col("lang")).alias("declared"),
        F.element_at(F.array(*[F.lit(h) for h in hosts]), (n % 8 + 1).cast("int")).alias("host"),
    )
    table = spark.createDataFrame(table.collect(), table.schema)
    found = language.identify(table, model, text=F.col("text"), declared=F.col("declared"), host=F.col("host"))
    got = {r["doc_id"]: r["language"] for r in found.collect()}
    seen = table.withColumn("e", model.evidence(F.col("text"))).orderBy("doc_id").collect()

    def known(declared):
        short = None if declared is None else declared.lower().split("-")[0]
        return short if short is None or short in model.languages else "other"

    wanted = plain_fusion([(list(r["e"]), known(r["declared"]), r["host"]) for r in seen], model.languages)
    for r, (lang, posterior) in zip(seen, wanted, strict=True):
        assert got[r["doc_id"]]["lang"] == lang and math.isclose(got[r["doc_id"]]["posterior"], posterior, rel_tol=1e-9)
    assert len({lang for lang, _ in wanted}) == len(model.languages) + 1


def test_text_alone_on_rows_not_seen_in_training(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    part = F.pmod(F.xxhash64("text"), F.lit(2))
    model = language.fit_text(docs.where(part == 0))
    found = language.identify(docs.where(part == 1), model, text=F.col("text"))
    right = found.select(F.avg((F.col("language.text_lang") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.99
