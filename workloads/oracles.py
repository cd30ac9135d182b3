"""DuckDB SQL with the same results as the queries, written independently of the Spark code."""

from __future__ import annotations

from textloom import fixed
from workloads.classifier_sql import PREDICTED_ROLES, ROLE_PROBABILITIES, TRAINED_ROLES, experiment
from workloads.common import (
    ALLOW_LIST,
    DIMENSIONS,
    MARKER_WORDS,
    MODEL_BLOCK,
    ROUTE_MARKERS,
    TOP_N,
)

# The 29 whitespace code points, as an RE2 class.
WS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda w: w <> '')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def entities(c: str) -> str:
    """The references found in the tables, which also count unclosed; the ampersand last."""
    for name, character in (
        ("nbsp", "\u00a0"),
        ("copy", "©"),
        ("middot", "·"),
        ("quot", '"'),
        ("lt", "<"),
        ("gt", ">"),
        ("amp", "&"),
    ):
        c = f"regexp_replace({c}, '&{name};?', {quoted(character)}, 'g')"
    return c


def clean(c: str) -> str:
    c = entities(f"coalesce({c}, '')")
    c = f"regexp_replace({c}, '<!--.*?-->', ' ', 'gs')"
    for element in ("script", "style", "template"):
        c = rf"regexp_replace({c}, '<{element}\b[^>]*>.*?</{element}\s*>', ' ', 'gsi')"
    tag = """<[/!?]?[a-zA-Z](?:"[^"]*"|''[^'']*''|[^''">])*>"""
    c = f"regexp_replace({c}, '{tag}', ' ', 'gs')"
    c = entities(c)
    c = f"regexp_replace({c}, '{WS}+', ' ', 'g')"
    c = rf"regexp_replace({c}, '{WS}+([.,!?;:])', '\1', 'g')"
    return strip(c)


def percent(c: str) -> str:
    return f"format('{{:.1f}}%', {c} * 100)"


PART_OPERATIONS = f"""
  SELECT lower(p_type) || '-' || (p_partkey // {MODEL_BLOCK}) AS service,
         'Model ' || lower(p_type) AS service_name,
         (p_partkey // {MODEL_BLOCK})::VARCHAR AS api_version,
         p_name || ' ' || p_partkey AS operation,
         '<p>' || p_brand || ' &amp; <b>' || p_name || '</b></p>' AS description,
         (p_partkey // {MODEL_BLOCK})::INTEGER AS list_pos,
         (row_number() OVER (PARTITION BY p_type, p_partkey // {MODEL_BLOCK}
                             ORDER BY p_partkey) - 1)::INTEGER AS pos
  FROM part"""

PAGE_RECORDS = f"""
  SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)/', 1)) AS service,
         'Host ' || regexp_extract(url, '^https?://([^/]+)/', 1) AS service_name,
         'v1' AS api_version,
         regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS operation,
         {clean("html")} AS description
  FROM pages"""

PAGE_CLEAN = f"""
  SELECT service, service_name, api_version, operation, description
  FROM ({PAGE_RECORDS})
  WHERE description <> ''
  QUALIFY row_number() OVER (PARTITION BY service, operation ORDER BY page_id) = 1"""

DOCUMENT_RECORDS = """
  SELECT lang AS service, 'Corpus' AS service_name, '1' AS api_version, md5(text) AS operation,
         CASE WHEN lang = 'es' THEN '' ELSE source END AS description, doc_id AS pos
  FROM documents"""


def chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
  SELECT source, (i + 1)::INTEGER AS chunk_number,
         array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS text
  FROM (SELECT source, w, unnest(range(CASE WHEN len(w) = 0 THEN 0
                                            WHEN len(w) <= {size} THEN 1
                                            ELSE (len(w) - {overlap} + {step} - 1) // {step}
                                       END)) AS i
        FROM (SELECT doc_id AS source, {words("text")} AS w FROM documents))"""


def _marker_probabilities(text_column: str) -> str:
    counts = [
        f"len(list_filter(string_split(lower({text_column}), ' '), "
        f"lambda w: w IN ({', '.join(quoted(m) for m in markers)})))"
        for markers in MARKER_WORDS.values()
    ]
    total = f"({len(counts)} + {' + '.join(counts)})"
    entries = ", ".join(
        f"{{'k': -(({n} + 1)::DOUBLE / {total}), 's': '{lang}'}}"
        for lang, n in zip(MARKER_WORDS, counts)
    )
    return f"list_sort([{entries}])[1:3]"


PREDICTED = f"SELECT doc_id, lang, {_marker_probabilities('text')} AS p FROM documents"

CLARIFICATION = "printf({template}, upper(p[1].s), upper(p[2].s))".format(
    template=quoted(fixed.CLARIFICATION_REPLY)
)
OPENING = "printf({template}, upper(p[1].s), {share})".format(
    template=quoted(fixed.RECOMMENDATION_REPLY), share=percent("(-p[1].k)")
)
OUTPUT_LINES = (
    "array_to_string(list_transform(p, lambda x: '- ' || upper(x.s) || ': ' || "
    + percent("(-x.k)")
    + " || ' confidence'), chr(10))"
)


def _fill(template: str, *values: str) -> str:
    pieces = [quoted(piece) for piece in template.split("%s")]
    filled = pieces[0]
    for value, piece in zip(values, pieces[1:]):
        filled += f" || {value} || {piece}"
    return f"({filled})"


def system_prompt(recommendation: str, context: str) -> str:
    instructions = (
        f"CASE WHEN {recommendation} THEN "
        + _fill(fixed.RECOMMENDATION_INSTRUCTIONS, "upper(p[1].s)", OUTPUT_LINES)
        + f" ELSE {quoted(fixed.GENERAL_INSTRUCTIONS)} END"
    )
    return _fill(fixed.SYSTEM_PROMPT, f"({instructions})", context)


EVALUATED = f"SELECT lang AS actual, p[1].s AS predicted FROM ({PREDICTED})"

PER_LABEL = f"""
  e AS ({EVALUATED}),
  l AS (SELECT actual AS label FROM e UNION SELECT predicted FROM e),
  c AS (SELECT label,
               (SELECT count(*) FROM e WHERE actual = label) AS support,
               (SELECT count(*) FROM e WHERE predicted = label) AS claimed,
               (SELECT count(*) FROM e WHERE actual = label AND predicted = label) AS hits
        FROM l),
  m AS (SELECT label, support, hits,
               CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
               2 * hits / (support + claimed) AS f1_score
        FROM c)"""

QUOTAS = """
  SELECT label, n, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                                     <= n_test - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT label, n, n_test, (n * n_test) // total AS whole, (n * n_test) % total AS rest
        FROM (SELECT label, n, sum(n) OVER () AS total,
                     ceil(0.2::DOUBLE * sum(n) OVER ())::BIGINT AS n_test
              FROM (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1)))"""

TERMS = r"""
  tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
  lists AS (SELECT doc_id, t, list_concat(t, list_transform(range(1, len(t)),
                   lambda i: t[i] || ' ' || t[i + 1])) AS terms FROM tok),
  tf AS (SELECT doc_id, term, count(*) AS tf
         FROM (SELECT doc_id, unnest(terms) AS term FROM lists) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
  idf AS (SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
          FROM df)"""


def embedded(columns: str, text_column: str, source: str, name: str) -> str:
    """CTEs ending in ``name`` with ``v`` (unit vector) next to ``columns``."""
    return rf"""
  {name}_s AS (SELECT {columns}, list_transform(
                      regexp_extract_all(lower({text_column}), '[\p{{L}}\p{{N}}_]{{2,}}'),
                      lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIMENSIONS}) AS slots
               FROM {source}),
  {name}_c AS (SELECT * EXCLUDE (slots), list_transform(range({DIMENSIONS}),
                      lambda s: len(list_filter(slots, lambda x: x = s))::DOUBLE) AS c
               FROM {name}_s),
  {name}_n AS (SELECT *, sqrt(list_dot_product(c, c)) AS n FROM {name}_c),
  {name} AS (SELECT * EXCLUDE (c, n),
                    CASE WHEN n > 0 THEN list_transform(c, lambda x: x / n) ELSE c END AS v,
                    CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS norm
             FROM {name}_n)"""


CHUNKS = chunks(fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP)

STORE = f"chunks AS ({CHUNKS}), " + embedded(
    "source, chunk_number, text", "text", "chunks", "store"
)


def matches(queries: str) -> str:
    """CTE ``best``: the top n per row of ``queries`` (request_id, v)."""
    return f"""
  scored AS (SELECT request_id, source, chunk_number, s.text,
                    CASE WHEN q.norm > 0 AND s.norm > 0
                         THEN round(list_cosine_similarity(q.v, s.v), 9) ELSE 0 END AS sim
             FROM {queries} q CROSS JOIN store s),
  best AS (SELECT *, row_number() OVER w AS rank FROM scored
           WINDOW w AS (PARTITION BY request_id ORDER BY sim DESC, source, chunk_number)
           QUALIFY row_number() OVER w <= {TOP_N})"""


BENCHMARK = embedded("item_id AS request_id", "text", "benchmark", "asked")

SCALED = """
  scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v
             FROM embeddings),
  sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM scaled)"""

NEAREST = f"""
WITH {SCALED},
  scored AS (SELECT q.vec_id AS request_id, s.vec_id AS source, 1::INTEGER AS chunk_number,
                    CASE WHEN q.n > 0 AND s.n > 0
                         THEN round(list_cosine_similarity(q.v, s.v), 9) ELSE 0 END AS sim
             FROM sized q CROSS JOIN sized s)
SELECT request_id, rank::INTEGER AS rank, source, chunk_number, round(sim, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY request_id
                                   ORDER BY sim DESC, source, chunk_number) AS rank FROM scored)
WHERE rank <= {TOP_N}"""

_ROUTED = " OR ".join(f"contains(lower(user_input), {quoted(m)})" for m in ROUTE_MARKERS)



def answered(predictions: str, source: str = "asked_all") -> str:
    """CTEs ending in ``answered``; ``predictions`` gives the ranked list of a row of ``source``."""
    return f"""
  asked_all AS (SELECT conv_id || ':' || turn AS request_id,
                       CASE WHEN role = 'system' THEN '  ' ELSE text END AS user_input
                FROM conversations),
  routed AS (SELECT *, {strip("user_input")} = '' AS blank, ({_ROUTED}) AS recommendation,
                    {predictions} AS p
             FROM {source}),
  gated AS (SELECT *, CASE WHEN blank THEN '{fixed.REJECTED}'
                           WHEN recommendation AND (-p[1].k < {fixed.MINIMUM_CONFIDENCE}
                                OR -p[1].k + p[2].k < {fixed.MINIMUM_MARGIN})
                           THEN '{fixed.CLARIFICATION}' ELSE '{fixed.COMPLETED}' END AS status
            FROM routed),
  open_requests AS (SELECT * FROM gated WHERE status = '{fixed.COMPLETED}'),
  {embedded("request_id", "user_input", "open_requests", "asked")},
  {STORE},
  {matches("asked")},
  context AS (SELECT request_id, count(*) AS n_chunks,
                     string_agg('- ' || text, chr(10) ORDER BY rank) AS context
              FROM best GROUP BY 1),
  answered AS (SELECT g.request_id, user_input, recommendation, status, p,
                      c.n_chunks, c.context,
                      'Based on ' || c.n_chunks || ' chunks: ' || user_input AS explanation
               FROM gated g LEFT JOIN context c USING (request_id))"""


ANSWERED = answered(_marker_probabilities("user_input"))

DIGEST = f"""
SELECT request_id, recommendation, status, n_chunks::INTEGER AS n_chunks,
       length(context)::INTEGER AS n_characters, md5(context) AS context_md5,
       CASE WHEN status = '{fixed.COMPLETED}'
            THEN md5({system_prompt("recommendation", "context")}) END AS prompt_md5,
       md5(CASE WHEN status = '{fixed.CLARIFICATION}' THEN {CLARIFICATION}
                WHEN status = '{fixed.COMPLETED}' AND recommendation
                THEN {OPENING} || {strip("explanation")}
                WHEN status = '{fixed.COMPLETED}' THEN {strip("explanation")} END) AS reply_md5
FROM answered"""

ANSWER_DIGEST = f"WITH {ANSWERED}{DIGEST}"

# Requests classified by the role that a trained classifier gives them.
TRAINED_DIGEST = f"""
WITH RECURSIVE {TRAINED_ROLES},
{answered("(SELECT list_sort(list_transform(range(1, len(e) + 1), lambda j: {'k': -e[j] / list_sum(e), 's': names[j]}))[1:3])", "asked_all LEFT JOIN fitted_roles ON id = request_id")}
{DIGEST}"""

ORACLES: dict[str, str] = {
    "service_models_s1_p1": PART_OPERATIONS,
    "operations_per_service_a4": f"""
        SELECT service, service_name, api_version, count(*)::INTEGER AS n_operations
        FROM ({PART_OPERATIONS}) GROUP BY ALL""",
    "allow_list_s2": f"""
        SELECT source AS service, doc_id AS operation,
               (list_position({list(ALLOW_LIST)}, source) - 1)::INTEGER AS list_pos
        FROM documents WHERE source IN {ALLOW_LIST}""",
    "table_contract_s3": "SELECT * FROM part",
    "record_contract_f1": """
        SELECT lower(p_type) AS service, p_brand AS service_name, p_size::VARCHAR AS api_version,
               p_name || ' ' || p_partkey AS operation, '"' || p_name || '"' AS description
        FROM part""",
    "intent_csv_s4_p5": f"""
        SELECT {strip("'  ' || lang || ' '")} AS service,
               md5({strip("text")}) AS description_md5 FROM documents""",
    "intent_problems_f3_f4": """
        SELECT 0::BIGINT AS null_service,
               count_if(lang IN ('de', 'fr') OR source = 'src3')::BIGINT AS null_description,
               count_if(lang = 'es')::BIGINT AS blank_service, 0::BIGINT AS blank_description
        FROM documents""",
    "listing_order_o1": """
        SELECT source AS service, 'A' || count(*) AS operation,
               (row_number() OVER (ORDER BY source) - 1)::INTEGER AS list_pos
        FROM documents GROUP BY source""",
    "text_corpus_s5": f"""
        SELECT sum(len({words("text")}))::BIGINT AS n_words,
               sum(length(text) + 1)::BIGINT AS n_characters FROM documents""",
    "operation_sink_s6": """
        SELECT s_nationkey::VARCHAR AS service, NULL::VARCHAR AS service_name,
               'v1' AS api_version, s_name AS operation, NULL::VARCHAR AS description
        FROM supplier""",
    "catalogue_job_s7": PAGE_CLEAN,
    "catalogue_counts_a1": f"""
        SELECT (SELECT count(*) FROM pages) AS n_raw,
               (SELECT count(DISTINCT service) FROM ({PAGE_RECORDS})) AS n_services,
               (SELECT count(*) FROM ({PAGE_CLEAN})) AS n_clean""",
    "keep_first_k1_f2": f"""
        SELECT * FROM ({DOCUMENT_RECORDS}) WHERE description <> ''
        QUALIFY row_number() OVER (PARTITION BY service, operation ORDER BY pos) = 1""",
    "removed_records_a5": f"""
        SELECT service, operation, 'empty' AS reason, count(*) AS n_removed
        FROM ({DOCUMENT_RECORDS}) WHERE description = '' GROUP BY ALL
        UNION ALL
        SELECT service, operation, 'duplicate', count(*) - 1
        FROM ({DOCUMENT_RECORDS}) WHERE description <> '' GROUP BY ALL HAVING count(*) > 1""",
    "stage_counts_a1": f"""
        SELECT count(*) AS n_in,
               count(DISTINCT CASE WHEN description <> '' THEN service || ' ' || operation END) AS n_out,
               count_if(description = '')::BIGINT AS n_empty,
               (count_if(description <> '')
                - count(DISTINCT CASE WHEN description <> '' THEN service || ' ' || operation END)
               )::BIGINT AS n_duplicate
        FROM ({DOCUMENT_RECORDS})""",
    "standardise_p2": """
        SELECT lower(p_type) AS service, p_brand AS service_name, p_size::VARCHAR AS api_version,
               p_name AS operation, p_name || '!' AS description, p_partkey FROM part""",
    "clean_html_p3": f"SELECT page_id, {clean('html')} AS description FROM pages",
    "normalise_query_p6": f"""
        SELECT conv_id, turn, array_to_string({words("text")}, ' ') AS query FROM conversations""",
    "word_split_p7": f"""
        SELECT doc_id, len(w)::BIGINT AS n_words, w[1] AS first_word, w[-1] AS last_word
        FROM (SELECT doc_id, {words("text")} AS w FROM documents)""",
    "chunk_documents_p9_w5": CHUNKS,
    "chunk_text_p8": f"""
        SELECT source, count(*) AS n_chunks, max(chunk_number)::BIGINT AS last_number,
               sum(len({words("text")}))::BIGINT AS n_words, min(md5(text)) AS smallest_md5,
               max(md5(text)) AS largest_md5
        FROM ({chunks(7, 3)}) GROUP BY source""",
    "route_requests_p10": f"""
        SELECT conv_id, turn,
               {" OR ".join(f"contains(lower(user_input), {quoted(m)})" for m in fixed.RECOMMENDATION_MARKERS)} AS by_default_markers,
               {_ROUTED} AS by_own_markers
        FROM (SELECT conv_id, turn, text AS user_input FROM conversations)""",
    "reject_blank_f5": f"""
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{fixed.REJECTED}' END AS status,
               role <> 'system' AND ({_ROUTED}) AS recommendation
        FROM (SELECT conv_id, turn, role, text AS user_input FROM conversations)""",
    "top_predictions_w1": f"""
        SELECT doc_id, i::INTEGER AS rank, p[i].s AS service, round(-p[i].k, 6) AS probability
        FROM (SELECT doc_id, p, unnest(range(1, 4)) AS i FROM ({PREDICTED}))""",
    "confidence_gate_p11_w3": f"""
        SELECT doc_id, round(-p[1].k + p[2].k, 6) AS margin,
               -p[1].k < {fixed.MINIMUM_CONFIDENCE}
               OR -p[1].k + p[2].k < {fixed.MINIMUM_MARGIN} AS clarification
        FROM ({PREDICTED})""",
    "reply_texts_p12_p15_p16_p17": f"""
        SELECT doc_id, {CLARIFICATION} AS clarification, {OUTPUT_LINES} AS classifier_output,
               CASE WHEN lang = 'en' THEN {OPENING} || 'Because.' ELSE 'Because.' END AS reply,
               '[Result] ' || p[1].s || ' (' || {percent("(-p[1].k)")} || ' confidence)' || chr(10)
               || '[Other possibilities]' || chr(10)
               || array_to_string(list_transform(p[2:3], lambda x: '- ' || x.s || ': '
                                  || {percent("(-x.k)")}), chr(10)) AS display
        FROM ({PREDICTED})""",
    "system_prompt_p14": f"""
        SELECT doc_id, {system_prompt("lang = 'en'", "'- context of ' || doc_id")} AS system_prompt
        FROM ({PREDICTED})""",
    "metrics_a6_a7": f"""
        WITH {PER_LABEL}
        SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision,
               round(avg(recall), 6) AS recall, round(avg(f1_score), 6) AS f1_score FROM m""",
    "classification_report_a8": f"""
        WITH {PER_LABEL}, t AS (SELECT sum(support)::BIGINT AS n, sum(hits) / sum(support) AS acc FROM m)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1_score, 6) AS f1_score, support::BIGINT AS support, false AS is_summary FROM m
        UNION ALL
        SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n, true FROM t
        UNION ALL
        SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
               round(avg(f1_score), 6), sum(support)::BIGINT, true FROM m
        UNION ALL
        SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
               round(sum(recall * support) / sum(support), 6),
               round(sum(f1_score * support) / sum(support), 6), sum(support)::BIGINT, true FROM m""",
    "confusion_matrix_a9": f"""
        WITH e AS ({EVALUATED}),
        l AS (SELECT unnest({[*MARKER_WORDS, "xx"]}) AS label),
        n AS (SELECT a.label AS actual, b.label AS predicted,
                     (SELECT count(*) FROM e WHERE actual = a.label AND predicted = b.label) AS n
              FROM l a CROSS JOIN l b)
        SELECT actual, predicted, n,
               round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS share
        FROM n""",
    "training_pairs_p4": "SELECT doc_id, md5(text) AS text_md5, lang AS label FROM documents",
    "distinct_labels_a2": """
        SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_labels FROM documents""",
    "rows_per_label_a3": "SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1",
    "rows_of_label_f7": "SELECT doc_id, lang AS label FROM documents WHERE lang = 'es'",
    "balanced_weights_m6": """
        SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
        FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1)""",
    "unknown_labels_j1_u3": """
        SELECT n_nationkey AS service FROM nation WHERE NOT EXISTS
          (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)""",
    "stratified_split_w4": f"""
        SELECT doc_id, lang AS label, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS part
        FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
                     ORDER BY md5('{fixed.RANDOM_SEED}:' || doc_id), doc_id) AS place
              FROM documents)
        JOIN ({QUOTAS.format(label="lang", source="documents")}) q ON q.label = lang""",
    "weighted_union_u1": f"""
        SELECT doc_id, lang, source, 0::INTEGER AS copy FROM documents WHERE lang = 'en'
        UNION ALL
        SELECT doc_id, lang, source, unnest(range(1, {fixed.INTENT_WEIGHT} + 1))::INTEGER
        FROM documents WHERE lang <> 'en'""",
    "terms_m1": f"""
        WITH {TERMS}
        SELECT doc_id, len(t)::BIGINT AS n_tokens, len(terms)::BIGINT AS n_terms,
               len(list_distinct(terms))::BIGINT AS n_distinct, list_max(terms) AS last_term
        FROM lists""",
    "document_frequency_m2_m3": f"""
        WITH {TERMS}
        SELECT df, round(idf, 6) AS idf, count(*) AS n_terms, min(term) AS first_term
        FROM idf GROUP BY ALL""",
    "tfidf_weights_m4_m5": f"""
        WITH {TERMS},
        raw AS (SELECT doc_id, tf, (1 + ln(tf)) * idf AS r FROM tf JOIN idf USING (term)),
        w AS (SELECT doc_id, tf, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)
        SELECT doc_id, count(*) AS n_terms, max(tf)::BIGINT AS largest_tf,
               round(sum(w), 6) AS total, round(max(w), 6) AS largest,
               round(sum(w * w), 6) AS squared_length
        FROM w GROUP BY doc_id""",
    "fit_and_predict_m7_m8": PREDICTED_ROLES,
    "fitted_probabilities_m7_m9": ROLE_PROBABILITIES,
    "training_experiment_m10": experiment(QUOTAS),
    "class_probabilities_m9": """
        SELECT count(*) AS n_rows, 0::BIGINT AS n_bad_totals, 0::BIGINT AS n_bad_orders
        FROM conversations""",
    "model_round_trip_s8": """
        SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM conversations""",
    "evaluation_sink_s9": """
        WITH rated AS (SELECT CASE WHEN lang = 'en' THEN 'botocore' ELSE 'intents' END AS test_set
                       FROM documents JOIN labels USING (doc_id))
        SELECT variant, test_set, ceil(0.2 * count(*))::BIGINT AS n_rows, 4::BIGINT AS n_cells
        FROM rated CROSS JOIN (SELECT unnest(['pre_intents', 'post_intents']) AS variant)
        GROUP BY ALL""",
    "embed_chunks_v1_v3": f"""
        WITH {STORE}
        SELECT source, chunk_number, md5(text) AS text_md5,
               len(list_filter(v, lambda x: x > 0))::INTEGER AS n_slots, round(norm, 6) AS norm,
               round(list_dot_product(v, list_transform(range(1, {DIMENSIONS} + 1),
                                                        lambda i: i::DOUBLE)), 6) AS checksum
        FROM store""",
    "custom_encoder_v1": """
        SELECT conv_id, turn, round((a / n)::FLOAT::DOUBLE, 4) AS a,
               round((e / n)::FLOAT::DOUBLE, 4) AS e, round((i / n)::FLOAT::DOUBLE, 4) AS i,
               round((o / n)::FLOAT::DOUBLE, 4) AS o, round((u / n)::FLOAT::DOUBLE, 4) AS u
        FROM (SELECT *, CASE WHEN a+e+i+o+u > 0 THEN sqrt((a*a + e*e + i*i + o*o + u*u)::DOUBLE) ELSE 1 END AS n
              FROM (SELECT conv_id, turn,
                           length(text) - length(replace(text, 'a', '')) AS a,
                           length(text) - length(replace(text, 'e', '')) AS e,
                           length(text) - length(replace(text, 'i', '')) AS i,
                           length(text) - length(replace(text, 'o', '')) AS o,
                           length(text) - length(replace(text, 'u', '')) AS u
                    FROM conversations))""",
    "unit_length_v2": f"""
        WITH {SCALED},
        u AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS u
              FROM sized)
        SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(u[1], 6) AS first,
               round(u[-1], 6) AS last FROM u""",
    "cosine_similarity_v4": f"""
        WITH {SCALED}
        SELECT a.vec_id, CASE WHEN a.n > 0 AND b.n > 0
                              THEN round(list_cosine_similarity(a.v, b.v), 6) ELSE 0 END AS similarity
        FROM sized a JOIN sized b ON b.vec_id = a.vec_id + 1""",
    "top_matches_v5_w2": NEAREST,
    "top_matches_grid_v5_j2": NEAREST,
    "top_matches_index_v5_j2": NEAREST,
    "indexed_chunks_v5": f"""
        WITH {BENCHMARK}, {STORE}, {matches("asked")}
        SELECT request_id, rank::INTEGER AS rank, source, chunk_number, round(sim, 6) AS similarity
        FROM best""",
    "empty_store_f8": """
        SELECT item_id AS request_id, 1::INTEGER AS rank, item_id AS source,
               1::INTEGER AS chunk_number, text, 0.0::DOUBLE AS similarity
        FROM benchmark WHERE false""",
    "retrieve_chunks_v5": f"""
        WITH {BENCHMARK}, {STORE}, {matches("asked")}
        SELECT request_id, rank::INTEGER AS rank, source, chunk_number, text,
               round(sim, 6) AS similarity
        FROM best""",
    "context_p13_a10": f"""
        WITH {BENCHMARK}, {STORE}, {matches("asked")},
        c AS (SELECT request_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS context,
                     count(*) AS n FROM best GROUP BY 1)
        SELECT request_id, context, n::INTEGER AS n_chunks,
               length(context)::INTEGER AS n_characters,
               substr(context, 1, {fixed.CONTEXT_PREVIEW}) AS preview
        FROM c""",
    "answer_requests_q1_j3": ANSWER_DIGEST,
    "answer_stream_q2": ANSWER_DIGEST,
    "answer_requests_trained_q1": TRAINED_DIGEST,
    "answer_requests_model_q1": TRAINED_DIGEST,
    "interaction_log_s10": f"""
        WITH {ANSWERED},
        kinds AS (
          SELECT status, 'WARNING' AS level, 'outcome' AS kind, 1 AS k FROM answered
          WHERE status = '{fixed.REJECTED}'
          UNION ALL SELECT status, 'INFO', 'outcome', 1 FROM answered WHERE status <> '{fixed.REJECTED}'
          UNION ALL SELECT status, 'DEBUG', 'predictions', 1 FROM answered WHERE status <> '{fixed.REJECTED}'
          UNION ALL SELECT status, 'DEBUG', 'chunk', n_chunks FROM answered WHERE n_chunks > 0
          UNION ALL SELECT status, 'INFO', 'context', 1 FROM answered WHERE status = '{fixed.COMPLETED}'
          UNION ALL SELECT status, 'DEBUG', 'preview', 1 FROM answered WHERE status = '{fixed.COMPLETED}')
        SELECT '2024-05-06 07:08:09' AS logged_at, level, kind, status, sum(k)::BIGINT AS n
        FROM kinds GROUP BY ALL""",
}
