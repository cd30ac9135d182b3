"""SQL of the trained classifier: the optimum of the same objective, found in another way."""

from __future__ import annotations

from textloom import fixed

# Accelerated gradient steps of the fit; at 500 rows the coefficients settle well before.
STEPS = 700


def fitted(rows: str, n_labels: int, name: str = "") -> str:
    """CTEs ending in ``{name}margins (i, m)`` for every row of ``rows``.

    ``rows`` is a table expression with ``i`` (dense from 1), ``text``, ``target`` (from 1; null for
    rows that are scored only) and ``copies`` (how often a row counts). The optimum of the weighted
    log-loss plus half the squared coefficients lies in the span of the rows, so the steps run on one
    number per row and label, over the rows' products with one another.
    """
    p, binary = name, n_labels == 2
    scores = range(1 if binary else n_labels)

    def each(template: str) -> str:
        return ", ".join(template.format(k=k) for k in scores)

    if binary:
        share = "1 / (1 + exp(-(m0[i])))"
        pulls = f"list_transform(ii, lambda i: w[i] * ({share} - (t[i] - 1))) AS g0"
    else:
        top = "greatest(" + ", ".join(f"m{k}[i]" for k in scores) + ")"
        total = " + ".join(f"exp(m{k}[i] - {top})" for k in scores)
        pulls = ", ".join(
            f"list_transform(ii, lambda i: w[i] * (exp(m{k}[i] - {top}) / ({total}) - CASE WHEN t[i] = {k + 1} THEN 1 ELSE 0 END)) AS g{k}"
            for k in scores
        )
    bend = 0.25 if binary else 0.5
    return f"""
  {p}rows AS MATERIALIZED ({rows}),
  {p}tf AS (SELECT i, term, count(*) AS tf FROM (
      SELECT i, unnest(list_concat(t, list_transform(range(1, len(t)), lambda j: t[j] || ' ' || t[j + 1]))) AS term
      FROM (SELECT i, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM {p}rows)) GROUP BY ALL),
  {p}n AS (SELECT sum(copies) AS n FROM {p}rows WHERE target IS NOT NULL),
  {p}idf AS (SELECT term, ln((1 + (SELECT n FROM {p}n)) / (1 + sum(copies))) + 1 AS idf
             FROM {p}tf JOIN {p}rows USING (i) WHERE target IS NOT NULL GROUP BY term),
  {p}x AS MATERIALIZED (SELECT i, term, r / sqrt(sum(r * r) OVER (PARTITION BY i)) AS x
             FROM (SELECT i, term, (1 + ln(tf)) * idf AS r FROM {p}tf JOIN {p}idf USING (term))),
  {p}products AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS k FROM {p}x a JOIN {p}x b USING (term)
                  JOIN {p}rows r ON r.i = b.i WHERE r.target IS NOT NULL GROUP BY ALL),
  {p}kernel AS MATERIALIZED (
      SELECT a.i, list(coalesce(k, 0) ORDER BY b.i) AS k
      FROM {p}rows a CROSS JOIN (SELECT i FROM {p}rows WHERE target IS NOT NULL) b
      LEFT JOIN {p}products q ON q.i = a.i AND q.j = b.i GROUP BY a.i),
  {p}weights AS (SELECT target, (SELECT n FROM {p}n) / ({n_labels} * sum(copies)) AS w
                 FROM {p}rows WHERE target IS NOT NULL GROUP BY target),
  {p}given AS MATERIALIZED (
      SELECT list(k ORDER BY i) AS kk, list(target ORDER BY i) AS t, list(w * copies ORDER BY i) AS w, range(1, count(*) + 1) AS ii,
             1 / (1 + {bend} * max(w * copies) * max(list_sum(k) + len(k))) AS eta
      FROM {p}rows JOIN {p}kernel USING (i) JOIN {p}weights USING (target)),
  {p}steps AS (
      SELECT 0 AS step, {each("list_transform(ii, lambda i: 0.0::DOUBLE) AS a{k}, list_transform(ii, lambda i: 0.0::DOUBLE) AS y{k}, 0.0::DOUBLE AS b{k}, 0.0::DOUBLE AS c{k}")}
      FROM {p}given
      UNION ALL
      SELECT step + 1, {each("n{k}, list_transform(ii, lambda i: n{k}[i] + mu * (n{k}[i] - a{k}[i])), d{k}, d{k} + mu * (d{k} - b{k})")}
      FROM (SELECT step, ii, (1 - sqrt(eta)) / (1 + sqrt(eta)) AS mu, {each("a{k}, b{k}, list_transform(ii, lambda i: y{k}[i] - eta * (g{k}[i] + y{k}[i])) AS n{k}, c{k} - eta * list_sum(g{k}) AS d{k}")}
            FROM (SELECT *, {pulls}
                  FROM (SELECT *, {each("list_transform(ii, lambda i: list_dot_product(kk[i], y{k}) + c{k}) AS m{k}")}
                        FROM {p}steps, {p}given WHERE step < {STEPS})))),
  {p}margins AS (SELECT i, [{each("list_dot_product(k, a{k}) + b{k}")}] AS m
                 FROM {p}kernel, (SELECT * FROM {p}steps WHERE step = {STEPS}))"""


_ROLE_ROWS = """SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, concat_ws(':', conv_id, turn) AS id, text, role AS label,
              dense_rank() OVER (ORDER BY role) AS target, 1 AS copies FROM conversations"""
ROLES = fitted(_ROLE_ROWS, 3)

# CTEs ending in ``fitted_roles (id, e, names)``: shares of the labels by request.
TRAINED_ROLES = f"""{fitted(_ROLE_ROWS, 3, "fit_")},
    fitted_roles AS (
      SELECT id, list_transform(m, lambda x: exp(x - list_max(m))) AS e,
             (SELECT list(label ORDER BY label) FROM (SELECT DISTINCT label FROM fit_rows)) AS names
      FROM fit_rows JOIN fit_margins USING (i))"""

PREDICTED_ROLES = f"""
    WITH RECURSIVE {ROLES},
    names AS (SELECT DISTINCT target, label FROM rows)
    SELECT id, label, (SELECT n.label FROM names n WHERE n.target = list_position(m, list_max(m))) AS predicted
    FROM rows JOIN margins USING (i)"""

ROLE_PROBABILITIES = f"""
    WITH RECURSIVE {ROLES},
    p AS (SELECT target, label, list_transform(m, lambda x: exp(x - list_max(m))) AS e FROM rows JOIN margins USING (i))
    SELECT label, count(*) AS n_rows, round(avg(e[target] / list_sum(e)), 5) AS mean_probability,
           round(min(e[target] / list_sum(e)), 4) AS least_probability
    FROM p GROUP BY label"""


def experiment(quotas: str) -> str:
    """Both variants of the training experiment over the rated documents."""
    base, extra = fixed.BASE_TEST_SET, fixed.EXTRA_TEST_SET

    def rows(variant: str) -> str:
        weight = f"CASE test_set WHEN '{base}' THEN 1 ELSE {fixed.INTENT_WEIGHT if variant == 'post' else 0} END"
        return f"""SELECT row_number() OVER (ORDER BY test_set, doc_id) AS i, text, label, test_set,
                          CASE WHEN place > quota THEN copies END AS copies,
                          CASE WHEN place > quota THEN label::INTEGER + 1 END AS target
                   FROM (SELECT *, {weight} AS copies FROM placed) WHERE place <= quota OR copies > 0"""

    def scored(variant: str, name: str) -> str:
        return f"""SELECT '{name}' AS variant, test_set, label AS actual, CASE WHEN m[1] > 0 THEN '1' ELSE '0' END AS predicted
                   FROM {variant}rows JOIN {variant}margins USING (i) WHERE target IS NULL"""

    sets = " UNION ALL ".join(
        f"SELECT '{name}' AS test_set, * FROM ({quotas.format(label='label', source=f'(SELECT * FROM rated WHERE test_set = {name!r})')})"
        for name in (base, extra)
    )
    return f"""
    WITH RECURSIVE rated AS (
        SELECT doc_id, text, quality::VARCHAR AS label, CASE WHEN lang = 'en' THEN '{base}' ELSE '{extra}' END AS test_set
        FROM documents JOIN labels USING (doc_id)),
    quotas AS ({sets}),
    placed AS MATERIALIZED (
        SELECT r.*, quota, row_number() OVER (PARTITION BY r.test_set, r.label
                                              ORDER BY md5('{fixed.RANDOM_SEED}:' || doc_id), doc_id) AS place
        FROM rated r JOIN quotas q ON q.test_set = r.test_set AND q.label = r.label),
    {fitted(rows("pre"), 2, "pre")},
    {fitted(rows("post"), 2, "post")},
    e AS ({scored("pre", fixed.BASE_ONLY)} UNION ALL {scored("post", fixed.WITH_EXTRA)}),
    l AS (SELECT DISTINCT variant, test_set, label
          FROM (SELECT variant, test_set, unnest([actual, predicted]) AS label FROM e)),
    c AS (SELECT variant, test_set, label, count(*) FILTER (WHERE actual = label) AS support,
                 count(*) FILTER (WHERE predicted = label) AS claimed,
                 count(*) FILTER (WHERE actual = label AND predicted = label) AS hits
          FROM l JOIN e USING (variant, test_set) GROUP BY ALL)
    SELECT variant, test_set, round(sum(hits) / sum(support), 6) AS accuracy,
           round(avg(CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END), 6) AS precision,
           round(avg(CASE WHEN support > 0 THEN hits / support ELSE 0 END), 6) AS recall,
           round(avg(2 * hits / (support + claimed)), 6) AS f1_score
    FROM c GROUP BY ALL"""
