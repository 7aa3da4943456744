"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

from cubeloom.llm.url_filter import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos FROM win JOIN least USING (k) WHERE f < doc_id),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS text, count(*) AS n FROM tok t LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.pos = t.pos WHERE c.pos IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCHMARK_INDEX = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

LINE_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(concat('=', source), '') AS host, {_WORDS} AS w FROM documents),
ln AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lw GROUP BY 1),
sizes AS (SELECT host, count(*) AS host_docs FROM d GROUP BY 1),
common AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM lw GROUP BY 1, 2) JOIN sizes USING (host) WHERE n >= 20 AND n > 0.05 * host_docs),
gone AS (SELECT doc_id, sum(n) AS removed FROM lw JOIN common USING (host, norm) GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n_rep FROM (SELECT doc_id, unnest(generate_series(i, i + 2)) AS pos FROM twice) GROUP BY 1),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
 coalesce(n_rep, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(removed_words AS BIGINT) AS removed_words,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept FROM f"""

JACCARD_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
edge AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 90 * (p.n + q.n - both_)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""



def _smoothed(bad: str, labelled: str) -> str:
    return f"(({bad}) + 10.0 * prior) / (({labelled}) + 10.0)"


def _contrast(bad: str, labelled: str, all_bad: str, all_labelled: str) -> str:
    part, rest = _smoothed(bad, labelled), _smoothed(f"{all_bad} - {bad}", f"{all_labelled} - {labelled}")
    n, m = f"({labelled} + 10.0)", f"({all_labelled} - {labelled} + 10.0)"
    pooled = f"(({part} * {n} + {rest} * {m}) / ({n} + {m}))"
    return f"(({part} - {rest}) / sqrt(greatest({pooled} * (1 - {pooled}), 1e-9) * (1 / {n} + 1 / {m})))"


#: Levels that the SQL writes out; no path of the tables has more segments.
URL_LEVELS = 6


def url_templates() -> str:
    """The walk of the path-template tree, level by level."""
    sums = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(labelled) AS BIGINT) AS labelled"
    rest = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
    sql = rf"""WITH p AS (SELECT page_id, translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
 regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pages),
marks AS (SELECT doc_id AS page_id, count(*) AS labelled, count(*) FILTER (quality = 0) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY 1),
urls AS (SELECT host, path, count(*) AS n, sum(coalesce(bad, 0)) AS bad, sum(coalesce(labelled, 0)) AS labelled FROM p LEFT JOIN marks USING (page_id) GROUP BY 1, 2),
pr AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(labelled), 0), 0.0) AS prior FROM urls),
t1 AS (SELECT host, path, n, bad, labelled, string_split(path, '/') AS seg, '' AS parent, '' AS template FROM urls)"""
    for k in range(1, URL_LEVELS + 1):
        sql += rf""",
n{k} AS (SELECT host, template, {sums} FROM t{k} WHERE len(seg) > {k} GROUP BY 1, 2),
c{k} AS (SELECT host, template, seg[{k + 1}] AS s, {sums} FROM t{k} WHERE len(seg) > {k} GROUP BY 1, 2, 3),
l{k} AS (SELECT c.host, c.template, c.s FROM c{k} c JOIN n{k} a USING (host, template), pr WHERE c.n >= 20 AND (c.n >= 0.05 * a.n OR abs({_contrast("c.bad", "c.labelled", "a.bad", "a.labelled")}) > 1.96)),
t{k + 1} AS (SELECT t.host, path, n, bad, labelled, seg, CASE WHEN len(seg) > {k} THEN t.template ELSE parent END AS parent,
 CASE WHEN len(seg) <= {k} THEN t.template WHEN l.s IS NULL THEN t.template || '/*' ELSE t.template || '/=' || l.s END AS template
 FROM t{k} t LEFT JOIN l{k} l ON l.host = t.host AND l.template = t.template AND l.s = seg[{k + 1}] AND len(seg) > {k})"""
    fits = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{x}') THEN '{{}}'" for _, h, x in fits)
    name = case.format(*(h + x for _, h, x in fits))
    verdict = case.format(*(v for v, _, _ in fits))
    return (
        sql
        + f""",
leaf AS (SELECT host, parent, template, sum(bad) AS bad, sum(labelled) AS labelled FROM t{URL_LEVELS + 1} GROUP BY 1, 2, 3),
fam AS (SELECT host, parent, sum(bad) AS all_bad, sum(labelled) AS all_labelled FROM leaf GROUP BY 1, 2),
br AS (SELECT host, parent, template, bad, labelled, CASE WHEN abs({_contrast("bad", "labelled", "all_bad", "all_labelled")}) > 1.96 THEN floor(10 * {_smoothed("bad", "labelled")}) ELSE -1 END AS branch FROM leaf JOIN fam USING (host, parent), pr),
pool AS (SELECT host, parent, branch, {_smoothed("sum(bad)", "sum(labelled)")} AS share FROM br, pr GROUP BY 1, 2, 3, prior),
bad_urls AS (SELECT t.host, t.path FROM t{URL_LEVELS + 1} t JOIN br ON br.host = t.host AND br.parent = t.parent AND br.template = t.template JOIN pool ON pool.host = br.host AND pool.parent = br.parent AND pool.branch = br.branch WHERE share >= 0.5)
SELECT page_id, p.host, p.path, CASE {name.replace("host", "p.host").replace("path", "p.path")} END AS rule,
 CASE {verdict.replace("host", "p.host").replace("path", "p.path")} WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN bad_urls b ON b.host = p.host AND b.path = p.path"""
    )


ORACLES = {
    "op5_url_templates": url_templates(),
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op6_benchmark_index": BENCHMARK_INDEX,
    "op7_line_rules": LINE_RULES,
    "op8_jaccard_join": JACCARD_JOIN,
}


def _codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Weighted Lloyd as SQL: a pair of tables (nearest entries, means) for each round."""

    def nearest(book: str) -> str:
        apart = "list_sum(list_transform(list_zip(u.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"SELECT u.p, u.part, u.n, arg_min(b.k, ({apart}, b.k)) AS k, min({apart}) AS error FROM u JOIN {book} b USING (p) GROUP BY 1, 2, 3"

    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({nearest(f'book{r}')})")
        total, many = "sum(part[i] * n)", "sum(n)"
        mean = f"({total} - ({total} % {many} + {many}) % {many}) // {many}"  # the floor of the quotient
        total = f"SELECT p, k, i, CAST({mean} AS BIGINT) AS x FROM near{r}, generate_series(1, len(part)) AS g(i) GROUP BY 1, 2, 3"
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN (SELECT p, k, list(x ORDER BY i) AS part FROM ({total}) GROUP BY 1, 2) m USING (p, k))")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 cut AS MATERIALIZED (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS part FROM kept, range({parts}) AS r(p)),
 u AS MATERIALIZED (SELECT p, part, count(*) AS n FROM cut GROUP BY 1, 2),
 book0 AS MATERIALIZED (SELECT p, k, part FROM (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS k FROM kept WHERE vec_id IS NOT NULL) JOIN cut USING (row) WHERE k < {entries}),
 {", ".join(steps)},
 coded AS MATERIALIZED ({nearest(f"book{rounds}")}),
 codes AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM cut JOIN coded USING (p, part) GROUP BY row),
 books AS (SELECT sha256(string_agg(x, ',' ORDER BY p, k)) AS codebooks_sha256 FROM (SELECT p, k, array_to_string(part, ',') AS x FROM book{rounds}))
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (row) CROSS JOIN books"""


ORACLES["op12_vector_codes"] = _codes_sql()
