"""The queries that SQL can express, as DuckDB SQL.

HTML, MinHash, spans, packing, sharding by propagation, archives and the index need parsers, models or iteration; their
tests hold them against brute-force versions instead.
"""

from __future__ import annotations

from tsquorum.llm import quality

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS lim FROM s),
r AS (SELECT *, row_number() OVER o AS place, sum(source_size) OVER ()::DOUBLE AS total, coalesce(sum(lim) OVER (ORDER BY lim / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY lim / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM w WINDOW o AS (ORDER BY lim / w, source IS NULL, encode(source))),
l AS (SELECT arg_min((total - capped) / opened, place) AS level FROM r WHERE lim >= w * (total - capped) / opened),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN round(least(lim, w * coalesce((SELECT level FROM l), 'inf'::DOUBLE)), 6) ELSE 0.0 END::DOUBLE AS target FROM r),
p AS (SELECT d.doc_id, d.source, d.k, d.size::BIGINT AS size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT p.*, seed, (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(seed || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p, range(17, 33) AS r(seed)),
b AS (SELECT source, arg_min(seed, {'off': abs(sums - target), 'seed': seed}) AS seed FROM (SELECT source, seed, sum(taken) AS sums, any_value(target) AS target FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, size, source_size, target, taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.seed = b.seed
"""


NEGATIVES = r"""
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, o.uid AS other, o.vec_id AS id, o.label = a.label AS same, list_dot_product(a.e, o.e)::BIGINT AS score FROM v a JOIN v o ON a.vec_id % 100 = 0 AND len(a.e) = len(o.e) AND a.uid <> o.uid),
p AS (SELECT uid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.uid, place ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (uid, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10
"""


def _quality() -> str:
    """The rules' table as rows, and the binomial tail by logarithms of the gamma function."""
    grid = ", ".join(f"('{rule}', {i}, {cut})" for rule, _, cuts in quality.RULES for i, cut in enumerate(cuts))
    signals = ", ".join(f"({signal})::DOUBLE AS {rule}" for rule, signal, _ in quality.RULES)
    value = "CASE rule " + " ".join(f"WHEN '{rule}' THEN {rule}" for rule, _, _ in quality.RULES) + " END"
    failed = " OR ".join(f"coalesce({rule} > (SELECT cutoff FROM best b WHERE b.stratum = s.stratum AND b.rule = '{rule}'), false)" for rule, _, _ in quality.RULES)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, words[i:i + 7] AS g FROM w, unnest(generate_series(1, len(words) - 7)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(coalesce(nxt - i, 8), 8))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY 1),
lines AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {signals} FROM m),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, place, cutoff)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
k AS (SELECT stratum, rule, place, cutoff, count(*) AS n, count(*) FILTER (WHERE {value} > cutoff) AS k FROM held, grid GROUP BY 1, 2, 3, 4),
tail AS (SELECT *, k < n * 0.02 AND list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.1 / ((SELECT count(DISTINCT stratum) FROM held) * {len(quality.RULES)}) AS passed FROM k),
best AS (SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM tail t WHERE NOT EXISTS (SELECT 1 FROM tail f WHERE f.stratum = t.stratum AND f.rule = t.rule AND NOT f.passed AND f.place <= t.place) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({failed}) AS kept FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": MIX.strip(), "op9_quality": _quality().strip(), "op12_negatives": NEGATIVES.strip()}
