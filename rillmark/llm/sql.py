"""Three of the operators as DuckDB SQL over the same tables: their methods' results without their methods' shortcuts."""

from __future__ import annotations

from rillmark.llm.mixing import BLOCK, GOLDEN, LEAST_BLOCKS, MOST, SHARE, WEIGHTS
from rillmark.llm.url_filter import LOST, ORDER, RULES, STRENGTH

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document joined with every window of every item, by text.
DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT r, dw.m, k, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN its ON d.r = its.r"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
#: The whole schedule, slot by slot.
MIXING = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h, row_number() OVER () AS r FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE (nth - 1) % {len(WEIGHTS)} {_WEIGHT} END AS weight FROM p),
c AS (SELECT *, ({SHARE} * sum(s) OVER () - coalesce(sum({MOST} * s) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS per FROM w WINDOW b AS (ORDER BY {MOST} * s / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(per * weight > {MOST} * s) OVER (ORDER BY {MOST} * s / weight, nth) AS full_ FROM c),
t AS (SELECT source, nth, s, CASE WHEN full_ THEN {MOST} * s ELSE coalesce((SELECT per FROM f AS g WHERE NOT full_ ORDER BY {MOST} * s / weight, nth LIMIT 1), 0) * weight END AS target, greatest((s + {BLOCK - 1}) // {BLOCK}, least(s, {LEAST_BLOCKS})) AS n FROM f),
g AS (SELECT *, CASE WHEN s > 0 THEN target * n / s ELSE 0 END AS wanted FROM t),
e AS (SELECT *, sum(wanted) OVER (ORDER BY nth) AS upto, sum(wanted) OVER () AS total FROM g),
cut AS (SELECT *, CASE WHEN nth = max(nth) OVER () THEN 18446744073709551616::HUGEINT ELSE CAST(floor(upto / total * 18446744073709551616.0) AS HUGEINT) END AS stop FROM e),
iv AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY nth), 0) AS begin_ FROM cut),
slots AS (SELECT range AS t, (range::HUGEINT * {GOLDEN}::HUGEINT) % 18446744073709551616::HUGEINT AS point FROM range((SELECT CAST(ceil(max(total)) AS BIGINT) FROM e))),
ranked AS (SELECT nth, n, row_number() OVER (PARTITION BY nth ORDER BY t) - 1 AS rank FROM slots JOIN iv ON point >= begin_ AND point < stop),
times AS (SELECT nth, rank % n AS block, count(*) AS times FROM ranked WHERE rank < 2 * n GROUP BY ALL),
pl AS (SELECT d.*, nth, s, n, target, CAST(sum(size) OVER (PARTITION BY nth ORDER BY h, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
tb AS (SELECT r, nth, s, n, start, size, unnest(range(((start + 1) * n - 1) // s, ((start + size) * n - 1) // s + 1)) AS block FROM pl WHERE size > 0),
got AS (SELECT r, sum((least(start + size, (tb.block + 1) * s // n) - greatest(start, tb.block * s // n)) * times) AS taken FROM tb JOIN times ON tb.nth = times.nth AND tb.block = times.block GROUP BY r)
SELECT doc_id, size, s AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM pl LEFT JOIN got ON pl.r = got.r"""

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
_P = ["(coalesce(n1.good, 0) + 1) / ((SELECT cg FROM c WHERE k = 1) + 256.0e0)", "(coalesce(n1.bad, 0) + 1) / ((SELECT cb FROM c WHERE k = 1) + 256.0e0)"]
for _k in range(2, ORDER + 1):
    _P = [f"((coalesce(n{_k}.{n}, 0) + {STRENGTH} * {p}) / (coalesce(c{_k}.{c}, 0) + {STRENGTH}))" for p, n, c in zip(_P, ("good", "bad"), ("cg", "cb"))]
_JOINS = " ".join(f"LEFT JOIN n AS n{k} ON n{k}.gram = right(x.gram, {k}) AND n{k}.k = {k}" + (f" LEFT JOIN c AS c{k} ON c{k}.context = left(right(x.gram, {k}), {k - 1}) AND c{k}.k = {k}" if k > 1 else "") for k in range(1, ORDER + 1))
#: Both models counted and applied window by window.
URL_FILTER = f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, rest, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(ruling, rule, rh, rp) AS (VALUES {_RULES}),
b AS MATERIALIZED (SELECT page_id, row_number() OVER () AS r, host, path, CASE WHEN instr(url, '://') > 0 THEN host || substr(rest, length(host) + 1) ELSE coalesce(url, '') END AS t,
 (SELECT {{'rule': rule, 'ruling': ruling}} FROM rules WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC, rule DESC LIMIT 1) AS x FROM hp),
q AS (SELECT t, count(*) FILTER (x.ruling = 'allow') AS g, count(*) FILTER (x.ruling = 'block') AS b, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 5 = 0 AS spare FROM b WHERE x IS NOT NULL GROUP BY t),
sg AS (SELECT substr(repeat(chr(2), {ORDER - 1}) || t, i, {ORDER}) AS gram, g, b FROM (SELECT t, g, b, unnest(range(1, length(t) + 1)) AS i FROM q WHERE NOT spare)),
n AS MATERIALIZED (SELECT right(gram, k) AS gram, k, sum(g) AS good, sum(b) AS bad FROM sg, (SELECT unnest(range(1, {ORDER + 1})) AS k) GROUP BY ALL),
c AS MATERIALIZED (SELECT left(gram, CAST(k - 1 AS INTEGER)) AS context, k, sum(good) AS cg, sum(bad) AS cb FROM n GROUP BY ALL),
a AS (SELECT DISTINCT t FROM b WHERE x IS NULL UNION SELECT t FROM q WHERE spare AND g > 0),
xs AS (SELECT t, substr(repeat(chr(2), {ORDER - 1}) || t, i, {ORDER}) AS gram FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM a)),
x AS MATERIALIZED (SELECT DISTINCT gram FROM xs),
l AS MATERIALIZED (SELECT x.gram, round((ln({_P[0]}) - ln({_P[1]})) * 1000000000.0e0) AS units FROM x {_JOINS}),
s AS MATERIALIZED (SELECT a.t, coalesce(sum(units), 0) / 1000000000.0e0 / greatest(length(a.t), 1) AS score FROM a LEFT JOIN xs ON a.t = xs.t LEFT JOIN l ON l.gram = xs.gram GROUP BY a.t),
th AS (SELECT coalesce(min(score), 0) AS least FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS m FROM s JOIN q ON s.t = q.t WHERE spare AND g > 0) WHERE i >= {LOST} * m)
SELECT page_id, host, path, x.rule AS rule, CASE WHEN x IS NOT NULL THEN x.ruling WHEN score >= least THEN 'allow' ELSE 'block' END AS verdict FROM b LEFT JOIN s ON b.t = s.t AND x IS NULL CROSS JOIN th"""
