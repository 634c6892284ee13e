"""DuckDB SQL for the queries of tessera.queries, by name. Queries without SQL are held against brute force in the tests."""

from __future__ import annotations

_T = "epoch_us(ts) / 1e6"
_LONG = """WITH long AS (
  SELECT 'l_quantity' AS feature, l_returnflag AS label, l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_returnflag, l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_discount', l_returnflag, l_discount FROM lineitem)"""
_CONFUSION = """WITH pred AS (SELECT CAST(l_linenumber AS BIGINT) AS truth, CAST(floor(l_quantity) AS BIGINT) % 7 + 1 AS guess FROM lineitem),
labels AS (SELECT truth AS l FROM pred UNION SELECT guess FROM pred),
conf AS (SELECT a.l AS truth, b.l AS guess, count(p.truth) AS n FROM labels a CROSS JOIN labels b LEFT JOIN pred p ON p.truth = a.l AND p.guess = b.l GROUP BY 1, 2)"""
_SCORED = "WITH s AS (SELECT CAST(n_chars AS DOUBLE) AS x, quality = 1 AS pos FROM labels JOIN documents USING (doc_id))"
_TWO = "WITH s AS (SELECT value AS x, event_type = 'click' AS pos FROM events WHERE event_type IN ('click', 'purchase'))"
_TABLE = """, v AS (SELECT x, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b FROM s WHERE x IS NOT NULL GROUP BY x),
t AS (SELECT x, a, b, coalesce(sum(a) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a_below,
  coalesce(sum(b) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_below, sum(a) OVER () AS n_a, sum(b) OVER () AS n_b FROM v)"""
_GRID = """WITH g AS (SELECT f.f AS l_returnflag, s.s AS l_linestatus, n.n AS l_linenumber FROM (VALUES ('A'), ('N'), ('R')) f(f) CROSS JOIN (VALUES ('F'), ('O'), ('X')) s(s) CROSS JOIN range(1, 8) n(n)),
cells AS (SELECT g.l_returnflag, g.l_linestatus, CAST(g.l_linenumber AS BIGINT) AS l_linenumber, count(l.l_orderkey) AS n FROM g LEFT JOIN lineitem l USING (l_returnflag, l_linestatus, l_linenumber) GROUP BY 1, 2, 3),
grid AS (SELECT *, CASE WHEN n >= 3000 THEN 'full' WHEN n > 0 THEN 'thin' ELSE 'empty' END AS state FROM cells)"""
_RATES = "SELECT l_suppkey, avg(CASE WHEN l_tax > 0.01 THEN CAST(l_discount < 0.05 AS INT) END) AS rate, count(CASE WHEN l_tax > 0.01 THEN 1 END) AS judged FROM lineitem GROUP BY 1"


def _nearest_mean(fold: str) -> str:
    return f"""WITH f AS (SELECT vec_id, label, embedding, {fold} AS fold FROM embeddings),
long AS (SELECT fold, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM f),
own AS (SELECT fold, label, i, sum(x) AS s, count(*) AS n FROM long GROUP BY ALL),
means AS (SELECT d.fold, w.label, list((w.S - coalesce(o.s, 0)) / (w.N - coalesce(o.n, 0)) ORDER BY w.i) AS m
  FROM (SELECT DISTINCT fold FROM f) d CROSS JOIN (SELECT label, i, sum(s) AS S, sum(n) AS N FROM own GROUP BY ALL) w
  LEFT JOIN own o ON o.fold = d.fold AND o.label = w.label AND o.i = w.i GROUP BY 1, 2),
best AS (SELECT f.vec_id, f.fold, f.label, min({{'d': list_distance(f.embedding::DOUBLE[], means.m), 'l': means.label}}).l AS guess FROM f JOIN means USING (fold) GROUP BY 1, 2, 3)
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, count(*) FILTER (label = guess) AS hits FROM best GROUP BY 1"""


_KNN = """WITH p AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, a.label AS la, b.label AS lb
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM p),
k AS (SELECT * FROM r WHERE rank <= 10)"""

ORACLES: dict[str, str] = {
    "dprime_pairs": _LONG
    + """, m AS (SELECT feature, label, count(x) AS n, avg(x) AS mean, coalesce(var_samp(x), 0) AS var FROM long GROUP BY 1, 2)
SELECT a.feature, a.label AS class_a, b.label AS class_b, a.n AS n_a, b.n AS n_b,
  round(CASE WHEN sqrt((a.var + b.var) / 2) >= 1e-12 THEN abs(b.mean - a.mean) / sqrt((a.var + b.var) / 2) END, 6) AS dprime,
  round(CASE WHEN sqrt((a.var + b.var) / 2) >= 1e-12 THEN (b.mean - a.mean) / sqrt((a.var + b.var) / 2) ELSE 0 END, 6) AS signed_dprime,
  round((b.mean - a.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 6) AS cohens_d
FROM m a JOIN m b ON a.feature = b.feature AND a.label < b.label""",
    "fisher_ratio": _LONG
    + """, m AS (SELECT feature, label, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM long GROUP BY 1, 2),
g AS (SELECT feature, avg(x) AS grand FROM long GROUP BY 1)
SELECT feature, round(sum(n * (mean - grand) ** 2) / sum((n - 1) * var) * 1e6, 4) AS fisher_ppm FROM m JOIN g USING (feature) GROUP BY 1""",
    "zscore_pop": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_p_retailprice FROM part",
    "class_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1",
    "fuse_left": "SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "fuse_one_to_one": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "duplicate_texts": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "semi_known": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_unseen": "SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "positional_zip": """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal FROM part), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS ordinal FROM part)
SELECT a.ordinal, a.p_partkey AS left_key, b.p_partkey AS right_key, a.p_partkey = b.p_partkey AS agrees FROM a JOIN b USING (ordinal)""",
    "ordinal_label_join": "SELECT conv_id, turn, CAST(coalesce([3, 5, 7, 9][turn + 1], -1) AS INTEGER) AS prompt FROM conversations",
    "asof_tempo": f"""WITH e AS (SELECT *, {_T} AS t FROM events), s AS (SELECT user_id, t, event_id, value FROM e WHERE event_type = 'signup')
SELECT p.event_id, s.event_id AS segment, s.value AS bpm FROM (SELECT * FROM e WHERE event_type <> 'signup') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t""",
    "cue_anchored_onset": f"""WITH e AS (SELECT *, {_T} AS t FROM events), m AS (SELECT c.event_id AS cue_id, c.t AS cue, p.t AS peak, row_number() OVER (PARTITION BY c.event_id ORDER BY p.value DESC NULLS LAST, p.t) AS rn
  FROM (SELECT * FROM e WHERE event_type = 'signup') c LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') p ON p.user_id = c.user_id AND p.t BETWEEN c.t - 21600 AND c.t + 64800)
SELECT cue_id, round(coalesce(peak, greatest(cue, 0)), 3) AS onset, peak IS NOT NULL AS found FROM m WHERE rn = 1""",
    "unseen_share": """WITH o AS (SELECT *, o_orderkey % 4 AS fold FROM orders), tr AS (SELECT DISTINCT fold, o_custkey FROM o WHERE o_orderstatus <> 'F')
SELECT o.fold, round(avg(CASE WHEN tr.o_custkey IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS unseen FROM o LEFT JOIN tr ON tr.fold = o.fold AND tr.o_custkey = o.o_custkey WHERE o_orderstatus = 'F' GROUP BY 1""",
    "class_pairs": "SELECT a.n_name AS class_a, b.n_name AS class_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "best_keyframe": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS error FROM customer ORDER BY coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 'inf'::DOUBLE), c_custkey LIMIT 1",
    "two_adapters": "SELECT s_nationkey, min(s_suppkey) AS first, CASE WHEN count(*) > 1 THEN max(s_suppkey) END AS second FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r <= 2 GROUP BY 1",
    "nearest_fret": """WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE * 0.4::DOUBLE AS x, p_size / 50.0::DOUBLE AS y FROM part),
c AS (SELECT *, n, 1 - 2.0::DOUBLE ** (-n / 12.0::DOUBLE) AS w, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(x - (1 - 2.0::DOUBLE ** (-n / 12.0::DOUBLE))), n) AS rn FROM p CROSS JOIN range(0, 8) r(n))
SELECT p_partkey, n AS fret, round(x - w, 6) AS d, CAST(least(6, greatest(1, 6 - round_even(y * 5, 0))) AS BIGINT) AS string FROM c WHERE rn = 1""",
    "pitch_to_string_fret": """WITH p AS (SELECT p_partkey, 69 + 12 * log2((p_retailprice - 800) / 440) AS midi FROM part WHERE p_retailprice > 800),
s AS (SELECT p.*, o.s, o.m, o.i, midi - m AS f FROM p CROSS JOIN (VALUES (6, 40, 0), (5, 45, 1), (4, 50, 2), (3, 55, 3), (2, 59, 4), (1, 64, 5)) o(s, m, i)),
b AS (SELECT p_partkey, min({'off': abs(f - round_even(f, 0)), 'i': i, 's': s, 'fret': round_even(f, 0)}) FILTER (round_even(f, 0) BETWEEN 0 AND 12) AS b FROM s GROUP BY 1)
SELECT q.p_partkey, round(midi, 6) AS midi, round((midi - round_even(midi, 0)) * 100, 4) AS cents, round(440 * 2.0::DOUBLE ** ((midi - 69) / 12), 6) AS back, CAST(b.b.s AS BIGINT) AS string, CAST(b.b.fret AS BIGINT) AS fret
FROM (SELECT part.p_partkey, p.midi FROM part LEFT JOIN p USING (p_partkey)) q LEFT JOIN b USING (p_partkey)""",
    "homography_project": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, 0.001 * p_size + 0.002 * p_retailprice / 100 + 1 AS w FROM part)
SELECT p_partkey, round((2 * x + 0.1 * y + 30) / w, 6) AS u, round((-0.2 * x + 1.5 * y + 10) / w, 6) AS v, CAST(0 AS DOUBLE) AS error FROM p""",
    "geometry_scalars": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 1000 AS r, p_size / 50.0::DOUBLE AS u FROM part), q AS (SELECT *, r - floor(r) AS v FROM p)
SELECT p_partkey, round(CASE WHEN s > 1e-9 AND sqrt(r * r + s * s) > 1e-9 THEN degrees(acos(least(1, greatest(-1, s * r / (s * sqrt(r * r + s * s)))))) END, 6) AS angle,
  round(degrees(atan2(s, r)), 6) AS direction, round(((s * 13 + 90) % 180) - 90, 6) AS wrapped,
  round(u * (1 - v) * 4 + u * v * 5, 6) AS qx, round(u * v * 3 + (1 - u) * v * 2, 6) AS qy, CAST(11 AS DOUBLE) AS area FROM q""",
    "note_envelope": """WITH p AS (SELECT p_partkey, 2.5::DOUBLE - p_size / 10.0::DOUBLE AS lead, p_size % 8 AS f FROM part)
SELECT p_partkey, round(CASE WHEN lead > 2.2 OR lead < -1.25 THEN 0 WHEN lead > 0 THEN (1 - lead / 2.2) ** 2 WHEN lead >= -1 THEN 1 + 0.5 * lead ELSE 0.5 * (1 + (lead + 1) / 0.25) END, 6) AS glow,
  round(CASE WHEN f > 0 THEN ((1 - 2.0::DOUBLE ** (-f / 12.0::DOUBLE)) + (1 - 2.0::DOUBLE ** (-(f - 1) / 12.0::DOUBLE))) / 2 ELSE 0 END / (1 - 2.0::DOUBLE ** (-7 / 12.0::DOUBLE)), 6) AS u FROM p""",
    "segment_spans": f"""WITH e AS (SELECT *, {_T} AS t FROM events)
SELECT event_id, row_number() OVER w - 1 AS k, round(greatest(coalesce(lead(t) OVER w, t + 60) - t, 0), 3) AS duration FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""",
    "onset_min_gap": f"""WITH RECURSIVE e AS (SELECT user_id, round({_T}, 3) AS t FROM events), kept AS (
  SELECT user_id, min(t) AS onset FROM e GROUP BY 1
  UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t - k.onset >= 86400) FROM kept k WHERE k.onset IS NOT NULL)
SELECT user_id, onset FROM kept WHERE onset IS NOT NULL""",
    "local_maxima": f"""WITH e AS (SELECT *, {_T} AS t FROM events), w AS (SELECT event_id, value, lag(value) OVER w AS l, lead(value) OVER w AS r, max(value) OVER (PARTITION BY user_id) AS top FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, value FROM w WHERE (l IS NULL OR value > l) AND (r IS NULL OR value >= r) AND value > 0.1 * top""",
    "moving_average": f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY {_T}, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events",
    "ticks_to_seconds": """WITH t AS (SELECT conv_id, turn * 960 AS tick, 60.0::DOUBLE + length(text) % 60 AS bpm FROM conversations),
l AS (SELECT *, coalesce((tick - lag(tick) OVER w) * 60.0::DOUBLE / (lag(bpm) OVER w * 960), 0) AS lasted FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY tick))
SELECT conv_id, tick, round(sum(lasted) OVER (PARTITION BY conv_id ORDER BY tick ROWS UNBOUNDED PRECEDING), 6) AS start_s FROM l""",
    "status_bands": """SELECT p_partkey, CASE WHEN nullif(p_size, 25) IS NULL THEN 'amber' WHEN p_size > 40 THEN 'red' WHEN p_size > 20 THEN 'amber' ELSE 'green' END AS high_bad,
  CASE WHEN p_retailprice < 920 THEN 'red' WHEN p_retailprice < 950 THEN 'amber' ELSE 'green' END AS low_bad FROM part""",
    "reject_status_counts": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT CASE WHEN k IS NULL THEN 'no_audio' WHEN value < 1 THEN 'silent' WHEN k < 5 THEN 'load_failed' WHEN event_type = 'error' THEN 'no_onsets' ELSE 'ok' END AS status, count(*) AS n FROM e GROUP BY 1""",
    "occlusion_reasons": """WITH r AS (SELECT concat_ws('|', CASE WHEN l_quantity > 45 THEN 'offboard' END, CASE WHEN l_discount >= 0.09 THEN 'deep' END, CASE WHEN l_tax < 0.01 THEN 'lowconf' END) AS reasons FROM lineitem)
SELECT reasons, reasons <> '' AS occluded, count(*) AS n FROM r GROUP BY 1""",
    "sentinel_parsing": r"""SELECT p_partkey, CAST(coalesce(CASE WHEN p_size % 5 = 0 THEN p_size END, try_cast(regexp_extract(concat_ws(' ', CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) END, p_name), '^\s*(-?\d+)(?:\s|$)', 1) AS INT), 0) AS BIGINT) AS s_num,
  regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9_.-]', '', 'g') AS safe, CAST(try_cast(substr(p_brand, 7, 9) AS INT) AS BIGINT) AS brand, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(p_size AS VARCHAR) END AS named FROM part""",
    "drop_missing": "SELECT p_type, count(*) AS n_rows, count(nullif(p_size, 7)) AS complete, count(*) FILTER (nullif(p_size, 7) BETWEEN 10 AND 40) AS in_range, count(*) FILTER (p_brand IN ('Brand#1', 'Brand#2')) AS chosen FROM part GROUP BY 1",
    "one_hot_relative": """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS "is_F", CAST(o_orderstatus = 'O' AS INT)::DOUBLE AS "is_O", CAST(o_orderstatus = 'P' AS INT)::DOUBLE AS "is_P",
  round((o_totalprice / 1e5 - 1) / sqrt((o_totalprice / 1e5) ** 2 + 1), 6) AS rel FROM orders WHERE o_orderstatus IS NOT NULL""",
    "pivot_grid": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
    "confusion_dense": _CONFUSION + " SELECT truth, guess, n FROM conf",
    "recall_by_class": _CONFUSION + " SELECT truth, CAST(sum(n) AS BIGINT) AS support, round(sum(CASE WHEN truth = guess THEN n ELSE 0 END) / nullif(sum(n), 0)::DOUBLE, 6) AS recall FROM conf GROUP BY 1",
    "error_structure": _CONFUSION
    + """, w AS (SELECT * FROM conf WHERE truth <> guess AND n > 0), top AS (SELECT * FROM w ORDER BY n DESC, truth, guess LIMIT 1)
SELECT (SELECT round(sum(CASE WHEN abs(truth - guess) = 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) FROM w) AS adjacent_share, truth AS worst_truth, guess AS worst_guess, n AS worst_n FROM top""",
    "information_transfer": _CONFUSION
    + """, t AS (SELECT sum(n)::DOUBLE AS t FROM conf), r AS (SELECT sum(n) AS n FROM conf GROUP BY truth), c AS (SELECT sum(n) AS n FROM conf GROUP BY guess)
SELECT round((SELECT -sum(n / t * log2(n / t)) FROM r, t WHERE n > 0) + (SELECT -sum(n / t * log2(n / t)) FROM c, t WHERE n > 0) - (SELECT -sum(n / t * log2(n / t)) FROM conf, t WHERE n > 0), 6) AS bits""",
    "masked_metrics": """WITH li AS (SELECT l_linenumber::DOUBLE AS t, (CAST(floor(l_quantity) AS BIGINT) % 7 + 1)::DOUBLE AS g, l_discount FROM lineitem),
m AS (SELECT 'all' AS mask, * FROM li UNION ALL SELECT 'visible', * FROM li WHERE l_discount < 0.05 UNION ALL SELECT 'occluded', * FROM li WHERE l_discount >= 0.05)
SELECT mask, model, count(*) AS n, round(avg(abs(t - p)), 6) AS mae, round(avg((t = p)::INT), 6) AS accuracy FROM (SELECT mask, 'model' AS model, t, g AS p FROM m UNION ALL SELECT mask, 'floor', t, 1 FROM m) GROUP BY 1, 2""",
    "majority_floor": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT user_id, event_type AS majority, n FROM r WHERE rn = 1""",
    "auc_rank": _SCORED + _TABLE + " SELECT round(sum(a * (b_below + 0.5 * b)) / (max(n_a)::DOUBLE * max(n_b)), 6) AS auc, CAST(max(n_a) AS BIGINT) AS n_pos, CAST(max(n_b) AS BIGINT) AS n_neg FROM t",
    "roc_points": _SCORED + _TABLE + " SELECT round(x, 6) AS threshold, round((n_b - b_below) / n_b::DOUBLE, 6) AS fpr, round((n_a - a_below) / n_a::DOUBLE, 6) AS tpr FROM t",
    "ks_two_sample": _TWO + _TABLE + " SELECT round(max(abs((a_below + a) / n_a::DOUBLE - (b_below + b) / n_b::DOUBLE)), 6) AS ks, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM t",
    "mann_whitney_u": _TWO
    + _TABLE
    + """, u AS (SELECT sum(a * (b_below + 0.5 * b))::DOUBLE AS u, sum((a + b)::DOUBLE ** 3 - (a + b)) AS ties, max(n_a)::DOUBLE AS p, max(n_b)::DOUBLE AS q FROM t),
z AS (SELECT u, (abs(u - p * q / 2) - 0.5) / sqrt(p * q / 12 * ((p + q + 1) - ties / ((p + q) * (p + q - 1)))) AS z FROM u), h AS (SELECT u, z, greatest(z, 0) / sqrt(2) AS x FROM z)
SELECT round(u, 6) AS u, round(z, 6) AS z, round(CASE WHEN x < 2 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 61), lambda n: (-1) ** n * x ** (2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1))))
  ELSE exp(-x * x) / (sqrt(pi()) * list_reduce(list_transform(range(60, 0, -1), lambda n: n::DOUBLE), lambda t, n: x + n / 2 / t, x)) END, 6) AS p FROM h""",
    "hist_fixed": "SELECT event_type, CAST(least(floor(value / 25), 19) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2",
    "overlap_coef": """WITH sp AS (SELECT event_type AS l, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1),
p AS (SELECT a.l AS class_a, b.l AS class_b, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, a.n AS na, b.n AS nb FROM sp a JOIN sp b ON a.l < b.l),
c AS (SELECT class_a, class_b, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 60)), 59) ELSE 0 END AS bin, count(*) FILTER (event_type = class_a) / max(na)::DOUBLE AS x, count(*) FILTER (event_type = class_b) / max(nb)::DOUBLE AS y
  FROM p JOIN events ON event_type IN (class_a, class_b) GROUP BY 1, 2, 3)
SELECT class_a, class_b, round(sum(least(x, y)), 6) AS overlap FROM c GROUP BY 1, 2""",
    "median_quantiles": "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY 1",
    "slope_log_decay": f"SELECT user_id, round(CASE WHEN var_pop(({_T} - 1704067200) / 86400) > 0 THEN regr_slope(ln(value + 1), ({_T} - 1704067200) / 86400) END, 6) AS slope FROM events GROUP BY 1",
    "flatness_rolloff": """WITH p AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS f, round(sum(value), 4) AS p FROM events GROUP BY 1, 2), q AS (SELECT * FROM p WHERE p > 0),
c AS (SELECT *, sum(p) OVER (PARTITION BY event_type ORDER BY f) AS upto, sum(p) OVER (PARTITION BY event_type) AS total FROM q)
SELECT event_type, round(exp(avg(ln(p))) / avg(p), 6) AS flatness, round(sum(f * p) / sum(p), 6) AS centroid, min(f) FILTER (upto >= 0.85 * total - 1e-9) AS rolloff FROM c GROUP BY 1""",
    "covariance_ellipse": """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS cx, avg(l_discount) AS cy, corr(l_quantity, l_discount) AS r, var_samp(l_quantity) AS a, var_samp(l_discount) AS b, covar_samp(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r, round(2 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)), 6) AS major, round(2 * sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 0)), 6) AS minor FROM m""",
    "qc_flags": """WITH f AS (SELECT user_id, unnest(['clipped', 'silent', 'any']) AS flag, unnest([value > 100, value < 1, value > 100 OR value < 1]) AS f FROM events)
SELECT flag, count(*) AS n, round(100 * avg(f::INT), 6) AS percent, count(DISTINCT CASE WHEN f THEN user_id END) AS bad_runs,
  CASE flag WHEN 'clipped' THEN CASE WHEN 100 * avg(f::INT) > 5 THEN 'red' WHEN 100 * avg(f::INT) > 2 THEN 'amber' ELSE 'green' END
            WHEN 'silent' THEN CASE WHEN 100 * avg(f::INT) > 10 THEN 'red' WHEN 100 * avg(f::INT) > 3 THEN 'amber' ELSE 'green' END ELSE 'green' END AS status FROM f GROUP BY 1""",
    "count_audit": """WITH c AS (SELECT conv_id, max(turn) + 1 AS expected, count(*) FILTER (role <> 'system') AS detected FROM conversations GROUP BY 1)
SELECT conv_id, expected, detected, expected > 0 AND expected <> detected AS mismatch FROM c""",
    "label_agreement": f"SELECT l_suppkey, round(rate, 6) AS rate, judged FROM ({_RATES})",
    "label_agreement_worst": f"SELECT l_suppkey, round(rate, 6) AS rate FROM ({_RATES}) WHERE rate < 1 ORDER BY rate, l_suppkey LIMIT 5",
    "coverage_grid": _GRID + " SELECT * FROM grid",
    "coverage_tallies": _GRID + """ SELECT count(*) FILTER (state = 'full') AS "full", count(*) FILTER (state = 'thin') AS thin, count(*) FILTER (state = 'empty') AS "empty" FROM grid""",
    "thin_cells": _GRID + " SELECT l_returnflag, l_linestatus, l_linenumber, n FROM grid ORDER BY n, l_returnflag, l_linestatus DESC, l_linenumber LIMIT 2",
    "recommendations": """WITH f AS (SELECT avg((value > 100)::INT) AS clipped, avg((value < 1)::INT) AS silent, count(DISTINCT user_id) AS players FROM events),
r AS (SELECT 1 AS p, 'lower the gain' AS a FROM f WHERE clipped > 0.05 UNION ALL SELECT 2, 'check the cable' FROM f WHERE silent > 0.001 UNION ALL SELECT 3, 'record more players' FROM f WHERE players < 1000000)
SELECT CAST(p AS BIGINT) AS priority, a AS advice FROM (SELECT * FROM r UNION ALL SELECT 0, 'all good' WHERE NOT EXISTS (SELECT 1 FROM r)) ORDER BY 1 LIMIT 4""",
    "session_status": """WITH c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 100) AS cl, count(*) FILTER (value < 1) AS si FROM events GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS events, CAST(sum(cl) AS BIGINT) AS clipped, CAST(sum(si) AS BIGINT) AS silent, count(*) AS runs, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS coverage FROM c GROUP BY 1""",
    "windowed_audit": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(*) FILTER (value > 100) AS clipped, count(*) FILTER (value < 1) AS silent FROM events GROUP BY 1, 2",
    "dedup_keep_first": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "knn_topk": _KNN.format(where="a.vec_id % 100 = 0") + " SELECT query, rank, vec_id, round(score, 6) AS score FROM k",
    "knn_coherence": _KNN.format(where="true") + " SELECT CAST(la AS BIGINT) AS label, count(*) AS n, round(avg((la = lb)::INT), 6) AS coherence FROM k GROUP BY 1",
    "neighbour_lift": _KNN.format(where="true")
    + """, b AS (SELECT label, count(*) / sum(count(*)) OVER ()::DOUBLE AS base FROM embeddings GROUP BY 1), s AS (SELECT la, lb AS label, count(*) / sum(count(*)) OVER (PARTITION BY la)::DOUBLE AS share FROM k GROUP BY 1, 2)
SELECT CAST(o.label AS BIGINT) AS "of", CAST(b.label AS BIGINT) AS label, round(coalesce(share, 0), 6) AS share, round(b.base, 6) AS base, round(coalesce(share, 0) / b.base, 6) AS lift FROM b o CROSS JOIN b LEFT JOIN s ON s.la = o.label AND s.label = b.label""",
    "seeded_search": _KNN.format(where="a.vec_id IN (SELECT vec_id FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 5)") + " SELECT query, rank, vec_id FROM k",
    "silhouette_exact": """WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END) AS s, count(*) AS c FROM embeddings a CROSS JOIN embeddings b GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / nullif(c - 1, 0) END) AS a, min(CASE WHEN la <> lb THEN s / c END) AS b FROM d GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM p""",
    "l2_normalise": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id, round(n, 5) AS norm, round(e[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS first FROM n",
    "mahalanobis_two": """WITH m AS (SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, var_pop(p_size) AS a, var_pop(p_retailprice) AS b, covar_pop(p_size, p_retailprice) AS c FROM part)
SELECT p_partkey, round(sqrt(greatest((b * (p_size - ma) ** 2 - 2 * c * (p_size - ma) * (p_retailprice - mb) + a * (p_retailprice - mb) ** 2) / (a * b - c * c), 0)), 5) AS distance FROM part, m""",
    "stratified_kfold": _nearest_mean("(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5"),
    "leave_one_out": _nearest_mean("vec_id % 8"),
    "impute_then_scale": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS fold, nullif(p_size, 25)::DOUBLE AS size, p_retailprice AS price FROM part),
long AS (SELECT p_partkey, fold, 'size' AS feature, size AS x FROM p UNION ALL SELECT p_partkey, fold, 'price', price FROM p),
st AS (SELECT d.fold, l.feature, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT DISTINCT fold FROM p) d JOIN long l ON l.fold <> d.fold GROUP BY 1, 2)
SELECT p_partkey, feature, round((coalesce(x, m) - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 5) AS z FROM long JOIN st USING (fold, feature)""",
    "correction_priority": """SELECT CASE WHEN NOT l_quantity > 10 THEN 'note' WHEN NOT l_discount < 0.08 THEN 'duration' WHEN NOT l_tax < 0.06 THEN 'pressure' ELSE 'ok' END AS first,
  CASE WHEN l_discount < 1e-4 AND l_tax < 1e-4 THEN 'FAIL' WHEN l_discount >= 2 * l_tax THEN 'PASS' WHEN l_tax >= 2 * l_discount THEN 'SWAPPED' ELSE 'UNCLEAR' END AS heard, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "channel_route": """WITH d AS (SELECT n_nationkey AS jack, s AS side, n_nationkey * 2 + s AS hw FROM nation CROSS JOIN (VALUES (0), (1)) v(s) WHERE n_regionkey < 4)
SELECT s_suppkey AS ch, CAST(hw + CASE WHEN s_suppkey % 4 >= 2 THEN 8 ELSE 0 END AS BIGINT) AS hw FROM supplier LEFT JOIN d ON jack = s_nationkey AND side = s_suppkey % 2""",
    "set_operations": """WITH a AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS k FROM customer WHERE c_acctbal < -500)
SELECT 'either' AS part, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
    "status_priority": """WITH m AS (SELECT CASE WHEN l_tax > 0.06 THEN 'sam' WHEN l_discount > 0.08 THEN 'skin' ELSE 'box' END AS method, CASE WHEN l_tax > 0.06 THEN l_tax WHEN l_discount > 0.08 THEN l_discount ELSE l_quantity END AS v FROM lineitem)
SELECT method, count(*) AS n, round(avg(v), 6) AS mean FROM m GROUP BY 1""",
}

_P = "WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, p_retailprice / 1000 AS r, p_size, p_brand FROM part)"
_STEPS = f"WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS rn FROM events)"
_HANDS = _P + """, f AS (SELECT p.*, i, f, s * (0.01::DOUBLE + i / 200::DOUBLE) AS x, r / 2 + i / 10::DOUBLE AS y FROM p CROSS JOIN (VALUES (0, 'index'), (1, 'middle'), (2, 'ring'), (3, 'pinky')) v(i, f) WHERE p_size % 7 <> 0)"""
_WIRE = "(1 - 2.0::DOUBLE ** (-({n}) / 12.0::DOUBLE))"

ORACLES |= {
    "quad_shapes": _P
    + """ SELECT k, round((20 * s + 10 * r * (s + 1)) / 2, 6) AS area, round((2 * s + 1) / 4, 6) AS cx, round((20 + 10 * r) / 4, 6) AS cy, round((3 * s + r * r) / (s * s + r * r), 5) AS share, s + 1 AS third_x,
  CASE WHEN s + sqrt((s + 1) ** 2 + (20 - 10 * r) ** 2) >= sqrt(401::DOUBLE) + 10 * r THEN 0 ELSE s END AS first_x FROM p""",
    "box_relations": _P
    + """ SELECT k, round((25 - s) / 10, 6) AS bx, round((2 - r) / 5, 6) AS "by", 25.0::DOUBLE AS x, sqrt((s + 5 - 25.5) ** 2 + (r + 2.5 - 3.5) ** 2) > 0.2 * sqrt(146::DOUBLE) AS jumped,
  round(0.35 * s / 50 + 0.125 + 0.40 * r / 2, 6) AS detector, round(0.5 * s / 50 + 0.15 + 0.2 * r / 2, 6) AS hand, CASE WHEN p_size % 2 = 0 THEN 'index' WHEN p_size <> 7 AND abs(s - 25) <= abs(r - 1) THEN 'index' ELSE 'middle' END AS finger FROM p""",
    "scalar_helpers": _P
    + """ SELECT k, round(least(greatest(s, 10), 40), 6) AS clipped, round(s + (r - s) * 0.25, 6) AS "between", round(sqrt((s * s + r * r + 4) / 3), 6) AS rms, round(sqrt(s * s + r * r), 6) AS hypot,
  CASE WHEN p_size % 4 > 0 THEN printf('%.1f', p_size / 7.0::DOUBLE * 100) || '%' ELSE '–' END AS percent, '&lt;a href=&quot;' || p_brand || '&quot;&gt;&amp;' AS escaped, round(r, 6) AS second,
  CAST(CASE WHEN p_size % 3 = 0 THEN p_size ELSE 440 END AS BIGINT) AS hz, CASE WHEN p_size % 2 = 0 THEN '/abs/' ELSE '/data/runs/' END || p_brand AS path FROM p""",
    "list_parsing": _P
    + """, q AS (SELECT *, list_distinct([round(r, 1), round(r + 0.00005, 1), 1.0::DOUBLE, 0.5::DOUBLE]) AS peaks FROM p)
SELECT k, CASE WHEN p_size % 3 > 0 THEN '1' || CASE WHEN p_size <= 12 THEN ',' || p_size ELSE '' END || ',3' ELSE '1,2,3,4,5,6,7,8' END AS channels, 2::BIGINT AS n_scores, s AS first_score, 'b' AS second_element,
  CAST(len(peaks) AS BIGINT) AS n_peaks, round(list_min(peaks), 6) AS first_peak FROM q""",
    "expected_pitches": _P
    + """, q AS (SELECT *, CASE WHEN p_size % 3 = 1 THEN [64, 59, 55, 50, 45, 40][p_size % 6 + 1] + p_size % 13 END AS m FROM p)
SELECT k, CAST(CASE WHEN p_size % 3 = 0 THEN 5 ELSE 1 END AS BIGINT) AS n, round(CASE WHEN p_size % 3 = 0 THEN 440 * 2.0::DOUBLE ** ((48 - 69) / 12.0::DOUBLE) WHEN p_size % 3 = 1 THEN 440 * 2.0::DOUBLE ** ((m - 69) / 12.0::DOUBLE) ELSE r * 100 END, 6) AS first,
  round(CASE WHEN p_size % 3 = 0 THEN 440 * 2.0::DOUBLE ** ((64 - 69) / 12.0::DOUBLE) WHEN p_size % 3 = 1 THEN 440 * 2.0::DOUBLE ** ((m - 69) / 12.0::DOUBLE) ELSE r * 100 END, 6) AS highest FROM q""",
    "tones": _P
    + """ SELECT k, round((SELECT sum((sin(2 * pi() * (100 + s) * i / 8000) * 0.5 * (1 - cos(2 * pi() * i / 79))) ** 2) FROM range(80) t(i)), 6) AS tone,
  round((SELECT sum(sin(2 * pi() * (s * i / 8000 + 3 * s * i * i / (2 * 8000.0::DOUBLE * 8000 * 0.01))) ** 2) FROM range(80) t(i)), 6) AS glide, CAST(3 * (p_size % 5 + 1) AS BIGINT) AS n, 1.25::DOUBLE * (p_size % 5 + 1) AS train FROM p""",
    "chord_fingers": _P
    + """, c AS (SELECT k, ['G', 'C', 'D'][p_size % 3 + 1] AS name FROM p)
SELECT k, name, v.finger::BIGINT AS finger, v.string::BIGINT AS string, v.fret::BIGINT AS fret FROM c JOIN (VALUES (true, 2, 6, 3), (true, 3, 5, 2), (true, 4, 1, 3), (false, 3, 5, 3), (false, 2, 4, 2), (false, 1, 2, 1)) v(g, finger, string, fret) ON v.g = (name = 'G')""",
    "note_channels": _P + " SELECT k, concat_ws(',', CASE WHEN p_size % 8 BETWEEN 1 AND 6 THEN p_size % 8 END, CASE WHEN p_size % 9 BETWEEN 1 AND 6 THEN p_size % 9 + 6 END) AS channels FROM p",
    "chart_sequence": "WITH s AS (SELECT conv_id, role AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, r * n + i AS pos, name, round((r * n + i) * 60 / 90.0::DOUBLE, 6) AS t FROM s, range(0, 2) q(r)",
    "planned_runs": "WITH g AS (SELECT s_suppkey AS pass, s AS string, c AS class FROM supplier, range(4, 7) b(s), (VALUES ('clean'), ('buzz'), ('mute')) v(c)) SELECT *, row_number() OVER (PARTITION BY pass, string ORDER BY md5(concat_ws('|', 11, pass, string, class))) AS planned, row_number() OVER (PARTITION BY pass, string ORDER BY md5(concat_ws('|', 5, pass, string, class))) AS turn FROM g",
    "demo_grid": """SELECT concat_ws('-', 'p' || (u + 1), s, f, c, t) AS run_id, 'p' || (u + 1) AS player_id, s AS s_num, 1::BIGINT AS expected, round(440 * 2.0::DOUBLE ** ((CASE s WHEN 6 THEN 40 ELSE 64 END + f - 69) / 12.0::DOUBLE) * (1 + 0.0008::DOUBLE * p), 6) AS hz, round(0.5::DOUBLE + 0.05::DOUBLE * p, 6) AS gain
FROM (SELECT c_custkey AS u, c_custkey % 5 AS p FROM customer) CROSS JOIN (VALUES (6::BIGINT), (1::BIGINT)) b(s) CROSS JOIN (VALUES (0), (5)) d(f) CROSS JOIN (VALUES ('clean'), ('buzz')) g(c) CROSS JOIN range(2) h(t)""",
    "csv_round_trip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "manifest_scan": """SELECT 's' || (event_id % 2) AS session_id, 'p' || (user_id % 3) AS player_id, event_type AS intended_class, count(*) AS n, max(event_id) AS last FROM events
WHERE user_id % 3 IN (0, 2) AND event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 17 > 0 GROUP BY ALL""",
    "sampled_frames": "SELECT event_type, round(median(value), 6) AS median, count(*) AS n, arg_max(event_id, value * 1e6 - event_id / 1e6) AS strongest FROM events WHERE event_id % 1000 % 20 = 0 GROUP BY 1",
    "calibration_scan": "SELECT s_suppkey, s_suppkey % 7 + 1 AS n FROM supplier WHERE s_suppkey % 7 >= 3",
    "document_scan": "SELECT n_name AS guitar_id, CAST(n_regionkey AS BIGINT) AS frets FROM nation",
    "head_onset": _P
    + """, q AS (SELECT *, r > 0.2 * s / 5 AND (p_size % 5 = 0 OR r / 20 > 0.06) AS head FROM p)
SELECT k, CAST(CASE WHEN p_size % 5 > 0 THEN 2 ELSE 0 END + head::INT AS BIGINT) AS n, round(CASE WHEN head THEN 0 WHEN p_size % 5 > 0 THEN r / 20 END, 6) AS first FROM q""",
    "backtracked_peaks": f"""WITH e AS (SELECT user_id, CAST(floor({_T}) AS BIGINT) AS t, max(value) AS energy, max((event_type = 'purchase')::INT) AS peak FROM events GROUP BY 1, 2),
l AS (SELECT *, energy <= coalesce(lag(energy) OVER w, 'inf'::DOUBLE) AND energy < coalesce(lead(energy) OVER w, 'inf'::DOUBLE) AS low FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, max(CASE WHEN low THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS seen FROM l) SELECT user_id, t, coalesce(seen, t) AS onset FROM s WHERE peak = 1""",
    "bridged_runs": _P + ' SELECT k, CAST(min(i) AS BIGINT) AS "first", CAST(max(i) AS BIGINT) AS "last" FROM p CROSS JOIN range(10) t(i) WHERE (p_size + i * 3) % 4 < 2 GROUP BY 1',
    "event_percentile": "WITH q AS (SELECT l_orderkey, quantile_cont(l_quantity, 0.25) - 1e-6 AS least FROM lineitem GROUP BY 1) SELECT l_orderkey, count(*) AS n, min(l_quantity) AS least FROM lineitem l JOIN q USING (l_orderkey) WHERE l_quantity >= q.least GROUP BY 1",
    "run_variety": "WITH o AS (SELECT count(DISTINCT l_returnflag) AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN m >= 3 THEN 'mixed' WHEN m = 1 THEN 'single' ELSE 'few' END AS kind, count(*) AS runs, CAST(sum(n) AS BIGINT) AS rows FROM o GROUP BY 1",
    "optional_filters": """SELECT 'kept' AS what, CAST(count(*) AS VARCHAR) AS found FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'named', (SELECT n_name FROM nation WHERE lower(n_name) LIKE '%an%' ORDER BY length(n_name) DESC, n_name LIMIT 1)
WHERE EXISTS (SELECT 1 FROM nation WHERE lower(n_name) LIKE '%an%') UNION ALL SELECT 'numbered', (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2)""",
    "strengths_sorted": "SELECT user_id, string_agg(event_type, '>' ORDER BY top DESC, event_type) AS types FROM (SELECT user_id, event_type, max(value) AS top FROM events GROUP BY 1, 2) GROUP BY 1",
    "vector_members": "SELECT vec_id, CAST(e.label AS BIGINT) AS label, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 5) AS score FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1) a ON a.label = e.label",
    "eased_values": _STEPS
    + """, s AS (SELECT user_id, rn, event_id, value AS x FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, e.event_id, s.x + 0.15::DOUBLE * (e.value - s.x) FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT event_id, round(x, 6) AS eased FROM s""",
    "cached_steps": _STEPS
    + """, s AS (SELECT user_id, rn, event_id, value > 60 AS far, 0 AS n, true AS fresh, event_id AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.event_id, e.value > 60, CASE WHEN s.far <> (e.value > 60) OR s.n >= 4 THEN 0 ELSE s.n + 1 END, s.far <> (e.value > 60) OR s.n >= 4, CASE WHEN s.far <> (e.value > 60) OR s.n >= 4 THEN e.event_id ELSE s.kept END
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1) SELECT event_id, fresh, CAST(kept AS VARCHAR) AS payload FROM s""",
    "hysteresis_hits": _STEPS
    + """, s AS (SELECT user_id, rn, event_id, value > 60 AS hit, CASE WHEN value > 60 THEN false ELSE true END AS armed, CASE WHEN value > 60 THEN t END AS last FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, hit, CASE WHEN hit THEN false WHEN value < 0.7::DOUBLE * 60 THEN true ELSE armed END, CASE WHEN hit THEN t ELSE last END
  FROM (SELECT e.*, s.armed, s.last, s.armed AND e.value > 60 AND (s.last IS NULL OR e.t - s.last >= 0.12) AS hit FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)) SELECT event_id, hit FROM s""",
    "one_euro_smooth": _STEPS
    + """, s AS (SELECT user_id, rn, event_id, t, value AS x, 0.0::DOUBLE AS dx FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, t, x0 + (value - x0) / (1 + 1 / (2 * pi() * (1 + 0.01::DOUBLE * abs(dx)) * dt)), dx
  FROM (SELECT *, dx0 + ((value - x0) / dt - dx0) / (1 + 1 / (2 * pi() * dt)) AS dx FROM (SELECT e.*, s.x AS x0, s.dx AS dx0, greatest(0.001::DOUBLE, e.t - s.t) AS dt FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)))
SELECT event_id, round(x, 6) AS smooth FROM s""",
    "monotonic_timestamps": f"""WITH e AS (SELECT event_id, user_id, {_T} AS t, CAST(floor({_T} / 3600) AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS rn FROM events)
SELECT event_id, max(ts - rn) OVER (PARTITION BY user_id ORDER BY rn) + rn AS ts_fixed FROM e""",
    "onset_top_spaced": f"""WITH RECURSIVE e AS (SELECT user_id, {_T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, {_T}) AS rn FROM events),
s AS (SELECT user_id, rn, [t] AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN len(s.kept) < 12 AND len(list_filter(s.kept, lambda x: abs(x - e.t) < 43200)) = 0 THEN list_append(s.kept, e.t) ELSE s.kept END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, unnest(kept) AS onset FROM s WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM e GROUP BY 1)""",
    "group_kfold": """WITH RECURSIVE c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS i FROM orders GROUP BY o_custkey),
s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS held
  UNION ALL SELECT i, list_transform(load, lambda x, f: x + CASE WHEN f = lightest THEN n ELSE 0 END), list_transform(held, lambda x, f: x + CASE WHEN f = lightest THEN 1 ELSE 0 END)
  FROM (SELECT c.i, c.n, s.load, s.held, list_position(s.load, list_min(s.load)) AS lightest FROM s JOIN c ON c.i = s.i + 1))
SELECT f - 1 AS fold, load[f] AS n, held[f] AS customers FROM (SELECT * FROM s ORDER BY i DESC LIMIT 1) CROSS JOIN range(1, 6) r(f)""",
    "held_frames": "SELECT user_id, round(avg((event_type = 'click')::INT), 6) AS fresh, count(*) FILTER (event_type = 'view') AS held FROM events WHERE value / 100 >= 0.3 GROUP BY 1",
    "pose_features": _HANDS
    + """, w AS (SELECT k, s * 0.015::DOUBLE + 0.2::DOUBLE AS mx, r / 2 AS my FROM p), c AS (SELECT f.*, sqrt((mx + 0.5) ** 2 + (my + 0.2) ** 2) AS scale FROM f JOIN w USING (k))
SELECT CAST(k AS VARCHAR) AS event_id, round(max(CASE WHEN i = 0 THEN (x + 0.5) / scale END), 5) AS index_x, round(max(CASE WHEN i = 0 THEN (y + 0.2) / scale END), 5) AS index_y, round(max(CASE WHEN i = 3 THEN (x + 0.5) / scale END), 5) AS pinky_x, round(max(CASE WHEN i = 3 THEN (y + 0.2) / scale END), 5) AS pinky_y FROM c GROUP BY 1""",
    "vision_rows": _HANDS
    + f""", n AS (SELECT f.*, (SELECT arg_min(j, abs(f.x - {_WIRE.format(n="j")}) * 1e6 + j * 1e-6) FROM range(8) t(j)) AS near FROM f),
d AS (SELECT *, x - {_WIRE.format(n="CASE WHEN p_size % 4 > 0 THEN p_size % 4 ELSE near END")} AS d FROM n),
a AS (SELECT k, min(CASE WHEN p_size % 2 = 0 THEN CASE WHEN i = 0 THEN {{'off': 0.0::DOUBLE, 'i': i, 'd': d, 'y': y, 'near': near}} END ELSE {{'off': abs(d), 'i': i, 'd': d, 'y': y, 'near': near}} END) AS b, max(CASE WHEN i = 0 THEN d END) AS d_index, max(CASE WHEN i = 3 THEN d END) AS d_pinky FROM d GROUP BY 1)
SELECT CAST(p.k AS VARCHAR) AS event_id, round(b.d, 5) AS d_active, round(d_index, 5) AS d_index, round(d_pinky, 5) AS d_pinky, CASE WHEN a.k IS NOT NULL THEN CAST(least(6, greatest(1, 6 - round_even(b.y * 5, 0))) AS DOUBLE) END AS string_est, CAST(b.near AS DOUBLE) AS fret_est,
  CASE WHEN a.k IS NOT NULL THEN 0.8::DOUBLE END AS hand_conf, CASE WHEN a.k IS NOT NULL THEN 1.5::DOUBLE END AS reproj_px FROM p LEFT JOIN a USING (k)""",
    "stratified_holdout": "WITH f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 = 0 AS h FROM embeddings) SELECT CAST(label AS BIGINT) AS label, count(*) AS n, count(*) FILTER (h) AS held, max(CASE WHEN h THEN vec_id END) AS last FROM f GROUP BY 1",
    "controlled_covariate": "SELECT l_returnflag, l_linestatus, round((SELECT avg(l_discount) FROM lineitem), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "class_medoids": """WITH m AS (SELECT p_brand, avg(p_size) AS a, avg(p_retailprice) AS b FROM part GROUP BY 1), d AS (SELECT p_brand, p_partkey, (p_size - a) ** 2 + (p_retailprice - b) ** 2 AS far FROM part JOIN m USING (p_brand)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY far, p_partkey) AS rn FROM d)
SELECT p_brand, p_partkey, round(sqrt(far), 6) AS distance FROM r WHERE rn = 1""",
    "series_offset": f"SELECT 2::BIGINT AS lag, count(*) AS users FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT floor({_T} / 86400)) > 2)",
    "quarantined_runs": "SELECT conv_id, count(*) AS detected, count(*) <> max(turn) + CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END OR conv_id % 7 = 0 AS quarantined FROM conversations GROUP BY conv_id",
    "largest_loadings": """WITH w AS (SELECT l_returnflag, l_linenumber, round(sum(l_discount - 0.05::DOUBLE), 4) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(w) DESC, l_linenumber) AS rank FROM w)
SELECT l_returnflag, rank, round(abs(w), 3) AS weight FROM r WHERE rank <= 3""",
    "between_means": """WITH m AS (SELECT avg(p_retailprice) FILTER (p_brand = 'Brand#1') AS lo, avg(p_retailprice) FILTER (p_brand = 'Brand#2') AS hi FROM part)
SELECT p_partkey, round(CASE WHEN abs(hi - lo) > 1e-12 THEN (p_retailprice - lo) / (hi - lo) END, 4) AS position FROM part, m""",
}

ORACLES |= {
    "forest_values": "SELECT p_partkey % 3 AS fold, count(*) AS n, true AS close FROM part GROUP BY 1",
    "perceptron": "SELECT p_partkey % 3 AS fold, count(*) AS n, true AS accurate FROM part GROUP BY 1",
    "pairwise_axis": """WITH li AS (SELECT l_returnflag AS c, CASE WHEN l_linenumber <> 4 THEN l_quantity::DOUBLE END AS x, l_discount::DOUBLE AS d, l_quantity::DOUBLE + 20::DOUBLE * l_discount AS w, l_orderkey % 5 AS f FROM lineitem),
r AS (SELECT 'wide' AS space, c, x, d AS y, f FROM li UNION ALL SELECT 'narrow', c, x, w, f FROM li), fo AS (SELECT DISTINCT f FROM r),
k AS (SELECT DISTINCT a.c AS ca, b.c AS cb FROM r a JOIN (SELECT DISTINCT c FROM r) b ON a.c < b.c),
t AS (SELECT fo.f, k.ca, k.cb, r.space, r.c, r.x, r.y FROM fo JOIN r ON r.f <> fo.f JOIN k ON r.c = k.ca OR r.c = k.cb),
m AS (SELECT space, f, ca, cb, avg(x) AS mx, avg(y) AS my FROM t GROUP BY ALL),
s AS (SELECT t.space, t.f, t.ca, t.cb, any_value(mx) AS mx, any_value(my) AS my, stddev_pop(coalesce(x, mx)) AS sx, stddev_pop(coalesce(y, my)) AS sy, corr(coalesce(x, mx), coalesce(y, my)) AS r FROM t JOIN m USING (space, f, ca, cb) GROUP BY ALL),
z AS (SELECT t.space, t.f, t.ca, t.cb, t.c, (coalesce(x, mx) - mx) / sx AS zx, (coalesce(y, my) - my) / sy AS zy, CASE WHEN (1 + abs(r)) / 2 > 0.95 THEN 1 ELSE 2 END AS axes, sign(r) AS sg FROM t JOIN s USING (space, f, ca, cb)),
u AS (SELECT space, f, ca, cb, axes, c, CASE WHEN axes = 1 THEN zx + sg * zy ELSE zx END AS p, CASE WHEN axes = 1 THEN 0 ELSE zy END AS q FROM z),
g AS (SELECT space, f, ca, cb, axes, c, count(*) AS n, avg(p) AS mp, avg(q) AS mq, var_pop(p) * count(*) AS spp, var_pop(q) * count(*) AS sqq, covar_pop(p, q) * count(*) AS spq FROM u GROUP BY ALL),
w AS (SELECT a.space, a.f, a.ca, a.cb, a.axes, (a.spp + b.spp) / (a.n + b.n - 2) AS vp, (a.sqq + b.sqq) / (a.n + b.n - 2) AS vq, (a.spq + b.spq) / (a.n + b.n - 2) AS vpq, b.mp - a.mp AS dp, b.mq - a.mq AS dq
  FROM g a JOIN g b ON a.space = b.space AND a.f = b.f AND a.ca = b.ca AND a.cb = b.cb AND a.c = a.ca AND b.c = b.cb),
h AS (SELECT *, CASE WHEN axes = 1 THEN dp / vp ELSE (vq * dp - vpq * dq) / (vp * vq - vpq * vpq) END AS up, CASE WHEN axes = 1 THEN 0 ELSE (vp * dq - vpq * dp) / (vp * vq - vpq * vpq) END AS uq FROM w),
o AS (SELECT r.space, ca, cb, axes, c, CASE WHEN axes = 1 THEN ((coalesce(x, mx) - mx) / sx + sign(s.r) * (coalesce(y, my) - my) / sy) * up ELSE (coalesce(x, mx) - mx) / sx * up + (coalesce(y, my) - my) / sy * uq END / sqrt(up * dp + uq * dq) AS z
  FROM h JOIN s USING (space, f, ca, cb) JOIN r ON r.space = h.space AND r.f = h.f AND (r.c = ca OR r.c = cb))
SELECT space, ca AS class_a, cb AS class_b, max(axes)::BIGINT AS axes, count(*) AS n, round(abs(avg(z) FILTER (c = ca) - avg(z) FILTER (c = cb)) / sqrt((var_samp(z) FILTER (c = ca) + var_samp(z) FILTER (c = cb)) / 2), 6) AS dprime FROM o GROUP BY 1, 2, 3""",
    "tone_pitches": "SELECT s_suppkey::BIGINT AS k, (s_suppkey % 36 + 43)::BIGINT AS before, (s_suppkey % 36 + 48)::BIGINT AS after, 0::BIGINT AS voiced_in_silence FROM supplier",
    "resampled_tones": "SELECT s_suppkey AS k, ceil(22050 * 16000 / 44100.0)::BIGINT AS n, ceil(22050 / 4096.0)::BIGINT AS chunks, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE round(sqrt(0.5), 2) END::DOUBLE AS level FROM supplier",
    "audio_containers": """SELECT doc_id, ['wav', 'wav', 'flac', 'ogg', 'webm', 'mp4', 'mp3', NULL][doc_id % 8 + 1] AS container, ['pcm', 'mp3', 'flac', 'opus', 'opus', 'aac', 'mp3', NULL][doc_id % 8 + 1] AS codec, doc_id % 8 IN (0, 2) AS kept FROM documents""",
    "ablation_arms": """WITH l AS (SELECT l_orderkey % 4 AS f, CASE WHEN l_quantity + 10 * (l_linenumber % 3) > 40 THEN 'high' WHEN l_quantity > 15 THEN 'middle' ELSE 'low' END AS y, CASE WHEN l_linenumber <> 5 THEN l_quantity::DOUBLE END AS a, l_extendedprice / 1000::DOUBLE AS b FROM lineitem),
r AS (SELECT row_number() OVER () AS id, * FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT id, f, y, 'quantity' AS arm, a AS x FROM r UNION ALL SELECT id, f, y, 'price', b FROM r), fo AS (SELECT DISTINCT f FROM r),
t AS (SELECT arm, fo.f, y, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s FROM fo JOIN m ON m.f <> fo.f GROUP BY ALL),
p AS (SELECT arm, f, y, m, n / sum(n) OVER w AS prior, sum(s) OVER w / (sum(n) OVER w - count(*) OVER w) AS v FROM t WINDOW w AS (PARTITION BY arm, f)),
g AS (SELECT m.arm, m.id, m.y, arg_max(p.y, p.m * m.x / v - p.m * p.m / (2 * v) + ln(prior)) AS guess FROM m JOIN p ON p.arm = m.arm AND p.f = m.f GROUP BY ALL)
SELECT arm, count(*) AS n, round(avg((y = guess)::INT), 6) AS accuracy FROM g GROUP BY 1
UNION ALL SELECT 'majority', sum(n)::BIGINT, round(max(n) / sum(n), 6) FROM (SELECT y, count(*) AS n FROM r GROUP BY 1)""",
    "transfer_positions": """WITH l AS (SELECT l_returnflag AS c, l_linenumber, l_quantity::DOUBLE AS a, (l_discount * 100 + CASE WHEN l_returnflag = 'N' THEN l_quantity / 10 ELSE 0 END)::DOUBLE AS b FROM lineitem),
m AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab FROM l WHERE c <> 'R' GROUP BY 1),
s AS (SELECT sum(saa) AS saa, sum(sbb) AS sbb, sum(sab) AS sab FROM m), d AS (SELECT lo.ma, lo.mb, hi.ma - lo.ma AS da, hi.mb - lo.mb AS db FROM m lo JOIN m hi ON lo.c = 'A' AND hi.c = 'N'),
w AS (SELECT ma, mb, da, db, sbb * da - sab * db AS wa, saa * db - sab * da AS wb FROM d, s)
SELECT l_linenumber, count(*) AS n, round(avg((wa * (a - ma) + wb * (b - mb)) / (wa * da + wb * db)), 4) AS position FROM l, w WHERE c = 'R' GROUP BY 1""",
    "smoothed_quads": _STEPS
    + """, s AS (SELECT user_id, rn, event_id, CASE WHEN event_type <> 'view' THEN value / 100 END AS x, CASE WHEN event_type <> 'view' THEN 0.9::DOUBLE END AS conf, CASE WHEN event_type <> 'view' THEN 0 ELSE 1 END AS missed, CASE WHEN event_type <> 'view' THEN 'fresh' ELSE 'miss' END AS state FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN new IS NULL THEN CASE WHEN missed < 5 THEN x END WHEN x IS NULL THEN new ELSE x + CASE WHEN abs(new - x) < 0.08::DOUBLE * sqrt(2) THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END * (new - x) END,
    CASE WHEN new IS NOT NULL THEN 0.9::DOUBLE WHEN x IS NOT NULL AND missed < 5 THEN conf * 0.8::DOUBLE END, CASE WHEN new IS NULL THEN missed + 1 ELSE 0 END, CASE WHEN new IS NOT NULL THEN 'fresh' WHEN x IS NOT NULL AND missed < 5 THEN 'held' ELSE 'miss' END
  FROM (SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.event_type <> 'view' THEN e.value / 100 END AS new, s.x, s.conf, s.missed FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1))
SELECT event_id, state, round(x, 6) AS x, round(conf, 6) AS confidence FROM s""",
    "board_twins": """WITH u AS (SELECT 1 - 2.0::DOUBLE ** (-3 / 12.0::DOUBLE) AS u)
SELECT s_nationkey, count(*) AS n_keyframes, 0.0::DOUBLE AS median_reproj_px, round((110 + s_nationkey + 900 * any_value(u)) / (1 + any_value(u) / 10), 3) AS third_x, round((50 + 2 * s_nationkey - 30 * any_value(u) + (200 + s_nationkey) / 2::DOUBLE) / (1 + any_value(u) / 10), 3) AS third_y FROM supplier, u WHERE s_suppkey % 5 <> 0 GROUP BY 1""",
    "score_charts": """WITH b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS bar, turn, length(text) AS n FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN turn % 4 = 0 OR after_close THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY bar) AS section FROM (SELECT *, coalesce(lag(turn % 4 = 3) OVER (PARTITION BY conv_id ORDER BY bar), false) AS after_close FROM b)),
p AS (SELECT *, unnest(range(1, CASE WHEN max(turn % 4) OVER (PARTITION BY conv_id, section) = 3 THEN 3 ELSE 2 END)) AS pass FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS play, coalesce(last_value(CASE WHEN turn % 3 = 0 THEN 60 + n % 120 END IGNORE NULLS) OVER w, 120)::DOUBLE AS bpm FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY section, pass, bar ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, coalesce(sum(240 / bpm) OVER (PARTITION BY conv_id ORDER BY play ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_s FROM o)
SELECT conv_id, round(start_s + k * 60 / bpm, 4) AS t, CASE j WHEN 0 THEN 1 + n % 3 WHEN 4 THEN 4 + n % 3 ELSE 1 + (n + k) % 6 END::INT AS string, ((n * 7 + k) % 13)::INT AS fret, round(60 / bpm, 4) AS dur, CASE WHEN k = 0 THEN play + 1 END AS chord
FROM t, (VALUES (0, 0), (4, 0), (1, 1), (2, 2), (3, 3)) v(j, k)""",
    "neck_edges": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 50 AS m, unnest(range(0, 30)) AS i FROM supplier),
p AS (SELECT k, i * 4.0::DOUBLE AS x, m * 2.0::DOUBLE AS y FROM s UNION ALL SELECT k, i * 4.0::DOUBLE, m * 2.0::DOUBLE + 60 FROM s UNION ALL SELECT k, m::DOUBLE, i * 3.0::DOUBLE FROM s WHERE i < 20),
g AS (SELECT k, a, floor((x * cos(a * (pi() / 36)) + y * sin(a * (pi() / 36))) / 2 + 0.5)::BIGINT AS o, count(*) AS n FROM p, range(0, 36) r(a) GROUP BY ALL HAVING count(*) >= 15),
v AS (SELECT k, a, o, n, a AS va, o AS vo FROM g UNION ALL SELECT k, a, o, n, a + 36, -o FROM g UNION ALL SELECT k, a, o, n, a - 36, -o FROM g),
t AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = g.k AND abs(v.va - g.a) <= 3 AND abs(v.vo - g.o) <= 5 AND (v.n > g.n OR (v.n = g.n AND (v.a, v.o) < (g.a, g.o))))),
w AS (SELECT c.k, c.a AS angle_a, c.o AS offset_a, d.a AS angle_b, d.o AS offset_b, (c.n + d.n)::DOUBLE AS votes, row_number() OVER (PARTITION BY c.k ORDER BY c.n + d.n DESC, c.a, c.o, d.a, d.o) AS r
  FROM t c JOIN t d ON c.k = d.k AND (c.a, c.o) < (d.a, d.o) AND (abs(c.a - d.a) <= 4 OR abs(c.a - d.a) >= 32))
SELECT k AS s_suppkey, angle_a::INT AS angle_a, offset_a, angle_b::INT AS angle_b, offset_b, votes FROM w WHERE r = 1""",
    "nearest_landmarks": f"""WITH e AS (SELECT *, {_T} AS t FROM events), p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'),
n AS (SELECT p.event_id, abs(v.t - p.t) AS gap, v.value, floor(v.t / 3600) % 24 AS hour, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.t - p.t), v.t, v.value) AS rank FROM p JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' AND abs(v.t - p.t) <= 86400)
SELECT p.event_id, count(n.rank) AS n_used, round(min(gap), 3) AS gap, round(median(n.value), 6) AS value, median(n.hour)::DOUBLE AS hour FROM p LEFT JOIN n ON n.event_id = p.event_id AND rank <= 3 GROUP BY 1""",
}

#: The spectrum of the first 256 samples of each tone (k, hz): a Hann window, and the discrete transform as it is defined.
_SPECTRUM = """s AS (SELECT k, hz, i, (0.5::DOUBLE * sin(2 * pi() * hz * i / 22050))::FLOAT::DOUBLE AS x FROM t, range(0, 8820) r(i)),
d AS (SELECT k, any_value(hz) AS hz, b, sum(x * h * cos(2 * pi() * b * i / 256)) AS re, sum(x * h * sin(2 * pi() * b * i / 256)) AS im
  FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 255) AS h FROM s WHERE i < 256), range(0, 129) q(b) GROUP BY k, b),
p AS (SELECT k, hz, b, b * 22050 / 256.0::DOUBLE AS f, re * re + im * im AS p, sqrt(re * re + im * im) AS m FROM d)"""
_HZ = "440 * 2.0::DOUBLE ** ((s_suppkey % 45 + 45 - 69) / 12.0::DOUBLE)"
ORACLES |= {
    "tone_features": f"""WITH t AS (SELECT s_suppkey::BIGINT AS k, {_HZ} * 2.0::DOUBLE ** ((s_suppkey % 7 - 3) * 10 / 1200.0::DOUBLE) AS hz FROM supplier), {_SPECTRUM},
w AS (SELECT k, sqrt(avg(x * x)) AS rms, count(*) FILTER (flips) / 8819.0::DOUBLE AS zcr FROM (SELECT k, x, (x < 0) <> lag(x < 0) OVER (PARTITION BY k ORDER BY i) AS flips FROM s) GROUP BY 1),
c AS (SELECT k, sum(m) AS total, sum(m * f) / sum(m) AS centre FROM p GROUP BY 1),
f AS (SELECT p.k, any_value(centre) AS centre, sqrt(sum(m * (f - centre) ** 2) / any_value(total)) AS width, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS flat, sum(p) FILTER (f >= 4000) / sum(p) AS buzz FROM p JOIN c USING (k) GROUP BY 1),
r AS (SELECT k, min(f) AS roll FROM (SELECT p.k, f, total, sum(m) OVER (PARTITION BY p.k ORDER BY b) AS upto FROM p JOIN c USING (k)) WHERE upto >= 0.85::DOUBLE * total GROUP BY 1),
e AS (SELECT j, 700 * (10 ** (j * (2595 * log10(1 + 11025 / 700.0::DOUBLE) / 41) / 2595) - 1) AS z FROM range(0, 42) g(j)),
b AS (SELECT lo.j, lo.z AS lo, mid.z AS mid, hi.z AS hi FROM e lo JOIN e mid ON mid.j = lo.j + 1 JOIN e hi ON hi.j = lo.j + 2),
l AS (SELECT k, j, 10 * log10(greatest(sum(p * greatest(least((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0)), 1e-10)) AS level FROM p, b GROUP BY ALL),
o AS (SELECT k, sum(level) * sqrt(1 / 40.0::DOUBLE) AS c1, sum(level * cos(pi() * (j + 0.5::DOUBLE) / 40)) * sqrt(2 / 40.0::DOUBLE) AS c2 FROM l GROUP BY 1)
SELECT k, k % 45 + 45 AS midi, round(rms, 5) AS rms, round(zcr, 6) AS zcr, (k % 7 - 3) * 10 AS cents, round(centre, 3) AS spec_centroid, round(width, 3) AS spec_bandwidth, round(roll, 3) AS spec_rolloff, round(flat, 7) AS spec_flatness, round(buzz, 7) AS buzz_band_ratio,
  round(c1, 3) AS mfcc_1, round(c2, 3) AS mfcc_2, -(2 + k % 5) AS decay, true AS harmonic FROM w JOIN f USING (k) JOIN r USING (k) JOIN o USING (k)""",
    "tone_residuals": f"""WITH t AS (SELECT s_suppkey::BIGINT AS k, {_HZ} AS hz FROM supplier), {_SPECTRUM},
q AS (SELECT *, CASE WHEN k % 2 = 0 THEN hz ELSE hz * sqrt(2) END AS heard FROM p),
r AS (SELECT k, f, p, (SELECT bool_and(abs(q.f - h * q.heard) > greatest(1.5::DOUBLE * 22050 / 256, h * q.heard * (2.0::DOUBLE ** (70 / 1200.0::DOUBLE) - 1))) FROM range(1, 9) n(h)) AS kept FROM q),
c AS (SELECT k, sum(p) AS whole, greatest(sum(p) FILTER (kept), 1e-12) AS rest, sum(p * f) FILTER (kept) AS moment, coalesce(sum(p) FILTER (kept AND f >= 4000), 0) AS high, exp(avg(ln(greatest(p, 1e-10))) FILTER (kept)) / avg(greatest(p, 1e-10)) FILTER (kept) AS flat FROM r GROUP BY 1),
u AS (SELECT k, min(f) AS roll FROM (SELECT r.k, f, rest, sum(CASE WHEN kept THEN p ELSE 0 END) OVER (PARTITION BY r.k ORDER BY f) AS upto FROM r JOIN c USING (k)) WHERE upto >= 0.85::DOUBLE * rest GROUP BY 1)
SELECT k, k % 2 = 0 AS expected, round(rest / whole, 7) AS res_energy_ratio, round(moment / rest, 3) AS res_centroid, round(roll, 3) AS res_rolloff, round(high / rest, 6) AS res_highband_ratio, round(flat, 6) AS res_flatness FROM c JOIN u USING (k)""",
    "tone_onsets": "SELECT s_suppkey::BIGINT AS k, round((s_suppkey % 3 + 1) / 10.0::DOUBLE, 1) AS onset FROM supplier",
    "wire_laws": "SELECT s_suppkey AS frame, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS sign, 10::BIGINT AS inliers, 1::BIGINT AS gaps, (40 + s_suppkey % 17)::DOUBLE AS nut, (900 + 10 * (s_suppkey % 3))::DOUBLE AS scale FROM supplier",
    "shrunk_covariance": """WITH l AS (SELECT [l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS v FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL),
m AS (SELECT count(*) AS n, [avg(v[1]), avg(v[2]), avg(v[3])] AS m FROM l), ij AS (SELECT i, j FROM range(0, 3) a(i), range(0, 3) b(j)),
s AS (SELECT i, j, covar_pop(v[i + 1], v[j + 1]) AS c FROM l, ij GROUP BY ALL), mu AS (SELECT sum(c) FILTER (i = j) / 3 AS mu, sum(c * c) AS square FROM s),
d AS (SELECT mu, square, sum((c - CASE WHEN i = j THEN mu ELSE 0 END) ** 2) AS delta FROM s, mu GROUP BY ALL), f AS (SELECT avg(list_distance(v, m) ** 4) AS fourth, any_value(n) AS n FROM l, m),
h AS (SELECT mu, greatest(least((fourth - square) / n, delta) / delta, 0) AS share FROM d, f)
SELECT i::INT AS i, j::INT AS j, round((1 - share) * c + CASE WHEN i = j THEN share * mu ELSE 0 END, 6) AS covariance, round(share, 9) AS shrinkage FROM s, h""",
    "bimodality": """WITH RECURSIVE l AS (SELECT ln(1 + value) AS x FROM events WHERE value IS NOT NULL), a AS (SELECT count(*)::DOUBLE AS n, var_pop(x) AS spread, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM l),
e AS (SELECT 0 AS i, 0.5::DOUBLE AS w, lo AS m0, hi AS m1, spread / 4 AS v0, spread / 4 AS v1, '-infinity'::DOUBLE AS two, false AS done FROM a
  UNION ALL SELECT i + 1, r / n, rx / r, (sx - rx) / (n - r), greatest(rxx / r - (rx / r) ** 2, 1e-6 * spread), greatest((sxx - rxx) / (n - r) - ((sx - rx) / (n - r)) ** 2, 1e-6 * spread), CASE WHEN k - two < 1e-7 * abs(k) THEN two ELSE k END, k - two < 1e-7 * abs(k)
  FROM (SELECT i, two, sum(share) AS r, sum(share * x) AS rx, sum(share * x * x) AS rxx, sum(x) AS sx, sum(x * x) AS sxx, sum(ln(total)) AS k FROM (SELECT i, two, x, p / (p + q) AS share, p + q AS total
    FROM (SELECT i, two, x, w / sqrt(2 * pi() * v0) * exp(-((x - m0) ** 2) / (2 * v0)) + 1e-300 AS p, (1 - w) / sqrt(2 * pi() * v1) * exp(-((x - m1) ** 2) / (2 * v1)) + 1e-300 AS q FROM e, l WHERE NOT done AND i < 60)) GROUP BY i, two), a),
z AS (SELECT -2 * (-0.5::DOUBLE * n * (ln(2 * pi() * spread) + 1)) + 2 * ln(n) AS b1, -2 * two + 5 * ln(n) AS b2, least(w, 1 - w) AS lw, abs(m0 - m1) / (0.5::DOUBLE * (sqrt(v0) + sqrt(v1))) AS apart FROM e, a ORDER BY i DESC LIMIT 1)
SELECT round(b1, 3) AS bic_1, round(b2, 3) AS bic_2, round(lw, 3) AS least_weight, round(apart, 3) AS separation, b1 - b2 > 6 AND lw > 0.15 AND apart > 1 AS bimodal FROM z""",
    "unnest_notes": """WITH c AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, turn, length(w) % 9 AS string, strlen(w) % 5 - 1 AS fret FROM c),
v AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event FROM n WHERE string BETWEEN 1 AND 6 AND fret >= 0), g AS (SELECT conv_id AS tab_id, event, string, fret, count(*) AS n FROM v GROUP BY ALL)
SELECT tab_id, event, round(event * 0.95::DOUBLE, 6) AS t, string, fret, n, round((row_number() OVER (PARTITION BY tab_id, event ORDER BY string DESC, fret) - 1) * 0.04::DOUBLE, 6) AS offset_s, string || CASE WHEN fret BETWEEN 1 AND 6 THEN ',' || (fret + 6) ELSE '' END AS channels FROM g""",
}
