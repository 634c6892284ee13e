"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, row_number() OVER () AS row
  FROM {docs}),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
caps AS (
  SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 AS DOUBLE) * source_size AS cap,
         CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS want FROM ranked),
levels AS (
  SELECT *, (want - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
water AS (SELECT arg_min(level, cap / weight * 1e6 + rank) AS water FROM levels WHERE level <= cap / weight),
targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM levels LEFT JOIN water ON true),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rows_ AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h % 4096, s.h, s.doc_id, s.size, s.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
drawn AS (SELECT *, quota > 0 AND before + size / CAST(2 AS DOUBLE) <= quota AS extra FROM rows_),
gaps AS (SELECT *, quota - coalesce(sum(CASE WHEN extra THEN size END) OVER (PARTITION BY source), 0) AS gap FROM drawn),
best AS (
  SELECT source, min({{'off': abs(gap - CASE WHEN extra THEN -size ELSE size END), 'h': h, 'doc_id': doc_id, 'size': size, 'row': row}}).row AS turn
  FROM gaps WHERE quota > 0 AND abs(gap - CASE WHEN extra THEN -size ELSE size END) < abs(gap) GROUP BY source),
final AS (
  SELECT g.*, g.whole + CAST(CASE WHEN b.turn IS NULL THEN g.extra ELSE NOT g.extra END AS BIGINT) AS repeats
  FROM gaps g LEFT JOIN best b ON g.source IS NOT DISTINCT FROM b.source AND g.row = b.turn)
"""

_LINES = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs}),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
"""


_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length({s}) + 1), lambda i:
  list_transform(range(0, 8), lambda b: CAST((ascii(substr({s}, CAST(i AS INT), 1)) >> CAST(b AS INT)) & 1 AS BIGINT))))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
_ID_CRC = _CRC.format(s="CAST(doc_id AS VARCHAR)")

_EXACT = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY t)
"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("shown_text")} AS shown
  FROM (SELECT *, CASE WHEN {_ID_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown_text FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes AS (
  SELECT source, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3),
subroots AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS idx, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY level, idx // 3),
docs AS (SELECT p.*, s.subroot, s.place FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source),
met AS (
  SELECT doc_id, 0 AS part, level, n.idx, node, d.idx // CAST(power(3, level) AS BIGINT) AS own
  FROM docs d JOIN nodes n ON d.source IS NOT DISTINCT FROM n.source AND n.n > 1 AND n.idx // 3 = d.idx // CAST(power(3, level + 1) AS BIGINT)
  UNION ALL
  SELECT doc_id, 1, level, t.idx, node, d.place // CAST(power(3, level) AS BIGINT)
  FROM docs d JOIN tops t ON t.n > 1 AND t.idx // 3 = d.place // CAST(power(3, level + 1) AS BIGINT)),
steps AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS step,
         coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS l,
         coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS r
  FROM met GROUP BY doc_id, part, level),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id),
folds AS (
  SELECT doc_id, 0 AS step, shown AS v FROM docs
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(s.l || f.v || s.r) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1),
folded AS (SELECT doc_id, arg_max(v, step) AS v FROM folds GROUP BY doc_id)
SELECT d.doc_id, d.leaf, d.subroot, t.node AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.v AS folded_root, f.v = t.node AS verified
FROM docs d JOIN (SELECT node FROM tops WHERE n = 1) t ON true JOIN folded f ON f.doc_id = d.doc_id LEFT JOIN proofs p ON p.doc_id = d.doc_id
"""

_RUNS = rf"""
WITH original AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_ID_CRC} AS h FROM documents),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM original),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
dealt AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
words AS (
  SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM dealt)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island, x.i
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
lists AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS written,
         first({{'s': start, 'l': length, 'p': period}} ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) AS best
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(written, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


_COMPONENTS = """
reach AS (SELECT id, id AS far FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.far),
parts AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)"""

_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN parts p ON p.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
"""

_SHINGLES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS shingle FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts p ON p.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_dedup": _VECTORS,
        "op7_minhash_dedup": _SHINGLES,
        "op11_exact_dedup": _EXACT,
        "op12_merkle_manifest": _MERKLE,
        "op13_periodic_runs": _RUNS,
        "op2_mix_sources": _MIX.format(docs="documents") + "SELECT doc_id, size, source_size, round(target, 6) AS target, repeats * size AS taken FROM final",
        "op9_line_dedup": _LINES.format(docs="documents")
        + """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY doc_id""",
    }
