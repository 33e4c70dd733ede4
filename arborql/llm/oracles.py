"""DuckDB SQL for the queries opN_<name> that SQL can express, over whole tables.

Without SQL: op2 (places of matches and sliding entropies), op3 (byte-pair merges), op5 (a trained model),
op8 (Viterbi), op11 (byte-pair merges). Their tests hold them against plain Python."""

WORD = r"[^\x20\x09-\x0D]+"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


#: What the query states on its own: metric, events, and of what they are counted, all per 1000.
_OP4_RATES = {
    "symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
    "shout_rate": ("n_shout", "word_chars"), "word_length": ("word_chars", "n_words"),
}


def _op4() -> str:
    rates = ", ".join(f"coalesce(1000 * {a} // nullif({b}, 0), 0) AS {m}" for m, (a, b) in _OP4_RATES.items())
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM r WHERE NOT base_failed" for m in _OP4_RATES)

    def fence(name: str, keys: str) -> str:
        return f"""
{name}_c AS (SELECT {keys}, metric, bucket, width, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, metric) AS total FROM {name}_c),
{name}_t AS (SELECT *, min(bucket) FILTER (100 * upto >= 99 * total) OVER (PARTITION BY {keys}, metric) AS top FROM {name}_u),
{name}_q AS (SELECT {keys}, metric, any_value(total)::BIGINT AS n, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket + width) FILTER (4 * upto >= 3 * total) AS q3,
  sum(n * least(bucket, top))::BIGINT AS events FROM {name}_t GROUP BY {keys}, metric),
{name} AS (SELECT {keys}, metric, n, (q1 - 3 * (q3 - q1))::BIGINT AS low, (q3 + 3 * (q3 - q1))::BIGINT AS high, 1000 * events // n AS mean FROM {name}_q)"""

    wide = ", ".join(f"max({c}) FILTER (metric = '{m}') AS {c}_{m}" for m in _OP4_RATES for c in (("low", "high") if m == "word_length" else ("mean",)))
    fits = lambda m, k, of: f"(1e6::DOUBLE * ({k} - 3) - mean_{m}::DOUBLE * {of} <= 0 OR (1e6::DOUBLE * ({k} - 3) - mean_{m}::DOUBLE * {of}) ** 2 <= 9e6::DOUBLE * (mean_{m}::DOUBLE * {of}))"
    rates_fit = " AND ".join([fits("symbol_rate", "n_symbols", "n_words"), fits("dup_line_rate", "n_dup_lines", "n_lines"), fits("shout_rate", "n_shout", "word_chars"),
                              fits("repeat_rate", "(n_repeat_words::DOUBLE * n_lines / n_words)", "n_lines")])
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents
), w AS (
  SELECT row, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {SPACES})) > 0) AS ls FROM d
), p AS (
  SELECT row, unnest(ws) AS w0, unnest(range(len(ws))) AS i FROM w
), tri AS (
  SELECT row, i, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY row ORDER BY i)
), rep AS (
  SELECT row, i, (w2 IS NOT NULL AND count(*) OVER (PARTITION BY row, w0, w1, w2) > 1)::INT AS hit FROM tri
), cov AS (
  SELECT row, max(hit) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM rep
), n_rep AS (SELECT row, sum(hit) AS n FROM cov GROUP BY row), m AS (
  SELECT d.row, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_rep.n, 0)::BIGINT AS n_repeat_words,
    (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_shout
  FROM d JOIN w USING (row) LEFT JOIN n_rep USING (row)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM m
), vals AS ({rows}), s AS (SELECT *, (1::BIGINT << greatest(0, length(bin(v)) - 6)) AS width FROM vals),
sketch AS (SELECT lang, source, metric, v // width * width AS bucket, width, count(*) AS n FROM s GROUP BY ALL),
{fence("own", "lang, source")},{fence("whole", "lang")},
blend AS (
  SELECT o.lang, o.source, o.metric, (o.n * o.low + 8 * w.low) // (o.n + 8) AS low, (o.n * o.high + 8 * w.high) // (o.n + 8) AS high, (o.n * o.mean + 8 * w.mean) // (o.n + 8) AS mean
  FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang AND o.metric = w.metric
), lim AS (SELECT lang, source, {wide} FROM blend GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_length BETWEEN low_word_length AND high_word_length AND {rates_fit}, false) AS kept
FROM r LEFT JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source
"""


OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS sh FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
), half AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP7 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS h FROM documents
), by_source AS (SELECT source, sum(size)::BIGINT AS size FROM docs GROUP BY source), s1 AS (
  SELECT row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid, source, size, 2 * size AS cap, sum(size) OVER () AS all_size FROM by_source
), s2 AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1]::BIGINT AS w FROM s1), s3 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM s2
), s4 AS (SELECT *, 150 * all_size - 100 * before AS left_n, 100 * cap::HUGEINT * wrest <= w::HUGEINT * (150 * all_size - 100 * before) AS full_up FROM s3),
lev AS (SELECT left_n AS num, 100 * wrest AS den FROM s4 WHERE NOT full_up ORDER BY cap / w, sid LIMIT 1),
s5 AS (SELECT s4.*, coalesce(num, 0) AS num, coalesce(den, 1) AS den FROM s4 LEFT JOIN lev ON true), s6 AS (
  SELECT sid, source, size AS source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM s5
), k AS (SELECT greatest(1, least(256, (sum(source_size) * 150 // 100) // 131072))::BIGINT AS block FROM s6),
s7 AS (
  SELECT s6.*, greatest(1, (source_size + block - 1) // block, least(source_size, 64))::BIGINT AS n_blocks FROM s6, k
), s8 AS (
  SELECT *, greatest(1, source_size // n_blocks)::BIGINT AS base, (source_size % n_blocks)::BIGINT AS rem,
    floor(target * n_blocks / greatest(source_size, 1) * 1048576)::HUGEINT AS tn FROM s7
), s9 AS (SELECT *, (sum(tn) OVER ())::HUGEINT AS all_tn, (sum(tn) OVER (ORDER BY sid))::HUGEINT AS upto FROM s8),
many AS (SELECT greatest(1, (sum(tn) + 524288) // 1048576)::HUGEINT AS n FROM s8), far AS (
  SELECT n, greatest(1, n * 6180339887498948482 // 10000000000000000000)::HUGEINT AS g0 FROM many
), stp AS (SELECT n, min(g) AS g FROM (SELECT n, g0 + unnest(range(500)) AS g FROM far) WHERE gcd(g, n) = 1 GROUP BY n),
rng AS (SELECT sid, n_blocks, ((upto - tn) * n // all_tn)::BIGINT AS lo, (upto * n // all_tn)::BIGINT AS hi FROM s9, many WHERE all_tn > 0),
slots AS (SELECT t, t * g % n AS p FROM (SELECT n, g, unnest(range(n::BIGINT)) AS t FROM stp)), ranked AS (
  SELECT sid, n_blocks, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS r FROM slots JOIN rng ON p >= lo AND p < hi
), takes AS (SELECT sid, r % n_blocks AS b, count(*) AS times FROM ranked WHERE r < 2 * n_blocks GROUP BY ALL),
placed AS (
  SELECT docs.row, docs.doc_id, size, sid, source_size, target, base, rem,
    sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS a
  FROM docs JOIN s9 ON docs.source IS NOT DISTINCT FROM s9.source
), ends AS (
  SELECT row, sid, a, size, base, rem,
    CASE WHEN a < rem * (base + 1) THEN a // (base + 1) ELSE rem + (a - rem * (base + 1)) // base END AS first_b,
    CASE WHEN a + size - 1 < rem * (base + 1) THEN (a + size - 1) // (base + 1) ELSE rem + (a + size - 1 - rem * (base + 1)) // base END AS last_b
  FROM placed WHERE size > 0
), cut AS (SELECT *, unnest(range(first_b::BIGINT, (last_b + 1)::BIGINT)) AS b FROM ends),
got AS (
  SELECT row, sum((least(a + size, (cut.b + 1) * base + least(cut.b + 1, rem)) - greatest(a, cut.b * base + least(cut.b, rem))) * times) AS taken
  FROM cut JOIN takes ON takes.sid = cut.sid AND takes.b = cut.b GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN got USING (row)
"""

_KEY = "CASE WHEN {h} <> '' THEN {h} || '|' || {p} END"
_REST = "coalesce(CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) END, '')"
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


#: What the query states on its own: the rules, the longest first.
_OP9_RULES = [("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("block", "com", "/en/"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def _op9(pages: str = "pages") -> str:
    def case(then: str) -> str:
        return "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{then.format(v=v, h=h, p=p)}'" for v, h, p in _OP9_RULES) + " END"

    rule, verdict = case("{h}{p}"), case("{v}")
    host, path = f"translate(regexp_extract(rest, '^[^/?#]*'), {LOWER})", "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    seen = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g')"
    return rf"""
WITH RECURSIVE a AS (SELECT page_id, html, {_REST.format(u="url")} AS rest FROM {pages}), b AS (
  SELECT page_id, html, {host} AS host, {path} AS path FROM a
), c AS (SELECT *, {rule} AS rule, {verdict} AS ruled, {_KEY.format(h="host", p="path")} AS key FROM b),
tags AS (
  SELECT key, unnest(list_concat(
    list_transform(regexp_extract_all({seen}, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all({seen}, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS u FROM c
), t AS (SELECT key, {_REST.format(u="u")} AS rest FROM tags WHERE contains(u, '://')), t2 AS (SELECT key, {host} AS host, {path} AS path FROM t),
half AS (SELECT key, {_KEY.format(h="host", p="path")} AS other, {verdict} AS ruled FROM t2 WHERE key IS NOT NULL AND host <> ''), links AS (
  SELECT key AS a, other AS b FROM half UNION SELECT other, key FROM half
), nodes AS (SELECT key, ruled FROM c WHERE key IS NOT NULL UNION SELECT other, ruled FROM half), reach AS (
  SELECT DISTINCT key AS a, key AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), grp AS (SELECT a AS key, min(b) AS g FROM reach GROUP BY a), votes AS (
  SELECT g, bool_or(ruled = 'allow') AS allowed FROM nodes JOIN grp USING (key) WHERE ruled IS NOT NULL GROUP BY g
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN allowed = false THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN grp USING (key) LEFT JOIN votes USING (g)
"""


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (
  SELECT row, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (SELECT *, translate(trim(line, {SPACES}), {LOWER}) AS key FROM l), c AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (SELECT k.*, c.top IS NOT NULL AND c.top <> doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row
"""

#: Pages of which four in five name the next one, by canonical links and by redirects in turn; of the others every second
#: names an address that is no page, blocked or allowed, and all name another one in a comment.
LINKED_PAGES = """(SELECT p.page_id, p.url, CASE
WHEN p.page_id % 10 = 0 THEN '<!-- <link rel="canonical" href="http://a.org/es/commented"> --><link rel="canonical" href="http://gone.' || CASE WHEN p.page_id % 20 = 0 THEN 'org/es/' ELSE 'net/de/' END || p.page_id || '">'
WHEN p.page_id % 5 = 0 THEN '<!-- <link rel="canonical" href="http://a.org/es/commented"> -->' WHEN n.url IS NULL THEN NULL WHEN p.page_id % 2 = 0 THEN '<link rel="canonical" href="' || n.url || '">'
ELSE '<meta http-equiv="refresh" content="0; url=' || n.url || '">' END AS html FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1)"""


def _op12(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round."""

    def nearest(name: str, centroids: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(list_value(d, j)) AS best FROM (
    SELECT x.row, x.vec_id, x.v, c.j, list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM x CROSS JOIN {centroids} c
  ) GROUP BY row)"""

    steps = []
    for r in range(1, rounds + 1):
        steps.append(nearest(f"a{r}", f"c{r - 1}"))
        steps.append(f"""s{r} AS (
  SELECT j, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS v FROM (
    SELECT best[2] AS j, i, count(*)::HUGEINT AS n, sum(v[i])::HUGEINT AS s FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL) GROUP BY j
), c{r} AS MATERIALIZED (SELECT c.j, coalesce(s.v, c.v)::BIGINT[] AS v FROM c{r - 1} c LEFT JOIN s{r} s ON s.j = c.j)""")
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS j, v FROM x QUALIFY j < {k}
), {", ".join(steps)}, {nearest("f", f"c{rounds}")}
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.j = best[2]
"""


#: For each class of documents and each order, the place of the first filter that fails decides.
OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text), said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first < d.doc_id, false)} AS fails
  FROM d JOIN least USING (text) LEFT JOIN said ON said.doc_id = d.doc_id
), c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
  JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), w AS (
  SELECT c.*, o, list_transform(o, lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS in_order FROM c, o
), p AS (
  SELECT part, good, toxic, n, o, in_order, coalesce(nullif(list_position(in_order, true), 0), 9) AS gone, unnest([1, 2, 3, 4, 5]) AS step FROM w
), r AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS filter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
    sum(n) FILTER (gone < step AND in_order[step]) AS redundant, sum(n) FILTER (in_order[step] AND len(list_filter(in_order, lambda z: z)) = 1) AS unique_fails,
    sum(n) FILTER (gone = step AND good) AS good_lost, sum(n) FILTER (gone = step AND toxic) AS toxic_lost FROM p GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM r
"""

ORACLE_SQL = {
    "op12_centroids": _op12(), "op13_filter_audit": OP13,
    "url_redirects": _op9(LINKED_PAGES),
    "op1_embedding_dedup": OP1, "op4_quality": _op4(), "op6_minhash": OP6, "op7_mixing": OP7, "op9_url_filter": _op9(), "op10_line_dedup": OP10,
}
