"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, SEPARATORS, Rules


def quality_rules_sql(docs: str = "documents", rules: Rules = Rules(), columns: str = "") -> str:
    """Rows of op2; ``columns`` replaces the select list, for use within a longer statement."""
    stock = "(?i)" + "|".join(BOILERPLATE)
    separators = ", ".join(f"'{c}'" for c in sorted(SEPARATORS))
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    chars = "CAST(list_sum(list_transform({}, lambda x: length(x))) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, {words.format('t')} AS ws FROM d),
line0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
line1 AS (SELECT *, {words.format('line')} AS ws FROM line0),
line2 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, len(ws) AS n,
    {chars.format('ws')} AS wc,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym,
    len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS sym_words,
    len(list_filter(ws, lambda x: ends_with(x, '!!') OR ends_with(x, '??') OR ends_with(x, '!?'))) AS shout,
    len(list_filter(ws, lambda x: x IN ({separators}))) AS sep,
    coalesce({chars.format(r"regexp_extract_all(line, '\p{L}+')")}, 0) AS letters,
    coalesce({chars.format("regexp_extract_all(line, '[A-ZÀ-ÖØ-Þ]+')")}, 0) AS upper_letters,
    regexp_matches(line, '{stock}') AS stock,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutter
  FROM line1 WHERE len(ws) > 0),
line3 AS (
  SELECT doc_id, nth, wc,
    (n >= 2 AND sym > {rules.max_symbol_share} * wc AND sym_words > {rules.max_symbol_words} * n)
    OR (n >= 4 AND shout > {rules.max_shout_share} * n)
    OR (sep >= {rules.min_separators} AND n <= {rules.max_words_per_separator} * sep)
    OR (n >= 4 AND letters >= {rules.min_capital_letters} AND upper_letters > {rules.max_capital_share} * letters)
    OR (n <= {rules.max_boilerplate_words} AND stock)
    OR (n >= 8 AND stutter > {rules.max_stutter_share} * n) AS bad
  FROM line2),
by_line AS (
  SELECT doc_id, CAST(count(*) FILTER (nth > 1) AS BIGINT) AS dup, CAST(coalesce(sum(wc) FILTER (bad), 0) AS BIGINT) AS removed
  FROM line3 GROUP BY doc_id),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - {rules.window} + 2)) AS i, ws FROM w WHERE len(ws) > {rules.window}),
rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {rules.window - 1}], ' ')) AS c FROM win),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range({rules.window}) AS offsets(o) WHERE c > 1 GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce({chars.format('ws')}, 0) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(by_line.dup, 0) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(by_line.removed, 0) AS removed
  FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN covered USING (doc_id)),
verdict AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT {columns or f'''doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND removed <= {rules.max_removed_share} * word_chars AS kept'''}
FROM verdict"""


def warc_sql() -> str:
    """Rows of op8: base32 is spelt out from the hexadecimal SHA-1, twenty bits to four characters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = " || ".join(
        f"substr('{alphabet}', 1 + ((('0x' || substr(sha1(payload), {5 * k + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER, 1)" for k in range(8) for shift in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {chars} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f"""


def near_dedup_sql(size: int = 4, percent: int = 80) -> str:
    """Rows of op9: shingle sets, all pairs that share a shingle, and the least id reachable."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= {percent} * (na.n + nb.n - o)),
reach AS (SELECT a AS v, a AS seen FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.seen),
comp AS (SELECT v, min(seen) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON v = w.doc_id"""


def line_dedup_sql(percent: int = 80, least: int = 1) -> str:
    """Rows of op7: every line against all earlier ones, by shared tokens; the places are compared as a list."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split({lower}, chr(10))) AS line, unnest(range(len(string_split({lower}, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS id, len(ws) AS n FROM t WHERE len(ws) >= {least}),
firsts AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ws ORDER BY id) = 1),
tok AS (SELECT id, n, unnest(ws) AS w FROM firsts),
near AS (SELECT b.id FROM tok a JOIN tok b ON a.w = b.w AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
gone AS (SELECT doc_id, pos FROM k WHERE id NOT IN (SELECT id FROM firsts) OR id IN (SELECT id FROM near)),
g AS (SELECT doc_id, count(*) AS n, list_sort(list(CAST(pos AS INTEGER))) AS removed FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, coalesce(removed, []) AS removed
FROM documents d LEFT JOIN g USING (doc_id)"""


def phrase_index_sql(size: int = 10) -> str:
    """Rows of op13: all runs of words of the documents against those of the items, by the lengths that windows have."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {found} AS ws FROM documents),
b AS (SELECT item_id, {found} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, ws[i:i + {size - 1}] AS gram FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {size - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(gram) AS n FROM g),
runs AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
hit AS (SELECT r, i, runs.n, item_id FROM runs JOIN g ON g.gram = runs.ws[i:i + runs.n - 1]),
covered AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM hit, range({size}) AS offsets(o) WHERE o < n GROUP BY r),
listed AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""


def _integers(scale: int) -> str:
    """The kept vectors as integers."""
    return f"""
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


#: Squared distance of two lists, and the floor of a sum over a count.
_SQUARED = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def ball_kmeans_sql(clusters: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """Rows of op11 by plain rounds: every vector against every centroid."""
    steps = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM q ORDER BY h LIMIT {clusters}))"]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, k, q.v, {_SQUARED.format('q.v', 'c.v')} AS d FROM q, c{i} c)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, v, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS p(j) GROUP BY k, j)")
            steps.append(f"m{i} AS (SELECT k, list({_FLOOR} ORDER BY j) AS v FROM s{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"""
WITH {_integers(scale)},
{(',' + chr(10)).join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN q USING (r) JOIN c{rounds} c ON c.k = a.k"""


def heap_lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rows of op12 by plain rounds: every part against every entry of its codebook."""
    width = 64 // parts
    steps = [
        f"x AS MATERIALIZED (SELECT r, p, v[p * {width} + 1:(p + 1) * {width}] AS v FROM q, range({parts}) AS parts(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, p, k, x.v, {_SQUARED.format('x.v', 'c.v')} AS d FROM x JOIN c{i} c USING (p))")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, v, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT p, k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) AS places(j) GROUP BY p, k, j)")
            steps.append(f"m{i} AS (SELECT p, k, list({_FLOOR} ORDER BY j) AS v FROM s{i} GROUP BY p, k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT p, c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (p, k))")
    return f"""
WITH {_integers(scale)},
{(',' + chr(10)).join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN q USING (r)"""
