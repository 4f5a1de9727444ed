"""The same queries as SQL, where SQL can express them over whole tables.

None for secret scans (checksums), SentencePiece, language identification, fingerprints and HTML extraction:
tests hold those against brute force, the public implementation, exact round trips or held-out labels.
"""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ})"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    return (
        f"CASE WHEN {_host(url)} <> '' THEN lower(regexp_extract({url}, '(?s)^([^:/?#]*)://', 1)) || '://' || {_host(url)} || "
        f"CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END || regexp_extract({url}, '(?s)^[^#?]*(\\?[^#]*)', 1) END"
    )


_RULES = """(VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS rules(verdict, host, path)"""

_TAG = r"""(?is)<(?:link|meta)\b[^>]*\b(?:rel\s*=\s*["'']?canonical\b|http-equiv\s*=\s*["'']?refresh\b)[^>]*>"""
_HREF = r"""(?is)\b(?:href\s*=|content\s*=\s*["'']?[\s\d.]*[;,]\s*url\s*=)\s*["'']?\s*([^"''\s>]+)"""

URL_FILTER = f"""
WITH RECURSIVE tags AS (
  SELECT url, replace(regexp_extract(unnest(regexp_extract_all(html, '{_TAG}')), '{_HREF}', 1), '&amp;', '&') AS t FROM pages
), targets AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^([^:/?#]*)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^([^:/?#]*)://', 1) || '://' || {_host("url")} || t END AS t FROM tags
), e AS (
  SELECT {_node("url")} AS a, {_node("t")} AS b FROM targets
), edges AS (
  SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL
), reach(a, b) AS (
  SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), said AS (
  SELECT n.a, arg_max(rules.verdict, length(rules.host || rules.path)) AS v FROM (SELECT DISTINCT a FROM edges) n
  JOIN {_RULES} ON ({_host("n.a")} = rules.host OR ends_with({_host("n.a")}, '.' || rules.host)) AND starts_with({_path("n.a")}, rules.path)
  GROUP BY n.a
), decided AS (
  SELECT reach.a, min(v) AS by_alias FROM reach JOIN said ON reach.b = said.a GROUP BY reach.a
), ruled AS (
  SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, row_number() OVER () AS n FROM pages
), fit AS (
  SELECT n, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    arg_max(rules.verdict, length(rules.host || rules.path)) AS verdict
  FROM ruled JOIN {_RULES} ON (ruled.host = rules.host OR ends_with(ruled.host, '.' || rules.host)) AND starts_with(ruled.path, rules.path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, by_alias, 'allow') AS verdict,
  rule IS NULL AND by_alias IS NOT NULL AS aliases_decide
FROM ruled LEFT JOIN fit USING (n) LEFT JOIN decided ON {_node("url")} = decided.a
"""

CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS t,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS o FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(o) + length(t))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per
), weighed AS (
  SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM ranked
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fit AS (
  SELECT level AS l FROM levels WHERE level * weight <= most ORDER BY most / weight, rank LIMIT 1
), targets AS (
  SELECT source, rank, source_size, least(coalesce((SELECT l FROM fit) * weight, most), most) AS target FROM levels
), sums AS (
  SELECT coalesce(sum(target) FILTER (WHERE rank % 3 = 0), 0) AS s0, coalesce(sum(target) FILTER (WHERE rank % 3 = 1), 0) AS s1,
    coalesce(sum(target) FILTER (WHERE rank % 3 = 2), 0) AS s2 FROM targets
), placed AS (
  SELECT doc_id, d.source, size, source_size, target, rank,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM placed
), counted AS (
  SELECT *, (size * rounds + greatest(0, least(size, round(target)::BIGINT - rounds * source_size - ahead)))::BIGINT AS taken, ahead / target AS x FROM taken
), timed AS (
  SELECT *, CASE WHEN taken > 0 THEN CASE rank % 3 WHEN 0 THEN sqrt(0.25 + 2 * x) - 0.5 WHEN 1 THEN x
    ELSE (sqrt(greatest(0, 2.25 - 2 * x)) - 1.5) / -1 END END AS t FROM counted
)
SELECT doc_id, source, size, source_size, target, taken,
  floor(s0 * (0.5 * t + 0.5 * t * t) + s1 * t + s2 * (1.5 * t + -0.5 * t * t))::BIGINT AS position
FROM timed, sums
"""

DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w
), class AS (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT rep, n, unnest(s) AS g FROM class
), pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), low AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(low.low, class.rep, s.doc_id) AS component_id,
  s.doc_id = coalesce(low.low, class.rep, s.doc_id) AS kept
FROM s LEFT JOIN class ON s.s = class.s LEFT JOIN low ON class.rep = low.a
"""


_PARTS, _ENTRIES = 16, 64


def _vector_codes(rounds: int = 2) -> str:
    """Assignments and means written out round by round, over vectors of one length."""

    def assigned(k: int) -> str:
        square = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v)"
        return f"""assigned{k} AS (
  SELECT * FROM (SELECT p.rid, p.p, p.v, b.entry, {square} AS d FROM parts p JOIN books{k} b USING (p))
  QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, entry) = 1)"""

    def means(k: int) -> str:
        return f"""means{k} AS (
  SELECT p, entry, list(x ORDER BY place) AS v FROM (
    SELECT p, entry, place, floor(sum(v[place]) / count(*)) AS x
    FROM assigned{k - 1}, (SELECT unnest(range(1, max(len(v)) + 1)) AS place FROM parts) GROUP BY ALL) GROUP BY p, entry),
books{k} AS (
  SELECT p, entry, coalesce(m.v, b.v) AS v FROM books{k - 1} b LEFT JOIN means{k} m USING (p, entry))"""

    steps = [assigned(0)]
    for k in range(1, rounds + 1):
        steps += [means(k), assigned(k)]
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT rid, p, e[p * len(e) // {_PARTS} + 1 : (p + 1) * len(e) // {_PARTS}] AS v FROM kept, range({_PARTS}) r(p)
), books0 AS (
  SELECT p, entry, v FROM parts JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, e) - 1 AS entry FROM kept) USING (rid)
  WHERE entry < {_ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned{rounds} GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(x, ',' ORDER BY p, entry, place)) AS codebooks_sha256 FROM (
    SELECT p, entry, unnest(range(1, len(v) + 1)) AS place, unnest(list_transform(v, lambda x: x::BIGINT::VARCHAR)) AS x
    FROM books{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), digest"""


FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts
), masks AS (
  SELECT doc_id, part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM words
), judged AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), classes AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM masks LEFT JOIN judged USING (doc_id) GROUP BY ALL
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))), 0)::INT AS before
  FROM orders, range(1, 6) s(step)
), counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND toxic), 0) AS toxic_lost
  FROM classes, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""

# Bytes as pairs of hexadecimal digits, so that they can be cut anywhere.
REPEATED_PASSAGES = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT rid, i, md5(substring(h, 2 * i + 1, 400)) AS w
  FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM texts)
), repeated AS (
  SELECT rid, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)
), runs AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT rid, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run
    FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM repeated)) GROUP BY rid, run
), edges AS (
  SELECT rid, coalesce(lag(b) OVER o, 0) AS a, a AS b, b - a AS gone FROM runs WINDOW o AS (PARTITION BY rid ORDER BY a)
), kept AS (
  SELECT rid, h, doc_id, a, b, gone FROM texts JOIN edges USING (rid)
  UNION ALL SELECT rid, h, doc_id, coalesce((SELECT max(b) FROM runs WHERE runs.rid = texts.rid), 0), len(h) // 2, NULL FROM texts)
SELECT any_value(doc_id) AS doc_id, any_value(len(h)) // 2 AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed,
  count(gone) AS n_spans, sha256(unhex(string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a))) AS kept_sha256
FROM kept GROUP BY rid
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_top_k": TOP_K,
        "op5_url_filter": URL_FILTER,
        "op6_chat_format": CHAT,
        "op9_mix": MIX,
        "op10_minhash_dedup": DEDUP,
        "op11_vector_codes": _vector_codes(),
        "op12_filter_audit": FILTER_AUDIT,
        "op13_repeated_passages": REPEATED_PASSAGES,
    }
