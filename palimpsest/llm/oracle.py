"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

from .secrets import KINDS

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(vertices: str, edges: str) -> str:
    """CTEs reach and comp: the least vertex that edges (a, b), both ways, reach."""
    return f"""
    reach(v, u) AS (
      SELECT {vertices}, {vertices} FROM rows
      UNION
      SELECT r.v, e.b FROM reach r JOIN {edges} e ON r.u = e.a),
    comp AS (SELECT v, min(u) AS component FROM reach GROUP BY v)"""


NGRAM_ROWS = f"""
    words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        {_LOWER.format(t="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM {{docs}}),
    rows AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i+3], 'string_agg', ' ')) END) AS s
      FROM words),
    grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM rows),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) AS n, any_value(y.n) AS m
      FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    edges AS (SELECT a, b FROM common WHERE 100 * i >= 85 * (n + m - i)),"""

OP6 = f"""
    WITH RECURSIVE {NGRAM_ROWS.format(docs="documents")}
    {_components("doc_id", "edges")}
    SELECT r.doc_id, CAST(len(r.s) AS BIGINT) AS n_shingles, c.component AS component_id
    FROM rows r JOIN comp c ON r.doc_id = c.v
"""

_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
    WITH docs AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM documents),
    items AS (
      SELECT item_id, w, least(10, len(w)) AS n
      FROM (SELECT item_id, {_WORDS.format(t=_LOWER.format(t="coalesce(text, '')"))} AS w FROM benchmark)
      WHERE len(w) > 0),
    win AS (
      SELECT DISTINCT item_id, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS p, n
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
    grams AS (
      SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS p
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM docs, (SELECT DISTINCT n FROM win))),
    hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.p = win.p AND g.n = win.n),
    hit AS (
      SELECT doc_id, count(DISTINCT x) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
      coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _kind(rank: int, name: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
      SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, a AS start, a + length(m[i]) AS stop, v[i] AS value
      FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, source, string_split_regex(text, {p}) AS g,
                          regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS v
                        FROM documents WHERE text IS NOT NULL)))
      WHERE length(v[i]) >= {least}"""


OP5 = f"""
    WITH spans AS ({" UNION ALL ".join(_kind(i, k.name, k.pattern, k.group, k.least) for i, k in enumerate(KINDS))}),
    said AS (SELECT *, kind || ':' || start || ':' || stop AS s FROM spans),
    owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n FROM spans GROUP BY value),
    per AS (
      SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
        string_agg(s, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (n <= 1) AS n_live, count(*) FILTER (n > 1) AS n_copied
      FROM said JOIN owners USING (value) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
      coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
      coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM documents d LEFT JOIN per USING (doc_id)
"""

OP7 = """
    WITH rows AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
    owners AS (SELECT h, max(page_id) AS owner FROM rows WHERE n >= 1000 GROUP BY h HAVING count(*) > 1)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(rows.h) AS payload_digest,
      CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN owner <> page_id THEN owner END AS refers_to
    FROM rows LEFT JOIN owners ON rows.h = owners.h
"""

OP8 = f"""
    WITH RECURSIVE rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    fit AS (
      SELECT * FROM rows WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e <> 0)) > 0
        AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    edges AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
    {_components("vec_id", "edges")},
    links AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
    SELECT r.vec_id, coalesce(n, 0) AS n_links, c.component AS component_id, c.component = r.vec_id AS kept
    FROM rows r JOIN comp c ON r.vec_id = c.v LEFT JOIN links ON links.a = r.vec_id
"""

OP11 = """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    scored AS (
      SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s
      FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
      SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
    SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id,
      p.s AS positive_score, n.s AS negative_score
    FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
    WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)
    QUALIFY row_number() OVER w <= 10
"""

# Pages of the given tables hold one article of plain paragraphs and few kinds of references.
OP12 = r"""
    WITH blocks AS (
      SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
        '</?(?:p|h1|article)>') AS b FROM pages),
    plain AS (
      SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(
          replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
            '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&copy;', '©'), '&middot;', '·'),
          '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b
      FROM blocks)
    SELECT page_id, url, coalesce(array_to_string(b, chr(10)), '') AS text,
      CAST(length(coalesce(array_to_string(b, chr(10)), '')) AS BIGINT) AS n_chars
    FROM plain
"""

# CRC-32 of the digits, bit by bit; then all pairs of equal words, whose stretches per distance are runs.
OP13 = """
    WITH hashed AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
          lambda x, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
            lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, b)), 4294967295),
          4294967295) AS h
      FROM documents),
    placed AS (
      SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM hashed),
    planted AS (
      SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
    words AS (
      SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS x
      FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
    pairs AS (
      SELECT doc_id, l.i, r.i - l.i AS q FROM words l JOIN words r USING (doc_id, x) WHERE l.i < r.i),
    stretches AS (
      SELECT doc_id, q, min(i) AS s, count(*) + q AS l
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs)
      GROUP BY doc_id, q, g HAVING count(*) >= greatest(12 - q, q)),
    runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches GROUP BY ALL),
    best AS (
      SELECT doc_id, count(*) AS n_runs, min((-l, s, q)) AS b,
        string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said
      FROM runs GROUP BY doc_id),
    kept AS (
      SELECT w.doc_id, string_agg(x, ' ' ORDER BY i) AS t
      FROM words w ANTI JOIN (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs) USING (doc_id, i)
      GROUP BY w.doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b[2] AS BIGINT) AS start, CAST(-b[1] AS BIGINT) AS length,
      CAST(b[3] AS BIGINT) AS period, CAST(-1000 * b[1] // b[3] AS BIGINT) AS exponent_milli,
      sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": OP2,
    "op5_secret_scans": OP5,
    "op6_ngram_join": OP6,
    "op7_warc_packages": OP7,
    "op8_vector_graph": OP8,
    "op11_cover_tree": OP11,
    "op12_tag_path_ratios": OP12,
    "op13_periodic_runs": OP13,
}
