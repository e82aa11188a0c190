"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

_SIZES = r"""
sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
)"""

# Targets: sources are filled up in the order of 3 * size / weight; the level
# is the first one that the next source's limit does not stop.
OP2 = f"""
WITH {_SIZES},
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM totals
),
filled AS (
  SELECT *, sum(cap) OVER o - cap AS spent, sum(w) OVER () - (sum(w) OVER o - w) AS free,
         sum(source_size) OVER () AS everything
  FROM weighed
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
level AS (
  SELECT arg_min((everything - spent)::DOUBLE / free::DOUBLE, spent) FILTER
           (WHERE (everything - spent)::DOUBLE / free::DOUBLE <= cap::DOUBLE / w) AS level
  FROM filled
),
targets AS (
  SELECT source, source_size, least(level * w, cap::DOUBLE) AS target,
         ('0x' || substr(md5('0:' || coalesce(source, chr(0))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS shift
  FROM filled, level
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.h, s.doc_id) - 1 AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
counted AS (
  SELECT *, (floor(rate * (place + 1) + shift) - floor(rate * place + shift))::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""

OP3 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

OP5 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""

OP7 = """
WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (
  SELECT doc_id, n, s, substr(x, (2 * s + 1)::BIGINT, 200) AS w
  FROM (SELECT doc_id, n, x, unnest(range(0, greatest(n - 99, 0))) AS s FROM b)
),
later AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY md5(w) ORDER BY doc_id, s) AS k FROM strings
  ) WHERE k > 1
),
marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM later
),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS lo, max(s) + 100 AS hi FROM numbered GROUP BY doc_id, span),
edges AS (
  SELECT doc_id, lo, hi FROM spans
  UNION ALL SELECT doc_id, n, n FROM b
),
pieces AS (
  SELECT e.doc_id, e.lo, substr(x, (2 * coalesce(lag(e.hi) OVER w, 0) + 1)::BIGINT,
                                (2 * (e.lo - coalesce(lag(e.hi) OVER w, 0)))::BIGINT) AS kept
  FROM edges e JOIN b USING (doc_id)
  WINDOW w AS (PARTITION BY e.doc_id ORDER BY e.lo, e.hi)
),
kept AS (SELECT doc_id, sha256(unhex(string_agg(kept, '' ORDER BY lo))) AS h FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo) AS r, count(*) AS c FROM spans GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, h AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


def _url_levels(depth: int) -> str:
    """The template tree level by level: frequent segments stay or are merged
    with siblings of a like labelled share, rare ones become wildcards."""
    levels = []
    for k in range(depth):
        levels.append(f"""
b{k} AS (SELECT host, template, parts[{k + 1}] AS part, sum(n) AS n, sum(a) AS a, sum(b) AS b
  FROM s{k} WHERE len(parts) > {k} GROUP BY ALL),
p{k} AS (SELECT host, template, sum(n) AS all_n, sum(a) AS all_a, sum(b) AS all_b FROM b{k} GROUP BY ALL),
n{k} AS (
  SELECT host, template, part, CASE
    WHEN n < 3 OR n < 0.1::DOUBLE * all_n THEN '*'
    WHEN a + b = 0 THEN '{{unknown}}'
    WHEN abs(a::DOUBLE / (a + b) - all_a::DOUBLE / (all_a + all_b)) > 1.96::DOUBLE * sqrt(
           all_a::DOUBLE / (all_a + all_b) * (1 - all_a::DOUBLE / (all_a + all_b)) / (a + b))
      OR (all_a > 0 AND all_b > 0 AND (a = 0 OR b = 0)) THEN part
    ELSE '{{alike}}' END AS name
  FROM b{k} JOIN p{k} USING (host, template)
),
s{k + 1} AS (
  SELECT s.* REPLACE (CASE WHEN len(parts) > {k} THEN s.template || '/' || name ELSE s.template END AS template)
  FROM s{k} s LEFT JOIN n{k} m ON s.host = m.host AND s.template = m.template AND s.parts[{k + 1}] = m.part
)""")
    return ",".join(levels)


OP8 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
raw AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
page AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM raw
),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM page
),
judged AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ruled),
s0 AS (
  SELECT host, path, count(*) AS n, count(*) FILTER (own = 'allow') AS a, count(*) FILTER (own = 'block') AS b,
         list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, 8) AS parts, '' AS template
  FROM judged GROUP BY host, path
),{_url_levels(8)},
leaf AS (
  SELECT host, template, (sum(a) + 2.0::DOUBLE * 0.7::DOUBLE) / (sum(a) + sum(b) + 2.0::DOUBLE) AS purity FROM s8 GROUP BY ALL
),
verdict AS (SELECT s.host, s.path, purity FROM s8 s JOIN leaf USING (host, template))
SELECT page_id, j.host, j.path, rule, coalesce(own, CASE WHEN purity < 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN verdict v ON j.host = v.host AND j.path = v.path
"""

# Masks per document, then every order and step of the five filters.
OP11 = r"""
WITH RECURSIVE texts AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
         coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
  FROM documents d
  LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic
             FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
),
words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts
),
masks AS (
  SELECT part, good, toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM words
),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM masks GROUP BY part, mask
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
prefixes AS (
  SELECT '' AS o, 0 AS used, 0 AS bit, 0 AS step
  UNION ALL
  SELECT o || f, used + b, b, step + 1 FROM prefixes, letters WHERE used & b = 0
),
steps AS (
  SELECT full_.o AS filter_order, p.step, p.bit, p.used - p.bit AS earlier
  FROM prefixes full_ JOIN prefixes p ON full_.step = 5 AND p.step > 0 AND starts_with(full_.o, p.o)
),
results AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (WHERE mask & (bit | earlier) = 0) AS kept,
         sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS removed,
         sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0) AS redundant,
         sum(n) FILTER (WHERE mask = bit) AS unique_fails,
         sum(n_good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS good_lost,
         sum(n_toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM results
"""


def _merkle(depth: int) -> str:
    """The tree level by level; sources of up to 3^depth documents, and as
    many sources."""

    def level(name: str, k: int) -> str:
        # Single nodes are carried along unchanged.
        return f"""
{name}{k + 1} AS (
  SELECT g, pos // 3 AS pos, (max(n) + 2) // 3 AS n,
         CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {name}{k} GROUP BY g, pos // 3
)"""

    def siblings(name: str, k: int, place: str) -> str:
        return f"""
{name}_s{k} AS (
  SELECT a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r, max(a.n) > 1 AS up
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 3 = b.pos // 3
  GROUP BY a.g, a.pos
)"""

    ctes = [
        r"""
leaves AS (
  SELECT doc_id, source,
         CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
           || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
           || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut
  FROM documents
)""",
        "n0 AS (SELECT doc_id, g, h, cut, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]
    for k in range(depth):
        ctes += [siblings("n", k, "pos"), level("n", k)]
    ctes.append(
        f"t0 AS (SELECT 'all' AS g, g AS source_key, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM n{depth})"
    )
    for k in range(depth):
        ctes += [siblings("t", k, "pos"), level("t", k)]
    joins, folds, proof = [], "start_h", []
    for k in range(depth):
        joins.append(f"LEFT JOIN n_s{k} a{k} ON a{k}.g = n0.g AND a{k}.pos = n0.pos // {3**k} AND a{k}.up")
    for k in range(depth):
        joins.append(f"LEFT JOIN t_s{k} b{k} ON b{k}.pos = t0.pos // {3**k} AND b{k}.up")
    names = [f"{x}{k}" for x in "ab" for k in range(depth)]
    proof = " || ".join(f"coalesce({n}.l || {n}.r, '')" for n in names)
    sides = ", ".join(f"{n}.l AS {n}l, {n}.r AS {n}r" for n in names)
    ctes.append(f"""
met AS (
  SELECT n0.doc_id, n0.h AS leaf, t0.h AS subroot, (SELECT h FROM t{depth}) AS root, sha256({proof}) AS proof_sha256,
         CASE WHEN c.sum % 2 = 0 THEN n0.cut ELSE n0.h END AS f_0, {sides}
  FROM n0 JOIN t0 ON t0.source_key = n0.g LEFT JOIN sums c ON c.doc_id = n0.doc_id {" ".join(joins)}
)""")
    for k, n in enumerate(names):
        before = "met" if k == 0 else f"fold{k}"
        ctes.append(
            f"fold{k + 1} AS (SELECT *, CASE WHEN {n}l IS NULL THEN f_{k} ELSE sha256({n}l || f_{k} || {n}r) END AS f_{k + 1} FROM {before})"
        )
    # DuckDB has no crc32: byte by byte over the decimal digits.
    crc = """
RECURSIVE table_ AS (
  SELECT b, b AS v, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM table_ WHERE k < 8
),
bytes AS (SELECT b, v FROM table_ WHERE k = 8),
digits AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT d.doc_id, d.s, d.k + 1, xor(d.v >> 8, b.v)
  FROM digits d JOIN bytes b ON b.b = xor(d.v & 255, ascii(substr(d.s, d.k + 1, 1))::BIGINT)
  WHERE d.k < length(d.s)
),
sums AS (SELECT doc_id, xor(v, 4294967295) AS sum FROM digits WHERE k = length(s))"""
    last = len(names)
    return f"""
WITH {crc}, {", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f_{last} AS folded_root, f_{last} = root AS verified FROM fold{last}
"""


OP12 = _merkle(7)

OP13 = """
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY t)
"""

ORACLES = {
    "op2_source_mixing": OP2,
    "op3_embedding_near_dedup": OP3,
    "op5_warc_archive": OP5,
    "op7_suffix_dedup": OP7,
    "op8_url_filter": OP8,
    "op11_filter_audit": OP11,
    "op12_merkle_manifest": OP12,
    "op13_exact_dedup": OP13,
}
