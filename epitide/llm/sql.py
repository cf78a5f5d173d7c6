"""DuckDB SQL for the registered queries, where SQL can express them on whole tables.

The other queries are tested against brute force, the tokenizers library or held-out accuracy.
"""

from __future__ import annotations

from epitide.llm.secret_scan import ACCESS, ALLOWED, ALLOWED_INSIDE, ASSIGN, ASSIGNED_AT_LEAST, CLASSES, HEX, KINDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(kind: str, pattern: str, group: int = 0, at_least: int = 1) -> str:
    """Rows (doc_id, k, start, stop, s) of the leftmost matches of a pattern in every text."""
    p = quoted(pattern)
    return f"""
  SELECT doc_id, row_id, {quoted(kind)} AS kind, start, start + length(s) AS stop, s FROM (
    SELECT doc_id, row_id, s, v,
           sum(length(gap)) OVER w + coalesce(sum(length(s)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, row_id, unnest(range(len(found))) AS i, unnest(found) AS s, unnest(vals) AS v,
                 unnest(pieces[1:len(found)]) AS gap
          FROM (SELECT doc_id, row_id, regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {group}) AS vals,
                       string_split_regex(t, {p}) AS pieces FROM texts))
    WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING))
  WHERE length(v) >= {at_least}"""


def secret_sql() -> str:
    base = " UNION ALL ".join([spans("assign", ASSIGN, 2, ASSIGNED_AT_LEAST), spans("access", ACCESS), spans("hex", HEX)])
    allowed = " AND ".join(f"NOT regexp_matches(s, {quoted(p)})" for p in ALLOWED)

    def inside(w):
        return " AND ".join(f"NOT regexp_matches(substr(s, pos + 1, {w}), {quoted(p)})" for p in ALLOWED_INSIDE)

    hot = []
    for c in CLASSES:
        hot.append(f"""
  SELECT doc_id, row_id, start, stop, '{c.name}' AS class, {c.window} AS w, pos FROM (
    SELECT doc_id, row_id, start, stop, pos, ch, count(*) AS n FROM (
      SELECT doc_id, row_id, start, stop, pos, s, substr(s, pos + unnest(range(1, {c.window} + 1)), 1) AS ch FROM (
        SELECT doc_id, row_id, start, stop, s, unnest(range(length(s) - {c.window} + 1)) AS pos
        FROM ({spans("entropy", c.run)}) WHERE {allowed}) WHERE {inside(c.window)})
    GROUP BY ALL)
  GROUP BY doc_id, row_id, start, stop, pos HAVING sum(CAST(round(n * log2(n) * 1000000) AS BIGINT)) <= {c.most}""")
    kinds = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    total = "list_transform(list_sort(list({'start': start, 'rank': list_position(" + kinds + ", kind), 'stop': stop})), " \
            "lambda x: concat_ws(':', " + kinds + "[x.rank], x.start, x.stop))"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
hot AS ({" UNION ALL ".join(hot)}),
islands AS (
  SELECT doc_id, row_id, start + min(pos) AS start, start + max(pos) + max(w) AS stop FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY row_id, start, class ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY row_id, start, class ORDER BY pos) <= w THEN 0 ELSE 1 END AS fresh FROM hot))
  GROUP BY doc_id, row_id, start, class, island),
more AS (SELECT DISTINCT doc_id, row_id, 'entropy' AS kind, start, stop FROM islands),
b AS (SELECT row_id, {counts}, array_to_string({total}, ',') AS spans FROM base GROUP BY row_id),
a AS (SELECT row_id, array_to_string({total}, ',') AS spans
      FROM (SELECT row_id, kind, start, stop FROM base UNION ALL SELECT row_id, kind, start, stop FROM more) GROUP BY row_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM texts t LEFT JOIN b USING (row_id) LEFT JOIN a USING (row_id)"""


CONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
windows AS (
  SELECT row_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (
    SELECT row_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n)),
hits AS (SELECT row_id, windows.n, i, item_id FROM windows JOIN tests USING (gram)),
words AS (
  SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY row_id),
named AS (SELECT row_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(CAST(len(ids) AS BIGINT), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN named USING (row_id)"""

REPEATS = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT row_id, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS gram FROM (
    SELECT row_id, doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
earliest AS (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram),
gone AS (
  SELECT DISTINCT row_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN earliest USING (gram)
  WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
words AS (SELECT row_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
stay AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (row_id, pos) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stay USING (row_id)"""

EMBEDDINGS = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding IS NOT NULL AND label IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))), 1) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.ok AND b.ok AND list_cosine_similarity(CASE WHEN a.ok AND b.ok THEN a.v ELSE [1.0] END, CASE WHEN a.ok AND b.ok THEN b.v ELSE [1.0] END) >= 0.93),
reach(node, other) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
groups AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN groups ON vec_id = node LEFT JOIN counts ON vec_id = a"""

PREFIX_TRIE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), md5(coalesce(text, ''))) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'k': md5(length(r) || ':' || r || x), 'b': CAST(strlen(x) AS BIGINT)} ORDER BY no) AS s FROM turns GROUP BY conv_id),
h AS (
  SELECT conv_id, s, conv_id - conv_id % 5 AS first,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, crc),
whole AS (
  SELECT h.conv_id, list_concat(coalesce(f.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own f ON f.conv_id = h.first),
prefixes AS (
  SELECT conv_id, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) AS node, d = len(s) AS last, s[d].b AS b,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), ',')) END AS parent
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent,
         CASE WHEN d > 0 THEN (count(*) - 1) * any_value(b) ELSE 0 END AS own,
         sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT p.d, p.node, sum(n.own) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d LEFT JOIN children c ON c.d = n.d AND c.node = n.node GROUP BY p.d, p.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (d, node) LEFT JOIN children c USING (d, node) LEFT JOIN nodes up ON up.d = n.d - 1 AND up.node = n.parent"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
         CAST('0x' || x[17:24] AS BIGINT) % 100 AS rate, CAST('0x' || x[25:32] AS BIGINT) % 100 AS spm FROM d),
f AS (
  SELECT doc_id, t, n, least(a, b) AS low, greatest(a, b) AS high,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR rate >= 90 THEN 'plain'
              WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1, n - high) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

SQL: dict[str, str] = {
    "op4_secret_scan": secret_sql(),
    "op7_spherical_caps": EMBEDDINGS,
    "op8_decontamination": CONTAMINATION,
    "op10_fm_index": REPEATS,
    "op12_sequence_collapse": PREFIX_TRIE,
    "op13_displacement_scatter": FILL_IN_MIDDLE,
}
