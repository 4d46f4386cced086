"""DuckDB SQL of the operators that SQL can express, over the same tables.

Written from the definitions (all word runs, whole trees, all proofs), not
from the plans of the operators; meant for small tables.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), 10) AS k FROM items WHERE len(w) > 0))
),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents
),
grams AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
),
hits AS (SELECT DISTINCT rid, g.k, i, item_id FROM grams g JOIN windows v ON g.k = v.k AND g.gram = v.gram),
words AS (
  SELECT rid, count(DISTINCT place) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM hits) GROUP BY rid
),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents
),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)
),
f AS (SELECT lang, gram, any_value(k) AS k, count(*) AS a FROM grams GROUP BY lang, gram),
candidates AS (SELECT *, string_split(gram, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
holders AS (
  SELECT lang, part, max(a) AS more
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part
),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN holders h ON c.lang = h.lang AND c.gram = h.part
  WHERE h.more IS NULL OR 100 * h.more < 50 * c.a
),
cuts AS (
  SELECT c.lang, c.gram, c.a, t.cut, l.a AS l, r.a AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM kept c, (VALUES (1), (2)) AS t(cut), f l, f r
  WHERE t.cut < c.k AND l.lang = c.lang AND r.lang = c.lang
    AND l.gram = array_to_string(c.w[1:t.cut], ' ') AND r.gram = array_to_string(c.w[t.cut + 1:], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best)
SELECT lang, rank, gram AS phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


# Every 400-byte string by its digest; runs of strings that occur twice, merged and cut out.
REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, b, unnest(range(0, octet_length(b) - 399)) AS i FROM docs),
windows AS (SELECT rid, i, md5(b[i + 1:i + 400]) AS h FROM starts),
twice AS (SELECT rid, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
islands AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS island
  FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM twice)
),
spans AS (SELECT rid, island, min(i) AS s, max(i) + 400 AS e FROM islands GROUP BY rid, island),
gaps AS (
  SELECT rid, s, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY s) AS before FROM spans
),
cut AS (
  SELECT rid, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, max(e) AS tail,
         list(b[before + 1:s] ORDER BY s) AS kept
  FROM gaps JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(kept, lambda x, y: x || y) || b[tail + 1:] END) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, base: str) -> str:
    """All nodes of the trees of ``base`` (tree, pos, n, h)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, h FROM {base}
  UNION ALL
  SELECT a.tree, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM {name} a LEFT JOIN {name} b ON a.tree = b.tree AND b.pos = a.pos + 1
  WHERE a.n > 1 AND a.pos % 2 = 0
)"""


def _paths(name: str, nodes: str, base: str) -> str:
    """The siblings of every leaf of ``base``, in order: their side and digest, ``-`` for none."""
    return f"""{name} AS (
  SELECT b.tree, b.pos, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < (b.pos >> l.level) THEN 'L' || s.h ELSE 'R' || s.h END
                             ORDER BY l.level) FILTER (WHERE l.level IS NOT NULL) AS path
  FROM {base} b
  LEFT JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE n > 1) l ON l.tree = b.tree
  LEFT JOIN {nodes} s ON s.tree = b.tree AND s.level = l.level AND s.pos = xor(b.pos >> l.level, 1)
  GROUP BY b.tree, b.pos
)"""


# CRC-32 of the decimal doc_id: bit by bit, reflected polynomial 0xEDB88320.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

MANIFEST = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_leaf()} AS h,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(CAST(n_chars AS HUGEINT) + 1)")} END AS other
  FROM documents
),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM rows
),
{_levels("nodes", "leaves")},
subroots AS (
  SELECT 0 AS tree, tree AS pos, (SELECT count(DISTINCT tree) FROM leaves) AS n, h FROM nodes WHERE nodes.n = 1
),
{_levels("above", "subroots")},
{_paths("low", "nodes", "leaves")},
{_paths("high", "above", "subroots")},
whole AS (
  SELECT v.doc_id, v.h AS leaf, coalesce(v.other, v.h) AS now, s.h AS subroot, (SELECT h FROM above WHERE above.n = 1) AS root,
         list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM leaves v JOIN low ON low.tree = v.tree AND low.pos = v.pos
  JOIN subroots s ON s.pos = v.tree JOIN high ON high.pos = v.tree
),
folded AS (
  SELECT *, list_reduce(list_prepend(now, path), lambda acc, e: CASE WHEN e[1] = 'L' THEN sha256(e[2:] || acc)
                        WHEN e[1] = 'R' THEN sha256(acc || e[2:]) ELSE sha256(acc) END) AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda e: CASE WHEN e = '-' THEN '' ELSE e[2:] END), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_winnowing_decontamination": CONTAMINATION,
        "op10_suffix_repeats": REPEATS,
        "op12_phrase_collocations": COLLOCATIONS,
        "op13_merkle_manifest": MANIFEST,
    }
