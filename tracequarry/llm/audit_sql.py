"""SQL of the dataset audits: the Merkle manifest and the divergence of sources."""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: xor(crc >> 8, list_reduce(list_prepend((xor(crc, b) & 255)::BIGINT, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))), 4294967295::BIGINT) % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END AS altered FROM documents),
f AS (
  SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM d),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS now FROM f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM l),
nodes AS (
  SELECT grp, 0 AS level, slot AS place, n, leaf AS h FROM ranked
  UNION ALL
  SELECT grp, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY grp, level, place // 3, n),
tops AS (SELECT grp, level AS height, h FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS level, grp AS place, (SELECT count(*) FROM tops) AS n, h FROM tops
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM over WHERE n > 1 GROUP BY level, place // 3, n),
way AS (
  SELECT r.grp, r.slot, r.now, k.level, CAST(r.slot // CAST(power(3, k.level) AS BIGINT) AS BIGINT) AS place FROM ranked r JOIN (SELECT DISTINCT grp, level FROM nodes WHERE n > 1) k USING (grp)),
up AS (SELECT t.grp, k.level, CAST(t.grp // CAST(power(3, k.level) AS BIGINT) AS BIGINT) AS place FROM tops t, (SELECT DISTINCT level FROM over WHERE n > 1) k),
beside AS (
  SELECT w.grp, w.slot, w.level, string_agg(CASE WHEN s.place < w.place THEN s.h END, '' ORDER BY s.place) AS a, string_agg(CASE WHEN s.place > w.place THEN s.h END, '' ORDER BY s.place) AS b
  FROM way w LEFT JOIN nodes s ON s.grp = w.grp AND s.level = w.level AND s.place // 3 = w.place // 3 AND s.place <> w.place GROUP BY w.grp, w.slot, w.level
  UNION ALL
  SELECT r.grp, r.slot, t.height + g.level, g.a, g.b FROM ranked r JOIN tops t USING (grp) JOIN (
    SELECT u.grp, u.level, string_agg(CASE WHEN s.place < u.place THEN s.h END, '' ORDER BY s.place) AS a, string_agg(CASE WHEN s.place > u.place THEN s.h END, '' ORDER BY s.place) AS b
    FROM up u LEFT JOIN over s ON s.level = u.level AND s.place // 3 = u.place // 3 AND s.place <> u.place GROUP BY u.grp, u.level) g USING (grp)),
proofs AS (SELECT grp, slot, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY level) AS proof FROM beside GROUP BY grp, slot),
fold AS (
  SELECT grp, slot, 0 AS level, now AS h FROM ranked
  UNION ALL
  SELECT f.grp, f.slot, f.level + 1, sha256(coalesce(b.a, '') || f.h || coalesce(b.b, '')) FROM fold f JOIN beside b USING (grp, slot, level)),
ends AS (SELECT grp, slot, arg_max(h, level) AS folded_root FROM fold GROUP BY grp, slot),
root AS (SELECT h AS root FROM over WHERE n = 1)
SELECT r.doc_id, r.leaf, t.h AS subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM ranked r JOIN tops t USING (grp) JOIN ends e USING (grp, slot) LEFT JOIN proofs p USING (grp, slot), root
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cells c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * s.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cells c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranks WHERE part = 'pair' OR rank <= 10
"""
