"""SQL that gives the rows of text queries."""

LINE_DEDUP = r"""
WITH split_lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM split_lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), counted AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS upto, sum(words) OVER (PARTITION BY doc_id ORDER BY k) - words AS before, max(k) OVER (PARTITION BY doc_id) AS last, sum(words) OVER (PARTITION BY doc_id) AS total
  FROM (SELECT *, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) AS words FROM lines)
), bounds AS (
  SELECT *, min(k) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 50 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
    max(k) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND 50 PRECEDING) AS earlier FROM counted
), runs AS (
  SELECT doc_id, k AS s, CASE WHEN later IS NOT NULL THEN later - 1 WHEN total - before >= 50 THEN last END AS e FROM bounds
  UNION
  SELECT doc_id, CASE WHEN earlier IS NOT NULL THEN earlier + 1 WHEN upto >= 50 THEN 1 END AS s, k AS e FROM bounds
), keyed AS (
  SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.k) AS run
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.k BETWEEN r.s AND r.e WHERE r.s IS NOT NULL AND r.e IS NOT NULL GROUP BY r.doc_id, r.s, r.e
), later_runs AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM keyed) WHERE nth > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM later_runs r JOIN lines l ON l.doc_id = r.doc_id AND l.k BETWEEN r.s AND r.e
), rest AS (
  SELECT s.doc_id, string_agg(s.raw, chr(10) ORDER BY s.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
  FROM split_lines s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos GROUP BY s.doc_id
), sizes AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(r.n_removed, 0) < coalesce(n.n_lines, 0) OR coalesce(n.n_lines, 0) = 0 AS kept,
  md5(CASE WHEN r.n_removed > 0 THEN coalesce(r.text, '') ELSE d.text END) AS text_md5
FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id LEFT JOIN sizes n ON n.doc_id = d.doc_id
"""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all("""
    + LOWER.format("coalesce(text, '')")
    + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(w[k:k + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM w WHERE len(w) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM ends UNION SELECT reach.doc_id, ends.b FROM reach JOIN ends ON ends.a = reach.r),
least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id, coalesce(least.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id
"""
)

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

_BENCH_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {_BENCH_WORDS}) AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {_BENCH_WORDS}) AS w FROM benchmark)),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i WHERE n > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths)),
hits AS (SELECT r.doc_id, r.k, r.n, x.item_id FROM runs r JOIN windows x ON x.n = r.n AND x.run = r.run),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


#: The unsigned CRC-32 of the text in {0}, bit by bit.
CRC32 = """CAST(xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), lambda b: [CAST(ascii(b) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) AS BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


_MEMBERS = "SELECT *, string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM"
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed FROM documents
), g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT doc_id, leaf, claimed, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY tree) AS n FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source
), levels AS (
  SELECT tree, 0 AS lev, nth, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lev + 1, nth // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY nth)) FROM levels WHERE n > 1 GROUP BY tree, lev, nth // 3, n
), tops AS (
  SELECT -1 AS tree, 0 AS lev, tree AS nth, (SELECT count(*) FROM g) AS n, h FROM levels WHERE n = 1
  UNION ALL
  SELECT tree, lev + 1, nth // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY nth)) FROM tops WHERE n > 1 GROUP BY tree, lev, nth // 3, n
), members AS (
  {_MEMBERS} (SELECT * FROM levels WHERE n > 1 UNION ALL SELECT * FROM tops WHERE n > 1) WINDOW run AS (PARTITION BY tree, lev, nth // 3 ORDER BY nth)
), nodes AS (
  SELECT tree, lev, nth, coalesce(before, '') AS before, coalesce(after, '') AS after, CASE WHEN n <= 3 AND tree >= 0 THEN -1 ELSE tree END AS up_tree,
    CASE WHEN n <= 3 AND tree >= 0 THEN 0 ELSE lev + 1 END AS up_lev, CASE WHEN n <= 3 AND tree >= 0 THEN tree ELSE nth // 3 END AS up_nth FROM members
), climb AS (
  SELECT tree AS own, nth AS own_nth, CASE WHEN n = 1 THEN -1 ELSE tree END AS tree, 0 AS lev, CASE WHEN n = 1 THEN tree ELSE nth END AS nth, claimed AS h, '' AS proof, 0 AS step FROM leaves
  UNION ALL
  SELECT own, own_nth, up_tree, up_lev, up_nth, sha256(before || h || after), proof || before || after, step + 1 FROM climb JOIN nodes USING (tree, lev, nth)
), last AS (SELECT own, own_nth, arg_max(h, step) AS folded_root, sha256(arg_max(proof, step)) AS proof_sha256 FROM climb GROUP BY own, own_nth)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaves JOIN last ON own = leaves.tree AND own_nth = leaves.nth JOIN (SELECT tree, h FROM levels WHERE n = 1) s ON s.tree = leaves.tree, (SELECT h FROM tops WHERE n = 1) r
"""

PREFIX_TRIE = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k,
    CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS token, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT c, count(*) AS n, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h, c - c % 20 AS d FROM t GROUP BY c),
plan AS (SELECT x.c, x.d, CASE WHEN x.c = x.d THEN 0 ELSE x.h END AS h, CASE WHEN x.c = x.d THEN 0 ELSE least(x.h, coalesce(y.n, 0)) END AS g FROM c x LEFT JOIN c y ON y.c = x.d),
r AS (
  SELECT p.c, t.k - p.h + p.g AS k, token, words FROM plan p JOIN t ON t.c = p.c WHERE t.k >= p.h
  UNION ALL SELECT p.c, t.k, token, words FROM plan p JOIN t ON t.c = p.d WHERE t.k < p.g
), path AS (
  SELECT c, k + 1 AS d, sha256(string_agg(sha256(token), ',') OVER (PARTITION BY c ORDER BY k)) AS node, coalesce(sha256(string_agg(sha256(token), ',') OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up,
    words, k + 1 = count(*) OVER (PARTITION BY c) AS ends FROM r
  UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM r) FROM plan
), nodes AS (
  SELECT d, node, up, min(c) AS owner, count(*) AS n, max(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM path GROUP BY d, node, up
), kids AS (SELECT up AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT x.d, x.node, x.owner, (x.n - 1) * x.words AS saved, k.n IS NULL AS leaf FROM nodes x LEFT JOIN kids k USING (d, node)),
sums AS (
  SELECT p.d, p.node, sum(o.saved) AS saved, count(*) FILTER (WHERE o.leaf) AS leaves FROM path p JOIN own o ON o.owner = p.c AND o.d >= p.d GROUP BY p.d, p.node
)
SELECT x.owner AS conv_id, CAST(x.d AS BIGINT) AS depth, y.owner AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s USING (d, node) LEFT JOIN kids k USING (d, node) LEFT JOIN nodes y ON y.d = x.d - 1 AND y.node = x.up
"""
