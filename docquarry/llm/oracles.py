"""DuckDB SQL for the queries that SQL can express."""

from . import quality

_SPACE = r"[ \t\n\v\f\r]"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '{_SPACE}+'), lambda w: w <> '')"


def lower_ascii(expression: str) -> str:
    return f"translate({expression}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, {lower_ascii(f"trim(line, {_STRIP})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5 = f"""
WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {lower_ascii("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
"""

_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "replace(replace({0}, '␛', '␛0'), '<|', '<␛1|')"
OP8 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(12 + length(replace({_ESCAPED.format("role")}, chr(10), '␛2')) + 1 + length({_ESCAPED.format("text")}) + 11)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

def _bucket(v: str) -> str:
    width = f"(2 ** greatest(length(bin({v})) - {len(bin(quality.SUB)) - 2}, 0))::BIGINT"
    return f"({v} // {width}) * {width}"


def _feature(expression: str) -> str:
    return expression.replace(" div ", " // ")


_NAMES = list(quality.FEATURES)
_LONG = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS feature, {_feature(e)} AS v FROM f" for k, (e, _) in quality.FEATURES.items())
_SLACK = " ".join(f"WHEN '{k}' THEN {s}" for k, (_, s) in quality.FEATURES.items())


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines FROM d),
p AS (SELECT rid, i, array_to_string(ws[i + 1:i + 8], ' ') AS g FROM (SELECT rid, ws, unnest(range(0, len(ws) - 7)) AS i FROM w)),
a AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM a, range(0, 8) x(o) WHERE c > 1 GROUP BY rid),
f AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len([1 for j in range(1, len(ws)) if ws[j] = ws[j + 1]])::BIGINT AS n_stutter FROM w LEFT JOIN r USING (rid)),
l AS ({_LONG}),
k AS (SELECT lang, source, feature, {_bucket("v")} AS bucket, count(*) AS n FROM l GROUP BY ALL),
e AS (SELECT feature, bucket, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
et AS (SELECT feature, sum(n)::HUGEINT AS total FROM e GROUP BY ALL),
lf AS (SELECT DISTINCT lang, feature FROM k), gf AS (SELECT DISTINCT lang, source, feature FROM k),
g AS (SELECT lang, feature, bucket, sum(n)::HUGEINT AS n FROM (
  SELECT lang, feature, bucket, n * total AS n FROM k JOIN et USING (feature) UNION ALL SELECT lang, feature, bucket, {quality.PRIOR} * n FROM lf JOIN e USING (feature)) GROUP BY ALL),
gt AS (SELECT lang, feature, sum(n)::HUGEINT AS total FROM g GROUP BY ALL),
o AS (SELECT lang, source, feature, bucket, sum(n)::HUGEINT AS n FROM (
  SELECT k.lang, source, k.feature, bucket, n * total AS n FROM k JOIN gt ON gt.lang IS NOT DISTINCT FROM k.lang AND gt.feature = k.feature
  UNION ALL SELECT gf.lang, source, gf.feature, bucket, {quality.PRIOR} * n FROM gf JOIN g ON g.lang IS NOT DISTINCT FROM gf.lang AND g.feature = gf.feature) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, feature ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, source, feature) AS total FROM o),
q AS (SELECT lang, source, feature, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM u GROUP BY ALL),
v AS (SELECT l.rid, bool_or(l.v > q3 + greatest((q3 - q1) * {quality.FENCE}, CASE l.feature {_SLACK} END)) AS above
  FROM l JOIN q ON q.lang IS NOT DISTINCT FROM l.lang AND q.source IS NOT DISTINCT FROM l.source AND q.feature = l.feature GROUP BY l.rid),
b AS (SELECT f.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM b JOIN v USING (rid)
"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p
"""

# DuckDB has no crc32: a table of the 256 one-byte remainders, then a fold over the bytes.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab"


def _crc32(text: str) -> str:
    bytes_ = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


OP11 = f"""
WITH RECURSIVE z AS ({_CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, {lower_ascii("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, z),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS MATERIALIZED (SELECT a.word, b.word AS near FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT p.word, v.word FROM p JOIN v ON p.rest = v.word UNION SELECT v.word, p.word FROM p JOIN v ON p.rest = v.word),
b AS (SELECT e.word, count(*)::BIGINT AS n_near, min(struct_pack(m := -v.n, near := near)) AS best FROM e JOIN v ON v.word = near GROUP BY e.word),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
o AS (SELECT w.word, root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""

OP12 = f"""
WITH z AS ({_CRC_TABLE}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, sha256(length(role) || ':' || role || text) AS key, len({words("text")}) AS words FROM t),
o AS (SELECT conv_id, list(struct_pack(key := key, words := words) ORDER BY turn NULLS FIRST, role, key) AS said FROM k GROUP BY conv_id),
h AS (SELECT conv_id, said, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM o, z),
s AS (SELECT h.conv_id, list_concat(coalesce(o.said, [])[1:h.h], h.said[h.h + 1:]) AS said FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, len(said) AS size, sha256(array_to_string([x.key for x in said[1:d]], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string([x.key for x in said[1:d - 1]], ',')) END AS up,
  CASE WHEN d > 0 THEN said[d].words ELSE 0 END AS words FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM s)),
n AS (SELECT node, up, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM m GROUP BY node, up, d),
c AS (SELECT up AS node, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT n.node, n.n, n.words, kids IS NULL AS leaf, m.conv_id, m.d FROM n LEFT JOIN c USING (node) JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d),
u AS (SELECT m.node, sum((a.n - 1) * a.words)::BIGINT AS saved, (count(*) FILTER (leaf))::BIGINT AS leaves FROM a JOIN m ON m.conv_id = a.conv_id AND m.d = a.d GROUP BY m.node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.up LEFT JOIN c ON c.node = n.node JOIN u ON u.node = n.node
"""

SQL = {"op11_spelling": OP11, "op12_prefix_trie": OP12, "op3_quality": OP3, "op4_line_dedup": OP4, "op5_url_filter": OP5, "op7_warc": OP7, "op8_chat": OP8}
