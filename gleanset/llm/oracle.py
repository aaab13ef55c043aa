"""The training-data queries' rows in SQL, where SQL can express them."""

from __future__ import annotations

from gleanset.llm.quality_rules import BOILERPLATE, MENU_WORDS, Rules

R = Rules()
SPACES = r"[\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACES}'), lambda v: v <> '')"


SYMBOL = "len(regexp_extract_all({0}, '[#*$%&|<>]'))"
MENU = "('" + "', '".join(sorted(w.decode() for w in MENU_WORDS)) + "')"
FAILS = (
    f"{SYMBOL.format('line')} > {R.max_symbols_per_word} * len(ws) OR len(list_filter(regexp_split_to_array(line, '[ \\t]'), lambda v: v IN ('|', '»', '›', '•', '·', '/', '>'))) >= {R.min_separators} "
    f"OR (len(ws) <= 6 AND len(list_filter(ws, lambda v: lower(trim(v, '|>.,:;-')) NOT IN {MENU})) = 0) OR regexp_matches(line, '(?i){BOILERPLATE.pattern}') "
    f"OR (len(ws) >= {R.unpunctuated_words} AND NOT regexp_matches(line, '[.!?…。！？]')) OR (len(ws) >= 3 AND len(list_filter(ws, lambda v: regexp_matches(v, '[!?]{{2,}}$'))) > {R.max_shouted} * len(ws))"
)

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS ws FROM documents),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d),
l AS (SELECT *, {words("line")} AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l0 WHERE len({words("line")}) > 0),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k > 1) AS dup, count(*) FILTER (WHERE {FAILS}) AS failed, coalesce(sum(len(ws)) FILTER (WHERE {FAILS}), 0) AS lost FROM l GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS a, unnest(generate_series(1, len(ws))) AS i FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(d.ws) AS n_words, length(text) - len(regexp_extract_all(text, '[\\x20\\x09-\\x0D]')) AS word_chars, {SYMBOL.format('text')} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(failed, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS failed_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {R.min_words} OR n_repeat_words > {R.max_repeat} * n_words AS base_failed,
NOT (n_words < {R.min_words} OR n_repeat_words > {R.max_repeat} * n_words) AND failed_words <= {R.max_lost} * n_words AS kept, n_lines, n_failed_lines, failed_words FROM m
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, y AS r FROM e UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON reach.r = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(r), d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

# CRC-32 of a list of bytes, by a table that is made from the polynomial.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"


def crc32(codes: str) -> str:
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


# Code points of the runs are below 0x100: in UTF-8 those from 0xC0 on are 0xC3 and the code less 0x40.
BYTES = "flatten(list_transform(range(length({0})), lambda i: CASE WHEN ord(substr({0}, i + 1, 1)) < 128 THEN [ord(substr({0}, i + 1, 1))::BIGINT] ELSE [195, ord(substr({0}, i + 1, 1))::BIGINT - 64] END))"

OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
own AS (SELECT doc_id, r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS s, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY doc_id, r),
hashed AS (SELECT r, n, {crc32(BYTES.format("s"))} AS h FROM own, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM w),
part AS (SELECT word, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM cut),
near AS (
  SELECT x.word, y.word AS near FROM part x JOIN part y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT part.word, w.word FROM part JOIN w ON w.word = part.a || part.z
  UNION SELECT w.word, part.word FROM part JOIN w ON w.word = part.a || part.z
),
top AS (SELECT near.word, count(*) AS n_near, list({{'n': -w.n, 'near': near}} ORDER BY -w.n, near)[1] AS t FROM near JOIN w ON w.word = near.near GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -t.n >= 10 * w.n THEN t.near END AS form, CASE WHEN -t.n >= 10 * w.n THEN -t.n END AS form_n FROM w LEFT JOIN top USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, form, root, f.n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)
"""

LEVELS = 5  # of SQL, enough for 16 ** 5 rows of a group


def tree(name: str, base: str) -> str:
    """CTEs name0 ... with g, i, n, d and the siblings l and r of each node; base has g, i, n, d."""
    sides = "*, coalesce(string_agg(d, '') OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    out = [f"{name}0 AS (SELECT {sides} FROM {base} WINDOW p AS (PARTITION BY g, i // 16 ORDER BY i))"]
    for k in range(1, LEVELS + 1):
        up = f"SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k - 1} GROUP BY g, i // 16"
        out.append(f"{name}{k} AS (SELECT {sides} FROM ({up}) WINDOW p AS (PARTITION BY g, i // 16 ORDER BY i))")
    return ",\n".join(out)


def climb(rows: str, name: str) -> str:
    """rows (g, i, f, p) with f folded and the siblings appended to p, level by level."""
    for k in range(LEVELS):
        kept = "x.* EXCLUDE (f, p)"
        rows = f"(SELECT {kept}, CASE WHEN t.n = 1 THEN f ELSE sha256(t.l || f || t.r) END AS f, p || t.l || t.r AS p FROM {rows} x JOIN {name}{k} t ON t.g = x.g AND t.i = x.i // {16**k})"
    return rows


def counted(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


ROW = " || ".join(map(counted, ("doc_id", "source", "lang", "n_chars")))
OP13 = f"""
WITH {CRC_TABLE},
doc AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, sha256({ROW} || {counted("text")}) AS d,
  CASE WHEN {crc32("list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ord(substr(CAST(doc_id AS VARCHAR), i + 1, 1))::BIGINT)")} % 5 = 0
  THEN sha256({ROW} || {counted("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) ELSE sha256({ROW} || {counted("text")}) END AS f FROM documents, crc),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM doc),
{tree("a", "(SELECT g, i, n, d FROM leaf)")},
subs AS (SELECT 'all' AS g, g AS own, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM a{LEVELS}),
{tree("b", "(SELECT g, i, n, d FROM subs)")},
low AS {climb("(SELECT doc_id, g, i, d AS leaf, f, '' AS p FROM leaf)", "a")},
high AS {climb("(SELECT doc_id, leaf, subs.d AS subroot, subs.g, subs.i, f, p FROM low JOIN subs ON subs.own = low.g)", "b")}
SELECT doc_id, leaf, subroot, b{LEVELS}.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b{LEVELS}.d AS verified FROM high, b{LEVELS}
"""

ORACLE_SQL = {"op6_near_dedup": OP6, "op7_quality_rules": OP7, "op12_spelling_variants": OP12, "op13_merkle_manifest": OP13}
