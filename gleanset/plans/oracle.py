"""The queries' rows in SQL for another engine, written for it and not derived from the Spark plans."""

from __future__ import annotations

from gleanset.functions import text as t
from gleanset.operators.labels import CLOSING, OPENING
from gleanset.plans.inputs import CANVAS, DETECTION, QUERY_TEXT, REGION

LINES = "lines AS (SELECT l_orderkey AS scan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, p_name, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey)"
DET = LINES + ", d AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in DETECTION.items()) + " FROM lines)"
SENT = "cut AS (SELECT doc_id AS scan_id, string_split(replace(text, chr(10), '.'), '.') AS parts FROM documents), s AS (SELECT scan_id, unnest(generate_series(0, len(parts) - 1)) AS ord, unnest(parts) AS text FROM cut)"
REG = SENT + ", r AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REGION.items()) + " FROM s)"
CAT = "names AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT card_ord, CASE WHEN card_ord % 5 = 0 THEN replace(name, ' ', ' // ') ELSE name END AS name FROM (SELECT row_number() OVER (ORDER BY name) - 1 AS card_ord, name FROM names))"
ANN = "ann AS (SELECT scan_id, ord, CASE pk % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'corrected' WHEN 2 THEN 'not-card' WHEN 3 THEN 'unreviewed' END AS verdict, CASE WHEN pk % 5 = 1 AND pk % 10 = 1 THEN concat(' ', detected_text, ' ') ELSE '' END AS corrected_text FROM d WHERE pk % 5 <> 4), v AS (SELECT d.*, coalesce(verdict, 'unreviewed') AS verdict, corrected_text FROM d LEFT JOIN ann USING (scan_id, ord))"
PIX = "p AS (SELECT l_suppkey AS image_id, i % 20 AS x, i // 20 AS y, i, (l_partkey * 7 + l_orderkey) % 256 AS r, (l_partkey * 3) % 256 AS g, l_orderkey % 256 AS b FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS i FROM lineitem)), pl AS (SELECT *, CAST(floor(0.2126 * CAST(r AS DOUBLE) + 0.7152 * CAST(g AS DOUBLE) + 0.0722 * CAST(b AS DOUBLE) + 0.5) AS INT) AS luma FROM p)"
FACES = "die AS (SELECT scan_id, ord, CAST((pk + ord) % 30 AS INT) AS value, confidence, x + 10 AS x, y + 25 AS y, CAST(8 AS DOUBLE) AS width, CAST(9 AS DOUBLE) AS height FROM d), face AS (SELECT *, width * height AS area FROM die WHERE value BETWEEN 1 AND 24), land AS (SELECT * FROM d WHERE name IN ('Island', 'Mountain'))"

LAND = "name IN ('" + "', '".join(t.BASIC_LANDS) + "')"
NAMED = "(name IS NOT NULL AND name <> '' AND status <> 'unknown')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def clean(x: str) -> str:
    """As sanitize()."""
    trim = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    return trim(f"regexp_replace(regexp_replace(regexp_replace({trim(x)}, '^[^A-Za-z0-9]+', ''), '^[A-Za-z]\\.\\s+', ''), '^[^A-Za-z0-9]+', '')")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def low_words(x: str) -> str:
    return words(f"regexp_replace(lower({x}), '[^a-z\\s]', ' ', 'g')")


SHORT = "('" + "', '".join(t.SHORT_TITLE_WORDS) + "')"
TYPES = "['" + "', '".join(t.TYPE_WORDS) + "']"


def hits(x: str) -> str:
    return f"len(list_filter({low_words(x)}, lambda w: len(w) >= 3 AND len(list_filter({TYPES}, lambda k: w = k OR (abs(len(w) - len(k)) <= (CASE WHEN len(w) >= 5 OR len(k) >= 7 THEN 2 ELSE 1 END) AND levenshtein(w, k) <= (CASE WHEN len(w) >= 5 OR len(k) >= 7 THEN 2 ELSE 1 END)))) > 0))"


def junk(x: str) -> str:
    return f"len(list_filter({low_words(x)}, lambda w: len(w) <= 2 AND w NOT IN {SHORT}))"


def run(x: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z]', '', 'g'), '[aeiouy]'), lambda v: len(v))), 0)"


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def body(x: str) -> str:
    """The ordered body text rules of a trimmed text x."""
    joined = f"regexp_replace({x}, '\\s+', '', 'g')"
    digits = count(x, "[0-9]")
    rules = [
        (f"{x} = ''", "empty"), (m(x, "[+=/]"), "contains a rules symbol"), (m(x, "[—–]|\\s-\\s"), "looks like a type line (dash)"), (m(x, "^[:;\"''.,()\\[\\]{}@]"), "leading punctuation"), (m(x, "[.!?]$"), "sentence punctuation"),
        (m(x, "(?i)^(?:[ptwueq]|tap)\\s*[,:]"), "activation cost"), (f"{digits} >= 2", "looks like rules/collector text (digits)"), (f"len({joined}) <= 3 AND {digits} > 0", "collector/mana fragment"),
        (f"len({joined}) <= 3 AND {m(x, '[A-Z]')} AND {m(x, '[a-z]')}", "mixed-case fragment"), (f"len({joined}) <= 5 AND {digits} > 0 AND {m(x, '[A-Za-z]')}", "alphanumeric fragment"), (m(x, "(?i)^anifact\\b"), "looks like a type line"),
        (m(x, "(?i)\\badd\\b|\\bald one\\b"), "mana ability"), (m(x, "(?i)\\b(enten|becomes|tapped|battlefield|turn|strike|token)\\b"), "rules phrase"),
        (m(x, "(?i)^(?:creature|legendary|artifact|enchantment|instant|sorcery|planeswalker|egeodary)\\b"), "looks like a type line"), (f"{m(x, '[-—]\\s*[A-Za-z]{3,}')} AND {hits(x)} >= 1", "looks like a type line"),
        (m(x, "(?i)\\b(deals?|damage|danage|tapped|untap|target|copy)\\b"), "rules phrase"), (f"{m(x, '(?i)\\b(you|your)\\b')} AND {m(x, '(?i)\\b(control|life|mana|pool)\\b')}", "rules phrase"),
        (m(x, "(?i)\\b(may pay|controller|coetroller|permanent)\\b"), "rules phrase"), (f"{m(x, '(?i)\\bthis\\b')} AND {m(x, '(?i)\\b(art|creat|enchant|land|perman|equip|instant|sorcery)\\b')}", "rules phrase"),
        (m(x, "(?i)\\bcard types\\b"), "rules phrase"), (f"{m(x, '(?i)\\bmore\\b')} AND {m(x, '(?i)\\bcards?\\b')}", "rules phrase"), (f"{junk(x)} >= 3", "garbled fragment"), (f"{hits(x)} >= 2", "looks like a type line"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in rules) + " END"


def iou(a: str, b: str) -> str:
    w = f"(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    h = f"(least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 0.0 ELSE {w} * {h} / ({a}.width * {a}.height + {b}.width * {b}.height - {w} * {h}) END"


def side(a: str, b: str) -> str:
    w = f"(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    return f"(CASE WHEN {w} <= 0 THEN 0.0 ELSE {w} / greatest(1, least({a}.width, {b}.width)) END)"


BODY_H, BODY_W = "greatest(height / 0.055, width * 1.8, 80.0)", "greatest(width / 0.55, greatest(height / 0.055, width * 1.8, 80.0) / (88.0 / 63.0))"


def clipped(out: str, x: str, y: str, w: str, h: str) -> str:
    """out's x, y, w and h: a box with its edges rounded and kept on the canvas."""
    on = lambda v, low, high: f"greatest({low}, least({high}, floor({v} + 0.5)))"
    left, top = on(x, "0.0", CANVAS[0]), on(y, "0.0", CANVAS[1])
    return f"{left} AS {out}x, {top} AS {out}y, {on(f'{x} + {w}', left, CANVAS[0])} - {left} AS {out}w, {on(f'{y} + {h}', top, CANVAS[1])} - {top} AS {out}h"


LAND_BOXES = (
    f"un AS (SELECT *, x - {BODY_W} * 0.12 AS ux, y - {BODY_H} * 0.03 AS uy, {BODY_W} AS uw, {BODY_H} AS uh FROM d WHERE name IN ('Island', 'Mountain')), "
    f"bodies AS (SELECT *, {clipped('k', 'ux', 'uy', 'uw', 'uh')} FROM un), "
    "arts AS (SELECT *, kx AS ax, greatest(ky, y + height) AS ay, kw AS aw, greatest(24.0, ky + kh - greatest(ky, y + height)) * 0.92 AS ah FROM bodies), "
    f"shown AS (SELECT *, {clipped('s', 'ax', 'ay', 'aw', 'ah')} FROM arts)"
)
UPPER = "list_sort(list({0}))[CAST(floor(count({0}) / 2) AS BIGINT) + 1]"
DECK = f"deck AS (SELECT scan_id, name, CAST(sum(coalesce(count, 1)) AS BIGINT) AS count, {LAND} AS is_land FROM d WHERE (count IS NULL OR count <> 0) AND {NAMED} GROUP BY scan_id, name)"
INDEX = f"ix AS (SELECT card_ord, 0 AS pass, name, name AS search_name FROM c UNION ALL SELECT card_ord, 1, name, face FROM (SELECT card_ord, name, trim(unnest(string_split(name, ' // '))) AS face FROM c) WHERE face <> name), i AS (SELECT *, {norm('search_name')} AS normalized FROM ix WHERE {norm('search_name')} <> ''), look AS (SELECT normalized, arg_min(name, pass * 1000000 + card_ord) AS name FROM i GROUP BY normalized)"
Q0 = f"q0 AS (SELECT p_partkey AS query_id, {QUERY_TEXT} AS text FROM part), q AS (SELECT query_id, text, {norm(clean('text'))} AS n FROM q0)"
CLEANED = "array_to_string(list_filter(string_split(n, ' '), lambda w, k: len(w) > 1 OR (k > 1 AND k < len(string_split(n, ' ')))), ' ')"
COLS = f"lim AS (SELECT scan_id, greatest(24.0, least(72.0, {UPPER.format('width')} * 0.55)) AS lim FROM d GROUP BY scan_id), gap AS (SELECT d.*, CASE WHEN x + width / 2 - lag(x + width / 2) OVER (PARTITION BY scan_id ORDER BY x + width / 2, ord) <= lim THEN 0 ELSE 1 END AS new FROM d JOIN lim USING (scan_id)), cols AS (SELECT *, CAST(sum(new) OVER (PARTITION BY scan_id ORDER BY x + width / 2, ord) AS BIGINT) AS column_id FROM gap)"
EXT = f"pad AS (SELECT scan_id, column_id, count(*) AS n, min(x) AS l, max(x + width) AS r, greatest(6.0, {UPPER.format('height')} * 0.25) AS pad, {UPPER.format('height')} AS height FROM cols GROUP BY ALL)"

BOXED = "concat(' [', CAST(floor(x + 0.5) AS BIGINT), ', ', CAST(floor(y + 0.5) AS BIGINT), ', ', CAST(floor(width + 0.5) AS BIGINT), ', ', CAST(floor(height + 0.5) AS BIGINT), ']')"
NAMED_LINE = f"concat('- \"', coalesce(name, detected_text, '(no text)'), '\"', {BOXED})"


def section(heading: str, of: str) -> str:
    return f"'{heading} (', coalesce({of}.n, 0), '):', chr(10), coalesce({of}.lines, '- none marked'), chr(10), chr(10)"


def listed(name: str, line: str, rows: str) -> str:
    return f"{name} AS (SELECT scan_id, count(*) AS n, string_agg({line}, chr(10) ORDER BY ord) AS lines FROM {rows} GROUP BY scan_id)"


FIXED_LINE = f"concat('- detected \"', CASE WHEN coalesce(detected_text, '') = '' THEN '(empty OCR)' ELSE detected_text END, '\" -> should be \"', trim(corrected_text), '\"', {BOXED})"
MISSED_LINE = f"concat('- \"', trim(concat(' ', detected_text)), '\"', {BOXED})"
REPORT = (
    f"WITH {DET}, {ANN}, {listed('c', NAMED_LINE, '(SELECT * FROM v WHERE verdict = $$correct$$)')}, "
    f"{listed('w', FIXED_LINE, '(SELECT * FROM v WHERE verdict = $$corrected$$ AND trim(corrected_text) <> $$$$)')}, "
    f"{listed('f', f'concat({NAMED_LINE}, $$ (not a card title)$$)', '(SELECT * FROM v WHERE verdict = $$not-card$$)')}, "
    f"{listed('m', MISSED_LINE, '(SELECT * FROM d WHERE pk % 17 = 0 AND pk % 34 <> 0)')}, "
    "u AS (SELECT scan_id, count(*) AS n FROM v WHERE verdict = 'unreviewed' GROUP BY scan_id), s AS (SELECT o_orderkey AS scan_id FROM orders) "
    f"SELECT s.scan_id, concat('{OPENING}', chr(10), chr(10), 'Sample: scan', s.scan_id, '.jpg', chr(10), 'Prepared image: 900x701 px (every box below is [x, y, width, height] in these pixels).', chr(10), chr(10), "
    f"{section('Correct detections', 'c')}, {section('Wrong names to fix', 'w')}, {section('False positives to suppress', 'f')}, {section('Missed titles to detect', 'm')}, "
    f"CASE WHEN u.n IS NULL THEN '' ELSE concat('Unreviewed detections (not labeled): ', u.n, chr(10), chr(10)) END, '{CLOSING}') AS report "
    "FROM s LEFT JOIN c USING (scan_id) LEFT JOIN w USING (scan_id) LEFT JOIN f USING (scan_id) LEFT JOIN m USING (scan_id) LEFT JOIN u USING (scan_id)"
)

STRETCHED = (
    f"WITH {PIX}, h AS (SELECT image_id, luma, count(*) AS n FROM pl GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY luma) AS acc, sum(n) OVER (PARTITION BY image_id) AS total FROM h), "
    "b AS (SELECT image_id, min(luma) FILTER (WHERE acc > floor(total * 0.02)) AS low, min(luma) FILTER (WHERE acc > least(total - 1, floor(total * 0.98))) AS high FROM c GROUP BY image_id) "
    "SELECT image_id, i, CAST(CASE WHEN high - low < 48 THEN luma ELSE greatest(0, least(255, floor((luma - low) * 255.0 / greatest(high - low, 1) + 0.5))) END AS BIGINT) AS value FROM pl JOIN b USING (image_id)"
)
SECTION_ROWS = (
    f"WITH {DET}, {ANN}, z AS (SELECT *, CASE WHEN verdict <> 'corrected' OR trim(coalesce(corrected_text, '')) <> '' THEN verdict END AS section, "
    f"CASE WHEN verdict = 'corrected' THEN {FIXED_LINE} WHEN verdict = 'not-card' THEN concat({NAMED_LINE}, ' (not a card title)') ELSE {NAMED_LINE} END AS line FROM v) "
    "SELECT scan_id, section, count(*) AS n, CASE WHEN section = 'unreviewed' THEN '' ELSE string_agg(line, chr(10) ORDER BY ord) END AS lines FROM z WHERE section IS NOT NULL GROUP BY scan_id, section"
)


def rounded(name: str, x: str, y: str, w: str, h: str) -> str:
    return ", ".join(f"round({v}, 6) AS {name}_{c}" for c, v in zip("xywh", (x, y, w, h)))


def kept_on_canvas(x: str, y: str, w: str, h: str) -> tuple[str, str, str, str]:
    """A box with rounded edges on the canvas, of one pixel each way at least."""
    left, top = f"greatest(0, floor({x} + 0.5))", f"greatest(0, floor({y} + 0.5))"
    return left, top, f"greatest(1, least({CANVAS[0]}, floor({x} + {w} + 0.5)) - {left})", f"greatest(1, least({CANVAS[1]}, floor({y} + {h} + 0.5)) - {top})"


DERIVED = (
    f"WITH {DET}, u AS (SELECT *, {BODY_W} AS bw, {BODY_H} AS bh FROM d), b AS (SELECT *, x - bw * 0.12 AS bx, y - bh * 0.03 AS b_y FROM u), a AS (SELECT *, greatest(b_y, y + height) AS ay FROM b) SELECT scan_id, ord, "
    f"{rounded('body', 'bx', 'b_y', 'bw', 'bh')}, {rounded('art', 'bx', 'ay', 'bw', 'greatest(24.0, b_y + bh - ay) * 0.92')}, {rounded('clipped', *kept_on_canvas('bx', 'b_y', 'bw', 'bh'))}, "
    f"{rounded('wider', *kept_on_canvas('(x - width * 0.1)', '(y - height * 0.25)', '(width + width * 0.1 * 2)', '(height + height * 0.25 * 2)'))}, {rounded('unit', 'x / 900', 'y / 700', 'width / 900', 'height / 700')}, "
    f"{rounded('band', 'x + width / 2 - greatest(72.0, width) / 2', 'y - greatest(6.0, height * 0.45)', 'greatest(72.0, width)', 'greatest(height * 2.2, 36 * 0.55)')} FROM a"
)
GAPS = (
    f"WITH {DET}, {COLS}, {EXT}, g AS (SELECT scan_id, column_id, y, y - lag(y) OVER (PARTITION BY scan_id, column_id ORDER BY y, ord) AS gap FROM cols), p AS (SELECT scan_id, column_id, min(gap) FILTER (WHERE gap BETWEEN 45 AND 190) AS pitch FROM g GROUP BY ALL), "
    "w AS (SELECT *, CAST(greatest(1, floor(gap / pitch + 0.5)) AS BIGINT) AS steps, ((l - pad) + (r + pad)) / 2 AS cx, (r + pad) - (l - pad) AS cw, coalesce(nullif(height, 0), 16.0) AS ch FROM g JOIN p USING (scan_id, column_id) JOIN pad USING (scan_id, column_id) WHERE gap > pitch * 1.55 AND gap >= 68), "
    "e AS (SELECT *, unnest(generate_series(1, steps)) AS k FROM w), z AS (SELECT *, y - gap + gap * k / (steps + 1) - greatest(6.0, ch * 0.45) AS top FROM e) "
    "SELECT scan_id, 'column-gap' AS reason, round(200 + top, 6) AS priority, round(cx - greatest(72.0, cw) / 2, 6) AS x, round(top, 6) AS y FROM z"
)
TOKENS = "('" + "', '".join(t.TOKEN_NAMES) + "')"
GIBBERISH = "len({0}) >= 5 AND len(regexp_extract_all({0}, '[aeiouy]')) / greatest(len({0}), 1) <= 0.42 AND len(list_distinct(string_split({0}, ''))) / greatest(len({0}), 1) < 0.45"
NO_TOKENS = (
    f"WITH {DET}, e AS (SELECT *, {norm('coalesce(CASE WHEN pk % 10 = 1 THEN $$Treasure $$ || name WHEN pk % 10 = 2 THEN $$Food$$ ELSE name END, $$$$)')} AS n, {norm('detected_text')} AS tx FROM d), "
    "z AS (SELECT *, replace(n, ' ', '') AS nj, replace(tx, ' ', '') AS xj FROM e) SELECT scan_id, ord FROM z WHERE NOT "
    f"(n IN {TOKENS} OR tx IN {TOKENS} OR (len(tx) >= 4 AND (n IN {TOKENS} OR string_split(n, ' ')[1] IN {TOKENS}) AND (({GIBBERISH.format('xj')}) OR 1 - levenshtein(xj, nj) / greatest(len(xj), len(nj), 1) < 0.72)))"
)


def bones(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z]|[aeiouy]', '', 'g')"


def ratio(common: str, a: str, b: str) -> str:
    """The better of shared characters and edits."""
    return f"greatest(2.0 * {common} / (len({a}) + len({b})), 1 - levenshtein({a}, {b}) / greatest(len({a}), len({b})))"


def boned(common: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {ratio(common, a, b)} END"


# Every form against every name. Common subsequences are made row by row of their table, for the distinct pairs of strings.
TOKEN_PAIRS = "SELECT v, w, k, string_split(v, ' ')[k] AS a, string_split(w, ' ')[k] AS b FROM (SELECT *, unnest(generate_series(1, least(len(string_split(v, ' ')), len(string_split(w, ' '))))) AS k FROM pr)"
SEARCHED = (
    f"WITH RECURSIVE {CAT}, {INDEX}, q0 AS (SELECT p_partkey AS query_id, {QUERY_TEXT} AS text FROM part), q AS (SELECT query_id, {norm('text')} AS v FROM q0 WHERE {norm('text')} <> ''), "
    f"nm AS (SELECT name, min(card_ord) AS place, {norm('name')} AS w FROM c GROUP BY name), pr AS (SELECT v, w, replace(v, ' ', '') AS a, replace(w, ' ', '') AS b FROM (SELECT DISTINCT v FROM q), (SELECT DISTINCT w FROM nm)), "
    f"tk AS ({TOKEN_PAIRS}), strings AS (SELECT a, b FROM pr UNION SELECT a, b FROM tk), need AS (SELECT a, b FROM strings UNION SELECT {bones('a')}, {bones('b')} FROM strings), "
    "step AS (SELECT a, b, 0 AS i, list_transform(range(len(b) + 1), lambda j: CAST(0 AS BIGINT)) AS t FROM need UNION ALL SELECT a, b, i + 1, "
    "list_prepend(CAST(0 AS BIGINT), list_transform(range(len(b)), lambda j: list_max(list_transform(range(j + 1), lambda m: greatest(t[m + 2], CASE WHEN substr(b, m + 1, 1) = substr(a, i + 1, 1) THEN t[m + 1] + 1 ELSE 0 END))))) FROM step WHERE i < len(a)), "
    "lc AS (SELECT a, b, t[len(b) + 1] AS n FROM step WHERE i = len(a)), "
    f"ts AS (SELECT v, w, CASE WHEN tk.a = tk.b THEN 1.0 ELSE greatest({ratio('x.n', 'tk.a', 'tk.b')}, CASE WHEN starts_with(tk.a, tk.b) OR starts_with(tk.b, tk.a) THEN 0.72 + 0.28 * least(len(tk.a), len(tk.b)) / greatest(len(tk.a), len(tk.b)) ELSE 0.0 END, "
    f"0.94 * ({boned('y.n', 'y.a', 'y.b')})) END AS sim FROM tk JOIN lc x ON x.a = tk.a AND x.b = tk.b JOIN lc y ON y.a = {bones('tk.a')} AND y.b = {bones('tk.b')}), "
    "al AS (SELECT v, w, sum(sim) AS total FROM ts GROUP BY v, w), "
    "sc AS (SELECT pr.v, pr.w, CASE WHEN pr.v = pr.w THEN 1.0 ELSE greatest(total / (least(lv, lw) + 0.35 * greatest(lw - lv, 0) + 0.5 * greatest(lv - lw, 0)), CASE WHEN len(pr.a) >= 4 AND starts_with(pr.b, pr.a) THEN 0.55 + 0.4 * len(pr.a) / len(pr.b) ELSE 0.0 END, "
    f"0.92 * (1 - levenshtein(pr.a, pr.b) / greatest(len(pr.a), len(pr.b))), 0.9 * (2.0 * x.n / (len(pr.a) + len(pr.b))), 0.88 * ({boned('y.n', 'y.a', 'y.b')})) END AS score "
    f"FROM (SELECT *, len(string_split(v, ' ')) AS lv, len(string_split(w, ' ')) AS lw FROM pr) pr JOIN al ON al.v = pr.v AND al.w = pr.w JOIN lc x ON x.a = pr.a AND x.b = pr.b JOIN lc y ON y.a = {bones('pr.a')} AND y.b = {bones('pr.b')}), "
    "near AS (SELECT v, name, round(score, 12) AS score, row_number() OVER (PARTITION BY v ORDER BY round(score, 12) DESC, place) AS k FROM sc JOIN nm USING (w) WHERE round(score, 12) >= 0.5), "
    "hit AS (SELECT v, name, score FROM near WHERE k <= 16 UNION ALL SELECT DISTINCT v, look.name, 1.0 FROM q JOIN look ON look.normalized = v), "
    "best AS (SELECT v, name, max(score) AS score FROM hit GROUP BY v, name), ranked AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, len(name), name) AS rank FROM best) "
    "SELECT query_id, rank, name, round(score, 6) AS score FROM q JOIN ranked USING (v) WHERE rank <= 6"
)


def first_of(name: str, rows: str, condition: str) -> str:
    return f"arg_min({{'text': text, 'name': nn}}, r.ord) FILTER (WHERE {rows} AND ({condition})) AS {name}"


WITHIN = "tn = norm OR contains(tn, norm) OR contains(norm, tn)"
TRACED = (
    f"WITH {DET}, e AS (SELECT DISTINCT scan_id, CASE WHEN pk % 2 = 0 THEN detected_text ELSE 'red ring' END AS expected FROM d WHERE ord <= 2), en AS (SELECT *, {norm('expected')} AS norm FROM e), "
    f"r AS (SELECT scan_id, ord, pk % 5 AS part, detected_text AS text, {norm('detected_text')} AS tn, {norm('coalesce(name, $$$$)')} AS nn FROM d), "
    f"j AS (SELECT en.scan_id, expected, norm, {first_of('k', 'part = 0', 'nn = norm OR tn = norm')}, {first_of('s', 'part = 1', f'nn = norm OR {WITHIN}')}, {first_of('c', 'part = 2', WITHIN)}, {first_of('f', 'part = 3', 'tn = norm OR contains(norm, tn)')}, "
    f"{first_of('w', 'true', 'tn = norm OR contains(norm, tn) OR contains(tn, string_split(norm, $$ $$)[1])')} FROM en LEFT JOIN r ON r.scan_id = en.scan_id GROUP BY ALL) "
    "SELECT scan_id, expected, CASE WHEN k.name = norm THEN 'matched' WHEN k IS NOT NULL THEN 'ocr-wrong-match' WHEN s IS NOT NULL THEN 'suppressed' WHEN c IS NOT NULL THEN 'ocr-unmatched' WHEN f IS NOT NULL THEN 'filtered' WHEN w IS NOT NULL THEN 'ocr-unmatched' ELSE 'not-detected' END AS reason, "
    "coalesce(k.text, s.text, c.text, f.text, w.text) AS ocr_text FROM j"
)

ORACLE_SQL: dict[str, str] = {
    "a1_decklist": f"WITH {DET}, {DECK} SELECT scan_id, name, count, is_land FROM deck",
    "a10_totals": f"WITH {DET} SELECT scan_id, CAST(coalesce(sum(CASE WHEN {NAMED} THEN coalesce(count, 1) END), 0) AS BIGINT) AS total, count(DISTINCT CASE WHEN {NAMED} THEN name END) AS n_names, count(*) FILTER (WHERE NOT {NAMED}) AS n_unresolved FROM d WHERE count IS NULL OR count <> 0 GROUP BY scan_id",
    "t6_deck_order": f"WITH {DET}, {DECK} SELECT scan_id, name, count, row_number() OVER (PARTITION BY scan_id ORDER BY is_land, lower(name), name) AS place FROM deck",
    "k1_decklist_text": f"WITH {DET}, {DECK}, part1 AS (SELECT scan_id, CASE WHEN is_land THEN 1 ELSE 0 END AS part, name AS key, 0 AS ord, concat(count, ' ', name) AS line FROM deck UNION ALL SELECT scan_id, 2, '', ord, concat('1 ', CASE WHEN coalesce(detected_text, '') = '' THEN 'Unknown card' ELSE detected_text END) FROM d WHERE (count IS NULL OR count <> 0) AND NOT {NAMED}) SELECT scan_id, string_agg(line, chr(10) ORDER BY part, key, ord) AS decklist FROM part1 GROUP BY scan_id",
    "k6_overlay": f"WITH {DET}, o AS (SELECT scan_id, ord, concat(CASE WHEN coalesce(count, 1) > 1 THEN concat(count, ' ') ELSE '' END, coalesce(name, detected_text)) AS label FROM d WHERE count IS NULL OR count <> 0) SELECT scan_id, ord, CASE WHEN len(label) > 12 THEN concat(substring(label, 1, 11), '…') ELSE label END AS label FROM o",
    "d1_choose_names": f"WITH {DET}, e AS (SELECT *, CASE WHEN pk % 11 = 0 THEN CASE WHEN pk % 2 = 0 THEN 'Forest' ELSE 'red ring' END END AS chosen FROM d) SELECT scan_id, ord, coalesce(chosen, name) AS name, CAST(CASE WHEN chosen IS NULL THEN count WHEN chosen = 'Forest' THEN coalesce(count, 1) ELSE 1 END AS INT) AS count, CASE WHEN chosen IS NULL THEN count_source WHEN chosen = 'Forest' THEN coalesce(count_source, 'manual') END AS count_source, CASE WHEN chosen IS NULL THEN status ELSE 'corrected' END AS status, CASE WHEN chosen IS NULL THEN confidence ELSE 1.0 END AS confidence FROM e",
    "d2_change_counts": f"WITH {DET} SELECT scan_id, ord, CAST(CASE WHEN pk % 13 = 0 THEN greatest(1, least(99, pk % 150)) ELSE count END AS INT) AS count, CASE WHEN pk % 13 = 0 THEN 'manual' ELSE count_source END AS count_source, CASE WHEN pk % 13 = 0 THEN 'corrected' ELSE status END AS status FROM d",
    "d3_delete": f"WITH {DET} SELECT scan_id, ord, name FROM d WHERE pk % 5 <> 0",
    "d4_add_cards": f"WITH {DET}, a AS (SELECT scan_id, name, status, count FROM d UNION ALL SELECT scan_id, 'Swamp', 'corrected', 1 FROM d WHERE ord = 1) SELECT scan_id, name, CAST(sum(coalesce(count, 1)) AS BIGINT) AS count FROM a WHERE (count IS NULL OR count <> 0) AND {NAMED} GROUP BY scan_id, name",
    "f1_normalize": f"SELECT doc_id, md5({norm('text')}) AS normalized FROM documents",
    "f2_split_faces": f"WITH {CAT} SELECT card_ord, unnest(generate_series(0, len(string_split(name, ' // ')) - 1)) AS face_no, trim(unnest(string_split(name, ' // '))) AS face FROM c",
    "f3_sanitize": f"WITH {SENT} SELECT scan_id, ord, {clean('text')} AS clean, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS squeezed FROM s",
    "f5_clean_query": f"WITH {Q0}, k AS (SELECT query_id, n, {CLEANED} AS cleaned FROM q) SELECT query_id, n, cleaned, array_to_string(list_concat(list_filter(string_split(cleaned, ' '), lambda w: w <> ''), list_filter(list_transform(generate_series(1, len(string_split(n, ' ')) - 1), lambda k: concat(string_split(n, ' ')[k], string_split(n, ' ')[k + 1])), lambda w: len(w) >= 7)), ' ') AS distinctive FROM k",
    "f8_text_measures": f"WITH {SENT}, z AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS j FROM s) SELECT scan_id, ord, regexp_replace(lower(text), '[^a-z]|[aeiouy]', '', 'g') AS skeleton, {count('text', '[A-Za-z]')} AS letters, {count('text', '[0-9]')} AS digits, {junk('text')} AS junk, {run('text')} AS run, len(j) >= 5 AND {count('j', '(?i)[aeiouy]')} / greatest(len(j), 1) <= 0.42 AND len(list_distinct(string_split(lower(j), ''))) / greatest(len(j), 1) < 0.45 AS gibberish, CASE WHEN len(text) > 28 THEN concat(substring(text, 1, 27), '…') ELSE text END AS short FROM z",
    "f9_edit_distance": f"WITH {Q0} SELECT query_id, levenshtein(text, p_name) AS distance, CASE WHEN levenshtein(text, p_name) <= 2 THEN levenshtein(text, p_name) ELSE -1 END AS within_two FROM q JOIN part ON query_id = p_partkey",
    "f29_type_hits": f"WITH {SENT} SELECT scan_id, ord, {hits('text')} AS hits FROM s",
    "f35_die_values": "WITH k AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS k FROM events) SELECT event_id, CASE WHEN len(k) <= 2 AND CAST(k AS INT) BETWEEN 1 AND 24 THEN CAST(k AS INT) END AS value, CASE WHEN len(k) <= 2 AND CAST(k AS INT) BETWEEN 1 AND 24 THEN CAST(k AS INT) END AS read FROM k",
    "f38_status": f"WITH {DET}, l AS (SELECT *, len(regexp_replace(detected_text, '\\s+', '', 'g')) AS a, len(replace({norm('coalesce(name, chr(32))')}, ' ', '')) AS b FROM d) SELECT scan_id, ord, CASE WHEN confidence < 0.58 THEN 'unknown' WHEN confidence >= 0.82 THEN 'confirmed' ELSE 'uncertain' END AS status, round(confidence * (0.55 + 0.45 * confidence), 6) AS score, CAST(CASE WHEN a <= 4 OR b = 0 THEN 1.0 WHEN b / a < 0.65 THEN 0.72 WHEN b / a > 2.2 THEN 0.88 ELSE 1.0 END AS DOUBLE) AS affinity FROM l",
    "g1_overlaps": f"WITH {DET} SELECT a.scan_id, a.ord, b.ord AS other, round({iou('a', 'b')}, 6) AS iou, round({side('a', 'b')}, 6) AS overlap_x, {iou('a', 'b')} > 0 AS touches, {side('a', 'b')} > 0.35 AND a.y + a.height / 2 BETWEEN b.y AND b.y + b.height AS in_band FROM d a JOIN d b ON a.scan_id = b.scan_id AND a.ord < b.ord",
    "m1_medians": f"WITH {DET} SELECT scan_id, {UPPER.format('height')} AS upper, median(height) AS middle, list_sort(list(height))[greatest(0, least(count(*) - 1, CAST(floor(count(*) * 0.55) AS BIGINT))) + 1] AS p55 FROM d GROUP BY scan_id",
    "s16_catalog_index": f"WITH {CAT}, {INDEX} SELECT card_ord, pass, name, search_name, normalized FROM i",
    "a2_lookup": f"WITH {CAT}, {INDEX} SELECT normalized, name FROM look",
    "j1_exact": f"WITH {CAT}, {INDEX}, {Q0}, k AS (SELECT query_id, n, {CLEANED} AS cleaned FROM q WHERE n <> '') SELECT query_id, coalesce(a.name, b.name) AS name FROM k LEFT JOIN look a ON a.normalized = n LEFT JOIN look b ON b.normalized = cleaned WHERE coalesce(a.name, b.name) IS NOT NULL",
    "j2_prefix": f"WITH {CAT}, {INDEX}, {Q0}, k AS (SELECT query_id, unnest([n, {CLEANED}]) AS v FROM q WHERE n <> '') SELECT DISTINCT query_id, name FROM k JOIN i ON len(v) >= 4 AND len(string_split(v, ' ')[1]) >= 4 AND (normalized = v OR starts_with(normalized, concat(v, ' ')) OR normalized = string_split(v, ' ')[1] OR starts_with(normalized, concat(string_split(v, ' ')[1], ' ')))",
    "p2_body_reason": f"WITH {SENT}, z AS (SELECT scan_id, ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM s) SELECT scan_id, ord, {body('x')} AS why FROM z",
    "j8_smaller_rereads": f"WITH {DET} SELECT scan_id, ord FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.scan_id = b.scan_id AND a.ord <> b.ord AND a.name = b.name AND {side('a', 'b')} > 0.5 AND b.height > a.height * 1.5)",
    "j9_land_rereads": f"WITH {DET} SELECT scan_id, ord FROM d a WHERE a.y <= 328 OR NOT EXISTS (SELECT 1 FROM d b WHERE a.scan_id = b.scan_id AND a.ord <> b.ord AND b.y <= 328 AND a.name = b.name AND {side('a', 'b')} > 0.35)",
    "j10_nearest_above": f"WITH {DET}, n AS (SELECT a.scan_id, a.ord, b.ord AS above, row_number() OVER (PARTITION BY a.scan_id, a.ord ORDER BY b.y DESC, b.ord) AS k FROM d a JOIN d b ON a.scan_id = b.scan_id AND a.ord <> b.ord AND b.y + b.height <= a.y AND {side('a', 'b')} >= 0.28) SELECT d.scan_id, d.ord, n.above FROM d LEFT JOIN n ON n.scan_id = d.scan_id AND n.ord = d.ord AND k = 1",
    "j13_row_peers": f"WITH {DET} SELECT a.scan_id, a.ord, count(*) AS peers FROM d a JOIN d b ON a.scan_id = b.scan_id AND a.ord <> b.ord AND abs(a.y - b.y) < 24 GROUP BY ALL",
    "st1_nms": f"WITH RECURSIVE {DET}, k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY confidence DESC, ord) AS k FROM d), s AS (SELECT scan_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(ord BIGINT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE)[]) AS done FROM d GROUP BY scan_id UNION ALL SELECT k.scan_id, k.k, CASE WHEN len(list_filter(done, lambda o: {iou('o', 'k')} > 0.3)) > 0 THEN done ELSE list_append(done, {{'ord': k.ord, 'x': k.x, 'y': k.y, 'width': k.width, 'height': k.height}}) END FROM s JOIN k ON k.scan_id = s.scan_id AND k.k = s.k + 1), e AS (SELECT scan_id, arg_max(done, k) AS done FROM s GROUP BY scan_id) SELECT d.scan_id, d.ord, list_contains(list_transform(done, lambda o: o.ord), d.ord) AS kept FROM d JOIN e USING (scan_id)",
    "w2_land_row": f"WITH {DET}, z AS (SELECT *, max(y + height) OVER (PARTITION BY scan_id) AS bottom, max(x + width) OVER (PARTITION BY scan_id) AS rightmost FROM d), low AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY scan_id ORDER BY y, ord) < 40 THEN 0 ELSE 1 END AS g FROM z WHERE bottom >= 80 AND y + height / 2 >= bottom * 0.55), grouped AS (SELECT *, sum(g) OVER (PARTITION BY scan_id ORDER BY y, ord) AS k FROM low), f AS (SELECT scan_id, k, {UPPER.format('y')} AS land_y, {UPPER.format('height')} AS h FROM grouped GROUP BY scan_id, k HAVING count(*) >= 2 AND max(x + width) - min(x) >= greatest(180, max(rightmost) * 0.35)) SELECT scan_id, land_y FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY h DESC, land_y) AS place FROM f) WHERE place = 1",
    "w1_title_columns": f"WITH {DET}, {COLS} SELECT scan_id, ord, column_id FROM cols",
    "a4_column_extents": f"WITH {DET}, {COLS}, {EXT} SELECT scan_id, column_id, n, round(l - pad, 6) AS left_x, round(r + pad, 6) AS right_x, round(((l - pad) + (r + pad)) / 2, 6) AS center_x, height FROM pad",
    "a5_pitches": f"WITH {DET}, {COLS}, st AS (SELECT scan_id, column_id, y - lag(y) OVER (PARTITION BY scan_id, column_id ORDER BY y, ord) AS gap FROM cols) SELECT scan_id, column_id, coalesce(list_sort(list(gap) FILTER (WHERE gap BETWEEN 32 AND 90))[CAST(floor(count(*) FILTER (WHERE gap BETWEEN 32 AND 90) / 2) AS BIGINT) + 1], 0.0) AS stack_pitch, min(gap) FILTER (WHERE gap BETWEEN 45 AND 190) AS gap_pitch FROM st GROUP BY scan_id, column_id",
    "j17_siblings": f"WITH {DET}, {LAND_BOXES} SELECT a.scan_id, a.ord, o.ord AS sibling FROM shown a JOIN shown o ON a.scan_id = o.scan_id AND a.name = o.name AND a.ord <> o.ord AND sqrt((a.kx + a.kw / 2 - (o.ux + o.uw / 2)) ** 2 + (a.ky + a.kh / 2 - (o.uy + o.uh / 2)) ** 2) < greatest(a.kw, o.uw) * 1.35",
    "j18_land_faces": f"WITH {DET}, {FACES}, {LAND_BOXES}, hit AS (SELECT l.scan_id, l.ord, f.ord AS face_ord, value, area, 1 / (1 + sqrt((f.x + f.width / 2 - (l.sx + l.sw / 2)) ** 2 + (f.y + f.height / 2 - (l.sy + l.sh / 2)) ** 2) / 40) AS score, {iou('l', 'f')} AS iou FROM shown l JOIN face f ON l.scan_id = f.scan_id AND f.x < l.ax + l.aw * 1.08 AND f.x + f.width > l.ax - l.aw * 0.08 AND f.y < l.ay + l.ah * 1.05 AND f.y + f.height > l.ay - l.ah * 0.05 AND area >= 16 AND area <= l.aw * 1.16 * l.ah * 1.1 * 0.35) SELECT scan_id, ord, face_ord, value, area, round(score, 6) AS score FROM hit WHERE iou <= 0.2",
    "j19_art_faces": f"WITH {DET}, {FACES}, {LAND_BOXES} SELECT l.scan_id, l.ord, f.ord AS face_ord, value, round(l.sx + l.sw / 2, 6) AS center_x, round(1 / (1 + sqrt((f.x + f.width / 2 - (l.sx + l.sw / 2)) ** 2 + (f.y + f.height / 2 - (l.sy + l.sh / 2)) ** 2) / 40), 6) AS score FROM shown l JOIN face f ON l.scan_id = f.scan_id AND f.x < l.sx + l.sw AND f.x + f.width > l.sx AND f.y < l.sy + l.sh AND f.y + f.height > l.sy",
    "m4_smoothed": f"WITH {PIX} SELECT image_id AS case_id, i, round(avg(CAST(r AS DOUBLE)) OVER (PARTITION BY image_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS s FROM p",
    "a11_histogram": f"WITH {PIX} SELECT image_id, luma, count(*) AS n FROM pl GROUP BY image_id, luma",
    "m7_contrast_bounds": f"WITH {PIX}, h AS (SELECT image_id, luma, count(*) AS n FROM pl GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY luma) AS acc, sum(n) OVER (PARTITION BY image_id) AS total FROM h) SELECT image_id, min(luma) FILTER (WHERE acc > floor(total * 0.02)) AS low, min(luma) FILTER (WHERE acc > least(total - 1, floor(total * 0.98))) AS high FROM c GROUP BY image_id",
    "p11_die_pixels": f"WITH {PIX}, z AS (SELECT image_id, i, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p), y AS (SELECT *, CASE WHEN hi = 0 THEN 0.0 ELSE CAST(hi - lo AS DOUBLE) / hi END AS sat FROM z) SELECT image_id, i, (sat > 0.45 AND hi > 90) OR (hi > 170 AND sat < 0.28) OR (hi < 55 AND sat < 0.35) AS die FROM y",
    "a12_edge_profile": f"WITH {PIX}, e AS (SELECT image_id, x, coalesce(abs(CAST(luma AS DOUBLE) - lag(luma) OVER (PARTITION BY image_id, y ORDER BY x)), 0.0) AS v FROM pl) SELECT image_id, x, round(avg(v), 6) AS v FROM e GROUP BY image_id, x",
    "b1_budget": "WITH s AS (SELECT o_orderkey AS scan_id, o_custkey % 200 AS raw, o_custkey % 60 AS titles, o_orderkey % 5 AS k, o_orderkey % 17 = 0 AS fast, o_custkey % 3 <> 0 AND o_custkey % 9 <= 4 AS low FROM orders), z AS (SELECT *, k = 0 OR fast AS off, titles >= 28 AS enough, raw >= 100 OR titles >= 28 AS dense FROM s) SELECT scan_id, CASE WHEN off THEN false WHEN k = 1 THEN true WHEN enough THEN false ELSE true END AS enabled, CASE WHEN off THEN 0 WHEN k = 1 THEN 36 WHEN k = 2 THEN 10 WHEN enough THEN 0 WHEN low THEN 8 WHEN dense THEN 12 ELSE 24 END AS max_attempts, CASE WHEN off THEN false WHEN k = 1 THEN true WHEN k = 2 THEN false ELSE NOT (dense OR low) END AS allow_expand, CASE WHEN off THEN false WHEN k = 1 THEN true WHEN k = 2 THEN false ELSE NOT (dense OR low) END AS enhance, CASE WHEN off THEN 'title re-OCR disabled' WHEN k = 1 THEN NULL WHEN k = 2 AND enough THEN 'enough titles from first pass' WHEN k = 2 THEN 'minimal re-OCR' WHEN enough THEN 'skipped re-OCR (dense photo, first pass enough)' WHEN dense THEN 'capped re-OCR (dense photo)' WHEN low THEN 'capped re-OCR (low memory)' END AS note FROM z",
    "s6_image_types": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE CASE WHEN p_partkey % 12 = 4 THEN 'image/tiff' ELSE 'image/jpeg' END END AS mime FROM part",
    "j22_verdicts": f"WITH {DET}, {ANN} SELECT scan_id, ord, verdict, corrected_text FROM v",
    "a7_verdict_counts": f"WITH {DET}, {ANN} SELECT scan_id, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'corrected') AS corrected, count(*) FILTER (WHERE verdict = 'not-card') AS not_card, count(*) FILTER (WHERE verdict = 'unreviewed') AS unreviewed FROM v GROUP BY scan_id",
    "d6_stored_labels": f"WITH {DET}, {ANN} SELECT scan_id, ord, round(x / 900, 6) AS x, round(height / 700, 6) AS h, verdict, trim(corrected_text) AS corrected FROM v WHERE verdict <> 'unreviewed'",
    "s8_ocr_regions": f"WITH {REG} SELECT scan_id, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, round(least(1.0, greatest(0.0, confidence * 1.2 - 0.1)), 6) AS confidence, x, y, width, height FROM r WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
    "s4_catalog_cache": "WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL) SELECT row_number() OVER (ORDER BY name) - 1 AS card_ord, name FROM n",
    "s14_first_images": "WITH f AS (SELECT l_orderkey AS upload_id, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS ord, CASE l_partkey % 4 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS declared FROM lineitem) SELECT upload_id, min(ord) AS ord, arg_min(declared, ord) AS declared FROM f WHERE declared IS NOT NULL GROUP BY upload_id",
    "k5_report_text": REPORT,
    "i1_stretched": STRETCHED,
    "g9_crop_scale": f"WITH {DET}, z AS (SELECT *, least(greatest(1.0, 480 / width, 36 / height), 1600 / width, 1600 / height) AS k FROM d) SELECT scan_id, ord, round(CASE WHEN width * height > 0 AND width * height * k * k > 240000 THEN sqrt(240000 / (width * height)) ELSE k END, 6) AS scale, CASE WHEN (height > 0 AND height <= 24 AND width / height >= 2.5) OR width >= height THEN 0.0 ELSE 90.0 END AS angle, round(5 + x / 2, 6) AS mapped_x, round(height / 2, 6) AS mapped_h FROM d JOIN z USING (scan_id, ord, x, width, height)",
    "t5_search": SEARCHED,
    "a8_report": SECTION_ROWS,
    "g11_boxes": DERIVED,
    "w4_gap_bands": GAPS,
    "st9_tokens": NO_TOKENS,
    "j20_trace": TRACED,
}
