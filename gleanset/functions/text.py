"""Text functions on columns: normalised names, token rules and the measures that title filters use. All run in the JVM but for
type_line_hits(), an Arrow function, which therefore can't stand in a lambda."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words, letters and thresholds that results depend on.
FUNCTION_WORDS = {"of": "of", "ef": "of", "af": "of", "oe": "of", "ro": "to", "per": "plow", "plow": "plowshares", "shares": "plowshares", "the": "the", "he": "the", "teh": "the", "thc": "the", "tbe": "the", "to": "to", "te": "to", "ta": "to"}
TOKEN_NAMES = ("treasure", "treasury", "food", "clue", "blood", "map", "powerstone", "junk", "gold", "shard", "lander", "bait")
BASICS = ("plains", "island", "swamp", "mountain", "forest", "wastes")
BASIC_LANDS = tuple(f"{p}{b.capitalize()}" for p in ("", "Snow-Covered ") for b in BASICS)
LAND_WORDS = "mesa|forge|foundry|springs|coliseum|encampment|shrine|pool|vent|tarn|delta|strand|steppe|pass|gate|quarter|monument|cathedral|tower|cemetery|garden|sanctuary|pathway|channel|cap|camp|mire|volcano|barrens|highland|waterfront|river|wood|trail|clearing|spires|hollow|cavern|factory|tomb|palace|arena|colony|citadel|expanse|haven|hideout|lair|labyrinth|mine|outpost|port|reach|summit|territory|yard|fields|grounds|basin|bed|bridge|crossing|cascade|causeway|coast|creek|falls|flats|glade|grove|heath|marsh|moor|peak|prairie|range|ridge|shore|vale|wilds"
SHORT_TITLE_WORDS = ("of", "the", "to", "a", "an", "in", "on", "or")
TYPE_WORDS = ("creature", "instant", "sorcery", "enchantment", "artifact", "legendary", "planeswalker", "battle", "land", "basic", "snow", "tribal", "kindred", "aura", "equipment", "vehicle", "human", "wizard", "warrior", "cleric", "goblin", "elf", "zombie", "soldier", "knight", "shaman", "rogue", "ally", "berserker", "monk", "dragon", "angel", "demon", "spirit", "beast", "elemental", "advisor", "mercenary")
OCR_REWRITES = (
    ("larthshaker", "earthshaker"), ("swons", "swords"), ("gobtin", "goblin"), ("gablin", "goblin"), ("fickerw(?:ine|isp)", "flickerwisp"), ("ghosifir", "ghostfire slice"), ("gimmer", "glimmer"), ("mapla", "magda"), ("ararem", "brazen"),
    ("senee", "seneschal"), ("hal ef", "of the"), ("adrlinr", "adeline resplendent cathar"), ("alrlinr", "adeline resplendent cathar"), ("atr linr", "adeline resplendent cathar"), ("laetle he m", "laelia the blade reforged"), ("ethe the m", "laelia the blade reforged"),
)
DIGIT_LIKE = ("oOlIi|ZzSsGbB", "0011112255668")
EXPANDED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ĳ": "ij", "½": "1 2", "¼": "1 4", "¾": "3 4"}


@lru_cache
def _plain_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one ASCII letter or digit, and these."""
    source, target = [], []
    for code in range(0xA0, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not "̀" <= c <= "ͯ").lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x computed once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def normalize_name(x: Column) -> Column:
    """Lower case, accents and apostrophes dropped, anything but a-z and 0-9 to single spaces."""
    plain = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), EXPANDED.items(), F.lower(x))
    plain = F.regexp_replace(F.translate(plain, *_plain_letters()), "['’̀-ͯ]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def split_faces(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\s*//\s*"), lambda p: F.trim(p)), lambda p: p != "")


def sanitize(x: Column) -> Column:
    """Text without what precedes its first letter or digit, and without a lone initial such as "A. "."""
    head = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^[^A-Za-z0-9]+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"^[A-Za-z]\.\s+", ""), "^[^A-Za-z0-9]+", ""), r"^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def expand_ocr_variants(x: Column) -> Column:
    """Known misreadings rewritten in order, then punctuation and runs of spaces to one space."""
    for pattern, value in OCR_REWRITES:
        x = F.regexp_replace(x, rf"\b(?:{pattern})\b", value)
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[,.'`]+", " "), r"\s+", " "))


def clean_query(normalized: Column) -> Column:
    """Without one-character tokens at either end, misreadings rewritten."""
    t = tokens(normalized)
    kept = F.filter(t, lambda w, i: (F.length(w) > 1) | ((i > 0) & (i < F.size(t) - 1)))
    return expand_ocr_variants(F.array_join(kept, " "))


def distinctive_query(normalized: Column) -> Column:
    """The cleaned tokens, and neighbouring raw tokens joined where that gives seven characters or more."""
    raw = tokens(normalized)
    joined = F.zip_with(raw, F.slice(raw, F.lit(2), F.greatest(F.size(raw), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_join(F.concat(tokens(clean_query(normalized)), F.filter(joined, lambda p: p.isNotNull() & (F.length(p) >= 7))), " ")


def compact(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def consonants(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z]|[aeiouy]", "")


def count_letters(x: Column) -> Column:
    return F.regexp_count(x, F.lit("[A-Za-z]"))


def count_digits(x: Column) -> Column:
    return F.regexp_count(x, F.lit("[0-9]"))


def lower_words(x: Column) -> Column:
    return words(F.regexp_replace(F.lower(x), r"[^a-z\s]", " "))


def short_junk_words(x: Column) -> Column:
    return F.size(F.filter(lower_words(x), lambda w: (F.length(w) <= 2) & ~w.isin(*SHORT_TITLE_WORDS)))


def type_line_hits(x: Column) -> Column:
    """How many of a text's words are at most one or two edits from a word of type lines."""
    return _type_words(F.regexp_replace(F.lower(x), r"[^a-z\s]", " "))


@F.arrow_udf(T.IntegerType())
def _type_words(texts: pa.Array) -> pa.Array:
    return pa.array([None if v is None else sum(map(_is_type_word, v.encode().split())) for v in texts.to_pylist()], pa.int32())


@lru_cache(1 << 17)
def _is_type_word(word: bytes) -> bool:
    """Words repeat, so that each is judged once a task and not once a place."""
    near = _type_places().get(len(word), ())
    letters = _letters(word) if near else 0
    # An edit takes one letter away and adds one at most.
    return any((letters & ~own).bit_count() <= most and (own & ~letters).bit_count() <= most and _edits(word, kind, where) <= most for own, most, kind, where in near)


def _letters(word: bytes) -> int:
    found = 0
    for c in word:
        found |= 1 << c
    return found


@lru_cache
def _type_places() -> dict[int, list[tuple[int, int, bytes, dict[int, int]]]]:
    """Of each length of a word, the type words that it may stand for: letters, most edits, word, places of its letters."""
    out: dict[int, list] = {}
    for kind in (k.encode() for k in TYPE_WORDS):
        where = {c: sum(1 << i for i, d in enumerate(kind) if d == c) for c in kind}
        for n in range(3, len(kind) + 3):
            most = 2 if n >= 5 or len(kind) >= 7 else 1
            if abs(n - len(kind)) <= most:
                out.setdefault(n, []).append((_letters(kind), most, kind, where))
    return out


def _edits(word: bytes, kind: bytes, where: dict[int, int]) -> int:
    """Levenshtein distance, with the places of the kind's characters as bits (Myers, 1999)."""
    full, last, score = (1 << len(kind)) - 1, 1 << len(kind) - 1, len(kind)
    plus, minus = full, 0
    for c in word:
        same = where.get(c, 0)
        h = (((same & plus) + plus) ^ plus) | same
        v = same | minus
        up, down = minus | ~(h | plus), plus & h
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(v | up)) & full, up & v & full
    return score


def mixed_case_runs(word: Column) -> Column:
    """Changes from lower to upper case, and from upper to lower but for one after the first letter."""
    return F.regexp_count(word, F.lit("[a-z](?=[A-Z])")) + F.regexp_count(F.substring(word, 2, 2147483647), F.lit("[A-Z](?=[a-z])"))


def consonant_run(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(F.regexp_replace(F.lower(x), "[^a-z]", ""), "[aeiouy]"), lambda p: F.length(p))), F.lit(0))


def garbled_word_ratio(x: Column) -> Column:
    """Share of words of two letters or more that look garbled. A word's case is read at its position among all words."""
    parts = F.struct(words(x).alias("raw"), F.filter(lower_words(x), lambda w: F.length(w) >= 2).alias("low"))
    return let(parts, lambda p: _garbled_share(p["raw"], p["low"]))


def _garbled_share(raw: Column, low: Column) -> Column:
    # One pattern asks whether mixed_case_runs() finds any, another whether consonant_run() of a lower-case word is 4 or more.
    odd = F.filter(
        low, lambda w, i: ((F.length(w) <= 2) & ~w.isin(*SHORT_TITLE_WORDS)) | w.rlike("[^aeiouy]{4}") | F.coalesce(F.get(raw, i), w).rlike("(?s)[a-z][A-Z]|.[A-Z][a-z]")
    )
    return F.when(F.size(low) == 0, 1.0).otherwise(F.size(odd) / F.size(low))


def token_gibberish(query: Column) -> Column:
    """Five characters or more, few vowels and few different characters."""
    c = compact(query)
    n = F.greatest(F.length(c), F.lit(1))
    distinct = F.size(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")))
    return (F.length(c) >= 5) & (F.regexp_count(c, F.lit("(?i)[aeiouy]")) / n <= 0.42) & (distinct / n < 0.45)


def is_land_name(name: Column) -> Column:
    norm = normalize_name(name)
    return norm.isin(*BASICS) | norm.rlike(rf"\b({LAND_WORDS})\b")


def is_short_spell(name: Column) -> Column:
    norm = normalize_name(name)
    return (norm != "") & ~is_land_name(name) & (F.size(F.split(norm, " ")) <= 2)


def is_basic_land(name: Column) -> Column:
    return F.coalesce(name.isin(*BASIC_LANDS), F.lit(False))


def normalize_text(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), r"\s+", " ")


def parse_die_value(x: Column) -> Column:
    """1 to 24 from one or two digits, look-alike letters read as digits; else null."""
    # One pattern holds the bounds: each use of a value in a bound would be a search of its own.
    return F.regexp_extract(F.translate(F.regexp_replace(x, r"^\s+|\s+$", ""), *DIGIT_LIKE), r"^(0?[1-9]|1[0-9]|2[0-4])[.,:;]?$", 1).try_cast("int")


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x)


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def fetch_error(x: Column) -> Column:
    """A class for the text of a failed fetch."""
    return F.when(x.rlike(r"(?i)failed to fetch|networkerror|load failed"), "network").otherwise("other")


def length_affinity(query: Column, name: Column) -> Column:
    q, n = F.length(compact(query)), F.length(compact(normalize_name(name)))
    ratio = n / F.greatest(q, F.lit(1))
    return F.when((q <= 4) | (n == 0), 1.0).when(ratio < 0.65, 0.72).when(ratio > 2.2, 0.88).otherwise(1.0)


def combined_score(similarity: Column, confidence: Column) -> Column:
    return similarity * (0.55 + 0.45 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))


def status_for_score(score: Column) -> Column:
    return F.when(score.isNull() | (score < 0.58), "unknown").when(score >= 0.82, "confirmed").otherwise("uncertain")
