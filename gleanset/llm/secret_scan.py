"""Secret scan: fixed patterns, and a password guess-cost dynamic program over values in a credential context.

The cost of a value is the least log10 number of guesses over all ways to cut it into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans; each further segment costs a factor of ten. Values that cost at least
10 ** min_cost guesses are secrets. The dictionary is the corpus's own most frequent words (a fixed number of ranks, so
its broadcast is bounded) over a short list of common passwords.

Defined results: a null or empty text has no spans. Spans are in code points of the whole text, end exclusive; a value
that touches a pattern's span isn't reported again. Ties in the dynamic program don't matter: only the cost is used.
Repeated rows are scanned one by one; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from gleanset.llm.common import frequent, id_and_text, map_arrow, word_counts, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?|authorization|bearer)["']?[\x20\t]*(?:[:=]|=>)[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)

#: Common passwords by rank, and the rows of a keyboard.
COMMON = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou master sunshine ashley bailey shadow superman "
    "football michael ninja mustang welcome admin login princess solo starwars passw0rd hello freedom whatever trustno1 hunter "
    "secret changeme default root guest test user summer winter spring autumn love flower orange computer internet server database"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301$5!7", "aaeolssit")

DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d")
REPEAT = re.compile(r"(.{1,12}?)\1+", re.DOTALL)
MAX_WORD = 24
SEGMENT = 1.0


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, 0), (1, -1)):
                if 0 <= y + dy < len(KEYBOARD) and 0 <= x + dx < len(KEYBOARD[y + dy]):
                    near.setdefault(key, set()).add(KEYBOARD[y + dy][x + dx])
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEAR = _neighbours()


def ranks(common_words: list[str] = ()) -> dict[str, float]:
    """log10 of each word's rank: the common passwords first, then the corpus's words by frequency."""
    out: dict[str, float] = {}
    for i, w in enumerate([*COMMON, *common_words], 1):
        out.setdefault(w, math.log10(i + 1))
    return out


def corpus_ranks(docs: DataFrame, size: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Ranks of the corpus's most frequent words of four letters or more, counted over all texts; size bounds the broadcast."""
    counted = word_counts(id_and_text(docs, id_col, text_col), keep=lambda w: 4 <= len(w) <= MAX_WORD and w.isalpha())
    return ranks([word for word, _ in frequent(written(counted), size)])


def _alphabet(value: str) -> float:
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c < "\x7f" and not c.isalnum() for c in value) + 100 * any(c > "\x7f" for c in value)
    return math.log10(max(size, 10))


def _walk_ends(low: str) -> list[int]:
    """For each start, the end of the longest keyboard walk, or of the run of characters by steps of one, from there."""
    n = len(low)
    ends = list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if low[i + 1] in NEAR.get(low[i], ""):
            ends[i] = ends[i + 1]
    for step in (1, -1):
        end = n
        for i in range(n - 2, -1, -1):
            if ord(low[i + 1]) - ord(low[i]) != step:
                end = i + 1
            ends[i] = max(ends[i], end)
    return ends


def guess_cost(value: str, rank: dict[str, float], limit: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of the value takes; limit, if it takes as many or more.

    Places that cost the limit already are left out, and so are repeats that begin inside a run of the same unit whose first
    start is as cheap from there on, so that time grows with the value's length."""
    n, per_char = len(value), _alphabet(value)
    low = value.lower()
    if len(low) != n:  # letters whose lower case is longer
        low = value
    plain = low.translate(LEET)
    walks = _walk_ends(low)
    done, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)  # the cheapest that ends here: with any segment, with brute force
    done[0] = 0.0
    last = 0  # the last place that is reached under the limit
    run: tuple[int, int, int] | None = None  # start, unit and end of the latest run of repeats

    def reach(j: int, cost: float) -> None:
        nonlocal last
        if cost < done[j]:
            done[j] = cost
            if cost < limit and j > last:
                last = j

    for i in range(n):
        if i > last:
            return limit
        if done[i] >= limit:
            continue
        base = done[i] + (SEGMENT if i else 0.0)
        brute[i + 1] = min(brute[i], base) + per_char
        reach(i + 1, brute[i + 1])
        for j in range(i + 3, min(n, i + MAX_WORD) + 1):
            found = rank.get(low[i:j])
            if found is None and (found := rank.get(plain[i:j])) is not None:
                found += 1
            if found is not None:
                upper = sum(a != b for a, b in zip(value[i:j], low[i:j]))
                reach(j, base + found + math.log10(1 + upper * (j - i)))
        if m := DATE.match(value, i):
            reach(m.end(), base + (2.1 if m.end() - i == 4 else 4.6))
        inside = False
        if run and i + 2 * run[1] <= run[2] and (i - run[0]) % run[1] == 0:
            first = done[run[0]] + (SEGMENT if run[0] else 0.0)
            inside = base + math.log10(2) >= first + math.log10((i - run[0]) // run[1] + 2)
        elif run and i + 2 * run[1] <= run[2]:
            # Another phase of the run: its first start, less than a unit after the run's, has done the same.
            s = run[0] + (i - run[0]) % run[1]
            inside = s < i and base + math.log10(2) >= done[s] + (SEGMENT if s else 0.0) + math.log10((i - s) // run[1] + 2)
        if not inside and (m := REPEAT.match(low, i)):
            unit = len(m[1])
            if run is None or run[1] != unit or i >= run[2] - unit:
                run = (i, unit, m.end())
            for j in range(i + 2 * unit, m.end() + 1, unit):
                reach(j, base + unit * per_char + math.log10((j - i) // unit))
        for j in range(i + 3, walks[i] + 1):
            cost = base + math.log10(50 * (j - i)) + 0.3 * (j - i - 2)
            if cost >= limit:
                break
            reach(j, cost)
    return min(done[n], limit)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, rank: dict[str, float], min_cost: float = 10.0) -> tuple[list, list]:
    """The base spans, and those of values in a credential context that are hard to guess."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        if not any(x < b and a < y for x, _, y in base) and guess_cost(m[1], rank, min_cost) >= min_cost:
            more.append((a, 3, b))
    return base, more


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, rank: dict[str, float] | None = None, min_cost: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, a row for each input row. rank: see ranks(); by default the corpus's own words."""
    rank = corpus_ranks(docs, id_col=id_col, text_col=text_col) if rank is None else rank
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def rows(ids, texts):
        out = []
        for t in texts:
            base, more = scan(t, shared.value, min_cost)
            n = [sum(k == x for _, x, _ in base) for k in range(3)]
            out.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
        return [ids, *zip(*out)]

    return map_arrow(id_and_text(docs, id_col, text_col), SCHEMA, rows)
