"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from the model: a normaliser (dummy prefix, spaces to the piece alphabet's space mark),
the pieces (a trie whose paths spell a piece, put out its id and lead back to the root; weight: minus the score) and byte
fallback (a character that no piece spells puts out the ids of its UTF-8 bytes). Each input is composed with them on the
fly, and the tropical-semiring shortest path through the resulting acyclic machine is the encoding.

A model of type unigram needs no more. In one of type BPE, the scores order merges and don't add up, so the machine is
also composed with a pair automaton: its state is the last piece, and the arc to the next piece weighs 0 if merging the
two pieces' joint text gives just these two, else infinity. A sequence of pieces is the BPE encoding of its text if and
only if all its adjacent pairs are such (Berglund and van der Merwe, 2023), so exactly one path has finite weight.

No piece reaches over the border between a character and a following space mark, nor over line ends that only bytes
spell, so an input's machine is a chain of small machines, one for each such chunk; frequent chunks' paths are kept.

Defined results: a null or empty text has no ids (null stays null in `decoded`). The text's own U+2581 reads as a space
after decoding, as in the library. Very long chunks take time in proportion to their length. Repeated rows are encoded
one by one; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import id_and_text, map_arrow

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
INFINITY = float("inf")
BYTES_WEIGHT = 1e6
FALLBACK = -1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Codec:
    """The compiled transducers of one model file's bytes."""

    def __init__(self, model: bytes, keep: int = 120_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze = False, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("the model's normaliser has a character map; only the identity is compiled here")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if USER in self.kinds:
            raise ValueError("the model has user-defined symbols, which aren't compiled here")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.chunk = re.compile(r"(?s).+")
        else:
            lone = "".join(c for c in "\n\r\t\x0b\x0c" if c not in inside)
            self.chunk = re.compile(rf"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + (f"|[{lone}]" if lone else ""))
        self.text_of = {i: (bytes([b]) if (b := self._byte(i)) is not None else self.pieces[i].replace(MARK, " ").encode()) for i in range(len(self.pieces)) if self.kinds[i] in (NORMAL, BYTE)}
        self.text_of[self.unknown] = " ⁇ ".encode()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.keep, self.paths, self.older = keep, {}, {}

    def _byte(self, i: int) -> int | None:
        return int(self.pieces[i][3:5], 16) if self.kinds[i] == BYTE else None

    def normalise(self, text: str) -> str:
        """The output side of the normaliser transducer."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merged(self, text: str, log: list | None = None) -> list[str]:
        """The symbols that are left when the best-scored adjacent pair is merged again and again. For short texts.

        log: gets the numbers of the characters that each merged symbol begins and ends at, and its score."""
        symbols, starts = list(text), list(range(len(text) + 1))
        while len(symbols) > 1:
            best, at = -INFINITY, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del starts[at + 1]
            if log is not None:
                log.append((starts[at], starts[at + 1], best))
        return symbols

    def edge(self, piece: str) -> tuple[list, list] | None:
        """The symbols that stand at the right and at the left edge of a piece while it is merged, each with the score of
        the merge that ends it; None if merging its text doesn't give the piece, or not by falling scores."""
        if piece not in self.edges:
            log: list = []
            whole = self.merged(piece, log) == [piece] and all(x[2] >= y[2] for x, y in zip(log, log[1:]))
            right, left = [[0, piece[-1:]]], [[0, piece[:1]]]
            for a, b, score in log:
                if b == len(piece):
                    right[-1][0] = score
                    right.append([-INFINITY, piece[a:]])
                if a == 0:
                    left[-1][0] = score
                    left.append([-INFINITY, piece[:b]])
            right[-1][0] = left[-1][0] = -INFINITY
            self.edges[piece] = (right, left) if whole else None
        return self.edges[piece]

    def follows(self, last: str, piece: str) -> bool:
        """Whether the pair automaton's arc from last to piece has weight 0; last is empty at the start of a chunk."""
        found = self.pairs.get((last, piece))
        if found is None:
            found = self._follows(last, piece)
            if len(self.pairs) < 300_000:
                self.pairs[last, piece] = found
        return found

    def _follows(self, last: str, piece: str) -> bool:
        edges = self.edge(last) if last else None, self.edge(piece)
        if None in edges:
            return self.merged(last + piece) == ([last, piece] if last else [piece])
        right, left = edges[0][0], edges[1][1]
        i = j = 0
        while True:  # the merges at both edges in turn; a better one across the border would come first
            (end_right, a), (end_left, b) = right[i], left[j]
            across = self.ids.get(a + b)
            if across is not None and self.scores[across] > end_right and self.scores[across] >= end_left:
                return False
            if end_right == end_left == -INFINITY:
                return True
            if end_right >= end_left:
                i += 1
            else:
                j += 1

    def arcs(self, chunk: str, at: int) -> list[tuple[int, str, int]]:
        """(end, piece, id) of the arcs from a position, shortest first; the id of byte fallback is FALLBACK."""
        out, node, end, n = [], self.trie, at, len(chunk)
        while end < n and (node := node.get(chunk[end])) is not None:
            end += 1
            if (number := node.get("")) is not None:
                out.append((end, chunk[at:end], number))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, chunk[at], FALLBACK))
        return out

    def shortest_path(self, chunk: str) -> list[int]:
        """Ids along the cheapest path through the composed machine."""
        ids: list[int] = []
        for number, piece in self._only_path(chunk) if self.bpe else self._cheapest_path(chunk):
            if number != FALLBACK:
                ids.append(number)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return ids

    def _cheapest_path(self, chunk: str) -> list[tuple[int, str]]:
        """Relaxation in topological order; a state is the number of characters read."""
        n = len(chunk)
        best: list = [(INFINITY, 0, 0)] * (n + 1)  # weight, position before, id
        best[0] = (0.0, 0, 0)
        for at in range(n):
            for end, _, number in self.arcs(chunk, at):
                weight = best[at][0] + (BYTES_WEIGHT if number == FALLBACK else -self.scores[number])
                if weight < best[end][0]:
                    best[end] = (weight, at, number)
        out, at = [], n
        while at:
            _, before, number = best[at]
            out.append((number, chunk[before:at]))
            at = before
        return out[::-1]

    def _only_path(self, chunk: str) -> list[tuple[int, str]]:
        """With the pair automaton, a state is (characters read, last piece) and all finite arcs weigh 0: the one path to the
        end is the shortest. Depth first, longest arc first; states that lead nowhere aren't entered again."""
        n, pairs, follows = len(chunk), self.pairs, self.follows
        arcs: list = [None] * n
        dead: set = set()
        path: list = []
        at, last, k = 0, "", 0
        while at < n:
            here = arcs[at]
            if here is None:
                here = arcs[at] = self.arcs(chunk, at)[::-1]
            for k in range(k, len(here)):
                end, piece, number = here[k]
                allowed = pairs.get((last, piece))
                if (follows(last, piece) if allowed is None else allowed) and not (dead and (end, piece) in dead):
                    path.append((number, piece, at, last, k + 1))
                    at, last, k = end, piece, 0
                    break
            else:
                dead.add((at, last))
                _, _, at, last, k = path.pop()
        return [(number, piece) for number, piece, *_ in path]

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        out = []
        paths, older = self.paths, self.older
        for chunk in self.chunk.findall(self.normalise(text)):
            found = paths.get(chunk)
            if found is None:
                found = older.get(chunk)
                if found is None:
                    found = np.array(self.shortest_path(chunk), "<i4").tobytes()
                if len(chunk) <= 48:
                    if len(paths) >= self.keep:
                        self.paths, self.older = {}, paths
                        paths, older = self.paths, self.older
                    paths[chunk] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.text_of.get(i, b"") for i in ids])
        text = text.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Codec:
    """One codec for each Python worker, which keeps it from task to task."""
    return Codec(model)


def sentence_pieces(docs: DataFrame, model_path: str = DEFAULT_MODEL, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text back), and ids."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(ids, texts):
        codec = compiled(model.value)
        packed = [codec.packed(t) for t in texts]
        first, count = min(codec.byte_ids.values(), default=0), len(codec.byte_ids)
        arrays = [np.frombuffer(p, "<i4") for p in packed]
        n_bytes = [int(np.count_nonzero((a >= first) & (a < first + count))) for a in arrays]
        sha = [hashlib.sha256(p).hexdigest() for p in packed]
        back = []
        for a, t in zip(arrays, texts):
            back.append(codec.decode(a.tolist()) == (t or "").replace(MARK, " ") if not codec.squeeze else None)
        out = [ids, [len(a) for a in arrays], n_bytes, sha, back]
        if with_ids:
            offsets = np.zeros(len(arrays) + 1, "<i4")
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
        return out

    schema = "doc_id long, n_ids long, n_byte_ids long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return map_arrow(id_and_text(docs, id_col, text_col), schema, rows)


def decode_pieces(encoded: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of an array column of ids; null stays null, unknown ids are skipped."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def rows(ids, sequences):
        codec = compiled(model.value)
        return [ids, [None if s is None else codec.decode(s) for s in sequences]]

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id long, decoded string", rows)
