"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton is built over the pieces as arrays. It runs once over a segment; at every
position its output links lead to all pieces that end there, the longest first, and each
may better the best score up to that position. Segments move side by side in numpy, one
position a step; a few long ones go one by one through the same arrays.

A text is cut into segments where no piece reaches across: before a space sign (pieces
hold it only in front, which is checked when the vocabulary is taken up) and between
characters that the vocabulary never joins. So the best path of a text is that of its
segments, and segments met before are remembered.

The ids are those of the path with the greatest sum of scores, as in a unigram model.
The scores of a vocabulary that was made by merges are the order of its merges: there the
path is still the best one by score, but not the one that replaying the merges gives.
No vocabulary is trained here.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import parts, shipped
from .automata import HALF, LOW, packed

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()


@dataclass
class Vocabulary:
    """Pieces by id; ``kinds``: n for normal, b for a byte, c for control and unknown."""

    pieces: list[str]
    scores: list[float]
    kinds: str


def load_vocabulary(model_file: str) -> Vocabulary:
    """The pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    kind = lambda i: "b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unknown(i) else "n"
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], "".join(map(kind, ids)))


@dataclass
class PieceAutomaton:
    """States of the trie of pieces by their place in ``table``; symbol 0 is any character that no piece holds."""

    symbol_of: dict[str, int]
    table: np.ndarray
    root: int
    #: By state: where it falls back to, the piece that ends in it (or -1), its length, and the next state on the way back in which one ends (or -1).
    fail: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    link: np.ndarray
    lists: list[list] = field(default_factory=list, repr=False)

    @classmethod
    def of(cls, pieces: dict[str, int]) -> PieceAutomaton:
        symbol_of = {c: i for i, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        moves: list[dict[int, int]] = [{}]
        depth, ends = [0], [-1]
        for p, i in pieces.items():
            s = 0
            for c in p:
                to = moves[s].get(symbol_of[c])
                if to is None:
                    to = moves[s][symbol_of[c]] = len(moves)
                    moves.append({})
                    depth.append(depth[s] + 1)
                    ends.append(-1)
                s = to
            ends[s] = i
        fail, link = [0] * len(moves), [-1] * len(moves)
        waiting = deque(moves[0].values())
        while waiting:
            s = waiting.popleft()
            for c, to in moves[s].items():
                waiting.append(to)
                f = fail[s]
                while f and c not in moves[f]:
                    f = fail[f]
                fail[to] = moves[f].get(c, 0)
                link[to] = fail[to] if ends[fail[to]] >= 0 else link[fail[to]]
        place, table = packed(moves, len(symbol_of) + 1)

        def by_place(values, moved: bool) -> np.ndarray:
            out = np.full(len(table), -1, dtype=np.int64)
            values = np.array(values, dtype=np.int64)
            out[place] = np.where(values >= 0, place[values], -1) if moved else values
            return out

        return cls(symbol_of, table, int(place[0]), by_place(fail, True), by_place(ends, False), by_place(depth, False), by_place(link, True))

    def moved(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each."""
        cell = self.table.take(state + symbol)
        out = cell & LOW
        lost = np.flatnonzero((cell >> HALF) != state)
        s, c = state[lost], symbol[lost]
        while len(lost):
            at_root = s == self.root
            out[lost[at_root]] = self.root
            lost, s, c = lost[~at_root], self.fail.take(s[~at_root]), c[~at_root]
            cell = self.table.take(s + c)
            found = (cell >> HALF) == s
            out[lost[found]] = cell[found] & LOW
            lost, s, c = lost[~found], s[~found], c[~found]
        return out

    def walk(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """End and state of each place where a piece ends, through plain lists, for one long segment."""
        if not self.lists:
            self.lists = [x.tolist() for x in (self.table, self.fail, self.piece, self.link)]
        table, fail, piece, link = self.lists
        low, s = int(LOW), self.root
        for end, c in enumerate(symbols, 1):
            while True:
                cell = table[s + c]
                if cell >> HALF == s:
                    s = cell & low
                    break
                if s == self.root:
                    break
                s = fail[s]
            out = s if piece[s] >= 0 else link[s]
            while out >= 0:
                yield end, out
                out = link[out]


def _segments(pieces: dict[str, int]) -> re.Pattern:
    """Cuts where no piece reaches across: before space signs, around characters that stand in no longer piece, and behind a run of inner characters.

    Inner are the letters, and whatever follows an inner character in some piece.
    """
    after: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            after.setdefault(a, set()).add(b)
    joined = set(after).union(*after.values())
    alone = {c for p in pieces for c in p} - joined - {SPACE}
    inner: set[str] = set()
    waiting = [c for c in joined if c.isalpha()]
    while waiting:
        c = waiting.pop()
        if c not in inner and c != SPACE:
            inner.add(c)
            waiting += after.get(c, ())
    one_of = lambda chars: "".join(map(re.escape, sorted(chars)))
    w, i = one_of(inner), one_of(alone)
    rest = f"[^{w}{i}{SPACE}]"
    return re.compile((f"[{i}]|" if i else "") + (f"{SPACE}*{rest}*[{w}]+|" if w else "") + f"{SPACE}*{rest}+|{SPACE}+")


class Codec:
    """Encodes with a vocabulary; segments of up to ``long`` characters move side by side, ``remembered`` of them are kept."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = 300_000, long: int = 48):
        self.v, self.long = vocabulary, long
        normal = {p: i for i, (p, k) in enumerate(zip(vocabulary.pieces, vocabulary.kinds, strict=True)) if k == "n"}
        if odd := next((p for p in normal if SPACE in p.lstrip(SPACE)), None):
            raise ValueError(f"a piece with a space sign behind another character: {odd!r}")
        self.automaton = PieceAutomaton.of(normal)
        self.score_of = np.array(vocabulary.scores)
        self.alone = {p for p in normal if len(p) == 1}
        top = max(map(ord, self.automaton.symbol_of), default=0) + 2  # the last place is for characters beyond
        self.symbol_at, self.free_at = np.zeros(top, dtype=np.int64), np.ones(top, dtype=bool)
        for c, i in self.automaton.symbol_of.items():
            self.symbol_at[ord(c)], self.free_at[ord(c)] = i, c not in self.alone
        #: What a character costs that no piece covers alone: below every piece.
        self.unknown = min(vocabulary.scores[i] for i in normal.values()) - 10
        self.byte_ids = [0] * 256
        self.text_of = np.array([p.replace(SPACE, " ") if k == "n" else "" for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)], dtype=object)
        self.high = np.zeros(len(vocabulary.pieces), dtype=bool)
        for i, kind in enumerate(vocabulary.kinds):
            if kind == "b":
                byte = int(vocabulary.pieces[i][3:-1], 16)
                self.byte_ids[byte] = i
                self.text_of[i], self.high[i] = chr(byte), byte > 127
        self.segments = _segments(normal)
        self.room, self.known = remembered, {}

    def _paths(self, segments: list[str]) -> Iterator[tuple[float, list[int]]]:
        """Best score and ids (-1 for a character spelled in bytes) of each segment, side by side; of equal scores the longer last piece wins."""
        a, n = self.automaton, len(segments)
        lengths = np.array([len(s) for s in segments])
        order = np.argsort(-lengths, kind="stable")
        lengths, most = lengths[order], int(lengths.max())
        symbols = np.zeros((most, n), dtype=np.int64)
        free = np.zeros((most, n), dtype=bool)
        codes = np.frombuffer("".join([segments[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        there = np.arange(most)[:, None] < lengths
        symbols.T[there.T] = self.symbol_at.take(np.minimum(codes, len(self.symbol_at) - 1))
        free.T[there.T] = self.free_at.take(np.minimum(codes, len(self.symbol_at) - 1))
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        came, size = np.full((most + 1, n), -1, dtype=np.int64), np.ones((most + 1, n), dtype=np.int64)
        state = np.full(n, a.root, dtype=np.int64)
        for t in range(most):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # those longer than t
            state = a.moved(state[:live], symbols[t, :live])
            best[t + 1, :live] = np.where(free[t, :live], best[t, :live] + self.unknown, -np.inf)
            out = np.where(a.piece.take(state) >= 0, state, a.link.take(state))
            col = np.flatnonzero(out >= 0)
            out = out[col]
            while len(col):
                length, i = a.length.take(out), a.piece.take(out)
                s = best[t + 1 - length, col] + self.score_of.take(i)
                old = best[t + 1, col]
                better = (s > old) | ((s == old) & (length > size[t + 1, col]))
                at = col[better]
                best[t + 1, at], came[t + 1, at], size[t + 1, at] = s[better], i[better], length[better]
                out = a.link.take(out)
                col, out = col[out >= 0], out[out >= 0]
        ids: list[list[int]] = [[] for _ in range(n)]
        at, rows = lengths.copy(), np.arange(n)
        while len(rows):
            for k, i in zip(rows.tolist(), came[at, rows].tolist(), strict=True):
                ids[k].append(i)
            at = at - size[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        back = np.argsort(order, kind="stable").tolist()
        scores = best[lengths, np.arange(n)].tolist()
        for k in back:
            yield scores[k], ids[k][::-1]

    def _long_path(self, segment: str) -> tuple[float, list[int]]:
        """The same for one segment of any length, in 16 bytes a character besides the symbols."""
        a, n = self.automaton, len(segment)
        best, came = array("d", [0.0]), array("q", [-1])
        length, piece, scores = a.length, a.piece, self.v.scores
        get = a.symbol_of.get

        def reach(end: int) -> None:
            while len(best) <= end:
                p = len(best)
                best.append(best[p - 1] + self.unknown if segment[p - 1] not in self.alone else float("-inf"))
                came.append(-1)

        for end, s in a.walk([get(c, 0) for c in segment]):
            reach(end)
            i, size = int(piece[s]), int(length[s])
            score = best[end - size] + scores[i]
            if score > best[end] or score == best[end] and (came[end] < 0 and size > 1 or came[end] >= 0 and size > len(self.v.pieces[came[end]])):
                best[end], came[end] = score, i
        reach(n)
        ids, at = [], n
        while at:
            ids.append(came[at])
            at -= len(self.v.pieces[came[at]]) if came[at] >= 0 else 1
        return best[n], ids[::-1]

    def learn(self, segments: set[str]) -> dict[str, tuple[float, bytes]]:
        """Score and ids (little-endian unsigned 32-bit) of segments not met before; as many as there is room for are remembered."""
        short = [s for s in segments if len(s) <= self.long]
        found: dict[str, tuple[float, bytes]] = {}
        for k in range(0, len(short), 8192):
            some = short[k : k + 8192]
            found |= {s: (score, self._spelled(s, ids)) for s, (score, ids) in zip(some, self._paths(some), strict=True)}
        for s in segments:
            if len(s) > self.long:
                score, ids = self._long_path(s)
                found[s] = score, self._spelled(s, ids)
        for s in short:
            if len(self.known) >= self.room:
                break
            self.known[s] = found[s]
        return found

    def _spelled(self, segment: str, ids: list[int]) -> bytes:
        if min(ids) >= 0:
            return array("I", ids).tobytes()
        out, at = array("I"), 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.v.pieces[i])
            else:
                # a space sign that no piece covers stands for a space, and is spelled as one
                out.extend([self.byte_ids[b] for b in segment[at].replace(SPACE, " ").encode("utf-8", "surrogatepass")])
                at += 1
        return out.tobytes()

    def _cut(self, text: str) -> list[str]:
        """Segments of a text, the first with a space sign before it. A space sign in the text itself stands alone, as None, and is spelled in bytes."""
        if SPACE not in text:
            return self.segments.findall(SPACE + text.replace(" ", SPACE))
        out: list = []
        for k, part in enumerate(text.split(SPACE)):
            out += [None] if k else []
            out += self.segments.findall((SPACE if not k else "") + part.replace(" ", SPACE))
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[float, bytes]]:
        """Score and ids (little-endian unsigned 32-bit) of each text."""
        cut = [self._cut(t) for t in texts]
        known = self.known
        fresh = self.learn({s for line in cut for s in line if s not in known and s is not None})
        sign = self.unknown, array("I", [self.byte_ids[b] for b in _SPACE_BYTES]).tobytes()
        out = []
        for line in cut:
            found = [sign if s is None else known.get(s) or fresh[s] for s in line]
            out.append((sum([x[0] for x in found]), b"".join([x[1] for x in found])))
        return out

    def encode(self, text: str) -> tuple[float, bytes]:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        at = np.frombuffer(ids, dtype="<u4")
        texts, high = self.text_of[at], self.high[at]
        if high.any():  # a run of bytes above 127 is characters; a byte below is one by itself
            starts = np.flatnonzero(high & ~np.r_[False, high[:-1]])
            ends = np.flatnonzero(high & ~np.r_[high[1:], False])
            for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
                raw = bytes(map(ord, texts[a : z + 1]))
                texts[a : z + 1] = ""
                texts[a] = raw.decode("utf-8", "replace")
        return "".join(texts.tolist()).removeprefix(" ")


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array of int), score of each whole text; null and empty texts are the lone space sign. Null and repeated ids stay as they are."""
    shared = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared())
        for batch in parts(batches):
            found = codec.encode_all(_texts(batch))
            ids = pa.array([array("i", b) for _, b in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([float(s) for s, _ in found])], ["doc_id", "ids", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text of rows with ``ids``; null ids give an empty text."""
    shared = shipped(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared())
        for batch in parts(batches):
            texts = [codec.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, decoded_sha256, round_trip of each row: encoded, then decoded again.

    Null and empty texts are the lone space sign; repeated rows and null ids are judged
    like any other; an empty table gives an empty result, and further columns are ignored.
    """
    shared = shipped(docs.sparkSession, vocabulary)
    names = ["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared())
        for batch in parts(batches):
            texts = _texts(batch)
            found = codec.encode_all(texts)
            back = [codec.decode(ids) for _, ids in found]
            columns = [
                pa.array([len(b) // 4 for _, b in found], pa.int64()), pa.array([zlib.crc32(b) for _, b in found], pa.int64()),
                pa.array([float(s) for s, _ in found], pa.float64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean")
