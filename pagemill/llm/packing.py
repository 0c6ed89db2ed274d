"""Best-fit packing of token sequences by linear grouping.

Texts are tokenised and cut where they were read. The plan needs only how many pieces
have each length, at most ``capacity`` numbers however many pieces there are:

1. Large lengths (over an eighth of the capacity) are dealt, longest first, to groups of
   equal cardinality, and each is rounded up to the longest of its group.
2. How often to use which configuration of those few sizes is a linear program: it is
   solved by generating columns, priced by a knapsack over the capacity. Its whole parts
   are used; the few sizes left over are filled into the fullest configurations.
3. The actual lengths take the places of their groups, which leaves gaps.
4. Small lengths go, longest first, to the narrowest gap that holds them.

Every step works on runs of equal sequences. The plan says where the k-th piece of a
length goes; the pieces are numbered per length in parallel and look themselves up.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import numbered, parts, written

#: Splits text before the merges; the rank files are made for it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in the faster standard module, for texts in which it means the same.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\t-\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧€]")


def added_tokens(definition: bytes) -> dict[str, int]:
    """Text and id of the added tokens of a ``tokenizers`` JSON file; they must match as they are written."""
    listed = json.loads(definition).get("added_tokens") or []
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in listed):
        raise ValueError("an added token that depends on the text around it")
    return {x["content"]: x["id"] for x in listed}


class ByteTokenizer:
    """Byte-level BPE from a rank file, with the ids of frequent pieces of text remembered.

    Texts of ``added`` are one id each wherever they occur (the longest of those that
    start first), and what lies between is encoded on its own; without them they are
    spelled like any text.
    """

    def __init__(self, ranks: bytes, added: dict[str, int] | None = None, remembered: int = 400_000):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self.full = regex.compile(PATTERN)
        self.room, self.known = remembered, {}
        self.added = {k: array("I", [v]).tobytes() for k, v in (added or {}).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _missing(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode("utf-8"))).tobytes()
        if len(self.known) < self.room and len(piece) < 40:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.marks and self.marks.search(text):
            parts = self.marks.split(text)  # every other one is an added token
            return b"".join([self.added[x] if i % 2 else self._between(x) for i, x in enumerate(parts)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        pieces = (self.full if _NOT_PLAIN.search(text) else _PLAIN).findall(text)
        get = self.known.get
        return b"".join([get(p) or self._missing(p) for p in pieces])


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; all but the first have ``capacity`` ids."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)] if n else [0]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenized_pieces(docs: DataFrame, ranks: bytes, capacity: int = 2048, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each whole text as ids and ``end_id``, cut; null text is empty.

    ``added`` are the tokens of ``added_tokens``. Repeated rows and null ids are rows like any other.
    """
    shared, end = docs.sparkSession.sparkContext.broadcast(ranks), array("I", [end_id]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer(shared.value, added)
        for batch in parts(batches):
            cuts = [cut(tokenizer.encode(text) + end, capacity) for text in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            rows = np.array([(k, *p) for c in cuts for k, p in enumerate(c)], dtype=np.int64).reshape(-1, 4).T
            columns = [batch.column("doc_id").take(pa.array(of)), pa.array(rows[0].astype(np.int32)), *map(pa.array, rows[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``copies`` sequences with equal gaps; each slot is (length, first rank, offset)."""

    copies: int
    used: int = 0
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def put(self, length: int, first: int) -> None:
        self.slots.append((length, first, self.used))
        self.used += length

    def split(self, n: int) -> Run:
        """Take the first ``n`` copies away as a run of their own."""
        taken = Run(n, self.used, list(self.slots))
        self.slots = [(length, first + n, offset) for length, first, offset in self.slots]
        self.copies -= n
        return taken


def _grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, first rank, copies] of the large lengths, longest first, in groups of equal cardinality."""
    total = sum(counts.values())
    out: list[list[list[int]]] = [[] for _ in range(groups)]
    done = 0
    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            g = min(groups - 1, done * groups // total)
            until = -(-(g + 1) * total // groups)
            n = min(left, max(1, until - done))
            out[g].append([length, first, n])
            first, left, done = first + n, left - n, done + n
    return [g for g in out if g]


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence best, the largest size left among them."""
    top = next(i for i, n in enumerate(left) if n)
    take = [0] * len(sizes)
    take[top] = 1
    room = capacity - sizes[top]
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    by = np.full(room + 1, -1)
    for i, size in enumerate(sizes):
        for _ in range(min(left[i] - take[i], room // size)):
            fresh = np.zeros_like(reached)
            fresh[size:] = reached[:-size]
            fresh &= ~reached
            if not fresh.any():
                break
            by[fresh] = i
            reached |= fresh
    at = int(np.flatnonzero(reached)[-1])
    while at:
        take[by[at]] += 1
        at -= sizes[by[at]]
    while any(k > n for k, n in zip(take, left, strict=True)):  # a path through the table may repeat a size too often
        over = next(i for i, (k, n) in enumerate(zip(take, left, strict=True)) if k > n)
        take[over] -= 1
    return take


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: a knapsack, size after size."""
    stages = np.zeros((len(sizes) + 1, capacity + 1))
    for i, (size, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        best = stages[i + 1]
        best[:] = stages[i]
        if w > 0:
            for at in range(size, capacity + 1, size):  # a block may build on the block before it
                np.maximum(best[at : at + size], best[at - size : at][: capacity + 1 - at] + w, out=best[at : at + size])
    take, c = np.zeros(len(sizes)), capacity
    for i in range(len(sizes), 0, -1):
        while c >= sizes[i - 1] and stages[i, c] > stages[i - 1, c]:
            take[i - 1] += 1
            c -= int(sizes[i - 1])
    return float(stages[-1, capacity]), take


def linear_program(sizes: list[int], counts: list[int], capacity: int, tolerance: float = 1e-9, most_steps: int = 4000) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations (rows), how often to use each (fractions) so that all ``counts`` are held, and what a sequence less would save.

    The revised simplex method over generated columns. Stops where no configuration is
    worth more than a sequence by more than ``tolerance``: at most that share is then
    above the optimum. The matrices are small, so products are sums of rows: threads of a
    linear algebra library would cost more than they save.
    """
    size, demand = np.array(sizes), np.array(counts, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x, dear = np.diag(inverse) * demand, 0.0
    for _ in range(most_steps):
        dear, column = _best_column(size, inverse.sum(axis=0), capacity)
        if dear <= 1 + tolerance:
            break
        used = np.flatnonzero(column)
        d = (inverse[:, used] * column[used]).sum(axis=1)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        x = x - ratio[out] * d
        x[out] = ratio[out]
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
    return basis.T.round().astype(int), np.maximum(x, 0), dear


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: neither than the bytes take, nor than there are lengths of more than half."""
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


def plan_packing(counts: dict[int, int], capacity: int = 2048, groups: int = 128) -> list[Run]:
    """Runs that hold ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    counts = {k: n for k, n in counts.items() if n}
    runs = [Run(counts[capacity], capacity, [(capacity, 0, 0)])] if capacity in counts else []  # full by themselves
    large = _grouped({k: n for k, n in counts.items() if capacity > k and 8 * k > capacity}, groups)
    merged: list[list[list[int]]] = []
    for g in large:  # groups that round up to one size are one size
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    large = merged
    sizes, left = [g[0][0] for g in large], [sum(r[2] for r in g) for g in large]
    chosen = []
    if large:
        for take, x in zip(*linear_program(sizes, left, capacity, 1e-4)[:2], strict=True):
            used = [k for k in range(len(sizes)) if take[k]]
            times = min([int(x + 1e-7), *[left[k] // int(take[k]) for k in used]])
            if times:
                chosen.append((take.tolist(), times))
                left = [n - int(k) * times for n, k in zip(left, take, strict=True)]
    while any(left) or chosen:
        if chosen:
            take, times = chosen.pop()
        else:
            take = _fullest(sizes, left, capacity)
            times = min(n // k for n, k in zip(left, take, strict=True) if k)
            left = [n - k * times for n, k in zip(left, take, strict=True)]
        places = []  # for each place of the configuration, the actual runs that take it
        for g, k in enumerate(take):
            for _ in range(k):
                need, taken = times, []
                while need:
                    head = large[g][0]
                    n = min(need, head[2])
                    taken.append([head[0], head[1], n])
                    head[1], head[2], need = head[1] + n, head[2] - n, need - n
                    if not head[2]:
                        large[g].pop(0)
                places.append(taken)
        while places[0]:
            n = min(p[0][2] for p in places)
            run = Run(n)
            for p in places:
                run.put(p[0][0], p[0][1])
                p[0][1], p[0][2] = p[0][1] + n, p[0][2] - n
                if not p[0][2]:
                    p.pop(0)
            runs.append(run)
    _best_fit_small({k: n for k, n in counts.items() if 8 * k <= capacity}, runs, capacity)
    return runs


def _best_fit_small(small: dict[int, int], runs: list[Run], capacity: int) -> None:
    by_gap: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_gap[capacity - run.used].append(run)
    gaps = sorted(g for g in by_gap if g)

    def shelve(run: Run) -> None:
        gap = capacity - run.used
        if gap and not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append(run)

    for length in sorted(small, reverse=True):
        first, left = 0, small[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length
                run = Run(max(1, left // fit))
                runs.append(run)
            else:
                gap = gaps[at]
                run = by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            if run.copies > left:
                taken = run.split(left)
                runs.append(taken)
                shelve(run)
                run = taken
            run.put(length, first)
            first, left = first + run.copies, left - run.copies
            shelve(run)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read three times, so it should be a table. Repeated rows are pieces of
    their own; an empty table gives an empty result.
    """
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_packing(counts, capacity)
    bases = np.cumsum([0] + [r.copies for r in runs])
    slots = sorted((length, first, int(base), offset) for r, base in zip(runs, bases, strict=False) for length, first, offset in r.slots)
    shared = pieces.sparkSession.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 4))
    kept = pieces.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, base, offset = shared.value.T
        starts = (length << 48) + first
        for batch in batches:
            rank, own = (batch.column(c).to_numpy().astype(np.int64) for c in ("rank", "length"))
            at = np.searchsorted(starts, (own << 48) + rank, side="right") - 1
            columns = [*[batch.column(c) for c in kept], pa.array(base[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    ranked = numbered(pieces, ["length"], [c for c in ("doc_id", "piece", "start") if c in kept], "rank")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(placed, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks: bytes, capacity: int = 2048, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of ``docs``."""
    return pack(written(tokenized_pieces(docs, ranks, capacity, added=added), "pieces"), capacity)
