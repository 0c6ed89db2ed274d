"""Scores of whole texts under a gated recurrent language model, beside a unigram base.

Counts of all training tokens are added up by word. The commonest words, a bounded table,
are known in every task; how often the others occur is looked up by a join on the word.

The network is a GRU in numpy. Its output softmax is factored by class: a class first,
then a word of that class; one more class stands for all words beyond its vocabulary,
which then have their share of the training counts, with one place for unseen words.
Training runs in parallel replicas over every token of every training text, once: texts
are cut into windows with truncated backpropagation, the state is carried from window to
window to the text's end, and the replicas' weights are averaged after each round. A hash
of id and text deals texts to replicas of a bounded size, and orders them there, so the
weights do not depend on how the input is split into tasks.
Scoring carries the state through whole texts, so a score is the log-likelihood of the
complete document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import parts, remainder, shipped, written

#: The token that ends a text; no word is empty.
END = b""
CLASSES, PER_CLASS = 64, 64
VOCABULARY = CLASSES * PER_CLASS
RARE, START = VOCABULARY, VOCABULARY + 1
HIDDEN, EMBEDDED = 24, 16
#: Tokens of texts that a task scores side by side, 2 bytes each; it changes no result.
TOGETHER = 4_000_000
#: Rows of logits, and weights, that are worked on at once; they change no result.
BLOCK, PART = 1024, 16_384


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, and the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    out.append(END)
    return out


@dataclass
class Shape:
    """Where each weight matrix lies in one flat vector."""

    parts = (
        ("embed", (VOCABULARY + 2, EMBEDDED)), ("w_x", (EMBEDDED, 3 * HIDDEN)), ("b_x", (3 * HIDDEN,)), ("w_h", (HIDDEN, 3 * HIDDEN)),
        ("w_c", (HIDDEN, CLASSES + 1)), ("b_c", (CLASSES + 1,)), ("w_o", (CLASSES, HIDDEN, PER_CLASS)), ("b_o", (CLASSES, PER_CLASS)),
    )

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.parts:
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(shape)) for _, shape in cls.parts)


def initial_weights(counts: np.ndarray, rare: int) -> np.ndarray:
    """Small random weights, and biases that make the untrained network a unigram model of ``counts`` (by word index)."""
    rng = np.random.default_rng(17)
    flat = np.zeros(Shape.size(), dtype=np.float32)
    w = Shape.views(flat)
    for name in ("embed", "w_x", "w_h"):
        w[name][:] = rng.normal(0, 0.3 if name != "embed" else 0.5, w[name].shape)
    w["b_x"][:HIDDEN] = 1.0  # keep most of the state at first
    full = np.zeros(VOCABULARY)
    full[: len(counts)] = counts
    by_class = (full + 1e-3).reshape(CLASSES, PER_CLASS)
    mass = np.append(by_class.sum(axis=1), rare + 1.0)
    w["b_c"][:] = np.log(mass / mass.sum())
    w["b_o"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
    return flat


def _steps(w: dict, x, h: np.ndarray, keep: bool):
    """Run the GRU over inputs x, of which x[t] is (B, 3H); returns states (T, B, H) and, to ``keep``, the gates z and r, n and what h adds to it of every step, which backpropagation needs.

    In memory, the rows of a step lie side by side, (H, B), so that what is done to a gate runs over whole arrays; what is returned are views.
    """
    steps, rows = len(x), len(h)
    held = steps if keep else 1
    out, zrs = np.empty((steps, HIDDEN, rows), dtype=np.float32), np.empty((held, 2 * HIDDEN, rows), dtype=np.float32)
    ns, us = np.empty((held, HIDDEN, rows), dtype=np.float32), np.empty((held, HIDDEN, rows), dtype=np.float32)
    w_h, u = w["w_h"].T.copy(), np.empty((3 * HIDDEN, rows), dtype=np.float32)
    w_h[: 2 * HIDDEN] *= -1
    u_zr, u_n, h = u[: 2 * HIDDEN], u[2 * HIDDEN :], h.T
    with np.errstate(over="ignore"):  # one that overflows gives a gate of 0
        for t in range(steps):
            at = t if keep else 0
            a, zr, n, new = x[t].T, zrs[at], ns[at], out[t]
            np.matmul(w_h, h, out=u)
            np.subtract(u_zr, a[: 2 * HIDDEN], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.divide(1, zr, out=zr)
            if keep:
                us[at] = u_n
            np.multiply(zr[HIDDEN:], u_n, out=n)
            n += a[2 * HIDDEN :]
            n += n
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            np.subtract(h, n, out=new)
            new *= zr[:HIDDEN]
            new += n
            h = new
    turned = lambda of: of.transpose(0, 2, 1)
    return turned(out), (turned(zrs[:, :HIDDEN]), turned(zrs[:, HIDDEN:]), turned(ns), turned(us))


class Looked:
    """The input part of each step's words, looked up when the step comes; ``to`` is a matrix that what is looked up is still to be multiplied by."""

    def __init__(self, table: np.ndarray, inputs: np.ndarray, to: np.ndarray | None = None):
        self.table, self.inputs, self.to = table, inputs, to

    def __len__(self) -> int:
        return len(self.inputs)

    def __getitem__(self, t: int) -> np.ndarray:
        found = self.table.take(self.inputs[t], axis=0)
        return found if self.to is None else (self.to.T @ found.T).T  # in memory (3H, B)


def _inputs(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings, each with a 1 behind, and the matrix from there to the gates, with the bias as last row."""
    return np.concatenate([w["embed"], np.ones((len(w["embed"]), 1), dtype=w["embed"].dtype)], axis=1), np.concatenate([w["w_x"], w["b_x"][None]])


def _hold_memory() -> None:
    """Let the C library keep what arrays of up to 31 MB leave, for the next ones: it does so once one of that size has been freed. Else each window's arrays are new pages, a quarter of all time."""
    np.empty(31 << 20, dtype=np.uint8)


def _lowered(x: np.ndarray) -> None:
    """Take their greatest from rows of logits, in place; moderate ones stay, as their exponentials neither overflow nor vanish."""
    if x.size and (x.min() <= -60 or x.max() >= 60):
        x -= x.max(axis=1)[:, None]


def _totals(x: np.ndarray) -> np.ndarray:
    """The sums of rows."""
    return x @ np.ones(x.shape[1], dtype=x.dtype)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order in which rows of a class lie together, and where those of each class of words lie in it."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")  # numbers of a byte are sorted by counting
    bounds = np.r_[0, np.cumsum(np.bincount(cls, minlength=CLASSES + 1))].tolist()
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def _blocks(rows: slice) -> list[slice]:
    """Parts of ``rows`` whose logits stay in a core's own cache."""
    return [slice(a, min(a + BLOCK, rows.stop)) for a in range(rows.start, rows.stop, BLOCK)]


def _grouped(classes: list[tuple[int, slice]]) -> list[list[tuple[int, slice]]]:
    """Rows of the classes in parts of at most BLOCK together: a small class needs no calls of its own, and a large one is split."""
    out: list[list[tuple[int, slice]]] = []
    for c, rows in classes:
        for at in _blocks(rows):
            if not out or at.stop - out[-1][0][1].start > BLOCK:
                out.append([])
            out[-1].append((c, at))
    return out


def _logits(h: np.ndarray, w_o: np.ndarray, group: list[tuple[int, slice]]) -> tuple[slice, np.ndarray]:
    """Which rows a group has, and their logits of the words of their classes."""
    rows = slice(group[0][1].start, group[-1][1].stop)
    d = np.empty((rows.stop - rows.start, PER_CLASS), dtype=h.dtype)
    for c, at in group:
        np.matmul(h[at], w_o[c], out=d[at.start - rows.start : at.stop - rows.start])
    return rows, d


def _with_one(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rows of h in an order, each with a 1 behind, by which a bias is one more row of a matrix."""
    out = np.empty((len(h), HIDDEN + 1), dtype=h.dtype)
    out[:, :HIDDEN] = h
    out[:, HIDDEN] = 1
    return out.take(order, axis=0)


def _outputs(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """The matrices from states to classes and to the words of each class, with the biases as last rows."""
    return np.concatenate([w["w_c"], w["b_c"][None]]), np.concatenate([w["w_o"], w["b_o"][:, None]], axis=1)


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log probability of one logit of each row."""
    _lowered(x)
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(_totals(x))


def log_probabilities(w: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target word index (RARE: the class of all rare words) after state h."""
    cls = np.minimum(target // PER_CLASS, CLASSES)
    order, classes = _by_class(cls)
    h, words, cls, (w_c, w_o) = _with_one(h, order), (target - cls * PER_CLASS).take(order), cls.take(order), _outputs(w)
    own, out = np.empty(len(h), dtype=h.dtype), np.empty(len(h), dtype=h.dtype)
    for at in _blocks(slice(0, len(h))):
        own[at] = _picked(h[at] @ w_c, cls[at])
    for group in _grouped(classes):
        at, d = _logits(h, w_o, group)
        own[at] += _picked(d, words[at])
    out[order] = own
    return out


def _slopes(x: np.ndarray, at: np.ndarray, scale: np.float32) -> None:
    """Turn rows of logits, in place, into the slopes of the loss along them, where ``at`` was to come."""
    _lowered(x)
    np.exp(x, out=x)
    x *= (scale / _totals(x))[:, None]
    x[np.arange(len(x)), at] -= scale


class Trainer:
    """Adam on windows of equal length; texts are rows of a batch and keep their state between windows."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat.copy(), rate, 0
        self.m, self.v, self.g, self.room = (np.zeros_like(flat) for _ in range(4))
        self.views = Shape.views(self.flat), Shape.views(self.g)

    def step(self) -> None:
        """One step of Adam along the gradient ``g``, in place, part by part of what fits a core's cache."""
        self.t += 1
        g, most = self.g, 1 - 0.99**self.t
        g *= 0.1 / max(1.0, float(np.sqrt(np.dot(g, g))))  # its square then is a hundredth
        for k in range(0, len(g), PART):
            m, v, g, flat = (x[k : k + PART] for x in (self.m, self.v, self.g, self.flat))
            a = self.room[: len(m)]
            m *= 0.9
            m += g
            np.multiply(g, g, out=a)
            v *= 0.99
            v += a
            np.sqrt(v, out=a)
            a += 1e-6 * most**0.5
            np.divide(m, a, out=a)
            a *= self.rate * most**0.5 / (1 - 0.9**self.t)
            flat -= a

    def _to_words(self, w: dict, g: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradients of the softmax after states h; returns that of each state."""
        cls = np.minimum(target // PER_CLASS, CLASSES)
        order, classes = _by_class(cls)
        hs, words, cls, (w_c, w_o) = _with_one(h, order), (target - cls * PER_CLASS).take(order), cls.take(order), _outputs(w)
        scale, dh, g_c = np.float32(1 / max(1, len(hs))), np.empty((len(hs), HIDDEN), dtype=np.float32), np.zeros_like(w_c)
        for at in _blocks(slice(0, len(hs))):
            d = hs[at] @ w_c
            _slopes(d, cls[at], scale)
            g_c += (d.T @ hs[at]).T
            np.matmul(d, w["w_c"].T, out=dh[at])
        g["w_c"][:], g["b_c"][:] = g_c[:HIDDEN], g_c[HIDDEN]
        for group in _grouped(classes):
            rows, d = _logits(hs, w_o, group)
            _slopes(d, words[rows], scale)
            for c, at in group:
                part = d[at.start - rows.start : at.stop - rows.start]
                g_o = part.T @ hs[at]
                g["w_o"][c] += g_o[:, :HIDDEN].T
                g["b_o"][c] += g_o[:, HIDDEN]
                dh[at] += part @ w["w_o"][c].T
        out = np.empty_like(dh)
        out[order] = dh
        return out

    def window(self, inputs: np.ndarray, target: np.ndarray, weight: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step on (T, B) inputs and targets; ``weight`` is 0 where a text has ended. Returns the last state."""
        w, g = self.views
        self.g.fill(0)
        embed, w_x = _inputs(w)
        states, kept = _steps(w, Looked(embed, inputs, w_x), h, True)
        live, hs, tg = np.flatnonzero(weight), states.reshape(-1, HIDDEN), target.reshape(-1)
        if len(live) == len(hs):
            dh_all = self._to_words(w, g, hs, tg)
        else:
            dh_all = np.zeros_like(hs)
            dh_all[live] = self._to_words(w, g, hs.take(live, axis=0), tg.take(live))
        turned = lambda of: of.transpose(0, 2, 1)
        dh_all = turned(dh_all.reshape(states.shape))
        states, z, r, n, u_n = (turned(x) for x in (states, *kept))  # (T, H, B), as they lie in memory
        # slopes of a step along what comes to n from h, z, r, and n from the inputs: the first three meet w_h, the last three w_x
        slopes = np.empty((4, HIDDEN, len(h)), dtype=np.float32)
        d_u, d_z, d_r, d_n = slopes
        by_h, by_x = (slopes[k : k + 3].reshape(3 * HIDDEN, len(h)) for k in (0, 1))
        back, d_h, d_x, d_e = np.roll(w["w_h"], HIDDEN, axis=1), np.zeros_like(w["w_h"]), np.zeros_like(w_x), np.empty((*inputs.shape, EMBEDDED), dtype=np.float32)
        dh, old, a, b, more = np.zeros((HIDDEN, len(h)), dtype=np.float32), *(np.empty(states.shape[1:], dtype=np.float32) for _ in range(4))
        for t in reversed(range(len(inputs))):
            before = states[t - 1] if t else h.T
            dh += dh_all[t]
            np.multiply(dh, z[t], out=old)
            np.subtract(dh, old, out=a)  # what goes to n
            np.subtract(before, n[t], out=b)
            b *= z[t]
            np.multiply(b, a, out=d_z)
            np.multiply(n[t], n[t], out=b)
            np.subtract(1, b, out=b)
            np.multiply(b, a, out=d_n)
            np.multiply(d_n, r[t], out=d_u)
            np.subtract(1, r[t], out=a)
            a *= d_u
            np.multiply(a, u_n[t], out=d_r)
            np.matmul(back, by_h, out=more)
            np.add(old, more, out=dh)
            d_h += before @ by_h.T
            d_x += (by_x @ embed.take(inputs[t], axis=0)).T
            np.matmul(by_x.T, w["w_x"].T, out=d_e[t])
        g["w_h"][:] = np.roll(d_h, -HIDDEN, axis=1)
        g["w_x"][:], g["b_x"][:] = d_x[:EMBEDDED], d_x[EMBEDDED]
        by_word = np.argsort(inputs.astype(np.int16), axis=None, kind="stable")  # numbers of two bytes are sorted by counting
        words = inputs.reshape(-1).take(by_word)
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        g["embed"][words[first]] = np.add.reduceat(d_e.reshape(-1, EMBEDDED).take(by_word, axis=0), first, axis=0)
        self.step()
        return states[-1].T


def _columns(lines: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of token lines as columns of ``width`` steps."""
    target = np.zeros((width, len(lines)), dtype=np.int64)
    weight = np.zeros((width, len(lines)), dtype=np.float32)
    inputs = np.full((width, len(lines)), START, dtype=np.int64)
    for i, line in enumerate(lines):
        target[: len(line), i] = line
        weight[: len(line), i] = 1
        inputs[1 : len(line), i] = line[:-1]
    return inputs, target, weight


@dataclass
class Lexicon:
    """The commonest training tokens, commonest first (END among them), and totals over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def rare_total(self) -> int:
        return self.total - int(self.counts[:VOCABULARY].sum())

    @property
    def rare_distinct(self) -> int:
        return self.distinct - min(len(self.words), VOCABULARY)


def count_tokens(texts: DataFrame) -> DataFrame:
    """word (binary), c over whole texts, the end counted once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text"))).flatten()
            seen = words.filter(pc.not_equal(words, "")).value_counts()
            yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.binary()), seen.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def common_words(counts: DataFrame, room: int) -> Lexicon:
    """The words that occur often enough for at most ``room`` of them to do so; ``counts`` is a table.

    How often is decided on levels of 1/64 of a doubling, so a few thousand sums come to the driver.
    """
    level = F.floor(64 * F.log2("c"))
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("c").alias("n")).collect()
    total, distinct = sum(r["n"] for r in levels), sum(r["k"] for r in levels)
    least, words = None, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        if words + r["k"] > room:
            break
        least, words = r["level"], words + r["k"]
    known = counts.filter((level >= least if least is not None else F.lit(False)) | (F.col("word") == F.lit(bytearray(END)))).toPandas()
    pairs = sorted(zip(known["c"], map(bytes, known["word"]), strict=True), key=lambda x: (-x[0], x[1]))
    end = next((i for i, x in enumerate(pairs) if x[1] == END), None)
    if end is not None and end >= VOCABULARY:  # the network must know the end
        pairs.insert(VOCABULARY - 1, pairs.pop(end))
    return Lexicon([w for _, w in pairs], np.array([c for c, _ in pairs], dtype=np.int64), total, distinct)


class Batch:
    """Token lines, longest first, behind one another with START before each."""

    def __init__(self, lines: list[np.ndarray]):
        self.lengths = np.array([len(x) for x in lines])
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.flat = np.empty(int(self.lengths.sum()) + len(lines), dtype=np.int16)
        there = np.ones(len(self.flat), dtype=bool)
        there[self.starts] = False
        self.flat[self.starts], self.flat[there] = START, np.concatenate(lines)

    def window(self, t: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets (T, B) of the lines that have more than t tokens, from there on, and which are there."""
        active = int(np.searchsorted(-self.lengths, -t))
        steps = np.arange(t, t + min(width, int(self.lengths[0]) - t) + 1)[:, None]
        found = self.flat.take(self.starts[:active] + steps, mode="clip")
        return found[:-1], found[1:], steps[:-1] < self.lengths[:active]


def learn(trainer: Trainer, lines: list[np.ndarray], width: int, rows: int) -> None:
    """Steps over every token of ``lines``, in windows of ``width``; lines of like length share a batch and carry their state to their ends."""
    _hold_memory()
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    for k in np.random.default_rng(trainer.t).permutation(-(-len(order) // rows)):
        batch = Batch([lines[i] for i in order[k * rows : (k + 1) * rows]])
        h = np.zeros((len(batch.lengths), HIDDEN), dtype=np.float32)
        for t in range(0, int(batch.lengths[0]), width):
            inputs, target, there = batch.window(t, width)
            h = trainer.window(inputs, target, there, h[: inputs.shape[1]])


def coded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Each row of ``docs`` (doc_id, text), written, with its tokens as ``line``, 2 bytes each: texts are taken apart once for training and scoring.

    ``row`` is a number of its own, ``deal`` and ``order`` are hashes that deal and order training texts, ``tail`` has the words that are not
    common and how often they occur; the other columns are counts and sums over the common ones.
    """
    shared = shipped(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared()
        get, logs = lexicon.index().get, np.log10(lexicon.counts + 1.0)
        for batch in parts(batches, 500):
            out, words, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                line = tokens(text)
                at = np.fromiter(map(get, line, repeat(-1)), np.int64, len(line))
                missing = np.flatnonzero(at < 0)
                seen = Counter([line[i] for i in missing.tolist()])
                words += seen
                times += seen.values()
                ends.append(len(words))
                known = at[at >= 0]
                rare = known[known >= VOCABULARY]
                line = np.where((at < 0) | (at >= VOCABULARY), RARE, at).astype(np.int16).tobytes()
                out.append((len(at), len(known), float(logs[known].sum()), float(logs[rare].sum()), len(rare) + len(missing), line))
            tail = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)]
            given = [batch.column(c) for c in ("row", "doc_id", "deal", "order")]
            yield pa.RecordBatch.from_arrays([*given, *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)], ["row", "doc_id", "deal", "order", *FIELDS, "tail"])

    row = F.monotonically_increasing_id()
    deal = F.xxhash64(F.coalesce("doc_id", row), "text", F.lit(5))  # texts without an id do not all meet in one part
    rows = docs.select(row.alias("row"), "doc_id", deal.alias("deal"), F.xxhash64("doc_id", "text", F.lit(3)).alias("order"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"row long, doc_id {kind}, deal long, order long, {CODED}, tail array<struct<word: binary, n: bigint>>"), "coded")


CODED = "n_tokens long, n_known long, known_log double, rare_log double, n_rare long, line binary"
FIELDS = [x.split()[0] for x in CODED.split(", ")]
TYPES = [{"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[x.split()[1]] for x in CODED.split(", ")]


def train(texts: DataFrame, lexicon: Lexicon, **training) -> np.ndarray:
    """The weights that ``texts`` (doc_id, text) teach."""
    return train_lines(coded(texts, lexicon), lexicon, **training)


def train_lines(coded: DataFrame, lexicon: Lexicon, rounds: int = 2, width: int = 32, rows: int = 256, rate: float = 0.015, replica_tokens: int = 2_000_000) -> np.ndarray:
    """Weights after ``rounds`` rounds; texts of ``coded`` are split among the rounds, and each is learned whole.

    A replica learns the texts of one part, about ``replica_tokens`` tokens, so their number
    grows with the corpus. Replicas are averaged, each counting by its tokens, slice by
    slice, so the driver gets one set of weights however many there are.
    """
    spark = coded.sparkSession
    flat = initial_weights(lexicon.counts[:VOCABULARY], lexicon.rare_total)
    slices, n_parts = 64, max(1, round(lexicon.total / rounds / replica_tokens))
    dealt = coded.select("line", "order", F.pmod("deal", F.lit(rounds * n_parts)).cast("int").alias("part"))

    def replica(shared, step: float):
        def run(group: pa.Table) -> pa.Table:
            trainer = Trainer(shared(), step)
            lines = _lines(group.sort_by("order"))
            learn(trainer, lines, width, rows)
            seen = sum(map(len, lines))
            pieces = [p.tobytes() for p in np.array_split(trainer.flat.astype(np.float64) * seen, slices)]
            columns = [pa.array(range(slices), pa.int32()), pa.array([group.column("part")[0].as_py()] * slices, pa.int32()), pa.array([seen] * slices, pa.int64()), pa.array(pieces, pa.binary())]
            return pa.table(columns, names=["slice", "part", "seen", "weights"])

        return run

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = sum(np.frombuffer(x) for x in group["weights"]) / group["seen"].sum()
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "weights": [total.astype(np.float32).tobytes()]})

    for k in range(rounds):
        part = dealt.filter(F.col("part") % rounds == k)
        replicas = part.groupBy("part").applyInArrow(replica(shipped(spark, flat), rate / (1 + k)), "slice int, part int, seen long, weights binary")
        averaged = replicas.groupBy("slice").applyInPandas(mean, "slice int, weights binary").toPandas().sort_values("slice")
        if len(averaged):
            flat = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in averaged["weights"]])
    return flat


def network_scores(flat: np.ndarray, lines: list[np.ndarray], window: int = 64, rows: int = 1024) -> np.ndarray:
    """Natural log probability of each whole line of word indices under the network, RARE for rare words."""
    _hold_memory()
    w = Shape.views(flat)
    embed, w_x = _inputs(w)
    out = np.zeros(len(lines))
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    for a in range(0, len(order), rows):
        chosen = order[a : a + rows]
        batch = Batch([lines[i] for i in chosen])
        h = np.zeros((len(chosen), HIDDEN), dtype=np.float32)
        for t in range(0, int(batch.lengths[0]), window):
            inputs, target, there = batch.window(t, window)
            states, _ = _steps(w, Looked(embed, inputs, w_x), h[: inputs.shape[1]], False)
            h = states[-1]  # a text that ended within the window is not active again
            states, target = states.reshape(-1, HIDDEN), target.reshape(-1)
            if there[-1].all():
                p = log_probabilities(w, states, target).reshape(there.shape)
            else:
                live = np.flatnonzero(there)
                p = np.zeros(there.shape, dtype=states.dtype)
                p.reshape(-1)[live] = log_probabilities(w, states.take(live, axis=0), target.take(live))
            out[chosen[: inputs.shape[1]]] += p.sum(axis=0, dtype=np.float64)
    return out


def _lines(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The word indices of the texts of ``coded``."""
    return [np.frombuffer(x, np.int16) for x in table.column("line").to_pylist()]


def score_lines(coded: DataFrame, counts: DataFrame, lexicon: Lexicon, flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of ``coded``."""
    shared = shipped(coded.sparkSession, flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored() -> Iterator[pa.RecordBatch]:
            scores, at = network_scores(shared(), lines), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores[at : at + b.num_rows])], [*b.schema.names, "network"])
                at += b.num_rows

        held, lines, n = [], [], 0
        for batch in parts(batches, 500):
            more = _lines(batch)
            held.append(batch.select(kept.names))
            lines += more
            n += sum(map(len, more))
            if n >= TOGETHER:
                yield from scored()
                held, lines, n = [], [], 0
        if lines:
            yield from scored()

    rows = coded.select("row", "doc_id", *FIELDS)
    kept = rows.drop("line").schema
    scored = written(rows.mapInArrow(run, type(kept)([*kept.fields]).add("network", "double")), "scored")
    tail = coded.select("row", F.inline("tail")).join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("t_log"))
    base = float(np.log10(lexicon.total + 1.0 * (lexicon.distinct + 1)))
    rare = float(np.log10(lexicon.rare_total + lexicon.rare_distinct + 1.0))
    t_log = F.coalesce("t_log", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        (F.col("known_log") + t_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("network") / float(np.log(10)) + F.col("rare_log") + t_log - F.col("n_rare") * rare).alias("score"))


def language_model(docs: DataFrame, room: int = 200_000, **training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows whose crc32(doc_id) mod 7 is 2 are held out. Null texts are empty: one end token.
    Repeated rows are scored each; without training rows every token is unknown, and an
    empty table gives an empty result. Rows with a null id are rows like any other.
    """
    held_out = remainder(F.col("doc_id"), 7) == 2
    counts = written(count_tokens(docs.filter(~held_out)), "counts")
    lexicon = common_words(counts, room)
    lines = coded(docs, lexicon)
    flat = train_lines(lines.filter(~held_out), lexicon, **training)
    return score_lines(lines, counts, lexicon, flat).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.total).cast("long").alias("train_tokens"), "base_score", "score")
