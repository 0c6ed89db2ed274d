"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded sample of labelled text. A text
is cut greedily into the longest phrases that the sample holds; a letter that the sample
lacks is a phrase by itself. A phrase is worth the bits that name its place in the sample,
log2 of the sample's length, so samples of different lengths compare: the language that
needs the fewest bits wins. Each automaton has its own alphabet of any size. The moves of
all automata lie in one packed array, through which a column of texts goes side by side,
one code point a step; the few longest texts of a column go on one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import parts, remainder, shipped
from .automata import HALF, LOW, packed

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, with each run of anything but letters as one space."""
    return _OTHER.sub(" ", text.lower())


class SuffixAutomaton:
    """All substrings of ``symbols``: one dict of transitions per state, state 0 the empty string. A null symbol parts two samples."""

    def __init__(self, symbols: list[int | None]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            if c is None:
                last = 0
                continue
            if c in self.next[last]:  # only after a break: the string may be known already
                q = self.next[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(link, length, last, c, q)
                continue
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._clone(link, length, p, c, q)
            last = state

    def _clone(self, link: list[int], length: list[int], p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = link[p]
        return clone


@dataclass
class LanguageModel:
    languages: list[str]
    #: Code points of all samples in order, the symbol of each being its place from 1; 0 stands for any other.
    alphabet: np.ndarray
    #: Moves of all automata (see ``automata.packed``), the start of each, and where each goes from its start by each symbol.
    table: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    #: Bits of a phrase of each language.
    bits: np.ndarray
    lists: list[list] = field(default_factory=list, repr=False)

    def phrases(self, texts: list[str], aside: int = 24) -> np.ndarray:
        """Phrases per text and language; texts are parsed side by side while more than ``aside`` of them go on."""
        codes = [np.frombuffer(letters(t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        order = np.argsort([-len(c) for c in codes], kind="stable")
        lengths = np.array([len(codes[i]) for i in order], dtype=np.int64)
        flat = np.concatenate([codes[i] for i in order]) if len(texts) else np.zeros(0, np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(len(self.alphabet) - 1, 0))
        symbols = np.where(self.alphabet[at] == flat, at + 1, 0) if len(self.alphabet) else np.zeros(len(flat), np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
        start = self.starts[:, None]
        state = np.repeat(start, len(texts), axis=1)
        count = np.zeros_like(state)
        active, t = int(np.count_nonzero(lengths)), 0
        while active > aside:
            c = symbols[begin[:active] + t]
            s = state[:, :active]
            cell = self.table.take(s + c)
            known = (cell >> HALF) == s
            anew = self.first[:, c]
            lost = anew == start  # a phrase by itself, after which none is open
            count[:, :active] += np.where(known, 0, (s != start) + lost.astype(np.int64))
            state[:, :active] = np.where(known, cell & LOW, anew)
            t += 1
            while active and lengths[active - 1] <= t:
                active -= 1
        count += state != start  # the phrase that the end closes
        if active:
            if not self.lists:
                self.lists = [self.table.tolist(), self.first.tolist()]
            for i in range(active):
                count[:, i] -= state[:, i] != self.starts
                line = symbols[begin[i] + t : begin[i] + lengths[i]].tolist()
                for k in range(len(self.starts)):
                    count[k, i] += self._parsed(k, int(state[k, i]), line)
        out = np.zeros((len(texts), len(self.starts)), dtype=np.int64)
        out[order] = count.T
        return out

    def _parsed(self, k: int, s: int, line: list[int]) -> int:
        table, first = self.lists[0], self.lists[1][k]
        start, low, n = int(self.starts[k]), int(LOW), 0
        for c in line:
            cell = table[s + c]
            if cell >> HALF == s:
                s = cell & low
            else:
                n += s != start
                s = first[c]
                n += s == start
        return n + (s != start)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.languages and lettered:
            found = self.phrases([texts[i] for i in lettered]) * self.bits
            best = found.argmin(axis=1)  # a tie goes to the first language in order of name
            least = found.min(axis=1)
            rest = np.sort(found, axis=1)[:, 1] if found.shape[1] > 1 else least * 2
            for i, b, x, y in zip(lettered, best, least, rest, strict=True):
                names[i], scores[i] = self.languages[b], float(1 - x / y) if y else 0.0
        return names, scores


def build_model(samples: dict[str, list[str]]) -> LanguageModel:
    languages = sorted(samples)
    lines = {name: [letters(t) for t in samples[name]] for name in languages}
    alphabet = np.array(sorted({ord(c) for texts in lines.values() for t in texts for c in t}), dtype=np.uint32)
    symbol = {int(c): i for i, c in enumerate(alphabet, 1)}
    moves: list[dict[int, int]] = []
    roots, firsts = [], []
    for name in languages:
        line: list[int | None] = []
        for t in lines[name]:
            line += [*[symbol[ord(c)] for c in t], None]
        own = SuffixAutomaton(line).next
        base = len(moves)
        moves += [{c: to + base for c, to in m.items()} for m in own]
        roots.append(base)
        firsts.append(moves[base])
    place, table = packed(moves, len(alphabet) + 1)
    starts = place[roots] if roots else np.zeros(0, np.int64)
    first = np.repeat(starts[:, None], len(alphabet) + 1, axis=1)
    for k, m in enumerate(firsts):
        for c, to in m.items():
            first[k, c] = place[to]
    bits = np.array([np.log2(2 + sum(map(len, lines[name]))) for name in languages])
    return LanguageModel(languages, alphabet, table, starts, first, bits)


def train_language_id(docs: DataFrame, sample_chars: int = 40_000, sample_docs: int = 200) -> LanguageModel:
    """Learn from rows of ``docs`` (doc_id, text, lang) with a text and a language.

    Per language about ``sample_docs`` rows are drawn by a hash of id and text, and of
    equal texts one. From the one of middle length outwards, whole texts are taken until
    they have ``sample_chars`` code points together: at least one, the last as whole as the
    others, and a very long one only where most are. These bounds are parameters of the
    fit alone. What comes to the driver is a row a language, a hash and a length of each
    row drawn, and the texts taken.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    known = known.select("lang", draw.alias("draw"), F.xxhash64("text", F.lit(12)).alias("key"), F.char_length("text").alias("size"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build_model({})
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample_docs / n) * float(1 << 30))])
    drawn = known.filter(F.col("draw") < limits[F.col("lang")])
    taken = set()
    for lang, rows in drawn.select("lang", "size", "key").distinct().toPandas().sort_values(["size", "key"]).groupby("lang"):
        left = sample_chars
        for i in sorted(range(len(rows)), key=lambda i, middle=len(rows) // 2: (abs(i - middle), i)):
            if left <= 0:
                break
            left -= int(rows["size"].iloc[i])
            taken.add((lang, int(rows["key"].iloc[i])))
    chosen = docs.sparkSession.createDataFrame(sorted(taken), "lang string, key long")  # at most ``sample_docs`` rows a language
    texts = drawn.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build_model(samples)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row; ``und`` and 0 for null, empty and letterless texts. Null and repeated ids stay as they are."""
    built = shipped(docs.sparkSession, model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built()
        for batch in parts(batches, 4000):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning only from rows that are not held out.

    The score is the share of bits saved against the second best language. Ties go to the
    language first in order of name; repeated rows are predicted alike, and rows with a
    null id like any other; an empty table gives an empty result; without labelled rows
    every text is ``und``. Further columns are ignored.
    """
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train_language_id(docs.filter(~held_out), **bounds)
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
