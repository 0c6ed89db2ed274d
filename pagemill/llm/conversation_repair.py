"""Repair of damaged conversations: the cheapest edits that make a dialogue regular again.

A repaired conversation's roles read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. The cheapest edits are a shortest path through an automaton of four
states, one step a turn. Long conversations are cut into chunks that run side by side: each
starts, from its end, with a speculative vector of costs, and runs again when the vector of
its successor turns out to differ by more than a constant, only as far back as the vectors
become parallel. Chunks whose vectors agree up to constants are stitched without adding
these constants up, as choices depend on differences alone. The path itself is found forwards:
each chunk maps its four entry states to exits, and most maps lead to one state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import PART_BITS, SPACE_CHARS, discard, in_order, null_safe_join, parts, shipped, written

#: States: nothing yet, after system, after user, after assistant; the second and third cannot end.
NEXT = np.array([2, 2, 3, 2])
ROLES = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A step's symbol is the role (system, user, assistant, other) and four times the fault.
SOUND, CUT, BLANK, DUPLICATE = range(4)
NEVER = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of (symbol, from, to) with insertions before the turn, the state that keeping leads to or -1, and the costs of ending."""
    insert = np.full((4, 4), NEVER)
    for q in range(4):
        insert[q, q] = 0
        insert[q, NEXT[q]] = min(insert[q, NEXT[q]], INSERT)
        insert[q, NEXT[NEXT[q]]] = min(insert[q, NEXT[NEXT[q]]], 2 * INSERT)
    keep = np.full((16, 4), -1)
    step = np.full((16, 4, 4), NEVER)
    for symbol in range(16):
        role, fault = symbol % 4, symbol // 4
        for q in range(4):
            step[symbol, q, q] = DELETE
            if fault in (SOUND, CUT):
                extra = TRUNCATED * (fault == CUT)
                step[symbol, q, NEXT[q]] = min(step[symbol, q, NEXT[q]], REROLE + extra)
                to = 1 if role == 0 and q == 0 else NEXT[q] if role in (1, 2) and NEXT[q] == role + 1 else -1
                keep[symbol, q] = to
                if to >= 0:
                    step[symbol, q, to] = min(step[symbol, q, to], KEEP + extra)
    whole = (insert[None, :, :, None] + step[:, None, :, :]).min(axis=2)
    end = (insert + np.where(np.isin(np.arange(4), (0, 3)), 0, NEVER)[None, :]).min(axis=1)
    return whole, keep, end


STEPS, KEPT, END = _tables()


def _matrix(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The steps of several chunks as rows of one matrix, and their numbers."""
    lengths = np.diff(symbols.offsets.to_numpy())
    steps = np.zeros((len(lengths), lengths.max(initial=0)), dtype=np.int8)
    steps[np.arange(steps.shape[1])[None, :] < lengths[:, None]] = symbols.flatten().to_numpy()
    return steps, lengths


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.int64).reshape(-1, 4)


def _level(costs: np.ndarray) -> np.ndarray:
    """Vectors that differ by a constant become one."""
    return costs - costs.min(axis=1, keepdims=True)


def backward(steps: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """The costs from each state to the chunk's end and on, before every step and after the last."""
    costs = [end]
    for t in range(steps.shape[1] - 1, -1, -1):
        moved = (STEPS[steps[:, t]] + costs[-1][:, None, :]).min(axis=2)
        costs.append(np.where((t < lengths)[:, None], moved, costs[-1]))
    return costs[::-1]


def rerun(steps: np.ndarray, lengths: np.ndarray, old: np.ndarray, new: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The vectors at the chunks' beginnings for new ends: walked back only as far as the old and the new still differ by more than constants."""
    for t in range(steps.shape[1] - 1, -1, -1):
        if (_level(old) == _level(new)).all():
            break
        active = (t < lengths)[:, None]
        old, new = (np.where(active, (STEPS[steps[:, t]] + x[:, None, :]).min(axis=2), x) for x in (old, new))
    parallel = (_level(old) == _level(new)).all(axis=1, keepdims=True)
    return np.where(parallel, begin, _level(new))


def trace(steps: np.ndarray, lengths: np.ndarray, costs: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits from given states, the ASCII-least first: letters as (chunk, step, 3), zero where none, and the states after the last step."""
    n, every = len(state), np.arange(len(state))
    letters = np.zeros((n, steps.shape[1], 3), dtype=np.uint8)
    state = state.copy()
    for t in range(steps.shape[1]):
        here, after, symbol = costs[t], costs[t + 1], steps[:, t]
        open_ = t < lengths
        extra = TRUNCATED * (symbol // 4 == CUT)
        for slot in range(3):
            now = here[every, state]
            delete = open_ & (DELETE + after[every, state] == now)
            insert = open_ & ~delete & (INSERT + here[every, NEXT[state]] == now)
            to = KEPT[symbol, state]
            keep = open_ & ~delete & ~insert & (to >= 0) & (KEEP + extra + after[every, to] == now)
            rerole = open_ & ~delete & ~insert & ~keep
            letters[:, t, slot] = delete * ord("D") + insert * ord("I") + keep * ord("K") + rerole * ord("R")
            state = np.where(keep, to, np.where(insert | rerole, NEXT[state], state))
            open_ = open_ & insert
    return letters, state


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations as the contract spoils them, in what columns it reads; nulls become one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    spoil = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    copies = F.when(spoil == 0, F.array().cast("array<int>")).when(spoil == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(spoil == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(spoil == 1, F.lit("")).when(spoil == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("copy"),
    )


def _chunks(rows: DataFrame, turns: int) -> DataFrame:
    """conv_id, no, n_chunks, at, symbols: the rows' symbols by chunks of at most ``turns`` rows, numbered from 0 within a conversation."""
    bare = F.rtrim("text", F.lit(SPACE_CHARS))
    blank = F.ltrim(bare, F.lit(SPACE_CHARS)) == ""
    seen = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = rows.filter(~blank).groupBy("conv_id", seen.alias("seen")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0))
    told = rows.select(
        "conv_id", "at", F.when(initial == 0, 3).otherwise(initial - 1).alias("role"), blank.alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    told = told.join(firsts.hint("merge"), "at", "left").select("conv_id", "at", (F.col("role") + 4 * fault).cast("tinyint").alias("symbol"))
    chunks = (
        told.groupBy("conv_id", F.floor(F.col("at") / turns).alias("chunk"))
        .agg(F.min("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
        .withColumn("part", F.shiftright("at", PART_BITS))
    )
    chunks = written(chunks, "chunks")
    spans = chunks.groupBy("conv_id", "part").agg(F.min("chunk").alias("low"), (F.max("chunk") - F.min("chunk") + 1).alias("n"))
    parts_before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "conv_id", "part", (F.coalesce(F.sum("n").over(parts_before), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_chunks")
    )
    placed = null_safe_join(chunks, spans.hint("merge"), ["conv_id", "part"])
    return written(placed.select("conv_id", (F.col("chunk") + F.col("shift")).alias("no"), "n_chunks", "at", "symbols"), "numbered", instead_of=chunks)


def _side_by_side(df: DataFrame, run, schema: str, columns: list[str]) -> DataFrame:
    """``run(batch)`` over the chunks, which gives a list of Arrow arrays for each of the last columns of ``schema``; ``columns`` are passed on."""
    ship = shipped(df.sparkSession, run)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = ship()
        for batch in parts(batches, 512):
            made = work(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made.values()], names=[*columns, *made])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.mapInArrow(each, f"{kinds}, {schema}")


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


def _first_pass(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    steps, lengths = _matrix(batch.column("symbols"))
    last = (batch.column("no").to_numpy() == batch.column("n_chunks").to_numpy() - 1)[:, None]
    end = np.where(last, END[None, :], np.zeros((1, 4), dtype=np.int64))
    return {"ends": _lists(end), "begins": _lists(_level(backward(steps, lengths, end)[0]))}


def _later_pass(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    steps, lengths = _matrix(batch.column("symbols"))
    old, new, begin = (_vectors(batch.column(c)) for c in ("ends", "new_ends", "begins"))
    return {"ends": _lists(new), "begins": _lists(rerun(steps, lengths, old, new, begin))}


def _exits(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    steps, lengths = _matrix(batch.column("symbols"))
    costs = backward(steps, lengths, _vectors(batch.column("ends")))
    return {"exits": _lists(np.stack([trace(steps, lengths, costs, np.full(len(steps), q))[1] for q in range(4)], axis=1))}


def _edits(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    steps, lengths = _matrix(batch.column("symbols"))
    letters, state = trace(steps, lengths, backward(steps, lengths, _vectors(batch.column("ends"))), batch.column("entry").to_numpy())
    last = batch.column("no").to_numpy() == batch.column("n_chunks").to_numpy() - 1
    closing = np.array([0, 2, 1, 0])[state] * last
    audits = [bytes(x[x > 0]) + b"I" * int(k) for x, k in zip(letters.reshape(len(letters), -1), closing, strict=True)]
    return {"audit": pa.array(audits, pa.binary()), "codes": pa.array([bytes(x[:n].astype(np.uint8)) for x, n in zip(steps, lengths, strict=True)], pa.binary())}


VECTORS = "ends array<bigint>, begins array<bigint>"


def _converged(several: DataFrame) -> DataFrame:
    """conv_id, no, ends: the costs at the end of each chunk of ``several``, up to a constant, when no chunk's successor contradicts it any more."""
    key = ["conv_id", "no"]
    known = written(_side_by_side(several, _first_pass, VECTORS, key), "vectors")
    while True:
        successors = known.select("conv_id", (F.col("no") - 1).alias("no"), F.col("begins").alias("new_ends"))
        level = F.transform("ends", lambda x: x - F.array_min("ends"))
        wrong = written(null_safe_join(known, successors.hint("merge"), key).filter(level != F.col("new_ends")), "wrong")
        if wrong.isEmpty():
            discard(wrong)
            return known
        again = _side_by_side(null_safe_join(several, wrong.hint("merge"), key), _later_pass, VECTORS, key)
        rest = null_safe_join(known, wrong.select(*key).hint("merge"), key, "left_anti")
        known = written(rest.unionByName(again), "vectors", instead_of=known)
        discard(wrong)


def _entered(several: DataFrame) -> DataFrame:
    """conv_id, no, entry: the state in which the cheapest path enters each chunk. ``several`` has each chunk's ends.

    Maps of entry states to exits are composed over twice as many chunks in each round, until they
    lead to one state or begin with the conversation.
    """
    key = ["conv_id", "no"]
    maps = _side_by_side(several, _exits, "exits array<bigint>", [*key, "n_chunks"]).filter("no < n_chunks - 1")
    maps = written(maps.select("conv_id", (F.col("no") + 1).alias("no"), F.col("no").alias("origin"), F.col("exits").alias("way")), "maps")
    one = (F.size(F.array_distinct("way")) == 1) | (F.col("origin") == 0)
    while not maps.filter(~one).isEmpty():
        before = maps.select("conv_id", F.col("no").alias("origin"), F.col("way").alias("way_before"), F.col("origin").alias("origin_before"))
        open_ = null_safe_join(maps.filter(~one), before.hint("merge"), ["conv_id", "origin"])
        further = open_.select(*key, F.col("origin_before").alias("origin"), F.transform("way_before", lambda q: F.element_at("way", (q + 1).cast("int"))).alias("way"))
        # what leads to one state from some chunk on does so from the conversation's beginning
        further = further.withColumn("origin", F.when(F.size(F.array_distinct("way")) == 1, F.lit(0)).otherwise(F.col("origin")).cast("bigint"))
        maps = written(maps.filter(one).unionByName(further), "maps", instead_of=maps)
    entries = maps.select(*key, F.col("way")[0].alias("entry"))
    return entries.unionByName(several.filter("no = 0").select(*key, F.lit(0).cast("bigint").alias("entry")))


def _repaired(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Reads each conversation's marker, edits and rows in order and gives its counts and the digest of what is left; only the audit is held."""

    class One:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.audit, self.edits, self.next, self.codes, self.at = conv_id, [], b"", 0, b"", 0
            self.digest, self.begun, self.state = hashlib.sha256(), False, 0
            self.low, self.high, self.turns, self.faults, self.illegal, self.cost, self.before = None, None, 0, [0, 0, 0, 0], 0, 0, None

        def say(self, role: str, text: str) -> None:
            self.digest.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode())
            self.begun = True

        def insert(self) -> None:
            self.state = int(NEXT[self.state])
            self.cost += INSERT
            self.say(ROLES[self.state], "")

        def piece(self, edits: bytes, codes: bytes) -> None:
            self.audit.append(edits)
            self.edits, self.next, self.codes, self.at = edits, 0, codes, 0

        def row(self, turn: int | None, role: str, text: str) -> None:
            symbol = self.codes[self.at]
            self.at += 1
            fault = symbol // 4
            self.faults[fault] += 1
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
            if self.before is not None:
                self.illegal += (self.before, symbol % 4) not in ((0, 1), (1, 2), (2, 1))
            self.before = symbol % 4
            while self.edits[self.next] == ord("I"):
                self.insert()
                self.next += 1
            edit = self.edits[self.next]
            self.next += 1
            if edit == ord("D"):
                self.cost += DELETE
                return
            self.cost += TRUNCATED * (fault == CUT)
            if edit == ord("K"):
                self.state = int(KEPT[symbol, self.state])
            else:
                self.cost += REROLE
                self.state = int(NEXT[self.state])
                role = ROLES[self.state]
            self.say(role, text)

        def result(self) -> tuple:
            while self.next < len(self.edits):
                self.insert()
                self.next += 1
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            _, cut, blank, duplicate = self.faults
            return self.conv_id, gaps, blank, duplicate, cut, self.illegal, self.cost, b"".join(self.audit).decode(), self.digest.hexdigest()

    def batch(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    one, kind = None, pa.int64()
    for given in parts(batches):
        done, kind = [], given.column("conv_id").type
        for conv_id, what, turn, role, text, edits, codes in zip(*(given.column(c).to_pylist() for c in ("conv_id", "what", "turn", "role", "text", "audit", "codes")), strict=True):
            if what == 0:
                if one:
                    done.append(one.result())
                one = One(conv_id)
            elif what == 1:
                one.piece(edits, codes)
            else:
                one.row(turn, role, text)
        if done:
            yield batch(done, kind)
    if one:
        yield batch([one.result()], kind)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(rows: DataFrame, all_ids: DataFrame, turns: int = 1024) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation of ``all_ids`` (conv_id).

    ``rows`` has conv_id, turn, role, text and may have copy. A conversation's rows are taken
    by turn (null first), then role, then the first 100 characters of the text and a hash of
    it; identical rows in any order. Rows of a null conv_id form one conversation. A role
    that begins with none of s, u, a, as an empty one, can only be changed or deleted. A
    conversation without rows has zeros, no edits and the hash of the empty string; an empty table
    gives an empty result. Other columns are ignored, whatever their names.

    ``turns`` bounds a chunk and does not change results. The texts of one conversation meet, in order,
    in the task that hashes them one after another, as the digest of the whole demands; a task holds one row of
    them at a time, and a letter for each edit.
    """
    order = [F.col(c) for c in ("conv_id", "turn", "role")] + [F.substring("text", 1, 100), F.xxhash64("text"), F.col("row")]
    numbered = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.monotonically_increasing_id().alias("row"))
    ordered = in_order(numbered, order, "rows").drop("row")
    chunks = _chunks(ordered, turns)
    several = chunks.filter("n_chunks > 1")
    alone = chunks.filter("n_chunks = 1").withColumns({"ends": F.array(*[F.lit(int(x)).cast("bigint") for x in END]), "entry": F.lit(0).cast("bigint")})
    if several.isEmpty():
        ready = alone
    else:
        key = ["conv_id", "no"]
        several = written(null_safe_join(several, _converged(several).select(*key, "ends").hint("merge"), key), "several")
        ready = alone.unionByName(null_safe_join(several, _entered(several).hint("merge"), key))
    pieces = _side_by_side(ready, _edits, "audit binary, codes binary", ["conv_id", "at"])
    nothing = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("audit", "binary"), ("codes", "binary"))}
    columns = ["conv_id", "at", "what", "turn", "role", "text", "audit", "codes"]

    def shaped(df: DataFrame, what: int) -> DataFrame:
        return df.withColumns({c: v for c, v in nothing.items() if c not in df.columns} | {"what": F.lit(what)}).select(*columns)

    markers = all_ids.select("conv_id").distinct().withColumn("at", F.lit(-1).cast("bigint"))
    stream = shaped(markers, 0).unionByName(shaped(pieces, 1)).unionByName(shaped(ordered, 2))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "what")
    names = ["conv_id", *[x.split()[0] for x in RESULT.split(", ")]]
    ship = shipped(rows.sparkSession, _repaired)
    kind = all_ids.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(lambda batches: ship()(batches, names), f"conv_id {kind}, {RESULT}")


def repair_damaged(conversations: DataFrame, turns: int = 1024) -> DataFrame:
    """``repair_conversations`` over rows that were damaged first, with every original conversation."""
    return repair_conversations(damaged(conversations), conversations, turns)
