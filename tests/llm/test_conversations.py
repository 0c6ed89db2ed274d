"""Repair and trie of conversations against brute force, in small and large pieces, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from pagemill.llm import conversation_repair, prefix_trie
from pagemill.llm._shared import table

SPACE = " \t\n\x0b\x0c\r"
ROW = "conv_id long, turn long, role string, text string, at long, symbol string, x long, audit string"


def conversations(spark, rows, parts=3):
    """Conversations with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, 0, "s", 1, "a") for r in rows], ROW).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(*parts):
    return zlib.crc32(":".join(" " if p is None else str(p) for p in parts).encode())


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


# -- 11


def spoilt(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv]
        role, text, kind = " " if role is None else role, " " if text is None else text, crc(conv, turn) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: by_turn(x) for c, x in found.items()}


def repaired(rows):
    """All that the contract asks of one conversation: every edit is tried at every place."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, said, inserted):
        """Cost, audit and lines from row i on; ``said`` is what tells prefixes apart: nothing, s, u or a. No repair inserts three in a row."""
        options = []
        if i == len(rows) and said in ("", "a"):
            options.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[said]
        if inserted < 3:
            for r in follows.replace("s", ""):
                c, a, t = best(i, r, inserted + 1)
                options.append((3 + c, "I" + a, ({"u": "user:", "a": "assistant:"}[r], *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, said, 0)
            options.append((4 + c, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] and role[:1] in follows:
                    c, a, t = best(i + 1, role[:1], 0)
                    options.append((more + c, "K" + a, (f"{role}:{text}", *t)))
                for r in follows.replace("s", ""):
                    c, a, t = best(i + 1, r, 0)
                    options.append((3 + more + c, "R" + a, ({"u": "user:", "a": "assistant:"}[r] + text, *t)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # so that recursion stays shallow
        for said in ("", "s", "u", "a"):
            best(i, said, 0)
    cost, audit, lines = best(0, "", 0)
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)),
    )


def check_repair(spark, rows, turns, parts=3):
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair_damaged(conversations(spark, rows, parts), turns).collect()}
    want = {c: repaired(x) for c, x in spoilt(rows).items()}
    assert got == want


def some(seed, n, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["", None, " \n", "one", "one.", "two?", "three! \t", f"t{rng.random()}.", "é✓"])
            rows.append((conv if rng.random() < 0.95 else None, turn if rng.random() < 0.9 else rng.choice([None, 3]), role, text))
    return rows


@pytest.mark.parametrize("turns", [1, 3, 1024])
def test_repair_of_random_conversations(spark, turns):
    check_repair(spark, some(turns, 60), turns)


def test_a_long_conversation_is_repaired_in_pieces(spark):
    rng = random.Random(1)
    roles = [rng.choice(["user", "assistant", "assistant", "system", "x"]) for _ in range(700)]
    rows = [(5, t, r, rng.choice(["a.", "b", f"{t}."])) for t, r in enumerate(roles)] + some(9, 5)
    check_repair(spark, rows, 16, 4)


def test_pieces_that_never_converge(spark):
    """Users and assistants in turn carry the difference between states through the whole conversation; so do turns that all have to go."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(60)] + [(2, t, "user", "") for t in range(60)]
    check_repair(spark, rows, 4, 4)


def test_repair_edges(spark):
    assert conversation_repair.repair_damaged(conversations(spark, [])).count() == 0
    gone = next(t for t in range(1000) if crc(1, t) % 20 == 0)
    whole = next(t for t in range(1000) if crc(2, t) % 20 > 4)
    rows = [(1, gone, "user", "a."), (2, whole, "user", "w " * 200_000 + "."), (3, None, None, None)] + [(4, 7, "user", "same.")] * 50
    check_repair(spark, rows, 8)
    got = {r.conv_id: r for r in conversation_repair.repair_damaged(conversations(spark, rows)).collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, "", sha(""))
    assert got[2].audit == "KI"


def test_vectors_that_differ_by_constants_are_not_walked_through():
    steps = np.array([[2, 1, 2, 1, 4 * conversation_repair.CUT + 3, 0]], dtype=np.int8)
    lengths = np.array([6])
    old = np.zeros((1, 4), dtype=np.int64)
    begin = conversation_repair._level(conversation_repair.backward(steps, lengths, old)[0])
    assert (conversation_repair.rerun(steps, lengths, old, old + 7, begin) == begin).all()
    for new in np.array([[[0, 6, 3, 0]], [[9, 0, 1, 5]]]):
        exact = conversation_repair._level(conversation_repair.backward(steps, lengths, new)[0])
        assert (conversation_repair.rerun(steps, lengths, old, new, begin) == exact).all()


# -- 12


def trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in by_turn(t)] for c, t in own.items()}
    whole = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in sorted(whole.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    @lru_cache(None)
    def below(p):
        leaves, saved = 0 if children[p] else 1, (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for q in children[p]:
            leaves, saved = leaves + below(q)[0], saved + below(q)[1]
        return leaves, saved

    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), *below(p), sha(",".join(str(c) for c in m if len(whole[c]) == len(p)))) for p, m in members.items()
    )


def check_trie(spark, rows, width=None, parts=3):
    got = prefix_trie.conversation_prefix_trie(conversations(spark, rows, parts), width).collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got) == trie(rows)


def talk(seed, n):
    rng = random.Random(seed)
    ids = [*range(-25, n), 10**15 + 3]
    return [
        (c if rng.random() < 0.98 else None, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "", None, "a b c", f"{t}"]))
        for c in ids for t in range(rng.randrange(1, 6))
    ]


@pytest.mark.parametrize("width", [1 << 15, None])
def test_trie_of_random_conversations(spark, width):
    check_trie(spark, talk(3, 120), width)


def test_trie_when_the_sketch_proves_nothing(spark, monkeypatch):
    """Every cell counts as crowded, so that all prefixes are counted exactly."""
    monkeypatch.setattr(prefix_trie, "crowded", lambda found, width: np.full(prefix_trie.SKETCH_ROWS * width // 8, 255, dtype=np.uint8))
    check_trie(spark, talk(4, 60), 1 << 15)


def test_trie_of_many_copies_and_a_long_conversation(spark):
    long = [(100, t, "user", f"{t % 7} words of it") for t in range(400)] + [(101, t, "user", f"{t % 7} words of it") for t in range(390)]
    copies = [(1000 + c, t, "user", f"same {t}") for c in range(150) for t in range(5)]
    check_trie(spark, long + copies + talk(5, 20), parts=4)


def test_trie_edges(spark):
    assert prefix_trie.conversation_prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.conversation_prefix_trie(conversations(spark, [(None, 1, "user", "a")])).count() == 0
    lone = next(c for c in range(21, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1)
    check_trie(spark, [(lone, 0, "user", "all of it goes")])
    check_trie(spark, [(0, 0, None, None), (20, 5, "user", "x " * 100_000), (20, 5, "user", "x " * 100_000)])


def test_what_the_sketch_screens(spark, sf):
    """Nothing shared is screened off, and most of what is not shared is."""
    turns = prefix_trie.rebuilt(table(spark, sf, "conversations"))
    seen = prefix_trie.screened(prefix_trie.prefixes(turns), 1 << 16).toPandas()
    n = seen.groupby(["x", "y"]).conv_id.transform("count")
    assert seen.maybe[n > 1].all()
    assert seen.maybe[n == 1].mean() < 0.01
