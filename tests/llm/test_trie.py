"""The prefix trie against plain Python: rebuilt conversations, merging, subtrees, long conversations, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from strataframe.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[3:] for x in sorted(found)] for c, found in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for path, found in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = {p for p in below if len(p) == len(path) + 1}
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        text = ",".join(map(str, sorted(ends.get(path, []))))
        out.append((min(found), len(path), min(members[path[:-1]]) if path else None, len(found), len(children), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(spark, rows, **more):
    return sorted(map(tuple, prefix_trie(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=repr)


def _conversations(seed, ids, most=7):
    r = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(r.randint(1, most)):
            rows.append((c, None if r.random() < 0.1 else t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "ünï😀"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [2, 3, 4096])
def test_equals_plain(spark, span):
    """Few texts, so families and strangers share many nodes; ids below zero and beside each other; absent bases."""
    rows = _conversations(span, [*range(0, 30), *range(100, 108), *range(203, 210), -3, -105, -100, 12345], 12)
    assert _got(spark, rows, span=span) == _brute(rows)


def test_repeated_rows_ties_and_nulls(spark):
    rows = [(1, 0, "user", "x")] * 3 + [(1, 0, "user", "y"), (None, 0, "user", "lost"), (2, None, None, None), (2, 5, "a", ""), (100, 1, "s", "t"), (101, 1, "s", "t"), (101, None, "s", "u")]
    assert _got(spark, rows) == _brute(rows)


def test_conversations_without_turns_left_are_members_of_the_root(spark):
    ids = [c for c in range(201, 230) if zlib.crc32(str(c).encode()) % 6 > 1]
    got = _got(spark, [(c, 0, "user", "only one") for c in ids])
    assert got == _brute([(c, 0, "user", "only one") for c in ids])
    assert got == [(min(ids), 0, None, len(ids), 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_role_and_text_dont_run_together(spark):
    rows = [(0, 0, "ab", "c"), (1000, 0, "a", "bc"), (2000, 0, "a", "bc")]
    assert _got(spark, rows) == _brute(rows)


def test_no_rows(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(None, 1, "user", "x")]) == []


def test_copies_and_a_long_conversation(spark):
    """A third of the conversations are one and the same, one conversation has a third of all turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(300, 700) for t in range(3)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(1000, 1200) for t in range(3)]
    rows += [(7, t, "user", f"turn {t % 5}") for t in range(900)]
    got = {r[:2]: r for r in _got(spark, rows, span=64)}
    assert sum(r[1] == 0 for r in got.values()) == 1 and max(d for _, d in got) == max(d for c, d in got if c == 7)
    root = got[7, 0]
    assert root[3] == 601
    # what is saved below the root is what all nodes save
    per_node = sum((r[3] - 1) * len(f"same {d - 1}") for (c, d), r in got.items() if c == 300 and d)
    assert root[6] >= per_node > 0 and root[5] == sum(r[4] == 0 for r in got.values())


def test_other_columns_and_long_texts(spark):
    df = spark.createDataFrame([(5, 0, "user", "z" * 300_000, 1, 2, "q"), (5, 1, "user", None, 1, 2, "q")], SCHEMA + ", x int, d int, key string")
    got = prefix_trie(df).collect()
    assert max(r["depth"] for r in got) <= 2 and {r["conv_id"] for r in got} == {5}
