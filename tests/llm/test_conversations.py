"""Conversation repair and the prefix trie against brute force, with nulls, ties, repeated rows, long conversations and empty tables."""

import binascii
import hashlib
import math
import random
import re

import pytest
from weftline.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string, at string, block int"


def by_turn(row):
    return (row[0] is not None, row[0] or 0, row[1].encode(), row[2].encode())


def follows(state, initial):
    return (state == "" and initial in "su") or (state in ("s", "a") and initial == "u") or (state == "u" and initial == "a")


def repaired(rows):
    """(cost, audit, messages) of the cheapest edits by a table of all output states, whose messages are carried along."""

    def with_inserts(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    new = (cost + 2, audit + "I", (*out, (role, "")))
                    if follows(s, i) and (i not in states or new[:2] < states[i][:2]):
                        states[i] = new
        return states

    states = {"": (0, "", ())}
    for role, text, fault in rows:
        found = []
        for s, (cost, audit, out) in with_inserts(states).items():
            found.append((s, (cost + 3, audit + "D", out)))
            if fault in ("b", "d"):
                continue
            late, i = int(fault == "t"), role[:1]
            if i in ("s", "u", "a") and follows(s, i):
                found.append((i, (cost + late, audit + "K", (*out, (role, text)))))
            found += [(j, (cost + 2 + late, audit + "R", (*out, (r, text)))) for j, r in (("u", "user"), ("a", "assistant")) if follows(s, j)]
        states = {}
        for s, new in found:
            if s not in states or new[:2] < states[s][:2]:
                states[s] = new
    states = with_inserts(states)
    return min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])


def brute_repair(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        own = convs.setdefault(c, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = binascii.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for c, own in convs.items():
        own.sort(key=by_turn)
        seen, faulty = set(), []
        for _, role, text in own:
            s = text.strip(" \t\n\v\f\r")
            faulty.append((role, text, "b" if not s else "d" if (role, text) in seen else "" if s[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        n = lambda f: sum(x[2] == f for x in faulty)  # noqa: B023, E731
        cost, audit, out = repaired(faulty)
        yield {
            "conv_id": c,
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": n("b"),
            "duplicate": n("d"),
            "truncated": n("t"),
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        }


def brute_trie(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=by_turn)] for c, v in own.items()}
    whole, members, below = {}, {}, {}
    for c in own:
        h = binascii.crc32(str(c).encode()) % 9
        whole[c] = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *own[c][h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    for k in members:
        if k:
            below.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in below.get(k, [])) or 1
        saved[k] = sum(saved[j] for j in below.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(k)))
        yield {
            "conv_id": min(m),
            "depth": len(k),
            "parent_conv_id": min(members[k[:-1]]) if k else None,
            "n_convs": len(m),
            "n_children": len(below.get(k, [])),
            "n_leaves": leaves[k],
            "saved_tokens": saved[k],
            "ends_sha256": hashlib.sha256(ends.encode()).hexdigest(),
        }


def same(df, expected):
    assert sorted(str(sorted(r.asDict().items())) for r in df.collect()) == sorted(str(sorted(e.items())) for e in expected)


def log(seed, convs, roles, texts, turns=(-2, 9), most=9):
    rnd = random.Random(seed)
    for c in [*convs, None]:
        rows = [(c, None if rnd.random() < 0.05 else rnd.randint(*turns), rnd.choice(roles), rnd.choice(texts), "x", 1) for _ in range(rnd.randint(1, most))]
        yield from rows + rows[: rnd.random() < 0.1]


ROLES = ["user", "assistant", "system", "tool", "", None, "unknown", "user", "assistant"]
TEXTS = ["a.", "b", "c!", " ", "", None, "d?\n ", "e. f", "x\x0b", "é ", "z. ", " "]


@pytest.mark.parametrize("block", [2048, 3])
def test_op12(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = list(log(1, range(-3, 200), ROLES, TEXTS))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(repair.report(df, repair.damaged(df)), brute_repair(rows))


def test_op12_long_conversation(spark):
    rnd = random.Random(2)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), f"{'w' * (50_000 if t == 9 else 3)}{t}{rnd.choice('.!? x')}", "x", 1) for t in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(repair.report(df, repair.damaged(df)), brute_repair(rows))


def test_op12_messages(spark):
    rows = [(1, 0, "system", "Be kind.", "x", 1), (1, 1, "assistant", "Hi.", "x", 1), (1, 2, "user", "Why?", "x", 1), (2, 0, "user", "", "x", 1)]
    out = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in out] == [(1, "K", "system", "Be kind."), (1, "I", "user", ""), (1, "K", "assistant", "Hi."), (1, "K", "user", "Why?"), (1, "I", "assistant", "")]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.report(df, repair.damaged(df)).count() == 0
    assert prefix_trie.nodes(prefix_trie.branched(prefix_trie.sequences(df))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_op13(spark, monkeypatch, seed):
    """Few texts, so that subtrees are deep and cross many small blocks."""
    monkeypatch.setattr(prefix_trie, "LEAST_BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK", 9)
    convs = [c for c in range(-7, 100 + 60 * seed) if c % 11]
    rows = list(log(seed, convs, ["user", "assistant", None][: seed + 1], ["a", "é", "", None][: seed + 2], (0, 14), 14))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(prefix_trie.nodes(prefix_trie.branched(prefix_trie.sequences(df))), brute_trie(rows))


@pytest.mark.parametrize("rows", [[(0, None, None, None, None, None)], [(1, 0, "a", "b", None, None)], [(c, 0, "user", "same", None, None) for c in range(40)]])
def test_op13_small(spark, rows):
    same(prefix_trie.nodes(prefix_trie.branched(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA)))), brute_trie(rows))


def test_op13_long_conversation(spark):
    rows = [(c, t, "user", "hi" if t < 2000 else f"{c}", "x", 1) for c in (5, 10, 15) for t in range(2000 + c)]
    same(prefix_trie.nodes(prefix_trie.branched(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA)))), brute_trie(rows))
