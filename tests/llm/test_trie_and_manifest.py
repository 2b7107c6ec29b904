"""The prefix trie and the Merkle manifest against brute force, and on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, pos string, depth string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    """Nodes by brute force: conv_id, depth, parent, members, children, leaves, saved, ends."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def totals(p):
        below = [totals(x) for x in children[p]]
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        return (sum(x for x, _ in below) if below else 1), saved + sum(y for _, y in below)

    out = []
    for p, m in members.items():
        leaves, saved = totals(p)
        ends = sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, ends))
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    nodes = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.coded_turns(df)))
    return [tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                           "saved_tokens", "ends_sha256").collect()]


def odd_conversations():
    draw = random.Random(3)
    rows = [(None, 0, "user", "no id"), (5, None, None, None), (5, None, "user", None), (5, 1, "user", "a"), (5, 1, "user", "a"),
            (5, 1, "assistant", "b"), (-7, 0, "user", "é😀"), (-100, 0, "user", "neg"), (300, 0, "user", "w" * 200_000)]
    for c in range(1000, 1330):
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice("ab")) for t in range(draw.choice([1, 2, 3, 5, 8, 12]))]
    rows += [(2000 + i, t, "user", f"same {t}") for i in range(1, 60) for t in range(9)]  # copies, their base is absent
    rows += [(7777, t, "user", str(t % 3)) for t in range(300)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [1, 7, 60, 10**6])
def test_trie_by_brute_force_for_any_shards(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    if turns == 60:
        monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    rows = odd_conversations() if turns > 1 else odd_conversations()[::7]
    assert sorted(map(str, trie_of(spark, rows))) == sorted(map(str, brute_trie(rows)))


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "user", "x")]) == []


def test_ternary_tree_is_balanced():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie._medians_first(1023):
        tree.insert([i], [1], 1, i, "")
    depth = {tree.first[0]: 1}
    for node in range(1, 1024):
        for link in (tree.below, tree.above):
            if link[node] >= 0:
                depth[link[node]] = depth[node] + 1
    assert len(depth) == 1023 and max(depth.values()) == 10


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); proofs climbed level by level over whole lists."""
    def h(*parts):
        return sha("".join(parts))

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        """The root, and for each leaf its list of (place in the run, the run's others)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
            for leaf, i in enumerate(at):
                run = runs[i // 16]
                steps[leaf].append((i % 16, [x for j, x in enumerate(run) if j != i % 16]))
                at[leaf] = i // 16
            nodes = [h(*r) for r in runs]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        shown = r[4]
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        leaf, other = h(*map(field, r)), h(*map(field, (*r[:4], shown)))
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, other, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (*_, leaf, other, key), steps in zip(sorted(groups[s]), trees[s][1]):
            node = other
            for at, others in steps + up:
                node = h(*others[:at], node, *others[at:])
            out.append((key, leaf, trees[s][0], root, h(*[x for _, o in steps + up for x in o]), node, node == root))
    return out


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, pos string, leaf string, grp string")
    return [tuple(r) for r in merkle.documents_manifest(df).collect()]


def odd_documents(sources):
    draw = random.Random(4)
    rows = [(i, draw.choice(sources), draw.choice(["en", None]), draw.choice([None, 1, 2**40]),
             draw.choice([None, "", "Abc É", "plain", "ÄÖ 日本 X"])) for i in range(-20, 500)]
    rows += [(None, "src1", "en", 1, "Null Id"), (None, "src1", "en", 1, "Null Id"), (None, None, None, None, None)]
    rows += [rows[3]] * 20 + [(7, "src1", "en", 1, f"Clash {i}") for i in range(5)] + [(2**60, "lone", "en", 1, "X" * 400_000)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_by_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    if levels == 1:
        monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 0)
    sources = ["src1", "src1", "src1", "Zrc", "ärc", "", "-", "=", None] + [f"s{i}" for i in range(30 if levels == 1 else 3)]
    rows = odd_documents(sources)
    got = manifest_of(spark, rows)
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(rows)))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert manifest_of(spark, []) == []
    for rows in ([(1, None, None, None, None)], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y")],
                 [(i, "a", "en", 1, "X") for i in range(17)]):
        assert sorted(map(str, manifest_of(spark, rows))) == sorted(map(str, brute_manifest(rows)))
