"""The conversation trie against a plain one of nested prefixes."""

import hashlib
import random
import zlib

import pytest

from pyspark.sql import functions as F

from populi.llm import prefix_trie
from populi.llm.common import Scratch, table
from populi.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x1 string, `class` string"


def plain_nodes(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built = own.get(base, [])[:h] + ts[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
        ends.setdefault(tuple(built), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items())


def rows_of(seed, n, alphabet=3, most=9):
    rng, out = random.Random(seed), []
    for c in range(n):
        ts = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "é✓" * 3, "ab", "c" * 40][:alphabet + 1])) for _ in range(rng.randrange(1, most))]
        if c % 3 == 0:
            ts = [("user", "hot")] + ts
        out += [(c, t if rng.random() > 0.05 or t else None, *x) for t, x in enumerate(ts)]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    scratch = Scratch(spark, "test")
    turns = scratch.write(prefix_trie.ordered(df), "turns")
    return sorted(tuple(r) for r in prefix_trie.digest(prefix_trie.prefix_trie(scratch.write(prefix_trie.spliced(turns), "spliced"), scratch, **options)).collect())


@pytest.mark.parametrize("fan, messages", [(256, 500_000), (3, 2)])
def test_nodes(spark, fan, messages):
    rows = rows_of(1, 330) + [(1000, None, None, None), (1001, 5, "user", "late"), (1001, 5, "user", "late"), (-250, 1, "user", "below"), (None, 1, "user", "lost")]
    rows += [(2000 + i, t, "user", "copy") for i in range(40) for t in range(8)]
    assert found(spark, rows, fan=fan, messages=messages) == plain_nodes(rows)


def test_long_conversations_are_named_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = rows_of(2, 40, most=60)
    rows += [(50 + i, t, "user", "same") for i in range(9) for t in range(100)]
    assert found(spark, rows) == plain_nodes(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, 0, "user", "x")]) == plain_nodes([(7, 0, "user", "x")])


def test_queue_spills_in_order():
    rng = random.Random(4)
    queue, items = prefix_trie.SpillingQueue(2, 10), [(rng.randrange(-50, 50), rng.randrange(1 << 60)) for _ in range(500)]
    for x in items:
        queue.push(x)
    out = []
    while queue.first() is not None:
        out.append(queue.pop())
    assert out == sorted(items) and queue.made > 40


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in op12_prefix_trie(spark, sf).collect()) == plain_nodes(rows)
