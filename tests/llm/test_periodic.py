"""Periodic runs against a plain loop over starts and periods."""

import hashlib
import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from populi.llm import periodic
from populi.llm.recompression import Grammar


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and (i, length) not in out:
                out[i, length] = q
            i = j + 1
    return sorted((s, l, q) for (s, l), q in out.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def rows(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.random()
        part = [f"w{rng.randrange(3 if kind < 0.3 else 60)}" for _ in range(rng.randrange(120))]
        if kind > 0.6 and part:
            at = rng.randrange(len(part))
            part[at:at] = part[at:at + rng.randrange(1, 9)] * rng.randrange(2, 12)
        out.append((i, rng.choice([" ", "\n", " \t", "\x0b\x0c"]).join(part)))
    return out


def test_extensions():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 3, 8):
        text, apart = [], []
        for _ in range(12):
            apart.append(len(text))
            text.append(-len(apart))
            text += np.tile(rng.integers(0, alphabet, rng.integers(1, 40)), rng.integers(1, 6)).tolist()
        apart.append(len(text))
        text.append(-len(apart))
        text = np.array(text)
        grammar = Grammar(text, np.array(apart))
        spans = [(a + 1, b) for a, b in zip(apart, apart[1:]) if b - a > 2]
        x, y = np.array([rng.choice(np.arange(*spans[rng.integers(len(spans))]), 2, replace=False) for _ in range(3000)]).T
        for forward in (True, False):
            found, d = grammar.extension(x, y, forward), 1 if forward else -1
            for i, j, k in zip(x.tolist(), y.tolist(), found.tolist()):
                e = 0
                while text[i + d * e] == text[j + d * e] and text[i + d * e] >= 0:
                    e += 1
                assert e == k


def test_rows(spark, docs_of):
    held = rows(1, 400) + [(900, None), (901, ""), (902, " \n\t"), (None, "a a a a a a b"), (903, "x " * 5000), (904, "a b c " * 900 + "tail"), (3, "q " * 7), (3, "q " * 7)]
    found = periodic.digest(periodic.find_runs(periodic.planted(docs_of(held)))).collect()
    assert sorted(map(repr, ((r[0], *r[1:]) for r in found))) == sorted(repr((i, *plain_row(i, t))) for i, t in held)


def test_long_texts_make_their_grid_in_parts(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(periodic, "GRID_WORDS", 64)
    monkeypatch.setattr(periodic, "_SHARED", [])
    monkeypatch.setattr(periodic, "QUERIES", 50)
    docs = [np.array([rng.randrange(2) for _ in range(rng.randrange(400))] + [1, 2, 3] * rng.randrange(30)) for _ in range(40)]
    for d, found in zip(docs, periodic.runs_of(docs)):
        assert [tuple(r) for r in found.tolist()] == plain_runs(d.tolist())


def test_other_columns_and_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a a a a a a a"), (2, None)]).withColumn("runs", F.lit(7)).withColumn("n_words", F.lit(8))
    out = periodic.find_runs(docs, runs_col="found", n_col="size")
    assert out.columns == [*docs.columns, "size", "found", "collapsed"]
    assert [(r["runs"], r["size"], r["collapsed"]) for r in out.orderBy("doc_id").collect()] == [(7, 7, "a"), (7, 0, "")]
    assert periodic.digest(periodic.find_runs(periodic.planted(docs.limit(0)))).count() == 0
