"""The class model: exchange against the objective itself, exact counts and base scores, a proper distribution, held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from populi.llm import class_lm
from populi.llm.common import held_out
from populi.llm.queries import op13_class_lm


def objective(pairs, own, classes):
    hot = np.eye(classes + 1)[np.append(own, classes)]
    between = hot.T @ pairs @ hot
    f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return f(between) - f(between.sum(0)) - f(between.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(rng.gamma(0.3, 3, (25, 25))).astype(float)
    own = class_lm.exchange(pairs, classes=4)
    best = objective(pairs, own, 4)
    assert best > objective(pairs, np.arange(24) % 4, 4)
    for w in range(24):
        for b in range(4):
            other = own.copy()
            other[w] = b
            assert objective(pairs, other, 4) <= best + 1e-6


def corpus(seed, n):
    """Two languages that never mix, with rare words, case and all kinds of white space."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice("ab")
        words = [f"{lang}{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(rng.randrange(1, 60))]
        words = [w.upper() if rng.random() < 0.1 else w for w in words]
        out.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    return out


def plain_base(rows):
    tokens = {k: [w.lower() for w in (t or "").split()] + ["\0end"] for k, (_, t) in enumerate(rows)}
    crc = lambda i: zlib.crc32(str(i).encode() if i is not None else b"")
    counts = Counter(w for k, (i, _) in enumerate(rows) if crc(i) % 5 != 1 for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return [(i, crc(i) % 5 == 1, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n,
             sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_counts_and_scores(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(class_lm, "BLOCK", block)
    rows = corpus(1, 400) + [(900, None), (901, ""), (902, " \n"), (None, "a1 a2 never-seen"), (903, "b1 " * 3000), (3, "a1 a1"), (3, "a1 a1"), (906, "unseen " * 3)]
    got = class_lm.scored(docs_of(rows), held_out(5, 1)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(got, key=key), sorted(plain_base(rows), key=key)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5] and g["base_score"] == pytest.approx(w[5], rel=1e-9)
    held = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held) + 0.1 * sum(g["n_tokens"] for g in held)  # the languages are told apart


def test_probabilities_add_up_to_one(spark, docs_of):
    """All one-word texts over the vocabulary and an unseen word, and the empty text, make up what can follow a start; each then ends."""
    rows = corpus(2, 300)
    train = {w.lower() for i, t in rows for w in t.split() if zlib.crc32(str(i).encode()) % 5 != 1}
    ids = [i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    probes = [(i, w) for i, w in zip(ids, sorted(train) + ["unseen-word"])]
    # P(w, end) = P(w | start) P(end | class of w); a text w w' tells P(w' | w) apart
    two = [(i, f"{w} a1") for i, w in zip(ids[len(probes):], sorted(train) + ["unseen-word"])]
    got = {r["doc_id"]: r["score"] for r in class_lm.scored(docs_of(rows + probes + two + [(ids[-1], "")]), held_out(5, 1)).collect()}
    empty = 10 ** got[ids[-1]]
    steps = np.array([10 ** got[i] for i, _ in probes])
    assert 0 < steps.sum() + empty < 1
    pairs = np.array([[3., 1, 0], [0, 2, 2], [0, 0, 0]])
    full = np.zeros((class_lm.KINDS, class_lm.KINDS))
    full[:3, :3] = pairs
    share = np.zeros(class_lm.KINDS)
    share[:3] = 4, 3, 2
    assert np.allclose((10 ** class_lm.transitions(full, share, 1)).sum(1), 1)


def test_small_inputs(spark, docs_of):
    assert class_lm.scored(docs_of([]), held_out(5, 1)).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = class_lm.scored(docs_of([(i, "x y")]), held_out(5, 1)).first()  # nothing to learn from
    assert tuple(alone) == (i, True, 3, 0, 0, 0.0, 0.0)
    clash = docs_of([(2, "x y x"), (4, None)]).withColumns({"block": F.lit(1), "held": F.lit(2), "words": F.lit(3)})
    assert class_lm.scored(clash, held_out(5, 1)).count() == 2


def test_held_out_documents(spark):
    rows = [r for r in op13_class_lm(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
