"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon is learned: words and word stems that labelled toxic texts hold and others do not, each supported by several
different neighbouring words, so that copies of one text do not vote twice. Its trie is intersected with automata that
allow one edit (two for long terms; a swap of neighbours is one); the product is determinised as texts demand it and
cached. Every token of a text runs through it until the state dies, so misspelled terms are caught in linear time.
A hit weighs what its term and distance proved to be worth on the labelled rows; quotation marks and reporting words
around it move the weight to a separate sum, and a logistic model over the sums gives the score.

Defined results: null and empty texts get the score of a text without hits; rows without a label teach nothing; with no
usable label the lexicon is empty and the score is the smoothed base rate (0 without labels). Repeated rows are scored
alike; further columns are ignored by the score and kept by `drop_toxic`; empty tables give empty results. The fit reads
at most `sample` labelled rows (smallest hashes of the id first); every text is scored whole."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from populi.llm.common import Scratch, per_batch, text_or_empty

SAMPLE = 16_000  # labelled rows that the fit may read, toxic and other together
MIN_SUPPORT = 4  # different neighbours of a term in toxic texts
MIN_ODDS = 4.0  # log odds of a term between toxic and other texts
STEMS = range(4, 8)
STEM_FORMS = 4  # words that a stem must have
WINDOW = 6  # tokens on either side

# Marks and words around a quotation or a report about somebody's words.
OPENERS, CLOSERS = "\"“„«‹‘'(", "\"”“»›’')"
REPORTING = frozenset("said says called quote quoted quotes wrote writes word term meaning reported zitat sagte nannte citation dit cita dijo".split())

WORD = re.compile(r"\w+")


def edits_of(term: str) -> int:
    """Edits allowed: none up to 4 characters, one up to 7, else two."""
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2


class Product:
    """Trie of terms times their edit automata, determinised lazily.

    A state is the set of (trie node, edits so far, character awaited after a swap) reachable, and the best stem already
    completed, which any ending keeps. `match` gives (term number, edits) or None."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.children, self.end, self.most, self.allowed = [{}], [None], [0], []
        for number, (term, stem) in enumerate(terms):
            node, k = 0, 0 if stem else edits_of(term)
            self.allowed.append(k)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.end[node] = (number, stem)
        self.ids, self.states, self.next, self.result = {}, [], [], []
        self.start = self._state({(0, 0, None)}, None)

    def _state(self, items: set, stem) -> int:
        todo = list(items)
        while todo:  # a character of the term left out
            node, e, awaited = todo.pop()
            if awaited is None:
                for child in self.children[node].values():
                    if (child, e + 1, None) not in items and e + 1 <= self.most[child]:
                        items.add((child, e + 1, None))
                        todo.append((child, e + 1, None))
        best: dict = {}
        for node, e, awaited in items:
            if e <= self.most[node] and e < best.get((node, awaited), 9):
                best[node, awaited] = e
        word = stem
        for (node, awaited), e in best.items():
            if awaited is None and self.end[node]:
                number, is_stem = self.end[node]
                if e <= self.allowed[number]:
                    word = min(word or (9, 0), (e, number))
                    if is_stem:
                        stem = min(stem or (9, 0), (e, number))
        key = (frozenset((n, e, a) for (n, a), e in best.items()), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.result.append(word)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        items, stem = self.states[state]
        after = set()
        for node, e, awaited in items:
            if awaited is not None:
                if c == awaited:
                    after.add((node, e, None))
                continue
            if e < self.most[node]:
                after.add((node, e + 1, None))  # c is one too many
            for d, child in self.children[node].items():
                if d == c:
                    after.add((child, e, None))
                elif e < self.most[child]:
                    after.add((child, e + 1, None))
                    if c in self.children[child]:
                        after.add((self.children[child][c], e + 1, d))
        after = {(n, e, a) for n, e, a in after if e <= self.most[n]}
        to = self.next[state][c] = self._state(after, stem)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        at = self.start
        for c in word:
            to = self.next[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.states[at][0]:
                break  # nothing but a completed stem is left
        found = self.result[at]
        return (found[1], found[0]) if found else None


class Hits(dict):
    """Best hit of a token, remembered; the memory is a cache and is cleared when full."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.product = Product(terms)

    def __missing__(self, token: str):
        if len(self) > 500_000:
            self.clear()
        found = [h for h in map(self.product.match, WORD.findall(token)) if h]
        hit = self[token] = min(found, key=lambda h: h[1]) if found else None
        return hit


def contexts(text: str, hits: Hits) -> tuple[list[tuple[int, int, bool]], int]:
    """((term, edits, quoted) of every hit, number of tokens)."""
    tokens = text.lower().split()
    found = []
    for i, hit in enumerate(map(hits.__getitem__, tokens)):
        if hit:
            before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
            opened = any(t[0] in OPENERS for t in (*before, tokens[i])) and any(t[-1] in CLOSERS or t[-1] in ".,;:!?" and len(t) > 1 and t[-2] in CLOSERS for t in (tokens[i], *after))
            told = any(t.strip(".,;:") in REPORTING for t in before)
            found.append((*hit, opened or told))
    return found, len(tokens)


def features(found: list[tuple[int, int, bool]], words: int, weights: dict[tuple[int, int], float]) -> list[float]:
    """Strongest hit, all hits outside and inside quotations, and their density, all from the weights of (term, edits)."""
    plain = [weights.get((t, e), 0.0) for t, e, quoted in found if not quoted]
    quoted = [weights.get((t, e), 0.0) for t, e, quoted in found if quoted]
    return [max(plain, default=0.0), float(np.log1p(sum(plain))), float(np.log1p(sum(quoted))), float(np.log1p(100 * len(plain) / max(words, 1)))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights with the intercept last, by Newton steps; the intercept is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(rows: DataFrame, scratch: Scratch) -> list[tuple[str, bool]]:
    """(term, is a stem): every term of the bounded sample (doc_id, text, toxic) that has the support and the odds, of any length.

    A term needs MIN_SUPPORT different neighbours, so the sample bounds the lexicon too."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    beside = F.concat(F.array(F.lit("")), words)
    pairs = rows.select("toxic", F.explode(F.arrays_zip(words.alias("word"), beside.alias("near"))).alias("p")).select(
        "toxic", F.col("p.word").alias("word"), F.col("p.near").alias("near"))
    support = (pairs.where(F.length("word") > 0).groupBy("word", "near").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("n"))
               .groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    support = scratch.write(support, "support")
    total = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).first()
    if not total["t"] or not total["n"]:
        return []
    odds = F.log((F.col("t") + 0.5) / total["t"]) - F.log((F.col("n") + 0.5) / total["n"])
    pure = lambda df, least: df.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    best = [F.desc("odds"), F.desc("t"), "term"]
    whole = pure(support, MIN_SUPPORT).select(F.col("word").alias("term"), "t", "odds").orderBy(*best).collect()
    stems = support.select("word", "t", "n", F.explode(F.array(*[F.lit(k) for k in STEMS])).alias("k")).where(F.length("word") > F.col("k"))
    stems = (stems.select(F.substring("word", F.lit(1), F.col("k")).alias("term"), "t", "n").groupBy("term")
             .agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum((F.col("t") > 0).cast("int")).alias("forms")).where(F.col("forms") >= STEM_FORMS))
    stems = pure(stems, 2 * MIN_SUPPORT).select("term", "t", "odds").orderBy(*best).collect()
    short: list[str] = []
    for term in sorted((r["term"] for r in stems), key=lambda t: (len(t), t)):
        if not any(term.startswith(s) for s in short):
            short.append(term)
    return [(r["term"], False) for r in whole] + [(t, True) for t in short]


class Model:
    """Lexicon, worth of each (term, edits), and the logistic weights; small, sent to the tasks with the function."""

    def __init__(self, terms: list[tuple[str, bool]], weights: dict, coefficients: list[float]):
        self.terms, self.weights, self.coefficients = terms, weights, coefficients

    def scores(self, found: list[tuple[list, int]]) -> np.ndarray:
        x = np.array([features(f, n, self.weights) for f, n in found]).reshape(-1, 4)
        z = x @ np.array(self.coefficients[:-1]) + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: F.Column, sample: int) -> DataFrame:
    """doc_id, text, label of at most `sample` rows, half of them of the rarer label if there are so many."""
    marks = labels.where(F.col(label).isin(0, 1) & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias(label))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ones, zeros = marks.where(F.col(label) == 1).orderBy(*order).limit(sample // 2), marks.where(F.col(label) == 0).orderBy(*order).limit(sample // 2)
    chosen = ones.unionByName(zeros)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows for which `usable` (a condition on doc_id) holds."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(labelled(docs, labels, "toxic", usable, sample), "sample")
    terms = learn_lexicon(rows, scratch)

    def find(batches):
        hits = Hits(terms)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [contexts(t, hits) for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([[[t, e, int(q)] for t, e, q in f] for f, _ in found], kind),
                                               pa.array([n for _, n in found], pa.int64())], names=["toxic", "hits", "words"])
        yield from per_batch(one)(batches)

    got = rows.select("toxic", "text").mapInArrow(find, "toxic int, hits array<array<int>>, words long").toPandas()  # bounded by sample
    scratch.drop("sample")
    y = got["toxic"].to_numpy(float)
    if not len(y):
        return Model([], {}, [0.0] * 4 + [-30.0])
    found = [([(int(t), int(e), bool(q)) for t, e, q in h], int(n)) for h, n in zip(got["hits"], got["words"])]
    with_hit: dict[tuple[int, int], list[float]] = {}
    for (hits_of, _), label in zip(found, y):
        for key in {(t, e) for t, e, _ in hits_of}:
            counts = with_hit.setdefault(key, [0.0, 0.0])
            counts[int(label)] += 1
    ones, zeros = y.sum(), len(y) - y.sum()
    prior: dict[int, list[float]] = {}  # of an edit distance, over all terms
    for (_, e), (n, t) in with_hit.items():
        p = prior.setdefault(e, [0.0, 0.0])
        p[0] += n
        p[1] += t
    worth = {}
    for (term, e), (n, t) in with_hit.items():
        pn, pt = prior[e]
        share = (t + 4 * pt / (pn + pt)) / (t + n + 4)
        worth[term, e] = max(0.0, float(np.log((share + 0.01) / (1.01 - share)) - np.log((ones + 1) / (zeros + 1))))
    for e, (pn, pt) in prior.items():  # misspellings that the labelled rows did not show count as their distance does
        for term in range(len(terms)):
            worth.setdefault((term, e), max(0.0, float(np.log((pt + 1) / (pn + 1)) - np.log((ones + 1) / (zeros + 1)))))
    if not ones or not zeros:
        rate = ones / len(y)
        return Model(terms, worth, [0.0] * 4 + [float(np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -30, 30))])
    x = np.array([features(f, n, worth) for f, n in found])
    return Model(terms, worth, [float(c) for c in logistic(x, y)])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __score; every other column stays as it is."""
    def find(batches):
        hits = Hits(model.terms)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("__t").to_pylist()
                scores = model.scores([contexts(t, hits) for t in texts])
                keep = [n for n in batch.schema.names if n != "__t"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(scores)], names=[*keep, "__score"])

    schema = StructType([*docs.schema.fields]).add("__score", DoubleType())
    return docs.withColumn("__t", text_or_empty(text_col)).mapInArrow(find, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    return score(docs, model).where(F.col("__score") < threshold).drop("__score")


def digest(docs: DataFrame, labels: DataFrame, held: F.Column) -> DataFrame:
    model = train(docs, labels, ~held)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
