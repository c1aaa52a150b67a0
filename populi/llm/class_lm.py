"""Brown class-based n-gram model: log P(text) = sum over tokens of log P(class | class before) + log P(word | class).

Texts are coded once: a block of some million tokens is one row with its own dictionary and the texts as numbers into it,
so later passes are array work on blocks and only dictionaries, one row per block and distinct word, are shuffled.

Classes come from exchange clustering, which moves a word to the class that most raises the mutual information of
neighbouring classes:
1. the SEEDS most frequent words are exchanged one by one until none moves (their bigram counts, SEEDS squared at most,
   fit one task);
2. each block guesses a class for its other words by the seeds next to them; all classes' bigrams are counted;
3. the counts of every word, by class of the word before and after, are summed over all blocks, and the word moves to its
   best class, however rare it is. Words that have no classed neighbour share a class of their own.
Counts are of all training texts, for all words; no word is cut off.

Smoothing: a word seen once also counts as an unseen one in the class bigrams, which gives unseen words, one type of
their own class, a probability after every class; class bigrams back off to class shares by Witten and Bell's rule.
Probabilities of all known words and the unseen type add up to one. A text starts as if after an end.

Defined results: words are parted by ASCII white space, A-Z lowered; a null or empty text is its end alone. Repeated
rows count each; a null doc_id counts as the empty text in the split and is kept. Without training rows every
probability is one. Other columns play no part; an empty table gives an empty result. Texts are read whole; a block is a
text at least."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from populi.llm.common import Scratch, text_or_empty

BLOCK = 2_000_000  # tokens of a block
SEEDS = 1_000
CLASSES = 64
LONE, END, UNSEEN = CLASSES, CLASSES + 1, CLASSES + 2  # words without classed neighbours, ends, words not in training
KINDS = CLASSES + 3
SWEEPS = 20  # of the seeds' exchange, a guard: they settle before
SHARE = 20_000  # a seed makes up one of so many tokens of some block
SLICE = 50_000  # rows of an output batch
BLOCKS = "block long, doc_id array<long>, held array<boolean>, size array<long>, codes binary, words binary, n binary"
OCCURRENCES = "word binary, block long, place int, n int, code array<short>, times array<int>"
CODED = "block long, doc_id array<long>, held array<boolean>, size array<long>, classes binary, known array<long>, base array<double>, emission array<double>"


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def coded_blocks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts: ids, whether held out, numbers of words, the words as numbers into the block's words (joined by
    spaces in the order of their numbers), and how often each occurs in training."""
    def run(batches):
        from pyspark import TaskContext
        name = TaskContext.get().partitionId() << 32
        ids, flags, sizes, parts = [], [], [], []
        number: dict[bytes, int] = defaultdict(count().__next__)
        filled = 0

        def row() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            train = codes[np.repeat(~np.array(flags, bool), sizes)]
            cells = [[name], [ids], [flags], [sizes], [codes.tobytes()], [b" ".join(number)], [np.bincount(train, minlength=len(number)).astype("<i4").tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=[c.split(" ")[0] for c in BLOCKS.split(", ")])
        slices = (batch.slice(at, 200) for batch in batches for at in range(0, batch.num_rows, 200))  # few texts at a time as Python strings
        for batch in slices:
            for doc_id, flag, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "held", "text")]):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                ids.append(doc_id)
                flags.append(flag)
                sizes.append(len(words))
                parts.append(np.fromiter(map(number.__getitem__, words), "<i4", len(words)))
                filled += len(words) + 1
                if filled >= BLOCK:
                    yield row()
                    name, filled = name + 1, 0
                    ids, flags, sizes, parts = [], [], [], []
                    number = defaultdict(count().__next__)
        if ids:
            yield row()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), text_or_empty(text_col).alias("text")).mapInArrow(run, BLOCKS)


class Block:
    """The arrays of one row of blocks."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, k: int = 0):
        cell = lambda c: batch.column(c)[k].as_py()
        self.block, self.size = cell("block"), np.array(cell("size"), np.int64)
        self.held = np.array(cell("held"), bool)
        self.codes = np.frombuffer(cell("codes"), "<i4")
        self.ends = np.cumsum(self.size)
        if "words" in batch.schema.names:
            self.words = cell("words").split()
        if "n" in batch.schema.names:
            self.n = np.frombuffer(cell("n"), "<i4")

    def train_pairs(self, kind_of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(before, after) of all neighbouring tokens of the training texts, mapped by kind_of, the end being `end`; with the word numbers (-1: end)."""
        at = self.ends + np.arange(len(self.size))  # where the ends stand
        word = np.empty(len(self.codes) + len(self.size), np.int32)
        here = np.ones(len(word), bool)
        here[at] = False
        word[here] = self.codes
        word[at] = -1
        kinds = np.append(kind_of, end).astype(np.int32)[word]  # the number -1 finds the last
        train = np.repeat(~self.held, self.size + 1)
        ends = np.array([end], np.int32), np.array([-1], np.int32)  # a text follows an end
        return np.concatenate((ends[0], kinds[:-1]))[train], kinds[train], np.concatenate((ends[1], word[:-1]))[train], word[train]


def _each(fn: Callable[[Block], Iterator[pa.RecordBatch]]):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from fn(Block(batch, k))
    return run


def _counted(keys: np.ndarray, names: list[str], divisor: int) -> pa.RecordBatch:
    """(a, b, times) of the distinct values of a * divisor + b."""
    found, times = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found // divisor, found % divisor, times)], names=names)


def _seed_numbers(block: Block, seeds: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((seeds.get(w, -1) for w in block.words), np.int64, len(block.words))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each of S words by exchange, from the classes of their order. pairs: (S+1) x (S+1) bigram counts, the last for ends."""
    s = len(pairs) - 1
    own = np.append(np.arange(s) % classes, classes)
    hot = np.eye(classes + 1)[own]
    after, before = pairs @ hot, pairs.T @ hot  # of each word: counts by the class of the word after, and before
    between = hot.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(s):
            a, loop = own[w], pairs[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[a] -= loop
            left[a] -= loop
            between[a] -= right
            between[:, a] -= left
            between[a, a] -= loop
            gain = _gain(between, right[None], left[None], classes)[0]
            # what the two sides share: the cell of a class before itself, and the word before itself
            cell, r, l = np.diag(between)[:classes], right[:classes], left[:classes]
            gain += _xlogx(cell + r + l + loop) - _xlogx(cell + r) - _xlogx(cell + l) + _xlogx(cell)
            for margin in (between[:classes].sum(1) + right.sum(), between[:, :classes].sum(0) + left.sum()):
                gain -= _xlogx(margin + loop) - _xlogx(margin)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            between[b] += right
            between[:, b] += left
            between[b, b] += loop
            if b != a:
                moved += 1
                own[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                before[:, a] -= pairs[w]
                before[:, b] += pairs[w]
        if not moved:
            break
    return own[:s]


def _gain(between: np.ndarray, right: np.ndarray, left: np.ndarray, candidates: int) -> np.ndarray:
    """How much the sum of N log N over class bigrams, less that of both margins, grows when a word with these counts (by class of
    the word after, and before) joins each class. One row a word; only counts above zero are looked at."""
    out = np.zeros((len(right), candidates))
    for counts, table in ((right, between[:candidates].T), (left, between[:, :candidates])):
        word, kind = np.nonzero(counts)
        if len(word):
            base = _xlogx(table)
            x = counts[word, kind][:, None]
            grown = _xlogx(table[kind] + x) - base[kind]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[starts]] += np.add.reduceat(grown, starts)
        total, margin = counts.sum(1)[:, None], table.sum(0)[None]
        out -= _xlogx(margin + total) - _xlogx(margin)
    return out


def _sums(block: Block, kinds: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word, side and class of the neighbour) of a block, coded word * 2 * KINDS + side * KINDS + class, and their counts."""
    before, after, earlier, word = block.train_pairs(kinds, END)
    if len(block.words) * 2 * KINDS >= 1 << 31:
        earlier, word = earlier.astype(np.int64), word.astype(np.int64)
    l, r = (word >= 0) & (before >= 0), (earlier >= 0) & (after >= 0)
    l[l] = ~skip[word[l]]
    r[r] = ~skip[earlier[r]]
    keys = np.concatenate((word[l] * 2 * KINDS + KINDS + before[l], earlier[r] * 2 * KINDS + after[r]))
    return np.unique(keys, return_counts=True)


def _dense(group: np.ndarray, code: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(right, left) counts of n words, by class."""
    flat = np.bincount(group * 2 * KINDS + code, weights=times, minlength=n * 2 * KINDS).reshape(n, 2, KINDS)
    return flat[:, 0], flat[:, 1]


def _best(between: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    gain = _gain(between, right, left, CLASSES + 1)
    return np.where((right.sum(1) + left.sum(1)) > 0, np.argmax(gain, 1), LONE)


def guessed(block: Block, seeds: dict[bytes, int], classes: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class of every word of a block: the seeds' own, for the others the best by the seeds next to them (-1: not in training)."""
    number = _seed_numbers(block, seeds)
    is_seed = number >= 0
    kinds = np.where(is_seed, classes[number] if len(classes) else -1, -1)
    keys, times = _sums(block, kinds, is_seed)
    out = np.where(is_seed, kinds, np.where(block.n > 0, LONE, -1))
    word, code = keys // (2 * KINDS), keys % (2 * KINDS)
    cuts = np.searchsorted(word, np.arange(0, len(block.words), 8192))
    for a, lo, hi in zip(range(0, len(block.words), 8192), cuts, np.append(cuts[1:], len(keys))):
        if hi > lo:
            ids, group = np.unique(word[lo:hi], return_inverse=True)
            out[ids] = _best(between, *_dense(group, code[lo:hi], times[lo:hi], len(ids)))
    return out


def _class_bigrams(table: DataFrame) -> np.ndarray:
    """a, b, times summed: KINDS squared numbers."""
    out = np.zeros((KINDS, KINDS))
    for a, b, times in table.groupBy("a", "b").agg(F.sum("times")).collect():
        out[a, b] = times
    return out


PAIR = "a long, b long, times long"


def fit_seeds(blocks: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The most frequent words (of those that are frequent in some block), numbered by rank, and their classes."""
    def frequent(block):
        at = np.flatnonzero(block.n >= max(1, block.n.sum() / SHARE))
        yield pa.RecordBatch.from_arrays([pa.array([block.words[i] for i in at], pa.binary()), pa.array(block.n[at], pa.int64())], names=["word", "n"])
    top = (blocks.select("block", "held", "size", "codes", "words", "n").mapInArrow(_each(frequent), "word binary, n long")
           .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(SEEDS).collect())
    seeds = {bytes(r["word"]): k for k, r in enumerate(top)}

    def pairs(block):
        before, after, _, _ = block.train_pairs(_seed_numbers(block, seeds), len(seeds))
        both = (before >= 0) & (after >= 0)
        yield _counted(before[both] * (len(seeds) + 1) + after[both], ["a", "b", "times"], len(seeds) + 1)

    def one(table: pa.Table) -> pa.Table:
        counts = np.zeros((len(seeds) + 1, len(seeds) + 1))
        counts[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("times").to_numpy()
        found = exchange(counts)
        return pa.table({"seed": pa.array(np.arange(len(found))), "class": pa.array(found)})
    counts = blocks.mapInArrow(_each(pairs), PAIR).groupBy("a", "b").agg(F.sum("times").alias("times"))
    classes = np.zeros(len(seeds), np.int64)
    whole = counts.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(one, "seed long, class long")  # SEEDS squared rows at most
    for seed, found in whole.collect():
        classes[seed] = found
    return seeds, classes


def classed_words(blocks: DataFrame, seeds: dict[bytes, int], classes: np.ndarray, scratch: Scratch) -> DataFrame:
    """block, place, times (of the word in training, in all blocks), class; is_first marks one row a word."""
    def seeded(block):
        number = _seed_numbers(block, seeds)
        before, after, _, _ = block.train_pairs(np.where(number >= 0, classes[number] if len(classes) else -1, -1), END)
        both = (before >= 0) & (after >= 0)
        yield _counted(before[both] * KINDS + after[both], ["a", "b", "times"], KINDS)
    between = _class_bigrams(blocks.mapInArrow(_each(seeded), PAIR))

    def all_pairs(block):
        kinds = guessed(block, seeds, classes, between)
        before, after, _, _ = block.train_pairs(kinds, END)
        yield _counted(before * KINDS + after, ["a", "b", "times"], KINDS)
    whole = _class_bigrams(blocks.mapInArrow(_each(all_pairs), PAIR))

    def occurrences(block):
        kinds = guessed(block, seeds, classes, between)
        keys, times = _sums(block, kinds, _seed_numbers(block, seeds) >= 0)
        cuts = np.searchsorted(keys, np.arange(len(block.words) + 1, dtype=np.int64) * 2 * KINDS)
        code = (keys % (2 * KINDS)).astype(np.int16)
        for lo in range(0, len(block.words), SLICE):
            hi = min(lo + SLICE, len(block.words))
            part, offsets = slice(cuts[lo], cuts[hi]), pa.array((cuts[lo:hi + 1] - cuts[lo]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.words[lo:hi], pa.binary()), pa.array(np.full(hi - lo, block.block)), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(block.n[lo:hi]),
                 pa.ListArray.from_arrays(offsets, pa.array(code[part])), pa.ListArray.from_arrays(offsets, pa.array(times[part].astype(np.int32)))],
                names=[c.split(" ")[0] for c in OCCURRENCES.split(", ")])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        word = rows.column("word").combine_chunks()
        fresh = np.concatenate(([True], pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
        group, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        total = np.bincount(group, weights=rows.column("n").to_numpy()).astype(np.int64)
        code, times = rows.column("code").combine_chunks(), rows.column("times").combine_chunks()
        belongs = np.repeat(group, pc.list_value_length(code).to_numpy())
        kind = np.empty(len(at), np.int64)
        bounds = np.searchsorted(belongs, np.arange(0, len(at) + 4096, 4096))
        code, times = code.flatten().to_numpy(), times.flatten().to_numpy()
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            here = slice(4096 * k, min(4096 * (k + 1), len(at)))
            kind[here] = _best(whole, *_dense(belongs[lo:hi] - 4096 * k, code[lo:hi], times[lo:hi], here.stop - here.start))
        for g, w in enumerate(word.take(pa.array(at)).to_pylist()):
            if w in seeds:
                kind[g] = classes[seeds[w]]
        kind[total == 0] = UNSEEN
        return pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), rows.column("place").combine_chunks(), pa.array(total[group]),
                                           pa.array(kind[group].astype(np.int16)), pa.array(fresh & (total[group] > 0))],
                                          names=["block", "place", "times", "class", "is_first"])

    def decide(batches):
        kept: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            last = table.column("word")[-1]
            cut = pc.index(table.column("word"), last).as_py()  # the last word may go on
            if cut:
                yield settle(pa.concat_tables([*kept, table.slice(0, cut)]))
                kept = []
            kept.append(table.slice(cut))
        if kept:
            yield settle(pa.concat_tables(kept))

    def guarded(batches):
        return decide(b for b in batches if b.num_rows)
    gathered = blocks.mapInArrow(_each(occurrences), OCCURRENCES).repartition("word").sortWithinPartitions("word")
    return scratch.write(gathered.mapInArrow(guarded, "block long, place int, times long, class short, is_first boolean"), "classed")


def scored(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed words alone), score (log10 of the model's probability)."""
    scratch = Scratch(docs.sparkSession, "classes")
    blocks = scratch.write(coded_blocks(docs, held, id_col, text_col), "blocks")
    seeds, classes = fit_seeds(blocks)
    classed = classed_words(blocks, seeds, classes, scratch)
    sums = classed.where("is_first").groupBy("class").agg(F.sum("times").alias("n"), F.count("*").alias("words"), F.sum((F.col("times") == 1).cast("long")).alias("once")).collect()
    ends = blocks.select(F.explode("held").alias("h")).where("not h").count()
    of_class = np.zeros(KINDS)
    for r in sums:
        of_class[r["class"]] = r["n"]
    of_class[END] = ends
    known_words, once = sum(r["words"] for r in sums) + (ends > 0), sum(r["once"] for r in sums) + (ends == 1)
    tokens = int(of_class.sum())
    unit = tokens + 0.5 * (known_words + 1)

    def code(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left)
        n_words = int(block.codes.max()) + 1 if len(block.codes) else 0
        kind, n = np.full(n_words, UNSEEN, np.int64), np.zeros(n_words, np.int64)
        place = right.column("place").to_numpy()
        kind[place], n[place] = right.column("class").to_numpy(), right.column("times").to_numpy()
        emission = np.log10(np.where(n > 0, n, 1) / np.where(n > 0, of_class[kind], 1))
        base = np.log10((n + 0.5) / unit)
        per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[block.codes])))[np.concatenate(([0], block.ends))])
        exact = lambda x: np.array([s.sum() for s in np.split(x[block.codes], block.ends[:-1])] if len(block.size) else [])
        mark = (kind | np.where(n == 1, 128, 0)).astype(np.uint8)
        columns = [left.column("block"), left.column("doc_id"), left.column("held"), left.column("size"), pa.array([mark[block.codes].tobytes()], pa.binary()),
                   pa.array([per_doc((n > 0).astype(np.int64)) + (ends > 0)], pa.list_(pa.int64())),
                   pa.array([exact(base) + np.log10((ends + 0.5) / unit)], pa.list_(pa.float64())), pa.array([exact(emission)], pa.list_(pa.float64()))]
        return pa.table(columns, names=[c.split(" ")[0] for c in CODED.split(", ")])
    parts = blocks.drop("words", "n").groupBy("block").cogroup(classed.drop("is_first").groupBy("block"))
    coded = scratch.write(parts.applyInArrow(code, CODED), "coded")
    for name in ("blocks", "classed"):
        scratch.drop(name)

    def pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                before, after, once_before, once_after = _class_pairs(batch, k, train=True)
                keys = [before * KINDS + after, before[once_after] * KINDS + UNSEEN, UNSEEN * KINDS + after[once_before],
                        np.full(int((once_before & once_after).sum()), UNSEEN * KINDS + UNSEEN)]
                yield _counted(np.concatenate(keys), ["a", "b", "times"], KINDS)
    steps = transitions(_class_bigrams(coded.mapInArrow(pairs, PAIR)), of_class, once)

    def score(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                before, after, _, _ = _class_pairs(batch, k, train=False)
                size = np.array(batch.column("size")[k].as_py(), np.int64) + 1
                gone = np.add.reduceat(steps[before, after], np.cumsum(size) - size)
                n = len(size)
                columns = [batch.column("doc_id")[k].values, batch.column("held")[k].values, pa.array(size), batch.column("known")[k].values, pa.array(np.full(n, tokens, np.int64)),
                           batch.column("base")[k].values, pa.array(gone + np.array(batch.column("emission")[k].as_py()))]
                for at in range(0, n, SLICE):
                    yield pa.RecordBatch.from_arrays([c.slice(at, SLICE) for c in columns],
                                                     names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _class_pairs(batch: pa.RecordBatch, k: int, train: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of neighbouring tokens of a coded block (of the training texts only), and whether each is a word seen once."""
    size = np.array(batch.column("size")[k].as_py(), np.int64)
    marks = np.frombuffer(batch.column("classes")[k].as_py(), np.uint8)
    total = len(marks) + len(size)
    at = np.cumsum(size) + np.arange(len(size))
    here = np.ones(total, bool)
    here[at] = False
    tokens = np.full(total, END, np.int64)
    tokens[here] = marks
    before = np.concatenate(([END], tokens[:-1]))  # after an end a text starts as if after one
    if train:
        keep = np.repeat(~np.array(batch.column("held")[k].as_py(), bool), size + 1)
        before, tokens = before[keep], tokens[keep]
    return before & 127, tokens & 127, before > 127, tokens > 127


def transitions(pairs: np.ndarray, of_class: np.ndarray, once: int) -> np.ndarray:
    """log10 P(class | class before), of rows that sum to one."""
    if not of_class.any():
        return np.zeros((KINDS, KINDS))
    share = of_class.copy()
    share[UNSEEN] = once + 0.5
    share /= share.sum()
    kinds = np.maximum((pairs > 0).sum(1), 1)[:, None]
    smooth = (pairs + kinds * share[None]) / (pairs.sum(1)[:, None] + kinds)
    return np.log10(np.maximum(smooth, 1e-300))


def digest(scores: DataFrame) -> DataFrame:
    return scores
