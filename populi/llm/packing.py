"""Best-fit packing into sequences of a fixed length by hierarchical residual packing.

Every task tokenises its documents and cuts only those longer than a sequence. Each partition then packs its pieces
best-fit: the largest opens a bin and its room takes the one or two pieces that fill it best, again and again. Bins that
are nearly full are emitted; what stays underfull goes on to the next level of a merge tree, item by item, where fewer
tasks pack the residuals of several again. Bins without a piece over half a sequence go on first, whose pieces can fill
the rooms beside large ones elsewhere. At most three quarters of a task's items go on, and no more than the next
level's tasks may hold: beyond that the fullest bins, which have the least to gain, are emitted too. So every level
shrinks, and the tree always ends in one task.

Defined results: a null or empty text is one piece holding only the closing id; repeated rows are packed each on its
own; further input columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from populi.llm.common import Scratch, gathered, text_or_empty

CAPACITY = 2048
SLACK = 8  # a bin with at most so many free places is nearly full
FAN_IN = 8  # tasks whose residuals meet in one task of the next level
TASK_ROWS = 1_000_000  # pieces that one packing task may hold
MEMO = 400_000  # words whose ids a task remembers; a cache, cleared when full
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, done boolean, task int"


PLAIN = re.compile("[a-zß-öø-ÿ]+")  # lower-case letters that the tokenizer's normalizer leaves as they are
ENDING = b".,!?;:|$%&*#()"


def _byte_signs() -> list[str]:
    """The sign by which a byte-level vocabulary writes each byte: itself where printable, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Ids of a stretch of text (UTF-8) as little-endian bytes, remembered.

    This tokenizer drops white space and never joins across it, so a text's ids are those of the stretches between its
    ASCII white space, in order. It lowers letters and parts a word from the signs that end it, so both are remembered
    apart, and a word of plain lower-case letters goes to the merges directly."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.path, tokenizer = path, Tokenizer.from_file(path)
        self.encode, self.merge, self.signs = tokenizer.encode, tokenizer.model.tokenize, _byte_signs()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, part: bytes) -> bytes:
        ids = self.words.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is None:
                text = part.decode()
                if PLAIN.fullmatch(text):
                    found = [t.id for t in self.merge("".join([self.signs[b] for b in part]))]
                else:
                    found = self.encode(text, add_special_tokens=False).ids
                ids = np.array(found, "<u4").tobytes()
            if len(self.words) >= MEMO:
                self.older, self.words = self.words, {}
            self.words[part] = ids
        return ids

    def __missing__(self, stretch: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        if b"<|" in stretch:  # a special token's name counts as written
            ids = self._ids(stretch)
        else:
            low = stretch.lower() if stretch.isascii() else stretch  # beside other signs a letter's case can matter to NFC
            word = low.rstrip(ENDING)
            last = word.decode()[-1:] if len(word) < len(low) else ""
            # an ending is parted from one letter or digit only (a letter may become two signs in lower case)
            ids = self._ids(word) + self._ids(low[len(word):]) if last.isalnum() and len(last.lower()) == 1 else self._ids(low)
        self[stretch] = ids
        return ids

    def document(self, text: str, closing: bytes = bytes(4)) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) + closing


_KNOWN: list[WordIds] = []  # of a worker process: tasks that follow each other share the words


def word_ids(path: str) -> WordIds:
    if not _KNOWN or _KNOWN[0].path != path:
        _KNOWN[:] = [WordIds(path)]
    return _KNOWN[0]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    def run(batches):
        words = word_ids(tokenizer)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = words.document(text)
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: the largest left opens a bin, and while items fit, the one or two that leave least room join it.

    Items are kept by size, and the set of present sizes is one integer, so the largest size up to a bound takes constant
    time; of pairs, only larger parts of half the best so far are tried, and a fit without rest ends the search."""
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, size in enumerate(sizes.tolist()):
        by_size[size].append(i)
    present = sum(1 << size for size in range(1, capacity + 1) if by_size[size])
    below = lambda bound: (present & ((1 << bound + 1) - 1)).bit_length() - 1  # noqa: E731  largest size up to bound, -1: none
    bins, opened = np.full(len(sizes), -1, np.int64), 0
    while present:
        room, chosen = capacity, [below(capacity)]
        while chosen:
            for size in chosen:
                bins[by_size[size].pop()] = opened
                room -= size
                if not by_size[size]:
                    present ^= 1 << size
            first = below(room)
            chosen, best = ([first], first) if first > 0 else ([], 0)
            while best < room and 2 * first > best and first > 0:
                second = below(min(room - first, first))
                if second == first and len(by_size[first]) < 2:
                    second = below(first - 1)
                if second > 0 and first + second > best:
                    chosen, best = [first, second], first + second
                first = below(first - 1)
        opened += 1
    for i in by_size[0]:  # empty items lie in the first bin
        bins[i] = 0
    return bins


def _packed(capacity: int, slack: int, level: int, most: float | None):
    """mapInArrow function: packs the items of a task; a bin's id is made of level, task and number. At most `most` items
    (None: no item), and three quarters of all, are left for the next level: those of bins of smaller items, then of the emptiest."""
    def run(batches):
        from pyspark import TaskContext
        rows = gathered(batches)
        if rows is None:
            return
        task = TaskContext.get().partitionId()
        size = rows.column("length").to_numpy()
        target = best_fit(size, capacity)
        order = np.lexsort((-size, target))
        before = np.cumsum(size[order]) - size[order]  # places taken before an item, over all bins
        fresh = np.r_[True, target[order][1:] != target[order][:-1]]
        place = np.empty(len(size), np.int64)
        place[order] = before - np.repeat(before[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(size)]))
        fill, items, largest = np.bincount(target, weights=size), np.bincount(target), np.zeros(target.max() + 1)
        np.maximum.at(largest, target, size)
        small = largest <= capacity // 2
        done = np.full(len(fill), True)
        if most is not None:
            emptiest = np.argsort(np.where(small, 0, fill), kind="stable")
            room = np.cumsum(items[emptiest]) <= min(most, len(size) * 3 // 4)
            done[emptiest[room & (small | (fill < capacity - slack))[emptiest]]] = False
        for name, values in (("bin", (np.int64(level) << 56) | (np.int64(task) << 32) | target), ("offset", place), ("done", done[target]),
                             ("task", np.full(len(size), task, np.int32))):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches(max_chunksize=100_000)
    return run


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN,
         task_rows: int = TASK_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset; pieces: a written table with the columns of `PIECES`."""
    count = pieces.count()
    if not count:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    session, columns = pieces.sparkSession, [c.split(" ")[0] for c in PIECES.split(", ")]
    tasks = max(-(-count // task_rows), min(int(session.conf.get("spark.sql.shuffle.partitions")), -(-count // 2000)))
    # a first task is drawn from the row, so equal rows spread evenly
    todo = pieces.where(F.col("length") < capacity).withColumn("task", F.monotonically_increasing_id()).repartition(tasks, "task")
    level = 1
    out = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("bin"), F.lit(0).cast("long").alias("offset"))
    while True:
        narrower = -(-tasks // fan_in)
        most = None if tasks == 1 else narrower * task_rows / tasks
        packed = scratch.write(todo.select(columns).mapInArrow(_packed(capacity, slack, level, most), PLACED), f"packed-{level}")
        out = out.unionByName(packed.where("done").select(*columns, "bin", "offset"))
        if tasks == 1:
            return out.select(*columns, F.col("bin").alias("sequence_id"), "offset")
        todo, tasks, level = packed.where(~F.col("done")).repartition(narrower, F.pmod("task", F.lit(narrower))), narrower, level + 1
