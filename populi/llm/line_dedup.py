"""Removal of repeated runs of lines by winnowing over line hashes.

A document is the sequence of its lines' hashes. A window is the shortest stretch from a line on that holds `min_words`
words; its minimum hash is its fingerprint, and because the minimum depends on the window's lines only, two documents
that share a run of `min_words` words share the fingerprint of the window at the run's start: none is missed. Windows meet
by (fingerprint, hash of the window); the first in the order of doc_id and place is the original. A later one is a
match, extended line by line both ways against the original; the lines of a match are deleted from the later place.
Windows are counted without their surroundings first; those that are left carry the few lines around them that an
extension can need (what lies further is in a window of its own), so no document is compared with another as a whole
and a window shared by many documents costs one row for each.

Passages in the middle of lines are found the same way with every stretch of `GRAM` words as a line of its own: of
`SPAN` consecutive stretches the one of the smallest hash is a fingerprint, so that a run of `PASSAGE` words shared
anywhere has one in common. Where documents share a fingerprint and a later one has it outside the lines already
deleted, the match is extended both ways: all windows of `PASSAGE` words around the fingerprint are hashed at all its
places, and those that an earlier document has are deleted; a longer match is the union of its windows.

Defined results: lines are parted by line feeds and compared exactly, but for white space at their ends; a run counts
its words; white lines match only within a run. Null and empty texts stay as they are. Rows equal in doc_id and text
are one document and all get its result; a null doc_id comes after all others. Further columns are kept, whatever their
names; an empty table gives an empty result. Whole texts are read, some at a time in one array of bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from populi.llm.common import Scratch, per_batch

MIN_WORDS = 10  # of a repeated run of lines
GRAM, SPAN = 16, 34  # words of a stretch, and consecutive stretches of which one is a fingerprint
PASSAGE = GRAM + SPAN  # words of a passage inside lines; all of GRAM + SPAN - 1 words share a fingerprint
SALTS = 8  # parts of a frequent hash's places
FREQUENT, HASHES = 1_000, 1_000  # a frequent hash has more places; so many of the most frequent ones are parted
BYTES = 1 << 20  # of texts that stand in arrays at once, or one document
KEY = ("__doc", "__text")  # doc_id and the text's hash: a document
WINDOWS = "line int, last int, fingerprint long, window long, again boolean, before array<long>, after array<long>"
STRETCH = np.dtype([("hash", "<i8"), ("start", "<i4"), ("line", "<i4"), ("last", "<i4")])  # a fingerprint, its first word, the lines of its first and last


class Words(NamedTuple):
    """The words and lines of some texts, one after the other."""
    data: np.ndarray  # bytes, of which eight blank ones follow the last text
    first: np.ndarray  # of each word
    end: np.ndarray
    upto: np.ndarray  # words before each text, and all
    feeds: np.ndarray  # words before each line's end
    lines: np.ndarray  # lines before each text, and all


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" * 9, np.uint8)
    blank = (data == 32) | ((data - np.uint8(9)) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))) + 1
    feeds = np.flatnonzero(data[1:begins[-1]] == 10) + 1
    first = edges[::2]
    return Words(data, first, edges[1::2], np.searchsorted(first, begins), np.searchsorted(first, feeds), np.searchsorted(feeds, begins))


def _bounded(fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch], column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adapter for mapInArrow as per_batch, for slices of about BYTES bytes in a column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(upto // BYTES)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                out = fn(batch.slice(low, high - low))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
    return run


def _bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _listed(values: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool = False) -> pa.Array:
    """Lists of the values from low to high, or from high down to low."""
    sizes = high - low
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    at = np.repeat(high, sizes) - 1 - step if back else np.repeat(low, sizes) + step
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[at], pa.int64()))


def windows_of(w: Words, min_words: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Text and the columns of WINDOWS of each window: first and last line, fingerprint, hash of the lines, whether the text has
    these lines before, hashes before from the nearest on, hashes after."""
    total = np.concatenate(([0], w.feeds))
    held, words, n = memoryview(w.data), np.diff(total), len(w.feeds)
    spoken, hashes = np.flatnonzero(words), np.full(n, _signed(xxhash.xxh64_intdigest(b"")), np.int64)
    hashes[spoken] = [_signed(xxhash.xxh64_intdigest(held[a:b])) for a, b in zip(w.first[total[spoken]].tolist(), w.end[total[spoken + 1] - 1].tolist())]
    text = np.repeat(np.arange(len(w.upto) - 1), np.diff(w.lines))
    ends = np.searchsorted(total, total[spoken] + min_words)  # lines up to there hold enough words
    whole = ends <= w.lines[text[spoken] + 1]
    line, ends = spoken[whole], ends[whole]
    text = text[line]
    low, high = w.lines[text], w.lines[text + 1]
    # fewer words lie between the first of these lines and this
    befores = np.maximum(np.searchsorted(total, total[line] - min_words, side="right") - 1, low)
    # the line that completes another window is not needed
    afters = np.maximum(np.minimum(np.searchsorted(total, total[ends] + min_words), high), ends)
    bounds = np.stack((line, ends), 1).ravel()
    least = np.minimum.reduceat(np.append(hashes, 0), bounds)[::2] if len(line) else hashes[:0]
    spelt = memoryview(hashes.tobytes())
    content = np.array([_signed(xxhash.xxh64_intdigest(spelt[8 * a:8 * b])) for a, b in zip(line.tolist(), ends.tolist())], np.int64)
    order = np.lexsort((line, content, text))
    again = np.zeros(len(line), bool)
    again[order[1:]] = (np.diff(content[order]) == 0) & (np.diff(text[order]) == 0)
    return text, [pa.array((line - low).astype(np.int32)), pa.array((ends - 1 - low).astype(np.int32)), pa.array(least), pa.array(content), pa.array(again),
                  _listed(hashes, befores, line, back=True), _listed(hashes, ends, afters)]


def _sketches(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each window of each row, and one with its fingerprints (`stretches`, of STRETCH); rows of one document give the same ones."""
    names = [c.split(" ")[0] for c in WINDOWS.split(", ")]

    def one(batch: pa.RecordBatch) -> pa.Table:
        w = words_of(_bytes(batch))
        text, columns = windows_of(w, min_words)
        windows = pa.table([batch.column(c).take(pa.array(text)) for c in KEY] + columns, names=[*KEY, *names])
        found, at = stretches_of(w)
        offsets = np.searchsorted(at, np.arange(len(w.upto))) * STRETCH.itemsize
        packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(found.tobytes())])
        marks = pa.table([batch.column(c) for c in KEY] + [packed], names=[*KEY, "stretches"])
        columns = [*KEY, *names, "stretches"]
        return pa.concat_tables([windows, marks], promote_options="default").select(columns)
    return docs.select(*KEY, "text").mapInArrow(_bounded(one, "text"), f"{KEY[0]} long, {KEY[1]} long, {WINDOWS}, stretches binary")


def _same(a: str, b: str) -> F.Column:
    """How many leading elements two arrays share."""
    hits = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    miss = F.array_position(hits, F.lit(False))
    return F.when(F.size(hits) == 0, 0).when(miss == 0, F.size(hits)).otherwise(miss.cast("int") - 1)


def _merged(ranges: DataFrame) -> DataFrame:
    """KEY, runs: the ranges first, last of each document sorted and joined where they touch."""
    listed = ranges.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("r"))
    kind = "array<struct<first:int,last:int>>"
    merged = F.aggregate("r", F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"] - 1),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"),
                                                                  F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))))
        .otherwise(F.concat(acc, F.array(x))).cast(kind))
    return listed.select(*KEY, merged.alias("runs"))


def _order(single: bool) -> F.Column:
    """The order of documents: where every doc_id is `single` (one row each, none null) it is the order itself, which needs no sort to find the first."""
    return F.col(KEY[0]) if single else F.struct(F.col(KEY[0]).isNull().alias("late"), *[F.col(k) for k in KEY])


def _parted(rows: DataFrame, hashes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by `on` with a salt, so that the places of the most frequent hashes don't meet in one task. hashes: `on`, unique, and n."""
    frequent = F.broadcast(hashes.where(F.col("n") > FREQUENT).orderBy(F.desc("n")).limit(HASHES).select(*on, F.lit(SALTS - 1).alias("__top")))
    top = F.coalesce("__top", F.lit(0))
    rows = rows.join(frequent, on, "left").withColumn("salt", F.when(F.col("__top").isNull(), 0).otherwise(F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))).drop("__top")
    return rows, hashes.join(frequent, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), top))).drop("__top", "n").hint("shuffle_hash")


def repeated_runs(windows: DataFrame, scratch: Scratch, single: bool = False) -> DataFrame:
    """KEY, runs: sorted, merged [first, last] line ranges that an earlier place has already. windows: KEY and WINDOWS."""
    on = ["fingerprint", "window"]
    order = _order(single)
    found = windows.groupBy(*on).agg(F.count("*").alias("n"), F.min(order).alias("o"), F.max(order).alias("z"), F.max("again").alias("again"))
    found = scratch.write(found.where("z > o OR again").select(*on, "n"), "found")
    # only what is left is compared with its surroundings
    rows, hashes = _parted(windows, found, on)
    met = scratch.write(rows.join(hashes, [*on, "salt"], "left_semi").drop("salt"), "met")
    place = F.struct(F.col(KEY[0]).isNull().alias("late"), *[F.col(k) for k in KEY], "line")
    original = met.groupBy(*on).agg(F.count("*").alias("n"), F.min(F.struct(place.alias("place"), "before", "after")).alias("o"))
    original = original.select(*on, "n", F.col("o.place").alias("o_place"), F.col("o.before").alias("o_before"), F.col("o.after").alias("o_after"))
    rows, hashes = _parted(met, scratch.write(original, "original"), on)
    later = (rows.join(hashes, [*on, "salt"]).where(place != F.col("o_place"))
             .select(*KEY, (F.col("line") - _same("before", "o_before")).alias("first"), (F.col("last") + _same("after", "o_after")).alias("last")))
    return _merged(later)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, in a logarithm of passes."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _remainders() -> np.ndarray:
    """The cyclic redundancy checks of single bytes."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> 1) ^ (x & 1) * np.uint32(0xEDB88320)
    return x


REMAINDERS, LONG = _remainders(), 24  # longer words are taken one by one


def _checks(w: Words) -> np.ndarray:
    """crc32 of each word, byte by byte for all words that are long enough."""
    size = w.end - w.first
    order = np.argsort(255 - np.minimum(size, 255).astype(np.uint8), kind="stable")
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, LONG + 1), minlength=LONG + 2))
    at, h = w.first[order], np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(LONG):
        m = longer[k]
        if not m:
            break
        x = h[:m]
        h[:m] = REMAINDERS[(x ^ w.data[at[:m] + k]) & 255] ^ (x >> 8)
    h = ~h
    for j in range(longer[LONG]):
        h[j] = zlib.crc32(w.data[at[j]:w.end[order[j]]])
    out = np.empty(len(size), np.uint64)
    out[order] = h
    return out


def stretches_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The selected stretches (of STRETCH), and the text of each."""
    h, factor, width = _checks(w), 0x9E3779B97F4A7C15, 1
    if len(h) < GRAM + SPAN - 1:
        return np.zeros(0, STRETCH), np.zeros(0, np.int64)
    while width < GRAM:  # a power of two: stretches of twice the width from two neighbours
        h = h[:-width] * np.uint64(pow(factor, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # a stretch is selected if it is the smallest of some SPAN neighbours in its text: the largest of the minima around it is its own hash
    low = _sliding(h, SPAN, np.minimum)
    low[_outside(w.upto[:-1], w.upto[1:] - (GRAM + SPAN - 2), len(low))] = 0
    ends = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([ends, low, ends]), SPAN, np.maximum) == h)
    text = np.searchsorted(w.upto, at, side="right") - 1
    out = np.zeros(len(at), STRETCH)
    out["hash"], out["start"] = h[at].view(np.int64), at - w.upto[text]
    out["line"], out["last"] = (np.searchsorted(w.feeds, x, side="right") - w.lines[text] for x in (at, at + GRAM - 1))
    return out, text


def _outside(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in no range from low to high (that one excluded); empty ranges count for nothing."""
    some = high > low
    return np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(high[some], minlength=n + 1))[:n] == 0


def fingerprints(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, line of its first word, line of its last) of the selected stretches of a text."""
    found, _ = stretches_of(words_of([text.encode("utf-8", "surrogatepass")]))
    return tuple(found[c].astype(np.int64) for c in STRETCH.names)


FACTOR = 0xD6E8FEB86659FD93  # odd, so that a change of one word always changes the hash of a window


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0 to n - 1 and 0 to 1 - n, modulo 2^64."""
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _hashes(w: Words) -> np.ndarray:
    """A hash of each word, eight bytes at a time; words of more than 256 bytes are taken one by one."""
    eight = np.ndarray(len(w.data) - 7, "<u8", buffer=w.data, strides=(1,))
    out = (w.end - w.first).astype(np.uint64)
    row = np.flatnonzero(out <= 256)
    at, left, h = w.first[row], (w.end - w.first)[row], out[row]
    while len(row):
        h = (h ^ eight[at] & MASKS[np.minimum(left, 8)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out[row] = h
        more = left > 8
        row, at, left, h = row[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(w.end - w.first > 256).tolist():
        out[i] = xxhash.xxh64_intdigest(w.data[w.first[i]:w.end[i]])
    return out


def passages_of(w: Words, text: np.ndarray, starts: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of all windows of PASSAGE words that hold one of the stretches, and whether one of these is free.

    A window's hash is a polynomial of its words' hashes, from the sums up to both its ends."""
    at, top = starts + w.upto[text], w.upto[text + 1] - PASSAGE
    low, high = np.maximum(w.upto[text], at + GRAM - PASSAGE), np.minimum(at, top) + 1
    n = int(w.upto[-1])
    first = np.flatnonzero(~_outside(low, high, n))
    up, down = _powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_hashes(w) * up)))
    h = (sums[first + PASSAGE] - sums[first]) * down[first]
    h ^= h >> np.uint64(32)
    of = np.searchsorted(w.upto, first, side="right") - 1
    return of, first - w.upto[of], (h * np.uint64(FACTOR)).view(np.int64), ~_outside(low[free], high[free], n)[first]


def passages_around(text: str, starts: list[int], free: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes and freedom of the windows around the stretches of one text."""
    w = words_of([text.encode("utf-8", "surrogatepass")])
    return passages_of(w, np.zeros(len(starts), np.int64), np.array(starts, np.int64), np.array(free, bool))[1:]


def _joined(places: DataFrame) -> DataFrame:
    """KEY, runs: the word ranges that the windows of PASSAGE words cover together. places: KEY and first."""
    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("r")
        first, sizes = lists.flatten().to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        opens = np.flatnonzero((np.diff(first, prepend=0) > PASSAGE) | (np.diff(row, prepend=-1) > 0))
        closes = np.concatenate((opens[1:], [len(first)])) - 1 if len(opens) else opens
        ranges = pa.StructArray.from_arrays([pa.array(first[opens].astype(np.int32)), pa.array((first[closes] + PASSAGE - 1).astype(np.int32))], names=["first", "last"])
        offsets = pa.array(np.searchsorted(row[opens], np.arange(len(sizes) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.ListArray.from_arrays(offsets, ranges)], names=[*KEY, "runs"])
    listed = places.groupBy(*KEY).agg(F.sort_array(F.collect_list("first")).alias("r"))
    return listed.mapInArrow(per_batch(join), f"{KEY[0]} long, {KEY[1]} long, runs array<struct<first:int,last:int>>")


def _free(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each stretch of the documents; free are those that the document's runs of lines don't cover."""
    packed, runs = batch.column("stretches").cast(pa.binary()), batch.column("runs")
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    found = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(STRETCH)
    row = np.repeat(np.arange(len(packed)), np.diff(offsets) // STRETCH.itemsize)
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ranges = runs.flatten()
    place = lambda row, line: (row << 32) + line
    first, last = (np.concatenate(([-1], place(np.repeat(np.arange(len(sizes)), sizes), ranges.field(c).to_numpy(zero_copy_only=False).astype(np.int64)))) for c in ("first", "last"))
    at = np.searchsorted(first, place(row, found["line"].astype(np.int64)), side="right") - 1  # the range that starts last before the stretch
    free = last[at] < place(row, found["last"].astype(np.int64))
    return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in KEY]
                                      + [pa.array(np.ascontiguousarray(found["hash"])), pa.array(np.ascontiguousarray(found["start"])), pa.array(free)], names=[*KEY, "hash", "start", "free"])


def _look(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each window of PASSAGE words around the places of the documents (`places`: twice the first word, plus one if free)."""
    places = batch.column("places")
    code = places.flatten().to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy())
    row, *cells = passages_of(words_of(_bytes(batch)), text, code >> 1, code % 2 == 1)
    return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in KEY] + [pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int64(), pa.bool_()))],
                                      names=[*KEY, "first", "window", "free"])


def _with(docs: DataFrame, told: DataFrame, kind: str = "left") -> DataFrame:
    """docs with the columns of told, one row a document, which is built into a map in each task: docs are not sorted and nothing is broadcast."""
    others = [c for c in told.columns if c not in KEY]
    told = told.select(F.col(KEY[0]).alias("__d"), F.col(KEY[1]).alias("__t"), *others).hint("shuffle_hash")
    return docs.join(told, F.col(KEY[0]).eqNullSafe(F.col("__d")) & (F.col(KEY[1]) == F.col("__t")), kind).drop("__d", "__t")


def repeated_passages(docs: DataFrame, stretches: DataFrame, runs: DataFrame, scratch: Scratch, single: bool = False) -> DataFrame:
    """KEY, runs: [first, last] word ranges of passages that an earlier document has and whose lines `runs` does not cover. stretches: KEY and stretches."""
    rows = _with(stretches, runs).select(*KEY, "stretches", "runs").mapInArrow(_bounded(_free, "stretches"), f"{KEY[0]} long, {KEY[1]} long, hash long, start int, free boolean")
    rows = scratch.write(rows, "marked")
    place = _order(single)
    first_and_last = (F.count("*").alias("n"), F.min(place).alias("o"), F.max(F.when(F.col("free"), place)).alias("z"))
    shared = scratch.write(rows.groupBy("hash").agg(*first_and_last).where("z > o").select("hash", "n"), "shared")
    # a fingerprint that a third of all documents have must not meet in one task
    salted, hashes = _parted(rows, shared, ["hash"])
    places = salted.join(hashes, ["hash", "salt"], "left_semi").groupBy(*KEY).agg(F.collect_list((F.col("start").cast("long") * 2 + F.col("free").cast("int"))).alias("places"))
    spans = _with(docs, places, "inner").select(*KEY, "text", "places").mapInArrow(_bounded(_look, "text"), f"{KEY[0]} long, {KEY[1]} long, first int, window long, free boolean")
    spans = scratch.write(spans, "spans")
    for name in ("marked", "shared"):
        scratch.drop(name)
    original = scratch.write(spans.groupBy("window").agg(*first_and_last).where("z > o").select("window", "n", "o"), "held")
    salted, hashes = _parted(spans.where("free"), original, ["window"])
    held = salted.join(hashes, ["window", "salt"]).where(place != F.col("o"))
    merged = scratch.write(_joined(held.select(*KEY, "first")), "passages")
    for name in ("spans", "held"):
        scratch.drop(name)
    return merged


WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def without(text: str, lines: list[tuple[int, int]], words: list[tuple[int, int]]) -> str:
    """The text without the line ranges and the word ranges; a line that loses all its words goes."""
    out, word, l, w = [], 0, 0, 0
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        here = len(line.split())
        while l < len(lines) and lines[l][1] < i:
            l += 1
        while w < len(words) and words[w][1] < word:
            w += 1
        end = word + here
        if l < len(lines) and lines[l][0] <= i:
            pass
        elif w < len(words) and words[w][0] < end and here:
            spans, at, kept, v = [m.span() for m in WORD.finditer(line)], 0, [], w
            while v < len(words) and words[v][0] < end:
                a, b = max(words[v][0], word) - word, min(words[v][1], end - 1) - word
                kept.append(line[at:spans[a][0]])
                at = spans[b + 1][0] if b + 1 < here else len(line)
                v += 1
            left = b"".join(kept) + line[at:]
            if left.strip():
                out.append(left.rstrip() if at == len(line) else left)
        else:
            out.append(line)
        word = end
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def _cut(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """The rows with the edits done, and __lines; rows without edits pass as they are."""
    text, edits = batch.column(text_col), [batch.column(c) for c in ("__runs", "__passages")]
    some = pc.and_(pc.greater(pc.fill_null(pc.binary_length(text), 0), 0), pc.or_(*[pc.greater(pc.fill_null(pc.list_value_length(e), 0), 0) for e in edits]))
    ranges = ([[(r["first"], r["last"]) for r in rs or ()] for rs in e.filter(some).to_pylist()] for e in edits)
    clean = [without(t, l, w) for t, l, w in zip(text.filter(some).to_pylist(), *ranges)]
    lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int32())
    clean = pc.replace_with_mask(text, some, pa.array(clean, text.type))
    return pa.RecordBatch.from_arrays([clean if c == text_col else batch.column(c) for c in batch.schema.names] + [lines], names=[*batch.schema.names, "__lines"])


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated runs deleted from the text, and after their columns __lines (lines before), __runs (line
    ranges) and __passages (word ranges) that were deleted, null if none were."""
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.col(text_col).cast("string")
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    single = ids.where("id IS NULL OR n > 1").isEmpty()
    keyed = docs.withColumns({KEY[0]: F.col(id_col).cast("long"), KEY[1]: F.lit(0).cast("long") if single else F.xxhash64(text)})
    held = keyed.where(text != "").select(*KEY, text.alias("text"))
    sketches = scratch.write(_sketches(held, min_words), "windows")
    runs = scratch.write(repeated_runs(sketches.where("window IS NOT NULL").drop("stretches"), scratch, single), "runs")
    for name in ("found", "met", "original"):
        scratch.drop(name)
    # rows of one document have the same stretches
    stretches = sketches.where("stretches IS NOT NULL").select(*KEY, "stretches")
    passages = repeated_passages(held, stretches, runs, scratch, single)
    scratch.drop("windows")
    none = F.lit(None).cast("array<struct<first:int,last:int>>")
    edits = (runs.withColumnRenamed("runs", "__runs").withColumn("__passages", none).unionByName(passages.withColumnRenamed("runs", "__passages").withColumn("__runs", none))
             .groupBy(*KEY).agg(F.max("__runs").alias("__runs"), F.max("__passages").alias("__passages")))
    out = _with(keyed, edits).withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in [*docs.columns, "__runs", "__passages"]])
    schema = StructType([*out.schema.fields]).add("__lines", IntegerType())
    return out.mapInArrow(_bounded(lambda batch: _cut(batch, text_col), text_col), schema)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, lines before, lines and words of passages removed, their ranges as first-last (from 0) and the text that stays."""
    ranges = lambda c: F.coalesce(F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ","), F.lit(""))
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"] + 1), F.lit(0).cast("long"))
    return cleaned.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__lines").cast("long").alias("n_lines"), size("__runs").alias("n_removed"),
                          ranges("__runs").alias("removed"), size("__passages").alias("n_words_removed"), ranges("__passages").alias("passages"), "text")
