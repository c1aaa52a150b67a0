"""Periodic runs of words by recompression.

A run is a maximal stretch of words with smallest period q that holds at least four periods and six words. Any such run
holds four neighbouring multiples of q, so the places iq of a harmonic grid (n/q of them for each q) are the candidates:
words there that agree three times in a row are extended exactly, both ways, by longest common extensions of the
places q apart in a run-length grammar of the document (`recompression`). A run is taken at its first grid place only,
and of the periods that give one stretch the smallest stays.

Documents are read whole and dealt into lots of a bounded number of words that share one grammar; a longer document is a
lot of its own, so a task holds one lot at a time.

Defined results: words are parted by ASCII white space and compared byte by byte; null, empty and white texts have no
words and no runs. Rows are independent: repeated rows give repeated results, a null id is kept. Further columns are
kept whatever their names (the added ones come last, under names of the caller's choice); an empty table stays empty."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from populi.llm.recompression import Grammar

LOT_WORDS = 400_000  # words of the documents that share a grammar
GRID_WORDS = 1 << 16  # texts up to there share one stored grid; longer ones make theirs part by part
QUERIES = 1 << 18  # extensions asked at once
EXPONENT, LEAST = 4, 6  # periods and words that a run holds at least
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def _grid(n: int, periods: range) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all grid places that three further periods follow in n words."""
    q = np.arange(periods.start, periods.stop)
    many = np.maximum((n - 1) // q - 2, 0)
    period = np.repeat(q, many)
    before = np.repeat(np.cumsum(many) - many, many)
    return (np.arange(len(period)) - before) * period, period


class _Grid:
    """The grid of GRID_WORDS words, ordered by what a text must hold, so that a shorter text's grid is its beginning."""

    def __init__(self):
        place, period = _grid(GRID_WORDS, range(1, GRID_WORDS // 3 + 1))
        ends = place + 3 * period
        order = np.argsort(ends, kind="stable")
        self.place, self.period = place[order].astype(np.int32), period[order].astype(np.int32)
        self.upto = np.searchsorted(ends[order], np.arange(GRID_WORDS + 1))  # grid places whose last word is before n


_SHARED: list[_Grid] = []  # of a worker process


def _kept(words: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hit = np.flatnonzero(words[place] == words[place + period])
    for k in (1, 2):
        p, q = place[hit], period[hit]
        hit = hit[words[p + k * q] == words[p + (k + 1) * q]]
    return place[hit].astype(np.int64), period[hit].astype(np.int64)


def candidates(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of the grid, (place, period), at which the words of four places agree."""
    n = len(words)
    if n <= GRID_WORDS:
        if not _SHARED:
            _SHARED.append(_Grid())
        grid = _SHARED[0]
        yield _kept(words, grid.place[:grid.upto[n]], grid.period[:grid.upto[n]])
        return
    q = 1
    while q <= (n - 1) // 3:
        more = min(max(q, GRID_WORDS * q // n), (n - 1) // 3 - q + 1)  # some GRID_WORDS places at a time
        yield _kept(words, *_grid(n, range(q, q + more)))
        q += more


def runs_of(documents: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of word numbers its runs, rows of (start, length, period) by start, then period."""
    found: list[list[np.ndarray]] = [[] for _ in documents]
    size = np.array([len(d) for d in documents], np.int64)
    begin = np.cumsum(size + 1) - size  # a separator before every document, and one at the end
    total = int(size.sum()) + len(documents) + 1
    apart = np.append(begin - 1, total - 1)
    text = np.empty(total, np.int64)
    text[apart] = -1 - np.arange(len(apart))
    for b, d in zip(begin.tolist(), documents):
        text[b:b + len(d)] = d
    grammar: Grammar | None = None
    queue: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        nonlocal grammar
        grammar = grammar or Grammar(text, apart)
        doc, place, q = (np.concatenate(x) for x in zip(*queue))
        x = place + begin[doc]
        right = grammar.extension(x, x + q)
        good = np.flatnonzero(right > (exponent - 2) * q)  # less from the first grid place of a run
        doc, place, q, x, right = doc[good], place[good], q[good], x[good], right[good]
        left = grammar.extension(x - 1, x + q - 1, forward=False)
        length = left + right + q
        good = np.flatnonzero((left < q) & (length >= np.maximum(least, exponent * q)))
        rows = np.stack((doc, place - left, length, q), 1)[good]
        for d, part in zip(*_split(rows)):
            found[d].append(part)
    for k, words in enumerate(documents):
        for place, q in candidates(words):
            if len(place):
                for at in range(0, len(place), QUERIES):
                    queue.append((np.full(len(place[at:at + QUERIES]), k), place[at:at + QUERIES], q[at:at + QUERIES]))
                    waiting += len(queue[-1][0])
                    if waiting >= QUERIES:
                        settle()
                        queue, waiting = [], 0
    if queue:
        settle()
    return [_smallest(np.concatenate(f)) if f else np.zeros((0, 3), np.int64) for f in found]


def _split(rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    ids, at = np.unique(rows[:, 0], return_index=True)
    return ids.tolist(), [part[:, 1:] for part in np.split(rows, at[1:])] if len(rows) else []


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period, by start and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return b" ".join([words[i] for i in keep])


def _lots(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, the words of each row) of neighbouring rows, LOT_WORDS words or one row at most."""
    start, lot, held = 0, [], 0
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if lot and held + len(words) > LOT_WORDS:
            yield start, lot
            start, lot, held = k, [], 0
        lot.append(words)
        held += len(words)
    if lot:
        yield start, lot


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", n_col: str = "n_words", collapsed_col: str = "collapsed") -> DataFrame:
    """The rows of docs, and after their columns the number of words, the runs and the text without repeats."""
    inner = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    at = inner.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start, lot in _lots(batch.column(at).to_pylist()):
                number: dict[bytes, int] = defaultdict(count().__next__)
                found = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in lot])
                cells = [pa.array([len(w) for w in lot], pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), r)) for r in f.tolist()] for f in found],
                                  pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                         pa.array([collapsed(w, f).decode("utf-8", "surrogatepass") for w, f in zip(lot, found)], pa.string())]
                part = batch.slice(start, len(lot))
                yield pa.RecordBatch.from_arrays([*part.columns, *cells], names=[*part.schema.names, n_col, runs_col, collapsed_col])
    schema = StructType([*inner.schema.fields])
    for name, kind in ((n_col, LongType()), (runs_col, ArrayType(RUN)), (collapsed_col, StringType())):
        schema = schema.add(name, kind)
    return inner.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: every document of which crc32(doc_id) ends in 0 with its words from a on replaced by repeats of the p words there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, text = F.floor(h / 10), F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), cycle), F.lit(1), n), " ")
    blank = text.rlike(r"^[\x20\x09-\x0D]*$")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & ~blank, repeated).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run and hashes of the runs and of the text without repeats."""
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = F.get(best, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return out.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), F.col("b.p").alias("period"),
                      F.floor(1000 * length / F.col("b.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
