"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are folded: lower case, every ASCII character but letters and digits a space, runs of spaces one. An item
is cut into windows of WINDOW bytes, one every STRIDE bytes and one at its end; a shorter one is one window. A document is
contaminated by an item if it holds a stretch within the edit budget, EDITS per byte, of one of its windows. Items of fewer
than SHORTEST folded bytes, too short for a budget, must stand there as they are, as whole words.

A stretch with at most e edits shares at least m - q + 1 - q e of the q-grams of a window of m bytes, on diagonals (place
in the text less place in the window) within 2 e of each other. Of a window only the rarest q-grams are indexed, so many
that SHARED of them must still be met; a gram in many windows thus needs no list. Hits are counted in half bands of
BAND diagonals; two neighbouring ones make a band, so every stretch lies in one whole band. Bands with enough hits are
verified by banded alignment.

Spark's part is a narrow map over the documents. Benchmark items are handled in blocks of BLOCK bytes at most, chosen by
hash, so what is broadcast is bounded whatever the benchmark's size; each further block is one more pass. Very long
texts are searched in overlapping stretches.

Edge cases: null and empty texts are clean; items without letters or digits contaminate nothing; equal items are found
each; repeated rows are judged each; an empty benchmark leaves all; columns beside id and text are handed through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q = 8
WINDOW = 100
STRIDE = 25
EDITS = 0.08
SHARED = 8
SHORTEST = 24
BAND = 16
BLOCK = 4 << 20
STRETCH = 1 << 20
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").lower().encode().translate(_FOLD), np.uint8)
    if len(b):
        space = b == 32
        b = b[~(space & np.concatenate([[True], space[:-1]]))]
    return b


def grams(b: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as a number."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out |= b[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def edits_of(m: int) -> int:
    """The edit budget of a window, as far as the lemma holds for it."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


class Index:
    """Windows of some items and the grams that lead to them."""

    BITS = 22

    def __init__(self, items: list[tuple]):
        self.item: list = []
        self.window: list[bytes] = []
        #: short items by their words in a row, and how many words that may be
        self.short: dict[bytes, list] = {}
        for item, text in items:
            b = folded(text)
            if len(b) and b[-1] == 32:
                b = b[:-1]
            if len(b) < SHORTEST:
                if len(b):
                    self.short.setdefault(b.tobytes(), []).append(item)
                continue
            places = sorted({*range(0, len(b) - WINDOW, STRIDE), max(0, len(b) - WINDOW)})
            for p in places:
                self.item.append(item)
                self.window.append(b[p : p + WINDOW].tobytes())
        self.short_sizes = sorted({x.count(b" ") + 1 for x in self.short})
        codes = [grams(np.frombuffer(w, np.uint8)) for w in self.window]
        often = Counter(c for x in codes for c in x.tolist())
        code, window, place, self.needed = [], [], [], np.ones(len(codes), np.int64)
        for k, x in enumerate(codes):
            bound = len(x) - Q * edits_of(len(self.window[k]))
            self.needed[k] = max(1, min(SHARED, bound))
            order = np.argsort([often[c] for c in x.tolist()], kind="stable")[: len(x) - bound + int(self.needed[k])]
            code.append(x[order])
            window.append(np.full(len(order), k, np.int32))
            place.append(order.astype(np.uint8))
        code = np.concatenate(code) if code else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.codes, self.begins, self.counts = np.unique(code[order], return_index=True, return_counts=True)
        self.of_window = np.concatenate(window)[order] if window else np.empty(0, np.int32)
        self.of_place = np.concatenate(place)[order] if place else np.empty(0, np.uint8)
        self.marks = np.zeros(1 << self.BITS, bool)
        self.marks[self._mark(self.codes)] = True

    def _mark(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def find(self, text: str | None) -> list[tuple]:
        """(item, fewest edits, first place in the folded text) of each item that contaminates a text."""
        b = folded(text)
        best: dict = {item: (0, at) for found, at in self._short(b) for item in self.short[found]}
        for begin in range(0, max(1, len(b)), STRETCH):
            for item, edits, at in self._stretch(b[begin : begin + STRETCH + 2 * WINDOW]):
                if item not in best or edits < best[item][0]:
                    best[item] = (edits, begin + at)
        return [(item, *found) for item, found in best.items()]

    def _short(self, b: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """Short items, and the first place where each stands as whole words."""
        if not self.short:
            return
        folded_text = b.tobytes()
        words, seen = folded_text.split(), set()
        for n in self.short_sizes:
            runs = words if n == 1 else map(b" ".join, zip(*[words[k:] for k in range(n)]))
            for x in self.short.keys() & set(runs):
                if x not in seen:
                    seen.add(x)
                    yield x, (b" " + folded_text + b" ").index(b" " + x + b" ")

    def _stretch(self, b: np.ndarray) -> Iterator[tuple]:
        if not len(self.codes):
            return
        g = grams(b)
        at = np.flatnonzero(self.marks[self._mark(g)])
        if len(at) < int(self.needed.min()):
            return
        k = np.minimum(np.searchsorted(self.codes, g[at]), len(self.codes) - 1)
        true = self.codes[k] == g[at]
        at, k = at[true], k[true]
        # hits in runs, so that memory stays bounded
        bands: Counter = Counter()
        step = max(1, 2_000_000 // int(self.counts.max()))
        for begin in range(0, len(at), step):
            a, j = at[begin : begin + step], k[begin : begin + step]
            n = self.counts[j]
            hit = np.repeat(self.begins[j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            diagonal = np.repeat(a, n) - self.of_place[hit] + WINDOW
            key, count = np.unique((self.of_window[hit].astype(np.int64) << 32) | (diagonal // BAND), return_counts=True)
            if len(at) <= step:
                yield from self._verified(b, key, count)
                return
            bands.update(dict(zip(key.tolist(), count.tolist())))
        key = np.array(sorted(bands), np.int64)
        yield from self._verified(b, key, np.array([bands[x] for x in key.tolist()]))

    def _verified(self, b: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
        after = np.zeros(len(key), np.int64)
        if len(key) > 1:
            after[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        need = self.needed[key >> 32]
        before_alone = np.concatenate([[True], key[1:] != key[:-1] + 1]) if len(key) else np.empty(0, bool)
        # a band is a half band and the one after it; the first half may be empty
        for k in np.flatnonzero((count + after >= need) | before_alone & (count >= need)):
            w = int(key[k] >> 32)
            window = self.window[w]
            low = int((key[k] & 0xFFFFFFFF) * BAND) - WINDOW
            e = edits_of(len(window))
            begin = max(0, low - e)
            region = b[begin : max(0, low + 2 * BAND + len(window) + e)]
            found = aligned(np.frombuffer(window, np.uint8), region, e)
            if found is not None:
                yield self.item[w], found[0], begin + found[1]


def aligned(window: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int] | None:
    """Fewest edits, if at most `most`, between the window and any stretch of the region, and about where it begins.

    The region is a band of diagonals around the window already: rows of the alignment are computed over it at once.
    """
    exact = region.tobytes().find(window.tobytes())
    if exact >= 0:
        return 0, exact
    if not most or len(region) < len(window) - most:
        return None
    n = len(region)
    columns = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, c in enumerate(window, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        np.minimum(row[:-1] + (region != c), row[1:] + 1, out=new[1:])
        row = columns + np.minimum.accumulate(new - columns)
        if row.min() > most:
            return None
    end = int(row.argmin())
    return int(row[end]), max(0, end - len(window))


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[Index]:
    """Indexes over hash blocks of the benchmark, each of about BLOCK bytes at most."""
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / BLOCK)) if total > BLOCK else 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        yield Index(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """id, item, edits, place: one row per document row and item that it holds."""
    kind, item_kind = docs.schema[id_column].dataType, benchmark.schema[item_column].dataType
    id_type, item_type = to_arrow_type(kind), to_arrow_type(item_kind)
    rows, out = docs.select(id_column, text_column), None
    for index in _blocks(benchmark, item_column, item_text_column):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(own, *x) for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in sent.value.find(text)]
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, item_type, pa.int32(), pa.int64()))], names=[id_column, item_column, "edits", "place"])

        found = rows.mapInArrow(run, f"{id_column} {kind.simpleString()}, {item_column} {item_kind.simpleString()}, edits int, place long")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    place = docs.columns.index(text_column)
    for index in _blocks(benchmark, item_column, item_text_column):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.find(text) for text in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
