"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised (lower case; each run of bytes that are no letter, digit or
non-ASCII is one blank). A leak is a window of WINDOW bytes of an item (the whole item if shorter)
that some part of the text matches within `budget` edits. If it does, the two share at least
w - q + 1 - q * budget q-grams, all on diagonals that differ by at most the budget. So shared
q-grams are counted in overlapping bands of diagonals, bands below the bound are dropped, and the
rest is verified: unbroken runs on one diagonal are matches without edits, others are aligned in
the band for every window of the item.

The benchmark is the stated query set: it is collected in blocks of at most BLOCK bytes, and each
block is broadcast and held against all rows. Nothing is shuffled.

Edge cases: null and empty texts have no leak; items whose normalised form is shorter than LEAST
never match, since so few letters stand in clean texts too; a null item_id is kept. Repeated rows are answered one by one; extra columns are
ignored by `leaks` and kept by `clean`. Empty tables give no leak.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, prepare

Q, WINDOW, LEAST = 10, 64, 24
#: Edits for each byte of a window.
RATE = 0.05
#: Bytes of benchmark text in a block; bytes of documents taken at once; pairs of equal q-grams held at once, but for those of one text and item.
BLOCK, CHUNK, PAIRS = 8 << 20, 1 << 20, 1 << 22

_TABLE = np.full(256, 32, np.uint8)
for _r in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _TABLE[list(_r)] = list(_r)


def normalised(text: str | None) -> np.ndarray:
    """Bytes of the normalised text, with a blank at its end."""
    data = _TABLE[np.frombuffer(((text or "") + " ").lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = data == 32
    return data[~blank | np.concatenate([[False], ~blank[:-1]])]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hashes of the Q-grams of data (uint32), by doubling."""
    with np.errstate(over="ignore"):
        p = np.uint32(0x01000193)
        one = data.astype(np.uint32) + np.uint32(7)
        two = one[:-1] * p + one[1:]
        p2 = p * p
        four = two[:-2] * p2 + two[2:]
        eight = four[:-4] * (p2 * p2) + four[4:]
        ten = eight[:-2] * p2 + two[8:]
        return (ten ^ (ten >> np.uint32(15))) * np.uint32(0x85EBCA6B)


class Block:
    """The q-grams of some items, and the search of texts for them."""

    def __init__(self, items: list[tuple]):
        self.ids = [k for k, _ in items]
        bytes_of = [normalised(t) for _, t in items]
        self.size = np.array([len(b) if len(b) > LEAST else 0 for b in bytes_of] or [0])
        gap = np.zeros(1, np.uint8)
        self.starts = np.cumsum([0, *[len(b) + 1 for b in bytes_of]])
        self.data = np.concatenate([x for b in bytes_of for x in (b, gap)] or [gap])
        self.window = np.minimum(WINDOW, self.size)
        self.budget = np.floor(RATE * self.window).astype(np.int64)
        self.bound = np.maximum(1, self.window - Q + 1 - Q * self.budget)
        h = gram_hashes(self.data) if len(self.data) > Q else np.zeros(0, np.uint32)
        at = np.arange(len(h))
        item = np.searchsorted(self.starts, at, side="right") - 1
        inside = (at + Q <= self.starts[item] + self.size[np.minimum(item, len(self.size) - 1)]) if len(h) else np.zeros(0, bool)
        at = at[inside]
        order = np.argsort(h[at], kind="stable")
        self.at = at[order]
        self.grams, self.first, self.many = np.unique(h[at][order], return_index=True, return_counts=True)
        # Places in order of gram, then position: those of a gram within some items are a slice.
        self.place = (np.repeat(np.arange(len(self.grams)), self.many) << 40) | self.at
        bits = max(16, min(24, (len(self.grams) * 32).bit_length()))
        self.shift = np.uint32(32 - bits)
        self.maybe = np.zeros(1 << bits, np.bool_)
        self.maybe[self.grams >> self.shift] = True
        self.band = 2 * (int(self.budget.max(initial=0)) + 1)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in data whose q-gram some item has, and the numbers of these q-grams."""
        found_at, found_gram = [], []
        for i in range(0, len(data) - Q + 1, CHUNK):
            h = gram_hashes(data[i : i + CHUNK + Q - 1])
            at = np.flatnonzero(self.maybe[h >> self.shift])
            gram = np.searchsorted(self.grams, h[at])
            sure = (gram < len(self.grams)) & (self.grams[np.minimum(gram, len(self.grams) - 1)] == h[at])
            found_at.append(at[sure] + i)
            found_gram.append(gram[sure])
        if not found_at:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate(found_at), np.concatenate(found_gram)

    def _pairs(self, begin: np.ndarray, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of equal q-grams in the texts and in the items: PAIRS at once, all of a text and an item together."""
        doc = np.searchsorted(begin, at, side="right") - 1
        upto = np.cumsum(self.many[gram])
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        i = 0
        while i + 1 < len(edges):
            j = i + 1
            before = upto[edges[i] - 1] if edges[i] else 0
            while j + 1 < len(edges) and upto[edges[j + 1] - 1] - before <= PAIRS:
                j += 1
            a, g = at[edges[i] : edges[j]], gram[edges[i] : edges[j]]
            parts = [(0, len(self.ids))]
            while parts:
                lo, hi = parts.pop()
                first = np.searchsorted(self.place, (g << 40) | self.starts[lo])
                n = np.searchsorted(self.place, (g << 40) | self.starts[hi]) - first
                total = int(n.sum())
                if total > PAIRS and hi - lo > 1:
                    parts += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                elif total:
                    k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(a, n), self.at[np.repeat(first, n) + k]
            i = j

    def search(self, texts: list[str | None]) -> list[dict[int, list[tuple[int, int, int]]]]:
        """For each text: item number -> (start, end in the normalised text, edits) of its leaks."""
        out: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in texts]
        if not len(self.grams):
            return out
        gap = np.zeros(1, np.uint8)
        parts = [normalised(t) for t in texts]
        begin = np.cumsum([0, *[len(p) + 1 for p in parts]])
        data = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
        for at, where in self._pairs(begin, *self.hits(data)):
            self._judge(data, begin, at, where, out)
        return out

    def _judge(self, data: np.ndarray, begin: np.ndarray, at: np.ndarray, where: np.ndarray, out: list[dict]) -> None:
        """Adds the leaks among pairs of positions to out."""
        doc = np.searchsorted(begin, at, side="right") - 1
        item = np.searchsorted(self.starts, where, side="right") - 1
        diagonal = at - where
        bands = []
        for offset in (0, self.band // 2):
            band = (diagonal + offset) // self.band
            order = np.lexsort((at, band, item, doc))
            d, i, b, a = doc[order], item[order], band[order], at[order]
            edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
            new = np.concatenate([[1], (a[1:] != a[:-1]).astype(np.int64)])
            new[edge] = 1
            count = np.add.reduceat(new, edge)
            enough = count >= self.bound[i[edge]]
            ends = np.append(edge[1:], len(order))
            bands += [order[s:e] for s, e in zip(edge[enough].tolist(), ends[enough].tolist(), strict=True)]
        for rows in bands:
            d, i = int(doc[rows[0]]), int(item[rows[0]])
            match = self._run(at[rows], diagonal[rows], i) or self._align(data, begin[d], begin[d + 1] - 1, i, diagonal[rows], where[rows])
            if match:
                start, end, edits = match
                found = out[d].setdefault(i, [])
                span = (start - int(begin[d]), end - int(begin[d]), edits)
                if not any(s < span[1] and span[0] < e for s, e, _ in found):
                    found.append(span)

    def _run(self, at: np.ndarray, diagonal: np.ndarray, item: int) -> tuple[int, int, int] | None:
        """The longest unbroken run of q-grams on a diagonal, if it is as long as a window."""
        order = np.lexsort((at, diagonal))
        a, d = at[order], diagonal[order]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)]))
        length = np.diff(np.append(cut, len(a)))
        best = int(length.argmax())
        if length[best] + Q - 1 < self.window[item]:
            return None
        start = int(a[cut[best]])
        return start, start + int(length[best]) + Q - 1, 0

    def _align(self, data: np.ndarray, begin: int, end: int, item: int, diagonal: np.ndarray, where: np.ndarray) -> tuple[int, int, int] | None:
        """Banded alignment of every window of the item that can hold the bound of hits."""
        w, e = int(self.window[item]), int(self.budget[item])
        first, last = int(self.starts[item]), int(self.starts[item]) + int(self.size[item])
        lo = int(diagonal.min()) - e
        band = int(diagonal.max()) + e - lo + 1
        s = np.arange(first, last - w + 1)
        ordered = np.sort(where)
        inside = np.searchsorted(ordered, s + w - Q, side="right") - np.searchsorted(ordered, s)
        s = s[inside >= self.bound[item]]
        if not len(s):
            return None
        k = np.arange(band)
        cost = np.zeros((len(s), band), np.int32)
        for row in range(w):
            pos = s[:, None] + row + lo + k
            letter = np.where((pos >= begin) & (pos < end), data[np.clip(pos, 0, len(data) - 1)], 1)
            step = cost + (letter != self.data[s + row][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - k, axis=1) + k
        flat = int(cost.argmin())
        row, col = divmod(flat, band)
        if cost[row, col] > e:
            return None
        stop = min(end, max(begin, int(s[row]) + w + lo + col))
        return max(begin, stop - w), stop, int(cost[row, col])


def _block(items: list[tuple]) -> Block:
    """One for each worker process and block."""
    return held("grams" + hashlib.sha256(repr(items).encode()).hexdigest(), lambda: Block(items))


def item_blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about `limit` bytes at most, each collected by itself."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // (limit // 2 if total > limit else limit)))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_places, edits (least), spans ("start:end", in the normalised text): one row for each leak."""
    prepare(docs.sparkSession)
    item_type = benchmark.schema["item_id"].dataType
    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id")).schema.add("item_id", item_type).add("n_places", "long").add("edits", "long").add("spans", "string")
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = _block(shared.value)
            for batch in batches:
                rows = []
                for part in _parts(batch):
                    for k, found in zip(part.column(0).to_pylist(), own.search(part.column(1).to_pylist()), strict=True):
                        rows += [(k, own.ids[i], len(v), min(x[2] for x in v), ",".join(f"{s}:{e}" for s, e, _ in sorted(v))) for i, v in sorted(found.items())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_pandas(_frame(cols), schema=_arrow(schema), preserve_index=False)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _frame(cols):
    import pandas as pd

    names = ["doc_id", "item_id", "n_places", "edits", "spans"]
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, cols, strict=True)})


def _parts(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text."""
    sizes = np.array([len(t.as_py() or "") for t in batch.column(column)])
    groups = (np.cumsum(sizes) - sizes) // CHUNK
    edges = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
        yield batch.slice(a, b - a)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns."""
    prepare(docs.sparkSession)
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        column = docs.columns.index("text")

        def work(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            own = _block(shared.value)
            for batch in batches:
                for part in _parts(batch, column):
                    found = own.search(part.column(column).to_pylist())
                    yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of query op6: one for each document and benchmark item that it leaks."""
    return leaks(docs, benchmark)
