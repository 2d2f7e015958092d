"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are words of 64 bits; bit j of a word is 1 if it is set in over half of the shingle
hashes. Distinct fingerprints of one word form a binary trie. Node pairs are traversed together
from the root, differing bits are summed, and a pair is pruned once it is over the error budget.
The first levels are dealt out by Spark (a fingerprint goes to each pair of prefixes that the
budget allows), the rest is traversed in one task per pair of prefixes, breadth first over sorted
arrays with a bounded frontier. Each task returns a spanning forest of its links, never all pairs;
components joins these forests.

`components_of` links fingerprints of one word within `budget` bits, exactly. `near_duplicates` is
for similarity: texts are sets of shingles, in which a shingle counts once. The trie join links sets
whose fingerprints are within BUDGET bits; a budget that held all pairs at SIMILARITY (a tenth to a
quarter of the bits) would prune nothing, so for those beyond BUDGET, sets that share one of BANDS
keys made of ROWS minimum hashes each are candidates too. Two are linked if and only if the Jaccard
similarity of the sets themselves is SIMILARITY or more. A pair at that similarity is no candidate
with chance 7e-6 at most, whatever the number of rows; equal sets are one from the start.

Edge cases: null text is empty; a text of fewer words than a shingle is one shingle; a text without
words has fingerprint zero and is linked like any other. Repeated rows are one group. A null doc_id
never becomes a component's id unless the group has no other. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, sieved, stored
from .components import components

SEED = 42
#: Words of a shingle in near_duplicates, and the Jaccard similarity that links.
SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a shingle set, and the minima that make one: a pair at SIMILARITY shares none with chance (1 - 0.8 ** 5) ** 30 = 7e-6.
BANDS, ROWS = 30, 5
#: Standard deviations by which the share of equal minima may fall short of the similarity before two sets are told apart by it (chance 3e-7).
SHORT = 5
#: Shingles in a block of a key's members that are compared at once.
PER_BLOCK = 1 << 19
#: Differing bits that link two fingerprints in components_of.
BUDGET = 2
#: Fingerprints that a task should hold, and node pairs of its frontier.
PER_TASK, FRONTIER = 1 << 12, 1 << 17

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TERMS = _random.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)

_SPACE = re.compile(rb"[^\x20\x09-\x0d]+")
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits set in each 64-bit integer."""
    return np.bitwise_count(x).astype(np.int16)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = _SPACE.findall((text or "").encode("utf-8", "surrogatepass").translate(_UPPER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Independent 64-bit hashes from h; word 0 is h itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        h = h + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """words unsigned 64-bit integers; hashes are summed in blocks, so a very long text stays small."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 13):
            bits = np.unpackbits(_mixed(hashes[i : i + (1 << 13)], w).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
                ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
        out[w] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, bits: array of `words` longs, for every row; `repeats`: a shingle counts each time it occurs."""
    once = (lambda h: h) if repeats else np.unique
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(once(shingle_hashes(t.as_py(), shingle)), words).view(np.int64) for t in batch.column(1)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * words, pa.int32()), pa.array(flat))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, bits array<long>")


class Forest:
    """Union-find over 0..n-1 with whole arrays of links at a time; the root is the least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _children(lo: np.ndarray, hi: np.ndarray, keys: np.ndarray, shift: int) -> np.ndarray:
    """Where the upper half of each node begins: the first key of the range with the bit set."""
    bit = (keys >> np.uint64(shift)) & np.uint64(1)
    ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
    return hi - (ones[hi] - ones[lo])


def trie_links(keys: np.ndarray, split: int, budget: int, start: int, free: int, accept, forest: Forest) -> None:
    """Links between keys[:split] and keys[split:] (or within all keys, if split is 0).

    Each side is sorted. Levels go from bit `start` down; `budget` holds down to bit `free`, below
    which nothing is pruned. accept(i, j) tells which pairs of leaves are links.
    """
    n = len(keys)
    first = (0, split, split, n) if split else (0, n, 0, n)
    stack = [(start, *(np.array([x]) for x in first), np.zeros(1, np.int16))]
    while stack:
        shift, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(shift, alo[s], ahi[s], blo[s], bhi[s], err[s]) for s in (slice(half), slice(half, None))]
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if shift < free:
            _leaves(alo, ahi, blo, bhi, accept, forest)
            continue
        if leaf.any():
            _check(alo[leaf], blo[leaf], accept, forest)
            rest = ~leaf
            alo, ahi, blo, bhi, err = alo[rest], ahi[rest], blo[rest], bhi[rest], err[rest]
        if not len(alo):
            continue
        am, bm = _children(alo, ahi, keys, shift), _children(blo, bhi, keys, shift)
        parts = []
        for a0, a1, b0, b1, more in ((alo, am, blo, bm, 0), (am, ahi, bm, bhi, 0), (alo, am, bm, bhi, 1), (am, ahi, blo, bm, 1)):
            keep = (a1 > a0) & (b1 > b0) & (err + more <= budget) & (a0 <= b0)
            parts.append((a0[keep], a1[keep], b0[keep], b1[keep], err[keep] + np.int16(more)))
        stack.append((shift - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _check(i: np.ndarray, j: np.ndarray, accept, forest: Forest) -> None:
    apart = (i != j) & (forest.root[i] != forest.root[j])
    i, j = i[apart], j[apart]
    yes = accept(i, j)
    forest.link(i[yes], j[yes])


def _leaves(alo, ahi, blo, bhi, accept, forest: Forest) -> None:
    """All pairs below node pairs: small ones in blocks, large ones by stars first, then what is still apart."""
    size = (ahi - alo) * (bhi - blo)
    for big in np.flatnonzero(size > FRONTIER).tolist():
        members = np.unique(np.concatenate([np.arange(alo[big], ahi[big]), np.arange(blo[big], bhi[big])]))
        for hub in members[:: max(1, len(members) // 16)]:
            _check(np.full(len(members), hub), members, accept, forest)
        for k, i in enumerate(members.tolist()):
            rest = members[k + 1 :]
            rest = rest[forest.root[rest] != forest.root[i]]
            if len(rest):
                _check(np.full(len(rest), i), rest, accept, forest)
    small = np.flatnonzero(size <= FRONTIER)
    ends = np.cumsum(size[small])
    for block in np.split(small, np.searchsorted(ends, np.arange(FRONTIER, ends[-1], FRONTIER))) if len(small) else []:
        if not len(block):
            continue
        n = size[block]
        node = np.repeat(np.arange(len(block)), n)
        k = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
        wide = (bhi - blo)[block][node]
        i, j = alo[block][node] + k // wide, blo[block][node] + k % wide
        upper = i < j
        _check(i[upper], j[upper], accept, forest)


def _masks(bits: int, budget: int) -> list[int]:
    return sorted(m for m in range(1 << bits) if m.bit_count() <= budget)


def _prefix_bits(count: int, per_task: int) -> int:
    return max(0, min(12, (max(count, 1) // per_task).bit_length()))


def _forests(rows: DataFrame, bits: int, budget: int, free_from: int, wide: int | None) -> DataFrame:
    """Rows (trie int, id long, key long, more array<long>) -> links (a, b) of ids, by the trie join of each trie.

    With `wide`, the prefixes that are dealt out may differ in one bit only, so that what is moved
    grows with the prefix, not with its square; other tries find what this one then misses.
    """
    masks = _masks(bits, budget if wide is None else min(1, budget))
    prefix = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    sent = rows.select("*", prefix.alias("p"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    sent = sent.withColumn("base", F.least(F.col("p"), F.col("p").bitwiseXOR(F.col("mask").cast("long")))).withColumn("side", (F.col("p") != F.col("base")).cast("int"))

    def work(found: pa.Table) -> pa.Table:
        side = found.column("side").to_numpy()
        key = found.column("key").to_numpy().view(np.uint64)
        order = np.lexsort((key, side))
        side, key = side[order], key[order]
        ids = found.column("id").to_numpy()[order]
        mask = found.column("mask")[0].as_py()
        split = int(np.searchsorted(side, 1))
        a = b = np.zeros(0, np.int64)
        if not mask or 0 < split < len(side):
            forest = Forest(len(key))
            if wide is None:
                accept = lambda i, j: popcount(key[i] ^ key[j]) <= budget
            else:
                more = found.column("more").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)[order]
                bits_of = np.column_stack([key, more])
                accept = lambda i, j: popcount(bits_of[i] ^ bits_of[j]).sum(1) <= wide
            trie_links(key, split if mask else 0, budget - mask.bit_count(), 63 - bits, 64 - free_from, accept, forest)
            linked = np.flatnonzero(forest.root != np.arange(len(key)))
            a, b = ids[linked], ids[forest.root[linked]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.select("trie", "base", "mask", "side", "id", "key", "more").groupBy("trie", "base", "mask").applyInArrow(work, "a long, b long")


def _named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """id, component_id of distinct fingerprints (id, least doc_id) and their links.

    Only linked ids are joined by root; each side of a join is a stored table, so that Spark can
    split the partition of a large group.
    """
    roots = components(links)
    linked = stored(roots.join(distinct, roots["node"] == distinct["id"]).select("id", "root", "least"), "simhash-linked")
    ids = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    found = stored(linked.select("id", "root").join(ids, "root").select("id", "component_id"), "simhash-found")
    named = stored(distinct.join(found, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id")), "simhash-named")
    discard(linked, ids, found)
    return named


def components_of(docs: DataFrame, shingle: int = 3, budget: int = BUDGET, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, bits (long), component_id: fingerprints within `budget` bits are linked, transitively."""
    marks = stored(fingerprints(docs, shingle).select("doc_id", F.col("bits")[0].alias("key")), "simhash")
    distinct = stored(marks.groupBy("key").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    rows = distinct.select(F.lit(0).alias("trie"), F.col("key").alias("id"), "key", F.expr("cast(array() as array<bigint>)").alias("more"))
    links = _forests(rows, _prefix_bits(distinct.count(), per_task), budget, 64, None)
    named = _named(distinct.withColumnRenamed("key", "id"), links).withColumnRenamed("id", "key")
    return marks.join(named, "key").select("doc_id", F.col("key").alias("bits"), "component_id")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each of BANDS * ROWS functions."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(high), 1 << 9):
        np.minimum(least, (high[i : i + (1 << 9), None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """Minima of n sets -> n x BANDS keys; two sets share a key with chance similarity ** ROWS."""
    parts = least.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = _mixed(np.arange(BANDS, dtype=np.uint64), 1) + np.zeros((len(parts), 1), np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys ^ parts[:, :, i], i + 2)
    return keys


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id, text -> row, doc_id, id of the shingle set, its size, fingerprint, bands, and the low bytes of its minima."""
    prepare(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in batch.column(2)]
            ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            sizes = np.array([len(h) for h in sets], np.int32)
            keys = [minima(h) for h in sets if len(h)]
            ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, 1))]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(np.stack(keys)).view(np.int64).ravel() if keys else np.zeros(0, np.int64)))
            low = iter(keys)
            marks = [next(low).astype(np.uint8).tobytes() if len(h) else b"" for h in sets]
            bits = np.array([fingerprint(h)[0] for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array(sizes), pa.array(bits), bands, pa.array(marks, pa.binary())], ["row", "doc_id", "id", "size", "bits", "bands", "mark"])

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "row long, doc_id long, id long, size int, bits long, bands array<long>, mark binary")


def _fewest(least: float) -> float:
    """Equal minima that two sets of similarity `least` have at least, but for a chance of 3e-7."""
    count = BANDS * ROWS
    return count * least - SHORT * (count * least * (1 - least)) ** 0.5


def _trie_pairs(sets: DataFrame, budget: int = BUDGET, per_task: int = PER_TASK) -> DataFrame:
    """Pairs (a, b) of set ids, a < b, that span each group of fingerprints within `budget` bits: a forest, never all pairs."""
    own = stored(sets.where("size > 0").select("id", F.col("bits").alias("key")), "simhash-bits")
    distinct = stored(own.groupBy("key").agg(F.min("id").alias("head")), "simhash-heads")
    rows = distinct.select(F.lit(0).alias("trie"), F.col("head").alias("id"), "key", F.expr("cast(array() as array<bigint>)").alias("more"))
    near = _forests(rows, _prefix_bits(distinct.count(), per_task), budget, 64, None)
    equal = own.join(distinct, "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    pairs = near.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = stored(pairs.distinct(), "simhash-near-bits")
    discard(own, distinct)
    return found


def _hashes(ids: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """id, hashes: the shingle set of each of ids, as sorted 64-bit integers."""
    wanted = stored(sets.join(ids, "id").select("id", F.col("least.row").alias("row")), "simhash-wanted")
    # One row of a key goes on, before the join, and texts that no key can be waiting for aren't shuffled.
    perhaps = sieved(rows.select("row", "text"), wanted, "row", "hit").where("hit")
    texts = perhaps.groupBy("row").agg(F.min("text").alias("text")).join(wanted, "row").select("id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(1)], pa.binary())], ["id", "hashes"])

    found = stored(texts.mapInArrow(hashed, "id long, hashes binary"), "simhash-hashes")
    discard(wanted)
    return found


def _verified(pairs: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) of set ids whose shingle sets have a Jaccard similarity of `least` or more."""
    left = stored(pairs.join(hashes.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a"), "simhash-left")
    both = left.join(hashes.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b").select("a", "b", "left", "right")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                joined = np.frombuffer(x + y, np.uint64).copy()
                joined.sort()
                common = int((joined[1:] == joined[:-1]).sum())
                yes.append(common >= least * (len(joined) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    found = stored(both.mapInArrow(work, "a long, b long"), "simhash-verified")
    discard(left)
    return found


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, left, right) without those whose marks agree too seldom for similarity `least`."""
    fewest = _fewest(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= fewest))

    return pairs.select("a", "b", "left", "right").mapInArrow(work, "a long, b long")


def _blocks(found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the few and of all members of each block (hub, i, j)."""
    side, few = found.column("side").to_numpy(), found.column("few").to_numpy()
    hub, i, j = (found.column(c).to_numpy() for c in ("hub", "i", "j"))
    order = np.lexsort((side, j, i, hub))
    same = (hub[order][1:] == hub[order][:-1]) & (i[order][1:] == i[order][:-1]) & (j[order][1:] == j[order][:-1])
    for block in np.split(order, np.flatnonzero(~same) + 1):
        dealt = side[block].min() == 0
        yield block[side[block] == 0] if dealt else block[few[block]], block[side[block] == 1]


def _marks(found: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(found.column("mark").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _bucket_near(found: pa.Table, least: float) -> pa.Table:
    """The rows of a bucket whose marks agree with those of a row of another component often enough."""
    fewest, marks = _fewest(least), _marks(found)
    size, root = found.column("size").to_numpy(), found.column("root").to_numpy()
    near = np.zeros(len(size), np.bool_)
    for searchers, members in _blocks(found):
        for f in searchers.tolist():
            some = members[(root[members] != root[f]) & (np.minimum(size[members], size[f]) >= least * np.maximum(size[members], size[f]) - 1e-9)]
            some = some[(marks[some] == marks[f]).sum(1) >= fewest]
            near[some] = True
            near[f] |= len(some) > 0
    return found.filter(pa.array(near))


def _bucket_links(found: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between the blocks of a bucket: at most one for each two components that they join.

    Rows are (hub, i, j, side, few, id, root, size, mark, hashes). In each block (hub, i, j) the few are
    held against all members that are in another component.
    """
    fewest = _fewest(least)
    size = found.column("size").to_numpy()
    ids, local = np.unique(found.column("id").to_numpy(), return_inverse=True)
    _, root = np.unique(found.column("root").to_numpy(), return_inverse=True)
    forest = Forest(len(ids))
    order = np.argsort(root, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
    forest.link(local[order], np.repeat(local[order][heads], np.diff(np.append(heads, len(order)))))
    marks = _marks(found)
    sets = found.column("hashes").combine_chunks()
    hashes = lambda n: np.frombuffer(sets[n].as_buffer(), np.uint64)
    a, b = [], []
    for searchers, members in _blocks(found):
        for f in searchers.tolist():
            near = members[forest.root[local[members]] != forest.root[local[f]]]
            near = near[np.minimum(size[near], size[f]) >= least * np.maximum(size[near], size[f]) - 1e-9]
            near = near[(marks[near] == marks[f]).sum(1) >= fewest]
            own = hashes(f) if len(near) else None
            for part in np.array_split(near, 1 + int(size[near].sum()) // FRONTIER):
                if not len(part):
                    continue
                flat = np.concatenate([hashes(n) for n in part.tolist()])
                at = np.searchsorted(own, flat)
                hit = own[np.minimum(at, len(own) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[part]) - size[part])
                for n in part[common >= least * (size[part].astype(np.int64) + int(size[f]) - common) - 1e-9].tolist():
                    if forest.root[local[n]] != forest.root[local[f]]:
                        forest.link(local[[f]], local[[n]])
                        a.append(ids[local[f]])
                        b.append(ids[local[n]])
    return np.array(a, np.int64), np.array(b, np.int64)


def near_groups(rows: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, block: int = PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, text) -> (row, doc_id, id) and (id, component_id: none, doc_id and row of a group's first row).

    The trie join of the sets' fingerprints gives the first pairs to verify. For similar sets beyond
    its budget every member of a shared key is joined to the key's hub, its member whose keys are the fullest, and
    these pairs are verified. The keys of one hub are then one crowd, in which a member counts once. Its
    members that are in another component than the hub, the few, are held against all of the crowd in
    blocks of about `block` shingles, first by their marks; one task takes the blocks of some crowds and
    returns a forest of verified links, so no pair of members is ever a row of a table.
    """
    marks = stored(_shingle_sets(rows, shingle), "simhash-sets")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = stored(marks.groupBy("id").agg(F.min(first).alias("least"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("bands").alias("bands"), F.min("mark").alias("mark")), "simhash-distinct")
    slim = stored(marks.select("row", "doc_id", "id"), "simhash-rows")
    discard(marks)
    near_bits = _trie_pairs(sets)
    posts = sets.select("id", "size", F.explode("bands").alias("key"))
    shared = stored(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    bare = stored(posts.join(shared, "key").select("key", "id", "size", "n"), "simhash-posts")
    weights = stored(bare.groupBy("id").agg(F.sum("n").alias("weight")), "simhash-weights")
    linked = near_bits.select(F.explode(F.array("a", "b")).alias("id"))
    hashes = _hashes(weights.select("id").unionByName(linked).distinct(), sets, rows, shingle)
    posts = stored(bare.join(weights, "id").select("key", "id", "size", "weight"), "simhash-weighed")
    hub = F.max_by(F.struct(F.col("id").alias("hub"), F.col("size").alias("hub_size")), F.struct("weight", "id")).alias("hub")
    keys = stored(posts.groupBy("key").agg(hub).select("key", "hub.*"), "simhash-hubs")
    crowds = stored(posts.join(keys, "key").select("hub", "hub_size", "id", "size").distinct(), "simhash-crowds")
    discard(shared, bare, weights, posts, keys)
    sizes = F.least("size", "hub_size") >= F.lit(least - 1e-9) * F.greatest("size", "hub_size")
    starred = crowds.where("id <> hub").where(sizes).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = stored(starred.unionByName(near_bits).distinct(), "simhash-pairs")
    # Marks are a tenth of the sets: what they tell apart is not moved again.
    mark = lambda k, of: sets.select(F.col("id").alias(k), F.col("mark").alias(of))
    marked = stored(pairs.join(mark("a", "left"), "a"), "simhash-marked")
    likely = stored(_alike(marked.join(mark("b", "right"), "b"), least), "simhash-likely")
    links = _verified(likely, hashes, least)
    roots = stored(components(links), "simhash-roots")
    rooted = stored(crowds.join(roots, crowds["id"] == roots["node"], "left").select("hub", "id", "size", F.coalesce("root", "id").alias("root")), "simhash-rooted")
    hubs = stored(crowds.select("hub").distinct().join(roots, F.col("hub") == roots["node"], "left").select("hub", F.coalesce("root", "hub").alias("hub_root")), "simhash-hub-roots")
    members = stored(rooted.join(hubs, "hub").select("hub", "id", "size", "root", (F.col("root") != F.col("hub_root")).alias("few")), "simhash-members")
    parts = lambda total: F.ceil(F.sum(total) / F.lit(block)).cast("int")
    apart = stored(members.groupBy("hub").agg(parts(F.when(F.col("few"), F.col("size"))).alias("si"), parts(F.col("size")).alias("sj")).where("si > 0"), "simhash-apart")
    cut = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    split = members.join(apart, "hub")
    searchers = split.where("few and si * sj > 1").withColumn("i", cut("si", 1)).withColumn("j", every("sj")).withColumn("side", F.lit(0))
    others = split.withColumn("j", cut("sj", 2)).withColumn("i", every("si")).withColumn("side", F.lit(1))
    dealt = stored(searchers.unionByName(others).select("hub", "i", "j", "side", "few", "id", "root", "size"), "simhash-dealt")
    discard(near_bits, crowds, pairs, marked, likely, roots, rooted, hubs, members, apart)
    total = dealt.agg(F.sum("size")).first()[0]
    if total:
        buckets = -(-total // (4 * block))
        narrow = dealt.join(sets.select("id", "mark"), "id").withColumn("bucket", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(buckets)))
        near = stored(narrow.groupBy("bucket").applyInArrow(lambda found: _bucket_near(found, least), narrow.schema), "simhash-near")
        full = near.join(hashes, "id")

        def work(found: pa.Table) -> pa.Table:
            a, b = _bucket_links(found, least)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        more = stored(full.groupBy("bucket").applyInArrow(work, "a long, b long"), "simhash-more")
        discard(near)
        links = links.unionByName(more)
    discard(hashes, dealt)
    named = _named(sets.select("id", "least"), links)
    discard(sets)
    return slim, named


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, block: int = PER_BLOCK) -> DataFrame:
    """doc_id, component_id for every row: near-duplicates by similarity of shingles."""
    marks, named = near_groups(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"), shingle, least, block)
    return marks.join(named, "id").select("doc_id", F.col("component_id.doc_id").alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op10."""
    return components_of(docs).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
