"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct shingles of ``width`` words (all its words as one, if it has fewer), words
being runs without ASCII white space with A-Z lowered; documents are linked if 100 * common >= 80 * all. The
classes are the connected components of the links.

1. Every text becomes a 64-bit hash per distinct shingle, a digest of the whole set, and a signature of
   ``VALUES`` minima. Texts of equal sets are one node, so copies cost no pairs.
2. The signature is put in ``ORDERS`` seeded orders. Nodes that share the first ``DEPTH`` values of an order
   are a region, and the nodes of a region are sorted by the order, so that they stand beside those with which they
   have the longest common prefixes. The sort is by range: a region of any size lies in as many tasks as it
   fills. A task reads its rows in windows: a whole region, or ``WINDOW`` rows of it, of which the last
   ``OVERLAP`` begin the next window; so the depth to which a window's rows agree adapts to how crowded they are.
3. In a window all signatures are compared. Those with at least ``ENOUGH`` equal values are alike (a pair at 0.8
   falls below by 5 standard deviations), and a union-find leaves of the alike ones one edge less than
   there are nodes; no pairs leave the task. The components of these edges are groups: whatever is alike in
   some window is in one group.
4. The full set of each node of a group goes to the group's task, once. There the classes are searched breadth
   first: a node's set is compared with those not reached yet, so that only one row a node leaves.
5. A group beyond ``NODES`` nodes or ``SHINGLES`` shingles is first read in windows of that size along
   ``RUNS`` of the orders, sorted by range as above, and solved window by window. What is not in the group's largest
   class then meets every node of the group of a size that can be linked, in blocks of both; in a block the sets are
   filed under their rarest shingles, and only those are compared that can be linked by where they share one.
6. Components of edges: alternating large-star and small-star joins until the edges stay, each step written.

Steps 4 and 5 miss no link inside a group. A link is lost only if its texts are in two groups, that is if no
chain of alike nodes in any window of any order joins them: of two texts at 0.8 no order has them in one region
with a chance of 5 in 10**8, and in a region of more than ``WINDOW`` nodes a text must be unlike all
that stand near it in all orders.

Links, components and fingerprints stay in tables. Sets are shuffled only for nodes in groups, once each
(``RUNS`` times more, and once a block of the unsettled, in large groups).

Defined results: a null text is an empty one; empty ones have no shingles, no links, and are kept; rows of
equal id are one node with the links of all of them; a null id has a null component and is kept; an empty
table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import remove, ship, small_or_plain, table, workspace, written

VALUES, ORDERS, DEPTH, WINDOW, OVERLAP = 128, 32, 4, 128, 32
#: Values by which a region is sorted.
PLACE = 16
#: Nodes, and shingles of all its nodes, of a group that one task solves by itself.
NODES, SHINGLES = 1024, 1 << 20
#: The same of a side of a block of unsettled nodes.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20
#: Orders along which larger groups are read in windows of that size.
RUNS = 2
#: Equal values that a candidate needs: 128 * 0.8 less 5 standard deviations.
ENOUGH = 80
PERCENT = 80
#: Ids up to which the table of candidates' ids (8 bytes a row) is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 300_000
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000

_SEED = np.random.default_rng(20_24)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _SEED.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHANGE = _SEED.integers(1, 1 << 63, VALUES, dtype=np.uint64)
_ORDER = np.stack([_SEED.permutation(VALUES) for _ in range(ORDERS)])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``offsets`` cut ``data`` (bytes) into texts."""
    data = _LOWER[data]
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    # the polynomial of a word does not depend on where it stands; its length is mixed in
    words = mixed((sums[ends] - sums[starts]) * _powers(_BACK, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(width):
        runs = mixed(runs * np.uint64(31) + words[i : i + n])
    sets = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = mixed(one * np.uint64(31) + words[i : i + 1])
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size, each with the bytes of its texts and their offsets."""
    texts = pc.fill_null(batch.column(column), "")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1))
        yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def signature(hashes: np.ndarray) -> np.ndarray:
    """``VALUES`` minima, of which 16 bits are kept."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        block = (hashes[i : i + 2048, None] ^ _CHANGE) * _MULTIPLY
        block ^= block >> np.uint64(32)
        np.minimum(least, block.min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def signatures(df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``id``, ``n_shingles``, ``digest`` of the set and ``sig``; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 1):
                sets = shingle_sets(data, offsets, width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs = [signature(s).tobytes() if len(s) else None for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "digest", "sig"])

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, sig binary")


def _stacked(column: pa.Array) -> np.ndarray:
    """The signatures of a column as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), VALUES)


def _keys(sigs: np.ndarray, order: int, depth: int) -> np.ndarray:
    """A key of the first ``depth`` values in an order, for every signature."""
    key = np.full(len(sigs), order + 1, np.uint64)
    for i in _ORDER[order, :depth]:
        key = mixed(key * np.uint64(_BASE) + sigs[:, i])
    return key.view(np.int64)


def prefixes(nodes: DataFrame) -> DataFrame:
    """``key, order, id`` of every node in every order, at the first depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs, ids = _stacked(batch.column(1)), batch.column(0)
                for t in range(ORDERS):
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(sigs, t, DEPTH)), pa.array(np.full(len(sigs), t, np.int32)), ids], names=["key", "order", "id"])

    return nodes.select("id", "sig").mapInArrow(run, "key long, order int, id long")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``low, key, order, id, sig``) with ``place``, the values by which the order sorts, as bytes, for ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs, orders = _stacked(batch.column(4)), batch.column(2).to_numpy()
            places = np.take_along_axis(sigs, _ORDER[orders, :PLACE], axis=1).astype(">u2")
            columns = [*batch.columns[:2], pa.array([x.tobytes() for x in places], pa.binary()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["low", "key", "place", "id", "sig"])

    return rows.select("low", "key", "order", "id", "sig").mapInArrow(run, "low long, key long, place binary, id long, sig binary")


#: Numbers that a task's union holds before its edges leave.
HELD_IDS = 200_000


class Union:
    """Union-find over numbers; the root is the smallest of a component."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def stars(self) -> pa.RecordBatch:
        """An edge from each root to each other number of its component."""
        pairs = [(a, x) for x in self.up if (a := self.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])


def _alike(sig: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """A root of each of the nodes of a window; ``beside`` tells which are alike to the next one."""
    root = np.concatenate([[0], np.cumsum(~beside)])
    for i in range(len(sig) - 2):
        others = i + 2 + np.flatnonzero(root[i + 2 :] != root[i])
        if len(others):
            for r in set(root[others[(sig[others] == sig[i]).sum(axis=1) >= ENOUGH]].tolist()):
                root[root == r] = root[i]
    return root


def _least(values: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """For each row the smallest of the ``values`` of the rows of its root."""
    least = values.copy()
    np.minimum.at(least, roots, values)
    return least[roots]


def alike(sorted_: DataFrame) -> DataFrame:
    """Edges ``a < b`` that join the nodes that a task finds alike, one less than there are nodes; ``sorted_`` has ``key, id, sig``."""

    def window(id: np.ndarray, sig: np.ndarray) -> tuple[list[int], list[int]]:
        beside = (sig[1:] == sig[:-1]).sum(axis=1) >= ENOUGH
        least = np.full(len(id), id.min()) if beside.all() else id if len(id) == 2 else _least(id, _alike(sig, beside))
        return least[least != id].tolist(), id[least != id].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        together = Union()
        for batch in _ended(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _stacked(batch.column(2))]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None:
                continue
            key, id, sig = held
            rest = len(key)
            for i, j in _bounds(key):
                last = j == len(key) and batch is not None
                while j - i > WINDOW or (j - i > 1 and not last):
                    stop = min(j, i + WINDOW)
                    for a, b in zip(*window(id[i:stop], sig[i:stop]), strict=True):
                        together.unite(a, b)
                    i = stop - OVERLAP if stop < j else j
                rest = i if last else rest
            held = [x[rest:] for x in held]
            # what later windows join again meets these edges in the components
            if len(together.up) >= HELD_IDS:
                yield together.stars()
                together = Union()
        yield together.stars()

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _bounds(key: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist() if len(key) else [0]
    return list(itertools.pairwise(cuts))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def sets_of(ids: DataFrame, df: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``id, group, large, shingles`` of those rows of ``df`` that ``ids`` (``_id, group, large``, ids distinct) has."""
    names = ["id", "group", "large", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, 3):
                sets = shingle_sets(data, offsets, width)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    docs = df.select(F.col(id).cast("long").alias("_doc"), F.col(text).alias("text"))
    asked = docs.join(ids, F.col("_doc") == F.col("_id")).select("_id", "group", "large", "text")
    # of a repeated id a row may have no set
    return asked.mapInArrow(run, "id long, group long, large boolean, shingles array<long>").where(F.size("shingles") > 0)


class Sets:
    """Sets of one group, ordered by size, each as numbers of the group's shingles."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[self.order]
        at = np.repeat(starts[self.order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        every, self.flat = np.unique(flat[at], return_inverse=True)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.mask = np.zeros(len(every), bool)

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] - self.sizes[k] : self.ends[k]]


def linked(own: np.ndarray, flat: np.ndarray, sizes: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which sets (by rising ``sizes``, in ``flat``) are linked with the set ``own``; ``mask`` is as long as there are shingles."""
    n = len(own)
    # common <= the smaller and all >= the larger set, so a link needs sizes that near
    low, high = np.searchsorted(sizes, -(-PERCENT * n // 100)), np.searchsorted(sizes, 100 * n // PERCENT, side="right")
    if low >= high:
        return np.zeros(0, np.int64)
    begin = ends[low] - sizes[low]
    mask[own] = True
    common = np.add.reduceat(mask[flat[begin : ends[high - 1]]], ends[low:high] - sizes[low:high] - begin, dtype=np.int64)
    mask[own] = False
    return low + np.flatnonzero(100 * common >= PERCENT * (sizes[low:high] + n - common))


def solved(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The root (smallest number) of each set's class; sets are compared only with those not reached yet."""
    if len(sizes) == 2:
        common = len(np.intersect1d(flat[: sizes[0]], flat[sizes[0] :], assume_unique=True))
        return np.array([0, 0 if 100 * common >= PERCENT * (len(flat) - common) else 1])
    s = Sets(flat, sizes)
    roots = np.zeros(len(sizes), np.int64)
    alive = np.arange(len(sizes))
    rest, rest_sizes, rest_ends, gone = s.flat, s.sizes, s.ends, np.zeros(len(sizes), bool)
    while not gone.all():
        first = int(np.flatnonzero(~gone)[0])
        gone[first] = True
        members = [int(alive[first])]
        queue = members[:]
        while queue:
            near = linked(s.of(queue.pop()), rest, rest_sizes, rest_ends, s.mask)
            near = near[~gone[near]]
            gone[near] = True
            queue += alive[near].tolist()
            members += alive[near].tolist()
            if 2 * gone.sum() > len(gone) and not gone.all():
                rest = rest[np.repeat(~gone, rest_sizes)]
                alive, rest_sizes = alive[~gone], rest_sizes[~gone]
                rest_ends, gone = np.cumsum(rest_sizes), np.zeros(len(rest_sizes), bool)
        numbers = s.order[members]
        roots[numbers] = numbers.min()
    return roots


def _joined(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``begins``, one run after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Filed:
    """Sets filed under their rarest shingles, so that a set is compared only with those that can be linked with it.

    With all shingles in one order, rarest first, two linked sets share one among the first ``n - least + 1`` of each
    (``least``: ``PERCENT`` of its ``n``). Of the first one that they share, no more can follow than stand behind it in
    either set, and that has to be enough; so texts with a frame in common and contents of their own never meet.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        _, numbers, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = rank[numbers]
        self.flat = flat[np.lexsort((flat, owner))]
        self.mask = np.zeros(len(counts), bool)
        self.early = sizes + -PERCENT * sizes // 100 + 1
        left = sizes[owner] - _joined(np.zeros_like(sizes), sizes)
        early = np.flatnonzero(left > (sizes - self.early)[owner])
        early = early[np.argsort(self.flat[early], kind="stable")]
        self.who, self.left = owner[early], left[early]
        self.posts = np.searchsorted(self.flat[early], np.arange(len(counts) + 1))

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.begins[k] : self.begins[k] + self.sizes[k]]

    def near(self, k: int) -> np.ndarray:
        """The sets that ``k`` has to be compared with."""
        head = self.of(k)[: self.early[k]]
        many = self.posts[head + 1] - self.posts[head]
        at = _joined(self.posts[head], many)
        who = self.who[at]
        left = np.minimum(self.left[at], np.repeat(self.sizes[k] - np.arange(len(head)), many))
        return np.unique(who[((100 + PERCENT) * left >= PERCENT * (self.sizes[who] + self.sizes[k])) & (who != k)])

    def linked(self, k: int) -> np.ndarray:
        """The sets that are linked with ``k``."""
        others = self.near(k)
        if not len(others):
            return others
        sizes = self.sizes[others]
        self.mask[self.of(k)] = True
        common = np.add.reduceat(self.mask[self.flat[_joined(self.begins[others], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mask[self.of(k)] = False
        return others[100 * common >= PERCENT * (sizes + self.sizes[k] - common)]


def classes(sorted_: DataFrame, overlap: int) -> DataFrame:
    """Edges ``a < b`` from the least node of each class to the others, of each run of ``key`` in ``sorted_`` (``key, id, shingles``).

    A run within ``NODES`` and ``SHINGLES`` is solved whole; a longer one in windows, of which the last ``overlap``
    rows, as far as they are half of it, begin the next.
    """

    def window(rows: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        id = np.array([r[1] for r in rows], np.int64)
        least = _least(id, solved(np.concatenate([r[2] for r in rows]), np.array([len(r[2]) for r in rows])))
        return least[least != id], id[least != id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        size, new = 0, 0
        for batch in batches:
            found = []
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, id, shingles in zip(keys, ids, batch.column(2), strict=True):
                own = shingles.values.to_numpy()
                if rows and (key != rows[0][0] or len(rows) >= NODES or size + len(own) > SHINGLES):
                    if new and len(rows) > 1:
                        found.append(window(rows))
                    rows = rows[-min(overlap, len(rows) // 2) :] if key == rows[0][0] and overlap and len(rows) > 1 else []
                    size, new = sum(len(r[2]) for r in rows), 0
                rows.append((key, id, own))
                size, new = size + len(own), new + 1
            # what stays for the next batch must not hold this one
            rows = [(k, i, s.copy() if s.base is not None else s) for k, i, s in rows]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if new and len(rows) > 1:
            a, b = window(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sorted_.mapInArrow(run, "a long, b long")


def settled(rows: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """Edges ``a < b`` between components (``known``: ``id, component``) of large groups' ``rows`` (``id, group, shingles``) that are one class.

    What is not in its group's largest class meets all nodes whose size can be linked, in blocks of both (``Filed``).
    """
    sizes = F.size("shingles")
    # a size and 80 % of it are in the same or in neighbouring bins
    bin = F.floor(F.log(sizes.cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9).cast("int")
    nodes = rows.select("id", "group", bin.alias("bin"), sizes.alias("size")).join(known.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id"), "left")
    nodes = written(nodes.select("id", "group", "bin", "size", F.coalesce("component", "id").alias("component")), folder, "large_nodes")
    counts = nodes.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("group").alias("_group")).agg(F.max_by("component", F.struct("n", "component")).alias("_largest"))
    counts = small_or_plain(written(counts, folder, "largest"), BROADCAST_ROWS)
    marked = nodes.join(counts, F.col("group") == F.col("_group")).withColumn("asks", F.col("component") != F.col("_largest"))
    marked = written(marked.select("id", "group", "bin", "size", "component", "asks"), folder, "asking")
    asking = marked.where("asks")
    if asking.isEmpty():
        return known.select(F.col("id").alias("a"), F.col("component").alias("b")).limit(0)
    near = F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))
    blocks = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long")
    asked = asking.select("group", near.alias("bin"), "size").groupBy(F.col("group").alias("_group"), F.col("bin").alias("_bin")).agg(blocks().alias("_sides"))
    parts = marked.groupBy("group", "bin").agg(blocks().alias("_parts"))
    plan = parts.join(asked, (F.col("group") == F.col("_group")) & (F.col("bin") == F.col("_bin"))).select("_group", "_bin", "_parts", "_sides")
    plan = small_or_plain(written(plan, folder, "blocks"), BROADCAST_ROWS)
    own = lambda n: F.pmod(F.xxhash64(F.lit(n), "id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = (F.col("group") == F.col("_group")) & (F.col("bin") == F.col("_bin"))
    told = marked.join(plan, place).select("group", "bin", "id", "component", F.lit(False).alias("asks"), own("_parts").alias("part"), every("_sides").alias("side"))
    asks = asking.select("group", near.alias("bin"), "id", "component").join(plan, place)
    asks = asks.select("group", "bin", "id", "component", F.lit(True).alias("asks"), own("_sides").alias("side"), every("_parts").alias("part")).select(told.columns)
    both = told.unionAll(asks)
    named = rows.select(F.col("id").alias("_id"), "shingles")
    both = both.join(named, F.col("id") == F.col("_id")).select(F.xxhash64("group", "bin", "part", "side").alias("key"), "asks", "component", "shingles")

    def window(rows: list[tuple[bool, int, np.ndarray]]) -> list[tuple[int, int]]:
        filed = Filed(np.concatenate([r[2] for r in rows]), np.array([len(r[2]) for r in rows]))
        u, out = Union(), []
        for k, (asks, component, _) in enumerate(rows):
            if asks:
                for j in filed.linked(k).tolist():
                    if u.unite(component, rows[j][1]):
                        out.append((min(component, rows[j][1]), max(component, rows[j][1])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in _ended(batches):
            found: list[tuple[int, int]] = []
            columns = [batch.column(i).to_pylist() for i in range(3)] if batch is not None else [[None], [0], [0]]
            sets = batch.column(3) if batch is not None else [None]
            for now, asks, component, shingles in zip(*columns, sets, strict=True):
                if now != key:
                    found += window(rows) if rows else []
                    key, rows = now, []
                if shingles is not None:
                    rows.append((asks, component, shingles.values.to_numpy().copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return both.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (``a < b``, distinct) is either a smallest one or beside one smallest one and no other."""
    ends = edges.select(F.col("a").alias("x"), F.lit(0).alias("up")).unionAll(edges.select(F.col("b").alias("x"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 OR (n = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``id, component`` (the smallest id) of every node that ``edges`` (``a < b``, distinct, written) have."""
    step = 0
    while not _is_star(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")).withColumn("_m", F.least("_a", "_m"))
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("_m").alias("a"), "b").distinct()
        # now each edge points down; a node's smallest neighbour takes its other ones
        down = large.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("_m"))
        small = large.join(down, F.col("b") == F.col("_b"))
        small = small.select(F.col("_m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges, step = written(small, folder, f"{name}_{step}"), step + 1
        if step > 1:
            remove(edges.sparkSession, f"{folder}/{name}_{step - 2}")
    stars = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionAll(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, folder: str = "") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row of ``df``; what it is read from stays in ``folder``, or in a fresh one."""
    spark = df.sparkSession
    ship(spark)
    folder = folder or workspace(spark)
    rows = written(signatures(df, id, text, width), folder, "signatures")
    some = rows.where("digest IS NOT NULL AND id IS NOT NULL")
    nodes = some.groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = written(nodes, folder, "nodes")

    light = prefixes(nodes)
    several = light.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low <> _high").select(F.col("key").alias("_key"), F.col("_low").alias("low"))
    met = light.join(several, light["key"] == several["_key"]).drop("_key")
    sigs = nodes.select(F.col("id").alias("_id"), "sig")
    met = written(placed(met.join(sigs, met["id"] == sigs["_id"])), folder, "met")
    in_order = lambda x, *by: x.repartitionByRange(*by).sortWithinPartitions(*by)
    # regions of one family in several orders have their least id in common: side by side, their edges are the same ones
    edges = written(alike(in_order(met, "low", "key", "place", "id").select("key", "id", "sig")), folder, "alike")
    remove(spark, f"{folder}/met")

    groups = components(edges, folder, "groups")
    groups = written(groups.select(F.col("id").alias("_id"), F.col("component").alias("group")), folder, "members")
    weights = nodes.select("id", "n_shingles").join(groups, F.col("id") == F.col("_id")).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    large = written(weights.where((F.col("n") > NODES) | (F.col("weight") > SHINGLES)).select(F.col("group").alias("_group")), folder, "large")
    several_large = not large.isEmpty()
    if several_large:
        marked = groups.join(small_or_plain(large, BROADCAST_ROWS), F.col("group") == F.col("_group"), "left").select("_id", "group", F.col("_group").isNotNull().alias("large"))
        groups = written(marked, folder, "marked")
    else:
        groups = groups.withColumn("large", F.lit(False))
    sets = sets_of(small_or_plain(groups, BROADCAST_ROWS), df, id, text, width)
    if several_large:
        sets = written(sets, folder, "sets")
    small = sets.where("NOT large").select(F.col("group").alias("key"), "id", "shingles")
    stars = written(classes(small.repartition("key").sortWithinPartitions("key", "id"), 0), folder, "stars_small")

    # a repeated id joins the nodes of all its texts
    twice = some.groupBy(F.col("id").alias("_id")).agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).where("_low <> _high").select("_id")
    twice = some.select("id", F.col("digest").alias("_digest")).join(small_or_plain(written(twice, folder, "twice"), BROADCAST_ROWS), F.col("id") == F.col("_id"), "left_semi").distinct()
    ties = twice.join(nodes.select("digest", F.col("id").alias("node")), F.col("_digest") == F.col("digest")).where("node < id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    ties = written(ties, folder, "ties")
    if several_large:
        many = sets.where("large").select("id", "group", "shingles")
        runs = many.join(nodes.select(F.col("id").alias("_id"), "sig"), F.col("id") == F.col("_id"))
        runs = runs.select("id", "group", "sig", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("order"))
        places = placed(runs.select(F.col("group").alias("low"), F.xxhash64("group", "order").alias("key"), "order", "id", "sig").distinct()).drop("low", "sig")
        places = written(places.withColumnRenamed("id", "_id"), folder, "places")
        runs = written(many.join(places, F.col("id") == F.col("_id")).select("key", "place", "id", "shingles"), folder, "runs_in")
        told = classes(in_order(runs, "key", "place", "id").select("key", "id", "shingles"), OVERLAP).distinct()
        inner = written(components(written(told, folder, "told"), folder, "runs"), folder, "inner")
        remove(spark, f"{folder}/runs_in")
        between = written(settled(many, inner, f"{folder}/settled"), folder, "between")
        if not between.isEmpty():
            outer = components(between, folder, "outer").select(F.col("id").alias("_from"), F.col("component").alias("_to"))
            inner = inner.join(outer, F.col("component") == F.col("_from"), "left").select("id", F.coalesce("_to", "component").alias("component"))
            # a node that no window linked is a component by itself
            inner = inner.unionAll(outer.select(F.col("_from").alias("id"), F.col("_to").alias("component"))).distinct()
        stars = stars.unionAll(inner.where("component < id").select(F.col("component").alias("a"), F.col("id").alias("b")))
        remove(spark, f"{folder}/sets")
    if ties.isEmpty():
        final = stars.select(F.col("b").alias("id"), F.col("a").alias("component"))
    else:
        final = components(written(stars.unionAll(ties).distinct(), folder, "tied"), folder, "stars")
    known = nodes.select("digest", "id").join(final.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    known = known.select(F.col("digest").alias("_digest"), F.coalesce("component", "id").alias("component"))
    out = rows.drop("sig").join(known, rows["digest"] == known["_digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` by shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2)


def oracle() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT id, b FROM reach JOIN both_ways ON other = a),
    least AS (SELECT id, min(other) AS component FROM reach GROUP BY 1)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON id = d.doc_id"""
