"""N-gram Jaccard join: exact links between documents whose shingle sets are similar, and their components.

Every shingle is hashed to a group; a set is the point of its group counts. Two sets overlap in no more than the
sum of the smaller count of each group, which bounds their similarity before any set is read.

1. Sets get 128-bit names; documents with equal sets are one class, so copies cost nothing twice.
2. A linked pair shares one of the first shingles of either set under any order that is the same for all sets, so
   classes meet, without loss, in the blocks of their first fifth of shingles. Frequent shingles come last in that
   order, so a common line or passage makes a block only of texts that have little else. Blocks with the same
   smallest member are put together.
3. Each task holds its blocks in one packed R-tree of points, searched for the points whose summed minima reach the
   overlap they need. Only a spanning forest of what is found leaves the task: a row for each member of a block at
   most, whatever the number of pairs. Forests of all tasks together give the candidate groups.
4. The sets of a candidate group are compared in tiles that read each set once, again giving a spanning forest; tiles
   of one group are tied together by a member that all of them get, and where that leaves a group in several
   components, all their sets meet in pairs of tiles.

Groups hold all links. links() and pairs() compare every two different sets of a group; no pair is left to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.components import connected_components
from pagelake.llm.store import arrow_rows, discard, small, stash, unused
from pagelake.llm.text import give_back, mix, shingle_set

#: Members of a block in one tree; larger blocks are dealt out as pairs of tiles.
TILE = 2048
LEAF, FAN = 16, 8
#: Points that a tree is searched for at once, and rows with whole texts or sets in a batch.
QUERIES, BATCH = 256, 200
#: Rows, and bytes of points, whose blocks make one tree. Members that a block searches for after its first; then twice as many.
CHUNK, CHUNK_BYTES, PAIRWISE = 20_000, 32 << 20, 48
#: Frequent shingles that a task reports, and of which all sets take theirs last. Which these are never changes a result.
HOT_TASK, HOT = 4096, 65_536
#: Different sets, and shingles in them, of a tile whose sets are all compared in one task.
TILE_SETS, TILE_SHINGLES = 256, 1 << 20


class Similar:
    """Arithmetic of one threshold, in whole numbers."""

    def __init__(self, percent: int = 80):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold has to be 50 to 100 per cent")
        self.percent = percent
        self.slack = Fraction(100 - percent, percent)

    def differ(self, n: int) -> int:
        """Shingles in which a set of n and one linked with it differ, at most."""
        return n * (100 - self.percent) // self.percent

    def smallest(self, n: int) -> int:
        """Size of the smallest set that links with one of n; also the least overlap that n needs."""
        return -(-n * self.percent // 100)

    def overlap(self, sizes: np.ndarray) -> np.ndarray:
        """Common shingles that sets of these sizes together need."""
        return -(-self.percent * sizes // (100 + self.percent))


def grid(n: int) -> int:
    """Groups of the point of a set of n: one for two to four shingles; a power of two, so a finer point folds to a coarser one."""
    return min(4096, max(64, 1 << n.bit_length() >> 2))


def point(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def _packed(hashes: np.ndarray) -> bytes:
    """A set's point; a byte for each count if that is enough."""
    counts = point(hashes, grid(len(hashes)))
    return (counts.astype(np.uint8) if counts.max() < 256 else counts).tobytes()


def _unpacked(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == grid(n) else np.uint16)


def _prefix(n: int, similar: Similar) -> int:
    """How many first shingles a set of n needs to meet all it links with; 0 if it links with equal sets only."""
    return 0 if similar.differ(n) == 0 and similar.smallest(n) == n else n - similar.smallest(n) + 1


def blocks_of(hashes: np.ndarray, similar: Similar, hot: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Blocks in which a sorted set meets all it links with: its first shingles, the rest being fewer than a link needs.

    The order is that of the hashes, but for the frequent ones of `hot` (sorted hashes, and their places), which come last.
    """
    need = _prefix(len(hashes), similar)
    if not need or hot is None or not len(hot[0]):
        return hashes[:need]
    at = np.minimum(np.searchsorted(hot[0], hashes), len(hot[0]) - 1)
    common = hot[0][at] == hashes
    rare = hashes[~common][:need]
    if len(rare) == need:
        return rare
    last = hashes[common][np.argsort(hot[1][at[common]], kind="stable")]
    return np.concatenate([rare, last[: need - len(rare)]])


def _name(hashes: np.ndarray) -> bytes:
    """A set's 128-bit name."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _keys(names: list[bytes | None]) -> pa.Array:
    """64 bits of each name, for what tells candidates only: two names with one key are both taken."""
    return pa.array([None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in names], pa.int64())


class _Frequent:
    """The most frequent of the hashes that a task has seen, by counts over a million at a time."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.rows = 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.rows += len(hashes)
        if self.rows > 1 << 20:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        found, counts = np.unique(np.concatenate(self.held), return_counts=True)
        found, counts = found[counts >= 8], counts[counts >= 8]
        every, at = np.unique(np.concatenate([self.hashes, found]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]), len(every)).astype(np.int64)
        top = np.argsort(-sums, kind="stable")[: 4 * HOT_TASK]
        self.hashes, self.counts, self.held, self.rows = every[top], sums[top], [], 0


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _named(documents: DataFrame, similar: Similar, words: int) -> DataFrame:
    """doc_id, name (null without words), key, n of each row; and a row a task with n -1, its frequent shingles and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column(1)]
            for s in sets:
                frequent.add(s[: 2 * _prefix(len(s), similar)])
            names = [_name(s) if len(s) else None for s in sets]
            lists = pa.array([None] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), _keys(names), pa.array(map(len, sets), pa.int64()), lists, lists], names=columns)
        frequent.fold()
        give_back()
        top = slice(0, HOT_TASK)
        lists = [pa.array([x[top]], pa.list_(pa.int64())) for x in (frequent.hashes.view(np.int64), frequent.counts)]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([-1], pa.int64()), *lists], names=columns)

    columns = ["doc_id", "name", "key", "n", "hot", "counts"]
    return _keyed(documents).mapInArrow(run, "doc_id long, name binary, key long, n long, hot array<long>, counts array<long>")


def _points(documents: DataFrame, similar: Similar, words: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, name, key, n, counts (the point), blocks of each row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, shingle_set(t.as_py(), words)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            found = [(i, s) for i, s in found if len(s)]
            names = [_name(s) for _, s in found]
            blocks = [blocks_of(s, similar, hot).view(np.int64) for _, s in found]
            offsets = pa.array(np.cumsum([0, *map(len, blocks)]).astype(np.int32))
            cols = [
                pa.array([i for i, _ in found], pa.int64()), pa.array(names, pa.binary()), _keys(names), pa.array([len(s) for _, s in found], pa.int64()),
                pa.array([_packed(s) for _, s in found], pa.binary()), pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *blocks])),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "name", "key", "n", "counts", "blocks"])

    return _keyed(documents).mapInArrow(run, "doc_id long, name binary, key long, n long, counts binary, blocks array<long>")


def _sets(documents: DataFrame, roots: DataFrame, words: int) -> DataFrame:
    """name, hashes (its sorted set) of the rows with a wanted id (root), and of all rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in b.column(1) if len(s := shingle_set(t.as_py(), words))]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "hashes"])

    docs = _keyed(documents)
    wanted = docs.join(small(roots.select(F.col("root").alias("doc_id"))), "doc_id", "left_semi")
    return wanted.union(docs.where("doc_id is null")).mapInArrow(run, "name binary, hashes binary")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, key) -> leader, key: the members of blocks with several, by their block's smallest key.

    Blocks with one leader are searched together, so a member's point travels once for each leader and not for each
    block. Of a block only its leader is remembered, so none is too long.
    """
    block, leader = None, 0
    for b in batches:
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        starts = np.concatenate([[k[0] != block], k[1:] != k[:-1]])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(k)), -1))
        lead = np.where(run < 0, leader, v[np.maximum(run, 0)])
        block, leader = k[-1], lead[-1]
        pairs = np.stack([lead, v])[:, lead != v]
        if pairs.size:
            pairs = np.unique(np.concatenate([pairs, pairs[[0, 0]]], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["block", "key"])


def _same_grid(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both points on the coarser grid; added in 32 bits, as sums of 16-bit counts may not fit in 16."""
    while len(x) > len(y):
        x = np.add(x[::2], x[1::2], dtype=np.uint32)
    while len(y) > len(x):
        y = np.add(y[::2], y[1::2], dtype=np.uint32)
    return x, y


class CountTree:
    """A packed R-tree of count vectors. Boxes keep the largest count of each group and the ranges of sizes and blocks."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None = None):
        blocks = np.zeros(len(points), np.int64) if blocks is None else blocks
        order = np.lexsort((points[:, 0], points.argmax(1), sizes, blocks)) if len(points) else np.empty(0, np.int64)
        self.levels = [(order, points[order], sizes[order], sizes[order], blocks[order], blocks[order])]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            _, top, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(top), width)
            self.levels.append((at, np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
            width = FAN

    def search(self, points: np.ndarray, sizes: np.ndarray, similar: Similar, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) pairs of one block whose sizes agree and whose summed smaller counts reach the overlap they need."""
        blocks = np.zeros(len(points), np.int64) if blocks is None else blocks
        found = [self._search(points, sizes, blocks, similar, np.arange(k, min(k + QUERIES, len(points)))) for k in range(0, max(1, len(points)), QUERIES)]
        return np.concatenate([q for q, _ in found]), np.concatenate([s for _, s in found])

    def _search(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, similar: Similar, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        box = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            order, top, low, high, first, last = self.levels[depth]
            n, block = sizes[q], blocks[q]
            fits = (first[box] <= block) & (block <= last[box]) & (high[box] * 100 >= similar.percent * n) & (low[box] * similar.percent <= 100 * n)
            q, box = q[fits], box[fits]
            need = similar.overlap(sizes[q] + np.maximum(low[box], similar.percent * sizes[q] // 100))
            keep = [np.minimum(points[q[k : k + 8192]], top[box[k : k + 8192]]).sum(1, dtype=np.int64) >= need[k : k + 8192] for k in range(0, len(q), 8192)]
            keep = np.concatenate(keep) if keep else np.empty(0, bool)
            q, box = q[keep], box[keep]
            if depth:
                below, width = self.levels[depth - 1][0], LEAF if depth == 1 else FAN
                child = order[box][:, None] + np.arange(width)
                inside = child < len(below)
                q, box = np.repeat(q, width)[inside.ravel()], child[inside]
        return q, self.levels[0][0][box]


class Forest:
    """Sets that only ever merge; what joins two of them is an edge of a spanning forest."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        at = np.array(self.parent, np.int64)
        while (at[at] != at).any():
            at = at[at]
        return at


def _search_blocks(similar: Similar):
    """a, b: the components (b in that of a, their smallest key) of the pairs, within each run of (block, low, high), whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest.num_rows >= CHUNK or rest.nbytes >= CHUNK_BYTES:
                keys = [rest.column(c).to_numpy() for c in ("block", "low", "high")]
                whole = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in keys])))  # the last block may go on
                if whole:
                    yield search(rest.slice(0, whole))
                    rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield search(rest)

    def search(t: pa.Table) -> pa.RecordBatch:
        keys = [t.column(c).to_numpy() for c in ("block", "low", "high")]
        start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        block = np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
        names, node = np.unique(t.column("key").to_numpy(), return_inverse=True)
        n = t.column("n").to_numpy()
        counts = [_unpacked(c, k) for c, k in zip(t.column("counts").to_pylist(), n.tolist(), strict=True)]
        coarse = np.stack([_same_grid(c, np.empty(64, np.uint16))[0] for c in counts]).astype(np.uint32)
        tree, forest = CountTree(coarse, n, block), Forest(len(names))
        asked, queries, width = np.zeros(len(n), bool), start, PAIRWISE
        # Once all members that aren't joined to their block's first have been searched for, no pair of two sets is left out.
        while len(queries):
            asked[queries] = True
            q, s = tree.search(coarse[queries], n[queries], similar, block[queries])
            for i, j in zip(queries[q].tolist(), s.tolist(), strict=True):
                x, y = int(node[i]), int(node[j])
                if forest.find(x) != forest.find(y):
                    most = np.minimum(*_same_grid(counts[i], counts[j])).sum(dtype=np.int64)
                    if most >= similar.overlap(n[i] + n[j]):
                        forest.join(x, y)
            at = forest.roots()[node]
            left = np.flatnonzero((at != at[start][block]) & ~asked)
            place = np.arange(len(left)) - np.searchsorted(block[left], block[left], "left")
            queries, width = left[place < width], 2 * width
        at = forest.roots()
        joined = at != np.arange(len(at))
        return pa.RecordBatch.from_arrays([pa.array(names[at[joined]]), pa.array(names[joined])], names=["a", "b"])

    return run


def _compare(similar: Similar, want: str):
    """Compares the sets of rows sorted by (group, low, high): those of tile low with those of tile high, or within one tile.

    want "forest": other, the smallest name of its component, for each further name, sets of one comp being joined to begin
    with. "links": besides, the number of rows that each name links with. "pairs": all pairs that link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}
        for b in batches:
            for *at, tile, name, comp, root, rows, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != key:
                    if len(members) > 1:
                        yield compare(key, members)
                    key, members = at, {}
                members[name] = tile, comp, root, rows, np.frombuffer(hashes, np.uint64)  # repeated rows give their set again
        if len(members) > 1:
            yield compare(key, members)

    def compare(key: list, members: dict) -> pa.RecordBatch:
        _, low, high = key
        names = list(members)
        tile, comp, root, rows, sets = (list(x) for x in zip(*members.values(), strict=True))
        n, rows, tile = np.array([len(x) for x in sets], np.int64), np.array(rows, np.int64), np.array(tile)
        left, right = np.flatnonzero(tile != high if low != high else tile == low), np.flatnonzero(tile == high)
        forest, first = Forest(len(names)), {}
        for i, c in enumerate(comp):
            forest.join(first.setdefault(c, i), i)
        links, found = np.zeros(len(names), np.int64), []
        if len(left) and len(right):
            known, of = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
            starts = np.cumsum(np.append(0, n[right][:-1]))
            for i in left:
                to = right
                if want == "forest":
                    at = forest.roots()
                    # sets that are joined to the first one are compared when the others' turn comes
                    if low == high and i != left[0] and at[i] == at[left[0]] or (at[right] == at[i]).all():
                        continue
                    to = right[at[right] != at[i]]
                here = np.zeros(len(known) + 1, bool)
                at = np.searchsorted(known, sets[i])
                here[at[known[np.minimum(at, len(known) - 1)] == sets[i]]] = True
                common = np.add.reduceat(here[of], starts, dtype=np.int64)
                linked = 100 * common >= similar.percent * (n[i] + n[right] - common)
                linked &= (right > i) if low == high and want != "forest" else (right != i)
                j = right[linked]
                if want == "forest":
                    j = np.intersect1d(j, to)
                links[i] += rows[j].sum()
                links[j] += rows[i]
                if want == "pairs":
                    found += [(root[i], root[x], int(c)) for x, c in zip(j, common[linked], strict=True)]
                for x in j.tolist():
                    forest.join(int(i), x)
        if want == "pairs":
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "common"])
        at, least = forest.roots().tolist(), {}
        for k, name in enumerate(names):
            least[at[k]] = min(name, least.get(at[k], name))
        other = [least[at[k]] if least[at[k]] != name else None for k, name in enumerate(names)]
        keep = [k for k, x in enumerate(other) if x is not None or want == "links" and links[k]]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.binary()), pa.array([other[k] for k in keep], pa.binary()), pa.array(links[keep])], names=["name", "other", "links"])

    return run


class _Solved:
    """Classes of equal sets, candidate groups of classes, and the comparisons inside them."""

    def __init__(self, documents: DataFrame, percent: int, words: int):
        self.similar, self.words = Similar(percent), words
        self.docs = documents.select("doc_id", "text")
        self.spark = documents.sparkSession
        self.scratch: list[DataFrame] = []
        with arrow_rows(self.spark, BATCH):
            every = stash(_named(self.docs, self.similar, words), "names")
        self.rows = every.where("n >= 0").select("doc_id", "name", "key", "n")
        hot = every.where("n < 0").select(F.explode(F.arrays_zip("hot", "counts")).alias("h")).groupBy(F.col("h.hot").alias("hot")).agg(F.sum("h.counts").alias("c"))
        hot = hot.orderBy(F.desc("c"), "hot").limit(HOT).collect()  # HOT rows at most
        shingles, place = np.array([r["hot"] for r in hot], np.int64).view(np.uint64), -np.arange(len(hot))
        order = np.argsort(shingles)
        self.hot = shingles[order], place[order]
        named = self.rows.where("name is not null")
        self.classes = self.keep(named.groupBy("name").agg(F.first("key").alias("key"), F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")), "classes")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.scratch.append(stash(df, name))
        return self.scratch[-1]

    def done(self, result: DataFrame) -> DataFrame:
        """The result, written, so that the tables it was made from can go."""
        result = stash(result, "resolved")
        for t in self.scratch:
            discard(t)
        return result

    def members(self) -> DataFrame:
        """name, root, rows, n, grp: the classes that share a candidate group with others."""
        with arrow_rows(self.spark, BATCH):
            points = self.keep(_points(self.docs, self.similar, self.words, self.hot), "points")
        # copies of a class take no part: of each class the rows with its smallest id do
        copied = self.classes.where("rows > 1 and root is not null").select("name", "root")
        one = points.join(small(copied), "name", "left").where("root is null or doc_id = root")
        met = one.select(F.explode("blocks").alias("block"), "key").repartition("block").sortWithinPartitions("block", "key")
        met = self.keep(met.mapInArrow(_shared, "block long, key long").distinct(), "blocks")
        large = met.groupBy("block").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > TILE).select("block", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
        wanted = one.select("key", "n", "counts").join(small(met.select("key").distinct()), "key", "left_semi")
        rows = met.join(wanted, "key")
        if large.isEmpty():
            rows = rows.select("block", F.lit(0).alias("low"), F.lit(0).alias("high"), "key", "n", "counts")
        else:
            rows = rows.join(small(large), "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
            rows = rows.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            rows = rows.where("tiles = 1 or tile <> other").select("block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "key", "n", "counts")
        rows = rows.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "key")
        groups = connected_components(rows.mapInArrow(_search_blocks(self.similar), "a long, b long"))
        self.scratch.append(groups)
        return self.keep(self.classes.join(groups.select(F.col("node").alias("key"), F.col("component").alias("grp")), "key"), "members")

    def sets(self, members: DataFrame) -> DataFrame:
        return _sets(self.docs, members.where("root is not null").select("root").distinct(), self.words)

    def compared(self, rows: DataFrame, sets: DataFrame, want: str) -> DataFrame:
        """rows: grp, low, high, tile, name, comp, root, rows."""
        rows = rows.join(sets, "name").select("grp", "low", "high", "tile", "name", "comp", "root", "rows", "hashes")
        rows = rows.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "name")
        return rows.mapInArrow(_compare(self.similar, want), "a long, b long, common long" if want == "pairs" else "name binary, other binary, links long")

    def everything(self, want: str) -> DataFrame:
        """All different sets of each group compared, tile by tile."""
        members = self.members()
        tiled = members.join(members.groupBy("grp").agg(_tiles().alias("tiles")), "grp").withColumn("tile", F.pmod(F.xxhash64("name"), "tiles").cast("int"))
        tiled = tiled.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = tiled.select("grp", F.least("tile", "to").alias("low"), F.greatest("tile", "to").alias("high"), "tile", "name", F.col("name").alias("comp"), "root", "rows")
        with arrow_rows(self.spark, BATCH):
            return self.keep(self.compared(rows, self.sets(members), want), "compared")

    def linked(self) -> DataFrame:
        """name, comp: the component (a name) of each class that links with another."""
        members = self.members()
        sets = self.sets(members)
        tiles = members.groupBy("grp").agg(_tiles().alias("tiles"), F.min("key").alias("least"))
        tiled = members.join(tiles, "grp").withColumn("tile", F.pmod(F.xxhash64("name"), "tiles").cast("int"))
        # the member with the group's smallest key goes to all of its tiles
        every = F.when(F.col("key") == F.col("least"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
        tied = tiled.withColumn("tile", F.explode(every))
        with arrow_rows(self.spark, BATCH):
            comps = self.components(self.compared(tied.select("grp", F.col("tile").alias("low"), F.col("tile").alias("high"), "tile", "name", F.col("name").alias("comp"), "root", "rows"), sets, "forest"))
        large = tiles.where("tiles > 1").select("grp")
        if large.isEmpty():
            return comps
        # groups of several tiles that are in several components: the largest one's sets are compared with all others
        rows = members.join(small(large), "grp", "left_semi").join(comps, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
        sizes = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("c"))
        best = sizes.groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("best"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        best = self.keep(best.select("grp", F.col("best.comp").alias("main"), F.ceil((F.col("all") - F.col("best.c")) / TILE_SETS).cast("int").alias("o"), F.ceil(F.col("best.c") / TILE_SETS).cast("int").alias("m")), "open")
        if best.isEmpty():
            return comps
        rows = rows.join(small(best), "grp")
        tile = F.when(F.col("comp") == F.col("main"), F.col("o") + F.pmod(F.xxhash64("name"), "m")).otherwise(F.pmod(F.xxhash64("name"), "o")).cast("int")
        rows = rows.withColumn("tile", tile).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("o") + F.col("m") - 1))).where("least(tile, to) < o")
        rows = rows.select("grp", F.least("tile", "to").alias("low"), F.greatest("tile", "to").alias("high"), "tile", "name", "comp", "root", "rows")
        known = comps.select("name", F.col("comp").alias("other"))
        with arrow_rows(self.spark, BATCH):
            return self.components(self.compared(rows, sets, "forest").select("name", "other").union(known))

    def components(self, links: DataFrame) -> DataFrame:
        found = connected_components(links.where("other is not null").select(F.col("name").alias("a"), F.col("other").alias("b")))
        self.scratch.append(found)
        return found.select(F.col("node").alias("name"), F.col("component").alias("comp"))

    def labelled(self, comps: DataFrame) -> DataFrame:
        """name, root, rows, component_id of the classes with copies or links, or with an id that has several texts."""
        texts = self.rows.where("doc_id is not null and name is not null").groupBy("doc_id").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
        texts = texts.select("doc_id", "a")
        if not texts.isEmpty():  # all texts of one id are one document
            same = self.rows.where("name is not null").join(small(texts), "doc_id").select("a", F.col("name").alias("b"))
            comps = self.components(same.select(F.col("a").alias("name"), F.col("b").alias("other")).union(comps.select("name", "comp")))
        found = self.classes.join(comps, "name", "left").where("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "name"))
        least = found.groupBy("comp").agg(F.min("root").alias("component_id"))
        return found.join(least, "comp").select("name", "root", F.col("rows").alias("copies"), "component_id")


def _tiles() -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_SHINGLES)).cast("int")


def join(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when 100 * common >= percent * united distinct shingles of `words` words, A-Z lower-cased; a shorter
    text is one shingle; one without words, or null, links with nothing. component_id is the smallest doc_id reached by
    links; null ids count as larger than all, so a component of such rows only has null. Equal sets are one class, so
    copies cost nothing twice. Repeated rows come out as often as they came in; rows with one doc_id and different texts
    are one document with the links of all. Further columns are ignored; an empty table gives an empty result.
    """
    s = _Solved(documents, percent, words)
    named = s.done(s.labelled(s.linked()).select("name", "component_id"))
    out = s.rows.join(small(named), "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def links(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id as join() has them; class_id, the smallest doc_id with the same set; n_links.

    n_links is the number of other rows whose text links with the row's: the copies of its set, and all rows of every
    different set that links with it. Rows without words have no class and no links.
    """
    s = _Solved(documents, percent, words)
    found = s.everything("links")
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    named = s.labelled(s.components(found)).join(counts, "name", "left")
    named = s.done(named.select("name", "root", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")).withColumnRenamed("n", "linked"))
    out = s.rows.join(small(named), "name", "left")
    own = F.when(F.col("name").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), own.alias("class_id"), F.coalesce("linked", F.lit(0)).alias("n_links"))


def pairs(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """a, b, common: class_ids (see links) of every two different sets that link, a <= b, and their common shingles; null ids last."""
    s = _Solved(documents, percent, words)
    found = s.done(s.everything("pairs"))
    return found.select(F.least("a", "b").alias("a"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b")).alias("b"), "common")


def one_of_each(documents: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row of each component of linked sets, with all its columns, and every row without words.

    Of a component the row with the smallest doc_id stays (null ids last; then the smallest set name), and of its
    repeated rows any one. Here components are of texts: two different texts under one doc_id go or stay each by itself.
    """
    s = _Solved(documents, percent, words)
    comps = s.linked()
    found = s.classes.join(comps, "name", "left").where("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "name"))
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("root").isNull().alias("no_id"), "root", "name")).alias("first"))
    named = s.done(found.join(first, "comp").select("name", F.col("first.root").alias("root"), F.col("first.name").alias("stays")))
    stay = F.when(F.col("stays").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("root")) & (F.col("name") == F.col("stays")))
    judged = s.rows.join(small(named), "name", "left").withColumn("stay", stay)
    several = stash(s.rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "several")
    gone = stash(judged.where("not stay and doc_id is not null").select("doc_id").distinct(), "gone")
    no_ids, repeated = not s.rows.where("doc_id is null").isEmpty(), not several.isEmpty()
    key = F.col("doc_id").cast("long")
    if not (no_ids or repeated):
        return _without(documents, gone, key)
    # ids don't tell these rows apart: their names do
    plain = _without(_without(documents.where(key.isNotNull()), several, key), gone, key)
    odd = documents.where(key.isNull()).union(_without(documents, several, key, "left_semi"))
    name = unused("set_name", documents.columns)
    with_names = stash(_with_names(odd, name, words), "odd")
    stay = judged.where("stay and name is not null").select(F.col("doc_id").alias("stay_id"), F.col("name").alias("stay_name")).distinct()
    kept = with_names.join(stay, (F.col(name) == stay["stay_name"]) & key.eqNullSafe(stay["stay_id"]), "left_semi").dropDuplicates(["doc_id", name])
    return plain.union(kept.drop(name)).union(with_names.where(F.col(name).isNull()).drop(name))


def _without(documents: DataFrame, ids: DataFrame, key: Column, how: str = "left_anti") -> DataFrame:
    named = small(ids.select(F.col("doc_id").alias("other_doc_id")))
    return documents.join(named, key == named["other_doc_id"], how)


def _with_names(documents: DataFrame, column: str, words: int) -> DataFrame:
    """The rows with their set's name in one more column."""
    at, fields = documents.columns.index("text"), [f.name for f in documents.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(None if t is None else t.encode(), words) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_name(x) if len(x) else None for x in sets], pa.binary())], names=[*fields, column])

    from pyspark.sql import types as T

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(column, T.BinaryType())]))
