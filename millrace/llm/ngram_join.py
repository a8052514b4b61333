"""N-gram Jaccard join: prefix trees of globally ordered shingle sets.

*Routing.*  Sets that can be linked are brought together by exact signatures:
two sets with Jaccard similarity t differ in at most D shingles, where D follows
from their sizes, so of D + 2 hash partitions of the shingles at least two hold
the same shingles in both.  The digest of each partition is a signature, taken per
band of sizes.  A quarter of D more partitions are made, and each set leaves out so
many of its smallest ones: empty ones and those of a common shingle or two, which
would join most long texts into one cluster.  Of the partitions that two linked sets
share the largest is left out by neither, as its place follows from what it holds.
Signatures with one set only are dropped by a partial aggregation; connected
components over the others are clusters.  Equal sets are
one node, and of a set with very many copies one row goes on from there.

*Equality.*  A shingle is the 128-bit digest of its words (BLAKE2 by word), in two
lanes.  Signatures and orders take the first; shingles of a set, and equal sets, are
the same when both lanes are, shingles of different sets in a trie when the first
and a quarter of the second are.

*Looser joins.*  Under ``STRICT`` percent a partition holds few shingles, and common
passages would join most texts into one cluster.  There each set leaves out its
most frequent signatures instead of its smallest, as many as the additional
partitions allow: in one order by frequency the rarest signature that two linked sets share is left out by neither.

*Join.*  In each cluster the sets, ordered by one global order of shingles, are
stored in a trie.  A query set walks the trie from the root; the overlap with a
prefix is counted once for all sets below it, and a subtree is left as soon as
the remaining lengths cannot reach the needed overlap.  Components are all that
is asked for, so a set that is linked leaves the trie and queries it later
itself: a group of near copies costs about one walk a set, not one a pair.
In clusters of more than ``SMALL`` shingles, a few pivots gather most members in
one pass that is spread over as many tasks as the cluster is large; only the
members that they leave are dealt out, in blocks, to meet the others.

Edge cases: null texts and texts without a word have no set and link with
nothing; texts with fewer words than a shingle have their whole sequence as one;
rows that share an identifier are one document; rows with a null identifier get
the component of their equals; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import HOT_KEYS, discard, join_hot, materialize, release, ship
from .bpe import slices
from .components import components
from .words import distinct, gram_digests, mix, word_digests

#: Ratio of the sizes in a band.
BAND = 1.5
#: Partitions that are spared, at least.
SPARE = 1
#: Percent under which frequent signatures are left out instead of small ones, and one partition is spared for so many that may differ.
STRICT, LOOSE = 90, 4
#: Shingles in one task's trie, about, and in a cluster that is joined in one trie.
BLOCK, SMALL = 1_000_000, 200_000
#: Members of a large cluster that all its others are held against first.
PIVOTS = 4
#: Octets of all pivots up to which they are broadcast.
PIVOT_BYTES = 16 << 20
#: Octets of sets that are dealt out at a time in large clusters, at least.
WAVE = 256 << 20
#: Sets in clusters, or tasks of sets, of some octets each, up to which their identifiers are broadcast.
MEMBERS = 2_000_000
#: Copies up to which a set's rows are dealt out with their signatures.
HOT_COPIES = 1_000
#: Symbols in one trie node at most, so that bounds are looked at early.
NODE = 32

_U = np.uint64


def _needed(size_a, size_b, percent: int):
    """The least intersection of sets of these sizes whose Jaccard similarity is ``percent`` or more."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text its distinct shingles of ``n`` words, A-Z lower-cased: two lanes of a 128-bit digest each, in order."""
    words, row = word_digests(texts, fold_case=True)
    counts = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    grams = gram_digests(words, n)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(distinct(grams[a : b - n + 1]))
        elif b > a:  # the whole sequence, told apart by its length
            with np.errstate(over="ignore"):
                out.append(mix(gram_digests(words[a:b], int(b - a)) + _U(b - a)))
        else:
            out.append(np.empty((0, 2), _U))
    return out


def _packed(own: np.ndarray) -> bytes:
    """A set as bytes: all of the first lane, a quarter of the second, 80 bits a shingle."""
    return own[:, 0].tobytes() + own[:, 1].astype(np.uint16).tobytes()


def _views(own: pa.BinaryScalar | bytes) -> tuple[np.ndarray, np.ndarray]:
    """The two lanes of a set from its bytes, without a copy."""
    data = own.as_buffer() if isinstance(own, pa.BinaryScalar) else own
    size = len(data) // 10
    return np.frombuffer(data, _U, size), np.frombuffer(data, np.uint16, size, 8 * size)


def _lanes(own: pa.BinaryScalar | bytes) -> np.ndarray:
    """A set from its bytes."""
    return np.stack(_views(own), 1)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets share."""
    return len(a) + len(b) - len(distinct(np.concatenate((a, b))))


def _edges_of_band(band: int) -> tuple[int, int]:
    """Smallest and largest size in a band."""
    low, high = math.ceil(BAND**band), math.ceil(BAND ** (band + 1)) - 1
    return low, high


def _band(size: int) -> int:
    band = max(0, int(math.log(size) / math.log(BAND)) - 1)
    while _edges_of_band(band)[1] < size:
        band += 1
    return band


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """The set's signatures for its band and, where a partner may be in the next one, for that."""
    return _signatures(own, percent)[0]


def _signatures(own: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """The signatures, and how many of an even and of an odd band's the set may leave out.

    Under ``STRICT`` percent a signature's lowest bit is its band's.
    """
    size, out, surplus = len(own), [], [0, 0]
    if not size:
        return np.empty(0, np.int64), surplus
    own = own[:, 0]  # signatures only bring sets together
    with np.errstate(over="ignore"):
        content = mix(own ^ _U(0xA24BAED4963EE407))
        place = own >> _U(11)
        for band in (b := _band(size), b + 1):
            low, high = _edges_of_band(band)
            if band > b and 100 * size < percent * low:
                continue
            differ = (100 - percent) * 2 * high // (100 + percent)
            spare = max(SPARE, differ // LOOSE)
            parts = differ + 1 + spare if differ else 1
            total, many = np.zeros(parts, _U), np.zeros(parts, np.int64)
            at = (place % _U(parts)).astype(np.int64)
            np.add.at(total, at, content)
            np.add.at(many, at, 1)
            full = many > 0
            number = np.arange(parts, dtype=_U)
            sigs = mix(total + mix(number + _U(band << 40) + _U(1)))
            if percent >= STRICT:
                if differ:  # one order of partitions by size and content, the same in all sets
                    sigs = sigs[np.argsort(np.minimum(many, 4095).astype(_U) << _U(52) | sigs >> _U(12), kind="stable")[spare:]]
            else:
                sigs = sigs[full if (~full).sum() <= spare else np.ones(parts, bool)]
                sigs = sigs & ~_U(1) | _U(band & 1)
                if differ and (~full).sum() <= spare:
                    surplus[band & 1] = max(0, len(sigs) - differ - 1)
            out.append(sigs)
    return np.concatenate(out).astype(np.int64), surplus


# -- the trie -------------------------------------------------------------------------
class Trie:
    """A radix trie of sorted integer sequences, walked level by level for one query at a time."""

    def __init__(self, sets: list[np.ndarray], numbers: np.ndarray):
        self.numbers = numbers
        keys = [sets[i].astype(">u4").tobytes() for i in numbers]
        order = sorted(range(len(numbers)), key=keys.__getitem__)
        own = [sets[numbers[i]] for i in order]
        base = np.concatenate(([0], np.cumsum([len(s) for s in own])))
        parent, begin, end, source = [-1], [0], [0], [0]
        ends = np.empty(len(own), np.int64)
        path = [0]  # nodes from the root to the last leaf
        for j, s in enumerate(own):
            shared = 0
            if j:
                before = own[j - 1]
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                shared = int(differ[0]) if len(differ) else m
            while end[path[-1]] > shared and begin[path[-1]] >= shared:
                path.pop()
            top = path[-1]
            if end[top] > shared:  # the border lies inside a node: its upper part becomes a node of its own
                upper = len(parent)
                parent.append(parent[top]), begin.append(begin[top]), end.append(shared), source.append(source[top])
                parent[top], begin[top] = upper, shared
                path[-1] = top = upper
            at = shared
            while at < len(s):
                node = len(parent)
                parent.append(top), begin.append(at), end.append(min(len(s), at + NODE)), source.append(j)
                path.append(node)
                top, at = node, end[node]
            ends[j] = top
        self.flat = np.concatenate(own) if own else np.empty(0, np.int64)
        self.parent, begin, end, source = map(np.array, (parent, begin, end, source))
        self.depth = end
        self.start, self.length = base[source] + begin, end - begin
        self.last = self.flat[np.maximum(base[source] + end - 1, 0)]
        self.sizes = np.array([len(s) for s in own])
        self.order = np.array(order, np.int64)
        nodes = len(parent)
        # children and sets by node, and levels from the root down
        self.child = np.argsort(self.parent, kind="stable")[1:]
        self.child_at = np.searchsorted(self.parent[self.child], np.arange(nodes + 1))
        self.leaf = np.argsort(ends, kind="stable")
        self.leaf_at = np.searchsorted(ends[self.leaf], np.arange(nodes + 1))
        levels, level = [], np.array([0])
        while len(level):
            levels.append(level)
            level = _ranges(self.child, self.child_at[level], self.child_at[level + 1])
        self.least, self.most = np.full(nodes, 1 << 40), np.zeros(nodes, np.int64)
        np.minimum.at(self.least, ends, self.sizes)
        np.maximum.at(self.most, ends, self.sizes)
        for level in reversed(levels[1:]):
            np.minimum.at(self.least, self.parent[level], self.least[level])
            np.maximum.at(self.most, self.parent[level], self.most[level])

    def linked(self, query: np.ndarray, inside: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets linked with ``query``; ``inside`` is a scratch bitmap of all symbols, all False."""
        a = len(query)
        inside[query] = True
        found, nodes, overlap = [], np.array([0]), np.array([0])
        while len(nodes):
            here = self.leaf_at[nodes + 1] - self.leaf_at[nodes]
            if here.any():
                leaves = _ranges(self.leaf, self.leaf_at[nodes], self.leaf_at[nodes + 1])
                common = np.repeat(overlap, here)
                found.append(leaves[common >= _needed(a, self.sizes[leaves], percent)])
            many = self.child_at[nodes + 1] - self.child_at[nodes]
            below = _ranges(self.child, self.child_at[nodes], self.child_at[nodes + 1])
            shared = np.repeat(overlap, many)
            fits = (100 * self.most[below] >= percent * a) & (percent * self.least[below] <= 100 * a)
            below, shared = below[fits], shared[fits]
            if not len(below):
                break
            size = self.length[below]
            hit = inside[_ranges(self.flat, self.start[below], self.start[below] + size)]
            shared = shared + np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            left = np.minimum(a - np.searchsorted(query, self.last[below], "right"), self.most[below] - self.depth[below])
            alive = shared + left >= _needed(a, self.least[below], percent)
            nodes, overlap = below[alive], shared[alive]
        inside[query] = False
        return self.numbers[self.order[np.concatenate(found)]] if found else np.empty(0, np.int64)


def _ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The concatenation of values[start:stop] over all pairs."""
    size = stop - start
    total = int(size.sum())
    if not total:
        return values[:0]
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]


def globally_ordered(sets: list[np.ndarray] | list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """The sets as ascending ranks in one order of all their shingles, frequent ones first so that prefixes are shared; and how many ranks there are."""
    lanes = [(s[:, 0], s[:, 1]) if isinstance(s, np.ndarray) else s for s in sets]
    first, second = (np.concatenate(x) for x in zip(*lanes))
    names, at, often = np.unique(first, return_inverse=True, return_counts=True)
    at = at.reshape(-1)
    told = np.empty(len(names), second.dtype)
    told[at] = second
    if (told[at] != second).any():  # different shingles share the first lane
        names, at, often = np.unique(np.stack((first, second), 1), axis=0, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    cuts = np.cumsum([len(s) for s, _ in lanes])[:-1]
    return [np.sort(s) for s in np.split(rank[at.reshape(-1)], cuts)], len(names)


def spanning_links(sets: list[np.ndarray] | list[tuple[np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join exactly the sets that links join: a spanning forest, by walks over a shrinking trie."""
    if len(sets) < 2:
        return []
    ordered, symbols = globally_ordered(sets)
    inside, free, links = np.zeros(symbols, bool), np.ones(len(sets), bool), []
    trie, left = Trie(ordered, np.arange(len(sets))), len(sets)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            if 2 * left < len(trie.numbers):
                trie = Trie(ordered, np.flatnonzero(free))
            x = queue.pop()
            near = trie.linked(ordered[x], inside, percent)
            near = near[free[near]]
            free[near] = False
            left -= len(near)
            links += [(x, int(y)) for y in near]
            queue += near.tolist()
    return links


# -- the join -------------------------------------------------------------------------
def join(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row: components of links at ``percent`` or more."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def key(own: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            both = (mix(own[:, 0] + _U(1)).sum(dtype=_U), mix(own[:, 1] ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
        return tuple(int(np.int64(x)) for x in both)

    def describe(batches):
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), n)
            keys = [key(s) for s in sets]
            told = [_signatures(s, percent) for s in sets]
            found, surplus = pa.array([s for s, _ in told], pa.list_(pa.int64())), pa.array([x for _, x in told], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, sets)), pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), found, surplus], ["id", "n", "k1", "k2", "sigs", "surplus"])

    described = materialize(rows.mapInArrow(describe, "id long, n long, k1 long, k2 long, sigs array<long>, surplus array<int>"), "sets")
    # one document for each distinct set, copies before any join
    owners = described.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    owners = materialize(owners, "owners")
    told = _without_copies(described.where("n > 0"), owners).select("k1", F.explode("sigs").alias("sig"))
    if percent < STRICT:
        clusters = components(_rarely_shared(told, described.where("n > 0").select("k1", "surplus")))
    else:
        clusters = components(_together(told))
    release(docs.sparkSession)
    # from here on only the sets' names are needed
    slim = materialize(described.drop("sigs", "surplus"), "names")
    discard(described)
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
    nodes = owners.where("id is not null").drop("copies").join(clusters.withColumnRenamed("node", "k1"), "k1")
    nodes = materialize(nodes.select("component", "k1", "k2", "id", "n"), "nodes")
    release(docs.sparkSession)
    linked = components(_links(rows, nodes, n, percent, key))
    release(docs.sparkSession)
    owners = owners.select("k1", "k2", F.col("id").alias("owner"), "copies").join(linked.withColumnRenamed("node", "owner"), "owner", "left")
    owners = materialize(owners.select("k1", "k2", F.coalesce("component", "owner").alias("component"), "copies"), "components-of")
    out = join_hot(slim, owners, ["k1", "k2"], "copies", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _without_copies(described: DataFrame, owners: DataFrame) -> DataFrame:
    """Leave out the rows of very frequent sets but for their owner's, before signatures are dealt out: fewer than ``HOT_KEYS`` sets have that share of all rows."""
    total = owners.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = owners.where(F.col("copies") > max(HOT_COPIES, total // HOT_KEYS)).select("k1", "k2", F.col("id").alias("owner"))
    met = described.join(F.broadcast(hot), ["k1", "k2"], "left")
    return met.where(F.col("owner").isNull() | (F.col("owner") == F.col("id"))).drop("owner")


def _together(told: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` from the least set of every shared signature to its others: signatures are dealt out once, eight octets each beside the set's name."""

    def least(batches):
        sig, first = None, None  # rows come by signature, and there by set
        for batch in batches:
            if not batch.num_rows:
                continue
            at, k1 = batch.column("sig").to_numpy(), batch.column("k1").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            firsts = k1[starts]
            if sig == at[0]:
                firsts[0] = first
            a = np.repeat(firsts, np.diff(np.concatenate((starts, [len(at)]))))
            sig, first = at[-1], firsts[-1]
            met = a < k1
            yield pa.RecordBatch.from_arrays([pa.array(a[met]), pa.array(k1[met])], ["a", "b"])

    dealt = told.select("sig", "k1").repartition("sig").sortWithinPartitions("sig", "k1")
    return dealt.mapInArrow(least, "a long, b long")


def _rarely_shared(told: DataFrame, surplus: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the sets that share a signature which neither leaves out as one of its most frequent."""
    of_sig = Window.partitionBy("sig")
    shared = told.select("sig", "k1", F.min("k1").over(of_sig).alias("a"), F.max("k1").over(of_sig).alias("b"), F.count(F.lit(1)).over(of_sig).alias("often"))
    shared = materialize(shared.where("a < b").select("sig", "k1", "often").distinct(), "shared")
    release(told.sparkSession)
    odd = F.col("sig").bitwiseAND(F.lit(1).cast("long")).cast("int")
    down = Window.partitionBy("k1", "odd").orderBy(F.desc("often"), F.desc("sig"))
    ranked = shared.withColumn("odd", odd).join(surplus.groupBy("k1").agg(F.first("surplus").alias("surplus")), "k1").withColumn("place", F.row_number().over(down))
    rare = ranked.where(F.col("place") > F.element_at("surplus", F.col("odd") + 1)).select("sig", "k1")
    return rare.select(F.min("k1").over(of_sig).alias("a"), F.col("k1").alias("b")).where("a < b")


def _links(rows: DataFrame, nodes: DataFrame, n: int, percent: int, key) -> DataFrame:
    """Spanning links ``(a, b)`` between the documents of each cluster."""
    weights = nodes.groupBy("component").agg(F.ceil(F.sum("n") / SMALL).cast("int").alias("blocks"))
    placed = materialize(nodes.join(weights, "component"), "placed")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, 4 * math.ceil(total / BLOCK))

    def read(batches):
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column("text"), n)
            right = [key(s) == k for s, k in zip(sets, zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True), strict=True)]
            own = pa.array([_packed(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "component", "blocks")] + [own], ["id", "component", "blocks", "own"]).filter(pa.array(right, pa.bool_()))

    def link(table: pa.Table) -> pa.Table:
        by_cluster: dict[int, list[int]] = {}
        for i, c in enumerate(table.column("component").to_pylist()):
            by_cluster.setdefault(c, []).append(i)
        ids, own = table.column("id").to_numpy(), table.column("own")
        a, b = [], []
        for members in by_cluster.values():
            for x, y in spanning_links([_views(own[i]) for i in members], percent):
                a.append(ids[members[x]]), b.append(ids[members[y]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    if placed.count() <= MEMBERS:  # identifiers only, so that just the texts of clusters are exchanged
        rows = rows.join(F.broadcast(placed.select("id")), "id", "left_semi")
    sets = rows.join(placed.select("id", "k1", "k2", "component", "blocks").hint("shuffle_hash"), "id").mapInArrow(read, "id long, component long, blocks int, own binary")
    if placed.where("blocks > 1").isEmpty():
        small, large = sets, None
    else:  # the sets of large clusters are read several times
        sets = materialize(sets, "own-sets")
        release(rows.sparkSession)
        small, large = sets.where("blocks = 1"), sets.where("blocks > 1")
    task = F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")
    links = small.withColumn("task", task).groupBy("task").applyInArrow(link, "a long, b long")
    return links if large is None else links.unionByName(_large(large, percent, link))


def _large(sets: DataFrame, percent: int, link) -> DataFrame:
    """Links within large clusters.

    First every member is held against a few pivots of its cluster, which gathers most near copies of
    one text at the cost of one pass.  Members of the largest group so found are linked already; only
    the others are then held, in blocks, against each other and against that group.
    """

    def against_pivots(batches):
        for batch in batches:
            a, b = [], []
            for member, own, pivots in zip(batch.column("id").to_pylist(), batch.column("own"), batch.column("pivots").to_pylist(), strict=True):
                mine = _lanes(own)
                for p in pivots:
                    other = _lanes(p["own"])
                    if p["id"] != member and _common(mine, other) >= _needed(len(mine), len(other), percent):
                        a.append(member), b.append(p["id"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # a fixed number of pivots: the members with the least hash by each of so many hashes
    least = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id")).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = sets.groupBy("component").agg(*least).select(F.explode(F.array(*(F.col(f"p{i}.id") for i in range(PIVOTS)))).alias("id")).distinct()
    # identifiers of a few members of each large cluster: sets stay where they are
    pivots = sets.join(F.broadcast(chosen), "id", "left_semi").groupBy("component").agg(F.collect_list(F.struct("id", "own")).alias("pivots"))
    pivots = materialize(pivots, "pivots")
    held = pivots.agg(F.coalesce(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["own"]))), F.lit(0))).first()[0]
    if held <= PIVOT_BYTES:
        met = sets.join(F.broadcast(pivots), "component")
    else:  # every part of a cluster gets its pivots, so that no cluster meets in one task
        parts = sets.groupBy("component").agg(F.first("blocks").alias("blocks"))
        spread = pivots.join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        met = sets.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("blocks")).cast("int")).join(spread, ["component", "part"])
    star = materialize(met.select("id", "own", "pivots").mapInArrow(against_pivots, "a long, b long"), "star")
    groups = sets.select("id", "component", F.octet_length("own").alias("size")).join(components(star).select(F.col("node").alias("id"), F.col("component").alias("grp")), "id", "left")
    groups = materialize(groups.select("id", "component", "size", F.coalesce("grp", "id").alias("grp")).dropDuplicates(["id"]), "groups")
    sums = groups.groupBy("component", "grp").agg(F.sum("size").alias("size"))
    largest = sums.groupBy("component").agg(F.max_by("grp", F.struct("size", "grp")).alias("main"), F.max("size").alias("main_size"), F.sum("size").alias("size"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / (10 * BLOCK))).cast("int")
    told = groups.select("id", "component", "grp", F.col("size").alias("own_size")).join(largest.withColumn("mains", blocks(F.col("main_size"))).withColumn("others", F.when(F.col("size") > F.col("main_size"), blocks(F.col("size") - F.col("main_size"))).otherwise(0)), "component")
    main = F.col("grp") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(main, F.col("mains")).otherwise(F.greatest("others", F.lit(1)))).cast("int")
    told = told.where("others > 0").withColumn("own_block", own).withColumn("in_main", main)
    name = lambda kind, i, j: F.concat_ws(":", "component", F.lit(kind), i, j)
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    among = F.transform(up_to("others"), lambda j: name("r", F.least(j, F.col("own_block")), F.greatest(j, F.col("own_block"))))
    among = F.when(F.col("others") > 1, F.filter(among, lambda t: t != name("r", F.col("own_block"), F.col("own_block")))).otherwise(among)  # two blocks together cover each alone
    with_main = F.when(F.col("in_main"), F.transform(up_to("others"), lambda i: name("m", i, F.col("own_block")))).otherwise(F.transform(up_to("mains"), lambda j: name("m", F.col("own_block"), j)))
    tasks = F.concat(F.when(F.col("in_main"), F.array().cast("array<string>")).otherwise(among), with_main)
    def link_main(table: pa.Table) -> pa.Table:
        """The main group is linked in itself: of each other set one link into it is enough."""
        ids, own, main = table.column("id").to_numpy(), table.column("own"), np.array(table.column("in_main").to_pylist(), bool)
        if main.all() or not main.any():  # a block may be empty
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        ordered, symbols = globally_ordered([_views(x) for x in own])
        trie, inside = Trie(ordered, np.flatnonzero(main)), np.zeros(symbols, bool)
        a, b = [], []
        for x in np.flatnonzero(~main):
            near = trie.linked(ordered[x], inside, percent)
            if len(near):
                a.append(ids[x]), b.append(ids[near[0]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    told = materialize(told.select("id", "in_main", F.col("own_size").alias("size"), tasks.alias("tasks")), "told")
    # how often a set is dealt out grows with its cluster, so this is done in waves of about the sets' own size, each written and its shuffles deleted
    octets, copied, many = told.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("size"), F.col("size") * F.size("tasks"), F.size("tasks")))).first()
    waves = max(1, -(-copied // max(WAVE, octets)))
    other = F.split_part(F.col("task"), F.lit(":"), F.lit(2)) == "r"
    links = star
    for wave in range(waves):
        mine = told.select("id", "in_main", F.filter("tasks", lambda t: F.pmod(F.xxhash64(t, F.lit("wave")), F.lit(waves)) == wave).alias("tasks"))  # noqa: B023
        # tasks are told where the sets lie, so that a set is exchanged by its tasks only
        dealt = sets.join(F.broadcast(mine) if many <= MEMBERS * waves else mine, "id").withColumn("task", F.explode("tasks")).select("task", "id", "component", "own", "in_main")
        among_others = dealt.where(other).groupBy("task").applyInArrow(link, "a long, b long")
        found = among_others.unionByName(dealt.where(~other).groupBy("task").applyInArrow(link_main, "a long, b long"))
        if waves > 1:
            found = materialize(found, "wave")
            release(sets.sparkSession)
        links = links.unionByName(found)
    return links
