"""Similarity join on word shingles by count vectors, complete at its threshold.

A document is the set of its distinct shingles. Hashed into groups, its group counts are a point; the overlap of two
documents is at most the sum of their coordinate minima, and of a document and a node of an R-tree at most the sum of
the minima with the node's upper corner. Which documents meet in a tree follows from groups as well: documents of a size
level that are similar enough differ in at most k shingles, so among more than k groups some have the same shingles in
both (a bucket).

1. Documents with equal sets are one class, stood for by its smallest doc_id.
2. In each bucket, one leader's point is held against the others' points, and what the bound leaves is verified.
3. Buckets that this leaves in several components get R-trees of count vectors over all their members; members outside the
   largest component search them, what the bound leaves is verified on the spot, and links come out only where they join
   components. Buckets that overlap are searched as one where that moves fewer rows. Large ones are cut into blocks, and
   each pair of blocks is a tree search of its own.
4. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, saved, sweep
from .graph import components

GROUPS, FAN = 64, 16
#: Members of a leader verified together; members and shingles of a block of a bucket.
GROUP, BLOCK, BLOCK_SHINGLES = 200, 1000, 1_000_000
#: Rows up to which a table of ids (two or three longs a row) is broadcast; larger ones are joined by shuffle.
SMALL = 200_000
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
A, B, C, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; keeps the hashes of words seen."""

    def __init__(self, width: int):
        self.width, self.known = width, WordHashes()
        #: An odd factor for each place in a shingle.
        self.factors = [np.uint64(pow(int(A), k + 1, 1 << 64)) for k in range(width)]

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 300_000:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        size = len(h) - width + 1
        out = h[:size] * self.factors[0]
        for k in range(1, width):
            out += h[k : size + k] * self.factors[k]
        out = _mix(out + np.uint64(width))
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def level(n: int) -> tuple[int, int, int]:
    """The size level of n: its number, least and greatest size. Levels grow by half."""
    number, low = 0, 1
    while True:
        high = max(low, low * 3 // 2 - 1)
        if n <= high:
            return number, low, high
        number, low = number + 1, high + 1


def signatures(shingles: np.ndarray, percent: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """Of each group of the set's level, and of the next one if a set there can be similar: a hash of the level, the group
    and its content. Sets that must be equal to be similar have none.

    Similar sets of a level differ in at most k shingles. Of k + 1 + spare groups, spare + 1 have the same content in both;
    where one set has at most `spare` empty groups, one of these is not empty. So empty groups, which unlike sets would
    share, get a signature only in sets that have more than `spare` of them.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    number, _, high = level(n)
    schemes = [(number, high)]
    if 100 * n >= percent * (high + 1):
        schemes.append((number + 1, level(high + 1)[2]))
    mixed = _mix(shingles + C) if mixed is None else mixed
    out = []
    for which, most in schemes:
        k = 2 * most * (100 - percent) // (100 + percent)
        if not k:
            continue
        spare = 1 + k // 8
        groups = k + 1 + spare
        of = ((shingles >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
        sums = np.zeros(groups, np.uint64)
        np.add.at(sums, of, mixed)
        own = _mix(sums * A + np.arange(groups, dtype=np.uint64) * B + np.uint64((which + 1) * int(C) & (1 << 64) - 1))
        filled = np.bincount(of, minlength=groups) > 0
        out.append(own if groups - filled.sum() > spare else own[filled])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def needed(a, b, percent: int):
    """The least overlap of similar sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def point(shingles: np.ndarray) -> np.ndarray:
    """The counts of a set by group."""
    return np.bincount((shingles >> np.uint64(8)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)


class CountTree:
    """An R-tree of count vectors, packed level by level: points sorted by size and first counts, FAN to a node, FAN nodes
    to a node above, up to one root. A node knows its upper corner and its least and greatest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], np.round(np.log(np.maximum(sizes, 1)) * 8)))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            upper, least, most = self.levels[-1]
            begins = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(upper, begins), np.minimum.reduceat(least, begins), np.maximum.reduceat(most, begins)))

    def near(self, at: np.ndarray, n: int, percent: int) -> np.ndarray:
        """The points that can be similar to one of n elements, as far as sizes and summed minima tell."""
        nodes = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            upper, least, most = self.levels[k]
            low, high = np.maximum(least[nodes], -(-percent * n // 100)), most[nodes]
            bound = np.minimum(upper[nodes], at).sum(axis=1)
            nodes = nodes[(low <= high) & (100 * n >= percent * low) & (bound >= needed(n, low, percent))]
            if k:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).reshape(-1)
                nodes = nodes[nodes < len(self.levels[k - 1][1])]
        return self.order[nodes]


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set `one` each of the other sets has."""
    every = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    return np.add.reduceat(found.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def spanning_links(sets: list[np.ndarray], labels: list, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of left x right that are similar, as many as join what the labels (components) hold apart: after them,
    any two similar rows are connected."""
    sizes = np.array([len(x) for x in sets])
    points = np.array([point(x) for x in sets])
    tree, up, out = CountTree(points[right], sizes[right]), {}, []

    def root(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    for i in left:
        own = root(labels[i])
        near = [int(j) for j in right[tree.near(points[i], int(sizes[i]), percent)] if root(labels[j]) != own]
        for start in range(0, len(near), FAN * FAN):
            some = near[start : start + FAN * FAN]
            both = overlaps(sets[i], [sets[j] for j in some])
            for j in np.array(some)[100 * both >= percent * (sizes[i] + sizes[some] - both)].tolist():
                x, y = root(labels[i]), root(labels[j])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((int(i), j))
    return out


def _features(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep()
        shingler = Shingler(width)
        for batch in batches:
            n, c1, c2, sigs = [], [], [], []
            for raw in batch.column(1):
                s = shingler(raw.as_py())
                n.append(len(s))
                mixed = _mix(s + C)
                c1.append(total(s))
                c2.append(total(mixed))
                sigs.append(signatures(s, percent, mixed).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n", "c1", "c2", "sigs"])

    return rows.mapInArrow(of, "doc_id long, n long, c1 long, c2 long, sigs array<long>")


def total(shingles: np.ndarray) -> int:
    return int(shingles.sum(dtype=np.uint64).astype(np.int64))


def _texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """wanted (with a column id) with the texts of those ids. Few are broadcast, more are joined by shuffle."""
    small = wanted.count() <= SMALL
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(wanted) if small else wanted, "id")


def _led(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, own_a, b, own_b) of a member and its leader, with their classes, the similar ones (a, b), on whole
    texts. A leader of many members is dealt over salts, GROUP members each."""
    many = saved(pairs.groupBy("own_b").agg(F.ceil(F.count("*") / GROUP).alias("salts")).where("salts > 1"))
    few = many.count() <= SMALL
    salted = pairs.join(F.broadcast(many) if few else many, "own_b", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int"))
    roles = saved(salted.select(F.col("a").alias("id"), F.col("own_a").alias("own"), "own_b", "salt").union(salted.select("b", "own_b", "own_b", "salt")).distinct())

    def of(got: pa.Table) -> pa.Table:
        shingler, leader = Shingler(width), got["own_b"][0].as_py()
        sets: dict[int, np.ndarray] = {}
        ids: dict[int, int] = {}
        for i, own, raw in zip(got["id"].to_pylist(), got["own"].to_pylist(), got["text"]):
            s = shingler(raw.as_py())
            if total(s) == own:  # another text of the same id is another class
                sets[own], ids[own] = s, i
        lead, found = sets.pop(leader, np.zeros(0, np.uint64)), []
        at = point(lead)
        near = [x for x, s in sets.items() if np.minimum(at, point(s)).sum() >= needed(len(lead), len(s), percent)]
        if near and len(lead):
            both = overlaps(lead, [sets[x] for x in near])
            found = [ids[x] for x, o in zip(near, both.tolist()) if 100 * o >= percent * (len(lead) + len(sets[x]) - o)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([ids.get(leader)] * len(found), pa.int64())})

    return saved(_texts(docs, roles, doc_id, text).groupBy("own_b", "salt").applyInArrow(of, "a long, b long"))


def _several(members: DataFrame, unit: str) -> DataFrame:
    """Of units (buckets or clusters) of several components: the largest one (top), blocks of the members outside it (xs) and
    of all members (ys), the rows that their search moves, and 128 bits that tell their members. Units of two are left out:
    their one pair is that of member and leader."""
    held = members.groupBy(unit, "component").agg(F.count("*").alias("held"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("own")).alias("x1"), F.bit_xor(F.xxhash64("own", F.lit(1))).alias("x2"))
    sizes = held.groupBy(unit).agg(F.sum("held").alias("n_members"), F.sum("size").alias("n_size"), F.max(F.struct("held", "size", "component")).alias("top"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).where("n_members > top.held and n_members > 2")
    cut = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    outer = F.col("n_members") - F.col("top.held")
    sizes = sizes.withColumns({"xs": cut(outer, F.col("n_size") - F.col("top.size")), "ys": cut(F.col("n_members"), F.col("n_size")), "outer": outer})
    moved = F.col("n_members") * F.col("xs") + F.col("outer") * (F.col("ys") - 1)
    return sizes.select(unit, F.col("top.component").alias("top"), "xs", "ys", moved.alias("moved"), "n_members", "x1", "x2")


def _units(members: DataFrame) -> DataFrame:
    """(unit, own, rep, component, top, xs, ys): what is searched together. Similar documents share most of their groups, so
    buckets overlap: of those with the same members one is enough, and those that hang together by members are one unit (a
    cluster) where its search moves no more rows than theirs apart. Both hold every pair of a bucket."""
    alike = _several(members, "sig").groupBy("n_members", "x1", "x2").agg(F.min(F.struct("sig", "top", "xs", "ys", "moved")).alias("of"))
    rows = saved(members.join(alike.select("of.*"), "sig"))
    clusters = components(rows.select(F.col("own").alias("a"), F.col("lead").alias("b")).distinct())
    placed = saved(rows.join(clusters.select(F.col("node").alias("own"), F.col("component").alias("cluster")), "own"))
    each = saved(placed.select("cluster", "own", "rep", "n", "component").distinct())
    apart = placed.select("cluster", "sig", "moved").distinct().groupBy("cluster").agg(F.sum("moved").alias("apart"))
    merged = saved(_several(each, "cluster").join(apart, "cluster").where("moved <= apart").select("cluster", "top", "xs", "ys"))
    columns = ["own", "rep", "component", "top", "xs", "ys"]
    together = each.join(merged, "cluster").select(F.col("cluster").alias("unit"), *columns)
    return together.unionByName(placed.join(merged, "cluster", "left_anti").select(F.col("sig").alias("unit"), *columns))


def _across(docs: DataFrame, members: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components of members (sig, lead, rep, own, component, n) of one bucket. The largest
    component of a unit is searched but does not search."""
    rows = _units(members).withColumn("outer", F.col("component") != F.col("top"))
    rows = rows.withColumn("x0", F.pmod(F.xxhash64("own"), F.col("xs")).cast("int")).withColumn("y0", F.pmod(F.xxhash64("own", F.lit(2)), F.col("ys")).cast("int"))
    searched = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda x: F.struct(x.alias("x"), F.col("y0").alias("y"), (F.col("outer") & (x == F.col("x0"))).alias("left"), F.lit(True).alias("right")))
    searching = F.transform(F.filter(F.sequence(F.lit(0), F.col("ys") - 1), lambda y: F.col("outer") & (y != F.col("y0"))), lambda y: F.struct(F.col("x0").alias("x"), y.alias("y"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    tasks = rows.select("unit", "rep", "own", "component", F.explode(F.concat(searched, searching)).alias("at")).select("unit", F.col("rep").alias("id"), "own", "component", "at.*")

    def of(got: pa.Table) -> pa.Table:
        shingler, sets, at = Shingler(width), [], []
        for k, (own, raw) in enumerate(zip(got["own"].to_pylist(), got["text"])):
            s = shingler(raw.as_py())
            if total(s) == own:
                sets.append(s)
                at.append(k)
        place = np.array(at, np.int64)
        left, right = (np.flatnonzero(got[side].to_numpy()[place]) if len(place) else place for side in ("left", "right"))
        ids, labels = got["id"].to_numpy(), got["component"].to_numpy()[place].tolist() if len(place) else []
        links = spanning_links(sets, labels, left, right, percent) if len(left) and len(right) else []
        return pa.table({"a": pa.array([int(ids[at[i]]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[at[j]]) for _, j in links], pa.int64())})

    # The key spreads the pairs of blocks of one unit over tasks. Units of equal keys are treated together.
    keyed = saved(tasks.withColumn("key", F.xxhash64("unit", "x", "y")))
    return saved(_texts(docs, keyed, doc_id, text).groupBy("key", "x", "y").applyInArrow(of, "a long, b long"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has doc_id, n_shingles and component_id of each row of docs; links the verified pairs (a, b) of
    class representatives from which the components follow.

    A to Z in lower case; words between ASCII white space; fewer words than `width` are one shingle, none an empty set
    that links with nothing (its component is itself). Linked when 100 * intersection >= percent * union. Null texts
    count as empty; rows with a null doc_id get a component only through equal sets; repeated rows repeat; rows of one
    doc_id and different texts are judged each by its own text. doc_id is a whole number. Extra columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = saved(_features(docs, doc_id, text, width, percent))
    salted = rows.where("n > 0").groupBy("c1", "c2", "n", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))).cast("int").alias("salt")).agg(F.min("doc_id").alias("rep"))
    classes = saved(salted.groupBy("c1", "c2", "n").agg(F.min("rep").alias("rep"), F.collect_set("salt").alias("salts")))

    named = classes.where("rep is not null").select(F.col("c1").alias("own"), "rep", "n")
    # Of a class only its representative is looked up, so copies, however many, put one row in a bucket.
    chosen = named.select(F.col("rep").alias("doc_id"), F.col("own").alias("c1"))
    bags = rows.join(chosen, ["doc_id", "c1"], "left_semi").select(F.col("c1").alias("own"), F.explode("sigs").alias("sig"))
    shared = saved(bags.groupBy("sig").agg(F.min("own").alias("lead"), F.max("own").alias("last")).where("lead <> last").select("sig", "lead"))
    members = saved(bags.join(shared, "sig").distinct().join(named, "own").select("sig", "lead", "own", "rep", "n"))
    leads = named.select(F.col("own").alias("lead"), F.col("rep").alias("b"), F.col("n").alias("lead_n"))
    close = (F.col("own") != F.col("lead")) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
    first = members.select("lead", "own", "rep", "n").distinct().join(leads, "lead").where(close)
    links = _led(docs, saved(first.select(F.col("rep").alias("a"), F.col("own").alias("own_a"), "b", F.col("lead").alias("own_b"))), doc_id, text, width, percent)

    found = components(links).withColumnRenamed("node", "rep")
    told = saved(members.select("sig", "lead", "own", "rep", "n").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    links = links.unionByName(_across(docs, told, doc_id, text, width, percent))

    last = components(links).withColumnRenamed("node", "rep")
    whole = classes.join(last, "rep", "left").select("c1", "c2", "n", F.explode("salts").alias("salt"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.select("doc_id", "n", "c1", "c2", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))).cast("int").alias("salt"))
    out = keyed.join(whole, ["c1", "c2", "n", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), links


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that have their component's id, with all their columns."""
    rows, _ = similar(docs, doc_id, text, **options)
    gone = saved(rows.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")))
    small = gone.count() <= SMALL
    return docs.join(F.broadcast(gone) if small else gone, docs[doc_id] == gone["_gone"], "left_anti")
