"""Near-duplicate documents by MinHash and an LSH forest; every link is confirmed on the full sets of shingles.

1. A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a class, and only
   classes go on, each under the fingerprint of its set.
2. The forest: the signature is cut into TREES pieces of DEPTH values. Each tree sorts all classes by its piece, over
   range partitions. A class's candidates are its neighbours in that order whose common prefix is LEAST or longer: where
   few classes share a prefix, all of them; where many do, the neighbours with the longest common prefixes, and the heads
   of the region and of its deeper parts, which tie a large region together. Rows at partition edges meet in a second step.
3. Candidates are confirmed in two rounds. First every class tries two of its candidates: a head of its regions, and the
   one it met in most trees. Then every other candidate pair whose classes aren't in one component yet is tried, so that
   a group of thousands of near copies costs about two comparisons a copy, and no candidate is given up.
4. Where three classes or more share LEAST values of a tree and aren't all in one component by then, the order alone
   doesn't bring all pairs together. The classes of all such regions are joined exactly: with shingles in order of how
   few of these classes hold them, two sets that overlap enough share one among their first n - need + 1. Texts of one
   template differ in just these, so they meet only where they agree beyond the template.

The trees and LEAST follow from the threshold (``forest``): a pair of similarity 0.8 shares 4 values in one of 16 trees with
a chance of 0.9998.

Cases: null and empty texts, and texts of white space only, have no set and link with nothing; fewer words than a shingle
make one shingle of all words; equal sets are linked; rows that repeat a doc_id are judged each by its own text; a null
doc_id gets the least id of its component, or null; empty tables give empty results. Other columns are carried along,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, packed, tidy, unpacked, written
from .graph import components
from .tokens import each, mixed, shingle_sets

DEPTH, WINDOW = 8, 4
#: Up to this many ids go to all tasks as a filter; beyond it the documents are joined with them.
MOST_BROADCAST = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: The chance that a pair at the threshold shares no tree's prefix, at most, and the trees that this may take.
MISS, MOST_TREES = 2.5e-4, 32


def forest(percent: int) -> tuple[int, int]:
    """How many trees, and how many values of a tree candidates share at least: the more the better, as long as few pairs are missed."""
    p = min(0.999, max(0.05, percent / 100))
    for least in range(4, 0, -1):
        trees = math.ceil(math.log(MISS) / math.log(1 - p**least))
        if trees <= MOST_TREES or least == 1:
            return max(4, trees), least


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = (mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32)
    return base[:count] | np.uint32(1), base[count:]


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima of linear hashes of the shingles' upper halves, big-endian so that bytes sort as numbers do."""
    a, b = _multipliers(count)
    x, low, room = (shingles >> np.uint64(32)).astype(np.uint32), np.full(count, np.iinfo(np.uint32).max, np.uint32), np.empty((min(512, len(shingles)), count), np.uint32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512, None]
        h = np.multiply(part, a, out=room[: len(part)])
        h += b
        np.minimum(low, h.min(axis=0), out=low)
    return low.astype(">u4")


def fingerprint(shingles: np.ndarray) -> bytes:
    size = np.array([len(shingles)], np.uint64)
    return b"".join(int(np.bitwise_xor.reduce(mixed(shingles + k)) ^ mixed(size * _STEP + k)[0]).to_bytes(8, "big") for k in (_STEP, ~_STEP))


def _sketches(words: int, count: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, sigs = [], [], []
            for s in shingle_sets(each(batch.column(1)), words):
                n.append(len(s))
                nodes.append(fingerprint(s) if len(s) else None)
                sigs.append(signature(s, count).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "node", "sig"])

    return sketch


def _planted(trees: int, depth: int) -> Callable:
    """tree, key, node, n: a row a tree for each class."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), f"S{4 * depth}").reshape(-1, trees) if batch.num_rows else np.empty((0, trees), f"S{4 * depth}")
            raw = sig.tobytes()
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth), sig.size, [None, pa.py_buffer(raw)]).cast(pa.binary())
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), trees))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)), keys, batch.column("node").take(repeat), batch.column("n").take(repeat)], ["tree", "key", "node", "n"])

    return plant


def _common_prefix(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row after the first, how many leading values it shares with the row before; -1 across trees."""
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], same, -1)


def neighbour_pairs(tree: np.ndarray, keys: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of candidate pairs in one sorted stretch, and whether the first is the head of a region of the second."""
    n = len(tree)
    shared = _common_prefix(tree, keys) if n > 1 else np.empty(0, int)
    first, second, run = [], [], shared
    for d in range(1, window + 1):
        if d > 1:
            run = np.minimum(run[:-1], shared[d - 1 :])
        i = np.flatnonzero(run >= least)
        first.append(i)
        second.append(i + d)
        if len(i) == 0:
            break
    head = [np.zeros(len(i), bool) for i in first]
    for depth in range(least, keys.shape[1] + 1, 2):
        start = np.concatenate(([True], shared < depth))
        leader = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        i = np.flatnonzero(np.arange(n) > leader)
        i = i if depth == least else i[i - leader[i] > window]
        first.append(leader[i])
        second.append(i)
        head.append(np.full(len(i), depth == least))
    a, b, head = np.concatenate(first), np.concatenate(second), np.concatenate(head)
    pairs, at = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_inverse=True)
    heads = np.zeros(len(pairs), bool)
    np.logical_or.at(heads, at, head)
    return pairs >> 32, pairs & 0xFFFFFFFF, heads


def _scan(depth: int, least: int, window: int, edges: bool, percent: int) -> Callable:
    """Sorted rows to candidate pairs; with ``edges`` also the first and last rows of the partition, as pairs without b."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        names, at, carried = ["part", "at", "tree", "key", "a", "b", "n", "head"], 0, None
        for batch in batches:
            rows = batch if carried is None else pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0] if batch.num_rows else carried
            old = carried.num_rows if carried is not None else 0
            tree = rows.column("tree").to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(-1, depth)
            n = rows.column("n").to_numpy(zero_copy_only=False)
            a, b, head = neighbour_pairs(tree, keys, least, window)
            use = (b >= old) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b, head = a[use], b[use], head[use]
            nodes, none = rows.column("node"), pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(a), pa.int64()), none, pa.nulls(len(a), pa.binary()), nodes.take(pa.array(a)), nodes.take(pa.array(b)), pa.nulls(len(a), pa.int64()), pa.array(head)], names)
            if edges and at == 0 and rows.num_rows:
                yield _edge(rows.slice(0, window), part, 0, names)
            at += rows.num_rows - old
            # what the next batch's rows may meet: the last rows, and the last region's first row at every depth
            shared = _common_prefix(tree, keys) if len(tree) > 1 else np.empty(0, int)
            keep = set(range(max(0, rows.num_rows - window), rows.num_rows))
            for d in range(least, depth + 1):
                cut = np.flatnonzero(shared < d)
                keep.add(int(cut[-1]) + 1 if len(cut) else 0)
            carried = rows.take(pa.array(sorted(k for k in keep if k < rows.num_rows)))
        if edges and carried is not None:
            yield _edge(carried.slice(max(0, carried.num_rows - window)), part, 1 << 40, names)

    return scan


def _edge(rows: pa.RecordBatch, part: int, at: int, names: list[str]) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), rows.column("tree"), rows.column("key"), rows.column("node"), pa.nulls(n, pa.binary()), rows.column("n"), pa.nulls(n, pa.bool_())], names)


def candidate_pairs(classes: DataFrame, trees: int, depth: int, least: int, window: int, percent: int) -> DataFrame:
    """a, b, met, a_heads, b_heads: pairs of classes, in how many trees they met, and whether one headed the other's region. ``classes`` has node, n and sig."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planted = classes.mapInArrow(tidy(_planted(trees, depth)), "tree int, key binary, node binary, n long")
    ordered = planted.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = written(ordered.mapInArrow(tidy(_scan(depth, least, window, True, percent)), "part int, at long, tree int, key binary, a binary, b binary, n long, head boolean"), "neighbours")
    # A partition's last rows and the next one's first rows, dealt out by boundary; empty partitions have none.
    edge = found.where("b IS NULL").select("part", "at", "tree", "key", F.col("a").alias("node"), "n")
    used = [r[0] for r in edge.select("part").distinct().orderBy("part").collect()]
    if len(used) > 1:
        place = F.create_map(*[F.lit(x) for i, p in enumerate(used) for x in (p, i)])[F.col("part")]
        edge = edge.withColumn("boundary", place - F.when(F.col("at") < 1 << 40, 1).otherwise(0))
        met = edge.groupBy("boundary").applyInArrow(_across(depth, least, window, percent), "a binary, b binary, head boolean")
        both = found.where("b IS NOT NULL").select("a", "b", "head").unionByName(met)
    else:
        both = found.where("b IS NOT NULL").select("a", "b", "head")
    ordered_pair = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("head") & (F.col("a") < F.col("b"))).cast("int").alias("a_heads"), (F.col("head") & (F.col("a") > F.col("b"))).cast("int").alias("b_heads"))
    pairs = written(ordered_pair.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("a_heads").alias("a_heads"), F.max("b_heads").alias("b_heads")), "candidates")
    drop_written(found)
    return pairs


def _across(depth: int, least: int, window: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("at", "ascending")])
        part, n = rows.column("part").to_numpy(), rows.column("n").to_numpy()
        keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(-1, depth)
        a, b, head = neighbour_pairs(rows.column("tree").to_numpy(), keys, least, 2 * window)
        use = (part[a] != part[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        node = rows.column("node").combine_chunks()
        return pa.table([node.take(pa.array(a[use])), node.take(pa.array(b[use])), pa.array(head[use])], names=["a", "b", "head"])

    return meet


def _confirm(percent: int) -> Callable:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for pairs of classes, by their full sets."""
    one = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(tidy(_confirm(percent)), "a binary, b binary, linked boolean")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles of the wanted classes (columns node and doc_id, one of the class's documents)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(1).slice(at, 256).to_pylist(), words))
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    chosen = docs.alias("d").join(ids.alias("i"), F.expr("d.doc_id <=> i.doc_id"), "left_semi")
    made = chosen.mapInArrow(tidy(make), "node binary, shingles binary")
    return made.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _partners(pairs: DataFrame) -> DataFrame:
    """For each class two of its pairs: with a head of its regions, and with the class that it met in most trees.

    All classes of a region that take a head take the one with the greatest name, so that a large group hangs together
    after one confirmation a class.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "met", F.col("b_heads").alias("heads")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "met", F.col("a_heads").alias("heads")))
    best = both.groupBy("x").agg(F.max_by("y", F.struct("heads", "y")).alias("hub"), F.max_by("y", F.struct("met", "y")).alias("near"))
    two = best.select("x", F.explode(F.array("hub", "near")).alias("y"))
    return two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_components(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component after two rounds of confirmations; empty if nothing is linked."""
    first = written(_confirmed(_partners(pairs), sets, percent), "confirmed")
    labels = written(components(first.where("linked").select("a", "b")), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    rest = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.withColumn("a_label", F.coalesce("a_label", "a")).withColumn("b_label", F.coalesce("b_label", "b")).where("a_label <> b_label")
    rest = written(rest.select("a", "b", "a_label", "b_label"), "rest")
    second = _confirmed(rest, sets, percent).where("linked").join(rest, ["a", "b"]).select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    second = written(second, "confirmed")
    drop_written(rest)
    out = _merged(labels, second)
    drop_written(first, second, *([labels] if out is not labels else []))
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component of ``labels`` after links a, b between components; a class without a label is its own component."""
    if links.isEmpty():
        return labels
    merged = written(components(links), "merged")
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("final"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    out = written(old.unionByName(merged.join(labels, "node", "left_anti").select("node", "component")), "labels")
    drop_written(merged)
    return out


def _crowded(classes: DataFrame, labels: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """node, doc_id, n, label of the classes in regions of three classes or more that aren't in one component yet."""
    label = F.coalesce("component", "node").alias("label")
    known = written(classes.join(labels, "node", "left").select("node", "doc_id", "n", "sig", label), "labelled")
    prefix = lambda t: F.xxhash64(t, F.substring("sig", t * (4 * depth) + 1, F.lit(4 * least)))
    members = known.select("node", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("region"))
    open_ = members.groupBy("region").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("k > 2 AND low <> high")
    open_ = written(open_.select("region"), "regions")
    few = open_.count() <= MOST_BROADCAST
    inside = members.join(F.broadcast(open_) if few else open_, "region").select("node").distinct()
    out = written(known.select("node", "doc_id", "n", "label").join(inside, "node"), "crowded")
    drop_written(known, open_)
    return out


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, shingle: a row for each shingle of a set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            sets = [np.frombuffer(x.as_py(), np.int64) for x in some.column("shingles")]
            repeat = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([some.column("node").take(pa.array(repeat)), pa.array(np.concatenate(sets))], ["node", "shingle"])


def rare_pairs(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, a_label, b_label: all pairs of these classes that may overlap enough and aren't in one component.

    Shingles are in order of how many of the classes hold them. Two sets of n and m shingles that share ``need`` of them
    share one among the first n - need + 1 of the one and m - need + 1 of the other.
    """
    rows = sets.select("node", "shingles").mapInArrow(tidy(_set_rows), "node binary, shingle long")
    shared = written(rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "shared-shingles")
    place = F.array_sort(F.collect_list(F.struct("held", "shingle")))  # the shingles of one text
    by_class = rows.join(shared, "shingle").groupBy("node").agg(place.alias("own")).join(crowded.select("node", "n", "label"), "node")
    alone = F.col("n") - F.size("own")  # shingles that nothing else holds stand first and meet nothing
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - alone
    postings = by_class.where(first > 0).select("node", "n", "label", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), F.greatest(F.lit(1), first).cast("int"))).alias("at", "s"))
    postings = postings.select("node", "n", "label", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("s.shingle").alias("shingle"))
    postings = written(postings, "rare-shingles")
    mixed = postings.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    postings_here = postings.join(mixed, "shingle")
    a, b = (postings_here.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "label", "left")]) for side in "ab")
    # 100 * both >= percent * (n + m - both), where both is at most what is left from here on of either set
    enough = F.expr(f"a_node < b_node AND a_label <> b_label AND (100 + {percent}) * least(a_left, b_left) >= {percent} * (a_n + b_n)")
    met = a.join(b.withColumnRenamed("shingle", "shingle_b"), (F.col("shingle") == F.col("shingle_b")) & enough)
    out = written(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_label", "b_label").distinct(), "rare-pairs")
    drop_written(shared, postings)
    return out


def joined_regions(docs: DataFrame, classes: DataFrame, labels: DataFrame, words: int, percent: int, trees: int, depth: int, least: int) -> DataFrame:
    """``labels`` after all pairs of crowded regions have been compared."""
    crowded = _crowded(classes, labels, trees, depth, least)
    if crowded.isEmpty():
        drop_written(crowded)
        return labels
    sets = written(_full_sets(docs, crowded.select("node", "doc_id"), words), "sets")
    pairs = rare_pairs(crowded, sets, percent)
    links = written(_confirmed(pairs, sets, percent).where("linked").join(pairs, ["a", "b"]).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "confirmed")
    out = _merged(labels, links)
    drop_written(crowded, sets, pairs, links)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", trees: int | None = None, depth: int = DEPTH, least: int | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents whose sets overlap in ``percent`` of their union or more are linked; component_id is the least doc_id that
    links lead to, and the document with that id is kept. The forest's size follows from ``percent`` unless it is given.
    """
    trees, least = trees or forest(percent)[0], least or forest(percent)[1]
    pairs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketches = written(pairs.mapInArrow(tidy(_sketches(words, trees * depth)), "doc_id long, n long, node binary, sig binary"), "sketches")
    classes = written(sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("sig").alias("sig")), "classes")
    candidates = candidate_pairs(classes, trees, depth, least, window, percent)
    wanted = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
    wanted = written(classes.select("node", "doc_id").join(wanted, "node"), "wanted")
    sets = written(_full_sets(pairs, wanted, words), "sets")
    none = classes.sparkSession.createDataFrame([], "node binary, component binary")
    first = none if candidates.isEmpty() else linked_components(candidates, sets, percent)
    drop_written(sets, wanted, candidates)
    labels = joined_regions(pairs, classes, first, words, percent, trees, depth, least)
    named = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = written(named.join(least_id, "component").select("node", "component_id"), "components")
    drop_written(classes, first, labels)
    out = sketches.select("doc_id", "n", "node").join(of_class, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return keeps(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept")), sketches, of_class)


def near_unique(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns: one row of each group, the one with the least doc_id.

    Each row is judged by its own text, also where rows share an id or have none; of rows alike in a group one stays.
    """
    rows = written(packed(docs, rid=F.monotonically_increasing_id(), doc_id=F.col(f"`{doc_id}`").cast("long"), text=F.col(f"`{text}`").cast("string")), "rows")
    found = near_duplicates(rows.select("rid", "text"), words, percent, "rid", "text")
    groups = found.where("component_id IS NOT NULL").select(F.col("doc_id").alias("rid"), "component_id")
    groups = written(groups.join(groups.where("rid <> component_id").select("component_id").distinct(), "component_id", "left_semi"), "groups")
    drop_written(found)
    named = groups.join(rows.select("rid", "doc_id"), "rid")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    gone = written(named.join(first, "component_id").where("rid <> first.rid").select("rid"), "gone")
    drop_written(groups)
    few = gone.count() <= MOST_BROADCAST
    return keeps(unpacked(rows.select("row", "rid").join(F.broadcast(gone) if few else gone, "rid", "left_anti")), rows, gone)
