"""Near-duplicate vectors by random-hyperplane sign hashing in several tables; every link is confirmed by its exact cosine.

1. Equal vectors form a class, and only classes go on, each under a digest of its vector.
2. Balls: groups of near copies, which would meet in every table, are tied together first. In rounds, over ever finer
   buckets of signs, each bucket offers one class as a pivot, and classes within half the threshold's angle of it join its
   ball. Two members of a ball are linked by the triangle inequality, so that a ball of n members costs n cosines and its
   links are counted, not listed. A class in no ball is a unit of its own.
3. Tables: each unit goes to the bucket of each of its members' signs, in as many tables as the wanted recall needs for
   the number of classes. Units that share a bucket and whose further 256 signs don't rule the threshold out are
   candidates. A crowded bucket is cut into blocks of units, and tasks take pairs of blocks.
4. The candidates' pivots are compared exactly. For two single classes that is the result; two balls are linked altogether,
   or not at all, if their radii leave no doubt. Balls in doubt are compared member by member, in blocks of vectors, and
   send back a count for each member.
5. Links between units are merged into components by alternating stars.

A pair at the threshold is found with a chance of about ``recall``, a closer one with a higher chance; links are exact. The
cosine is the product of two vectors over the product of their lengths, in double precision.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, link with
nothing, are their own component and are kept; a shorter vector counts as padded with zeros; equal vectors are linked, rows that
repeat an id are judged each by their own vector; an empty table gives an empty result. Columns other than the two named
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, tidy, written
from .graph import components
from .vector_search import complete

SKETCH, BLOCK, MOST_BROADCAST_BYTES, SLACK, SEED = 256, 512, 32 << 20, 1e-7, 17
PAIRS_AT_ONCE = 1 << 21
ROUND_BITS = 4  # each round of balls cuts the buckets of the one before by so many signs


def tables_for(bits: int, least: float, recall: float) -> int:
    """Tables of ``bits`` signs in which a pair of cosine ``least`` meets at least once with a chance of ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.acos(least) / math.pi) ** bits)))


def hyperplanes(width: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(seed)).standard_normal((width, count))


def most_apart(angle: float) -> int:
    """Signs of SKETCH that differ between vectors at this angle, but for a chance of about a thousand millionth."""
    p = min(angle / math.pi, 0.5)
    return math.floor(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def doubles(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a binary column, each scaled by a power of two so that no square overflows or vanishes."""
    out = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)
    return out * np.ldexp(1.0, -np.frexp(np.abs(out).max(axis=1, initial=0))[1])[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _digested(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, node, vector: the vector as doubles padded to ``width``, and its digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False) + 0.0  # no minus zero
            rows, ends, held = np.zeros((len(sizes), width)), np.cumsum(sizes), []
            for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                rows[i, : b - a] = flat[a:b]
                held.append(rows[i].tobytes() if rows[i].any() else None)
            nodes = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(held, pa.binary())], ["vec_id", "node", "vector"])

    return digest


def _signed(width: int, tables: int, bits: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, sketch, keys: SKETCH signs, and the signs of each table as a number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, power = hyperplanes(width, SKETCH + tables * bits, seed), np.int64(1) << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                side = doubles(part.column(1), width) @ normals >= 0
                sketch = [r.tobytes() for r in np.packbits(side[:, :SKETCH], axis=1)]
                keys = side[:, SKETCH:].reshape(-1, tables, bits) @ power
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sketch, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "sketch", "keys"])

    return sign


def _inside(width: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, ball, radius of the classes within half the threshold's angle of their bucket's pivot."""
    most = math.acos(least) / 2 - SLACK

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = angles(cosines(doubles(batch.column("vector"), width), doubles(batch.column("pivot"), width))) if batch.num_rows else np.empty(0)
            use = pa.array(np.flatnonzero(apart <= most))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(use), batch.column("ball").take(use), pa.array(apart[use.to_numpy()])], ["node", "ball", "radius"])

    return near


def balls(classes: DataFrame, width: int, bits: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """node, ball, radius of the classes that share a ball with others, and the tables to drop with it."""
    found: list[DataFrame] = []
    for round_, depth in enumerate(range(ROUND_BITS, bits + 1, ROUND_BITS)):
        key = F.shiftright(F.get("keys", F.lit(0)), bits - depth).alias("key")
        loose = classes.select("node", "vector", key)
        for before in found:
            loose = loose.join(before.select("node"), "node", "left_anti")
        chosen = F.max(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), F.col("node").alias("ball"), F.col("vector").alias("pivot"))).alias("best")
        pivots = loose.groupBy("key").agg(chosen, F.count("*").alias("n")).where("n > 1").select("key", "best.ball", "best.pivot")
        small = (8 * width + 64) << depth <= MOST_BROADCAST_BYTES
        met = loose.join(F.broadcast(pivots) if small else pivots, "key").select("node", "vector", "ball", "pivot").mapInArrow(tidy(_inside(width, least)), "node binary, ball binary, radius double")
        found.append(written(met.join(met.where("node <> ball").select("ball").distinct(), "ball", "left_semi"), "balls"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, found


class _flat_units:
    """A column of lists of units, one after the other; a null list has no units."""

    def __init__(self, lists: pa.ListArray):
        self.sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        rows = lists.flatten()
        self.units = np.array(rows.field("unit").to_pylist(), object)
        self.many = rows.field("many").to_numpy(zero_copy_only=False).astype(np.int64)
        self.sketches = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), "<u8").reshape(-1, SKETCH // 64)


def _stretches(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes, with these running sums, add up to about ``most``; a larger row alone."""
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def _candidates(angle: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of units of two blocks of a bucket whose sketches leave the threshold possible."""
    # a sketch stands for a ball with any of its members: each ball widens what may be by its diameter
    most = np.array([most_apart(angle), most_apart(2 * angle), most_apart(3 * angle)])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_flat_units(batch.column(c)) for c in ("own", "other"))
            alone = b.sizes == 0  # a block within itself
            n, m = a.sizes, np.where(alone, a.sizes, b.sizes)
            ends = np.cumsum(n * m)
            for low, high in _stretches(ends, PAIRS_AT_ONCE):
                own = np.repeat(np.arange(low, high), (n * m)[low:high])
                at = np.arange(len(own)) - (ends - n * m - (ends - n * m)[low])[own]
                i, j = at // m[own], at % m[own]
                use = ~alone[own] | (i > j)
                own, i, j = own[use], i[use], j[use]
                for self_, x, y in ((True, a, a), (False, a, b)):
                    here = alone[own] == self_
                    p, q = x.starts[own[here]] + i[here], y.starts[own[here]] + j[here]
                    near = np.bitwise_count(x.sketches[p] ^ y.sketches[q]).sum(axis=1, dtype=np.int32) <= most[x.many[p] + y.many[q]]
                    u, v = x.units[p[near]], y.units[q[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(u < v, u, v), pa.binary()), pa.array(np.where(u < v, v, u), pa.binary())], ["u", "v"])

    return pair


def candidate_pairs(signs: DataFrame, angle: float) -> DataFrame:
    """u, v: pairs of units that share a bucket. ``signs`` has unit, many (is it a ball), sketch and keys."""
    rows = signs.select("unit", "many", "sketch", F.posexplode("keys").alias("table", "key"))
    units = rows.groupBy("table", "key", "unit").agg(F.min("many").alias("many"), F.min("sketch").alias("sketch"))
    stored = written(units, "buckets")
    crowd = stored.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = stored.join(crowd, ["table", "key"]).withColumn("of", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("of")))
    blocks = blocks.groupBy("table", "key", "of", "block").agg(F.collect_list(F.struct("unit", "many", "sketch")).alias("own"))
    blocks = written(blocks, "blocks")  # about BLOCK units each
    apart = blocks.where("of > 1")
    across = apart.alias("a").join(apart.alias("b"), F.expr("a.table = b.table AND a.key = b.key AND a.block < b.block"))
    both = blocks.select("own", F.lit(None).cast(blocks.schema["own"].dataType).alias("other")).unionByName(across.select("a.own", F.col("b.own").alias("other")))
    out = written(both.mapInArrow(tidy(_candidates(angle)), "u binary, v binary").distinct(), "candidates")
    drop_written(stored, blocks)
    return out


def _decided(width: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """u, v, whole: the pairs that are linked altogether (true), or whose members must tell (false)."""
    most = math.acos(least)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = cosines(doubles(batch.column("x"), width), doubles(batch.column("y"), width))
            reach = batch.column("ru").to_numpy(zero_copy_only=False) + batch.column("rv").to_numpy(zero_copy_only=False)
            single, apart = reach == 0, angles(cosine)
            whole = np.where(single, cosine >= least, apart + reach <= most - SLACK)
            doubt = ~single & ~whole & (apart - reach <= most + SLACK)
            use = pa.array(np.flatnonzero(whole | doubt))
            yield pa.RecordBatch.from_arrays([batch.column("u").take(use), batch.column("v").take(use), pa.array(whole).take(use)], ["u", "v", "whole"])

    return decide


def _compared(width: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """u, v, node, links: for each member of two blocks how many rows of the other block it is linked with."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                x, y = (doubles(pa.array([m["vector"] for m in row[c]], pa.binary()), width) for c in ("a", "b"))
                long = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, y)]
                linked = (x @ y.T) / (long[0][:, None] * long[1][None, :]) >= least
                links = np.concatenate((linked @ np.array([m["n"] for m in row["b"]]), np.array([m["n"] for m in row["a"]]) @ linked))
                nodes = [m["node"] for m in row["a"]] + [m["node"] for m in row["b"]]
                use = np.flatnonzero(links)
                same = lambda c: pa.array([row[c]] * len(use), pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("u"), same("v"), pa.array([nodes[k] for k in use], pa.binary()), pa.array(links[use].astype(np.int64))], ["u", "v", "node", "links"])

    return compare


def _members(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """unit, members: the wanted units' classes in blocks of about BLOCK."""
    held = classes.join(wanted, "unit")
    sized = held.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK).alias("of"))
    block = F.pmod(F.xxhash64("node"), F.col("of")).alias("block")
    return held.join(sized, "unit").groupBy("unit", block).agg(F.collect_list(F.struct("node", "n", "vector")).alias("members")).select("unit", "members")


def near_vectors(table: DataFrame, least: float = 0.9, recall: float = 0.97, vec_id: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links) and kept of every row."""
    angle = math.acos(least)
    v, own_id = F.col(f"`{vector}`"), F.col(f"`{vec_id}`").cast("long").alias("vec_id")
    usable = complete(v) & F.col(f"`{vec_id}`").isNotNull() & (F.size(v) > 0)
    width = table.where(usable).agg(F.max(F.size(v))).first()[0] or 0
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    unusable = table.where(~F.coalesce(usable, F.lit(False))).select(own_id)
    if not width:
        return alone(unusable)
    read = written(table.where(usable).select(own_id, v.cast("array<double>").alias("v")).mapInArrow(tidy(_digested(width)), "vec_id long, node binary, vector binary"), "vectors")
    one = read.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
    bare = written(one, "classes")
    bits = min(62, max(8, math.ceil(math.log2(bare.count() + 1)) - 1))
    tables = tables_for(bits, least, recall)
    signs = bare.select("node", "vector").mapInArrow(tidy(_signed(width, tables, bits, seed)), "node binary, sketch binary, keys array<long>")
    signs = written(signs, "signs")
    in_balls, ball_tables = balls(bare.join(signs.select("node", "keys"), "node"), width, bits, least)
    unit = F.coalesce("ball", "node").alias("unit")
    classes = written(bare.join(in_balls, "node", "left").select("node", "n", "least_id", "vector", unit, F.coalesce("radius", F.lit(0.0)).alias("radius"), F.col("ball").isNotNull().alias("many")), "classes")
    pairs = candidate_pairs(classes.select("node", "unit", "many").join(signs, "node"), angle)
    units = classes.groupBy("unit").agg(F.max("radius").alias("radius"), F.sum("n").alias("rows"), F.min("least_id").alias("least_id"), F.max(F.when(F.col("node") == F.col("unit"), F.col("vector"))).alias("vector"))
    units = written(units, "units")
    side = lambda c, r, x: units.select(F.col("unit").alias(c), F.col("radius").alias(r), F.col("vector").alias(x))
    decided = pairs.join(side("u", "ru", "x"), "u").join(side("v", "rv", "y"), "v").select("u", "v", "ru", "rv", "x", "y")
    decided = written(decided.mapInArrow(tidy(_decided(width, least)), "u binary, v binary, whole boolean"), "decided")
    wholly = decided.where("whole").select("u", "v")
    doubtful = decided.where("NOT whole").select("u", "v")
    ends = doubtful.select(F.explode(F.array("u", "v")).alias("unit")).distinct()
    blocks = written(_members(classes, ends), "members")
    of = lambda c, m: blocks.select(F.col("unit").alias(c), F.col("members").alias(m))
    met = doubtful.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(tidy(_compared(width, least)), "u binary, v binary, node binary, links long")
    met = written(met.groupBy("u", "v", "node").agg(F.sum("links").alias("links")), "met")
    edges = wholly.unionByName(met.select("u", "v").distinct())
    labels = written(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("unit"), "component"), "labels")
    labelled = units.select("unit", "rows", "least_id").join(labels, "unit", "left").select("unit", "rows", "least_id", F.coalesce("component", "unit").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    rows_of = units.select(F.col("unit").alias("other"), "rows")
    by_unit = wholly.unionByName(wholly.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias("unit"), F.col("v").alias("other")).join(rows_of, "other").groupBy("unit").agg(F.sum("rows").alias("unit_links"))
    of_unit = labelled.join(smallest, "component").join(by_unit, "unit", "left").select("unit", "component_id", (F.col("rows") - 1 + F.coalesce("unit_links", F.lit(0))).alias("unit_links"))
    by_node = met.groupBy("node").agg(F.sum("links").alias("links"))
    facts = classes.select("node", "unit").join(of_unit, "unit").join(by_node, "node", "left").select("node", "component_id", (F.col("unit_links") + F.coalesce("links", F.lit(0))).alias("n_links"))
    facts = written(facts, "facts")
    drop_written(bare, signs, *ball_tables, classes, pairs, units, decided, blocks, met, labels)
    out = read.select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return keeps(out.unionByName(alone(unusable)).unionByName(alone(read.where("node IS NULL"))), read, facts)
