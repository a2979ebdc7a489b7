"""Nearest neighbours, agreement of neighbourhoods, matches, theta joins on the sphere, k-subsets, regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratascope.folders import stored
from stratascope.functions.geometry import great_circle_km


def _packed(vectors: DataFrame, block: int, *ids: str) -> DataFrame:
    """size, v and the ids, as bytes: rows of (ids, v) in blocks of ``block`` at most, a block a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                own = batch.slice(low, block)
                flat = own.column("v").flatten()
                if own.column("v").null_count or flat.null_count:
                    raise ValueError("a vector is missing or lacks a component")
                parts = [own.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes() for c in ids]
                parts.append(flat.to_numpy(zero_copy_only=False).astype(np.float64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([own.num_rows]), *[pa.array([x], pa.binary()) for x in parts]], ["size", *ids, "v"])

    return vectors.select(*ids, "v").mapInArrow(pack, f"size long, {', '.join(f'{c} binary' for c in ids)}, v binary")


class _Unit:
    """A block of vectors: as they are, and of length one in single precision; those without a length are marked."""

    def __init__(self, size: int, v: bytes):
        self.v = np.frombuffer(v).reshape(size, -1)
        length = np.linalg.norm(self.v, axis=1)
        self.odd = ~(np.isfinite(length) & (length > 0))
        self.unit = np.divide(self.v, length[:, None], out=np.zeros_like(self.v), where=~self.odd[:, None]).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows to nine digits, summed component by component, as the SQL sums them; NaN where a length is zero."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot, left, right = dot + x * y, left + x * x, right + y * y
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.clip(dot / np.sqrt(left * right), -1.0, 1.0) * 1e9
        whole = np.trunc(s)
        return (whole + np.sign(s) * (np.abs(s - whole) >= 0.5)) / 1e9


def _first(row: np.ndarray, other: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k first by falling s and rising other; NaN is above all, as in an ORDER BY."""
    order = np.lexsort((other, -np.where(np.isnan(s), np.inf, s), row))
    row, other, s = row[order], other[order], s[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], other[place < k], s[place < k]


def _nearest(k: int, at_once: int = 1 << 21):
    """rep, other, similarity: each query's k nearest of the points that meet it here."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = asks = reps = None
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(reps[best[0]]), pa.array(best[1]), pa.array(best[2])], ["rep", "other", "similarity"])

        for batch in batches:
            for q_size, q_rep, q_v, size, ids, v in zip(*[batch.column(c) for c in ("q_size", "q_rep", "q_v", "size", "id", "v")]):
                if own != q_rep.as_py():
                    if own is not None:
                        yield found()
                    own, asks = q_rep.as_py(), _Unit(q_size.as_py(), q_v.as_py())
                    reps, best = np.frombuffer(own, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                points, other = _Unit(size.as_py(), v.as_py()), np.frombuffer(ids.as_py(), np.int64)
                slack = np.float32((asks.v.shape[1] + 16) * 2.0**-22)  # beyond what single precision can be off
                step = max(1, at_once // len(other))
                for low in range(0, len(reps), step):
                    high = min(low + step, len(reps))
                    s = asks.unit[low:high] @ points.unit.T
                    s[asks.odd[low:high]], s[:, points.odd] = np.inf, np.inf
                    last = np.full(high - low, -np.inf, np.float32)
                    a, b = np.searchsorted(best[0], [low, high])
                    held = np.bincount(best[0][a:b] - low, minlength=high - low)
                    full = np.flatnonzero(held == k)
                    if len(full):
                        kth = best[2][a:b][np.cumsum(held)[full] - 1]
                        last[full] = np.where(np.isnan(kth), np.inf, kth)
                    if (held < k).any() and len(other) > k:  # nothing to go by yet
                        last = np.maximum(last, np.partition(s, len(other) - k, axis=1)[:, len(other) - k])
                    p, q = np.nonzero(s >= (last - slack)[:, None])
                    for begin in range(0, len(p), at_once):  # where nearly all are alike, a part at a time
                        pp, qq = p[begin : begin + at_once], q[begin : begin + at_once]
                        a, b = np.searchsorted(best[0], [low, high])
                        new = (pp + low, other[qq], _cosines(asks.v[pp + low], points.v[qq]))
                        kept = _first(*[np.concatenate([x[a:b], y]) for x, y in zip(best, new)], k)
                        best = tuple(np.concatenate([x[:a], y, x[b:]]) for x, y in zip(best, kept))
        if own is not None:
            yield found()

    return search


def similarities(points: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """id, other, similarity, rank: each query's k nearest points by cosine, ties to the smaller id.

    Every query meets every point, in blocks as matrices, that are read where they are compared and not shuffled; a task
    holds k + 1 rows a query and two blocks. A product in single precision tells which pairs can be among the nearest; these
    are compared as they are. Of points that have one vector only the first k + 1 ids can be among the nearest, and queries
    that have one vector ask once.
    """
    alike = Window.partitionBy("v")
    p = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).withColumn("_i", F.row_number().over(alike.orderBy("id"))).where(F.col("_i") <= k + 1)
    q = stored(queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).withColumn("rep", F.min("id").over(alike)), "asking")
    files = max(1, -(-points.count() // (8 * block)))
    p = stored(_packed(p.repartition(files, "id"), block, "id"), "points")
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, files)
    one = stored(_packed(q.where("id = rep").repartition(tasks, "rep"), block, "rep"), "queries")
    met = one.select(*[F.col(c).alias(f"q_{c}") for c in one.columns]).hint("shuffle_replicate_nl").crossJoin(p)
    near = met.mapInArrow(_nearest(k + 1), "rep long, other long, similarity double")
    at = lambda key: Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
    near = near.withColumn("_i", F.row_number().over(at("rep"))).where(F.col("_i") <= k + 1).drop("_i")
    return q.select("id", "rep").join(near, "rep").where("id <> other").drop("rep").withColumn("rank", F.row_number().over(at("id"))).where(F.col("rank") <= k)


def mutual_alignment(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """points, shared, alignment: the mean share of k neighbours that two neighbour tables (id, other) agree on."""
    points = left.select("id").distinct().agg(F.count("*").alias("points"))
    return left.select("id", "other").join(right.select("id", "other"), ["id", "other"]).agg(F.count("*").alias("shared")).crossJoin(points).select("points", "shared", (F.col("shared") / (F.col("points") * k)).alias("alignment"))


def mutual_nearest(distances: DataFrame) -> DataFrame:
    """left, right, distance of pairs that are each other's nearest; ties by id."""
    to_right = Window.partitionBy("left").orderBy("distance", "right")
    to_left = Window.partitionBy("right").orderBy("distance", "left")
    return distances.withColumn("_a", F.row_number().over(to_right)).withColumn("_b", F.row_number().over(to_left)).where("_a = 1 AND _b = 1").select("left", "right", "distance")


def ratio_margin(distances: DataFrame, most: float) -> DataFrame:
    """left, right, distance, ratio where the nearest is at most ``most`` times as far as the second nearest."""
    w = Window.partitionBy("left").orderBy("distance", "right")
    two = distances.withColumn("_i", F.row_number().over(w)).where("_i <= 2").withColumn("_next", F.lead("distance").over(w))
    return two.where("_i = 1 AND _next > 0").select("left", "right", "distance", (F.col("distance") / F.col("_next")).alias("ratio")).where(F.col("ratio") <= most)


def nearest_values(left: DataFrame, right: DataFrame, count: int, *keys: str) -> DataFrame:
    """left, right, distance, next: the nearest rights (keys, id, value) of each left, ties by id; ``count`` is 1 or 2.

    Sorted by value, a left's nearest rights stand next to it: the two values below or equal, the two above, and the two
    least ids of each. Nothing is compared beyond those. ``next`` is the distance to the second nearest.
    """
    at_value = Window.partitionBy(*keys, "value").orderBy("id")
    few = right.where("value IS NOT NULL").withColumn("i", F.row_number().over(at_value)).where("i <= 2").groupBy(*keys, "value").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    here, in_order = F.struct("value", "ids"), Window.partitionBy(*keys).orderBy("value")
    rows = few.select(*keys, "value", F.lit(0).alias("side"), here.alias("here"), F.lag(here).over(in_order).alias("before"), F.lead(here).over(in_order).alias("after"))
    asking = left.where("value IS NOT NULL").select(*keys, "value", F.lit(1).alias("side"), F.col("id").alias("left"))
    both = rows.unionByName(asking, allowMissingColumns=True)
    seen = F.when(F.col("side") == 0, F.struct("here", "before", "after"))
    up = Window.partitionBy(*keys).orderBy("value", "side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("value"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("low", F.last(seen, ignorenulls=True).over(up)).withColumn("high", F.last(seen, ignorenulls=True).over(down)).where("side = 1")
    each = lambda c: F.coalesce(F.transform(c["ids"], lambda i: F.struct(F.round(F.abs(c["value"] - F.col("value")), 6).alias("distance"), i.alias("right"))), F.array())
    near = F.array_sort(F.concat(each(F.col("low.here")), each(F.col("low.before")), each(F.col("high.here")), each(F.col("high.after"))))
    found = met.select(*keys, "left", near.alias("near"))
    return found.select(*keys, "left", F.posexplode(F.slice("near", 1, count)).alias("at", "n"), F.try_element_at("near", F.lit(2))["distance"].alias("next")).select(*keys, "left", "n.right", "n.distance", "next")


def mutual_nearest_values(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left, right, distance of pairs that are each other's nearest by value."""
    there = nearest_values(left, right, 1, *keys).select("left", "right", "distance")
    back = nearest_values(right, left, 1, *keys).select(F.col("left").alias("right"), F.col("right").alias("left"))
    return there.join(back, ["left", "right"])


def ratio_margin_values(left: DataFrame, right: DataFrame, most: float, *keys: str) -> DataFrame:
    """left, right, distance, ratio where the nearest by value is at most ``most`` times as far as the second nearest."""
    return nearest_values(left, right, 1, *keys).where("next > 0").select("left", "right", "distance", (F.col("distance") / F.col("next")).alias("ratio")).where(F.col("ratio") <= most)


def features_within(fixes: DataFrame, features: DataFrame, radius_km: float, *keys: str) -> DataFrame:
    """id, n, nearest_km of the features (lat, lon) within a radius of each fix at the same keys; fixes without any stay.

    Both sides are dealt into latitude bands as wide as the radius, and within a band into cells of longitude that are no
    narrower than the radius can reach there, so that a fix meets nine cells; bands near a pole are one cell. Rows at one
    place are one row with their number on either side, so that what meets grows with the places and not with the rows.
    """
    features = features.groupBy(*keys, "lat", "lon").agg(F.count("*").alias("_n"))
    places = fixes.select(*keys, "lat", "lon").distinct()
    band = radius_km / 111.0
    reach = math.radians(band)

    def cells(at: Column) -> Column:
        edge = F.radians(F.greatest(F.abs(at), F.abs(at + 1)) * band + band)
        wide = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(reach, math.pi / 2)) / F.cos(edge))))
        return F.when(edge + reach < math.pi / 2, F.greatest(F.lit(1), F.floor(360 / wide))).otherwise(1).cast("long")

    cell = lambda lon: F.floor(F.pmod(lon, F.lit(360.0)) * F.col("_cells") / 360)
    f = places.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(F.sequence(F.floor(F.col("lat") / band) - 1, F.floor(F.col("lat") / band) + 1)).alias("_band")).withColumn("_cells", cells(F.col("_band")))
    f = f.withColumn("_cell", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(cell(F.col("_lon")) + i, F.col("_cells"))))))
    g = features.select(*keys, "lat", "lon", "_n", F.floor(F.col("lat") / band).alias("_band")).withColumn("_cells", cells(F.col("_band"))).withColumn("_cell", F.pmod(cell(F.col("lon")), F.col("_cells"))).drop("_cells")
    met = f.join(g, [*keys, "_band", "_cell"]).withColumn("km", great_circle_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).where(F.col("km") <= radius_km)
    near = met.groupBy(*keys, F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).agg(F.sum("_n").alias("n"), F.min("km").alias("nearest_km"))
    return fixes.select(*keys, "id", "lat", "lon").join(near, [*keys, "lat", "lon"], "left").drop("lat", "lon").fillna(0, ["n"])


def subsets(members: DataFrame, size: int, *keys: str, member: str = "member", most: int | None = None) -> DataFrame:
    """keys, members (in order, joined by +): all subsets of ``size`` members of each group.

    Groups of more than ``most`` members make the whole pass refuse, never a part of it.
    """
    from stratascope.errors import Refused

    if most is not None and (n := members.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most:
        raise Refused(f"a group has {n} members and {most} are allowed")
    out = members.select(*keys, F.col(member).cast("string").alias("members"), F.col(member).alias("_last"))
    for _ in range(size - 1):
        nxt = members.select(*keys, F.col(member).alias("_next"))
        out = out.join(nxt, list(keys)).where("_next > _last").select(*keys, F.concat_ws("+", "members", F.col("_next").cast("string")).alias("members"), F.col("_next").alias("_last"))
    return out.drop("_last")


def assign_regions(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """id, verdict, region: boxes (id, low_y, high_y, low_x, high_x) against named regions of the same form.

    INSIDE if one region holds the box and no other touches it; STRADDLES if several touch it; PARTLY_OUTSIDE if one
    does; else OUTSIDE. Regions are a declared, short list.
    """
    r = regions.select("region", *[F.col(c).alias(f"r_{c}") for c in ("low_y", "high_y", "low_x", "high_x")])
    touch = "low_y < r_high_y AND r_low_y < high_y AND low_x < r_high_x AND r_low_x < high_x"
    inside = F.expr("low_y >= r_low_y AND high_y <= r_high_y AND low_x >= r_low_x AND high_x <= r_high_x")
    met = boxes.join(F.broadcast(r), F.expr(touch), "left").groupBy("id").agg(F.count("region").alias("t"), F.count_if(inside).alias("i"), F.min(F.when(inside, F.col("region"))).alias("region"))
    verdict = F.when((F.col("t") == 1) & (F.col("i") == 1), "INSIDE").when(F.col("t") >= 2, "STRADDLES").when(F.col("t") == 1, "PARTLY_OUTSIDE").otherwise("OUTSIDE")
    return met.select("id", verdict.alias("verdict"), F.when((F.col("t") == 1) & (F.col("i") == 1), F.col("region")).alias("region"))


def band_reasons(candidates: DataFrame, bands: dict[str, tuple[Column, float]]) -> DataFrame:
    """``candidates`` with reasons: the names of the admission bands that each fails, a ratio within [1 / b, b]."""
    fails = [F.when((ratio > b) | (ratio < 1 / b) | ratio.isNull(), F.lit(name)) for name, (ratio, b) in bands.items()]
    return candidates.withColumn("reasons", F.array_compact(F.array(*fails))).withColumn("admitted", F.size("reasons") == 0)


def pool_rank(pool: DataFrame, observed: Column, value: Column, *keys: str) -> DataFrame:
    """keys, pool, above, tied, p_value = (1 + above + tied) / (1 + pool) of an enumerated pool."""
    g = pool.withColumn("_o", observed).withColumn("_v", value).groupBy(*keys).agg(F.count("*").alias("pool"), F.count_if(F.col("_v") > F.col("_o")).alias("above"), F.count_if(F.col("_v") == F.col("_o")).alias("tied"))
    return g.withColumn("p_value", (1 + F.col("above") + F.col("tied")) / (1 + F.col("pool")))
