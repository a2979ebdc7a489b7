"""Compact linear subspaces of a few features that explain a target, stably: found on one half, confirmed on the other.

All that is asked of the rows are sums: counts, sums and products of features and target, by region of a nuisance and by
draw. They are aggregated where the rows are, for all draws at once; what comes to the driver is one row of a few figures
for each region and draw. Spans are then fitted to these sums by block power iteration from several starts.

A perturbed draw adds hashed normal noise to every standard score. A null draw gives every row's target score a hashed sign:
that breaks its relation to the features, keeps its sizes, and needs no order of all rows, as a permutation would. Regions
are thirds of the nuisance at cuts that belong to the generating half. Two to six features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratascope.errors import Refused
from stratascope.operators.hashes import digests, numbers
from stratascope.operators.nulls import drawn
from stratascope.operators.testing import adjust, check_power, required_surrogates

REGIONS, LEAST_ROWS = 3, 80


@dataclass(frozen=True)
class Recipe:
    dimensions: tuple[int, ...] = (1,)
    ridges: tuple[float, ...] = (0.01, 0.1, 1.0)
    draws: int = 499
    perturbations: int = 6
    noise: float = 0.1
    stable: float = 0.1
    regional: float = 0.35
    penalty: float = 1.0
    spread: float = 0.05
    starts: int = 6
    iterations: int = 48
    seed: int = 7
    alpha: float = 0.05
    method: str = "by"

    def members(self) -> list[tuple[int, float]]:
        return [(d, r) for d in sorted(self.dimensions) for r in sorted(self.ridges)]


@dataclass(frozen=True)
class Scores:
    """What turns rows into standard scores and regions: figures of the generating half, applied unchanged elsewhere."""

    features: tuple[str, ...]
    target: str
    nuisance: str | None
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    target_mean: float
    target_scale: float
    cuts: tuple[float, float] | None


def scores_of(rows: DataFrame, features: Sequence[str], target: str, nuisance: str | None = None) -> Scores:
    """Means, deviations and the nuisance's thirds; refused where a feature or the target doesn't vary, or rows are few or incomplete."""
    names = tuple(sorted(features))
    if not 2 <= len(names) <= 6:
        raise Refused("a search over spans has two to six features")
    used = [*names, target, *([nuisance] if nuisance else [])]
    figures = rows.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)).alias(f"k_{c}") for c in used], *[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_samp(c).alias(f"s_{c}") for c in used]).first()
    if figures["n"] < LEAST_ROWS or any(figures[f"k_{c}"] < figures["n"] for c in used):
        raise Refused(f"{LEAST_ROWS} complete rows or more are needed")
    if flat := [c for c in used if figures[f"s_{c}"] <= 1e-12]:
        raise Refused(f"{', '.join(flat)} doesn't vary")
    cuts = tuple(rows.agg(F.percentile(nuisance, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]) if nuisance else None
    return Scores(names, target, nuisance, tuple(figures[f"m_{c}"] for c in names), tuple(figures[f"s_{c}"] for c in names), figures[f"m_{target}"], figures[f"s_{target}"], cuts)


def scored(rows: DataFrame, s: Scores, row_id: Column) -> DataFrame:
    """id, region, v: standard scores of the features, in order of their names, and of the target last."""
    each = [(F.col(c) - m) / k for c, m, k in zip((*s.features, s.target), (*s.mean, s.target_mean), (*s.scale, s.target_scale))]
    region = F.lit(0) if s.cuts is None else sum(((F.col(s.nuisance) > c).cast("int") for c in s.cuts), F.lit(0))
    return rows.select(row_id.cast("string").alias("id"), region.alias("region"), F.array(*each).alias("v"))


def _normal(*parts: Column) -> Column:
    unit = lambda which: (drawn(*parts, F.lit(which)) + 1) / F.lit(float((1 << 48) + 1))
    return F.sqrt(-2 * F.log(unit("r"))) * F.cos(2 * math.pi * unit("t"))


def perturbed(rows: DataFrame, draws: int, noise: float, seed: int) -> DataFrame:
    """draw and the scores with hashed normal noise, for draws from 1; draw 0 is as it is."""
    out = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    shaken = F.transform("v", lambda x, i: x + noise * _normal(F.lit(seed), F.col("draw"), F.col("id"), i))
    return out.withColumn("v", F.when(F.col("draw") == 0, F.col("v")).otherwise(shaken))


def signed(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw and the scores with a hashed sign of the target, for draws from 1."""
    out = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = 1 - 2 * (drawn(F.lit(seed), F.col("draw"), F.col("id")) % 2)
    return out.withColumn("v", F.transform("v", lambda x, i: F.when(i == F.size("v") - 1, x * sign).otherwise(x)))


def moments(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """keys, n, sums (array) and products (array, pairs i <= j in order) of the first ``width`` + 1 scores."""
    at = lambda i: F.get("v", F.lit(i))
    sums = F.array(*[F.sum(at(i)) for i in range(width + 1)])
    products = F.array(*[F.sum(at(i) * at(j)) for i, j in combinations_with_replacement(range(width + 1), 2)])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("sums"), products.alias("products"))


class Sums:
    """Moments of some rows: n, sums s and products q over the features and, last, the target."""

    def __init__(self, n: int, s: np.ndarray, q: np.ndarray):
        self.n, self.s, self.q = n, s, q

    @classmethod
    def of(cls, row) -> Sums:
        width = len(row["sums"])
        q = np.zeros((width, width))
        for (i, j), x in zip(combinations_with_replacement(range(width), 2), row["products"]):
            q[i, j] = q[j, i] = x
        return cls(row["n"], np.array(row["sums"]), q)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.q + other.q)

    def explained(self, basis: np.ndarray) -> float:
        """The share of the target's variance that a regression on the span explains."""
        centred = self.q - np.outer(self.s, self.s) / self.n
        total, across, own = centred[-1, -1], basis.T @ centred[:-1, -1], basis.T @ centred[:-1, :-1] @ basis
        if total <= 1e-15:
            raise Refused("the target doesn't vary")
        return float(max(0.0, across @ np.linalg.pinv(own) @ across / total))


def objective(whole: Sums, regions: list[Sums], ridge: float, recipe: Recipe) -> np.ndarray:
    """What a span maximises: relevance to the target and some spread, less what differs between regions, in whitened features."""
    covariance, relevance = whole.q[:-1, :-1] / whole.n, whole.q[:-1, -1] / whole.n
    unstable = np.zeros_like(covariance)
    for r in regions if len(regions) > 1 else []:
        delta = r.q[:-1, -1] / r.n - relevance
        unstable += r.n / whole.n * np.outer(delta, delta)
    signal = np.outer(relevance, relevance) + recipe.spread * covariance - recipe.penalty * unstable
    values, vectors = np.linalg.eigh(covariance + ridge * np.eye(len(covariance)))
    root = vectors / np.sqrt(values) @ vectors.T
    out = root @ signal @ root
    low = np.linalg.eigvalsh(out).min()
    return out + (abs(low) + 1e-9) * np.eye(len(out)) if low <= 0 else out


def fitted(matrix: np.ndarray, dimension: int, recipe: Recipe, stream: int) -> np.ndarray:
    """The best of several starts of block power iteration, all starts at once."""
    rng = np.random.default_rng(recipe.seed + stream)
    q = np.linalg.qr(np.stack([rng.standard_normal((len(matrix), dimension)) for _ in range(recipe.starts)]))[0]
    for _ in range(recipe.iterations):
        q = np.linalg.qr(matrix @ q)[0]
    return q[int(np.argmax(np.einsum("sid,ij,sjd->s", q, matrix, q)))]


def projector(basis: np.ndarray) -> np.ndarray:
    q = np.linalg.qr(np.asarray(basis, float))[0]
    return q @ q.T


def projector_distance(a: np.ndarray, b: np.ndarray) -> float:
    """How far two spans of one dimension are apart, from 0 to 1, whatever their bases."""
    p, q = projector(a), projector(b)
    rank, other = round(np.trace(p)), round(np.trace(q))
    if p.shape != q.shape or rank != other:
        raise Refused("spans of one dimension in one space are compared")
    return float(np.linalg.norm(p - q) / math.sqrt(2 * rank))


def _by_draw(rows: DataFrame, width: int) -> dict[int, list[Sums]]:
    """The regions' sums of each draw: as many rows as there are draws and regions."""
    out: dict[int, list[Sums]] = {}
    for row in moments(rows, width, "draw", "region").orderBy("draw", "region").collect():
        out.setdefault(row["draw"], []).append(Sums.of(row))
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows in tasks of a size: each is hashed for all draws, whatever size the files have."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 50_000))
    return rows.repartition(tasks, "id")


def _perturbed_by_draw(rows: DataFrame, width: int, draws: int, noise: float, seed: int) -> dict[int, list[Sums]]:
    """The regions' sums of each draw of ``perturbed``, without a row for each draw and row: the same hashes, as arrays."""
    at = list(combinations_with_replacement(range(width + 1), 2))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, total = [f"{seed}:{draw}:" for draw in range(1, draws + 1)], {}
        for batch in batches:
            v, region = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1), batch.column("region").to_numpy(zero_copy_only=False)
            unit = lambda i, which: [(numbers(w) + 1) / float((1 << 48) + 1) for w in digests(heads, batch.column("id"), f":{i}:{which}")]  # noqa: B023, E731
            shaken = [v, *[v.copy() for _ in heads]]
            for i in range(width + 1):
                for draw, (r, t) in enumerate(zip(unit(i, "r"), unit(i, "t")), 1):
                    shaken[draw][:, i] += noise * (np.sqrt(-2 * np.log(r)) * np.cos(2 * math.pi * t))
            for region_ in np.unique(region):
                own = region == region_
                for draw, w in enumerate(shaken):
                    n, sums, products = total.get((draw, region_), (0, 0.0, 0.0))
                    total[draw, region_] = (n + int(own.sum()), sums + w[own].sum(axis=0), products + w[own].T @ w[own])
        if total:
            yield _as_batch([(draw, r, n, s, [q[i, j] for i, j in at]) for (draw, r), (n, s, q) in total.items()])

    return _summed(_dealt(rows).mapInArrow(add, PARTS), width)


#: A task's sums: counts, sums and products by draw and region.
PARTS = "draw int, region int, n long, s array<double>, q array<double>"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    draw, region, n, s, q = zip(*rows)
    doubles = lambda x: pa.array([list(map(float, r)) for r in x], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(draw, pa.int32()), pa.array(region, pa.int32()), pa.array(n, pa.int64()), doubles(s), doubles(q)], ["draw", "region", "n", "s", "q"])


def _summed(each: DataFrame, width: int) -> dict[int, list[Sums]]:
    """The regions' sums of each draw: as many rows as there are draws and regions."""
    sums = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width + 1)])
    products = F.array(*[F.sum(F.get("q", F.lit(k))) for k in range((width + 1) * (width + 2) // 2)])
    out: dict[int, list[Sums]] = {}
    for row in each.groupBy("draw", "region").agg(F.sum("n").alias("n"), sums.alias("sums"), products.alias("products")).orderBy("draw", "region").collect():
        out.setdefault(row["draw"], []).append(Sums.of(row))
    return out


def _signed_by_draw(rows: DataFrame, width: int, draws: int, seed: int) -> dict[int, list[Sums]]:
    """The regions' sums of each draw of ``signed``, without a row for each draw and row.

    A sign turns the target's sum and its products with the features, nothing else. A batch of rows is thus a matrix of signs
    times a matrix of what they turn; the hashes are the same, their parity is the last bit of the sixth byte.
    """
    at = list(combinations_with_replacement(range(width + 1), 2))
    turned = [k for k, (i, j) in enumerate(at) if j == width and i < width]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, total = [f"{seed}:{draw}:" for draw in range(1, draws + 1)], {}
        for batch in batches:
            v, region = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 1), batch.column("region").to_numpy(zero_copy_only=False)
            signs = np.empty((draws, len(v)))
            for d, (_, word) in enumerate(digests(heads, batch.column("id"))):
                signs[d] = 1.0 - 2.0 * (word >> 8 & 1)
            products = np.stack([v[:, i] * v[:, j] for i, j in at], axis=1)
            for r in np.unique(region):
                own = region == r
                n, sums, both, own_signs = total.get(r, (0, 0.0, 0.0, 0.0))
                flips = signs[:, own] @ np.column_stack([v[own, width], products[own][:, turned]])
                total[r] = (n + int(own.sum()), sums + v[own].sum(axis=0), both + products[own].sum(axis=0), own_signs + flips)
        for r, (n, sums, both, flips) in total.items():
            s, q = np.repeat(sums[None], draws, 0), np.repeat(both[None], draws, 0)
            s[:, width], q[:, turned] = flips[:, 0], flips[:, 1:]
            yield _as_batch([(draw + 1, r, n, s[draw], q[draw]) for draw in range(draws)])

    return _summed(_dealt(rows).mapInArrow(add, PARTS), width)


def _whole(parts: list[Sums]) -> Sums:
    return sum(parts[1:], parts[0])


SPANS = "label string, dimension int, ridge double, basis array<array<double>>, projector array<array<double>>, explained double, p_value double, region_range double, farthest double"


def generated(rows: DataFrame, s: Scores, row_id: Column, recipe: Recipe = Recipe()) -> DataFrame:  # noqa: B008
    """A row a member of the family: its span, what it explains, p and q over the family, how far perturbed fits move it, how regions differ, and whether it is a candidate."""
    members, width = recipe.members(), len(s.features)
    if not members or max(recipe.dimensions) >= width or min(recipe.dimensions) < 1 or min(recipe.ridges) <= 0:
        raise Refused("dimensions lie from 1 to one less than the features, ridges above 0")
    if not check_power(recipe.draws, len(members), recipe.alpha, recipe.method):
        raise Refused(f"{recipe.draws} draws can't reject one of {len(members)}: {required_surrogates(len(members), recipe.alpha, recipe.method)} are needed")
    own = scored(rows, s, row_id)
    shaken = _perturbed_by_draw(own, width, recipe.perturbations, recipe.noise, recipe.seed)
    if s.cuts and (len(shaken[0]) < REGIONS or min(r.n for r in shaken[0]) < max(20, 4 * (max(recipe.dimensions) + 1))):
        raise Refused("a region of the nuisance has too few rows")
    null = _signed_by_draw(own, width, recipe.draws, recipe.seed)
    fit = lambda parts, i: fitted(objective(_whole(parts), parts, members[i][1], recipe), members[i][0], recipe, 1009 * i)
    out = []
    for i, (dimension, ridge) in enumerate(members):
        basis = fit(shaken[0], i)
        explained = _whole(shaken[0]).explained(basis)
        reached = sum(_whole(parts).explained(fit(parts, i)) >= explained for parts in null.values())
        farthest = max(projector_distance(basis, fit(parts, i)) for draw, parts in shaken.items() if draw)
        regional = [r.explained(basis) for r in shaken[0]]
        out.append((f"dimension={dimension};ridge={ridge:g}", dimension, ridge, basis.tolist(), projector(basis).tolist(), explained, (1 + reached) / (1 + recipe.draws), max(regional) - min(regional) if s.cuts else 0.0, farthest))
    return _judged(rows.sparkSession.createDataFrame(out, SPANS), recipe, (F.col("farthest") <= recipe.stable) & (F.col("region_range") <= recipe.regional), "candidate")


def _judged(spans: DataFrame, recipe: Recipe, holds: Column, name: str) -> DataFrame:
    q = adjust(spans, len(recipe.members()), label="label").withColumn("q", F.col(recipe.method)).drop("bonferroni", "holm", "bh", "by")
    return q.withColumn(name, (F.col("q") <= recipe.alpha) & holds)


def confirmed(rows: DataFrame, spans: DataFrame, s: Scores, row_id: Column, recipe: Recipe = Recipe()) -> DataFrame:  # noqa: B008
    """The frozen spans of ``generated`` on rows that it hasn't seen, once: explained, p and q over the whole family, and whether a candidate is replicated.

    Spans, scores and cuts are those of the generating half; nothing is fitted again. With rows of another source the
    same call certifies spans outside.
    """
    frozen, width = spans.orderBy("label").collect(), len(s.features)  # a member of the family a row
    if sorted(f["label"] for f in frozen) != sorted(f"dimension={d};ridge={r:g}" for d, r in recipe.members()):
        raise Refused("the frozen spans are the whole family, each once")
    for f in frozen:
        if not np.allclose(projector(np.array(f["basis"])), np.array(f["projector"]), atol=1e-10):
            raise Refused(f"{f['label']}: the basis doesn't span what was frozen")
    own = scored(rows, s, row_id)
    parts = [Sums.of(r) for r in moments(own, width, "region").orderBy("region").collect()]
    least = max(10, 2 * (max(recipe.dimensions) + 1)) if s.cuts else 40
    if len(parts) < (REGIONS if s.cuts else 1) or min(p.n for p in parts) < least:
        raise Refused("a region of the nuisance has too few rows")
    null = {d: _whole(p) for d, p in _signed_by_draw(own, width, recipe.draws, recipe.seed + 1).items()}
    out = []
    for f in frozen:
        basis = np.array(f["basis"])
        explained = _whole(parts).explained(basis)
        reached = sum(p.explained(basis) >= explained for p in null.values())
        regional = [p.explained(basis) for p in parts]
        out.append((f["label"], f["dimension"], f["ridge"], f["basis"], f["projector"], explained, (1 + reached) / (1 + recipe.draws), max(regional) - min(regional) if s.cuts else 0.0, None, f["candidate"]))
    made = rows.sparkSession.createDataFrame(out, SPANS + ", candidate boolean").drop("farthest")
    return _judged(made, recipe, F.col("candidate") & (F.col("region_range") <= recipe.regional), "replicated")
