"""Centroid clustering on bit planes: exact dot products and distances by counting the bits that two words share.

A component is the integer floor(scale * x). A vector of 64 components is packed once: plane b holds bit b of every
component, in two's complement, so that a vector of values of B bits is B unsigned words of 64 bits. A dot product is the
sum over pairs of planes of weight * weight * popcount(plane & plane), the last plane's weight being negative; a squared
distance follows from it and the two lengths. The planes are written once, at a few words a vector, and read in every
round; a round's centroids (a few rows of planes) go to every task, and a task sends back one count and one sum of
components for each centroid, whatever share of the vectors a centroid has.

Cases: a vector takes part if it has exactly 64 components, none null or non-finite. Rows that repeat stay separate; a
null id is hashed as the empty text; starts with equal hashes are in the order of their vectors. With fewer vectors than
centroids, there are as many centroids as vectors. An empty table gives an empty result. Components beyond 2^27 in
magnitude would not have distances of 64 bits: they end in an error, before the first round. Columns other than the two
named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, tidy, written
from .vector_search import complete

WIDTH, MOST_BITS = 64, 28
SUMS = "cluster int, n long, total array<long>"


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64 integers as ``bits`` words: component d is bit d, plane b is bit b of two's complement."""
    bit = (values[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(bit.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def values(words: np.ndarray) -> np.ndarray:
    """The integers that ``planes`` packed."""
    n, bits = words.shape
    bit = np.unpackbits(np.ascontiguousarray(words).astype("<u8")[:, :, None].view(np.uint8), axis=2, bitorder="little")
    return np.einsum("nbd,b->nd", bit, weights(bits), dtype=np.int64, casting="unsafe")


def weights(bits: int) -> np.ndarray:
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the packed rows of ``a`` with those of ``b``, by weighted AND and popcount."""
    w = weights(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        column = np.ascontiguousarray(a[:, i])[:, None]
        for j in range(b.shape[1]):
            out += w[i] * w[j] * np.bitwise_count(column & b[None, :, j]).astype(np.int64)
    return out


def lengths(words: np.ndarray) -> np.ndarray:
    """Each packed row's inner product with itself."""
    w, out = weights(words.shape[1]), np.zeros(len(words), np.int64)
    for i in range(words.shape[1]):
        for j in range(i, words.shape[1]):
            out += (1 + (j > i)) * w[i] * w[j] * np.bitwise_count(words[:, i] & words[:, j]).astype(np.int64)
    return out


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the smaller number on ties, and its squared distance."""
    far = lengths(words)[:, None] + lengths(centroids)[None, :] - 2 * dot_products(words, centroids)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(words)), best]


def _words(batch: pa.RecordBatch, bits: int, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        flat = part.column(part.schema.get_field_index("planes")).flatten().to_numpy(zero_copy_only=False)
        yield part, flat.astype(np.int64).view(np.uint64).reshape(-1, bits)


def packed_vectors(table: DataFrame, scale: int, bits: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id and planes (array of long) of the vectors that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                whole = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                words = planes(whole.reshape(-1, WIDTH), bits).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * bits), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["vec_id", "planes"])

    return _kept(table, vec_id, vector).mapInArrow(tidy(pack), "vec_id long, planes array<long>")


def _kept(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    return table.where(complete(v) & (F.size(v) == WIDTH)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def _bits(kept: DataFrame, scale: int) -> int:
    """Bits of two's complement that hold every component; 0 for no vectors."""
    low, high = kept.agg(F.min(F.floor(scale * F.array_min("vector")).cast("double")), F.max(F.floor(scale * F.array_max("vector")).cast("double"))).first()
    if low is None:
        return 0
    if max(-low, high) > 1 << (MOST_BITS - 1):
        raise ValueError(f"components up to {max(-low, high):.0f}: squared distances may not fit into 64 bits")
    return 1 + max(int(high).bit_length(), (-1 - int(low)).bit_length() if low < 0 else 0)


def _sums(packed: DataFrame, shared, bits: int) -> DataFrame:
    """cluster, n, total: of each cluster the number of vectors and the sum of each component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for batch in batches:
            for _, words in _words(batch, bits):
                best, _ = nearest(words, centroids)
                n += np.bincount(best, minlength=len(n))
                np.add.at(total, best, values(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    by_task = packed.select("planes").mapInArrow(tidy(sums), SUMS).where("n > 0")
    exact = [F.sum(F.get("total", F.lit(d)).cast("decimal(38,0)")) for d in range(WIDTH)]
    return by_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*exact).alias("total"))


def clusters(table: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long) and centroid_sha256 of every vector that takes part.

    The first centroids are the k vectors with the least SHA-256 of "seed:vec_id"; each round moves every centroid that
    has vectors to the floor of their mean. ``k`` centroids are held by every task.
    """
    spark = table.sparkSession
    kept = _kept(table, vec_id, vector)
    bits = _bits(kept, scale)
    if not bits:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    packed = written(packed_vectors(table, scale, bits, vec_id, vector), "planes")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("vector", lambda x: F.floor(scale * x))
    start = kept.select(mark.alias("mark"), whole.alias("whole")).orderBy("mark", "whole").limit(k).collect()
    centroids = np.array([r["whole"] for r in start], np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(planes(centroids, bits))
        for row in _sums(packed, shared, bits).collect():  # at most k rows
            centroids[row["cluster"]] = [int(t) // row["n"] for t in row["total"]]
    shared = spark.sparkContext.broadcast(planes(centroids, bits))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _words(batch, bits):
                best, far = nearest(words, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    assigned = written(packed.mapInArrow(tidy(assign), "vec_id long, cluster int, distance long"), "assigned")
    inertia = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    drop_written(packed)
    facts = [(i, int(inertia[i]), [int(x) for x in c], hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid array<long>, centroid_sha256 string")
    out = assigned.join(F.broadcast(facts), "cluster")  # k rows at most
    return keeps(out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(int(sum(inertia.values()))).cast("long").alias("inertia"), "centroid", "centroid_sha256"), assigned)


def _sql() -> str:
    rounds = ["""
a{r} AS MATERIALIZED (SELECT rowid_, min({{'d': d, 'cluster': cluster}}).cluster AS cluster FROM (SELECT rowid_, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept_, c{r}) GROUP BY rowid_),
m{r} AS MATERIALIZED (SELECT cluster, list(floor(s / n)::BIGINT ORDER BY pos) AS c FROM (SELECT cluster, pos, sum(x)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT a.cluster, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS pos FROM kept_ k JOIN a{r} a USING (rowid_)) GROUP BY cluster, pos) GROUP BY cluster),
c{s} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (cluster))""".format(r=r, s=r + 1) for r in range(3)]  # fmt: skip
    return f"""
WITH kept_ AS MATERIALIZED (SELECT row_number() OVER () AS rowid_, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v AS c FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept_ ORDER BY h, v LIMIT 16)),
{','.join(rounds)},
last_ AS MATERIALIZED (SELECT rowid_, min({{'d': d, 'cluster': cluster}}) AS best FROM (SELECT rowid_, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept_, c3) GROUP BY rowid_)
SELECT k.vec_id, best.cluster AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia,
    sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM last_ JOIN kept_ k USING (rowid_) JOIN c3 c ON c.cluster = last_.best.cluster
"""


CLUSTERS_SQL = _sql()
