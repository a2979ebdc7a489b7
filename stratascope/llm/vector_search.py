"""Exact top-k inner-product search by distributed histogram selection.

Queries go to the tasks in slices of bounded size; every row is scored against the slice in each pass, and no score is
stored. The first pass counts scores in wide bins, the next ones count again within the one bin that holds a query's kth
best score, until bins are single integers. The last pass keeps what lies above the kth score, and of the ties at it the
smallest ids. A task reports only its own best bins until they hold k scores: the kth best score of all rows can't lie
below the kth best of some of them.

Cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; a shorter
vector counts as padded with zeros; rows with a query's own id are no candidates for it; of several query rows with one
id the smallest vector asks; fewer than k candidates all come out; an empty table gives an empty result. Scores beyond 64
bits end in an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, keeps, tidy, written

FIRST_BITS, NEXT_BITS = 10, 8
FOUND = "query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def complete(vector: Column) -> Column:
    """No component is missing or non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(lists: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component as doubles, padded with zeros to ``width`` columns."""
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out, row = np.zeros((len(sizes), width)), np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[col < width], col[col < width]] = flat[col < width]
    return out


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, a row a query."""
    if not q.size or not v.size or np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(q), whole(v).T).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray, scale: int, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of a few hundred rows at a time; a query's own row scores NONE."""
    order = np.argsort(q_ids)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            s = _scores(q, _matrix(part.column(1), scale, q.shape[1]))
            place = np.minimum(np.searchsorted(q_ids, ids, sorter=order), len(q_ids) - 1)
            own = np.flatnonzero(q_ids[order[place]] == ids)
            s[order[place[own]], own] = NONE
            yield ids, s


def _histogram(vectors: DataFrame, given, scale: int, k: int, shift: int, bits: int, first: bool) -> DataFrame:
    """query, bin, n: counts of scores >> shift; after the first pass only within each query's bin of the pass before."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, inside, _ = given.value
        width = 1 << bits
        low = -(width // 2) if first else 0
        counts = np.zeros((len(q_ids), width), np.int64)
        row = np.arange(len(q_ids))[:, None]
        for _, s in _scored(batches, q_ids, q, scale):
            use = s != NONE
            bins = s >> shift
            if not first:
                use &= (bins >> bits) == inside[:, None]
                bins = bins & (width - 1)
            key = (row * width + (bins - low))[use]
            counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        r, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(b + low, pa.int64()), pa.array(counts[r, b], pa.int64())], ["query", "bin", "n"])

    return vectors.mapInArrow(tidy(count), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _edges(histogram: DataFrame, need: DataFrame) -> list:
    """A row a query of the slice: the bin where the counts from above reach the number needed, and what lies above it."""
    upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))  # at most 1,024 rows a query
    return histogram.join(need, "query").withColumn("upto", upto).where("upto >= need and upto - n < need").select("query", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()


def top_k(table: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", slice_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``table`` for each of its rows where ``queries`` holds."""
    spark = table.sparkSession
    usable = table.where(complete(F.col(f"`{vector}`")) & F.col(f"`{vec_id}`").isNotNull())
    pair = [F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")]
    vectors = usable.select(*pair)
    asking = written(usable.where(queries).select(*pair).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n = asking.count()
    slices = max(1, -(-n // slice_rows))
    asking = asking.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    largest = vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.max(F.size("vector"))).first()
    found = []  # each slice's result is a table of its own, so that the plan stays as short for many slices as for one
    for i in range(slices if n else 0):
        rows = asking.where(F.col("slice") == i).select("vec_id", "vector").toArrow()  # about slice_rows rows
        if not rows.num_rows:
            continue
        lists = rows.column(1).combine_chunks()
        q_ids, q = rows.column(0).to_numpy(), _matrix(lists, scale, max([1, *np.diff(lists.offsets.to_numpy())]))
        reach = int(np.abs(q).max(initial=0) + 1) * int(largest[0] * scale + 2) * q.shape[1]
        shift = max(0, (2 * reach).bit_length() - FIRST_BITS + 1)
        state = [np.full(len(q_ids), NONE), np.zeros(len(q_ids), np.int64)]  # each query's bin, and the count above it
        first, short = True, np.zeros(len(q_ids), bool)
        while True:
            given = spark.sparkContext.broadcast((q_ids, q, *state))
            bits = FIRST_BITS if first else min(NEXT_BITS, last - shift)  # noqa: F821
            need = spark.createDataFrame([(j, k - int(a)) for j, a in enumerate(state[1])], "query long, need long")
            edges = _edges(_histogram(vectors, given, scale, k, shift, bits, first), need)
            inside, above = np.full(len(q_ids), NONE), state[1].copy()
            for e in edges:
                inside[e["query"]] = e["bin"] if first else (int(state[0][e["query"]]) << bits) + e["bin"]
                above[e["query"]] += e["above"]
            if first:
                short = inside == NONE
            state, last, first = [inside, above], shift, False
            if shift == 0:
                break
            shift = max(0, shift - NEXT_BITS)
        kth = np.where(short, NONE + 1, state[0])
        given = spark.sparkContext.broadcast((q_ids, q, kth, k - state[1]))
        found.append(written(vectors.mapInArrow(tidy(_chosen(given, scale)), FOUND), "found"))
    drop_written(asking)
    out = spark.read.schema(FOUND).parquet(*[f._written_path for f in found]) if found else spark.createDataFrame([], FOUND)
    drop = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return keeps(out.withColumn("rank", F.row_number().over(drop)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), *found)


def _chosen(given, scale: int):
    """What lies above each query's kth score, and of a task's ties at it the smallest ids, no more than are needed."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, kth, need = given.value
        ties: dict[int, list[int]] = {}
        for ids, s in _scored(batches, q_ids, q, scale):
            r, c = np.nonzero(s > kth[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(ids[c]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])
            for j, i in zip(*np.nonzero((s == kth[:, None]) & (s != NONE))):
                ties.setdefault(int(j), []).append(int(ids[i]))
            for j, own in ties.items():
                ties[j] = sorted(own)[: int(need[j])]
        flat = [(int(q_ids[j]), i, int(kth[j])) for j, own in ties.items() for i in own]
        cols = zip(*flat) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return choose
