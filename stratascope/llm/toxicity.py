"""Toxic passages as maximal scoring segments of token log-odds, judged by extreme-value statistics.

Training, on labelled rows: each distinct word of a document and its prefixes of 4, 5 and 6 letters are features; texts
with the same set of words and the same label count once. A feature's log-odds between toxic and clean documents take an
informative Dirichlet prior (its rate in all of them), less one standard error. A token scores the best of its features
that speak for toxicity, less DRIFT, and any other token -DRIFT, so that a passage pays for what stands between its
marked words. The model holds the features whose log-odds exceed DRIFT, for no other one can change a score.

Search: the linear-time scan finds every maximal scoring segment of a text. Under the clean documents' own token scores,
chance segments of score S in n tokens number K n exp(-lambda S); lambda solves E[exp(lambda s)] = 1 and K comes from the
chance segments counted in clean documents. A passage is significant if that number is at most SIGNIFICANT. A document's
evidence is the sum of lambda S - ln(K n) over its significant passages; a logistic curve turns it into a score. Lambda,
K and the curve come from the training rows, each scored without its own counts.

Cases: null and empty texts have no tokens and get the score of a text without evidence; labels that are null are not
used, and of several labels for one doc_id the highest counts; without labels of both kinds, or without a feature that
tells them apart, every score is 0; rows alike are scored alike; an empty table gives an empty result; very long texts
are scanned whole, in linear time. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, tidy, written
from .tokens import Words, blocks, each, letter_words

#: Labelled rows to train on, at most; more are thinned evenly by a hash of their id.
MOST_LABELLED = 200_000
#: Feature hashes that a counting task gathers before it reports.
MOST_HELD = 2_000_000
PREFIXES = (4, 5, 6)
PRIOR, DRIFT, LEAST_DOCS = 50.0, 1.0, 2
#: Chance segments as good as a passage that its text may be expected to hold, at most, for the passage to be significant.
SIGNIFICANT = 0.3
_SLOTS = 20


def maximal_segments(at: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text whose tokens score ``scores`` at the places ``at`` and -drift elsewhere.

    Each segment links to the nearest earlier one with a smaller total before it, so that no segment is passed twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total, before = 0.0, -1
    for i, s in zip(at.tolist(), scores.tolist()):
        total -= drift * (i - before - 1)
        a, x, h, j = i, total, total + s, len(first) - 1
        total, before = h, i
        while True:
            while j >= 0 and low[j] >= x:
                j = link[j]
            if j < 0 or high[j] >= h:
                break
            a, x, k = first[j], low[j], link[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j = k
        first.append(a)
        last.append(i)
        low.append(x)
        high.append(h)
        link.append(j)
    return [(a, b, h - x) for a, b, x, h in zip(first, last, low, high)]


def log_odds(toxic, clean, n_toxic: int, n_clean: int, log: Callable, sqrt: Callable):
    """Less one standard error; of arrays, or of Spark columns with their functions."""
    a = PRIOR * (toxic + clean) / max(1, n_toxic + n_clean)
    return log((toxic + a) / (n_toxic + PRIOR - toxic - a)) - log((clean + a) / (n_clean + PRIOR - clean - a)) - sqrt(1 / (toxic + a) + 1 / (clean + a))


@dataclass
class TokenModel:
    """Sorted feature hashes with their counts of toxic and of clean documents."""

    keys: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int

    def gains(self, without: int | None = None) -> np.ndarray:
        """Log-odds above DRIFT; ``without`` leaves out one document with that label, which holds the feature."""
        t, c = self.toxic - (without == 1), self.clean - (without == 0)
        with np.errstate(all="ignore"):
            odds = log_odds(t, c, self.n_toxic - (without == 1), self.n_clean - (without == 0), np.log, np.sqrt)
        return np.where((t > 0) & np.isfinite(odds), np.maximum(odds - DRIFT, 0.0), 0.0)


class Scorer:
    """Token scores of a model: a table of slots tells most features apart from all of the model's, a search decides the rest."""

    def __init__(self, model: TokenModel, without: int | None = None):
        gains = model.gains(without)
        self.keys, self.gains = model.keys[gains > 0], gains[gains > 0]
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.keys >> np.uint64(64 - _SLOTS)] = True

    def tokens(self, words: Words) -> np.ndarray:
        """The score of each word; 0 for those that don't speak for toxicity."""
        best = np.zeros(len(words.whole))
        if not len(self.keys):
            return best
        for h, short in [(words.whole, None), *zip(words.prefixes, words.short)]:
            at = np.flatnonzero(self.slots[h >> np.uint64(64 - _SLOTS)])
            if short is not None:
                at = at[~short[at]]
            i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            same = self.keys[i] == h[at]
            at, i = at[same], i[same]
            best[at] = np.maximum(best[at], self.gains[i])
        return best

    def texts(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words, int]]:
        """For each text its number of tokens, the places and scores of those that speak for toxicity, and where its words stand."""
        for some in blocks(texts):
            words = letter_words(some, PREFIXES)
            s = self.tokens(words)
            marked = np.flatnonzero(s)
            cuts = np.searchsorted(marked, words.first).tolist()
            first = words.first.tolist()
            for k in range(len(some)):
                at = marked[cuts[k] : cuts[k + 1]]
                yield first[k + 1] - first[k], at - first[k], s[at], words, first[k]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, copy and text: ``copy`` names the set of a text's words."""
    for batch in batches:
        keys = []
        for some in blocks(each(batch.column("text"))):
            words = letter_words(some)
            for a, b in zip(words.first, words.first[1:]):
                own = np.unique(words.whole[a:b])
                keys.append(f"{len(own)}:{np.bitwise_xor.reduce(own)}:{own.sum()}" if len(own) else "")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(keys, pa.string()), batch.column("text")], ["doc_id", "toxic", "copy", "text"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, clean: counts of documents, reported whenever MOST_HELD features are held."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def counted() -> Iterator[pa.RecordBatch]:
        each = {k: np.unique(np.concatenate(v), return_counts=True) if v else (np.empty(0, np.uint64), np.empty(0, np.int64)) for k, v in held.items()}
        keys = np.union1d(each[0][0], each[1][0])
        counts = np.zeros((2, len(keys)), np.int64)
        for k, (own, n) in each.items():
            counts[k][np.searchsorted(keys, own)] = n
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[1][part]), pa.array(counts[0][part])], ["feature", "toxic", "clean"])
        for v in held.values():
            v.clear()

    n = 0
    for batch in batches:
        labels, at = batch.column("toxic").to_pylist(), 0
        for some in blocks(each(batch.column("text"))):
            words = letter_words(some, PREFIXES)
            for a, b in zip(words.first, words.first[1:]):
                own = np.unique(np.concatenate([words.whole[a:b], *[h[a:b][~few[a:b]] for h, few in zip(words.prefixes, words.short)]]))
                held[labels[at]].append(own)
                at, n = at + 1, n + len(own)
            if n > MOST_HELD:
                yield from counted()
                n = 0
    yield from counted()


def _own_segments(model) -> Callable:
    """Training rows scored without their own counts: toxic, n, positive token scores, segment scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {label: Scorer(model.value, label) for label in (0, 1)}
        real = pa.list_(pa.float64())
        for batch in batches:
            whole = pa.table(batch)
            for label, scorer in scorers.items():
                texts = whole.filter(pc.equal(whole["toxic"], label))["text"].to_pylist()
                n, marks, segments = [], [], []
                for size, at, s, _, _ in scorer.texts(texts):
                    n.append(size)
                    marks.append(s)
                    segments.append([x[2] for x in maximal_segments(at, s, DRIFT)])
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(marks, real), pa.array(segments, real)], ["toxic", "n", "marks", "segments"])

    return score


@dataclass
class ToxicityModel:
    tokens: TokenModel
    lam: float
    k: float
    slope: float
    intercept: float

    def bits(self, scores: np.ndarray, n: int) -> np.ndarray:
        """Minus the logarithm of the number of chance segments as good as these in a text of n tokens."""
        return self.lam * np.asarray(scores, float) - np.log(max(1e-9, self.k * n))

    def significant(self, bits: np.ndarray) -> np.ndarray:
        return bits >= -np.log(SIGNIFICANT)

    def evidence(self, scores, n: int) -> float:
        bits = self.bits(scores, n)
        return float(np.log1p(bits[self.significant(bits)].sum()))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * evidence + self.intercept))))


class Judge:
    """Scores texts in a task."""

    def __init__(self, model: ToxicityModel):
        self.model, self.scorer = model, Scorer(model.tokens)
        self.none = model.probability(0.0)

    def texts(self, texts, passages: bool = False) -> Iterator[tuple[float, list]]:
        """Each text's score, and if asked for its significant passages."""
        for n, at, s, words, first in self.scorer.texts(texts):
            if not len(at):
                yield self.none, []
                continue
            found = maximal_segments(at, s, DRIFT)
            bits = self.model.bits([x[2] for x in found], n)
            sure = self.model.significant(bits)
            score = self.model.probability(float(np.log1p(bits[sure].sum())))
            yield score, [{"start": int(words.start[first + a]), "end": int(words.end[first + b]), "score": x} for (a, b, x), y in zip(found, sure) if y] if passages else []


def _karlin_lambda(scores: np.ndarray, counts: np.ndarray, tokens: float) -> float:
    """The positive root of E[exp(lambda s)] = 1; one chance token of the highest score is always supposed."""
    scores, counts = np.append(scores, max(1.0, scores.max(initial=0))), np.append(counts, 1.0)
    p = counts / (tokens + 1)
    low, high = 1e-6, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        value = np.exp(np.clip(mid * scores, None, 700)) @ p + max(0.0, 1 - p.sum()) * np.exp(-mid * DRIFT)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a little ridge; slope and intercept."""
    m, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.eye(2) * 1e-2, m.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def _useful(n_toxic: int, n_clean: int) -> Column:
    """Features that may score, with all rows or without one."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = [F.when((t > dt) & (c >= dc), log_odds(t - dt, c - dc, n_toxic - dt, n_clean - dc, F.log, F.sqrt)) for dt, dc in ((0, 0), (1, 0), (0, 1))]
    return (F.col("toxic") >= LEAST_DOCS) & (F.greatest(*odds) > DRIFT)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from the rows of ``labels`` (doc_id and a 0/1 label); the caller leaves out what is to be held out.

    The driver gets the features that may score, and a row for each of at most MOST_LABELLED labelled rows.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, MOST_LABELLED / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    named = texts.join(F.broadcast(own), "doc_id").select("doc_id", "toxic", "text").mapInArrow(tidy(_copies), "doc_id long, toxic int, copy string, text string")
    rows = written(named.groupBy("copy", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("toxic", "text"), "labelled")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nt, nc = counts.get(1, 0), counts.get(0, 0)
    none = TokenModel(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), nt, nc)
    if not nt or not nc:
        drop_written(rows)
        return ToxicityModel(none, 1.0, 1.0, 0.0, -50.0)
    summed = rows.mapInArrow(tidy(_feature_counts), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    top = summed.where(_useful(nt, nc)).toArrow()
    keys = top.column(0).to_numpy().view(np.uint64)
    if not len(keys):
        drop_written(rows)
        return ToxicityModel(none, 1.0, 1.0, 0.0, -50.0)
    order = np.argsort(keys)
    tokens = TokenModel(keys[order], top.column(1).to_numpy()[order], top.column(2).to_numpy()[order], nt, nc)
    shared = spark.sparkContext.broadcast(tokens)
    own_rows = written(rows.mapInArrow(tidy(_own_segments(shared)), "toxic int, n long, marks array<double>, segments array<double>"), "calibration")
    clean = own_rows.where("toxic = 0")
    marks = clean.select(F.explode("marks").alias("s")).groupBy(F.round("s", 1).alias("s")).count().toPandas()
    tokens_n = float(clean.agg(F.sum("n")).first()[0] or 0)
    lam = _karlin_lambda(marks["s"].to_numpy(float), marks["count"].to_numpy(float), tokens_n)
    chance = clean.select(F.explode("segments").alias("s")).agg(F.count("*"), F.min("s")).first()
    k = (chance[0] + 1.0) * float(np.exp(min(50.0, lam * (chance[1] or 0.0)))) / (tokens_n + 1.0)
    model = ToxicityModel(tokens, lam, k, 0.0, 0.0)
    evidence = F.pandas_udf(lambda s, n: pd.Series([model.evidence(x, m) for x, m in zip(s, n)]), "double")
    points = own_rows.select(evidence("segments", "n").alias("x"), "toxic").toPandas()  # MOST_LABELLED rows at most
    model.slope, model.intercept = _logistic(points["x"].to_numpy(float), points["toxic"].to_numpy(float))
    drop_written(rows, own_rows)
    return model


def toxic_scores(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted and the significant passages (start, end, score; in code points) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            scores, passages = zip(*judge.texts(each(batch.column(1)), True)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    found = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidy(judge), "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>")
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def toxic_score(text: Column, model: ToxicityModel, docs: DataFrame) -> Column:
    """The score of a text column of ``docs``, without passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(shared.value)
        for texts in batches:
            yield pd.Series([x for x, _ in judge.texts(texts.tolist())], dtype="float64")

    return score(text.cast("string"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), toxic_score(F.col(f"`{text}`"), model, docs).alias("own"))
    return judged.where(F.col("own") < threshold).select("row.*")
