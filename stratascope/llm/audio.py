"""Chroma fingerprints of audio, and the alignment of recordings that share a passage.

1. Samples are cut into overlapping windows; the power spectrum of a window, folded onto the 12 pitch classes, is a row of
   the chroma image. Sixteen box filters over the image's integral compare two areas each, at every frame; two bits a
   filter make a packed 32-bit integer a frame.
2. Recordings with equal fingerprints form a class. Runs of RUN integers are hashed, and the least hash of every WINNOW
   neighbouring runs is posted, so that any two recordings with RUN + WINNOW - 1 equal integers in a row post one alike.
3. Recordings that hashes tie together, directly or over others, form a part. A part is cut into blocks of recordings, and
   each pair of blocks is compared within a task: all of its pairs that post a hash alike meet there, at each offset that a
   common hash gives, so that no pair is written down before it is found to share a passage.
4. Along an offset the bit errors of the two fingerprints are scored, and the best stretch of all offsets is the shared
   passage; pairs whose passage is long enough are linked. Links are counted and the best kept for each recording in the
   task, and a forest of them goes on to the classes, so that what is written grows with the blocks and not with the links.

Cases: null or empty samples, and those too short for one fingerprint, have none and are linked with nothing; equal
recordings share a class; repeated rows are separate rows; very long recordings are cut into blocks of windows, so that
memory stays bounded by a recording's samples; an input column that is named like an output gives way to it; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, tidy, written
from .graph import components
from .tokens import each

RUN, WINNOW, LEAST_FRAMES, MOST_ERROR = 4, 4, 12, 0.2
#: Samples that a task turns into frames at once, unless one recording has more.
BLOCK_SAMPLES = 400_000
#: Recordings and bytes of fingerprints of a block that meets others, about, unless one recording has more.
BLOCK_RECORDINGS, BLOCK_BYTES = 1024, 8_000_000
#: Fingerprints that are compared at once, about.
AT_ONCE = 2_000_000
#: What a frame adds to a stretch and each of its bit errors takes off, in whole numbers: a stretch grows at error rates below MOST_ERROR.
GAIN, LOSS = 32 * Fraction(MOST_ERROR).limit_denominator(1000).numerator, Fraction(MOST_ERROR).limit_denominator(1000).denominator


@dataclass(frozen=True)
class Chroma:
    rate: int = 11025
    window: int = 4096
    hop: int = 1365
    low: float = 28.0
    high: float = 3520.0
    #: Frames that a filter spans, at most.
    span: int = 8

    def classes(self) -> np.ndarray:
        """For each bin of the spectrum its pitch class, or 12 outside the band."""
        f = np.fft.rfftfreq(self.window, 1 / self.rate)
        with np.errstate(divide="ignore"):
            note = np.round(12 * np.log2(f / 440.0))
        return np.where((f >= self.low) & (f <= self.high), np.mod(np.maximum(note, -1000), 12), 12).astype(int)


def chroma_images(recordings: list[np.ndarray], c: Chroma, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The frames x 12 of all recordings one after the other, each row of unit length or zero if silent, and where each recording ends."""
    counts = [max(0, (len(r) - c.window) // c.hop + 1) for r in recordings]
    ends = np.cumsum([0, *counts])
    out, fold = np.zeros((ends[-1], 12), np.float32), np.zeros((c.window // 2 + 1, 13), np.float32)
    if not len(out):
        return out.astype(float), ends
    fold[np.arange(c.window // 2 + 1), c.classes()] = 1
    taper = np.hanning(c.window).astype(np.float32)
    samples = np.concatenate(recordings).astype(np.float32, copy=False)
    begins = np.cumsum([0, *map(len, recordings)])[:-1]
    starts = np.repeat(begins - ends[:-1] * c.hop, counts) + np.arange(ends[-1]) * c.hop
    views = np.lib.stride_tricks.sliding_window_view(samples, c.window)
    for at in range(0, len(out), block):
        spectrum = np.fft.rfft(views[starts[at : at + block]] * taper, axis=1)
        out[at : at + block] = ((spectrum.real**2 + spectrum.imag**2) @ fold)[:, :12]
    out = out.astype(float)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9), ends


def box_filters(span: int) -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """Sixteen pairs of boxes (frame from, to, class from, to), made by rule.

    Even ones compare earlier with later frames of a band of classes, odd ones the lower with the upper half of a band.
    """
    out = []
    for i in range(16):
        height, length = (2, 4, 6, 4)[i // 2 % 4], span if i % 3 else span // 2
        y = (5 * i) % (13 - height)
        if i % 2 == 0:
            out.append(((0, length // 2, y, y + height), (length // 2, length, y, y + height)))
        else:
            out.append(((0, length, y, y + height // 2), (0, length, y + height // 2, y + height)))
    return out


def fingerprint(image: np.ndarray, span: int, step: float = 0.25) -> np.ndarray:
    """A packed 32-bit integer for each frame from which ``span`` frames follow."""
    n = len(image) - span + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at, out = np.arange(n), np.zeros(n, np.uint32)

    def area(box):
        a, b, lo, hi = box
        return total[at + b, hi] - total[at + a, hi] - total[at + b, lo] + total[at + a, lo]

    for one, other in box_filters(span):
        v = np.log((0.1 + area(one)) / (0.1 + area(other)))
        level = (v > -step).astype(np.uint32) + (v > 0) + (v > step)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # Gray code: neighbouring levels differ in one bit
    return out


def prints_of(recordings: list[np.ndarray], c: Chroma) -> list[np.ndarray]:
    """The fingerprint of each recording; one pass over the frames of all of them, of which those across two recordings are left out."""
    image, ends = chroma_images(recordings, c)
    every = fingerprint(image, c.span)
    return [every[a : max(a, b - c.span + 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _postings(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of winnowed runs and where they start; of equal hashes the first."""
    n = len(prints) - RUN + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(RUN):
        h = (h ^ prints[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if n < WINNOW:
        least = np.array([int(h.argmin())])
    else:
        views = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
        least = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    keys, first = np.unique(h[least], return_index=True)
    return keys, least[first]


def shared_passage(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, int, float]:
    """Start in x, length and bit error rate of the best stretch where y, moved by ``offset``, agrees with x."""
    a, b = max(0, offset), min(len(x), len(y) + offset)
    if b <= a:
        return 0, 0, 1.0
    errors = np.bitwise_count(x[a:b] ^ y[a - offset : b - offset]).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(GAIN - LOSS * errors)))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return a + start, end - start, float(errors[start:end].sum() / (32 * max(1, end - start)))


class _Block:
    """Recordings of a block: their nodes, prints one after the other, and postings by key."""

    def __init__(self, own: pa.StructArray):
        self.node = own.field("node")
        prints = [np.frombuffer(p.as_py(), np.uint32) for p in own.field("prints")]
        self.size = np.array([len(p) for p in prints], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(prints)
        posted = [_postings(p) for p in prints]
        self.row = np.repeat(np.arange(len(prints)), [len(k) for k, _ in posted])  # by recording
        self.key, self.at = (np.concatenate([p[i] for p in posted]) for i in (0, 1))
        self.by_key = np.argsort(self.key, kind="stable")
        self.keys = self.key[self.by_key]


def _stretches(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """``shared_passage`` of recordings i of x and j of y at these offsets: starts, lengths and bit errors (whole numbers)."""
    a = np.maximum(0, offset)
    n = np.minimum(x.size[i], y.size[j] + offset) - a
    first = np.cumsum(n + 1) - (n + 1)  # a stretch of none stands first
    of = np.repeat(np.arange(len(i)), n + 1)
    at = np.arange(len(of)) - first[of]
    frame = np.maximum(at - 1, 0) + a[of]
    errors = np.bitwise_count(x.flat[x.start[i][of] + frame] ^ y.flat[y.start[j][of] + frame - offset[of]]).astype(np.int64)
    total = np.cumsum(np.where(at > 0, GAIN - LOSS * errors, 0))
    total -= total[first][of]
    apart = of * (2 * LOSS * 32 * (int(n.max()) + 1))  # so that the running minimum starts anew
    low = np.minimum.accumulate(total - apart) + apart
    rise, none = total - low, len(of)
    end = np.minimum.reduceat(np.where(rise == np.maximum.reduceat(rise, first)[of], at, none), first)
    begin = np.minimum.reduceat(np.where(total == low[first + end][of], at, none), first)
    frames = end - begin
    return a + begin, frames, (GAIN * frames - (total[first + end] - total[first + begin])) // LOSS


def _links(x: _Block, y: _Block, least_frames: int) -> tuple[np.ndarray, ...]:
    """i, j, offset, start, frames, errors of the pairs of recordings of x and y (i > j in one block) that share a passage: y, moved, agrees with x."""
    out = [np.empty((6, 0), np.int64)]
    low, high = np.searchsorted(y.keys, x.key, "left"), np.searchsorted(y.keys, x.key, "right")
    met, begin = np.cumsum(high - low), 0
    ends = np.searchsorted(x.row, np.arange(len(x.size)), "right")  # postings up to each recording's last
    while begin < len(met):
        before = met[begin] - (high - low)[begin]
        end = int(ends[x.row[max(begin, int(np.searchsorted(met, before + AT_ONCE, "right")) - 1)]])  # whole recordings
        n = (high - low)[begin:end]
        own = np.repeat(np.arange(begin, end), n)
        other = y.by_key[low[own] + np.arange(len(own)) - (np.cumsum(n) - n)[own - begin]]
        i, j, offset = x.row[own], y.row[other], x.at[own] - y.at[other]
        begin = end
        if x is y:
            i, j, offset = i[i > j], j[i > j], offset[i > j]
        if not len(i):
            continue
        (pair, offset), hits = _counted(i * len(y.size) + j, offset)
        i, j = pair // len(y.size), pair % len(y.size)
        room = np.cumsum(np.minimum(x.size[i], y.size[j]))
        cuts = [0, *(np.flatnonzero(np.diff(room // AT_ONCE)) + 1).tolist(), len(i)]
        found = [_stretches(x, y, i[p:q], j[p:q], offset[p:q]) for p, q in zip(cuts, cuts[1:]) if q > p]
        start, frames, errors = (np.concatenate(c) for c in zip(*found))
        best = np.lexsort((offset, np.abs(offset), -hits, errors, -frames, pair))
        best = best[np.concatenate(([True], np.diff(pair[best]) != 0))]
        best = best[frames[best] >= least_frames]
        out.append(np.stack([v[best] for v in (i, j, offset, start, frames, errors)]))
    return tuple(np.concatenate(out, axis=1))


def _counted(pair: np.ndarray, offset: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs of values, in order, and how often each occurs."""
    order = np.lexsort((offset, pair))
    pair, offset = pair[order], offset[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(offset) != 0))))
    return (pair[first], offset[first]), np.diff(np.append(first, len(pair)))


def fingerprints(recordings: DataFrame, samples: Callable[[object], np.ndarray], column: str, chroma: Chroma) -> DataFrame:
    """``recordings`` without ``column``, with n_frames and prints (packed 32-bit integers) instead.

    ``samples`` turns a value of the column into samples between -1 and 1: a decoder of the stored format.
    """
    taken = {column, "n_frames", "prints"}
    names = [c for c in recordings.columns if c not in taken]
    recordings = recordings.select(F.col(f"`{column}`").alias("recording"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in names]).alias("row"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[np.ndarray] = []
            held: list[np.ndarray] = []
            size = 0
            for v in each(batch.column(0)):
                held.append(samples(v) if v is not None else np.empty(0, np.float32))
                size += len(held[-1])
                if size > BLOCK_SAMPLES:
                    made += prints_of(held, chroma)
                    held, size = [], 0
            made += prints_of(held, chroma) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], ["row", "n_frames", "prints"])

    out = recordings.mapInArrow(tidy(make), f"row {recordings.schema['row'].dataType.simpleString()}, n_frames long, prints binary")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "n_frames", "prints")


def _blocks(prints: DataFrame) -> DataFrame:
    """a, b: pairs of blocks (lists of node and prints) of each part of the recordings (node, prints); b is null where a meets itself."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_postings(np.frombuffer(p.as_py(), np.uint32))[0] for p in batch.column("prints")]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)), batch.column("node").take(pa.array(rows.astype(np.int64)))], ["key", "node"])

    kind = prints.schema["node"].dataType.simpleString()
    posted = written(prints.select("node", "prints").mapInArrow(tidy(post), f"key long, node {kind}"), "postings")
    # A recording posts a key once; keys of one recording alone tie nothing and go before anything is joined.
    leaders = posted.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    part = components(posted.join(leaders, "key").select(F.col("node").alias("a"), F.col("first").alias("b")))
    drop_written(posted)
    tied = written(prints.select("node", "prints").join(part, "node"), "tied")
    cut = F.ceil(F.greatest(F.count("*") / BLOCK_RECORDINGS, F.sum(F.length("prints")) / BLOCK_BYTES))
    sizes = tied.groupBy("component").agg(cut.alias("of"))
    block = F.pmod(F.xxhash64("node"), F.col("of")).alias("block")
    lists = written(tied.join(sizes, "component").groupBy("component", "of", block).agg(F.collect_list(F.struct("node", "prints")).alias("a")), "blocks")
    alone = lists.select("a", F.lit(None).cast(lists.schema["a"].dataType).alias("b"))
    cut_up = lists.where("of > 1")
    later = cut_up.select("component", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("with"), "block").where(F.col("with") > F.col("block")).drop("block")
    across = later.join(cut_up.select("component", F.col("block").alias("with"), F.col("a").alias("b")), ["component", "with"]).select("a", "b")
    return keeps(alone.unionByName(across), tied, lists)


def _met(batches: Iterator[pa.RecordBatch], least_frames: int) -> Iterator[tuple[_Block, _Block, tuple[np.ndarray, ...]]]:
    """The blocks of each row and their links."""
    for batch in batches:
        for r in range(batch.num_rows):
            x = _Block(batch.column("a")[r].values)
            y = _Block(batch.column("b")[r].values) if batch.column("b")[r].is_valid else x
            links = _links(x, y, least_frames)
            if len(links[0]):
                yield x, y, links


def aligned(prints: DataFrame, least_frames: int = LEAST_FRAMES) -> DataFrame:
    """node, other, offset, start, frames, bit_error: each two recordings (columns node, prints) that post a hash alike and share a passage, once.

    ``recording_classes`` counts these without writing them down: copies in many versions make as many rows here as they make pairs.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, (i, j, offset, start, frames, errors) in _met(batches, least_frames):
            a, b = x.node.take(pa.array(i)), y.node.take(pa.array(j))
            yield pa.RecordBatch.from_arrays([a, b, *map(pa.array, (offset, start, frames, errors / (32 * frames)))], ["a", "b", "offset", "start", "frames", "bit_error"])

    kind = prints.schema["node"].dataType.simpleString()
    blocks = _blocks(prints)
    met = blocks.mapInArrow(tidy(pairs), f"a {kind}, b {kind}, offset long, start long, frames long, bit_error double")
    turned = F.col("a") > F.col("b")  # then the later one is the node and the earlier one stands still
    out = met.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"), F.when(turned, -F.col("offset")).otherwise(F.col("offset")).alias("offset"), F.when(turned, F.col("start") - F.col("offset")).otherwise(F.col("start")).alias("start"), "frames", "bit_error")
    out = written(out, "alignments")
    drop_written(blocks)
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n things the least that the links lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _summed(prints: DataFrame, least_frames: int) -> DataFrame:
    """node, root, n, best of each pair of blocks: how many links a recording has in it, the best of them, and a recording that links lead to."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, (i, j, offset, start, frames, errors) in _met(batches, least_frames):
            nodes = x.node if x is y else pa.concat_arrays([x.node, y.node])
            k = j if x is y else j + len(x.size)
            root = _roots(i, k, len(nodes))
            # Each link from both ends: a recording, moved by the offset, agrees with the other one from its frame ``start`` on.
            own, other = np.concatenate([i, k]), np.concatenate([k, i])
            moved, begin = np.concatenate([-offset, offset]), np.concatenate([start - offset, start])
            frames, errors = np.tile(frames, 2), np.tile(errors, 2)
            name = np.empty(len(nodes), np.int64)
            name[pa.compute.sort_indices(nodes).to_numpy()] = np.arange(len(nodes))
            order = np.lexsort((name[other], -errors / frames, frames, own))
            last = np.flatnonzero(np.append(np.diff(own[order]) != 0, True))
            best, n = order[last], np.diff(last, prepend=-1)
            kept = [nodes.take(pa.array(other[best])), *map(pa.array, (moved[best], begin[best], frames[best], errors[best] / (32 * frames[best])))]
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own[best])), nodes.take(pa.array(root[own[best]])), pa.array(n.astype(np.int64)), pa.StructArray.from_arrays(kept, ["other", "offset", "start", "frames", "bit_error"])], ["node", "root", "n", "best"])

    kind = prints.schema["node"].dataType.simpleString()
    blocks = _blocks(prints)
    out = written(blocks.mapInArrow(tidy(sums), f"node {kind}, root {kind}, n long, best struct<other: {kind}, offset: long, start: long, frames: long, bit_error: double>"), "alignments")
    drop_written(blocks)
    return out


def recording_classes(prints: DataFrame, least_frames: int = LEAST_FRAMES) -> DataFrame:
    """``prints`` (with n_frames and prints) with node, class, n_links and the best alignment (other, offset, start, frames, bit_error).

    ``n_links`` counts the other fingerprints that post a hash alike and share a passage; copies of one fingerprint count once.

    ``node`` is the SHA-256 of the fingerprint; ``class`` the least node that alignments lead to, null without one.
    """
    own = [c for c in prints.columns if c not in ("node", "class", "n_links", "other", "offset", "start", "frames", "bit_error")]
    whole = written(prints.select(*[F.col(f"`{c}`") for c in own]).withColumn("node", F.when(F.col("n_frames") > 0, F.sha2("prints", 256))), "fingerprints")
    nodes = written(whole.where("node IS NOT NULL").groupBy("node").agg(F.first("prints").alias("prints")), "recordings")
    links = _summed(nodes, least_frames)
    best = links.groupBy("node").agg(F.sum("n").alias("n_links"), F.max_by("best", F.struct("best.frames", -F.col("best.bit_error"), "best.other")).alias("best"))
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", F.col("component").alias("class"))
    of_node = written(nodes.select("node").join(labels, "node", "left").join(best, "node", "left").select("node", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best.*"), "recording-classes")
    drop_written(nodes, links)
    return keeps(whole.drop("prints").join(of_node, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), whole, of_node)


#: Text as sound: a word is a tone of TONE samples.
TONE, TONE_RATE, NOTES = 128, 2000, 36
TONES = Chroma(rate=TONE_RATE, window=256, hop=TONE, low=60.0, high=1000.0, span=8)


def tones(text: str) -> np.ndarray:
    """A text played word by word: each word's hash picks one of three octaves of notes above 110 Hz."""
    words = np.array(text.split(), dtype=object)
    if not len(words):
        return np.empty(0, np.float32)
    note = (pd.util.hash_array(words, categorize=False) % np.uint64(NOTES)).astype(int)
    t = np.arange(TONE) / TONE_RATE
    table = np.sin(2 * np.pi * (110.0 * 2 ** (np.arange(NOTES) / 12))[:, None] * t).astype(np.float32)
    return table[note].ravel()
