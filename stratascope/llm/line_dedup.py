"""Lines that repeat, exactly or within a few edits: an edit-distance join over segments.

1. Equal lines are one line, kept where it stands first: by doc_id, then by place in the text.
2. A line of length l is cut into EDITS + 1 even segments. A line within EDITS edits of it holds one of them, shifted by
   no more than the edits before or after allow. Each line puts its own segments into an index by (length, segment
   number, text) and probes the index of every length up to EDITS below its own with its substrings in those windows.
   Only hashes travel, and they are summed up by hash before the shuffle, so that a frequent one is a row a task; lines
   whose hashes meet another line's are then fetched with their text.
3. Lines that met are compared within their group: letter counts must nearly agree, then a banded bit-parallel edit
   distance decides, many pairs at a time. A group sends on the links that join its lines, never its pairs; lines already
   joined aren't compared again. A group of more than FEW lines is cut again, by the same index over what its lines don't
   all have in common; groups of more than MOST lines are dealt out in pairs of blocks before that.
4. Linked lines form classes; the line that stands first stays and the others go.

Lines are compared without blanks at their ends. Lines under LEAST_CHARS characters repeat only exactly; blank lines are
left alone.

Cases: a null text stays null and has no lines; repeated rows of one doc_id are one document, whose own lines count once
each, and where their texts differ each row loses its own repeats only; a null doc_id comes before all others; an empty table gives an empty result. A document that had lines and loses
all of them is dropped by ``without_repeats``; other columns are carried along.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, keeps, packed, tidy, written
from .graph import components

EDITS, LEAST_CHARS, MOST, FEW, LONG = 2, 20, 20_000, 48, 512
MOST_BROADCAST = 500_000
LETTERS = 32


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 segments, the longer ones last."""
    n = edits + 1
    short, longer = length // n, length % n
    sizes = [short + (i >= n - longer) for i in range(n)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(n)]


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line of this length looks up, its own index entries left out."""
    out = []
    for shorter in range(max(0, length - edits), length + 1):
        gap = length - shorter
        for i, (at, size) in enumerate(segments(shorter, edits)):
            low, high = max(-i, gap - (edits - i)), min(i, gap + (edits - i))
            out += [(shorter, i, at + d, size) for d in range(low, high + 1) if 0 <= at + d <= length - size and not (gap == 0 and d == 0)]
    return out


def segment_key(text: str, length: int, segment: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=length * 16 + segment)


def _keys(edits: int, most_known: int = 500_000) -> Callable:
    """key, line, own: index entries (own) and probes of a task's distinct lines."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        plans: dict[int, tuple[list, list]] = {}
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, sizes, ids, owns = [], [], [], []
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if line in known:
                    continue
                known.add(line)
                n = len(text)
                if n not in plans:
                    if len(plans) > 20_000:
                        plans.clear()
                    plans[n] = ([(a, a + k, n * 16 + i) for i, (a, k) in enumerate(segments(n, edits))], [(a, a + k, m * 16 + i) for m, i, a, k in probes(n, edits)])
                own, others = plans[n]
                keys += [digest(text[a:b].encode(), seed=s) for a, b, s in own]
                keys += [digest(text[a:b].encode(), seed=s) for a, b, s in others]
                ids.append(line)
                sizes.append(len(own) + len(others))
                owns.append(len(own))
            if len(known) > most_known:
                known.clear()
            sizes = np.array(sizes, np.int64)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.arange(len(keys)) - first < np.repeat(np.array(owns, np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(own)], ["key", "line", "own"])

    return make


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by the column ``key``, cut so that no key is spread over two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        if held and held[-1].column("key")[-1].as_py() != key[0]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        cut = int(np.searchsorted(key, key[-1])) if np.all(key[:-1] <= key[1:]) else int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield from pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bounded_distances(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distances, edits + 1 standing for any larger one.

    Each pair is one lane of 64-bit words: the bits are the vertical differences on 2 * edits + 1 diagonals of the
    distance matrix, moved along the diagonal a character at a time.
    """
    out = np.full(len(pairs), edits + 1, np.int64)
    lanes = []
    for k, (x, y) in enumerate(pairs):
        if len(x) < len(y):
            x, y = y, x
        if len(x) - len(y) > edits:
            continue
        a, b = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(b)
        differ = np.flatnonzero(a[:n] != b)
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(a[len(a) - n :] != b)
        tail = min(n - 1 - int(differ[-1]) if len(differ) else n, n - head)
        a, b = a[head : len(a) - tail], b[head : n - tail]
        if len(a) <= edits:
            out[k] = max(len(a), len(b)) if not len(b) else _plain_distance(a, b, edits)
        elif len(b) <= edits:
            out[k] = _plain_distance(a, b, edits)
        else:
            lanes.append((k, a, b))
    lanes.sort(key=lambda lane: len(lane[1]))
    for at in range(0, len(lanes), 1024):
        part = lanes[at : at + 1024]
        out[[k for k, _, _ in part]] = _banded([a for _, a, _ in part], [b for _, _, b in part], edits)
    return out


def _plain_distance(a: np.ndarray, b: np.ndarray, edits: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], edits + 1)


def _banded(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Lanes with len(a) >= len(b) > edits and len(a) - len(b) <= edits."""
    n, m = (np.array([len(s) for s in side]) for side in (a, b))
    x, y = np.zeros((len(a), int(n.max())), np.uint32), np.zeros((len(a), int(m.max())), np.uint32)
    for k, (p, q) in enumerate(zip(a, b)):
        x[k, : len(p)] = p + 2
        y[k, : len(q)] = q + 2
    return _banded_lanes(x, n, y, m, edits)


def _banded_lanes(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, edits: int) -> np.ndarray:
    """A lane a row: code points plus 2 of the longer and of the shorter text, 0 where it has ended, and their lengths."""
    a = n
    rows = np.zeros((x.shape[1] + 2 * edits + 1, len(a)), np.uint32)
    rows[edits : edits + x.shape[1]] = x.T
    cols = np.ascontiguousarray(np.where(y == 0, np.uint32(1), y).T)  # 0 and 1 stand for no character, and differ
    u = np.uint64
    one, top = u(1), u(63)
    bits = [u(1 << (63 - k)) for k in range(2 * edits + 1)]
    vp, vn = np.full(len(a), u(((1 << (edits + 1)) - 1) << (63 - edits))), np.zeros(len(a), np.uint64)
    score, done = np.full(len(a), edits, np.int64), np.full(len(a), edits + 1, np.int64)
    for i in range(int(m.max())):
        eq = np.zeros(len(a), np.uint64)
        for k, bit in enumerate(bits):  # bit 63 - k stands for row i + edits - k
            eq |= np.where(rows[i + 2 * edits - k] == cols[i], bit, u(0))
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = i < n - edits
        place = np.clip(62 - (i - (n - edits)), 0, 63).astype(np.uint64)
        across = ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64)
        score += np.where(diagonal, 1 - ((d0 >> top) & one).astype(np.int64), across)
        ends = i == m - 1
        done[ends] = score[ends]
        d0 >>= one
        vp, vn = hn | ~(d0 | hp), d0 & hp
        if i % 16 == 15 and (score[i < m - 1] > 3 * edits).all():
            break
    return np.minimum(done, edits + 1)


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often characters of each of LETTERS kinds occur."""
    out = np.zeros((len(texts), LETTERS), np.int32)
    for k, t in enumerate(texts):
        out[k] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS)
    return out


class Links:
    """The links found among some lines, and which lines they join."""

    def __init__(self, n: int):
        self.label, self.found = np.arange(n), []

    def add(self, i: int, j: int) -> None:
        if self.label[i] != self.label[j]:
            self.found.append((int(i), int(j)))
            self.label[self.label == self.label[j]] = self.label[i]


class Links:
    """The links found among some lines, and which lines they join.

    Candidate pairs are gathered, and compared in batches; pairs whose lines are joined by then are passed over.
    """

    def __init__(self, texts: list[str], edits: int, batch: int = 1_000_000):
        self.texts, self.edits, self.batch = texts, edits, batch
        self.parent, self.label, self.found, self.waiting = list(range(len(texts))), np.arange(len(texts)), [], array("q")
        raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
        self.codes = np.frombuffer(b"".join(raw), np.uint32)
        self.sizes = np.array([len(r) // 4 for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = letter_counts(texts)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def joined(self, lines: list[int]) -> bool:
        return len({self.root(i) for i in lines}) == 1

    def pairs(self, some: list[int], others: list[int]) -> None:
        """Each of ``some`` is to be compared with each of ``others``."""
        n = len(self.texts)
        self.waiting.extend([i * n + j if i < j else j * n + i for i in some for j in others if i != j])
        if len(self.waiting) > self.batch:
            self.compare()

    def compare(self) -> None:
        n, e = max(1, len(self.texts)), self.edits
        codes = np.unique(np.frombuffer(self.waiting, np.int64)) if self.waiting else np.empty(0, np.int64)
        self.waiting = array("q")
        for at in range(0, len(codes), 8192):
            i, j = codes[at : at + 8192] // n, codes[at : at + 8192] % n
            use = (self.label[i] != self.label[j]) & (np.abs(self.sizes[i] - self.sizes[j]) <= e)
            i, j = i[use], j[use]
            use = np.abs(self.letters[i] - self.letters[j]).sum(axis=1) <= 2 * e  # an edit changes two counts at most, by one each
            i, j = i[use], j[use]
            if len(i):
                near = self.distances(i, j) <= e
                for x, y in zip(i[near].tolist(), j[near].tolist()):
                    if (p := self.root(x)) != (q := self.root(y)):
                        self.parent[max(p, q)] = min(p, q)
                        self.found.append((x, y))
                if near.any():
                    self.label = np.array(self.parent)
                    while (self.label[self.label] != self.label).any():
                        self.label = self.label[self.label]
                    self.parent = self.label.tolist()

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distances, edits + 1 standing for any larger one."""
        swap = self.sizes[i] < self.sizes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = np.full(len(i), self.edits + 1, np.int64)
        usual = (self.sizes[j] > self.edits) & (self.sizes[i] <= LONG)
        lanes = np.flatnonzero(usual)
        lanes = lanes[np.argsort(self.sizes[i[lanes]], kind="stable")]
        for at in range(0, len(lanes), 1024):
            k = lanes[at : at + 1024]
            out[k] = _banded_lanes(*self.lanes(i[k]), *self.lanes(j[k]), self.edits)
        k = np.flatnonzero(~usual)
        if len(k):
            out[k] = bounded_distances([(self.texts[a], self.texts[b]) for a, b in zip(i[k], j[k])], self.edits)
        return out

    def lanes(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[i]
        at = np.arange(int(n.max()))
        inside = at < n[:, None]
        return np.where(inside, self.codes[np.minimum(self.starts[i][:, None] + at, len(self.codes) - 1)] + np.uint32(2), np.uint32(0)), n


def group_links(texts: list[str], own: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """Links that join the lines of a group wherever a line with its own segment there and another are near enough."""
    links = Links(texts, edits)
    join_group(list(range(len(texts))), own.tolist(), links)
    links.compare()
    return links.found


def join_group(lines: list[int], own: list[bool], links: Links) -> None:
    if len(lines) <= FEW:
        links.pairs([i for i, o in zip(lines, own) if o], lines)
    else:
        _join(lines, [links.texts[i] for i in lines], links)


def _trimmed(texts: list[str]) -> list[str]:
    """Without what all of them begin with."""
    low, high = min(texts), max(texts)
    n = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    return [t[n:] for t in texts]


def _join(lines: list[int], rests: list[str], links: Links) -> None:
    """Candidates among many lines, by an index over the segments of their rests.

    Two lines within the edits have rests within the edits wherever the pieces taken out so far are what they share.
    """
    edits, size = links.edits, sum(map(len, rests))
    rests = [t[::-1] for t in _trimmed([t[::-1] for t in _trimmed(rests)])]
    tiny: dict[str, list[int]] = {}
    groups: dict[tuple[int, int, str], tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
    plans: dict[int, tuple[list, list]] = {}
    for k, r in enumerate(rests):
        n = len(r)
        if n <= 2 * edits:
            tiny.setdefault(r, []).append(lines[k])
        if n <= edits:  # no segments
            continue
        if n not in plans:
            plans[n] = ([(i, a, w) for i, (a, w) in enumerate(segments(n, edits))], [x for x in probes(n, edits) if x[0] > edits])
        for i, a, w in plans[n][0]:
            groups.setdefault((n, i, r[a : a + w]), ([], []))[0].append((k, a))
        for m, i, a, w in plans[n][1]:
            groups.setdefault((m, i, r[a : a + w]), ([], []))[1].append((k, a))
    for r, some in tiny.items():
        if len(r) <= edits:
            for t, others in tiny.items():
                if t != r:
                    links.pairs(some, others)
        if len(some) > FEW:  # lines that differ at most in where the pieces stood
            links.pairs(some[:1], some)
            links.compare()
        if not links.joined(some):
            links.pairs(some, some)
    for (_, _, piece), (own, others) in groups.items():
        if not own or len(own) + len(others) < 2:
            continue
        members = own + others
        if len(members) > FEW:
            ids = list(dict.fromkeys(lines[k] for k, _ in members))
            if links.joined(ids):
                continue
            # What is left of the lines where this piece is taken out; a line may hold it in several places.
            cut = [rests[k][:a] + "\0" + rests[k][a + len(piece) :] for k, a in members]
            if len(ids) > FEW and sum(map(len, cut)) < size:
                links.compare()
                if not links.joined(ids):
                    _join([lines[k] for k, _ in members], cut, links)
                continue
        links.pairs([lines[k] for k, _ in own], [lines[k] for k, _ in members])


def _links(edits: int) -> Callable:
    """a, b: of rows sorted by key, each group's links."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches):
            key, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line"))
            own = batch.column("own").to_pylist()
            ids, first, at = np.unique(line, return_index=True, return_inverse=True)
            links, at = Links(batch.column("text").take(pa.array(first)).to_pylist(), edits), at.tolist()
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() + [len(key)]
            for s, e in zip(start, start[1:]):
                if e - s > 1:
                    join_group(at[s:e], own[s:e], links)
            links.compare()
            a, b = (ids[[x[k] for x in links.found]] if links.found else np.empty(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return link


def _bare(line: Column) -> Column:
    """A line without blanks at its ends."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (hash), check (a second hash) and text of every line that isn't blank."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).select("doc_id", "line_no", _bare(F.col("raw")).alias("text"))
    return each.where("text <> ''").select("doc_id", "line_no", F.xxhash64("text").alias("line"), F.xxhash64("text", F.lit(1)).alias("check"), "text")


def _dealt(met: DataFrame, most: int) -> DataFrame:
    """Rows of keys with more than ``most`` lines, dealt into pairs of blocks under keys of their own; other rows as they are."""
    large = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if large.isEmpty():
        return met
    rows = met.join(large, "key", "left")
    blocks = F.ceil(2 * F.col("n") / most).cast("int")
    mine = F.pmod(F.xxhash64("line", F.lit(2)), blocks.cast("long"))
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    dealt = rows.withColumn("mine", mine).withColumn("other", other)
    key = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return dealt.select(key.alias("key"), "line", "own")


def line_classes(lines: DataFrame, edits: int = EDITS) -> DataFrame | None:
    """line, class: for the lines (columns line, text) that are near another; None if there are none."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = written(lines.select("line", "text").mapInArrow(tidy(_keys(edits)), "key long, line long, own boolean"), "keys")
    several = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.max("own").alias("own")).where("low <> high AND own")
    several = written(several.select("key"), "shared-keys")
    few = several.count() <= MOST_BROADCAST
    met = keys.join(F.broadcast(several) if few else several, "key").groupBy("key", "line").agg(F.max("own").alias("own"))
    met = written(met, "met")
    drop_written(keys, several)
    wanted = written(met.select("line").distinct(), "wanted")
    few = wanted.count()
    if not few:
        drop_written(met, wanted)
        return None
    texts = lines.select("line", "text").join(F.broadcast(wanted) if few <= MOST_BROADCAST else wanted, "line")
    texts = written(texts.groupBy("line").agg(F.first("text").alias("text")), "line-texts")
    groups = _dealt(met, MOST).join(texts, "line").select("key", "line", "own", "text")
    links = groups.repartition(parts, "key").sortWithinPartitions("key", "line").mapInArrow(tidy(_links(edits)), "a long, b long")
    links = written(links, "line-links")
    out = None if links.isEmpty() else written(components(links).select(F.col("node").alias("line"), F.col("component").alias("class")), "classes")
    drop_written(met, wanted, texts, links)
    return out


def repeated_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line (its hash), first_doc, first_line, exact: every line that repeats one that stands first elsewhere.

    ``exact`` tells whether a line with the same text stands before it.
    """
    pairs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = _lines(pairs)
    slim = written(lines.select("doc_id", "line_no", "line", "check"), "lines")
    classes = line_classes(lines.where(F.length("text") >= least_chars), edits)
    first = slim.groupBy("line", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    if classes is not None:
        first = first.join(classes, "line", "left").withColumn("class", F.coalesce("class", "line"))
        least = first.groupBy("class").agg(F.min("first").alias("class_first"))
        first = first.join(least, "class").select("line", "check", "first", "class_first")
    else:
        first = first.withColumn("class_first", F.col("first"))
    first = written(first, "first-lines")
    here = F.struct("doc_id", "line_no")
    later = slim.join(first, ["line", "check"]).where(~here.eqNullSafe(F.col("class_first")))
    drop_written(classes)
    return keeps(later.select("doc_id", "line_no", "line", F.col("class_first.doc_id").alias("first_doc"), F.col("class_first.line_no").alias("first_line"), (~here.eqNullSafe(F.col("first"))).alias("exact")).distinct(), slim, first)


def repeat_report(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_repeats, n_near, repeats (line numbers from 0, joined by commas) and first_docs (where those lines stand first) of every row."""
    found = repeated_lines(docs, edits, least_chars, doc_id, text)
    own = F.array_sort(F.collect_list(F.struct("line_no", "first_doc", "exact")))  # the lines of one text
    by_doc = written(found.groupBy("doc_id").agg(own.alias("own")), "repeats")
    drop_written(found)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col(f"`{text}`").cast("string"), "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.alias("r").join(by_doc.alias("b"), F.expr("r.doc_id <=> b.doc_id"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    joined = lambda field: F.coalesce(F.array_join(F.transform("own", lambda x: x[field].cast("string")), ",", "null"), F.lit(""))
    out = out.select("r.doc_id", n(F.col("n_lines")).alias("n_lines"), F.when(F.col("own").isNull(), 0).otherwise(F.size("own")).cast("long").alias("n_repeats"), F.when(F.col("own").isNull(), 0).otherwise(F.size(F.filter("own", lambda x: ~x["exact"]))).cast("long").alias("n_near"), joined("line_no").alias("repeats"), joined("first_doc").alias("first_docs"))
    return keeps(out, by_doc)


def without_repeats(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the lines that repeat earlier ones; rows that lose all their lines go."""
    found = repeated_lines(docs, edits, least_chars, doc_id, text)
    by_doc = written(found.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "line")).alias("gone")), "repeats")
    drop_written(found)
    rows = packed(docs, key=F.col(f"`{doc_id}`").cast("long")).alias("r").join(by_doc.alias("b"), F.expr("r.key <=> b.doc_id"), "left")
    lines = F.split(F.col(f"row.`{text}`").cast("string"), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", F.struct(i.alias("line_no"), F.xxhash64(_bare(x)).alias("line"))))
    whole = F.col(f"row.`{text}`")
    kept = rows.withColumn("left", F.when(F.col("gone").isNotNull(), left)).where(F.col("left").isNull() | F.exists("left", lambda x: F.length(_bare(x)) > 0))
    return keeps(kept.select(*[(F.when(F.col("left").isNull(), whole).otherwise(F.array_join("left", "\n")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]), by_doc)
