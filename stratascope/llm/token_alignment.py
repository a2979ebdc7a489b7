"""Alignment of two tokenizers' tokens over a corpus, and how often each pair of tokens ends together.

1. Every task encodes its texts by both tokenizers and aligns the arrays of byte ends by diagonal run skipping: as long as
   the tokens lie one to one, an end's index in the one array is its index in the other plus a shift, and probes of 1, 2,
   4, ... ends at that shift jump over such stretches; a group that isn't one to one is resolved by stepping both arrays
   to their next common end, which gives the new shift.
2. A chunk is a run of documents of about CHUNK_CHARS characters. Its distinct linked pairs of ids are numbered, with how
   often each occurs; a document is stored as the numbers of its distinct pairs and their occurrences.
3. Counts are summed over chunks, a row for each pair and chunk; the largest count of each B id is a table no longer than
   B's vocabulary. Each chunk gets the counts of its pairs back, and lays its documents out from them.

Every token has at least one byte, so that ends increase strictly: each common end is one group and one link.

Cases: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: zeros and an
empty digest. Special tokens' strings in a text are plain text. Rows that repeat stay separate, a null id stays null; a
text of any length is aligned whole, in memory in proportion to it. An empty table gives an empty result. Columns other
than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import keeps, tidy, written
from .tokens import each

CHUNK_CHARS, DOC_ROWS, B_BITS = 8_000_000, 256, 32
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes array<int>, times array<int>, pairs array<long>, ns array<long>"
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A tokenizer from a JSON file of byte-level BPE whose ids are in the order of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model.get("added_tokens", [])}
        alphabet = byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        self.size = 1 + max(self.ranks.values())

    def encoder(self, pattern: str) -> Callable[[str], np.ndarray]:
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        return lambda text: np.array(own.encode_ordinary(" " + text), np.int32)

    def table(self) -> list[bytes]:
        out = [b""] * self.size
        for token, i in self.ranks.items():
            out[i] = token
        return out


class Pieces:
    """A sentencepiece model with byte fallback; it sets the space before a text itself."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()

    def encoder(self) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
        own = SentencePieceProcessor(model_proto=self.proto)
        pieces = [(own.IdToPiece(i), own.IsByte(i)) for i in range(own.GetPieceSize())]
        table = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        return lambda text: np.array(own.encode(text, num_threads=1), np.int32), table


def common_ends(a: list[int], b: list[int]) -> list[int]:
    """Runs and groups (i, j, n, m), one after the other in one list: tokens i to i + n and j to j + m.

    If n = m they lie one to one; otherwise they are one group. ``a`` and ``b`` hold increasing ends with the same last one.
    """
    out: list[int] = []
    add, i, j, n = out.extend, 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            start, size = i, 2
            i, j = i + 1, j + 1
            while i < n and a[i : i + size] == b[j : j + size]:  # probes double as long as they fit the shift j - i
                i, j, size = i + size, j + size, 2 * size
            while size > 1 and i < n:  # and then halve, to where the stretch ends
                size //= 2
                if a[i : i + size] == b[j : j + size]:
                    i, j = i + size, j + size
            if i > n:  # the last probe reached over the end
                i, j = n, j - (i - n)
            add((start, j - i + start, i - start, i - start))
        else:  # an irregular group: on to the next common end
            p, q = i, j
            while x != y:
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
            add((i, j, p + 1 - i, q + 1 - j))
            i, j = p + 1, q + 1
    return out


@cache
def _shown(size: int) -> pa.Array:
    """Each id with each sign that can follow it: 4 * id + (0 a comma, 1 a bar, 2 a semicolon)."""
    return pa.array([f"{i}{sign}" for i in range(size) for sign in ",|;,"])


def laid_out(table: pa.Array, at: np.ndarray) -> memoryview:
    """The texts or bytes at these places of a table, one after the other."""
    rows = table.take(pa.array(at))
    _, offsets, data = rows.buffers()
    end = np.frombuffer(offsets, np.int32, len(at) + 1)[-1]
    return memoryview(data).cast("B")[:end] if data is not None else memoryview(b"")


def aligned(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[int, memoryview, np.ndarray]:
    """The number of groups, the groups as ASCII text, and the linked pairs of ids, a << 32 | b."""
    listed_a, listed_b = ends_a.tolist(), ends_b.tolist()
    found = np.array(common_ends(listed_a, listed_b), np.int64).reshape(-1, 4)
    # one to one: as many tokens on both sides that start to end together; any other stretch is one group
    single = (found[:, 2] == found[:, 3]) & (ends_a[found[:, 0]] == ends_b[found[:, 1]])
    groups = np.where(single, found[:, 2], 1)
    within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
    last_a, last_b = (np.repeat(np.where(single, found[:, k], found[:, k] + found[:, k + 2] - 1), groups) + within for k in (0, 1))
    # in the text, A's tokens of a group stand after B's of the groups before it, and B's after A's of the group itself
    codes, before = np.empty(len(a) + len(b), np.int32), np.concatenate(([-1], last_b[:-1])) + 1
    place_a = np.arange(len(a)) + np.repeat(before, np.diff(last_a, prepend=-1))
    place_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
    codes[place_a], codes[place_b] = 4 * a, 4 * b
    codes[place_a[last_a]] += 1
    codes[place_b[last_b]] += 2
    text = laid_out(_shown(1 << max(16, int(codes.max()).bit_length() - 2)), codes)
    return len(last_a), text[:-1], a[last_a].astype(np.int64) << B_BITS | b[last_b].astype(np.int64)


def _align(shared, pattern: str, chunk_chars: int, keep_groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, ints, longs = [c.split()[0] for c in ALIGNED.split(", ")], pa.list_(pa.int32()), pa.list_(pa.int64())

    def rows(chunk: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [d[6] for d in docs]
        own, code = np.unique(np.concatenate(pairs), return_inverse=True)
        times = [d[7] for d in docs]
        ns = np.bincount(code, np.concatenate(times), len(own)).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum([len(p) for p in pairs])))
        for at in range(0, len(docs), DOC_ROWS):
            part = docs[at : at + DOC_ROWS]
            bounds = pa.array(upto[at : at + len(part) + 1] - upto[at], pa.int32())
            inside = slice(upto[at], upto[at + len(part)])
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (code[inside], np.concatenate(times[at : at + len(part)]))]
            none = pa.nulls(len(part), longs)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), *[pa.array([d[k] for d in part], pa.string() if k > 3 else pa.int64()) for k in range(6)], *lists, none, none], names)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, *[pa.nulls(1, pa.string())] * 2, pa.nulls(1, ints), pa.nulls(1, ints), pa.array([own], longs), pa.array([ns], longs)], names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_level, pieces = shared.value
        encode_a, table_a = byte_level.encoder(pattern), byte_level.table()
        encode_b, table_b = pieces.encoder()
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (table_a, table_b))
        table_a, table_b = (pa.array(t, pa.binary()) for t in (table_a, table_b))
        nothing = (0, 0, 0, "", "" if keep_groups else None, np.empty(0, np.int64), np.empty(0, np.int32))
        chunk, chars, docs = uuid.uuid4().int >> 65, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), each(batch.column(1), 64)):
                found = nothing
                if text:
                    a, b, whole = encode_a(text), encode_b(text), (" " + text).encode()
                    if laid_out(table_a, a) == whole == laid_out(table_b, b):
                        n, groups, links = aligned(a, b, np.cumsum(size_a[a]), np.cumsum(size_b[b]))
                        pairs, times = np.unique(links, return_counts=True)
                        found = (len(a), len(b), n, hashlib.sha256(groups).hexdigest(), bytes(groups).decode() if keep_groups else None, pairs, times.astype(np.int32))
                docs.append((doc_id, *found))
                chars += len(text or "") + 64
                if chars >= chunk_chars:
                    yield from rows(chunk, docs)
                    chunk, chars, docs = uuid.uuid4().int >> 65, 0, []
        if docs:
            yield from rows(chunk, docs)

    return align


def _lay_out(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links; ``facts`` has the count of each of the chunk's pairs."""
    facts = facts.sort_by("code")
    total, best = facts["total"].to_numpy(), facts["best"].to_numpy()
    lists = [docs[c].combine_chunks() for c in ("codes", "times")]
    codes, times = (x.flatten().to_numpy() for x in lists)
    bounds = lists[0].offsets.to_numpy() - (lists[0].offsets[0].as_py() if len(lists[0]) else 0)
    upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[bounds])
    times = times.astype(np.int64)
    own = [docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
    return pa.table([*own, pa.array(upto(times * best[codes])), pa.array(upto(times * total[codes])), docs["groups_sha256"], docs["groups"]], names=[c.split()[0] for c in FOUND.split(", ")])


def alignments(docs: DataFrame, byte_level: ByteLevel, pieces: Pieces, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if they are to be kept, groups of every row of ``docs``.

    Both tokenizers are models of bounded size and go to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))
    one = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(tidy(_align(shared, pattern, chunk_chars, keep_groups)), ALIGNED)
    chunks = written(one, "aligned")
    held = chunks.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "ns")).alias("code", "own"))
    held = held.select("chunk", "code", F.col("own.pairs").alias("pair"), F.col("own.ns").alias("n"))
    totals = written(held.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("id_b")
    highest = totals.groupBy(id_b).agg(F.max("total").alias("highest"))  # a row for an id of B's vocabulary at most
    flagged = totals.withColumn("id_b", id_b).join(F.broadcast(highest), "id_b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    facts = held.select("chunk", "code", "pair").join(flagged, "pair").select("chunk", "code", "total", "best")
    again = chunks.sparkSession.read.schema(chunks.schema).parquet(chunks._written_path)
    laid = again.where("pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "codes", "times").groupBy("chunk").cogroup(facts.groupBy("chunk"))
    found = laid.applyInArrow(_lay_out, FOUND)
    return keeps(found if keep_groups else found.drop("groups"), chunks, totals)


def pair_counts(found: DataFrame) -> DataFrame:
    """id_a, id_b, total: how often each pair of ids ends together, from the result of ``alignments`` while its tables are kept."""
    totals = found._written_reads[1]
    return totals.select(F.shiftright("pair", B_BITS).cast("int").alias("id_a"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).cast("int").alias("id_b"), "total")

