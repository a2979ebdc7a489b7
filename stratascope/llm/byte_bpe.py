"""Byte-level BPE over a corpus: each distinct word is encoded once, and its ids are joined back to where it stands.

1. Every task cuts its documents into pre-tokens. A chunk is a run of documents of about CHUNK_CHARS characters; within it
   each distinct word has a code, and a document is the array of its words' codes, in order of position. The chunk's words
   are dealt by hash into ``spark.sql.shuffle.partitions`` buckets, a row for each bucket.
2. The rows of words are shuffled by bucket. A task encodes each distinct word of its buckets once, and every chunk that
   holds the word gets its ids. A word costs an entry for each chunk that holds it, not for each occurrence.
3. The ids go back to their chunks, and each document is laid out anew from the ids of its words, position by position.
   The documents' codes are stored in buckets by chunk, so that only the words' ids are shuffled for this.

Decoding looks each id up in the table of token bytes, which every task holds, and joins the bytes in order.

Words and ids travel as arrays, for rows of single words take more disk than they may: README has the figures.

Cases: a null text is empty and has no ids; rows alike stay separate rows; a pre-token may be as long as the text; an
empty table gives an empty result; decoding gives null for null ids or an id that the table lacks. Input columns other
than the two named are not read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import goes_at_exit, keeps, shared_folder, tidy
from .tokens import each

CHUNK_CHARS, DOC_ROWS, MOST_KNOWN = 24_000_000, 256, 1_000_000
#: Either a document (doc_id and the codes of its words) or those words of the chunk that fall into a bucket: their codes, the
#: words one after the other, and their lengths.
CHUNK = "chunk long, doc_id long, codes array<int>, bucket int, words string, lengths array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line holds a token in base 64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))), pa.int32())


def _chunks(pattern: str, buckets: int, chunk_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, ints = ["chunk", "doc_id", "codes", "bucket", "words", "lengths"], pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        words: dict[str, int] = {}
        chunk, chars = uuid.uuid4().int >> 65, 0
        codes, sizes, ids = array("i"), [], []

        def documents() -> pa.RecordBatch:
            n = len(ids)
            own = pa.ListArray.from_arrays(_offsets(sizes), pa.array(np.frombuffer(codes, np.int32) if codes else [], pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array(ids, pa.int64()), own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, ints)], names)

        def vocabulary() -> Iterator[pa.RecordBatch]:
            every = list(words)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in every), np.int64, len(every))
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                own = order[a:b]
                here = [every[k] for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), pa.array([own], ints), pa.array([int(bucket[own[0]])], pa.int32()), pa.array(["".join(here)], pa.string()), pa.array([list(map(len, here))], ints)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), each(batch.column(1), 64)):
                before = len(codes)
                codes.extend([words.setdefault(w, len(words)) for w in find(text or "")])
                ids.append(doc_id)
                sizes.append(len(codes) - before)
                chars += len(text or "")
                if len(ids) >= DOC_ROWS or len(codes) > 1_000_000 or chars >= chunk_chars:
                    yield documents()
                    codes, sizes, ids = array("i"), [], []
                if chars >= chunk_chars:
                    yield from vocabulary()
                    words, chunk, chars = {}, uuid.uuid4().int >> 65, 0
        if ids:
            yield documents()
        yield from vocabulary()

    return cut


def _encode_words(ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """chunk, bucket, and of the bucket's words the numbers of ids and the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        known: dict[str, list[int]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                flat, sizes = array("i"), []
                words, upto = batch.column("words")[at].as_py(), 0
                for n in batch.column("lengths")[at].as_py():
                    word = words[upto : upto + n]
                    upto += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = whole.encode_ordinary(word)
                    flat.extend(ids)
                    sizes.append(len(ids))
                if len(known) > MOST_KNOWN:
                    known.clear()
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(at, 1), batch.column("bucket").slice(at, 1), pa.array([np.array(sizes, np.int32)], ints), pa.array([np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)], ints)], ["chunk", "bucket", "sizes", "ids"])

    return encode


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, one after the other."""
    if not len(sizes):
        return np.empty(0, np.int32)
    out = np.repeat((starts - np.cumsum(sizes, dtype=np.int64) + sizes).astype(np.int32), sizes)  # a chunk has far fewer than 2^31 ids
    out += np.arange(len(out), dtype=np.int32)
    return out


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and the lists' sizes."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def token_bytes(ranks: dict[bytes, int]) -> np.ndarray:
    """The table of tokens, by id."""
    out = np.full(max(ranks.values(), default=-1) + 1, None, dtype=object)
    for token, i in ranks.items():
        out[i] = token
    return out


def _decoded(ids: np.ndarray | None, table: np.ndarray) -> bytes | None:
    if ids is None or len(ids) and not (0 <= np.nanmin(ids) and np.nanmax(ids) < len(table)):
        return None
    parts = table[ids.astype(np.int64)].tolist()
    return None if None in parts else b"".join(parts)


def _lay_out(ranks, codes_at_once: int = 500_000) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """doc_id and ids of a chunk's documents, from the ids of its words; with ``ranks`` also the bytes that the ids stand for."""

    def lay_out(rows: pa.Table, words: pa.Table) -> pa.Table:
        docs, held = rows.filter(pc.is_null(rows["bucket"])), rows.filter(pc.is_valid(rows["bucket"])).sort_by("bucket")
        words = words.sort_by("bucket")
        if held["bucket"].to_pylist() != words["bucket"].to_pylist():
            raise RuntimeError("a chunk lacks the ids of some of its words")
        order = np.argsort(_flat(held["codes"])[0])
        flat, own = _flat(words["ids"])[0], _flat(words["sizes"])[0].astype(np.int64)
        starts, own = (np.cumsum(own) - own)[order], own[order]  # by code
        codes, sizes = _flat(docs["codes"])
        ends, doc_ids = np.cumsum(sizes), docs["doc_id"].combine_chunks()
        table = token_bytes(ranks.value) if ranks is not None else None
        out, a, kind = [], 0, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *[("decoded", pa.binary())] * (table is not None)])
        while a < len(ends):  # a few documents at a time
            low = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, low + codes_at_once, "right")))
            here = codes[low : ends[b - 1]]
            upto = np.concatenate(([0], np.cumsum(own[here])))[np.concatenate(([0], ends[a:b] - low))]
            ids = flat[_runs(starts[here], own[here])]
            columns = [doc_ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))]
            if table is not None:
                columns.append(pa.array([_decoded(ids[x:y], table) for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary()))
            out.append(pa.table(columns, schema=kind))
            a = b
        return pa.concat_tables(out) if out else kind.empty_table()

    return lay_out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs``; with ``decoded`` also the bytes that the ids decode to.

    ``ranks`` is a model of at most a few hundred thousand tokens and goes to every executor.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = Bucketed(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(tidy(_chunks(pattern, n, chunk_chars)), CHUNK), n, "chunk")
    shared = spark.sparkContext.broadcast(ranks)
    words = chunks.table().where("bucket IS NOT NULL").select("chunk", "bucket", "words", "lengths").repartition(n, "bucket")
    words = words.mapInArrow(tidy(_encode_words(shared)), "chunk long, bucket int, sizes array<int>, ids array<int>")
    laid = chunks.table().select("chunk", "doc_id", "codes", "bucket").groupBy("chunk").cogroup(words.groupBy("chunk"))
    return keeps(laid.applyInArrow(_lay_out(shared if decoded else None), "doc_id long, ids array<int>" + ", decoded binary" * decoded), chunks)


class Bucketed:
    """A table in the shared folder, bucketed by a column, until ``drop_written`` drops it."""

    def __init__(self, df: DataFrame, buckets: int, column: str):
        self.sparkSession, self.name = df.sparkSession, f"stratascope_{uuid.uuid4().hex}"
        self._written_path = f"{shared_folder(self.sparkSession)}/stratascope/{self.name}"
        goes_at_exit(self.sparkSession, self._written_path)
        df.write.bucketBy(buckets, column).option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.compression.codec.zstd.level", "9").option("path", self._written_path).format("parquet").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.sparkSession.table(self.name)

    def _drop_table(self) -> None:
        self.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``out``: the bytes that its ids stand for, looked up in the table of tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    at = encoded.columns.index(ids)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(shared.value)
        for batch in batches:
            texts = [_decoded(own.values.to_numpy(zero_copy_only=False) if own.is_valid else None, table) for own in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out])

    return encoded.mapInArrow(tidy(look_up), StructType([*encoded.schema.fields, StructField(out, BinaryType())]))


def encoded_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, and its ids if they are to be kept."""
    both = encode(docs, ranks, pattern, decoded=True)
    digests = [F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return keeps(both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests, *["ids"] * keep_ids), both)
