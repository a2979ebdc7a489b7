"""Token alignment against a plain version with the tokenizers' own libraries; bit-plane clusters against SQL and plain integers."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import rows
from tokenizers import Tokenizer

from stratascope.llm import bit_clusters, token_alignment

ODD = ["a▁b", "<|endoftext|> <s> </s> x", "x" * 5000 + " " * 300 + "é" * 700, "\x00\t\r\n   ​𝔘 it's", "  lead  two ", "naïve café\n\nRésumé — 東京", "1234567 12:30", None, ""]


@pytest.fixture(scope="module")
def models():
    return token_alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), token_alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, name = token_alignment.byte_alphabet(), {i: s for s, i in t.get_vocab().items()}
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b, links, groups = [], [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(alphabet[c] for c in name[i]) for i in a]
            bytes_b = [bytes([int(sp.IdToPiece(i)[3:5], 16)]) if sp.IsByte(i) else sp.IdToPiece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == whole == b"".join(bytes_b):
                a = b = []
            ends, upto = {}, 0
            for k, x in enumerate(bytes_a if a else []):
                upto += len(x)
                ends[upto] = k
            upto = i0 = j0 = 0
            for k, x in enumerate(bytes_b if a else []):
                upto += len(x)
                if (i := ends.get(upto)) is not None:
                    groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : k + 1])))
                    links.append((a[i], b[k]))
                    i0, j0 = i + 1, k + 1
        counts.update(links)
        found.append((doc_id, len(a), len(b), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    out = [(d, na, nb, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), digest(g), g) for d, na, nb, ls, g in found]
    return sorted(out, key=repr)


def test_alignment_equals_plain_version(spark, models, make_docs):
    rng = random.Random(5)
    words = "the of naïve résumé tokenization 12,345 don't https://example.com/a?b=c\t snake_case   München 東京 ﬁ".split(" ")
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 300))), "s") for i in range(60)]
    docs += [(100 + i, t, "s") for i, t in enumerate(ODD)] + [(None, "a null id", "s"), (7, docs[7][1], "s")]
    want = plain_alignment([d[:2] for d in docs])
    for chunk_chars in (500, 10_000_000):  # whatever the chunks, counts are over all documents
        got = token_alignment.alignments(make_docs(docs), *models, public_tokenizers.PATTERN, chunk_chars=chunk_chars, keep_groups=True)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_alignment_of_odd_tables(spark, models, make_docs, odd_rows):
    got = token_alignment.alignments(make_docs(odd_rows), *models, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:-1] for r in plain_alignment([r[:2] for r in odd_rows])), key=repr)
    counted = token_alignment.pair_counts(got).groupBy().sum("total").first()[0]
    assert counted == got.groupBy().sum("n_links").first()[0]
    assert token_alignment.alignments(make_docs([]), *models, public_tokenizers.PATTERN).collect() == []
    nothing = token_alignment.alignments(make_docs([(1, None, "a"), (2, "", "a")]), *models, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_runs_are_skipped_at_every_shift():
    rng = random.Random(1)
    for _ in range(300):
        last = rng.randint(1, 400)
        a, b = (sorted({*rng.sample(range(1, last + 1), rng.randint(1, last)), last}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*a, *rng.sample(range(1, last + 1), min(last, 3))})
        i = j = 0
        ends = []
        found = token_alignment.common_ends(a, b)
        for x, y, n, m in zip(found[::4], found[1::4], found[2::4], found[3::4]):
            assert (x, y) == (i, j)
            i, j = x + n, y + m
            ends += [a[x + k] for k in range(n)] if a[x : x + n] == b[y : y + m] else [a[x + n - 1]]
        assert ends == sorted(set(a) & set(b)) and (i, j) == (len(a), len(b))


def test_byte_pairs_of_one_length_may_end_apart():
    a, b = np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8])
    n, text, _ = token_alignment.aligned(a, b, np.array([1, 3, 4, 5]), np.array([2, 3, 4, 5]))
    assert (n, bytes(text)) == (3, b"1,2|5,6;3|7;4|8")


def vectors(n=400, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=64) * scale).tolist(), "clash", 1) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, planes string, cluster int")


def in_sql(rows_of):
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    if rows_of:
        db.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows_of])
    return db.sql(bit_clusters.CLUSTERS_SQL).df()


@pytest.mark.parametrize("scale", [0.01, 1.0, 3000.0])
def test_clusters_equal_sql(spark, scale):
    own = vectors(scale=scale)
    own += [(i, own[3][1], "clash", 1) for i in range(1000, 1100)]  # a third of the rows alike
    own += [(5, own[5][1], "clash", 1), (2000, None, "x", 1), (2001, own[0][1][:63], "x", 1), (2002, [*own[0][1][:63], None], "x", 1), (2003, [*own[0][1][:63], float("nan")], "x", 1), (2004, [*own[0][1][:63], float("inf")], "x", 1), (None, own[9][1], "x", 1)]
    got = bit_clusters.clusters(frame(spark, own)).drop("centroid").toPandas()
    assert rows(got) == rows(in_sql(own)) and len(got) == 502


def test_clusters_of_odd_tables(spark):
    assert bit_clusters.clusters(frame(spark, [])).collect() == []
    assert bit_clusters.clusters(frame(spark, [(1, None, "x", 1), (2, [], "x", 1)])).collect() == []
    few = vectors(3)
    assert rows(bit_clusters.clusters(frame(spark, few)).drop("centroid").toPandas()) == rows(in_sql(few))
    zeros = [(i, [0.0] * 64, "x", 1) for i in range(20)]
    assert {tuple(r)[1:5] for r in bit_clusters.clusters(frame(spark, zeros)).collect()} == {(0, 0, 0, 0)}
    with pytest.raises(ValueError, match="64 bits"):
        bit_clusters.clusters(frame(spark, [(1, [1e30] * 64, "x", 1)]))


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 9, 28):
        low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
        a, b = (rng.integers(low, high, size=(n, 64), endpoint=True) for n in (30, 7))
        p, q = bit_clusters.planes(a, bits), bit_clusters.planes(b, bits)
        assert (bit_clusters.values(p) == a).all() and (bit_clusters.dot_products(p, q) == a @ b.T).all() and (bit_clusters.lengths(p) == (a * a).sum(1)).all()
