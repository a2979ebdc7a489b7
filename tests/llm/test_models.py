from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from stratascope.llm import audio, byte_bpe, quality, tokens, toxicity, vector_search

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_bpe_round_trip(spark, make_docs, odd_rows):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    odd = ["'s 't it's", "  two  spaces \n\n", "éß\U0001f600 日本", "12 345", "<|endoftext|>", "\x00\x01", "a" * 3000]
    rows = [*odd_rows, *[(100 + i, "".join(rnd.choice(odd) for _ in range(5)), "s") for i in range(40)]]
    got = byte_bpe.encoded_digests(make_docs(rows), ranks, public_tokenizers.PATTERN).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert byte_bpe.encode(make_docs(rows).limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_chunks_of_any_size_agree(spark, make_docs):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = make_docs([(i, f"some words {i % 5} and more words", "s") for i in range(50)])
    a, b = (sorted(map(str, byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk_chars=c).collect())) for c in (60, 10**6))
    assert a == b
    bad = spark.createDataFrame([(1, [0, 1]), (2, [99_999_999]), (3, None), (4, [])], "doc_id long, ids array<int>")
    out = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(bad, ranks).collect()}
    assert out[2] is None and out[3] is None and bytes(out[4]) == b"" and out[1]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 7]) for i in range(120)]
    rows += [(120, None), (121, [1.0, None]), (122, [float("nan")] * 6), (123, [0.5] * 3), (124, []), (None, [1.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for k, size in ((3, 4096), (10, 4), (500, 4096)):
        got = [tuple(r) for r in vector_search.top_k(df, df["vec_id"] % 20 == 0, k=k, slice_rows=size).orderBy("query_id", "rank").collect()]
        want = []
        for q, v in sorted(x for x in usable if x[0] % 20 == 0):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
        assert got == want
    assert vector_search.top_k(df.limit(0), df["vec_id"] % 20 == 0).count() == 0


def plain_segments(s: list[float], low: int = 0, high: int | None = None) -> list[tuple[int, int, float]]:
    """Maximal segments by their definition: the best stretch, then those to its left and to its right."""
    high = len(s) if high is None else high
    best = max(((sum(s[i : j + 1]), i, j) for i in range(low, high) for j in range(i, high)), default=(0.0, 0, 0))
    if best[0] <= 0:
        return []
    return [*plain_segments(s, low, best[1]), (best[1], best[2], best[0]), *plain_segments(s, best[2] + 1, high)]


def test_segments_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randrange(1, 40)
        s = [rnd.random() * 3 if rnd.random() < 0.4 else -1.0 for _ in range(n)]
        at = np.flatnonzero(np.array(s) > 0)
        got = toxicity.maximal_segments(at, np.array(s)[at], 1.0)
        want = plain_segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


@pytest.mark.parametrize("between", [1, 3])
def test_segments_take_linear_time(between):
    at = np.arange(0, 200_000 * (between + 1), between + 1)
    for scores in (np.full(len(at), 0.5), np.full(len(at), between + 0.5), np.linspace(0.1, 3 * between, len(at)), np.linspace(3 * between, 0.1, len(at))):
        began = time.process_time()
        toxicity.maximal_segments(at, scores, 1.0)
        assert time.process_time() - began < 5


def test_words_against_regex():
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("aBc 1_-é\u0130ß\U0001d400\ud800\n") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", "x" * 5000]
    names: dict[str, int] = {}
    for some in tokens.blocks(texts):
        w = tokens.letter_words(some, (2,))
        for k, t in enumerate(some):
            found = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
            a, b = w.first[k], w.first[k + 1]
            assert list(zip(w.start[a:b].tolist(), w.end[a:b].tolist())) == found
            for (x, y), h, p, short in zip(found, w.whole[a:b].tolist(), w.prefixes[0][a:b].tolist(), w.short[0][a:b].tolist()):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t[x:y])
                assert names.setdefault(low, h) == h and short == (y - x <= 2) and (short or names.setdefault(f"{low[:2]}-", p) == p)
    assert len(set(names.values())) == len(names)


def test_scores_against_plain_version(spark, make_docs):
    """The whole score of every row, from counts of strings and segments by definition."""
    rnd = random.Random(21)
    vocabulary, bad = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("lm", "rt", "nsss", "ppqqrr")], ["vile", "vilest", "filthy", "rotten"]
    rows = []
    for i in range(240):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 40))]
        if i % 3 == 0:
            own[2:2] = [rnd.choice(bad) for _ in range(rnd.randrange(2, 6))]
        rows.append((i, " ".join(own).title(), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (3, rows[3][1], "s")]
    toxic = {i: int(i % 3 == 0) for i in range(180)}
    features = lambda w: {w} | {f"{w[:k]}-{k}" for k in toxicity.PREFIXES if len(w) > k}
    texts = {i: (t or "").lower().split() for i, t, _ in rows}
    distinct = {(frozenset(texts[i]), y): i for i, y in sorted(toxic.items(), reverse=True)}
    n, counts = [0, 0], {}
    for (words_, y), i in distinct.items():
        n[y] += 1
        for f in set().union(*map(features, words_)):
            counts.setdefault(f, [0, 0])[y] += 1

    def gain(word: str, without: int | None) -> float:
        out = 0.0
        for f in features(word):
            c, t = counts.get(f, (0, 0))
            if t < toxicity.LEAST_DOCS:
                continue
            c, t, nc, nt = c - (without == 0), t - (without == 1), n[0] - (without == 0), n[1] - (without == 1)
            if t > 0:
                out = max(out, toxicity.log_odds(t, c, nt, nc, math.log, math.sqrt) - toxicity.DRIFT)
        return out

    marks, segments, chars = [], {}, 0
    for (_, y), i in distinct.items():
        s = [gain(w, y) or -toxicity.DRIFT for w in texts[i]]
        segments[i] = (y, len(s), [x[2] for x in plain_segments(s)])
        if not y:
            marks += [round(x, 1) for x in s if x > 0]
            chars += len(s)
    lam = toxicity._karlin_lambda(np.array(sorted(set(marks))), np.array([marks.count(x) for x in sorted(set(marks))], float), chars)
    chance = [x for y, _, own in segments.values() if not y for x in own]
    k = (len(chance) + 1) * math.exp(min(50, lam * min(chance, default=0.0))) / (chars + 1)
    model = toxicity.ToxicityModel(None, lam, k, 0.0, 0.0)
    model.slope, model.intercept = toxicity._logistic(np.array([model.evidence(s, m) for _, m, s in segments.values()]), np.array([y for y, _, _ in segments.values()], float))
    want = {i: model.probability(model.evidence([x[2] for x in plain_segments([gain(w, None) or -toxicity.DRIFT for w in own])], len(own))) for i, own in texts.items()}
    docs = make_docs(rows)
    learned = toxicity.train(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    got = toxicity.toxic_scores(docs, learned).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-3)
    assert {r["score"] for r in docs.select(toxicity.toxic_score(docs["text"], learned, docs).alias("score")).collect()} == {r["score"] for r in got}
    for r in got:
        for p in r["passages"]:
            assert set(rows[r["doc_id"]][1][p["start"] : p["end"]].lower().split()) & set(bad)


@tables
def test_toxicity_on_held_out_rows(spark):
    from stratascope.llm import queries

    scored = queries.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((scored["predicted"] == 1) & (scored["toxic"] == 1)).sum()
    assert hit / max(1, (scored["toxic"] == 1).sum()) > 0.6 and hit / max(1, (scored["predicted"] == 1).sum()) > 0.7


def test_toxicity_of_odd_rows(spark, make_docs, odd_rows):
    own = lambda i: f"{chr(97 + i % 26)}q{chr(97 + i // 26)}z"
    rows = [*odd_rows, *[(i, f"you utter bleep {own(i)}" if i % 2 else f"a kind {own(i)}", "s") for i in range(100, 160)]]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.toxic_scores(docs, model).collect()}
    assert {(101, 1), (100, 0), (1, 0), (2, 0)} <= got
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    nobody = toxicity.train(docs, labels.limit(0))
    assert toxicity.toxic_scores(docs, nobody).where("predicted = 1").count() == 0 and toxicity.toxic_scores(docs.limit(0), model).count() == 0


@tables
def test_quality_on_held_out_rows(spark):
    from stratascope.llm import queries

    scored = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.95


def test_quality_of_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None)], "doc_id long, quality int")
    got = quality.quality_scores(make_docs(odd_rows), labels)
    assert got.count() == len(odd_rows) and got.where("score IS NULL").count() == 0
    assert quality.quality_scores(make_docs(odd_rows).limit(0), labels).count() == 0


def test_audio_finds_a_shared_passage(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, other = [word() for _ in range(60)], [[word() for _ in range(40)] for _ in range(6)]
    texts = [" ".join(other[0] + passage + other[1]), " ".join(other[2][:25] + passage + other[3]), " ".join(other[4]), " ".join(other[4]), None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in audio.recording_classes(audio.fingerprints(df, audio.tones, "text", audio.TONES)).collect()}
    assert got[0]["class"] == got[1]["class"] and got[0]["n_links"] == 1 and got[0]["frames"] >= 50 and abs(got[0]["offset"]) == 15
    assert got[2]["class"] == got[3]["class"] != got[0]["class"] and got[2]["n_links"] == 0
    assert all(got[i]["class"] is None and got[i]["n_frames"] == 0 for i in (4, 5, 6))
    assert audio.recording_classes(audio.fingerprints(df.limit(0), audio.tones, "text", audio.TONES)).count() == 0


def test_audio_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l " * 4, 5, 6, 7), (2, None, 5, 6, 7), (1, "x " * 70_000, 5, 6, 7)], "id long, text string, node int, offset int, prints int")
    got = audio.recording_classes(audio.fingerprints(df, audio.tones, "text", audio.TONES))
    assert len(set(got.columns)) == len(got.columns) and got.count() == 3 and got.where("node IS NULL").count() == 1


def test_fingerprints_together_and_alone():
    rng = np.random.default_rng(4)
    texts = [" ".join(str(x) for x in rng.integers(0, 99, n)) for n in (30, 0, 3, 200, 9)]
    recordings = [audio.tones(t) for t in texts]
    for own, r in zip(audio.prints_of(recordings, audio.TONES), recordings):
        assert np.bitwise_count(own ^ audio.prints_of([r], audio.TONES)[0]).sum() <= 2


def test_alignments_against_brute_force(spark):
    """All pairs of fingerprints that share a posted hash and a long enough stretch end in one class, and no others."""
    rng = np.random.default_rng(11)
    new = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    passages = [new(30) for _ in range(6)]
    rows = []
    for i in range(40):
        p = passages[rng.integers(6)][rng.integers(8) :][: rng.integers(6, 31)].copy()
        p[rng.random(len(p)) < 0.1] ^= np.uint32(5)
        rows.append((f"r{i:02}", np.concatenate([new(rng.integers(3, 12)), p, new(rng.integers(3, 12))])))
    label = {k: k for k, _ in rows}
    for a, (x, p) in enumerate(rows):
        for y, q in rows[:a]:
            best = max(audio.shared_passage(q, p, o)[1] for o in range(-len(p), len(q)))
            if best >= audio.LEAST_FRAMES:
                label = {k: min(label[x], label[y]) if v in (label[x], label[y]) else v for k, v in label.items()}
    links = audio.aligned(spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in rows], "node string, prints binary")).collect()
    got = {k: k for k, _ in rows}
    for r in links:
        low = min(got[r["node"]], got[r["other"]])
        got = {k: low if v in (got[r["node"]], got[r["other"]]) else v for k, v in got.items()}
    pairs = lambda own: {(x, y) for x in own for y in own if x < y and own[x] == own[y]}
    assert pairs(got) <= pairs(label) and len(pairs(got)) >= 0.9 * len(pairs(label)) > 20


def test_audio_passage_behind_short_leaders(spark):
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    passage = new(40)
    rows = [(f"a{i:02}", np.concatenate([new(20), passage[3 * i : 3 * i + 8], new(20)])) for i in range(12)]  # each too short to be linked
    rows += [(f"a{20 + i}", np.concatenate([new(20), passage[i : i + 9], new(20)])) for i in range(0, 32)]
    rows += [(f"b{i}", np.concatenate([new(5 + i), passage, new(9)])) for i in range(2)]
    links = audio.aligned(spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in rows], "node string, prints binary")).collect()
    assert any((r["node"], r["other"], r["offset"]) == ("b1", "b0", -1) and r["frames"] >= 40 for r in links)


def test_audio_links_of_all_pairs(spark, monkeypatch):
    """Links and the best one are those of all pairs that post a hash alike at any of their common offsets, whatever the blocks."""
    rng = np.random.default_rng(17)
    new = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    passage, rows = new(60), {}
    for i in range(50):
        p = passage[rng.integers(30) :][: rng.integers(6, 40)].copy()
        p[rng.random(len(p)) < 0.15] ^= np.uint32(1 << 9)
        rows[f"r{i:02}"] = np.concatenate([new(rng.integers(1, 12)), p, new(rng.integers(1, 12)), passage[:8] if i % 5 == 0 else new(2)])
    want = {}
    posted = {k: dict(zip(*map(np.ndarray.tolist, audio._postings(p)))) for k, p in rows.items()}
    for a in rows:
        for b in rows:
            offsets = {posted[b][h] - posted[a][h] for h in posted[a].keys() & posted[b].keys()} if a > b else ()
            found = max((audio.shared_passage(rows[b], rows[a], o) for o in offsets), key=lambda f: (f[1], -f[2]), default=(0, 0, 1.0))
            if found[1] >= audio.LEAST_FRAMES:
                want[a, b] = found
    assert len(want) > 300
    prints = spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in rows.items()], "node string, prints binary")
    whole = spark.createDataFrame([(k, len(p), bytearray(p.tobytes())) for k, p in [*rows.items(), ("copy", rows["r00"])]], "id string, n_frames long, prints binary")
    for block in (1024, 7):
        monkeypatch.setattr(audio, "BLOCK_RECORDINGS", block)
        got = {(r["node"], r["other"]): (r["start"], r["frames"], r["bit_error"]) for r in audio.aligned(prints).collect()}
        assert got == want
        for r in audio.recording_classes(whole).collect():
            own = "r00" if r["id"] == "copy" else r["id"]
            mine = [f for k, f in want.items() if own in k]
            assert r["n_links"] == len(mine) and r["frames"] == max((f[1] for f in mine), default=None)
            assert r["bit_error"] == min((f[2] for f in mine if f[1] == r["frames"]), default=None)
            if mine:
                other = next(p for p in rows.values() if hashlib.sha256(p.tobytes()).hexdigest() == r["other"])
                assert audio.shared_passage(other, rows[own], r["offset"]) == (r["start"], r["frames"], r["bit_error"])


def test_integral_image_against_sums():
    image = np.random.default_rng(1).uniform(size=(20, 12))
    one, other = audio.box_filters(8)[3]
    area = lambda at, box: image[at + box[0] : at + box[1], box[2] : box[3]].sum()
    prints = audio.fingerprint(image, 8)
    for at in range(len(prints)):
        v = np.log((0.1 + area(at, one)) / (0.1 + area(at, other)))
        level = int(v > -0.25) + int(v > 0) + int(v > 0.25)
        assert int(prints[at]) >> 2 * (15 - 3) & 3 == level ^ level >> 1


@tables
def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from stratascope.llm.common import table, written

    docs = table(spark, SF, "documents")
    columns, library = docs.columns, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for name, stage in cp.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        if name != "byte_bpe":
            assert docs.columns == columns and 0.8 * before.count() < docs.count() <= 1.2 * before.count()
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in docs.collect():
        assert list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]] or "")
