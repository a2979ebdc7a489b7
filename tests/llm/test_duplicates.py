from __future__ import annotations

import random
import time

import numpy as np
import pytest

from stratascope.llm import graph, line_dedup, near_dedup


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd: random.Random, text: str, edits: int) -> str:
    s = list(text)
    for _ in range(edits):
        at, kind = rnd.randrange(len(s) + 1), rnd.randrange(3)
        if kind == 0 or at == len(s):
            s.insert(at, rnd.choice("abcé"))
        elif kind == 1:
            s[at] = rnd.choice("abcé")
        else:
            del s[at]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance_and_segments(edits):
    rnd = random.Random(edits)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(40)))
    pairs = [(a := word(), edited(rnd, a, rnd.randrange(edits + 3)) if rnd.random() < 0.8 else word()) for _ in range(600)]
    want = [min(plain_distance(a, b), edits + 1) for a, b in pairs]
    assert line_dedup.bounded_distances(pairs, edits).tolist() == want
    for (a, b), d in zip(pairs, want):
        a, b = sorted((a, b), key=len)
        if 8 <= len(a) and 0 < d <= edits:
            own = {line_dedup.segment_key(a[s : s + k], len(a), i) for i, (s, k) in enumerate(line_dedup.segments(len(a), edits))}
            asked = {line_dedup.segment_key(b[s : s + k], m, i) for m, i, s, k in line_dedup.probes(len(b), edits)}
            asked |= {line_dedup.segment_key(b[s : s + k], len(b), i) for i, (s, k) in enumerate(line_dedup.segments(len(b), edits))}
            assert own & asked


def test_lines_against_brute_force(spark, make_docs, monkeypatch):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(22, 60))).strip() + "x" for _ in range(25)]
    docs = []
    for i in range(60):
        lines = [edited(rnd, rnd.choice(base), rnd.randrange(3)) if rnd.random() < 0.7 else "".join(rnd.choice("stuvwxyz") for _ in range(30)) for _ in range(4)]
        docs.append((i, "\n".join([*lines, "short"]), "s"))
    first: dict[str, tuple[int, int]] = {}
    for i, text, _ in docs:
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (i, k))
    names = list(first)
    label = list(range(len(names)))
    for i in range(len(names)):
        for j in range(i):
            if min(len(names[i]), len(names[j])) >= 20 and abs(len(names[i]) - len(names[j])) <= 2 and plain_distance(names[i], names[j]) <= 2:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    head = {c: min(first[names[i]] for i in range(len(names)) if label[i] == c) for c in set(label)}
    of = {names[i]: head[label[i]] for i in range(len(names))}
    want = {(i, k) for i, text, _ in docs for k, line in enumerate(text.split("\n")) if line.strip() in of and of[line.strip()] != (i, k)}
    got = line_dedup.repeated_lines(make_docs(docs)).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(line_dedup, "MOST", 3)  # large groups are dealt out in blocks
    monkeypatch.setattr(line_dedup, "FEW", 2)  # and cut again
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.repeated_lines(make_docs(docs)).collect()} == want


@pytest.mark.parametrize("few", [2, 8])
def test_groups_cut_again_against_brute_force(few, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", few)
    for seed in range(12):
        rnd = random.Random(seed)
        digits = lambda n: "".join(rnd.choice("01") for _ in range(n))
        shape = rnd.choice([lambda: f"item {digits(6)} costs {digits(3)} today", lambda: digits(rnd.randrange(3, 9)), lambda: f"ab{digits(4)}{'ab' * rnd.randrange(4)}{digits(2)}"])
        texts = sorted({edited(rnd, shape(), rnd.randrange(2)) or "x" for _ in range(60)})
        label, got = list(range(len(texts))), list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if plain_distance(texts[i], texts[j]) <= 2:
                    label = [label[j] if x == label[i] else x for x in label]
        links = line_dedup.group_links(texts, np.ones(len(texts), bool), 2)
        for i, j in links:
            assert plain_distance(texts[i], texts[j]) <= 2
            got = [got[j] if x == got[i] else x for x in got]
        assert len(links) == len(texts) - len(set(label)) and len(set(zip(label, got))) == len(set(label))


@pytest.mark.parametrize("shape", ["order number {a:08d} was shipped", "user {a:05d} signed in from {b:06d} on node {c:04d} today", "{a:06d}{b:06d} and no more than that"])
def test_many_lines_of_one_template(shape):
    rnd = random.Random(1)
    texts = list(dict.fromkeys(shape.format(a=rnd.randrange(10**5 if "user" in shape else 10**6 if "more" in shape else 10**8), b=rnd.randrange(10**6), c=rnd.randrange(10**4)) for _ in range(50_000)))
    began = time.process_time()
    line_dedup.group_links(texts, np.ones(len(texts), bool), 2)
    assert time.process_time() - began < 60


def test_short_lines_repeat_exactly(spark, make_docs):
    docs = make_docs([(1, "yes\n\nno, not", "a"), (2, "yes\n\nyet", "a"), (3, "yes", "a"), (4, "no, no", "b")])
    assert {(r["doc_id"], r["text"]) for r in line_dedup.without_repeats(docs).collect()} == {(1, "yes\n\nno, not"), (2, "\nyet"), (4, "no, no")}


def test_rows_of_one_id_lose_their_own_repeats(spark, make_docs):
    docs = make_docs([(1, "first line of the first one\nsecond line of the first one", "a"), (2, "something else stands here\nsecond line of the first one", "a"), (2, "nothing that repeats stands here\nquite another ending of it all", "a")])
    assert sorted(r["text"] for r in line_dedup.without_repeats(docs).where("doc_id = 2").collect()) == ["nothing that repeats stands here\nquite another ending of it all", "something else stands here"]


def test_lines_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (8, "a line that is long enough to count\nand another one, quite long too", "a"), (9, "a line that is long enough to count", "a")])
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 4, 5, 8, None}  # row 7 holds nothing but the line that row 3 has first
    assert line_dedup.repeat_report(docs).count() == 10 and line_dedup.without_repeats(docs.limit(0)).count() == 0


def words(text: str | None, n: int) -> frozenset:
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_near_duplicates_against_brute_force(spark, make_docs, percent):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(150):
        if i % 3 and docs:
            own = rnd.choice(docs)[1].split()
            for _ in range(rnd.randrange(4 if percent == 80 else 9)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary).upper()
        else:
            own = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 200))]
        docs.append((i, " ".join(own), "s"))
    sets = [words(t, 4) for _, t, _ in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {c: min(i for i in range(len(docs)) if label[i] == c) for c in set(label)}
    got = near_dedup.near_duplicates(make_docs(docs), words=4, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), least[label[i]], least[label[i]] == i) for i in range(len(docs))}


def test_near_copies_within_a_template(spark, make_docs):
    rnd, docs = random.Random(8), []
    template = [f"w{rnd.randrange(10**9)}" for _ in range(450)]
    for i in range(80):  # texts of one template are alike at about 0.73, and every second one has a copy at 0.82
        own = rnd.sample(template, 380)
        docs.append((2 * i, own))
        if i % 2:
            docs.append((2 * i + 1, own[38:] + rnd.sample(sorted(set(template) - set(own)), 38)))
    alike = {(i, j) for i, x in docs for j, y in docs if i < j and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert alike == {(i - 1, i) for i, _ in docs if i % 2}
    got = near_dedup.near_duplicates(make_docs([(i, " ".join(x), "s") for i, x in docs]), words=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in docs}


def test_near_duplicates_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted([("1", "1"), ("2", "2"), ("3", "3"), ("3", "3"), ("4", "4"), ("5", "5"), ("None", "None"), ("7", "3")])
    assert near_dedup.near_unique(docs).columns == docs.columns and near_dedup.near_unique(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in near_dedup.near_unique(docs).collect()) == ["1", "2", "3", "4", "5", "None"]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_unique_judges_rows_by_their_own_text(spark):
    words_ = [f"w{i}" for i in range(60)]
    text = " ".join(words_)
    rows = [(5, "another text that stands alone here", 1), (5, text + " more", 2), (3, text, 3), (None, text + " else", 4), (9, "quite another text of no id", 5), (None, "no id and no copy", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long").withColumnsRenamed({})
    kept = near_dedup.near_unique(docs)
    assert kept.columns == docs.columns and sorted(r["rid"] for r in kept.collect()) == [1, 3, 5, 6]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = (near_dedup.signature(np.concatenate((both, own)), 2048) for own in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.03
    assert near_dedup.forest(80) == (16, 4) and near_dedup.forest(60)[1] == 2


def test_one_row_partitions_still_meet():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 3, size=(40, 8)).astype(">u4").view("S32").ravel())
    a, b, _ = near_dedup.neighbour_pairs(np.zeros(40, int), np.frombuffer(keys.tobytes(), ">u4").reshape(40, 8), 2, 4)
    assert (a < b).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(200, i) for i in range(100, 130)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in [e for e in edges if e[0] != e[1]] * 80:
        label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label and len(got) == len(label)
