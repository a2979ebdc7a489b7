"""Links between near vectors against all pairs compared."""

from __future__ import annotations

import numpy as np
import pytest

from stratascope.llm import cosine_links


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", b"x", 3) for r in rows], "vec_id long, embedding array<double>, unit string, node binary, n int")


def near(rng, centre, cosine):
    """A vector at this cosine to ``centre``."""
    noise = rng.normal(size=len(centre))
    noise -= centre * (noise @ centre) / (centre @ centre)
    return cosine * centre / np.linalg.norm(centre) + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def brute(rows, least=0.9):
    width = max((len(v) for _, v in rows if v), default=0)
    usable = lambda i, v: i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.pad(np.array(v, float) / max(map(abs, v)), (0, width - len(v))) if usable(i, v) else None for i, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    label, links = [r[0] for r in rows], [0] * len(rows)
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        label[i] = rows[i][0] if unit[i] is None else min(ids)
    return sorted(((r[0], n, c, r[0] is None or r[0] == c) for r, n, c in zip(rows, links, label)), key=repr)


def compare(spark, rows, least=0.9, recall=1 - 1e-8):
    got = sorted(map(tuple, cosine_links.near_vectors(frame(spark, rows), least=least, recall=recall).collect()), key=repr)
    want = brute(rows, least)
    assert [g[0] for g in got] == [w[0] for w in want]
    return got, want


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=24) for _ in range(150)]
    for cosine, n in ((0.999, 60), (0.985, 40), (0.96, 40), (0.93, 30), (0.91, 20)):  # tight groups, and groups that no ball holds
        centre = rng.normal(size=24)
        rows += [near(rng, centre, cosine) for _ in range(n)]
    rows += [rows[0]] * 80 + [3 * rows[1], -rows[2], rows[3] * 1e200, rows[3] * 1e-200]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]
    got, want = compare(spark, rows)
    assert got == want


def test_groups_that_touch(spark):
    """Balls whose members are partly linked are compared member by member."""
    rng = np.random.default_rng(4)
    a, rows = rng.normal(size=16), []
    for cosine in (0.98, 0.95, 0.92, 0.89, 0.85):
        b = near(rng, a, cosine)
        rows += [near(rng, b, 0.99) for _ in range(40)]
    got, want = compare(spark, [(i, v.tolist()) for i, v in enumerate(rows)])
    assert got == want


@pytest.mark.parametrize("block", [8, 512])
def test_crowded_buckets_are_cut(spark, monkeypatch, block):
    monkeypatch.setattr(cosine_links, "BLOCK", block)
    rng = np.random.default_rng(6)
    a = rng.normal(size=16)
    got, want = compare(spark, [(i, near(rng, a, 0.95).tolist()) for i in range(150)])
    assert got == want


def test_recall_and_another_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):  # pairs at the threshold itself
        v = rng.normal(size=32)
        rows += [(2 * i, v.tolist()), (2 * i + 1, near(rng, v, 0.8001).tolist())]
    got, want = compare(spark, rows, least=0.8, recall=0.97)
    assert sum(g[1] for g in got) >= 0.93 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    one = [1.0] * 8
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, one), (4, one), (4, [-1.0] * 8), (5, [*one[:7], None]), (6, [*one[:7], float("nan")]), (7, [*one[:7], float("inf")]), (None, one), (8, one[:7]), (9, [-0.0, *one[1:]]), (10, [0.0, *one[1:]])]
    got, want = compare(spark, rows)
    assert got == want
    assert cosine_links.near_vectors(frame(spark, [])).collect() == []
    assert sorted(map(tuple, cosine_links.near_vectors(frame(spark, rows[:3])).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [tuple(r) for r in cosine_links.near_vectors(frame(spark, [(1, one)])).collect()] == [(1, 0, 1, True)]
