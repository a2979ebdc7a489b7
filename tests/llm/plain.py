"""Plain versions of the pipeline's stages, over rows (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(n: int, linked) -> list[int]:
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def order(doc_id) -> tuple:
    return (doc_id is not None, doc_id or 0)


def without_repeats(rows: list[tuple]) -> list[tuple]:
    first: dict[str, tuple] = {}
    for row in rows:
        for k, line in enumerate((row[1] or "").split("\n")):
            if bare := line.strip(" \t\r\x0b\x0c"):
                first[bare] = min(first.get(bare, (order(row[0]), k)), (order(row[0]), k))
    names = sorted(first)
    near = lambda i, j: min(len(names[i]), len(names[j])) >= 20 and abs(len(names[i]) - len(names[j])) <= 2 and distance(names[i], names[j]) <= 2
    label = classes(len(names), near)
    head = {c: min(first[names[i]] for i in range(len(names)) if label[i] == c) for c in set(label)}
    head_of = {names[i]: head[label[i]] for i in range(len(names))}
    gone: dict[tuple, set[tuple]] = {}  # rows of one id are one document
    for row in rows:
        for k, line in enumerate((row[1] or "").split("\n")):
            if (bare := line.strip(" \t\r\x0b\x0c")) and head_of[bare] != (order(row[0]), k):
                gone.setdefault(order(row[0]), set()).add((k, bare))
    out = []
    for row in rows:
        cut = gone.get(order(row[0]), set())
        if row[1] is None or not cut:
            out.append(row if row[1] is None else (*row[:4], len(row[1])))
            continue
        left = [line for k, line in enumerate(row[1].split("\n")) if (k, line.strip(" \t\r\x0b\x0c")) not in cut]
        if any(line.strip(" \t\r\x0b\x0c") for line in left):
            text = "\n".join(left)
            out.append((row[0], text, *row[2:4], len(text)))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def near_unique(rows: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    sets = [shingles(row[1], n) for row in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    label = classes(len(rows), linked)
    least: dict[int, int] = {}
    for i, c in enumerate(label):
        if c not in least or (rows[i][0] is None, rows[i][0] or 0) < (rows[least[c]][0] is None, rows[least[c]][0] or 0):
            least[c] = i
    return [row for i, row in enumerate(rows) if not sets[i] or least[label[i]] == i]
