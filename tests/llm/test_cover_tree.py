import math

import numpy as np
import pytest

from sitequill.llm import cover_tree


def brute(rows, cosine):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a):
            (i, l, u), (j, m, v) = rows[a], rows[b]
            if None in (i, j, l) or l != m or not usable(u) or not usable(v) or len(u) != len(v):
                continue
            x, y = np.array(u, float), np.array(v, float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), low, rows[a][0] is not None and low == rows[a][0]))
    return sorted(out, key=str)


def vectors(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i > 20 and i % 3 == 0:
            base = rows[int(rng.integers(0, i // 2))]
            v, label = np.array(base[2]) + rng.normal(0, rng.choice([0.0, 0.05, 0.12, 0.2]), dims), base[1]
        else:
            v, label = rng.normal(0, 1, dims), 0 if rng.random() < 0.4 else int(rng.integers(0, labels))
        rows.append((i, label, [float(np.float32(x)) for x in v]))
    return rows


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, id long, node string")


@pytest.mark.parametrize("node,kind,dims", [(1024, "float", 8), (16, "double", 4)])
def test_links_equal_brute_force(spark, monkeypatch, node, kind, dims):
    monkeypatch.setattr(cover_tree, "NODE", node)
    monkeypatch.setattr(cover_tree, "FAN", 4)
    rows = vectors(1, 240, dims, 4)
    rows += [(500, 1, None), (501, 1, [0.0] * dims), (502, 1, [float("nan")] * dims), (503, None, rows[0][2]), (504, 1, [None] * dims), (505, 1, [float("inf")] * dims)]
    rows += [(600, rows[5][1], rows[5][2]), (601, rows[5][1], rows[5][2]), (600, rows[5][1], rows[5][2]), (602, rows[5][1], [2 * x for x in rows[5][2]]), (603, rows[5][1], []), (604, rows[5][1], [1.0, 2.0]), (None, rows[5][1], rows[5][2])]
    got = sorted(map(tuple, cover_tree.near_vectors(table(spark, rows, kind)).collect()), key=str)
    assert got == brute(rows, 0.93)


def test_tree_covers_and_traversal_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 5))
    raw = np.concatenate([c + rng.normal(0, 0.08, (150, 5)) for c in centres])
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    tree = cover_tree.Tree(x)
    assert sorted(tree.order) == list(range(len(x))) and len(tree.nodes) > 6
    for centre, radius, start, end, first, last in tree.nodes:
        assert np.linalg.norm(x[tree.order[start:end]] - x[centre], axis=1).max() <= radius + 1e-12
        if last:
            assert sorted(k for c in range(first, last) for k in range(tree.nodes[c][2], tree.nodes[c][3])) == list(range(start, end))
    i, j = cover_tree.linked(tree, tree, raw, raw, 0.93, True)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if x[a] @ x[b] >= 0.93}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_empty(spark):
    assert cover_tree.near_vectors(table(spark, [])).collect() == []
    assert [tuple(r) for r in cover_tree.near_vectors(table(spark, [(3, None, None)])).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("label", ["a\nb", "a.1\n.2", "x/3", ""])
def test_odd_labels_of_large_nodes(spark, monkeypatch, label):
    monkeypatch.setattr(cover_tree, "NODE", 16)
    rows = [(i, label if l == 0 else f"{label}.0", v) for i, l, v in vectors(3, 120, 4, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = sorted(map(tuple, cover_tree.near_vectors(frame).collect()), key=str)
    assert got == brute(rows, 0.93) and sum(r[1] for r in got) > 50
