"""The hierarchy in tables against the same tree condensed in one process."""

import math
import random

import numpy as np
import pytest

from emberline.operators import hierarchy


def condense(n, tree, min_cluster_size):
    """Labels from the edges (a, b, w), by the dendrogram itself."""
    parent = list(range(2 * n - 1))
    size, kids, height = [1] * n + [0] * (n - 1), [None] * (2 * n - 1), [0.0] * (2 * n - 1)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b, w) in enumerate(sorted(((min(a, b), max(a, b), w) for a, b, w in tree), key=lambda e: (e[2], e[0], e[1]))):
        x, y = find(a), find(b)
        parent[x] = parent[y] = n + k
        kids[n + k], height[n + k], size[n + k] = (x, y), w, size[x] + size[y]

    def leaves(x):
        stack = [x]
        while stack:
            y = stack.pop()
            if y < n:
                yield y
            else:
                stack += kids[y]

    clusters = [{"birth": 0.0, "own": 0.0, "below": [], "top": 2 * n - 2}]
    todo = [(2 * n - 2, 0)] if n > 1 else []
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        level = min(1 / height[node], 1e12) if height[node] > 0 else 1e12
        big = [s for s in kids[node] if size[s] >= min_cluster_size]
        if len(big) == 2:
            clusters[c]["own"] += size[node] * (level - clusters[c]["birth"])
            for s in big:
                clusters[c]["below"].append(len(clusters))
                todo.append((s, len(clusters)))
                clusters.append({"birth": level, "own": 0.0, "below": [], "top": s})
            continue
        for s in kids[node]:
            if s in big:
                todo.append((s, c))
            else:
                clusters[c]["own"] += size[s] * (level - clusters[c]["birth"])
    total, kept = {}, {}
    for c in reversed(range(len(clusters))):
        under = sum(total[k] for k in clusters[c]["below"])
        if clusters[c]["below"] and (c == 0 or under > clusters[c]["own"] * (1 + 1e-12)):
            kept[c], total[c] = [x for k in clusters[c]["below"] for x in kept[k]], under
        else:
            kept[c], total[c] = ([c] if c else []), clusters[c]["own"]
    label = [-1] * n
    for name, c in enumerate(sorted(kept[0], key=lambda c: min(leaves(clusters[c]["top"])))):
        for row in leaves(clusters[c]["top"]):
            label[row] = name
    return label


def random_tree(rng, n, kind):
    edges = []
    for i in range(1, n):
        j = i - 1 if kind == "chain" else 0 if kind == "star" and rng.random() < 0.8 else rng.randrange(max(0, i - 12), i) if kind == "bushy" else rng.randrange(i)
        w = rng.random() if kind != "ties" else rng.choice([0.0, 1.0, 2.0, 2.5, 7.0])
        if kind == "blobs":
            w = (1 + rng.random()) * (10 if i % 37 == 0 else 1)
        edges.append((i, j, w))
    name = list(range(n))
    rng.shuffle(name)
    return [(name[a], name[b], w) for a, b, w in edges]


def table(spark, tree):
    return spark.createDataFrame(tree, "a long, b long, w double").repartition(3)


@pytest.mark.parametrize(("kind", "n", "m", "leaf", "small"), [
    ("any", 200, 5, 1000, 1000), ("blobs", 300, 6, 80, 1000), ("chain", 120, 3, 60, 0), ("star", 150, 3, 80, 1000), ("ties", 120, 4, 1000, 1000),
])
def test_labels_of_random_trees(spark, kind, n, m, leaf, small):
    rng = random.Random(f"{kind}{n}{m}")
    tree = random_tree(rng, n, kind)
    got = {r["i"]: r["cluster"] for r in hierarchy.condensed_labels(table(spark, tree), n, m, leaf, small=small).collect()}
    assert [got[i] for i in range(n)] == condense(n, tree, m)


def test_merges_are_those_of_one_pass(spark):
    rng = random.Random(1)
    tree = random_tree(rng, 150, "any")
    rows = sorted(tuple(r) for r in hierarchy.merges(table(spark, tree), 20).collect())
    root, size, want = list(range(150)), [1] * 150, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (w, a, b) in enumerate(sorted((w, min(a, b), max(a, b)) for a, b, w in tree)):
        p, q = sorted((find(a), find(b)))
        want.append((k, w, p, q, size[p], size[q]))
        root[q] = p
        size[p] += size[q]
    assert rows == want


def test_pointers(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, int(rng.integers(0, max(1, i)))) for i in range(200)] + [(1000, 2000)]
    want = {}
    for k, t in pairs:
        want[k] = want.get(t, t) if t != k else t
    t = spark.createDataFrame(pairs, "k long, t long")
    for small in (0, 1000):
        assert {r["k"]: r["t"] for r in hierarchy.chase(t, small).collect()} == want
    assert hierarchy.chase(t.limit(0)).collect() == []


def test_few_rows_and_refusal(spark):
    one = spark.createDataFrame([], "a long, b long, w double")
    assert [tuple(r) for r in hierarchy.condensed_labels(one, 1, 2).collect()] == [(0, -1)]
    assert hierarchy.condensed_labels(one, 0, 2).collect() == []
    two = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 9.0), (3, 4, 1.0), (4, 5, 1.0)]
    assert sorted(tuple(r) for r in hierarchy.condensed_labels(table(spark, two), 6, 3).collect()) == [(i, i // 3) for i in range(6)]
    with pytest.raises(ValueError, match="clusters"):
        hierarchy.condensed_labels(table(spark, two), 6, 3, most_clusters=2)
    assert math.isfinite(hierarchy.positions(table(spark, two), ["w", "a"]).agg({"pos": "max"}).first()[0])
