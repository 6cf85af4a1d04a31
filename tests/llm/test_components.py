import random

import pytest

from strandline.llm import components as C


def union_find(pairs):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, linked in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        if linked and root(a) != root(b):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((x, root(x)) for x in parent)


@pytest.mark.parametrize("side, cell, local", [(None, 400_000, 1_000_000), (1, 9, 1_000_000), (5, 20, 1_000_000), (3, 40, 25)])
def test_groups_equal_union_find_on_any_grid(spark, side, cell, local):
    rng = random.Random(7)
    pairs = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}", rng.random() < 0.6) for _ in range(260)]
    chain = [f"c{i:03}" for i in range(120)]
    rng.shuffle(chain)
    pairs += [(a, b, True) for a, b in zip(chain, chain[1:])]
    pairs += [("hub", f"h{i}", True) for i in range(150)] + [("hub", "hub", True), ("é", "z", True), ("Z", "z", True), ("solo", "solo", False)]
    pairs += pairs[:20] + [(b, a, x) for a, b, x in pairs[:20]]
    df = spark.createDataFrame(pairs, "id1 string, id2 string, linked boolean")
    parents = C.component_parents(df.where("linked").selectExpr("id1 u", "id2 v"), side, cell, local)
    direct = dict(tuple(r) for r in parents.collect())
    want = union_find(pairs)
    assert all(direct.get(x, x) == g for x, g in want)
    assert sorted(tuple(r) for r in C.linked_groups(df, side, cell).collect()) == want


def test_calls_with_missing_ids_and_failed_distances(spark):
    rows = [
        ("a", "b", 0, "x"), ("b", "c", 20, "x"), ("c", "d", 21, "x"), ("d", "e", None, "x"), ("e", "d", -1, "x"), ("f", "f", 3, "x"),
        (None, "a", 1, "x"), ("", "a", 1, "x"), (".", "g", 1, "x"), ("h", "NA", 1, "x"), ("b", "a", 99, "x"),
    ]
    got = C.call_groups(spark.createDataFrame(rows, "id1 string, id2 string, edit_distance bigint, group_id string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")]
    assert C.call_groups(spark.createDataFrame([], "id1 string, id2 string, edit_distance bigint")).count() == 0


def test_the_grid_has_several_cells_in_every_run(spark):
    assert C.grid_side(spark) >= 2
    edges = spark.createDataFrame([(f"c{i:04}", f"c{i + 1:04}") for i in range(500)], "u string, v string")
    got = dict(tuple(r) for r in C.component_parents(edges).collect())
    assert len(got) == 500 and set(got.values()) == {"c0000"}
    cells = edges.repartition(4, "u").mapInArrow(C.local_forest(3), "v string, r string")
    assert cells.rdd.getNumPartitions() == 4 and cells.count() > 0
