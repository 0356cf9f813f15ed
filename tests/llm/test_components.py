"""Rounds of connected components leave nothing on the driver."""

import numpy as np

from corpus_pipeline import near_dedup
from ticklane.llm import components as C
from ticklane.llm.components import _star, components


def by_search(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for start in sorted(near):
        todo = [start] if start not in least else []
        while todo:
            if (x := todo.pop()) not in least:
                least[x] = start
                todo += near[x]
    return least


def test_a_round_on_a_small_graph_broadcasts_nothing(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(9)] + [(k, 0) for k in range(1, 5)] + [(21, 20)], "a long, b long")
    for large in (True, False):
        made = _star(edges, large, 1)
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in components(edges).collect()} == {*((k, 0) for k in range(10)), (20, 20), (21, 20)}


def test_a_task_ties_its_nodes_to_the_least_one():
    rng = np.random.default_rng(7)
    for n in (1, 2, 40, 400):
        for edges in (rng.integers(0, n, (n, 2)), rng.integers(0, n, (n // 2 + 1, 2)) * -3, np.stack([rng.permutation(n), np.roll(rng.permutation(n), 1)], 1)):
            node, root = C.roots(edges[:, 0], edges[:, 1])
            assert dict(zip(node.tolist(), root.tolist(), strict=True)) == by_search(edges.tolist())


def test_a_small_graph_takes_no_rounds(spark, monkeypatch):
    edges = [(k + 1, k) for k in range(300)] + [(500, 400), (401, 500)]
    monkeypatch.setattr(C, "_star", lambda *_: 1 / 0)  # each round was a plan, some stages and their threads on the driver
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == set(by_search(edges).items())


def test_the_pipelines_near_dedup_takes_no_rounds_on_few_links(spark, monkeypatch):
    words = [f"word{k}" for k in range(120)]
    texts = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in (10, 60, 110)] + ["a text of its own", " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(C, "_star", lambda *_: 1 / 0)
    assert sorted(r.doc_id for r in near_dedup(spark, docs, "").collect()) == [0, 3]


def test_forests_of_several_tasks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(C, "EDGES_A_FOREST", 60)
    rng = np.random.default_rng(8)
    edges = [*((k + 1, k) for k in range(120)), *map(tuple, rng.integers(200, 500, (150, 2)).tolist()), *((700, 600 + k) for k in range(60))]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task gets all of so few edges
    try:
        got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == set(by_search([e for e in edges if e[0] != e[1]]).items())
