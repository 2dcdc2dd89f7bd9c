import random
from collections import deque

import pytest

from quarry.operators import graph
from quarry.streaming import reach


def search(edges, seeds):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    depth, queue = dict.fromkeys(seeds, 0), deque(seeds)
    while queue:
        a = queue.popleft()
        for b in after.get(a, ()):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    return depth


@pytest.mark.parametrize("seed", range(12))
def test_changes_against_a_whole_search(seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(rng.choice([4, 12, 40]))]
    edges, seeds, kept = set(), set(), {}
    for _ in range(60):
        changes = {}
        for _ in range(rng.randint(1, 8)):
            a, b = rng.choice(nodes), rng.choice(nodes)
            one = (a, None) if rng.random() < 0.15 else (a, b)
            changes[one] = rng.choice("+-" if rng.random() < 0.5 else "+-+")
        g = reach.Graph(kept.get)
        g.change([(a, b, op) for (a, b), op in changes.items()])
        kept |= {name: node for name, node, _ in g.touched()}
        for (a, b), op in changes.items():
            (seeds if b is None else edges).__getattribute__("add" if op == "+" else "discard")(a if b is None else (a, b))
        assert {n: k.depth for n, k in kept.items() if k.depth < reach.FAR} == search(edges, seeds)


def test_a_change_touches_only_what_it_must():
    g = reach.Graph(lambda name: None)
    g.change([("s", None, "+"), *((f"a{k}", f"a{k + 1}", "+") for k in range(500)), ("s", "a0", "+"), ("s", "t", "+")])
    kept, asked = dict(g.nodes), []
    again = reach.Graph(lambda name: asked.append(name) or kept.get(name))
    again.change([("t", "u", "+")])
    assert set(asked) == {"t", "u"} and again["u"].depth == 2


def test_state_lives_between_batches_and_restarts(spark, tmp_path):
    """Every batch is a run of its own that goes on from the checkpoint; after each the result is that of a full search."""
    rng = random.Random(3)
    at = {k: str(tmp_path / k) for k in ("source", "checkpoint", "target")}
    edges, seeds, n = {"p": set(), "q": set()}, {"p": set(), "q": set()}, 0
    for batch in range(4):
        rows = []
        for _ in range(120 if batch == 0 else 25):
            p, a, b = rng.choice("pq"), f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}"
            op = "+" if batch == 0 or rng.random() < 0.4 else "-"
            if op == "-" and edges[p] and rng.random() < 0.9:
                a, b = rng.choice(sorted(edges[p]))
            if rng.random() < 0.05:
                b = None
            n += 1
            rows.append((p, a, b, op, n))
            (seeds if b is None else edges)[p].__getattribute__("add" if op == "+" else "discard")(a if b is None else (a, b))
        if batch == 0:
            rows += [("p", "n1", None, "+", n + 1), ("q", "n2", None, "+", n + 2)]
            seeds["p"].add("n1")
            seeds["q"].add("n2")
            n += 2
        spark.createDataFrame(rows, reach.CHANGE).coalesce(1).write.mode("append").parquet(at["source"])
        reach.follow(spark, at["source"], at["checkpoint"], at["target"]).awaitTermination()
        got = {(r.project, r.node): r.depth for r in reach.current(spark, at["target"]).collect()}
        assert got == {(p, k): d for p in "pq" for k, d in search(edges[p], seeds[p]).items()}, batch
    full = graph.reachable(
        spark.createDataFrame([(p, a, b) for p in "pq" for a, b in edges[p]], "project string, src string, dst string"), spark.createDataFrame([(p, a) for p in "pq" for a in seeds[p]], "project string, node string")
    )
    assert {(r.project, r.node): r.depth for r in full.collect()} == got


def test_an_unknown_op_is_an_error():
    with pytest.raises(ValueError, match="adds"):
        reach.Graph(lambda name: None).change([("a", "b", "*")])
