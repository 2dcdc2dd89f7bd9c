import random

from quarry.operators import graph

EDGE, NODE = "project string, src string, dst string", "project string, node string"


def shapes():
    rng = random.Random(2)
    tree = [("p", f"n{(k - 1) // 2}", f"n{k}") for k in range(1, 300)]
    chain = [("p", f"n{k}", f"n{k + 1}") for k in range(300)]
    ring = [("q", f"r{k}", f"r{(k + 1) % 50}") for k in range(50)] + [("q", "s", "t")]
    comb = chain + [("p", f"n{k}", f"leaf{k}") for k in range(0, 300, 3)]
    shortcut = chain + [("p", "n0", "n200"), ("p", "n10", "n290"), ("p", "n299", "n3"), ("p", "n5", "n5")]
    randoms = [("p", f"n{rng.randint(0, 120)}", f"n{rng.randint(0, 120)}") for _ in range(150)] + [("q", f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(60)]
    return {"tree": tree, "chain": chain, "ring": ring, "comb": comb, "shortcut": shortcut, "random": randoms, "none": []}


def test_rounds_give_the_depths_of_a_search(spark):
    """All shapes, each from two sets of seeds, as projects of one table."""
    edges, seeds = [], []
    for shape, rows in shapes().items():
        for k, starts in enumerate(([("p", "n0"), ("q", "s"), ("p", "lonely")], [("p", "n7"), ("p", "n150"), ("q", "r3"), ("q", "n1")])):
            edges += [(f"{shape} {p} {k}", a, b) for p, a, b in rows]
            seeds += [(f"{shape} {p} {k}", n) for p, n in starts]
    edges, seeds = spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, NODE)
    rounds, search = ({(r.project, r.node): r.depth for r in graph.reachable(edges, seeds, method=m).collect()} for m in ("rounds", "search"))
    assert rounds == search


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 nodes one after the other: doublings and frontier rounds are at most 20 together."""
    n = 100_000
    rounds = []
    written = graph._written

    def counted(df):
        rounds.append(sorted(df.columns))
        return written(df)

    monkeypatch.setattr(graph, "_written", counted)
    edges = spark.range(n - 1).selectExpr("'p' AS project", "concat('n', id) AS src", "concat('n', id + 1) AS dst")
    seeds = spark.createDataFrame([("p", "n0")], NODE)
    got = graph.reachable(edges, seeds, method="rounds")
    assert got.count() == n and got.filter("node <> concat('n', depth)").isEmpty()
    doublings = sum(c == sorted(["project", "node", "head", "length", "open"]) for c in rounds)
    steps = sum(c == sorted(["project", "node", "depth"]) for c in rounds)
    # Of these tables one for each of two contractions, and two for each when depths are handed back, are no rounds.
    assert (doublings - 2) + (steps - 4) <= 20, (doublings, steps)
