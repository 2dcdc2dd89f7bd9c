"""Reachability kept up to date over a stream of changes: edges and seeds of projects come and go.

A project's graph and the depth of each of its nodes live in the state store, one entry a node. A
batch reads and writes only the entries that its changes touch; a project's changes of a batch are
one task's work, so a large graph is best brought in over several batches. Edges that go may take depths with
them: nodes that lose their last support are given up in order of depth, then derived again from
what is left, together with what new edges and seeds bring. After each batch depths are those of a
search over the whole graph.

Defined cases: of several changes to one edge or seed in a batch the one with the largest ``at``
holds; adding what is there and removing what is not change nothing; an edge from a node to itself
supports nothing; an op other than ``+`` and ``-`` is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.shipping import ship

#: A change: an edge from src to dst, or a seed (dst null), added or removed.
CHANGE = "project string, src string, dst string, op string, at long"
DEPTH = "project string, node string, depth int"
FAR = 1 << 30


@dataclass
class Node:
    depth: int = FAR
    seed: bool = False
    heads: set[str] = field(default_factory=set)
    tails: set[str] = field(default_factory=set)


class Graph:
    """Nodes, loaded when first asked for."""

    def __init__(self, load: Callable[[str], Node | None]):
        self.load, self.nodes, self.before = load, {}, {}

    def __getitem__(self, name: str) -> Node:
        if name not in self.nodes:
            node = self.load(name) or Node()
            self.nodes[name], self.before[name] = node, (node.depth, node.seed, frozenset(node.heads), frozenset(node.tails))
        return self.nodes[name]

    def touched(self) -> Iterator[tuple[str, Node, int]]:
        """Nodes that differ from what was loaded, with the depth that they had."""
        for name, node in self.nodes.items():
            if (node.depth, node.seed, node.heads, node.tails) != self.before[name]:
                yield name, node, self.before[name][0]

    def change(self, changes: Iterable[tuple[str, str | None, str]]) -> None:
        """Apply (src, dst or None, op), each edge and seed once."""
        suspects, fresh = [], []
        for src, dst, op in changes:
            if op not in ("+", "-"):
                raise ValueError(f"a change adds (+) or removes (-), not {op!r}")
            here = self[src]
            if dst is None:
                if op == "-" and here.seed:
                    suspects.append((here.depth, src))
                elif op == "+":
                    fresh.append((0, src))
                here.seed = op == "+"
            elif op == "+" and dst not in here.heads:
                here.heads.add(dst)
                self[dst].tails.add(src)
                fresh.append((None, src, dst))
            elif op == "-" and dst in here.heads:
                here.heads.discard(dst)
                self[dst].tails.discard(src)
                if self[dst].depth == here.depth + 1:
                    suspects.append((self[dst].depth, dst))
        lost = self._give_up(suspects)
        self._derive(lost, fresh)

    def _give_up(self, suspects: list[tuple[int, str]]) -> set[str]:
        """Nodes that nothing holds at their depth any more; shallow ones are decided first, so supports are settled."""
        lost: set[str] = set()
        heapq.heapify(suspects)
        while suspects:
            depth, name = heapq.heappop(suspects)
            node = self[name]
            if name in lost or node.depth != depth or depth >= FAR or node.seed and depth == 0:
                continue
            if depth > 0 and any(self[t].depth == depth - 1 and t not in lost for t in node.tails):
                continue
            lost.add(name)
            for head in node.heads:
                if self[head].depth == depth + 1:
                    heapq.heappush(suspects, (depth + 1, head))
        return lost

    def _derive(self, lost: set[str], fresh: list[tuple]) -> None:
        for name in lost:
            self[name].depth = FAR
        found = [(0, f[1]) for f in fresh if f[0] == 0]
        found += [(self[f[1]].depth + 1, f[2]) for f in fresh if f[0] is None]
        found += [(0, name) for name in lost if self[name].seed]
        found += [(min((self[t].depth for t in self[name].tails), default=FAR) + 1, name) for name in lost]
        heapq.heapify(found)
        while found:
            depth, name = heapq.heappop(found)
            node = self[name]
            if depth >= min(node.depth, FAR):
                continue
            node.depth = depth
            for head in node.heads:
                heapq.heappush(found, (depth + 1, head))


class _Keeper(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("nodes", "node string", "depth int, seed boolean, heads array<string>, tails array<string>")

    def _load(self, name: str) -> Node | None:
        if not self.state.containsKey((name,)):
            return None
        depth, seed, heads, tails = self.state.getValue((name,))
        return Node(depth, seed, set(heads), set(tails))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[tuple[str, str | None], tuple[int, str]] = {}
        for frame in rows:
            for src, dst, op, at in zip(frame["src"], frame["dst"], frame["op"], frame["at"], strict=True):
                one = (src, None if pd.isna(dst) else dst)
                if one not in last or (at, op) >= last[one]:
                    last[one] = (at, op)
        graph = Graph(self._load)
        graph.change((src, dst, op) for (src, dst), (_, op) in last.items())
        out = []
        for name, node, before in graph.touched():
            if node.heads or node.tails or node.seed:
                self.state.updateValue((name,), (node.depth, node.seed, sorted(node.heads), sorted(node.tails)))
            elif self.state.containsKey((name,)):
                self.state.removeKey((name,))
            if node.depth != before:
                out.append((key[0], name, node.depth if node.depth < FAR else None))
        yield pd.DataFrame({"project": pd.Series([r[0] for r in out], dtype=object), "node": pd.Series([r[1] for r in out], dtype=object), "depth": pd.array([r[2] for r in out], "Int32")})

    def close(self) -> None:
        pass


def depth_changes(changes: DataFrame) -> DataFrame:
    """project, node, depth of every node whose depth a batch of ``changes`` (a stream of CHANGE) altered; null: no longer reached."""
    ship(changes.sparkSession)
    rows = changes.filter("project IS NOT NULL AND src IS NOT NULL AND op IS NOT NULL").withColumn("at", F.coalesce("at", F.lit(0)))
    return rows.groupBy("project").transformWithStateInPandas(_Keeper(), DEPTH, "Update", "None")


def follow(spark: SparkSession, source: str, checkpoint: str, target: str):
    """Take in what has arrived in ``source`` (files of CHANGE) and write the altered depths under ``target``, then stop.

    A batch is written under its number, so one that is done again after a failure writes the same place.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = depth_changes(spark.readStream.schema(CHANGE).parquet(source))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """project, node, depth of the nodes that are reached now: each node's last written depth."""
    rows = spark.read.schema(f"{DEPTH}, batch long").parquet(target)
    last = rows.groupBy("project", "node").agg(F.max_by(F.struct("depth"), "batch").alias("last"))
    return last.select("project", "node", F.col("last.depth").alias("depth")).filter("depth IS NOT NULL")
