"""Graphs as edge DataFrames (src, dst), and the same questions on the driver for small task graphs."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Hashable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut


class Graph:
    """A directed graph of driver-side tasks; vertices and edges keep their order and count once."""

    def __init__(self, edges: Iterable[tuple[Hashable, Hashable]] = (), vertices: Iterable[Hashable] = ()):
        self.out: dict[Hashable, dict[Hashable, None]] = {}
        self.into: dict[Hashable, dict[Hashable, None]] = {}
        for v in vertices:
            self.add_vertex(v)
        for a, b in edges:
            self.add_edge(a, b)

    def add_vertex(self, v: Hashable) -> None:
        self.out.setdefault(v, {})
        self.into.setdefault(v, {})

    def add_edge(self, a: Hashable, b: Hashable) -> None:
        self.add_vertex(a)
        self.add_vertex(b)
        self.out[a][b] = self.into[b][a] = None

    def vertices(self) -> list:
        return list(self.out)

    def edges(self) -> list[tuple]:
        return [(a, b) for a, bs in self.out.items() for b in bs]

    def successors(self, v: Hashable) -> list:
        return list(self.out[v])

    def predecessors(self, v: Hashable) -> list:
        return list(self.into[v])

    def neighbors(self, v: Hashable) -> list:
        return list(dict.fromkeys([*self.out[v], *self.into[v]]))

    def has_vertex(self, v: Hashable) -> bool:
        return v in self.out

    def has_edge(self, a: Hashable, b: Hashable) -> bool:
        return b in self.out.get(a, ())

    def order(self) -> list:
        """Topological order, first come first served; ValueError on a cycle."""
        waiting = {v: len(p) for v, p in self.into.items()}
        ready, done = deque(v for v, n in waiting.items() if not n), []
        while ready:
            done.append(v := ready.popleft())
            for w in self.out[v]:
                waiting[w] -= 1
                if not waiting[w]:
                    ready.append(w)
        if len(done) < len(self.out):
            raise ValueError("the graph has a cycle")
        return done

    def has_cycle(self) -> bool:
        try:
            return not self.order() and bool(self.out)
        except ValueError:
            return True


def in_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, degree), zero included; repeated edges count once."""
    into = edges.distinct().groupBy(F.col("dst").alias("vertex")).agg(F.count(F.lit(1)).alias("n"))
    return vertices.join(into, "vertex", "left").select("vertex", F.coalesce("n", F.lit(0)).alias("degree"))


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, level): the longest path to each vertex, layer by layer; ValueError on a cycle. Each layer is checkpointed, and there are as many as the longest path has vertices."""
    left, todo = vertices.select("vertex").distinct(), edges.distinct()
    out = None
    for level in itertools.count():
        layer = left.join(todo.select(F.col("dst").alias("vertex")).distinct(), "vertex", "left_anti")
        layer = cut(layer.withColumn("level", F.lit(level)))
        if layer.isEmpty():
            break
        out = layer if out is None else out.unionByName(layer)
        left = cut(left.join(layer, "vertex", "left_anti"))
        todo = cut(todo.join(layer.select(F.col("vertex").alias("src")), "src", "left_anti"))
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return out if out is not None else vertices.select("vertex", F.lit(0).alias("level"))
