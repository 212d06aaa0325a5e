"""Typed property graphs as vertex and edge tables, and the bounded kernels that rank them.

Whole-graph work is joins; traversals that stop at a few hundred nodes run in
one process, because their result depends on the order in which nodes are met.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

# Weights of edge types in ranking.
EDGE_WEIGHTS = {
    "CALLS": 3, "REFERENCES": 3, "TARGETS": 3, "DEPENDS_ON": 3, "BLOCKS": 3, "VERIFIED_BY": 3, "RESOLVES": 3,
    "IMPORTS": 2, "EXTENDS": 2, "IMPLEMENTS": 2, "DEFINES": 2, "CONTAINS": 2, "EXPORTS": 2, "PART_OF": 2, "PRODUCED": 2, "RELATED_TO": 1,
}
# Edge types that carry the impact of a change from their target to their source.
IMPACT_TYPES = ("CALLS", "REFERENCES", "IMPORTS", "DEPENDS_ON", "TARGETS", "BLOCKS", "VERIFIED_BY", "DEFINES", "CONTAINS")


@dataclass(frozen=True)
class GraphConfig:
    """Limits and parameters of ranking; checked when made."""

    rrf_k: float = 60.0
    damping: float = 0.85
    max_hops: int = 3
    max_candidates: int = 200
    min_score: float = 1e-6
    max_iterations: int = 100
    tolerance: float = 1e-10
    weights: Mapping[str, float] = field(default_factory=lambda: dict(EDGE_WEIGHTS))

    def __post_init__(self) -> None:
        fine = self.rrf_k > 0 and 0 <= self.damping < 1 and 0 <= self.max_hops <= 10 and 1 <= self.max_candidates <= 2000
        fine &= self.min_score >= 0 and 1 <= self.max_iterations <= 1000 and self.tolerance > 0 and all(w > 0 for w in self.weights.values())
        if not fine or not all(np.isfinite([self.rrf_k, self.damping, self.min_score, self.tolerance, *self.weights.values()])):
            raise ValueError("a graph parameter is out of range")


@dataclass(frozen=True, order=True)
class Edge:
    id: str
    source: str
    target: str
    kind: str


def dedup_edges(edges: DataFrame, *identity: str) -> DataFrame:
    """One edge of each identity."""
    return edges.dropDuplicates(list(identity))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out): how many edges come to and go from each node, both counted in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("n_in"), F.sum("o").cast("long").alias("n_out"))


def neighbours(edges: DataFrame, node: str, kind: str | None = None, incoming: bool = False) -> DataFrame:
    """Edges from (or to) a node, of one type if named: callees and callers, imports, definitions."""
    here = edges.where(F.col("dst" if incoming else "src") == node)
    return here if kind is None else here.where(F.col("type") == kind)


def levels(edges: DataFrame, seeds: DataFrame, hops: int, both: bool = False, kinds: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """(node, hop): the smallest number of hops to each reachable node, in at most `hops` joins."""
    e = edges if kinds is None else edges.where(F.col("type").isin(*kinds))
    forward, backward = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = forward.unionByName(backward) if both else backward if reverse else forward
    steps = steps.distinct()
    frontier = found = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        reached = frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(found, "node", "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


def paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop, path): the first path to each node; of several arrivals the smallest (from, edge) counts."""
    frontier = found = seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.array("node").alias("path"))
    e = edges.select("src", "dst", "id")
    for hop in range(1, hops + 1):
        arrivals = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("to"), F.struct("src", "id", "path").alias("via"))
        best = arrivals.groupBy("to").agg(F.min("via").alias("via"))
        frontier = cut(best.join(found.select(F.col("node").alias("to")), "to", "left_anti").select(F.col("to").alias("node"), F.lit(hop).alias("hop"), F.concat("via.path", F.array("to")).alias("path")))
        found = found.unionByName(frontier)
    return found


def bounded_bfs(edges: Iterable[Edge], seeds: Iterable[str], max_hops: int, max_candidates: int, reverse: bool = False) -> dict[str, tuple[Edge, ...]]:
    """Nodes met by a breadth-first search with a cap, in order, each with the edges of its first path.

    Normally edges go both ways; in reverse only impact types, from target to
    source.  The frontier and the edges of a node are taken in order of id, so
    the result does not depend on the order of the input.
    """
    ordered = sorted(edges, key=attrgetter("id"))
    out: dict[str, list[tuple[Edge, str]]] = {}
    for e in ordered:
        if reverse:
            if e.kind in IMPACT_TYPES:
                out.setdefault(e.target, []).append((e, e.source))
        else:
            out.setdefault(e.source, []).append((e, e.target))
            out.setdefault(e.target, []).append((e, e.source))
    found: dict[str, tuple[Edge, ...]] = {s: () for s in sorted(set(seeds))[:max_candidates]}
    frontier = list(found)
    for _ in range(max_hops):
        reached: list[str] = []
        for node in frontier:
            for e, other in out.get(node, ()):
                if other not in found and len(found) < max_candidates:
                    found[other] = (*found[node], e)
                    reached.append(other)
        frontier = sorted(reached)
        if not frontier:
            break
    return found


def personalized_pagerank(edges: Iterable[Edge], seeds: Iterable[str], config: GraphConfig | None = None, reverse: bool = False) -> tuple[dict[str, float], dict[str, tuple[Edge, ...]], int]:
    """Scores (summing to 1) of the nodes that a bounded search reaches, their paths, and the iterations taken."""
    config = config or GraphConfig()
    edges = sorted({e.id: e for e in edges}.values(), key=attrgetter("id"))
    found = bounded_bfs(edges, seeds, config.max_hops, config.max_candidates, reverse)
    nodes = sorted(found)
    starts = sorted(set(seeds) & set(nodes))
    if not starts:
        return {}, {}, 0
    index = {n: k for k, n in enumerate(nodes)}
    move = np.zeros((len(nodes), len(nodes)))
    for e in edges:
        if e.source in index and e.target in index and (not reverse or e.kind in IMPACT_TYPES):
            w = float(config.weights.get(e.kind, 1))
            a, b = index[e.source], index[e.target]
            if not reverse:
                move[a, b] += w
            move[b, a] += w  # both ways, so an edge of a node to itself counts twice
    total = move.sum(axis=1)
    move[total > 0] /= total[total > 0, None]
    restart = np.zeros(len(nodes))
    restart[[index[s] for s in starts]] = 1 / len(starts)
    score, iterations = restart.copy(), 0
    for iterations in range(1, config.max_iterations + 1):
        flow = score @ move + score[total == 0].sum() * restart
        new = (1 - config.damping) * restart + config.damping * flow
        done = np.abs(new - score).sum() < config.tolerance
        score = new
        if done:
            break
    return {n: float(score[index[n]]) for n in nodes}, found, iterations


def ranking_steps(edges: DataFrame, weights: Mapping[str, float] = EDGE_WEIGHTS, reverse: bool = False) -> DataFrame:
    """(src, dst, weight) of the steps that ranking takes over typed edges (src, dst, type): both ways, so an edge of a node to itself counts twice; in reverse only impact types, from target to source."""
    weight = F.lit(1.0)
    for kind, w in weights.items():
        weight = F.when(F.col("type") == kind, float(w)).otherwise(weight)
    e = edges.select("src", "dst", "type", weight.alias("weight"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    if reverse:
        return e.where(F.col("type").isin(*IMPACT_TYPES)).select(back.alias("s")).select("s.*")
    return e.select(F.explode(F.array(F.struct("src", "dst", "weight"), back)).alias("s")).select("s.*")


def pagerank_rounds(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(node, score) of a personalized PageRank on the whole graph, by a fixed number of joins.

    edges has src, dst, weight, both ways where wanted; the mass of nodes
    without edges goes back to the seeds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    out = step.select("src").distinct()
    n = seeds.select("node").distinct().agg(F.count("*").alias("n"))
    start = seeds.select("node").distinct().crossJoin(F.broadcast(n)).select("node", (F.lit(1.0) / F.col("n")).alias("restart"))
    score = start.select("node", F.col("restart").alias("score"))
    for k in range(rounds):
        moved = score.join(step, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("p")).alias("moved"))
        lost = score.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        score = start.join(moved, F.col("node") == F.col("dst"), "full_outer").crossJoin(F.broadcast(lost)).select(
            F.coalesce("node", "dst").alias("node"),
            ((1 - damping) * F.coalesce("restart", F.lit(0.0)) + damping * (F.coalesce("moved", F.lit(0.0)) + F.col("lost") * F.coalesce("restart", F.lit(0.0)))).alias("score"),
        )
        if k % 2 or k == rounds - 1:  # each score is used twice, so a plan doubles with every round that is not cut
            score = cut(score)
    return score
