"""Online solving on Structured Streaming: arrival order, a re-solve policy, one writer.

The state of a graph is global, so micro-batches go through one foreachBatch writer that keeps versioned tables
of edges and states; how a batch is treated is decided by counters alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.optimize import PoseGraph, Solution, gauss_newton, initial_states


@dataclass(frozen=True)
class Policy:
    """How often to solve: every `nonlinear` or `linear` units (0: never), counted in vertices or edges."""

    nonlinear: int = 1
    linear: int = 0
    by_vertices: bool = True
    #: Wait for the first loop closure.
    need_closure: bool = True
    iterations: int = 5
    threshold: float = 20.0
    marginals: bool = False


NONE, LINEAR, NONLINEAR = 0, 1, 2


@dataclass
class Counters:
    vertices: int = 0
    edges: int = 0
    last_linear: int = 0
    last_nonlinear: int = 0
    closure: bool = False
    delayed: bool = False


def decide(policy: Policy, c: Counters, new_edges: int, new_vertices: int, closure: bool) -> int:
    """What to do after a step, and the counters moved on."""
    c.edges += new_edges
    c.vertices += new_vertices
    c.closure |= closure
    at = c.vertices if policy.by_vertices else c.edges
    if c.delayed or (policy.need_closure and not c.closure):
        return NONE
    if policy.nonlinear and at - c.last_nonlinear >= policy.nonlinear:
        c.last_nonlinear = c.last_linear = at
        c.closure = False
        return NONLINEAR
    if policy.linear and at - c.last_linear >= policy.linear:
        c.last_linear = at
        return LINEAR
    return NONE


def step_types(edges: DataFrame, policy: Policy, group: list[str]) -> DataFrame:
    """For recorded streams (group, eid, v0, v1), the count windows and closures of each edge as columns: n_vertices, is_closure, window."""
    w = Window.partitionBy(*group).orderBy("eid")
    top = F.max(F.greatest("v0", "v1")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.max(F.greatest("v0", "v1")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    n = (top + 1) if policy.by_vertices else F.row_number().over(w)
    size = policy.nonlinear or policy.linear or 1
    return edges.select(*edges.columns, (top + 1).alias("n_vertices"), (F.greatest("v0", "v1") <= before).alias("is_closure"), F.call_function("div", n.cast("long"), F.lit(size).cast("long")).alias("window"))


@dataclass
class OnlineSolver:
    """Takes batches of edges (eid, v0, v1, dx, dy, dt) in the order of eid; keeps edges, states and counters.

    An edge whose eid is known replaces it; `changed_from` says from which edge on partial sums are stale.
    """

    policy: Policy = field(default_factory=Policy)
    information: float = 45.0
    on_solution: Callable[[Solution, int], None] | None = None
    counters: Counters = field(default_factory=Counters)
    edges: dict[int, tuple] = field(default_factory=dict)
    states: DataFrame | None = None
    changed_from: int | None = None
    last: Solution | None = None

    def delay(self) -> None:
        self.counters.delayed = True

    def enable(self) -> None:
        self.counters.delayed = False

    def add(self, batch: DataFrame, batch_id: int = 0) -> int:
        """Takes a micro-batch; returns what was done. Batches are the increments of one graph and come to this writer."""
        rows = batch.select("eid", "v0", "v1", "dx", "dy", "dt").orderBy("eid").toLocalIterator()
        done = NONE
        fresh: list[tuple] = []
        known = self.counters.vertices
        seen_top, closure, new_edges = known - 1, False, 0
        for r in rows:
            if r.eid in self.edges:
                self.changed_from = r.eid if self.changed_from is None else min(self.changed_from, r.eid)
            else:
                new_edges += 1
                closure |= max(r.v0, r.v1) <= seen_top
            seen_top = max(seen_top, r.v0, r.v1)
            self.edges[r.eid] = tuple(r)
            fresh.append(tuple(r))
        if not fresh:
            return NONE
        done = decide(self.policy, self.counters, new_edges, seen_top + 1 - known, closure)
        spark = batch.sparkSession
        graph = PoseGraph(self.frame(spark), information=self.information)
        guess = initial_states(graph.edges)
        if self.states is not None:  # solved states stay; new vertices start from the edges
            guess = guess.join(self.states.select("v"), "v", "left_anti").unionByName(self.states)
        graph.states = guess
        if done:
            one = done == LINEAR
            self.last = gauss_newton(graph, 1 if one else self.policy.iterations, 0.0 if one else self.policy.threshold)
            self.states = self.last.states
            self.changed_from = None
            if self.on_solution:
                self.on_solution(self.last, batch_id)
        return done

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.edges.values()), "eid long, v0 long, v1 long, dx double, dy double, dt double")

    def finish(self, spark, iterations: int = 5, threshold: float = 0.01) -> Solution:
        """The batch solve at the end."""
        self.last = gauss_newton(PoseGraph(self.frame(spark), self.states, self.information), iterations, threshold)
        self.states = self.last.states
        return self.last

    def run(self, stream: DataFrame, checkpoint: str):
        """Starts a query that feeds this solver."""
        return stream.writeStream.foreachBatch(lambda b, i: self.add(b, i) and None).option("checkpointLocation", checkpoint).start()


def flush_segments(lines: DataFrame, group: str) -> DataFrame:
    """Batches by punctuation: (group, segment, n, first, last) of the lines up to each marker (is_marker)."""
    w = Window.partitionBy(group).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    s = lines.withColumn("segment", F.coalesce(F.count_if("is_marker").over(w), F.lit(0)))
    return s.groupBy(group, "segment").agg(F.count_if(~F.col("is_marker")).alias("n"), F.min("line").alias("first"), F.max("line").alias("last"))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with rows replaced or added by the latest change of each key."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("s")).select("s.*").select(*table.columns)
    return table.join(last.select(key), key, "left_anti").unionByName(last)
