"""Graph operators on edge tables (a, b): co-visibility, components, spanning trees, independent sets, cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle

#: Edges and vertices up to which a graph is worked on by the driver; beyond, by rounds of joins.
SMALL = 200_000
#: Cameras of a landmark, about, that a task pairs with as many others.
BLOCK = 2_000


def is_small(vertices: DataFrame, edges: DataFrame, small: int) -> bool:
    return small > 0 and edges.limit(small + 1).count() <= small and vertices.limit(small + 1).count() <= small


class Forest:
    """Union-find with the least vertex as the root."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, v: int) -> int:
        root = v
        while (up := self.top.get(root, root)) != root:
            root = up
        while v != root:
            self.top[v], v = root, self.top.get(v, v)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.top[max(a, b)] = min(a, b)
        return True


def meetings(seen: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lo, hi, n_lo, n_hi) for each landmark that two cameras share, from distinct (landmark, cam, n). The cameras of a landmark seen by more than `block` are dealt into parts, and each two parts meet in a cell of their own."""
    crowded = seen.groupBy("landmark").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = seen.join(crowded, "landmark", "left").withColumn("part", F.pmod(F.xxhash64("cam"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lo = dealt.select("landmark", F.col("part").alias("i"), F.col("other").alias("j"), F.col("cam").alias("lo"), F.col("n").alias("n_lo"))
    hi = dealt.select("landmark", F.col("other").alias("i"), F.col("part").alias("j"), F.col("cam").alias("hi"), F.col("n").alias("n_hi"))
    return lo.join(hi, ["landmark", "i", "j"]).where("lo < hi").select("lo", "hi", "n_lo", "n_hi")


def covisibility(observations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lo, hi, weight) of cameras that see a common landmark, from (cam, landmark): 1 for each two observations of it. A camera that sees a landmark twice pairs with itself; a null camera or landmark pairs with none."""
    seen = observations.where("cam IS NOT NULL AND landmark IS NOT NULL").groupBy("landmark", "cam").agg(F.count("*").alias("n"))
    alone = seen.where("n > 1").groupBy("cam").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("weight")).select(F.col("cam").alias("lo"), F.col("cam").alias("hi"), "weight")
    return meetings(seen, block).groupBy("lo", "hi").agg(F.sum(F.col("n_lo") * F.col("n_hi")).alias("weight")).unionByName(alone)


def co_observation(observations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lo, hi, shared): distinct landmarks that two different cameras share; a null camera or landmark is shared by none."""
    seen = observations.where("cam IS NOT NULL AND landmark IS NOT NULL").select("landmark", "cam").distinct().withColumn("n", F.lit(1))
    return meetings(seen, block).groupBy("lo", "hi").agg(F.count("*").alias("shared"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, once, without loops."""
    e = edges.where("a <> b").select("a", "b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(v, component): the least vertex that each can reach. Labels fall to the neighbours' least and jump to their label's label until none changes; up to `small` edges the driver does it."""
    if is_small(vertices, edges, small):
        forest = Forest()
        for r in edges.select("a", "b").toLocalIterator():
            forest.union(r.a, r.b)
        return edges.sparkSession.createDataFrame([(r.v, forest.find(r.v)) for r in vertices.select("v").toLocalIterator()], "v long, component long")
    both = settle(undirected(edges))
    labels = settle(vertices.select("v", F.col("v").alias("component")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        low = labels.join(near, "v", "left").select("v", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = low.join(labels.select(F.col("v").alias("component"), F.col("component").alias("further")), "component", "left")
        new = settle(jump.select("v", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
        if not new.where("was <> component").limit(1).count():
            return new.select("v", "component")
        labels = new.select("v", "component")


def is_connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return components(vertices, edges).agg((F.count_distinct("component") <= 1).alias("connected"))


def maximum_spanning_tree(vertices: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b, weight) of the heaviest spanning forest; ties by (a, b). Up to `small` edges by Kruskal on the driver, beyond by Boruvka's rounds: every component takes its heaviest edge out."""
    if is_small(vertices, edges, small):
        forest = Forest()
        best: dict[tuple[int, int], int] = {}
        for r in edges.where("a <> b").select("a", "b", "weight").toLocalIterator():
            key = (min(r.a, r.b), max(r.a, r.b))
            best[key] = max(best.get(key, r.weight), r.weight)
        rows = [(*k, w) for k, w in sorted(best.items(), key=lambda x: (-x[1], x[0])) if forest.union(*k)]
        return edges.sparkSession.createDataFrame(rows, "a long, b long, weight long")
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight")))
    tree: DataFrame | None = None
    while True:
        if tree is None:
            labels = vertices.select("v", F.col("v").alias("component"))
        else:
            labels = components(vertices, tree.select("a", "b"), small)
        labels = settle(labels)
        sides = edges.join(labels.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a").join(labels.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b").where("ca <> cb")
        best = F.max(F.struct("weight", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")))
        chosen = sides.select(F.explode(F.array("ca", "cb")).alias("c"), "weight", "a", "b").groupBy("c").agg(best.alias("m")).select((-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), F.col("m.weight").alias("weight")).distinct()
        chosen = settle(chosen)
        if not chosen.limit(1).count():
            return tree if tree is not None else edges.limit(0)
        tree = settle(chosen if tree is None else tree.unionByName(chosen))


def breadth_first(edges: DataFrame, root: int) -> DataFrame:
    """(v, depth, parent) of what the root reaches; of several parents the least."""
    both = settle(undirected(edges))
    spark = edges.sparkSession
    seen = settle(spark.createDataFrame([(root, 0, None)], "v long, depth int, parent long"))
    depth = 0
    while True:
        front = seen.where(F.col("depth") == depth).select(F.col("v").alias("a"))
        new = settle(both.join(front, "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("parent")).join(seen.select("v"), "v", "left_anti").select("v", F.lit(depth + 1).alias("depth"), "parent"))
        if not new.limit(1).count():
            return seen
        seen, depth = settle(seen.unionByName(new)), depth + 1


def maximal_independent_set(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v) of a maximal independent set: in rounds, a vertex joins if its (degree, id) is the least of its open neighbourhood; its neighbours leave."""
    both = settle(undirected(edges))
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("degree"))
    open_ = settle(vertices.select("v").join(degree, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree")))
    chosen = open_.select("v").limit(0)
    while True:
        key = F.struct("degree", "v")
        near = both.join(open_.select(F.col("v").alias("b"), key.alias("k")), "b").groupBy(F.col("a").alias("v")).agg(F.min("k").alias("least"))
        joins = settle(open_.join(near, "v", "left").where(F.col("least").isNull() | (key < F.col("least"))).select("v"))
        if not joins.limit(1).count():
            return chosen
        chosen = settle(chosen.unionByName(joins))
        gone = joins.unionByName(both.join(joins.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"))).distinct()
        open_ = settle(open_.join(gone, "v", "left_anti"))


def schur_ordering(vertices: DataFrame, independent: DataFrame) -> DataFrame:
    """(v, place): those outside the independent set first, then those in it, each by id."""
    v = vertices.select("v").join(independent.select("v", F.lit(1).alias("inside")), "v", "left").select("v", F.coalesce("inside", F.lit(0)).alias("inside"))
    return v.select("v", (F.row_number().over(Window.orderBy("inside", "v")) - 1).cast("long").alias("place"))


def guided_ordering(vertices: DataFrame) -> DataFrame:
    """(v, place) of vertices (v, dim): larger dimensions first."""
    return vertices.select("v", (F.row_number().over(Window.orderBy(F.desc("dim"), "v")) - 1).cast("long").alias("place"))


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the end of smaller (degree, id): no vertex has many ahead of it."""
    d = degrees(undirected(edges).where("a < b"))
    e = undirected(edges).where("a < b").join(d.select(F.col("v").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("v").alias("b"), F.col("degree").alias("db")), "b")
    ahead = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    return e.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z), x < y < z: wedges from the oriented edges, closed by a third."""
    o = settle(oriented(edges))
    wedges = o.join(o.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = undirected(edges).where("a < b").select(F.col("a").alias("b"), F.col("b").alias("c"))
    t = wedges.join(closed, ["b", "c"]).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    return t.select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def prune_cliques(cliques: DataFrame) -> DataFrame:
    """Cliques (members: sorted array) that aren't part of another: candidates share their least common member."""
    c = cliques.select("members").distinct()
    small = c.select("members", F.element_at("members", 1).alias("m"))
    large = c.select(F.col("members").alias("other"), F.explode("members").alias("m"))
    inside = small.join(large, "m").where((F.size("members") < F.size("other")) & (F.size(F.array_except("members", "other")) == 0))
    return c.join(inside.select("members").distinct(), "members", "left_anti")


def odometry_split(edges: DataFrame) -> DataFrame:
    """edges (eid, v0, v1) with is_closure: both ends were seen before. Edges are one order, so this runs in one task a graph; partition by graph where there are many."""
    top = F.max(F.greatest("v0", "v1")).over(Window.orderBy("eid").rowsBetween(Window.unboundedPreceding, -1))
    return edges.withColumn("is_closure", F.coalesce(F.greatest("v0", "v1") <= top, F.lit(False)))
