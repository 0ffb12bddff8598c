"""Consolidating pairwise matches into groups: connected components of a table of edges.

The largest component usually holds most vertices. It is peeled first: breadth-first joins from the vertex of highest
degree, each frontier against the edges, then an anti-join takes its vertices out. Once a frontier is thin beside what
was reached (the component's core is peeled, and chains hang from it), the peeled part becomes one vertex and what hangs
from it is left to the small components. These are labelled by propagating the minimum over the edges, with a jump to the
label's own label in each round, until nothing changes.

The edges are partitioned and sorted by vertex once and stay where they are: each round moves vertices only. A vertex of
many edges has them in several places, and its own row is sent to each. Each round's table is written to the shared
checkpoint folder, the one before the last is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import cut, cut_by, discard, small_or_not

#: Edges of a vertex in one place, and the share of the reached vertices below which a frontier is thin.
PLACE_EDGES, THIN = 100_000, 0.1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", place_edges: int = PLACE_EDGES, thin: float = THIN) -> DataFrame:
    """``vertex, component`` (the smallest vertex of the group) of every vertex that an edge ties to another one.

    Edges may come in either order and repeatedly; edges with a null end, and of a vertex with itself, tie nothing; an
    empty table gives no rows; other columns are ignored. Degrees and neighbours' minima are combined before each
    shuffle, and a vertex's edges are split into places of about ``place_edges``, so a vertex that holds a third of all
    edges is no bottleneck.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    graph, start = _placed(pairs, place_edges)
    if start is None:
        return graph.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    layers, whole = _peel(graph, start, thin)
    peeled = layers[0]
    for layer in layers[1:]:
        peeled = peeled.unionByName(layer)
    outside = graph.join(_sent(peeled), ["a", "p"], "left_anti")
    root = peeled.agg(F.min("a")).first()[0]
    done = peeled.select(F.col("a").alias("vertex"))
    if whole:
        small = _propagate(_placed(outside.select("a", "b"), place_edges)[0])
        return done.withColumn("component", F.lit(root)).unionByName(small)
    # Only the last layer has neighbours outside; the whole peeled part stands for them as one vertex.
    last = layers[-1].select(F.col("a").alias("b"), F.lit(True).alias("_in"))
    rest = outside.join(small_or_not(last), "b", "left").select("a", F.when(F.col("_in"), F.lit(root)).otherwise(F.col("b")).alias("b"))
    small = cut(_propagate(_placed(rest, place_edges)[0]))
    label = small.where(F.col("vertex") == root).first()
    return done.withColumn("component", F.lit(label[1] if label else root)).unionByName(small.where(F.col("vertex") != root))


def _placed(pairs: DataFrame, place_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """``a, p, b, k``: each edge in both directions at a place of its first vertex, with the places of its second; and the
    vertex of highest degree as ``a, k``."""
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = cut(both.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / place_edges).cast("int").alias("k"), F.count(F.lit(1)).alias("n")))
    top = degree.orderBy(F.desc("n"), "a").select("a", "k").limit(1)
    first = top.first()
    if first is None or first.k == 1:
        placed = both.select("a", F.lit(0).alias("p"), "b", F.lit(1).alias("k"))
    else:
        hubs = small_or_not(cut(degree.where("k > 1").select("a", "k")))
        placed = both.join(hubs.select("a", F.col("k").alias("_ka")), "a", "left").join(hubs.select(F.col("a").alias("b"), F.col("k").alias("_kb")), "b", "left")
        place = F.pmod(F.xxhash64("b"), F.coalesce("_ka", F.lit(1))).cast("int")
        placed = placed.select("a", place.alias("p"), "b", F.coalesce("_kb", F.lit(1)).alias("k"))
    graph = cut_by(placed, "a", "p")
    discard(both)
    return graph, None if first is None else cut(top)


def _sent(vertices: DataFrame) -> DataFrame:
    """The rows of ``vertices`` (``a, k``), once for each place of the vertex."""
    return vertices.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")


def _peel(graph: DataFrame, frontier: DataFrame, thin: float) -> tuple[list[DataFrame], bool]:
    """The layers (``a, k``) around ``frontier``, and whether they are its whole component."""
    layers, reached = [frontier], 1
    while True:
        # A neighbour lies in this layer, the one before or the next: only two need taking out.
        found = graph.join(_sent(layers[-1]), ["a", "p"], "left_semi").select(F.col("b").alias("a"), "k").distinct()
        for layer in layers[-2:]:
            found = found.join(layer.select("a"), "a", "left_anti")
        found = cut(found)
        n = found.count()
        if not n:
            return layers, True
        layers.append(found)
        reached += n
        if n < thin * reached:
            return layers, False


def _propagate(graph: DataFrame) -> DataFrame:
    own = graph.groupBy("a").agg(F.min("b").alias("_m"))
    back = graph.groupBy(F.col("b").alias("a")).agg(F.max("k").alias("k"))
    labels = cut(own.join(back, "a").select("a", "k", F.least("a", "_m").alias("component")))
    while True:
        near = graph.join(_sent(labels), ["a", "p"]).groupBy(F.col("b").alias("a")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "a", "left").select("a", "k", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        jump = labels.select(F.col("a").alias("_v"), F.col("component").alias("_jump"))
        lower = lower.join(jump, lower["component"] == jump["_v"], "left").select("a", "k", "_old", F.least("component", "_jump").alias("component"))
        lower = cut(lower)
        ended = lower.where("_old <> component").isEmpty()
        discard(labels)
        labels = lower.select("a", "k", "component")
        if ended:
            return labels.select(F.col("a").alias("vertex"), "component")
        labels = lower.drop("_old")
