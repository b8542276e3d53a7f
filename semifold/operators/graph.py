"""Graphs as edge tables (src, dst): degrees, reachability, components, spanning forests, order and moral graphs.

Iterative operators write each round to the cluster's checkpoint folder, so plans do not grow with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semifold.operators.lineage import dropped
from semifold.operators.lineage import kept as _kept


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


def reachable(edges: DataFrame, roots: DataFrame, radius: int | None = None) -> DataFrame:
    """id and depth of what the roots (id) reach along edges, roots included; depth is the least number of steps."""
    seen = _kept(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    front, step = seen, 0
    while radius is None or step < radius:
        step += 1
        found = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = _kept(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = _kept(seen.unionByName(front))
    return seen


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return reachable(edges, roots).where(F.col("depth") > 0)


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable): neighbours' least label, then the label's own label, until stable.

    Sides grow with the graph, so none is broadcast, however small its file: the driver would hold it in every round."""
    both = _kept(undirected(edges).distinct())
    labels = _kept(both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.hint("merge"), both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("least"))
        stepped = labels.join(near.hint("merge"), labels["id"] == near["src"]).select("id", F.least("component", "least").alias("component"))
        jump = stepped.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = _kept(stepped.join(jump.hint("merge"), "component").select("id", F.col("further").alias("component")))
        if after.join(labels.withColumnRenamed("component", "was").hint("merge"), "id").where(F.col("component") != F.col("was")).isEmpty():
            return after
        labels = after


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of (src, dst, weight) by rounds in which every component takes its lightest edge."""
    e = _kept(edges.select("src", "dst", "weight"))
    chosen = None
    current = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "weight").where(F.col("src") != F.col("dst"))
    while True:
        both = current.select("a", "b", "src", "dst", "weight").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b"), "src", "dst", "weight"))
        best = _kept(both.groupBy("a").agg(F.min(F.struct("weight", "src", "dst", "b")).alias("e")).select("a", "e.*"))
        if best.isEmpty():
            return chosen if chosen is not None else e.limit(0)
        picked = best.select("src", "dst", "weight").distinct()
        chosen = _kept(picked if chosen is None else chosen.unionByName(picked).distinct())
        label = components(best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        la, lb = label.select(F.col("id").alias("a"), F.col("component").alias("ca")), label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        current = _kept(current.join(la, "a").join(lb, "b").where(F.col("ca") != F.col("cb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "src", "dst", "weight"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """id and level (longest path from a source) of an acyclic graph; an error if a cycle is left."""
    e = _kept(edges.select("src", "dst").distinct())
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    done, level = None, 0
    left, rest = _kept(ids), e
    while not left.isEmpty():
        ready = _kept(left.join(rest.hint("merge"), left["id"] == rest["dst"], "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        now = ready.withColumn("level", F.lit(level))
        done = now if done is None else done.unionByName(now)
        left = _kept(left.join(ready.hint("merge"), "id", "left_anti"))
        rest = _kept(rest.join(ready.hint("merge"), rest["src"] == ready["id"], "left_anti"))
        level += 1
    return done if done is not None else ids.withColumn("level", F.lit(0))


def moral_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges (src < dst): parent and child, and every two parents of one child."""
    a, b = edges.select(F.col("src").alias("a"), "dst"), edges.select(F.col("src").alias("b"), "dst")
    married = a.join(b, "dst").where(F.col("a") < F.col("b")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    plain = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return plain.unionByName(married).distinct()


def grid_graph(spark, height: int, width: int) -> DataFrame:
    """Edges of a grid whose vertices are numbered row by row."""
    v = spark.range(height * width).select(F.col("id").alias("src"))
    right = v.where(F.col("src") % width < width - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = v.where(F.col("src") < (height - 1) * width).select("src", (F.col("src") + width).alias("dst"))
    return right.unionByName(down)


def set_supersets(sets: DataFrame, query: DataFrame) -> DataFrame:
    """set_id of the sets (set_id, element) that hold every element of query (element): an inverted-index count."""
    n = query.select("element").distinct().agg(F.count("*").alias("_n"))
    hits = sets.join(query.select("element").distinct(), "element", "left_semi").distinct().groupBy("set_id").agg(F.count("*").alias("_hits"))
    return hits.join(n, hits["_hits"] == n["_n"]).select("set_id")


def set_intersecting(sets: DataFrame, query: DataFrame) -> DataFrame:
    """set_id and overlap of the sets that share elements with query."""
    return sets.distinct().join(query.select("element").distinct(), "element", "left_semi").groupBy("set_id").agg(F.count("*").alias("overlap"))


def subsets(df: DataFrame, items: str, least: int, most: int) -> DataFrame:
    """Every subset of the array column items (at most 16 entries) with least to most elements, as a sorted array."""
    n = F.size(items)
    masks = F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), n) - 1).cast("int")))
    picked = df.withColumn("_mask", masks).where(F.bit_count("_mask").between(least, most))
    return picked.withColumn("subset", F.array_sort(F.filter(items, lambda x, i: F.expr("_mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))).drop("_mask")


def running_intersection(cliques: DataFrame) -> DataFrame:
    """Pairs of cliques (clique_id, element) with the size of their separator: the weights of a junction tree."""
    a, b = cliques.select(F.col("clique_id").alias("src"), "element"), cliques.select(F.col("clique_id").alias("dst"), "element")
    return a.join(b, "element").where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def peer_rank(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def is_connected(edges: DataFrame) -> DataFrame:
    """One row: whether all vertices of the undirected graph are in one component (a graph without edges is)."""
    return components(edges).agg((F.countDistinct("component") <= 1).alias("value"))


def is_tree(edges: DataFrame) -> DataFrame:
    """One row: whether the undirected graph is connected and has one edge less than vertices."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().agg(F.count("*").alias("_e"))
    c = components(edges).agg(F.countDistinct("component").alias("_c"), F.count("*").alias("_v"))
    return c.crossJoin(e).select(((F.col("_c") <= 1) & ((F.col("_e") == F.col("_v") - 1) | (F.col("_v") == 0))).alias("value"))


def acyclic_part(edges: DataFrame) -> DataFrame:
    """The edges left when vertices without incoming edges are taken away until there is none: empty if there is no
    directed cycle."""
    left = _kept(edges.select("src", "dst").distinct())
    while True:
        more = left.join(left.select(F.col("dst").alias("_d")).distinct().hint("merge"), F.col("src") == F.col("_d"), "left_semi")
        after = _kept(more)
        if after.count() == left.count():
            return after
        left = after


def is_cyclic(edges: DataFrame) -> bool:
    return not acyclic_part(edges).isEmpty()


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges whose ends are both among vertices (id)."""
    v = vertices.select("id").distinct()
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id and neighbour, over the undirected edges of the given vertices."""
    return undirected(edges).join(vertices.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()


def tree_order(edges: DataFrame, root: DataFrame) -> DataFrame:
    """id, parent and depth of a tree seen from its root (id): parents come before children in order of depth (pre-order by
    levels), children before parents in reverse."""
    depth = reachable(undirected(edges), root)
    up = undirected(edges).join(depth.withColumnsRenamed({"id": "src", "depth": "_p"}), "src").join(depth.withColumnsRenamed({"id": "dst", "depth": "_c"}), "dst").where(F.col("_c") == F.col("_p") + 1)
    parent = up.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return depth.join(parent, "id", "left").select("id", "parent", "depth")


def separated(edges: DataFrame, a: DataFrame, b: DataFrame, given: DataFrame) -> DataFrame:
    """d-separation in a directed graph, as tables of id: one row, whether given cuts a from b in the moral graph of the
    ancestors of all three."""
    asked = a.select("id").union(b.select("id")).union(given.select("id")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = _kept(reachable(back, asked).select("id"))
    moral = moral_graph(induced(edges, own))
    open_ = own.join(given.select("id"), "id", "left_anti")
    met = reachable(undirected(induced(moral, open_)), a.join(given.select("id"), "id", "left_anti"))
    return met.join(b.select("id"), "id", "left_semi").agg((F.count("*") == 0).alias("value"))


def set_cover_least(sets: DataFrame, query: DataFrame) -> DataFrame:
    """set_id of the smallest set that holds every element of query (the least id on ties)."""
    own = set_supersets(sets, query)
    sizes = sets.distinct().join(own, "set_id", "left_semi").groupBy("set_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.min(F.struct("n", "set_id")).alias("s")).select("s.set_id", "s.n")


def set_meets_most(sets: DataFrame, query: DataFrame) -> DataFrame:
    """set_id and overlap of the set that shares most with query (the least id on ties)."""
    return set_intersecting(sets, query).agg(F.min(F.struct((-F.col("overlap")).alias("o"), "set_id")).alias("s")).select("s.set_id", (-F.col("s.o")).alias("overlap"))


def counting_numbers(regions: DataFrame) -> DataFrame:
    """Bethe counting numbers for factor scopes (region, variable): 1 for each factor, 1 - degree for each variable."""
    big = regions.select(F.col("region").cast("string").alias("region")).distinct().withColumn("number", F.lit(1).cast("long"))
    small = regions.distinct().groupBy(F.col("variable").cast("string").alias("region")).agg((1 - F.count("*")).alias("number"))
    return big.withColumn("kind", F.lit("factor")).unionByName(small.withColumn("kind", F.lit("variable")))


def balanced_parts(edges: DataFrame, k: int) -> DataFrame:
    """id and part: vertices in breadth-first order from the least vertex of each component, cut into k runs of one size, so
    neighbours tend to share a part."""
    from semifold.operators.dataset import with_row_index

    roots = components(edges).select(F.col("component").alias("id")).distinct()
    order = reachable(undirected(edges), roots)
    indexed = _kept(with_row_index(order, "depth", "id"))
    n = indexed.agg(F.count("*").alias("_n"))
    return indexed.crossJoin(n).select("id", F.floor(F.col("row_idx") * k / F.col("_n")).cast("int").alias("part"))


def refined_parts(edges: DataFrame, parts: DataFrame, rounds: int = 20) -> DataFrame:
    """parts (id, part) with a smaller cut and the same sizes: vertices change places in pairs.

    A vertex's gain towards a part is its edges into that part less those within its own. In a round the vertices of part p
    that gain most in q are set beside those of q that gain most in p, by rank, and pairs that gain together change places.
    All pairs of parts work at once, each vertex in one of them. Neighbours that move at once can spoil each other's gain, so
    only vertices of a larger hash, drawn anew in each round, than their moving neighbours go; a round that does not lower the
    cut is undone, and three of them end the search. Only exchanges between two parts are tried, no turns of three.
    """
    from semifold.operators.dataset import uniform

    both = _kept(undirected(edges.where("src <> dst")))

    def seen(parts: DataFrame) -> DataFrame:
        """One row a vertex: its part, the other part it would gain most in (to) and that gain, and its edges to other parts."""
        beside = both.join(parts.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").groupBy("src", "to").agg(F.count("*").alias("n"))
        beside = beside.join(parts.select(F.col("id").alias("src"), F.col("part").alias("own")), "src")
        most, inner, outer = F.struct("n", "to"), F.when(F.col("to") == F.col("own"), F.col("n")).otherwise(0), F.when(F.col("to") != F.col("own"), F.col("n")).otherwise(0)
        best = beside.groupBy("src", "own").agg(F.max(F.when(F.col("to") != F.col("own"), most)).alias("b"), F.sum(inner).alias("inner"), F.sum(outer).alias("outer"))
        return _kept(best.select(F.col("src").alias("id"), "own", (F.col("b.n") - F.col("inner")).alias("gain"), "b.to", "outer"))

    cut_of = lambda around: (around.agg(F.sum("outer")).first()[0] or 0) // 2  # noqa: E731  both ends count an edge
    now = _kept(parts.select("id", "part"))
    around = seen(now)
    cut, failed = cut_of(around), 0
    for step in range(rounds):
        best = _kept(around.where("gain > 0").select("id", "own", "gain", "to").withColumn("rank", uniform("id", seed=step)))
        near = both.join(best.select(F.col("id").alias("dst"), F.col("rank").alias("theirs")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("theirs").alias("most"))
        free = best.join(near, "id", "left").where(F.col("most").isNull() | (F.col("rank") > F.col("most")))
        low, high = F.least("own", "to"), F.greatest("own", "to")
        placed = free.withColumn("place", F.row_number().over(Window.partitionBy("own", "to").orderBy(F.desc("gain"), "id"))).withColumns({"low": low, "high": high})
        placed = _kept(placed.select("id", "to", "low", "high", "place"))
        pair = placed.groupBy("low", "high", "place").agg(F.count("*").alias("n")).where("n = 2")
        moves = placed.join(pair.select("low", "high", "place"), ["low", "high", "place"]).select("id", F.col("to").alias("_to"))
        after = _kept(now.join(moves, "id", "left").select("id", F.coalesce("_to", "part").alias("part")))
        then = seen(after)
        less = cut_of(then)
        dropped(best, placed)
        if less >= cut:
            dropped(after, then)
            failed += 1
            if failed == 3:
                break
            continue
        dropped(now, around)
        now, around, cut, failed = after, then, less, 0
    return now


def cut_size(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: the number of edges between parts."""
    ends = edges.join(parts.select(F.col("id").alias("src"), F.col("part").alias("_a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("_b")), "dst")
    return ends.agg(F.sum((F.col("_a") != F.col("_b")).cast("long")).alias("value"))
