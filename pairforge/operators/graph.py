"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.shared import release, stash


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every edge in both directions, as (src, dst)."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: (id, component), where component is its least node.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones, are linked to
    the least node it knows. Each keeps the components and flattens the trees, so few rounds are needed. Least nodes
    come from aggregates that combine on the map side and are joined back, so a node with very many edges does not
    need one task. Null ends are dropped; an edge from a node to itself makes the node its own component.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    loops = ends.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    links = stash(ends.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    if links.isEmpty():
        return loops.distinct()
    for _ in range(max_rounds):
        both = symmetric(links, "u", "v")
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
        large = both.filter("dst > src").join(least, "src").filter("dst > m").select(F.col("dst").alias("v"), F.col("m").alias("u"))
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = stash(small.union(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        release(links)
        links = new
        # done when the links are stars: one parent for each node, and parents without one
        now = links.agg(F.count("*").alias("n"), F.count_distinct("v").alias("nodes")).first()
        if now["n"] == now["nodes"] and links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return links.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots).unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))


def top_neighbours(edges: DataFrame, k: int, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """For each node its k best neighbours: (src, dst, score, rank), ties to the lesser node."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(score).alias("score"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def reciprocal(edges: DataFrame, k: int, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """The edges whose ends are among each other's k best neighbours."""
    top = top_neighbours(edges, k, a, b, score)
    forth = top.select(F.col("src").alias(a), F.col("dst").alias(b))
    back = top.select(F.col("dst").alias(a), F.col("src").alias(b))
    return edges.join(forth, [a, b], "left_semi").join(back, [a, b], "left_semi")


def shared_neighbours(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges`` with ``shared``, the number of nodes that both ends are linked with.

    Each edge asks the lists of both its ends: an equi-join on one end, then on (other end, neighbour).
    """
    both = symmetric(edges, a, b).distinct()
    asked = edges.select(a, b).join(both.select(F.col("src").alias(a), F.col("dst").alias("_mid")), a)
    hits = asked.join(both.select(F.col("src").alias(b), F.col("dst").alias("_mid")), [b, "_mid"]).groupBy(a, b).agg(F.count("*").alias("shared"))
    return edges.join(hits, [a, b], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))


def prune_by_neighbours(edges: DataFrame, least: int = 1, *, rounds: int = 0, keep_score: float | None = None, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """Drops edges with fewer than ``least`` shared neighbours, all at once in each round, until none drops.

    ``rounds`` bounds the rounds, 0 means until nothing changes. Edges of at least ``keep_score`` always stay.
    """
    here, n, done = stash(edges, "edges"), None, 0
    while True:
        counted = shared_neighbours(here, a, b)
        stays = F.col("shared") >= least
        if keep_score is not None:
            stays |= F.col(score) >= keep_score
        after = stash(counted.filter(stays).select(*edges.columns), "edges")
        done += 1
        was, n = (here.count() if n is None else n), after.count()
        release(here)
        here = after
        if n == was or done == rounds:
            return here


def triangle_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The edges that are part of a triangle."""
    return shared_neighbours(edges, a, b).filter("shared > 0").drop("shared")


def filter_cascade(edges: DataFrame, *, threshold: float, reliability: float = 0.3, direct: str | None = None, k: int = 5, least_shared: int = 1, rounds: int = 0, triangles: bool = False) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The graph's filters in order, with the number of edges after each: score, reliability, reciprocity, neighbours.

    ``edges`` has a, b, score, reliability and, if named, the boolean ``direct``: such edges pass the reliability test.
    """
    counts = [("all", edges.count())]
    here = stash(edges.filter(F.col("score") >= threshold), "edges")
    counts.append(("threshold", here.count()))
    good = F.col("reliability") >= reliability
    here = stash(here.filter(good | F.col(direct) if direct else good), "edges")
    counts.append(("reliability", here.count()))
    if k:
        here = stash(reciprocal(here, k), "edges")
        counts.append(("reciprocal", here.count()))
    if least_shared:
        here = prune_by_neighbours(here, least_shared, rounds=rounds)
        counts.append(("shared_neighbours", here.count()))
    if triangles:
        here = stash(triangle_edges(here), "edges")
        counts.append(("triangles", here.count()))
    return here, counts


def cluster_stats(edges: DataFrame, members: DataFrame, least_size: int = 2) -> DataFrame:
    """One row for each component of (id, component): size, edges, density, scores, share of leaves, tree or not, set id."""
    degrees = symmetric(edges).groupBy("src").agg(F.count("*").alias("degree"))
    nodes = members.join(degrees, F.col("id") == F.col("src"), "left").groupBy("component").agg(
        F.count("*").alias("size"), F.avg((F.coalesce("degree", F.lit(0)) <= 1).cast("int")).alias("leaf_share"), F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("_ids")
    )
    inside = edges.join(members.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(
        F.count("*").alias("edges"), F.min("score").alias("min_score"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")
    )
    out = nodes.filter(F.col("size") >= least_size).join(inside, "component")
    return out.select(
        "component", "size", "edges", F.round(F.col("edges") * 2 / (F.col("size") * (F.col("size") - 1)), 6).alias("density"), F.round("min_score", 6).alias("min_score"),
        F.round("mean_score", 5).alias("mean_score"), F.round("max_score", 6).alias("max_score"), F.round("leaf_share", 6).alias("leaf_share"), (F.col("edges") == F.col("size") - 1).alias("is_tree"), set_id(F.col("_ids")).alias("set_id"),
    )


def set_id(members: Column) -> Column:
    """A short name for a set of strings: the first digits of the SHA-256 of its sorted members."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n"), 256), 1, 12)


def member_ranks(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, id, degree, max_score, rank): members by degree, then best score, then id."""
    one = edges.select(F.col("a").alias("id"), "score").unionByName(edges.select(F.col("b").alias("id"), "score"))
    own = members.join(one.groupBy("id").agg(F.count("*").alias("degree"), F.max("score").alias("max_score")), "id")
    w = Window.partitionBy("component").orderBy(F.desc("degree"), F.desc("max_score"), "id")
    return own.withColumn("rank", F.row_number().over(w)).select("component", "id", "degree", "max_score", "rank")


def closure(facts: DataFrame, seeds: DataFrame, fact: str = "fact", key: str = "key", max_rounds: int = 50) -> DataFrame:
    """All keys that seeds reach: a fact with any active key makes all its keys active. Returns (key, round).

    ``facts`` is (fact, key), ``seeds`` is (key). Each round joins only the keys that became active in the last one.
    """
    links = stash(facts.select(F.col(fact).alias("fact"), F.col(key).alias("key")).distinct(), "facts")
    active = stash(seeds.select(F.col(key).alias("key")).distinct().withColumn("round", F.lit(0)), "active")
    fresh = active
    for turn in range(1, max_rounds + 1):
        hit = links.join(fresh.select("key"), "key", "left_semi").select("fact").distinct()
        found = links.join(hit, "fact", "left_semi").select("key").distinct().join(active, "key", "left_anti")
        fresh = stash(found.withColumn("round", F.lit(turn)), "active")
        if fresh.isEmpty():
            return active
        active = stash(active.unionByName(fresh), "active")
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def consistent_components(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(id, component) over positive edges, without components that hold both ends of a negative edge."""
    members = stash(connected_components(positive), "components")
    left = members.select(F.col("id").alias("a"), F.col("component").alias("c1"))
    right = members.select(F.col("id").alias("b"), F.col("component").alias("c2"))
    bad = negative.join(left, "a").join(right, "b").filter("c1 = c2").select(F.col("c1").alias("component")).distinct()
    return members.join(bad, "component", "left_anti").select("id", "component")


def closure_pairs(members: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Pairs inside a component that are not among ``known`` (a, b), the first ``most`` of each component in key order: (component, a, b, rank).

    For each member the number of its new pairs with greater ones follows from its place and its known pairs. Only members
    that the first ``most`` new pairs can begin with are taken, each with as many that follow it as could be needed; so a
    large component does not form all of its pairs.
    """
    from pairforge.operators.metrics import running
    from pairforge.operators.ranks import global_rank

    placed = global_rank(members.select("id", "component"), [F.col("component"), F.col("id")], "_at")
    sizes = placed.groupBy("component").agg(F.min("_at").alias("_from"), F.count("*").alias("size"))
    own = stash(placed.join(sizes, "component").select("component", "id", (F.col("_at") - F.col("_from")).alias("place"), "size"), "members")
    pairs = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left, right = own.select(F.col("id").alias("a"), "component"), own.select(F.col("id").alias("b"), F.col("component").alias("_c"))
    inside = stash(pairs.join(left, "a").join(right, "b").filter("component = _c").select("component", "a", "b"), "known")
    counts = inside.groupBy("component", F.col("a").alias("id")).agg(F.count("*").alias("known"))
    new = own.join(counts, ["component", "id"], "left").fillna(0, ["known"]).withColumn("new", F.col("size") - F.col("place") - 1 - F.col("known")).filter("new > 0")
    first = running(new, ["component"], "place", ["new"]).filter(F.col("before_new") < most)
    last = F.least(F.col("size") - 1, F.col("place") + most + F.col("known"))
    asked = first.select("component", F.col("id").alias("a"), F.explode(F.sequence(F.col("place") + 1, last)).alias("place"))
    found = asked.join(own.select("component", "place", F.col("id").alias("b")), ["component", "place"]).join(inside, ["component", "a", "b"], "left_anti")
    w = Window.partitionBy("component").orderBy("a", "b")
    return found.select("component", "a", "b").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
