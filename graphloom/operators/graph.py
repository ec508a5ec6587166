"""Graph measures and traversals over edges (src, dst) as DataFrame plans.

Undirected measures use the distinct symmetric adjacency without self-loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.blocks import Blocks, most_frequent, summed
from graphloom.operators.loops import Saved, components, ranked, reachable


def adjacency(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, degree, centrality = degree / (n - 1), rank (ties by node)."""
    found = degrees(edges)
    n = found.agg(F.count("*")).scalar()
    # ranks come from the degrees that occur, which are few, not from a sort of all nodes
    sizes = found.groupBy("degree").agg(F.count("*").alias("k"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("degree", (1 + F.coalesce(F.sum("k").over(above), F.lit(0))).alias("rank"))
    return found.join(ranks, "degree").select("node", "degree", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0)).alias("centrality"), "rank")


def directed_degree(nodes: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """Raw degree by direction; nodes without edges have 0."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    touched = edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(touched, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def connectivity_metrics(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    return d.withColumn("density", 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def type_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count("*").alias("n")))


def directed_density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*")).scalar()
    return edges.agg(F.count("*").alias("edges")).withColumn("nodes", n).withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def band(hops: Column) -> Column:
    return F.when(hops <= 1, "direct").when(hops <= 3, "near").when(hops <= 6, "mid-range").otherwise("distant")


def neighbors(edges: DataFrame, start: str, hops: int, *, types: list[str] | None = None, min_weight: float | None = None) -> DataFrame:
    """Directed expansion: node, hop, decay (the greatest product of weights on a shortest
    path), band. The first arrival of a node counts."""
    links = edges if types is None else edges.where(F.col("type").isin(types))
    links = links if min_weight is None else links.where(F.col("weight") >= min_weight)
    links = links.select("src", "dst", "weight")
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("decay"))
    frontier = seen
    for k in range(1, hops + 1):
        fresh = frontier.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("n")).agg(F.max(F.col("decay") * F.col("weight")).alias("decay"))
        fresh = fresh.join(seen.select(F.col("node").alias("n")), "n", "left_anti").select(F.col("n").alias("node"), F.lit(k).alias("hop"), "decay")
        seen, frontier = seen.union(fresh), fresh
    return seen.where("hop > 0").withColumn("band", band(F.col("hop")))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id of the node's component; isolated nodes have their own."""
    groups = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def structure(edges: DataFrame, n_components: int) -> DataFrame:
    m = connectivity_metrics(edges)
    return m.withColumn("structure", F.when(F.lit(n_components > 1), "disconnected").when(F.col("density") > 0.5, "dense").when(F.col("density") < 0.1, "sparse").otherwise("moderate"))


def pagerank(edges: DataFrame, *, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, score: fixed rounds from 1 / n over the undirected adjacency; weight that
    reaches no neighbour is lost (no dangling redistribution)."""
    graph = Blocks(edges, "pagerank")
    base = (1 - damping) / graph.n if graph.n else 0.0
    # every node has a neighbour, so every node is sent something
    score = graph.run(lambda own, start, far: base + damping * summed(far, start), 1.0 / graph.n if graph.n else 0.0, rounds, share=True)
    return score.withColumnRenamed("value", "score")


def eigenvector(edges: DataFrame, *, rounds: int = 20) -> DataFrame:
    """Power iteration on A + I (so that it settles on two-sided graphs), L2 norm."""
    score = Blocks(edges, "eigenvector").run(lambda own, start, far: own + summed(far, start), 1.0, rounds, norm=True)
    return score.withColumnRenamed("value", "score")


def _by_number(edges: DataFrame, saved: Saved) -> tuple[DataFrame, DataFrame, int]:
    """Links of the undirected graph by the numbers of their ends, the numbers (node, id), and how
    many nodes there are: rows for many pairs of nodes then have numbers and not names."""
    pairs = saved.save(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    nodes, n = numbered(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node")
    one = pairs.join(nodes.select(F.col("node").alias("src"), F.col("id").alias("x")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("y")), "dst")
    both = F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))
    return saved.save(one.select(F.inline(both))), nodes, n


def _levels(links: DataFrame, starts: DataFrame, saved: Saved, *, max_hops: int | None = None) -> list[tuple[DataFrame, int]]:
    """By hops, from 0: (s, node, paths), the nodes first reached from each start (node) after that
    many hops with the number of shortest paths to them, and the sum of their degrees.

    A step goes from the last level to its neighbours, or looks back from the pairs that are not
    reached yet, whichever meets fewer links: near the end few nodes are left, and most links of
    a large last level lead back. It ends when every pair is reached or nothing new is."""
    degree = saved.save(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    level = [saved.save(starts.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
    starts = level[0].select("s")
    n_starts = starts.count()
    size = lambda rows: rows.groupBy("node").count().join(degree, "node").agg(F.coalesce(F.sum(F.col("count") * F.col("degree")), F.lit(0))).first()[0]
    ahead = [size(level[0])]
    seen = level[0].select("s", "node")
    while max_hops is None or len(level) <= max_hops:
        known = seen.groupBy("node").agg(F.count("*").alias("k"))
        left = saved.save(degree.join(known, "node", "left").select("node", "degree", F.coalesce("k", F.lit(0)).alias("k")).where(F.col("k") < n_starts))
        n_left, behind = left.agg(F.count("*"), F.coalesce(F.sum(F.col("degree") * (n_starts - F.col("k"))), F.lit(0))).first()
        if not n_left:
            break
        last = level[-1]
        if behind + n_left * n_starts < ahead[-1]:
            some = seen.join(left.select("node"), "node", "left_semi")
            want = saved.save(left.select("node").crossJoin(starts).join(some, ["s", "node"], "left_anti"))
            back = want.join(links, F.col("node") == F.col("src")).select("s", "node", F.col("dst").alias("near"))
            step = back.join(last.select("s", F.col("node").alias("near"), "paths"), ["s", "near"]).groupBy("s", "node").agg(F.sum("paths").alias("paths"))
        else:
            step = last.join(links, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            # a neighbour of a level is in the level before, in the same, or new
            near = last.select("s", "node") if len(level) < 2 else last.select("s", "node").union(level[-2].select("s", "node"))
            step = step.join(near, ["s", "node"], "left_anti")
        fresh = saved.save(step.select("s", "node", "paths"))
        if fresh.isEmpty():
            break
        level.append(fresh)
        ahead.append(size(fresh))
        seen = seen.union(fresh.select("s", "node"))
    return list(zip(level, ahead, strict=True))


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the given source nodes (id): r / sum(distances) * r / (n - 1), r reachable nodes."""
    saved = Saved(edges.sparkSession, "closeness")
    links, names, n = _by_number(edges, saved)
    level = _levels(links, names.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("id").alias("node")), saved)
    far = level[0][0].select("s", F.lit(0).alias("hops")).limit(0)
    for hops, (rows, _) in enumerate(level[1:], 1):
        far = far.union(rows.select("s", F.lit(hops)))
    got = far.groupBy("s").agg(F.count("*").alias("r"), F.sum("hops").alias("total")).join(names.select(F.col("id").alias("s"), F.col("node")), "s").select(F.col("node").alias("s"), "r", "total")
    return nodes.select("id").join(got, F.col("id") == F.col("s"), "left").select("id", F.coalesce((F.col("r") / F.col("total")) * (F.col("r") / (n - 1)), F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, *, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """node, betweenness (undirected, divided by (n-1)(n-2)/2): Brandes' sums from all sources
    at once, level by level, in both directions, until nothing new is reached. Each step goes
    over the links of the smaller of its two levels.

    All nodes as sources need rows for all pairs. With `sources` (id) only shortest paths from
    these count, divided by s(n-1) for s sources; from a random sample of s nodes this is an
    estimate of the exact value whose error is below e with probability 1 - d where
    s >= ln(2n / d) / (2 e^2)."""
    spark = edges.sparkSession
    saved = Saved(spark, "betweenness")
    links, names, n = _by_number(edges, saved)
    nodes = names.select(F.col("id").alias("node"))
    starts = nodes if sources is None else names.join(sources.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("id").alias("node"))
    level = _levels(links, starts, saved, max_hops=max_hops)
    n_starts = level[0][0].count()
    total = None
    below, width = None, 0  # s, node, paths, share of the level below, and the sum of its degrees
    for here, mine in reversed(level[1:]):
        if below is None:
            now = here.withColumn("share", F.lit(0.0))
        else:
            part = below.select("s", F.col("node").alias("low"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
            if width <= mine:
                given = part.join(links, F.col("low") == F.col("src")).select("s", F.col("dst").alias("node"), "part")
                got = given.groupBy("s", "node").agg(F.sum("part").alias("part"))
            else:
                asked = here.join(links, F.col("node") == F.col("src")).select("s", "node", F.col("dst").alias("low"))
                got = asked.join(part, ["s", "low"]).groupBy("s", "node").agg(F.sum("part").alias("part"))
            now = here.join(got, ["s", "node"], "left").withColumn("share", F.coalesce(F.col("part") * F.col("paths"), F.lit(0.0)))
        now = saved.save(now.select("s", "node", "paths", "share"))
        total = now.select("node", "share") if total is None else total.union(now.select("node", "share"))
        below, width = now, mine
    if sources is None:
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0  # ordered pairs: each path is met twice
    else:
        scale = 1.0 / (n_starts * (n - 1)) if n > 1 and n_starts else 0.0
    summed = nodes.withColumn("share", F.lit(0.0)) if total is None else nodes.withColumn("share", F.lit(0.0)).union(total)
    scored = summed.groupBy("node").agg((F.sum("share") * scale).alias("betweenness")).withColumnRenamed("node", "id")
    return scored.join(names, "id").select("node", "betweenness")


def label_propagation(edges: DataFrame, *, rounds: int = 5) -> DataFrame:
    """node, community: synchronous; the most frequent label of the neighbours, the smallest
    of equals."""
    # numbers are in the order of the nodes
    graph = Blocks(edges, "labels")
    label = graph.run(lambda own, start, far: most_frequent(far, start), None, rounds, kind=np.int64)
    names = graph.nodes.select(F.col("id").alias("value"), F.col("node").alias("community"))
    return label.join(names, "value").select("node", "community")


def community_metrics(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Sizes, and edges inside and between communities (each undirected edge twice)."""
    links = adjacency(edges)
    a, b = community.select(F.col("node").alias("src"), F.col("community").alias("ca")), community.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    both = links.join(a, "src").join(b, "dst").agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("intra"), F.sum((F.col("ca") != F.col("cb")).cast("long")).alias("inter"))
    sizes = community.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.avg("n").alias("avg_size"))
    return sizes.withColumn("intra", both.select("intra").scalar()).withColumn("inter", both.select("inter").scalar()).withColumn("edge_ratio", F.col("intra") / (F.col("inter") + 1))


def triangle_rows(edges: DataFrame) -> DataFrame:
    """x, y, z: the nodes of each triangle, once, in no order. Edges point from smaller to larger
    degrees (ties by name), so no node points to more than the root of twice the number of
    edges. An edge's two ends are compared by the shorter of their two lists: its entries
    are looked up with the other end."""
    saved = Saved(edges.sparkSession, "triangles")
    links = saved.save(adjacency(edges))
    d = links.groupBy("src").agg(F.count("*").alias("d"))
    ranked_ = links.where("src < dst").join(d.select("src", F.col("d").alias("x")), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("y")), "dst")
    up = F.col("x") <= F.col("y")
    ab = saved.save(ranked_.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    out = saved.save(ab.groupBy("a").agg(F.count("*").alias("n")))
    # an end that points nowhere is in the middle of no triangle
    sized = ab.join(out.where("n > 1").withColumnRenamed("n", "na"), "a").join(out.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    near = F.col("nb") <= F.col("na")
    tried = sized.select(F.when(near, F.col("b")).otherwise(F.col("a")).alias("y"), F.when(near, F.col("a")).otherwise(F.col("b")).alias("x"))
    tried = tried.join(ab.select(F.col("a").alias("y"), F.col("b").alias("z")), "y").where("x <> z")
    return tried.join(ab.select(F.col("a").alias("x"), F.col("b").alias("z")), ["x", "z"], "left_semi").select("x", "y", "z")


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: in how many triangles a node is."""
    return triangle_rows(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


HUB = 1000  # members of a list that a row carries
PAIR_BLOCK = 128  # first members of pairs that one task counts, about


def shared_pairs(cells: DataFrame, n_members: int, **sums: Column) -> DataFrame:
    """(u, v, shared, *sums), u < v: members (long, near 0 to n_members) that share a `via`, with
    the number of what they share and sums over it. cells: via, member (distinct), and columns
    of via that `sums` are made from.

    Pairs are not shuffled: lists of members are, each to the blocks of members that it has
    part in, and a block's task counts all pairs that start there. A via with many members
    has several lists of HUB members, about, that meet each other."""
    size = cells.groupBy("via").agg(F.count("*").alias("size"))
    cells = cells.select("via", "member", *[c.alias(k) for k, c in sums.items()]).join(size, "via")
    parts = F.ceil(F.col("size") / HUB).cast("int")
    part = F.pmod(F.hash("member"), parts)
    lists = cells.groupBy("via", part.alias("part")).agg(F.sort_array(F.collect_list("member")).alias("vs"))
    block = F.floor(F.col("member") / PAIR_BLOCK).cast("int")
    firsts = cells.groupBy("via", block.alias("block")).agg(F.sort_array(F.collect_list("member")).alias("us"), F.first("size").alias("size"), *[F.first(k).alias(k) for k in sums])
    firsts = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = firsts.join(lists, ["via", "part"]).where(F.element_at("vs", -1) > F.element_at("us", 1))
    later = F.filter("vs", lambda x: x > F.element_at("us", 1))
    tasks = max(1, min(2000, -(-n_members // PAIR_BLOCK)))
    dealt = met.select("block", "us", later.alias("vs"), *sums).repartition(tasks, "block")
    pairs = dealt.select("block", F.explode("us").alias("u"), "vs", *sums).select("block", "u", F.explode("vs").alias("v"), *sums).where("u < v")
    return pairs.groupBy("block", "u", "v").agg(F.count("*").alias("shared"), *[F.sum(k).alias(k) for k in sums]).drop("block")


def numbered(nodes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """nodes (distinct by `column`) with `id`, numbers from 0 in the order of `column`, and
    how many there are."""
    saved = Saved(nodes.sparkSession, "numbered")
    nodes = saved.save(nodes)
    n = nodes.count()
    out = ranked(nodes.withColumn("_all", F.lit(0)), "_all", column, name="id", n=n).drop("_all")
    return saved.save(out.withColumn("id", F.col("id").cast("long") - 1)), n


def link_scores(edges: DataFrame, *, exclude_existing: bool = True, among: Column | None = None) -> DataFrame:
    """u < v with a common neighbour: common_neighbors, jaccard, adamic_adar (1 / (d ln d)
    for each common neighbour of degree d > 1), resource_allocation, preferential_attachment.

    Pairs come from shared neighbours only. `among` (over a column `src`) tells the nodes that
    links are predicted between, all if not given."""
    saved = Saved(edges.sparkSession, "scores")
    links = saved.save(adjacency(edges))
    d = saved.save(links.groupBy("src").agg(F.count("*").alias("d")))
    nodes, n = numbered(d if among is None else d.where(among), "src")
    cells = links.join(nodes.select("src", F.col("id").alias("member")), "src").join(d.select(F.col("src").alias("dst"), "d"), "dst")
    cells = saved.save(cells.select(F.col("dst").alias("via"), "member", "d"))
    pairs = shared_pairs(cells, n, adamic_adar=F.when(F.col("d") > 1, 1 / (F.col("d") * F.log("d"))).otherwise(0.0), resource_allocation=1 / F.col("d"))
    if exclude_existing:
        ids = nodes.select("src", "id")
        there = links.where("src < dst").join(ids.withColumnRenamed("id", "u"), "src").join(ids.select(F.col("src").alias("dst"), F.col("id").alias("v")), "dst").select("u", "v")
        if not (there := saved.save(there)).isEmpty():
            pairs = pairs.join(there, ["u", "v"], "left_anti")
    pairs = pairs.join(nodes.select(F.col("id").alias("u"), F.col("src").alias("name_u"), F.col("d").alias("du")), "u").join(nodes.select(F.col("id").alias("v"), F.col("src").alias("name_v"), F.col("d").alias("dv")), "v")
    k = F.col("shared")
    return pairs.select(F.col("name_u").alias("u"), F.col("name_v").alias("v"), k.alias("common_neighbors"), (k / (F.col("du") + F.col("dv") - k)).alias("jaccard"), "adamic_adar", "resource_allocation", (F.col("du") * F.col("dv")).alias("preferential_attachment"))


def shortest_weighted(edges: DataFrame, start: str, *, rounds: int | None = None) -> DataFrame:
    """node, distance: least sum of weights (none below 0) from start along directed edges. A
    round relaxes only nodes that improved; rounds end when none has, or after `rounds`."""
    saved = Saved(edges.sparkSession, "weighted")
    links = saved.save(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = saved.save(edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0.0).alias("distance")))
    front, k = best, 0
    while rounds is None or k < rounds:
        k += 1
        offered = front.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        front = saved.save(offered.join(best, "node", "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).select("node", F.col("offer").alias("distance")))
        if front.isEmpty():
            break
        best = saved.save(best.join(front.select("node"), "node", "left_anti").union(front))
    return best


def paths(edges: DataFrame, start: str, goal: str, *, max_hops: int, k: int | None = None) -> DataFrame:
    """Simple directed paths of max_hops edges at most: path, hops, cost; the k cheapest."""
    now = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(0.0).alias("cost"))
    found = None
    links = edges.select("src", "dst", "weight")
    for _ in range(max_hops):
        now = now.join(links, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost"))
        hit = now.where(F.element_at("path", -1) == goal)
        found = hit if found is None else found.union(hit)
        now = now.where(F.element_at("path", -1) != goal)
    out = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), "cost")
    return out if k is None else out.orderBy("cost", "path").limit(k)


def bridges(edges: DataFrame) -> DataFrame:
    """Edges (a < b) whose removal separates their ends: those on no cycle. An edge outside a
    breadth-first forest closes one cycle, whose forest edges are marked by walking both of
    its ends up to where they meet, all such edges a level at a time; what stays unmarked
    is a bridge."""
    spark = edges.sparkSession
    saved = Saved(spark, "bridges")
    links = saved.save(adjacency(edges))
    roots = components(links.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("component").alias("start")).distinct()
    depth = saved.save(reachable(links, roots).select("node", "hops"))
    up = links.join(depth.select(F.col("node").alias("src"), F.col("hops").alias("hs")), "src").join(depth.select(F.col("node").alias("dst"), F.col("hops").alias("hd")), "dst")
    parent = saved.save(up.where("hd = hs - 1").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent")).join(depth, "node"))
    tree = parent.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    pairs = links.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    walk = saved.save(pairs.join(tree, ["a", "b"], "left_anti").distinct())
    marked = None
    while not walk.isEmpty():
        x = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"), F.col("hops").alias("ha"))
        y = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"), F.col("hops").alias("hb"))
        at = walk.join(x, "a", "left").join(y, "b", "left").withColumns({"ha": F.coalesce("ha", F.lit(0)), "hb": F.coalesce("hb", F.lit(0))})
        # the deeper end climbs; both do if they are level
        a_up, b_up = F.col("ha") >= F.col("hb"), F.col("hb") >= F.col("ha")
        crossed = at.select(F.explode(F.array(F.when(a_up, F.struct(F.col("a").alias("n"), F.col("pa").alias("p"))), F.when(b_up, F.struct(F.col("b").alias("n"), F.col("pb").alias("p"))))).alias("e")).where("e is not null").select(F.least("e.n", "e.p").alias("a"), F.greatest("e.n", "e.p").alias("b"))
        crossed = saved.save(crossed.distinct())
        marked = crossed if marked is None else marked.union(crossed)
        walk = saved.save(at.select(F.when(a_up, F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(b_up, F.col("pb")).otherwise(F.col("b")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return tree if marked is None else tree.join(marked.distinct(), ["a", "b"], "left_anti")


def cycles(edges: DataFrame, *, max_length: int) -> DataFrame:
    """Directed simple cycles of max_length edges at most, each from its smallest node."""
    links = edges.select("src", "dst").distinct()
    now = links.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = None
    for _ in range(max_length - 1):
        grown = now.join(links, F.element_at("path", -1) == F.col("src")).where(F.col("dst") >= F.element_at("path", 1))
        closed = grown.where(F.col("dst") == F.element_at("path", 1)).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))
        found = closed if found is None else found.union(closed)
        now = grown.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found


def linked_graphs(graphs: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """Edges (src, dst) over several graphs' edges: nodes are named graph:node. links:
    source_graph, source, target_graph, target."""
    def name(graph: Column, node: Column) -> Column:
        return F.concat(graph, F.lit(":"), node)

    out = links.select(name(F.col("source_graph"), F.col("source")).alias("src"), name(F.col("target_graph"), F.col("target")).alias("dst"))
    for graph, edges in graphs.items():
        out = out.union(edges.select(name(F.lit(graph), F.col("src")), name(F.lit(graph), F.col("dst"))))
    return out


def distances(edges: DataFrame, nodes: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """a, b, hops, band, proximity (1 / hops): directed distances between given nodes (id)."""
    walk = reachable(edges, nodes.select(F.col("id").alias("start")), max_hops=max_hops)
    met = walk.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").where("hops > 0")
    return met.select(F.col("start").alias("a"), F.col("node").alias("b"), "hops", band(F.col("hops")).alias("band"), (1 / F.col("hops")).alias("proximity"))


def path_rows(edges: DataFrame, start: str) -> DataFrame:
    """node, distance, path: of every node that start leads to, the least sum of weights and the
    path that has it, the smallest of equals. Weights are above 0."""
    saved = Saved(edges.sparkSession, "paths")
    best = saved.save(shortest_weighted(edges, start))
    tight = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    up = best.select(F.col("node").alias("src"), F.col("distance").alias("ds")).join(tight, "src").join(best.select(F.col("node").alias("dst"), "distance"), "dst")
    up = saved.save(up.where(F.abs(F.col("ds") + F.col("weight") - F.col("distance")) <= 1e-9 * (1 + F.abs("distance"))).select("src", "dst"))
    routes = Saved(edges.sparkSession, "routes")
    grown, n = routes.save(best.where(F.col("node") == start).select("node", F.col("node").alias("path"))), 1
    while n:
        # a node's path is final once all of its tight predecessors have theirs
        have = routes.all()
        waiting = up.join(have.select(F.col("node").alias("dst")), "dst", "left_anti")
        known = waiting.join(have.select(F.col("node").alias("src"), "path"), "src", "left")
        ready = known.groupBy("dst").agg(F.count_if(F.col("path").isNull()).alias("open"), F.min(F.concat("path", F.lit(">"), "dst")).alias("path")).where("open = 0")
        grown, (n, _) = routes.signed(ready.select(F.col("dst").alias("node"), "path"), "node")
    return best.join(routes.all(), "node").select("node", "distance", "path")


def modularity(edges: DataFrame, community: DataFrame) -> DataFrame:
    """One row: modularity of communities (node, community) over the undirected adjacency."""
    links = adjacency(edges)
    d = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")).join(community, "node")
    twice = links.count()
    inside = links.join(community.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(community.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inside"))
    total = d.groupBy("community").agg(F.sum("d").alias("total")).join(inside, "community", "left")
    share = F.coalesce("inside", F.lit(0)) / twice - (F.col("total") / twice) * (F.col("total") / twice)
    return total.agg(F.count("*").alias("communities"), F.sum(share).alias("modularity"))


def modular_communities(edges: DataFrame, *, rounds: int = 10) -> DataFrame:
    """node, community: label moves that raise modularity. In each round a node that its hash
    picks joins the neighbouring community with the greatest gain, if there is one; rounds end
    when nobody moves. Communities are named by their smallest node."""
    links = adjacency(edges)
    saved = Saved(edges.sparkSession, "modular")
    links = saved.save(links)
    degree = saved.save(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")))
    twice = links.count()
    label = saved.save(degree.select("node", "d", F.col("node").alias("label")))
    quiet = 0
    for k in range(2 * rounds):
        size = label.groupBy("label").agg(F.sum("d").alias("total"))
        # half of the nodes move at a time, so that two neighbours do not trade places
        mine = label.where(F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2)
        near = links.join(mine, F.col("src") == F.col("node")).select("node", "d", F.col("label").alias("own"), "dst").join(label.select(F.col("node").alias("dst"), "label"), "dst")
        ties = near.groupBy("node", "d", "own", "label").agg(F.count("*").alias("ties")).union(mine.select("node", "d", F.col("label").alias("own"), "label", F.lit(0)))
        ties = ties.groupBy("node", "d", "own", "label").agg(F.sum("ties").alias("ties")).join(size, "label")
        others = F.col("total") - F.when(F.col("label") == F.col("own"), F.col("d")).otherwise(0)
        gain = F.round(F.col("ties") - others * F.col("d") / twice, 9)
        best = ties.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), (F.col("label") == F.col("own")).alias("stays"), "label")).alias("b")).select("node", F.col("b.label").alias("to"))
        moved = saved.save(label.join(best, "node", "left").select("node", "d", F.coalesce("to", "label").alias("label"), (F.coalesce("to", "label") != F.col("label")).alias("moved")))
        quiet = 0 if moved.where("moved").limit(1).count() else quiet + 1
        label = moved.select("node", "d", "label")
        if quiet == 2:
            break
    name = label.groupBy("label").agg(F.min("node").alias("community"))
    return label.join(name, "label").select("node", "community")


def network_metrics(edges: DataFrame) -> DataFrame:
    """One row of a directed network: nodes, edges, density, an estimate of the mean path
    (1 / density, the number of nodes at most), greatest degree, components."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    groups = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select("component").distinct().count()
    one = degree.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.max("d").alias("max_degree"))
    density = F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))
    return one.select("nodes", "edges", density.alias("density"), F.least(1 / density, F.col("nodes")).alias("mean_path"), "max_degree", F.lit(groups).alias("components"))
