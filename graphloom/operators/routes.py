"""Best paths in a semiring: the k cheapest (min, +) and the k widest (max, min).

The first path starts at the start. Each further one leaves an earlier path at one of its
nodes, by an edge that no path found so far takes there (Yen). The searches from all nodes of
the last path run as one job, with the search's number as a part of the key.

A search goes back from the goal, with numbers alone: a node's label is its least cost to the
goal and, of equal costs, the fewest hops, and a round relaxes only what the last one improved.
What cannot lead to less than the best way that the search's first node has so far is left out.
Then the path is walked forward from label to label, by the smallest node where several fit, so
equal costs have a defined winner, and no hop limit is needed.

Wide paths take two steps: the width of the widest path of each search, where no edge counts
for more than the widest first edge does, then the path of fewest hops among the edges that
are so wide.

k paths come to the driver, as a search's result does, never the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from graphloom.operators.loops import Saved

Search = tuple[int, list, float, list]  # number, root path, its cost, nodes that may not follow it


def _searches(spark: SparkSession, edges: DataFrame, searches: list[Search]) -> DataFrame:
    """search, root, cost, banned, and the least weight that its edges have (none yet)."""
    node = edges.schema["src"].dataType
    schema = StructType([StructField("search", LongType()), StructField("root", ArrayType(node)), StructField("cost", DoubleType()), StructField("banned", ArrayType(node)), StructField("least", DoubleType())])
    return spark.createDataFrame([(*x, None) for x in searches], schema)


def _labels(links: DataFrame, searches: DataFrame, exits: DataFrame, goal, saved: Saved, *, widest: bool = False, hops: bool = False) -> tuple[DataFrame, dict[int, float]]:
    """(search, node, value, hops): ways from the nodes to the goal that avoid the root, as far
    as they matter; and what each search reaches by its exits (search, dst, weight). hops:
    every edge counts 1."""
    weight = F.lit(1.0) if hops else F.col("weight")
    joined = (lambda v: F.least(v, weight)) if widest else (lambda v: v + weight)
    best_of, better = (F.max, max) if widest else (F.min, min)
    first = exits.groupBy("search").agg(F.min(weight).alias("first"), F.max("weight").alias("cap"))
    own = saved.save(searches.join(first, "search").select("search", "root", "least", "first", F.least("cost", "cap").alias("cap")))
    best = front = saved.save(own.select("search", F.lit(goal).alias("node"), (F.col("cap") if widest else F.lit(0.0)).alias("value"), F.lit(0).alias("hops")))
    reached: dict[int, float] = {}
    hop = 0
    while True:
        met = exits.join(front.select("search", F.col("node").alias("dst"), "value"), ["search", "dst"]).groupBy("search").agg(best_of(joined(F.col("value"))).alias("value"))
        for r in met.collect():  # a row for each search
            reached[r.search] = better(r.value, reached.get(r.search, r.value))
        hop += 1
        bound = links.sparkSession.createDataFrame(list(reached.items()), "search long, bound double")
        matters = lambda v: F.col("bound").isNull() | (v > F.col("bound") if widest else v + F.col("first") < F.col("bound"))
        go = front.join(F.broadcast(own), "search").join(F.broadcast(bound), "search", "left").where(matters(F.col("value")))
        step = go.join(links, F.col("node") == F.col("dst")).where((F.col("least").isNull() | (F.col("weight") >= F.col("least"))) & ~F.array_contains("root", F.col("src")))
        offer = step.select("search", F.col("src").alias("node"), joined(F.col("value")).alias("offer"), "first", "bound").where(matters(F.col("offer"))).groupBy("search", "node").agg(best_of("offer").alias("offer"))
        beats = F.col("offer") > F.col("value") if widest else F.col("offer") < F.col("value")
        front, (n, _) = saved.signed(offer.join(best, ["search", "node"], "left").where(F.col("value").isNull() | beats).select("search", "node", F.col("offer").alias("value"), F.lit(hop).alias("hops")), "search", "node")
        if not n:
            return best, reached
        best = saved.save(best.join(front, ["search", "node"], "left_anti").union(front))


def _walked(links: DataFrame, exits: DataFrame, labels: DataFrame, *, hops: bool) -> dict[int, tuple[list, list[float]]]:
    """Nodes behind the root, and the weights before them, of each search that reaches the goal."""
    weight = F.lit(1.0) if hops else F.col("weight")
    label = labels.select("search", F.col("node").alias("dst"), "value", "hops")
    total = F.struct((F.col("value") + weight).alias("total"), "hops", "dst", "value", "weight")
    now = exits.join(label, ["search", "dst"]).groupBy("search").agg(F.min(total).alias("x")).select("search", "x.*").collect()
    found: dict[int, tuple[list, list[float]]] = {}
    node = links.schema["src"].dataType
    schema = StructType([StructField("search", LongType()), StructField("src", node), StructField("from", DoubleType()), StructField("left", LongType()), StructField("least", DoubleType())])
    least = {r.search: r.weight for r in exits.groupBy("search").agg(F.first("least").alias("weight")).collect()}
    while now:
        for r in now:
            nodes, weights = found.setdefault(r.search, ([], []))
            nodes.append(r.dst)
            weights.append(r.weight)
        at = [(r.search, r.dst, r.value, r.hops, least[r.search]) for r in now if r.hops]
        if not at:
            break
        step = links.join(F.broadcast(links.sparkSession.createDataFrame(at, schema)), "src").where(F.col("least").isNull() | (F.col("weight") >= F.col("least")))
        fits = (F.col("value") + weight == F.col("from")) & (F.col("hops") == F.col("left") - 1)
        now = step.join(label, ["search", "dst"]).where(fits).groupBy("search").agg(F.min(F.struct("dst", "hops", "value", "weight")).alias("x")).select("search", "x.*").collect()
    return found


def _found(links: DataFrame, back: DataFrame, searches: list[Search], goal, widest: bool, saved: Saved) -> list[tuple[float, int, list]]:
    """(cost, hops, path) of each search that reaches the goal; a width counts as minus it.
    back: the links, dealt out by dst."""
    starts = _searches(links.sparkSession, links, searches)
    first = links.join(F.broadcast(starts.select("*", F.element_at("root", -1).alias("src"))), "src").where(~F.array_contains("root", F.col("dst")) & ~F.array_contains("banned", F.col("dst")))
    exits = saved.save(first.select("search", "dst", "weight", "least"))
    root = {number: (list(nodes), cost) for number, nodes, cost, _ in searches}
    width: dict[int, float] = {}
    if widest:
        _, reached = _labels(back, starts, exits, goal, saved, widest=True)
        width = {k: min(v, root[k][1]) for k, v in reached.items()}
        wide = F.broadcast(links.sparkSession.createDataFrame(list(width.items()), "search long, least double"))
        starts = starts.drop("least").join(wide, "search")
        exits = saved.save(exits.drop("least").join(wide, "search").where("weight >= least").select("search", "dst", "weight", "least"))
    labels, _ = _labels(back, starts, exits, goal, saved, hops=widest)
    out = []
    for number, (nodes, weights) in _walked(links, exits, labels, hops=widest).items():
        path, cost = root[number]
        for w in weights:
            cost += w
        out.append((-width[number] if widest else cost, len(path) + len(nodes) - 1, path + nodes))
    return out


def best_paths(edges: DataFrame, start, goal, *, k: int = 1, widest: bool = False) -> DataFrame:
    """rank, cost (or width), hops, path: the k best paths without a repeated node along directed
    edges (src, dst, weight, none below 0). Cheapest: least sum of weights; widest: greatest
    least weight. Equal ones come by fewest hops, then by their nodes."""
    spark = edges.sparkSession
    saved = Saved(spark, "routes")
    links = saved.save(edges.where("src <> dst").groupBy("src", "dst").agg((F.max if widest else F.min)(F.col("weight").cast("double")).alias("weight")))
    # the links are dealt out by dst once and stay there
    back = links.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dst").persist()
    try:
        paths = _ranked(links, back, start, goal, k, widest, saved)
    finally:
        back.unpersist()
    node = ArrayType(edges.schema["src"].dataType)
    name = "width" if widest else "cost"
    rows = [(i + 1, -c if widest else c, h, p) for i, (c, h, p) in enumerate(paths)]
    return spark.createDataFrame(rows, StructType([StructField("rank", LongType()), StructField(name, DoubleType()), StructField("hops", LongType()), StructField("path", node)]))


def _ranked(links: DataFrame, back: DataFrame, start, goal, k: int, widest: bool, saved: Saved) -> list[tuple[float, int, list]]:
    spark = links.sparkSession
    weight = {}  # of the edges on found paths
    paths: list[tuple[float, int, list]] = []
    offers = _found(links, back, [(0, [start], float("inf") if widest else 0.0, [])], goal, widest, saved) if start != goal else [(0.0, 0, [start])]
    while offers and len(paths) < k:
        offers.sort()
        paths.append(offers.pop(0))
        if len(paths) == k:
            break
        path = paths[-1][2]
        ends = spark.createDataFrame([(a, b) for a, b in zip(path[:-1], path[1:], strict=True)], StructType([StructField(c, links.schema["src"].dataType) for c in ("src", "dst")])) if len(path) > 1 else None
        for r in links.join(F.broadcast(ends), ["src", "dst"]).collect() if ends is not None else []:
            weight[r.src, r.dst] = r.weight
        searches: list[Search] = []
        for i in range(len(path) - 1):
            root = path[: i + 1]
            costs = [weight[x] for x in zip(root[:-1], root[1:], strict=True)]
            cost = min(costs, default=float("inf")) if widest else sum(costs, 0.0)
            searches.append((i, root, cost, sorted({p[i + 1] for _, _, p in paths if p[: i + 1] == root and len(p) > i + 1})))
        known = [p for _, _, p in paths + offers]
        offers += [x for x in _found(links, back, searches, goal, widest, saved) if x[2] not in known] if searches else []
    return paths


def widest_rows(edges: DataFrame, start) -> DataFrame:
    """node, width, parent: the widest way from the start to every node that it leads to (none
    limits the start itself), and the node before it on such a way."""
    saved = Saved(edges.sparkSession, "widest")
    links = saved.save(edges.where("src <> dst").groupBy("src", "dst").agg(F.max(F.col("weight").cast("double")).alias("weight")))
    best = front = saved.save(edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(float("inf")).alias("width"), F.lit(None).cast(links.schema["src"].dataType).alias("parent")))
    while True:
        offer = front.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((-F.least("width", "weight")).alias("less"), F.col("src").alias("parent"))).alias("o"))
        better = offer.join(best.select("node", "width"), "node", "left").where(F.col("width").isNull() | (-F.col("o.less") > F.col("width")))
        # a node's parent had its width before: parents lead back to the start
        front, (n, _) = saved.signed(better.select("node", (-F.col("o.less")).alias("width"), F.col("o.parent").alias("parent")), "node")
        if not n:
            return best
        best = saved.save(best.join(front, "node", "left_anti").union(front))
