"""Navigation graphs: sampled nodes, checked edges, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.operators.spatial import nearest, within
from terraloom.rules import FORBIDDEN
from terraloom.storage import table

STEP_M, CAP = {"dense": 150, "complex": 200, "open": 400}, {"dense": 12, "complex": 9, "open": 2}


def sample_blocks(cells: DataFrame, block: int, res: float, dense_step: int = 150) -> DataFrame:
    """Of cells (r, c, kind of their block) those on the block's step grid, thinned evenly to the cap of the kind."""
    pick = lambda d: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in d.items()])
    step = F.greatest(F.lit(1), (pick({**STEP_M, "dense": dense_step}) / res).cast("int"))
    a = cells.withColumns({"br": (F.col("r") / block).cast("int"), "bc": (F.col("c") / block).cast("int"), "_s": step})
    on = lambda x, b: ((x - b * block - F.floor(F.col("_s") / 2)) % F.col("_s") == 0) & (x - b * block >= F.floor(F.col("_s") / 2))
    a = a.filter(on(F.col("r"), F.col("br")) & on(F.col("c"), F.col("bc")))
    w = W.partitionBy("br", "bc")
    a = a.withColumn("_k", F.row_number().over(w.orderBy("r", "c")) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_cap", pick(CAP))
    stride = F.when(F.col("_n") > F.col("_cap"), F.ceil(F.col("_n") / F.col("_cap"))).otherwise(1)
    a = a.withColumn("_t", stride).filter("_k % _t = 0 AND _k / _t < _cap")
    return a.drop("_s", "_k", "_n", "_cap", "_t")


def skeleton(cells: DataFrame, blocks: DataFrame, block: int, res: float, top: float, budget: int = 12000) -> DataFrame:
    """Nodes (fid in scan order of blocks, x, y, lpcf) on free cells. Over budget, the step of dense blocks is widened twice at most."""
    kinds = blocks.select("br", "bc", "kind")
    joined = cells.withColumns({"br": (F.col("r") / block).cast("int"), "bc": (F.col("c") / block).cast("int")}).join(kinds, ["br", "bc"])
    nodes = None
    for dense_step in (150, 225, 300):
        nodes = table(sample_blocks(joined, block, res, dense_step).filter(~F.col("forbidden") & (F.col("lpcf") < FORBIDDEN)), "nodes")
        if nodes.count() <= budget:
            break
    return number(nodes).withColumns({"x": (F.col("c") + 0.5) * res, "y": top - (F.col("r") + 0.5) * res})


def number(nodes: DataFrame) -> DataFrame:
    """fid by (br, bc, r, c): counts per row of blocks, then ranks within, so no single task orders all nodes."""
    per = nodes.groupBy("br").count()
    before = per.select("br", (F.sum("count").over(W.orderBy("br").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("_b"))
    return nodes.join(before, "br").withColumn("fid", F.col("_b") + F.row_number().over(W.partitionBy("br").orderBy("bc", "r", "c")) - 1).drop("_b")


def edge_samples(pairs: DataFrame, res: float, top: float) -> DataFrame:
    """A row for each cell that an edge (a, b, ax, ay, bx, by, d) is sampled in, ends included, cells by truncation."""
    steps = F.greatest(F.lit(2), (F.col("d") / res).cast("int"))
    s = pairs.withColumn("_n", steps).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_t", F.col("_t") / F.col("_n"))
    x, y = F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay"))
    return s.withColumn("c", (x / res).cast("int")).withColumn("r", ((top - y) / res).cast("int")).drop("_n", "_t")


def check_edges(pairs: DataFrame, cells: DataFrame, res: float, top: float) -> DataFrame:
    """Edges that cross no forbidden cell, with the mean cost of their other cells (1 without any). Samples off the grid don't count."""
    s = edge_samples(pairs, res, top).join(cells.select("r", "c", "forbidden", "lpcf"), ["r", "c"], "left")
    g = s.groupBy("a", "b", "d").agg(F.coalesce(F.bool_or("forbidden"), F.lit(False)).alias("_f"), F.coalesce(F.avg(F.when(F.col("lpcf") < FORBIDDEN, F.col("lpcf"))), F.lit(1.0)).alias("avg_lpcf"))
    return g.filter("NOT _f AND d >= 1").drop("_f").withColumn("edge_cost", F.col("d") * F.greatest("avg_lpcf", F.lit(0.1)))


def candidate_edges(nodes: DataFrame, cutoff: float, budget: int = 600_000, least: float = 500.0) -> DataFrame:
    """Pairs within cutoff; over budget the cutoff shrinks by a quarter, twice at most and down to the least."""
    pairs = table(within(nodes, cutoff), "pairs")
    for _ in range(2):
        if pairs.count() <= budget or cutoff <= least:
            break
        cutoff = max(least, 0.75 * cutoff)
        pairs = pairs.filter(F.col("d") <= cutoff)
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of the edges (a, b): c is the least vertex of its component.

    Each round takes the least label among neighbours, then the label of that
    label, so the number of rounds grows with the logarithm of the diameter.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = table(both, "edges")
    labels = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("n"))
        hop = labels.toDF("n", "h")
        then = table(step.join(hop, "n").select("v", F.least("n", "h").alias("n"), "c"), "labels")
        changed = then.filter("n <> c").limit(1).count()
        labels = then.select("v", F.col("n").alias("c"))
        if not changed:
            return labels


def connectivity(labels: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row from the labels (v, c) of components: their number, size of the largest, whether two vertices (the first and the last by default) are together."""
    size = labels.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    a = F.lit(start) if start is not None else F.min("v")
    b = F.lit(end) if end is not None else F.max("v")
    ends = labels.agg(a.alias("a"), b.alias("b"))
    both = labels.join(F.broadcast(ends), (F.col("v") == F.col("a")) | (F.col("v") == F.col("b"))).agg((F.countDistinct("c") == 1).alias("together"))
    return size.crossJoin(F.broadcast(both))


def navigation(nodes: DataFrame, controls: DataFrame, factor: float = 4.0, least: float = 500.0, most: float = 1500.0, budget: int = 600_000) -> tuple[DataFrame, DataFrame]:
    """(all nodes, candidate edges): control nodes follow the others in number; the cutoff is a multiple of the median distance to the nearest node, between two bounds."""
    first = (nodes.agg(F.max("fid")).first()[0] or 0) + 1
    more = controls.select((F.row_number().over(W.orderBy("node_type", "seq", "x", "y")) - 1 + first).cast("long").alias("fid"), "x", "y")  # controls are few, set by hand
    every = table(nodes.select(F.col("fid").cast("long").alias("fid"), "x", "y").unionByName(more), "nodes")
    own = every.select("fid", "x", "y", F.lit(0).alias("_all"))
    near = nearest(own, own.select(F.col("fid").alias("sid"), "x", "y", "_all", F.lit(0).alias("_v")), "_all", "_v", same=True)
    middle = near.agg(F.percentile("distance", F.lit(0.5))).first()[0]
    return every, candidate_edges(every, max(least, min(most, factor * (middle or 0.0))), budget, least)


def control_nodes(controls: DataFrame) -> DataFrame:
    """Nodes of control points (ctrl_kind, seq, type, x, y)."""
    kind = F.when(F.col("ctrl_kind") == "start_end", F.concat(F.lit("start_end_"), F.coalesce("type", F.lit("waypoint")))).otherwise(F.col("ctrl_kind"))
    return controls.filter(F.col("ctrl_kind").isin("start_end", "must_pass", "dense_corridor")).select(kind.alias("node_type"), "seq", "x", "y")
