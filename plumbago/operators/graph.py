"""Concept graphs: degrees, rank, levels, chains, closures, salience and components."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbago.operators.tables import stored

#: Relation parts that say a concept holds another; that say a step follows another.
CONTAINMENT = ("has", "includes", "contains", "consists_of", "comprised_of", "composed_of", "has_component", "has_phase", "has_step", "has_part", "has_stage", "has_layer", "has_type", "has_subtype", "encompasses", "covers", "is_a", "type_of", "part_of")
FLOW = (
    "precedes", "followed_by", "next_step", "produces", "generates", "outputs", "feeds_into", "transforms_into", "leads_to", "results_in", "passes_to", "passed_to", "input_to", "output_of", "converts_to",
    "then", "next", "after", "before", "flows_to", "phase_of",
)


def _holds(relation: str, kinds: tuple[str, ...]):
    """A relation, its blanks as underscores, that has one of the parts."""
    plain = F.replace(F.trim(F.lower(F.coalesce(relation, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.exists(F.array(*map(F.lit, kinds)), lambda k: F.contains(plain, k))


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends here; a loop's plan stays as small as one round's. tables.clean() deletes what this writes."""
    return stored(df)


def latest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target), the last by edge_idx."""
    return edges.groupBy("source", "target").agg(F.max(F.struct("edge_idx", "relation")).alias("m")).select("source", "target", "m.edge_idx", "m.relation")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, degree) of every node; edges of unknown nodes count for the ends that are known."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("id").join(sums.hint("merge"), "id", "left").select("id", zero(F.col("o")).alias("n_out"), zero(F.col("i")).alias("n_in"), (zero(F.col("o")) + zero(F.col("i"))).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(id, rank): mass of nodes without successors is dealt out evenly; parallel edges count once."""
    links = edges.select("source", "target").distinct().join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return ranks(nodes, stored(links, "links"), damping, rounds)


def ranks(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """pagerank over links(source, target), stored, each once and between nodes.

    What the rounds deal out evenly is one number a round, so a rank is a sum of steps: what walks of k links bring from a
    start of one at every node, times a factor that only these numbers make. A step joins the links with the step before
    and sums by target; steps end where no walk is longer, so a graph without cycles takes as many as its longest path
    has links, and another one `rounds`.
    """
    n, leaving = max(nodes.count(), 1), links.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("k"))
    step = stored(nodes.select("id", F.lit(1.0).alias("y")).join(leaving, "id", "left"), "step")
    steps, idle = [], []  # idle: what the step brings to nodes without successors
    while True:
        lost, busy = step.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("y"))), F.lit(0.0)), F.count("k")).first()
        steps.append(step)
        idle.append(lost)
        if len(steps) > rounds or not busy:
            break
        given = step.where("k is not null").select(F.col("id").alias("source"), (F.col("y") / F.col("k")).alias("z"))
        brought = links.join(given, "source").groupBy(F.col("target").alias("id")).agg(F.sum("z").alias("y"))
        step = stored(brought.join(leaving, "id", "left"), "step")
    factors = [1.0 / n]  # of the steps, after no round
    for _ in range(rounds):
        even = (1 - damping + damping * sum(a * b for a, b in zip(factors, idle))) / n  # noqa: B905
        factors = [even, *(damping * a for a in factors)][: len(steps)]
    parts = [df.select("id", (F.col("y") * F.lit(a)).alias("y")) for df, a in zip(steps, factors, strict=False)]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("y").alias("rank"))


def levels(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = CONTAINMENT) -> DataFrame:
    """(id, level, parent): breadth first from nodes that no containment edge enters; the parent that stands first wins.

    Nodes on cycles without an entry have level 0 and no parent.
    """
    held = edges.where(_holds("relation", kinds)).where("source <> target").select("source", "target", "edge_idx")
    held = _cut(held.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").join(nodes.select(F.col("id").alias("source")), "source", "left_semi"))
    parts = [_cut(nodes.select("id").join(held.select(F.col("target").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")))]
    for depth in count(1):
        found = held.join(parts[-1].where(F.col("level") == depth - 1).select(F.col("id").alias("source")), "source").groupBy("target").agg(F.min_by("source", "edge_idx").alias("parent"))
        done = reduce(DataFrame.unionByName, parts)
        front = _cut(found.select(F.col("target").alias("id"), F.lit(depth).alias("level"), "parent").join(done.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > 4:  # a deep graph's plan stays small too
            parts = [_cut(reduce(DataFrame.unionByName, parts))]
    done = reduce(DataFrame.unionByName, parts)
    rest = nodes.select("id").join(done.select("id"), "id", "left_anti").select("id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"))
    return done.unionByName(rest)


def descendants(edges: DataFrame) -> DataFrame:
    """(root, id): everything that can be reached along the edges; a cycle ends where it closes."""
    known = _cut(edges.select(F.col("source").alias("root"), F.col("target").alias("id")).distinct())
    front = known
    while True:
        front = _cut(front.join(edges.select(F.col("source").alias("id"), F.col("target").alias("next")), "id").select("root", F.col("next").alias("id")).distinct().join(known, ["root", "id"], "left_anti"))
        if front.isEmpty():
            break
        known = _cut(known.unionByName(front))
    return known


def chains(edges: DataFrame, kinds: tuple[str, ...] = FLOW, least: int = 3) -> DataFrame:
    """(head, steps array): chains along each node's first flow edge, from nodes that none enters; least steps or more.

    Heads go in the order of their first edge, and a chain ends before a node that an earlier head's path holds, so no
    step is in two chains. A path ends where it would close.
    """
    flow = edges.where(_holds("relation", kinds))
    step = _cut(flow.groupBy("source").agg(F.min_by("target", "edge_idx").alias("next"), F.min("edge_idx").alias("first")))
    heads = step.join(flow.select(F.col("target").alias("source")).distinct(), "source", "left_anti")
    open_ = heads.select(F.col("source").alias("head"), F.array("source").alias("steps"))
    done = []
    while True:
        walked = open_.join(step, F.element_at("steps", -1) == step["source"], "left")
        ends = F.col("next").isNull() | F.array_contains("steps", F.col("next"))
        walked = _cut(walked.select("head", F.when(ends, F.col("steps")).otherwise(F.array_append("steps", F.col("next"))).alias("steps"), ends.alias("end")))
        done.append(walked.where("end").drop("end"))
        if len(done) > 16:  # a long chain's plan stays small too
            done = [_cut(reduce(DataFrame.unionByName, done))]
        open_ = walked.where("not end").drop("end")
        if open_.isEmpty():
            break
    paths = reduce(DataFrame.unionByName, done).join(heads.select(F.col("source").alias("head"), "first"), "head")
    places = _cut(paths.select("head", F.struct("first", "head").alias("turn"), F.posexplode("steps").alias("k", "step")))
    owners = places.groupBy("step").agg(F.min("turn").alias("owner"))
    kept = places.join(owners, "step").where("turn = owner").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("k", "step"))).alias("s"))
    return kept.select("head", F.transform("s", lambda x: x["step"]).alias("steps")).where(F.size("steps") >= least)


def salient(scores: DataFrame, top: int, mass: float = 0.85, least: int = 3) -> DataFrame:
    """scores(id, score) -> (id, score, place): nodes by falling score up to the given share of all score; the node that
    crosses it is out, the first `least` are in, and there are `top` at most."""
    total = scores.agg(F.sum("score")).first()[0] or 0.0
    best = scores.orderBy(F.desc("score"), "id").limit(top)  # a top-k: what the window below orders is no more
    order = W.orderBy(F.desc("score"), "id")
    ranked = best.withColumn("place", F.row_number().over(order)).withColumn("sum", F.sum("score").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.where((F.col("place") <= least) | (F.col("sum") <= mass * total)).select("id", "score", "place")


def two_hop_paths(edges: DataFrame, scores: DataFrame, among: int = 15, most: int = 8) -> DataFrame:
    """(a, b, c, weight): distinct two-edge paths among the best nodes, heaviest first."""
    best = scores.orderBy(F.desc("score"), "id").limit(among).select("id", "score")
    e = edges.select("source", "target").distinct().where("source <> target")
    inner = e.join(F.broadcast(best.select(F.col("id").alias("source"), F.col("score").alias("s"))), "source").join(F.broadcast(best.select(F.col("id").alias("target"), F.col("score").alias("t"))), "target")
    x, y = inner.select(F.col("source").alias("a"), F.col("target").alias("b"), "s"), inner.select(F.col("source").alias("b"), F.col("target").alias("c"), F.col("s").alias("m"), F.col("t").alias("e"))
    return x.join(y, "b").where("a <> c").select("a", "b", "c", (F.col("s") + F.col("m") + F.col("e")).alias("weight")).orderBy(F.desc("weight"), "a", "b", "c").limit(most)


def last_label_types(nodes: DataFrame) -> DataFrame:
    """(label, type): of several nodes with one label the last by pos."""
    return nodes.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.max_by("type", "pos").alias("type"))
