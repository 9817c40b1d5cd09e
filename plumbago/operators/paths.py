"""Shortest paths between stated nodes, and walks that a seed decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.operators.tables import stored

_PAIR = ["a", "b"]
#: Neighbours in one list, so that a node with many is several rows.
NEIGHBOURS = 4096


def shortest(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, path): the shortest path along edges(source, target), of several the least by its ids.

    Both ends are searched in turn, the one with fewer nodes at its border next, until they meet; what lies on a
    shortest path is then known by its place, and the least is walked. Pairs without a path have no row; a path from a
    node to itself is that node. Repeated edges and pairs count once, null ends never. A step is a join with the edges,
    so a path of n steps takes some 2 n of them; a pair's borders are distributed like any table.
    """
    out = stored(edges.select("source", "target").where("source <> target").distinct(), "edges")
    into = out.select(F.col("target").alias("source"), F.col("source").alias("target"))
    pairs = stored(pairs.select(*_PAIR).where("a is not null and b is not null").distinct(), "pairs")
    seen = {"a": stored(pairs.select(*_PAIR, F.col("a").alias("id"), F.lit(0).alias("d"))), "b": stored(pairs.select(*_PAIR, F.col("b").alias("id"), F.lit(0).alias("d")))}
    steps, along = {"a": 0, "b": 0}, {"a": out, "b": into}
    front = dict(seen)
    met = stored(pairs.where("a = b").select(*_PAIR, F.col("a").alias("id"), F.lit(0).alias("da"), F.lit(0).alias("db")), "met")
    open_ = stored(pairs.where("a <> b"), "open")
    while True:
        border = {side: front[side].join(open_, _PAIR, "left_semi") for side in "ab"}
        sizes = {side: border[side].count() for side in "ab"}
        if not sizes["a"] or not sizes["b"]:
            break
        side = min("ab", key=lambda s: sizes[s])
        other = "b" if side == "a" else "a"
        steps[side] += 1
        found = border[side].join(along[side].withColumnRenamed("source", "id"), "id").select(*_PAIR, F.col("target").alias("id")).distinct()
        front[side] = stored(found.join(seen[side], [*_PAIR, "id"], "left_anti").withColumn("d", F.lit(steps[side])), "front")
        seen[side] = stored(seen[side].unionByName(front[side]), "seen")
        here = front[side].join(front[other].select(*_PAIR, "id"), [*_PAIR, "id"], "left_semi").select(*_PAIR, "id", F.lit(steps["a"]).alias("da"), F.lit(steps["b"]).alias("db"))
        met = stored(met.unionByName(here), "met")
        # a pair whose border on this side is empty has no path, one that has met is done
        open_ = stored(open_.join(front[side], _PAIR, "left_semi").join(met, _PAIR, "left_anti"), "open")
    return _least(out, seen, met)


def _least(out: DataFrame, seen: dict[str, DataFrame], met: DataFrame) -> DataFrame:
    """The least path through nodes whose place is known, from where the searches met."""
    lengths = stored(met.groupBy(*_PAIR).agg(F.max("da").alias("da"), F.max("db").alias("db")), "lengths")
    layer = stored(met.select(*_PAIR, "id", F.col("da").alias("k")), "layer")
    places = layer
    while not layer.where("k > 0").isEmpty():
        before = layer.where("k > 0").join(out, F.col("id") == F.col("target")).select(*_PAIR, F.col("source").alias("id"), (F.col("k") - 1).alias("d")).distinct()
        layer = stored(before.join(seen["a"], [*_PAIR, "id", "d"], "left_semi").withColumnRenamed("d", "k"), "layer")
        places = stored(places.unionByName(layer), "places")
    rest = seen["b"].join(lengths, _PAIR).where("d < db").select(*_PAIR, "id", (F.col("da") + F.col("db") - F.col("d")).alias("k"))
    places = stored(places.unionByName(rest), "places")
    walk = stored(lengths.select(*_PAIR, (F.col("da") + F.col("db")).alias("n"), F.array("a").alias("path")), "walk")
    done = walk.where("n = 0")
    while not (left := walk.where("size(path) <= n")).isEmpty():
        ahead = left.withColumn("source", F.element_at("path", -1)).withColumn("k", F.size("path")).join(out, "source").withColumnRenamed("target", "id")
        step = ahead.join(places, [*_PAIR, "id", "k"], "left_semi").groupBy(*_PAIR).agg(F.min("id").alias("next"))
        walk = stored(left.join(step, _PAIR).select(*_PAIR, "n", F.array_append("path", F.col("next")).alias("path")), "walk")
        done = stored(done.unionByName(walk.where("size(path) > n")), "done")
    return done.select(*_PAIR, "path")


def walks(edges: DataFrame, starts: DataFrame, steps: int = 4, seed: int = 42) -> DataFrame:
    """starts(walk, id) -> (walk, path): up to so many steps from a start, each to the neighbour with the least hash of
    seed, walk, step and neighbour. A walk ends early where no edge leads on, and may come back.

    Neighbours stand in lists of some NEIGHBOURS at most: each list of a walk's node offers its least, and the offers
    meet by walk. So a step moves walks and lists, and no row for each neighbour of each walk.
    """
    each = edges.select("source", "target").distinct()
    sized = each.join(each.groupBy("source").agg(F.count("*").alias("n")), "source")
    part = F.pmod(F.xxhash64("target"), F.expr(f"1 + n div {NEIGHBOURS}"))
    lists = stored(sized.groupBy("source", part.alias("part")).agg(F.collect_list("target").alias("targets")).select("source", "targets"), "lists")
    now = stored(starts.select("walk", F.array("id").alias("path")), "walk")
    for step in range(1, steps + 1):
        hashed = F.transform("targets", lambda t: F.struct(F.xxhash64(F.lit(seed), F.col("walk"), F.lit(step), t).alias("h"), t.alias("target")))  # noqa: B023
        offers = now.withColumn("source", F.element_at("path", -1)).join(lists, "source", "left").select("walk", "path", F.array_min(hashed).alias("offer"))
        ahead = offers.groupBy("walk").agg(F.any_value("path").alias("path"), F.min("offer")["target"].alias("next"))
        now = stored(ahead.select("walk", F.when((F.size("path") == step) & F.col("next").isNotNull(), F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path")), "walk")
    return now


def selected(edges: DataFrame, scores: DataFrame, most: int = 5, central: int = 5, steps: int = 4, seed: int = 42) -> DataFrame:
    """(place, kind, path): shortest paths between the central nodes by scores(id, score), best pairs first; if there
    are fewer than most, walks from the nodes with the least hash under the seed. Ties in score go by id.

    The central nodes and the starts are a top-k each: central and most are parameters, not caps on the graph. A graph
    of one node or none has no paths.
    """
    best = [r["id"] for r in scores.orderBy(F.desc("score"), "id").limit(central).collect()]
    spark = edges.sparkSession
    ranked = [(best[i], best[j], i, j) for i in range(len(best)) for j in range(i + 1, len(best))]
    stated = spark.createDataFrame(ranked, "a string, b string, i int, j int")
    found = shortest(edges, stated).join(stated, _PAIR).orderBy("i", "j").limit(most).select("i", "j", "path").collect()
    rows = [(k, "shortest", r["path"]) for k, r in enumerate(sorted(found))]
    if len(rows) < most and len(best) > 1:
        starts = scores.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most - len(rows)).select("id").collect()
        begun = spark.createDataFrame([(len(rows) + i, r["id"]) for i, r in enumerate(starts)], "walk int, id string")
        walked = walks(edges, begun, steps, seed).where("size(path) > 1").orderBy("walk").collect()
        rows += [(len(rows) + i, "walk", r["path"]) for i, r in enumerate(walked)]
    return spark.createDataFrame(rows, "place int, kind string, path array<string>")
