"""Graph loops over (src, dst, conf) edge tables: closure, PageRank, bounded best paths, packing.

Rounds are written to the shared folder, so plans stay short and a lost executor costs one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlight.plans.durable import Scratch, buckets


def closure_steps(edges: DataFrame, parents: DataFrame | None = None, conditional: DataFrame | None = None) -> DataFrame:
    """(id, next): what marking a vertex marks, dealt and written once in buckets of id and shared by closures, whose rounds deal only what they found.

    edges (src, dst); parents(id, parent): marking a vertex marks its ancestors; conditional(id, needs): such a vertex is a root
    once ``needs`` is reached.
    """
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    if parents is not None:
        step = step.unionByName(parents.where("parent is not null").select("id", F.col("parent").alias("next")))
    if conditional is not None:
        step = step.unionByName(conditional.select(F.col("needs").alias("id"), F.col("id").alias("next")))
    step = step.where("id is not null and next is not null").repartition(buckets(edges.sparkSession), "id").distinct()
    return Scratch(edges.sparkSession, "steps").save_by(step, "id")


def reach(edges: DataFrame | None, roots: DataFrame, parents: DataFrame | None = None, conditional: DataFrame | None = None, steps: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id): all that the roots (id) reach along edges (src, dst); see closure_steps, whose result may be given instead.

    known: what an earlier closure over the same steps has reached; only what is beyond it is walked, and it is part of the result.
    Semi-naive: each round joins only what the last one found. What is known is merged every eight rounds, so a round reads
    few files however long the chains are.
    """
    scratch = Scratch(roots.sparkSession, "reach")
    step = closure_steps(edges, parents, conditional) if steps is None else steps
    first = roots.select("id").where("id is not null").distinct()
    parts = [] if known is None else [known.select("id")]
    parts.append(scratch.save(first if known is None else first.join(parts[0], "id", "left_anti")))
    while not parts[-1].isEmpty():
        if len(parts) > 8:
            parts = [scratch.save(reduce(DataFrame.unionByName, parts[:-1])), parts[-1]]
        seen = reduce(DataFrame.unionByName, parts)
        parts.append(scratch.save(parts[-1].join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")))
    return reduce(DataFrame.unionByName, parts)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85, focus: DataFrame | None = None, tolerance: float | None = 1e-9) -> DataFrame:
    """(id, rank): weighted PageRank of nodes (id) over edges (src, dst, weight); self loops dropped, parallel edges kept.

    Teleport is uniform, or half uniform and half over the focus (id). Vertices without out-edges give their rank to the
    teleport. With tolerance None exactly ``rounds`` rounds are run; else rounds stop when the L1 change is below it.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "pagerank")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    tele = nodes.select("id", F.lit(1.0 / n).alias("tele"))
    if focus is not None and (k := focus.join(nodes, "id", "left_semi").distinct().count()):
        marked = focus.select("id").distinct().withColumn("in", F.lit(1.0))
        tele = tele.join(marked, "id", "left").select("id", (F.col("tele") / 2 + F.coalesce("in", F.lit(0.0)) / (2 * k)).alias("tele"))
    # dealt by src once; groups, shares and every round's join then find the edges where they lie
    e = edges.where("src <> dst").select("src", "dst", "weight").repartition(buckets(spark), "src").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    e = scratch.save_by(e.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share")), "src")
    out = e.select(F.col("src").alias("id")).distinct().withColumn("dangling", F.lit(False))
    state = scratch.save(tele.join(out, "id", "left").select("id", "tele", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.col("tele").alias("rank")))
    for _ in range(rounds):
        lost = state.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        sent = e.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = state.join(sent, "id", "left").crossJoin(F.broadcast(lost))  # one row
        new = new.select("id", "tele", "dangling", ((1 - damping) * F.col("tele") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("tele"))).alias("rank"), F.col("rank").alias("old"))
        new = scratch.save(new)
        delta = None if tolerance is None else new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        scratch.drop(state)
        state = new
        if delta is not None and delta < tolerance:
            break
    return state.select("id", "rank")


def best_paths(edges: DataFrame, seeds: DataFrame, depth: int = 4, least: float = 0.0) -> DataFrame:
    """(id, distance, confidence): callers of the seeds (id) against the edges' direction, level by level.

    A vertex is met at its least distance; its confidence is the best product over the edges from that level on which it is met.
    Paths, and edges, under ``least`` are dropped; seeds themselves are left out.
    """
    scratch = Scratch(edges.sparkSession, "impact")
    back = scratch.save(edges.where(F.col("conf") >= least).groupBy(F.col("dst").alias("id"), F.col("src").alias("caller")).agg(F.max("conf").alias("conf")))  # every level reads it
    level = scratch.save(seeds.select("id").distinct().withColumns({"distance": F.lit(0), "confidence": F.lit(1.0)}))
    parts = [level]
    for d in range(1, depth + 1):
        known = reduce(DataFrame.unionByName, [p.select("id") for p in parts])
        nxt = parts[-1].join(back, "id").select(F.col("caller").alias("id"), (F.col("confidence") * F.col("conf")).alias("confidence")).where(F.col("confidence") >= least)
        nxt = nxt.groupBy("id").agg(F.max("confidence").alias("confidence")).join(known, "id", "left_anti").select("id", F.lit(d).alias("distance"), "confidence")
        nxt = scratch.save(nxt)
        if nxt.isEmpty():
            break
        parts.append(nxt)
    return reduce(DataFrame.unionByName, parts).where("distance > 0")


def pack_budget(candidates: DataFrame, order: list, budget: int, shared: str | None = None, shared_cost: str | None = None) -> DataFrame:
    """Rows (id, cost) taken greedily in the order while they fit; what doesn't fit is skipped and the rest still tried.

    With shared, the first row taken of each value of that column also costs shared_cost. What no longer fits never will, so each
    round asks the cluster for the first rows that still do, as many as the budget could hold, and fills up from them: the
    driver sees as many rows as the budget has units at most, however long the table is.
    """
    spark = candidates.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in candidates.schema}
    group, extra = (F.col(shared) if shared else F.lit(None).cast("string")).alias("_g"), (F.col(shared_cost) if shared_cost else F.lit(0)).alias("_x")
    cheapest = candidates.agg(F.min("cost")).first()[0]
    taken, left, paid = [], budget, set()
    while cheapest is not None and left >= max(cheapest, 0):
        fits = candidates.where(F.col("cost") <= left)
        if taken:
            fits = fits.where(~F.col("id").isin([t[0] for t in taken]))
        if shared:  # a row whose heading isn't paid must fit with it
            fits = fits.where((F.col("cost") + F.col(shared_cost) <= left) | F.col(shared).isin(sorted(paid)))
        most = left // max(cheapest, 1) + 1
        rows = fits.orderBy(*order).select("id", "cost", group, extra).limit(int(most)).collect()
        if not rows:
            break
        for row in rows:
            cost = row.cost + (0 if row._g is None or row._g in paid else row._x)
            if cost <= left:
                taken.append((row.id, row.cost, len(taken) + 1))
                left -= cost
                if row._g is not None:
                    paid.add(row._g)
    return spark.createDataFrame(taken, f"id {kind['id']}, cost {kind['cost']}, place int")
