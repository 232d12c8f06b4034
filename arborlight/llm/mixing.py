"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources share all words by their weights; none gets more than ``most`` times its own words, and what is over goes
to the others by weight until none is above. The targets are cut into blocks of equal size, and the blocks are seats:
each goes to the source with the highest quotient target / (2 * seats + 1). A source's seats are apportioned to its
shards by the same rule, by the words that they hold. Within a shard the documents stand in a seeded order, their words end to end;
whole passes over it are taken first, and the rest of the quota is a run of blocks from a seeded start.

Shards are hash buckets of bounded size, so a source with a third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlight.llm.common import SPACE_WORD
from arborlight.plans.durable import Scratch


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, weight) with the columns target and votes; one row for each source.

    min(most * size, level * weight) with the level that makes the sum right: sources are capped in order of size / weight. votes are
    the targets times a number that all sources share, as whole numbers (most * all words * all weights must stay below 2^63).
    """
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(most) * F.col("source_size")
    df = sources.withColumn("weight", F.col("weight").cast("long")).withColumns({"_total": F.sum("source_size").over(every), "_weights": F.sum("weight").over(every)})
    df = df.withColumns({"_over": F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0)), "_under": F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the level if all sources before this one are capped and it is not; capping one more than needed only lowers it
    level = F.struct((F.col("_over") / F.col("_under")).alias("level"), "_over", "_under")
    df = df.withColumn("_level", F.max(F.when(F.col("_over") * F.col("weight") <= cap * F.col("_under"), level)).over(every))
    share, whole = F.col("_level._over") * F.col("weight"), cap * F.col("_level._under")
    votes = F.when(F.col("_level").isNull(), cap).otherwise(F.greatest(F.lit(0), F.least(share, whole)))
    target = F.when(F.col("_level").isNull(), cap.cast("double")).otherwise(F.least(F.col("_level.level") * F.col("weight"), cap.cast("double")))
    return df.withColumns({"target": target, "votes": votes}).drop("_total", "_weights", "_over", "_under", "_level")


#: Quotients are compared by their whole part and three more digits in this base, by long division: exact for fewer than 9e9 seats in a row.
_DIGIT = 1_000_000_000


def _apportion(df: DataFrame, votes: Column, seats: Column, group: list[str], key: str) -> DataFrame:
    """Adds seats to each row of a group by the highest quotients votes / (2s + 1); ties to the lesser key, null last.

    votes and seats are columns of whole numbers; seats is equal in a group, whose rows the key tells apart. Rounding votes * rate
    gives the seats that quotients over 1 / (2 * rate) win, and over m rows rounding errs by m / 2 at most. So the rates
    (n - m/2 - 1) / all and (n + m/2 + 1) / all give too few and too many seats. What lies between them, about four quotients a
    row, is ranked, and the highest make up the n. Null and negative votes win nothing; without votes no row does.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    df = df.withColumns({"_v": F.when(votes > 0, votes.cast("long")).otherwise(0), "_n": F.greatest(seats.cast("long"), F.lit(0))})
    df = df.withColumns({"_all": F.sum("_v").over(w).cast("double"), "_half": F.count(F.lit(1)).over(w) / 2 + 1})
    at = lambda n, slack: F.when((F.col("_v") > 0) & (F.col("_n") > 0), F.greatest(F.lit(0), F.floor(F.col("_v") * (n / F.col("_all")) + 0.5).cast("long") + slack)).otherwise(0).cast("long")
    df = df.withColumns({"_low": at(F.greatest(F.lit(0.0), F.col("_n") - F.col("_half")), -1), "_high": at(F.col("_n") + F.col("_half"), 1)})
    df = df.withColumn("_left", F.col("_n") - F.sum("_low").over(w))
    open_ = df.where("_high > _low").select(*group, F.col(key).alias("_key"), "_v", "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_s")).withColumn("_d", 2 * F.col("_s") + 1)
    digits, rest = [], "_v"
    for i in range(4):
        open_ = open_.withColumns({f"_q{i}": F.expr(f"{rest} div _d"), f"_r{i}": F.expr(f"({rest} % _d) * {_DIGIT}")})
        digits.append(F.col(f"_q{i}").desc())
        rest = f"_r{i}"
    best = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    won = open_.withColumn("_place", F.row_number().over(best.orderBy(*digits, F.col("_key").asc_nulls_last()))).where("_place <= _left")
    won = won.groupBy(*group, "_key").agg(F.count(F.lit(1)).alias("_won")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_key", "_won")
    same = F.col(key).eqNullSafe(F.col("_key"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = df.join(won, same, "left").withColumn("seats", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_v", "_n", "_all", "_half", "_low", "_high", "_left", "_key", "_won", *[f"_g{i}" for i in range(len(group))])


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 17,
    shard_rows: int = 4096, block_words: int = 1024, weights: tuple[int, ...] = (1, 2, 3), row_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words taken, repeats counted), passes, first, length and
    wrapped: whole passes; then length words from the word first (from 0) on, and the wrapped first words, once more.

    Sources in code point order, null last, have the weights in turn. Null and empty texts have size 0 and nothing is
    taken of them. Repeated rows are documents of their own that share their place in the seeded order. The shards of a source are apportioned in
    one window of a row for each ``shard_rows`` documents: 4,096 serve up to some 10^10 documents in a source (2.4 million rows); take 65,536 beyond. Blocks have
    ``block_words`` words, or fewer, so that the smallest target still has 100. An empty table gives an empty result; other
    columns are not read. The result depends on ids and sizes alone. ``row_col``, which tells all rows apart, is carried through and
    breaks ties of the order, so that callers can join the plan back where ids are null or repeated.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(row_col).alias("_row")] if row_col else []))
    sized = scratch.save(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    sources = scratch.save(targets(sources, most))
    every = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / 100))).cast("long"))
    sources = _apportion(sources, F.col("votes"), F.floor(F.sum("target").over(every) / F.col("block") + 0.500001), [], "source").withColumnRenamed("seats", "source_seats")
    sources = scratch.save(sources.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")).select("source", "source_size", "target", "block", "source_seats", "shards"))
    keyed = sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "source_size", "target", "block", "source_seats", "shards")
    rows = sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).join(keyed, "key")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards")).cast("int"))
    # written, as later steps read the shards' sizes and seats several times
    shards = scratch.save(rows.groupBy("key", "shard", "block", "source_seats").agg(F.sum("size").alias("shard_size")))
    shards = scratch.save(_apportion(shards, F.col("shard_size"), F.col("source_seats"), ["key"], "shard"))
    blocks = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    shards = shards.select(
        F.concat("key", F.lit("/"), F.col("shard").cast("string")).alias("_k"), "shard_size",
        F.when(F.col("shard_size") > 0, F.least(F.col("seats"), most * blocks)).otherwise(0).alias("quota"), F.greatest(blocks, F.lit(1)).alias("blocks"),
    )
    rows = rows.withColumn("_j", F.concat("key", F.lit("/"), F.col("shard").cast("string"))).join(shards, F.col("_j") == F.col("_k"))
    order = Window.partitionBy("_j").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size", *(["_row"] if row_col else []))
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("lo", end - F.col("size"))
    passes, rest = F.expr("quota div blocks"), F.col("quota") % F.col("blocks")
    start = F.pmod(F.xxhash64("_j", F.lit(seed + 2)), F.col("blocks"))
    # the run of blocks [start, start + rest), going round at the shard's end
    a, b = start * F.col("block"), (start + rest) * F.col("block")
    rows = rows.withColumns({"passes": passes, "a": a, "b": F.least(b, F.col("shard_size")), "c": F.greatest(F.lit(0), (start + rest - F.col("blocks")) * F.col("block"))})
    hi = F.col("lo") + F.col("size")
    main = F.greatest(F.lit(0), F.least(hi, F.col("b")) - F.greatest("lo", "a"))
    round_ = F.greatest(F.lit(0), F.least(hi, F.col("c")) - F.col("lo"))
    rows = rows.withColumns({"_main": main, "_round": round_})
    first = F.when(F.col("_main") > 0, F.greatest("lo", "a") - F.col("lo")).otherwise(0)
    return rows.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("_main") + F.col("_round")).cast("long").alias("taken"),
        F.col("passes").alias("passes"), first.cast("long").alias("first"), F.col("_main").cast("long").alias("length"), F.col("_round").cast("long").alias("wrapped"),
        *([F.col("_row").alias(row_col)] if row_col else []),
    )
