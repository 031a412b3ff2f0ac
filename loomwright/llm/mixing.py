"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks of words, then a seeded choice of blocks.

Everything is DataFrame code. Sources are dealt into shards of about ``SHARD_ROWS`` documents by a seeded hash of the id,
so a source with a third of all rows is many small windows. Only rows per source and per shard meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SHARD_ROWS = 8192
LEAST_BLOCKS = 1 << 17
BLOCKS_PER_SHARD = 64
#: A block is at most this part of the smallest target above 0, so that rounding costs no source more than about a thousandth.
BLOCKS_PER_SOURCE = 1000
SEED = "mix-1"


def seeded(*parts: Column) -> Column:
    """60 pseudo-random bits of the parts (nulls count as the word null)."""
    joined = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def apportion(units: DataFrame, keys: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """Sainte-Laguë: give each key's ``seats`` to its units by the highest quotients ``weight / (2 * k - 1)``.

    Adds ``quota``. Seats that surely belong to a unit are counted in closed form; only quotients near the cut (at most
    two per unit and key on average) become rows and are ranked. Ties go to the smaller ``order``. A key without weight
    gets no seat.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    total, n, w, s = F.sum(weight).over(group), F.count("*").over(group), F.col(weight), F.col(seats)
    scaled = lambda x: F.when(F.col("_total") > 0, F.floor(w * x / F.col("_total") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    sized = units.withColumns({"_total": total.cast("double"), "_n": n})
    sure = sized.withColumns({
        "_base": scaled(F.greatest(s - F.col("_n") / 2, F.lit(0.0))),
        "_top": F.when(w > 0, scaled(s + F.col("_n") / 2) + 1).otherwise(F.lit(0)).cast("long"),
    })
    left = sure.withColumn("_left", s - F.sum("_base").over(group))
    rows = left.filter(F.col("_top") > F.col("_base")).withColumn("_k", F.explode(F.sequence(F.col("_base") + 1, F.col("_top"))))
    best = Window.partitionBy(*keys).orderBy((w / (2 * F.col("_k") - 1)).desc(), *order)
    won = (
        rows.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_left"))
        .groupBy(*keys, *order).agg(F.count("*").alias("_won"))
    )
    on = list(dict.fromkeys([*keys, *order]))
    return (
        left.join(won, on, "left").withColumn("quota", F.col("_base") + F.coalesce("_won", F.lit(0)))
        .drop("_total", "_n", "_base", "_top", "_left", "_won")
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source with its number, size, target words and block quota.

    Weights repeat over the sources in code point order, null last. Targets share ``SHARE`` times all words and stop at
    ``CAP`` times the source; the excess is shared again by weight until no target is above its cap.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    numbered = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumns({
        "weight": F.element_at(weights, ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int")),
        "cap": CAP * F.col("source_size"),
        "budget": SHARE * F.sum("source_size").over(everything),
        "shards": F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD_ROWS)).cast("long"),
    })
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = numbered.withColumns({"_level": level, "_at": F.row_number().over(by_ratio)})
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct("_at", "_level"))
    shared = levels.withColumn("_share", F.min(fits).over(everything)["_level"])
    targets = shared.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("_share") * F.col("weight")), F.col("cap").cast("double")))
    n_blocks = F.greatest(F.lit(LEAST_BLOCKS), BLOCKS_PER_SHARD * F.sum("shards").over(everything))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    fine = F.least(F.floor(F.col("budget") / n_blocks), F.floor(least / BLOCKS_PER_SOURCE))
    cut_up = targets.withColumn("block", F.greatest(F.lit(1), fine).cast("long"))
    seats = cut_up.withColumn("seats", F.floor(F.col("budget") / F.col("block")).cast("long"))
    return apportion(seats, [], "target", "seats", ["source_no"]).select("source", "source_no", "source_size", "shards", "target", "block", F.col("quota").alias("source_quota"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of each.

    A shard's documents stand in seeded order as one ring of words cut into blocks. The shard takes its quota of blocks:
    whole rounds first, then the run of blocks from a seeded block on. So no document exceeds twice its size, a source
    misses its target by rounding only (a block is 1 word or at most a thousandth of the smallest target), and reruns agree. Null texts and empty texts have size 0 and take 0; null
    sources are one source; rows with the same id are separate documents; an empty table gives no rows; other columns
    are not read.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id")).alias("hash")))
    sources = cut(source_targets(sized))
    s = sources.withColumnRenamed("source", "_source")
    dealt = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.col("hash") % F.col("shards"))
    shards = dealt.groupBy("source_no", "shard", "source_quota", "block").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(shards, ["source_no"], "shard_size", "source_quota", ["shard"])
    words = F.least(F.col("quota") * F.col("block"), CAP * F.col("shard_size"))
    size = F.greatest(F.col("shard_size"), F.lit(1))
    plan = quotas.select(
        "source_no", "shard", F.col("shard_size"), F.floor(words / size).alias("rounds"), (words % size).alias("rest"),
        (seeded(F.col("source_no"), F.col("shard")) % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))) * F.col("block")).alias("begin"),
    )
    ring = Window.partitionBy("source_no", "shard").orderBy("hash", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0))).join(plan, ["source_no", "shard"])

    def shared(start: Column, stop: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), stop) - F.greatest(F.col("end") - F.col("size"), start))

    begin, stop = F.col("begin"), F.col("begin") + F.col("rest")
    taken = F.col("rounds") * F.col("size") + shared(begin, stop) + shared(begin - F.col("shard_size"), stop - F.col("shard_size"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
