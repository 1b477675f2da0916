"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Written, sent_if_small, word_count

#: Blocks of a source from which documents fill what is left after whole blocks.
FILL_BLOCKS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sizes (source, source_size, n_docs) with target: shares of the sum by weight, none above most times its size.

    Sorted by the share at which a source reaches its limit, those before the first that stays below theirs are at
    their limit, and the rest divide what is left by weight: the fixed point of resharing excess.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))[(F.row_number().over(in_order) - 1) % len(weights)]
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before, onward = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(onward)).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    open_ = F.col("cap") * F.col("w_left") > F.col("left") * F.col("w")
    first = F.min(F.when(open_, F.struct("place", "left", "w_left"))).over(everyone)
    share = F.col("first.left") * F.col("w") / F.col("first.w_left")
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(share.cast("double"))
    return t.withColumn("first", first).select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    shards: int = 16,
    seed: int = 11,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """Every row of docs with struct column mix: size, source_size, target, placements and taken.

    size is a column of docs (its words by default); weights repeat over the sources by code point, a null source
    last. target is the source's share of all words; placements, an array of (pass, shard), has an element for each time
    that the mix takes the document, at most most; taken is size times their number. Every column of docs stays, whatever its name
    but mix. A null text has size 0. Rows with equal id, source and size go
    together. A null id is an id like any other. An empty table gives no rows. The same rows give the same mix, however they are partitioned.

    A source of n documents has about sqrt(n) blocks of as many. Passes that a target holds whole take every block;
    the rest takes whole blocks in permuted order, and then single documents, large ones first, of the next FILL_BLOCKS blocks.
    The blocks drawn are slots. A tree parts them among the shards: each node sends a random half of its
    slots to either side, so its counts by source are multivariate hypergeometric, and shards hold disjoint blocks whose numbers add up
    to each source's quota exactly. Only sums by source and block are shuffled, and a hot source has as many keys as blocks.
    """
    size = word_count(F.col("text")) if size is None else size
    key = [F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size")]
    rows = Written(docs.select(*key), "sizes").df
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    t = source_targets(sums, weights, most)
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")).withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("long"))
    sources = Written(t, "sources").df
    small = sent_if_small(sources)

    def block_of(id_: Column, size_: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), id_, size_), n)

    in_block = rows.alias("r").join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.source", "id", "size", "passes", "rest", block_of(F.col("id"), F.col("size"), F.col("n_blocks")).alias("block"))
    blocks = in_block.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    blocks = blocks.withColumn("sum", F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.col("sum") <= F.col("rest"))
    order = F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(permuted.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("sum"))).over(Window.partitionBy("source")), F.lit(0))
    blocks = blocks.withColumn("fill", order.between(1, FILL_BLOCKS)).withColumn("gap", gap)
    drawn = Written(blocks.select("source", "block", "passes", "whole", "gap", (F.col("fill") & (F.col("gap") > 0)).alias("fill")), "blocks").df

    # documents that fill the gap: of each size as many as still fit, from the largest size down
    open_ = drawn.where("fill").select("source", "block", "gap")
    units = in_block.alias("r").join(sent_if_small(open_).alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block"))).groupBy("r.source", "r.block", "id", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    units = Written(units.withColumn("words", F.col("n") * F.col("size")).where("words > 0 and words < 2 * gap"), "units").df
    classes = units.groupBy("source", "words").agg(F.count("*").alias("n"), F.first("gap").alias("gap")).groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("words", "n")), asc=False).alias("c"))
    start = F.struct(F.col("gap").alias("left"), F.expr("cast(array() as array<struct<words:bigint,take:bigint,n:bigint>>)").alias("taken"))

    def take(state: Column, c: Column) -> Column:
        n = F.least(c["n"], F.floor(state["left"] / c["words"]).cast("long"))
        more = F.concat(state["taken"], F.array(F.struct(c["words"].alias("words"), n.alias("take"), c["n"].alias("n"))))
        return F.struct((state["left"] - n * c["words"]).alias("left"), F.when(n > 0, more).otherwise(state["taken"]).alias("taken"))

    filled = classes.select("source", "c", F.aggregate("c", start, take).alias("f"))
    spent = F.transform(F.filter("f.taken", lambda x: x["take"] == x["n"]), lambda x: x["words"])
    near = F.transform(F.filter("c", lambda x: x["words"] < 2 * F.col("f.left")), lambda x: x["words"])
    nearer = F.array_min(F.array_except(near, spent))  # one more document, if that comes nearer to the target than none
    more = F.when(nearer.isNotNull(), F.array(F.struct(nearer.alias("words"), F.lit(1).cast("long").alias("take"), F.lit(1).cast("long").alias("n"))))
    takes = filled.select("source", F.explode(F.concat("f.taken", F.coalesce(more, F.expr("cast(array() as array<struct<words:bigint,take:bigint,n:bigint>>)")))).alias("x"))
    takes = takes.groupBy("source", "x.words").agg(F.sum("x.take").alias("take"))
    ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy("source", "words").orderBy(F.xxhash64(F.lit(seed + 2), "id", "size"), "id", "size")))
    fills = ranked.alias("u").join(takes.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")) & (F.col("u.words") == F.col("t.words")) & (F.col("rank") <= F.col("take"))).select("u.source", "u.block", "id", "size", F.lit(True).alias("filled"))
    fills = Written(fills, "fills").df

    # the tree: slots of blocks, halved at random level by level
    slots = drawn.select("source", "block", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or whole or fill)")).alias("pass")).withColumn("node", F.lit(0))
    for level in range(max(0, shards - 1).bit_length()):
        half = Window.partitionBy("node").orderBy(F.xxhash64(F.lit(seed + 3), F.lit(level), "source", "block", "pass"), F.col("source").asc_nulls_last(), "block", "pass")
        slots = slots.withColumn("rank", F.row_number().over(half)).withColumn("count", F.count("*").over(Window.partitionBy("node"))).select("source", "block", "pass", F.expr("node * 2 + case when rank * 2 > count then 1 else 0 end").cast("int").alias("node"))
    where = slots.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), (F.col("node") % shards).alias("shard")))).alias("slots"))
    where = where.alias("w").join(drawn.alias("d"), F.col("w.source").eqNullSafe(F.col("d.source")) & (F.col("w.block") == F.col("d.block"))).select("d.source", "d.block", "passes", "whole", "slots")
    where = Written(where, "slots").df

    names = docs.columns
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *key)
    out = out.alias("r").join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("row", "r.source", "id", "size", "source_size", "target", block_of(F.col("id"), F.col("size"), F.col("n_blocks")).alias("block"))
    out = out.alias("r").join(sent_if_small(where).alias("w"), F.col("r.source").eqNullSafe(F.col("w.source")) & (F.col("r.block") == F.col("w.block")), "left").select("row", "r.source", "r.block", "id", "size", "source_size", "target", "passes", "whole", "slots")
    out = out.alias("r").join(sent_if_small(fills).alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.block") == F.col("f.block")) & F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.size") == F.col("f.size")), "left")
    placed = F.coalesce(F.filter("slots", lambda s: (s["pass"] < F.col("passes")) | F.col("whole") | F.coalesce("filled", F.lit(False))), F.expr("cast(array() as array<struct<pass:int,shard:int>>)"))
    out = out.select("row", "r.size", "source_size", "target", placed.alias("placements"))
    mix = F.struct("size", "source_size", "target", "placements", (F.col("size") * F.size("placements")).alias("taken"))
    return out.select("row.*", mix.alias("mix"))


def shuffled(mixed: DataFrame, seed: int = 11, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: a row for each time a document is taken, by shard, in random order inside each."""
    each = mixed.select("*", F.explode("mix.placements").alias("__at"))
    order = F.xxhash64(F.lit(seed + 4), F.col(id_col), F.col("__at.pass"))
    return each.repartition(F.col("__at.shard")).sortWithinPartitions(F.col("__at.shard"), order).drop("__at", "mix")
