"""Computations in which a row's fate depends on the rows accepted before it, in parallel.

No group is read by one task: acceptance goes in rounds over keys, chunks by blocks of
rows whose entries and exits are composed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kiteloom.operators.ranking import global_rank
from kiteloom.sources.stages import published

#: Rows of a block of a group.
BLOCK = 1024


def accepted(rows: DataFrame, group: str, order: str, keys: Sequence[str]) -> DataFrame:
    """``group``, ``order`` and ``keys`` of the rows that share no key with a row accepted before them.

    Rows are taken in ``order``, unique within a group (neither is null), and only accepted ones count. In a
    round a row is accepted if no undecided row before it has one of its keys, and whatever
    shares a key with it is out; so a round costs a minimum and two joins a key over what
    is undecided, and no pair of rows is formed. In random order the rounds grow with the
    logarithm of the rows. A null key is nobody else's.
    """
    undecided = published(rows.select(group, order, *keys), "undecided")
    taken = None
    while True:
        first = undecided
        for k in keys:
            least = undecided.filter(F.col(k).isNotNull()).groupBy(group, k).agg(F.min(order).alias(f"least_{k}"))
            first = first.join(least, [group, k], "left").filter(F.col(k).isNull() | (F.col(order) == F.col(f"least_{k}"))).drop(f"least_{k}")
        winners = published(first.select(group, order, *keys), "winners")
        taken = winners if taken is None else taken.unionByName(winners)
        rest = undecided.join(winners.select(group, order), [group, order], "left_anti")
        for k in keys:
            rest = rest.join(winners.select(group, k), [group, k], "left_anti")
        undecided = published(rest.select(group, order, *keys), "undecided")
        if undecided.isEmpty():
            return taken


def two_key_dedupe(rows: DataFrame) -> DataFrame:
    """grp, id of rows whose key_a and key_b both are new among the accepted ones, by id."""
    return accepted(rows, "grp", "id", ["key_a", "key_b"]).select("grp", "id")


def interleave(rows: DataFrame) -> DataFrame:
    """grp, id, place: kinds in turn, the one with most left that wasn't just placed.

    Ties go to the lesser kind; a kind follows itself only where no other is left. The
    order of kinds needs just their counts, so these are what a group's fold sees; the
    rows then take their places by rank within kind.
    """
    counts = rows.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("kinds"))

    @F.udtf(returnType="kind string, nth int, place int")
    class Order:
        def eval(self, kinds):
            left, used, last = {r["kind"]: r["n"] for r in kinds}, {}, None
            for place in range(1, sum(left.values()) + 1):
                best = min((k for k, n in left.items() if n and k != last), key=lambda k: (-left[k], k), default=last)
                left[best] -= 1
                used[best] = used.get(best, 0) + 1
                last = best
                yield best, used[best], place

    spark = rows.sparkSession
    spark.udtf.register("interleave_order", Order)
    lists.createOrReplaceTempView("interleave_counts")
    order = spark.sql("SELECT grp, o.kind, o.nth, o.place FROM interleave_counts, LATERAL interleave_order(kinds) o")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("grp", "kind").orderBy("id")))
    return ranked.join(order, ["grp", "kind", "nth"]).select("grp", "id", "place")


def paper_guard(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """paper, id, reason: the first reason a row is refused, null where it is accepted.

    ``rows``: paper, id, stem, answer (null where it isn't to be compared), numeric (else
    digits with one point at most are) and planned (the paper's size; null: no limit). A row is refused for a stem that was
    accepted before, an answer that was, or a numeric answer beyond max(1, ceil(share *
    planned)) of them; only accepted rows count. Until the limit is reached it changes
    nothing, so a first run without it shows at which row that is, and a second run leaves
    out the numeric rows after that row.
    """
    numeric = F.col("numeric") if "numeric" in rows.columns else F.col("answer").rlike("^(?=.*[0-9])[0-9]*[.]?[0-9]*$")
    rows = rows.withColumn("numeric", F.coalesce(numeric & F.col("answer").isNotNull(), F.lit(False)))
    free = accepted(rows, "paper", "id", ["stem", "answer"]).select("paper", "id")
    limit = F.greatest(F.lit(1), F.ceil(F.col("planned") * share))
    counted = rows.filter("numeric AND planned IS NOT NULL").join(free, ["paper", "id"]).select("paper", "id", limit.alias("limit"))
    nth = F.row_number().over(Window.partitionBy("paper").orderBy("id"))  # a paper's accepted numeric rows
    full = counted.withColumn("nth", nth).filter(F.col("nth") == F.col("limit")).select("paper", F.col("id").alias("full_at"))
    open_rows = rows.join(full, "paper", "left").filter(~F.col("numeric") | F.col("full_at").isNull() | (F.col("id") <= F.col("full_at")))
    held = published(accepted(open_rows, "paper", "id", ["stem", "answer"]), "accepted")
    by = lambda key: held.filter(F.col(key).isNotNull()).select("paper", key, F.col("id").alias(f"{key}_of"))
    told = rows.join(by("stem"), ["paper", "stem"], "left").join(by("answer"), ["paper", "answer"], "left").join(held.select("paper", "id", F.lit(True).alias("kept")), ["paper", "id"], "left")
    reason = F.when(F.col("kept"), F.lit(None)).when(F.col("stem_of") < F.col("id"), "duplicate_stem").when(F.col("answer_of") < F.col("id"), "repeated_answer").otherwise("numeric_cap")
    return told.select("paper", "id", reason.alias("reason"))


def _composed(first: Column, then: Column) -> Column:
    """The map of two runs of rows, one after the other: entry -> (entry of what follows, chunks begun)."""
    return F.transform(first, lambda a: F.struct(F.get(then, a["to"])["to"].alias("to"), (a["n"] + F.get(then, a["to"])["n"]).alias("n")))


def budget_chunks(rows: DataFrame, budget: int, most: int) -> DataFrame:
    """grp, id, chunk: rows in order, a new chunk when size or number would go over.

    A chunk has ``most`` rows at most, so it can enter a block of rows only at one of its
    first ``most`` rows. Each block maps such entries to the next block's and counts the
    chunks begun; maps are composed by doubling over the blocks of a group, and then each
    block numbers its own rows. Blocks are arrays of bounded size, all in the JVM.
    """
    ranked = global_rank(rows.select("grp", "id", "size"), ["grp", "id"], "nth")
    starts = ranked.groupBy("grp").agg(F.min("nth").alias("start"))
    placed = ranked.join(starts, "grp").withColumn("i", F.col("nth") - F.col("start"))
    block, within = F.floor(F.col("i") / BLOCK), (F.col("i") % BLOCK).cast("int")
    # the rows that a chunk may reach from the block before stand in both
    spread = placed.select("grp", "id", "size", within.alias("at"), F.explode(F.when((within < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"), block.alias("own"))
    item = F.struct((F.col("at") + F.when(F.col("own") == F.col("block"), 0).otherwise(BLOCK)).alias("at"), "id", "size")
    arrays = spread.groupBy("grp", "block").agg(F.sort_array(F.collect_list(item)).alias("rows"))

    def reach(i: Column) -> Column:
        """Rows of a chunk that begins at row ``i`` of the block."""
        begin = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(s: Column, x: Column) -> Column:
            fits = s["open"] & ((s["n"] == 0) | (s["size"] + x["size"] <= budget))
            return F.struct((s["size"] + x["size"]).alias("size"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.aggregate(F.slice("rows", i + 1, most), begin, add, lambda s: s["n"])

    own = F.filter("rows", lambda x: x["at"] < BLOCK)
    blocks = published(arrays.select("grp", "block", F.transform(own, lambda x, i: F.struct(x["id"].alias("id"), x["at"].alias("at"), (x["at"] + reach(i)).alias("next"))).alias("rows")), "chunk-blocks")

    def through(entry: Column) -> Column:
        walk = lambda s, x: F.when(x["at"] == s["to"], F.struct(x["next"].alias("to"), (s["n"] + 1).alias("n"))).otherwise(s)
        last = lambda s: F.struct(F.greatest(s["to"] - BLOCK, F.lit(0)).alias("to"), s["n"].alias("n"))
        return F.aggregate("rows", F.struct(entry.alias("to"), F.lit(0).cast("long").alias("n")), walk, last)

    last, step = blocks.agg(F.max("block")).first()[0] or 0, 1
    nowhere = F.lit(None).cast("struct<to:int,n:bigint>")
    entered = blocks.withColumn("entry", nowhere)
    if last:  # some group goes on beyond its first block
        maps = published(blocks.select("grp", "block", F.transform(F.sequence(F.lit(0), F.lit(most - 1)), through).alias("map")), "chunk-maps")
        while step <= last:
            before = maps.select("grp", (F.col("block") + step).alias("block"), F.col("map").alias("before"))
            joined = maps.join(before, ["grp", "block"], "left")
            maps = published(joined.select("grp", "block", F.when(F.col("before").isNull(), F.col("map")).otherwise(_composed(F.col("before"), F.col("map"))).alias("map")), "chunk-maps")
            step *= 2
        entered = blocks.join(maps.select("grp", (F.col("block") + 1).alias("block"), F.get("map", F.lit(0)).alias("entry")), ["grp", "block"], "left")
    begin = F.struct(F.coalesce(F.col("entry.to"), F.lit(0)).alias("to"), (F.coalesce(F.col("entry.n"), F.lit(0).cast("long")) - 1).alias("chunk"), F.array().cast("array<bigint>").alias("out"))

    def number(s: Column, x: Column) -> Column:
        opens = x["at"] == s["to"]
        chunk = s["chunk"] + opens.cast("long")
        return F.struct(F.when(opens, x["next"]).otherwise(s["to"]).alias("to"), chunk.alias("chunk"), F.concat(s["out"], F.array(chunk)).alias("out"))

    numbered = entered.select("grp", "rows", F.aggregate("rows", begin, number, lambda s: s["out"]).alias("chunks"))
    opened = numbered.select("grp", F.explode(F.arrays_zip(F.col("rows.id").alias("id"), F.col("chunks").alias("chunk"))).alias("r"))
    return opened.select("grp", "r.id", F.col("r.chunk").cast("int").alias("chunk"))
