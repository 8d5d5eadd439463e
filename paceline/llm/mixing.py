"""Mixing of sources to target shares, with sizes in tokens.

1. Every source's texts are laid out as one token stream in pseudorandom order (by hash) and packed
   into the least number of blocks that hold at most ``block`` tokens each; the blocks of a source are
   equally long up to one token, so that each slot of a source is worth the same. Stream positions come
   from a prefix sum over hash buckets (as many as the rows ask for) and a running sum inside each
   bucket, so no source is ever gathered in one task.
2. ``plan`` gives each source its number of blocks. Without a given total it is the largest one at
   which every source that has tokens meets its target; with a given total, sources that would need
   more repeats than allowed are held at their cap and the rest share what is missing in proportion.
   The total ``SOURCES`` is the tokens of all sources that may take part, so no scarce one sets it.
3. The slots of all sources stand one source after another; one pseudorandom permutation of them deals
   them to output shards of ``shard_blocks`` slots. So the counts of the sources in the shards are
   multinomial draws without replacement, and add up exactly to the plan; no task and no driver ever
   holds a table of them.
4. The j-th slot of a source takes block perm(j mod N) of its repeat j div N, where perm is a
   pseudorandom permutation of the N blocks, another one for each repeat. Slots and blocks are joined
   by source and block index.

Documents of null or unlisted sources and targets without documents take no part; a null or zero
share or repeat count counts as 0. Texts that are null or empty have no tokens.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm import bpe
from paceline.plans.lineage import store

#: Rows that a hash bucket of one source is meant to hold.
BUCKET_ROWS = 2048
SOURCES = "sources"
#: Steps of a cycle walk: the domain has at most 2 sqrt(n) + 1 places more than n.
WALK = 24


def plan(tokens: np.ndarray, shares: np.ndarray, repeats: np.ndarray, total: float | None = None) -> np.ndarray:
    """Tokens to take of each source: as near to ``shares`` as ``repeats`` of its tokens allow."""
    cap = tokens * repeats
    want = np.where(cap > 0, shares, 0.0)
    if want.sum() <= 0:
        return np.zeros(len(tokens))
    want = want / want.sum()
    if total is None:
        total = np.min(cap[want > 0] / want[want > 0])
    take, open_ = np.zeros(len(tokens)), want > 0
    while open_.any():
        left = total - take.sum()
        offer = np.where(open_, left * want / want[open_].sum(), 0.0)
        full = open_ & (offer > cap)
        if not full.any():
            return take + offer
        take[full] = cap[full]
        open_ &= ~full
    return take


def largest_remainders(amounts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole numbers that add up to the rounded sum of ``amounts``, none above ``most``."""
    whole = np.minimum(np.floor(amounts + 1e-9).astype(np.int64), most)
    for i in np.argsort(-(amounts - whole), kind="stable")[: max(0, round(amounts.sum()) - int(whole.sum()))]:
        whole[i] += whole[i] < most[i]
    return whole


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Position of i in a pseudorandom permutation of 0..n-1: rounds that shift the column of a square grid of
    just more than n places by a hash of the row and the other way round; a place beyond n goes on."""
    side = F.ceil(F.sqrt(F.greatest(n, F.lit(1)).cast("double"))).cast("long")

    def bound(p: Column) -> Column:
        def rounds(place: Column) -> Column:
            def shifted(s: Column, r: Column) -> Column:
                return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], r, p["key"]), p["side"]), p["side"]).alias("b"))

            start = F.struct(F.floor(place / p["side"]).cast("long").alias("a"), F.pmod(place, p["side"]).alias("b"))
            return F.aggregate(F.array(*map(F.lit, range(4))), start, shifted, lambda s: s["a"] * p["side"] + s["b"])

        # up to n = 81 the walk is sure to end; beyond, each step ends it with a chance of 4 in 5 at least
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(p["i"]), lambda x, _: F.when(x < p["n"], x).otherwise(rounds(x)))

    return bpe.let(F.struct(i.cast("long").alias("i"), n.cast("long").alias("n"), side.alias("side"), key.alias("key")), bound)


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient; the dividend is made a multiple first, so that rounding can't reach the next one."""
    return F.round((a - F.pmod(a, b)) / b).cast("long")


def pack(coded: DataFrame, block: int, seed: int) -> DataFrame:
    """(source, block, n_tokens, docs, ids) of rows (source, doc, n, ids): the token stream of each source in
    blocks. ``docs`` names the documents in a block with the number of their tokens."""
    buckets = 1 << max(0, -(-coded.count() // BUCKET_ROWS) - 1).bit_length()
    order = F.xxhash64("source", "doc", F.xxhash64("ids"), F.lit(seed))
    placed = coded.withColumn("_o", order).withColumn("_b", F.pmod("_o", F.lit(buckets)))
    # two levels of prefix sums: buckets in groups of about the square root of their number
    group = F.floor(F.col("_b") / (1 << (buckets.bit_length() // 2)))
    sums = placed.groupBy("source", "_b").agg(F.sum("n").alias("s")).withColumn("_g", group)
    groups = sums.groupBy("source", "_g").agg(F.sum("s").alias("g"))
    whole = F.sum("g").over(W.partitionBy("source"))
    groups = groups.select("source", "_g", whole.alias("whole"), (F.sum("g").over(W.partitionBy("source").orderBy("_g")) - F.col("g")).alias("first"))
    inner = F.sum("s").over(W.partitionBy("source", "_g").orderBy("_b")) - F.col("s")
    before = sums.withColumn("inner", inner).join(groups, ["source", "_g"]).select("source", "_b", "whole", (F.col("first") + F.col("inner")).alias("before"))
    running = F.sum("n").over(W.partitionBy("source", "_b").orderBy("_o", "doc").rowsBetween(W.unboundedPreceding, -1))
    placed = placed.withColumn("inside", F.coalesce(running, F.lit(0))).join(before, ["source", "_b"]).withColumn("at", F.col("before") + F.col("inside"))
    # the first ``long`` of k blocks have base + 1 tokens, the others base
    k = F.ceil(F.col("whole") / block).cast("long")
    base, long = F.expr("whole div k"), F.expr("whole % k")
    of = lambda t: F.when(t < long * (base + 1), _div(t, base + 1)).otherwise(long + _div(t - long * (base + 1), base))
    start_of = lambda b: b * base + F.least(b, long)
    first, last = of(F.col("at")), of(F.col("at") + F.col("n") - 1)
    parts = placed.withColumn("k", k).select("source", "doc", "at", "n", "ids", "whole", "k", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), start_of(F.col("block")) - F.col("at"))
    end = F.least(F.col("n"), start_of(F.col("block") + 1) - F.col("at"))
    part = F.struct((F.col("at") + start).alias("at"), F.col("doc"), (end - start).cast("int").alias("n"), F.slice("ids", (start + 1).cast("int"), (end - start).cast("int")).alias("ids"))
    blocks = parts.select("source", "block", part.alias("part")).groupBy("source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return blocks.select(
        "source", "block", F.aggregate("parts", F.lit(0), lambda s, x: s + x["n"]).alias("n_tokens"),
        F.transform("parts", lambda x: F.struct(x["doc"].alias("doc_id"), x["n"].alias("n"))).alias("docs"), F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"),
    )


def mixture(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = 256, shard_blocks: int = 4096, total_tokens: float | str | None = None, seed: int = 7, path: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """The mixture, a row for each slot: (shard, slot, source, block, repeat, n_tokens, docs, ids).

    ``targets`` (source, target_share, max_repeats) is a small table: one row for each source, read to
    the driver with the block count of each source; nothing else is."""
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).where("source is not null").orderBy("source").collect()
    wanted = df.where(F.col(source).isin([r.source for r in rows]) & (F.octet_length(text) > 0)).select(F.col(source).alias("source"), F.col(key).alias("doc"), F.col(text).alias("_t"))
    # every text is encoded once: sizes, positions and blocks are made from what is stored
    coded = store(bpe.encode(wanted, "_t", path).select("source", "doc", F.size("ids").cast("long").alias("n"), "ids"))
    blocks = store(pack(coded.where("n > 0"), block, seed))
    size = {r.source: (r.tokens, r.blocks) for r in blocks.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks")).collect()}
    share = np.array([r.share if r.share and math.isfinite(r.share) and r.share > 0 else 0.0 for r in rows])
    repeats = np.array([max(0, r.repeats or 0) for r in rows])
    tokens, count = (np.array([size.get(r.source, (0, 0))[i] for r in rows], dtype=np.int64) for i in (0, 1))
    total = float(tokens[(share > 0) & (repeats > 0)].sum()) if total_tokens == SOURCES else total_tokens
    take = plan(tokens.astype(float), share, repeats, total)
    slots = largest_remainders(take * np.divide(count, tokens, out=np.zeros(len(rows)), where=tokens > 0), count * repeats)
    return slots_of(df.sparkSession, [r.source for r in rows], slots, count, shard_blocks, seed).join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "n_tokens", "docs", "ids")


def slots_of(spark: SparkSession, names: list[str], slots: np.ndarray, blocks: np.ndarray, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, slot, source, block, repeat) of every slot: ``slots`` of them for each source."""
    used = np.flatnonzero(slots)
    if not len(used):
        return spark.createDataFrame([], "shard long, slot long, source string, block long, repeat long")
    total, first = int(slots.sum()), np.cumsum(slots[used]) - slots[used]
    rows = [F.struct(F.lit(int(f)).alias("first"), F.lit(names[i]).alias("source"), F.lit(int(blocks[i])).alias("blocks")) for f, i in zip(first, used)]  # one for each source

    def slot(at: Column) -> Column:
        def of_source(r: Column) -> Column:
            def in_repeat(p: Column) -> Column:
                block = permuted(p["j"] - p["repeat"] * r["blocks"], r["blocks"], F.xxhash64(r["source"], p["repeat"], F.lit(seed)))
                return F.struct(r["source"].alias("source"), block.alias("block"), p["repeat"].alias("repeat"))

            j = at - r["first"]
            return bpe.let(F.struct(j.alias("j"), _div(j, r["blocks"]).alias("repeat")), in_repeat)

        return bpe.let(F.element_at(F.filter(F.array(*rows), lambda r: r["first"] <= at), -1), of_source)

    drawn = bpe.let(permuted(F.col("id"), F.lit(total), F.lit(seed).cast("long")), slot)
    each = spark.range(total).select(F.floor(F.col("id") / shard_blocks).alias("shard"), F.pmod("id", F.lit(shard_blocks)).alias("slot"), drawn.alias("s"))
    # stored, for a filter of the join would draw every slot once more
    return store(each.select("shard", "slot", "s.source", "s.block", "s.repeat"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, repeats): what each source has reached."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").cast("long").alias("tokens"), (F.max("repeat") + 1).cast("long").alias("repeats"))
    whole = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # one row for each source
    out = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(got, "source", "left")
    out = out.fillna(0, ["tokens", "repeats"])
    return out.select("source", "target_share", "max_repeats", "tokens", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6).alias("share"), "repeats")
