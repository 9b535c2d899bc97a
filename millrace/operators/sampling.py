"""Seeded sampling of a taxonomy: apportioning, holdouts, marginals, plan expansion, coherence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import rng
from millrace.functions.text import js_round


#: Vendors that are sent to all tasks; the parts in which more of them meet a region's cells.
BROADCAST_VENDORS, VENDOR_WAYS = 500_000, 8
#: Cells of one kind that meet vendors as one block; those of a kind that are numbered in one task; pairs that a task may make, and tasks.
BLOCK_CELLS, NUMBERED_CELLS, TASK_PAIRS, MOST_TASKS = 256, 1 << 15, 50_000_000, 10_000
BUCKETS = 1 << 14


def number_rows(df: DataFrame, draw: str, ties: Sequence[str], name: str) -> DataFrame:
    """Numbers rows from 0 in order of a uniform draw in [0, 1), without one task that sorts all.

    Rows go to equal ranges of the draw; a range's offset is the count of rows
    before it (``BUCKETS`` rows at most, so they can be sent to all tasks).
    """
    d = df.withColumn("_bucket", F.floor(F.col(draw) * BUCKETS).cast("int"))
    sizes = d.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    w = W.partitionBy("_bucket").orderBy(draw, *ties)
    numbered = d.withColumn("_rn", F.row_number().over(w) - 1).join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn(name, F.col("_rn") + F.col("_offset")).drop("_bucket", "_rn", "_offset")


def apportion(df: DataFrame, weight: str, order: str, total: int, floor: int = 0) -> DataFrame:
    """Whole shares of ``total`` by largest remainders, at least ``floor`` each.

    ``df`` has one row per stratum, few by nature.  Overshoot from the floor is
    taken from the largest shares one unit at a time, in closed form: shares are
    cut down to a common ceiling, and what is left over goes back in order.
    """
    every = W.partitionBy()
    share = F.col(weight) * total / F.sum(weight).over(every)
    d = df.withColumn("_exact", F.when(F.sum(weight).over(every) > 0, share).otherwise(F.lit(0.0))).withColumn("_base", F.greatest(F.floor("_exact").cast("long"), F.lit(floor).cast("long")))
    d = d.withColumn("_rest", F.lit(total) - F.sum("_base").over(every)).withColumn("_n", F.count("*").over(every))
    d = d.withColumn("_rn", F.row_number().over(W.orderBy((F.col("_exact") - F.floor("_exact")).desc(), order)))
    up = F.when(F.col("_rest") >= F.col("_rn"), F.floor((F.col("_rest") - F.col("_rn")) / F.col("_n")) + 1).otherwise(0)
    d = d.withColumn("share", (F.col("_base") + up).cast("long"))
    if floor > 0:
        # the highest ceiling c >= floor whose capped sum fits; then rows at c get one more, last row first
        over = d.where("_rest < 0").agg(F.collect_list("share").alias("s")).select(F.expr(f"""
            aggregate(sequence(0, 62), named_struct('lo', cast({floor} as bigint), 'hi', coalesce(array_max(s), cast({floor} as bigint))), (a, i) ->
              if(a.lo >= a.hi, a, if(aggregate(s, 0L, (t, x) -> t + least(x, (a.lo + a.hi + 1) div 2)) <= {total},
                named_struct('lo', (a.lo + a.hi + 1) div 2, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi + 1) div 2 - 1)))).lo""").alias("_cap"))
        d = d.withColumn("_one", F.lit(1)).join(F.broadcast(over.withColumn("_one", F.lit(1))), "_one")
        capped = F.least(F.col("share"), F.col("_cap"))
        spare = F.lit(total) - F.sum(capped).over(every)
        late = F.row_number().over(W.orderBy((F.col("share") > F.col("_cap")).desc(), F.desc(order)))
        lift = (F.col("share") > F.col("_cap")) & (late <= spare)
        d = d.withColumn("share", F.when(F.col("_rest") < 0, capped + F.when(lift, 1).otherwise(0)).otherwise(F.col("share")).cast("long"))
    return d.select(*df.columns, "share")


def seeded(key: str, seed: int) -> Column:
    """The uniform draw of a row's key."""
    return rng.draw(F.col(key).cast("long").bitwiseXOR(F.lit(seed).cast("long")), F.lit(1))


def stratified_holdout(df: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """Marks about ``share`` of each stratum (one at least, one less than all at most), in order of a seeded draw.

    No stratum is sorted as a whole: a histogram of the draws finds the range in
    which a stratum's quota ends, and only the rows of that range are ordered.
    Rows with equal keys go to one side together.
    """
    d = df.select(F.col(stratum).alias("_s"), F.col(key).alias("_key"), seeded(key, seed).alias("_draw")).withColumn("_bucket", F.floor(F.col("_draw") * BUCKETS).cast("int"))
    sizes = d.groupBy("_s", "_bucket").agg(F.count("*").alias("_size"))  # BUCKETS rows a stratum at most
    n = sizes.groupBy("_s").agg(F.sum("_size").alias("_n"))
    quota = F.greatest(F.lit(0), F.least(F.greatest(F.lit(1), js_round(F.col("_n") * share)), F.col("_n") - 1))
    through = F.sum("_size").over(W.partitionBy("_s").orderBy("_bucket"))
    run = sizes.withColumn("_through", through).alias("x").join(n.select("_s", quota.alias("_quota")).alias("y"), F.col("x._s").eqNullSafe(F.col("y._s"))).select("x.*", "_quota")
    edge = run.where((F.col("_through") >= F.col("_quota")) & (F.col("_through") - F.col("_size") < F.col("_quota"))).select("_s", "_bucket", (F.col("_quota") - F.col("_through") + F.col("_size")).alias("_left"))
    rows = d.alias("x").join(edge.alias("y"), F.col("x._s").eqNullSafe(F.col("y._s")) & (F.col("x._bucket") == F.col("y._bucket"))).select("x._s", "_draw", "_key", "_left")
    last = rows.withColumn("_at", F.row_number().over(W.partitionBy("_s").orderBy("_draw", "_key"))).where("_at = _left").select("_s", F.struct("_draw", "_key").alias("_last"))
    j = df.join(last, df[stratum].eqNullSafe(last["_s"]), "left")
    held = F.struct(seeded(key, seed).alias("_draw"), F.col(key).alias("_key")) <= F.col("_last")
    return j.withColumn("split", F.when(held, "eval_iid").otherwise("train")).drop("_s", "_last")


def compositional_holdout(df: DataFrame, axes: Sequence[str], key: str, share: float, seed: int) -> DataFrame:
    """Rows whose combination of axis values is the only one while each value occurs elsewhere, up to a share of all.

    Counts are those of the input; every chosen row lowers a value's count, so
    where all rows of a value could be chosen the last of them in order of the
    draw stays out. Values are counted, never sorted.
    """
    sig = F.concat_ws("|", *axes)
    n = df.agg(F.count("*").alias("_all")).withColumn("_one", F.lit(1))
    combos = df.groupBy(sig.alias("_sig")).agg(F.count("*").alias("_same"))
    d = df.withColumn("_sig", sig).join(combos, "_sig")
    for a in axes:
        d = d.join(df.groupBy(a).agg(F.count("*").alias(f"_n_{a}")), a)
    ok = F.col("_same") == 1
    for a in axes:
        ok = ok & (F.col(f"_n_{a}") > 1)
    d = d.withColumn("_draw", seeded(key, seed)).withColumn("_ok", ok)
    place = F.struct("_draw", key)
    for a in axes:  # at least one row of the value stays
        free = d.where("_ok").groupBy(a).agg(F.count("*").alias("_free"), F.max(place).alias("_late"))
        d = d.join(free, a, "left").withColumn("_ok", F.col("_ok") & ~((F.col("_free") == F.col(f"_n_{a}")) & (place == F.col("_late")))).drop("_free", "_late")
    chosen = number_rows(d.where("_ok"), "_draw", [key], "_place").withColumn("_one", F.lit(1))
    chosen = chosen.join(F.broadcast(n), "_one").where(F.col("_place") < js_round(F.col("_all") * share)).select(F.col(key).alias("_held"))
    return df.join(chosen, df[key] == chosen["_held"], "left").withColumn("split", F.when(F.col("_held").isNotNull(), "eval_compositional").otherwise("train")).drop("_held")


def token_holdout(df: DataFrame, surfaces: Column, held: Sequence[str]) -> DataFrame:
    """Rows that carry any held-out token go to eval_compositional."""
    return df.withColumn("split", F.when(F.arrays_overlap(surfaces, F.array(*map(F.lit, held))), "eval_compositional").otherwise("train"))


def backstop(df: DataFrame, group: str, key: str, held: str, least: int) -> DataFrame:
    """Moves rows back to train, in order of their key, until each group has ``least`` there; rows marked ``held`` stay out.

    Only the rows a group may move are ordered, and only in groups that are short.
    """
    train = df.groupBy(group).agg(F.count(F.when(F.col("split") == "train", 1)).alias("_train")).where(F.col("_train") < least)
    short = df.where((F.col("split") != "train") & ~F.col(held)).join(train, group)
    # the first few of each group: a window limit is pushed below the shuffle
    back = short.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(key))).where(F.col("_k") <= least).where(F.col("_k") <= least - F.col("_train")).select(F.col(key).alias("_back"))
    return df.join(back, df[key] == back["_back"], "left").withColumn("split", F.when(F.col("_back").isNotNull(), "train").otherwise(F.col("split"))).drop("_back")


def marginals(df: DataFrame, axis: str, targets: dict[str, float]) -> DataFrame:
    """Realised and target share of each target value, and the difference in percentage points."""
    spark = df.sparkSession
    t = spark.createDataFrame(list(targets.items()), f"{axis} string, target double")
    n = df.groupBy(axis).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))
    j = t.join(n, axis, "left").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("_all")
    return j.select(axis, F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "target", ((share - F.col("target")) * 100).alias("delta_pp"))


def expand_plan(cells: DataFrame, key: str, rows: str, seed: int, limit: int | None = None) -> DataFrame:
    """Each cell as often as its rows, in a seeded order, numbered from 0; ``limit`` is the plan's length."""
    each = cells.where(F.col(rows) >= 1).select(key, F.explode(F.sequence(F.lit(1), F.col(rows).cast("int"))).alias("copy"))
    draw = rng.draw(F.lit(seed).cast("long").bitwiseXOR(F.col(key).cast("long")), F.col("copy"))
    d = each.withColumn("_draw", draw)
    return number_rows(d, "_draw", [key, "copy"], "plan_index").where(F.lit(True) if limit is None else F.col("plan_index") < limit).drop("_draw")


def shuffle_small(items: Sequence, seed: int) -> list:
    """The exact seeded Fisher-Yates order of a short list (driver side)."""
    state, out = seed & 0xFFFFFFFF, list(items)
    for i in range(len(out) - 1, 0, -1):
        state = (state + rng.STEP) & rng.MASK
        out[i], out[j] = out[(j := int(_number(state) * (i + 1)) % (i + 1))], out[i]
    return out


def _number(t: int) -> float:
    x = (t ^ t >> 15) * (1 | t) & rng.MASK
    x ^= x + (x ^ x >> 7) * (61 | x) & rng.MASK
    return (x ^ x >> 14) / 4294967296


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per row and rule broken: a single scan, no union."""
    hit = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in rules.items())))
    return df.select(key, F.explode(hit).alias("rule"))


def vendors_for(cells: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendors whose range overlaps a cell's band and whose polarity fits; those of the cell's rail if there are any.

    Whether there are any is found for each kind of cell and, where a ``cell_id``
    has several, settled on the cells. Cells of one kind then meet vendors in
    blocks of ``BLOCK_CELLS``; pairs, which grow with the product of both tables,
    are made from them last and never shuffled. A vendor's pairs with a block
    follow each other and the next vendor repeats the same cells, so that written
    pairs take little room. More than ``BROADCAST_VENDORS`` vendors meet the
    blocks by a shuffle of both, each region in parts.
    """
    fits = (F.col("lo") < F.col("band_hi")) & (F.col("band_lo") < F.col("hi") + 1) & ((F.col("polarity") == "any") | (F.col("polarity") == F.col("direction")))
    small = vendors.limit(BROADCAST_VENDORS + 1).count() <= BROADCAST_VENDORS
    kind = ["region", "band_lo", "band_hi", "direction", "rail"]
    kinds = cells.groupBy(*kind).agg(F.count("*").alias("_n"))
    rails = kinds.join(F.broadcast(vendors) if small else vendors, F.col("region") == F.col("v_region")).where(fits).groupBy(*kind, "_n").agg(F.max(F.col("rail") == F.col("v_rail")).alias("_any"))
    rails = rails.select(*(F.col(c).alias(f"_{c}") for c in kind), "_any", "_n")
    same = F.lit(True)
    for c in kind:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    led = cells.join(rails, same, "left").withColumn("_any", F.max("_any").over(W.partitionBy("cell_id"))).drop(*(f"_{c}" for c in kind))
    # a kind without _n has no vendor that fits
    led = led.where(F.col("_any").isNotNull() & F.col("_n").isNotNull()).withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.ceil(F.col("_n") / NUMBERED_CELLS)))
    own, key = [c for c in cells.columns if c not in kind], [*kind, "_any", "_part"]
    order = F.xxhash64(*(c for c, t in cells.dtypes if "map<" not in t))  # rows that tie are alike
    led = led.withColumn("_block", F.floor((F.row_number().over(W.partitionBy(*key).orderBy("cell_id", order)) - 1) / BLOCK_CELLS))
    blocks = led.groupBy(*key, "_block").agg(F.collect_list(F.struct(*own)).alias("_cells"))
    # a vendor is met by its rail, by cells that have any there, and without it, by those that have none
    ways = 1 if small else VENDOR_WAYS
    if small:
        blocks = blocks.repartitionByRange(_tasks(cells, vendors), *key, "_block")
    blocks = blocks.withColumn("_on", F.when(F.col("_any"), F.col("rail"))).withColumn("_way", F.pmod(F.xxhash64(*key, "_block"), F.lit(ways)))
    met = vendors.withColumn("_met", F.explode(F.array(F.struct(F.lit(True).alias("by"), F.col("v_rail").alias("on")), F.struct(F.lit(False).alias("by"), F.lit(None).cast(vendors.schema["v_rail"].dataType).alias("on")))))
    met = met.withColumn("_by", F.col("_met.by")).withColumn("_v_on", F.col("_met.on")).drop("_met").withColumn("_v_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    met = F.broadcast(met) if small else met.hint("merge")
    at = (F.col("region") == F.col("v_region")) & (F.col("_any") == F.col("_by")) & F.col("_on").eqNullSafe(F.col("_v_on")) & (F.col("_way") == F.col("_v_way"))
    pairs = blocks.join(met, at).where(fits).withColumn("on_rail", F.col("rail") == F.col("v_rail")).withColumn("_cell", F.explode("_cells"))
    return pairs.select(*(F.col(c) if c in kind else F.col("_cell")[c].alias(c) for c in cells.columns), *vendors.columns, "on_rail")


def _tasks(cells: DataFrame, vendors: DataFrame) -> int:
    """Tasks that make all pairs, by the most pairs that the regions can have."""
    by = cells.groupBy("region").count().alias("x").join(vendors.groupBy("v_region").count().alias("y"), F.col("region") == F.col("v_region"))
    most = by.agg(F.sum(F.col("x.count").cast("double") * F.col("y.count"))).first()[0] or 0
    return int(min(MOST_TASKS, max(2 * cells.sparkSession.sparkContext.defaultParallelism, most // TASK_PAIRS + 1)))
