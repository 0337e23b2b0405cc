"""One ranking from several differently-scaled scores: outranking net flow on percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.scale import heavy_keys, heavy_limit, materialise, numbered, split_by

#: Differences in percentile up to the first do not count; from the second on they count in full.
INDIFFERENCE, PREFERENCE = 0.02, 0.25


def net_of(x: Column, below: list[tuple[Column, Column]], n: Column, q: float, p: float) -> tuple[Column, Column]:
    """(net flow of percentile x among n, summed strengths of others over it); below: (count, sum) of the percentiles up to x-p, x-q, x+q, x+p."""
    (c1, s1), (c2, s2), (c3, s3), (c4, s4) = below
    plus = c1 + ((c2 - c1) * (x - q) - (s2 - s1)) / (p - q)
    minus = (n - c4) + ((s4 - s3) - (c4 - c3) * (x + q)) / (p - q)
    return F.when(n > 1, (plus - minus) / (n - 1)).otherwise(F.lit(0.0)).alias("flow"), minus.alias("minus")


def _light(items: DataFrame, q: float, p: float) -> DataFrame:
    """(g, c, item, place, pct, flow, minus) of groups that fit a window: one sort by value gives the count up to each item, and with it place and percentile."""
    key = Window.partitionBy("g", "c")
    fine = key.orderBy(F.asc("value"), F.desc("item"))
    items = items.withColumn("n", F.count(F.lit(1)).over(key)).withColumn("nth", F.row_number().over(fine))
    tie = Window.partitionBy("g", "c", "value")
    pct = (F.min("nth").over(tie) - 1 + F.max("nth").over(tie)) / (2.0 * F.col("n"))
    items = items.select("g", "c", "item", "n", (F.col("n") - F.col("nth") + 1).alias("place"), pct.alias("pct"))
    over = lambda d: f"over (partition by g, c order by pct range between unbounded preceding and {abs(d)!r}D {'preceding' if d < 0 else 'following'})"
    cols = [F.expr(f"coalesce({v} {over(d)}, 0)").alias(f"b{i}{j}") for i, d in enumerate((-p, -q, q, p)) for j, v in enumerate(("count(1)", "sum(pct)"))]
    items = items.select("*", *cols)
    pairs = [(F.col(f"b{i}0"), F.col(f"b{i}1")) for i in range(4)]
    return items.select("g", "c", "item", "place", "pct", *net_of(F.col("pct"), pairs, F.col("n"), q, p))


def _hot(items: DataFrame, q: float, p: float, heavy_rows: int) -> DataFrame:
    """The same for groups of any size: ranks by one range sort, prefix sums by bins of the percentile."""
    numbers = numbered(items.select("g", "c", "value", "item", "rows_in_group"), ["g", "c"], [F.asc("value"), F.desc("item")], "nth")
    blocks = numbers.groupBy("g", "c", "value").agg(F.min("nth").alias("lo"), F.count(F.lit(1)).alias("cnt"), F.max("rows_in_group").alias("rows_in_group"))
    sizes = F.broadcast(blocks.groupBy(F.col("g").alias("sg"), F.col("c").alias("sc")).agg(F.sum("cnt").alias("n")))  # a row for each heavy group
    blocks = blocks.join(sizes, F.col("g").eqNullSafe(F.col("sg")) & (F.col("c") == F.col("sc"))).drop("sg", "sc")
    bins = F.greatest(F.lit(2), F.ceil(2 * F.col("n") / heavy_rows))
    blocks = blocks.select("g", "c", "value", "n", "cnt", ((F.col("lo") - 1 + F.col("cnt") / 2) / F.col("n")).alias("pct"), bins.alias("bins"))
    at = lambda t: F.least(F.greatest(F.floor(t * F.col("bins")), F.lit(0)), F.col("bins") - 1)
    entries = blocks.select("g", "c", at(F.col("pct")).alias("bin"), F.col("pct").alias("t"), "cnt", (F.col("pct") * F.col("cnt")).alias("s"), F.lit(-1).alias("which"), "value")
    asks = blocks.withColumn("which", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    t = F.col("pct") + F.element_at(F.array(*[F.lit(d) for d in (-p, -q, q, p)]), F.col("which") + 1)
    asks = asks.withColumn("t", t).select("g", "c", at(F.col("t")).alias("bin"), "t", F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("s"), "which", "value")
    inside = Window.partitionBy("g", "c", "bin").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    run = entries.unionByName(asks).select("*", F.sum("cnt").over(inside).alias("rc"), F.sum("s").over(inside).alias("rs")).filter(F.col("which") >= 0)
    sums = entries.groupBy("g", "c", "bin").agg(F.sum("cnt").alias("bc"), F.sum("s").alias("bs"))
    # every bin up to the last, so that a probe of an empty one finds what lies before it; groups x bins rows
    every = blocks.groupBy("g", "c").agg(F.max("bins").alias("bins")).select("g", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    sums = every.join(sums.withColumnsRenamed({"g": "xg", "c": "xc", "bin": "xb"}), F.col("g").eqNullSafe(F.col("xg")) & (F.col("c") == F.col("xc")) & (F.col("bin") == F.col("xb")), "left")
    before = Window.partitionBy("g", "c").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("g").alias("xg"), F.col("c").alias("xc"), F.col("bin").alias("xb"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("oc"), F.coalesce(F.sum("bs").over(before), F.lit(0.0)).alias("os"))
    run = run.join(sums, F.col("g").eqNullSafe(F.col("xg")) & (F.col("c") == F.col("xc")) & (F.col("bin") == F.col("xb"))).select("g", "c", "value", "which", (F.col("rc") + F.col("oc")).alias("cc"), (F.col("rs") + F.col("os")).alias("ss"))
    wide = run.groupBy("g", "c", "value").agg(*[F.max(F.when(F.col("which") == i, F.col(v))).alias(f"b{i}{j}") for i in range(4) for j, v in enumerate(("cc", "ss"))])
    same = lambda a, b: F.col(f"{a}g").eqNullSafe(F.col(f"{b}g")) & (F.col(f"{a}c") == F.col(f"{b}c")) & (F.col(f"{a}value") == F.col(f"{b}value"))
    wide = wide.withColumnsRenamed({"g": "xg", "c": "xc", "value": "xvalue"})
    pairs = [(F.col(f"b{i}0"), F.col(f"b{i}1")) for i in range(4)]
    # a row for each distinct score, read three times below
    flows = blocks.join(wide, same("", "x")).select(F.col("g").alias("yg"), F.col("c").alias("yc"), F.col("value").alias("yvalue"), "n", "pct", "cnt", *net_of(F.col("pct"), pairs, F.col("n"), q, p))
    flows = materialise(flows)
    # a score shared by very many is one row here: such rows (at most 1000) are broadcast, the rest meet by shuffle
    big = F.broadcast(flows.filter(F.col("cnt") > heavy_rows // 10).orderBy(F.desc("cnt"), "yc", "yvalue").limit(1000))
    place = (F.col("n") - F.col("nth") + 1).alias("place")
    keys = [F.col("g").eqNullSafe(F.col("zg")) & (F.col("c") == F.col("zc")) & (F.col("value") == F.col("zvalue"))][0]
    named = big.select(F.col("yg").alias("zg"), F.col("yc").alias("zc"), F.col("yvalue").alias("zvalue"))
    rest = flows.join(named, F.col("yg").eqNullSafe(F.col("zg")) & (F.col("yc") == F.col("zc")) & (F.col("yvalue") == F.col("zvalue")), "left_anti")
    common = numbers.join(big, same("", "y")).select("g", "c", "item", place, "pct", "flow", "minus")
    return common.unionByName(numbers.join(named, keys, "left_anti").join(rest, same("", "y")).select("g", "c", "item", place, "pct", "flow", "minus"))


def net_flow(
    df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None,
    indifference: float = INDIFFERENCE, preference: float = PREFERENCE, heavy_rows: int | None = None, ranked: bool = True,
) -> DataFrame:
    """Rank the items of each group by weighted net flow: (group, item, net, rank, place_1.., flow_1.., minus_1..).

    `df` holds one row an item and group, with a column for each score, higher being better. Within a group each score becomes
    a percentile (ties share the middle one). Item a is preferred to b by a score with strength 0 up to a difference of
    `indifference`, 1 from `preference` on, linear between; flow = mean strength over others minus mean strength of others over
    it. Without `ranked` the last column, rank, is left out. The net is the weighted mean of the flows; a null or NaN score gives flow 0 and takes no part in that score's percentiles.
    place_i is the rank by score i alone (ties by item), minus_i the summed strength of all others over the item by score i; both are null without a score. The last rank orders by (net, item).
    Rows with a null item are dropped, a null group is a group. All sums are exact prefix sums over sorted
    percentiles; no pair is ever formed. Groups of over `heavy_rows` rows (by default a part of a task's fair share of all rows) are sorted by range over all tasks.
    """
    if not 0 <= indifference < preference:
        raise ValueError("0 <= indifference < preference is needed")
    weights = weights or [1.0] * len(scores)
    src = df.select(F.col(group).alias("g"), F.col(item).alias("item"), *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"s{i}") for i, s in enumerate(scores)])
    src = src.filter(F.col("item").isNotNull())

    def wide(rows: DataFrame, method) -> DataFrame:
        """One row an item: its places, flows and net."""
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"s{i}").alias("value")) for i in range(len(scores))])).alias("x")
        long = rows.select("g", "item", *(["rows_in_group"] if "rows_in_group" in rows.columns else []), pairs).select("*", "x.c", "x.value").drop("x").filter(F.col("value").isNotNull())
        every = rows.select("g", "item", F.lit(-1).alias("c"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("pct"), F.lit(0.0).alias("flow"), F.lit(None).cast("double").alias("minus"))
        pick = lambda i, v: F.max(F.when(F.col("c") == i, F.col(v)))
        out = method(long).unionByName(every).groupBy("g", "item").agg(*[pick(i, v).alias(f"{v}_{i + 1}") for v in ("place", "flow", "minus") for i in range(len(scores))])
        net = sum((F.coalesce(F.col(f"flow_{i + 1}"), F.lit(0.0)) * w for i, w in enumerate(weights)), F.lit(0.0)) / float(sum(weights))
        return out.withColumn("net", F.round(net, 9) + 0.0)

    heavy_rows = heavy_rows or heavy_limit(src.count(), df.sparkSession)
    heavy = heavy_keys(src, ["g"], heavy_rows)
    best = [F.desc("net"), F.asc("item")]
    hot, cold = split_by(src, heavy, ["g"]) if heavy is not None else (None, src)
    out = wide(cold, lambda long: _light(long, indifference, preference))
    if ranked:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*best)).cast("long"))
    if hot is not None:
        big = wide(hot, lambda long: _hot(long, indifference, preference, heavy_rows))
        out = out.unionByName(numbered(big, ["g"], best, "rank").select(*out.columns) if ranked else big)
    return out.withColumnsRenamed({"g": group, "item": item})
