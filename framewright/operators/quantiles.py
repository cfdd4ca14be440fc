"""Exact quantiles by rank selection: no buffer grows with a group.

Each quantile needs the values at one or two ranks. A pass counts a group's values in ``BINS`` bins between the least and the
largest; the bin that holds a rank is kept with its own least and largest value, and the next pass looks only at that. Bins
shrink at least ``BINS``-fold a pass, so a few passes leave at most ``FEW`` values, or one value that repeats, and an ordinary
sort of those few finds the rank. Groups that are small from the start are dealt to tasks of a fixed size and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bins of a pass; values that are sorted at once; passes after which something must be wrong (doubles have 64 bits).
BINS, FEW, MOST_PASSES = 2048, 10_000, 12
#: Values of small groups that one task sorts, so that its memory doesn't grow with the table.
SORTED = 1 << 20


def _halved(lo: Column, hi: Column, v: Column) -> Column:
    """The bin of a value: it never falls as values rise. Scaled down, so that the range of all doubles can be divided."""
    share = (v / 4 - lo / 4) / (hi / 4 - lo / 4)
    return F.least(F.lit(BINS - 1), F.floor(F.when(hi > lo, share).otherwise(0.0) * BINS).cast("int"))


def values_at(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, v: the value that has ``rank`` (0 is the least) in its group, for ``wanted`` (by, rank, n, lo, hi: the size
    and bounds of the group) and ``values`` (by, v)."""
    keys = [*by, "rank"]
    todo = wanted.withColumn("at", F.col("rank"))
    pool = values.join(todo, by)  # a row for each value and wanted rank of its group
    found: list[DataFrame] = []
    for _ in range(MOST_PASSES):
        small = pool.filter((F.col("n") <= FEW) & (F.col("lo") < F.col("hi"))).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
        found += [small.filter("k = at").select(*keys, "v"), todo.filter("lo = hi").select(*keys, F.col("lo").alias("v"))]
        big = todo.filter((F.col("n") > FEW) & (F.col("lo") < F.col("hi")))
        if big.isEmpty():
            break
        binned = pool.filter((F.col("n") > FEW) & (F.col("lo") < F.col("hi"))).withColumn("bin", _halved(F.col("lo"), F.col("hi"), F.col("v")))
        bins = binned.groupBy(*keys, "at", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")  # BINS rows a group and rank
        held = bins.withColumn("before", before).filter("before <= at and at < before + n")
        todo = stored(held.select(*keys, "n", "lo", "hi", (F.col("at") - F.col("before")).alias("at")), "ranks")
        inside = pool.select(*keys, "v").join(todo, keys).filter("v between lo and hi")
        pool = stored(inside, "values")
    else:
        raise RuntimeError("the ranks did not settle")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def small_quantiles(values: DataFrame, tasks: int, by: list[str], ranks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """by, n, and for each of ``ranks`` (of a group of n) the two values there, of groups that can be sorted as they are."""
    own = Window.partitionBy(*by)
    ranked = values.repartition(tasks, *by).withColumn("k", F.row_number().over(own.orderBy("v")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    ends = [F.max(F.when(F.col("k") == rank, F.col("v"))).alias(f"{name}_{end}") for name, both in ranks.items() for end, rank in zip(("lo", "hi"), both, strict=True)]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *ends)


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """by and, by name, the linearly interpolated quantiles of the values that aren't null, one row a group that has any."""
    values = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null")
    sizes = stored(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    big = sizes.filter(F.col("n") > FEW).dropna(subset=by)  # equal keys meet in joins, null ones don't: these are sorted, which spills
    few, large = sizes.agg(F.sum(F.when(F.col("n") <= FEW, F.col("n"))), F.count(F.when(F.col("n") > FEW, 1))).first()
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    names = {name: f"q{k}" for k, name in enumerate(qs)}
    rest = values.join(big.select(*by), by, "left_anti") if large else values
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(few or 0) // SORTED))
    found = small_quantiles(rest, tasks, by, {names[name]: (F.floor(place(q)), F.ceil(place(q))) for name, q in qs.items()})
    if large:
        ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in qs.values()])))
        got = values_at(values, big.select("*", F.explode(ranks).alias("rank")), by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two a quantile
        ends = [F.col("at")[rank(place(q))].alias(f"{names[name]}_{end}") for name, q in qs.items() for end, rank in (("lo", F.floor), ("hi", F.ceil))]
        found = found.unionByName(big.join(got, by).select(*by, "n", *ends))
    between = {name: F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * (place(qs[name]) - F.floor(place(qs[name]))) for name, c in names.items()}
    return found.select(*by, *[c.alias(name) for name, c in between.items()])
