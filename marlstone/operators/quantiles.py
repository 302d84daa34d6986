"""Exact percentiles of groups of any size in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import remove, shared_folder

BINS, SMALL = 1024, 10_000


def percentiles(rows: DataFrame, value: str, ps: list[float], by: list[str], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """by, p (array<double>): percentiles with linear interpolation between neighbours, exact.

    Groups of at most `small` values are sorted as they are. Of a larger group only counts are kept: its values are counted in
    `bins` intervals between their least and greatest, the interval that holds a wanted rank is cut again, between the least
    and greatest value that really lie in it, and so on until one value or `small` of them are left. So a group never comes
    together in one row; two or three passes suffice for most data. Nulls and NaN don't count; a group without values has
    null percentiles."""
    if not by:
        return percentiles(rows.withColumn("__g", F.lit(0)), value, ps, ["__g"], small, bins).drop("__g")
    spark = rows.sparkSession
    named = [F.col(c) for c in by]
    rows = rows.select(*named, F.col(value).cast("double").alias("__v"))
    held = F.col("__v").isNotNull() & ~F.isnan("__v")
    sizes = rows.groupBy(*by).agg(F.count_if(held).alias("__n"), F.min(F.when(held, F.col("__v"))).alias("__lo"), F.max(F.when(held, F.col("__v"))).alias("__hi"))
    folders = []

    def kept(df: DataFrame) -> DataFrame:
        folders.append(shared_folder(spark, "percentiles"))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    sizes = kept(sizes)
    rows = rows.filter(held)
    little = sizes.filter(F.col("__n") <= small)
    few = rows.alias("r").join(little.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by], "left_semi")
    out = few.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, ps))).alias("p"))
    out = out.unionByName(sizes.filter("__n = 0").select(*by, F.transform(F.array(*map(F.lit, ps)), lambda _: F.lit(None).cast("double")).alias("p")))
    # wanted ranks: the two neighbours of each percentile, by their place from 0
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p * (F.col("__n") - 1)), F.ceil(p * (F.col("__n") - 1))) for p in ps])))
    todo = kept(sizes.filter(F.col("__n") > small).select(*by, F.explode(places).alias("__rank"), "__lo", "__hi").withColumns({"__at": F.col("__rank"), "__left": F.lit(small + 1).cast("long")}))
    found = None
    while True:
        done = todo.filter("__lo = __hi").select(*by, "__rank", F.col("__lo").alias("__x"))
        last = todo.filter((F.col("__lo") < F.col("__hi")) & (F.col("__left") <= small))
        last = _within(rows, last, by).groupBy(*by, "__rank", "__at").agg(F.array_sort(F.collect_list("__v")).alias("__all")).select(*by, "__rank", F.get("__all", F.col("__at").cast("int")).alias("__x"))
        now = done.unionByName(last)
        found = now if found is None else found.unionByName(now)
        todo = todo.filter((F.col("__lo") < F.col("__hi")) & (F.col("__left") > small))
        if todo.isEmpty():
            break
        v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
        wide = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * (bins - 2)).cast("int")
        cell = F.when(v == lo, 0).when(v == hi, bins - 1).when((lo == float("-inf")) | (hi == float("inf")), 1).otherwise(F.least(F.lit(bins - 2), F.greatest(F.lit(1), wide + 1)))
        counts = _within(rows, todo, by).groupBy(*by, "__rank", "__at", cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__left"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__left").over(Window.partitionBy(*by, "__rank").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))  # `bins` rows
        counts = counts.withColumn("__upto", upto).filter((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__left")))
        todo = kept(counts.select(*by, "__rank", "__lo", "__hi", (F.col("__at") - (F.col("__upto") - F.col("__left"))).alias("__at"), "__left"))
    known = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__known"))  # two ranks a percentile
    large = sizes.filter(F.col("__n") > small).alias("s").join(known.alias("k"), [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])

    def between(p: float):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        a, b = F.element_at("__known", F.floor(at)), F.element_at("__known", F.ceil(at))
        return F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at)))

    out = kept(out.unionByName(large.select(*[F.col(f"s.{c}").alias(c) for c in by], F.array(*map(between, ps)).alias("p"))))
    for folder in folders[:-1]:
        remove(folder)
    return out


def _within(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the bounds of what is wanted of their group."""
    near = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by] + [F.col("__v").between(F.col("__lo"), F.col("__hi"))]
    own = [c for c in wanted.columns if c not in by]
    return rows.alias("r").join(wanted.alias("w"), near).select(*[F.col(f"r.{c}").alias(c) for c in by], "__v", *own)
