"""Exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups up to this size are sorted whole; of larger ones only what lies near a wanted rank is.
SORTED = 100_000
#: Of a larger group, what share of its rows may lie between a rank and its estimate, inverted.
ACCURACY = 10_000


def rank_index(n: Column, p: float, ties: str = "even") -> Column:
    """round((n - 1) * p); where it is a half, 'even' takes the even index and 'away' the higher."""
    at = (n - 1) * F.lit(float(p))
    index = F.rint(at) if ties == "even" else F.floor(at + 0.5)
    return F.greatest(F.lit(0), F.least(n - 1, index.cast("long")))


def nearest_ranks(df: DataFrame, value: str, wanted: dict[str, tuple[float, str]], by: tuple[str, ...] = (), sorted_whole: int = SORTED) -> DataFrame:
    """A row a group of by: for each name of wanted, (p, ties), the value at rank_index of the sorted values.

    Nulls don't count; NaN is greater than all numbers; a group without values gives NaN.  Without by there is one row.

    A group is never gathered: estimates bracket each rank, the rows below a bracket are counted, and only those within
    it, of a large group about four in ACCURACY, are sorted.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v"))
    margin = 2.5 / ACCURACY
    ends = [min(1.0, max(0.0, p + d)) for p, _ in wanted.values() for d in (-margin, margin)]
    groups = rows.groupBy(*by).agg(F.count("__v").alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__ends"))
    whole = F.col("__n") <= sorted_whole
    places = F.array(
        *(
            F.struct(
                F.lit(i).alias("i"), rank_index(F.col("__n"), p, ties).alias("at"),
                F.when(whole, F.lit(float("-inf"))).otherwise(F.get("__ends", F.lit(2 * i))).alias("low"), F.when(whole, F.lit(float("nan"))).otherwise(F.get("__ends", F.lit(2 * i + 1))).alias("high"),
            )
            for i, (p, ties) in enumerate(wanted.values())
        )
    )
    placed = groups.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), places.alias("__places"))
    if by:
        met = rows.where("__v is not null").join(placed, [rows[c].eqNullSafe(placed[f"__{i}"]) for i, c in enumerate(by)])
    else:
        met = rows.where("__v is not null").crossJoin(F.broadcast(placed))
    near = met.select(*by, "__v", F.explode("__places").alias("__p"))
    below = near.groupBy(*by, "__p.i").agg(F.count(F.when(F.col("__v") < F.col("__p.low"), 1)).alias("__below"))
    inside = near.where("__v >= __p.low and __v <= __p.high")
    order = Window.partitionBy(*by, "i").orderBy("__v")
    ordered = inside.select(*by, "__p.i", "__p.at", "__v").withColumn("__r", F.row_number().over(order) - 1)
    both = ordered.alias("a").join(below.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "i")])
    hit = both.where("a.at = b.__below + a.__r").select(*(f"a.{c}" for c in by), "a.i", "a.__v")
    values = hit.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, F.col("__v"))).alias(name) for i, name in enumerate(wanted)))
    nan = F.lit(float("nan"))
    if not by:
        return values.select(*(F.coalesce(name, nan).alias(name) for name in wanted))
    all_groups = groups.select(*by).alias("g").join(values.alias("v"), [F.col(f"g.{c}").eqNullSafe(F.col(f"v.{c}")) for c in by], "left")
    return all_groups.select(*(F.col(f"g.{c}").alias(c) for c in by), *(F.coalesce(F.col(f"v.{name}"), nan).alias(name) for name in wanted))
