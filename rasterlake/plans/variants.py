"""Planner of lossless encoder variants: three small axes, crossed and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dimensions import fingerprint, small

METHODS = (("none", 0, 0), ("lzw", 1, 2), ("deflate", 2, 3), ("packbits", 3, 1))  # name, code, cost tier


def plan(spark: SparkSession, full: bool = True, max_tier: int | None = None, max_deviations: int | None = None) -> DataFrame:
    """Cells: cell_id, method, predictor, big_tiff, deviations, idx_sum, tier, fingerprint, dropped; simplest first.

    Cells beyond ``max_tier`` stay, marked dropped; those beyond ``max_deviations`` go.
    """
    methods = small(spark, [(i, *m) for i, m in enumerate(METHODS)], "ci int, method string, code int, tier int")
    predictors = small(spark, [(0, "none"), (1, "horizontal")][: 2 if full else 1], "pi int, predictor string")
    layouts = small(spark, [(0, False), (1, True)][: 2 if full else 1], "bi int, big_tiff boolean")
    cells = methods.crossJoin(predictors).crossJoin(layouts).where((F.col("ci") > 0) | (F.col("pi") == 0))
    prints = F.create_map(*[F.lit(x) for c in range(4) for p in range(2) for b in range(2) for x in (c * 4 + p * 2 + b, fingerprint(c, p, b))])
    moved = [(F.col(c) > 0).cast("int") for c in ("ci", "pi", "bi")]
    cells = cells.withColumn("deviations", moved[0] + moved[1] + moved[2]).withColumn("idx_sum", F.col("ci") + F.col("pi") + F.col("bi"))
    cell_id = F.concat(F.lit("tiff-"), "method", F.when(F.col("pi") == 1, "-hpred").otherwise(""), F.when(F.col("big_tiff"), "-big").otherwise(""))
    cells = cells.withColumn("cell_id", cell_id).withColumn("fingerprint", prints[F.col("code") * 4 + F.col("pi") * 2 + F.col("bi")])
    cells = cells.withColumn("dropped", F.lit(False) if max_tier is None else F.col("tier") > max_tier)
    cells = cells if max_deviations is None else cells.where(F.col("dropped") | (F.col("deviations") <= max_deviations))
    return cells.orderBy("deviations", "idx_sum", "ci", "pi", "bi")


def plans_of(asked: DataFrame, key: str) -> DataFrame:
    """The plan of every request: key, position (from 1), and the columns of :func:`plan`.

    ``asked`` has key, all_axes (or methods only), max_tier and max_deviations, null for no
    bound. Joined to at most 18 cells by axes and numbered within a request, so requests stay spread.
    """
    spark = asked.sparkSession
    cells = plan(spark, True).withColumn("all_axes", F.lit(True)).unionByName(plan(spark, False).withColumn("all_axes", F.lit(False))).drop("dropped")
    found = asked.join(F.broadcast(cells), "all_axes").withColumn("dropped", F.coalesce(F.col("tier") > F.col("max_tier"), F.lit(False)))
    found = found.where("dropped or max_deviations is null or deviations <= max_deviations")
    order = Window.partitionBy(key).orderBy("deviations", "idx_sum", "ci", "pi", "bi")
    return found.withColumn("position", F.row_number().over(order).cast("int"))


def parse_cell_id(cell: str):
    """Struct (method, hpred, big) of a cell id, or null where it isn't one."""
    parts = F.split(F.col(cell), "-", -1)
    flags = F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))
    method = F.try_element_at(parts, F.lit(2))
    known = (F.element_at(parts, 1) == "tiff") & method.isin(*[m[0] for m in METHODS]) & F.forall(flags, lambda f: f.isin("hpred", "big"))
    good = known & ~((method == "none") & F.array_contains(flags, "hpred"))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(method.alias("method"), F.array_contains(flags, "hpred").alias("hpred"), F.array_contains(flags, "big").alias("big")))
