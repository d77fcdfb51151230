"""Counts of different values and quantiles by group, kept as sketches that later rows are merged into.

A batch is sketched by group, one row a group, into a folder of its own under its id; a batch that
is there already changes nothing, so a repeated write counts once. Reading merges the sketches of all
batches: HyperLogLog states for the number of different values (relative standard error about
1.04 / sqrt(2 ** LG_K), 1.6 %), KLL states for quantiles (rank error about 1.3 % at ``KLL_K``). So a
day's or a source's figures, and those of any union of groups, need no earlier row again.

Defined results for odd input: null values are counted in ``n`` only; a null group is a group; no
rows, or a batch without any: no groups; repeated rows count in ``n`` and in the quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.shared import exists

LG_K = 12
KLL_K = 200


class SketchTable:
    """Sketches by ``groups`` of the different values of one column and the quantiles of another, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, groups: Sequence[str]):
        self.spark, self.folder, self.groups = spark, folder, list(groups)

    def append(self, batch_id: str, rows: DataFrame, counted: str, measured: str) -> bool:
        """Add a batch of rows (groups..., counted, measured); False if it was there."""
        if not batch_id.replace("-", "").isalnum():
            raise ValueError(f"batch ids are letters, digits and dashes: {batch_id!r}")
        path = f"{self.folder}/batch={batch_id}"
        if exists(self.spark, f"{path}/_SUCCESS"):
            return False
        value, size = F.col(counted).cast("string"), F.col(measured).cast("double")
        rows.groupBy(*self.groups).agg(
            F.count("*").alias("n"), F.hll_sketch_agg(value, LG_K).alias("different"), F.kll_sketch_agg_double(size, KLL_K).alias("quantiles")
        ).write.mode("overwrite").parquet(path)
        return True

    def merged(self, by: Sequence[str] | None = None) -> DataFrame:
        """(by..., n, different, quantiles): the sketches of all batches, by the groups or some of them."""
        by = self.groups if by is None else list(by)
        if not exists(self.spark, self.folder):
            raise ValueError("no batch yet")
        rows = self.spark.read.option("basePath", self.folder).parquet(self.folder)
        return rows.groupBy(*by).agg(
            F.sum("n").alias("n"), F.hll_union_agg("different").alias("different"), F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles")
        )

    def totals(self, by: Sequence[str] | None = None, ranks: Sequence[float] = (0.5, 0.95)) -> DataFrame:
        """(by..., n, n_different, q50, q95, ...)."""
        merged = self.merged(by)
        held = F.kll_sketch_get_n_double("quantiles") > 0
        named = [F.when(held, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r)))).alias(f"q{round(100 * r)}") for r in ranks]
        return merged.select(*(self.groups if by is None else by), "n", F.hll_sketch_estimate("different").alias("n_different"), *named)
