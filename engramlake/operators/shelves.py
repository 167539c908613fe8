"""Ranked search that ends early: entries lie on shelves by what their weight and time let them score at most.

A score is a share of terms (1 at most) x weight x DECAY ^ days. The logarithm of weight x DECAY ^ -time
orders entries alike at any time that is asked about, so shelves are ranges of it; entries whose time
doesn't count are shelved by weight alone. A shelf's largest values bound every score on it, and
shelves are read in falling order of the bound until the last result beats the next one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..model import DECAY, LIMIT
from . import memory

#: Entries of a shelf, and the factor by which more shelves are read at each step.
SHELF, GROWTH = 1_000_000, 2
#: Ranges that shelves are cut from, at most.
RANGES = 256
#: Scores and bounds are computed in different orders.
SLACK = 1e-9
_DAY = 86400e6


def _runs(known: list[int], chosen: list[int]) -> Column:
    """These shelves of all known ones, as ranges of their numbers, by which the file format leaves out the others."""
    at = {x: i for i, x in enumerate(known)}
    runs: list[list[int]] = []
    for x in sorted(chosen):
        if runs and at[x] == at[runs[-1][1]] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return reduce(lambda a, b: a | b, [F.col("shelf").between(*r) for r in runs], F.lit(False))


class Shelves:
    """Entries below a folder: ``rows`` (Parquet in order of shelf) and ``shelves`` (shelf, rows, heavy: the largest weight, dated: the largest logarithm of weight x DECAY ^ -days since 1970 of entries whose time counts, undated: the largest weight of the others).

    ``read`` holds the shelves that the last search has read.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.read = spark, root.rstrip("/"), []

    def build(self, entries: DataFrame, shelf: int = SHELF) -> Shelves:
        """Writes entries, as the functions of ``memory`` take them. Any number of equal ones lie on several shelves."""
        days = F.unix_micros(E.instant(F.col("ts"))) / F.lit(_DAY)
        heavy = F.greatest(F.col("weight"), F.lit(1e-300))
        rows = entries.withColumns({"_dated": F.log(heavy) - F.lit(math.log(DECAY)) * days, "_undated": F.when(days.isNull(), F.col("weight"))})
        n = max(1, -(-entries.count() // shelf))
        keys = [F.col("_dated").isNull(), F.col("_dated").desc(), F.col("_undated").desc(), F.xxhash64("id", "line_no")]
        # few ranges, cut into shelves as they lie: the sample that ranges come from doesn't grow with the shelves
        placed = rows.repartitionByRange(min(n, RANGES), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
        place = F.shiftleft(F.shiftright("_at", 33), 33) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / shelf)
        placed = placed.withColumn("shelf", place.cast("long")).drop("_at")
        placed.write.parquet(f"{self.root}/rows")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.root}/rows")
        written.groupBy("shelf").agg(F.count("*").alias("rows"), F.max("weight").alias("heavy"), F.max("_dated").alias("dated"), F.max("_undated").alias("undated")).coalesce(1).write.parquet(f"{self.root}/shelves")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows").drop("_dated", "_undated")

    def bounds(self, now: Column) -> DataFrame:
        """shelf and the most score of any entry on it: days are whole, so up to one more isn't counted, and times to come count as now."""
        days = F.unix_micros(now) / F.lit(_DAY)
        most = F.least(F.col("heavy"), F.exp(F.col("dated") + F.lit(math.log(DECAY)) * (days - 1)))
        bound = F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("dated").isNotNull(), most), F.lit(0.0)), F.coalesce("undated", F.lit(0.0)))
        return self.spark.read.parquet(f"{self.root}/shelves").select("shelf", (bound * (1 + SLACK)).alias("bound"))

    def search(self, query: str, now: Column, tiers: list[str] | None = None, limit: int = LIMIT[2], date_from: str | None = None, date_to: str | None = None, min_weight: float | None = None) -> DataFrame:
        """``memory.search`` over the shelves that can hold a result."""
        options = {"tiers": tiers, "date_from": date_from, "date_to": date_to, "min_weight": min_weight}
        left = [(r["bound"], r["shelf"]) for r in self.bounds(now).orderBy(F.desc("bound"), "shelf").collect()]  # a row for each SHELF entries
        known, best = sorted(x for _, x in left), []
        self.read, step = [], 1
        while left and E.terms_of(query) and (len(best) < limit or left[0][0] >= best[-1]):
            now_read, left = [s for _, s in left[:step]], left[step:]
            found = memory.scored(memory.filtered(self.rows().filter(_runs(known, now_read)), **options), query, now)
            scores = [r[0] for r in found.select("unrounded").orderBy(F.desc("unrounded")).limit(limit).collect()]
            best = sorted([*best, *scores], reverse=True)[:limit]
            self.read, step = [*self.read, *now_read], step * GROWTH
        return memory.search(self.rows().filter(_runs(known, self.read)).drop("shelf"), query, now, limit=limit, **options)

