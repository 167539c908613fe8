"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import few, ship, written  # noqa: F401 (operators take few from here)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so that no other column can clash."""
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` would also change other letters."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_hash(c: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(c)


#: Values of an array that are summed up at a time; a running list is copied for each value.
RUN = 256


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each computed once: neither filters nor lambdas that use them take in their expressions, as these stand behind a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def sums_before(values: str) -> Column:
    """For each value of an array column of numbers the sum of those before it.

    A running list would be copied for each value; here lists of RUN values are, and one of the sums of these.
    """
    n = F.size(values)
    # values by place: a slice would look at the whole array each time
    own = lambda i: F.transform(F.sequence(i, F.least(i + (RUN - 1), n - 1)), lambda k: F.get(F.col(values), k))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(RUN)), own)).otherwise(F.array())
    zero = lambda start: F.array(start)
    after = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    starts = F.aggregate(F.transform(parts, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)), zero(F.lit(0).cast("long")), after)
    within = F.zip_with(parts, F.slice(starts, 1, F.size(starts) - 1), lambda x, start: F.slice(F.aggregate(x, zero(start), after), 1, F.size(x)))
    return F.flatten(within)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest reachable id) for every id in the edges.

    Large-star and small-star in turn (Kiveris et al. 2014) until nothing changes. Each star is an
    aggregate of the smallest neighbour and a join, never a list of neighbours, so a hub of any
    degree is only a skewed join key, which adaptive execution splits. Edges with a null end and
    loops have no effect beyond naming their node.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = edges.filter("u <> v")
    # done when every edge goes to the root of a star, which is never the upper end of another edge
    while not links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() or not links.groupBy("u").count().filter("count > 1").isEmpty():
        # large star: the neighbours above a node go to the smallest id around it
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its neighbours below go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = written(small.filter("u <> v").distinct())
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
