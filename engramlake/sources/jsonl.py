"""JSON lines of a memory log: scan with physical line numbers, skip headers and what isn't an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import strip
from ..model import TIERS


def parse(lines: DataFrame) -> DataFrame:
    """Entries of ``line`` (with tier, file, line_no and any other column): adds raw, raw_lc, id, ts, weight, e_tier and e_type.

    Blank lines, malformed ones, headers (objects with a key ``schema``) and values that aren't objects
    are left out; so are objects whose weight is null or no number or whose ts is no string.
    """
    good = _parsed(lines).filter(_is_entry())
    get = lambda k, t: F.try_variant_get("_v", f"$.{k}", t)
    return good.withColumns(
        {
            "raw_lc": F.lower("raw"),
            "id": get("id", "string"),
            "ts": get("ts", "string"),
            "weight": F.coalesce(get("weight", "double"), F.lit(1.0)),
            "e_tier": F.coalesce(get("_tier", "string"), F.lit("")),
            "e_type": F.coalesce(get("_type", "string"), F.lit("")),
        }
    ).drop("_v", "_keys")


def _parsed(lines: DataFrame) -> DataFrame:
    """raw, _v and _keys of non-blank lines; each is computed once, as filters aren't pushed below a generator."""
    raw = lines.select(*(c for c in lines.columns if c != "line"), F.inline(F.array(F.struct(strip(F.col("line")).alias("raw"))))).filter("raw <> ''")
    return raw.select("*", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("_v"), F.json_object_keys("raw").alias("_keys")))))


def _is_entry() -> Column:
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    has = lambda k: F.array_contains("_keys", k)
    number = F.coalesce(F.regexp_like(kind("weight"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.lit(False))
    text = F.coalesce(kind("ts") == "STRING", F.lit(False))
    return F.col("_v").isNotNull() & F.col("_keys").isNotNull() & ~has("schema") & (~has("weight") | number) & (~has("ts") | text)


def malformed(lines: DataFrame) -> DataFrame:
    """Per tier and file, how many non-blank lines were left out although they are no header."""
    return _parsed(lines).groupBy("tier", "file").agg(F.count_if(~(F.coalesce(_is_entry(), F.lit(False)) | F.coalesce(F.array_contains("_keys", "schema"), F.lit(False)))).alias("malformed"))


def read_files(spark: SparkSession, root: str, tiers: list[str] | None = None) -> DataFrame:
    """``line`` with tier, file and physical line_no of ``<root>/<tier>/<file>.jsonl``; only the tiers asked for are listed and read.

    Files are split as any text files are. Lines are numbered by their place in a split and the lines of
    the splits before, which are counted first: a row for each split.
    """
    lines = spark.read.option("lineSep", "\n").text(f"{root}/{{{','.join(tiers or TIERS)}}}/*.jsonl")
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("path", "at").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(splits.select("path", "at", (before - F.col("first") + 1).alias("shift")), ["path", "at"])
    return numbered.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("tier"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("file"), (F.col("row") + F.col("shift")).alias("line_no"), F.col("value").alias("line"))
