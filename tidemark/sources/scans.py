"""Tolerant scans of files: JSON lines by wanted keys, one JSON document a file, and CSV exports named by their date.

Lines keep their place (file, block, row), so that "the first one wins" means the
first in the files, however they are split. What cannot be read is kept apart and
never fails a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_value, once

#: Characters of a text that are kept.
LIMIT = 100_000
#: Bits a key and hashes of the filter that wanted keys are asked through; it has at most ``BLOOM_MOST`` words of 64 bits.
BLOOM_BITS, BLOOM_HASHES, BLOOM_MOST = 10, 4, 1 << 17


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line) of all lines that are not blank; a place orders lines as they stand in the files."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.select(F.struct("file_path", "file_block_start", "row").alias("place"), F.trim("value").alias("line")).filter("line <> ''")


def _object(line: Column) -> Column:
    """The line as a variant if it is a JSON object, NaN being null; else null."""
    named = F.regexp_replace(line, r"(?<=[:\[,\s])(NaN|-?Infinity)(?=\s*[,}\]])", "null")
    parsed = json_value(F.when(line.contains("NaN") | line.contains("Infinity"), named).otherwise(line))
    return once(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _parsed(rows: DataFrame) -> DataFrame:
    """rows with ``v``, the object of their line. It is a row of its own, as a filter on it would else parse the line anew for each use."""
    return rows.select("*", F.explode(F.array(_object(F.col("line")))).alias("v"))


def _text(v: Column, name: str) -> Column:
    """A field as text: strings as they are, other values as JSON; null if it is missing or null."""
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.nullif(F.to_json(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("null")))


def _maybe(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows that a Bloom filter of the wanted keys lets through; a join that follows decides."""
    spark = rows.sparkSession
    words = min(BLOOM_MOST, max(1, -(-wanted.count() * BLOOM_BITS // 64)))
    bits = lambda c: [F.pmod(F.xxhash64(c, F.lit(j)), F.lit(words * 64)) for j in range(BLOOM_HASHES)]
    at = wanted.select(F.explode(F.array(*bits(F.col(key)))).alias("at"))
    marks = at.select(F.shiftright("at", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("w"))
    filled = marks.union(spark.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))).groupBy("i").agg(F.bit_or("w").alias("w"))
    level = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")).scalar()
    hit = F.lit(True)
    for place in bits(F.col(key)):
        hit = hit & (F.getbit(F.get(level, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1)
    return rows.filter(hit)


def wanted_lines(spark: SparkSession, path: str, wanted: DataFrame, key: str, value: str, limit: int = LIMIT) -> DataFrame:
    """(key, value) of the first object that has each wanted key, its value cut to ``limit`` characters; ``wanted`` has a column ``key``.

    Blank lines, broken ones and those that are no objects are passed over. A value
    that is missing or null is an empty text, one that is no string is its JSON. Keys
    that are no strings match nothing.
    """
    keys = wanted.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    rows = _parsed(_lines(spark, path)).filter("v IS NOT NULL")
    is_text = F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")) == "STRING"
    rows = rows.filter(is_text).select("place", F.try_variant_get("v", f"$.{key}", "string").alias(key), F.substring(F.coalesce(_text(F.col("v"), value), F.lit("")), 1, limit).alias(value))
    hits = _maybe(rows, key, keys).join(keys, key, "left_semi")
    return hits.groupBy(key).agg(F.min_by(value, "place").alias(value))


def first_lines(spark: SparkSession, path: str, needed: list[str], unique: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, broken lines): the fields of the first object with each ``unique`` value; objects that lack a needed field, or have it empty, are no records."""
    rows = _parsed(_lines(spark, path))
    names = list(dict.fromkeys([unique, *needed, *fields]))
    good = rows.filter("v IS NOT NULL").select("place", *[_text(F.col("v"), n).alias(n) for n in names])
    for n in {unique, *needed}:
        good = good.filter(F.coalesce(n, F.lit("")) != "")
    first = good.groupBy(unique).agg(F.min_by(F.struct(*[n for n in names if n != unique]), "place").alias("r"))
    return first.select(unique, *[f"r.{n}" for n in names if n != unique]), rows.filter("v IS NULL").select("line")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document): each file as one variant, null where it is no JSON."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), json_value(F.col("value")).alias("document"))


def dated_csv(spark: SparkSession, path: str, columns: list[str], placed: bool = False) -> DataFrame:
    """Rows of CSV exports as text, with ``run_date``: the date in the file's name, else its name without extension. Missing cells are empty; cells may hold line breaks. ``placed`` adds ``place``, which orders rows as they stand in the files."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    name = F.col("_metadata.file_name")
    date = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    place = [F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("row")).alias("place")] if placed else []
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], F.when(date != "", date).otherwise(stem).alias("run_date"), *place)
