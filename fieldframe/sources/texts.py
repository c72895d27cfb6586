"""Meshes, tables and reports as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (mesh, face, part, and ax to cz of their corners) of OBJ files, one mesh a file.

    A face's indices count vertices from 1, negative ones back from the last vertex before
    it; a polygon becomes a fan from its first corner. An index without a vertex is an
    error. A mesh is read whole by one task, its lines are then rows.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mesh"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    words = whole.select("mesh", "line", F.split(F.trim("text"), r"\s+").alias("w"))
    number = lambda i: F.get("w", i).cast("double")
    order = Window.partitionBy("mesh").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = words.withColumn("seen", F.count_if(F.get("w", 0) == "v").over(order))
    vertices = counted.where(F.get("w", 0) == "v").select("mesh", F.col("seen").alias("at"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"))
    index = lambda w: F.element_at(F.split(w, "/"), 1).cast("long")
    corners = F.transform(F.slice("w", F.lit(2), F.size("w") - 1), lambda w: F.when(index(w) < 0, F.col("seen") + index(w) + 1).otherwise(index(w)))
    faces = counted.where(F.get("w", 0) == "f").select("mesh", F.col("line").alias("face"), "seen", corners.alias("c"))
    fan = faces.select("mesh", "face", "seen", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("part"))
    ends = fan.select("mesh", "face", "seen", "part", F.get("c", 0).alias("i_a"), F.get("c", F.col("part")).alias("i_b"), F.get("c", F.col("part") + 1).alias("i_c"))
    for n in "abc":
        side = vertices.select("mesh", F.col("at").alias(f"i_{n}"), *[F.col(a).alias(f"{n}{a}") for a in "xyz"])
        ends = ends.join(side, ["mesh", f"i_{n}"], "left")
    held = F.col("ax").isNotNull() & F.col("bx").isNotNull() & F.col("cx").isNotNull()
    checked = F.when(held, F.col("part")).otherwise(F.raise_error(F.concat(F.lit("a face of "), F.col("mesh"), F.lit(" has an index without a vertex"))).cast("int"))
    return ends.select("mesh", "face", checked.alias("part"), *[f"{n}{a}" for n in "abc" for a in "xyz"])


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header line; a byte order mark in front of it is passed over, unknown columns are left out by name."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def top_rows(table: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows in an order."""
    return table.orderBy(*order).limit(k)


def report_fields(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row a report (report, text lines) with the first value of each name that its pattern finds; the pattern's first group is a number."""
    found = [F.first(F.nullif(F.regexp_extract("text", p, 1), F.lit("")), ignorenulls=True).cast("double").alias(n) for n, p in names.items()]
    return lines.groupBy("report").agg(*found)
