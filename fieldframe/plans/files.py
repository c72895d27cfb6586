"""Registered queries through files: raw volumes in both layouts, packed assets, meshes, tables and reports, with their DuckDB equivalents."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..operators import fields
from ..sources import packed, raw, texts
from ..sources.shared import new_path, written
from .catalog import CELLS, H, T, W, _cells, _paired, _table, query


def _volumes(spark, sf_dir, time_fastest):
    """The volume as one raw file a slab, with slabs that no cell lies in left out; paths in order of the slabs."""
    manifest = written(raw.write_volumes(fields.field_cells(_table(spark, sf_dir, "lineitem")), new_path(spark, "volumes"), W, H, 8, T, time_fastest), "volume-manifest")
    return manifest, [r["path"] for r in manifest.orderBy("slab").select("path").collect()]


@query(f"""WITH {CELLS}, k AS (SELECT z, t, count(*) AS held, round(sum(CAST(CAST(v AS FLOAT) AS DOUBLE)), 3) AS total, max(v) AS high FROM cells GROUP BY 1, 2), s AS (SELECT DISTINCT z // 8 AS slab FROM cells), g AS (SELECT slab * 8 + lz AS z, t FROM s, range(8) a(lz), range(16) b(t))
SELECT CAST(g.z AS INT) AS z, CAST(g.t AS INT) AS t, CAST(1024 AS BIGINT) AS cells, coalesce(held, 0) AS held, coalesce(total, 0) AS total, coalesce(high, 0) AS high FROM g LEFT JOIN k USING (z, t)""")
def raw_scan(spark, sf_dir):
    """Raw files by frame, one a slab, scanned as a stack of volumes."""
    _, paths = _volumes(spark, sf_dir, False)
    c = raw.read_raw(spark, *paths, stacked="true")
    return c.groupBy("z", "t").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("v") != 0).alias("held"), F.round(F.sum(F.col("v").cast("double")), 3).alias("total"), F.max("v").cast("double").alias("high"))


@query(f"""WITH {CELLS} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST(t AS INT) AS t, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM cells WHERE t = 3 AND z BETWEEN 2 AND 5""")
def time_fastest_frame(spark, sf_dir):
    """One frame and some planes of files whose fastest axis is time: the conditions reach the reader."""
    _, paths = _volumes(spark, sf_dir, True)
    c = raw.read_raw(spark, *paths, stacked="true").where("t = 3 and z >= 2 and z <= 5")
    return c.where("v <> 0").select("x", "y", "z", "t", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"""WITH {CELLS}, s AS (SELECT z // 8 AS slab, max(v) AS high FROM cells GROUP BY 1) SELECT CAST(slab AS BIGINT) AS slab, 32 AS width, 32 AS height, 8 AS depth, 16 AS frames, high AS data_max, CAST(524288 AS BIGINT) AS n_bytes, true AS same_digest FROM s""")
def raw_manifest(spark, sf_dir):
    """Descriptions of raw files read as rows, beside their sizes and digests as the files have them now."""
    manifest, paths = _volumes(spark, sf_dir, False)
    folder = paths[0].rpartition("/")[0]
    slab = lambda c: F.regexp_extract(c, r"slab(\d+)", 1).cast("long").alias("slab")
    told = raw.metadata(spark, f"{folder}/*.metadata.json").select(slab("path"), "width", "height", "depth", "frames", F.col("data_max").cast("double").alias("data_max"))
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(folder).select(slab("path"), F.sha2("content", 256).alias("now"))
    return manifest.join(told, "slab").join(now, "slab").select("slab", "width", "height", "depth", "frames", "data_max", "n_bytes", (F.col("sha256") == F.col("now")).alias("same_digest"))


_MEANS = f"{CELLS}, m AS (SELECT leaf_id // 16 AS slab, leaf_id % 16 AS leaf, t, CAST(avg(v) AS FLOAT) AS p FROM leafed GROUP BY 1, 2, 3)"


def _assets(spark, sf_dir):
    """One packed asset a slab: a word of mode 0 and the means of 16 frames for each of its 16 leaves."""
    slabs = _cells(spark, sf_dir).select(F.expr("leaf_id div 16").alias("asset")).distinct()
    every = slabs.select("asset", F.explode(F.expr("sequence(0L, 15L)")).alias("leaf_id"))
    m = _cells(spark, sf_dir).groupBy(F.expr("leaf_id div 16").alias("asset"), F.expr("leaf_id % 16").alias("leaf_id"), "t").agg(F.avg("v").cast("float").alias("p"))
    frames = m.groupBy("asset", "leaf_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "p"))).alias("m"))
    series = F.transform(F.expr("sequence(0L, 15L)"), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0).cast("float")))

    @F.pandas_udf("binary")
    def words(s):
        return s.map(lambda v: struct.pack("<I16f", 0, *v) if v is not None else struct.pack("<I16f", 0, *[0.0] * 16))

    leaves = every.join(frames.select("asset", "leaf_id", series.alias("s")), ["asset", "leaf_id"], "left").select("asset", "leaf_id", words("s").alias("payload"))
    told = {"width": 32, "height": 32, "depth": 8, "frames": 16, "coarse_resolution": 4, "max_coarse_keep": 1, "profile_type": 0, "ac_scales": [0.5]}
    manifest = written(packed.write_assets(leaves, new_path(spark, "assets"), b"FIELDPCK", told), "asset-manifest")
    return manifest, [r["path"] for r in manifest.orderBy("asset").select("path").collect()]


@query(f"""WITH {_MEANS}, s AS (SELECT DISTINCT slab FROM m), g AS (SELECT slab, leaf FROM s, range(16) a(leaf)), k AS (SELECT slab, leaf, sum(CAST(p AS DOUBLE)) AS total FROM m GROUP BY 1, 2) SELECT slab, leaf AS leaf_id, leaf * 17 AS word_begin, (leaf + 1) * 17 AS word_end, CAST(0 AS BIGINT) AS mode, round(coalesce(total, 0), 4) AS total FROM g LEFT JOIN k USING (slab, leaf)""")
def packed_leaves(spark, sf_dir):
    """Leaves of packed assets, one asset a slab, with their words read back."""
    _, paths = _assets(spark, sf_dir)
    leaves = packed.read_leaves(spark, *paths)

    @F.pandas_udf("double")
    def total(payload):
        return payload.map(lambda p: float(sum(struct.unpack("<16f", p[4:]))))

    slab = F.regexp_extract("asset", r"asset(\d+)", 1).cast("long").alias("slab")
    return leaves.select(slab, "leaf_id", "word_begin", "word_end", (F.col("packed_header").bitwiseAND(F.lit(3).cast("long"))).alias("mode"), F.round(total("payload"), 4).alias("total"))


@query(f"""WITH {_MEANS}, q AS (SELECT o_orderkey AS qid, o_orderkey // 8192 AS slab, o_orderkey % 16 AS leaf, o_custkey % 16 AS t FROM orders) SELECT qid, q.slab, q.leaf AS leaf_id, q.t, round(coalesce(CAST(p AS DOUBLE), 0.0), 4) AS v FROM q JOIN (SELECT DISTINCT slab FROM m) s USING (slab) LEFT JOIN m USING (slab, leaf, t)""")
def packed_point_queries(spark, sf_dir):
    """Point queries joined with the leaves' payloads, the frame's word taken out of each."""
    _, paths = _assets(spark, sf_dir)
    leaves = packed.read_leaves(spark, *paths).select(F.regexp_extract("asset", r"asset(\d+)", 1).cast("long").alias("slab"), "leaf_id", "payload")
    q = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.expr("o_orderkey div 8192").alias("slab"), (F.col("o_orderkey") % 16).alias("leaf_id"), (F.col("o_custkey") % 16).alias("t"))

    @F.pandas_udf("double")
    def frame(payload, t):
        import pandas as pd

        return pd.Series([struct.unpack_from("<f", p, 4 + 4 * i)[0] for p, i in zip(payload, t, strict=True)], dtype="float64")

    return q.join(leaves, ["slab", "leaf_id"]).select("qid", "slab", "leaf_id", "t", F.round(frame("payload", "t"), 4).alias("v"))


@query(f"""WITH {CELLS}, s AS (SELECT DISTINCT leaf_id // 16 AS asset FROM leafed) SELECT asset, 4 AS version, 32 AS width, 16 AS frames, 16 AS leaf_count, 1 AS scales, CAST(8 + 44 + 4 + 4 * 17 + 16 * 68 AS BIGINT) AS n_bytes FROM s""")
def packed_headers(spark, sf_dir):
    """Headers of packed assets, looked into without their payloads, beside the files' sizes."""
    manifest, _ = _assets(spark, sf_dir)
    heads = packed.read_headers(spark, manifest.select(F.col("path").alias("asset"))).withColumnRenamed("asset", "path")
    return manifest.join(heads, "path").select("asset", "version", "width", "frames", "leaf_count", F.size("ac_scales").alias("scales"), "n_bytes")


@query("""WITH e AS (SELECT vec_id, [round(CAST(e AS DOUBLE), 4) FOR e IN embedding] AS e FROM embeddings), t AS (SELECT vec_id, 1 AS part, e[1] AS ax, e[2] AS ay, e[3] AS az, e[4] AS bx, e[5] AS by_, e[6] AS bz, e[7] AS cx, e[8] AS cy, e[9] AS cz FROM e UNION ALL SELECT vec_id, 2, e[1], e[2], e[3], e[7], e[8], e[9], e[10], e[11], e[12] FROM e),
a AS (SELECT part, vec_id, 0.5 * sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) AS area, least(ax, bx, cx) AS lo, greatest(ax, bx, cx) AS hi FROM t)
SELECT part, count(*) AS triangles, round(sum(area), 3) AS area, round(min(lo), 4) AS low_x, round(max(hi), 4) AS high_x FROM a GROUP BY 1""")
def mesh_scan(spark, sf_dir):
    """Four-cornered faces written as OBJ text, faces naming their vertices from behind, and read back as fans of triangles."""
    at = lambda i: F.round(F.get("embedding", i).cast("double"), 4).cast("string")
    vertex = lambda k: F.concat_ws(" ", F.lit("v"), *[at(3 * k + i) for i in range(3)])
    lines = _table(spark, sf_dir, "embeddings").select(F.explode(F.array(F.concat_ws("\n", *[vertex(k) for k in range(4)], F.lit("f -4 -3/1 -2//2 -1")))).alias("value"))
    path = new_path(spark, "meshes")
    lines.write.text(path)
    m = texts.read_obj(spark, path)
    u, v = [[F.col(f"{n}{a}") - F.col(f"a{a}") for a in "xyz"] for n in "bc"]
    area = 0.5 * F.sqrt(sum(F.pow(u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3], F.lit(2.0)) for i in range(3)))
    return m.groupBy("part").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(area), 3).alias("area"), F.round(F.min(F.least("ax", "bx", "cx")), 4).alias("low_x"), F.round(F.max(F.greatest("ax", "bx", "cx")), 4).alias("high_x"))


@query(f"""WITH {CELLS}, e AS (SELECT leaf_id, sum((v - p) * (v - p)) AS sse, sqrt(avg((v - p) * (v - p))) AS rmse, max(abs(v - p)) AS peak FROM paired GROUP BY 1) SELECT leaf_id, leaf_id % 4 AS bx, leaf_id // 4 % 4 AS by_, leaf_id // 16 AS bz, round(sse, 3) AS sse, round(rmse, 6) AS rmse, round(peak, 6) AS peak FROM e ORDER BY round(sse, 3) DESC, round(rmse, 6) DESC, leaf_id LIMIT 10""")
def hotspot_table(spark, sf_dir):
    """Leaf errors written as a CSV table, read back, and the ten worst leaves of it."""
    e = F.expr("(v - p) * (v - p)")
    stats = _paired(spark, sf_dir).groupBy("leaf_id").agg(F.round(F.sum(e), 3).alias("sse"), F.round(F.sqrt(F.avg(e)), 6).alias("rmse"), F.round(F.max(F.abs(F.expr("v - p"))), 6).alias("peak"))
    placed = stats.select("leaf_id", F.expr("leaf_id % 4").alias("bx"), F.expr("leaf_id div 4 % 4").alias("by_"), F.expr("leaf_id div 16").alias("bz"), "sse", "rmse", "peak")
    path = new_path(spark, "hotspots")
    placed.write.option("header", True).csv(path)
    table = texts.read_table(spark, path, "leaf_id long, bx long, by_ long, bz long, sse double, rmse double, peak double")
    return texts.top_rows(table, [F.desc("sse"), F.desc("rmse"), F.col("leaf_id")], 10)


@query(f"""WITH {CELLS}, e AS (SELECT leaf_id, count(*) AS n, round(sqrt(avg((v - p) * (v - p))), 6) AS rmse, round(max(abs(v - p)), 6) AS peak FROM paired GROUP BY 1) SELECT leaf_id, CAST(n AS DOUBLE) AS n, rmse, peak FROM e""")
def parsed_reports(spark, sf_dir):
    """Reports of lines of text, one a leaf, and the numbers found in them again."""
    e = _paired(spark, sf_dir).groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.expr("(v - p) * (v - p)"))), 6).alias("rmse"), F.round(F.max(F.abs(F.expr("v - p"))), 6).alias("peak"))
    line = lambda text, c: F.concat(F.lit("leaf "), F.col("leaf_id").cast("string"), F.lit(f": {text} = "), F.col(c).cast("string"))
    path = new_path(spark, "reports")
    e.select(F.explode(F.array(line("cells", "n"), F.concat(line("RMSE", "rmse"), F.lit(" units")), line("Peak error", "peak"))).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^leaf (\d+):", 1).cast("long").alias("report"), F.col("value").alias("text"))
    found = texts.report_fields(lines, {"n": r"cells = (\d+)", "rmse": r"RMSE = ([0-9.eE+-]+)", "peak": r"Peak error = ([0-9.eE+-]+)"})
    return found.withColumnRenamed("report", "leaf_id")
