"""Registered queries of backgrounds, series predicates, joins of fields and frames, and small formulas, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.columns import clamp
from ..operators import fields, keep, ranks, series
from .catalog import CELLS, SERIES, _cells, _paired, _r, _series, _table, query

_CLASS = "CASE WHEN high <= greatest(1e-9, 0.15 * 40) THEN 'elide' WHEN high <= 0.9 * 40 AND high < 40 - 2 AND high - low <= greatest(0.15 * 40, 0.25 * 4.0) THEN 'uniform' ELSE 'keep' END"


@query(f"""WITH {CELLS}, c AS (SELECT x, y, z, min(v) AS low, max(v) AS high FROM cells GROUP BY 1, 2, 3) SELECT x, y, z, low, high, {_CLASS} AS class FROM c""")
def background_columns(spark, sf_dir):
    """Columns of cells over time that are background, nearly constant below what is visible, or kept."""
    c = fields.field_cells(_table(spark, sf_dir, "lineitem")).groupBy("x", "y", "z").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return c.withColumn("class", keep.background_class(F.col("low"), F.col("high"), cutoff=40.0, band=2.0, zero_ratio=0.15, const_ratio=0.9))


@query(f"""WITH {CELLS}, s AS (SELECT leaf_id, t, round(avg(v)) AS v FROM leafed WHERE t IN (0, 7, 15) GROUP BY 1, 2) SELECT leaf_id, CASE WHEN bool_and(abs(v - 25) < 0.5) THEN 'air' WHEN bool_and(abs(v - 26) < 0.5) THEN 'inside' END AS elide FROM s GROUP BY 1""")
def elided_leaves(spark, sf_dir):
    """Leaves whose mean is one of two backgrounds at the first, the middle and the last frame."""
    s = _cells(spark, sf_dir).where(F.col("t").isin(0, 7, 15)).groupBy("leaf_id", "t").agg(F.round(F.avg("v")).alias("v"))
    return keep.elided(s, "leaf_id", 25.0, 26.0)


@query(f"""WITH {SERIES}, d AS (SELECT user_id, cents - 15000 AS d, lag(cents) OVER (PARTITION BY user_id ORDER BY t) - 15000 AS b FROM series) SELECT user_id, bool_or(abs(d) <= 500 OR coalesce((b <= 0 AND d >= 0) OR (b >= 0 AND d <= 0), false)) AS critical FROM d GROUP BY 1""")
def surface_critical_series(spark, sf_dir):
    """Series whose keys come near a level or lie on both sides of it."""
    return keep.surface_critical(_series(spark, sf_dir), "user_id", "cents", 15000, 500)


_STATE3 = "CASE WHEN v < 15000 - 8000 THEN 0 WHEN v > 15000 + 8000 THEN 2 ELSE 1 END"


@query(f"""WITH {SERIES}, d AS (SELECT u.user_id, f AS t, max(s.t) FILTER (s.t <= f) AS t0, arg_max(cents, s.t) FILTER (s.t <= f) AS v0, min(s.t) FILTER (s.t >= f) AS t1, arg_min(cents, s.t) FILTER (s.t >= f) AS v1 FROM (SELECT DISTINCT user_id FROM series) u, range(30) r(f), series s WHERE s.user_id = u.user_id GROUP BY 1, 2),
l AS (SELECT user_id, t, t0 = t1 AS own, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (t - t0) / CAST(t1 - t0 AS DOUBLE) * (v1 - v0) END AS v FROM d), s AS (SELECT user_id, t, coalesce(own, false) OR t IN (0, 29) AS seen, {_STATE3} AS s FROM l), p AS (SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM series WHERE user_id + 1 IN (SELECT user_id FROM series))
SELECT p.a, p.b, NOT bool_or((x.seen OR y.seen) AND ((x.s = 0 AND y.s = 2) OR (x.s = 2 AND y.s = 0))) AS compatible FROM p JOIN s x ON x.user_id = p.a JOIN s y ON y.user_id = p.b AND y.t = x.t GROUP BY 1, 2""")
def compatible_series(spark, sf_dir):
    """Neighbouring series that are never on clearly different sides of a cutoff, at any day that one of them has, nor at the ends."""
    s = _series(spark, sf_dir)
    a = s.select(F.col("user_id").alias("a")).distinct()
    pairs = a.withColumn("b", F.col("a") + 1).join(a.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    return keep.compatible(pairs, s, "user_id", "cents", 30, 15000, 8000)


@query(f"""WITH {CELLS}, c AS (SELECT leaf_id, t, CASE WHEN avg(v) < 25.4 THEN 'air' WHEN avg(v) < 25.8 THEN 'inside' ELSE 'leaf' END AS value FROM leafed GROUP BY 1, 2), d AS (SELECT *, CASE WHEN count(*) FILTER (value = 'inside') OVER (PARTITION BY t) > count(*) FILTER (value = 'air') OVER (PARTITION BY t) THEN 'inside' ELSE 'air' END AS "default" FROM c)
SELECT t, leaf_id, value, "default", row_number() OVER (PARTITION BY t ORDER BY leaf_id) - 1 AS place FROM d WHERE value <> "default" """)
def compacted_children(spark, sf_dir):
    """Children stored as exceptions from their parent's default."""
    # to nine places: a mean that lies on a bound is on it in whatever order it was summed
    c = _cells(spark, sf_dir).groupBy("leaf_id", "t").agg(F.round(F.avg("v"), 9).alias("m"))
    value = F.when(F.col("m") < 25.4, "air").when(F.col("m") < 25.8, "inside").otherwise("leaf")
    return keep.compacted(c.select("t", F.col("leaf_id").alias("child"), value.alias("value")), "t").select("t", F.col("child").alias("leaf_id"), "value", "default", "place")


@query(f"""WITH {SERIES}, g AS (SELECT DISTINCT user_id, unnest(range(9)) AS s FROM series), q AS (SELECT *, 29 * s / 8.0::DOUBLE AS tt FROM g), d AS (SELECT user_id, CAST(t AS DOUBLE) AS t, CAST(cents AS DOUBLE) AS v FROM series),
j AS (SELECT q.*, a.t AS t0, a.v AS v0 FROM q ASOF LEFT JOIN d a ON a.user_id = q.user_id AND q.tt >= a.t), l AS (SELECT j.*, b.t AS t1, b.v AS v1 FROM j ASOF LEFT JOIN d b ON b.user_id = j.user_id AND j.tt <= b.t)
SELECT user_id, CAST(s AS INT) AS s, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (tt - t0) / (t1 - t0) END, 6) AS v FROM l""")
def series_sketches(spark, sf_dir):
    """Nine samples of each series on lines between its days."""
    return keep.sketch(_series(spark, sf_dir), "user_id", "cents", 30).select("user_id", "s", _r("v"))


@query(f"""WITH {CELLS}, {SERIES}, k AS (SELECT user_id, unnest(range(9)) AS s, user_id % 10 AS grp FROM (SELECT DISTINCT user_id FROM series)), q AS (SELECT *, 29 * s / 8.0::DOUBLE AS tt FROM k), d AS (SELECT user_id, CAST(t AS DOUBLE) AS t, CAST(cents AS DOUBLE) AS v FROM series),
j AS (SELECT q.*, a.t AS t0, a.v AS v0 FROM q ASOF LEFT JOIN d a ON a.user_id = q.user_id AND q.tt >= a.t), l AS (SELECT j.*, b.t AS t1, b.v AS v1 FROM j ASOF LEFT JOIN d b ON b.user_id = j.user_id AND j.tt <= b.t),
sk AS (SELECT user_id, s, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (tt - t0) / (t1 - t0) END AS v FROM l), w AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY s) AS slope FROM sk),
p AS (SELECT a.user_id AS a, b.user_id AS b, corr(a.v, b.v) AS r, max(abs(a.v - b.v)) AS gap, avg(CASE WHEN a.slope * b.slope < 0 THEN 1.0 ELSE 0.0 END) FILTER (a.slope IS NOT NULL) AS mismatch FROM w a JOIN w b ON b.user_id = a.user_id + 1 AND b.s = a.s GROUP BY 1, 2),
h AS (SELECT user_id, min(v) AS low, max(v) AS high, arg_min(s, {{'v': v, 's': s}}) AS low_at, arg_max(s, {{'v': v, 's': -s}}) AS high_at, greatest(1e-5, stddev_pop(v), max(v) - min(v)) AS scale FROM sk GROUP BY 1)
SELECT p.a, p.b, round(coalesce(r, 0), 6) AS correlation, round(gap, 4) AS gap, round(mismatch, 6) AS mismatch, round(greatest(abs(x.low - y.low), abs(x.high - y.high)) / x.scale, 6) AS envelope, abs(x.low_at - y.low_at) > 2 AND abs(x.high_at - y.high_at) > 2 AS apart,
coalesce(r, 0) >= 0.6 AND mismatch <= 0.45 AND greatest(abs(x.low - y.low), abs(x.high - y.high)) / x.scale <= 4.5 AND NOT (abs(x.low_at - y.low_at) > 2 AND abs(x.high_at - y.high_at) > 2) AS alike FROM p JOIN h x ON x.user_id = p.a JOIN h y ON y.user_id = p.b""")
def sketch_gates(spark, sf_dir):
    """Neighbouring series compared by their sketches: correlation, largest gap, how often their slopes differ in sign, how far their envelopes and their extrema lie apart, and whether all gates pass."""
    s = keep.sketch(_series(spark, sf_dir), "user_id", "cents", 30)
    w = s.withColumn("slope", F.col("v") - F.lag("v").over(series.Window.partitionBy("user_id").orderBy("s")))
    side = lambda n, by: w.select((F.col("user_id") + by).alias("a"), "s", F.col("v").alias(f"v_{n}"), F.col("slope").alias(f"slope_{n}"))
    met = side("a", 0).join(side("b", -1), ["a", "s"])
    differ = F.when(F.col("slope_a").isNotNull(), F.when(F.col("slope_a") * F.col("slope_b") < 0, 1.0).otherwise(0.0))
    first = lambda f, c, sign: f(F.struct(c, (sign * F.col("s")).alias("s")))
    shape = [x for n in "ab" for x in (F.min(f"v_{n}").alias(f"low_{n}"), F.max(f"v_{n}").alias(f"high_{n}"), first(F.min, f"v_{n}", 1)["s"].alias(f"low_at_{n}"), (-first(F.max, f"v_{n}", -1)["s"]).alias(f"high_at_{n}"))]
    p = met.groupBy("a").agg(F.coalesce(F.nanvl(F.corr("v_a", "v_b"), F.lit(0.0)), F.lit(0.0)).alias("r"), F.max(F.abs(F.expr("v_a - v_b"))).alias("gap"), F.avg(differ).alias("mismatch"), F.stddev_pop("v_a").alias("deviation"), *shape)
    scale = F.greatest(F.lit(1e-5), F.col("deviation"), F.expr("high_a - low_a"))
    p = p.withColumns({"envelope": F.greatest(F.abs(F.expr("low_a - low_b")), F.abs(F.expr("high_a - high_b"))) / scale, "apart": F.expr("abs(low_at_a - low_at_b) > 2 and abs(high_at_a - high_at_b) > 2")})
    return p.select("a", (F.col("a") + 1).alias("b"), _r("correlation", "r"), F.round("gap", 4).alias("gap"), _r("mismatch"), _r("envelope"), "apart", F.expr("r >= 0.6 and mismatch <= 0.45 and envelope <= 4.5 and not apart").alias("alike"))


_FIELDS = """f AS (SELECT l_partkey % 32 AS x, l_suppkey % 32 AS y, l_orderkey % 8 + 8 * (l_orderkey // 8192) AS z, CAST((year(l_shipdate) * 12 + month(l_shipdate)) % 16 AS BIGINT) AS t, avg(l_quantity) AS density, avg(l_discount) AS flames, avg(l_tax) AS temperature,
count(*) FILTER (l_returnflag = 'R') > 0 AS burns FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_FIELDS} SELECT a.t, count(*) AS cells, (SELECT count(DISTINCT t) FROM f) = (SELECT count(DISTINCT t) FROM f WHERE burns) AS aligned, round(avg(a.density), 6) AS density, round(avg(b.flames), 6) AS flames, round(avg(c.temperature), 6) AS temperature, count(b.flames) AS burning
FROM f a LEFT JOIN (SELECT * FROM f WHERE burns) b USING (x, y, z, t) LEFT JOIN f c USING (x, y, z, t) GROUP BY 1""")
def aligned_fields(spark, sf_dir):
    """Three fields of one volume joined cell by cell, and whether they have the same number of frames."""
    lines = _table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") * 12 + F.month("l_shipdate")) % 16).cast("long").alias("t")
    place = [(F.col("l_partkey") % 32).alias("x"), (F.col("l_suppkey") % 32).alias("y"), fields.slab_z("l_orderkey").alias("z"), month]
    f = lines.groupBy(*place).agg(F.avg("l_quantity").alias("density"), F.avg("l_discount").alias("flames"), F.avg("l_tax").alias("temperature"), (F.count_if(F.col("l_returnflag") == "R") > 0).alias("burns"))
    return fields.aligned({"density": f.select("x", "y", "z", "t", "density"), "flames": f.where("burns").select("x", "y", "z", "t", "flames"), "temperature": f.select("x", "y", "z", "t", "temperature")}, "density").groupBy("t").agg(
        F.count(F.lit(1)).alias("cells"), F.bool_and("aligned").alias("aligned"), *[F.round(F.avg(c), 6).alias(c) for c in ("density", "flames", "temperature")], F.count("flames").alias("burning")
    )


@query(f"""WITH {CELLS}, i AS (SELECT t, x, y, avg(v) AS a FROM cells GROUP BY 1, 2, 3), r AS (SELECT t, x, y, avg(p) AS b FROM paired GROUP BY 1, 2, 3), m AS (SELECT r.t, i.t - r.t AS step, avg((a - b) * (a - b)) AS mse FROM r JOIN i ON i.x = r.x AND i.y = r.y AND i.t BETWEEN r.t - 1 AND r.t + 1 GROUP BY 1, 2)
SELECT t, round(max(mse) FILTER (step = -1), 6) AS previous, round(max(mse) FILTER (step = 0), 6) AS selected, round(max(mse) FILTER (step = 1), 6) AS next, coalesce(max(mse) FILTER (step = 0) <= min(mse) FILTER (step <> 0), true) AS nearest FROM m GROUP BY 1""")
def neighbouring_frames(spark, sf_dir):
    """Whether each predicted frame is nearer to its own original than to the frames before and after."""
    paired = _paired(spark, sf_dir)
    images = paired.groupBy("t", "x", "y").agg(F.avg("v").alias("a"), F.avg("p").alias("b"))
    predicted = images.select("t", "x", "y", "b", F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)])).alias("step"))
    originals = images.select(F.col("t").alias("other"), "x", "y", "a")
    m = predicted.withColumn("other", F.col("t") + F.col("step")).join(originals, ["other", "x", "y"]).groupBy("t", "step").agg(F.avg(F.expr("(a - b) * (a - b)")).alias("mse"))
    of = lambda s: F.max(F.when(F.col("step") == s, F.col("mse")))
    near = F.coalesce(of(0) <= F.min(F.when(F.col("step") != 0, F.col("mse"))), F.lit(True))
    return m.groupBy("t").agg(F.round(of(-1), 6).alias("previous"), F.round(of(0), 6).alias("selected"), F.round(of(1), 6).alias("next"), near.alias("nearest"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS state, round(o_totalprice, 2) AS price FROM orders), b AS (SELECT l_orderkey AS k, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS state, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT k, b.k IS NOT NULL AS found, coalesce(a.state = b.state, false) AS same_state, coalesce(lines, 0) AS lines FROM a LEFT JOIN b USING (k)""")
def log_equality(spark, sf_dir):
    """Two logs of the same runs joined one to one, with what is equal in both."""
    a = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"))
    one = lambda s: F.bool_and(F.col("l_linestatus") == s)
    b = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(one("F"), "F").when(one("O"), "O").otherwise("P").alias("state_b"), F.count(F.lit(1)).alias("lines"))
    j = a.join(b, "k", "left")
    return j.select("k", F.col("lines").isNotNull().alias("found"), F.coalesce(F.col("state") == F.col("state_b"), F.lit(False)).alias("same_state"), F.coalesce("lines", F.lit(0).cast("long")).alias("lines"))


@query("""WITH built AS (SELECT c_nationkey AS k, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1), stored AS (SELECT c_nationkey AS k, CAST(count(*) + CASE WHEN c_nationkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey % 7 <> 3 GROUP BY 1)
SELECT 'missing' AS state, * FROM (SELECT * FROM built EXCEPT SELECT * FROM stored) UNION ALL SELECT 'stale', * FROM (SELECT * FROM stored EXCEPT SELECT * FROM built)""")
def catalog_differences(spark, sf_dir):
    """A catalogue built anew against the stored one: rows that one of them lacks, which must be none for equality."""
    c = _table(spark, sf_dir, "customer")
    built = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    stored = built.where("k % 7 <> 3").withColumn("n", F.col("n") + F.when(F.col("k") % 6 == 0, 1).otherwise(0))
    return built.exceptAll(stored).withColumn("state", F.lit("missing")).unionByName(stored.exceptAll(built).withColumn("state", F.lit("stale"))).select("state", "k", "n", "total")


@query("""WITH a AS (SELECT s_suppkey AS k, 'dir' || (s_nationkey % 9) AS folder, 'run' || s_suppkey || '.raw' AS name FROM supplier), m AS (SELECT 'dir' || (s_nationkey % 9) AS folder, 'run' || s_suppkey || '.metadata.json' AS meta FROM supplier WHERE s_suppkey % 3 = 0),
one AS (SELECT folder, min(meta) AS sole FROM m GROUP BY 1 HAVING count(*) = 1) SELECT k, a.folder, coalesce(m.meta, sole) AS meta, m.meta IS NOT NULL AS exact FROM a LEFT JOIN m ON m.folder = a.folder AND m.meta = regexp_replace(name, '\\.raw$', '.metadata.json') LEFT JOIN one ON one.folder = a.folder""")
def metadata_lookup(spark, sf_dir):
    """The description of each file: the one of its own name, or the only one of its folder."""
    s = _table(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("dir"), (F.col("s_nationkey") % 9).cast("string"))
    a = s.select(F.col("s_suppkey").alias("k"), folder.alias("folder"), F.concat(F.lit("run"), F.col("s_suppkey").cast("string"), F.lit(".raw")).alias("name"))
    m = s.where("s_suppkey % 3 = 0").select(folder.alias("folder"), F.concat(F.lit("run"), F.col("s_suppkey").cast("string"), F.lit(".metadata.json")).alias("meta"))
    only = m.groupBy("folder").agg(F.min("meta").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").select("folder", "only")
    named = a.withColumn("meta", F.regexp_replace("name", r"\.raw$", ".metadata.json"))
    exact = named.join(m.withColumn("exact", F.lit(True)), ["folder", "meta"], "left").join(only, "folder", "left")
    return exact.select("k", "folder", F.when(F.col("exact"), F.col("meta")).otherwise(F.col("only")).alias("meta"), F.coalesce("exact", F.lit(False)).alias("exact"))


@query("""SELECT p_partkey AS k, p_name AS name, lower(p_type) AS category FROM part WHERE NOT (contains(lower(p_type), 'standard') AND contains(p_brand, '1'))""")
def category_filter(spark, sf_dir):
    """Rows without those that two categories hold twice."""
    both = F.contains(F.lower("p_type"), F.lit("standard")) & F.contains(F.col("p_brand"), F.lit("1"))
    return _table(spark, sf_dir, "part").where(~both).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"))


@query(f"""WITH {CELLS} SELECT x, y, z, t, v FROM cells WHERE abs(v - 25) > 20""")
def sparse_grid(spark, sf_dir):
    """The cells that differ enough from the background."""
    return fields.field_cells(_table(spark, sf_dir, "lineitem")).where(F.abs(F.col("v") - 25) > 20)


@query(f"""WITH {CELLS}, a AS (SELECT leaf_id, t, max(v) >= 49 AS active FROM leafed GROUP BY 1, 2) SELECT leaf_id, t, row_number() OVER (ORDER BY t, leaf_id) AS slot FROM a WHERE active""")
def active_slots(spark, sf_dir):
    """Active leaves of all frames, packed into slots without gaps."""
    a = _cells(spark, sf_dir).groupBy("leaf_id", "t").agg((F.max("v") >= 49).alias("active")).where("active").select("leaf_id", "t")
    return ranks.ranked(a, [F.col("t"), F.col("leaf_id")], "slot")


@query("""SELECT event_id, event_id % 10 AS frame, event_id % 23 - 11 AS delta, ((event_id % 10 + event_id % 23 - 11) % 10 + 10) % 10 AS looped, least(9, greatest(0, event_id % 10 + event_id % 23 - 11)) AS clamped FROM events""")
def timeline_steps(spark, sf_dir):
    """A step on a timeline of ten frames, around or up to the ends."""
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10).alias("frame"), (F.col("event_id") % 23 - 11).alias("delta"))
    return e.withColumn("looped", bits.stepped(F.col("frame"), F.col("delta"), 10, True)).withColumn("clamped", bits.stepped(F.col("frame"), F.col("delta"), 10, False))


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 16 + 1 AS keep, l_suppkey % 4 AS tier, l_orderkey % 250 + 1 AS frames, l_linenumber % 4 AS quant, l_partkey * 7 % 1500 AS events, l_linenumber % 4 AS mode FROM lineitem),
h AS (SELECT *, 1 + (keep - 1) * 4 + tier * 256 + (least(15, CAST(ceil(frames / 16.0) AS BIGINT) - 1)) * 1024 + quant * 16384 + (events % 4096) * 65536 AS word, mode + (frames % 128) * 4 + ((frames + 60) % 128) * 512 + events * 65536 AS plain FROM f)
SELECT k, n, CAST(word AS BIGINT) AS word, CAST(plain AS BIGINT) AS plain, CAST((word >> 2) & 63 AS BIGINT) + 1 AS keep, CAST((word >> 8) & 3 AS BIGINT) AS tier, CAST((word >> 10) & 15 AS BIGINT) + 1 AS per_bin, CAST((word >> 16) & 4095 AS BIGINT) AS events, CAST((plain >> 9) & 127 AS BIGINT) AS last_frame FROM h""")
def header_words(spark, sf_dir):
    """Header words of leaves in both layouts, and what is read back from them."""
    c = F.col
    f = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "l_partkey % 16 + 1 as keep", "l_suppkey % 4 as tier", "l_orderkey % 250 + 1 as frames", "l_linenumber % 4 as quant", "l_partkey * 7 % 1500 as events", "l_linenumber % 4 as mode")
    h = f.select("k", "n", bits.sparse_header(c("keep"), c("tier"), c("frames"), c("quant"), c("events")).alias("word"), bits.plain_header(c("mode"), c("frames"), c("frames") + 60, c("events")).alias("plain"))
    u = bits.unpacked
    return h.select("k", "n", "word", "plain", (u(c("word"), 2, 6) + 1).alias("keep"), u(c("word"), 8, 2).alias("tier"), (u(c("word"), 10, 4) + 1).alias("per_bin"), u(c("word"), 16, 12).alias("events"), u(c("plain"), 9, 7).alias("last_frame"))


_H = "(l_extendedprice - 30000.0::DOUBLE) / (CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1e3 WHEN 3 THEN 1e9 WHEN 4 THEN 1e-3 ELSE 17 END)"


@query(f"""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS n, {_H} AS v FROM lineitem), e AS (SELECT *, abs(v) AS s, greatest(-14, floor(log2(greatest(abs(v), 9.313225746154785e-10)))) AS e0 FROM v), f AS (SELECT *, greatest(-14, CASE WHEN s < pow(2.0, e0) THEN e0 - 1 WHEN s >= pow(2.0, e0 + 1) THEN e0 + 1 ELSE e0 END) AS e FROM e),
b AS (SELECT k, n, v, (e + 14) * 1024 + floor(s / pow(2.0, e - 10) + 0.5) AS b, v < 0 AS neg FROM f), h AS (SELECT k, n, CAST(CASE WHEN b >= 31744 THEN 31744 ELSE b END AS BIGINT) AS b, neg FROM b)
SELECT k, n, b + CASE WHEN neg THEN 32768 ELSE 0 END AS half, CASE WHEN b = 31744 THEN NULL ELSE round((CASE WHEN neg THEN -1 ELSE 1 END) * CASE WHEN b < 1024 THEN b * pow(2.0, -24) ELSE (1 + (b % 1024) / 1024.0::DOUBLE) * pow(2.0, b // 1024 - 15) END, 9) END AS v FROM h""")
def half_floats(spark, sf_dir):
    """Values of many sizes as half floats and back; what is too large has no value."""
    lines = _table(spark, sf_dir, "lineitem")
    by = F.when(F.col("l_linenumber") == 1, 1.0).when(F.col("l_linenumber") == 2, 1e3).when(F.col("l_linenumber") == 3, 1e9).when(F.col("l_linenumber") == 4, 1e-3).otherwise(17.0)
    h = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), bits.half_bits((F.col("l_extendedprice") - 30000) / by).alias("half"))
    v = bits.half_value(F.col("half"))
    return h.withColumn("v", F.when(F.abs(v) < 1e9, F.round(v, 9)))


@query(f"""WITH {CELLS}, q AS (SELECT *, CAST(round(v - 25) AS BIGINT) % 8 AS q FROM leafed) SELECT leaf_id, t, voxel, q, CASE WHEN q < 0 THEN q + 16 ELSE q END AS nibble, CASE WHEN q < 0 THEN q ELSE q END AS back, round(abs(v - p0) / greatest(0.5 + 0.02 * abs(v), 1e-6), 6) AS relative,
CASE WHEN v >= 40 THEN 1.0 WHEN v > 10 THEN round((v - 10) / 30.0, 6) ELSE 0.0 END AS ramp, round(CASE WHEN v <= 10 THEN 1 WHEN v >= 35 THEN 3 ELSE 1 + 2 * pow((v - 10) / 25.0, 2) * (3 - 2 * (v - 10) / 25.0) END, 6) AS gain,
CASE WHEN 25 - v <= 0 AND v - 25 <= 20 THEN round(1 - (v - 25) / 20.0, 6) END AS shell, round(exp(-v * 0.04 * 1.5), 6) AS lets_through FROM (SELECT *, CAST(round(v - 25) AS BIGINT) % 8 AS q FROM paired)""".replace(", q AS (SELECT *, CAST(round(v - 25) AS BIGINT) % 8 AS q FROM leafed)", ""))
def cell_formulas(spark, sf_dir):
    """Four-bit codes, relative errors, ramps, shell gain and density, and absorption of every cell."""
    p = _paired(spark, sf_dir).withColumn("q", F.round(F.col("v") - 25).cast("long") % 8).withColumn("nibble", bits.nibble(F.col("q")))
    v = F.col("v")
    return p.select(
        "leaf_id", "t", "voxel", "q", "nibble", bits.from_nibble(F.col("nibble")).alias("back"), F.round(bits.relative_error(v, F.col("p0"), 0.5, 0.02), 6).alias("relative"), F.round(bits.ramp(v, 10.0, 40.0), 6).alias("ramp"),
        F.round(bits.shell_gain(v, 50.0, 0.2, 0.7, 3.0), 6).alias("gain"), F.round(bits.shell_density(25 - v, 20.0), 6).alias("shell"), F.round(bits.beer_lambert(v, 0.04, 1.5), 6).alias("lets_through"),
    )


_HEAT = "least(1.0, greatest(0.0, v / 50.0::DOUBLE))"


def _mix(a, b, lo, hi):
    return f"({a} + ({b} - {a}) * ({_HEAT} - {lo}) / ({hi} - {lo}))"


def _fire_sql(c):
    steps = [(0.0, (0.35, 0.005, 0.0)), (0.12, (1.0, 0.03, 0.0)), (0.35, (1.0, 0.22, 0.005)), (0.62, (1.0, 0.48, 0.02)), (1.0, (1.0, 0.82, 0.28))]
    return "CASE " + " ".join(f"WHEN {_HEAT} < {hi[0]} THEN {_mix(lo[1][c], hi[1][c], lo[0], hi[0])}" for lo, hi in zip(steps[:-1], steps[1:], strict=True)) + f" ELSE {steps[-1][1][c]} END"


_K = "(least(12000.0, greatest(1000.0, v * 260)) / 100.0::DOUBLE)"
_ONE = "least(1.0, greatest(0.0, {}))"


@query(f"""WITH {CELLS} SELECT x, y, z, t, {", ".join(f"round({_fire_sql(i)}, 6) AS fire_{n}" for i, n in enumerate(("red", "green", "blue")))}, round(CASE WHEN {_K} <= 66 THEN 1 ELSE {_ONE.format(f"1.2929362 * pow(greatest({_K} - 60, 1e-9), -0.13320476)")} END, 6) AS red,
round(CASE WHEN {_K} <= 66 THEN {_ONE.format(f"0.39008158 * ln({_K}) - 0.63184144")} ELSE {_ONE.format(f"1.1298909 * pow(greatest({_K} - 60, 1e-9), -0.07551485)")} END, 6) AS green, round(CASE WHEN {_K} >= 66 THEN 1 WHEN {_K} <= 19 THEN 0 ELSE {_ONE.format(f"0.5432068 * ln(greatest({_K} - 10, 1e-9)) - 1.1962541")} END, 6) AS blue FROM cells""")
def colour_ramps(spark, sf_dir):
    """Every cell's colour as fire and as a black body."""
    cells = fields.field_cells(_table(spark, sf_dir, "lineitem"))
    fires = [F.round(bits.fire(F.col("v") / 50.0, i), 6).alias(f"fire_{n}") for i, n in enumerate(("red", "green", "blue"))]
    return cells.select("x", "y", "z", "t", *fires, *[F.round(c, 6).alias(n) for n, c in bits.black_body(F.col("v") * 260).items()])


@query("""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 3 THEN 'x,' || c_custkey ELSE (c_custkey % 50) || ',' || (c_nationkey - 12) || ', ' || (c_custkey % 7) END AS text, c_acctbal / 1000.0::DOUBLE AS wheel FROM customer)
SELECT k, regexp_matches(text, '^\\s*-?\\d+\\s*,\\s*-?\\d+\\s*,\\s*-?\\d+\\s*$') AS valid, coalesce(TRY_CAST(regexp_extract(text, '^\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*$', 1) AS BIGINT), 0) AS x, coalesce(TRY_CAST(regexp_extract(text, '^\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*$', 2) AS BIGINT), 0) AS y, coalesce(TRY_CAST(regexp_extract(text, '^\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*$', 3) AS BIGINT), 0) AS z,
round(least(6.0, greatest(0.75, 2.0 * exp(-wheel * 0.12))), 6) AS distance, round(least(1.45, greatest(-1.45, 0.2 + wheel / 3.0)), 6) AS pitch FROM s""")
def parsed_triples(spark, sf_dir):
    """Triples read from texts, and a camera's zoom and pitch kept in bounds."""
    text = F.when(F.col("c_custkey") % 4 == 3, F.concat(F.lit("x,"), F.col("c_custkey"))).otherwise(F.concat((F.col("c_custkey") % 50).cast("string"), F.lit(","), (F.col("c_nationkey") - 12).cast("string"), F.lit(", "), (F.col("c_custkey") % 7).cast("string")))
    s = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), bits.triple(text).alias("p"), (F.col("c_acctbal") / 1000.0).alias("wheel"))
    zero = lambda a: F.coalesce(f"p.{a}", F.lit(0).cast("long")).alias(a)
    return s.select("k", F.col("p").isNotNull().alias("valid"), zero("x"), zero("y"), zero("z"), F.round(clamp(2.0 * F.exp(-F.col("wheel") * 0.12), 0.75, 6.0), 6).alias("distance"), F.round(clamp(0.2 + F.col("wheel") / 3.0, -1.45, 1.45), 6).alias("pitch"))


@query("""WITH t AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az, CAST(embedding[4] AS DOUBLE) AS bx, CAST(embedding[5] AS DOUBLE) AS by_, CAST(embedding[6] AS DOUBLE) AS bz, CAST(embedding[7] AS DOUBLE) AS cx, CAST(embedding[8] AS DOUBLE) AS cy, CAST(embedding[9] AS DOUBLE) AS cz FROM embeddings),
e AS (SELECT vec_id, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM t), n AS (SELECT vec_id, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM e), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM n)
SELECT a.vec_id, round(a.len / 2, 6) AS area, round(a.nx / a.len, 6) AS nx, round(a.ny / a.len, 6) AS ny, round(a.nz / a.len, 6) AS nz, round(degrees(acos(least(1.0, greatest(-1.0, (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / (a.len * b.len))))), 4) AS angle FROM l a LEFT JOIN l b ON b.vec_id = a.vec_id + 1""")
def triangle_normals(spark, sf_dir):
    """A triangle of each vector's first nine values: area, normal, and the angle to the next one's normal."""
    at = lambda i: F.get("embedding", i).cast("double")
    edge = lambda j: tuple(at(3 * j + i) - at(i) for i in range(3))
    n = bits.cross(edge(1), edge(2))
    l = _table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"n{a}") for a, c in zip("xyz", n, strict=True)]).withColumn("len", bits.length((F.col("nx"), F.col("ny"), F.col("nz"))))  # noqa: E741
    nxt = l.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"{c}_") for c in ("nx", "ny", "nz", "len")])
    cosine = F.expr("least(1e0, greatest(-1e0, (nx * nx_ + ny * ny_ + nz * nz_) / (len * len_)))")
    return l.join(nxt, "vec_id", "left").select("vec_id", _r("area", "len / 2"), *[_r(c, f"{c} / len") for c in ("nx", "ny", "nz")], F.round(F.degrees(F.acos(cosine)), 4).alias("angle"))
