"""Registered queries that write to sinks and read back, run streams to their end, and fit models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import models as M
from gridloom.operators import series as W
from gridloom.operators.steps import scratch
from gridloom.plans.queries import OBS, POINTS, PX, observations, pixels, points, query, r, table
from gridloom.sources import files, sinks
from gridloom.streaming import forms


@query(f"""WITH {POINTS} SELECT 'P' || id AS name, CAST(printf('%.4f', lat) AS DOUBLE) AS lat, CAST(printf('%.1f', lon) AS DOUBLE) AS lon, DATE '2024-01-05' + CAST(nation AS INTEGER) AS day FROM points""")
def s15_point_requests(spark, sf_dir):
    path, p = scratch(spark), points(spark, sf_dir)
    day = F.date_add(F.lit("2024-01-05").cast("date"), F.col("nation").cast("int"))
    p.select(F.concat(F.lit("P"), F.col("id")).alias("name"), F.format_string("%.4f", "lat").alias("lat"), F.format_string("%.1f", "lon").alias("lon"), day.alias("day")).write.option("header", "true").csv(path)
    return files.point_requests(spark, path)


@query(f"""WITH {PX}, c AS (SELECT cell, t, count(value) AS n FROM px GROUP BY ALL) SELECT cell || '_' || t AS product, 's' || t AS source, CASE WHEN n = 0 THEN 'SKIP_EMPTY' WHEN n < 45 THEN 'SKIP_PARTIAL' ELSE 'CLIP' END AS action, n / 4.0 AS area_km2, n AS valid_pixels FROM c""")
def s17_manifest(spark, sf_dir):
    path = scratch(spark)
    rows = A.clip_actions(pixels(spark, sf_dir), ["cell", "t"], "value", 45)
    n = F.col("valid_pixel_count")
    files.write_manifest(rows.select(F.concat_ws("_", "cell", "t").alias("product"), F.concat(F.lit("s"), F.col("t")).alias("source"), "action", (n / 4).alias("area_km2"), n.alias("valid_pixels")), path)
    return files.read_manifest(spark, path)


@query(f"""WITH {OBS} SELECT cell, band AS modality, day, round(value, 4) AS value FROM obs WHERE day >= (SELECT max(day) - 7 FROM obs)""")
def s19_blocks_of_a_window(spark, sf_dir):
    """All blocks go to the store; only the last eight days' partitions are read back."""
    path, obs = scratch(spark), observations(spark, sf_dir)
    sinks.put_blocks(obs.select("cell", F.col("band").alias("modality"), "day", "value"), path)
    last = obs.agg(F.max("day").alias("d"), F.date_sub(F.max("day"), 7).alias("f")).first()
    return sinks.blocks_between(spark, path, str(last.f), str(last.d)).select("cell", "modality", "day", r("value").alias("value"))


@query(f"""WITH {OBS} SELECT day, round(count(value) / (SELECT count(*) FROM (SELECT DISTINCT cell, band FROM obs))::DOUBLE, 6) AS coverage FROM obs GROUP BY day""")
def s21_mosaic_coverage(spark, sf_dir):
    path, obs = scratch(spark), observations(spark, sf_dir)
    expected = obs.select("cell", "band").distinct().count()
    sinks.write_mosaic(obs.select("day", "cell", "band", "value"), f"{path}/pixels", f"{path}/stats", expected)
    return spark.read.parquet(f"{path}/stats").select("day", r("coverage", 6).alias("coverage"))


@query(f"""WITH {OBS} SELECT 'events' AS tier, band, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM obs GROUP BY band HAVING count(value) >= 2""")
def s23_statistics(spark, sf_dir):
    path = scratch(spark)
    files.write_statistics(A.band_statistics(observations(spark, sf_dir), ["band"], "value").withColumn("tier", F.lit("events")), path)
    return files.read_statistics(spark, path).select("tier", "band", "n", r("mean").alias("mean"), r("std").alias("std"))


def _events(spark, sf_dir) -> DataFrame:
    """One reading for each user and moment, as a table of a few files."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), "event_type")
    return e.groupBy("user_id", "ts").agg(F.max("value").alias("value"), F.min("event_type").alias("event_type"))


_EVENTS = """e AS (SELECT user_id, ts, max(CASE WHEN value >= 5 THEN value END) AS value, min(event_type) AS event_type FROM events GROUP BY user_id, ts)"""


def _stream(spark, sf_dir) -> DataFrame:
    """The readings as a stream over a written table."""
    path = scratch(spark)
    rows = _events(spark, sf_dir)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _ended(stream: DataFrame) -> DataFrame:
    """What a stream has put out once it has read all there is."""
    path = scratch(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query(f"""WITH {_EVENTS} SELECT DISTINCT user_id, event_type FROM e""")
def x02_first_sightings(spark, sf_dir):
    return _ended(forms.first_sightings(_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query(f"""WITH {_EVENTS}, d AS (SELECT ts::DATE AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY ALL) SELECT * FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM e)""")
def t03_days_behind_the_frontier(spark, sf_dir):
    """A day's block is put out, and its state let go, once the latest reading is seven days past it."""
    blocks = _ended(forms.daily_blocks(_stream(spark, sf_dir), "ts", ["event_type"], "value"))
    return blocks.select(F.to_date("start").alias("day"), "event_type", "n", r("mean", 6).alias("mean"))


@query(f"""WITH {_EVENTS} SELECT CAST(user_id AS VARCHAR) AS key, ts, last_value(value IGNORE NULLS) OVER w AS filled, round(coalesce(epoch(ts) - epoch(last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w), -1), 3) AS age_s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def t04_carried_values(spark, sf_dir):
    carried = _ended(forms.carried_values(_stream(spark, sf_dir), "ts", "user_id", "value", "3650 days"))
    return carried.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "filled", r("age_s", 3).alias("age_s"))


@query(f"""WITH {_EVENTS} SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total FROM e GROUP BY ALL""")
def t06_daily_sweep(spark, sf_dir):
    path = scratch(spark)
    forms.sweep(_stream(spark, sf_dir).withColumn("day", F.to_date("ts")), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("day").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query(None)
def m01_forest(spark, sf_dir):
    """RMSE of the line items of suppliers that the forest was not fitted on, each and all, over three features."""
    features = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", *features)
    parts = W.split_exact(rows, ["l_suppkey"], 0.2, "split")
    forest = M.fit_forest(parts.where("part = 'train'"), features, "l_extendedprice", trees=20, depth=8)
    scored = M.predicted(forest, parts.where("part = 'test'"), features, ["l_suppkey", "l_extendedprice"])
    return A.with_pooled(scored, "l_suppkey", "l_extendedprice", "prediction")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_discount * 5 + l_tax * 2, 0), 1), 6) AS score FROM lineitem""")
def m05_batch_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4])
    scored = M.score_batches(rows, lambda b: (b["l_discount"] * 5 + b["l_tax"] * 2).clip(0, 1), rows.columns[:4], schema)
    return scored.withColumn("score", r("score", 6))


@query(None)
def m02_logistic(spark, sf_dir):
    """Whether a line item was sent back, by a logistic regression over three features: of suppliers it was not fitted on, the classes and how many of each are foretold so."""
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("double").alias("label"), *features)
    parts = W.split_exact(rows, ["l_suppkey"], 0.2, "split")
    scored = M.predicted(M.fit_logistic(parts.where("part = 'train'"), features, "label"), parts.where("part = 'test'"), features, ["label"])
    return A.confusion(scored, "label", "prediction")
