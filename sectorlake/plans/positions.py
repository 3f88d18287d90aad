"""Position and matching queries: unit conversions, block extents, free runs, arrival order, levels, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.operators.reports import pearson
from sectorlake.operators import matching
from sectorlake.plans import images, signals, timeline
from sectorlake.plans.registry import query
from sectorlake.plans.timeline import table


@query(
    "position_conversions",
    """WITH e AS (SELECT event_id, event_id * 37 AS n, 3000 + event_id % 30000 AS rate, event_id % 4096 AS f, 1 + event_id % 60 AS fps, event_id % 256 AS b FROM events)
SELECT event_id, n - n % 512 AS aligned, CASE WHEN rate >= 24000 THEN 0 WHEN rate >= 12000 THEN 1 WHEN rate >= 6000 THEN 2 ELSE 3 END AS rate_code,
  f * 31468 // 15 // 2 - (f * 31468 // 15 // 2) % 512 AS adpcm_byte, greatest(0, f * 1000000 // 4096 - 1440) AS mp2_byte,
  least(10, greatest(1, (60 + fps // 2) // fps)) AS fields, b // 16 + b % 16 * 16 AS swapped FROM e""",
)
def position_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P5, P7, P8, P9, P19 over event ordinals."""
    c = F.col
    e = table(spark, sf_dir, "events").select(
        "event_id", (c("event_id") * 37).alias("n"), (3000 + c("event_id") % 30000).alias("rate"), (c("event_id") % 4096).alias("f"),
        (1 + c("event_id") % 60).alias("fps"), (c("event_id") % 256).alias("b"),
    )
    return e.select(
        "event_id", U.align_down(c("n")).alias("aligned"), U.rate_code_by_threshold(c("rate")).alias("rate_code"),
        U.frame_to_adpcm_byte(c("f"), F.lit(timeline.RATE), F.lit(15), F.lit(1)).alias("adpcm_byte"),
        U.frame_to_mp2_byte(c("f"), F.lit(1_000_000), F.lit(4096)).alias("mp2_byte"),
        U.fields_per_frame(c("fps"), F.lit(1)).alias("fields"), U.swap_nibbles(c("b")).alias("swapped"),
    )


@query(
    "block_extents",
    f"""WITH RECURSIVE {timeline._INTERLEAVED}
SELECT b.stream_id, b.block, 2 * b.bytes AS samples, (b.bytes + 2047) // 2048 AS sectors, CASE WHEN b.block < 2 THEN 63 + 32 * b.block ELSE p.video_sector + 4 END AS sector
FROM blocks b LEFT JOIN schedule s ON s.stream_id = b.stream_id AND s.block = b.block AND s.block > 1
LEFT JOIN placed p ON p.stream_id = s.stream_id AND p.frame = s.frame""",
)
def block_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and extent of every audio block of a source."""
    found = matching.block_extents(timeline._audio(spark, sf_dir), timeline._interleaved(spark, sf_dir), timeline.DATA_START)
    return found.select("stream_id", "block", (2 * F.col("bytes")).alias("samples"), "sectors", "sector")


@query(
    "arrival_order",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((l_linenumber - 1) * 100 AS BIGINT) AS first_byte, CAST(CASE WHEN l_partkey % 5 = 0 THEN 101 ELSE 100 END AS BIGINT) AS size FROM lineitem),
w AS (SELECT *, coalesce(lag(first_byte + size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) AS expected FROM c)
SELECT l_orderkey, l_linenumber, first_byte, size, expected FROM w WHERE first_byte <> expected""",
)
def arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of an order's stream that begin elsewhere than the previous one ended."""
    size = F.when(F.col("l_partkey") % 5 == 0, 101).otherwise(100).cast("long")
    chunks = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_linenumber") - 1) * 100).cast("long").alias("first_byte"), size.alias("size")
    )
    found = matching.arrival_faults(chunks, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "first_byte", "size")
    return found.select("l_orderkey", "l_linenumber", "first_byte", "size", "expected")


@query(
    "first_free_runs",
    """WITH f AS (SELECT p_partkey // 28 AS shelf, p_partkey AS slot FROM part WHERE p_size > 20),
i AS (SELECT *, slot - row_number() OVER (PARTITION BY shelf ORDER BY slot) AS island FROM f),
r AS (SELECT shelf, min(slot) AS first_slot, count(*) AS n FROM i GROUP BY shelf, island)
SELECT shelf, min(first_slot) AS first_slot, least(8, arg_min(n, first_slot)) AS n FROM r GROUP BY shelf""",
)
def first_free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as slots, 28 a shelf, free over size 20: the first free run of each shelf."""
    free = table(spark, sf_dir, "part").where("p_size > 20").select(U.div(F.col("p_partkey"), 28).alias("shelf"), F.col("p_partkey").alias("slot"))
    return matching.first_free_run(free, ["shelf"], "slot")


@query(
    "ready_high_water",
    """WITH r AS (SELECT user_id, event_id, ts, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ready FROM events)
SELECT user_id, event_id, ready, max(ready) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high FROM r""",
)
def ready_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks fill and views empty a user's slots; the level and its maximum so far."""
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return matching.high_water(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], change).select("user_id", "event_id", "ready", "high")


@query(
    "running_energy",
    f"""WITH {signals._S}, e AS (SELECT user_id, pos, sum(value * value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS energy FROM s)
SELECT user_id, pos, round(energy, 5) AS energy FROM e WHERE pos >= 7""",
)
def running_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each user's last eight samples."""
    found = matching.running_energy(signals.samples(spark, sf_dir), "user_id", "value", 8)
    return found.select("user_id", "pos", F.round("energy", 5).alias("energy"))


@query(
    "resampled_envelope",
    f"""WITH {signals._env(4)}, n AS (SELECT user_id, max(hop) AS last FROM e GROUP BY user_id),
p AS (SELECT user_id, i, i * last / 9.0 AS x FROM n, unnest(range(10)) t(i))
SELECT p.user_id, CAST(i AS INTEGER) AS point, round(a.rms + (x - floor(x)) * (coalesce(b.rms, a.rms) - a.rms), 5) AS rms
FROM p JOIN e a ON a.user_id = p.user_id AND a.hop = CAST(floor(x) AS BIGINT) LEFT JOIN e b ON b.user_id = p.user_id AND b.hop = CAST(floor(x) AS BIGINT) + 1""",
)
def resampled_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's envelope at ten even places."""
    found = matching.resample(signals.envelope(spark, sf_dir, 4), "user_id", "rms", 10)
    return found.withColumn("rms", F.round("rms", 5))


@query(
    "picture_gate",
    f"""WITH {images._PIXELS}, a AS (SELECT vec_id, i, p[i + 1] AS v FROM px, unnest(range(64)) t(i)),
m AS (SELECT a.vec_id, round(avg(CASE WHEN a.i >= 32 THEN CASE WHEN a.v < 100 THEN 1.0 ELSE 0.0 END END), 6) AS dark,
  round(avg(CASE WHEN a.i >= 32 THEN CASE WHEN b.v < 100 THEN 1.0 ELSE 0.0 END END), 6) AS ref_dark, round(avg(abs(a.v - b.v)), 6) AS mae, round(corr(a.v, b.v), 5) AS corr,
  round(avg(CASE WHEN a.i % 8 >= 6 THEN abs(a.v - b.v) END), 6) AS edge, round(avg(CASE WHEN a.i % 8 < 6 THEN abs(a.v - b.v) END), 6) AS body
  FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id)
SELECT vec_id, 'bottom_black' AS rule FROM m WHERE dark > 0.70 AND ref_dark < 0.40
UNION ALL SELECT vec_id, 'black_delta' FROM m WHERE dark - ref_dark > 0.45
UNION ALL SELECT vec_id, 'mae' FROM m WHERE mae > 75
UNION ALL SELECT vec_id, 'corr' FROM m WHERE corr < 0.45
UNION ALL SELECT vec_id, 'edge' FROM m WHERE edge > 2 * body + 12""",
)
def picture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block against the next one as its reference."""
    a, b = F.col("a"), F.col("b")
    metrics = images.beside(spark, sf_dir).select(
        "vec_id", F.round(images.dark_share(a, images.LOWER), 6).alias("dark"), F.round(images.dark_share(b, images.LOWER), 6).alias("ref_dark"),
        F.round(images.mean_error(a, b), 6).alias("mae"), F.round(pearson(a, b), 5).alias("corr"), F.round(images.mean_error(a, b, images.RIGHT), 6).alias("edge"),
        F.round(images.mean_error(a, b, images.BODY), 6).alias("body"),
    )
    return matching.picture_faults(metrics, "vec_id")
