"""Signal queries: each user's event values, in time order, as one sampled signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.operators import adpcm, correlate, series
from sectorlake.plans.registry import query
from sectorlake.plans.timeline import table

WIN = 16


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return series.number_samples(events, "user_id", ["ts", "event_id"])


def envelope(spark: SparkSession, sf_dir: str, win: int = WIN) -> DataFrame:
    """Root mean squares, rounded so that sums in another order give the same."""
    return series.rms_envelope(samples(spark, sf_dir), "user_id", "value", win).withColumn("rms", F.round("rms", 6))


_S = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


def _env(win: int) -> str:
    return f"""{_S}, e AS (SELECT user_id, pos // {win} AS hop, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM s
  GROUP BY user_id, pos // {win} HAVING count(*) = {win})"""


@query("rms_envelope", f"WITH {_env(WIN)} SELECT user_id, hop, rms FROM e")
def rms_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: root mean square of whole windows of 16 samples."""
    return envelope(spark, sf_dir)


@query(
    "active_segments",
    f"""WITH {_env(4)}, p AS (SELECT *, max(rms) OVER (PARTITION BY user_id) AS peak FROM e),
l AS (SELECT user_id, hop FROM p WHERE peak > 1e-7 AND rms > greatest(peak * power(10, -6.0 / 20), 0.0015)),
g AS (SELECT *, CASE WHEN hop - lag(hop) OVER (PARTITION BY user_id ORDER BY hop) - 1 <= 2 THEN 0 ELSE 1 END AS fresh FROM l),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY hop) AS island FROM g)
SELECT user_id, min(hop) AS "start", max(hop) + 1 AS "end" FROM i GROUP BY user_id, island HAVING max(hop) + 1 - min(hop) >= 2""",
)
def active_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops within 6 dB of a user's peak, gaps of up to two hops closed."""
    return series.active_segments(envelope(spark, sf_dir, 4), "user_id", level_db=-6.0, gap=2, min_len=2)


@query(
    "zscore_log_envelope",
    f"WITH {_env(4)} SELECT user_id, hop, round((ln(rms) - avg(ln(rms)) OVER w) / stddev_pop(ln(rms)) OVER w, 5) AS z FROM e WINDOW w AS (PARTITION BY user_id)",
)
def zscore_log_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: standard scores of the logarithmic envelope."""
    scored = series.zscores(envelope(spark, sf_dir, 4), "user_id", F.ln("rms"), "z")
    return scored.select("user_id", "hop", F.round("z", 5).alias("z"))


@query(
    "dynamic_anchor",
    f"""WITH {_env(4)}, d AS (SELECT user_id, hop, count(*) OVER w AS n, round(stddev_pop(rms) OVER w / (avg(rms) OVER w + 1e-9), 9) AS dynamics
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dynamics DESC, hop) AS turn FROM d WHERE n = 8 AND hop % 2 = 0)
SELECT user_id, hop, round(dynamics, 6) AS dynamics FROM r WHERE turn = 1""",
)
def dynamic_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where eight hops of a user's envelope move most."""
    found = series.dynamic_anchor(envelope(spark, sf_dir, 4), "user_id", hops=8, stride=2)
    return found.withColumn("dynamics", F.round("dynamics", 6))


@query(
    "lag_correlation_peak",
    f"""WITH {_S}, c AS (SELECT user_id, pos, value - avg(value) OVER (PARTITION BY user_id) AS x FROM s),
m AS (SELECT a.user_id AS "left", b.user_id AS "right", k AS lag, sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb
  FROM c a, unnest(range(-20, 21)) t(k), c b WHERE b.user_id = a.user_id + 1 AND b.pos = a.pos + k GROUP BY a.user_id, b.user_id, k),
r AS (SELECT "left", "right", lag, round(ab / sqrt(aa * bb), 6) AS corr FROM m WHERE aa > 0 AND bb > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY corr DESC, lag) AS turn FROM r)
SELECT "left", "right", CAST(lag AS INTEGER) AS lag, corr FROM w WHERE turn = 1""",
)
def lag_correlation_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which each user's signal and the next user's go together best."""
    rows = samples(spark, sf_dir)
    pairs = rows.select(F.col("user_id").alias("left")).distinct().withColumn("right", F.col("left") + 1)
    return correlate.lag_correlation(pairs, rows, "user_id", "value", 20)


@query(
    "snr",
    """SELECT user_id, round(10 * log10(CASE WHEN sum(value * value) = 0 THEN 1 ELSE sum(value * value) END /
  CASE WHEN sum((value - floor(value / 4) * 4) * (value - floor(value / 4) * 4)) = 0 THEN 1 ELSE sum((value - floor(value / 4) * 4) * (value - floor(value / 4) * 4)) END), 5) AS snr_db
FROM events GROUP BY user_id""",
)
def snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values against themselves in steps of 4."""
    rows = table(spark, sf_dir, "events").select("user_id", "value", (F.floor(F.col("value") / 4) * 4.0).alias("decoded"))
    return series.snr_db(rows, ["user_id"], "value", "decoded").withColumn("snr_db", F.round("snr_db", 5))


@query(
    "drift",
    f"""WITH {_S}, f AS (SELECT user_id, pos * 524 AS clock, count(*) FILTER (WHERE event_type IN ('click', 'view')) OVER (PARTITION BY user_id ORDER BY pos) AS frames FROM s)
SELECT user_id, round(max(abs(clock / 31468.0 - frames / 15.0)), 6) AS max_drift FROM f GROUP BY user_id""",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a user's events as fields of audio, clicks and views as frames: the largest distance of the clocks."""
    from pyspark.sql import Window

    shown = F.count_if(F.col("event_type").isin("click", "view")).over(Window.partitionBy("user_id").orderBy("pos"))
    rows = samples(spark, sf_dir).withColumn("frames", shown)
    found = series.clock_drift(rows, ["user_id"], F.col("pos") * 524, 31468, F.col("frames"), 15, 1)
    return found.withColumn("max_drift", F.round("max_drift", 6))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pcm): each user's values times ten, about 1000 taken off, as 16-bit samples."""
    rows = samples(spark, sf_dir).withColumn("v", F.floor(F.col("value") * 10).cast("int") - 1000)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return rows.groupBy("user_id").agg(F.transform(ordered, lambda s: s["v"]).alias("pcm"))


_STEPS = ", ".join(map(str, adpcm.STEPS))
_MOVES = ", ".join(map(str, adpcm.INDEX_MOVES))
_CODEC = f"""{_S}, x AS (SELECT user_id, pos, (CAST(floor(value * 10) AS BIGINT) - 1000) AS v FROM s),
k AS (SELECT [{_STEPS}] AS steps, [{_MOVES}] AS moves),
fold(user_id, pos, pred, idx, code, v) AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM events
  UNION ALL
  SELECT f.user_id, x.pos, CAST(b.p AS BIGINT), CAST(greatest(0, least(48, f.idx + k.moves[b.m + 1])) AS BIGINT), CAST(CASE WHEN (x.v >> 1) < f.pred THEN 8 ELSE 0 END + b.m AS BIGINT), x.v
  FROM fold f JOIN x ON x.user_id = f.user_id AND x.pos = f.pos + 1, k,
  LATERAL (SELECT k.steps[f.idx + 1] AS step, (x.v >> 1) AS target) t,
  LATERAL (SELECT greatest(0, least(7, (2 * abs(t.target - f.pred) // t.step + 1) // 2 - 1)) AS near) n,
  LATERAL (SELECT n.near + d AS m, r, greatest(-16384, least(16383, f.pred + CASE WHEN t.target < f.pred THEN -1 ELSE 1 END * t.step * (n.near + d + 1))) AS p
    FROM (VALUES (0, 0), (-1, 1), (1, 2)) c(d, r) WHERE n.near + d BETWEEN 0 AND 7 ORDER BY abs(t.target - p), r LIMIT 1) b)"""


@query(
    "adpcm_encode_summary",
    f"""WITH RECURSIVE {_CODEC}
SELECT user_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS code_sum, CAST(arg_max(pred, pos) AS INTEGER) AS last_pred, CAST(arg_max(idx, pos) AS INTEGER) AS last_index
FROM fold WHERE pos >= 0 GROUP BY user_id""",
)
def adpcm_encode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-loop encoding with a search of the neighbouring magnitudes."""
    encoded = adpcm.encode_signals(pcm(spark, sf_dir), "user_id", "pcm")
    return encoded.select("user_id", "n", "code_sum", "last_pred", "last_index")


@query(
    "adpcm_roundtrip_stats",
    f"""WITH RECURSIVE {_CODEC}, e AS (SELECT user_id, v, greatest(-32768, least(32767, pred * 2)) AS d FROM fold WHERE pos >= 0)
SELECT user_id, CAST(max(abs(v - d)) AS INTEGER) AS max_error, round(10 * log10(CASE WHEN sum(v * v) = 0 THEN 1.0 ELSE sum(v * v) END / CASE WHEN sum((v - d) * (v - d)) = 0 THEN 1.0 ELSE sum((v - d) * (v - d)) END), 5) AS snr_db
FROM e GROUP BY user_id""",
)
def adpcm_roundtrip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals encoded, decoded from their codes and compared."""
    signals = pcm(spark, sf_dir)
    encoded = adpcm.encode_signals(signals, "user_id", "pcm")
    both = signals.join(adpcm.decode_signals(encoded, "user_id", "codes"), "user_id")
    rows = both.select("user_id", F.explode(F.arrays_zip("pcm", "decoded")).alias("p")).select("user_id", F.col("p.pcm").cast("double").alias("v"), F.col("p.decoded").cast("double").alias("d"))
    error = rows.groupBy("user_id").agg(F.max(F.abs(F.col("v") - F.col("d"))).cast("int").alias("max_error"))
    return error.join(series.snr_db(rows, ["user_id"], "v", "d"), "user_id").withColumn("snr_db", F.round("snr_db", 5))


#: Codes of one block of ``adpcm_streams``.
PER_BLOCK = 512


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal, block, n, data): every fifth event's value as a 4-bit code, PER_BLOCK codes a block, high nibble first."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 5).alias("signal"), F.call_function("div", F.col("event_id"), F.lit(5)).alias("pos"), F.hex((F.floor(F.col("value") * 10) % 16).cast("long")).alias("digit")
    )
    block = F.call_function("div", F.col("pos"), F.lit(PER_BLOCK)).alias("block")
    listed = rows.groupBy("signal", block).agg(F.array_sort(F.collect_list(F.struct("pos", "digit"))).alias("c"))
    return listed.select("signal", "block", F.size("c").alias("n"), adpcm.codes_to_bytes(F.array_join(F.transform("c", lambda c: c["digit"]), ""), low_first=False).alias("data"))


@query(
    "adpcm_streams",
    f"""WITH RECURSIVE l AS (SELECT event_id % 5 AS signal, list(CAST(floor(value * 10) AS BIGINT) % 16 ORDER BY event_id) AS codes FROM events GROUP BY event_id % 5),
k AS (SELECT [{_STEPS}] AS steps, [{_MOVES}] AS moves),
v(variant, linear, low, high, start, scale, base) AS (VALUES ('signed15', true, -16384, 16383, 0, 2, 0), ('unsigned15', true, 0, 32767, 16384, 2, -32768),
  ('oki12', false, 0, 65535, 32768, 1, -32768), ('wrapping12', false, 0, 65520, 32768, 1, -32768)),
fold(signal, variant, pos, idx, pred, heard) AS (
  SELECT signal, variant, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(start AS BIGINT), CAST(0 AS BIGINT) FROM l, v
  UNION ALL
  SELECT f.signal, f.variant, f.pos + 1, CAST(greatest(0, least(48, f.idx + moves[c % 8 + 1])) AS BIGINT), CAST(CASE WHEN f.variant = 'wrapping12' THEN ((f.pred + d) % 65536 + 65536) % 65536 ELSE greatest(low, least(high, f.pred + d)) END AS BIGINT),
    CAST(greatest(low, least(high, f.pred + d)) AS BIGINT)
  FROM fold f JOIN l ON l.signal = f.signal AND f.pos + 1 < len(l.codes) JOIN v ON v.variant = f.variant, k,
  LATERAL (SELECT l.codes[f.pos + 2] AS c, steps[f.idx + 1] AS s) x,
  LATERAL (SELECT CASE WHEN c >= 8 THEN -1 ELSE 1 END * CASE WHEN linear THEN s * (c % 8 + 1) ELSE 16 * ((s >> 3) + (c >> 2 & 1) * s + (c >> 1 & 1) * (s >> 1) + (c & 1) * (s >> 2)) END AS d) y)
SELECT signal, variant, pos // {PER_BLOCK} AS block, count(*) AS n, CAST(sum(greatest(-32768, least(32767, heard * scale + base)) * (pos % 7 + 1)) AS BIGINT) AS checksum, min(heard) AS low, max(heard) AS high
FROM fold JOIN v USING (variant) WHERE pos >= 0 GROUP BY signal, variant, pos // {PER_BLOCK}""",
)
def adpcm_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of codes cut into blocks, decoded by all four forms; a weighted sum and the predictor's extremes a block."""
    blocks = code_blocks(spark, sf_dir)
    found = None
    for variant in adpcm.VARIANTS:
        weight = (F.col("block") * PER_BLOCK).cast("long")
        total = F.aggregate(F.transform("pcm", lambda x, i: x * ((weight + i) % 7 + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        part = adpcm.decode_blocks(blocks, "signal", variant, low_first=False).select(
            "signal", F.lit(variant).alias("variant"), "block", F.size("pcm").cast("long").alias("n"), total.alias("checksum"), "low", "high"
        )
        found = part if found is None else found.unionByName(part)
    return found


@query(
    "bias_ramps",
    """WITH RECURSIVE n AS (SELECT event_id % 35 AS signal, count(*) AS n FROM events GROUP BY event_id % 35),
walk(signal, bias, pos, v) AS (
  SELECT signal, b, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM n, (VALUES (0), (21), (150), (900)) t(b)
  UNION ALL
  SELECT w.signal, bias, w.pos + 1, CASE WHEN n.n < 200 THEN 0 WHEN n.n - w.pos - 2 < (bias + 1) // 2 THEN CASE WHEN w.v > 0 THEN w.v - 2 ELSE w.v END WHEN w.v < (bias + 1) // 2 * 2 THEN w.v + 2 ELSE w.v END
  FROM walk w JOIN n ON n.signal = w.signal AND w.pos + 1 < n.n)
SELECT signal, bias, pos, v AS ramp FROM walk WHERE pos >= 0""",
)
def bias_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DC bias at each sample of streams made of events, for four biases. The oracle walks the samples."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 35).alias("signal"), F.call_function("div", F.col("event_id"), F.lit(35)).alias("pos"))
    sized = rows.join(rows.groupBy("signal").agg(F.count("*").alias("n")), "signal")
    ramps = F.explode(F.array(*[F.struct(F.lit(b).alias("bias"), adpcm.bias_ramp(F.col("pos"), F.col("n"), b).alias("ramp")) for b in (0, 21, 150, 900)])).alias("r")
    return sized.select("signal", "pos", ramps).select("signal", "r.bias", "pos", "r.ramp")
