"""Reports, gates and round trips of the binary formats over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.functions.prefix import exclusive_sums, numbered
from sectorlake.operators import blocks8, correlate, lookup, matching, placement, reports, series
from sectorlake.plans import images
from sectorlake.plans.images import _PIXELS, _QUANT, QUALITY_75, mp2_profiles, pixels
from sectorlake.plans.registry import query
from sectorlake.plans.signals import _env, envelope, samples
from sectorlake.plans.timeline import _SIZED, payloads, table
from sectorlake.sources import container, disc, files, riff, tables, text
from sectorlake.sources.shared import shared_folder, written


@query(
    "frame_totals",
    f"""WITH {_SIZED} SELECT source, max((bytes + 2047) // 2048) AS max_sectors, CAST(sum((bytes + 2047) // 2048) AS BIGINT) AS total_sectors,
  count(*) FILTER (WHERE bytes > 2048) AS chunks FROM sized GROUP BY source""",
)
def frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's largest payload, all its sectors, and payloads of more than one sector."""
    docs = table(spark, sf_dir, "documents").select("source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return reports.frame_totals(docs, ["source"], F.col("bytes"), F.col("bytes") > 2048)


@query("capped_frames", f"WITH {_SIZED} SELECT doc_id, bytes FROM sized ORDER BY bytes DESC, doc_id LIMIT 240")
def capped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L3: the cap is the feature: the 240 largest payloads."""
    return reports.first_rows(payloads(spark, sf_dir), [F.desc("bytes"), F.asc("doc_id")], 240)


_STEPS = """steps AS (SELECT vec_id, label, x, avg(abs(p[y * 8 + x + 1] - p[y * 8 + x])) AS d FROM px, unnest(range(1, 8)) a(x), unnest(range(8)) b(y) GROUP BY vec_id, label, x),
along AS (SELECT vec_id, avg(abs(p[y * 8 + x + 2] - p[y * 8 + x + 1])) FILTER (WHERE x = 6) AS r, avg(abs(p[y * 8 + x + 2] - p[y * 8 + x + 1])) FILTER (WHERE x BETWEEN 2 AND 4) AS l
  FROM px, unnest(range(7)) a(x), unnest(range(8)) b(y) GROUP BY vec_id),
down AS (SELECT vec_id, avg(abs(p[y * 8 + x + 9] - p[y * 8 + x + 1])) FILTER (WHERE x >= 6) AS r, avg(abs(p[y * 8 + x + 9] - p[y * 8 + x + 1])) FILTER (WHERE x BETWEEN 2 AND 5) AS l
  FROM px, unnest(range(8)) a(x), unnest(range(7)) b(y) GROUP BY vec_id),
edge AS (SELECT s.vec_id, round(max(d) FILTER (WHERE x = 6) / (avg(d) FILTER (WHERE x IN (2, 4)) + 1e-6), 6) AS seam, round(max(a.r + n.r) / (max(a.l + n.l) + 1e-6), 6) AS noise
  FROM steps s JOIN along a ON a.vec_id = s.vec_id JOIN down n ON n.vec_id = s.vec_id GROUP BY s.vec_id),
lit AS (SELECT vec_id, len(list_filter(p, lambda v: v > 130)) / 64 AS lit FROM px)"""


@query(
    "edge_corruption",
    f"WITH {_PIXELS}, {_STEPS} SELECT edge.vec_id, lit, seam, noise, lit >= 0.05 AND seam > 2 AND noise > 2 AS corrupt FROM edge JOIN lit ON lit.vec_id = edge.vec_id",
)
def edge_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lit share, seam and unrest of each block's last two columns."""
    seam, noise = reports.seam_and_noise(F.col("pixels"), 8, 8, seam=6, grid=2)
    found = pixels(spark, sf_dir).select("vec_id", reports.lit_fraction(F.col("pixels"), 130).alias("lit"), F.round(seam, 6).alias("seam"), F.round(noise, 6).alias("noise"))
    return found.withColumn("corrupt", reports.is_corrupt(F.col("lit"), F.col("seam"), F.col("noise")))


@query(
    "start_checkpoint",
    "SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'purchase' AND value > 200), max(event_id)) AS event_id FROM events GROUP BY user_id",
)
def start_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first large purchase, else the last event."""
    return series.start_checkpoint(table(spark, sf_dir, "events"), ["user_id"], "event_id", (F.col("event_type") == "purchase") & (F.col("value") > 200))


@query(
    "block_error",
    f"""WITH {_QUANT} SELECT dct.vec_id, round(sum(CASE WHEN dct.j = 0 THEN 1.6 WHEN dct.j < 16 THEN 1.15 ELSE 1.0 END * (c - q * ([{", ".join(map(str, QUALITY_75))}])[dct.j + 1])
  * (c - q * ([{", ".join(map(str, QUALITY_75))}])[dct.j + 1])), 3) AS error FROM dct JOIN q ON q.vec_id = dct.vec_id AND q.j = dct.j GROUP BY dct.vec_id""",
)
def block_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted squared error of each block's coefficients after quantization."""
    dct = blocks8.forward_dct(pixels(spark, sf_dir), "pixels").withColumn("q", blocks8.quantize(F.col("coefficients"), QUALITY_75))
    restored = F.zip_with("q", F.array(*[F.lit(float(s)) for s in QUALITY_75]), lambda q, s: q * s)
    return dct.select("vec_id", F.round(blocks8.weighted_error(F.col("coefficients"), restored), 3).alias("error"))


@query(
    "codec_mismatches",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'none' WHEN (p_partkey % 4) & 2 <> 0 THEN 'mp2' WHEN (p_partkey % 4) & 1 <> 0 THEN 'adpcm' ELSE 'unknown' END AS codec,
  CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'adpcm' ELSE 'mp2' END AS expected FROM part)
SELECT p_partkey, codec, expected FROM s WHERE codec <> expected""",
)
def codec_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as streams, their flags against the build's codec."""
    streams = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 4).alias("flags"), (F.col("p_size") % 5).alias("audio_bytes"))
    return reports.codec_mismatches(streams, "p_partkey", F.when(F.col("p_size") % 3 == 0, "none").when(F.col("p_size") % 3 == 1, "adpcm").otherwise("mp2"))


@query(
    "disc_faults",
    """WITH d AS (SELECT s_suppkey, CAST(abs(s_acctbal) * 300 AS BIGINT) AS program_bytes, s_suppkey * 37 % 700 * (s_suppkey % 3) AS blocks, s_suppkey * 11 % 300 AS files FROM supplier),
b AS (SELECT *, (program_bytes + 2047) // 2048 AS need, CASE WHEN blocks = 0 THEN (program_bytes + 2047) // 2048 ELSE blocks END AS held FROM d)
SELECT s_suppkey, 'blocks' AS rule FROM b WHERE held < need
UNION ALL SELECT s_suppkey, 'memory' FROM b WHERE 2097152 - held * 2048 - 32768 - 2048 < 0
UNION ALL SELECT s_suppkey, 'files' FROM b WHERE files > 256""",
)
def disc_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as discs, their balance as the boot program's size."""
    discs = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.round(F.abs("s_acctbal") * 300).cast("long").alias("program_bytes"), (F.col("s_suppkey") * 37 % 700 * (F.col("s_suppkey") % 3)).alias("blocks"),
        (F.col("s_suppkey") * 11 % 300).alias("files"),
    )
    return reports.disc_faults(discs, "s_suppkey")


@query("timer_periods", "SELECT o_orderkey, rate, CASE rate WHEN 22050 THEN 65 WHEN 24000 THEN 60 ELSE 89 END AS period FROM (SELECT o_orderkey, ([16000, 22050, 24000])[o_orderkey % 3 + 1] AS rate FROM orders)")
def timer_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timer periods of sample rates."""
    rate = F.element_at(F.array(F.lit(16000), F.lit(22050), F.lit(24000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rate.alias("rate"), U.timer_period(rate).alias("period"))


_DISC = """s AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS bytes FROM part),
lba AS (SELECT p_partkey, bytes, (bytes + 2047) // 2048 AS sectors, CAST(2 + coalesce(sum((bytes + 2047) // 2048) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lba FROM s)"""


def _disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 1000).alias("bytes"))
    return placement.disc_addresses(files, "p_partkey", F.col("bytes"))


@query(
    "read_commands",
    f"WITH {_DISC} SELECT p_partkey, '2800' || printf('%08X', lba) || '00' || printf('%04X', sectors) || '00' AS command, lba AS lba_back, sectors AS sectors_back FROM lba",
)
def read_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read command of ten bytes for each file of a disc, and its address and length read back, big-endian."""
    command = _disc(spark, sf_dir).select("p_partkey", U.read_command(F.col("lba"), F.col("bytes")).alias("c"))
    return command.select("p_partkey", F.hex("c").alias("command"), U.big_endian(F.col("c"), 2, 4).alias("lba_back"), U.big_endian(F.col("c"), 7, 2).alias("sectors_back"))


@query("file_symbols", f"WITH {_DISC} SELECT l_orderkey, l_linenumber, lba FROM lineitem JOIN lba ON p_partkey = l_partkey")
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item's part as a symbol, with its file's address on the disc."""
    named = _disc(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "lba")
    return table(spark, sf_dir, "lineitem").join(named, "l_partkey").select("l_orderkey", "l_linenumber", "lba")


@query(
    "seek_targets",
    f"""WITH {_SIZED}, s AS (SELECT doc_id, (bytes + 2047) // 2048 AS n FROM sized),
f AS (SELECT doc_id AS frame, coalesce(CAST(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + n AS b, n FROM s),
q AS (SELECT o_orderkey, o_orderkey % 5 AS mode, (o_orderkey * 31) % 900 AS v FROM orders),
t AS (SELECT o_orderkey, mode, v, CASE mode WHEN 1 THEN v WHEN 2 THEN greatest(v - 300, 0) WHEN 3 THEN v + 63 END AS sector FROM q)
SELECT o_orderkey, sector, CASE WHEN mode = 0 THEN least(v, (SELECT max(frame) FROM f)) WHEN mode = 4 THEN 0
  ELSE coalesce((SELECT min(frame) FROM f WHERE n > 0 AND b > sector), (SELECT max(frame) FROM f WHERE n > 0)) END AS frame FROM t""",
)
def seek_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by frame, stream sector, disc address, data sector or none, as frames."""
    sized = payloads(spark, sf_dir).withColumn("n", U.sectors(F.col("bytes")))
    placed = exclusive_sums(sized, "doc_id", {"a": F.col("n")})
    frames = placed.where("n > 0").select(F.col("doc_id").alias("frame"), F.col("a").alias("start_sector"), (F.col("a") + F.col("n")).alias("end_sector"))
    mode = F.element_at(F.array(*[F.lit(m) for m in ("frame", "stream", "lba", "data", "none")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    asked = lookup.resolve_seek(table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode"), (F.col("o_orderkey") * 31 % 900).alias("value")), 300, 63)
    by_sector = lookup.sector_to_frame(asked.where("frame_direct is null").select("o_orderkey", "sector"), "sector", frames)
    last = sized.agg(F.max("doc_id").alias("last"))
    direct = asked.where("frame_direct is not null").join(F.broadcast(last)).select(  # one row
        "o_orderkey", F.lit(None).cast("long").alias("sector"), F.least("frame_direct", "last").alias("frame")
    )
    return by_sector.select("o_orderkey", "sector", "frame").unionByName(direct)


@query(
    "due_frames",
    """WITH e AS (SELECT event_id, event_id % 401 AS following, least(400, (event_id * 524 * 2) // 31468) AS target, event_type <> 'error' AS running, event_type = 'view' AS loops FROM events)
SELECT event_id, NOT running OR CASE WHEN loops THEN ((target - following) % 401 + 401) % 401 < 200 AND following <= target ELSE following <= target END AS due FROM e""",
)
def due_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's frame is due at its clock."""
    target = U.samples_to_frame(F.col("event_id") * U.CLOCK_SAMPLES_PER_FIELD, F.lit(31468), F.lit(2), F.lit(1), F.lit(401))
    due = reports.is_due(F.col("event_id") % 401, target, 401, F.col("event_type") != "error", F.col("event_type") == "view")
    return table(spark, sf_dir, "events").select("event_id", due.alias("due"))


@query(
    "ready_slots",
    """WITH r AS (SELECT event_id, user_id, event_id % 40 AS frame FROM events WHERE event_type = 'click'), s AS (SELECT user_id, event_id % 40 AS frame FROM events WHERE event_type = 'view' AND value > 20)
SELECT event_id, user_id, frame FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.frame = r.frame)""",
)
def ready_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks whose frame some view of the same user holds ready."""
    events = table(spark, sf_dir, "events").withColumn("frame", F.col("event_id") % 40)
    slots = events.where("event_type = 'view'").select("user_id", "frame", (F.col("value") > 20).alias("ready"))
    return reports.ready_slots(events.where("event_type = 'click'").select("event_id", "user_id", "frame"), slots, ["user_id", "frame"])


@query("step_candidates", "SELECT DISTINCT p_partkey, greatest(1, least(31, p_size - 9 + d)) AS step FROM part, unnest([-2, -1, 0, 1, 2]) t(d)")
def step_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: quantizer steps around each part's size, each once."""
    near = reports.nearby_steps(F.col("p_size") - 9, 2, 1, 31)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(near).alias("step"))


@query(
    "source_frame_match",
    f"""WITH {_PIXELS}, shots AS (SELECT vec_id, vec_id % 700 AS vf FROM embeddings WHERE vec_id % 3 = 0), ask AS (
  SELECT DISTINCT vec_id, greatest(0, least(599, vf - back)) AS source_frame FROM shots, unnest([1, 2]) t(back) WHERE vf > 0),
c AS (SELECT ask.vec_id, source_frame, corr(a.p[i + 1], b.p[i + 1]) AS r, var_pop(a.p[i + 1]) AS va, var_pop(b.p[i + 1]) AS vb
  FROM ask JOIN px a ON a.vec_id = ask.vec_id JOIN px b ON b.vec_id = ask.source_frame, unnest(range(64)) t(i) GROUP BY ask.vec_id, source_frame),
s AS (SELECT vec_id, source_frame, round(CASE WHEN va * 64 > 1e-9 AND vb * 64 > 1e-9 THEN r ELSE -1.0 END, 6) AS corr FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY corr DESC, source_frame DESC) AS turn FROM s)
SELECT vec_id, source_frame, corr FROM t WHERE turn = 1""",
)
def source_frame_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block as a shot, against the two source frames that it may show."""
    images = pixels(spark, sf_dir).select("vec_id", "pixels")
    return reports.best_source_frames(images.where("vec_id % 3 = 0"), "vec_id", F.col("vec_id") % 700, 600, images, "vec_id")


_SHOTS = f"""{_PIXELS}, asked AS (SELECT vec_id, vec_id % 700 AS vf, greatest(0, least(599, vec_id % 700 - 1 - vec_id % 2)) AS shown FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 17 <> 0 AND vec_id % 700 > 0),
shots AS (SELECT asked.vec_id, vf, [CASE WHEN asked.vec_id % 5 = 0 AND i >= 32 THEN 0.0 WHEN asked.vec_id % 7 = 0 AND i % 8 >= 6 THEN 255 - p[i + 1] ELSE p[i + 1] END FOR i IN range(64)] AS s FROM asked JOIN px ON px.vec_id = shown),
ask AS (SELECT DISTINCT vec_id, s, greatest(0, least(599, vf - back)) AS source_frame FROM shots, unnest([1, 2]) t(back)),
c AS (SELECT ask.vec_id, source_frame, corr(s[i + 1], b.p[i + 1]) AS r, var_pop(s[i + 1]) AS va, var_pop(b.p[i + 1]) AS vb FROM ask JOIN px b ON b.vec_id = ask.source_frame, unnest(range(64)) t(i) GROUP BY ask.vec_id, source_frame),
best AS (SELECT vec_id, source_frame FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(CASE WHEN va * 64 > 1e-9 AND vb * 64 > 1e-9 THEN r ELSE -1.0 END, 6) DESC, source_frame DESC) = 1),
cells AS (SELECT b.vec_id, b.source_frame, i, s[i + 1] AS a, px.p[i + 1] AS b FROM best b JOIN shots USING (vec_id) JOIN px ON px.vec_id = b.source_frame, unnest(range(64)) t(i)),
m AS (SELECT vec_id, source_frame, round(avg(CASE WHEN a < 8 THEN 1.0 ELSE 0.0 END), 6) AS dark_all, round(avg(CASE WHEN i >= 32 THEN CASE WHEN a < 8 THEN 1.0 ELSE 0.0 END END), 6) AS dark,
  round(avg(CASE WHEN i >= 32 THEN CASE WHEN b < 8 THEN 1.0 ELSE 0.0 END END), 6) AS ref_dark, round(avg(abs(a - b)), 6) AS mae, round(CASE WHEN var_pop(a) * 64 > 1e-9 AND var_pop(b) * 64 > 1e-9 THEN corr(a, b) ELSE 0 END, 5) AS corr,
  round(avg(CASE WHEN i % 8 >= 6 THEN abs(a - b) END), 6) AS edge, round(avg(CASE WHEN i % 8 < 6 THEN abs(a - b) END), 6) AS body FROM cells GROUP BY vec_id, source_frame)"""


@query(
    "visual_report",
    f"""WITH {_SHOTS}, f AS (SELECT *, concat_ws(',', CASE WHEN dark > 0.70 AND ref_dark < 0.40 THEN 'bottom_black' END, CASE WHEN dark - ref_dark > 0.45 THEN 'black_delta' END, CASE WHEN mae > 75 THEN 'mae' END,
  CASE WHEN corr < 0.45 THEN 'corr' END, CASE WHEN edge > 2 * body + 12 THEN 'edge' END) AS faults FROM m) SELECT *, faults = '' AS passes FROM f""",
)
def visual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a shot: the source frame it shows, all metrics against it, the limits it breaks, and whether it passes.

    Every third block is a shot of one of the two frames before its number, some with a dark lower half or
    a turned right edge; shots of a run that has ended (every seventeenth) are skipped.
    """
    stills = written(pixels(spark, sf_dir).select("vec_id", "pixels"), "pixels")
    shot = stills.where("vec_id % 3 = 0 and vec_id % 17 <> 0 and vec_id % 700 > 0").select("vec_id", (F.col("vec_id") % 700).alias("vf"))
    shown = F.greatest(F.lit(0).cast("long"), F.least(F.lit(599).cast("long"), F.col("vf") - 1 - F.col("vec_id") % 2))
    key = F.col("vec_id")
    spoiled = F.transform("pixels", lambda v, i: F.when((key % 5 == 0) & (i >= 32), 0.0).when((key % 7 == 0) & (i % 8 >= 6), 255 - v).otherwise(v))
    shots = shot.withColumn("_at", shown).join(stills.select(F.col("vec_id").alias("_at"), "pixels"), "_at").select("vec_id", "vf", spoiled.alias("pixels"))
    shots = written(shots, "shots")
    best = reports.best_source_frames(shots, "vec_id", F.col("vf"), 600, stills, "vec_id").select("vec_id", "source_frame")
    met = best.join(shots.select("vec_id", F.col("pixels").alias("a")), "vec_id").join(stills.select(F.col("vec_id").alias("source_frame"), F.col("pixels").alias("b")), "source_frame")
    a, b = F.col("a"), F.col("b")
    dark = lambda p, cells=None: F.round(images.dark_share(p, cells, 8), 6)
    error = lambda cells=None: F.round(images.mean_error(a, b, cells), 6)
    metrics = met.select(
        "vec_id", "source_frame", dark(a).alias("dark_all"), dark(a, images.LOWER).alias("dark"), dark(b, images.LOWER).alias("ref_dark"), error().alias("mae"),
        F.round(F.coalesce(reports.pearson(a, b), F.lit(0.0)), 5).alias("corr"), error(images.RIGHT).alias("edge"), error(images.BODY).alias("body"),
    )
    return metrics.withColumn("faults", F.array_join(matching.picture_rules(), ",")).withColumn("passes", F.col("faults") == "")


_SEGMENTS = f"""{_env(4)}, p AS (SELECT *, max(rms) OVER (PARTITION BY user_id) AS peak FROM e),
l AS (SELECT user_id, hop FROM p WHERE peak > 1e-7 AND rms > greatest(peak * power(10, -6.0 / 20), 0.0015)),
g AS (SELECT *, CASE WHEN hop - lag(hop) OVER (PARTITION BY user_id ORDER BY hop) - 1 <= 2 THEN 0 ELSE 1 END AS fresh FROM l),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY hop) AS island FROM g),
seg AS (SELECT user_id, min(hop) AS a, max(hop) + 1 AS b FROM i GROUP BY user_id, island HAVING max(hop) + 1 - min(hop) >= 1)"""


@query(
    "segment_groups",
    f"""WITH {_SEGMENTS}, ref AS (SELECT user_id - 1 AS pair, count(*) AS n, max(b) - min(a) AS span FROM seg GROUP BY user_id),
cap AS (SELECT user_id AS pair, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM seg),
r AS (SELECT x.pair, x.a AS "start", y.b - x.a AS span, ref.span AS reference_span, abs(y.b - x.a - ref.span) AS error
  FROM cap x JOIN ref ON ref.pair = x.pair JOIN cap y ON y.pair = x.pair AND y.seq = x.seq + least(ref.n, x.n) - 1),
w AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY error, "start") AS turn FROM r)
SELECT pair, "start", span, reference_span, error FROM w WHERE turn = 1""",
)
def segment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's run of active segments that spans most nearly what the next user's do."""
    found = series.active_segments(envelope(spark, sf_dir, 4), "user_id", level_db=-6.0, gap=2, min_len=1)
    return reports.segment_groups(found.select((F.col("user_id") - 1).alias("pair"), "start", "end"), found.withColumnRenamed("user_id", "pair"), "pair")


@query(
    "envelope_scales",
    f"""WITH {_env(4)}, v AS (SELECT user_id, hop, ln(rms + 1e-5) AS v FROM e), z AS (
  SELECT user_id, hop, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9) AS z FROM v WINDOW w AS (PARTITION BY user_id)),
n AS (SELECT user_id, count(*) AS n FROM z GROUP BY user_id),
scales AS (SELECT 1 - 0.1 + 2 * 0.1 * k / 160 AS scale FROM unnest(range(161)) t(k)),
cand AS (SELECT a.user_id AS x, a.n AS na, b.n AS nb, CAST(greatest(8, round_even(a.n * scale, 0)) AS BIGINT) AS len, min(scale) AS scale
  FROM n a JOIN n b ON b.user_id = a.user_id + 1, scales WHERE a.n >= 8 AND b.n >= 8 GROUP BY a.user_id, a.n, b.n, len HAVING len <= b.n),
pts AS (SELECT x, na, nb, len, scale, i, i * (na - 1) / (len - 1)::DOUBLE AS idx FROM cand, LATERAL (SELECT unnest(range(len)) AS i)),
r AS (SELECT p.x, p.na, p.nb, p.len, p.scale, p.i, lo.z + (p.idx - floor(p.idx)) * (coalesce(hi.z, lo.z) - lo.z) AS r
  FROM pts p JOIN z lo ON lo.user_id = p.x AND lo.hop = floor(p.idx) LEFT JOIN z hi ON hi.user_id = p.x AND hi.hop = floor(p.idx) + 1),
rz AS (SELECT *, (r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-9) AS q FROM r WINDOW w AS (PARTITION BY x, len)),
c AS (SELECT x, len, scale, pos, round(sum(q * z.z) / len, 6) AS corr FROM rz, LATERAL (SELECT unnest(range(nb - len + 1)) AS pos), z WHERE z.user_id = x + 1 AND z.hop = pos + i GROUP BY x, len, scale, pos),
t AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY corr DESC, scale, pos) AS turn FROM c)
SELECT n.user_id AS "left", n.user_id + 1 AS "right", round(scale, 6) AS scale, pos, corr FROM n JOIN n m ON m.user_id = n.user_id + 1 LEFT JOIN t ON t.x = n.user_id AND turn = 1""",
)
def envelope_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's envelope, stretched by up to a tenth, in the next user's."""
    env = envelope(spark, sf_dir, 4)
    pairs = env.select(F.col("user_id").alias("left")).distinct().withColumn("right", F.col("left") + 1)
    found = correlate.envelope_scales(pairs, env, "user_id", "rms", size=128)
    return found.select("left", "right", F.round("scale", 6).alias("scale"), "pos", "corr")


#: Documents of one container of ``container_roundtrip``.
PER_FILE = 256
_FILES = f"""d AS (SELECT source, doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
f AS (SELECT source || '-' || CAST(n // {PER_FILE} AS VARCHAR) AS stream_id, n % {PER_FILE} AS frame, text, CAST(strlen(text) AS BIGINT) AS size,
  (strlen(text) + 2047) // 2048 AS vs, CASE WHEN n % 4 = 0 THEN least(2048, strlen(text)) ELSE 0 END AS chunk FROM d),
g AS (SELECT *, CASE WHEN chunk > 0 THEN 1 ELSE 0 END AS a, count(*) OVER (PARTITION BY stream_id) AS count FROM f),
p AS (SELECT *, (64 + 32 * count + 2047) // 2048 + coalesce(CAST(sum(vs + a) OVER w AS BIGINT), 0) AS "at", 2048 * coalesce(CAST(sum(a) OVER w AS BIGINT), 0) AS off
  FROM g WINDOW w AS (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, file_bytes, content): each source's documents as containers of PER_FILE frames, every fourth with a chunk of audio."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    # Sizes alone are laid out; payloads join their frames once.
    n = numbered(docs.select("source", "doc_id", F.octet_length("payload").cast("long").alias("video_size")), "doc_id", "n", ("source",))
    chunk = F.when(F.col("n") % 4 == 0, F.least("video_size", F.lit(2048))).otherwise(0)
    frames = n.select(
        "source", "doc_id", F.concat("source", F.lit("-"), U.div(F.col("n"), PER_FILE).cast("string")).alias("stream_id"), (F.col("n") % PER_FILE).alias("frame"),
        "video_size", U.sectors(F.col("video_size")).alias("video_sectors"), chunk.alias("audio_size"), F.when(chunk > 0, 1).otherwise(0).cast("long").alias("a_sectors"),
    )
    frames = written(frames, "frames")
    totals = frames.groupBy("stream_id").agg(
        F.count("*").alias("frame_count"), F.sum("a_sectors").alias("audio_sectors"), F.sum("audio_size").alias("audio_bytes"),
        F.max("video_sectors").alias("max_video_sectors"),
    )
    start = U.sectors(F.lit(container.HEADER_BYTES) + F.col("frame_count") * container.ENTRY_BYTES)
    zero = [F.lit(0).alias(c) for c in ("preroll_sectors", "refill_sectors", "ring_half_bytes", "reserved0", "reserved1")]
    # Each chunk begins a sector of the audio's stream, so its length counts whole sectors.
    head = totals.select(
        "stream_id", F.lit(256).alias("width"), F.lit(240).alias("height"), F.lit(15).alias("fps_num"), F.lit(1).alias("fps_den"), "frame_count", F.lit(U.FLAG_MP2).alias("flags"),
        (F.col("frame_count") * container.ENTRY_BYTES).alias("index_bytes"), start.alias("data_start_sector"), "max_video_sectors", (F.col("audio_sectors") * 2048).alias("audio_bytes"),
        "audio_sectors", *zero, F.lit(16000).alias("audio_rate_hz"), F.lit(None).cast("binary").alias("preroll"),
    )
    placed = exclusive_sums(frames, "frame", {"before": F.col("video_sectors") + F.col("a_sectors"), "chunks": F.col("a_sectors")}, ("stream_id",), width=placement.DENSE)
    at = F.col("data_start_sector") + F.col("before")
    layout = placed.join(head.select("stream_id", "data_start_sector"), "stream_id").select(
        "source", "doc_id", "stream_id", "frame", "video_size", "video_sectors", "a_sectors", at.alias("video_sector"),
        F.when(F.col("a_sectors") > 0, at + F.col("video_sectors")).otherwise(0).alias("audio_sector"), (F.col("chunks") * 2048 * F.col("a_sectors")).alias("audio_byte_offset"), F.lit(0).alias("entry_flags"),
    )
    layout = docs.join(written(layout, "layout"), ["source", "doc_id"]).withColumns({"video_crc32": F.crc32("payload"), "audio": F.when(F.col("a_sectors") > 0, F.substring("payload", 1, 2048))})
    made = container.assemble(head, layout)
    return made.select("stream_id", F.octet_length("content").cast("long").alias("file_bytes"), "content")


def _container_files(spark: SparkSession, sf_dir: str, part: str, **options: str) -> DataFrame:
    """The containers written as files and opened again, as ``part``."""
    files.register(spark)
    folder = shared_folder(spark, "containers")
    _containers(spark, sf_dir).select("stream_id", "content").write.format("whole_files").mode("append").save(folder)
    return spark.read.format("sector_container").options(part=part, **options).load(folder)


@query(
    "container_roundtrip",
    f"""WITH {_FILES} SELECT stream_id, frame, "at" AS video_sector, size AS video_size, vs AS video_sectors, CASE WHEN a = 1 THEN "at" + vs ELSE 0 END AS audio_sector, CAST(a AS BIGINT) AS a_sectors,
  off * a AS audio_byte_offset, md5(text) AS payload_md5, true AS crc_holds FROM p""",
)
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as container files and read back frame by frame, payloads included."""
    found = _container_files(spark, sf_dir, "frames", payloads="true")
    return found.select(
        "stream_id", "frame", "video_sector", "video_size", "video_sectors", "audio_sector", "a_sectors", "audio_byte_offset", F.md5("payload").alias("payload_md5"),
        (F.col("payload_crc32") == F.col("video_crc32")).alias("crc_holds"),
    )


@query(
    "container_headers",
    f"""WITH {_FILES} SELECT stream_id, 'PCFV0001' AS magic, max(count) AS frame_count, 32 * max(count) AS index_bytes, (64 + 32 * max(count) + 2047) // 2048 AS data_start_sector, max(vs) AS max_video_sectors,
  CAST(sum(a) AS BIGINT) AS audio_sectors, CASE WHEN sum(a) = 0 THEN 'none' ELSE 'mp2' END AS codec, CAST(((64 + 32 * max(count) + 2047) // 2048 + sum(vs + a)) * 2048 AS BIGINT) AS file_bytes, CAST(64 AS BIGINT) AS read_bytes FROM p GROUP BY stream_id""",
)
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the files that ``container_roundtrip`` writes, of which 64 bytes are read each."""
    head = _container_files(spark, sf_dir, "streams")
    return head.select("stream_id", "magic", "frame_count", "index_bytes", "data_start_sector", "max_video_sectors", "audio_sectors", "codec", "file_bytes", "read_bytes")


@query(
    "container_audio",
    f"WITH {_FILES} SELECT stream_id, off AS byte_offset, CAST(2048 AS BIGINT) AS bytes, md5(rpad(substr(hex(encode(text)), 1, 4096), 4096, '0')) AS hex_md5 FROM p WHERE a = 1",
)
def container_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio chunks of the same files, padding included."""
    chunks = _container_files(spark, sf_dir, "chunks")
    return chunks.select("stream_id", "byte_offset", F.octet_length("data").cast("long").alias("bytes"), F.md5(F.hex("data").cast("binary")).alias("hex_md5"))


_ON_DISC = """f AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
a AS (SELECT *, (bytes + 2047) // 2048 AS sectors, 2 + CAST(coalesce(sum((bytes + 2047) // 2048) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lba FROM f)"""


def _on_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content, bytes, sectors, lba): all documents as the files of one disc."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return disc.addresses(docs, "doc_id")


@query(
    "disc_image",
    f"""WITH {_ON_DISC}, s AS (SELECT lba + k AS sector, rpad(substr(h, CAST(4096 * k + 1 AS BIGINT), 4096), 4096, '0') AS h FROM (SELECT lba, hex(encode(text)) AS h, unnest(range(sectors)) AS k FROM a)),
n AS (SELECT unnest(range(greatest(300, (SELECT max(lba + sectors) FROM a)))) AS sector)
SELECT n.sector, md5(coalesce(h, repeat('0', 4096))) AS hex_md5 FROM n LEFT JOIN s ON s.sector = n.sector""",
)
def disc_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a disc image by all tasks at once, and its sectors read back by ranges."""
    path = shared_folder(spark, "disc") + "/image.bin"
    disc.write_image(spark, _on_disc(spark, sf_dir), path)
    back = spark.read.format("byte_ranges").option("bytes", 2048).load(path)
    return back.select(U.div(F.col("at"), 2048).alias("sector"), F.md5(F.hex("data").cast("binary")).alias("hex_md5"))


@query(
    "disc_header_lines",
    f"""WITH {_ON_DISC} SELECT 'enum' AS part, doc_id AS n, chr(9) || 'BINARY_LBA_F' || CAST(doc_id AS VARCHAR) || '_TXT = ' || CAST(lba AS VARCHAR) || ',' AS line FROM a
UNION ALL SELECT 'macro', doc_id, '#define BINARY_LBA_F' || CAST(doc_id AS VARCHAR) || '_TXT ' || CAST(lba AS VARCHAR) FROM a""",
)
def disc_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that name each file's address, as an enumeration and as macros."""
    placed = _on_disc(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return disc.header_lines(placed, "doc_id", "name")


#: Samples of one file of ``riff_roundtrip``.
PER_WAVE = 4096
_PCM = f"s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), w AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(pos // {PER_WAVE} AS VARCHAR) AS stream_id, pos % {PER_WAVE} AS pos, CAST(floor(value * 10) AS BIGINT) - 1000 AS v FROM s)"


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, content): each user's values as two-channel 16-bit files of PER_WAVE frames, with a loop over all but the first."""
    rows = samples(spark, sf_dir).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), U.div(F.col("pos"), PER_WAVE).cast("string")).alias("stream_id"), (F.col("pos") % PER_WAVE).alias("pos"),
        (F.floor(F.col("value") * 10) - 1000).cast("long").alias("v"),
    )
    # The right channel lies two over the left one, so their mean is one over it.
    both = F.concat(riff.sample_bytes(F.col("v") - 1), riff.sample_bytes(F.col("v") + 1))
    data = rows.select("stream_id", "pos", both.alias("b")).groupBy("stream_id").agg(F.expr("listagg(b) within group (order by pos)").alias("data"), F.count("*").alias("n"))
    return data.select("stream_id", riff.wave_file(F.col("data"), 2, 16000, F.lit(1).cast("long"), F.col("n") - 1).alias("content"))


@query("riff_roundtrip", f"WITH {_PCM} SELECT stream_id, pos, CAST(v AS DOUBLE) AS sample FROM w")
def riff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as wave files and read back as the mean of both channels."""
    return riff.mono_samples(_waves(spark, sf_dir))


@query(
    "riff_formats",
    f"""WITH {_PCM} SELECT stream_id, 1 AS format_tag, 2 AS channels, 16000 AS rate, 64000 AS byte_rate, 4 AS block_align, 16 AS bits, 44 AS data_offset, 4 * count(*) AS data_bytes,
  1 AS loop_start, count(*) - 1 AS loop_end FROM w GROUP BY stream_id""",
)
def riff_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, data extents and loops of the same files."""
    found = riff.formats(_waves(spark, sf_dir))
    return found.select("stream_id", "format_tag", "channels", "rate", "byte_rate", "block_align", "bits", "data_offset", "data_bytes", F.col("loop.start").alias("loop_start"), F.col("loop.end").alias("loop_end"))


@query(
    "riff_details",
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT *, CASE user_id % 5 WHEN 0 THEN CAST(n // 4 AS VARCHAR) || ' ' || CAST(n // 2 AS VARCHAR) WHEN 1 THEN '0x' || printf('%x', n // 4) || chr(9) || '0' || printf('%o', n // 2) || ' loop' WHEN 2 THEN 'just a comment' WHEN 3 THEN CAST(n // 4 AS VARCHAR) END AS comment FROM n)
SELECT CAST(user_id AS VARCHAR) AS stream_id, CASE WHEN user_id % 2 = 0 THEN n ELSE 3 * n END AS total_samples,
  CASE WHEN user_id % 5 < 2 THEN n // 4 WHEN user_id % 3 = 0 THEN 1 END AS loop_start, CASE WHEN user_id % 5 < 2 THEN n // 2 + 1 WHEN user_id % 3 = 0 THEN n END AS loop_end,
  comment, 'user ' || CAST(user_id AS VARCHAR) AS title FROM c""",
)
def riff_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave files with fact, loops in smpl or in INFO's comment, read through the tree of their chunks."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    user, n = F.col("user_id"), F.col("n")
    quarter, half = (U.div(n, k).cast("string") for k in (4, 2))
    odd = F.concat(F.lit("0x"), F.lower(F.hex(U.div(n, 4))), F.lit("\t0"), F.conv(half, 10, 8), F.lit(" loop"))
    comment = F.when(user % 5 == 0, F.concat(quarter, F.lit(" "), half)).when(user % 5 == 1, odd).when(user % 5 == 2, F.lit("just a comment")).when(user % 5 == 3, quarter)
    data = F.unhex(F.repeat(F.lit("0102"), n.cast("int")))
    start = F.when(user % 3 == 0, F.lit(1).cast("long"))
    info = [("INAM", F.concat(F.lit("user "), user.cast("string"))), ("ICMT", comment)]
    plain, coded = riff.wave_file(data, 1, 16000, start, n - 1, info=info), riff.wave_file(data, 1, 16000, start, n - 1, tag=0x11, bits=4, fact=3 * n, info=info)
    files_ = rows.select(user.cast("string").alias("stream_id"), F.when(user % 2 == 0, plain).otherwise(coded).alias("content"))
    return riff.details(files_, loop_in_comment=True).select("stream_id", "total_samples", "loop_start", "loop_end", "comment", F.col("info")["INAM"].alias("title"))


@query("vox_files", f"WITH {_PCM} SELECT stream_id, count(*) AS n_codes, ((count(*) + 1) // 2 + 2047) // 2048 * 2048 AS file_bytes, CAST(sum((v + 1000) % 16) AS BIGINT) AS code_sum, 7867 AS rate FROM w GROUP BY stream_id")
def vox_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-bit codes written without a header, padded to sectors, and read back at a rate given by option."""
    rows = samples(spark, sf_dir).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), U.div(F.col("pos"), PER_WAVE).cast("string")).alias("stream_id"), "pos",
        F.hex((F.floor(F.col("value") * 10) % 16).cast("long")).alias("digit"),
    )
    codes = rows.groupBy("stream_id").agg(F.expr("listagg(digit) within group (order by pos)").alias("codes"), F.count("*").alias("n"))
    files = codes.select("stream_id", "n", riff.vox_file(F.col("codes")).alias("content"))
    back = riff.vox_codes(files, 7867).join(files.select("stream_id", "n", F.octet_length("content").cast("long").alias("file_bytes")), "stream_id")
    own = F.substring("codes", F.lit(1), F.col("n").cast("int"))
    digits = F.transform(F.split(own, ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return back.select("stream_id", F.length(own).cast("long").alias("n_codes"), "file_bytes", F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s + F.coalesce(d, F.lit(0).cast("long"))).alias("code_sum"), "rate")


@query(
    "directive_lines",
    """WITH w AS (SELECT p_partkey, (['name', 'blocks', 'colour', 'makerid', 'version', 'asset'])[p_partkey % 6 + 1] AS word,
  CASE p_partkey % 6 WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE p_name || ' #' || CAST(p_size AS VARCHAR) || ' of 50 ' END AS value FROM part WHERE p_partkey % 7 <> 0)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE word END AS directive, CASE WHEN p_partkey % 11 = 0 THEN word || ' ' || value WHEN p_partkey % 13 <> 0 THEN value END AS value,
  p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND word <> 'colour' AS known FROM w""",
)
def directive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directive lines made of parts and read back; every seventh is a comment, others stand indented or without a value."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("name", "blocks", "colour", "makerid", "version", "asset")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 6 == 1, F.col("p_size").cast("string")).otherwise(F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"), F.lit(" of 50 ")))
    given = F.concat(word, F.lit(" "), value)
    line = F.when(F.col("p_partkey") % 7 == 0, F.lit("# nothing")).when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(" "), given)).when(F.col("p_partkey") % 13 == 0, word).otherwise(given)
    return text.parse_directives(table(spark, sf_dir, "part").select("p_partkey", F.concat(line, F.lit("\r\n")).alias("value")), ["p_partkey"])


@query(
    "map_symbols",
    """WITH n AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'g_done' WHEN 1 THEN 'g_frame_count' ELSE 'g_part_' || CAST(p_partkey AS VARCHAR) END AS symbol FROM part)
SELECT p_partkey, symbol, CAST(32768 + 4 * p_partkey AS BIGINT) AS address, CAST(CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE p_size END AS BIGINT) AS bytes,
  CAST(CASE WHEN p_partkey % 5 < 2 THEN p_size ELSE p_size * 65537 END AS BIGINT) AS value FROM n""",
)
def map_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of map lines of all three forms, and the counter at each one's place in its own dump of sixteen bytes.

    Plain lines name a symbol; sections are on one line or two, each behind a plain line of a wrong address.
    """
    hexed = lambda v: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(v)), 8, "0"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("g_done")).when(F.col("p_partkey") % 5 == 1, F.lit("g_frame_count")).otherwise(F.concat(F.lit("g_part_"), F.col("p_partkey").cast("string")))
    at, extent = hexed(32768 + 4 * F.col("p_partkey")), F.concat(hexed(32768 + 4 * F.col("p_partkey")), F.lit("        "), hexed(F.col("p_size")), F.lit(" a.o"))
    plain = lambda address: F.concat(F.lit("                "), address, F.lit("                "), name)
    section = F.concat(F.lit(" .bss."), name)
    lines = (
        F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Memory map"), plain(at), plain(F.lit("0x00000001"))))
        .when(F.col("p_partkey") % 3 == 1, F.array(plain(F.lit("0x00000001")), F.concat(section, F.lit("  "), extent)))
        .otherwise(F.array(section, F.concat(F.lit("      "), extent), plain(F.lit("0x00000001"))))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", lines.alias("lines"))
    found = text.parse_symbols(parts.select("p_partkey", F.posexplode("lines").alias("line_no", "value")), ["p_partkey"])
    dump = F.concat(F.unhex(F.lit("FF" * 4)), container.little_endian_bytes(F.col("p_size") * 65537, 4), F.unhex(F.lit("EE" * 8)))
    memory = parts.select("p_partkey", dump.alias("content"), (32768 + 4 * F.col("p_partkey") - 4).alias("base"))
    held = found.join(memory, "p_partkey").withColumn("_n", text.counter_bytes(F.col("symbol")))
    value = F.coalesce(*[F.when(F.col("_n") == n, U.little_endian(F.col("content"), F.col("address") - F.col("base"), n)) for n in (1, 2, 4)])
    return held.select("p_partkey", "symbol", "address", "bytes", value.alias("value"))


@query("counter_lines", "SELECT user_id, count(*) AS presented, count(*) FILTER (WHERE event_type = 'error') AS skipped FROM events GROUP BY user_id")
def counter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each user as a JSON line, read back; broken lines are skipped."""
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("presented"), F.count_if(F.col("event_type") == "error").alias("skipped"))
    lines = counted.select(text.report_line(F.struct("user_id", "presented", "skipped")).alias("value"))
    broken = counted.select(F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit(', "presented"')).alias("value"))
    return text.parse_reports(lines.unionByName(broken), f"user_id {dict(counted.dtypes)['user_id']}, presented bigint, skipped bigint")


@query("report_lines", """SELECT user_id, '{"user_id":' || CAST(user_id AS VARCHAR) || ',"n":' || CAST(count(*) AS VARCHAR) || '}' AS line FROM events GROUP BY user_id""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a report's lines as they are written."""
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", text.report_line(F.struct("user_id", "n")).alias("line"))


@query(
    "c_arrays",
    """SELECT doc_id, md5('static const unsigned char f_' || CAST(doc_id AS VARCHAR) || '[' || CAST(strlen(coalesce(text, '')) AS VARCHAR) || '] = { ' ||
  regexp_replace(lower(hex(encode(coalesce(text, '')))), '(..)', '0x\\1,', 'g') || ' };') AS source_md5 FROM documents""",
)
def c_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: each document as a C array; the digest of its source."""
    name = F.concat(F.lit("f_"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.c_array(name, F.coalesce("text", F.lit("")).cast("binary")).cast("binary")).alias("source_md5"))


@query("image_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'ppm' END AS kind FROM pages")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers by magic bytes; what no reader takes is null."""
    start = F.element_at(F.array(F.lit("89504E470D0A1A0A"), F.lit("5036"), F.lit("89504E"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    content = F.concat(F.unhex(start), F.substring(F.coalesce("html", F.lit("")), 1, 40).cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", tables.image_kind(content).alias("kind"))


@query(
    "library_members",
    """WITH m AS (SELECT 'lib' || CAST(p_partkey // 64 AS VARCHAR) AS library, p_partkey, p_name, strlen(p_name) AS size, p_partkey % 64 AS n FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY library) AS count, coalesce(CAST(sum(size) OVER (PARTITION BY library ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM m)
SELECT library, CAST(n AS INTEGER) AS n, 'part' || CAST(p_partkey AS VARCHAR) || '.o' AS name, 32 + 64 * count + before AS "offset", CAST(size AS BIGINT) AS size, md5(p_name) AS content_md5 FROM c""",
)
def library_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names as members of libraries of 64, written big-endian, listed and extracted."""
    members = table(spark, sf_dir, "part").select(
        F.concat(F.lit("lib"), U.div(F.col("p_partkey"), 64).cast("string")).alias("library"), (F.col("p_partkey") % 64).alias("n"),
        F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit(".o")).alias("name"), F.col("p_name").cast("binary").alias("data"),
    )
    found = tables.library_members(tables.libraries(members))
    return found.select("library", "n", "name", "offset", "size", F.md5("content").alias("content_md5"))


@query(
    "object_sections",
    """WITH m AS (SELECT 'obj' || CAST(p_partkey // 16 AS VARCHAR) AS object, p_partkey, p_name, strlen(p_name) AS size, p_partkey % 16 AS n FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY object) AS count, coalesce(CAST(sum(size) OVER (PARTITION BY object ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
  row_number() OVER (PARTITION BY object ORDER BY n) - 1 AS k FROM m)
SELECT object, CAST(k AS INTEGER) AS n, '.part' || CAST(p_partkey AS VARCHAR) AS name, 64 + 48 * count + before AS "offset", CAST(size AS BIGINT) AS size, CAST(0 AS BIGINT) AS relocations, md5(p_name) AS content_md5 FROM c""",
)
def object_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names as sections of objects of 16, written big-endian, listed and extracted."""
    sections = table(spark, sf_dir, "part").select(
        F.concat(F.lit("obj"), U.div(F.col("p_partkey"), 16).cast("string")).alias("object"), (F.col("p_partkey") % 16).alias("n"),
        F.concat(F.lit(".part"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").cast("binary").alias("data"),
    )
    found = tables.object_sections(tables.objects(sections))
    return found.select("object", "n", "name", "offset", "size", "relocations", F.md5("content").alias("content_md5"))


@query(
    "mp2_frame_offsets",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
f AS (SELECT user_id, pos, 144000 * ([32, 48, 56, 64])[user_id % 4 + 1] // 44100 + event_id % 2 AS size FROM s),
o AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM f)
SELECT user_id, pos, size, "offset" FROM o WHERE pos >= 5""",
)
def mp2_frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as MP2 frames, split at their sizes, from the fifth on."""
    kbps = F.element_at(F.array(F.lit(32), F.lit(48), F.lit(56), F.lit(64)), (F.col("user_id") % 4 + 1).cast("int"))
    rows = samples(spark, sf_dir).select("user_id", "pos", kbps.alias("kbps"), (F.col("event_id") % 2).cast("int").alias("padding"))
    sizes = mp2_profiles(spark).where("version = 'full' and rate = 44100").select("kbps", "padding", F.col("frame_bytes").alias("size"))
    sized = rows.join(F.broadcast(sizes), ["kbps", "padding"])  # at most 28 profiles
    found = exclusive_sums(sized, "pos", {"offset": F.col("size")}, ("user_id",), width=placement.DENSE)
    return found.where("pos >= 5").select("user_id", "pos", "size", "offset")
