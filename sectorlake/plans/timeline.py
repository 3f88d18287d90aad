"""Placement and lookup queries: payloads on a sector timeline, refills, pacing, positions, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.functions.prefix import exclusive_sums, numbered
from sectorlake.operators import lookup, placement, rules
from sectorlake.plans.registry import query
from sectorlake.sources.shared import written

NUM, DEN, RATE, STRIDE = 2, 1, 31468, 4
DATA_START = 63  # sectors of a header and 4000 index entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads: (doc_id, bytes)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def source_frames(spark: SparkSession, sf_dir: str, fixed: bool = True) -> DataFrame:
    """Each source's documents as the frames of one stream, numbered by doc_id; ``fixed`` keeps those that fit a slot."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("stream_id"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    docs = docs.where(U.sectors(F.col("bytes")) <= STRIDE) if fixed else docs
    return numbered(docs, "doc_id", "frame", ("stream_id",))


_SIZED = "sized AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents)"


@query("payload_sectors", f"WITH {_SIZED} SELECT doc_id, bytes, (bytes + 2047) // 2048 AS sectors FROM sized")
def payload_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of each payload."""
    return payloads(spark, sf_dir).withColumn("sectors", U.sectors(F.col("bytes")))


@query(
    "layout_variable_slots",
    f"""WITH {_SIZED}, s AS (SELECT *, (bytes + 2047) // 2048 AS sectors FROM sized)
SELECT doc_id, bytes, sectors, CAST(63 + coalesce(sum(sectors) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sector FROM s""",
)
def layout_variable_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads one behind the other in slots as large as they need."""
    return placement.variable_slots(payloads(spark, sf_dir), "doc_id", F.col("bytes"), DATA_START)


_FITS = " WHERE (bytes + 2047) // 2048 <= 4"
_FRAMES = f"""{_SIZED}, frames AS (
  SELECT source AS stream_id, doc_id, bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame FROM sized{_FITS})"""


@query("layout_fixed_stride", f"WITH {_FRAMES} SELECT stream_id, frame, doc_id, CAST(63 + 4 * frame AS BIGINT) AS video_sector, bytes FROM frames")
def layout_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 without audio: payloads of at most four sectors in slots of four."""
    return source_frames(spark, sf_dir).select("stream_id", "frame", "doc_id", (F.lit(DATA_START).cast("long") + F.col("frame") * STRIDE).alias("video_sector"), "bytes")


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's audio: half a minute's worth a hundred of its documents, cut into ring blocks."""
    count = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stream_id")).agg((F.count("*") * 4000 + 65_000).cast("long").alias("audio_bytes"))
    return placement.audio_blocks(count)


_BLOCKS = """audio AS (SELECT source AS stream_id, CAST(count(*) * 4000 + 65000 AS BIGINT) AS audio_bytes FROM documents GROUP BY source),
blocks AS (
  SELECT stream_id, k AS block, least(65536, audio_bytes - k * 65536) AS bytes FROM audio, unnest(range((audio_bytes + 65535) // 65536)) t(k))"""
_REFILLS = f"""{_BLOCKS}, schedule(stream_id, block, frame) AS (
  SELECT stream_id, CAST(1 AS BIGINT), CAST(-1 AS BIGINT) FROM audio
  UNION ALL
  SELECT s.stream_id, s.block + 1, greatest((s.block * 131072 * 2) // 31468, s.frame + 1)
  FROM schedule s JOIN blocks b ON b.stream_id = s.stream_id AND b.block = s.block + 1)"""


@query("refill_schedule", f"WITH RECURSIVE {_REFILLS} SELECT stream_id, block, frame, (block - 1) * 131072 * 2 // 31468 AS deadline_frame FROM schedule WHERE block > 1")
def refill_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that carries each refill block. The oracle follows the recursion, the query its closed form."""
    return placement.refill_schedule(_audio(spark, sf_dir), NUM, DEN, RATE).select("stream_id", "block", "frame", "deadline_frame")


_INTERLEAVED = f"""{_FRAMES}, {_REFILLS}, carried AS (
  SELECT f.stream_id, f.frame, f.doc_id, f.bytes, coalesce((b.bytes + 2047) // 2048, 0) AS audio_sectors
  FROM frames f LEFT JOIN schedule s ON s.stream_id = f.stream_id AND s.frame = f.frame AND s.block > 1
  LEFT JOIN blocks b ON b.stream_id = s.stream_id AND b.block = s.block),
placed AS (
  SELECT *, CAST(63 + 64 + coalesce(sum(4 + audio_sectors) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS video_sector
  FROM carried)"""


def _interleaved(spark: SparkSession, sf_dir: str, fixed: bool = True) -> DataFrame:
    """Each source's frames with its refills, written down once: all that builds on a layout reads the same rows."""
    blocks = _audio(spark, sf_dir)
    refills = placement.refill_schedule(blocks, NUM, DEN, RATE)
    return written(placement.interleaved(source_frames(spark, sf_dir, fixed), refills, STRIDE, DATA_START, 64), "layout")


@query(
    "layout_interleaved",
    f"WITH RECURSIVE {_INTERLEAVED} SELECT stream_id, frame, doc_id, video_sector, audio_sectors, CASE WHEN audio_sectors > 0 THEN video_sector + 4 ELSE 0 END AS audio_sector FROM placed",
)
def layout_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2 + J4: fixed-stride frames with refill blocks behind the frames that carry them."""
    return _interleaved(spark, sf_dir).select("stream_id", "frame", "doc_id", "video_sector", "audio_sectors", "audio_sector")


@query(
    "mp2_pacing",
    """WITH RECURSIVE streams AS (
  SELECT source AS stream_id, count(*) AS fc, CAST(count(*) * 3000 + 1000 AS BIGINT) AS total FROM documents GROUP BY source),
walk(stream_id, i, pos, chunk_sectors, byte_offset) AS (
  SELECT stream_id, CAST(0 AS BIGINT), least(total, 24576), CASE WHEN fc = 1 THEN (total + 2047) // 2048 ELSE least(12, (total + 2047) // 2048) END, CAST(0 AS BIGINT) FROM streams
  UNION ALL
  SELECT w.stream_id, w.i + 1, least(s.total, w.pos + d.n * 2048), d.n, CASE WHEN d.n > 0 THEN w.pos ELSE 0 END
  FROM walk w JOIN streams s ON s.stream_id = w.stream_id AND w.i + 1 < s.fc,
  LATERAL (SELECT CASE
    WHEN w.i + 1 = s.fc - 1 THEN (s.total - w.pos + 2047) // 2048
    WHEN (w.i + 2) * s.total // s.fc > w.pos AND ((w.i + 2) * s.total // s.fc - w.pos + 2047) // 2048 >= 4 THEN 4 ELSE 0 END AS n) d)
SELECT stream_id, i AS frame, CAST(chunk_sectors AS BIGINT) AS audio_sectors, byte_offset AS audio_byte_offset FROM walk""",
)
def mp2_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 with an integer target: 12 lead sectors, chunks of 4. The oracle walks the frames one by one."""
    frames = source_frames(spark, sf_dir, fixed=False)
    sizes = frames.groupBy("stream_id").agg(F.count("*").alias("n_frames"), (F.count("*") * 3000 + 1000).cast("long").alias("audio_bytes"))
    return placement.paced_chunks(frames.join(sizes, "stream_id"), 12, 4)


@query(
    "extent_overlaps",
    """WITH e AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_orderkey AS start_pos, l_orderkey + CAST(l_quantity AS BIGINT) AS end_pos FROM lineitem),
w AS (SELECT *, lag(end_pos) OVER (PARTITION BY l_suppkey ORDER BY start_pos, end_pos, l_orderkey, l_linenumber) AS previous_end FROM e)
SELECT * FROM w WHERE start_pos < previous_end""",
)
def extent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as extents of a supplier's timeline that begin before the previous one ends."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("start_pos"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end_pos")
    )
    return placement.overlaps(items, ["l_suppkey"], "start_pos", "end_pos", ["l_orderkey", "l_linenumber"])


@query(
    "sector_to_frame",
    f"""WITH {_SIZED}, s AS (SELECT doc_id, (bytes + 2047) // 2048 AS n FROM sized),
p AS (SELECT doc_id, n, CAST(sum(n + doc_id % 3) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM s),
f AS (SELECT doc_id AS frame, coalesce(before, 0) AS a, coalesce(before, 0) + n AS b FROM p WHERE n > 0),
q AS (SELECT o_orderkey, (o_orderkey * 7919) % (SELECT max(b) + 50 FROM f) AS sector FROM orders)
SELECT o_orderkey, sector, coalesce((SELECT min(frame) FROM f WHERE b > sector), (SELECT max(frame) FROM f)) AS frame FROM q""",
)
def sector_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over P1 and prefix sums, with gaps of 0 to 2 sectors behind payloads: the frame of each order's sector."""
    sized = payloads(spark, sf_dir).withColumn("n", U.sectors(F.col("bytes")))
    placed = exclusive_sums(sized, "doc_id", {"a": F.col("n") + F.col("doc_id") % 3})
    frames = placed.where("n > 0").select(F.col("doc_id").alias("frame"), F.col("a").alias("start_sector"), (F.col("a") + F.col("n")).alias("end_sector"))
    top = frames.agg((F.max("end_sector") + 50).alias("top"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(top))  # one row
    probes = orders.select("o_orderkey", F.expr("(o_orderkey * 7919) % top").alias("sector"))
    return lookup.sector_to_frame(probes, "sector", frames).select("o_orderkey", "sector", "frame")


@query(
    "byte_to_chunk",
    """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT page_id, CAST(coalesce(sum(n) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM p WHERE n > 0),
q AS (SELECT event_id, (event_id * 104729) % (SELECT sum(n) + 100 FROM p) AS byte FROM events)
SELECT event_id, CAST(byte AS BIGINT) AS byte, page_id FROM q ASOF LEFT JOIN m ON q.byte >= m.at""",
)
def byte_to_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page whose html starts at or before a byte of all pages' html."""
    sized = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("n")).where("n > 0")
    marks = exclusive_sums(sized, "page_id", {"at": F.col("n")})
    total = sized.agg((F.sum("n") + 100).alias("top"))
    probes = table(spark, sf_dir, "events").select("event_id").join(F.broadcast(total)).select("event_id", F.expr("(event_id * 104729) % top").alias("byte"))  # one row
    return lookup.last_at_or_before(probes, "byte", marks.select("page_id", "at"), "at", "page_id").select("event_id", "byte", "page_id")


@query("clock_to_frame", "SELECT event_id, least(400, (event_id * 524 * 2) // 31468) AS frame, (event_id * 524) // 131072 AS block, ((event_id * 524) // 131072) % 2 AS half FROM events")
def clock_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's ordinal as fields of the sample clock; its frame of 401, ring block and half."""
    clock = F.col("event_id") * U.CLOCK_SAMPLES_PER_FIELD
    block = U.div(clock, 2 * U.HALF_BYTES)
    return table(spark, sf_dir, "events").select(
        "event_id", U.samples_to_frame(clock, F.lit(RATE), F.lit(NUM), F.lit(DEN), F.lit(401)).alias("frame"), block.alias("block"), (block % 2).alias("half")
    )


@query(
    "contiguous_batches",
    """WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
n AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS island FROM k),
b AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey, island ORDER BY l_orderkey) - 1) // 8 AS batch FROM n)
SELECT l_suppkey, CAST(min(l_orderkey) AS BIGINT) AS first, count(*) AS n FROM b GROUP BY l_suppkey, island, batch""",
)
def contiguous_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive orders of a supplier, read eight at a time."""
    return placement.contiguous_batches(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey").select("l_suppkey", "first", "n")


@query("circular_drop", "SELECT event_id, (((user_id - event_id) % 401) + 401) % 401 AS distance, (((user_id - event_id) % 401) + 401) % 401 > 200 AS stale FROM events")
def circular_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, T5: an event is late if its target lies further ahead than half the loop."""
    distance = U.circular_distance(F.col("event_id"), F.col("user_id"), 401)
    return table(spark, sf_dir, "events").select("event_id", distance.alias("distance"), (distance > 200).alias("stale"))


@query(
    "nearest_ready",
    """WITH d AS (SELECT user_id, event_id, (((event_id - user_id * 7) % 401) + 401) % 401 AS distance FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance, event_id) AS turn FROM d WHERE distance <= 27)
SELECT user_id, event_id, distance FROM r WHERE turn = 1""",
)
def nearest_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's slots the nearest at most 27 frames ahead of its target."""
    slots = table(spark, sf_dir, "events").select("user_id", "event_id")
    return lookup.nearest_ahead(slots, ["user_id"], F.col("event_id"), F.col("user_id") * 7, 401, 27, "event_id")


@query(
    "refill_deadlines",
    f"""WITH RECURSIVE {_INTERLEAVED},
loads AS (SELECT p.stream_id, s.block, p.frame, p.video_sector + 4 + p.audio_sectors AS loaded_sector, (s.block - 1) * 131072 * 150 // 31468 + 127 AS due_sector
  FROM placed p JOIN schedule s ON s.stream_id = p.stream_id AND s.frame = p.frame AND s.block > 1 WHERE p.audio_sectors > 0)
SELECT stream_id, block, frame, loaded_sector, due_sector, loaded_sector > due_sector AS late FROM loads""",
)
def refill_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 re-aimed: does each refill of the layout pass under a reader of 150 sectors a second before it must play?"""
    placed = _interleaved(spark, sf_dir).where("audio_sectors > 0")
    due = U.div((F.col("block") - 1) * (2 * U.HALF_BYTES) * 150, RATE) + DATA_START + 64
    loaded = F.col("video_sector") + STRIDE + F.col("audio_sectors")
    return placed.select("stream_id", "block", "frame", loaded.alias("loaded_sector"), due.alias("due_sector"), (loaded > due).alias("late"))


@query(
    "disc_lba",
    """WITH s AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS bytes FROM part)
SELECT p_partkey, bytes, (bytes + 2047) // 2048 AS sectors,
  CAST(2 + coalesce(sum((bytes + 2047) // 2048) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lba FROM s""",
)
def disc_lba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a disc, padded to sectors, from address 2 on."""
    files = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 1000).alias("bytes"))
    return placement.disc_addresses(files, "p_partkey", F.col("bytes"))


def _defective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Layouts of all sources as containers, with defects seeded by frame and source number."""
    n = F.substring("stream_id", 4, 9).cast("long")
    frames = _interleaved(spark, sf_dir, fixed=False).withColumn("n", n)
    spoiled = frames.select(
        "stream_id", "frame",
        (F.col("video_sector") - F.when((F.col("n") % 5 == 1) & (F.col("frame") % 17 == 3), 2).otherwise(0)).alias("video_sector"),
        F.when((F.col("n") % 5 == 2) & (F.col("frame") % 13 == 4), 9000).otherwise(F.greatest("bytes", F.lit(1))).cast("long").alias("video_size"),
        F.lit(STRIDE).cast("long").alias("video_sectors"), (F.col("doc_id") * 31).alias("video_crc32"), "audio_sector",
        F.col("audio_sectors").cast("long").alias("a_sectors"),
        F.when(F.col("audio_sectors") > 0, F.col("block") * U.HALF_BYTES + F.when(F.col("n") % 5 == 3, 2048).otherwise(0)).otherwise(0).cast("long").alias("audio_byte_offset"),
        (F.col("doc_id") * 31 + F.when((F.col("n") % 5 == 4) & (F.col("frame") % 11 == 5), 1).otherwise(0)).alias("payload_crc32"),
    )
    totals = frames.groupBy("stream_id", "n").agg(F.count("*").cast("int").alias("frame_count"), F.max(F.col("video_sector") + STRIDE + F.col("audio_sectors")).alias("end_sector"))
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stream_id")).agg((F.count("*") * 4000 + 65_000).cast("long").alias("audio_bytes"))
    streams = totals.join(counts, "stream_id").select(
        "stream_id", F.lit(rules.MAGIC).alias("magic"), (F.lit(256) + F.when(F.col("n") % 11 == 1, 16).otherwise(0)).alias("width"), F.lit(240).alias("height"), F.when(F.col("n") % 11 == 2, 61).otherwise(NUM).alias("fps_num"), F.lit(DEN).alias("fps_den"),
        "frame_count", F.when(F.col("n") % 11 == 6, 2).otherwise(1).alias("flags"), (F.col("frame_count") * 32 + F.when(F.col("n") % 7 == 6, 32).otherwise(0)).alias("index_bytes"),
        F.lit(DATA_START).cast("long").alias("data_start_sector"), F.when(F.col("n") % 11 == 3, 5).otherwise(STRIDE).cast("long").alias("max_video_sectors"), "audio_bytes",
        (U.sectors(F.col("audio_bytes")) + F.when(F.col("n") % 11 == 4, 1).otherwise(0)).alias("audio_sectors"),
        (F.least(F.lit(64).cast("long"), U.sectors(F.col("audio_bytes"))) - F.when(F.col("n") % 11 == 5, 3).otherwise(0)).alias("preroll_sectors"),
        F.when(F.col("n") % 7 == 5, 32768).otherwise(65536).alias("ring_half_bytes"), F.when(F.col("n") % 7 == 4, 32000).otherwise(RATE).alias("audio_rate_hz"),
        (F.col("end_sector") * 2048).alias("file_bytes"),
    )
    return streams, spoiled


@query(
    "rule_violations",
    f"""WITH RECURSIVE {_INTERLEAVED.replace(_FITS, "")},
x AS (SELECT p.*, CAST(substr(p.stream_id, 4) AS BIGINT) AS n, s.block FROM placed p LEFT JOIN schedule s ON s.stream_id = p.stream_id AND s.frame = p.frame AND s.block > 1),
f AS (SELECT stream_id, n, frame, video_sector - CASE WHEN n % 5 = 1 AND frame % 17 = 3 THEN 2 ELSE 0 END AS v0,
  CASE WHEN n % 5 = 2 AND frame % 13 = 4 THEN 9000 ELSE greatest(bytes, 1) END AS size, audio_sectors AS a,
  CASE WHEN audio_sectors > 0 THEN video_sector + 4 ELSE 0 END AS a0, CASE WHEN audio_sectors > 0 THEN block * 65536 + CASE WHEN n % 5 = 3 THEN 2048 ELSE 0 END ELSE 0 END AS off,
  n % 5 = 4 AND frame % 11 = 5 AS bad_crc FROM x),
t AS (SELECT f.stream_id, n, count(*) AS fc, max(CASE WHEN a > 0 THEN a0 + a ELSE v0 + 4 END) AS end_sector, count(*) FILTER (WHERE a > 0) AS chunks, any_value(audio_bytes) AS audio_bytes
  FROM f JOIN audio ON audio.stream_id = f.stream_id GROUP BY f.stream_id, n),
heads AS (
  SELECT stream_id, 'V1' AS rule FROM t WHERE n % 11 = 1
  UNION ALL SELECT stream_id, 'V2' FROM t WHERE n % 11 = 2 OR fc > 4096
  UNION ALL SELECT stream_id, 'V4' FROM t WHERE n % 11 = 3
  UNION ALL SELECT stream_id, 'V6' FROM t WHERE n % 11 = 4
  UNION ALL SELECT stream_id, 'V7' FROM (SELECT *, least(64, (audio_bytes + 2047) // 2048) - CASE WHEN n % 11 = 5 THEN 3 ELSE 0 END AS pre, (audio_bytes + 2047) // 2048 + CASE WHEN n % 11 = 4 THEN 1 ELSE 0 END AS held FROM t)
    WHERE n % 11 <> 6 AND NOT (pre > 0 AND (pre % 32 = 0 OR pre = held))
  UNION ALL SELECT stream_id, 'V3' AS rule FROM t WHERE n % 7 = 6 OR (64 + fc * 32 + 2047) // 2048 > 63
  UNION ALL SELECT stream_id, 'V5' FROM t WHERE n % 7 IN (4, 5) AND n % 11 <> 6
  UNION ALL SELECT stream_id, 'V12' FROM t WHERE n % 11 <> 6 AND (least(64, (audio_bytes + 2047) // 2048) - CASE WHEN n % 11 = 5 THEN 3 ELSE 0 END + 31) // 32 + chunks <> (audio_bytes + 65535) // 65536),
g AS (SELECT f.*, t.audio_bytes, (least(64, (t.audio_bytes + 2047) // 2048) - CASE WHEN f.n % 11 = 5 THEN 3 ELSE 0 END + 31) // 32 + count(*) FILTER (WHERE a > 0) OVER (PARTITION BY f.stream_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_block
  FROM f JOIN t ON t.stream_id = f.stream_id),
ext AS (SELECT stream_id, frame, v0 AS s, v0 + 4 AS e FROM f UNION ALL SELECT stream_id, frame, a0, a0 + a FROM f WHERE a > 0),
lapped AS (SELECT *, lag(e) OVER (PARTITION BY stream_id ORDER BY s, e, frame) AS before FROM ext)
SELECT stream_id, CAST(NULL AS BIGINT) AS frame, rule FROM heads
UNION ALL SELECT stream_id, frame, 'V8' FROM f WHERE size > 8192
UNION ALL SELECT stream_id, frame, 'V9' FROM f WHERE bad_crc
UNION ALL SELECT stream_id, frame, 'V10' FROM g WHERE n % 11 <> 6 AND a > 0 AND (off <> next_block * 65536 OR a < (least(65536, audio_bytes - off) + 2047) // 2048)
UNION ALL SELECT stream_id, frame, 'V13' FROM f WHERE n % 11 = 6 AND a > 8
UNION ALL SELECT stream_id, frame, 'V11' FROM lapped WHERE s < before""",
)
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V13 over layouts of all payloads, also those over a slot (V8), with seeded defects."""
    return rules.violations(*_defective(spark, sf_dir))


_GATE = """WITH m AS (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS underflows, CAST(max(value) AS DOUBLE) AS clock_error, CAST(count(*) AS BIGINT) AS presented FROM events GROUP BY user_id)
SELECT user_id, 'underflows' AS metric, CAST(underflows AS DOUBLE) AS value, 12.0 AS "limit" FROM m WHERE underflows > 12
UNION ALL SELECT user_id, 'clock_error', clock_error, 250.0 FROM m WHERE clock_error > 250
UNION ALL SELECT user_id, 'presented', CAST(presented AS DOUBLE), 60.0 FROM m WHERE presented < 60"""


@query("threshold_gate", _GATE)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each user's events outside their limits."""
    metrics = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("underflows"), F.max("value").alias("clock_error"), F.count("*").alias("presented")
    )
    return rules.gate(metrics, "user_id", {"underflows": ("max", 12), "clock_error": ("max", 250), "presented": ("min", 60)})
