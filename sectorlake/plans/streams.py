"""Byte streams made of events: MP2 frames among junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions.prefix import exclusive_sums
from sectorlake.functions.units import div
from sectorlake.operators import frames
from sectorlake.plans.registry import query
from sectorlake.plans.timeline import table

#: Bytes of a chunk of ``mp2_stream_frames``.
CHUNK = 4096


def _piece() -> Column:
    """Each event as a frame of a profile that its numbers choose, some with junk before them and some with what looks like a header inside."""
    e, u = F.col("event_id"), F.col("user_id")
    index, rate, padding, full = (u % 14).cast("int"), (e % 3).cast("int"), (div(e, 7) % 2).cast("int"), (div(e, 3) % 2).cast("int")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    kbps = F.when(full == 1, pick(frames.MP2_KBPS["full"], index)).otherwise(pick(frames.MP2_KBPS["lsf"], index))
    hertz = F.when(full == 1, pick(frames.MP2_RATES["full"], rate)).otherwise(pick(frames.MP2_RATES["lsf"], rate))
    size = div(F.lit(144_000).cast("long") * kbps, hertz.cast("long")) + padding
    third = F.lpad(F.hex(((index + 1) * 16 + rate * 4 + padding * 2).cast("long")), 2, "0")
    head = F.concat(F.when(full == 1, F.lit("FFFD")).otherwise(F.lit("FFF5")), third, F.lit("C0"))
    filler = lambda seed, n: F.substring(F.repeat(F.upper(F.md5(seed.cast("binary"))), 110), F.lit(1), n.cast("int"))
    fake = F.when(e % 11 == 0, F.lit("FFF594C0")).otherwise(F.lit(""))
    body = filler(e.cast("string"), 2 * size - 8 - F.length(fake))
    junk = F.when(e % 13 == 0, F.concat(F.when(e % 26 == 0, F.lit("FFFD94C0")).otherwise(F.lit("")), filler(F.concat(F.lit("j"), e.cast("string")), 2 * (e % 61)))).otherwise(F.lit(""))
    return F.unhex(F.concat(junk, head, fake, body))


@query(
    "mp2_stream_frames",
    f"""WITH RECURSIVE e AS (SELECT event_id AS e, event_id % 5 AS signal, event_id // 5 AS pos, user_id % 14 AS i, event_id % 3 AS r, event_id // 7 % 2 AS pad, event_id // 3 % 2 AS f FROM events),
s AS (SELECT *, 144000 * CASE WHEN f = 1 THEN ({frames.MP2_KBPS["full"]})[i + 1] ELSE ({frames.MP2_KBPS["lsf"]})[i + 1] END // CASE WHEN f = 1 THEN ({frames.MP2_RATES["full"]})[r + 1] ELSE ({frames.MP2_RATES["lsf"]})[r + 1] END + pad AS size,
  CASE WHEN e % 11 = 0 THEN 'FFF594C0' ELSE '' END AS fake FROM e),
p AS (SELECT signal, pos, CASE WHEN e % 13 = 0 THEN CASE WHEN e % 26 = 0 THEN 'FFFD94C0' ELSE '' END || substr(repeat(upper(md5('j' || CAST(e AS VARCHAR))), 110), 1, 2 * (e % 61)) ELSE '' END ||
  CASE WHEN f = 1 THEN 'FFFD' ELSE 'FFF5' END || printf('%02X', (i + 1) * 16 + r * 4 + pad * 2) || 'C0' || fake || substr(repeat(upper(md5(CAST(e AS VARCHAR))), 110), 1, 2 * size - 8 - length(fake)) AS h FROM s),
o AS (SELECT signal, h, coalesce(CAST(sum(length(h) // 2) OVER (PARTITION BY signal ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at0, CAST(sum(length(h) // 2) OVER (PARTITION BY signal) AS BIGINT) AS total FROM p),
y AS (SELECT signal, total, at0 + unnest(range(length(h) // 2)) AS pos, unnest([CAST('0x' || h[2 * k + 1:2 * k + 2] AS INTEGER) FOR k IN range(length(h) // 2)]) AS v FROM o),
b AS (SELECT * FROM (SELECT signal, total, pos, v, lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, lead(v, 3) OVER w AS b3 FROM y WINDOW w AS (PARTITION BY signal ORDER BY pos)) WHERE v = 255 AND b3 IS NOT NULL),
c AS (SELECT signal, pos, total, 144000 * CASE WHEN (b1 & 8) = 8 THEN ({frames.MP2_KBPS["full"]})[b2 >> 4] ELSE ({frames.MP2_KBPS["lsf"]})[b2 >> 4] END //
    CASE WHEN (b1 & 8) = 8 THEN ({frames.MP2_RATES["full"]})[((b2 >> 2) & 3) + 1] ELSE ({frames.MP2_RATES["lsf"]})[((b2 >> 2) & 3) + 1] END + ((b2 >> 1) & 1) AS size, (b2 >> 1) & 1 AS pad
  FROM b WHERE (b1 & 246) = 244 AND (b2 >> 4) BETWEEN 1 AND 14 AND ((b2 >> 2) & 3) < 3),
ok AS (SELECT a.signal, a.pos FROM c a LEFT JOIN c d ON d.signal = a.signal AND d.pos = a.pos + a.size WHERE a.size <= {frames.LONGEST} AND (d.pos IS NOT NULL OR a.total - a.pos < a.size + 4)),
nxt AS (SELECT a.signal, a.pos, a.size, a.pad, a.total, d.pos IS NULL AS hunts, coalesce(d.pos, o.pos) AS following
  FROM c a LEFT JOIN c d ON d.signal = a.signal AND d.pos = a.pos + a.size AND d.size <= {frames.LONGEST} ASOF LEFT JOIN ok o ON o.signal = a.signal AND o.pos >= a.pos + a.size WHERE a.size <= {frames.LONGEST}),
walk AS (
  SELECT n.*, true AS hunted, CAST(0 AS BIGINT) AS frame FROM nxt n JOIN (SELECT signal, min(pos) AS pos FROM ok GROUP BY signal) f USING (signal, pos) WHERE n.pos + size <= total
  UNION ALL SELECT n.*, w.hunts, w.frame + 1 FROM walk w JOIN nxt n ON n.signal = w.signal AND n.pos = w.following WHERE n.pos + n.size <= n.total)
SELECT signal, frame, pos AS start, size, hunted, CASE WHEN hunted THEN (pos + (size - pad) // 2) // (size - pad) END AS guess FROM walk""",
)
def mp2_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of five byte streams with junk between them, found by their headers. The oracle follows the chain frame by frame."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("signal"), div(F.col("event_id"), 5).alias("pos"), "event_id", "user_id")
    # Only sizes are put in order; the bytes are made where the pieces are placed.
    placed = exclusive_sums(events, "pos", {"at": F.octet_length(_piece())}, ("signal",))
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "signal", "pos")
    chunks = frames.byte_chunks(placed.select("signal", "at", _piece().alias("data")), "signal", CHUNK, frames.OVERLAP)
    return frames.split_frames(chunks, "signal", CHUNK).withColumnRenamed("at", "start")
