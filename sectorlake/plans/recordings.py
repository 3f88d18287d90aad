"""Captures made of events' values, held against the values themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions.units import div
from sectorlake.operators import recordings
from sectorlake.plans.registry import query
from sectorlake.plans.timeline import table

#: Samples of silence before a capture begins, and of the reference between two samples that it plays twice.
LEAD, SLIP = 40, 2048
HOP, LONG_HOP, START, STRETCH, STRIDE, SLACK, LEAST = 2, 10, 10, 25, 5, 30, 40
RATE = 200


def _muted(pos):
    return F.when(div(pos, 80) % 4 == 3, 0.0)


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, captures) of five pairs: every fifth event's value, silent for 80 of 320 samples.

    A capture has LEAD samples of hum first and repeats a sample every SLIP; even pairs capture their
    own reference, odd ones the values of the pair after the next.
    """
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("signal"), div(F.col("event_id"), 5).alias("pos"), (F.col("value") / 500).alias("v"))
    x = F.coalesce(_muted(F.col("pos")), F.col("v")).alias("x")
    references = rows.select(F.col("signal").alias("pair"), "pos", x)
    heard = rows.select(F.explode(F.array_compact(F.array(F.when(F.col("signal") % 2 == 0, F.col("signal")), *[F.when((F.col("signal") - p) % 5 == 2 - 5 * (p > 2), F.lit(p).cast("long")) for p in (1, 3)]))).alias("pair"), "pos", x)
    at = F.col("pos") + div(F.col("pos"), SLIP) + LEAD
    twice = F.when(F.col("pos") % SLIP == SLIP - 1, F.array(at, at + 1)).otherwise(F.array(at))
    played = heard.select("pair", F.explode(twice).alias("pos"), "x")
    hum = played.select("pair").distinct().select("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEAD - 1).cast("long"))).alias("pos"), F.lit(0.0005).alias("x"))
    return references, hum.unionByName(played)


_PAIRS = f"""ev AS (SELECT event_id % 5 AS signal, event_id // 5 AS pos, CASE WHEN (event_id // 5 // 80) % 4 = 3 THEN 0.0 ELSE value / 500 END AS x FROM events),
ref AS (SELECT signal AS pair, pos, x FROM ev),
heard AS (SELECT signal AS pair, pos, x FROM ev WHERE signal % 2 = 0 UNION ALL SELECT 1, pos, x FROM ev WHERE signal = 3 UNION ALL SELECT 3, pos, x FROM ev WHERE signal = 0),
cap AS (
  SELECT pair, pos + pos // {SLIP} + {LEAD} AS pos, x FROM heard UNION ALL SELECT pair, pos + pos // {SLIP} + {LEAD} + 1, x FROM heard WHERE pos % {SLIP} = {SLIP - 1}
  UNION ALL SELECT pair, h, 0.0005 FROM (SELECT DISTINCT pair FROM heard), unnest(range({LEAD})) t(h))"""


def _scored(name: str, rows: str) -> str:
    """Standard scores of ``rows`` (pair, pos, v)."""
    return f"{name} AS (SELECT pair, pos, (v - avg(v) OVER (PARTITION BY pair)) / (stddev_pop(v) OVER (PARTITION BY pair) + 1e-9) AS x FROM ({rows}))"


def _place(name: str, hay: str, needle: str, keys: str) -> str:
    """The best lag of each needle by direct sums, ties first."""
    on = " AND ".join(f"h.{k} = n.{k}" for k in keys.split(", "))
    listed = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    return f"""{name}_n AS (SELECT {keys}, pos, x - avg(x) OVER (PARTITION BY {keys}) AS x FROM {needle}),
{name}_s AS (SELECT {listed("h")}, h.n - n.n AS room, power FROM (SELECT {keys}, max(pos) + 1 AS n FROM {hay} GROUP BY {keys}) h JOIN (SELECT {keys}, max(pos) + 1 AS n, sum(x * x) AS power FROM {name}_n GROUP BY {keys}) n ON {on}),
{name}_c AS (SELECT {listed("n")}, h.pos - n.pos AS lag, sum(n.x * h.x) AS c, sum(h.x * h.x) AS e FROM {name}_n n JOIN {name}_s s ON {on.replace("h.", "s.")} JOIN {hay} h ON {on} AND h.pos BETWEEN n.pos AND n.pos + room GROUP BY {listed("n")}, h.pos - n.pos),
{name}_r AS (SELECT {listed("c")}, lag, round(c / sqrt(greatest(e, 1e-9) * power + 1e-9), 6) AS score FROM {name}_c c JOIN {name}_s s ON {on.replace("h.", "s.").replace("n.", "c.")}),
{name} AS (SELECT * FROM {name}_r QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, lag) = 1)"""


_ANCHORS = f"""{_PAIRS},
re AS (SELECT pair, pos // {HOP} AS hop, sqrt(avg(x * x)) AS rms FROM ref GROUP BY pair, pos // {HOP} HAVING count(*) = {HOP}),
ce AS (SELECT pair, pos // {HOP} AS hop, sqrt(avg(x * x)) AS rms FROM cap GROUP BY pair, pos // {HOP} HAVING count(*) = {HOP}),
size AS (SELECT pair, n FROM (SELECT pair, count(*) AS n FROM re GROUP BY pair) JOIN (SELECT pair, count(*) - {START} AS room FROM ce GROUP BY pair) USING (pair) WHERE n >= {LEAST} AND room >= n),
{_scored("rz", "SELECT pair, hop AS pos, rms AS v FROM re JOIN size USING (pair)")},
{_scored("cz", f"SELECT pair, hop - {START} AS pos, rms AS v FROM ce WHERE hop >= {START}")},
{_place("coarse", "cz", "rz", "pair")},
parts AS (SELECT pair, 1 AS part, 0 AS lo, CAST(floor(n * 0.35::DOUBLE) AS BIGINT) - {STRETCH} AS hi FROM size UNION ALL SELECT pair, 2, CAST(floor(n * 0.65::DOUBLE) AS BIGINT), n - {STRETCH} FROM size),
wins AS (SELECT pair, part, unnest(range(lo, hi, {STRIDE})) AS spot FROM parts),
moved AS (SELECT w.pair, part, spot, round(stddev_pop(rms) / (avg(rms) + 1e-9), 9) AS d FROM wins w JOIN re ON re.pair = w.pair AND hop BETWEEN spot AND spot + {STRETCH - 1} GROUP BY w.pair, part, spot),
best AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY pair, part ORDER BY d DESC, spot) = 1),
spots AS (SELECT pair, part, lag + {START} AS "offset", spot * {HOP} AS reference, greatest(0, (lag + {START} + spot) * {HOP} - {SLACK}) AS lo, (lag + {START} + spot + {STRETCH}) * {HOP} + {SLACK} AS hi FROM best JOIN coarse USING (pair)),
needles AS (SELECT s.pair, part, pos - reference AS pos, x FROM ref JOIN spots s ON ref.pair = s.pair AND pos BETWEEN reference AND reference + {STRETCH * HOP - 1}),
around AS (SELECT s.pair, part, pos - lo AS pos, x FROM cap JOIN spots s ON cap.pair = s.pair AND pos >= lo AND pos < hi),
{_place("fine", "around", "needles", "pair, part")},
met AS (SELECT pair, part, "offset", reference, lo + lag AS capture, score AS corr FROM spots JOIN fine USING (pair, part)),
anchors AS (
  SELECT p.pair, a."offset", a.reference AS reference_1, a.capture AS capture_1, a.corr AS corr_1, b.reference AS reference_2, b.capture AS capture_2, b.corr AS corr_2,
    (b.capture - a.capture) / nullif(b.reference - a.reference, 0)::DOUBLE AS time_scale
  FROM (SELECT DISTINCT pair FROM ref) p LEFT JOIN met a ON a.pair = p.pair AND a.part = 1 LEFT JOIN met b ON b.pair = p.pair AND b.part = 2)"""


@query("anchor_scales", f"""WITH {_ANCHORS} SELECT pair, "offset", reference_1, capture_1, corr_1, reference_2, capture_2, corr_2, round(time_scale, 9) AS time_scale FROM anchors""")
def anchor_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five captures of events' values, their playback rates from two anchors each."""
    found = recordings.anchor_scales(*pairs(spark, sf_dir), HOP, START, STRETCH, STRIDE, SLACK, LEAST, size=1024)
    return found.withColumn("time_scale", F.round("time_scale", 9))


def _segments(name: str, rows: str, start: int) -> str:
    return f"""{name}_l AS (SELECT pair, hop FROM (SELECT *, max(rms) OVER (PARTITION BY pair) AS peak FROM {rows}) WHERE peak > 1e-7 AND rms > greatest(peak * power(10, -34.0 / 20), 0.0015)),
{name}_g AS (SELECT *, CASE WHEN hop - lag(hop) OVER (PARTITION BY pair ORDER BY hop) - 1 <= 5 THEN 0 ELSE 1 END AS fresh FROM {name}_l),
{name}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY pair ORDER BY hop) AS island FROM {name}_g),
{name} AS (SELECT pair, min(hop) AS a, max(hop) + 1 AS b FROM {name}_i GROUP BY pair, island HAVING max(hop) + 1 - min(hop) >= 20 AND min(hop) >= {start})"""


_LATE = (START * HOP + LONG_HOP // 2) // LONG_HOP


@query(
    "recording_comparison",
    f"""WITH {_ANCHORS},
rl AS (SELECT pair, pos // {LONG_HOP} AS hop, sqrt(avg(x * x) + 1e-12) AS rms FROM ref GROUP BY pair, pos // {LONG_HOP} HAVING count(*) = {LONG_HOP}),
cl AS (SELECT pair, pos // {LONG_HOP} AS hop, sqrt(avg(x * x) + 1e-12) AS rms FROM cap GROUP BY pair, pos // {LONG_HOP} HAVING count(*) = {LONG_HOP}),
{_segments("rs", "rl", 0)}, {_segments("cs", "cl", _LATE)},
spans AS (SELECT pair, count(*) AS n, max(b) - min(a) AS span FROM rs GROUP BY pair),
seq AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY a) AS k, count(*) OVER (PARTITION BY pair) AS n FROM cs),
runs AS (SELECT x.pair, x.a, y.b - x.a AS span, s.span AS reference_span FROM seq x JOIN spans s USING (pair) JOIN seq y ON y.pair = x.pair AND y.k = x.k + least(s.n, x.n) - 1),
grp AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pair ORDER BY abs(span - reference_span), a) = 1),
{_scored("za", "SELECT pair, hop AS pos, ln(rms + 1e-5) AS v FROM rl")}, {_scored("zb", "SELECT pair, hop AS pos, ln(rms + 1e-5) AS v FROM cl")},
cnt AS (SELECT pair, n, m FROM (SELECT pair, count(*) AS n FROM za GROUP BY pair) JOIN (SELECT pair, count(*) AS m FROM zb GROUP BY pair) USING (pair) WHERE n >= 8 AND m >= 8),
cand AS (SELECT pair, n, m, CAST(greatest(8, round_even(n * scale, 0)) AS BIGINT) AS len, min(scale) AS scale FROM cnt, (SELECT 1 - 0.1 + 2 * 0.1 * k / 160 AS scale FROM unnest(range(161)) t(k)) GROUP BY pair, n, m, len HAVING len <= m - {START * HOP // LONG_HOP}),
pts AS (SELECT *, i * (n - 1) / (len - 1)::DOUBLE AS idx FROM cand, LATERAL (SELECT unnest(range(len)) AS i)),
drawn AS (SELECT p.pair, len, scale, i, m, lo.x + (idx - floor(idx)) * (coalesce(hi.x, lo.x) - lo.x) AS r FROM pts p JOIN za lo ON lo.pair = p.pair AND lo.pos = floor(idx) LEFT JOIN za hi ON hi.pair = p.pair AND hi.pos = floor(idx) + 1),
dz AS (SELECT *, (r - avg(r) OVER w) / (stddev_pop(r) OVER w + 1e-9) AS q FROM drawn WINDOW w AS (PARTITION BY pair, len)),
dc AS (SELECT d.pair, len, scale, zb.pos - i AS spot, round(sum(q * zb.x) / len, 6) AS corr FROM dz d JOIN zb ON zb.pair = d.pair AND zb.pos - i BETWEEN {START * HOP // LONG_HOP} AND m - len GROUP BY d.pair, len, scale, zb.pos - i),
env AS (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY pair ORDER BY corr DESC, scale, spot) = 1),
joined AS (
  SELECT a.*, g.a, g.span, g.reference_span, e.scale AS envelope_scale, e.spot AS envelope_offset, e.corr AS envelope_corr,
    CASE WHEN g.span IS NULL THEN 'none' WHEN coalesce(least(corr_1, corr_2) >= 0.5 AND corr_1 IS NOT NULL AND corr_2 IS NOT NULL, false) THEN 'anchors' ELSE 'active_span' END AS method,
    CASE WHEN g.reference_span > 0 THEN g.span / g.reference_span::DOUBLE ELSE 1.0 END AS spanned
  FROM anchors a LEFT JOIN grp g USING (pair) LEFT JOIN env e USING (pair)),
scaled AS (SELECT *, CASE method WHEN 'anchors' THEN time_scale WHEN 'active_span' THEN spanned END AS s FROM joined)
SELECT pair, method, round(s, 9) AS time_scale, round((s - 1) * 100, 6) AS duration_error_pct, round({RATE} / s, 6) AS effective_rate, round(reference_span * {LONG_HOP / RATE}, 6) AS reference_span,
  round(span * {LONG_HOP / RATE}, 6) AS captured_span, CASE WHEN method <> 'none' THEN round((spanned - 1) * 100, 6) END AS span_error_pct, round(a * {LONG_HOP / RATE}, 6) AS match_start, round((a + span) * {LONG_HOP / RATE}, 6) AS match_end,
  least(corr_1, corr_2) AS anchor_corr, round(time_scale, 9) AS anchor_scale, envelope_corr, round(envelope_scale, 6) AS envelope_scale, envelope_offset
FROM scaled""",
)
def recording_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full comparison of the same captures; even pairs by anchors, odd ones by their active spans."""
    found = recordings.comparison(*pairs(spark, sf_dir), RATE, HOP, LONG_HOP, START, STRETCH, STRIDE, SLACK, LEAST, size=1024)
    digits = {"time_scale": 9, "anchor_scale": 9} | dict.fromkeys(["duration_error_pct", "effective_rate", "reference_span", "captured_span", "span_error_pct", "match_start", "match_end", "envelope_scale"], 6)
    return found.withColumns({c: F.round(c, d) for c, d in digits.items()})
