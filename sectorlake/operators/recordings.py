"""A capture against its reference recording: playback rate from two anchors, and the full comparison.

Both tables have (pair, pos, x): samples 0, 1, ... of the reference and of the capture of one pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlake.functions.units import div
from sectorlake.operators import correlate, reports, series
from sectorlake.sources.shared import written

#: The parts of a reference that anchors are taken from, and the least correlation of an anchor that counts.
PARTS = ((0.0, 0.35), (0.65, 1.0))
ANCHORED = 0.5


def _hops(samples: DataFrame, hop: int, floor: float = 0.0) -> DataFrame:
    return series.rms_envelope(samples, "pair", "x", hop, floor)


def dynamic_windows(envelopes: DataFrame, sizes: DataFrame, win: int, stride: int) -> DataFrame:
    """(pair, part, at, dynamics): of the windows of each part the one of the largest deviation over mean; ties: the first.

    ``sizes`` has (pair, n).  Every hop is dealt to the windows that hold it, so no signal is put in one order.
    """
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.floor(F.col("n") * lo).alias("lo"), (F.floor(F.col("n") * hi) - win).alias("hi")) for k, (lo, hi) in enumerate(PARTS)]))
    rows = envelopes.join(sizes, "pair").select("pair", "hop", "rms", part.alias("w")).select("pair", "hop", "rms", "w.*")
    first = F.greatest(F.lit(0).cast("long"), div(F.greatest(F.lit(0).cast("long"), F.col("hop") - win + stride - F.col("lo")), stride))
    last = F.least(F.floor((F.col("hop") - F.col("lo")) / stride), F.floor((F.col("hi") - 1 - F.col("lo")) / stride))
    held = rows.withColumns({"_first": first, "_last": last}).where("_last >= _first").select("pair", "part", "rms", "lo", F.explode(F.sequence("_first", "_last")).alias("j"))
    moved = held.groupBy("pair", "part", (F.col("lo") + F.col("j") * stride).alias("at")).agg(F.round(F.stddev_pop("rms") / (F.avg("rms") + 1e-9), 9).alias("dynamics"), F.count("*").alias("_n"))
    best = F.max_by(F.struct("at", "dynamics"), F.struct("dynamics", -F.col("at"))).alias("_best")
    return moved.where(F.col("_n") == win).groupBy("pair", "part").agg(best).select("pair", "part", "_best.at", "_best.dynamics")


def anchor_scales(
    references: DataFrame, captures: DataFrame, hop: int = 160, start: int = 800, win: int = 100, stride: int = 10, slack: int = 2400, least: int = 1000, size: int = correlate.BLOCK
) -> DataFrame:
    """(pair, offset, reference_1, capture_1, corr_1, reference_2, capture_2, corr_2, time_scale), one row a pair of both tables.

    Envelopes of ``hop`` samples place the reference in the capture from hop ``start`` on; the window of
    ``win`` hops that moves most is taken from the reference's first and last third and found in the
    capture within ``slack`` samples of where it should be.  ``time_scale`` is the anchors' distance in
    the capture over that in the reference.  ``offset`` counts hops, anchors are first samples.  Pairs whose
    reference has less than ``least`` hops, or more than the capture has from ``start`` on, have nulls.
    """
    own, theirs = written(_hops(references, hop), "reference-hops"), written(_hops(captures, hop), "capture-hops")
    sizes = own.groupBy("pair").agg(F.count("*").alias("n")).join(theirs.groupBy("pair").agg((F.count("*") - start).alias("room")), "pair")
    sizes = sizes.where((F.col("n") >= least) & (F.col("room") >= F.col("n"))).select("pair", "n")
    own = own.join(sizes.select("pair"), "pair")
    score = lambda rows: correlate.standard_scores(rows, ["pair"], F.col("rms"), "x").select("pair", F.col("hop").alias("pos"), "x")
    hays = score(theirs.where(F.col("hop") >= start)).withColumn("pos", F.col("pos") - start)
    placed = correlate.correlate(hays, score(own), ["pair"], size=size).select("pair", (F.col("lag") + start).alias("offset"))
    anchors = dynamic_windows(own, sizes, win, stride).join(placed, "pair")
    ends = captures.groupBy("pair").agg((F.max("pos") + 1).alias("_end"))
    expected = (F.col("offset") + F.col("at")) * hop
    spots = anchors.join(ends, "pair").select(
        "pair", "part", "offset", (F.col("at") * hop).alias("reference"), F.greatest(F.lit(0).cast("long"), expected - slack).alias("_lo"), F.least("_end", expected + win * hop + slack).alias("_hi")
    )
    spots = written(spots, "spots")
    needles = references.join(spots, "pair").where((F.col("pos") >= F.col("reference")) & (F.col("pos") < F.col("reference") + win * hop))
    around = captures.join(spots, "pair").where((F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_hi")))
    found = correlate.correlate(
        around.select("pair", "part", (F.col("pos") - F.col("_lo")).alias("pos"), "x"), needles.select("pair", "part", (F.col("pos") - F.col("reference")).alias("pos"), "x"), ["pair", "part"], size=size
    )
    met = spots.join(found, ["pair", "part"]).select("pair", "part", "offset", F.struct("reference", (F.col("_lo") + F.col("lag")).alias("capture"), F.col("score").alias("corr")).alias("a"))
    both = met.groupBy("pair").agg(F.max("offset").alias("offset"), *[F.max(F.when(F.col("part") == k, F.col("a"))).alias(f"_{k + 1}") for k in range(len(PARTS))])
    flat = both.select("pair", "offset", *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in ("reference", "capture", "corr")])
    scaled = flat.withColumn("time_scale", (F.col("capture_2") - F.col("capture_1")) / F.nullif(F.col("reference_2") - F.col("reference_1"), F.lit(0)))
    pairs = references.select("pair").distinct().join(captures.select("pair").distinct(), "pair")
    return pairs.join(scaled, "pair", "left")


def comparison(
    references: DataFrame, captures: DataFrame, rate: int = 16_000, hop: int = 160, long_hop: int = 800, start: int = 800, win: int = 100, stride: int = 10, slack: int = 2400, least: int = 1000,
    least_segment: int = 20, gap: int = 5, size: int = correlate.BLOCK,
) -> DataFrame:
    """One row a pair: by which method its playback rate was found, the rate, and all that speaks for it.

    ``method`` is ``anchors`` where both anchors correlate at ANCHORED or more, else ``active_span``: the span of
    the captured segments that goes best with the reference's; ``none`` where either has no active
    segment of ``least_segment`` long hops.  Times are seconds at ``rate``; ``start`` counts short hops.
    """
    late = div(F.lit(start) * hop + long_hop // 2, long_hop)
    envelopes = [_hops(x, long_hop, 1e-12) for x in (references, captures)]
    envelopes = [written(e, "long-hops") for e in envelopes]
    own, theirs = (series.active_segments(e, "pair", gap=gap, min_len=least_segment) for e in envelopes)
    groups = reports.segment_groups(own, theirs.where(F.col("start") >= late), "pair")
    both = envelopes[0].select(F.concat(F.lit("r"), F.col("pair").cast("string")).alias("signal"), "hop", "rms").unionByName(
        envelopes[1].select(F.concat(F.lit("c"), F.col("pair").cast("string")).alias("signal"), "hop", "rms")
    )
    anchors = anchor_scales(references, captures, hop, start, win, stride, slack, least, size)
    names = anchors.select("pair", F.concat(F.lit("r"), F.col("pair").cast("string")).alias("left"), F.concat(F.lit("c"), F.col("pair").cast("string")).alias("right"))
    scales = correlate.envelope_scales(names.select("left", "right"), both, "signal", "rms", start=start * hop // long_hop, size=size)
    scales = names.join(scales, ["left", "right"]).select("pair", F.col("scale").alias("envelope_scale"), F.col("pos").alias("envelope_offset"), F.col("corr").alias("envelope_corr"))
    joined = anchors.join(groups.withColumnRenamed("start", "_start"), "pair", "left").join(scales, "pair", "left")
    spanned = F.when(F.col("reference_span") > 0, F.col("span") / F.col("reference_span")).otherwise(1.0)
    anchored = F.coalesce(F.least("corr_1", "corr_2") >= ANCHORED, F.lit(False)) & F.col("corr_1").isNotNull() & F.col("corr_2").isNotNull()
    method = F.when(F.col("span").isNull(), "none").when(anchored, "anchors").otherwise("active_span")
    scale = F.when(method == "anchors", F.col("time_scale")).when(method == "active_span", spanned)
    seconds = lambda c: c * (long_hop / rate)
    return joined.select(
        "pair", method.alias("method"), scale.alias("time_scale"), ((scale - 1) * 100).alias("duration_error_pct"), (rate / F.nullif(scale, F.lit(0.0))).alias("effective_rate"),
        seconds(F.col("reference_span")).alias("reference_span"), seconds(F.col("span")).alias("captured_span"), F.when(method != "none", (spanned - 1) * 100).alias("span_error_pct"),
        seconds(F.col("_start")).alias("match_start"), seconds(F.col("_start") + F.col("span")).alias("match_end"), F.least("corr_1", "corr_2").alias("anchor_corr"),
        F.col("time_scale").alias("anchor_scale"), "envelope_corr", "envelope_scale", "envelope_offset",
    )
