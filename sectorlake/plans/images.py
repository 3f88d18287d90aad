"""Block and picture queries: each embedding as an 8x8 block of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlake.functions import units as U
from sectorlake.operators import bitstream, blocks8
from sectorlake.operators.frames import MP2_KBPS, MP2_RATES
from sectorlake.operators.reports import pearson
from sectorlake.plans.registry import query
from sectorlake.plans.timeline import table
from sectorlake.sources.shared import written

QUALITY_75 = [max(1, min(255, (b * 50 + 50) // 100)) for b in blocks8.BASE_LUMA]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, pixels): components spread over 0 to 255, rounded to whole numbers."""
    spread = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double") * 400 + 128))).cast("double"))
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", spread.alias("pixels"))


_PIXELS = "px AS (SELECT vec_id, label, [floor(greatest(0.0, least(255.0, CAST(x AS DOUBLE) * 400 + 128))) FOR x IN embedding] AS p FROM embeddings WHERE len(embedding) = 64)"
_TABLE = ", ".join(map(str, QUALITY_75))
_DCT = f"""{_PIXELS}, cell AS (SELECT vec_id, i, p[i + 1] - 128 AS v FROM px, unnest(range(64)) t(i)),
k AS (SELECT j, i, (CASE WHEN j % 8 = 0 THEN sqrt(0.5) ELSE 1 END) * (CASE WHEN j // 8 = 0 THEN sqrt(0.5) ELSE 1 END)
  * cos((2 * (i % 8) + 1) * (j % 8) * pi() / 16) * cos((2 * (i // 8) + 1) * (j // 8) * pi() / 16) / 16 AS w FROM unnest(range(64)) a(j), unnest(range(64)) b(i)),
dct AS (SELECT vec_id, j, sum(w * v) AS c FROM cell JOIN k ON cell.i = k.i GROUP BY vec_id, j)"""
_QUANT = f"""{_DCT}, q AS (SELECT vec_id, j, CAST(greatest(-511, least(511, sign(round(c / ([{_TABLE}])[j + 1], 9)) * floor(abs(round(c / ([{_TABLE}])[j + 1], 9)) + 0.5))) AS INTEGER) AS q FROM dct)"""
_ZIGZAG = ", ".join(map(str, blocks8.zigzag()))
_RUNS = f"""{_QUANT}, z AS (SELECT q.vec_id, seq, q AS level FROM (SELECT unnest(range(63)) AS seq, unnest([{_ZIGZAG}]) AS j) o JOIN q ON q.j = o.j WHERE q <> 0),
g AS (SELECT *, seq - coalesce(lag(seq) OVER (PARTITION BY vec_id ORDER BY seq), -1) - 1 AS gap FROM z),
runs AS (SELECT vec_id, seq, CASE WHEN gap > 15 THEN (gap - 1) // 15 ELSE 0 END AS escapes, gap - 15 * CASE WHEN gap > 15 THEN (gap - 1) // 15 ELSE 0 END AS run, level FROM g)"""


def quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    dct = blocks8.forward_dct(pixels(spark, sf_dir), "pixels")
    return dct.withColumn("q", blocks8.quantize(F.col("coefficients"), QUALITY_75))


@query(
    "quant_tables",
    f"""WITH base AS (SELECT 'y' AS plane, unnest(range(64)) AS pos, unnest({blocks8.BASE_LUMA}) AS base UNION ALL SELECT 'uv', unnest(range(64)), unnest({blocks8.BASE_CHROMA})),
s AS (SELECT quality, CASE WHEN quality = 100 THEN 1 WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END AS scale FROM unnest(range(1, 101)) t(quality))
SELECT CAST(quality AS INTEGER) AS quality, plane, CAST(pos AS INTEGER) AS pos, CAST(greatest(1, least(255, (base * scale + 50) // 100)) AS INTEGER) AS entry FROM s, base""",
)
def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantizers of every quality."""
    return blocks8.quant_tables(spark, range(1, 101))


@query("block_fdct", f"WITH {_DCT} SELECT vec_id, CAST(j AS INTEGER) AS pos, round(c, 6) + 0.0 AS coefficient FROM dct")
def block_fdct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each block."""
    rows = blocks8.forward_dct(pixels(spark, sf_dir), "pixels").select("vec_id", F.posexplode("coefficients").alias("pos", "c"))
    return rows.select("vec_id", "pos", (F.round("c", 6) + 0.0).alias("coefficient"))


@query("block_quantize", f"WITH {_QUANT} SELECT vec_id, CAST(j AS INTEGER) AS pos, q FROM q")
def block_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients in steps of quality 75."""
    return quantized(spark, sf_dir).select("vec_id", F.posexplode("q").alias("pos", "q"))


@query("zigzag_runs", f"WITH {_RUNS} SELECT vec_id, CAST(seq AS INTEGER) AS seq, CAST(escapes AS INTEGER) AS escapes, CAST(run AS INTEGER) AS run, level FROM runs")
def zigzag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of zeros before each non-zero coefficient."""
    return blocks8.runs(quantized(spark, sf_dir), "vec_id", "q")


# Bits of the luma codes by run (lines, 0 to 15) and category (1 to 9), of the end mark and of sixteen zeros.
LUMA_BITS = [
    [2, 2, 3, 4, 5, 6, 9, 12, 11],  # run 0
    [4, 5, 7, 12, 12, 12, 12, 12, 11],  # run 1
    [5, 7, 12, 12, 12, 12, 12, 12, 11],  # run 2
    [6, 12, 12, 12, 12, 12, 12, 12, 11],  # run 3
    [6, 12, 12, 12, 12, 12, 12, 12, 11],  # run 4
    [6, 12, 12, 12, 12, 12, 12, 12, 11],  # run 5
    [7, 12, 12, 12, 12, 12, 12, 12, 11],  # run 6
    [9, 12, 12, 12, 12, 12, 12, 12, 11],  # run 7
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 8
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 9
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 10
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 11
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 12
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 13
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 14
    [12, 12, 12, 12, 12, 12, 12, 12, 11],  # run 15
]
END_BITS, ZEROS_BITS = 5, 12


def luma_code_bits() -> list[tuple[int, int]]:
    """(symbol, bits) of the luma code, with symbol 16 * run + category."""
    return [(0, END_BITS), (16, ZEROS_BITS), *((16 * run + n + 1, bits) for run, line in enumerate(LUMA_BITS) for n, bits in enumerate(line))]


_CODES = ", ".join(f"({s}, {b})" for s, b in luma_code_bits())


@query(
    "huffman_bits",
    f"""WITH {_RUNS}, codes(symbol, bits) AS (VALUES {_CODES}),
c AS (SELECT *, length(ltrim(bin(abs(level)), '0')) AS category FROM runs),
spent AS (SELECT c.vec_id, sum(bits + category + escapes * 12) AS bits, max(seq) AS last, count(*) FILTER (WHERE bits IS NULL) AS uncoded
  FROM c LEFT JOIN codes ON codes.symbol = 16 * c.run + c.category GROUP BY c.vec_id)
SELECT px.vec_id, CAST(coalesce(bits, 0) + CASE WHEN last = 62 THEN 0 ELSE 5 END AS BIGINT) AS bits, CAST(coalesce(uncoded, 0) AS BIGINT) AS uncoded
FROM px LEFT JOIN spent ON spent.vec_id = px.vec_id""",
)
def huffman_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + J6: bits of each block's alternating coefficients."""
    q = quantized(spark, sf_dir)
    codes = spark.createDataFrame(luma_code_bits(), "symbol int, bits int")
    return blocks8.bit_cost(blocks8.runs(q, "vec_id", "q"), "vec_id", q, codes)


@query(
    "dc_prediction",
    f"WITH {_QUANT} SELECT vec_id, q AS dc, q - coalesce(lag(q) OVER (PARTITION BY vec_id // 16 ORDER BY vec_id), 0) AS dc_diff FROM q WHERE j = 0",
)
def dc_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First coefficients as differences within strips of 16 blocks."""
    q = quantized(spark, sf_dir).select("vec_id", F.element_at("q", 1).alias("dc")).withColumn("strip", U.div(F.col("vec_id"), 16))
    return blocks8.dc_differences(q, ["strip"], "vec_id", F.col("dc")).select("vec_id", "dc", "dc_diff")


@query(
    "chroma_subsample",
    f"""WITH {_PIXELS} SELECT vec_id, CAST(c AS INTEGER) AS cell, (p[1 + b] + p[2 + b] + p[9 + b] + p[10 + b]) / 4 AS mean
FROM px, LATERAL (SELECT i AS c, (i // 4) * 16 + (i % 4) * 2 AS b FROM unnest(range(16)) t(i)) x""",
)
def chroma_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 2x2 cells."""
    return pixels(spark, sf_dir).select("vec_id", F.posexplode(blocks8.halve(F.col("pixels"))).alias("cell", "mean"))


def beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, a, b): pixels of each block and of the next: one join of arrays."""
    own = pixels(spark, sf_dir).select("vec_id", F.col("pixels").alias("a"))
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


LOWER, RIGHT, BODY = (lambda i: i >= 32), (lambda i: i % 8 >= 6), (lambda i: i % 8 < 6)


def _mean(values: Column, cells) -> Column:
    own = F.filter(values, lambda _, i: cells(i)) if cells else values
    return F.aggregate(own, F.lit(0.0), lambda s, v: s + v) / F.size(own)


def mean_error(a: Column, b: Column, cells=None) -> Column:
    """A5: mean absolute difference, over all cells or those that ``cells`` picks by number."""
    return _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)), cells)


def dark_share(a: Column, cells=None, level: float = 100) -> Column:
    """Share of the cells under a level."""
    return _mean(F.transform(a, lambda v: F.when(v < level, 1.0).otherwise(0.0)), cells)


@query(
    "image_metrics",
    f"""WITH {_PIXELS}, a AS (SELECT vec_id, i, p[i + 1] AS v FROM px, unnest(range(64)) t(i))
SELECT a.vec_id, round(avg(abs(a.v - b.v)), 6) AS mae, round(corr(a.v, b.v), 5) AS corr, round(avg(CASE WHEN a.i % 8 >= 6 THEN abs(a.v - b.v) END), 6) AS edge_mae,
  round(avg(CASE WHEN a.v < 100 THEN 1.0 ELSE 0.0 END), 6) AS black, round(avg(CASE WHEN a.i >= 32 THEN CASE WHEN a.v < 100 THEN 1.0 ELSE 0.0 END END), 6) AS black_below
FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id""",
)
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block against the next: mean absolute error, correlation, right edge, dark shares."""
    a, b = F.col("a"), F.col("b")
    return beside(spark, sf_dir).select(
        "vec_id", F.round(mean_error(a, b), 6).alias("mae"), F.round(pearson(a, b), 5).alias("corr"), F.round(mean_error(a, b, RIGHT), 6).alias("edge_mae"),
        F.round(dark_share(a), 6).alias("black"), F.round(dark_share(a, LOWER), 6).alias("black_below"),
    )


@query(
    "rgb_to_yuv",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity * 5 AS r, l_discount * 2550 AS g, l_tax * 3000 AS b FROM lineitem),
y AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM c)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(255, y)), 6) AS y, round(greatest(0, least(255, (b - y) / 2.031999684343434 + 128)), 6) AS u,
  round(greatest(0, least(255, (r - y) / 1.139827967171717 + 128)), 6) AS v FROM y""",
)
def rgb_to_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax as colours."""
    y, u, v = U.rgb_to_yuv(F.col("l_quantity") * 5, F.col("l_discount") * 2550, F.col("l_tax") * 3000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def mp2_profiles(spark: SparkSession) -> DataFrame:
    """(version, kbps, rate, padding, frame_bytes): P17 over all legal headers."""
    rows = [(v, k, r, p) for v in MP2_KBPS for k in MP2_KBPS[v] for r in MP2_RATES[v] for p in (0, 1)]
    profiles = spark.createDataFrame(rows, "version string, kbps int, rate int, padding int")
    return profiles.withColumn("frame_bytes", U.div(F.lit(144_000).cast("long") * F.col("kbps"), F.col("rate")) + F.col("padding"))


def mp2_header(content):
    """Struct (valid, version, kbps_index, rate_index, padding, channels) of a frame's first four bytes."""
    byte = lambda i: U.big_endian(content, i, 1)
    field = lambda i, shift, mask: F.shiftright(byte(i), shift).bitwiseAND(F.lit(mask).cast("long")).cast("int")
    index = field(2, 4, 15) - 1
    valid = (byte(0) == 0xFF) & (byte(1).bitwiseAND(F.lit(0xF6).cast("long")) == 0xF4) & index.between(0, 13) & (field(2, 2, 3) != 3)
    return F.struct(
        valid.alias("valid"), F.when(field(1, 3, 1) == 0, "lsf").otherwise("full").alias("version"), index.alias("kbps_index"), field(2, 2, 3).alias("rate_index"),
        field(2, 1, 1).alias("padding"), F.when(field(3, 6, 3) == 3, 1).otherwise(2).alias("channels"),
    )


@query(
    "mp2_frame_sizes",
    f"""WITH k AS (SELECT 'lsf' AS version, unnest({MP2_KBPS["lsf"]}) AS kbps UNION ALL SELECT 'full', unnest({MP2_KBPS["full"]})),
r AS (SELECT 'lsf' AS version, unnest({MP2_RATES["lsf"]}) AS rate UNION ALL SELECT 'full', unnest({MP2_RATES["full"]}))
SELECT k.version, kbps, rate, padding, CAST(144000 * kbps // rate + padding AS BIGINT) AS frame_bytes FROM k JOIN r ON k.version = r.version, (VALUES (0), (1)) p(padding)""",
)
def mp2_frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame bytes of every version, bit rate, sample rate and padding."""
    return mp2_profiles(spark)


@query("macro_name", "SELECT page_id, upper(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g')) AS name FROM pages")
def macro_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: addresses as identifiers."""
    return table(spark, sf_dir, "pages").select("page_id", U.macro_name(F.col("url")).alias("name"))


@query(
    "crc_payload",
    """WITH RECURSIVE step(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
byte_table AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(n)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc32
FROM h, byte_table""",
)
def crc_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each payload. The oracle makes its table from the polynomial."""
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc32"))


@query(
    "pcm_packing",
    "WITH s AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) - 9000 AS v FROM events), c AS (SELECT *, greatest(0, least(1023, (v + (v >> 1) + 32768) >> 6)) AS code FROM s) "
    "SELECT event_id, code, code | ((1023 - code) << 16) AS word FROM c",
)
def pcm_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as 10-bit codes, packed with their mirror."""
    code = U.pcm_to_10bit(F.floor(F.col("value") * 60) - 9000)
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), U.pack_stereo(code, 1023 - code).alias("word"))


_DC_CODES = bitstream.canonical(dict(enumerate(blocks8.DC_LUMA_BITS)))
_AC_CODES = bitstream.canonical(dict(luma_code_bits()), end=0, last=16)
_WRITTEN = f"""{_RUNS}, ac(symbol, code, bits) AS (VALUES {", ".join(map(str, _AC_CODES))}), dcc(symbol, code, bits) AS (VALUES {", ".join(map(str, _DC_CODES))}),
d AS (SELECT vec_id, vec_id // 16 AS strip, greatest(-511, least(511, q - coalesce(lag(q) OVER (PARTITION BY vec_id // 16 ORDER BY vec_id), 0))) AS v FROM q WHERE j = 0),
t AS (SELECT vec_id, strip, -1 AS seq, v, length(ltrim(bin(abs(v)), '0')) AS n, '' AS before, length(ltrim(bin(abs(v)), '0')) AS symbol, true AS dc FROM d
  UNION ALL SELECT r.vec_id, strip, seq, level, length(ltrim(bin(abs(level)), '0')), repeat('111101111111', escapes), 16 * run + length(ltrim(bin(abs(level)), '0')), false FROM runs r JOIN d USING (vec_id)),
bits AS (SELECT vec_id, strip, seq, before || lpad(ltrim(bin(coalesce(dcc.code, ac.code)), '0'), CAST(coalesce(dcc.bits, ac.bits) AS INTEGER), '0') || CASE WHEN n > 0 THEN lpad(ltrim(bin(CASE WHEN v >= 0 THEN v ELSE v + (1 << n) - 1 END), '0'), CAST(n AS INTEGER), '0') ELSE '' END AS b
  FROM t LEFT JOIN dcc ON dc AND dcc.symbol = t.symbol LEFT JOIN ac ON NOT dc AND ac.symbol = t.symbol
  UNION ALL SELECT vec_id, strip, 1000, '11111' FROM d WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.vec_id = d.vec_id AND seq = 62))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strip, vec_id, seq, value, bits) of all blocks, in strips of 16."""
    q = written(quantized(spark, sf_dir).select("vec_id", "q"), "quantized")
    first = q.select("vec_id", F.element_at("q", 1).alias("dc"), U.div(F.col("vec_id"), 16).alias("strip"))
    codes = lambda rows: spark.createDataFrame(rows, "symbol int, code bigint, bits int")
    return bitstream.block_tokens(blocks8.dc_differences(first, ["strip"], "vec_id", F.col("dc")), blocks8.runs(q, "vec_id", "q"), "strip", "vec_id", codes(_DC_CODES), codes(_AC_CODES))


@query("block_bits", f"WITH {_WRITTEN} SELECT vec_id, CAST(sum(length(b)) AS BIGINT) AS bits FROM bits GROUP BY vec_id")
def block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each block, first coefficient and alternating part."""
    return bitstream.block_bits(_tokens(spark, sf_dir), "vec_id")


@query(
    "strip_bytes",
    f"""WITH {_WRITTEN}, s AS (SELECT strip, string_agg(b, '' ORDER BY vec_id, seq) AS b FROM bits GROUP BY strip),
p AS (SELECT strip, length(b) AS n, rpad(b, CAST((length(b) + 7) // 8 * 8 AS INTEGER), '0') AS b FROM s),
h AS (SELECT strip, n, [CAST(list_sum([CAST(substr(b, 8 * k + i, 1) AS INTEGER) << (8 - i) FOR i IN range(1, 9)]) AS INTEGER) FOR k IN range(length(b) // 8)] AS v FROM p)
SELECT strip, n AS n_bits, CAST(len(v) AS BIGINT) AS n_bytes, CAST(len(v) + len(list_filter(v, lambda x: x = 255)) AS BIGINT) AS stuffed_bytes,
  md5(array_to_string([CASE WHEN x = 255 THEN 'FF00' ELSE printf('%02X', x) END FOR x IN v], '')) AS hex_md5 FROM h""",
)
def strip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of 16 blocks written as bytes, with their stuffing. The oracle makes one string of bits a strip."""
    made = bitstream.pack(_tokens(spark, sf_dir), "strip", ["vec_id", "seq"])
    return made.select("strip", "n_bits", "n_bytes", F.octet_length("data").cast("long").alias("stuffed_bytes"), F.md5(F.hex("data").cast("binary")).alias("hex_md5"))
