"""Integer conversions between bytes, sectors, samples, frames and blocks (operators P1-P19, P23-P25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the container format and its hardware.
SECTOR_BYTES = 2048
HALF_BYTES = 65536
HALF_SECTORS = 32
PREROLL_BLOCKS = 2
ADPCM_RATES = {31468: 0, 15734: 1, 7867: 2, 3934: 3}
CLOCK_SAMPLES_PER_FIELD = 524
MP2_FRAME_SAMPLES = 1152
MP2_BACK_OFF_BYTES = 1440
FLAG_ADPCM, FLAG_MP2 = 1, 2


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates, on longs."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), b.cast("long"))


def sectors(n_bytes: Column) -> Column:
    """Sectors that hold ``n_bytes``."""
    return div(n_bytes + (SECTOR_BYTES - 1), SECTOR_BYTES)


def align_down(n_bytes: Column, step: int = 512) -> Column:
    """The multiple of ``step`` (a power of two) at or under ``n_bytes``."""
    return n_bytes.cast("long").bitwiseAND(F.lit(-step).cast("long"))


def codec(flags: Column, audio_bytes: Column) -> Column:
    """The audio codec that header flags name."""
    return F.when(audio_bytes == 0, "none").when(flags.bitwiseAND(F.lit(FLAG_MP2)) != 0, "mp2").when(
        flags.bitwiseAND(F.lit(FLAG_ADPCM)) != 0, "adpcm").otherwise("unknown")


def rate_code(rate: Column) -> Column:
    """P5: code of a legal rate, else null."""
    out = F.lit(None).cast("int")
    for hz, code in ADPCM_RATES.items():
        out = F.when(rate == hz, code).otherwise(out)
    return out


def rate_code_by_threshold(rate: Column) -> Column:
    """P5, the player's variant: code by lower bounds."""
    return F.when(rate >= 24000, 0).when(rate >= 12000, 1).when(rate >= 6000, 2).otherwise(3)


def samples_to_frame(samples: Column, rate: Column, num: Column, den: Column, frames: Column) -> Column:
    """The frame shown at a sample clock, at most the last."""
    return F.least(frames.cast("long") - 1, div(samples.cast("long") * num, rate.cast("long") * den))


def frame_to_adpcm_byte(frame: Column, rate: Column, num: Column, den: Column) -> Column:
    """Byte of the 4-bit stream at a frame's start, at a 512-byte step."""
    return align_down(div(div(frame.cast("long") * rate * den, num), 2))


def frame_to_mp2_byte(frame: Column, total_bytes: Column, frames: Column) -> Column:
    """A byte safely before a frame's audio, for resynchronisation."""
    return F.greatest(F.lit(0).cast("long"), div(frame.cast("long") * total_bytes, frames) - MP2_BACK_OFF_BYTES)


def fields_per_frame(num: Column, den: Column) -> Column:
    """60 Hz fields per frame, 1 to 10."""
    return F.least(F.lit(10).cast("long"), F.greatest(F.lit(1).cast("long"), div(60 * den + div(num, 2), num)))


def circular_distance(start: Column, to: Column, n: Column | int) -> Column:
    """P10: steps forward from one frame to another in a loop of n frames."""
    return F.pmod(to - start, F.lit(n) if isinstance(n, int) else n)


def block_samples(block: Column, audio_bytes: Column) -> Column:
    """Samples of a ring block; the last one may be short."""
    return 2 * F.least(F.lit(HALF_BYTES).cast("long"), audio_bytes - block.cast("long") * HALF_BYTES)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma and two colour differences around 128, each clamped to 0..255."""
    # The weights of the luma and the spans of the colour differences.
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return clamp(y), clamp((b - y) / 2.031999684343434 + 128), clamp((r - y) / 1.139827967171717 + 128)


def pcm_to_10bit(sample: Column) -> Column:
    """A 16-bit sample at 1.5 times gain as a 10-bit code, clipped."""
    s = sample.cast("long")
    return F.least(F.lit(1023).cast("long"), F.greatest(F.lit(0).cast("long"), F.shiftright(s + F.shiftright(s, 1) + 32768, 6)))


def pack_stereo(left: Column, right: Column) -> Column:
    """Two 10-bit codes in one word, bits 0-9 and 16-25."""
    return left.bitwiseOR(F.shiftleft(right, 16))


def unpack_stereo(word: Column) -> tuple[Column, Column]:
    mask = F.lit(1023).cast("long")
    return word.bitwiseAND(mask), F.shiftright(word, 16).bitwiseAND(mask)


def swap_nibbles(byte: Column) -> Column:
    """P19."""
    return div(byte, 16) + F.pmod(byte, F.lit(16)) * 16


def category(value: Column) -> Column:
    """Bits of a coefficient's magnitude; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value.cast("long")))))


def payload(value: Column) -> Column:
    """The bits behind a category; a negative value as its complement."""
    return F.when(value >= 0, value.cast("long")).otherwise(value + F.call_function("shiftleft", F.lit(1).cast("long"), category(value).cast("int")) - 1)


def round_half_away(value: Column) -> Column:
    """P25."""
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("int")


def little_endian(content: Column, at: Column | int, size: int) -> Column:
    """An unsigned integer of ``size`` bytes at a byte offset of a binary column."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("long")


def big_endian(content: Column, at: Column | int, size: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, at.cast("int") + 1, F.lit(size))), 16, 10).cast("long")


def timer_period(rate: Column) -> Column:
    """Ticks of the sound timer for a sample rate."""
    # Periods of the two upper rates and of all others.
    return F.when(rate == 22050, 65).when(rate == 24000, 60).otherwise(89)


def read_command(lba: Column, n_bytes: Column) -> Column:
    """The ten bytes of a READ(10) command for ``n_bytes`` from a block address on."""
    digits = lambda v, n: F.lpad(F.hex(v.cast("long")), n, "0")
    return F.unhex(F.concat(F.lit("2800"), digits(lba, 8), F.lit("00"), digits(sectors(n_bytes), 4), F.lit("00")))


def macro_name(path: Column) -> Column:
    """P20: a path as an upper-case identifier."""
    return F.upper(F.regexp_replace(path, "[^A-Za-z0-9]", "_"))
