"""Bit packing, half floats and small formulas as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp


def packed(fields: list[tuple[Column, int, int]]) -> Column:
    """A word of fields (value, first bit, bits); values are cut to their bits."""
    word = F.lit(0).cast("long")
    for value, shift, bits in fields:
        word = word.bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")), shift))
    return word


def unpacked(word: Column, shift: int, bits: int) -> Column:
    return F.shiftright(word.cast("long"), shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def sparse_header(keep: Column, tier: Column, frames: Column, quant: Column, events: Column) -> Column:
    """The header word of a leaf with sparse events: mode 1, coefficients kept, tier, frames a bin (of 16 bins), quantisation, event count (12 bits)."""
    per_bin = F.least(F.lit(15), F.ceil(F.greatest(F.lit(1), frames) / 16.0) - 1)
    return packed([(F.lit(1), 0, 2), (keep - 1, 2, 6), (tier, 8, 2), (per_bin, 10, 4), (quant, 14, 2), (events, 16, 12)])


def plain_header(mode: Column, start: Column, end: Column, config: Column) -> Column:
    """The older header word: mode, first and last frame (7 bits each), configuration."""
    return packed([(mode, 0, 2), (start, 2, 7), (end, 9, 7), (config, 16, 16)])


def nibble(q: Column) -> Column:
    """A value from -8 to 7 as four bits."""
    return F.when(q < 0, q + 16).otherwise(q)


def from_nibble(n: Column) -> Column:
    return F.when(n >= 8, n - 16).otherwise(n)


def half_bits(v: Column) -> Column:
    """The bits of the nearest half float, halves away from zero; too small values are 0, too large ones infinite.

    It is worked out from the value, not from its bits: the exponent is that of the largest
    power of two below it, and the mantissa is rounded at ten bits (at 2**-24 below 2**-14).
    """
    size = F.abs(v.cast("double"))
    exponent = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))), F.lit(-14))
    # log2 may be off by one next to powers of two
    exponent = F.greatest(F.lit(-14), F.when(size < F.pow(F.lit(2.0), exponent), exponent - 1).when(size >= F.pow(F.lit(2.0), exponent + 1), exponent + 1).otherwise(exponent))
    steps = F.floor(size / F.pow(F.lit(2.0), exponent - 10) + 0.5)
    bits = (exponent + 14) * 1024 + steps
    return (F.when(v < 0, 0x8000).otherwise(0) + F.when(bits >= 0x7C00, 0x7C00).otherwise(bits)).cast("long")


def half_value(bits: Column) -> Column:
    """The value of a half float's bits."""
    exponent, mantissa = unpacked(bits, 10, 5), unpacked(bits, 0, 10)
    size = F.when(exponent == 0, mantissa * 2.0**-24).when(exponent == 31, F.when(mantissa == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + mantissa / 1024.0) * F.pow(F.lit(2.0), exponent - 15))
    return F.when(unpacked(bits, 15, 1) == 1, -size).otherwise(size)


def relative_error(truth: Column, pred: Column, absolute: float, relative: float) -> Column:
    """A difference in units of its tolerance."""
    return F.abs(truth - pred) / F.greatest(absolute + relative * F.abs(truth), F.lit(1e-6))


def ramp(v: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, a line between."""
    return F.when(v >= high, 1.0).when(v > low, (v - low) / (high - low)).otherwise(0.0)


def shell_gain(v: Column, top: float, low: float, high: float, most: float) -> Column:
    """1 below low * top, most above high * top, a smooth step between."""
    if most <= 1 or top <= 0:
        return F.lit(1.0)
    u = (v - top * low) / (top * (high - low)) if high > low else F.lit(1.0)
    return F.when(v <= top * low, 1.0).when(v >= top * high, most).otherwise(1 + (most - 1) * u * u * (3 - 2 * u))


def shell_density(phi: Column, width: float) -> Column:
    """Density of a level set's inner shell: 1 at the surface, 0 at width; null outside it."""
    return F.when((phi <= 0) & (-phi <= width), clamp(1 - F.abs(phi) / width, 0.0, 1.0))


def beer_lambert(density: Column, scale: float, length: float) -> Column:
    """What a segment lets through."""
    return F.exp(-density * max(scale, 0.0) * length)


# Where the fire ramp bends, and its colours there.
FIRE = ((0.0, (0.35, 0.005, 0.0)), (0.12, (1.0, 0.03, 0.0)), (0.35, (1.0, 0.22, 0.005)), (0.62, (1.0, 0.48, 0.02)), (1.0, (1.0, 0.82, 0.28)))


def fire(heat: Column, channel: int) -> Column:
    """One channel of the fire ramp."""
    h, out = clamp(heat, 0.0, 1.0), None
    for (a, low), (b, high) in zip(FIRE[:-1], FIRE[1:], strict=True):
        line = low[channel] + (high[channel] - low[channel]) * (h - a) / (b - a)
        out = F.when(h < b, line) if out is None else out.when(h < b, line)
    return out.otherwise(FIRE[-1][1][channel])


# The coefficients of a published approximation of black-body colours.
RED, GREEN_LOW, GREEN_HIGH, BLUE = (1.2929362, -0.13320476), (0.39008158, 0.63184144), (1.1298909, -0.07551485), (0.5432068, 1.1962541)


def black_body(kelvin: Column) -> dict[str, Column]:
    """Red, green and blue of a temperature."""
    t = clamp(kelvin, 1000.0, 12000.0) / 100.0
    above = F.greatest(t - 60.0, F.lit(1e-9))
    red = F.when(t <= 66, 1.0).otherwise(clamp(RED[0] * F.pow(above, F.lit(RED[1])), 0.0, 1.0))
    green = F.when(t <= 66, clamp(GREEN_LOW[0] * F.ln(t) - GREEN_LOW[1], 0.0, 1.0)).otherwise(clamp(GREEN_HIGH[0] * F.pow(above, F.lit(GREEN_HIGH[1])), 0.0, 1.0))
    blue = F.when(t >= 66, 1.0).when(t <= 19, 0.0).otherwise(clamp(BLUE[0] * F.ln(F.greatest(t - 10.0, F.lit(1e-9))) - BLUE[1], 0.0, 1.0))
    return {"red": red, "green": green, "blue": blue}


def triple(text: Column) -> Column:
    """Three whole numbers from "x,y,z"; null where the text is anything else."""
    parts = F.split(text, ",")
    return F.when(text.rlike(r"^\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*$"), F.struct(*[F.trim(F.get(parts, i)).cast("long").alias(a) for i, a in enumerate("xyz")]))


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))


def length(a: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(c * c for c in a))


def stepped(frame: Column, delta: Column, frames: int, loop: bool) -> Column:
    """The frame after a step of delta: around, or clamped to the ends."""
    return F.pmod(frame + delta, F.lit(frames)) if loop else F.least(F.lit(frames - 1), F.greatest(F.lit(0), frame + delta))


def density_weight(v: Column, cutoff: float, band: float) -> Column:
    """4 within the band around a cutoff, 2 above it, 1.5 up to two bands below it, else 1."""
    b = max(1e-6, band)
    return F.when(F.abs(v - cutoff) <= b, 4.0).when(v >= cutoff, 2.0).when(v >= cutoff - 2 * b, 1.5).otherwise(1.0)
