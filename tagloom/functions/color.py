"""Colour expressions. Packed colours are 0xRRGGBB integers; channels are 0..1 doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tagloom import lexicon as lx


def channels(packed: Column) -> tuple[Column, Column, Column]:
    """The three 8-bit channels as doubles in 0..1."""
    def part(shift: int) -> Column:
        return F.shiftright(packed, shift).bitwiseAND(255) / F.lit(255.0)
    return part(16), part(8), part(0)


def hex_color(packed: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(packed), 6, "0")))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels in 0..1."""
    def linear(c: Column) -> Column:
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def _linear(v: float) -> float:
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


_GRID = "array(" + ", ".join(f"{_linear(i / 255.0)!r}D" for i in range(256)) + ")"


def _grid(byte: Column) -> Column:
    """Linear light of an 8-bit channel: one read of a constant 256-entry array."""
    return F.get(F.expr(_GRID), byte)


def byte_luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit channels (integer columns)."""
    return 0.2126 * _grid(r) + 0.7152 * _grid(g) + 0.0722 * _grid(b)


def packed_luminance(packed: Column) -> Column:
    return byte_luminance(*[F.shiftright(packed, s).bitwiseAND(255) for s in (16, 8, 0)])


def ratio_of(lum_a: Column, lum_b: Column) -> Column:
    return (F.greatest(lum_a, lum_b) + 0.05) / (F.least(lum_a, lum_b) + 0.05)


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast ratio of two packed colours."""
    return ratio_of(packed_luminance(a), packed_luminance(b))


def quantize(c: Column) -> Column:
    """Snap a channel to the 8-bit grid a renderer shows."""
    return F.rint(c * 255.0) / 255.0


def to_byte(c: Column) -> Column:
    return F.rint(c * 255.0).cast("int")


def quantized_luminance(r: Column, g: Column, b: Column, scale: Column) -> Column:
    return byte_luminance(to_byte(r * scale), to_byte(g * scale), to_byte(b * scale))


def pack(r: Column, g: Column, b: Column) -> Column:
    return pack_bytes(to_byte(r), to_byte(g), to_byte(b))


def pack_bytes(r: Column, g: Column, b: Column) -> Column:
    return (F.shiftleft(r, 16) + F.shiftleft(g, 8) + b).cast("int")


def white_ratio(lum: Column) -> Column:
    return F.lit(1.05) / (lum + 0.05)


def darken_exact(r: Column, g: Column, b: Column, required: float = lx.TEXT_RATIO) -> Column:
    """Least darkening that passes against white on the 8-bit grid, as a packed colour.

    24 halvings of the scale interval, then at most 8 steps of one grid unit.
    """
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        ok = white_ratio(quantized_luminance(r, g, b, mid)) >= required
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"),
                        F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

    lo = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, halve)["lo"]

    def stepped(n: Column, s: Column) -> list[Column]:
        return [F.greatest(F.lit(0), to_byte(c * s) - n) for c in (r, g, b)]

    def settle(s: Column) -> Column:
        tries = F.filter(F.sequence(F.lit(0), F.lit(8)),
                         lambda n: white_ratio(byte_luminance(*stepped(n, s))) >= required)
        return pack_bytes(*stepped(F.coalesce(F.try_element_at(tries, F.lit(1)), F.lit(8)), s))

    passes = white_ratio(quantized_luminance(r, g, b, F.lit(1.0))) >= required
    # transform over a one-element array keeps the searched scale computed once
    searched = F.transform(F.array(lo), settle)[0]
    return F.when(passes, pack(r, g, b)).otherwise(searched)


#: Scales tried are 1.000, 0.995 ... 0.000.
DARKEN_STEPS, DARKEN_BY = 200, 0.005
_GRID_VALUES = np.array([_linear(i / 255.0) for i in range(256)])


def _first_step(required: float):
    """Number of the first step that reaches the ratio, null if none does, for whole Arrow batches of colours at once."""

    def steps(r: pd.Series, g: pd.Series, b: pd.Series, bg: pd.Series) -> pd.Series:
        channels, other = [v.to_numpy(float) for v in (r, g, b)], bg.to_numpy(float)
        usable = ~np.isnan(np.stack([*channels, other])).any(axis=0)
        channels, other = [np.where(usable, v, 0.0) for v in channels], np.where(usable, other, 0.0)

        def passes(step: np.ndarray) -> np.ndarray:
            scale = 1.0 - step * DARKEN_BY
            x, y, z = (_GRID_VALUES[np.rint(v * scale * 255.0).astype(int)] for v in channels)
            lum = 0.2126 * x + 0.7152 * y + 0.0722 * z
            return (np.maximum(lum, other) + 0.05) / (np.minimum(lum, other) + 0.05) >= required

        fails = np.zeros(len(other), int)  # the last step that fails, bit by bit
        bit = 1 << DARKEN_STEPS.bit_length() - 1
        while bit:
            further = fails + bit
            fails = np.where((further <= DARKEN_STEPS) & ~passes(np.minimum(further, DARKEN_STEPS)), further, fails)
            bit >>= 1
        first = np.where(passes(np.zeros_like(fails)), 0, fails + 1)
        return pd.Series(first).astype("Int32").mask(~usable | (first > DARKEN_STEPS))

    return F.pandas_udf(steps, "int")


def with_darken_scale(df: DataFrame, r: Column, g: Column, b: Column, bg_lum: Column, required: float) -> DataFrame:
    """``df`` with ``_scale``, the first scale tried that reaches the ratio; null if none does.

    Darkening a colour that fails can only start to pass once, on the dark side of its background, so the number of
    the last step that fails is found bit by bit, eight tests for a whole batch of rows. As columns the search is either a fold, which is
    interpreted row by row, or a method too long to be compiled.
    """
    out = df.withColumns({"_r": r, "_g": g, "_b": b, "_bg": bg_lum})
    step = _first_step(required)("_r", "_g", "_b", "_bg")
    return out.withColumn("_scale", F.lit(1.0) - step * DARKEN_BY)


def _scaled() -> Column:
    return pack(*[F.col(n) * F.col("_scale") for n in ("_r", "_g", "_b")])


def darken_linear(df: DataFrame, r: Column, g: Column, b: Column, bg_lum: Column, required: float = lx.TEXT_RATIO) -> DataFrame:
    """``df`` with ``_fixed``, the darkened packed colour against a given background; black if nothing passes."""
    out = with_darken_scale(df, r, g, b, bg_lum, required)
    return out.withColumn("_fixed", F.when(F.col("_scale").isNull(), F.lit(0)).otherwise(_scaled())).drop("_r", "_g", "_b", "_bg", "_scale")


def darken_graphic(df: DataFrame, r: Column, g: Column, b: Column, bg_lum: Column, required: float = lx.GRAPHIC_RATIO) -> DataFrame:
    """As above, but null when it passes already or would need too much darkening."""
    out = with_darken_scale(df, r, g, b, bg_lum, required)
    low = ratio_of(quantized_luminance(F.col("_r"), F.col("_g"), F.col("_b"), F.lit(1.0)), F.col("_bg")) < required
    return out.withColumn("_fixed", F.when(low & (F.col("_scale") >= lx.DARKEN_FLOOR), _scaled())).drop("_r", "_g", "_b", "_bg", "_scale")


def device_rgb(space: Column, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """RGB of an rgb / gray / cmyk fill, and whether the space is known."""
    known = F.lower(space).isin("rgb", "gray", "cmyk")

    def channel(rgb: Column, ink: Column) -> Column:
        return (F.when(F.lower(space) == "rgb", rgb).when(F.lower(space) == "gray", a)
                .when(F.lower(space) == "cmyk", (1.0 - ink) * (1.0 - d)).otherwise(F.lit(0.0)))
    return channel(a, a), channel(b, b), channel(c, c), known


def manhattan(a: Column, b: Column) -> Column:
    """Channel-wise distance of two packed colours, in 8-bit units."""
    total = F.lit(0)
    for shift in (16, 8, 0):
        total = total + F.abs(F.shiftright(a, shift).bitwiseAND(255) - F.shiftright(b, shift).bitwiseAND(255))
    return total
