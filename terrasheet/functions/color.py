"""Colour expressions over Column values; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LUMA = (0.299, 0.587, 0.114)
#: The weights that luma gets when the order of the channels is taken the other way round.
SWAPPED_LUMA = LUMA[::-1]


def gray(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = LUMA) -> Column:
    """Rounded luma, 0 to 255."""
    return F.floor(r * weights[0] + g * weights[1] + b * weights[2] + 0.5).cast("int")


def gray_mean(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def hsv(r: Column, g: Column, b: Column, scale: float = 255.0) -> tuple[Column, Column, Column]:
    """Hue, saturation and value, each 0 to 1; hue of grey is 0."""
    r, g, b = (c.cast("double") / scale for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span) / 6
    return F.when(sector < 0, sector + 1).otherwise(sector), F.when(top == 0, 0.0).otherwise(span / top), top


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def nearest(r: Column, g: Column, b: Column, palette: list[tuple[float, float, float]]) -> Column:
    """The index of the nearest colour; ties go to the first."""
    tries = [F.struct((((r - p[0]) * (r - p[0])) + ((g - p[1]) * (g - p[1])) + ((b - p[2]) * (b - p[2]))).cast("double").alias("d"), F.lit(i).alias("i")) for i, p in enumerate(palette)]
    return F.array_min(F.array(*tries))["i"]


def lookup(index: Column, values: list) -> Column:
    """values[index]; null beyond them."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)
