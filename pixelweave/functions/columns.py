"""Column-level formulas: fluorescence ratios, camera units, precision, colour."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def adu_to_photons(counts: Column, baseline: float = 100.0, photons_per_adu: float = 1.0,
                   quantum_efficiency: float = 1.0, em_gain: float = 1.0) -> Column:
    return (counts - baseline) * photons_per_adu / quantum_efficiency / em_gain


def localization_precision(intensity: Column, background: Column, sigma: Column, pixel_size: float = 1.0,
                           least_squares: bool = False, emccd: bool = False) -> Column:
    """Thompson-Mortensen uncertainty; null when no photons were counted."""
    s2 = sigma * sigma + pixel_size * pixel_size / 12.0
    var = s2 / intensity + 8 * math.pi * s2 * s2 * background * background / (
        pixel_size * pixel_size * intensity * intensity)
    factor = (16.0 / 9.0 if least_squares else 1.0) * (2.0 if emccd else 1.0)
    return F.when(intensity > 0, F.sqrt(var * factor))


def apparent_fret(donor: Column, acceptor: Column, bg_donor: float = 0.0, bg_acceptor: float = 0.0) -> Column:
    d = F.greatest(donor - bg_donor, F.lit(0.0))
    a = F.greatest(acceptor - bg_acceptor, F.lit(0.0))
    return F.when(d + a > 0, a / (d + a))


def corrected_fret(donor: Column, acceptor: Column, bleed_through: float, direct_excitation: float,
                   gamma: float = 1.0, bg_donor: float = 0.0, bg_acceptor: float = 0.0) -> Column:
    d = F.greatest(donor - bg_donor, F.lit(0.0))
    a = F.greatest(acceptor - bg_acceptor, F.lit(0.0))
    fc = a - bleed_through * d - direct_excitation * a
    total = fc + gamma * d
    return F.when(total > 0, fc / total)


def fret_stoichiometry(donor: Column, acceptor: Column, gamma: float = 1.0,
                       bg_donor: float = 0.0, bg_acceptor: float = 0.0) -> Column:
    d = F.greatest(donor - bg_donor, F.lit(0.0))
    a = F.greatest(acceptor - bg_acceptor, F.lit(0.0))
    return F.when(a + gamma * d > 0, (a + d) / (a + gamma * d))


def half_time(tau: Column) -> Column:
    return tau * math.log(2.0)


def soumpasis_diffusion(half: Column, radius: Column) -> Column:
    """0.224 r^2 / t_half; null for a non-positive half time."""
    return F.when(half > 0, 0.224 * radius * radius / half)


def grayscale(r: Column, g: Column, b: Column, method: str = "Luminance") -> Column:
    if method == "Luminance":
        return 0.2126 * r + 0.7152 * g + 0.0722 * b
    if method == "Average":
        return (r + g + b) / 3
    if method == "Lightness":
        return (F.greatest(r, g, b) + F.least(r, g, b)) / 2
    raise ValueError(method)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = (F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0)))
           .when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)) / 6
    return [hue.alias("hue"), F.when(top == 0, 0.0).otherwise(span / top).alias("saturation"), top.alias("brightness")]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    def channel(shift: int) -> Column:
        k = F.pmod(h * 6 + shift, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return [channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b")]


# ITU-R BT.601 studio-range YCbCr matrix and offsets.
YCBCR = ((65.481, 128.553, 24.966, 16.0), (-37.797, -74.203, 112.0, 128.0), (112.0, -93.786, -18.214, 128.0))
# sRGB to XYZ matrix and the D65 2-degree white point.
SRGB_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
D65 = (0.95047, 1.0, 1.08883)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    return [(m[0] * r + m[1] * g + m[2] * b + m[3]).alias(n) for m, n in zip(YCBCR, ("luma", "cb", "cr"))]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    f = []
    for row, white in zip(SRGB_XYZ, D65):
        t = (row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0))
    return [(116 * f[1] - 16).alias("lightness"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b_axis")]


def normalize_spectrum(data: Column) -> Column:
    """Array divided by its sum (by 1 when the sum is not positive)."""
    total = F.aggregate(data, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(data, lambda v: v / F.when(total > 0, total).otherwise(1.0))
