"""Scalar functions that Spark lacks, as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, DEGREE = 6.0, 24


def _scaled(u: np.ndarray) -> np.ndarray:
    """log(erfc(x) exp(x^2) / t) at t = 2 / (2 + x), where u in [-1, 1] runs over the t of x from MOST to 0."""
    t = _t(u)
    x = 2 / t - 2
    return np.log([math.erfc(v) for v in x]) + x * x - np.log(t)


def _t(u):
    low = 2 / (2 + MOST)
    return low + (1 - low) * (u + 1) / 2


#: A polynomial in u that interpolates _scaled at Chebyshev points: double precision over the whole range.
SCALED = np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(_scaled, DEGREE)).tolist()


def erf(x: Column) -> Column:
    """Error function, as one expression without loops; beyond 6 it is 1 to double precision."""
    size, low = F.least(F.abs(x), F.lit(MOST)), 2 / (2 + MOST)
    t = 2 / (2 + size)
    u = (t - low) * (2 / (1 - low)) - 1
    total = F.lit(SCALED[-1])
    for c in reversed(SCALED[:-1]):
        total = total * u + c
    # no condition around the polynomial: Spark finds u and t once for all their uses only outside of branches
    return F.signum(x) * (1 - t * F.exp(total - size * size))


def strip_integral(lo: Column, hi: Column) -> Column:
    """Share of a unit Gaussian influence that falls between two scaled bounds."""
    return (erf(hi) - erf(lo)) / 2


def wrap(phase: Column) -> Column:
    """Phase in (-pi, pi]."""
    return F.atan2(F.sin(phase), F.cos(phase))


def floored(phase: Column) -> Column:
    """Phase in [0, 2 pi)."""
    return F.pmod(phase, F.lit(2 * math.pi))


def quantize(phase: Column, bins: int) -> Column:
    """Lower edge of the phase's bin; 0 bins leave it as it is."""
    step = 2 * math.pi / bins if bins else 0
    return F.floor(floored(phase) / step) * F.lit(step) if bins else floored(phase)


def colour_index(phase: Column, bins: int = 16) -> Column:
    """Bin of the phase; the modulus guards against the endpoint."""
    return F.pmod(F.floor(floored(phase) / (2 * math.pi) * bins), F.lit(bins)).cast("int")


def response(age: Column, tau: Column) -> Column:
    """First-order response to an age that counts from 0."""
    return -F.expm1(-F.greatest(age, F.lit(0.0)) / tau)


def line_of_sight(down: Column, east: Column, north: Column, incidence: float, heading: float) -> Column:
    """Displacement towards the sensor; angles in degrees."""
    i, h = math.radians(incidence), math.radians(heading)
    return -down * math.cos(i) + (east * -math.cos(h) + north * math.sin(h)) * math.sin(i)


def phase_of(los: Column, wavelength: float) -> Column:
    return -4 * math.pi * los / wavelength


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole != 0, part / whole)


def uniform(seed: int, stream: str, *keys) -> Column:
    """Draw in [0, 1) that depends on seed, stream and keys only: 48 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(2**48)


def wrap_unit(x: Column, lo: float, hi: float) -> Column:
    """A unit draw scaled to [lo, hi)."""
    return lo + x * (hi - lo)


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue of a colour as a share of the circle; 0 for greys."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = high - low
    sixth = F.when(high == r, (g - b) / spread).when(high == g, 2 + (b - r) / spread).otherwise(4 + (r - g) / spread)
    return F.when(spread == 0, 0.0).otherwise(F.pmod(sixth / 6, F.lit(1.0)))


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return F.when(high == 0, 0.0).otherwise((high - F.least(r, g, b)) / high)


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation between knots (x, y) in rising x; constant outside."""
    out = F.lit(float(knots[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x <= b, p + (q - p) * (x - a) / (b - a)).otherwise(out)
    return F.when(x <= knots[0][0], float(knots[0][1])).otherwise(out)


def hsv_rgb(hue_: Column, saturation_: Column, value: Column) -> Column:
    """Red, green and blue from 0 to 255 of a hue (turns), saturation and value (0 to 1)."""
    place = lambda k: F.pmod(F.lit(float(k)) + 6 * hue_, F.lit(6.0))
    channel = lambda k: value - value * saturation_ * F.greatest(F.lit(0.0), F.least(place(k), 4 - place(k), F.lit(1.0)))
    return F.array(*(F.rint(255 * channel(k)).cast("int") for k in (5, 3, 1)))


def ramp(x: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """Colour between those of the stops on either side, by channel; the end stops' colours beyond them."""
    return F.array(*(F.rint(piecewise(F.greatest(F.lit(stops[0][0]), F.least(F.lit(stops[-1][0]), x)), [(at, float(c[k])) for at, c in stops])).cast("int") for k in range(3)))


def overlaid(rgb: Column, colour: tuple[int, int, int], share: float, marked: Column) -> Column:
    """A colour laid over the marked pixels with a share; what is left of a level is cut off."""
    mixed = F.array(*(F.floor(F.get(rgb, F.lit(k)) * (1 - share) + c * share).cast("int") for k, c in enumerate(colour)))
    return F.when(marked, mixed).otherwise(rgb)
