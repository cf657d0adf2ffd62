"""Column functions with the rounding, median, clamp and angle rules of raster analysis."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: h*c in eV*Angstrom.
HC = 12398.419843320026
GAUSS_FWHM = 2.3548
MAD_SIGMA = 1.4826


def upper_median(x: str | Column) -> Column:
    """The element at n div 2 of the sorted values, without interpolation; an aggregate."""
    values = F.sort_array(F.collect_list(x))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def clamp_to_zero(v: Column, most: float = 1e9) -> Column:
    """0 for values below 0 or over most."""
    return F.when((v < 0) | (v > most), 0.0).otherwise(v)


def clip(v: Column, low: float = 0.0, high: float = 1e9) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def bin_index(v: Column, low: Column, width: Column, n: Column | int) -> Column:
    """Histogram bin of v, the last one closed on the right, values outside clipped."""
    return F.greatest(F.lit(0), F.least(F.floor((v - low) / width), F.lit(n) - 1)).cast("bigint")


def wrap180(angle: Column) -> Column:
    """Angle in [-180, 180)."""
    return F.pmod(angle + 180, F.lit(360.0)) - 180


def wrap360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def in_arc(angle: Column, low: Column, high: Column) -> Column:
    """Whether an angle lies in [low, high], an interval that may wrap past the end of the circle."""
    return F.when(low <= high, (angle >= low) & (angle <= high)).otherwise((angle >= low) | (angle <= high))


def wavelength(energy_ev: Column) -> Column:
    """Wavelength in Angstrom."""
    return F.lit(HC) / energy_ev


def q_magnitude(tth_deg: Column, wave: Column) -> Column:
    return 4 * math.pi * F.sin(F.radians(tth_deg) / 2) / wave


def chi(x: Column, y: Column, beam_x: float, beam_y: float) -> Column:
    """Azimuth in degrees around the beam centre."""
    return F.degrees(F.atan2(y - beam_y, x - beam_x))


def flat_tth(y: Column, x: Column, beam_y: float, beam_x: float, distance: float, pixel: float) -> Column:
    """Scattering angle of a pixel of a flat detector."""
    return F.degrees(F.atan2(pixel * F.hypot(y - beam_y, x - beam_x), F.lit(distance)))


def q_vector(y: Column, x: Column, beam_y: float, beam_x: float, distance: float, pixel: float, wave: float) -> tuple[Column, Column, Column]:
    """(qx, qy, qz) of a pixel, the beam along x."""
    dy, dz, d = (x - beam_x) * pixel, (beam_y - y) * pixel, F.lit(distance)
    norm = F.sqrt(d * d + dy * dy + dz * dz)
    k = 2 * math.pi / wave
    return k * (d / norm - 1), k * dy / norm, k * dz / norm


def rotate_z(qx: Column, qy: Column, theta_deg: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(theta_deg)), F.sin(F.radians(theta_deg))
    return qx * c - qy * s, qx * s + qy * c


def microstrain(tth_deg: Column, ref_deg: Column) -> Column:
    """Lattice strain of a shifted reflection, null where the reference angle has no tangent."""
    return -F.radians((tth_deg - ref_deg) / 2) / F.nullif(F.tan(F.radians(ref_deg / 2)), F.lit(0.0))


def gaussian(x: Column, centre: Column, fwhm: Column, height: Column, floor: Column) -> Column:
    return floor + height * F.exp(-4 * math.log(2) * ((x - centre) / fwhm) ** 2)


def pseudo_voigt(x: Column, centre: Column, gauss: Column, lorentz: Column) -> Column:
    """Unit-height pseudo-Voigt whose width and mixing follow the Gaussian and Lorentzian widths."""
    powers = [gauss**5, 2.69269 * gauss**4 * lorentz, 2.42843 * gauss**3 * lorentz**2, 4.47163 * gauss**2 * lorentz**3, 0.07842 * gauss * lorentz**4, lorentz**5]
    f = F.pow(sum(powers[1:], powers[0]), F.lit(0.2))
    r = lorentz / f
    eta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.36603 * r - 0.47719 * r**2 + 0.11116 * r**3))
    return eta / (1 + 4 * ((x - centre) / f) ** 2) + (1 - eta) * F.exp(-4 * math.log(2) * ((x - centre) / f) ** 2)


def f_score(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """F-beta of counts, 0 where nothing was found or missed."""
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp), F.lit(0.0))


def scan_name(number: Column) -> Column:
    return F.concat(F.lit("Scan_"), F.lpad(number.cast("string"), 4, "0"))


def scan_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("int")


def cell_key(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def duration(seconds: Column) -> Column:
    """A time span as hours, minutes and seconds, the leading zero parts left out."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))


def shoelace(points: Column) -> Column:
    """Area of the polygon whose corners are structs of x and y."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2
