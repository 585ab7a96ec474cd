"""Scalar column functions: links, normalisation, densities, colours, channels, pose geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: what is undefined is left out of means."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp_negative(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def share_of(x: Column, total: Column) -> Column:
    """x over total, x itself where the total is 0."""
    return F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), x.cast("double"))


def rescale(x: Column, low: Column, high: Column) -> Column:
    """To 0..1; a constant column is only shifted."""
    return F.when(high != low, (x - low) / (high - low)).otherwise(x - low)


def histogram_bin(x: Column, low: float, high: float, n: int) -> Column:
    """The nearest of n centres from low to high, ties to the lower one, outliers to the ends."""
    step = (high - low) / (n - 1)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.ceil((x - low) / step - 0.5))).cast("int")


def gaussian2(dx: Column, dy: Column, lx: Column, ly: Column, along: float, across: float) -> Column:
    """A 2-D Gaussian stretched along the limb (lx, ly): variances along * (length + 1) and across in the limb's frame."""
    length = F.sqrt(lx * lx + ly * ly)
    c, s = F.coalesce(F.try_divide(lx, length), F.lit(1.0)), F.coalesce(F.try_divide(ly, length), F.lit(0.0))
    u, v = c * dx + s * dy, c * dy - s * dx
    a, b = along * (length + 1), F.lit(across)
    return F.exp(-0.5 * (u * u / a + v * v / b)) / (2 * math.pi * F.sqrt(a * b))


def normal2(x: Column, y: Column, m: list[Column], cov: list[Column]) -> Column:
    """A bivariate normal density; cov: xx, xy, yy."""
    xx, xy, yy = cov
    det = xx * yy - xy * xy
    dx, dy = x - m[0], y - m[1]
    q = (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det
    return F.exp(-0.5 * q) / (2 * math.pi * F.sqrt(det))


def pack24(r: Column, g: Column, b: Column) -> Column:
    """Three bytes as one number, the first lowest."""
    return r.cast("int").bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(F.shiftleft(b.cast("int"), 16))


def unpack24(x: Column) -> list[Column]:
    return [F.shiftright(x, s).bitwiseAND(F.lit(255)) for s in (0, 8, 16)]


# sRGB to XYZ under D65, and the white point.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> list[Column]:
    return [m[0] * r + m[1] * g + m[2] * b for m in _XYZ]


def _invert(m: tuple) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def xyz_to_rgb(x: Column, y: Column, z: Column) -> list[Column]:
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), m[0] * x + m[1] * y + m[2] * z)) for m in _invert(_XYZ)]


def xyz_to_lab(x: Column, y: Column, z: Column) -> list[Column]:
    f = [F.when(v / w > 0.008856, F.pow(v / w, F.lit(1 / 3))).otherwise(7.787 * v / w + 16 / 116) for v, w in zip((x, y, z), _WHITE)]
    light = F.when(y / _WHITE[1] > 0.008856, 116 * f[1] - 16).otherwise(903.3 * y / _WHITE[1])
    return [light, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_to_xyz(light: Column, a: Column, b: Column) -> list[Column]:
    fy = (light + 16) / 116
    back = lambda f: F.when(f > 0.206893, f * f * f).otherwise((f - 16 / 116) / 7.787)
    return [w * back(f) for w, f in zip(_WHITE, (fy + a / 500, fy, fy - b / 200))]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    return xyz_to_lab(*rgb_to_xyz(r, g, b))


# Linear sRGB to XYZ in hundredths under D65, the way back, and the white point.
_SRGB = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
_SRGB_BACK = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
_D65 = (95.047, 100.0, 108.883)


def srgb_to_xyz(r: Column, g: Column, b: Column) -> list[Column]:
    """XYZ from 0 to 100 of gamma-corrected channels from 0 to 1; rgb_to_xyz() takes linear ones."""
    linear = [100 * F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    return [sum((k * c for k, c in zip(m[1:], linear[1:])), m[0] * linear[0]) for m in _SRGB]


def xyz_to_srgb(x: Column, y: Column, z: Column) -> list[Column]:
    """Gamma-corrected channels, clipped to 0..1 as bytes are."""
    linear = [(m[0] * x + m[1] * y + m[2] * z) / 100 for m in _SRGB_BACK]
    curved = [F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c) for c in linear]
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) for c in curved]


def xyz_to_cielab(x: Column, y: Column, z: Column, white: tuple[float, float, float] = _D65) -> list[Column]:
    """L, a, b of XYZ from 0 to 100, with one formula for L at all lightnesses."""
    f = [F.when(v / w > 0.008856, F.pow(v / w, F.lit(1 / 3))).otherwise(7.787 * (v / w) + 16 / 116) for v, w in zip((x, y, z), white)]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def cielab_to_xyz(light: Column, a: Column, b: Column, white: tuple[float, float, float] = _D65) -> list[Column]:
    fy = (light + 16) / 116
    back = lambda f: F.when(F.pow(f, F.lit(3)) > 0.008856, F.pow(f, F.lit(3))).otherwise((f - 16 / 116) / 7.787)
    return [back(f) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), white)]


def srgb_to_cielab(r: Column, g: Column, b: Column) -> list[Column]:
    return xyz_to_cielab(*srgb_to_xyz(r, g, b))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sixth = F.when(d == 0, F.lit(0.0)).when(top == r, F.try_divide(g - b, d)).when(top == g, 2 + F.try_divide(b - r, d)).otherwise(4 + F.try_divide(r - g, d)) / 6
    return [F.when(sixth < 0, sixth + 1).otherwise(sixth), F.coalesce(F.try_divide(d, top), F.lit(0.0)), top]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    i = F.floor(h * 6) % 6
    f = h * 6 - F.floor(h * 6)
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    pick = lambda *x: F.element_at(F.array(*x), (i + 1).cast("int"))
    return [pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)]


def oriented(x: Column, y: Column, jx: Column, jy: Column, dx: Column, dy: Column, width: Column, height: Column) -> list[Column]:
    """Coordinates seen from a joint, turned so that the limb's direction is the vertical axis."""
    angle = -math.pi / 2 + F.atan2(dy / height, dx / width)
    c, s, u, v = F.cos(angle), F.sin(angle), (x - jx) / width, (y - jy) / height
    return [c * u + s * v, c * v - s * u]


def flip_x(x: Column, width: Column) -> Column:
    """A mirrored column position, counted from 1."""
    return width - x + 1


def resize(x: Column, scale: Column | float) -> Column:
    """A position counted from 1 after scaling."""
    return scale * (x - 1) + 1


def unscale(x: Column, scale: Column | float) -> Column:
    return (x - 1) / scale + 1


def direction(x: Column, y: Column, px: Column, py: Column) -> list[Column]:
    """The unit vector from the parent; (0, -1) where they coincide."""
    n = F.sqrt((x - px) ** 2 + (y - py) ** 2)
    return [F.coalesce(F.try_divide(x - px, n), F.lit(0.0)), F.coalesce(F.try_divide(y - py, n), F.lit(-1.0))]


def hazen_quantile(values: Column, p: float) -> Column:
    """The p-quantile with midpoints at (i - 0.5) / n, from an array."""
    v, n = F.array_sort(values), F.size(values)
    at = F.least(F.greatest(p * n + 0.5, F.lit(1.0)), n.cast("double"))
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, n)
    return F.element_at(v, lo) + (at - lo) * (F.element_at(v, hi) - F.element_at(v, lo))


def pair_vector(a: Column, b: Column) -> Column:
    """Half sums, then absolute differences, of two arrays."""
    return F.concat(F.zip_with(a, b, lambda x, y: (x + y) / 2), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def intersection(a: Column, b: Column) -> Column:
    """Histogram intersection: the sum of the smaller entries."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda s, x: s + x)
