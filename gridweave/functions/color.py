"""Colour expressions: hex, OKLab, luminance, hue.

The matrix entries and transfer-curve constants are the published OKLab and
sRGB values (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LMS = [
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
]
LAB = [
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
]
LAB_INV = [(1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728),
           (1.0, -0.0894841775, -1.2914855480)]
LMS_INV = [(4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965),
           (-0.0041960863, -0.7034186147, 1.7076147010)]


def linear(channel: Column) -> Column:
    """sRGB byte -> linear light."""
    c = channel.cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def gamma_byte(light: Column) -> Column:
    """Linear light -> sRGB byte, clamped and rounded."""
    c = F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(F.greatest(light, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255.0 + 0.5).cast("int")


def _dot(row, cols):
    return row[0] * cols[0] + row[1] * cols[1] + row[2] * cols[2]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    rgb = [linear(r), linear(g), linear(b)]
    lms = [F.cbrt(_dot(row, rgb)) for row in LMS]
    return [_dot(row, lms) for row in LAB]


def oklab_to_rgb(lightness: Column, a: Column, b: Column) -> list[Column]:
    lms = [F.pow(_dot(row, [lightness, a, b]), F.lit(3.0)) for row in LAB_INV]
    return [gamma_byte(_dot(row, lms)) for row in LMS_INV]


def with_oklab(df: DataFrame, prefix: str = "ok") -> "DataFrame":  # noqa: F821
    """Adds ``<prefix>_l, _a, _b, _hue, _chroma`` for columns ``r, g, b``."""
    light = df.withColumns({f"_lin_{c}": linear(F.col(c)) for c in "rgb"})
    rgb = [F.col(f"_lin_{c}") for c in "rgb"]
    light = light.withColumns({f"_lms{i}": F.cbrt(_dot(row, rgb)) for i, row in enumerate(LMS)})
    lms = [F.col(f"_lms{i}") for i in range(3)]
    lab = light.withColumns({f"{prefix}_{n}": _dot(row, lms) for n, row in zip("lab", LAB)})
    a, b = F.col(f"{prefix}_a"), F.col(f"{prefix}_b")
    deg = F.degrees(F.atan2(b, a))
    return lab.withColumns({
        f"{prefix}_hue": F.when(deg < 0, deg + 360.0).otherwise(deg),
        f"{prefix}_chroma": F.sqrt(a * a + b * b),
    }).drop(*[f"_lin_{c}" for c in "rgb"], *[f"_lms{i}" for i in range(3)])


def delta_e(l1, a1, b1, l2, a2, b2) -> Column:
    return F.sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))


def luminance709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def hsv_hue(r: Column, g: Column, b: Column) -> Column:
    """HSV hue in degrees, 0 for greys."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r, 60.0 * F.pmod((g - b) / d, F.lit(6.0))).when(
        top == g, 60.0 * ((b - r) / d + 2.0)).otherwise(60.0 * ((r - g) / d + 4.0))
    return hue


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def hex_valid(text: Column) -> Column:
    return text.rlike("^#([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")


def hex_channels(text: Column) -> dict[str, Column]:
    """``#rrggbb[aa]`` -> channels; null when malformed, alpha defaults to 255."""
    def byte(pos: int) -> Column:
        return F.conv(F.substring(text, pos, 2), 16, 10).cast("int")

    ok = hex_valid(text)
    alpha = F.when(F.length(text) == 9, byte(8)).otherwise(255)
    return {"r": F.when(ok, byte(2)), "g": F.when(ok, byte(4)), "b": F.when(ok, byte(6)),
            "a": F.when(ok, alpha)}
