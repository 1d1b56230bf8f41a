"""Colour maths on columns: channels are doubles from 0 to 255; every function is a pure expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed

#: Named colours for nearest-name look-up, in order of preference on ties.
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "crimson": "#dc143c", "tomato": "#ff6347", "coral": "#ff7f50", "orange": "#ffa500", "darkorange": "#ff8c00",
    "amber": "#ffbf00", "gold": "#ffd700", "yellow": "#ffff00", "olive": "#808000", "chartreuse": "#7fff00", "lime": "#00ff00", "green": "#008000", "forestgreen": "#228b22",
    "seagreen": "#2e8b57", "emerald": "#50c878", "teal": "#008080", "turquoise": "#40e0d0", "cyan": "#00ffff", "darkcyan": "#008b8b", "skyblue": "#87ceeb", "dodgerblue": "#1e90ff",
    "blue": "#0000ff", "royalblue": "#4169e1", "navy": "#000080", "midnightblue": "#191970", "indigo": "#4b0082", "purple": "#800080", "rebeccapurple": "#663399", "violet": "#ee82ee",
    "magenta": "#ff00ff", "fuchsia": "#ff00ff", "pink": "#ffc0cb", "hotpink": "#ff69b4", "brown": "#a52a2a", "saddlebrown": "#8b4513", "sienna": "#a0522d", "peru": "#cd853f",
    "tan": "#d2b48c", "beige": "#f5f5dc", "ivory": "#fffff0", "wheat": "#f5deb3", "khaki": "#f0e68c", "plum": "#dda0dd", "orchid": "#da70d6", "lavender": "#e6e6fa",
    "slategray": "#708090", "gray": "#808080", "dimgray": "#696969", "silver": "#c0c0c0", "darkgray": "#a9a9a9", "lightgray": "#d3d3d3", "whitesmoke": "#f5f5f5", "gainsboro": "#dcdcdc",
    "linen": "#faf0e6", "azure": "#f0ffff", "aliceblue": "#f0f8ff",
}


def rgb(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """A colour as a struct of doubles."""
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"), (F.lit(1.0) if a is None else a.cast("double")).alias("a"))


def _channel(raw: Column) -> Column:
    value = F.regexp_extract(raw, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.least(F.greatest(F.coalesce(F.when(raw.contains("%"), value * 2.55).otherwise(value), F.lit(0.0)), F.lit(0.0)), F.lit(255.0))


def _alpha(raw: Column) -> Column:
    value = F.regexp_extract(raw, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    return F.least(F.greatest(F.coalesce(F.when(raw.contains("%"), value / 100).otherwise(value), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))


def parse(s: Column) -> Column:
    """Hex with 3, 4, 6 or 8 digits, rgb(), rgba(), hsl(), hsla(), a bare HSL triple, a name, transparent; else null."""
    t = F.lower(F.trim(s))
    digits = F.regexp_extract(t, "^#([0-9a-f]{3,8})$", 1)
    wide = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    byte = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("double")
    hexed = F.when(F.length(digits).isin(3, 4, 6, 8), rgb(byte(1), byte(3), byte(5), F.when(F.length(wide) == 8, byte(7) / 255).otherwise(F.lit(1.0))))
    inside = F.filter(F.split(F.regexp_extract(t, r"^(?:rgba?|hsla?)\(([^)]*)\)$", 1), r"[\s,/]+"), lambda x: x != "")
    from_rgb = F.when(t.rlike(r"^rgba?\([^)]*\)$") & (F.size(inside) >= 3), rgb(_channel(inside[0]), _channel(inside[1]), _channel(inside[2]), F.when(F.size(inside) > 3, _alpha(F.get(inside, F.lit(3)))).otherwise(F.lit(1.0))))
    bare = F.split(F.regexp_extract(t, r"^(-?[0-9.]+(?:deg)?\s+[0-9.]+%\s+[0-9.]+%)$", 1), r"\s+")
    part = lambda p, i: F.regexp_extract(F.get(p, F.lit(i)), r"([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    turn = F.when(F.get(inside, F.lit(0)).contains("turn"), 360.0).when(F.get(inside, F.lit(0)).contains("rad"), 57.29577951308232).otherwise(1.0)
    from_hsl = F.when(t.rlike(r"^hsla?\([^)]*\)$") & (F.size(inside) >= 3), hsl_to_rgb(F.pmod(part(inside, 0) * turn, F.lit(360.0)), part(inside, 1) / 100, part(inside, 2) / 100, F.when(F.size(inside) > 3, _alpha(F.get(inside, F.lit(3)))).otherwise(F.lit(1.0))))
    from_bare = F.when(F.size(bare) == 3, hsl_to_rgb(F.pmod(part(bare, 0), F.lit(360.0)), part(bare, 1) / 100, part(bare, 2) / 100, F.lit(1.0)))
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k, v)])
    hit = names[t]
    named = F.when(hit.isNotNull(), rgb(*(F.conv(F.substring(hit, i, 2), 16, 10) for i in (2, 4, 6))))
    clear = F.when(t == "transparent", rgb(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    return F.coalesce(hexed, from_rgb, from_hsl, from_bare, named, clear)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, channels clamped and rounded."""
    one = lambda x: F.lpad(F.lower(F.hex(F.floor(F.least(F.greatest(x, F.lit(0)), F.lit(255)) + 0.5).cast("bigint"))), 2, "0")
    return F.concat(F.lit("#"), one(r), one(g), one(b))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, 0 for greys."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(top == low, F.lit(1.0)).otherwise(top - low)
    return F.when(top == low, F.lit(0.0)).when(top == r, F.pmod(60.0 * (g - b) / d, F.lit(360.0))).when(top == g, 60.0 * (b - r) / d + 120).otherwise(60.0 * (r - g) / d + 240)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSL saturation from 0 to 1."""
    top, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    span = 1 - F.abs(top + low - 1)
    return F.when(top == low, F.lit(0.0)).otherwise((top - low) / F.when(span == 0, F.lit(1.0)).otherwise(span))


def lightness(r: Column, g: Column, b: Column) -> Column:
    """HSL lightness from 0 to 1."""
    return (F.greatest(r, g, b) + F.least(r, g, b)) / 510.0


def hsl_to_rgb(h: Column, s: Column, light: Column, a: Column) -> Column:
    """A colour from hue in degrees, saturation and lightness from 0 to 1."""
    def value(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30.0, F.lit(12.0))
        return 255.0 * (light - s * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))
    return rgb(value(0), value(8), value(4), a)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """WCAG relative luminance."""
    lin = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances, two places."""
    return fixed((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 2)


def grade(ratio: Column) -> Column:
    """WCAG grade of a ratio."""
    return F.when(ratio >= 7, "AAA").when(ratio >= 4.5, "AA").when(ratio >= 3, "AA Large").otherwise("Fail")


def is_light(r: Column, g: Column, b: Column) -> Column:
    """Brightness over 150 of 255."""
    return (299 * r + 587 * g + 114 * b) / 1000 > 150


def mix(a: Column, b: Column, w: float) -> Column:
    """w of b in a, channel by channel."""
    return F.struct(*[(a[c] * (1 - w) + b[c] * w).alias(c) for c in ("r", "g", "b", "a")])


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab under D65."""
    lin = lambda c: F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92)
    x = (0.4124 * lin(r) + 0.3576 * lin(g) + 0.1805 * lin(b)) / 0.95047
    y = 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)
    z = (0.0193 * lin(r) + 0.1192 * lin(g) + 0.9505 * lin(b)) / 1.08883
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    return F.struct((116 * f(y) - 16).alias("l"), (500 * (f(x) - f(y))).alias("a"), (200 * (f(y) - f(z))).alias("b"))


def _held(x: Column, f) -> Column:
    """f of x, with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def delta_e(p: Column, q: Column) -> Column:
    """CIEDE2000 of two Lab structs, four places (Sharma, Wu and Dalal 2005)."""
    cos = lambda x: F.cos(F.radians(x))
    angle = lambda y, x: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))

    def primed(v: Column) -> Column:
        m7 = F.pow((F.hypot(v["p"]["a"], v["p"]["b"]) + F.hypot(v["q"]["a"], v["q"]["b"])) / 2, F.lit(7.0))
        return F.struct(v["p"].alias("p"), v["q"].alias("q"), (1.5 - 0.5 * F.sqrt(m7 / (m7 + 6103515625.0))).alias("g"))

    def polar(v: Column) -> Column:
        a1, a2, b1, b2 = v["p"]["a"] * v["g"], v["q"]["a"] * v["g"], v["p"]["b"], v["q"]["b"]
        return F.struct(v["p"]["l"].alias("l1"), v["q"]["l"].alias("l2"), F.hypot(a1, b1).alias("d1"), F.hypot(a2, b2).alias("d2"), angle(b1, a1).alias("h1"), angle(b2, a2).alias("h2"))

    def means(v: Column) -> Column:
        h1, h2, none = v["h1"], v["h2"], v["d1"] * v["d2"] == 0
        dh = F.when(none, F.lit(0.0)).when(h2 - h1 > 180, h2 - h1 - 360).when(h2 - h1 < -180, h2 - h1 + 360).otherwise(h2 - h1)
        hm = F.when(none, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
        low = F.pow((v["l1"] + v["l2"]) / 2 - 50, F.lit(2.0))
        return F.struct(v.alias("v"), dh.alias("dh"), hm.alias("hm"), low.alias("low"), ((v["d1"] + v["d2"]) / 2).alias("cm"))

    def distance(m: Column) -> Column:
        v, hm, cm = m["v"], m["hm"], m["cm"]
        t = 1 - 0.17 * cos(hm - 30) + 0.24 * cos(2 * hm) + 0.32 * cos(3 * hm + 6) - 0.20 * cos(4 * hm - 63)
        turn = -F.sin(F.radians(60 * F.exp(-F.pow((hm - 275) / 25, F.lit(2.0))))) * 2
        cm7 = F.pow(cm, F.lit(7.0))
        dl = (v["l2"] - v["l1"]) / (1 + 0.015 * m["low"] / F.sqrt(20 + m["low"]))
        dc = (v["d2"] - v["d1"]) / (1 + 0.045 * cm)
        dd = 2 * F.sqrt(v["d1"] * v["d2"]) * F.sin(F.radians(m["dh"] / 2)) / (1 + 0.015 * cm * t)
        parts = F.struct(dl.alias("l"), dc.alias("c"), dd.alias("h"), (turn * F.sqrt(cm7 / (cm7 + 6103515625.0))).alias("r"))
        return _held(parts, lambda x: F.sqrt(x["l"] * x["l"] + x["c"] * x["c"] + x["h"] * x["h"] + x["r"] * x["c"] * x["h"]))

    both = F.struct(p.alias("p"), q.alias("q"))
    return fixed(_held(both, lambda a: _held(primed(a), lambda b: _held(polar(b), lambda c: _held(means(c), distance)))), 4)
