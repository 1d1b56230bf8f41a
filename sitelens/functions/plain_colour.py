"""Colour maths on plain numbers, for steps that claim one colour after the other."""

from __future__ import annotations

from functools import lru_cache
from math import atan2, cos, degrees, exp, floor, hypot, radians, sin, sqrt


def channels(hex_: str) -> tuple[int, int, int]:
    """Red, green and blue of #rrggbb."""
    return int(hex_[1:3], 16), int(hex_[3:5], 16), int(hex_[5:7], 16)


def written(rgb: tuple[float, float, float]) -> str:
    """#rrggbb of three channels."""
    return "#" + "".join(f"{min(255, max(0, floor(c + 0.5))):02x}" for c in rgb)


def mixed(a: str, b: str, weight: float) -> str:
    """weight of b in a."""
    return written(tuple(x + (y - x) * weight for x, y in zip(channels(a), channels(b), strict=True)))


def lightness(hex_: str) -> float:
    """HSL lightness from 0 to 1."""
    return (max(channels(hex_)) + min(channels(hex_))) / 510


def contrast(a: str, b: str) -> float:
    """WCAG contrast ratio."""
    def luminance(hex_: str) -> float:
        lin = [c / 255 / 12.92 if c / 255 <= 0.03928 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in channels(hex_)]
        return 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]

    low, high = sorted((luminance(a), luminance(b)))
    return floor((high + 0.05) / (low + 0.05) * 100 + 0.5) / 100


@lru_cache(65536)
def lab(hex_: str) -> tuple[float, float, float]:
    """CIE Lab under D65."""
    r, g, b = (((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in channels(hex_))
    scaled = (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047, 0.2126 * r + 0.7152 * g + 0.0722 * b, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883
    x, y, z = (t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116 for t in scaled)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(p: str, q: str) -> float:
    """CIEDE2000 of two colours (Sharma, Wu and Dalal 2005)."""
    (l1, a1, b1), (l2, a2, b2) = lab(p), lab(q)
    c7 = ((hypot(a1, b1) + hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * sqrt(c7 / (c7 + 25**7))
    d1, d2 = hypot(a1 * g, b1), hypot(a2 * g, b2)
    h1, h2 = (degrees(atan2(b, a * g)) % 360 if a or b else 0.0 for a, b in ((a1, b1), (a2, b2)))
    dh, hm = h2 - h1, (h1 + h2) / 2
    if d1 * d2 == 0:
        dh, hm = 0.0, h1 + h2
    elif abs(h1 - h2) > 180:
        dh, hm = (dh - 360 if dh > 180 else dh + 360), ((h1 + h2 + 360) / 2 if h1 + h2 < 360 else (h1 + h2 - 360) / 2)
    cm, low = (d1 + d2) / 2, ((l1 + l2) / 2 - 50) ** 2
    wave = lambda x: cos(radians(x))
    t = 1 - 0.17 * wave(hm - 30) + 0.24 * wave(2 * hm) + 0.32 * wave(3 * hm + 6) - 0.20 * wave(4 * hm - 63)
    turn = -sin(radians(60 * exp(-(((hm - 275) / 25) ** 2)))) * 2 * sqrt(cm**7 / (cm**7 + 25**7))
    dl = (l2 - l1) / (1 + 0.015 * low / sqrt(20 + low))
    dc = (d2 - d1) / (1 + 0.045 * cm)
    dd = 2 * sqrt(d1 * d2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t)
    return floor(sqrt(max(0.0, dl * dl + dc * dc + dd * dd + turn * dc * dd)) * 10000 + 0.5) / 10000
