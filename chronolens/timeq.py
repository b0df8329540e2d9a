"""Rational time, durations and time windows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
_U32 = 2**32 - 1


def _half_away(x: Fraction) -> int:
    n = abs(x) + Fraction(1, 2)
    return (n.numerator // n.denominator) * (1 if x >= 0 else -1)


@dataclass(frozen=True)
class Timestamp:
    """``num / den`` seconds; equality and order are exact, whatever the denominators."""

    num: int
    den: int

    def __post_init__(self):
        if self.den <= 0:
            raise ValueError("a denominator must be positive")

    @property
    def secs(self) -> float:
        return self.num / self.den

    def rescale(self, den: int) -> Timestamp:
        return Timestamp(_half_away(Fraction(self.num, self.den) * den), den)

    @staticmethod
    def of_secs(secs: float, den: int = 1_000_000) -> Timestamp:
        return Timestamp(_half_away(Fraction(secs) * den), den)

    def _with(self, other: Timestamp, sign: int) -> Timestamp:
        den = self.den * other.den // gcd(self.den, other.den)
        den = den if den <= _U32 else 1_000_000
        a, b = self.rescale(den), other.rescale(den)
        return Timestamp(a.num + sign * b.num, den)

    def __add__(self, other: Timestamp) -> Timestamp:
        return self._with(other, 1)

    def __sub__(self, other: Timestamp) -> Timestamp:
        return self._with(other, -1)

    def _key(self) -> Fraction:
        return Fraction(self.num, self.den)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Timestamp) and self._key() == other._key()

    def __lt__(self, other: Timestamp) -> bool:
        return self._key() < other._key()

    def __le__(self, other: Timestamp) -> bool:
        return self._key() <= other._key()

    def __hash__(self) -> int:
        return hash(_half_away(self._key() * 1_000_000))

    def __str__(self) -> str:
        ms = abs(_half_away(self._key() * 1000))
        s, ms = divmod(ms, 1000)
        return f"{'-' if self.num < 0 else ''}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{ms:03d}"


def duration_secs(text: str) -> float:
    """Seconds of a duration such as 20m, 1h30m, 90s, 250ms, 2d; a bare number is seconds."""
    text = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def hms(secs: Column) -> Column:
    """HH:MM:SS of a column of seconds."""
    s = F.floor(secs).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def exact(num: Column, den: Column, other_num: Column, other_den: Column) -> Column:
    """Sign of num/den - other_num/other_den, by cross-multiplication."""
    a = num.cast("decimal(19,0)") * other_den.cast("decimal(10,0)")
    b = other_num.cast("decimal(19,0)") * den.cast("decimal(10,0)")
    return F.signum(a - b).cast("int")


def merge_windows(windows: list[tuple[float, float]], most: int | None = None) -> list[tuple[float, float]]:
    """Overlapping or touching windows joined, in order; an error if more than ``most`` are left."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(windows):
        if b <= a:
            raise ValueError("an empty window")
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    if most is not None and len(out) > most:
        raise ValueError(f"more than {most} windows")
    return out
