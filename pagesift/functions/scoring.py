"""Scores of findings, 0.0 to 9.9 in tenths, and the levels they stand for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each level's lowest and highest score, and the score the level alone stands for.
BANDS = {"hint": (0.0, 0.9, 0.5), "info": (1.0, 3.2, 2.0), "warning": (3.3, 6.5, 5.0), "error": (6.6, 9.9, 8.0)}
#: Levels from the most urgent one.
ORDER = tuple(reversed(BANDS))


def tenths(score: Column) -> Column:
    return F.least(F.lit(9.9), F.greatest(F.lit(0.0), F.floor(score.cast("double") * 10 + 0.5) / 10))


def _by_level(level: Column, k: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, band in BANDS.items() for x in (name, band[k])]), level)


def level_of(score: Column) -> Column:
    t, out = tenths(score), F.lit("hint")
    for name, band in BANDS.items():
        out = F.when(t >= band[0], name).otherwise(out)
    return out


def base_score(level: Column) -> Column:
    return _by_level(level, 2)


def pinned(level: Column, score: Column) -> Column:
    """The score moved into the level's band."""
    return F.least(_by_level(level, 1), F.greatest(_by_level(level, 0), tenths(score)))


def interpolated(value: Column, scale: Sequence[tuple[float, float]]) -> Column:
    """The score at ``value`` on the line through the scale's points, level beyond its ends."""
    points = sorted(scale)
    v, out = value.cast("double"), F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        out = F.when(v <= x1, F.lit(float(y0)) + F.lit(float(y1 - y0)) * (v - F.lit(float(x0))) / F.lit(float(x1 - x0))).otherwise(out)
    out = F.when(v <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)
    return tenths(F.when(v.isNotNull(), out))


def weight(score: Column) -> Column:
    """What a failed check costs: 1 at the base of a warning, rising with the square."""
    return (score / BANDS["warning"][2]) * (score / BANDS["warning"][2])


def level_rank(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(ORDER) for x in (name, i)]), level)
