"""Zones: bands, the key polygon, huddles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import BEHIND_NET, BEYOND_30, KEY, NET_TO_8, PERIMETER

ARC_STEPS = 40
ARC_DEPTH = 0.3


@dataclass(frozen=True)
class Calibration:
    """Lines and key corners of one camera. key: four points; the arc runs from the third to the fourth."""

    goal_y: float
    yard8_y: float
    yard30_y: float
    key: tuple[tuple[float, float], ...]
    frame_width: int = 3840
    frame_height: int = 2160

    @staticmethod
    def from_points(points: list[list[float]], width: int, height: int) -> Calibration:
        """Eight points: four of the key, then pairs on the 8 and 30 line; the goal line is that of the first pair."""
        mean = lambda i, j: (points[i][1] + points[j][1]) / 2
        return Calibration(mean(0, 1), mean(4, 5), mean(6, 7), tuple((float(x), float(y)) for x, y in points[:4]), width, height)


def key_polygon(cal: Calibration) -> list[tuple[float, float]]:
    """First corner, points along the arc, second corner.

    The arc is a quadratic curve whose control point lies beyond the middle of the last two
    corners, away from the first two, by a share of the arc's chord."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = cal.key
    near, far = ((x1 + x2) / 2, (y1 + y2) / 2), ((x3 + x4) / 2, (y3 + y4) / 2)
    dx, dy = far[0] - near[0], far[1] - near[1]
    norm, chord = max(1.0, math.hypot(dx, dy)), max(1.0, math.hypot(x4 - x3, y4 - y3))
    cx, cy = far[0] + dx / norm * chord * ARC_DEPTH, far[1] + dy / norm * chord * ARC_DEPTH
    arc = []
    for k in range(ARC_STEPS + 1):
        t = k / ARC_STEPS
        arc.append(((1 - t) ** 2 * x3 + 2 * (1 - t) * t * cx + t * t * x4, (1 - t) ** 2 * y3 + 2 * (1 - t) * t * cy + t * t * y4))
    return [(x1, y1), *arc, (x2, y2)]


def edges(polygon: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(polygon, [*polygon[1:], polygon[0]], strict=True)]


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd ray test; a point on an edge is inside. Points out of the polygon's box are done with
    before any edge is looked at."""
    crossings, on = F.lit(0), F.lit(False)
    x, y = x.cast("double"), y.cast("double")
    for ax, ay, bx, by in edges(polygon):
        turn = (F.lit(bx) - ax) * (y - ay) - (F.lit(by) - ay) * (x - ax)
        on = on | ((turn == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            low, high = (ay, by) if ay < by else (by, ay)
            right = turn > 0 if by > ay else turn < 0
            crossings = crossings + F.when((y >= low) & (y < high) & right, 1).otherwise(0)
    xs, ys = zip(*polygon, strict=True)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (on | (crossings % 2 == 1))


def zone(x: Column, y: Column, cal: Calibration, with_key: bool = True) -> Column:
    """Zone of a point: bands by height, and within them the key."""
    out = F.when(y > cal.goal_y, BEHIND_NET)
    if with_key:
        out = out.when(inside(x, y, key_polygon(cal)), KEY)
    return out.when(y >= cal.yard8_y, NET_TO_8).when(y >= cal.yard30_y, PERIMETER).otherwise(BEYOND_30)


def beyond_cutoff(y: Column, zone_col: Column, cal: Calibration, share: float = 0.7) -> Column:
    """True for the far part of the perimeter, which the signal leaves out."""
    return (zone_col == PERIMETER) & (y < F.lit(cal.yard8_y - share * (cal.yard8_y - cal.yard30_y)))


def huddled(points: Column, widths: Column, players: int = 4, ratio: float = 3.0) -> Column:
    """Whether so many players stand within ratio mean widths of each other, on average over pairs.

    points: array of structs x, y."""
    n = F.size(points)

    def from_one(p: Column, i: Column) -> Column:
        rest = F.slice(points, i + 2, F.greatest(n - i - 1, F.lit(0)))
        return F.aggregate(rest, F.lit(0.0), lambda a, q: a + F.hypot(p["x"] - q["x"], p["y"] - q["y"]))

    total = F.aggregate(F.transform(points, from_one), F.lit(0.0), lambda a, v: a + v)
    width = F.aggregate(widths, F.lit(0.0), lambda a, v: a + v) / n
    pairs = n * (n - 1) / 2
    return F.when((n >= players) & (width > 0), total / pairs / width < ratio).otherwise(False)


def colour_range(mean: Column, sd: Column, floor: float, low: float, high: float) -> tuple[Column, Column]:
    """mean -+ max(3 sd, floor), cut to the channel's range."""
    reach = F.greatest(sd * 3, F.lit(float(floor)))
    return F.greatest(F.rint(mean - reach), F.lit(float(low))), F.least(F.rint(mean + reach), F.lit(float(high)))
