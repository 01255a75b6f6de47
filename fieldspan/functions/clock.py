"""Clock and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(clock: Column, period_sec: float = 900.0) -> Column:
    """Seconds since the period began from a MM:SS clock that counts down."""
    part = F.split(clock, ":")
    return F.lit(float(period_sec)) - (F.try_element_at(part, F.lit(1)).try_cast("double") * 60 + F.try_element_at(part, F.lit(2)).try_cast("double"))


def remaining_clock(elapsed_sec: Column, period_sec: float = 900.0) -> Column:
    """MM:SS.ss left in the period."""
    left = F.greatest(F.lit(float(period_sec)) - elapsed_sec, F.lit(0.0))
    minutes = F.floor(left / 60)
    return F.format_string("%02d:%05.2f", minutes.cast("int"), left - minutes * 60)


def frame_clock(frame: Column, fps: float = 30.0) -> Column:
    """HH:MM:SS of a frame number."""
    s = F.floor(frame / F.lit(float(fps))).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int"), s % 60)


def seconds_or_clock(text: Column) -> Column:
    """Seconds from "MM:SS" or a plain number; null where it is neither."""
    part = F.split(F.trim(text), ":")
    two = F.try_element_at(part, F.lit(1)).try_cast("double") * 60 + F.try_element_at(part, F.lit(2)).try_cast("double")
    return F.when(F.size(part) == 2, two).when(F.size(part) == 1, F.trim(text).try_cast("double"))


def to_frame(second: Column, first_frame: Column, fps: float = 30.0) -> Column:
    """Frame of a second within a quarter: the product is cut, not rounded, in binary doubles."""
    return first_frame + (second * F.lit(float(fps))).cast("int")


def rounded(x: Column, digits: int = 1) -> Column:
    """x to so many decimals as its exact binary value asks for, halves to even: 0.25 gives 0.2, 0.35 (a little less in binary)
    0.3, 2.675 2.67. round() goes by the shortest decimal that stands for x, and takes halves up.

    x times a power of ten is a double and what it lost, found without error by cutting both factors in halves;
    which side of the middle it lies on follows from both."""
    p = float(10**digits)
    x = x.cast("double")

    def halves(v: Column) -> tuple[Column, Column]:
        c = v * 134217729.0  # 2 ** 27 + 1
        high = c - (c - v)
        return high, v - high

    (xh, xl), t = halves(x), x * p
    c = p * 134217729.0
    ph = c - (c - p)
    pl = p - ph
    lost = ((xh * ph - t) + xh * pl + xl * ph) + xl * pl
    low = F.floor(t).cast("double")
    beyond = (t - low - 0.5) + lost
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    # From 2 ** 52 on there is nothing behind the point to round; nor in what isn't a finite number.
    return F.when(F.abs(t) < 4503599627370496.0, F.when(up, low + 1.0).otherwise(low) / p).otherwise(x)


def interval_id(quarter: Column, team: Column, start: Column, end: Column) -> Column:
    """Q1_TEAM_12.5_60.0"""
    return F.concat_ws("_", F.concat(F.lit("Q"), quarter.cast("string")), team, start.cast("double").cast("string"), end.cast("double").cast("string"))


def normalised(team: Column, aliases: dict[str, str]) -> Column:
    """The team's name behind an alias."""
    out = team
    for short, name in aliases.items():
        out = F.when(team == short, F.lit(name)).otherwise(out)
    return out


def other_team(team: Column, a: str, b: str) -> Column:
    """b for a; a for every other value."""
    return F.when(team == a, F.lit(b)).otherwise(F.lit(a))
