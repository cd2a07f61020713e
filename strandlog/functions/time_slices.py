"""Time slices by expressions such as "15m", "8 am", "fri", "weekdays before 12pm" or "every 2 hours after noon".

An expression is compiled to one column: the start of the slice that a time falls in, or null where it lies outside.

    15m, 1h30m, every 2 hours      slices of this length, counted from 1970; with `after` or `from`, from that time of day
    8 am, 08:30, noon, midnight    the hour or, with minutes, the minute at this time of every day
    before T, after T              each day up to T, or from T on
    T to T, from T to T            from one time of day to another; over midnight if the second is earlier, then by the
                                   evening's day
    fri, mon tue, weekdays         these days; weekend; several days are one set
    jan, june july                 these months; alone, the slice is the month
    today, yesterday               these days, counted from `now`

Parts together narrow the slice: "mon before 9am" has Mondays up to nine. Without times of day the slice is the day.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.functions.text import c

SECOND, DAY = 1_000_000, 86_400_000_000
UNITS = {"us": 1, "ms": 1_000, "s": SECOND, "m": 60 * SECOND, "h": 3_600 * SECOND, "d": DAY, "w": 7 * DAY}
#: Longer names of the units; a name may end in s.
LONG_UNITS = {"second": "s", "sec": "s", "minute": "m", "min": "m", "hour": "h", "hr": "h", "day": "d", "week": "w"}
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SETS = {"weekday": range(5), "weekend": range(5, 7)}

_TOKEN = re.compile(
    r"\s*(?:(?P<clock>\d{1,2}(?::\d{2}){1,2}\s*(?:[ap]m)?|\d{1,2}\s*[ap]m\b|noon\b|midnight\b)|(?P<length>\d+(?:\.\d+)?\s*[a-z]+)|(?P<word>[a-z]+)|(?P<sign>,))", re.IGNORECASE
)


@dataclass
class _Slice:
    length: int = 0
    begin: int | None = None
    end: int | None = None
    days: set[int] = field(default_factory=set)
    months: set[int] = field(default_factory=set)
    back: set[int] = field(default_factory=set)  # days before now


def _clock(text: str) -> tuple[int, int]:
    """Microseconds from midnight, and how long the time lasts as it is given."""
    text = text.lower().replace(" ", "")
    if text in ("noon", "midnight"):
        return (DAY // 2 if text == "noon" else 0), UNITS["h"]
    half = text[-2:] if text.endswith("m") else ""
    parts = [int(x) for x in text.removesuffix(half).split(":")] if half else [int(x) for x in text.split(":")]
    hour = parts[0] % 12 + (12 if half == "pm" else 0) if half else parts[0]
    if hour > 23 or any(x > 59 for x in parts[1:]) or half and not 1 <= parts[0] <= 12:
        raise ValueError(f"no time of day: {text}")
    at = hour * UNITS["h"] + sum(x * u for x, u in zip(parts[1:], (UNITS["m"], SECOND)))
    return at, (UNITS["h"], UNITS["m"], SECOND)[len(parts) - 1]


def _length(text: str) -> int:
    number, unit = re.fullmatch(r"([\d.]+)\s*([a-z]+)", text.lower()).groups()
    short = unit if unit in UNITS else LONG_UNITS.get(unit.removesuffix("s"), "")
    if not short:
        raise ValueError(f"no unit of time: {unit}")
    return round(float(number) * UNITS[short])


def parse(text: str) -> _Slice:
    out, tokens, at = _Slice(), [], 0
    text = re.sub(r"(\d)([a-z]+)(?=\d)", r"\1\2 ", text.strip())  # 1h30m
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't be read as a time slice: {text!r}, from {text[at:]!r} on")
        tokens.append((m.lastgroup, m[m.lastgroup].lower()))
        at = m.end()
    if not tokens:
        raise ValueError("an empty time slice")
    i = 0

    def clock() -> tuple[int, int]:
        nonlocal i
        i += 1
        if i >= len(tokens) or tokens[i][0] != "clock":
            raise ValueError(f"a time of day is missing in {text!r}")
        return _clock(tokens[i][1])

    while i < len(tokens):
        kind, word = tokens[i]
        short = word[:3]
        if kind == "length":
            out.length += _length(word)
        elif kind == "clock":
            out.begin, lasts = _clock(word)
            out.end = out.begin + lasts
        elif word == "before":
            out.begin, out.end = out.begin or 0, clock()[0]
        elif word in ("after", "from"):
            out.begin = clock()[0]
            out.end = out.end or DAY
        elif word in ("to", "until") and out.begin is not None:
            out.end = clock()[0]
        elif word.removesuffix("s") in SETS:
            out.days |= set(SETS[word.removesuffix("s")])
        elif short in DAYS and re.fullmatch(r"(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:days?)?", word):
            out.days.add(DAYS.index(short))
        elif short in MONTHS and re.fullmatch(r"[a-z]{3}|january|february|march|april|june|july|august|sept(?:ember)?|october|november|december", word):
            out.months.add(MONTHS.index(short))
        elif word in ("today", "yesterday"):
            out.back.add(("today", "yesterday").index(word))
        elif word not in ("every", "and", "on", "in", "at", "the", "of", ","):
            raise ValueError(f"unknown in a time slice: {word!r}")
        i += 1
    return out


def time_slice(t: Column | str, text: str, now: Column | None = None) -> Column:
    """The start of the slice of the expression that t falls in; null outside of it and for a null t."""
    s = parse(text)
    t = c(t).cast("timestamp")
    micros = F.unix_micros(t)
    inside = F.pmod(micros, F.lit(DAY))
    day = micros - inside
    fits = t.isNotNull()
    start = day
    if s.begin is not None or s.end is not None:
        begin, end = s.begin or 0, DAY if s.end is None else s.end
        if begin < end:
            fits = fits & (inside >= begin) & (inside < end)
        else:  # over midnight: the hours after it belong to the day before
            fits = fits & ((inside >= begin) | (inside < end))
            day = F.when(inside < end, day - DAY).otherwise(day)
        start = day + begin
    elif s.months and not (s.days or s.back or s.length):
        start = F.unix_micros(F.date_trunc("month", t))
    if s.length:
        base = start if s.begin is not None else F.lit(0)
        start = micros - F.pmod(micros - base, F.lit(s.length))
    if s.days:
        of_day = F.weekday(F.timestamp_micros(day))
        fits = fits & of_day.isin(*sorted(s.days))
    if s.months:
        fits = fits & (F.month(F.timestamp_micros(day)) - 1).isin(*sorted(s.months))
    if s.back:
        today = F.unix_micros(F.date_trunc("day", now if now is not None else F.current_timestamp()))
        fits = fits & ((today - day) / DAY).isin(*sorted(s.back))
    return F.when(fits, F.timestamp_micros(start))
