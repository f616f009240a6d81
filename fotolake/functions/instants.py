"""Every instant a timestamp text can mean, under declared conventions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Conventions that narrow the readings: dotted dates start with the day, slashed dates ending in the year with the month.
DOTTED_DAY_FIRST, SLASHED_MONTH_FIRST = "dotted_day_first", "slashed_month_first"
STATED = frozenset({DOTTED_DAY_FIRST, SLASHED_MONTH_FIRST})

_CLOCK = r"(?:(?:[Tt]|\s+)(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?(?:\s*(?P<ap>[AaPp][Mm]))?)?"
_OFF = r"\s*(?P<off>[Zz]|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)?(?:\[[A-Za-z0-9_+\-/]+\])?"
_DAY_NAME = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
_NUMERIC = re.compile(r"(?P<a>[0-9]{1,4})(?P<sep>[-:./])(?P<b>[0-9]{1,2})(?P=sep)(?P<c>[0-9]{1,4})" + _CLOCK + _OFF)
_COMPACT = re.compile(r"(?P<y>[0-9]{4})(?P<mo>[0-9]{2})(?P<d>[0-9]{2})[Tt](?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?:(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]+))?)?" + _OFF)
_DAY_MONTH = re.compile(_DAY_NAME + r"(?P<d>[0-9]{1,2})\s+(?P<mon>[a-z]+)\.?,?\s+(?P<y>[0-9]{4})" + _CLOCK + _OFF, re.IGNORECASE)
_MONTH_DAY = re.compile(_DAY_NAME + r"(?P<mon>[a-z]+)\.?\s+(?P<d>[0-9]{1,2}),?\s+(?P<y>[0-9]{4})" + _CLOCK + _OFF, re.IGNORECASE)
_NUMBER = re.compile(r"([0-9]{10})(?:\.([0-9]+))?|([0-9]{13})|([0-9]{16})")
_OFFSET = re.compile(r"([+-])([0-9]{2})(?::?([0-9]{2}))?")
_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)

#: Names of the formats, which the path search compares.
FORMATS = ("epoch_s", "epoch_ms", "epoch_us", "compact", "iso", "exif", "slashed_ymd", "slashed_mdy", "slashed_dmy", "dotted_dmy", "dotted_mdy", "day_month", "month_day")
_NUMBER_OF = {name: k for k, name in enumerate(FORMATS)}


@lru_cache(maxsize=65_536)
def _offset_s(text: str) -> int | None:
    """Seconds east of UTC of an offset or UTC mark, None if it is neither."""
    if text.upper() in ("Z", "UTC", "GMT"):
        return 0
    m = _OFFSET.fullmatch(text)
    if not m or int(m[2]) > 18 or int(m[3] or 0) > 59:
        return None
    return (int(m[2]) * 3600 + int(m[3] or 0) * 60) * (-1 if m[1] == "-" else 1)


@lru_cache(maxsize=65_536)
def _zone(name: str):
    """A zone by IANA name or fixed offset; None for anything else."""
    fixed = _offset_s(name)
    if fixed is not None:
        return fixed
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any name that is no zone
        return None


def _instants(wall: datetime, off: str | None, zone_name: str | None) -> list[int]:
    """Microseconds since 1970 UTC for a wall time: none in a gap or without zone, two where the zone has it twice."""
    local = (wall - _EPOCH) // _US
    if off:
        fixed = _offset_s(off)
        return [] if fixed is None else [local - fixed * 1_000_000]
    zone = _zone(zone_name) if zone_name else None
    if zone is None:
        return []
    if isinstance(zone, int):
        return [local - zone * 1_000_000]
    out: list[int] = []
    try:
        # both folds agree except where clocks change, where the offsets before and after differ
        early = zone.utcoffset(wall)
        if early == zone.utcoffset(wall.replace(fold=1)):
            return [local - early // _US]
        for fold in (0, 1):
            shift = wall.replace(tzinfo=zone, fold=fold).utcoffset()
            utc = wall - shift
            back = utc.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)
            us = local - shift // _US
            if back == wall and us not in out:
                out.append(us)
    except (OverflowError, ValueError):
        return []
    return out


def _wall(y: str, mo: int, d: str, g: dict) -> datetime | None:
    try:
        h, frac = int(g.get("h") or 0), (g.get("f") or "")[:6].ljust(6, "0")
        if ap := g.get("ap"):
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if ap[0] in "pP" else 0)
        return datetime(int(y), mo, int(d), h, int(g.get("mi") or 0), int(g.get("s") or 0), int(frac))
    except ValueError:
        return None


def _month(name: str) -> int | None:
    n = name.lower()
    if n == "sept":
        return 9
    return next((i + 1 for i, m in enumerate(MONTHS) if n == m or n == m[:3]), None)


def _dates(text: str, conventions: frozenset) -> list[tuple[str, str, int, str, dict]]:
    """(format, year, month, day, clock parts) for every way to read the text's date."""
    if m := _NUMERIC.fullmatch(text):
        g, a, b, c = m.groupdict(), m["a"], m["b"], m["c"]
        if len(a) == 4 and len(c) <= 2:
            name = {"-": "iso", ":": "exif", "/": "slashed_ymd"}.get(m["sep"])
            return [(name, a, int(b), c, g)] if name else []
        if len(a) <= 2 and len(c) == 4:
            if m["sep"] == ".":
                both = [("dotted_dmy", c, int(b), a, g)]
                return both if DOTTED_DAY_FIRST in conventions else [*both, ("dotted_mdy", c, int(a), b, g)]
            if m["sep"] == "/":
                both = [("slashed_mdy", c, int(a), b, g)]
                return both if SLASHED_MONTH_FIRST in conventions else [*both, ("slashed_dmy", c, int(b), a, g)]
        return []
    if m := _COMPACT.fullmatch(text):
        return [("compact", m["y"], int(m["mo"]), m["d"], m.groupdict())]
    for name, pattern in (("day_month", _DAY_MONTH), ("month_day", _MONTH_DAY)):
        if m := pattern.fullmatch(text):
            month = _month(m["mon"])
            return [(name, m["y"], month, m["d"], m.groupdict())] if month else []
    return []


def interpretations(text: str | None, zone_name: str | None, conventions: frozenset = STATED) -> list[tuple[int, int]]:
    """All (format number, microseconds since 1970 UTC) a text can mean; empty for junk, nulls and impossible dates.

    Outer blanks don't matter. Bare numbers count from 1970 in seconds (10 digits, perhaps with
    decimals), milliseconds (13) or microseconds (16). Digits beyond microseconds are cut off, however many; texts may have any length. Two
    formats may give one instant (05/05/2021): both are listed, as the format matters to the search.
    """
    if text is None or not (t := text.strip()):
        return []
    if m := _NUMBER.fullmatch(t):
        if m[1]:
            return [(0, int(m[1]) * 1_000_000 + int((m[2] or "")[:6].ljust(6, "0")))]
        return [(1, int(m[3]) * 1_000)] if m[3] else [(2, int(m[4]))]
    zone = zone_name.strip() if zone_name else None
    out = []
    for name, y, mo, d, g in _dates(t, conventions):
        wall = _wall(y, mo, d, g)
        if wall is not None:
            k = _NUMBER_OF[name]
            out += [(k, us) for us in _instants(wall, g["off"], zone)]
    return out
