"""Versioned zone transition tables, read from the public tz database and searched with numpy.

The driver reads the compiled zones once (zone_bytes) and ships them, so that every executor uses one version.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
import struct
import zoneinfo
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np

LAST_YEAR = 2100


def zone_bytes() -> tuple[str, dict[str, bytes]]:
    """(version, zone name -> compiled zone). Under 2 MB for all zones there are."""
    try:
        import tzdata

        version, root = tzdata.IANA_VERSION, resources.files("tzdata.zoneinfo")
    except ImportError:
        root = next(p for p in map(Path, zoneinfo.TZPATH) if p.is_dir())
        version = next((p.read_text().split("\n")[0].removeprefix("# version ").strip() for p in (root / "tzdata.zi", root / "+VERSION") if p.is_file()), "system")
    found = {}
    for name in zoneinfo.available_timezones():
        p = root
        for part in name.split("/"):
            p = p / part
        if p.is_file():
            found[name] = p.read_bytes()
    return version, found


_RULE = re.compile(r"(<[^>]+>|[A-Za-z]+)(-?\d+(?::\d+){0,2})(?:(<[^>]+>|[A-Za-z]+)(-?\d+(?::\d+){0,2})?,M(\d+)\.(\d)\.(\d)(?:/(-?\d+(?::\d+){0,2}))?,M(\d+)\.(\d)\.(\d)(?:/(-?\d+(?::\d+){0,2}))?)?$")


def _hms(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [int(x) for x in text.lstrip("-").split(":")]
    return sign * sum(v * m for v, m in zip(parts, (3600, 60, 1)))


def _nth_weekday(year: int, month: int, week: int, weekday: int) -> int:
    """Seconds since 1970 of that day's midnight; week 5 is the last one."""
    first = (calendar.weekday(year, month, 1) + 1) % 7
    day = 1 + (weekday - first) % 7 + 7 * (week - 1)
    if day > calendar.monthrange(year, month)[1]:
        day -= 7
    return calendar.timegm((year, month, day, 0, 0, 0))


class ZoneTable:
    """utc[i]: second at which offset[i + 1] begins; offset[0] holds before. Abbreviations map to offsets."""

    def __init__(self, raw: bytes):
        assert raw[:4] == b"TZif"
        head = struct.unpack(">6l", raw[20:44])
        at = 44 + head[3] * 4 + head[3] + head[4] * 6 + head[5] + head[2] * 8 + head[1] + head[0]
        isut, isstd, leap, times, types, chars = struct.unpack(">6l", raw[at + 20 : at + 44])
        at += 44
        utc = list(struct.unpack(f">{times}q", raw[at : at + times * 8]))
        at += times * 8
        kind = list(raw[at : at + times])
        at += times
        infos = [struct.unpack(">lBB", raw[at + i * 6 : at + i * 6 + 6]) for i in range(types)]
        at += types * 6
        names = raw[at : at + chars]
        at += chars + leap * 12 + isstd + isut
        footer = raw[at:].strip(b"\n").decode()
        offsets = [infos[0][0]] + [infos[k][0] for k in kind]
        self.abbreviations: dict[str, int] = {}
        for off, _, i in infos:
            self.abbreviations[names[i : names.index(b"\0", i)].decode()] = off
        if (m := _RULE.match(footer)) and m[3]:
            std, dst = -_hms(m[2]), (-_hms(m[4]) if m[4] else -_hms(m[2]) + 3600)
            self.abbreviations |= {m[1].strip("<>"): std, m[3].strip("<>"): dst}
            first = dt.datetime.fromtimestamp(utc[-1], dt.UTC).year if utc else 1970
            for year in range(first, LAST_YEAR + 1):
                begin = _nth_weekday(year, int(m[5]), int(m[6]), int(m[7])) + _hms(m[8] or "2") - std
                end = _nth_weekday(year, int(m[9]), int(m[10]), int(m[11])) + _hms(m[12] or "2") - dst
                for t, off in sorted(((begin, dst), (end, std))):
                    if not utc or t > utc[-1]:
                        utc.append(t)
                        offsets.append(off)
        self.utc = np.array(utc, dtype=np.int64)
        self.offset = np.array(offsets, dtype=np.int64)
        # a local time seen twice is the first one, a skipped one moves forward: both keep the offset from before
        self.local = self.utc + np.maximum(self.offset[:-1], self.offset[1:]) if len(utc) else np.zeros(0, np.int64)

    def offset_of_local(self, seconds: np.ndarray) -> np.ndarray:
        return self.offset[np.searchsorted(self.local, seconds, side="right")]


class ZoneTables:
    """Zone tables by name, decoded when first asked for."""

    def __init__(self, zones: dict[str, bytes]):
        self.zones = zones
        self.by_lower = {k.lower(): k for k in zones}
        self.get = lru_cache(maxsize=None)(self._get)

    def _get(self, name: str) -> ZoneTable | None:
        real = self.by_lower.get((name or "").strip().lower())
        return ZoneTable(self.zones[real]) if real else None
