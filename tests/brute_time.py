"""A slow, independent reading of timestamp texts, by strptime and zoneinfo."""

import datetime as dt
import re
import zoneinfo

UTC = dt.UTC
FIXED = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 1, "CEST": 2, "BST": 1, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "JST": 9, "IST": 5.5, "AEST": 10, "AEDT": 11}
FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y:%m:%d %H:%M:%S", "%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%d.%m.%Y %H:%M:%S",
    "%m/%d/%Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S",
]
EPOCH = dt.datetime(1970, 1, 1, tzinfo=UTC)


def _since(when: dt.datetime) -> int:
    return (when - EPOCH) // dt.timedelta(microseconds=1)


def instant(raw: str | None, zone: str | None) -> int | None:
    if raw is None:
        return None
    s = raw.strip("\0 \t\r\n")
    if re.fullmatch(r"\d{9,}(\.\d+)?", s):
        head, _, tail = s.partition(".")
        scale = 6 if len(head) <= 11 else 3 if len(head) <= 14 else 0
        return int(head + (tail + "000000")[:scale]) if len(head) <= 17 else int(head) // 1000
    tz, off = zone or "UTC", None
    if m := re.search(r"\[([^\]]+)\]$", s):
        tz, s = m[1], s[: m.start()]
    if m := re.search(r"(?<=\d)([+-])(\d\d):?(\d\d)?$", re.sub(r"^\d{4}-\d\d-\d\d$", "x", s)):
        off, s = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0)), s[: -len(m[0])]
    elif m := re.search(r" ([+-])(\d\d):?(\d\d)$", s):
        off, s = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])), s[: m.start()]
    elif m := re.search(r"(?<=\d) ?([Zz]|[A-Z]{3,4})$", s):
        off, s = int(FIXED[m[1].upper()] * 60), s[: m.start()]
    micros = 0
    if m := re.search(r"(?<=\d\d:\d\d)[.,](\d+)$", s):
        micros, s = int((m[1] + "000000")[:6]), s[: m.start()]
    s = s.replace("t", "T") if re.match(r"\d{4}-\d\d-\d\dt", s) else s
    for fmt in FORMATS:
        try:
            wall = dt.datetime.strptime(s, fmt)
            break
        except ValueError:
            pass
    else:
        return None
    wall = wall.replace(microsecond=micros)
    if off is not None:
        return _since(wall.replace(tzinfo=UTC)) - off * 60_000_000
    # fold=0: the first of two; in a gap, the offset before it, which moves the time forward
    return _since(wall.replace(tzinfo=zoneinfo.ZoneInfo(tz)).astimezone(UTC))
