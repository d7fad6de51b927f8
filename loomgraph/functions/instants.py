"""Texts that denote instants, in mixed formats, to microseconds since 1970 in UTC.

A text is reduced to its shape mask: every digit becomes 9, every letter A, the rest stays. All texts of
one mask have their fields at the same places, so a mask is tokenised and given its parser once, and the
fields of all its rows are read together as columns of code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd

from loomgraph.functions.timezones import local_to_utc

# Month names and their short forms in the languages of the sources.
MONTHS = {
    1: "january jan januar jän jänner enero ene",
    2: "february feb februar febrero",
    3: "march mar märz mär marzo maerz mrz",
    4: "april apr abril abr",
    5: "may mai mayo",
    6: "june jun juni junio",
    7: "july jul juli julio",
    8: "august aug agosto ago",
    9: "september sep sept septiembre set",
    10: "october oct oktober okt octubre",
    11: "november nov noviembre",
    12: "december dec dezember dez diciembre dic",
}
# Weekday names, which are read past.
WEEKDAYS = (
    "mon tue wed thu fri sat sun tues thur thurs monday tuesday wednesday thursday friday saturday sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag mo di mi do fr sa so "
    "lunes martes miércoles jueves viernes sábado domingo"
)
# Zone abbreviations in minutes east of Greenwich.
ABBREVIATIONS = {
    "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180,
    "msk": 180, "ist": 330, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300,
    "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540,
    "akdt": -480, "hst": -600,
}

_WORDS: dict[str, tuple[str, int]] = {}
for _number, _names in MONTHS.items():
    _WORDS |= {w: ("M", _number) for w in _names.split()}
_WORDS |= {w: ("W", 0) for w in WEEKDAYS.split() if w not in _WORDS}
_WORDS |= {w: ("A", minutes) for w, minutes in ABBREVIATIONS.items()}
_WORDS |= {w: ("Z", 0) for w in ("z", "utc", "gmt")}
_WORDS |= {w: ("P", hours) for w, hours in (("am", 0), ("a.m.", 0), ("a.m", 0), ("pm", 12), ("p.m.", 12), ("p.m", 12))}
_WORDS |= {w: ("O", 0) for w in ("st", "nd", "rd", "th")}
_WORDS |= {w: ("F", 0) for w in ("of", "de", "del")}
_WORDS |= {"t": ("T", 0), "uhr": ("U", 0), "at": ("S", 0), "um": ("S", 0)}

_TOKEN = re.compile(r"A\.A\.?(?![A9])|A+(?:/A+(?:[_-]A+)*)+|A+|9+|.", re.S)
_TIME = r"(?P<h>[12]):(?P<mi>2)(?::(?P<s>2)(?:[.,](?P<f>[1-9]))?)?(?: ?(?P<p>P))?(?: U)?"
_ZONE = (
    r"(?: ?[ZA]?(?P<sign>[+-])(?:(?P<o4>4)|(?P<oh>[12])(?::(?P<om>2))?)(?: ?\[[NZA]\]| ?\([ZAN]\))?"
    r"| ?\[?\(?(?P<z>[ZAN])\)?\]?)"
)
_DATES = [
    r"(?P<y>4)(?P<sep>[-/.])(?P<m>[12])(?P=sep)(?P<d>[12])",
    r"(?P<d>[12])\.(?P<m>[12])\.(?P<y>4)",
    r"(?P<a>[12])(?P<sep>[-/])(?P<b>[12])(?P=sep)(?P<y>4)",
    r"(?P<d>[12])O?\.?(?: F)?[ -](?P<M>M)\.?(?: F)?,?[ -](?P<y>4)",
    r"(?P<M>M)\.? (?P<d>[12])O?,? (?P<y>4)",
]
_FORMS = [
    re.compile(p)
    for date in _DATES
    for p in (rf"(?:W[,.]? )?{date}(?:(?:T| T |,? (?:S )?){_TIME}{_ZONE}?)?", rf"(?:W[,.]? )?{_TIME}{_ZONE}?,? {date}")
] + [
    re.compile(p)
    for p in (
        rf"(?:W[,.]? )?(?P<M>M) +(?P<d>[12]) {_TIME}{_ZONE}? (?P<y>4)",
        rf"(?P<ymd>8)T(?P<hms>[46])(?:[.,](?P<f>[1-9]))?{_ZONE}?",
        r"(?P<y>4)",
        r"(?P<y>4)[-/](?P<m>2)",
        r"(?P<m>2)/(?P<y>4)",
        r"(?P<M>M)\.?(?: F)?,? (?P<y>4)",
    )
]
MOST_TOKENS = 64  # no form has so many: a text of more denotes no instant
_FROM, _TO = 1_262_304_000, 1_893_456_000  # 2010 and 2030, the range of bare numbers


class _Mask(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "9" if c.isdecimal() else "A" if c.isalpha() else c
        return out


_MASK = _Mask()


@lru_cache(maxsize=65536)
def _tokens(mask: str) -> tuple[tuple[int, int, str], ...]:
    return tuple((m.start(), m.end(), m.group()) for m in _TOKEN.finditer(mask))


def _too_long(mask: str) -> bool:
    return len(mask) > MOST_TOKENS and next(islice(_TOKEN.finditer(mask), MOST_TOKENS, None), None) is not None


@lru_cache(maxsize=65536)
def _parser(symbols: str) -> dict[str, int] | None:
    """Field name to token number, or None where the shape denotes no instant."""
    for form in _FORMS:
        if m := form.fullmatch(symbols):
            return {k: m.start(k) for k, v in m.groupdict().items() if v is not None and k != "sep"}
    return None


def _word(text: str) -> tuple[str, int | str]:
    low = text.lower()
    return _WORDS.get(low) or (("N", text) if "/" in text else ("?", 0))


def _number(points: np.ndarray, start: int, end: int) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    for i in range(start, end):
        out = out * 10 + (points[:, i].astype(np.int64) - 48)
    return out


def _bare(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of more than four digits: seconds, milliseconds or microseconds, by range."""
    micros, ok = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        whole, _, part = text.partition(".")
        if len(whole) > 18:
            continue
        for unit in (1_000_000, 1_000, 1):
            scaled = int(whole) * unit
            if _FROM * 1_000_000 <= scaled < _TO * 1_000_000:
                micros[i], ok[i] = scaled + int(unit * int(part or 0) // 10 ** len(part)), True
                break
    return micros, ok


def _resolve(points, tokens, fields, words, zones, orders):
    """(micros, ok) of rows of one mask whose words have the same classes."""
    n = len(points)

    def value(name: str, default: int = 0) -> np.ndarray:
        if name not in fields:
            return np.full(n, default, np.int64)
        start, end, _ = tokens[fields[name]]
        return _number(points, start, end)

    if "ymd" in fields:
        ymd, (start, end, _) = value("ymd"), tokens[fields["hms"]]
        year, month, day = ymd // 10000, ymd // 100 % 100, ymd % 100
        clock = _number(points, start, end) * (1 if end - start == 6 else 100)
        hour, minute, second = clock // 10000, clock // 100 % 100, clock % 100
    else:
        year, month, day = value("y"), value("m", 1), value("d", 1)
        hour, minute, second = value("h"), value("mi"), value("s")
        if "M" in fields:
            month = words[fields["M"]].astype(np.int64)
        if "a" in fields:
            a, b = value("a"), value("b")
            day_first = np.where(a > 12, True, np.where(b > 12, False, orders != "MDY"))
            day, month = np.where(day_first, a, b), np.where(day_first, b, a)
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    if "p" in fields:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + words[fields["p"]].astype(np.int64)
    first = ((year - 1970) * 12 + np.where(ok, month, 1) - 1).astype("datetime64[M]")
    start_day = first.astype("datetime64[D]").astype(np.int64)
    ok &= day <= (first + 1).astype("datetime64[D]").astype(np.int64) - start_day
    local = (start_day + day - 1) * 86400 + hour * 3600 + minute * 60 + second
    part = np.zeros(n, np.int64)
    if "f" in fields:
        start, end, _ = tokens[fields["f"]]
        end = min(end, start + 6)
        part = _number(points, start, end) * 10 ** (6 - (end - start))
    if "sign" in fields:
        if "o4" in fields:
            o = value("o4")
            away = o // 100 * 60 + o % 100
        else:
            away = value("oh") * 60 + value("om")
        minus = points[:, tokens[fields["sign"]][0]] == ord("-")
        utc = local - np.where(minus, -away, away) * 60
        ok &= away <= 18 * 60
    elif "z" in fields and words[fields["z"]].dtype != object:
        utc = local - words[fields["z"]].astype(np.int64) * 60
    else:
        utc = local.copy()
        names = words[fields["z"]] if "z" in fields else zones
        for number, name in enumerate(uniques := pd.unique(names)):
            rows = names == uniques[number]
            utc[rows], known = local_to_utc(local[rows], name)
            if not known:
                ok[rows] = False
    return utc * 1_000_000 + part, ok


def parse_instants(texts: Sequence, zones: Sequence, orders: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and whether the text denotes an instant.

    zones and orders say how a text is read where it leaves that open; null stands for UTC and DMY.
    Null and blank texts, words such as "soon", impossible dates, unknown zones: no instant.
    """
    n = len(texts)
    micros, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    clean = []
    for text in texts:
        text = "" if text is None else str(text)
        clean.append(" ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split()))
    codes, masks = pd.factorize(pd.Series([t.translate(_MASK) for t in clean], dtype=object))
    zones = np.array(["UTC" if z is None else z for z in zones], dtype=object)
    orders = np.array(["DMY" if o is None else o for o in orders], dtype=object)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(masks) + 1))
    for number, mask in enumerate(masks):
        if "9" not in mask or _too_long(mask):
            continue
        rows = order[bounds[number] : bounds[number + 1]]
        own = [clean[i] for i in rows]
        if re.fullmatch(r"9{5,}(?:\.9+)?", mask):
            micros[rows], ok[rows] = _bare(own)
            continue
        tokens = _tokens(mask)
        points = np.array(own, dtype=f"U{len(mask)}").view(np.uint32).reshape(len(own), len(mask))
        signature, words = np.zeros(len(own), np.int64), {}
        symbols = [str(e - s) if t[0] == "9" and e - s < 10 else "L" if t[0] == "9" else t for s, e, t in tokens]
        seen: list[list[str]] = []
        at: list[int] = []
        for k, (start, end, token) in enumerate(tokens):
            if token[0] != "A":
                continue
            text = np.ascontiguousarray(points[:, start:end]).view(f"U{end - start}").ravel()
            unique, inverse = np.unique(text, return_inverse=True)
            classed = [_word(str(w)) for w in unique]
            kinds = sorted({c for c, _ in classed})
            signature = signature * len(kinds) + np.array([kinds.index(c) for c, _ in classed])[inverse]
            values = [v for _, v in classed]
            words[k] = np.array(values, dtype=object if any(isinstance(v, str) for v in values) else np.int64)[inverse]
            seen.append(kinds)
            at.append(k)
        for one in np.unique(signature) if at else [0]:
            picked = np.flatnonzero(signature == one)
            rest, own_symbols = int(one), list(symbols)
            for k, kinds in zip(reversed(at), reversed(seen), strict=True):
                own_symbols[k] = kinds[rest % len(kinds)]
                rest //= len(kinds)
            fields = _parser("".join(own_symbols))
            if fields is None:
                continue
            own_words = {k: v[picked] for k, v in words.items()}
            if "z" in fields and own_symbols[fields["z"]] != "N":
                own_words[fields["z"]] = own_words[fields["z"]].astype(np.int64)
            at_rows = rows[picked]
            micros[at_rows], ok[at_rows] = _resolve(points[picked], tokens, fields, own_words, zones[at_rows], orders[at_rows])
    return micros, ok
