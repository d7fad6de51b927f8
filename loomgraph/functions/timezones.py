"""Versioned tables of zone transitions, for vectorised conversion of local time."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

_FIRST, _LAST = 1900, 2100
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def table_version() -> str:
    """The release of the zone database that the tables are made from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


def _offset(zone: ZoneInfo, second: int) -> int:
    return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=1024)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(local thresholds, offsets) of a zone in seconds, or None for an unknown name.

    offsets[i] holds for local times from thresholds[i - 1] up to thresholds[i]. A change at instant t
    from offset a to b takes effect at local time t + max(a, b): a time that occurs twice then means
    the first, one that is skipped takes the offset before the change.
    """
    try:
        zone = ZoneInfo(name)
    except Exception:
        return None
    step = 7 * 86400
    at = int(datetime(_FIRST, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(_LAST, 1, 1, tzinfo=timezone.utc).timestamp())
    offsets, thresholds = [_offset(zone, at)], []
    while at < end:
        low, high = at, at + step
        after = _offset(zone, high)
        if after != offsets[-1]:
            while high - low > 1:
                middle = (low + high) // 2
                if _offset(zone, middle) == offsets[-1]:
                    low = middle
                else:
                    high = middle
            after = _offset(zone, high)
            thresholds.append(high + max(offsets[-1], after))
            offsets.append(after)
            at = high
        else:
            at = high
    return np.array(thresholds, dtype=np.int64), np.array(offsets, dtype=np.int64)


def local_to_utc(local_seconds: np.ndarray, name: str) -> tuple[np.ndarray, bool]:
    """UTC seconds of local seconds in one zone; the flag is False where the zone is unknown."""
    table = transitions(name)
    if table is None:
        return local_seconds, False
    thresholds, offsets = table
    return local_seconds - offsets[np.searchsorted(thresholds, local_seconds, side="right")], True
