"""Dwelling in near-linear time: spans around an anchor report, for many paths at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from tidewatch.functions.geo import EARTH_KM

SCAN_ROWS = 50_000


def km_between(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))


class Boxes:
    """Bounding boxes of aligned runs of 1, 2, 4, ... reports, level after level in flat arrays."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray):
        levels = [(lat, lat, lon, lon)]
        while len(levels[-1][0]) > 1:
            south, north, west, east = (np.append(v, v[-1]) if len(v) % 2 else v for v in levels[-1])
            levels.append((np.minimum(south[::2], south[1::2]), np.maximum(north[::2], north[1::2]), np.minimum(west[::2], west[1::2]), np.maximum(east[::2], east[1::2])))
        self.at = np.cumsum([0, *[len(v[0]) for v in levels[:-1]]])
        self.top = len(levels) - 1
        self.south, self.north, self.west, self.east = (np.concatenate([v[k] for v in levels]) for k in range(4))

    def most_km(self, lat: np.ndarray, lon: np.ndarray, level: np.ndarray, first: np.ndarray) -> np.ndarray:
        """No report of the run of 2**level from first is farther than this: a path along a meridian and a parallel bounds the distance."""
        k = self.at[level] + (first >> level)
        south, north = np.minimum(self.south[k], lat), np.maximum(self.north[k], lat)
        up = np.maximum(np.abs(lat - self.south[k]), np.abs(self.north[k] - lat))
        along = np.maximum(np.abs(lon - self.west[k]), np.abs(self.east[k] - lon))
        nearest = np.where((south <= 0) & (north >= 0), 0.0, np.minimum(np.abs(south), np.abs(north)))
        return EARTH_KM * np.hypot(np.radians(up), np.cos(np.radians(nearest)) * np.radians(along)) * (1 + 1e-9)


def exits(lat: np.ndarray, lon: np.ndarray, end: np.ndarray, radius_km: float) -> np.ndarray:
    """For each report the first later one out of its reach, or the end of its path.

    Runs whose box lies in reach are passed over whole, in doubling steps; single reports are measured.
    """
    boxes, n = Boxes(lat, lon), len(lat)
    out, at, level = end.copy(), np.arange(1, n + 1), np.zeros(n, np.int64)
    active = np.flatnonzero(at < end)
    while len(active):
        p, k = at[active], level[active]
        single = k == 0
        near = np.empty(len(active), bool)
        i, j = active[single], p[single]
        near[single] = km_between(lat[i], lon[i], lat[j], lon[j]) <= radius_km
        i = active[~single]
        near[~single] = boxes.most_km(lat[i], lon[i], k[~single], p[~single]) <= radius_km
        gone = single & ~near
        out[active[gone]] = p[gone]
        p = np.where(near, p + (1 << k), p)
        k = np.where(near, np.where(((p >> k) & 1 == 0) & (k < boxes.top), k + 1, k), k - 1)
        at[active], level[active] = p, k
        active = active[~gone & (p < end[active])]
    return out


def dwell_spans(us, lat, lon, sog, port: Callable[[float, float], bool], radius_km: float = 2, minutes: float = 60, slow: tuple[float, float] = (0.5, 2.0), end: np.ndarray | None = None) -> list[tuple]:
    """(first, last, lat, lon, mean speed, in port) of spans around an anchor report, found greedily.

    port tells whether a centre lies in a port; a port's span is passed over whole, and
    returned marked; a span that fails advances the anchor by one report. end holds the end of each report's
    path where several paths follow each other.
    """
    n = len(us)
    if not n:
        return []
    leave = exits(lat, lon, np.full(n, n) if end is None else end, radius_km)
    known = ~np.isnan(sog)
    total, count = (np.concatenate([[0.0], np.cumsum(v)]) for v in (np.where(known, sog, 0.0), known))
    i = np.arange(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.round(np.nan_to_num((total[leave] - total[i]) / (count[leave] - count[i])), 9)
    hit = (leave - i >= 2) & (us[leave - 1] - us >= minutes * 60e6) & (mean >= slow[0]) & (mean <= slow[1])
    following = np.minimum.accumulate(np.where(hit, i, n)[::-1])[::-1]  # the first report from here on that anchors a span
    out, k = [], int(following[0])
    while k < n:
        j = int(leave[k])
        own = sog[k:j][known[k:j]]
        centre = round(float(lat[k:j].mean()), 11), round(float(lon[k:j].mean()), 11)
        out.append((k, j - 1, *centre, round(float(own.mean()), 9) if len(own) else 0.0, port(*centre)))
        k = int(following[j]) if j < n else n
    return out


def path_ends(keys: list[np.ndarray]) -> np.ndarray:
    """For each row the end of its run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.append(np.flatnonzero(new), n)
    return starts[np.searchsorted(starts, np.arange(n), side="right")]


def whole_paths(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = SCAN_ROWS) -> Iterator[pd.DataFrame]:
    """Sorted batches put together to frames of some rows that end where a path ends."""
    parts: list[pd.DataFrame] = []
    held = 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append(batch)
        held += len(batch)
        if held < rows:
            continue
        changed = np.zeros(len(batch), bool)
        before = parts[-2].iloc[-1] if len(parts) > 1 else None
        for k in keys:
            v = batch[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
            changed[0] |= before is not None and v[0] != before[k]
        last = np.flatnonzero(changed)
        if len(last):
            at = int(last[-1])
            yield pd.concat([*parts[:-1], batch.iloc[:at]], ignore_index=True)
            parts, held = [batch.iloc[at:]], len(batch) - at
    if parts:
        yield pd.concat(parts, ignore_index=True)
