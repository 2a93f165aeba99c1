"""Small ledgers that the position fixtures lack: outages, collector runs and external events."""

from __future__ import annotations

_T0 = 1_704_067_200_000_000
_H = 3_600_000_000

#: (key, opened_us, closed_us)
OUTAGES = [("sg", _T0 + 5 * _H, _T0 + 5 * _H + _H // 2), ("sg", _T0 + 5 * _H + _H // 4, _T0 + 6 * _H), ("sg", _T0 + 17 * _H, _T0 + 17 * _H + _H // 3)]
#: (key, started_us, stopped_us, last_message_us)
RUNS = [("sg", _T0 - _H, _T0 + 10 * _H, _T0 + 10 * _H), ("sg", _T0 + 10 * _H, _T0 + 20 * _H, _T0 + 20 * _H), ("sg", _T0 + 22 * _H, None, _T0 + 28 * _H), ("sg", _T0 + 29 * _H, None, None)]
#: (event_id, kind, mmsi, ts_us, lat, lon)
EVENTS = [
    ("e1", "gap", "563000003", _T0 + 8 * _H, 1.2, 103.7), ("e2", "spoof", "563000011", _T0 + 12 * _H, 1.3, 103.8), ("e3", "gap", None, _T0 + 15 * _H, 1.15, 103.75),
    ("e4", "loiter", "563000099", _T0 + 3 * _H, 1.25, 103.9), ("e5", "spoof", None, _T0 + 20 * _H, 3.2, 103.7), ("e6", "gap", "999000000", _T0 + 9 * _H, 40.0, 10.0),
]
#: (event_id, source, source_confidence, event_type, mmsi, counterpart_mmsi, ts_us, lat, lon, retrieved_us): the events as labels
LABELS = [(e[0], f"watch-{e[1]}", "official" if e[0] in ("e3", "e5") else "silver", e[1], e[2], "563000012" if e[0] == "e4" else None, *e[3:], _T0 + 30 * _H + k * _H) for k, e in enumerate(EVENTS)]
#: vessels whose silence is known to be harmless, as truth (kind, mmsi)
TRAPS = [("trap", f"56300{k:04d}") for k in range(0, 40, 3)]
#: the reason of each outage, and one that is still open
REASONS = [(*OUTAGES[0], "websocket timeout"), (*OUTAGES[1], "database locked"), (*OUTAGES[2], "collector offline between runs"), ("sg", _T0 + 29 * _H, None, "connection reset")]
#: (metric, value) of several seeds
SEEDS = [("auc", 0.9625), ("auc", 0.95), ("auc", float("nan")), ("loss", 0.1), ("loss", 0.3)]
