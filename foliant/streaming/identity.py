"""Identity of arriving files as a stream: moves and hard links told apart once the watermark has passed.

State is kept by (device, inode): known paths, when paths vanished, and arrivals that wait. An arrival is decided when the watermark
is ``wait`` seconds beyond it, so a deletion that is reported later than the arrival at the new place still counts, and the order in which events
come within the watermark doesn't matter. What vanished is forgotten ``wait`` seconds later: an inode without paths has no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: event: KNOWN (an active file of the inventory), ARRIVED, VANISHED.
SIGHTINGS = "event string, path string, file_id long, filesystem_device long, inode long, size_bytes long, modified_at_fs long, hash_content string, ts long"
DECISIONS = "path string, ts long, candidates long, event string, level string, score int, candidate_id long"
VALUES = "file_id long, size_bytes long, modified_at_fs long, hash_content string, ts long"


def decide(arrival: tuple, candidates: list[tuple[tuple, bool]]) -> tuple | None:
    """(candidates, event, level, score, candidate_id) for an arrival's values by those of its candidates and whether they are missing.

    As in the batch form ``identity_match``: any candidate still there is a hard link, several missing ones are ambiguous, one is scored.
    """
    if not candidates:
        return None
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    here = [c[0] for c, missing in candidates if not missing]
    gone = [c for c, missing in candidates if missing]
    if here:
        return len(candidates), "HARDLINK_DETECTED", "ambiguous", None, least(here)
    if len(gone) > 1:
        return len(candidates), "IDENTITY_AMBIGUOUS", "ambiguous", None, least(c[0] for c in gone)
    same = [a is not None and a == b for a, b in zip(arrival[1:4], gone[0][1:4], strict=True)]
    score = 50 + 10 * same[0] + 10 * same[1] + 30 * same[2]
    return 1, "IDENTITY_MATCHED" if score >= 90 else "IDENTITY_REJECTED", "high" if score >= 90 else "medium" if score >= 65 else "low", score, gone[0][0]


class IdentityMatcher(StatefulProcessor):
    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "path string", VALUES)
        self.gone = handle.getMapState("gone", "path string", "ts long")
        self.waiting = handle.getMapState("waiting", "ts long, path string", VALUES)

    @staticmethod
    def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
        for r in frame.astype(object).where(frame.notna(), None).itertuples():
            ts = int(r.ts or 0)
            yield r, ts, tuple(None if x is None else int(x) for x in (r.file_id, r.size_bytes, r.modified_at_fs)) + (r.hash_content, ts)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r, _, values in self._rows(initialState):
            self.known.updateValue((r.path,), values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r, ts, values in self._rows(frame):
                if r.event == "KNOWN":
                    self.known.updateValue((r.path,), values)
                elif r.event == "ARRIVED":
                    self.waiting.updateValue((ts, r.path), values)
                    self.handle.registerTimer((ts + self.wait) * 1000)
                elif not self.gone.containsKey((r.path,)) or self.gone.getValue((r.path,))[0] < ts:
                    self.gone.updateValue((r.path,), (ts,))
                    self.handle.registerTimer((ts + self.wait) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        gone = {k[0]: v[0] for k, v in self.gone.iterator()}
        due = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] + self.wait <= now)
        out = []
        for (ts, path), values in due:
            self.waiting.removeKey((ts, path))
            # Paths that vanished so long before the arrival that their timer has passed it are no candidates any more.
            others = {p: v for p, v in known.items() if p != path and not (p in gone and gone[p] + self.wait < ts)}
            missing = {p: p in gone and gone[p] <= ts + self.wait and v[4] <= gone[p] for p, v in others.items()}
            old = known.get(path)
            if old is None or path in gone and old[4] <= gone[path] <= ts:
                found = decide(values, [(v, missing[p]) for p, v in sorted(others.items())])
                if found:
                    out.append((path, ts, *found))
                    if found[1] == "IDENTITY_MATCHED":
                        moved = next(p for p, m in missing.items() if m)
                        values = (known[moved][0], *values[1:])
                        self.known.removeKey((moved,))
                        del known[moved]
            elif values[0] is None:
                values = (old[0], *values[1:])
            self.known.updateValue((path,), values)
            known[path] = values
        for path, ts in gone.items():
            if ts + self.wait <= now and not any(k[0] <= ts + self.wait for k, _ in self.waiting.iterator()):
                self.gone.removeKey((path,))
                if path in known and known[path][4] <= ts:
                    self.known.removeKey((path,))
        if out:
            yield pd.DataFrame(out, columns=["path", "ts", "candidates", "event", "level", "score", "candidate_id"]).astype({"score": "Int32", "candidate_id": "Int64"})

    def close(self) -> None:
        pass


def identity_stream(sightings: DataFrame, wait: int, late: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """Decisions on the arrivals of a stream of sightings (see SIGHTINGS), each when the watermark is ``wait`` seconds beyond it.

    known: active files as the stream begins, with the columns of sightings but the event (no stream; read with the first batch only). An arrival becomes a
    known path once it is decided, under the file of its candidate if that matched. Rows without device, inode or path, sightings without
    time, and those more than ``late`` behind the newest are left out.
    """
    whole = "filesystem_device is not null and inode is not null and path is not null"
    stamped = sightings.where(f"{whole} and ts is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    start = known.where(whole).groupBy("filesystem_device", "inode") if known is not None else None
    return stamped.groupBy("filesystem_device", "inode").transformWithStateInPandas(IdentityMatcher(wait), DECISIONS, "Append", "EventTime", initialState=start)
