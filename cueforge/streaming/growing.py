"""Transcripts that grow while their segments arrive, in any order."""

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cueforge.operators.segments import lines

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transcripts(StatefulProcessor):
    """State of a video: its lines by idx, and whether it is closed, which it is when nothing came for `timeout_ms`."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "idx long", "line string")
        self.closed = handle.getValueState("closed", "at long")

    def _told(self, video: Any, closed: bool) -> pd.DataFrame:
        held = sorted((k[0], v[0]) for k, v in self.lines.iterator())
        return pd.DataFrame({"video_id": [video], "raw_text": ["\n".join(x for _, x in held)], "n_segments": [len(held)], "closed": [closed]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.closed.exists():
            for _ in rows:  # late
                pass
            return
        grew = False
        for batch in rows:
            for idx, line in zip(batch["idx"].tolist(), batch["line"].tolist(), strict=True):
                if not self.lines.containsKey((idx,)):
                    self.lines.updateValue((idx,), (line,))
                    grew = True
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        if grew:
            yield self._told(key[0], False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self._told(key[0], True)
        self.closed.update((timerValues.getCurrentProcessingTimeInMs(),))
        self.lines.clear()
        yield last

    def close(self) -> None:
        pass


def growing(segments: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """A stream of segments (video_id, idx, start, end, text) -> (video_id, raw_text, n_segments, closed): the transcript so far of each video that a batch adds to, the latest row of a video being the whole one.

    A segment whose idx a video has already is dropped, the first one stays. After timeout_ms without a segment a video is
    closed: its last transcript is told once more, its lines leave the state, and what comes later for it is dropped.
    """
    segments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kind = segments.schema["video_id"].dataType.simpleString()
    rows = lines(segments).selectExpr("video_id", "cast(idx as long) as idx", "line")
    return rows.groupBy("video_id").transformWithStateInPandas(Transcripts(timeout_ms), f"video_id {kind}, raw_text string, n_segments long, closed boolean", "Update", "ProcessingTime")
