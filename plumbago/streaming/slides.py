"""Selection of stable frames from a stream, with state for each source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Frames in a row that have to agree, and how far apart agreeing signals may be.
STABLE_FRAMES, TOLERANCE = 3, 0.02
OUTPUT = "source string, start_s double, end_s double, signal double"
STATE = "start double, last double, first double, n int, saved double"


class Selector:
    """One source's frames in order: a run of like, sharp frames is a slide once it is long enough and unlike the last.

    A blurry frame ends the run: candidate and count start anew.
    """

    def __init__(self, state: tuple = (-1.0, -1.0, 0.0, 0, float("nan")), stable: int = STABLE_FRAMES, tolerance: float = TOLERANCE):
        self.start, self.last, self.first, self.n, self.saved = state
        self.stable, self.tolerance = stable, tolerance

    def push(self, at: float, signal: float, sharp: bool) -> tuple[float, float, float] | None:
        if not sharp:
            self.n = 0
            return None
        if self.n and abs(signal - self.first) <= self.tolerance:
            self.n += 1
        else:
            self.start, self.first, self.n = at, signal, 1
        self.last = at
        if self.n == self.stable and not abs(self.first - self.saved) <= self.tolerance:
            self.saved = self.first
            return self.start, at, self.first
        return None

    def state(self) -> tuple:
        return self.start, self.last, self.first, self.n, self.saved


def stable_frames(frames: DataFrame, stable: int = STABLE_FRAMES, tolerance: float = TOLERANCE) -> DataFrame:
    """frames(source, at double, signal double, sharp boolean), a stream or a table -> OUTPUT rows, one a slide.

    The state of a source is five numbers. In a stream, the frames of a source have to come in order over micro-batches
    and are sorted within one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        selector = Selector(state.get if state.exists else (-1.0, -1.0, 0.0, 0, float("nan")), stable, tolerance)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        found = [x for r in rows.itertuples() if (x := selector.push(r.at, r.signal, r.sharp))]
        state.update(selector.state())
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["source", "start_s", "end_s", "signal"])

    if frames.isStreaming:
        return frames.groupBy("source").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        selector = Selector(stable=stable, tolerance=tolerance)
        found = [x for r in rows.sort_values("at", kind="stable").itertuples() if (x := selector.push(r.at, r.signal, r.sharp))]
        return pd.DataFrame([(rows["source"].iloc[0], *x) for x in found], columns=["source", "start_s", "end_s", "signal"])

    return frames.groupBy("source").applyInPandas(whole, OUTPUT)
