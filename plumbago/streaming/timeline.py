"""The timeline of a source's slides, from frames that come as a stream or a table, with a record at its end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "source string, kind string, number int, start_s double, end_s double, signal double"
STATE = "at double, looked double, slide double, saved double, candidate double, since double, n int, count int, texts array<string>"
_COLUMNS = ["kind", "number", "start_s", "end_s", "signal"]


@dataclass(frozen=True)
class Rules:
    """Seconds between frames that are looked at, and between slides; frames in a row that agree; how far apart frames of
    one slide may be; seconds without a frame that end a timeline."""

    every: float = 0.0
    gap: float = 5.0
    stable: int = 3
    tolerance: float = 0.02
    idle: float = 600.0


@dataclass
class Held:
    """What is kept of a source: times of the last frame, of the last one looked at and of the last slide, that slide's
    signal, the candidate with its time and length, how many slides there were and what was written on them."""

    at: float
    looked: float
    slide: float
    saved: float
    candidate: float = 0.0
    since: float = 0.0
    n: int = 0
    count: int = 0
    texts: list[str] = field(default_factory=list)

    def end(self) -> tuple:
        return "end", self.count, None, self.at, None


def follow(held: Held | None, at: float, signal: float, sharp: bool, text: str | None, rules: Rules) -> tuple[Held, list[tuple]]:
    """One frame more: what is held after it, and the rows that it gives rise to."""
    out = []
    if held is not None and at - held.at > rules.idle:
        out.append(held.end())
        held = None
    if held is None:
        held = Held(at, at, at, signal)
        if sharp:
            out.append(("slide", 0, at, at, signal))
            held.count, held.texts = 1, [text] if text else []
        return held, out
    held.at = at
    if at - held.looked < rules.every:
        return held, out
    held.looked = at
    if at - held.slide < rules.gap:
        return held, out
    if not sharp:
        held.n = 0
    elif abs(signal - held.saved) > rules.tolerance and not (text and text in held.texts):
        if held.n and abs(signal - held.candidate) <= rules.tolerance:
            held.n += 1
        else:
            held.candidate, held.since, held.n = signal, at, 1
        if held.n >= rules.stable:
            out.append(("slide", held.count, held.slide, held.since, held.candidate))
            if text:
                held.texts.append(text)
            held.saved, held.slide, held.n, held.count = held.candidate, held.since, 0, held.count + 1
    return held, out


def _frames(frames: DataFrame) -> DataFrame:
    """Frames with a source and a time; one without a signal is blurred."""
    known = frames.where("source is not null and at is not null")
    at = F.unix_micros("at") / 1e6
    return known.select("source", "at", at.alias("s"), F.coalesce("signal", F.lit(0.0)).cast("double").alias("signal"), (F.coalesce("sharp", F.lit(False)) & F.col("signal").isNotNull()).alias("sharp"), F.col("text").cast("string").alias("text"))


_ORDER = ["s", "signal", "sharp", "text"]


def timeline(frames: DataFrame, rules: Rules = Rules(), late: str = "1 minute") -> DataFrame:
    """frames(source, at timestamp, signal double, sharp boolean, text) -> OUTPUT, kind slide or end.

    The first sharp frame is a slide at once. Later ones need the gap since the last slide, a signal unlike the last
    slide's, a text that no slide had, and as many agreeing frames as the rules say; a slide lasts from the last one to
    its candidate. A pause beyond idle ends the timeline: one row with its last time and how many slides it had, and the
    next frame begins another. Frames without source or time are left out, frames of one time go by signal; a null text
    is like no other.

    In a stream, a source's end comes from a timer once the watermark, `late` behind the newest frame of all, has passed
    idle; its frames must come in order over micro-batches and are sorted within one. What is held for a source is as
    long as its slides. As a table, frames are sorted by source and time and run through their task in batches, so a
    long source takes no memory; every source ends with its last frame.
    """
    rows = _frames(frames)
    if not frames.isStreaming:
        return rows.drop("at").repartition("source").sortWithinPartitions("source", *_ORDER).mapInPandas(lambda parts: _whole(parts, rules), OUTPUT)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Held(*state.get[:-1], list(state.get[-1])) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            found = [held.end()]
        else:
            found = []
            for r in pd.concat(list(parts)).sort_values(_ORDER, kind="stable").itertuples():
                held, more = follow(held, r.s, r.signal, r.sharp, r.text if isinstance(r.text, str) else None, rules)
                found += more
            state.update(astuple(held))
            state.setTimeoutTimestamp(max(int((held.at + rules.idle) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["source", *_COLUMNS])

    return rows.withWatermark("at", late).groupBy("source").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _whole(parts: Iterator[pd.DataFrame], rules: Rules) -> Iterator[pd.DataFrame]:
    """The sources of one task, one after the other; a source may go on in the next batch."""
    source, held = None, None
    for part in parts:
        found = []
        for r in part.itertuples():
            if r.source != source:
                if held is not None:
                    found.append((source, *held.end()))
                source, held = r.source, None
            held, more = follow(held, r.s, r.signal, r.sharp, r.text if isinstance(r.text, str) else None, rules)
            found += [(source, *x) for x in more]
        yield pd.DataFrame(found, columns=["source", *_COLUMNS])
    if held is not None:
        yield pd.DataFrame([(source, *held.end())], columns=["source", *_COLUMNS])
