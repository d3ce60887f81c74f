"""Noon windows over a stream of house-days: a day waits for the next day of its house.

The state of a house is the days that still wait. A day is emitted with the next day's morning as soon as
that arrives, or without it once the watermark has passed the next day's end; a later morning is
lost, as in any watermarked join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUT = T.StructType([T.StructField("mp_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("win", T.ArrayType(T.DoubleType()))])
STATE = T.StructType([T.StructField("days", T.ArrayType(T.IntegerType())), T.StructField("kw", T.ArrayType(T.ArrayType(T.DoubleType())))])


def stitch(held: dict, arrived: dict, done_before: int | None) -> tuple[list[tuple[int, list]], dict]:
    """One step of a house: (windows to emit, days that still wait). Days are numbers since 1970."""
    days = {**held, **arrived}
    out = []
    for day in sorted(days):
        following = days.get(day + 1)
        if following is not None:
            out.append((day, days[day][48:] + following[:48]))
        elif done_before is not None and day + 2 <= done_before:
            out.append((day, days[day][48:] + [None] * 48))
    emitted = {d for d, _ in out}
    # Days come in order of time: one that arrives after its successor has been emitted goes without a morning.
    rest = {d: v for d, v in days.items() if d not in emitted}
    return out, rest


def noon_stream(days: DataFrame, delay: str = "1 day") -> DataFrame:
    """days: a stream with mp_id, ts (noon of the day), date and kw (96 values) of import. Returns OUTPUT rows."""
    import datetime

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    epoch = datetime.date(1970, 1, 1)

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        held = {}
        if state.exists:
            numbers, values = state.get
            held = {n: [None if x is None or x != x else float(x) for x in v] for n, v in zip(numbers, values, strict=True)}
        arrived = {}
        for f in frames:
            for day, kw in zip(f["date"], f["kw"], strict=True):
                arrived[(day - epoch).days] = [None if x is None or x != x else float(x) for x in kw]
        mark = state.getCurrentWatermarkMs()
        done = mark // 86_400_000 if mark > 0 else None
        out, rest = stitch(held, arrived, done)
        if rest:
            state.update((list(rest), list(rest.values())))
            state.setTimeoutTimestamp(max(mark + 1, (min(rest) + 2) * 86_400_000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"mp_id": [key[0]] * len(out), "date": [epoch + datetime.timedelta(days=d) for d, _ in out], "win": [w for _, w in out]})

    marked = days.withWatermark("ts", delay).select("mp_id", "ts", "date", F.col("kw").cast("array<double>").alias("kw"))
    return marked.groupBy("mp_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
