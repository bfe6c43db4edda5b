"""Custom keyed state: regime changes and their counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series_id string, ts timestamp, from_regime int, to_regime int, confidence double, switches bigint, recent array<int>"
STATE = ("last_regime int, switches bigint, recent array<int>, "
         "at array<bigint>, tie array<bigint>, regime array<int>, confidence array<double>")
_NAMES = ["at", "tie", "regime", "confidence"]


def regime_changes(labels: DataFrame, delay: str = "10 minutes", keep: int = 100) -> DataFrame:
    """Changes of a label stream (series_id, ts, regime, confidence, tie), in append mode.

    A row is emitted when the regime differs from that of the row before it in (ts, tie), with the number of changes
    so far and the last ``keep`` regimes changed to.  Labels wait in the state until the watermark, ``delay`` behind
    the latest label, has passed them, so the result doesn't depend on the order of files or on triggers; later
    labels are dropped.  State lives in the checkpoint: one record per series, with the labels of one delay.
    """
    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, switches, recent, *held = state.get if state.exists else (None, 0, [], [], [], [], [])
        recent = list(recent)
        waiting = [pd.DataFrame(dict(zip(_NAMES, map(list, held))))] if held[0] else []
        if not state.hasTimedOut:
            waiting += [pdf[_NAMES] for pdf in batches if len(pdf)]
        if not waiting:
            return
        rows = pd.concat(waiting).sort_values(["at", "tie"], kind="stable")
        mark = state.getCurrentWatermarkMs()
        ready = (rows["at"] // 1000 < mark).to_numpy(bool)
        out = []
        for at, _, regime, confidence in rows[ready].itertuples(index=False):
            if last is not None and regime != last:
                switches += 1
                recent = (recent + [int(regime)])[-keep:]
                out.append((key[0], pd.Timestamp(at, unit="us"), int(last), int(regime), float(confidence), switches, recent))
            last = int(regime)
        rest = rows[~ready]
        state.update((last, switches, recent, *(rest[n].tolist() for n in _NAMES)))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["at"].iloc[0]) // 1000, mark + 1))
        yield pd.DataFrame(out, columns=["series_id", "ts", "from_regime", "to_regime", "confidence", "switches", "recent"])

    rows = labels.withWatermark("ts", delay).select(
        "series_id", "ts", F.unix_micros("ts").alias("at"), F.col("tie").cast("bigint").alias("tie"),
        F.col("regime").cast("int").alias("regime"), F.col("confidence").cast("double").alias("confidence"))
    return rows.groupBy("series_id").applyInPandasWithState(changes, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
