"""Packet ingest as a keyed stateful stream, with the verdicts of the batch operator.

A channel's state is the sequence it expects next and its counts. Packets are
taken in arrival order within a micro-batch; a packet below the expected
sequence is stale and never reordered in. A channel that stays silent past its
timeout is closed by an event of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICT = "channel long, arrival long, sequence long, expected long, stale boolean, missing long, closed boolean"
STATE = "expected long, accepted long, stale long, missing long"


def verdicts(packets: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One verdict for each packet of (channel, arrival, sequence), in update order; with ``idle_ms`` a closing row for channels silent that long."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, accepted, stale, missing = state.get if state.exists else (0, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], -1, -1, expected, False, 0, True)], columns=["channel", "arrival", "sequence", "expected", "stale", "missing", "closed"])
            return
        out = []
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
        for arrival, sequence in zip(rows["arrival"].tolist(), rows["sequence"].tolist(), strict=True):
            late = sequence < expected
            gap = 0 if late else sequence - expected
            out.append((key[0], arrival, sequence, expected, late, gap, False))
            if late:
                stale += 1
            else:
                accepted, missing, expected = accepted + 1, missing + gap, sequence + 1
        state.update((expected, accepted, stale, missing))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["channel", "arrival", "sequence", "expected", "stale", "missing", "closed"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return packets.select("channel", "arrival", "sequence").groupBy("channel").applyInPandasWithState(step, VERDICT, STATE, "append", timeout)
