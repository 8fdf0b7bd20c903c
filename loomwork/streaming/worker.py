"""Workers as keyed state of a stream: leases with timers, streaks of failures, and how long each waits.

Each worker has a few values of state: its streak, and the lease of every row that it
holds. A lease that runs out is a timer; time is the events' own, so a replay of a stream
gives what the stream gave.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: What a state store needs for timers and maps; set on the session before such a query starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = StructType([StructField("worker_id", StringType()), StructField("content_uid", StringType()), StructField("kind", StringType()), StructField("streak", LongType()), StructField("delay", DoubleType()), StructField("at_ms", LongType())])


def retry_delay(streak: int, retry_after: float | None, base: float, most: float) -> float:
    """Seconds after the ``streak``-th failure in a row: as the provider asks, else doubling, from 0 to ``most``."""
    if retry_after is not None:
        return min(max(0.0, retry_after), most)
    return min(most, base * 2.0 ** max(0, streak - 1))


class _Worker(StatefulProcessor):
    def __init__(self, lease_ms: int, base: float, most: float):
        self.lease_ms, self.base, self.most = lease_ms, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", StructType([StructField("n", LongType())]))
        self.leases = handle.getMapState("leases", StructType([StructField("uid", StringType())]), StructType([StructField("until", LongType())]))

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in OUT])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak = self.streak.get()[0] if self.streak.exists() else 0
        out = []
        every = pd.concat(list(rows)).sort_values(["ts", "content_uid", "event"], kind="stable")
        for row in every.itertuples():
            at = int(row.ts.timestamp() * 1000)
            if row.event == "claimed":
                until = at + self.lease_ms
                self.leases.updateValue((row.content_uid,), (until,))
                self.handle.registerTimer(until)
                continue
            if not self.leases.containsKey((row.content_uid,)):
                out.append((key[0], row.content_uid, "refused", streak, 0.0, at))  # not held, or its lease ran out
                continue
            until = self.leases.getValue((row.content_uid,))[0]
            self.leases.removeKey((row.content_uid,))
            if until <= at:  # the timer would say so, but rows come before timers
                out += [(key[0], row.content_uid, "lease-expired", streak, 0.0, until), (key[0], row.content_uid, "refused", streak, 0.0, at)]
                continue
            again = row.event == "failed-retryable"
            streak = streak + 1 if again else 0
            after = None if pd.isna(row.retry_after) else float(row.retry_after)
            out.append((key[0], row.content_uid, row.event, streak, retry_delay(streak, after, self.base, self.most) if again else 0.0, at))
        self.streak.update((streak,))
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        streak = self.streak.get()[0] if self.streak.exists() else 0
        late = [uid[0] for uid, until in self.leases.iterator() if until[0] <= now]
        for uid in late:
            self.leases.removeKey((uid,))
        yield from self._out([(key[0], uid, "lease-expired", streak, 0.0, now) for uid in sorted(late)])

    def close(self) -> None:
        pass


def run(events: DataFrame, lease_seconds: int = 300, base: float = 2.0, most: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """What happens to workers' rows: worker_id, content_uid, kind, streak, delay (seconds), at_ms.

    ``events``: worker_id, content_uid, ts, event (claimed, or an outcome: succeeded,
    failed-retryable, failed-final) and retry_after (null: not asked for). An outcome for a row
    whose lease ran out, or that was never claimed, is refused and changes nothing.
    """
    if lease_seconds <= 0 or base < 0 or most < 0:
        raise ValueError("leases must be positive, delays not negative")
    key, value = PROVIDER
    if events.sparkSession.conf.get(key, None) != value:
        events.sparkSession.conf.set(key, value)
    return events.withWatermark("ts", late).groupBy("worker_id").transformWithStateInPandas(_Worker(lease_seconds * 1000, base, most), OUT, "Update", "EventTime")
