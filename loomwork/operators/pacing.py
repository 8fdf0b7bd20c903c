"""Waiting after failures: doubling delays by streaks, and what a provider asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import retry_delay
from .ordinals import with_ordinals, with_running_max


def retry_delays(attempts: DataFrame, worker: str, order: Sequence[str], base: float = 2.0, most: float = 60.0) -> DataFrame:
    """``attempts`` with ``streak`` and ``delay``: how many failures in a row could be tried again, and the seconds that the worker then waits.

    ``attempts``: the worker, columns of ``order``, retryable (null or false: a success, or a
    failure for good, which end a streak) and retry_after (null: not asked for). A
    worker's history is scanned in ranges, however long it is.
    """
    again = F.coalesce(F.col("retryable"), F.lit(False))
    numbered = with_ordinals(attempts, list(order), "_n", within=[worker])
    ended = with_running_max(numbered, ["_n"], F.when(~again, F.col("_n")), "_ended", within=[worker])
    streak = F.when(again, F.col("_n") - F.coalesce("_ended", F.lit(0))).otherwise(0).cast("long")
    return ended.withColumn("streak", streak).withColumn("delay", F.when(F.col("streak") > 0, retry_delay(F.col("streak"), F.col("retry_after"), base, most)).otherwise(0.0)).drop("_n", "_ended")
