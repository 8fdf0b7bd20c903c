"""A row-wise provider, such as a remote translator, called from partitions with pacing and retries."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: What a provider returns for (uid, text): (outcome, text or None, error code or None, prompt tokens, completion tokens), and, if it asks for that, the seconds to wait.
Outcome = tuple[str, str | None, str | None, int | None, int | None] | tuple[str, str | None, str | None, int | None, int | None, float | None]
RESULT = "content_uid string, outcome string, translated_text string, error_code string, attempts int, prompt_tokens long, completion_tokens long"


def run(rows: DataFrame, provider: Callable[[str, str], Outcome], max_attempts: int = 3, interval: float = 0.0, base: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, partitions: int | None = None) -> DataFrame:
    """One result per row of content_uid and text.

    Outcomes that can be tried again are, up to ``max_attempts``, after the wait that the
    provider asks for, else one that doubles with each such failure in a row, over the rows
    of a partition; ``most`` bounds both. A provider that raises fails its row for good, not
    the job. ``partitions``
    bounds how many calls run at once; ``interval`` paces those of a partition.
    """

    def each(frames):
        streak, wait = 0, 0.0
        for frame in frames:
            out = []
            for uid, text in zip(frame["content_uid"], frame["text"], strict=True):
                for attempt in range(1, max_attempts + 1):
                    if max(interval, wait) > 0:
                        sleep(max(interval, wait))
                    try:
                        outcome, result, error, asked, answered, *after = provider(uid, text)
                    except Exception as fault:  # noqa: BLE001 - a provider's fault is the row's result
                        outcome, result, error, asked, answered, after = "failed-final", None, f"PROVIDER_EXCEPTION:{type(fault).__name__}", None, None, []
                    streak = streak + 1 if outcome == "failed-retryable" else 0
                    wait = 0.0 if not streak else min(most, max(0.0, after[0])) if after and after[0] is not None else min(most, base * 2 ** (streak - 1))
                    if not streak or attempt == max_attempts:
                        break
                out.append((uid, "failed-final" if outcome == "failed-retryable" else outcome, result, error, attempt, asked, answered))
            got = pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in RESULT.split(",")])
            yield got.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    dealt = rows.select("content_uid", "text")
    return (dealt.repartition(partitions) if partitions else dealt).mapInPandas(each, RESULT)
