"""Reports: progress, rates, usage, cost and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from .ordinals import with_ordinals


def runs(started: DataFrame, attempts: DataFrame, run: str) -> DataFrame:
    """One row for each run, attempts or none: counts by outcome and kind of error, average seconds of successes, the last end observed, successes per minute.

    ``started``: the run, its started_at and finished_at (null while it goes on) and what
    else is known of it; ``attempts``: the run, attempt_number, started_at, finished_at,
    outcome and error_code. A run lasts from its start to its end, or to the last end
    of an attempt; without time between them it has no rate.
    """
    ok, code = F.col("outcome") == "succeeded", F.col("error_code")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    counts = {
        "n_attempts": F.lit(True),
        "n_succeeded": ok,
        "n_failed_retryable": F.col("outcome") == "failed-retryable",
        "n_failed_final": F.col("outcome") == "failed-final",
        "n_retries": F.col("attempt_number") > 1,
        "n_http_429": code == "HTTP_429",
        "n_http_5xx": code.rlike("^HTTP_5..$"),
        "n_transport": code == "PROVIDER_TRANSPORT_ERROR",
    }
    agg = attempts.groupBy(F.col(run).alias("_run")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.avg(F.when(ok, seconds)).alias("mean_seconds"), F.max("finished_at").alias("last_observed_at"))
    met = started.join(agg, F.col(run) == F.col("_run"), "left")
    succeeded = F.coalesce("n_succeeded", F.lit(0))
    minutes = (F.unix_micros(F.coalesce("finished_at", "last_observed_at")) - F.unix_micros("started_at")) / 6e7
    return met.select(*started.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.bround("mean_seconds", 4).alias("mean_seconds"), "last_observed_at", F.when(minutes > 0, F.bround(succeeded / minutes, 4)).alias("per_minute"))


def rates(attempts: DataFrame) -> DataFrame:
    """One row: shares of outcomes among ended attempts."""
    ended = attempts.where("outcome <> 'running'")
    n = lambda o: F.count_if(F.col("outcome") == o)
    return ended.agg(F.count(F.lit(1)).alias("n_ended"), percent(n("succeeded"), F.count(F.lit(1))).alias("success_percent"), percent(n("failed-final"), F.count(F.lit(1))).alias("failure_percent"), percent(n("failed-retryable"), F.count(F.lit(1))).alias("retry_percent"))


def error_histogram(attempts: DataFrame, top: int | None = None) -> DataFrame:
    """error_code, n, rank: how often each error was met, the most frequent first, then by code; the first ``top`` or all."""
    ranked = with_ordinals(attempts.where("error_code IS NOT NULL").groupBy("error_code").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "error_code"], "rank")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def in_order(by_category: DataFrame) -> DataFrame:
    """:func:`categories` with ``rank``: what has most left first, then by category."""
    return with_ordinals(by_category, [F.desc("n_remaining"), "category"], "rank")


#: Samples that a category needs for an estimate of its own.
LEAST_SAMPLES = 10


def usage(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of ended attempts by provider and model; cost is null without a price.

    ``attempts``: provider, model, outcome, prompt_tokens, completion_tokens,
    total_tokens; ``prices``: provider, model, input_per_million,
    output_per_million (decimals). An attempt is known that reports any count, and
    can be priced if it reports both sides. Costs are exact decimals.
    """
    p, c, t = F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")
    both = p.isNotNull() & c.isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    summed = attempts.where("outcome <> 'running'").groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n_ended"),
        F.count(F.coalesce(p, c, t)).alias("n_known"),
        total(p).alias("prompt_tokens"),
        total(c).alias("completion_tokens"),
        total(t).alias("total_tokens"),
        F.count_if(both).alias("_costable"),
        total(F.when(both, p)).alias("_in"),
        total(F.when(both, c)).alias("_out"),
    )
    cost = lambda tokens, price: (F.col(tokens).cast("decimal(18,0)") * F.col(price).cast("decimal(12,6)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,12)")
    priced = summed.join(prices, ["provider", "model"], "left")
    return priced.select(
        "provider",
        "model",
        "n_ended",
        "n_known",
        (F.col("n_ended") - F.col("n_known")).alias("n_unknown"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.when(F.col("input_per_million").isNull(), 0).otherwise(F.col("_costable")).cast("long").alias("n_priced"),
        cost("_in", "input_per_million").alias("input_cost"),
        cost("_out", "output_per_million").alias("output_cost"),
    )


def cost_summary(by_model: DataFrame) -> DataFrame:
    """One row: what :func:`usage` adds up to, and whether every ended attempt has a price (complete), some (partial) or none (unavailable)."""
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,12)").alias(c)
    n, priced = F.coalesce(F.sum("n_ended"), F.lit(0)), F.coalesce(F.sum("n_priced"), F.lit(0))
    status = F.when((n > 0) & (priced == 0), "unavailable").when(n == priced, "complete").otherwise("partial")
    return by_model.agg(n.alias("n_ended"), priced.alias("n_priced"), (n - priced).alias("n_unpriced"), money("input_cost"), money("output_cost"), status.alias("cost_status"))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """One row: all attempts, retries, final failures, their shares, and attempts for each success."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("outcome") == "succeeded")
    retries, final = F.count_if(F.col("attempt_number") > 1), F.count_if(F.col("outcome") == "failed-final")
    return attempts.agg(n.alias("n_attempts"), ok.alias("n_succeeded"), retries.alias("n_retries"), percent(retries, n).alias("retry_percent"), final.alias("n_failed_final"), percent(final, n).alias("failed_final_percent"), F.bround(n / F.nullif(ok, F.lit(0)), 4).alias("attempts_per_success"))


def forecast(samples: DataFrame, remaining: DataFrame, category: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """One row: tokens that the remaining items will take, by each category's mean where it has enough samples, by the mean of all else.

    ``samples``: category, prompt_tokens, completion_tokens of succeeded attempts
    that report both; ``remaining``: category, n_remaining. Unavailable (null
    tokens) while all samples together are too few; nothing left takes nothing.
    """
    own = samples.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    whole = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gn"), F.sum("p").alias("gp"), F.sum("c").alias("gc")).first()  # one row
    met = remaining.join(own, category, "left")
    enough = F.coalesce(F.col("n") >= least, F.lit(False))
    use = lambda mine, every: F.when(enough, F.col(mine) / F.col("n")).otherwise(F.lit(every / whole.gn if whole.gn else None).cast("double")) * F.col("n_remaining")
    left = F.coalesce(F.sum("n_remaining"), F.lit(0)).cast("long")
    ready = (left == 0) | F.lit(whole.gn >= least)
    tokens = lambda mine, every: F.when(left == 0, 0).when(ready, F.bround(F.sum(use(mine, every)), 0)).cast("long")
    return met.agg(F.when(ready, "available").otherwise("unavailable").alias("status"), left.alias("n_remaining"), F.lit(int(whole.gn)).cast("long").alias("n_samples"), tokens("p", whole.gp or 0).alias("prompt_tokens"), tokens("c", whole.gc or 0).alias("completion_tokens"))


def categories(rows: DataFrame) -> DataFrame:
    """Progress by category from category, status, route (null unless checked and current) and disposition."""
    n = F.count(F.lit(1))
    done, ready = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("disposition") == "MERGE_READY")
    return rows.groupBy("category").agg(
        n.alias("n_total"),
        done.alias("n_succeeded"),
        (n - done).alias("n_remaining"),
        F.count_if(F.col("disposition") == "WAITING_RETRY").alias("n_retry"),
        F.count_if(F.col("status") == "failed-final").alias("n_failed_final"),
        F.count_if(F.col("route") == "PASS").alias("n_qa_pass"),
        F.count_if(F.col("route") == "REVIEW").alias("n_qa_review"),
        ready.alias("n_merge_ready"),
        percent(done, n).alias("succeeded_percent"),
        percent(ready, n).alias("merge_ready_percent"),
    )


def estimate(samples: DataFrame, remaining: DataFrame, category: str, value: str, least: int = 10) -> DataFrame:
    """Work left by category: its own mean where it has ``least`` samples, the global mean else, times what remains."""
    own = samples.groupBy(category).agg(F.count(value).alias("n_samples"), F.avg(value).alias("_own"))
    whole = samples.agg(F.avg(value).alias("_all")).first()._all  # one number
    mean = F.when(F.col("n_samples") >= least, F.col("_own")).otherwise(F.lit(whole))
    basis = F.when(F.col("n_samples") >= least, "category").otherwise("global")
    return remaining.join(own, category, "left").select(category, "n_remaining", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce(basis, F.lit("global")).alias("basis"), F.bround(F.coalesce(mean, F.lit(whole)) * F.col("n_remaining"), 0).cast("long").alias("estimate"))


def rollup(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by the second key over all rows and within the first key, in one pass."""
    return rows.groupingSets([[F.col(inner)], [F.col(outer), F.col(inner)]], F.col(outer), F.col(inner)).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(outer, F.lit("ALL")).alias(outer), inner, "n")
