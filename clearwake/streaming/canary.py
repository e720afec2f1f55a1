"""Stateful canary verdict: one row per deployment, emitted once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearwake.operators.telemetry import CANARY_DURATION_S, ERROR_THRESHOLD, SAMPLE_INTERVAL_S, SPIKE_FACTOR

OUTPUT = "deployment string, verdict string, samples long, mean_ratio double"
#: Samples that wait, in microseconds and ratios by time, and whether the verdict is given.
STATE = "times array<long>, ratios array<double>, done boolean"


def _observe(ratios: list[float], state: tuple, threshold: float, wanted: int):
    """Next state and the verdict, if this batch brings one."""
    total, samples, done = state
    for ratio in ratios:
        if done:
            break
        total, samples = total + ratio, samples + 1
        # a ratio that is no number is no reason to go on
        if not ratio <= threshold * SPIKE_FACTOR:
            return (total, samples, True), "ROLLBACK_SPIKE"
        if samples == wanted:
            verdict = "ROLLBACK_AVG" if total / samples > threshold else "PROMOTE"
            return (total, samples, True), verdict
    return (total, samples, done), None


def _settled(times: list[int], passed: int, interval: int) -> int:
    """How many of the first samples no other can come between: the watermark has passed them, or they follow without a gap."""
    for i, time in enumerate(times):
        if i and time - times[i - 1] > interval and time > passed:
            return i
    return len(times)


def stream_canary(
    ratios: DataFrame,
    threshold: float = ERROR_THRESHOLD,
    wanted_samples: int = CANARY_DURATION_S // SAMPLE_INTERVAL_S,
    interval_s: int = SAMPLE_INTERVAL_S,
    timeout_s: int | None = CANARY_DURATION_S,
    delay: str = "1 minute",
) -> DataFrame:
    """Verdict per deployment from a stream of ratio samples ``(deployment, ts, ratio)``.

    A spike decides at once, otherwise the mean does when the observation is complete. Samples
    are one row per deployment and interval: raw events are counted per window beforehand, so no
    group grows with the traffic. Behind a gap of more than an interval samples wait until the watermark has passed
    them, so those of a later micro-batch take their place in time. When it has passed ``timeout_s`` after the first sample,
    what came until then decides; with None only a spike or all samples do. Rows without a time or a ratio are left out, and rows
    behind the watermark are dropped and counted as late. State per deployment is ``wanted_samples`` times and ratios.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, held, done = state.get if state.exists else ([], [], False)
        waiting = list(zip(map(int, times), map(float, held)))
        for frame in frames:
            waiting += zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["ratio"].tolist())
        if done:
            state.update(([], [], True))
            return
        waiting.sort(key=lambda sample: sample[0])
        passed = state.getCurrentWatermarkMs() * 1000
        end = None if timeout_s is None else waiting[0][0] + timeout_s * 1_000_000
        # later ones than the first so many, or after the end, have no say whatever still comes
        waiting = [s for s in waiting if end is None or s[0] < end][:wanted_samples]
        times = [t for t, _ in waiting]
        sure = [r for _, r in waiting[: _settled(times, passed, interval_s * 1_000_000)]]
        (total, samples, done), verdict = _observe(sure, (0.0, 0, False), threshold, wanted_samples)
        if verdict is None and end is not None and end <= passed:
            done, verdict = True, "ROLLBACK_AVG" if total / samples > threshold else "PROMOTE"
        if done:
            state.update(([], [], True))
            yield pd.DataFrame(
                {
                    "deployment": [key[0]],
                    "verdict": [verdict],
                    "samples": [samples],
                    "mean_ratio": [total / samples],
                }
            )
            return
        state.update((times, [r for _, r in waiting], False))
        # called again when the watermark reaches the next sample that waits, or the end
        ahead = [t for t in (*times[len(sure) :], end) if t is not None and t > passed]
        if ahead:
            state.setTimeoutTimestamp(max(-(-min(ahead) // 1000) - 1, passed // 1000 + 1))

    return (
        ratios.select("deployment", "ts", "ratio")
        .where("ts IS NOT NULL AND ratio IS NOT NULL")
        .withWatermark("ts", delay)
        .groupBy("deployment")
        .applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
