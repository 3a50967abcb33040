"""Stateful operators over keyed streams: throttles, monotone publishing, bracket completion, feedback.

Each takes a stream, a key, a time and an id; rows of one key within a
micro-batch are handled in (time, id) order, and state carries over between
batches, so results do not depend on how files fall into batches as long as
they arrive in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _keyed(stream: DataFrame, key: str, order: list[str], columns: list[str], out: str, state: str, step) -> DataFrame:
    """``step(state tuple or None, sorted rows) -> (new state tuple, output frame)``."""

    def run(k, batches, held: GroupState):
        rows = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        new, got = step(held.get if held.exists else None, rows)
        held.update(new)
        yield got.assign(**{key: k[0]})[[c.strip().split(" ")[0] for c in out.split(",")]]

    needed = list(dict.fromkeys([key, *order, *columns]))
    return stream.select(*needed).groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def throttled(stream: DataFrame, key: str, time_us: str, ident: str, gap_us: int) -> DataFrame:
    """A row passes if the last passed one of its key lies at least the gap before."""

    def step(state, rows):
        last, keep = state[0] if state else None, []
        for t in rows[time_us]:
            ok = last is None or t - last >= gap_us
            keep.append(ok)
            last = t if ok else last
        return (int(last),), rows[keep]

    return _keyed(stream, key, [time_us, ident], [], f"{key} long, {ident} long, {time_us} long", "last long", step)


def monotone(stream: DataFrame, key: str, time_us: str, ident: str) -> DataFrame:
    """Rows in arrival (id) order whose time is past everything shown before; late ones are dropped."""

    def step(state, rows):
        top, keep = state[0] if state else None, []
        for t in rows[time_us]:
            keep.append(top is None or t > top)
            top = t if top is None else max(top, t)
        return (int(top),), rows[keep]

    return _keyed(stream, key, [ident], [time_us], f"{key} long, {ident} long", "top long", step)


def brackets(stream: DataFrame, key: str, time_us: str, ident: str, value: str, size: int = 4) -> DataFrame:
    """Every ``size`` rows of a key come out as one, with their order and sum; the rest waits."""

    def step(state, rows):
        waiting, nth = (list(state[0]), state[1]) if state else ([], 0)
        out = []
        for v in rows[value]:
            waiting.append(int(v))
            if len(waiting) == size:
                out.append((nth, sum(waiting)))
                waiting, nth = [], nth + 1
        return (waiting, nth), pd.DataFrame(out, columns=["nth", "total"])

    return _keyed(stream, key, [time_us, ident], [value], f"{key} long, nth long, total long", "waiting array<long>, nth long", step)


def first_seed(stream: DataFrame, key: str, time_us: str, ident: str, value: str) -> DataFrame:
    """Each row with its key's first value, written once and never changed."""

    def step(state, rows):
        seed = state[0] if state else int(rows[value].iloc[0])
        return (seed,), rows.assign(governing=seed)

    return _keyed(stream, key, [time_us, ident], [value], f"{key} long, {ident} long, governing long", "seed long", step)


def feedback(stream: DataFrame, key: str, time_us: str, ident: str, value: str, seed: int) -> DataFrame:
    """Each row with the latest non-null value before it; the seed until there is one."""

    def step(state, rows):
        known = state[0] if state else seed
        plan = []
        for v in rows[value]:
            plan.append(known)
            known = known if pd.isna(v) else int(v)
        return (known,), rows.assign(plan=plan)

    return _keyed(stream, key, [time_us, ident], [value], f"{key} long, {ident} long, plan long", "known long", step)


def running_churn(stream: DataFrame, key: str, time_us: str, ident: str, value: str) -> DataFrame:
    """Each row with how often its key's value has changed so far."""

    def step(state, rows):
        before, changed = state if state else (None, 0)
        out = []
        for v in rows[value]:
            changed += before is not None and v != before
            before = int(v)
            out.append(changed)
        return (before, changed), rows.assign(churn=out)

    return _keyed(stream, key, [time_us, ident], [value], f"{key} long, {ident} long, churn long", "before long, changed long", step)


def failures(stream: DataFrame, key: str, time_us: str, ident: str, ok: str, budget: int) -> DataFrame:
    """Rows at which a key's failures first exceed the budget: one alarm a key."""

    def step(state, rows):
        bad, alarmed = state if state else (0, False)
        out = []
        for i, good in zip(rows[ident], rows[ok]):
            bad += not good
            if bad > budget and not alarmed:
                alarmed = True
                out.append((i, bad))
        return (bad, alarmed), pd.DataFrame(out, columns=[ident, "failed"])

    return _keyed(stream, key, [time_us, ident], [ok], f"{key} long, {ident} long, failed long", "bad long, alarmed boolean", step)


def stalled(stream: DataFrame, key: str, ts: str, gap: str = "90 seconds") -> DataFrame:
    """Sessions per key that a silence of the gap ends (watchdog): start, end and rows."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, "0 seconds").groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed(stream: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and exact value sums in event-time windows (an extension; the late bound drops state)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.unix_micros("window.start").alias("start_us"), *keys, "n", "cents")
