"""Custom keyed state in event-time order: rolling KPI features, the breaker machine, alarms that corroborate flags.

Rows wait in the state until the watermark has passed them and are then taken in time
order, however they were delivered.  State per entity is bounded by the waiting rows and
a memory (the last 96 readings, one breaker record) and expires in event time.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ropeway.operators.rules import Breaker

NAMES = {"C": "closed", "O": "open", "H": "half_open"}
LONG, SHORT = 96, 16
#: Keys of the state, to which entities are dealt, and rows whose frames are held at once.
SHARES, ROWS = 1024, 20_000


def in_order(stream: DataFrame, entity: str, time: str, tie: str, value: str, memory: str, output: dict[str, str],
             advance: Callable[[list, np.ndarray, np.ndarray, np.ndarray], tuple[list, list]], ttl_hours: int, delay: str) -> DataFrame:
    """Run ``advance(memories, lengths, times, values)`` over the rows behind the watermark.

    Entities are dealt to SHARES keys and all due entities of a share are advanced in one
    call, as a call costs far more than a row.  ``advance`` gets one memory (None at
    first, else of SQL type ``memory``) and one number of rows per entity, and their rows
    one entity behind the other, each in time order; it returns the new memories and the
    ``output`` columns of the rows.  Rows later than ``delay`` are dropped by the watermark.
    An entity without waiting rows is forgotten ``ttl_hours`` of event time after its
    last reading.
    """
    types = dict(stream.dtypes)
    schema = ", ".join([f"{entity} {types[entity]}", f"{tie} {types[tie]}", *[f"{n} {t}" for n, t in output.items()]])
    kept = (f"entities array<{types[entity]}>, memories array<{memory}>, lasts array<bigint>, "
            f"owners array<{types[entity]}>, times array<bigint>, ties array<{types[tie]}>, vals array<{types[value]}>")
    ttl = ttl_hours * 3_600_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.getCurrentWatermarkMs()
        entities, memories, lasts, *waiting = state.get if state.exists else [[] for _ in range(7)]
        known = {e: (m, t) for e, m, t in zip(entities, memories, lasts)}
        owners, times, ties, values = (list(w) for w in waiting)
        if not state.hasTimedOut:
            for pdf in batches:
                owners += [None] * len(pdf) if key[0] < 0 else pdf[entity].tolist()
                times += pdf["_us"].tolist()
                ties += pdf[tie].tolist()
                values += [None if v is None or v != v else v for v in pdf[value].tolist()]
        number = {e: i for i, e in enumerate(dict.fromkeys(owners))}
        rows = sorted(zip([number[e] for e in owners], times, ties, values), key=lambda r: r[:3])
        ready, waiting = [r for r in rows if r[1] // 1000 < seen], [r for r in rows if r[1] // 1000 >= seen]
        names = list(number)
        if ready:
            who, at, tied, vals = zip(*ready)
            due, ends = np.unique(np.array(who), return_index=True)
            lengths = np.diff(np.append(ends, len(who)))
            held, columns = advance([known.get(names[i], (None, None))[0] for i in due], lengths, np.array(at, np.int64), np.array(vals, object))
            for i, m, end in zip(due, held, np.cumsum(lengths)):
                known[names[i]] = m, at[end - 1]
        for e in names:
            known.setdefault(e, (None, None))
        known = {e: (m, t) for e, (m, t) in known.items() if e in number or t // 1000 + ttl >= seen}
        if known:
            state.update(([*known], [m for m, _ in known.values()], [t for _, t in known.values()],
                          *([f(r) for r in waiting] for f in (lambda r: names[r[0]], lambda r: r[1], lambda r: r[2], lambda r: r[3]))))
            open_now = {names[r[0]] for r in waiting}
            wake = min([r[1] // 1000 for r in waiting] + [t // 1000 + ttl for e, (_, t) in known.items() if e not in open_now])
            state.setTimeoutTimestamp(max(wake, seen + 1))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame({entity: pd.Series([names[i] for i in who], dtype=object), tie: list(tied), **dict(zip(output, columns))})

    share = F.when(F.col(entity).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(entity), F.lit(SHARES))).cast("int")
    rows = stream.withWatermark(time, delay).select(entity, time, tie, value, F.unix_micros(time).alias("_us"), share.alias("_share"))
    return rows.groupBy("_share").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def rolling(held: list, lengths: np.ndarray, times: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Mean and deviation of the last 16 and 96 readings and the last change, for all rows of all entities at once."""
    before = [np.frombuffer(h, float) if h is not None else np.empty(0) for h in held]
    new = np.split(values.astype(float), np.cumsum(lengths)[:-1])
    every = np.concatenate([np.full(LONG, np.nan), *[x for pair in zip(before, new) for x in pair]])
    sizes = np.array([len(b) for b in before]) + lengths
    ends = LONG + np.cumsum(sizes)
    # places of the new rows and the readings of their entity up to them
    place = np.concatenate([np.arange(e - n, e) for e, n in zip(ends, lengths)])
    depth = place - np.repeat(ends - sizes, lengths) + 1
    columns: list = [[] for _ in range(5)]
    for begin in range(0, len(place), ROWS):
        at, own = place[begin : begin + ROWS], depth[begin : begin + ROWS, None]
        for i, w in enumerate((SHORT, LONG)):
            frames = np.lib.stride_tricks.sliding_window_view(every, w)[at - w + 1]
            frames = np.where(np.arange(w, 0, -1) <= own, frames, np.nan)
            count = (~np.isnan(frames)).sum(1)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # frames without a reading
                mean, deviation = np.nanmean(frames, axis=1), np.nanstd(frames, axis=1, ddof=1)
            columns[2 * i].append(np.where(count > 0, mean, 0.0))
            columns[2 * i + 1].append(np.where(count > 1, deviation, 0.0))
        change = np.where(own[:, 0] > 1, every[at] - every[at - 1], np.nan)
        columns[4].append(np.where(np.isnan(change), 0.0, change))
    kept = [every[max(e - LONG, e - n) : e].tobytes() for e, n in zip(ends, sizes)]
    return kept, [np.concatenate(c) for c in columns]


def rolling_stream(stream: DataFrame, entity: str, time: str, tie: str, kpi: str, ttl_hours: int = 48,
                   delay: str = "1 hour") -> DataFrame:
    """Rolling features of every reading once the watermark has passed it."""
    output = {n: "double" for n in ("mean_4h", "std_4h", "mean_24h", "std_24h", "delta_1")}
    return in_order(stream, entity, time, tie, kpi, "binary", output, rolling, ttl_hours, delay)


def breaker_steps(records: list, lengths: np.ndarray, times: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    held, out, begin = [], [], 0
    for record, n in zip(records, lengths.tolist()):
        machine = Breaker(record)
        for at, good in zip(times[begin : begin + n].tolist(), values[begin : begin + n].tolist()):
            seen, used = machine.call(at / 1e6, bool(good))
            out.append((NAMES[seen], int(used), NAMES[machine.state]))
        held.append(machine.dump())
        begin += n
    return held, [list(c) for c in zip(*out)]


def breaker_stream(stream: DataFrame, entity: str, time: str, tie: str, ok: str, ttl_hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """The batch breaker machine with its record in the state store."""
    output = {"state_before": "string", "tried": "int", "state_after": "string"}
    return in_order(stream, entity, time, tie, ok, "string", output, breaker_steps, ttl_hours, delay)


def corroborated(flags: DataFrame, alarms: DataFrame, key: str, time: str, within: str = "30 minutes",
                 delay: str = "1 hour", spans: int = 4) -> DataFrame:
    """Every flag (key, flag time) with the first alarm of the following half hour, or none.

    Times are compared as they are: an alarm at the flag's time or at the end of the
    interval counts.  Keys are cut into stretches of ``spans`` intervals; an alarm also
    goes to the stretch before when flags there can still reach it.  A stretch keeps its
    open flags and the alarms they can meet, in order, so no pairs are formed and a flag
    costs one search.  A flag leaves once the watermark has passed its interval.
    """
    reach = int(pd.Timedelta(within) / pd.Timedelta(microseconds=1))
    stretch = spans * reach
    dtype = dict(flags.dtypes)[key]
    at, back = F.unix_micros(time), F.unix_micros(time) - reach
    slot = lambda c: F.floor(c / F.lit(stretch)).cast("bigint")

    def side(rows: DataFrame, alarm: bool, slots: list) -> DataFrame:
        # an alarm without a key meets nothing, a flag without one keeps its row
        marked = rows.where(F.col(time).isNotNull() & (F.col(key).isNotNull() | F.lit(not alarm))).withWatermark(time, delay)
        return marked.select(key, time, at.alias("_us"), F.lit(alarm).alias("_alarm"), F.explode(F.array_distinct(F.array(*slots))).alias("_slot"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = max(state.getCurrentWatermarkMs(), 0)
        open_flags, known = (np.array(v, np.int64) for v in (state.get if state.exists else ([], [])))
        if not state.hasTimedOut:
            for pdf in batches:
                times, alarm = pdf["_us"].to_numpy(), pdf["_alarm"].to_numpy(bool)
                open_flags, known = np.union1d(open_flags, times[~alarm]), np.union1d(known, times[alarm])
        n = int(np.searchsorted(open_flags, seen * 1000 - reach))
        ready, open_flags = open_flags[:n], open_flags[n:]
        first = np.append(known, np.iinfo(np.int64).max)[np.searchsorted(known, ready)]
        end = (int(group[1]) + 1) * stretch
        if seen:  # flags still to come are not before the watermark
            known = known[known >= min([seen * 1000, *open_flags[:1].tolist()])]
        if len(open_flags) or end // 1000 >= seen:
            state.update((open_flags.tolist(), known.tolist()))
            wake = (int(open_flags[0]) + reach if len(open_flags) else end) // 1000
            state.setTimeoutTimestamp(max(wake, seen, 1))
        elif state.exists:
            state.remove()
        if n:
            yield pd.DataFrame({key: group[0], "_flag": ready, "_first": first, "_met": first <= ready + reach})

    rows = side(flags, False, [slot(at)]).unionByName(side(alarms, True, [slot(at), slot(back)]))
    out = rows.groupBy(key, "_slot").applyInPandasWithState(
        step, f"{key} {dtype}, _flag bigint, _first bigint, _met boolean", "flags array<bigint>, alarms array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("_flag").alias("flag_time"),
                      F.when(F.col("_met"), F.timestamp_micros("_first")).alias("alarm_time"))
