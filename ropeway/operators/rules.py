"""Governance rules as column expressions and the ordered state machines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.segments import SEGMENT, last_known, split
from ropeway.plans.skew import attach, lookup_join
from ropeway.session import durable, rows_per_task

# Action kinds, levels, limits and latency budgets.
WRITE_ACTIONS = ("ANTENNA_TILT_ADJUST", "HO_PARAM_CHANGE", "POWER_REDUCTION", "CELL_BLOCK", "CARRIER_SHUTDOWN")
SUGGEST, ACT_APPROVAL, ACT_NOTIFY, AUTONOMOUS = 0, 1, 2, 3
ONE_CELL, ONE_SITE, ESCALATE_ABOVE = 1, 6, 7
LOCK_SECONDS = 300
LATENCY_BUDGET_MS = {"ran_near_rt": 50, "ran_non_rt": 500, "cx_realtime": 200, "batch_planning": 3600000}
SQUADS = ("ran", "cx", "fraud", "oss", "energy")
ROOT_CONFIDENCE, MAX_HANDOVER_DROP, LOOP_F1 = 0.72, 0.5, 0.82


def messages(rules: Sequence[tuple[Column, str]]) -> Column:
    """Texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in rules]))


def promotion_issues() -> Column:
    """Blocking issues of a model card row."""
    c = F.col
    return messages([
        (c("approved_by").isNull(), "not approved"),
        (c("achieved_auc").isNull(), "no evaluation metrics"),
        (c("achieved_auc") < c("target_auc"), "auc below target"),
        (c("achieved_f1").isNull(), "f1 not recorded"),
        (c("achieved_f1") < c("target_f1"), "f1 below target"),
        (F.size("data_sources") == 0, "no data sources"),
        ((c("risk") == "high_risk") & c("approved_by").isNull(), "high risk needs approval"),
    ])


def promotion_policy(required: Sequence[str] = ("squad", "description")) -> dict[str, Column]:
    """Policy verdict and violations; ``conflicts`` is the card's number of write-set conflicts."""
    c = F.col
    complete = F.size("data_sources") > 0
    for name in required:
        complete = complete & (c(name) != "")
    good = (c("achieved_auc") >= c("target_auc")) & (c("achieved_f1") >= c("target_f1"))
    clean = c("conflicts") == 0
    risk = (c("risk") == "limited_risk") | (
        (c("risk") == "high_risk") & c("approved_by").isNotNull() & c("oversight"))
    human = c("approved_by").isNotNull() & (c("approved_by") != "") & ~F.startswith(c("approved_by"), F.lit("svc-"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    allow = yes(complete) & yes(good) & clean & yes(risk) & yes(human)
    return {
        "allow": allow.cast("int"),
        "violations": messages([
            (~yes(complete), "card incomplete"), (~yes(good), "below target"), (~clean, "write-set conflict"),
            ((c("risk") == "high_risk") & c("approved_by").isNull(), "high risk needs approval")]),
    }


def write_conflicts(writes: DataFrame, kpis: DataFrame, model: str = "model") -> DataFrame:
    """block / warn / pass per model without listing model pairs.

    ``writes`` is (model, parameter, direction 'up' or 'down'), ``kpis`` (model, kpi).
    Per parameter only the number of models per direction is needed.
    """
    per = writes.groupBy(model, "parameter").agg(
        F.max((F.col("direction") == "up").cast("int")).alias("up"),
        F.max((F.col("direction") == "down").cast("int")).alias("down"))
    seen = per.groupBy("parameter").agg(
        F.sum("up").alias("n_up"), F.sum("down").alias("n_down"), F.count(F.lit(1)).alias("_n"))
    both = attach(per, seen, ["parameter"], rows="_n")
    opposed = ((F.col("up") == 1) & (F.col("n_down") > F.col("down"))) | (
        (F.col("down") == 1) & (F.col("n_up") > F.col("up")))
    blocks = both.groupBy(model).agg(F.sum(opposed.cast("int")).alias("conflicts"))
    uses = kpis.select(model, "kpi").distinct()
    users = uses.groupBy("kpi").agg(F.count(F.lit(1)).alias("_n"))
    overlap = attach(uses, users, ["kpi"], rows="_n").groupBy(model).agg(
        F.sum((F.col("_n") > 1).cast("int")).alias("shared_kpis"))
    out = blocks.join(overlap, model, "full").na.fill(0, ["conflicts", "shared_kpis"])
    return out.withColumn("verdict", F.when(F.col("conflicts") > 0, "block").when(F.col("shared_kpis") > 0, "warn").otherwise("pass"))


PolicyRule = Callable[[], tuple[Column, str]]


def tilt_limit() -> tuple[Column, str]:
    return (F.col("action_type") == "ANTENNA_TILT_ADJUST") & (F.col("n_cells") > ONE_SITE), "tilt on more than one site"


def peak_handover() -> tuple[Column, str]:
    local = F.pmod(F.hour("now") + 10, F.lit(24))
    return (F.col("action_type") == "HO_PARAM_CHANGE") & local.between(7, 21), "handover change in peak hours"


def suggest_only() -> tuple[Column, str]:
    return F.col("action_type").isin(*WRITE_ACTIONS) & (F.col("requested_level") == SUGGEST), "write at suggest level"


DEFAULT_POLICIES: tuple[PolicyRule, ...] = (tilt_limit, peak_handover, suggest_only)


def policy_violations(rules: Sequence[PolicyRule] = DEFAULT_POLICIES) -> Column:
    """Violations of a proposal (action_type, n_cells, requested_level, now)."""
    return messages([rule() for rule in rules])


def approval_path(level: Column, cells: Column, violated: Column) -> Column:
    """Routing by granted autonomy level and number of touched cells."""
    supervisor, operator = F.lit("SUPERVISOR_REQUIRED"), F.lit("OPERATOR_REQUIRED")
    auto, denied = F.lit("AUTO"), F.lit("DENIED_POLICY")
    return (
        F.when(violated, denied).when(cells == 0, auto)
        .when(level == AUTONOMOUS, F.when(cells <= ONE_SITE, auto).otherwise(supervisor))
        .when(level == ACT_NOTIFY, F.when(cells <= ONE_CELL, auto).when(cells <= ONE_SITE, operator).otherwise(supervisor))
        .when(level == ACT_APPROVAL, F.when(cells > ESCALATE_ABOVE, supervisor).otherwise(operator))
        .otherwise(denied))


def lock_decisions(proposals: DataFrame, action: str, cell: str, time: str, seconds: int = LOCK_SECONDS) -> DataFrame:
    """Approve or deny proposals whose cells may be locked by an earlier approved action.

    ``proposals`` has one row per (action, cell).  A proposal is settled once every
    earlier proposal in reach is: each round looks up, per cell, the latest approved
    and the latest open proposal before it.  No conflict pair is written out, a busy
    cell is split along time, and settled denials leave the next round.  Every round
    settles at least the earliest open proposals, so it ends.
    """
    wait = seconds * 1_000_000
    work = durable(proposals.select(action, cell, time).distinct().withColumn("_ok", F.lit(None).cast("int")))
    decided: list[DataFrame] = []
    while True:
        us = F.unix_micros(time)
        marked = work.select("*", us.alias("_us"), F.struct(time, action).alias("_k"))
        prior = last_known(
            marked.withColumn("_r", F.lit(1)).unionByName(marked.withColumn("_r", F.lit(0))),
            [cell], time, [action, "_r"],
            # the _r = 0 copy reads what came before, the _r = 1 copy is what others see
            {"_locked": F.when((F.col("_r") == 1) & (F.col("_ok") == 1), F.col("_us")),
             "_open": F.when((F.col("_r") == 1) & F.col("_ok").isNull(), F.col("_us"))},
        ).where("_r = 0 AND _ok IS NULL")
        near = lambda c: F.coalesce(F.col("_us") - F.col(c) < wait, F.lit(False)).cast("int")
        verdict = prior.groupBy(action).agg(F.max(near("_locked")).alias("_l"), F.max(near("_open")).alias("_o"))
        verdict = verdict.select(action, F.when(F.col("_l") == 1, 0).when(F.col("_o") == 0, 1).alias("_new"))
        nxt = work.join(verdict, action, "left").select(
            action, cell, time, F.coalesce("_ok", "_new").alias("_ok"))
        nxt = durable(nxt)
        decided.append(nxt.where("_ok IS NOT NULL").select(action, F.col("_ok").alias("approved")).distinct())
        still = nxt.where("_ok IS NULL")
        if still.limit(1).count() == 0:
            break
        # an approval can still lock an open proposal of its cell only in the same or the next span of the lock's length
        span = F.floor(us / F.lit(max(wait, 1)))
        reached = still.select(F.col(cell).alias("_at"), F.explode(F.array(span, span - 1)).alias("_reach")).distinct()
        locks = nxt.where("_ok = 1").withColumn("_span", span).join(
            reached, F.col(cell).eqNullSafe(F.col("_at")) & (F.col("_span") == F.col("_reach")), "left_semi").drop("_span")
        work = durable(still.unionByName(locks))
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.distinct()


def two_hop_reach(edges: DataFrame, source: str, target: str, cells: DataFrame) -> DataFrame:
    """(cell, near) within two undirected hops, every cell near itself."""
    there = edges.select(F.col(source).alias("cell"), F.col(target).alias("near"))
    near = there.union(there.select("near", "cell").toDF("cell", "near")).distinct()
    onward = near.join(near.toDF("near", "_far"), "near").select("cell", F.col("_far").alias("near"))
    own = cells.select(F.col(cells.columns[0]).alias("cell"), F.col(cells.columns[0]).alias("near"))
    return near.union(onward).union(own).distinct()


def arbitration(proposals: DataFrame, reach: DataFrame, window: str, cell: str, tolerance: float = 0.05) -> DataFrame:
    """Outcome of competing proposals on cells in each other's reach within one window.

    ``proposals`` has id, safety (0/1), confidence and ts; ``reach`` lists (cell, near)
    up to two hops, the cell itself included.  A proposal is suspended by a rival of
    higher safety; else by one whose confidence is higher by more than ``tolerance``;
    else by a later one within the tolerance; one of the same instant within it asks
    for a human.  Differences are compared to nine decimals.

    Every proposal is shown once to each cell it reaches, and a cell's window is judged where its
    rows meet.  Only if one may hold more rows than a task takes, rivals within the tolerance
    come from a frame over confidence inside bands of that width, each row also shown
    to the bands beside its own, so that a busy cell is sorted by many tasks.
    """
    band = round(tolerance * 1e9)
    proposals = proposals.withColumn("_c", F.round(F.col("confidence") * 1e9).cast("bigint"))
    own = F.col(cell) == F.col("_at")
    rest = [c for c in proposals.columns if c not in ("id", "safety", "_c", "ts", window, cell)]
    shown = proposals.join(reach.select(F.col("near").alias(cell), F.col(cell).alias("_at")), cell).select(
        "id", "safety", "_c", "ts", window, "_at", own.alias("_own"), F.when(own, F.struct(F.lit(0), *rest)).alias("_rest"))
    busiest = proposals.groupBy(window, cell).count().agg(F.max("count")).first()[0] or 0
    widest = reach.groupBy(cell).count().agg(F.max("count")).first()[0] or 0
    out = (_meeting if busiest * widest <= rows_per_task(proposals.sparkSession) else _banded)(proposals, shown, window, cell, band)
    best = F.when(F.col("safety") == 1, F.col("_best_1")).otherwise(F.col("_best_0"))
    beaten = (F.col("_top") > F.col("safety")) | (best > F.col("_c") + band) | (F.col("_last.ts") > F.col("ts"))
    tied = F.col("_last.id") != -F.col("_first.id")
    verdict = F.when(F.col("_size") <= 1, "unopposed").when(beaten, "suspended").when(tied, "escalate").otherwise("proceed")
    return out.select(*[c for c in proposals.columns if c != "_c"], verdict.alias("verdict"))


def _meeting(proposals: DataFrame, shown: DataFrame, window: str, cell: str, band: int) -> DataFrame:
    """What each proposal sees at its own cell; all rows of a cell's window meet in one task."""
    here = Window.partitionBy(window, "_at")
    near = Window.partitionBy(window, "_at", "safety").orderBy("_c").rangeBetween(-band, band)
    seen = shown.withColumns({
        "_top": F.max("safety").over(here), "_size": F.count(F.lit(1)).over(here),
        **{f"_best_{s}": F.max(F.when(F.col("safety") == s, F.col("_c"))).over(here) for s in (0, 1)}})
    seen = seen.withColumns({
        "_last": F.max(F.struct("ts", "id")).over(near), "_first": F.max(F.struct("ts", (-F.col("id")).alias("id"))).over(near)})
    seen = seen.where("_own").withColumnRenamed("_at", cell)
    return seen.withColumns({c: F.col(f"_rest.{c}") for c in proposals.columns if c not in seen.columns})


def _banded(proposals: DataFrame, shown: DataFrame, window: str, cell: str, band: int) -> DataFrame:
    """``_meeting`` with the rows of a cell's window spread over bands of confidence."""
    shown = shown.drop("_rest")
    tops = shown.groupBy(window, F.col("_at").alias(cell)).agg(
        F.max("safety").alias("_top"), F.count(F.lit(1)).alias("_size"),
        F.count_if("_own").alias("_rows"),
        *[F.max(F.when(F.col("safety") == s, F.col("_c"))).alias(f"_best_{s}") for s in (0, 1)])
    strip = F.floor(F.col("_c") / band)
    spread = shown.withColumn("_band", F.explode(F.array(strip - 1, strip, strip + 1))).withColumn(
        "_home", F.col("_own") & (F.col("_band") == strip))
    near = Window.partitionBy(window, "_at", "safety", "_band").orderBy("_c").rangeBetween(-band, band)
    latest = F.struct("ts", "id")
    seen = spread.select(
        "id", window, F.col("_at").alias(cell), "_home", F.max(latest).over(near).alias("_last"),
        F.max(F.struct("ts", (-F.col("id")).alias("id"))).over(near).alias("_first")).where("_home").drop("_home")
    around = proposals.join(seen.select("id", F.col(cell).alias("_cell"), "_last", "_first"), "id").drop("_cell")
    return attach(around, tops, [window, cell], rows="_rows")


SEMVER = r"^(\d+)\.(\d+)\.(\d+)(-[A-Za-z0-9.]+)?$"


def version_key(version: Column) -> Column:
    """(major, minor, patch), NULL when the text is not a semantic version."""
    ok = F.rlike(version, F.lit(SEMVER))
    # an unmatched group is empty text, which ANSI would refuse to cast
    part = lambda i: F.nullif(F.regexp_extract(version, SEMVER, i), F.lit("")).cast("int")
    return F.when(ok, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compatible_releases(catalogue: DataFrame, current: str) -> DataFrame:
    """Safe upgrade targets of ``current``; the catalogue has version, blocked, blocklist, cross_major_allowed, allow_skip."""
    import re

    match = re.match(SEMVER, current.strip())
    if not match:
        raise ValueError(f"{current!r} is not a semantic version")
    now = [int(match.group(i)) for i in (1, 2, 3)]
    df = catalogue.withColumn("_v", version_key(F.trim("version"))).where(F.col("_v").isNotNull())
    v = F.col("_v")
    newer = v > F.struct(*[F.lit(n).alias(k) for n, k in zip(now, ("major", "minor", "patch"))])
    same = v["major"] == now[0]
    ok = ~F.coalesce("blocked", F.lit(False)) & ~F.coalesce(F.array_contains("blocklist", current), F.lit(False))
    reach = F.when(same, (v["minor"] - now[1] <= 1) | F.coalesce("allow_skip", F.lit(False))).otherwise(
        F.coalesce("cross_major_allowed", F.lit(False)))
    return df.where(newer & ok & reach).orderBy("_v").drop("_v")


def budget_breach(tier: Column, latency: Column) -> Column:
    budget = F.element_at(F.create_map(*[x for k, v in LATENCY_BUDGET_MS.items() for x in (F.lit(k), F.lit(v))]), tier)
    return (latency > budget).cast("int")


def valid_namespace(name: Column) -> Column:
    return F.split(name, r"\.")[0].isin(*SQUADS).cast("int")


def denied_reads(reads: DataFrame, grants: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup_join(reads, grants.select(*keys).distinct(), keys, "left_anti")


# Lowest autonomy level per tool type.
TOOL_LEVEL = {"telemetry": 0, "narration": 1, "simulation": 2, "reversible": 3, "irreversible": 5}


def loop_state(daily: DataFrame, cluster: str, day: str) -> DataFrame:
    """7-day rolling F1 per cluster from daily counts; below the limit the loop is suspended."""
    over = Window.partitionBy(cluster).orderBy(F.unix_date(day)).rangeBetween(-6, 0)
    tp, fp, fn = (F.sum(c).over(over) for c in ("tp", "fp", "fn"))
    f1 = F.coalesce(2.0 * tp / F.nullif((2 * tp + fp + fn).cast("double"), F.lit(0.0)), F.lit(0.0))
    return daily.withColumn("rolling_f1", f1).withColumn(
        "loop_state", F.when(F.col("rolling_f1") < LOOP_F1, "SUSPENDED").otherwise("ENABLED"))


def tool_permitted(tool: Column, level: Column, state: Column) -> Column:
    """Write tools need an enabled loop as well as the level."""
    need = F.element_at(F.create_map(*[x for k, v in TOOL_LEVEL.items() for x in (F.lit(k), F.lit(v))]), tool)
    return ((level >= need) & ((need < 3) | (state == "ENABLED"))).cast("int")


def plan_gate(proposals: DataFrame, projected: DataFrame, cell: str, max_delta: dict[str, float]) -> DataFrame:
    """All four conditions of a plan; ``projected`` has (cell, affected, d_handover) within two hops."""
    worst = projected.groupBy(cell).agg(F.min("d_handover").alias("worst_handover"), F.count(F.lit(1)).alias("_n"))
    out = proposals.join(worst, cell, "left")
    cap = F.element_at(F.create_map(*[x for k, v in max_delta.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("tool"))
    checks = {
        "confident": F.col("confidence") >= ROOT_CONFIDENCE,
        "harmless": F.coalesce(F.col("worst_handover"), F.lit(0.0)) >= -MAX_HANDOVER_DROP,
        "permitted": ~F.startswith(F.col("path"), F.lit("DENIED")),
        "bounded": F.abs("delta") <= F.coalesce(cap, F.lit(0.0)),
    }
    every = F.lit(True)
    for c in checks.values():
        every = every & F.coalesce(c, F.lit(False))
    return out.select(*proposals.columns, *[c.cast("int").alias(n) for n, c in checks.items()], every.cast("int").alias("go"))


def deployment_stage(labels: Column) -> Column:
    """Stage by number of labels; below the first tier only labels are collected."""
    return (F.when(labels >= 200, 4).when(labels >= 80, 3).when(labels >= 40, 2).otherwise(1))


def stage_gate(stage: Column, agreement: Column, node_auc: Column, top1: Column, baseline: Column, escalation: Column) -> Column:
    full = (node_auc >= 0.80) & (top1 >= F.greatest(baseline + 0.10, F.lit(0.60))) & (escalation <= 0.05)
    return (F.when(stage == 1, False).when(stage == 2, agreement >= 0.55).when(stage == 3, node_auc >= 0.78).otherwise(full)).cast("int")


# Breaker settings.
FAILURES, SUCCESSES, OPEN_SECONDS, SLOW_MS, ERROR_RATE, RESULTS = 5, 3, 60.0, 500.0, 0.30, 20


class Breaker:
    """State of one endpoint; small enough to travel as text between chunks."""

    def __init__(self, text: str | None = None):
        parts = (text or "C|0|0||").split("|")
        self.state, self.fails, self.wins = parts[0], int(parts[1]), int(parts[2])
        self.failed_at = float(parts[3]) if parts[3] else None
        self.results = [c == "1" for c in parts[4]]

    def dump(self) -> str:
        at = "" if self.failed_at is None else repr(self.failed_at)
        return f"{self.state}|{self.fails}|{self.wins}|{at}|{''.join('1' if r else '0' for r in self.results)}"

    def call(self, at: float, ok: bool) -> tuple[str, bool]:
        """State seen by the call and whether the primary was tried."""
        if self.state == "O" and at - self.failed_at >= OPEN_SECONDS:
            self.state, self.wins = "H", 0
        seen = self.state
        if seen == "O":
            return seen, False
        self.results = [*self.results, ok][-RESULTS:]
        if ok:
            self.fails = 0
            if seen == "H":
                self.wins += 1
                if self.wins >= SUCCESSES:
                    self.state = "C"
            return seen, True
        self.fails, self.failed_at = self.fails + 1, float(at)
        full = len(self.results) == RESULTS
        if self.fails >= FAILURES or (full and self.results.count(False) / RESULTS >= ERROR_RATE):
            self.state = "O"
        return seen, True


def breaker_timeline(calls: DataFrame, endpoint: str, time: str, tie: str, ok: str) -> DataFrame:
    """Breaker state before and after every call of an endpoint.

    The machine is sequential, but a busy endpoint is cut into time segments that run
    in parallel from a guessed start state.  Segments whose true start differs from
    the guess run again until every start equals its predecessor's end.
    """
    parts = split(calls.select(endpoint, time, tie, ok), [endpoint], time, ties=[tie])
    rows = parts.df.drop("_halo") if parts.is_split else parts.df.withColumn(SEGMENT, F.lit(0))
    rows = rows.withColumn("_at", F.unix_micros(time) / 1e6)
    types = dict(calls.dtypes)
    schema = (f"{endpoint} {types[endpoint]}, {SEGMENT} int, {tie} {types[tie]}, state_before string, tried int, "
              "state_after string, _end string")
    names = {"C": "closed", "O": "open", "H": "half_open"}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_at", tie], kind="stable")
        machine = Breaker(pdf["_start"].iloc[0])
        before, tried, after = [], [], []
        for at, good in zip(pdf["_at"], pdf[ok]):
            seen, used = machine.call(at, bool(good))
            before.append(names[seen])
            tried.append(int(used))
            after.append(names[machine.state])
        out = pd.DataFrame({endpoint: pdf[endpoint], SEGMENT: pdf[SEGMENT], tie: pdf[tie],
                            "state_before": before, "tried": tried, "state_after": after})
        out["_end"] = None
        out.loc[out.index[-1], "_end"] = machine.dump()
        return out

    keys = [endpoint, SEGMENT]
    fresh = Breaker().dump()
    if not parts.is_split:
        done = rows.withColumn("_start", F.lit(fresh)).groupBy(*keys).applyInPandas(run, schema)
        return done.drop(SEGMENT, "_end")
    rows = durable(rows)
    starts = durable(rows.select(*keys).distinct().withColumn("_start", F.lit(fresh)))
    done = durable(rows.join(starts, keys).groupBy(*keys).applyInPandas(run, schema))
    while True:  # every round settles at least the first unsettled segment of an endpoint
        ends = done.where(F.col("_end").isNotNull()).select(*keys, "_end")
        before = Window.partitionBy(endpoint).orderBy(SEGMENT)
        true_starts = ends.withColumn("_true", F.coalesce(F.lag("_end").over(before), F.lit(fresh))).drop("_end")
        wrong = durable(true_starts.join(starts, keys).where("_true <> _start").select(*keys, F.col("_true").alias("_start")))
        if wrong.limit(1).count() == 0:
            return done.drop(SEGMENT, "_end")
        again = rows.join(wrong, keys).groupBy(*keys).applyInPandas(run, schema)
        done = durable(done.join(wrong.select(*keys), keys, "left_anti").unionByName(again))
        starts = durable(starts.join(wrong.select(*keys), keys, "left_anti").unionByName(wrong))
