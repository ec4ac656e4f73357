"""A resumable work ledger: what has been scanned, up to where, by which rules.

Two small tables, ``work`` (a row per source) and ``phases`` (a row per source and
phase). Each transition maps the tables to their next state in one pass; a single
writer overwrites them, so there is no concurrency to control. Transitions are
guarded: results of an older epoch, or of cancelled work, change nothing. Time is
always given, never read from the clock.

``work``: source_id, status, watermark, ruleset_version, epoch, retry, started_at,
finished_at, reason. ``phases``: source_id, phase, status, target, completed,
ruleset_version, epoch, retry, started_at, finished_at, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.tables import stored

WORK = "source_id long, status string, watermark string, ruleset_version string, epoch int, retry int, started_at timestamp, finished_at timestamp, reason string"
PHASES = "source_id long, phase string, status string, target string, completed string, ruleset_version string, epoch int, retry int, started_at timestamp, finished_at timestamp, reason string"
# States, phases, the target that any head result answers, and the
# reason that is not tried again.
WORK_STATES = ("pending", "in_progress", "done", "failed", "cancelled")
PHASE_STATES = ("pending", "running", "done", "incomplete", "failed", "cancelled")
PHASE_NAMES = ("head", "history")
ANY_TARGET, GONE = "latest", "repository_unavailable"
BUDGET_REASON = "scan_cache_budget_exceeded"


def _changed(df: DataFrame, hit: Column, **values) -> DataFrame:
    """Rows that are hit get the values; a null hit is no hit."""
    at = F.coalesce(hit, F.lit(False))
    made = {c: F.when(at, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}
    return df.withColumns(made)


def _is(source_id: int, phase: str | None = None) -> Column:
    hit = F.col("source_id") == source_id
    return hit if phase is None else hit & (F.col("phase") == phase)


def add(work: DataFrame, arriving: DataFrame) -> DataFrame:
    """Sources that the ledger does not know are added as pending."""
    new = arriving.select(F.col("source_id").cast("long")).where("source_id is not null").distinct().join(work, "source_id", "left_anti")
    values = {"status": "pending", "epoch": 0, "retry": 0}
    return work.unionByName(new.select(*[F.col("source_id") if f.name == "source_id" else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in work.schema]))


def start(work: DataFrame, source_ids: DataFrame, epoch: int, as_of: str, restart_cancelled: bool = False) -> DataFrame:
    """Given sources are in progress, unless the ledger has a newer epoch of them or
    they were cancelled in this one. Unknown sources are added."""
    work = add(work, source_ids)
    asked = work.join(source_ids.select("source_id").distinct(), "source_id", "left_semi").select("source_id", F.lit(True).alias("_asked"))
    rows = work.join(asked, "source_id", "left")
    stale = (F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("status") == "cancelled") & F.lit(not restart_cancelled))
    out = _changed(rows, F.col("_asked") & ~stale, status="in_progress", started_at=as_of, epoch=epoch)
    return out.select(*work.columns)


def claim(work: DataFrame, k: int, epoch: int, as_of: str) -> DataFrame:
    """The first ``k`` pending sources by epoch 0 first (new ones), then id, are in
    progress. A top-k, not a full sort."""
    order = [F.when(F.col("started_at").isNull(), 0).otherwise(1), F.col("source_id")]
    first = work.where((F.col("status") == "pending") & (F.col("epoch") <= epoch)).orderBy(*order).limit(k).select("source_id")
    return start(work, first, epoch, as_of)


def schedule(phases: DataFrame, work: DataFrame, source_id: int, phase: str, target: str, epoch: int = 0) -> DataFrame:
    """The phase is pending for a target, unless its source has a newer epoch or was
    cancelled in this one; a cancelled phase is reopened only while its source is in
    progress."""
    parent = work.where(_is(source_id)).select(F.col("source_id").alias("_id"), F.col("epoch").alias("_epoch"), F.col("status").alias("_status"))
    blocked = (F.col("_epoch") > epoch) | ((F.col("_epoch") == epoch) & (F.col("_status") == "cancelled"))
    new = work.sparkSession.createDataFrame([(source_id, phase)], "source_id long, phase string")
    new = new.join(phases, ["source_id", "phase"], "left_anti").join(parent, F.col("source_id") == F.col("_id"), "left").where(~F.coalesce(blocked, F.lit(False)))
    values = {"status": "pending", "target": target, "epoch": epoch, "retry": 0}
    made = new.select(*[F.col(f.name) if f.name in ("source_id", "phase") else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in phases.schema])
    rows = phases.join(parent, phases["source_id"] == F.col("_id"), "left")
    working = F.coalesce((F.col("_epoch") == epoch) & (F.col("_status") == "in_progress"), F.lit(False))
    shut = (F.col("epoch") == epoch) & (F.col("status") == "cancelled") & ~working
    hit = _is(source_id, phase) & (F.col("epoch") <= epoch) & ~F.coalesce(blocked, F.lit(False)) & ~shut
    out = _changed(rows, hit, status="pending", epoch=epoch, target=target, started_at=None, finished_at=None, reason=None)
    return out.select(*phases.columns).unionByName(made)


def claim_phase(phases: DataFrame, work: DataFrame, source_id: int, phase: str, target: str, epoch: int, as_of: str) -> DataFrame:
    """Pending to running, if target and epoch agree and the source has this epoch and
    is not cancelled."""
    alive = work.where(_is(source_id) & (F.col("epoch") == epoch) & (F.col("status") != "cancelled")).select(F.col("source_id").alias("_id")).distinct()
    rows = phases.join(alive, phases["source_id"] == F.col("_id"), "left")
    hit = _is(source_id, phase) & (F.col("target") == target) & (F.col("status") == "pending") & (F.col("epoch") == epoch) & F.col("_id").isNotNull()
    return _changed(rows, hit, status="running", started_at=as_of, finished_at=None, reason=None).select(*phases.columns)


def _running(source_id: int, phase: str, target: str, epoch: int) -> Column:
    wanted = F.col("target").isin(target, ANY_TARGET) if phase == "head" else F.col("target") == target
    return _is(source_id, phase) & (F.col("status") == "running") & (F.col("epoch") == epoch) & wanted


def finish_phase(
    phases: DataFrame, work: DataFrame, source_id: int, phase: str, status: str, target: str, epoch: int, as_of: str, completed: str | None = None, version: str | None = None, reason: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """A running phase ends as done, incomplete, failed or cancelled; both tables'
    next states. A head phase passes its end on to its source: done moves the
    watermark, failed counts a try."""
    hit = _running(source_id, phase, target, epoch)
    failed = status == "failed"
    ended = phases.where(F.coalesce(hit, F.lit(False))).select(F.col("source_id").alias("_id")).distinct()
    values = {"status": status, "target": target, "finished_at": as_of, "reason": None if status == "done" else reason}
    if status == "done":
        values |= {"completed": completed, "ruleset_version": version}
    after = _changed(phases, hit, **values, retry=F.col("retry") + int(failed))
    if phase != "head":
        return after, work
    rows = work.join(ended, work["source_id"] == F.col("_id"), "left")
    own = F.col("_id").isNotNull() & (F.col("epoch") == epoch) & (F.col("status") != "cancelled")
    if status == "done":
        passed = {"status": "done", "watermark": completed, "ruleset_version": version, "finished_at": as_of, "reason": None}
    elif status == "cancelled":
        passed = {"status": "cancelled"}
    else:
        passed = {"status": "failed", "reason": reason}
    return after, _changed(rows, own, **passed, retry=F.col("retry") + int(failed)).select(*work.columns)


def cancel_before(phases: DataFrame, work: DataFrame, epoch: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Unfinished work of older epochs is cancelled, without counting a try."""
    older = F.col("epoch") < epoch
    after = _changed(phases, older & F.col("status").isin("pending", "running"), status="cancelled", finished_at=as_of, reason="scan_cancelled")
    return after, _changed(work, older & F.col("status").isin("pending", "in_progress"), status="cancelled")


def requeue_stale(work: DataFrame, timeout_s: int, as_of: str) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(secs=F.lit(timeout_s))
    return _changed(work, (F.col("status") == "in_progress") & (F.col("started_at") < cutoff), status="pending")


def requeue_failed(work: DataFrame, most_retries: int) -> DataFrame:
    """Failed work with tries left is pending again; work whose source is gone is not,
    and neither is work without a reason (a null is not known to differ)."""
    return _changed(work, (F.col("status") == "failed") & (F.col("retry") < most_retries) & (F.col("reason") != GONE), status="pending")


def claimable(phases: DataFrame, work: DataFrame, phase: str, epoch: int) -> DataFrame:
    """Pending phases of one kind whose source has the same epoch, the control's, and
    is not cancelled; by source."""
    alive = work.where((F.col("epoch") == epoch) & (F.col("status") != "cancelled")).select("source_id", "epoch")
    return phases.where((F.col("phase") == phase) & (F.col("status") == "pending")).join(alive, ["source_id", "epoch"]).select("source_id", "phase", "target", "epoch")


def with_phases(sources: DataFrame, phases: DataFrame) -> DataFrame:
    """Sources with the state of both phases: ``head_status, head_completed,
    history_status, history_completed``, null where a phase is not known. The phases
    are folded to a row per source first, so it is one join."""
    folded = phases.groupBy("source_id").agg(*[F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{c}") for p in PHASE_NAMES for c in ("status", "completed")])
    return sources.join(folded, "source_id", "left")


def queue_status(work: DataFrame) -> DataFrame:
    """One row: how many sources wait, by being new or tried before, and each state's count."""
    waits = F.col("status") == "pending"
    new = F.count_if(waits & F.col("started_at").isNull()).alias("new")
    return work.agg(new, F.count_if(waits & F.col("started_at").isNotNull()).alias("again"), *[F.count_if(F.col("status") == s).alias(s) for s in WORK_STATES])


def within_budget(rows: DataFrame, size: str, budget: int, sequence: str = "seq", bucket: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Rows of each source, in sequence, up to a budget of summed sizes, and
    ``(source_id, status, reason, scanned)``: ``incomplete`` for a source whose rows
    go beyond it, else ``done``.

    Sizes are summed by buckets of the sequence, and only the bucket in which a budget
    ends is ordered, so a source may have any number of rows.
    """
    at = F.floor(F.col(sequence) / bucket)
    sums = rows.groupBy("source_id", at.alias("_bucket")).agg(F.sum(size).alias("_sum"))
    order = Window.partitionBy("source_id").orderBy("_bucket")
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.withColumns({"_before": before, "_after": F.sum("_sum").over(order)}).where(F.col("_before") <= budget), "budget")
    placed = rows.withColumn("_bucket", at).join(sums, ["source_id", "_bucket"])
    inside, cut = placed.where(F.col("_after") <= budget), placed.where(F.col("_after") > budget)
    upto = F.sum(size).over(Window.partitionBy("source_id").orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_upto", upto + F.col("_before")).where(F.col("_upto") <= budget).drop("_upto")
    kept = inside.unionByName(cut).select(*rows.columns)
    over = F.max(F.col("_after") > budget)
    ended = sums.groupBy("source_id").agg(F.when(over, "incomplete").otherwise("done").alias("status"), F.when(over, BUDGET_REASON).alias("reason"))
    scanned = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("scanned"))
    return kept, ended.join(scanned, "source_id", "left").withColumn("scanned", F.coalesce("scanned", F.lit(0)))


def seeded(work: DataFrame) -> DataFrame:
    """Done phases of sources that were done before there were phases."""
    known = work.where("status = 'done' and watermark is not null and ruleset_version is not null")
    names = F.explode(F.array(*[F.lit(p) for p in PHASE_NAMES])).alias("phase")
    rows = known.select("source_id", names, "watermark", "ruleset_version", "epoch", "started_at", "finished_at")
    return rows.select(
        "source_id", "phase", F.lit("done").alias("status"), F.col("watermark").alias("target"), F.col("watermark").alias("completed"), "ruleset_version", "epoch", F.lit(0).alias("retry"), "started_at", "finished_at", F.lit(None).cast("string").alias("reason")
    )


def to_scan(rows: DataFrame, work: DataFrame, version: str, sequence: str = "seq") -> DataFrame:
    """Rows not yet scanned: those past the watermark of their source under the same
    rules, and all rows of sources without one or with other rules."""
    marks = work.where(F.col("watermark").isNotNull() & (F.col("ruleset_version") == version)).select("source_id", F.col("watermark").cast("long").alias("_mark"))
    return rows.join(marks, "source_id", "left").where(F.col("_mark").isNull() | (F.col(sequence) > F.col("_mark"))).select(*rows.columns)


def control(state: dict, action: str, as_of: str | None = None, epoch: int | None = None) -> dict:
    """Next control record of ready → stopping → stopped → ready. A stop opens a new
    epoch; work is admitted unless a stop is under way; a record that makes no
    sense is refused."""
    now, at = state.get("state"), state.get("epoch")
    if now not in ("ready", "stopping", "stopped") or not isinstance(at, int) or at < 0:
        raise ValueError("control record is unusable")
    if now != "ready" and state.get("stop_epoch") != at:
        raise ValueError("control record is unusable")
    if action == "admit":
        if now == "stopping":
            raise RuntimeError("a stop is under way")
        return state | {"state": "ready"}
    if action == "stop":
        return state if now != "ready" else {"state": "stopping", "epoch": at + 1, "stop_epoch": at + 1, "requested_at": as_of, "finished_at": None}
    if action == "finish":
        return state | {"state": "stopped", "finished_at": as_of} if now == "stopping" and epoch == at else state
    raise ValueError(f"unknown action: {action}")
