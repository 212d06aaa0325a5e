"""Operators on append-only histories: contiguity, active sessions, as-of state, validity, transitions, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut


def with_sequence(events: DataFrame, project: str, *order: str, name: str = "sequence") -> DataFrame:
    """Number the events of each project from 1 in the given order, which must be total."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(project).orderBy(*order)).cast("long"))


def sequence_audit(events: DataFrame, project: str, sequence: str) -> DataFrame:
    """Per project: n_events, first and last sequence, n_broken (events whose sequence is not their place) and contiguous."""
    marked = events.select(project, F.col(sequence).cast("long").alias("s")).withColumn("place", F.row_number().over(Window.partitionBy(project).orderBy("s")).cast("long"))
    return marked.groupBy(project).agg(
        F.count("*").alias("n_events"), F.min("s").alias("first_sequence"), F.max("s").alias("last_sequence"), F.sum((F.col("s") != F.col("place")).cast("long")).alias("n_broken")
    ).withColumn("contiguous", F.col("n_broken") == 0)


def active_session(events: DataFrame, project: str, sequence: str, session: Column, starts: Column, name: str = "active_session") -> DataFrame:
    """The session that was started last before each event (null before the first)."""
    before = Window.partitionBy(project).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(starts, session), ignorenulls=True).over(before))


def session_violations(events: DataFrame, project: str, sequence: str, session: str, starts: Column) -> DataFrame:
    """Events outside the active session: other than starts, they must carry the session started last."""
    held = active_session(events, project, sequence, F.col(session), starts)
    return held.where(~starts & ~F.col(session).eqNullSafe(F.col("active_session")))


def as_of(events: DataFrame, sequence: str, through: int) -> DataFrame:
    """The prefix of a history up to a sequence, inclusive."""
    return events.where(F.col(sequence) <= through)


def latest_per(events: DataFrame, keys: Sequence[str], sequence: str, tombstone: Column | None = None) -> DataFrame:
    """The latest event of each key, without those that are tombstones.

    max_by over the whole row aggregates before the shuffle, where a window
    would move and sort every event.
    """
    row = F.struct(*[c for c in events.columns])
    dead = F.lit(False) if tombstone is None else tombstone
    last = events.groupBy(*keys).agg(F.max_by(F.struct(row.alias("row"), F.coalesce(dead, F.lit(False)).alias("dead")), sequence).alias("last"))
    return last.where(~F.col("last.dead")).select("last.row.*")


def validity(events: DataFrame, key: str, sequence: str, id_: str) -> DataFrame:
    """Closed-open validity of versions: each version of a key holds until the next one."""
    by = Window.partitionBy(key).orderBy(sequence, id_)
    return events.select("*", F.col(sequence).alias("valid_from"), F.lead(sequence).over(by).alias("valid_to"), F.lead(id_).over(by).alias("superseded_by"))


# What a memory of each type may become while it is active or in progress.
OPEN_STATUSES = ("active", "in_progress")
TRANSITIONS = {
    "goal": ("in_progress", "completed", "cancelled"), "task": ("in_progress", "completed", "cancelled"), "action": ("in_progress", "completed", "cancelled"),
    "blocker": ("resolved", "cancelled"), "question": ("resolved", "cancelled"),
    "decision": ("cancelled",), "constraint": ("cancelled",), "result": ("cancelled",), "artifact": ("cancelled",),
}


def transition_allowed(kind: Column, before: Column, after: Column) -> Column:
    """Whether a status change is valid."""
    allowed = F.lit(False)
    for name, targets in TRANSITIONS.items():
        allowed = F.when(kind == name, after.isin(*targets)).otherwise(allowed)
    return F.coalesce(before.isin(*OPEN_STATUSES) & (before != after) & allowed, F.lit(False))


def check_transition(kind: str, before: str, after: str) -> bool:
    return before in OPEN_STATUSES and before != after and after in TRANSITIONS[kind]


def missing_provenance(claims: DataFrame, sources: DataFrame, claim_key: str, source_key: str, earlier: Column) -> DataFrame:
    """Claims whose source does not exist, or is not earlier."""
    return claims.join(sources, (F.col(claim_key) == F.col(source_key)) & earlier, "left_anti")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, hops): everything reachable over edges (src, dst), by semi-naive rounds.

    seeds has `node`.  Only pairs found for the first time go into the next
    round; the number of rounds is the depth of the graph.
    """
    frontier = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0))
    found = frontier
    hop = 0
    while True:
        hop += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def diff_snapshots(previous: DataFrame, current: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """(key, state): added, changed, deleted or reused, by comparing the identity columns of two snapshots."""
    p = previous.select(F.col(key).alias("_p"), F.struct(*identity).alias("before"))
    c = current.select(F.col(key).alias("_c"), F.struct(*identity).alias("after"))
    state = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(F.col("before").eqNullSafe(F.col("after")), "reused").otherwise("changed")
    return p.join(c, F.col("_p") == F.col("_c"), "full_outer").select(F.coalesce("_c", "_p").alias(key), state.alias("state"))


def run_counters(log: DataFrame, run: str, state: str) -> DataFrame:
    """Per run: seen, changed (added too), deleted and unchanged (reused) of rows with such a state."""
    counts = {"changed": F.count_if(F.col(state).isin("changed", "added")), "deleted": F.count_if(F.col(state) == "deleted"), "unchanged": F.count_if(F.col(state) == "reused")}
    return log.groupBy(run).agg(F.count("*").alias("seen"), *[c.alias(n) for n, c in counts.items()])


def histogram(rows: DataFrame, category: str, categories: Sequence[str]) -> DataFrame:
    """Counts of all categories, also of those without rows."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(c,) for c in categories], f"{category} string")
    return every.join(rows.groupBy(category).agg(F.count("*").alias("n")), category, "left").select(category, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
