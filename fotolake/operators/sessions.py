"""Activity sessions by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.runtime import cut

DAY = 86_400
#: Cameras with a rule of their own that go to all workers at once at most; beyond it the planner joins by shuffle.
MAX_RULES = 100_000


def camera_key(col: str | Column) -> Column:
    """Camera name as compared: lower case, no outer white space; blank counts as absent."""
    c = F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), r"^\s+|\s+$", "")
    return F.when(c != "", c)


def session_events(events: DataFrame, camera: str, time_s: str, event_id: str) -> DataFrame:
    """The events that count, as (camera, t, n): n distinct ids per camera and second."""
    e = events.select(camera_key(camera).alias("camera"), F.col(time_s).cast("long").alias("t"), F.col(event_id).alias("_id"))
    e = e.where("camera is not null and t > 0 and _id is not null").distinct()
    return e.groupBy("camera", "t").agg(F.count(F.lit(1)).alias("n"))


def with_window(nodes: DataFrame, config: DataFrame | None, default_window: int) -> DataFrame:
    """Add the gap allowed per camera (`w`), from `config(camera_model, burst_window_secs, profile)`.

    A config row without camera gives the default; where a camera is named twice the first profile
    by name holds; a null window falls back to the default, and without any default row
    `default_window` holds.
    """
    if config is None:
        return nodes.withColumn("w", F.lit(default_window).cast("long"))
    rules = config.select(camera_key("camera_model").alias("camera"), F.col("burst_window_secs").cast("long").alias("w"), "profile")
    rules = cut(rules.where("w is not null").groupBy("camera").agg(F.min_by("w", "profile").alias("w")))
    fallback = rules.where("camera is null").agg(F.coalesce(F.max("w"), F.lit(default_window).cast("long")).alias("_d"))
    named = rules.where("camera is not null")
    if named.limit(MAX_RULES + 1).count() <= MAX_RULES:
        named = F.broadcast(named)  # a hot camera's rows then stay where they are
    out = nodes.join(named, "camera", "left").crossJoin(F.broadcast(fallback))  # one row: an aggregate without keys
    return out.withColumn("w", F.greatest(F.coalesce("w", "_d"), F.lit(0))).drop("_d")


def predecessor_links(nodes: DataFrame) -> DataFrame:
    """Link each (camera, t) to the latest earlier t of its camera within `w`, else to itself.

    Times are cut into slices of at least a day and at least the gap, so a predecessor within the
    gap lies in the same slice or the one before. A slice holds at most one node per second, which
    bounds each window group whatever the camera's share of the rows.
    """
    n = nodes.withColumn("_slice", F.expr(f"t div greatest(w, {DAY})"))
    inside = Window.partitionBy("camera", "_slice").orderBy("t")
    n = n.withColumn("_prev", F.lag("t").over(inside))
    last = n.groupBy("camera", "_slice").agg(F.max("t").alias("_last")).withColumn("_slice", F.col("_slice") + 1)
    n = n.join(last, ["camera", "_slice"], "left").withColumn("_prev", F.coalesce("_prev", "_last"))
    ptr = F.when(F.col("t") - F.col("_prev") <= F.col("w"), F.col("_prev")).otherwise(F.col("t"))
    return n.select("camera", "t", "n", ptr.alias("ptr"))


def resolve_roots(links: DataFrame) -> DataFrame:
    """Pointer doubling: (camera, t, n, ptr) to (camera, t, n, root).

    Each round replaces a pointer by the pointer's pointer until nothing moves; a chain of L events
    needs about log2 L rounds. Only nodes whose pointer has not reached a root stay on the left of
    the self-join: after k rounds those point exactly 2^k events back, so their join keys are
    distinct and no session, however long, becomes a hot key.
    """
    state = cut(links.withColumn("done", F.col("ptr") == F.col("t")))
    while not (active := state.where("not done")).isEmpty():
        targets = state.select("camera", F.col("t").alias("ptr"), F.col("ptr").alias("_next"))
        moved = active.join(targets, ["camera", "ptr"])
        moved = moved.select("camera", "t", "n", F.col("_next").alias("ptr"), (F.col("_next") == F.col("ptr")).alias("done"))
        state = cut(state.where("done").unionByName(moved))
    return state.select("camera", "t", "n", F.col("ptr").alias("root"))


def sessionize(events: DataFrame, config: DataFrame | None = None, *, camera: str = "camera_model", time_s: str = "date_taken", event_id: str = "id", default_window: int = 2) -> DataFrame:
    """Sessions per camera: camera, start_s, end_s, duration_s, n_shots.

    Events with a null or blank camera, a null id, or a null or non-positive time don't count;
    repeated rows count once; ids sharing a second belong to one session; an event without near
    neighbours is a session of one. An empty table gives no session. Other columns are ignored.
    """
    nodes = with_window(session_events(events, camera, time_s, event_id), config, default_window)
    rooted = resolve_roots(predecessor_links(nodes))
    s = rooted.groupBy("camera", "root").agg(F.max("t").alias("end_s"), F.sum("n").alias("n_shots"))
    return s.select("camera", F.col("root").alias("start_s"), "end_s", (F.col("end_s") - F.col("root")).alias("duration_s"), "n_shots")
