"""Per-agent quota and bounded first-in-first-out backlog of one drain interval, in closed form.

A batch is one fill of the queue followed by a drain. Nothing leaves within a batch, so the queue's state before an event
follows from ranks and running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.config import ForwardConfig
from palisade.operators.limiter import ARRIVAL, arrival_bounds, numbered
from palisade.reasons import outcome
from palisade.sources.shared import written

QUOTA, FULL = "DroppedAgentQuotaExceeded", "DroppedQueueFull"


def bound_backlog(df: DataFrame, batch: Column | str, config: ForwardConfig = ForwardConfig()) -> DataFrame:
    """Drop events beyond an agent's quota or the queue's depth; the quota is tested first, and an event that finds the
    queue full holds no place in its agent's. Adds ``batch`` and ``forwarded_order`` (1 for the first to leave a batch).
    Rows dropped before are not queued, but stay in the frame, dealt evenly; one shuffle by batch serves all that is counted."""
    dealt = F.when(F.col("drop_reason").isNotNull(), F.xxhash64(*ARRIVAL))
    df = df.withColumn("batch", batch if isinstance(batch, Column) else F.col(batch)).withColumn("_spread", dealt).repartition("batch", "_spread")
    by_agent, by_batch = W.partitionBy("batch", "_spread", "agent_id").orderBy(*ARRIVAL), W.partitionBy("batch", "_spread").orderBy(*ARRIVAL)
    so_far = W.unboundedPreceding, W.currentRow
    df = df.withColumn("_pass", within_quota(by_agent, config).cast("int"))
    df = df.withColumn("_place", F.sum("_pass").over(by_batch.rowsBetween(*so_far)))
    df = df.withColumn("_queued", ((F.col("_pass") == 1) & (F.col("_place") <= config.max_queue_depth)).cast("int"))
    df = df.withColumn("_held", F.coalesce(F.sum("_queued").over(by_agent.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    refused = F.when(F.col("_queued") == 0, F.when(F.col("_held") >= config.max_per_agent, F.lit(QUOTA)).otherwise(F.lit(FULL)))
    df = df.withColumn("forwarded_order", F.when(F.col("_queued") == 1, F.col("_place")))
    return outcome(df, "forward", refused).drop("_pass", "_place", "_queued", "_held", "_spread")


def within_quota(by_agent: W, config: ForwardConfig) -> Column:
    """Whether a row is alive and one of its agent's first ones that are."""
    alive = F.col("drop_reason").isNull()
    return alive & (F.sum(alive.cast("int")).over(by_agent.rowsBetween(W.unboundedPreceding, W.currentRow)) <= config.max_per_agent)


#: Rows of a range of arrival, and how many ranges there are at least and at most.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 20, 8, 1 << 12


def bound_large_backlog(df: DataFrame, config: ForwardConfig = ForwardConfig(), batch: Column | str | None = None, ranges: int | None = None, carried: DataFrame | None = None) -> DataFrame:
    """The same for intervals of any size (default: the frame is one), with ranks that are made of parts.

    Arrival is cut into ``ranges`` of like many rows. An agent's events are counted by range; running sums of the counts
    say with which rank each range begins, so a rank needs the rows of its own range only, and so does a place in
    the queue. No window is over all rows of an interval or of an agent: a hot agent is spread over as many tasks as
    there are ranges. The counts are put among the rows of their range, and nothing is joined by id, so rows that repeat
    an id or have none are rows as others. The rows are worked out once, into a table.

    ``carried`` (batch, agent_id, alive, queued): what came in and was queued of intervals that an earlier frame has begun
    (``carry_on``); their rows stand before all of this frame.
    """
    key = F.lit(0) if batch is None else batch if isinstance(batch, Column) else F.col(batch)
    df = written(df.withColumn("batch", key).withColumns({c: F.col(c).cast("long") for c in ARRIVAL}), "backlog")
    kind = df.schema["batch"].dataType
    n = df.count()
    bounds = arrival_bounds(df, ranges or min(max(LEAST_RANGES, n // RANGE_ROWS), MOST_RANGES), n)
    ranged = numbered(df, bounds).withColumn("_alive", F.col("drop_reason").isNull())
    counts = ranged.filter("_alive").groupBy("batch", "agent_id", "chunk").agg(F.count("*").alias("n")).withColumn("queued", F.lit(None).cast("long"))
    if carried is not None:
        counts = counts.unionByName(carried.select(F.col("batch").cast(kind), "agent_id", F.lit(-1).alias("chunk"), F.col("alive").alias("n"), "queued"))
    counts = written(counts, "counts")
    quota, depth = config.max_per_agent, config.max_queue_depth
    # with which rank an agent's events begin in a range, and with which place those of all agents
    earlier = W.partitionBy("batch", "agent_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.withColumn("passing", F.least(F.greatest(F.lit(quota) - F.col("rank"), F.lit(0)), F.col("n")))
    places = counts.groupBy("batch", "chunk").agg(F.sum("passing").alias("passing"))
    so_far = W.partitionBy("batch").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    places = places.withColumn("place", F.coalesce(F.sum("passing").over(so_far), F.lit(0)))
    marked = counts.drop("passing").join(places.withColumnRenamed("passing", "_in_range"), ["batch", "chunk"])
    # of an agent's places, how many are taken before a range: all in ranges that end within the depth, none past it, and
    # in the one range of an interval that reaches it as many as its rows say
    cut = (F.col("place") < depth) & (F.col("place") + F.col("_in_range") > depth) & (F.col("chunk") >= 0)
    taken = F.when(F.col("chunk") < 0, F.col("queued")).when(F.col("place") + F.col("_in_range") <= depth, F.least(F.greatest(F.lit(quota) - F.col("rank"), F.lit(0)), F.col("n"))).otherwise(F.lit(0))
    marked = written(marked.withColumns({"_cut": cut, "_taken": taken}), "marks")
    cuts = marked.filter("_cut").select("batch", "chunk").distinct()
    at_cut = placed(ranged.join(F.broadcast(cuts), ["batch", "chunk"], "left_semi"), marked.join(cuts, ["batch", "chunk"], "left_semi"), config)
    reached = at_cut.filter("_queued").groupBy("batch", "agent_id", "chunk").agg(F.count("*").alias("_reached"))
    marked = marked.join(reached, ["batch", "agent_id", "chunk"], "left").withColumn("_taken", F.col("_taken") + F.coalesce("_reached", F.lit(0)))
    marked = marked.withColumn("held", F.coalesce(F.sum("_taken").over(earlier), F.lit(0)))
    out = placed(ranged, marked, config)
    local = W.partitionBy("batch", "chunk", "agent_id").orderBy(F.col("_mark").desc(), *ARRIVAL)
    out = out.withColumn("_held", F.first("held").over(local) + F.coalesce(F.sum(F.col("_queued").cast("int")).over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.filter("not _mark")
    refused = F.when(~F.col("_queued"), F.when(F.col("_held") >= quota, F.lit(QUOTA)).otherwise(F.lit(FULL)))
    out = out.withColumn("forwarded_order", F.when(F.col("_queued"), F.col("_place")))
    return outcome(out, "forward", refused).select(*df.columns, "forwarded_order")


def placed(ranged: DataFrame, marked: DataFrame, config: ForwardConfig) -> DataFrame:
    """Rows, and the marks that their ranges' ranks and places begin with (``_mark``), with each row's place and whether it
    is queued: one shuffle, by interval and range."""
    marks = marked.filter("chunk >= 0").select("batch", "agent_id", "chunk", "rank", "place", *(c for c in ("held",) if c in marked.columns), F.lit(True).alias("_mark"), F.lit(False).alias("_alive"))
    rows = ranged.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True).repartition("batch", "chunk")
    first = F.col("_mark").desc()
    by_agent, by_range = W.partitionBy("batch", "chunk", "agent_id").orderBy(first, *ARRIVAL), W.partitionBy("batch", "chunk").orderBy(first, *ARRIVAL)
    until = W.unboundedPreceding, W.currentRow
    rank = F.first("rank").over(by_agent.rowsBetween(*until)) + F.sum(F.col("_alive").cast("int")).over(by_agent.rowsBetween(*until))
    rows = rows.withColumn("_pass", F.col("_alive") & (rank <= config.max_per_agent))
    place = F.first("place", ignorenulls=True).over(by_range.rowsBetween(*until)) + F.sum(F.coalesce(F.col("_pass"), F.lit(False)).cast("int")).over(by_range.rowsBetween(*until))
    rows = rows.withColumn("_place", place)
    return rows.withColumn("_queued", F.coalesce(F.col("_pass") & (F.col("_place") <= config.max_queue_depth), F.lit(False)))


def carry_on(bounded: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """(batch, agent_id, alive, queued, last): what came in of each agent's, was queued, and arrived last, until the end of a
    frame that ``bound_large_backlog`` has bounded, with what was ``carried`` into it."""
    came = bounded.filter(F.col("drop_reason").isNull() | (F.col("drop_stage") == "forward"))
    now = came.select("batch", "agent_id", F.lit(1).cast("long").alias("alive"), F.col("forwarded_order").isNotNull().cast("long").alias("queued"), F.col(ARRIVAL[0]).alias("last"))
    if carried is not None:
        now = now.unionByName(carried.select(F.col("batch").cast(bounded.schema["batch"].dataType), "agent_id", "alive", "queued", "last"))
    return now.groupBy("batch", "agent_id").agg(F.sum("alive").alias("alive"), F.sum("queued").alias("queued"), F.max("last").alias("last"))


def agent_stats(bounded: DataFrame) -> DataFrame:
    """(batch, agent_id, in_flight, quota_rejections): what each agent holds at the end of a batch's fill."""
    return bounded.filter(F.col("agent_id").isNotNull() & F.col("batch").isNotNull()).groupBy("batch", "agent_id").agg(
        F.count("forwarded_order").alias("in_flight"), F.count_if(F.col("drop_reason") == QUOTA).alias("quota_rejections")
    )


def batch_stats(bounded: DataFrame) -> DataFrame:
    """(batch, tracked_agents, total_in_flight, quota_rejections) of each batch."""
    by_batch = agent_stats(bounded).groupBy("batch")
    return by_batch.agg(F.count_if(F.col("in_flight") > 0).alias("tracked_agents"), F.sum("in_flight").alias("total_in_flight"), F.sum("quota_rejections").alias("quota_rejections"))
