"""Joins in time and between hosts, sessions, process forest and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..adapters import DENSE, SEC, dense_events, security_events, table
from ..store import stored


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: float, after: float) -> DataFrame:
    """Pairs of equal keys with right_ts in [left_ts - before, left_ts + after] (seconds).

    An equi join on buckets as wide as the interval: the right side stands in its own bucket, the left
    side is replicated to the buckets that its interval meets (three at most). No nested loop.
    """
    width = int(max(before + after, 1) * 1_000_000)
    bucket = lambda m: ((m - F.pmod(m, F.lit(width))) / width).cast("long")  # noqa: E731  whole microseconds: no border is missed by rounding
    right = right.withColumn("_bucket", bucket(F.unix_micros(right_ts)))
    first, last = bucket(F.unix_micros(left_ts) - int(before * 1_000_000)), bucket(F.unix_micros(left_ts) + int(after * 1_000_000))
    left = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    gap = F.unix_micros(right_ts) - F.unix_micros(left_ts)
    return left.join(right, [*keys, "_bucket"]).where(gap.between(-int(before * 1_000_000), int(after * 1_000_000))).drop("_bucket")


def any_near(rows: DataFrame, others: DataFrame, within: float) -> DataFrame:
    """The rows that have one of ``others`` within some seconds, by the microseconds ``m`` of both.

    Slots are as wide as the time: any other in a row's own slot is near, of the slots beside it the last and the first one
    tell. One row a slot is joined, so the work doesn't grow with the pairs.
    """
    width = int(within * 1_000_000)
    slot = ((F.col("m") - F.pmod("m", F.lit(width))) / width).cast("long")
    ends = others.select(slot.alias("slot"), "m").groupBy("slot").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    beside = F.explode(F.array(*[F.struct((F.col("slot") + k).alias("slot"), (F.col("first") if k <= 0 else F.lit(None)).alias("first"), (F.col("last") if k >= 0 else F.lit(None)).alias("last"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)]))
    ends = ends.select(beside.alias("x")).select("x.*").groupBy("slot").agg(F.bool_or("own").alias("_own"), F.min(F.when(~F.col("own"), F.col("first"))).alias("_next"), F.max(F.when(~F.col("own"), F.col("last"))).alias("_before"))
    near = F.col("_own") | F.coalesce(F.col("_next") - F.col("m") <= width, F.lit(False)) | F.coalesce(F.col("m") - F.col("_before") <= width, F.lit(False))
    return rows.withColumn("slot", slot).join(ends, "slot").where(near).drop("slot", "_own", "_next", "_before")


def asof_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The latest start of the parent's pid on the same host strictly before each child's, by one sorted pass."""
    p = parents.select("host", F.col("pid").alias("key"), "ts", F.lit(0).alias("is_child"), "id", F.lit(None).cast("long").alias("pid"))
    c = children.select("host", F.col("ppid").alias("key"), "ts", F.lit(1).alias("is_child"), "id", "pid")
    # children come before parents of the same time, so a parent has to be earlier
    w = W.partitionBy("host", "key").orderBy("ts", F.desc("is_child"), "id").rowsBetween(W.unboundedPreceding, -1)
    both = p.unionByName(c).withColumn("parent_id", F.last(F.when(F.col("is_child") == 0, F.col("id")), ignorenulls=True).over(w))
    return both.where("is_child = 1").select(F.col("id").alias("child_id"), "parent_id")


def process_starts(ev: DataFrame) -> DataFrame:
    """Process creations of either sensor; of two with the same host, pid and second the lower code stays."""
    p = ev.where("event_code IN (1, 4688)").select(F.col("row_id").alias("id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("ts"), F.col("process_id").alias("pid"), F.col("parent_process_id").alias("ppid"), "event_code", "process_name", "parent_process_name", "command_line", "username")
    w = W.partitionBy("host", "pid", F.rint(seconds(F.col("ts")))).orderBy("event_code", "id")
    return p.withColumn("nr", F.row_number().over(w)).where("nr = 1").drop("nr")


def edges(ev: DataFrame) -> DataFrame:
    p = process_starts(ev)
    return asof_parent(p, p).where("parent_id IS NOT NULL")


def classify(pairs: DataFrame) -> DataFrame:
    """Parent and child names: a pair known as bad, a parent that rarely starts others, expected, or unusual."""
    spark = pairs.sparkSession
    bad = F.broadcast(spark.createDataFrame(rules.BAD_PAIRS, "parent string, child string").withColumn("bad", F.lit(True)))
    fine = F.broadcast(spark.createDataFrame([(p, c) for c, ps in rules.EXPECTED_PARENTS.items() for p in ps], "parent string, child string").withColumn("fine", F.lit(True)))
    j = pairs.join(bad, ["parent", "child"], "left").join(fine, ["parent", "child"], "left")
    return j.withColumn("class", F.when(F.col("bad"), "HIGHLY_SUSPICIOUS").when(F.col("parent").isin(rules.RARE_PARENTS), "SUSPICIOUS").when(F.col("fine"), "EXPECTED").otherwise("UNUSUAL")).drop("bad", "fine")


def forest(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Root and depth of each node, by doubling: each round follows the ancestor found so far to its own."""
    up = nodes.select("id").join(edge.select(F.col("child_id").alias("id"), "parent_id"), "id", "left")
    state = stored(up.select("id", F.coalesce("parent_id", "id").alias("top"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")))
    while True:
        next_ = state.join(state.select(F.col("id").alias("top"), F.col("top").alias("far"), F.col("depth").alias("more")), "top").select("id", F.col("far").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("far") != F.col("top")).alias("moved"))
        next_ = stored(next_, over=state)
        if next_.where("moved").isEmpty():
            return next_.select("id", F.col("top").alias("root"), "depth")
        state = next_.drop("moved")
        state._stored_at = next_._stored_at


def trees(ev: DataFrame) -> DataFrame:
    """One row for each tree: nodes, depth, edges, processes, users and span in seconds."""
    p = process_starts(ev)
    f = forest(edges(ev), p).join(p, "id")
    t = f.groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").cast("long").alias("max_depth"), F.countDistinct("process_name").alias("processes"), F.countDistinct("username").alias("users"), F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, 3).alias("span"))
    return t.withColumn("edges", F.col("nodes") - 1)


def tree_scores(ev: DataFrame) -> DataFrame:
    p = process_starts(ev)
    e = edges(ev)
    names = p.select("id", "process_name")
    pair = e.join(names.select(F.col("id").alias("child_id"), F.col("process_name").alias("child")), "child_id").join(names.select(F.col("id").alias("parent_id"), F.col("process_name").alias("parent")), "parent_id")
    points = classify(pair).select(F.col("child_id").alias("id"), F.when(F.col("class") == "HIGHLY_SUSPICIOUS", 10).when(F.col("class") == "SUSPICIOUS", 5).otherwise(0).alias("points"))
    f = forest(e, p).join(points, "id", "left")
    return f.groupBy("root").agg(F.sum(F.coalesce("points", F.lit(0))).alias("s"), F.max("depth").alias("m")).where("s > 0").select("root", (F.col("s") * (F.col("m") + 1)).cast("long").alias("score"))


def ancestors(ev: DataFrame, levels: int = 3) -> DataFrame:
    """Up to three levels of parents of each process."""
    e = edges(ev)
    step = e.select(F.col("child_id").alias("id"), F.col("parent_id").alias("ancestor"), F.lit(1).alias("level"))
    out = step
    for level in range(2, levels + 1):
        step = step.join(e.select(F.col("child_id").alias("ancestor"), F.col("parent_id").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(level).alias("level"))
        out = out.unionByName(step)
    return out.withColumn("level", F.col("level").cast("long"))


def sessions(ev: DataFrame, keys: list[str], gap: float = 1800) -> DataFrame:
    """Runs of events of a key without a pause over half an hour (a pause of just that stays inside)."""
    w = W.partitionBy(*keys).orderBy("timestamp_utc", "row_id")
    e = ev.withColumn("fresh", F.coalesce((F.unix_micros("timestamp_utc") - F.unix_micros(F.lag("timestamp_utc").over(w)) > int(gap * 1_000_000)).cast("int"), F.lit(1)))
    return e.withColumn("session", F.sum("fresh").over(w))


def session_table(ev: DataFrame) -> DataFrame:
    keys = ["source_system", "username"]
    s = sessions(ev, keys).groupBy(*keys, "session")
    out = s.agg(F.min("timestamp_utc").alias("start"), F.max("timestamp_utc").alias("end"), F.count("*").alias("n"), F.countDistinct("process_name").alias("processes"), F.countDistinct("dest_ip").alias("ips"))
    return out.withColumn("duration", (F.unix_micros("end") - F.unix_micros("start")) / 1e6)


def session_intent(ev: DataFrame) -> DataFrame:
    keys = ["source_system", "username"]
    low = F.lower("command_line")
    tags = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)), F.lit(tag)) for tag, words in rules.INTENTS.items()]))
    s = sessions(ev, keys).withColumn("tag", F.explode_outer(tags)).groupBy(*keys, "session").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("intent"))
    return s.withColumn("intent", F.when(F.col("intent") == "", "UNKNOWN").otherwise(F.col("intent")))


def time_gaps(ev: DataFrame, over: float = 900) -> DataFrame:
    """Pauses in the whole event stream. Days are ordered apart; each day's last event is then joined with
    the next day's first, so no task sees the whole stream."""
    e = ev.select("row_id", "timestamp_utc", "event_type").withColumn("day", F.to_date("timestamp_utc"))
    w = W.partitionBy("day").orderBy("timestamp_utc", "row_id")
    inner = e.withColumns({"before_ts": F.lag("timestamp_utc").over(w), "before_type": F.lag("event_type").over(w)})
    edge = e.groupBy("day").agg(F.max(F.struct("timestamp_utc", "row_id", "event_type")).alias("l"))
    days = edge.select(F.lead("day").over(W.orderBy("day")).alias("day"), "l")  # a row for each day
    first = inner.where("before_ts IS NULL").drop("before_ts", "before_type").join(days, "day").select("row_id", "timestamp_utc", "event_type", F.col("l.timestamp_utc").alias("before_ts"), F.col("l.event_type").alias("before_type"))
    both = inner.where("before_ts IS NOT NULL").select("row_id", "timestamp_utc", "event_type", "before_ts", "before_type").unionByName(first)
    micros = F.unix_micros("timestamp_utc") - F.unix_micros("before_ts")  # whole numbers: a difference of two doubles would round
    return both.withColumn("gap", F.round(micros / 1e6, 3)).where(micros > int(over * 1_000_000)).select("row_id", "gap", "before_type", F.col("event_type").alias("after_type"))


def next_after(hits: DataFrame, width: int) -> DataFrame:
    """(host, slot, m, n, head, next) for the times m of hits (host, m, n): the first time more than ``width`` later,
    and whether no hit lies within ``width`` before.

    Slots are as wide as ``width``: m + width falls into the slot after m's, so a window over one slot finds the next
    time there; beyond it, a table with one row for each slot tells.
    """
    hits = hits.withColumn("slot", ((F.col("m") - F.pmod("m", F.lit(width))) / width).cast("long"))
    along = W.partitionBy("host").orderBy("slot")
    ends = hits.groupBy("host", "slot").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    ends = ends.select("host", "slot", F.lag("last").over(along).alias("before"), F.lead("slot").over(along).alias("slot1"), F.lead("first").over(along).alias("first1"), F.lead("first", 2).over(along).alias("first2"))
    later = ends.select("host", "slot", "before", F.when(F.col("slot1") > F.col("slot") + 1, F.col("first1")).otherwise(F.col("first2")).alias("beyond"))
    own = hits.select("host", "slot", "m", F.col("m").alias("at"), F.lit(0).alias("asks"))
    asked = hits.select("host", (F.col("slot") + 1).alias("slot"), "m", (F.col("m") + width).alias("at"), F.lit(1).alias("asks"))
    down = W.partitionBy("host", "slot").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(W.unboundedPreceding, -1)  # later times come first; an equal one is not later
    found = own.unionByName(asked).withColumn("inside", F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(down)).where("asks = 1").select("host", (F.col("slot") - 1).alias("slot"), "m", "inside")
    up = W.partitionBy("host", "slot").orderBy("m")
    rows = hits.withColumn("lag", F.lag("m").over(up)).join(later, ["host", "slot"]).join(found, ["host", "slot", "m"])
    head = F.coalesce(F.col("m") - F.coalesce("lag", "before") > width, F.lit(True))
    return rows.select("host", "slot", "m", "n", head.alias("head"), F.coalesce("inside", "beyond").alias("next"))


def bursts(hits: DataFrame, within: float = 60, least: int = 3) -> DataFrame:
    """Groups of hits of a host: one starts at the first hit left and takes those within a time of its start.

    A hit without another in the time before always starts a group. From there each start points to the next one, the first
    hit beyond its time. Pointers are doubled: after round r those of length 2^r mark further starts from all marked
    ones. No task holds a host's hits or a run of them, and a run of n groups takes log n rounds.
    """
    width = int(within * 1_000_000)
    times = hits.select(F.col("source_system").alias("host"), F.unix_micros("timestamp_utc").alias("m")).groupBy("host", "m").agg(F.count("*").alias("n"))
    nodes = stored(next_after(times, width))
    heads = nodes.where("head").select("host", "m")
    jump = stored(nodes.select("host", "m", F.col("next").alias("to")).where("to IS NOT NULL").join(heads.withColumnRenamed("m", "to").withColumn("_head", F.lit(True)), ["host", "to"], "left").where("_head IS NULL").drop("_head"))
    marked = stored(heads)
    while not jump.isEmpty():
        reached = marked.join(jump, ["host", "m"]).select("host", F.col("to").alias("m"))
        marked = stored(marked.unionByName(reached), over=marked)
        jump = stored(jump.join(jump.select("host", F.col("m").alias("to"), F.col("to").alias("far")), ["host", "to"]).select("host", "m", F.col("far").alias("to")), over=jump)
    slot = ((F.col("m") - F.pmod("m", F.lit(width))) / width).cast("long")
    starts = marked.select("host", F.col("m").alias("start"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    groups = nodes.join(starts, ["host", "slot"]).where(F.col("m").between(F.col("start"), F.col("start") + width)).groupBy("host", "start").agg(F.max("m").alias("last"), F.sum("n").alias("n"))
    return groups.where(F.col("n") >= least).select(F.col("host").alias("source_system"), F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")


def merge_windows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping [begin, end] of a key joined to one, with their number and greatest count."""
    w = W.partitionBy(*keys).orderBy("begin", "end")
    s = spans.withColumn("reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("begin") > F.col("reach")), 1).otherwise(0)).over(w))
    return s.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("windows"), F.max("n").alias("most")).drop("island")


def slotted(df: DataFrame, ts: str, width: int) -> DataFrame:
    """``df`` with its microseconds ``m`` and the slot of ``width`` microseconds that they fall into; without host or time a row meets none."""
    m = F.unix_micros(ts)
    return df.where(F.col(ts).isNotNull() & F.col("host").isNotNull()).withColumns({"m": m, "slot": ((m - F.pmod(m, F.lit(width))) / width).cast("long")})


def ranked(both: DataFrame, keys: list[str], up: str = "up", down: str = "down") -> DataFrame:
    """Events and findings (``is_event`` 1 and 0) with their places among the events of a slot: of equal times the least id
    comes first in ``up`` and last in ``down``; for a finding both are the number of events before its time."""
    place = lambda by: F.sum("is_event").over(W.partitionBy(*keys, "slot").orderBy("m", "is_event", by).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumns({up: place(F.col("other_id")), down: place(F.desc("other_id"))})


def slot_counts(events: DataFrame, keys: list[str], n: str = "n", n0: str = "n0") -> DataFrame:
    """The number of events of each slot, and of the slot before it."""
    own = events.groupBy(*keys, "slot").agg(F.count("*").alias(n))
    own = own.select(*keys, F.explode(F.array(F.struct("slot", n, F.lit(0).cast("long").alias(n0)), F.struct((F.col("slot") + 1).alias("slot"), F.lit(0).cast("long").alias(n), F.col(n).alias(n0)))).alias("x"))
    return own.select(*keys, "x.*").groupBy(*keys, "slot").agg(F.sum(n).alias(n), F.sum(n0).alias(n0))


def places_around(found: DataFrame, k: int) -> DataFrame:
    """(id, host, at, side, slot, place) of the k events before and the k after each finding, which has ``up`` events of its
    slot before it, ``n`` in its slot and ``n0`` in the slot before that; a place beyond its slot is one of the next slot."""
    up, slot, n, n0 = (F.coalesce(F.col(c), F.lit(0)) for c in ("up", "slot", "n", "n0"))
    place = lambda side, inside, here, there, beyond: F.struct(F.lit(side).alias("side"), F.when(inside, slot).otherwise(there).alias("slot"), F.when(inside, here).otherwise(beyond).alias("place"))
    before = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: place("before", up - j >= 1, up - j, slot - 1, up - j + n0))
    after = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: place("after", up + j <= n, up + j, slot + 1, up + j - n))
    return found.select("id", "host", F.col("m").alias("at"), F.explode(F.concat(before, after)).alias("x")).select("id", "host", "at", "x.*").where("place >= 1")


def by_place(events: DataFrame, up: str = "up", down: str = "down") -> DataFrame:
    """Each event with its place from either side."""
    sides = F.array(F.struct(F.lit("before").alias("side"), F.col(down).alias("place")), F.struct(F.lit("after").alias("side"), F.col(up).alias("place")))
    return events.select("host", "slot", "m", "other_id", F.explode(sides).alias("x")).select("host", "slot", F.col("m").alias("other_m"), "other_id", "x.*")


def both_kinds(findings: DataFrame, events: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Events with their slots, and the same with the findings among them."""
    e = slotted(events.select("host", "other_id", "other_ts"), "other_ts", width).select("host", "slot", "m", "other_id")
    f = slotted(findings.select("host", "id", "ts"), "ts", width).select("host", "slot", "m", F.lit(None).cast("long").alias("other_id"), "id", F.lit(0).alias("is_event"))
    return e, e.withColumns({"id": F.lit(None).cast("long"), "is_event": F.lit(1)}).unionByName(f)


def around(findings: DataFrame, events: DataFrame, within: float, k: int) -> DataFrame:
    """(id, host, side, other_id, gap) of the k events of its host before, and the k at or after, each finding within some
    seconds; the gap is in microseconds. No pairs are formed: events are numbered in slots of that time, and a finding asks
    for 2 k numbers."""
    width = int(within * 1_000_000)
    e, both = both_kinds(findings, events, width)
    both = ranked(both, ["host"])
    found = both.where("is_event = 0").join(slot_counts(e, ["host"]), ["host", "slot"], "left")
    met = places_around(found, k).join(by_place(both.where("is_event = 1")), ["host", "slot", "side", "place"])
    return met.withColumn("gap", F.col("other_m") - F.col("at")).where(F.abs("gap") <= width).select("id", "host", "side", "other_id", "gap")


def around_elsewhere(findings: DataFrame, events: DataFrame, within: float, k: int) -> DataFrame:
    """As ``around``, for the events of all other hosts.

    Among those the finding asks for numbers q; the same event's number among all is q and the number of the own host's
    events that have fewer than q others before them, which one sorted pass over the own host's slot tells.
    """
    width = int(within * 1_000_000)
    e, both = both_kinds(findings, events, width)
    both = ranked(ranked(both, [], "all_up", "all_down"), ["host"], "own_up", "own_down")
    found = both.where("is_event = 0").join(slot_counts(e, [], "an", "an0"), "slot", "left").join(slot_counts(e, ["host"], "hn", "hn0"), ["host", "slot"], "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    asked = places_around(found.select("id", "host", "slot", "m", (F.col("all_up") - F.col("own_up")).alias("up"), (count("an") - count("hn")).alias("n"), (count("an0") - count("hn0")).alias("n0")), k)
    own = by_place(both.where("is_event = 1").withColumns({"up": F.col("all_up") - F.col("own_up"), "down": F.col("all_down") - F.col("own_down")})).select("host", "slot", "side", "place", F.lit(1).alias("is_own"))
    along = W.partitionBy("host", "slot", "side").orderBy("place", "is_own").rowsBetween(W.unboundedPreceding, 0)
    asked = asked.withColumn("is_own", F.lit(0)).unionByName(own, allowMissingColumns=True).withColumn("place", F.col("place") + F.sum("is_own").over(along)).where("is_own = 0").drop("is_own")
    met = asked.join(by_place(both.where("is_event = 1"), "all_up", "all_down").drop("host"), ["slot", "side", "place"])
    return met.withColumn("gap", F.col("other_m") - F.col("at")).where(F.abs("gap") <= width).select("id", "host", "side", "other_id", "gap")


def nearest(left: DataFrame, right: DataFrame, within: float) -> DataFrame:
    """For each left event, the event of the named host closest in time within some seconds; the signed gap stays."""
    best = around(left, right, within, 1).groupBy("id", "host").agg(F.min(F.struct(F.abs("gap").alias("far"), "other_id", "gap")).alias("b"))
    return best.select("id", "host", "b.other_id", F.round(F.col("b.gap") / 1e6, 3).alias("delta"))


def context(findings: DataFrame, events: DataFrame, within: float = 30, k: int = 10) -> DataFrame:
    """The k nearest events before and after each finding on its host."""
    near = around(findings, events, within, k + 1).where("other_id <> id").withColumn("gap", F.abs("gap"))  # itself may be one of them
    w = W.partitionBy("id", "side").orderBy("gap", "other_id")
    return near.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= k).select("id", "side", "other_id", F.col("nr").cast("long").alias("nr"))


def cross_system(findings: DataFrame, events: DataFrame, within: float = 5, k: int = 10) -> DataFrame:
    """The k events of other hosts closest in time to each finding."""
    w = W.partitionBy("id").orderBy(F.abs("gap"), "other_id")
    return around_elsewhere(findings, events, within, k).withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= k).select("id", "other_id")


def _ids(where: str):
    return lambda ev: ev.where(where).select(F.col("row_id").alias("id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("ts"))


def _others(ev):
    return ev.select(F.col("row_id").alias("other_id"), F.col("source_system").alias("host"), F.col("timestamp_utc").alias("other_ts"))


def _ev(f):
    return lambda s, d: f(security_events(s, d))


def _dense(f):
    return lambda s, d: f(dense_events(s, d))


_P = "p0 AS (SELECT row_id AS id, source_system AS host, timestamp_utc AS ts, process_id AS pid, parent_process_id AS ppid, event_code, process_name, username, row_number() OVER (PARTITION BY source_system, process_id, round_even(epoch_us(timestamp_utc) / 1e6, 0) ORDER BY event_code, row_id) AS nr FROM sec WHERE event_code IN (1, 4688)), p AS (SELECT * FROM p0 WHERE nr = 1), e AS (SELECT child_id, parent_id FROM (SELECT c.id AS child_id, q.id AS parent_id, row_number() OVER (PARTITION BY c.id ORDER BY q.ts DESC, q.id DESC) AS nr FROM p c JOIN p q ON c.host = q.host AND c.ppid = q.pid AND q.ts < c.ts) WHERE nr = 1)"
_F = "f AS (SELECT id, id AS root, 0 AS depth FROM p WHERE id NOT IN (SELECT child_id FROM e) UNION ALL SELECT e.child_id, f.root, f.depth + 1 FROM f JOIN e ON e.parent_id = f.id)"
_CLS = "CASE WHEN parent || '>' || child IN (" + ", ".join(f"'{p}>{c}'" for p, c in rules.BAD_PAIRS) + ") THEN 'HIGHLY_SUSPICIOUS' WHEN parent IN (" + ", ".join(f"'{p}'" for p in rules.RARE_PARENTS) + ") THEN 'SUSPICIOUS' WHEN parent || '>' || child IN (" + ", ".join(f"'{p}>{c}'" for c, ps in rules.EXPECTED_PARENTS.items() for p in ps) + ") THEN 'EXPECTED' ELSE 'UNUSUAL' END"
_S = "a AS (SELECT *, coalesce((epoch_us(timestamp_utc) - epoch_us(lag(timestamp_utc) OVER (PARTITION BY source_system, username ORDER BY timestamp_utc, row_id))) / 1e6 > 1800, true)::INT AS fresh FROM sec), b AS (SELECT *, sum(fresh) OVER (PARTITION BY source_system, username ORDER BY timestamp_utc, row_id) AS session FROM a)"
_HIT = "event_code IN (7045, 1102, 4720)"

QUERIES = {
    "sessionize": _dense(session_table),
    "session_intent": _dense(session_intent),
    "time_gaps": _ev(time_gaps),
    "proc_dedup": _ev(lambda ev: process_starts(ev).select("id", "host", "pid")),
    "proc_edges": _ev(edges),
    "parent_name_lookup": _ev(lambda ev: ev.join(ev.groupBy(F.col("process_id").alias("parent_process_id")).agg(F.max_by("process_name", F.struct("timestamp_utc", "row_id")).alias("parent")), "parent_process_id", "left").select("row_id", "parent")),
    "edge_classify": _ev(lambda ev: classify(ev.where("event_code IN (1, 4688)").select("row_id", F.col("parent_process_name").alias("parent"), F.col("process_name").alias("child")))),
    "proc_forest": _ev(trees),
    "tree_score": _ev(tree_scores),
    "ancestors": _ev(ancestors),
    "xsys_nearest": _dense(lambda ev: nearest(_ids(_HIT)(ev).withColumn("host", F.concat(F.lit("host"), (F.col("id") % 7).cast("string"))), _others(ev), 5)),
    "ctx_before_after": _dense(lambda ev: context(_ids(_HIT)(ev), _others(ev))),
    "ctx_cross_system": _dense(lambda ev: cross_system(_ids(_HIT)(ev), _others(ev))),
    "burst_groups": _dense(lambda ev: bursts(ev.where("command_line LIKE '%exe%'"))),
    "hot_windows": _dense(lambda ev: interval_join(_ids(_HIT)(ev), _others(ev).withColumn("hit", F.lit(1)), ["host"], "ts", "other_ts", 30, 90).groupBy("id").agg(F.count("*").alias("n")).where("n >= 3")),
    "merge_windows": _ev(lambda ev: merge_windows(ev.where(_HIT).select("source_system", (F.unix_micros("timestamp_utc") / 1000000).cast("long").alias("begin"), (F.unix_micros("timestamp_utc") / 1000000 + 7200).cast("long").alias("end"), F.col("k").alias("n")), ["source_system"])),
    "unified_timeline": _ev(lambda ev: ev.select("row_id", "timestamp_utc", "event_type", "source_file").orderBy("timestamp_utc", "row_id")),
    "except_pids": _ev(lambda ev: ev.select("parent_process_id").distinct().join(ev.where("event_code = 1 AND source_system = 'host1'").select(F.col("process_id").alias("parent_process_id")).distinct(), "parent_process_id", "left_anti")),
    "hidden_by_crossref": _ev(lambda ev: ev.select(F.regexp_extract(F.concat("process_name", F.lit(" Pid "), F.col("process_id").cast("string")), r"Pid ([0-9]+)", 1).cast("bigint").alias("pid")).where("pid > 4").distinct().join(ev.where("event_code = 4688 AND source_system = 'host1'").select(F.col("process_id").alias("pid")).distinct(), "pid", "left_anti")),
    "missing_events": _ev(lambda ev: ev.select("source_system").distinct().select("source_system", F.explode(F.array(*[F.lit(i) for i in (4624, 4672, 4768, 1102)])).alias("event_code")).join(ev.select("source_system", "event_code").distinct(), ["source_system", "event_code"], "left_anti")),
    "attack_path": _ev(lambda ev: ev.where(_HIT).select("row_id", "source_system", F.row_number().over(W.partitionBy("source_system").orderBy("timestamp_utc", "row_id")).cast("long").alias("step"))),
    "score_regression": lambda s, d: table(s, d, "orders").withColumn("before", F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before - o_totalprice > 1").select("o_orderkey", "o_custkey", F.round(F.col("before") - F.col("o_totalprice"), 2).cast("double").alias("drop")),
}
ORACLES = {
    "sessionize": f"WITH {DENSE}, {_S} SELECT source_system, username, CAST(session AS BIGINT) AS session, min(timestamp_utc) AS start, max(timestamp_utc) AS \"end\", count(*) AS n, count(DISTINCT process_name) AS processes, count(DISTINCT dest_ip) AS ips, (epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc))) / 1e6 AS duration FROM b GROUP BY 1, 2, 3",
    "session_intent": f"WITH {DENSE}, {_S}, t AS (SELECT source_system, username, session, " + ", ".join(f"bool_or({' OR '.join(f'contains(lower(command_line), {chr(39)}{w}{chr(39)})' for w in ws)}) AS {tag}" for tag, ws in rules.INTENTS.items()) + " FROM b GROUP BY 1, 2, 3) SELECT source_system, username, CAST(session AS BIGINT) AS session, coalesce(nullif(array_to_string(list_filter([CASE WHEN CREDENTIAL THEN 'CREDENTIAL' END, CASE WHEN LATERAL_ THEN 'LATERAL' END, CASE WHEN RECON THEN 'RECON' END, CASE WHEN STAGING THEN 'STAGING' END], lambda x: x IS NOT NULL), ','), ''), 'UNKNOWN') AS intent FROM t",
    "time_gaps": f"WITH {SEC}, l AS (SELECT row_id, event_type AS after_type, lag(event_type) OVER w AS before_type, round((epoch_us(timestamp_utc) - epoch_us(lag(timestamp_utc) OVER w)) / 1e6, 3) AS gap FROM sec WINDOW w AS (ORDER BY timestamp_utc, row_id)) SELECT * FROM l WHERE gap > 900",
    "proc_dedup": f"WITH {SEC}, {_P} SELECT id, host, pid FROM p",
    "proc_edges": f"WITH {SEC}, {_P} SELECT * FROM e",
    "parent_name_lookup": f"WITH {SEC}, l AS (SELECT process_id, arg_max(process_name, (timestamp_utc, row_id)) AS parent FROM sec GROUP BY 1) SELECT row_id, parent FROM sec LEFT JOIN l ON sec.parent_process_id = l.process_id",
    "edge_classify": f"WITH {SEC}, x AS (SELECT row_id, parent_process_name AS parent, process_name AS child FROM sec WHERE event_code IN (1, 4688)) SELECT *, {_CLS} AS class FROM x",
    "proc_forest": f"WITH RECURSIVE {SEC}, {_P}, {_F} SELECT root, count(*) AS nodes, CAST(max(depth) AS BIGINT) AS max_depth, count(DISTINCT process_name) AS processes, count(DISTINCT username) AS users, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS span, count(*) - 1 AS edges FROM f JOIN p USING (id) GROUP BY 1",
    "tree_score": f"WITH RECURSIVE {SEC}, {_P}, {_F}, x AS (SELECT e.child_id, c.process_name AS child, q.process_name AS parent FROM e JOIN p c ON c.id = e.child_id JOIN p q ON q.id = e.parent_id), k AS (SELECT child_id, CASE {_CLS} WHEN 'HIGHLY_SUSPICIOUS' THEN 10 WHEN 'SUSPICIOUS' THEN 5 ELSE 0 END AS pts FROM x), g AS (SELECT root, sum(coalesce(pts, 0)) AS s, max(depth) AS m FROM f LEFT JOIN k ON k.child_id = f.id GROUP BY 1) SELECT root, CAST(s * (m + 1) AS BIGINT) AS score FROM g WHERE s > 0",
    "ancestors": f"WITH {SEC}, {_P} SELECT child_id AS id, parent_id AS ancestor, CAST(1 AS BIGINT) AS level FROM e UNION ALL SELECT a.child_id, b.parent_id, 2 FROM e a JOIN e b ON b.child_id = a.parent_id UNION ALL SELECT a.child_id, c.parent_id, 3 FROM e a JOIN e b ON b.child_id = a.parent_id JOIN e c ON c.child_id = b.parent_id",
    "xsys_nearest": f"WITH {DENSE}, h AS (SELECT row_id AS id, 'host' || (row_id % 7) AS host, timestamp_utc AS ts FROM sec WHERE {_HIT}), j AS (SELECT id, host, row_id AS other_id, (epoch_us(timestamp_utc) - epoch_us(ts)) / 1e6 AS g FROM h JOIN sec ON source_system = host AND abs(epoch_us(timestamp_utc) - epoch_us(ts)) <= 5e6) SELECT id, host, other_id, round(g, 3) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY id, host ORDER BY abs(g), other_id) AS nr FROM j) WHERE nr = 1",
    "ctx_before_after": f"WITH {DENSE}, j AS (SELECT h.row_id AS id, o.row_id AS other_id, epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc) AS g FROM sec h JOIN sec o ON h.source_system = o.source_system AND abs(epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc)) <= 30e6 AND o.row_id <> h.row_id WHERE h.{_HIT}), r AS (SELECT id, other_id, CASE WHEN g < 0 THEN 'before' ELSE 'after' END AS side, row_number() OVER (PARTITION BY id, g < 0 ORDER BY abs(g), other_id) AS nr FROM j) SELECT id, side, other_id, nr FROM r WHERE nr <= 10",
    "ctx_cross_system": f"WITH {DENSE} SELECT id, other_id FROM (SELECT h.row_id AS id, o.row_id AS other_id, row_number() OVER (PARTITION BY h.row_id ORDER BY abs(epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc)), o.row_id) AS nr FROM sec h JOIN sec o ON h.source_system <> o.source_system AND abs(epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc)) <= 5e6 WHERE h.{_HIT}) WHERE nr <= 10",
    "hot_windows": f"WITH {DENSE} SELECT h.row_id AS id, count(*) AS n FROM sec h JOIN sec o ON h.source_system = o.source_system AND epoch_us(o.timestamp_utc) - epoch_us(h.timestamp_utc) BETWEEN -30e6 AND 90e6 WHERE h.{_HIT} GROUP BY 1 HAVING count(*) >= 3",
    "merge_windows": f"WITH {SEC}, x AS (SELECT source_system, epoch_us(timestamp_utc) // 1000000 AS begin, epoch_us(timestamp_utc) // 1000000 + 7200 AS fin, k AS n FROM sec WHERE {_HIT}), y AS (SELECT *, max(fin) OVER (PARTITION BY source_system ORDER BY begin, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), z AS (SELECT *, sum(CASE WHEN reach IS NULL OR begin > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_system ORDER BY begin, fin ROWS UNBOUNDED PRECEDING) AS isl FROM y) SELECT source_system, CAST(min(begin) AS BIGINT) AS begin, CAST(max(fin) AS BIGINT) AS \"end\", count(*) AS windows, max(n) AS most FROM z GROUP BY source_system, isl",
    "unified_timeline": f"WITH {SEC} SELECT row_id, timestamp_utc, event_type, source_file FROM sec ORDER BY timestamp_utc, row_id",
    "except_pids": f"WITH {SEC} SELECT DISTINCT parent_process_id FROM sec WHERE parent_process_id NOT IN (SELECT process_id FROM sec WHERE event_code = 1 AND source_system = 'host1')",
    "hidden_by_crossref": f"WITH {SEC} SELECT DISTINCT process_id AS pid FROM sec WHERE process_id > 4 AND process_id NOT IN (SELECT process_id FROM sec WHERE event_code = 4688 AND source_system = 'host1')",
    "missing_events": f"WITH {SEC} SELECT h.source_system, c.event_code FROM (SELECT DISTINCT source_system FROM sec) h CROSS JOIN (VALUES (4624), (4672), (4768), (1102)) c(event_code) WHERE NOT EXISTS (SELECT 1 FROM sec s WHERE s.source_system = h.source_system AND s.event_code = c.event_code)",
    "attack_path": f"WITH {SEC} SELECT row_id, source_system, row_number() OVER (PARTITION BY source_system ORDER BY timestamp_utc, row_id) AS step FROM sec WHERE {_HIT}",
    "score_regression": "WITH l AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_orderkey, o_custkey, CAST(round(b - o_totalprice, 2) AS DOUBLE) AS drop FROM l WHERE b - o_totalprice > 1",
}
ORACLES["session_intent"] = ORACLES["session_intent"].replace("AS LATERAL,", "AS LATERAL_,")
ORACLES["burst_groups"] = (
    f"WITH RECURSIVE {DENSE}, h AS (SELECT source_system, epoch_us(timestamp_utc) AS t, row_number() OVER (PARTITION BY source_system ORDER BY timestamp_utc, row_id) AS nr FROM sec WHERE command_line LIKE '%exe%'), "
    "w AS (SELECT source_system, nr, t, t AS start FROM h WHERE nr = 1 UNION ALL SELECT h.source_system, h.nr, h.t, CASE WHEN h.t - w.start <= 60000000 THEN w.start ELSE h.t END FROM w JOIN h ON h.source_system = w.source_system AND h.nr = w.nr + 1) "
    "SELECT source_system, make_timestamp(start) AS start, make_timestamp(max(t)) AS last, count(*) AS n FROM w GROUP BY source_system, start HAVING count(*) >= 3"
)
