"""Statistics, percentiles, metering and anomaly rules."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.folds import fold_sorted
from palimpsest.operators.shared import stored

# Bounds of the latency histogram.
BOUNDS = (1, 5, 10, 25, 50, 75, 100, 150, 200, 500, 1000)


def memory_stats(memories: DataFrame) -> DataFrame:
    """Total, rows by type (a map) and distinct entities, over all rows."""
    kinds = memories.groupBy("memory_type").agg(F.count("*").alias("n"))
    by_type = kinds.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "n")))).alias("by_type"))
    found = memories.select(F.explode("entity_ids").alias("e")).agg(F.count_distinct("e").alias("n_entities"))
    return by_type.crossJoin(found)  # one row each


def feedback_counts(log: DataFrame, domain: list[str]) -> DataFrame:
    """Count of each feedback value, 0 for absent ones, and the mean latency (0 without any)."""
    values = log.sparkSession.createDataFrame([(d,) for d in domain], "feedback string")
    got = log.groupBy("feedback").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("ms"))
    return values.join(got, "feedback", "left").select("feedback", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ms", F.lit(0.0)).alias("mean_ms"))


def values_at(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by and, for each name, the value at a 0-based place of its group's sorted values; a place is a function of their number.

    Equal values of a group are counted first; the different ones are dealt by ranges and
    counted on from range to range, so a large group is sorted and counted by many tasks.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    keys = [f"_by{k}" for k in range(len(by))]
    dealt = stored(counted.repartitionByRange(*keys, "_value").withColumn("_part", F.spark_partition_id()), "counted")
    # a row for each group of each range
    sizes, order = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size")), Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_total": F.sum("_size").over(order), "_base": F.coalesce(F.sum("_size").over(order.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("_part").alias("__part"), "_base", "_total")
    run = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("_part") == F.col("__part")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = dealt.withColumn("_run", run).join(sizes, same).withColumn("_end", F.col("_base") + F.col("_run"))
    at = lambda place: F.max(F.when((place >= F.col("_end") - F.col("_n")) & (place < F.col("_end")), F.col("_value")))
    found = found.groupBy(*keys).agg(*(at(f(F.col("_total"))).alias(a) for a, f in places.items()))
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *places)


def nearest_rank(value: str, p: float) -> Column:
    """percentile_disc, the ceil(p n)-th value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def floor_rank_percentiles(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Count, sum, least, most, mean and value[floor(p n)] for each p.

    The values are picked by position, see ``values_at``; nothing is collected.
    """
    at = lambda p: lambda n: F.least(F.floor(n * p), n - 1)
    found = values_at(rows, by, value, {a: at(p) for a, p in ps.items()})
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean")
    )
    return _beside(sums, found, by)


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of two tables with the same groups side by side; a null group is one, too."""
    own, same = right, F.lit(True)
    for c in by:
        own = own.withColumnRenamed(c, f"_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(own, same).drop(*(f"_{c}" for c in by))


def operation_stats(log: DataFrame) -> DataFrame:
    """Log (op, success, elapsed): counts, and mean and value[clamp(int(n p / 100) - 1)] of successful rows."""
    base = log.groupBy("op").agg(F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"))
    good = log.where("success and elapsed is not null")
    at = lambda p: lambda n: F.greatest(F.lit(0), F.floor(n * p / 100) - 1)
    found = values_at(good, ["op"], "elapsed", {f"p{p}": at(p) for p in (50, 95, 99)})
    good = _beside(good.groupBy("op").agg(F.avg("elapsed").alias("mean")), found, ["op"])
    return base.join(good, "op", "left")


def overall(log: DataFrame) -> DataFrame:
    """Each operation's counts and p99, and those of all (op null), by rollup."""
    return log.rollup("op").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("n_failed"), F.percentile("elapsed", F.lit(0.99)).alias("p99"))


def histogram(rows: DataFrame, by: str, value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Rows by the first bound that is not less than the value; larger values are dropped."""
    bound = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        bound = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bound)
    return rows.withColumn("bound", bound).where("bound is not null").groupBy(by, "bound").agg(F.count("*").alias("n"))


def prometheus(rows: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """A10: text lines of cumulative buckets, (name, line_no, line)."""
    sums = rows.groupBy(by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("inf"))
    lines = [F.format_string(f'%s_bucket{{le="{b:g}"}} %d', F.col(by), F.col(f"b{k}")) for k, b in enumerate(bounds)]
    lines.append(F.format_string('%s_bucket{le="+Inf"} %d', F.col(by), F.col("inf")))
    return sums.select(F.col(by), F.posexplode(F.array(*lines)).alias("line_no", "line"))


def error_signatures(errors: DataFrame) -> DataFrame:
    """(signature, n, last_seen, sample) by the part of the message before the first colon."""
    sign = F.trim(F.substring_index("message", ":", 1))
    return errors.groupBy(sign.alias("signature")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"), F.min("message").alias("sample"))


def dominant_sources(memories: DataFrame) -> DataFrame:
    """Sources with over 60 % of all rows (and more than one): n, level, first three ids."""
    n = memories.groupBy("source").agg(F.count("*").alias("n"), F.expr("min_by(id, id)").alias("_"))
    total = memories.agg(F.count("*").alias("total"))
    big = n.drop("_").crossJoin(F.broadcast(total)).where((F.col("n") > 1) & (F.col("n") > 0.6 * F.col("total")))  # total: one row
    ids = memories.join(F.broadcast(big.select("source")), "source", "left_semi").orderBy("id").limit(3)
    first = ids.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return big.join(first, "source").select("source", "n", F.when(F.col("n") > 0.8 * F.col("total"), "high").otherwise("medium").alias("level"), "ids")


def index_advice(log: DataFrame, least: float = 0.1, most: int = 3) -> DataFrame:
    """Columns of the query log (filters array, sort_by) by share of queries, the first ``most``."""
    n = log.agg(F.count("*").alias("total"))
    used = log.select(F.explode(F.array_distinct(F.concat("filters", F.array_compact(F.array("sort_by"))))).alias("column"))
    share = used.groupBy("column").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).withColumn("share", F.col("n") / F.col("total"))  # total: one row
    return share.where(F.col("share") >= least).orderBy(F.desc("n"), "column").limit(most).select("column", "n", "share")


def usage(log: DataFrame, since: Column) -> DataFrame:
    """Rows, tokens and compute of each tenant and endpoint since a time."""
    return log.where(F.col("ts") >= since).groupBy("tenant", "endpoint").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"), F.sum("compute_ms").alias("compute_ms"))


def risk_scores(findings: DataFrame) -> DataFrame:
    """By category: count and max(0, 100 - sum of 25, 15, 8 and 3 for each level)."""
    points = F.when(F.col("level") == "critical", 25).when(F.col("level") == "high", 15).when(F.col("level") == "medium", 8).otherwise(3)
    return findings.groupBy("category").agg(F.count("*").alias("n"), F.greatest(F.lit(0), 100 - F.sum(points)).alias("score"))


def next_queries(log: DataFrame, k: int = 3) -> DataFrame:
    """(query, next_query, n, rank): what users ask after a query, the k most frequent."""
    w = Window.partitionBy("user_id").orderBy("ts", "query")
    pairs = log.withColumn("next_query", F.lead("query").over(w)).where("next_query is not null").groupBy("query", "next_query").agg(F.count("*").alias("n"))
    r = Window.partitionBy("query").orderBy(F.desc("n"), "next_query")
    return pairs.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k)


def spikes(rows: DataFrame, by: list[str], order: list[str], value: str, width: int = 30, sigmas: float = 3.0) -> DataFrame:
    """Value above mean + 3 standard deviations of the last ``width`` rows (this one included)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumns({"mean": F.avg(value).over(w), "sd": F.stddev_samp(value).over(w)}).withColumn("spike", F.coalesce(F.col(value) > F.col("mean") + sigmas * F.col("sd"), F.lit(False)))


def level_shift(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The mean of the last ten rows differs by over half from that of the ten before."""
    w = Window.partitionBy(*by).orderBy(*order)
    now, before = F.avg(value).over(w.rowsBetween(-9, 0)), F.avg(value).over(w.rowsBetween(-19, -10))
    return rows.withColumns({"recent": now, "before": before}).withColumn("shifted", F.coalesce(F.abs(F.col("recent") - F.col("before")) > 0.5 * F.col("before"), F.lit(False)))


def all_failed(rows: DataFrame, by: list[str], order: list[str], width: int = 50) -> DataFrame:
    """The last ``width`` operations all failed."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("down", (F.count("*").over(w) == width) & (F.max((F.col("status") != "failed").cast("int")).over(w) == 0))


def access_pattern(log: DataFrame, by: str = "user_id") -> DataFrame:
    """Rows, distinct keys and the share of steps to the next numbered key."""
    w = Window.partitionBy(by).orderBy("ts", "key")
    number = F.regexp_extract("key", r"(\d+)$", 1).try_cast("bigint")
    rows = log.withColumn("_n", number).withColumn("_step", (F.col("_n") - F.lag("_n").over(w) == 1).cast("int"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.coalesce(F.avg("_step"), F.lit(0.0)).alias("sequential"))


def moving_success(events: DataFrame, by: str, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """Exponential moving average of x over (ts, id) for each key, and weights that sum to the number of keys; a null x changes nothing."""

    def step(ema: float, v: tuple) -> tuple:
        return (ema if v[2] is None else alpha * v[2] + (1 - alpha) * ema), None

    out = fold_sorted(events, [by], {"ts": F.col("ts"), "id": F.col("id"), "x": F.col("x").cast("double")}, start, step, {"ema": "double"}, each=False)
    total = out.agg(F.sum("ema").alias("s"), F.count("*").alias("k"))
    return out.crossJoin(F.broadcast(total)).select(by, "ema", (F.col("ema") / F.col("s") * F.col("k")).alias("weight"))  # total: one row


def budget_spends(spends: DataFrame, budget: float) -> DataFrame:
    """Spends (key, seq, epsilon) with ``accepted``; one above what is left is refused and not charged, a null one neither."""

    def step(used: float, v: tuple) -> tuple:
        ok = None if v[1] is None else used + v[1] <= budget + 1e-12
        return (used + v[1] if ok else used), (*v, ok)

    values = {"seq": F.col("seq").cast("long"), "epsilon": F.col("epsilon").cast("double")}
    return fold_sorted(spends, ["key"], values, 0.0, step, {"seq": "long", "epsilon": "double", "accepted": "boolean"})


def scene_relations(scenes: DataFrame) -> DataFrame:
    """Relations of each scene (video, pos, id, start, stop) to the next: follows, and contains or overlaps."""
    w = Window.partitionBy("video").orderBy("pos")
    rows = scenes.withColumn("nxt", F.lead(F.struct("id", "start", "stop")).over(w)).where("nxt is not null")
    shared = F.least("stop", F.col("nxt.stop")) - F.col("nxt.start")
    share = shared / F.greatest(F.col("nxt.stop") - F.col("nxt.start"), F.lit(1e-9))
    kinds = F.array_compact(F.array(F.lit("follows"), F.when(F.col("nxt.start") < F.col("stop"), F.when(share > 0.5, "contains").otherwise("overlaps"))))
    return rows.select("video", F.col("id").alias("source_id"), F.col("nxt.id").alias("target_id"), F.explode(kinds).alias("relation_type"))


def broken_chain(ledger: DataFrame) -> DataFrame:
    """Rows (seq, payload, prev_hash, hash) whose hash or link does not hold, within each ledger_id."""
    w = Window.partitionBy("ledger_id").orderBy("seq")
    linked = F.coalesce(F.lag("hash").over(w), F.lit(""))
    own = F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("payload")), 256)
    return ledger.withColumn("_link", linked).where((F.col("_link") != F.coalesce("prev_hash", F.lit(""))) | (own != F.col("hash"))).drop("_link")


def federated_mean(updates: DataFrame) -> DataFrame:
    """Sample-weighted mean of the clients' vectors (key, vector, samples), (key, mean)."""
    rows = updates.select("key", "samples", F.posexplode("vector").alias("pos", "x"))
    mean = rows.groupBy("key", "pos").agg((F.sum(F.col("samples") * F.col("x")) / F.sum("samples")).alias("x"))
    return mean.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
