"""Decay, importance, retention, tiers and governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import days_between, half_life, importance_score, retention


def decayed(memories: DataFrame, now: Column) -> DataFrame:
    """Columns retention and new_importance; one application at ``now``."""
    kept = retention(days_between(now, F.col("last_accessed")), F.col("importance"), F.col("access_count"))
    return memories.withColumn("retention", kept).withColumn("new_importance", F.col("importance") * F.col("retention"))


def forgotten(memories: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows below the least importance."""
    return memories.where(F.col("importance") < least)


def scored(memories: DataFrame, now: Column) -> DataFrame:
    """Column score."""
    days = days_between(now, F.col("last_accessed"))
    return memories.withColumn("score", importance_score(F.col("importance"), F.col("access_count"), F.size("entity_ids"), days, F.col("memory_type")))


def predicted_importance(memories: DataFrame, log: DataFrame, now: Column, keywords: list[str] | None = None) -> DataFrame:
    """(id, predicted) in [0, 1] of memories (id, content, created_at, entity_ids) and their accesses, log (id).

    A quarter for recency, linear over a year; .3 for accesses, up to ten; a quarter for
    richness (length up to 1,000, entities up to five); .2 for the share of ``keywords`` in
    the content, or .1 without keywords.  Accesses are counted before they are joined.
    """
    counts = log.groupBy("id").agg(F.count("*").alias("_accesses"))
    rows = memories.join(counts, "id", "left")
    part = lambda c, most: F.least(F.coalesce(c, F.lit(0)) / F.lit(float(most)), F.lit(1.0))
    recency = F.greatest(F.lit(0.0), 1.0 - days_between(now, F.col("created_at")) / 365.0)
    rich = (part(F.length("content"), 1000) + part(F.greatest(F.size("entity_ids"), F.lit(0)), 5)) / 2.0
    if keywords:
        text = F.lower(F.coalesce("content", F.lit("")))
        hits = sum((F.contains(text, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
        aligned = F.least(hits / len(keywords), F.lit(1.0)) * 0.2
    else:
        aligned = F.lit(0.1)
    score = recency * 0.25 + part(F.col("_accesses"), 10) * 0.3 + rich * 0.25 + aligned
    return rows.select("id", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("predicted"))


def query_keywords(query: str) -> list[str]:
    """Words of more than two letters, without marks at their ends."""
    return [w for w in (x.strip(".,!?;:'\"()-[]{}<>") for x in query.split()) if len(w) > 2]


def faded_attributes(attributes: DataFrame, now: Column, life: float = 30.0, least: float = 0.1) -> DataFrame:
    """Attributes (user_id, name, value, confidence, updated_at) with decayed confidence, above the least."""
    age = days_between(now, F.col("updated_at"))
    return attributes.withColumn("confidence", half_life(F.col("confidence"), age, life)).where(F.col("confidence") >= least)


def keep_top(memories: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Ids beyond the n most important; of all rows, or of each key.

    Without a key the cut-off is found first (one aggregation of a quantile-free top n),
    so that only rows at the cut-off are ranked together.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("importance"), "id")
        return memories.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > n).drop("_n")
    top = memories.orderBy(F.desc("importance"), "id").limit(n).select("id")
    return memories.join(top, "id", "left_anti")


def retention_plan(memories: DataFrame, now: Column, ttl_days: float | None, least: float | None, most_rows: int | None) -> DataFrame:
    """(id, policy) of rows to delete; policies ttl, importance, count in order, each on what is left."""
    plan, left = None, memories
    steps: list[tuple[str, Column]] = []
    if ttl_days is not None:
        steps.append(("ttl", days_between(now, F.col("created_at")) > ttl_days))
    if least is not None:
        steps.append(("importance", F.col("importance") < least))
    for name, condition in steps:
        hit = left.where(condition).select("id", F.lit(name).alias("policy"))
        plan = hit if plan is None else plan.unionByName(hit)
        left = left.where(~F.coalesce(condition, F.lit(False)))
    if most_rows is not None:
        hit = keep_top(left, most_rows).select("id", F.lit("count").alias("policy"))
        plan = hit if plan is None else plan.unionByName(hit)
    return plan if plan is not None else memories.where("1 = 0").select("id", F.lit("").alias("policy"))


def next_tier(tier: Column, age_days: Column, retention_days: Column) -> Column:
    """One step a run: hot > 30 days, warm > 90, cold > the retention."""
    days = F.floor(age_days)
    return (
        F.when((tier == "hot") & (days > 30), "warm").when((tier == "warm") & (days > 90), "cold")
        .when((tier == "cold") & (days > retention_days), "archive").otherwise(tier)
    )


def status(memories: DataFrame, now: Column, stale_days: float = 90.0) -> DataFrame:
    """Superseded, stale or active."""
    stale = days_between(now, F.col("last_accessed")) > stale_days
    return memories.withColumn("status", F.when(F.col("superseded_by").isNotNull() | ~F.col("is_active"), "superseded").when(stale, "stale").otherwise("active"))


def purge_due(records: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Records (id, category, created_at, legal_hold) whose category's policy lets them be deleted."""
    joined = records.join(policies, "category")
    return joined.where(F.col("auto_delete") & ~F.col("legal_hold") & (days_between(now, F.col("created_at")) > F.col("retention_days"))).select(*records.columns)


def compliance(records: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """(id, category, issue): of each record that is not deleted, no_policy, retention_exceeded or null for none.

    records: id, category, created_at, deleted; policies: category, retention_days (null or
    0: for ever), legal_hold.  Ages are whole days; a legal hold excuses any age.
    """
    own = policies.select("category", "retention_days", "legal_hold", F.lit(True).alias("_known"))
    rows = records.where(~F.col("deleted")).join(own, "category", "left")
    late = (F.coalesce("retention_days", F.lit(0)) > 0) & (F.floor(days_between(now, F.col("created_at"))) > F.col("retention_days")) & ~F.col("legal_hold")
    issue = F.when(F.col("_known").isNull(), "no_policy").when(late, "retention_exceeded")
    return rows.select("id", "category", issue.alias("issue"))


def compliance_rate(found: DataFrame) -> DataFrame:
    """One row of n_compliant, n_issues and rate (per cent to two places, 100 without records) of ``compliance``."""
    n, bad = F.count("*"), F.count("issue")
    return found.agg((n - bad).alias("n_compliant"), bad.alias("n_issues"), F.when(n > 0, F.round((n - bad) / n * 100, 2)).otherwise(100.0).alias("rate"))


def erasures(requests: DataFrame, records: DataFrame, policies: DataFrame) -> DataFrame:
    """(request_id, id, category) of the records that pending requests delete; a record goes with its first request.

    requests: request_id, user_id, tenant_id, status, categories (null or empty: all).  A
    record goes if user and tenant are those of the request, it is not deleted, its category
    has a policy without legal hold and is among those asked for; without asked categories
    the policy must say gdpr_applies.
    """
    open_ = requests.where("status = 'pending'").select("request_id", "user_id", "tenant_id", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
    mine = records.where(~F.col("deleted")).join(open_, ["user_id", "tenant_id"])
    rules = policies.where(~F.col("legal_hold")).select("category", "gdpr_applies")
    every = F.size("categories") == 0
    due = mine.join(rules, "category").where((every & F.col("gdpr_applies")) | F.array_contains("categories", F.col("category")))
    return due.groupBy("id", "category").agg(F.min("request_id").alias("request_id")).select("request_id", "id", "category")


def transitions(history: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of a state history (id, seq, state) with ``valid``: the step from the previous state is allowed."""
    w = Window.partitionBy("id").orderBy("seq")
    rows = history.withColumn("before", F.lag("state").over(w))
    ok = allowed.select(F.col("from_state").alias("before"), F.col("to_state").alias("state"), F.lit(True).alias("_ok"))
    return rows.join(F.broadcast(ok), ["before", "state"], "left").select("id", "seq", "before", "state", (F.col("before").isNull() | F.col("_ok").isNotNull()).alias("valid"))


def tiers(memories: DataFrame, hot_share: float = 0.2) -> DataFrame:
    """The ``hot_share`` most used rows are hot, by (access_count, last_accessed, id).

    The cut-off on access_count is a grouped count, so rows are not ranked in one task;
    only rows at the cut-off are told apart by the other columns.
    """
    by_count = memories.groupBy("access_count").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("access_count")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_count.withColumn("above", F.coalesce(F.sum("n").over(w), F.lit(0)))
    total = memories.agg(F.count("*").alias("total"))
    inner = Window.partitionBy("access_count").orderBy(F.desc("last_accessed"), "id")
    rows = memories.join(before, "access_count").crossJoin(F.broadcast(total)).withColumn("_r", F.row_number().over(inner))  # total: one row
    hot = F.col("above") + F.col("_r") <= F.floor(F.col("total") * hot_share)
    return rows.select(*memories.columns, F.when(hot, "hot").otherwise("warm").alias("tier"))


def budgeted_context(parts: DataFrame, budget: int) -> DataFrame:
    """Parts (context_id, priority, confidence, text) cut to shares of a budget of characters, joined by priority.

    A part gets floor(budget * confidence / sum of confidences); what rounding leaves goes to the first priority.
    """
    all_ = Window.partitionBy("context_id")
    share = F.floor(budget * F.col("confidence") / F.sum("confidence").over(all_))
    rows = parts.withColumn("share", share)
    left = budget - F.sum("share").over(all_)
    rows = rows.withColumn("share", F.col("share") + F.when(F.row_number().over(all_.orderBy("priority", "text")) == 1, left).otherwise(0))
    rows = rows.withColumn("text", F.substring("text", F.lit(1), F.col("share").cast("int")))
    return rows.groupBy("context_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "text"))), lambda x: x["text"]), "\n").alias("context"))


def session_layer(importance: Column, layer: Column) -> Column:
    """Important rows become long_term."""
    return F.when(importance >= 0.7, "long_term").otherwise(layer)


def permitted(rows: DataFrame, grants: DataFrame, agent: str, k: int) -> DataFrame:
    """Rows (source, id, score) of sources that the agent may read, best k, each (source, id) once."""
    mine = grants.where((F.col("agent_id") == agent) & F.col("action").isin("read", "admin")).select("source").distinct()
    return rows.join(mine, "source", "left_semi").groupBy("source", "id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "source", "id").limit(k)


def decisions(requests: DataFrame, grants: DataFrame, roles: DataFrame, role_grants: DataFrame) -> DataFrame:
    """Requests (user_id, resource, space, action) with ``by``: resource, space, role or deny."""
    direct = grants.select("user_id", F.col("scope").alias("resource"), "action", F.lit(True).alias("_d")).distinct()
    space = grants.select("user_id", F.col("scope").alias("space"), "action", F.lit(True).alias("_s")).distinct()
    role = roles.join(role_grants, "role").select("user_id", "action", F.lit(True).alias("_r")).distinct()
    rows = requests.join(direct, ["user_id", "resource", "action"], "left").join(space, ["user_id", "space", "action"], "left").join(role, ["user_id", "action"], "left")
    return rows.select(*requests.columns, F.when(F.col("_d"), "resource").when(F.col("_s"), "space").when(F.col("_r"), "role").otherwise("deny").alias("by"))


def policy_decisions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Defer without a matching rule (type, action), deny if any denies, else allow."""
    joined = requests.join(rules.select("type", "action", "effect"), ["type", "action"], "left")
    agg = joined.groupBy(*requests.columns).agg(F.count("effect").alias("n"), F.max((F.col("effect") == "deny").cast("int")).alias("d"))
    return agg.select(*requests.columns, F.when(F.col("n") == 0, "defer").when(F.col("d") == 1, "deny").otherwise("allow").alias("decision"))
