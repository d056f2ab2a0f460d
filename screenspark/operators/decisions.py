"""Experiment suggestions, diversity, budgeted plans, ledgers and validation evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.functions.columns import clean_text, clip, first_nonempty, steady, time_or_min, token

TIERS = ("validate_now", "review_first", "backup")


def tier_order(c: Column | str = "tier") -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x == TIERS[0], 0).when(x == TIERS[1], 1).otherwise(2)


def suggest(consensus: DataFrame, high: float = 0.70, low: float = 0.55, risk: float = 0.40, delta: float = 3.0) -> DataFrame:
    """Priority of a next experiment for each candidate of a reviewed consensus, and its tier."""
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(float(d)))
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0)
    score = 0.44 * clip(num("consensus_score", 0), 0, 1) + 0.16 * (1 - clip(num("confidence_score", 0.5), 0, 1)) + 0.14 * clip(num("abs_rank_delta", 0) / max(delta, 1.0), 0, 1)
    score = score + 0.10 * clip(num("qc_risk", 0), 0, 1) + 0.06 * (1 - clip(num("source_coverage", 1), 0, 1)) + 0.06 * flag("close_competition") + 0.04 * flag("unstable")
    d = consensus.withColumn("priority_score", clip(score, 0, 1))
    p, at = steady("priority_score"), lambda c, d: steady(num(c, d))
    now = (p >= 0.72) | ((F.col("decision_tier") == "priority") & (at("consensus_score", 0) >= high) & (at("confidence_score", 0) >= low) & (at("qc_risk", 0) < risk))
    review = (p >= 0.52) | (at("consensus_score", 0) >= high) | (at("confidence_score", 1) < low) | (at("qc_risk", 0) >= risk) | (num("abs_rank_delta", 0) >= delta) | (flag("close_competition") > 0) | (flag("unstable") > 0)
    return d.withColumn("tier", F.when(now, TIERS[0]).when(review, TIERS[1]).otherwise(TIERS[2]))


def diversity_group(d: DataFrame, column: str | None = None, high: float = 0.70, low: float = 0.55, risk: float = 0.40, delta: float = 3.0) -> DataFrame:
    """Group by a column if one is given, else by the candidate's profile."""
    if column:
        return d.withColumn("diversity_group", F.when(clean_text(column) == "", "ungrouped").otherwise(clean_text(column)))
    has = lambda f: F.array_contains("review_flags", f)
    g = (
        F.when(F.coalesce(F.col("close_competition"), F.lit(False)), "close_decision")
        .when((F.coalesce(F.col("abs_rank_delta"), F.lit(0.0)) >= delta) | has("rank_disagreement"), "rank_disagreement")
        .when((steady("qc_risk") >= risk) | has("overwide"), "qc_or_site_risk")
        .when(F.coalesce(F.col("unstable"), F.lit(False)), "instability")
        .when(steady("confidence_score") < low, "low_confidence")
        .when((F.col("decision_tier") == "priority") & (steady("consensus_score") >= high), "high_confidence_priority")
        .when(steady("consensus_score") >= high, "high_score_standard")
        .otherwise("exploratory")
    )
    return d.withColumn("diversity_group", g)


def diversify(d: DataFrame, penalty: float = 0.08, cap: int = 2) -> DataFrame:
    """Greedy diversity order within tiers, without a loop.

    Within a group, items are always taken in the order of their scores, so the
    number taken before an item is its place in the group, and one sort by the
    score less the penalty for that number gives the greedy order.
    """
    score = F.round("priority_score", 9)
    w = Window.partitionBy("diversity_group").orderBy(tier_order(), score.desc(), "consensus_rank")
    d = d.withColumn("seen", F.row_number().over(w) - 1)
    extra = F.when(F.col("seen") >= cap, penalty * (F.col("seen") - cap + 1)).otherwise(0.0) if cap > 0 else F.lit(0.0)
    d = d.withColumn("adjusted", score - (penalty * F.col("seen") + extra))
    final = Window.partitionBy(F.lit(0)).orderBy(tier_order(), F.round("adjusted", 9).desc(), score.desc(), "consensus_rank")
    return d.withColumn("suggestion_rank", F.row_number().over(final))


def plan(suggestions: DataFrame, total: int, per_tier: dict[str, int], per_group: int, overrides: DataFrame | None = None, standby: int = 3) -> DataFrame:
    """Budgeted plan for each ``batch``: rows in the order of suggestion_rank, within the budgets.

    ``overrides`` (candidate, override, status): ``include`` goes first, past the tier
    and group budgets; ``exclude`` and a final status stay out; the next rows fill
    the standby pool.  The three budgets depend on each other, so each batch is walked in
    order by one task; a batch has the size of a candidate list.
    """
    d = suggestions.select("batch", "candidate", "tier", "diversity_group", "suggestion_rank")
    if overrides is not None:
        d = d.join(overrides.select("candidate", token("override").alias("override"), token("status").alias("status")), "candidate", "left")
    else:
        d = d.withColumn("override", F.lit("")).withColumn("status", F.lit(""))
    d = d.select("batch", "candidate", "tier", "diversity_group", "suggestion_rank", F.coalesce("override", F.lit("")).alias("override"), F.coalesce("status", F.lit("")).alias("status"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_o=(part["override"] != "include").astype(int)).sort_values(["_o", "suggestion_rank", "candidate"])
        used, tiers, groups, waiting, decision = 0, {}, {}, 0, []
        for r in part.itertuples():
            if r.override == "exclude" or r.status in ("completed", "cancelled"):
                decision.append("excluded")
                continue
            room = used < total and (r.override == "include" or tiers.get(r.tier, 0) < per_tier.get(r.tier, total) and groups.get(r.diversity_group, 0) < per_group)
            if room:
                used += 1
                tiers[r.tier] = tiers.get(r.tier, 0) + 1
                groups[r.diversity_group] = groups.get(r.diversity_group, 0) + 1
                decision.append("include")
            elif waiting < standby:
                waiting += 1
                decision.append("standby")
            else:
                decision.append("deferred")
        return part.assign(plan=decision)[["batch", "candidate", "tier", "diversity_group", "suggestion_rank", "plan"]]

    return d.groupBy("batch").applyInPandas(walk, "batch long, candidate long, tier string, diversity_group string, suggestion_rank int, plan string")


def next_ledger(planned: DataFrame) -> DataFrame:
    """Ledger of the next round: included rows without a status become ``planned``."""
    return planned.withColumn("status", F.when(F.col("included") & (clean_text("status") == ""), "planned").otherwise(clean_text("status")))


def union_history(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; missing columns are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def latest_state(history: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last record of each key in descending ``order``, and how many it has."""
    w = Window.partitionBy(key)
    return history.withColumn("n_records", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(*order))).filter("_r = 1").drop("_r")


def merge_ledgers(history: DataFrame, aliases: dict[str, list[str]], key: str = "candidate") -> DataFrame:
    """History with alias columns joined into one and override tokens normalised, then the latest state of each key.

    ``history`` has run_time, source_time, source_priority and row_id for the order; times
    in text that are missing or no times count as the least.
    """
    texts = [f.name for f in history.schema if f.name in ("run_time", "source_time") and f.dataType.simpleString() == "string"]
    history = history.withColumns({c: time_or_min(c) for c in texts})
    for name, options in aliases.items():
        history = history.withColumn(name, first_nonempty(*(o for o in options if o in history.columns)))
    if "override" in aliases:
        t = token("override")
        history = history.withColumn("override", F.when(t.isin("include", "force_include", "yes"), "include").when(t.isin("exclude", "skip", "no"), "exclude").otherwise(t))
    return latest_state(history, key, [F.desc_nulls_last("run_time"), F.desc_nulls_last("source_time"), F.asc("source_priority"), F.desc("row_id")])


#: Words for a positive and a negative result, and for states of an experiment.
POSITIVE = ("positive", "pos", "hit", "pass", "passed", "success", "active", "blocked", "yes", "true", "1")
NEGATIVE = ("negative", "neg", "miss", "fail", "failed", "inactive", "no_effect", "no", "false", "0")
OPEN_STATES = ("planned", "in_progress", "running", "queued")


def infer_validation(ledger: DataFrame) -> DataFrame:
    """Label, readiness, category and use of each record, from its label, else its result, else its status.

    A number above 0.5 is positive, zero or less negative; between, neither.
    """
    value = clean_text("validation_label").try_cast("double")
    marked = token("validation_label")
    from_label = F.when(value >= 0.5, 1).when(value <= 0, 0).when(marked.isin(*POSITIVE), 1).when(marked.isin(*NEGATIVE), 0)
    result = token("result")
    from_result = F.when(result.isin(*POSITIVE), 1).when(result.isin(*NEGATIVE), 0)
    label = F.coalesce(from_label, from_result)
    status = token("status")
    category = F.when(from_label.isNotNull(), "explicit_label").when(from_result.isNotNull(), "result").when(status == "completed", "completed_without_result").when(status.isin(*OPEN_STATES), "open").when(status.isin("blocked", "cancelled"), "stopped").otherwise("no_evidence")
    d = ledger.withColumn("inferred_label", label).withColumn("ready", label.isNotNull()).withColumn("category", category)
    return d.withColumn("use", F.when(F.col("ready"), "calibrate").when(F.col("category") == "completed_without_result", "fill_result").when(F.col("category") == "open", "wait").otherwise("ignore"))


def best_evidence(sources: DataFrame, key: str = "candidate") -> DataFrame:
    """The best record of each key: ready first, then source priority, then status priority, then the later row."""
    order = [F.desc("ready"), F.asc("source_priority"), F.desc("status_priority"), F.desc("row_id")]
    return sources.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def evidence_audit(ranked: DataFrame, evidence: DataFrame, k: int = 10) -> DataFrame:
    """Evidence of each ranked candidate, its gap, and what to do about the first ``k``."""
    d = ranked.join(best_evidence(evidence), "candidate", "left")
    top = F.col("rank") <= k
    gap = F.when(F.coalesce(F.col("ready"), F.lit(False)), "none").when(F.col("source_priority").isNull(), "no_record").when(F.col("category") == "completed_without_result", "missing_result").otherwise("not_finished")
    d = d.withColumn("in_top", top).withColumn("gap", gap)
    return d.withColumn("action", F.when((gap == "none") | ~top, "none").when(gap == "missing_result", "record_result").when(gap == "no_record", "plan_validation").otherwise("finish_validation"))


def audit_status(audit: DataFrame, warn: float = 0.5) -> DataFrame:
    """Coverage of the first ranks and a status: FAIL without any, WARN below the share, else PASS."""
    d = audit.agg(F.count_if("in_top").alias("n_top"), F.count_if(F.col("in_top") & (F.col("gap") == "none")).alias("n_ready"), F.count_if(F.col("action") != "none").alias("n_actions"))
    share = F.when(F.col("n_top") > 0, F.col("n_ready") / F.col("n_top")).otherwise(0.0)
    return d.withColumn("coverage", share).withColumn("status", F.when(F.col("n_ready") == 0, "FAIL").when(share < warn, "WARN").otherwise("PASS"))
