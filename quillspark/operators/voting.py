"""Consensus of model votes, escalation over tiers, agreement and costs.

A vote table has unit_id, vote_ord (order within the unit), tier, verdict,
confidence, reasoning and quote columns. Every operator is one aggregation per
unit: the verdict domain is fixed, so counts by verdict are conditional sums,
combined before the one shuffle on unit_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.records import distinct_quotes

ABSTAIN, ESCALATE = "cannot_verify", "contradicted"
ACTIVE = ("supported", "partially_supported", "not_supported", "contradicted")
UNANIMOUS_BONUS, MAJORITY_PENALTY, FALLBACK_PENALTY = 0.05, 0.03, 0.1
#: Claim types that follow the strict opinion.
CONSERVATIVE = ("factual", "contrast", "methodological")


def vote_sums(prefix: str, where: Column) -> list[Column]:
    """Per verdict: votes, their confidence, and the first one's order; for the votes that ``where`` holds for."""
    out = [F.count_if(where).alias(f"{prefix}_all")]
    for v in ACTIVE:
        own = where & (F.col("verdict") == v)
        out += [
            F.count_if(own).alias(f"{prefix}_n_{v}"),
            F.sum(F.when(own, F.col("confidence"))).alias(f"{prefix}_c_{v}"),
            F.min(F.when(own, F.col("vote_ord"))).alias(f"{prefix}_o_{v}"),
        ]
    return out


def consensus_of(prefix: str) -> Column:
    """struct(verdict, confidence, consensus_type, agreement_ratio) from the sums of ``vote_sums``.

    Any contradiction escalates; abstentions don't count; then unanimity, two
    thirds and half decide, and the earliest of equally frequent verdicts leads.
    """
    n = lambda v: F.col(f"{prefix}_n_{v}")
    total = sum((n(v) for v in ACTIVE[1:]), n(ACTIVE[0]))
    top = F.array_max(F.array(*(F.struct(n(v).alias("n"), (-F.col(f"{prefix}_o_{v}")).alias("o"), F.lit(v).alias("v"), F.col(f"{prefix}_c_{v}").alias("c")) for v in ACTIVE)))
    ratio, mean = top["n"] / total, top["c"] / top["n"]

    def result(verdict, confidence, kind, agreement):
        return F.struct(
            verdict.alias("verdict"), F.round(confidence, 3).alias("confidence"), F.lit(kind).alias("consensus_type"), F.round(agreement, 3).alias("agreement_ratio")
        )

    zero, one = F.lit(0.0), F.lit(1.0)
    return (
        F.when(F.col(f"{prefix}_all") == 0, result(F.lit(ABSTAIN), zero, "no_votes", zero))
        .when(n(ESCALATE) > 0, result(F.lit("escalate"), zero, "escalate", zero))
        .when(total == 0, result(F.lit(ABSTAIN), zero, "all_abstain", one))
        .when(top["n"] == total, result(top["v"], F.least(one, mean + UNANIMOUS_BONUS), "unanimous", one))
        .when(top["n"] * 3 >= total * 2, result(top["v"], mean, "supermajority", ratio))
        .when(top["n"] * 2 > total, result(top["v"], F.greatest(zero, mean - MAJORITY_PENALTY), "majority", ratio))
        .otherwise(result(F.lit("escalate"), zero, "escalate", zero))
    )


def determine_consensus(votes: DataFrame) -> DataFrame:
    """One row per unit: verdict, confidence, consensus_type, agreement_ratio, n_votes."""
    sums = votes.groupBy("unit_id").agg(*vote_sums("v", F.lit(True)))
    return sums.select("unit_id", consensus_of("v").alias("r"), F.col("v_all").alias("n_votes")).select("unit_id", "r.*", "n_votes")


def agreement(prefix: str, verdict: Column) -> Column:
    """Share of the active votes that have ``verdict``, 0 without any."""
    counts = {v: F.col(f"{prefix}_n_{v}") for v in ACTIVE}
    total = sum(list(counts.values())[1:], counts[ACTIVE[0]])
    own = F.coalesce(*(F.when(verdict == v, c) for v, c in counts.items()), F.lit(0))
    return F.when(total == 0, 0.0).otherwise(F.round(own / total, 3))


def escalate(votes: DataFrame) -> DataFrame:
    """Tiers 0 and 1 decide by all votes so far; tier 2's and then tier 3's first vote decides alone; else the most confident vote.

    A tier without votes is skipped. final_tier, escalation_path (tiers that voted, as text) and agreement_ratio come with the verdict.
    """
    first = lambda t: F.min(F.when(F.col("tier") == t, F.struct("vote_ord", "verdict", "confidence"))).alias(f"first{t}")
    best = F.max(F.struct(F.col("confidence"), (-F.col("vote_ord")).alias("o"), F.col("verdict"), F.col("tier"))).alias("best")
    has = [F.max(F.col("tier") == t).alias(f"has{t}") for t in range(4)]
    sums = votes.groupBy("unit_id").agg(
        *vote_sums("t0", F.col("tier") <= 0), *vote_sums("t1", F.col("tier") <= 1), *vote_sums("t2", F.col("tier") <= 2), *vote_sums("t3", F.lit(True)), first(2), first(3), best, *has
    )

    def step(result: Column, tier: Column, last: int) -> Column:
        path = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"has{t}"), F.lit(str(t))) for t in range(last + 1)))), ">")
        return F.struct(result["verdict"].alias("verdict"), result["confidence"].alias("confidence"), result["consensus_type"].alias("consensus_type"), result["agreement_ratio"].alias("agreement_ratio"), tier.alias("final_tier"), path.alias("escalation_path"))

    def single(vote: Column, kind: str, confidence: Column, prefix: str) -> Column:
        return F.struct(vote["verdict"].alias("verdict"), confidence.alias("confidence"), F.lit(kind).alias("consensus_type"), agreement(prefix, vote["verdict"]).alias("agreement_ratio"))

    by_votes = [consensus_of(f"t{t}") for t in range(3)]
    settled = [F.col(f"has{t}") & (by_votes[t]["consensus_type"] != "escalate") for t in range(3)]
    two, three, most = F.col("first2"), F.col("first3"), F.col("best")
    decided = (
        F.when(settled[0], step(by_votes[0], F.lit(0), 0))
        .when(settled[1], step(by_votes[1], F.lit(1), 1))
        .when(F.col("has2"), step(single(two, "tiebreaker", two["confidence"], "t2"), F.lit(2), 2))
        .when(F.col("has3"), step(single(three, "tiebreaker", three["confidence"], "t3"), F.lit(3), 3))
        .otherwise(step(single(most, "fallback", F.greatest(F.lit(0.0), most["confidence"] - FALLBACK_PENALTY), "t3"), most["tier"], 3))
    )
    return sums.select("unit_id", decided.alias("d")).select("unit_id", "d.*")


def merge_evidence(votes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per unit of ``verdicts`` (unit_id, verdict): reasoning of the most confident agreeing vote (the earliest of equals),
    and the agreeing votes' different quotes, in order, joined by ' | '. Where nobody agrees, all votes count."""
    joined = votes.join(verdicts.select("unit_id", F.col("verdict").alias("agreed")), "unit_id")
    agrees = F.col("verdict") == F.col("agreed")
    some = F.max(agrees).over(Window.partitionBy("unit_id"))
    used = joined.withColumn("some", some).filter(agrees | ~F.col("some")).withColumn("key", F.lower(F.trim("quote")))
    once = F.row_number().over(Window.partitionBy("unit_id", "key").orderBy("vote_ord"))
    quotes = F.array_sort(F.collect_list(F.when((F.col("nth") == 1) & (F.col("key") != ""), F.struct("vote_ord", "quote"))))
    return (
        used.withColumn("nth", once)
        .groupBy("unit_id")
        .agg(F.max_by("reasoning", F.struct(F.col("confidence"), -F.col("vote_ord"))).alias("reasoning"), quotes.alias("q"))
        .select("unit_id", "reasoning", F.array_join(F.transform("q", lambda x: x["quote"]), " | ").alias("quotes"))
    )


def _opinion(name: str, field: str) -> Column:
    return F.col(f"{name}_{field}")


def _merged(pairs: DataFrame, verdict: Column, review: Column, reasoning: Column, coverage: Column, tier: int) -> DataFrame:
    """Two opinions a and b as one: agreement raises the mean confidence, and a disagreement keeps the mean."""
    same = F.col("a_verdict") == F.col("b_verdict")
    mean = (F.col("a_confidence") + F.col("b_confidence")) / 2
    return pairs.select(
        "unit_id",
        F.when(same, F.col("a_verdict")).otherwise(verdict).alias("verdict"),
        F.when(same, F.bround(F.least(F.lit(1.0), mean + UNANIMOUS_BONUS), 3)).otherwise(F.bround(mean, 3)).alias("confidence"),
        reasoning.alias("reasoning"),
        distinct_quotes(F.col("a_quotes"), F.col("b_quotes")).alias("quotes"),
        F.when(same, F.col("a_coverage")).otherwise(coverage).alias("source_coverage"),
        (~same & review).alias("needs_review"),
        F.lit(tier).alias("tier"),
    )


def merge_strategies(pairs: DataFrame) -> DataFrame:
    """A strict opinion a and a generous one b of a unit into one of tier 2.

    ``pairs``: unit_id, claim_type, and verdict, confidence, reasoning, quotes and coverage of each. An opinion that could
    not verify gives way to one that could, without review. Else claims of facts, contrasts and methods follow the strict
    opinion and others the generous one, for review.
    """
    a, b = F.col("a_verdict"), F.col("b_verdict")
    one_failed = (a == ABSTAIN) != (b == ABSTAIN)
    strict = F.when(one_failed, b == ABSTAIN).otherwise(F.col("claim_type").isin(*CONSERVATIVE))
    apart = F.concat(F.lit("[Strict \u2192 "), a, F.lit("] "), "a_reasoning", F.lit("\n[Generous \u2192 "), b, F.lit("] "), "b_reasoning")
    together = F.concat(F.lit("[Strict] "), "a_reasoning", F.lit("\n[Generous] "), "b_reasoning")
    covered = F.coalesce(F.nullif("a_coverage", F.lit("")), F.col("b_coverage"))
    return _merged(pairs, F.when(strict, a).otherwise(b), ~one_failed, F.when(a == b, together).otherwise(apart), covered, 2)


def merge_models(pairs: DataFrame) -> DataFrame:
    """An opinion a of tier 2 and that of a second model b into one of tier 3, columns as in ``merge_strategies``.

    A first opinion that could not verify gives way to the second, without review; else it stands, for review.
    """
    a, b = F.col("a_verdict"), F.col("b_verdict")
    failed = a == ABSTAIN
    apart = F.concat(F.lit("[Primary \u2192 "), a, F.lit("] "), "a_reasoning", F.lit("\n[Secondary \u2192 "), b, F.lit("] "), "b_reasoning")
    together = F.concat("a_reasoning", F.lit("\n[Secondary model] "), "b_reasoning")
    covered = F.coalesce(F.nullif("b_coverage", F.lit("")), F.col("a_coverage"))
    return _merged(pairs, F.when(failed, b).otherwise(a), ~failed, F.when(a == b, together).otherwise(apart), covered, 3)


def cost_summary(calls: DataFrame) -> DataFrame:
    """Calls and cost by model, by task, by tier and in all, by grouping sets over one scan; cost rounded to 4 digits."""
    return (
        calls.groupingSets([["model"], ["task"], ["tier"], []], "model", "task", "tier")
        .agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
        .select("model", "task", "tier", "calls", "cost_usd")
    )


def call_cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column) -> Column:
    """Dollars from tokens and rates per million, rounded to 6 digits."""
    return F.round(input_tokens / 1e6 * input_rate + output_tokens / 1e6 * output_rate, 6)


def running_cost(calls: DataFrame, key: str, order: list[str], limit: float) -> DataFrame:
    """Running cost per key and whether it has passed the limit."""
    total = F.sum("cost_usd").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("running_cost", total).withColumn("over_limit", F.col("running_cost") > limit)


def jury(votes: DataFrame) -> DataFrame:
    """Majority verdict without abstentions (the earliest of equals) and how many active votes dissent."""
    sums = votes.groupBy("unit_id").agg(*vote_sums("v", F.lit(True)))
    n = [F.col(f"v_n_{v}") for v in ACTIVE]
    top = F.array_max(F.array(*(F.struct(F.col(f"v_n_{v}").alias("n"), (-F.col(f"v_o_{v}")).alias("o"), F.lit(v).alias("v")) for v in ACTIVE)))
    total = sum(n[1:], n[0])
    return sums.select("unit_id", F.when(total > 0, top["v"]).alias("majority"), F.when(total > 0, total - top["n"]).otherwise(0).alias("dissenters"))


def votes_by_tier(votes: DataFrame) -> DataFrame:
    """Per unit and tier, verdicts in order, joined by commas."""
    ordered = F.array_sort(F.collect_list(F.struct("vote_ord", "verdict")))
    return votes.groupBy("unit_id", "tier").agg(F.array_join(F.transform(ordered, lambda x: x["verdict"]), ",").alias("verdicts"))


VERDICTS = ("supported", "partially_supported", "not_supported", "contradicted", "cannot_verify")


def results_of_consensus(consensus: DataFrame) -> DataFrame:
    """Results of consensus rows: ``escalate`` and unknown verdicts become cannot_verify, confidence is kept within 0 and 1,
    and contradicted ones need review."""
    verdict = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("cannot_verify")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    return consensus.withColumns({"verdict": verdict, "confidence": clamped}).withColumn("needs_review", F.col("verdict") == "contradicted")


def finalize_single(results: DataFrame, pairs: DataFrame, tier: int = 2) -> DataFrame:
    """A lone strategy's results (unit_id, ...) under the claim and reference that were asked about, as of ``tier``."""
    kept = [c for c in results.columns if c not in ("unit_id", "claim_id", "ref_num", "tier")]
    return results.select("unit_id", *kept).join(pairs.select("unit_id", "claim_id", "ref_num"), "unit_id").select("claim_id", "ref_num", *kept, F.lit(tier).alias("tier"))


def available_models(models: DataFrame, providers: DataFrame) -> DataFrame:
    """Models (model, provider, tier) of providers that have a key, the most capable tiers first."""
    return models.join(providers.filter("has_key").select("provider").distinct(), "provider", "left_semi").orderBy(F.desc("tier"), "ord")
