"""Queries of the voting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import voting as V
from quillspark.plans.stand_ins import VOTES, for_duckdb, load, stand_in


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir, VOTES)


def l01_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.determine_consensus(votes(spark, sf_dir))


def l02_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.escalate(votes(spark, sf_dir))


def l04_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = votes(spark, sf_dir)
    return V.merge_evidence(table, V.determine_consensus(table))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    cost = V.call_cost(F.col("l_quantity") * 1000, F.col("l_quantity") * 250, F.lit(0.5), F.lit(2.0))
    return lines.select(
        F.concat(F.lit("model"), (F.col("l_suppkey") % 7).cast("string")).alias("model"),
        F.concat(F.lit("verification_tier"), (F.col("l_linenumber") % 4).cast("string")).alias("task"),
        (F.col("l_linenumber") % 4).alias("tier"),
        cost.alias("cost_usd"),
    )


def l05_cost_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cost_summary(calls(spark, sf_dir))


def l06_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.round(F.col("value") * 64) / 64).alias("cost_usd"))
    return V.running_cost(events, "user_id", ["ts", "event_id"], 50.0).select("user_id", "event_id", "running_cost", "over_limit")


def l07_jury(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jury(votes(spark, sf_dir))


def l08_votes_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.votes_by_tier(votes(spark, sf_dir))


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two votes of a unit as opinions, with a claim type."""
    one = votes(spark, sf_dir).select("unit_id", "vote_ord", "verdict", "confidence", "reasoning", F.array("quote").alias("quotes"), F.when(F.col("vote_ord") == 1, F.when(F.col("unit_id") % 4 > 0, "full_text").otherwise("")).otherwise("abstract").alias("coverage"))
    side = lambda n, c: one.filter(F.col("vote_ord") == n).select("unit_id", *(F.col(x).alias(f"{c}_{x}") for x in ("verdict", "confidence", "reasoning", "quotes", "coverage")))
    kinds = F.array(*map(F.lit, ("factual", "contrast", "methodological", "background", "attribution", "interpretive")))
    return side(1, "a").join(side(2, "b"), "unit_id").withColumn("claim_type", F.get(kinds, (F.col("unit_id") % 6).cast("int")))


def l19_merge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_strategies(opinions(spark, sf_dir)).withColumn("quotes", F.array_join("quotes", "|"))


def l27_merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_models(opinions(spark, sf_dir)).withColumn("quotes", F.array_join("quotes", "|"))


_V = f"WITH v AS ({for_duckdb(VOTES)})"
_TWO = """p AS (SELECT a.unit_id, a.verdict AS av, b.verdict AS bv, a.reasoning AS ar, b.reasoning AS br, CASE WHEN lower(trim(a.quote)) = lower(trim(b.quote)) THEN a.quote ELSE a.quote || '|' || b.quote END AS quotes,
  CASE WHEN a.verdict = b.verdict THEN round_even(least(1.0, (a.confidence + b.confidence) / 2 + 0.05), 3) ELSE round_even((a.confidence + b.confidence) / 2, 3) END AS confidence FROM v a JOIN v b USING (unit_id) WHERE a.vote_ord = 1 AND b.vote_ord = 2)"""
_COUNT = """
  SELECT unit_id, verdict, count(*) AS n, avg(confidence) AS c, min(vote_ord) AS o FROM v WHERE verdict <> 'cannot_verify' {more} GROUP BY unit_id, verdict"""


def _consensus(where: str, name: str) -> str:
    """CTEs that give table ``name`` (unit_id, verdict, confidence, consensus_type, agreement_ratio, n_votes) of the votes in ``where``."""
    return f"""
{name}_c AS ({_COUNT.format(more='AND ' + where)}),
{name}_t AS (SELECT unit_id, sum(n) AS total, max(CASE WHEN verdict = 'contradicted' THEN 1 ELSE 0 END) AS bad, arg_max(struct_pack(v := verdict, n := n, c := c), n * 1000 - o) AS top FROM {name}_c GROUP BY unit_id),
{name}_a AS (SELECT unit_id, count(*) AS n_votes FROM v WHERE {where} GROUP BY unit_id),
{name} AS (SELECT a.unit_id, n_votes,
  CASE WHEN bad = 1 THEN 'escalate' WHEN total IS NULL THEN 'all_abstain' WHEN top.n = total THEN 'unanimous' WHEN top.n * 3 >= total * 2 THEN 'supermajority' WHEN top.n * 2 > total THEN 'majority' ELSE 'escalate' END AS consensus_type,
  CASE consensus_type WHEN 'escalate' THEN 'escalate' WHEN 'all_abstain' THEN 'cannot_verify' ELSE top.v END AS verdict,
  CASE consensus_type WHEN 'unanimous' THEN round(least(1.0, top.c + 0.05), 3) WHEN 'supermajority' THEN round(top.c, 3) WHEN 'majority' THEN round(greatest(0.0, top.c - 0.03), 3) ELSE 0.0 END::DOUBLE AS confidence,
  CASE consensus_type WHEN 'escalate' THEN 0.0 WHEN 'all_abstain' THEN 1.0 WHEN 'unanimous' THEN 1.0 ELSE round(top.n / total, 3) END::DOUBLE AS agreement_ratio
  FROM {name}_a a LEFT JOIN {name}_t USING (unit_id))"""


_L02 = f"""{_V},
{_consensus('tier <= 0', 't0')},
{_consensus('tier <= 1', 't1')},
firsts AS (SELECT unit_id, arg_min(verdict, vote_ord) FILTER (tier = 2) AS v2, arg_min(confidence, vote_ord) FILTER (tier = 2) AS c2,
    arg_min(verdict, vote_ord) FILTER (tier = 3) AS v3, arg_min(confidence, vote_ord) FILTER (tier = 3) AS c3,
    arg_max(verdict, confidence * 100000 - vote_ord) AS vb, max(confidence) AS cb, arg_max(tier, confidence * 100000 - vote_ord) AS tb,
    max(tier = 0) AS h0, max(tier = 1) AS h1, max(tier = 2) AS h2, max(tier = 3) AS h3 FROM v GROUP BY unit_id),
pick AS (SELECT f.*, CASE WHEN h0 AND t0.consensus_type <> 'escalate' THEN 0 WHEN h1 AND t1.consensus_type <> 'escalate' THEN 1 WHEN h2 THEN 2 WHEN h3 THEN 3 ELSE 4 END AS way,
    t0.verdict AS a_v, t0.confidence AS a_c, t0.consensus_type AS a_t, t0.agreement_ratio AS a_r, t1.verdict AS b_v, t1.confidence AS b_c, t1.consensus_type AS b_t, t1.agreement_ratio AS b_r
  FROM firsts f LEFT JOIN t0 USING (unit_id) LEFT JOIN t1 USING (unit_id)),
named AS (SELECT *, CASE way WHEN 0 THEN a_v WHEN 1 THEN b_v WHEN 2 THEN v2 WHEN 3 THEN v3 ELSE vb END AS verdict FROM pick),
agree AS (SELECT unit_id, coalesce(round(count(*) FILTER (v.verdict = n.verdict AND v.verdict <> 'cannot_verify') / nullif(count(*) FILTER (v.verdict <> 'cannot_verify'), 0), 3), 0.0) AS r
  FROM named n JOIN v USING (unit_id) WHERE way >= 3 OR v.tier <= 2 GROUP BY unit_id)
SELECT unit_id, verdict, CASE way WHEN 0 THEN a_c WHEN 1 THEN b_c WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE greatest(0.0, cb - 0.1) END::DOUBLE AS confidence,
  CASE way WHEN 0 THEN a_t WHEN 1 THEN b_t WHEN 2 THEN 'tiebreaker' WHEN 3 THEN 'tiebreaker' ELSE 'fallback' END AS consensus_type,
  CASE way WHEN 0 THEN a_r WHEN 1 THEN b_r ELSE r END::DOUBLE AS agreement_ratio,
  CASE way WHEN 4 THEN tb ELSE way END::INT AS final_tier,
  concat_ws('>', CASE WHEN h0 THEN '0' END, CASE WHEN h1 AND way >= 1 THEN '1' END, CASE WHEN h2 AND way >= 2 THEN '2' END, CASE WHEN h3 AND way >= 3 THEN '3' END) AS escalation_path
FROM named JOIN agree USING (unit_id)"""

_CALLS = """WITH c AS (SELECT 'model' || (l_suppkey % 7) AS model, 'verification_tier' || (l_linenumber % 4) AS task, l_linenumber % 4 AS tier,
  round(l_quantity * 1000 / 1e6 * 0.5 + l_quantity * 250 / 1e6 * 2.0, 6) AS cost_usd FROM lineitem)"""

QUERIES = {f.__name__: f for f in (l01_consensus, l02_escalation, l04_merge_evidence, l05_cost_grouping_sets, l06_running_cost, l07_jury, l08_votes_by_tier, l19_merge_strategies, l27_merge_models)}
ORACLE = {
    "l01_consensus": f"{_V}, {_consensus('true', 'x')} SELECT unit_id, verdict, confidence, consensus_type, agreement_ratio, n_votes FROM x",
    "l02_escalation": _L02,
    "l04_merge_evidence": f"""{_V}, {_consensus('true', 'x')},
      u AS (SELECT v.*, lower(trim(quote)) AS key FROM v JOIN x USING (unit_id)
        WHERE v.verdict = x.verdict OR NOT EXISTS (SELECT 1 FROM v w WHERE w.unit_id = v.unit_id AND w.verdict = x.verdict)),
      q AS (SELECT *, row_number() OVER (PARTITION BY unit_id, key ORDER BY vote_ord) AS nth FROM u)
      SELECT unit_id, arg_max(reasoning, confidence * 100000 - vote_ord) AS reasoning, coalesce(string_agg(CASE WHEN nth = 1 THEN quote END, ' | ' ORDER BY vote_ord), '') AS quotes FROM q GROUP BY unit_id""",
    "l05_cost_grouping_sets": f"{_CALLS} SELECT model, task, tier, count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd FROM c GROUP BY GROUPING SETS ((model), (task), (tier), ())",
    "l06_running_cost": """WITH e AS (SELECT *, round(value * 64) / 64 AS c FROM events)
      SELECT user_id, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_cost,
        sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 50.0 AS over_limit FROM e""",
    "l07_jury": f"""{_V}, c AS ({_COUNT.format(more='')}), u AS (SELECT DISTINCT unit_id FROM v)
      SELECT unit_id, arg_max(verdict, n * 1000 - o) AS majority, coalesce(sum(n) - max(n), 0)::BIGINT AS dissenters FROM u LEFT JOIN c USING (unit_id) GROUP BY unit_id""",
    "l08_votes_by_tier": f"{_V} SELECT unit_id, tier, string_agg(verdict, ',' ORDER BY vote_ord) AS verdicts FROM v GROUP BY unit_id, tier",
    "l19_merge_strategies": f"""{_V}, {_TWO} SELECT unit_id, CASE WHEN av = bv THEN av WHEN (av = 'cannot_verify') <> (bv = 'cannot_verify') THEN CASE WHEN bv = 'cannot_verify' THEN av ELSE bv END WHEN unit_id % 6 < 3 THEN av ELSE bv END AS verdict, confidence,
      CASE WHEN av = bv THEN '[Strict] ' || ar || chr(10) || '[Generous] ' || br ELSE '[Strict → ' || av || '] ' || ar || chr(10) || '[Generous → ' || bv || '] ' || br END AS reasoning, quotes,
      CASE WHEN unit_id % 4 > 0 THEN 'full_text' WHEN av = bv THEN '' ELSE 'abstract' END AS source_coverage, av <> bv AND (av = 'cannot_verify') = (bv = 'cannot_verify') AS needs_review, 2 AS tier FROM p""",
    "l27_merge_models": f"""{_V}, {_TWO} SELECT unit_id, CASE WHEN av = 'cannot_verify' THEN bv ELSE av END AS verdict, confidence,
      CASE WHEN av = bv THEN ar || chr(10) || '[Secondary model] ' || br ELSE '[Primary → ' || av || '] ' || ar || chr(10) || '[Secondary → ' || bv || '] ' || br END AS reasoning, quotes,
      CASE WHEN av <> bv THEN 'abstract' WHEN unit_id % 4 > 0 THEN 'full_text' ELSE '' END AS source_coverage, av <> bv AND av <> 'cannot_verify' AS needs_review, 3 AS tier FROM p""",
}
