"""The rule-based risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

HIGHEST = sum(rule[2] for rule in fixed.RISK_RULES)


def checks(use_btw: bool = False) -> dict[str, Column]:
    """Rule -> whether it holds, over the columns emails, phones, addresses, kvk, btw, ibans (arrays, null: none), four page
    flags, kvk_number, has_ssl, is_expired, domain_age, total_verified, claimed_not_verified and flagged. Missing evidence fails
    a rule, but passes no_foreign_iban, no_fake_tm and not_in_scam_db. has_btw holds only with use_btw."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    ibans = F.coalesce("ibans", F.array().cast("array<string>"))
    return {
        "has_address": some("addresses"),
        "has_email": some("emails"),
        "has_phone": some("phones"),
        "has_kvk": some("kvk"),
        "has_btw": some("btw") if use_btw else F.lit(False),
        "kvk_verified": F.coalesce(F.col("kvk_number") != "", F.lit(False)),
        "has_contact_page": true("has_contact"),
        "has_privacy": true("has_privacy_page"),
        "has_terms": true("has_terms_page"),
        "has_returns": true("has_return_page"),
        "has_nl_iban": F.exists(ibans, lambda x: F.upper(x).startswith("NL")),
        "no_foreign_iban": ~F.exists(ibans, lambda x: ~F.upper(x).startswith("NL")),
        "has_ssl": true("has_ssl") & ~true("is_expired"),
        "domain_age_1yr": F.coalesce(F.col("domain_age"), F.lit(0)) >= 365,
        "domain_age_2yr": F.coalesce(F.col("domain_age"), F.lit(0)) >= 730,
        "has_verified_tm": F.coalesce(F.col("total_verified"), F.lit(0)) > 0,
        "no_fake_tm": F.coalesce(F.col("claimed_not_verified"), F.lit(0)) == 0,
        "not_in_scam_db": ~true("flagged"),
    }


def level(score: Column) -> Column:
    t = fixed.RISK_THRESHOLDS
    return F.when(score >= t["low"], "low").when(score >= t["medium"], "medium").when(score >= t["high"], "high").otherwise("critical")


def scored(facts: DataFrame, key: str, use_btw: bool = False) -> DataFrame:
    """facts -> key, raw, score (0 to 100, one decimal), risk_level, tips (of failed rules with a deduction, the largest first)."""
    held = checks(use_btw)
    raw = sum((F.when(held[k], points).otherwise(-malus) for k, _, points, malus, _ in fixed.RISK_RULES), F.lit(0))
    tips = F.array(*[
        F.when(~held[k], F.struct(F.lit(-malus).alias("order"), F.lit(n).alias("rule_no"), F.lit(k).alias("rule"), F.lit(tip).alias("tip")))
        for n, (k, _, _, malus, tip) in enumerate(fixed.RISK_RULES) if malus > 0
    ])
    tips = F.transform(F.array_sort(F.filter(tips, lambda t: t.isNotNull())), lambda t: F.struct((-t["order"]).alias("malus"), t["rule"].alias("rule"), t["tip"].alias("tip")))
    score = F.round(F.greatest(F.lit(0), F.col("raw")) / HIGHEST * 100, 1)
    return facts.select(key, raw.alias("raw"), tips.alias("tips")).select(key, "raw", score.alias("score"), level(score).alias("risk_level"), "tips")


def rules(spark) -> DataFrame:
    rows = [(n, *rule) for n, rule in enumerate(fixed.RISK_RULES)]
    return spark.createDataFrame(rows, "rule_no int, rule string, label string, points int, malus int, tip string")
