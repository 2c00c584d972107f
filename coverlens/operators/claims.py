"""Is a defect claimable? Keyword flags, one rule per issue, texts from a fixed table.

All of it is a projection plus broadcast equi joins: nothing is shuffled.
"""
from pyspark.sql import DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.text import contains_any, strip
from coverlens.operators.enrich import with_mentioned_brand, with_policy_note
from coverlens.sources.dims import dim


def with_claim_flags(df: DataFrame, issue_col: str = "issue") -> DataFrame:
    low = df.withColumn("_issue", F.lower(F.coalesce(F.col(issue_col), F.lit(""))))
    return low.withColumns({flag: contains_any("_issue", words) for flag, words in V.CLAIM_FLAGS.items()}).drop("_issue")


def with_claim_rule(df: DataFrame) -> DataFrame:
    """Number of the first rule that applies; needs the flags."""
    low = df.withColumns({"_t": F.lower(F.coalesce("issue", F.lit(""))),
                          "_b": strip(F.lower(F.coalesce("brand", F.lit("")))),
                          "_c": strip(F.lower(F.coalesce("category", F.lit(""))))})
    known_line = contains_any("_b", V.GREEN_LINE_BRANDS) | contains_any("_t", V.GREEN_LINE_BRANDS)
    audio = (F.col("has_audio_issue") | F.col("_c").contains(V.AUDIO_WORD) | F.col("_t").contains(V.AUDIO_WORD)
             | contains_any("_b", V.AUDIO_BRANDS))
    appliance = F.col("has_appliance_issue") | contains_any("_c", V.APPLIANCE_CATEGORIES)
    rule = (F.when(F.col("has_green_line") & known_line, 1)
            .when(F.col("has_physical_crack") & ~F.col("has_green_line"), 2)
            .when(F.col("has_water_damage"), 3).when(audio, 4).when(appliance, 5).otherwise(6))
    return low.withColumn("rule_id", rule).drop("_t", "_b", "_c")


def with_verdict(df: DataFrame) -> DataFrame:
    """Verdict and answer texts of the rule; an old product makes rule 6 conditional."""
    out = df.join(dim(df.sparkSession, "claim_rule"), "rule_id")
    aged = (F.col("rule_id") == 6) & F.coalesce(F.col("days_since_purchase") > V.STANDARD_COVER_DAYS, F.lit(False))
    return (out.withColumn("verdict", F.when(aged, V.CONDITIONAL_VERDICT).otherwise(F.col("verdict")))
            .withColumn("verdict_emoji", F.when(aged, V.CONDITIONAL_EMOJI).otherwise(F.col("verdict_emoji"))))


DIAGNOSIS_FIELDS = ["verdict", "verdict_emoji", "verdict_title", "confidence", "explanation",
                    "service_center_advice", "lost_bill_tip", "brand_policy_note", "action_steps"]


def diagnose_claims(df: DataFrame) -> DataFrame:
    """Adds ``diagnosis``, the flags and the rule to (issue, brand, category, days_since_purchase)."""
    out = with_verdict(with_claim_rule(with_claim_flags(df)))
    out = with_policy_note(out, "brand", "issue")
    return (out.withColumn("diagnosis", F.struct(*DIAGNOSIS_FIELDS))
            .drop(*DIAGNOSIS_FIELDS, "policy_key"))


def claim_answer(df: DataFrame) -> DataFrame:
    """Diagnosis from the text alone, the brand it mentions and the steps as one text."""
    free = (df.withColumn("brand", F.lit(None).cast("string")).withColumn("category", F.lit(None).cast("string"))
            .withColumn("days_since_purchase", F.lit(None).cast("int")))
    out = with_mentioned_brand(diagnose_claims(free), "issue")
    steps = F.transform("diagnosis.action_steps", lambda s: F.concat(F.lit("• "), s))
    return out.withColumn("steps_text", F.array_join(steps, "\n"))
