"""Claim check: from free issue texts to an answer each, without any shuffle."""
from pyspark.sql import DataFrame

from coverlens.operators.claims import claim_answer
from coverlens.operators.messages import route_intake


def claim_check(issues: DataFrame) -> DataFrame:
    """Answers for typed questions: (issue, ...) as free text."""
    return claim_answer(issues)


def check_defect_photos(photos: DataFrame, image_type_col: str, caption_col: str, issue_col: str) -> DataFrame:
    """Answers for photos that show a defect; bills among them are left to the intake."""
    routed = route_intake(photos, image_type_col, caption_col, issue_col).where("intake_route = 'claim_check'")
    return claim_answer(routed.withColumn("issue", routed["claim_text"]))
