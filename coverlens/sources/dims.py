"""Lookup tables with a fixed number of rows, marked for broadcast.

The largest has 35 rows, so broadcasting them never depends on the data.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from coverlens import fixed_values as V


def _numbered(rows):
    return [(i, *r) for i, r in enumerate(rows)]


_DIMS = {
    "brand_support": (_numbered(V.BRAND_SUPPORT), "ord int, key string, name string, toll_free string, "
                      "whatsapp string, support_url string, warranty_check_url string"),
    "brand_policy": (_numbered(V.BRAND_POLICIES), "ord int, key string, note string"),
    "component_coverage": (_numbered(V.COMPONENT_COVERAGE),
                           "ord int, category string, component string, months int, note string"),
    "bill_guide": (_numbered(V.BILL_GUIDES), "ord int, key string, text string"),
    "brand_keyword": (_numbered(V.BRAND_KEYWORDS), "ord int, key string, brand string, category string"),
    "claim_rule": (V.CLAIM_RULES, "rule_id int, verdict string, verdict_emoji string, verdict_title string, "
                   "confidence string, explanation string, service_center_advice string, "
                   "lost_bill_tip string, action_steps array<string>"),
}
DIM_NAMES = list(_DIMS)


def dim(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = _DIMS[name]
    return F.broadcast(spark.createDataFrame(rows, schema))
