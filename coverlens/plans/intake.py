"""Bill intake: model answers first, text rules as the fallback, then product columns."""
from pyspark.sql import DataFrame, functions as F

from coverlens.functions.dates import expiry_date
from coverlens.operators.bills import bill_defaults, extract_bill, first_acceptable
from coverlens.operators.messages import route_intake


def bill_records(bills: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    """(bill_id, text, caption) with ``bill``: the chosen model answer, else the record read from the text.

    Bills with an answer go through the text rules as empty texts, which cost
    next to nothing; a second join to keep them apart would cost a shuffle.
    """
    joined = bills.join(first_acceptable(answers), "bill_id", "left")
    unanswered = F.col("model_bill").isNull()
    joined = joined.withColumns({"_text": F.when(unanswered, F.col("text")),
                                 "_caption": F.when(unanswered, F.col("caption"))})
    ruled = extract_bill(joined, "_text", "_caption", as_of)
    return (ruled.withColumn("source", F.when(F.col("model_bill").isNotNull(), "model").otherwise("text"))
            .withColumn("bill", F.coalesce("model_bill", "bill"))
            .drop("model_bill", "chosen_engine", "_text", "_caption"))


def intake(bills: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    """Records routed to the claim check or to registration, with defaults and expiry."""
    records = bill_records(bills, answers, as_of)
    records = (records.withColumn("_type", F.col("bill.image_type"))
               .withColumn("_issue", F.col("bill.detected_issue")))
    routed = route_intake(records, "_type", "caption", "_issue").drop("_type", "_issue")
    return (bill_defaults(routed, "bill", as_of)
            .withColumn("expiry_date", expiry_date("purchase_date", "warranty_months")))
