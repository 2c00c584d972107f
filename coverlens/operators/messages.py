"""Inbound messages: callbacks, intents, leads."""
from pyspark.sql import Column, DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.functions.text import contains_any


def _digits(c) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def parse_action(df: DataFrame, data_col: str = "text") -> DataFrame:
    """Splits ``kind:arg[:arg]``; only leads name a provider, only item actions a product."""
    parts = F.split(F.col(data_col), ":")
    kind, arg = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (df.withColumn("kind", kind).withColumn("arg", arg)
            .withColumn("provider", F.when(kind == "lead", arg))
            .withColumn("product_id", F.when(kind.isin(V.PRODUCT_ACTIONS), _digits(arg))
                        .when(kind == "lead", _digits(F.get(parts, F.lit(2))))))


def callback_route(c) -> Column:
    out = F
    for route, values in V.CALLBACK_EXACT:
        out = out.when(c.isin(values), F.lit(route))
    for route, prefixes in V.CALLBACK_PREFIXES:
        hit = c.startswith(prefixes[0])
        for p in prefixes[1:]:
            hit = hit | c.startswith(p)
        out = out.when(hit, F.lit(route))
    return out.otherwise(F.lit(None).cast("string"))


def message_route(c) -> Column:
    """Intent of a text: slash command (also with a bot name or arguments) or button label."""
    command = F.lower(F.regexp_extract(c, r"^/([A-Za-z0-9_]+)(?:@[A-Za-z0-9_]+)?(?:\s|$)", 1))
    out = F
    for route, names in V.COMMAND_ROUTES:
        out = out.when(command.isin(names), F.lit(route))
    for route, labels in V.BUTTON_ROUTES:
        out = out.when(c.isin(labels), F.lit(route))
    return out.otherwise(F.lit(None).cast("string"))


def route_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """First route that fits: text intents, then callbacks, else unhandled."""
    c = F.col(text_col)
    return df.withColumn("route", F.coalesce(message_route(c), callback_route(c), F.lit("unhandled")))


def to_leads(actions: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Lead rows with referral address from parsed actions; product 0 means none."""
    known = F.col("provider").isin(V.WARRANTY_PARTNERS)
    url = F
    for provider, base in V.REFERRAL_URLS:
        url = url.when(F.col("provider") == provider, F.lit(base + codes.get(provider, "")))
    return (actions.where(F.col("kind") == "lead")
            .withColumn("product_id", F.when(F.col("product_id") > 0, F.col("product_id")))
            .withColumn("service_type", F.when(known, V.WARRANTY_SERVICE).otherwise(F.lower("provider")))
            .withColumn("status", F.lit(V.LEAD_STATUS))
            .withColumn("referral_url", url.otherwise(F.lit(None).cast("string"))))


def route_intake(df: DataFrame, image_type_col: str, caption_col: str, issue_col: str) -> DataFrame:
    """Defects go to the claim check with the best text at hand, everything else is a bill."""
    caption = F.coalesce(F.col(caption_col), F.lit(""))
    defect = (F.coalesce(F.col(image_type_col) == V.DEFECT_IMAGE_TYPE, F.lit(False))
              | contains_any(F.lower(caption), V.DEFECT_CAPTION_WORDS))
    text = F.coalesce(F.nullif(caption, F.lit("")), F.nullif(F.col(issue_col), F.lit("")), F.lit(V.DEFAULT_ISSUE))
    return (df.withColumn("intake_route", F.when(defect, "claim_check").otherwise("bill"))
            .withColumn("claim_text", F.when(defect, text)))
