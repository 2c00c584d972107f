"""Users: first sight, cascading delete, allow-list."""
from pyspark.sql import DataFrame, functions as F

from coverlens import fixed_values as V
from coverlens.operators.hot_keys import spread_join


def upsert_users(users: DataFrame, seen: DataFrame) -> DataFrame:
    """Existing users as they are, plus one new row per unknown user.

    The first sight of each user is an aggregate, so a very active user is
    reduced on the map side before the join.
    """
    profile = [c for c in ("username", "first_name", "last_name") if c in seen.columns]
    first = (seen.where(F.col("user_id").isNotNull()).groupBy("user_id")
             .agg(F.min_by(F.struct("ts", *profile), F.struct("ts", "event_id")).alias("first")))
    new = first.join(users.select("user_id"), "user_id", "left_anti").select(
        "user_id", *[F.col(f"first.{c}").alias(c) for c in profile],
        F.lit("en").alias("language"), F.lit("free").alias("plan_tier"),
        F.lit(V.DEFAULT_VAULT_LIMIT).alias("vault_limit"), F.col("first.ts").alias("created_at"))
    return users.unionByName(new, allowMissingColumns=True)


def cascade_delete(tables: dict, product_ids: DataFrame | None = None, user_ids: DataFrame | None = None) -> dict:
    """Tables without the given products or users and what hangs on them.

    A user takes the products along, a product its reminder log. Leads stay
    and may name products that are gone. Only key columns are shuffled.
    """
    products, users, log = tables["products"], tables["users"], tables["reminder_logs"]
    gone = product_ids.select("product_id") if product_ids is not None else None
    if user_ids is not None:
        owners = user_ids.select("user_id").distinct()
        owned = spread_join(products.select("product_id", "user_id"), owners, "user_id", ["product_id"],
                            "left_semi").select("product_id")
        gone = owned if gone is None else gone.unionByName(owned)
        users = users.join(owners, "user_id", "left_anti")
    gone = gone.distinct()
    return {**tables, "users": users, "products": products.join(gone, "product_id", "left_anti"),
            "reminder_logs": log.join(gone, "product_id", "left_anti")}


def set_languages(users: DataFrame, actions: DataFrame) -> DataFrame:
    """Users with the language of their latest choice; choices of unknown users change nothing."""
    latest = (actions.where(F.col("kind") == "set_lang").groupBy("user_id")
              .agg(F.max_by("arg", F.struct("ts", "event_id")).alias("_chosen")))
    return (users.join(latest, "user_id", "left")
            .withColumn("language", F.coalesce("_chosen", "language")).drop("_chosen"))


def admin_ids(csv: str) -> list[int]:
    return [int(p.strip()) for p in csv.split(",") if p.strip().isdigit()]


def only_admins(events: DataFrame, csv: str) -> DataFrame:
    """Events of listed users; the list is a setting, so it becomes a literal set the scan can use."""
    return events.where(F.col("user_id").isin(admin_ids(csv)))
