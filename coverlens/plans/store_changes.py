"""Deletes and changes of stored users, products and reminders, written as a new version of the store.

Each change reads and rewrites only the parts of a table that hold one of its keys. Running it again changes nothing more.
"""
from pyspark.sql import DataFrame, functions as F

from coverlens.operators.hot_keys import spread_join
from coverlens.operators.users import cascade_delete, set_languages, upsert_users
from coverlens.session import materialize
from coverlens.sources.snapshots import Store

KEYS = {"users": ["user_id"], "products": ["product_id"], "reminder_logs": ["product_id"]}


def open_store(spark, directory: str, **options) -> Store:
    return Store(spark, directory, KEYS, **options)


def delete(store: Store, product_ids: DataFrame | None = None, user_ids: DataFrame | None = None) -> int:
    """Removes products, users with their products, and the reminders of both; returns the new version, the old one if nothing was there.

    The products of a user lie in all parts, so their ids are looked up first, in two columns of the table.
    """
    base = store.version()
    nobody = store.spark.createDataFrame([], "user_id long")
    owners = materialize((nobody if user_ids is None else user_ids.select("user_id")).distinct(), "owners")
    products = store.read("products", base).select("product_id", "user_id")
    gone = spread_join(products, owners, "user_id", ["product_id"], "left_semi").select("product_id")
    if product_ids is not None:
        gone = gone.unionByName(product_ids.select("product_id"))
    gone = materialize(gone.distinct(), "gone")
    parts = {"users": store.touched("users", owners), "products": store.touched("products", gone), "reminder_logs": store.touched("reminder_logs", gone)}
    if not any(parts.values()):
        return base
    tables = {name: store.read(name, base, of) for name, of in parts.items()}
    left = cascade_delete({**tables}, gone, None)
    left["users"] = tables["users"].join(owners, "user_id", "left_anti")
    return store.commit({name: (left[name], of) for name, of in parts.items() if of}, base)


def first_seen(store: Store, seen: DataFrame) -> int:
    """Adds the users seen for the first time."""
    base = store.version()
    known = store.read("users", base)
    parts = store.touched("users", seen.where("user_id is not null"))
    old = store.read("users", base, parts)
    return store.commit({"users": (upsert_users(old, seen).select(known.columns), parts)}, base) if parts else base


def choose_languages(store: Store, actions: DataFrame) -> int:
    """Sets the language of users to their latest choice."""
    base = store.version()
    parts = store.touched("users", actions.where(F.col("kind") == "set_lang"))
    return store.commit({"users": (set_languages(store.read("users", base, parts), actions), parts)}, base) if parts else base
