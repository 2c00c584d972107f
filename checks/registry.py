"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame.

Results are flat, so that they can be compared with plain SQL value by value.
"""
import datetime

from pyspark.sql import functions as F

from checks import fixtures as X
from coverlens import fixed_values as V, schemas
from coverlens.functions import answers, dates, entries, files, text
from coverlens.operators import bills, claims, enrich, lifecycle, limits, messages, sessions, users
from coverlens.plans import intake, reminders, store_changes
from coverlens.session import materialize, work_dir
from coverlens.sources import delivery, dims, sinks, tables
from coverlens.streaming.first_seen import stream_first_seen
from coverlens.streaming.limiter import stream_allow_on_arrival, stream_allow_requests
from coverlens.streaming.ordered import only_with_data, rocksdb_state
from coverlens.streaming.routing import stream_route_counts
from coverlens.streaming.sessions import stream_registrations
from coverlens.streaming.tables import append_stream, stream_leads, stream_reminders, stream_users

QUERIES = {}
ONE_USER, ONE_PRODUCT = 42, 77


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def products(spark, sf):
    return X.v_products(spark, sf)


# --- scans, sources, sinks ---------------------------------------------------
@query
def S1_scan_tables(spark, sf):
    folder = work_dir(spark, "tables")
    stored = products(spark, sf).withColumnRenamed("product_id", "id")
    sinks.conform(stored, schemas.PRODUCTS).write.parquet(f"{folder}/product_warranties")
    return tables.read_table(spark, folder, "product_warranties").select(
        "product_id", "user_id", "brand", "purchase_date", "expiry_date", "price_paid")


@query
def S1_scan_all_tables(spark, sf):
    """Each of the four stored tables, written and read back with its declared schema."""
    folder = work_dir(spark, "all-tables")
    leads = messages.to_leads(messages.parse_action(X.v_messages(spark, sf)), X.LEAD_CODES).withColumn("id", F.col("event_id"))
    stored = {"users": X.v_users(spark, sf), "product_warranties": products(spark, sf).withColumnRenamed("product_id", "id"),
              "reminder_logs": X.v_reminder_log(spark, sf), "lead_requests": leads}
    shown = {"users": ("user_id", "first_name"), "product_warranties": ("product_id", "brand"),
             "reminder_logs": ("product_id", "reminder_type"), "lead_requests": ("id", "service_type")}
    out = None
    for name, df in stored.items():
        sinks.conform(df, schemas.TABLES[name]).write.parquet(f"{folder}/{name}")
        key, detail = shown[name]
        part = tables.read_table(spark, folder, name).select(
            F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.col(detail).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def S2_bill_files(spark, sf):
    return tables.classify_files(X.v_files(spark, sf)).select(
        "doc_id", "path", "length", "extension", "accepted", "is_image")


@query
def S3_mime_types(spark, sf):
    f = X.v_files(spark, sf)
    return f.select("doc_id", files.mime_type("path", "storage").alias("storage_mime"),
                    files.mime_type("path", "model").alias("model_mime"))


@query
def S4_append_products(spark, sf):
    """Appended twice: the second run finds every key stored."""
    done = materialize(sessions.confirmed_registrations(X.v_session_events(spark, sf)), "confirmed")
    folder = work_dir(spark, "products")
    sinks.append_products(done, folder)
    sinks.append_products(done, folder)
    return spark.read.schema(schemas.PRODUCTS).parquet(folder).select(
        "user_id", "product_name", "category", "brand", "purchase_platform", "purchase_date", "warranty_months",
        "expiry_date", "price_paid", "return_window_days", "status", "serial_no", *sessions.FILE_FIELDS,
        F.unix_micros("created_at").alias("created_us"))


@query
def S5_emit_reminders(spark, sf):
    """The day's job run twice; outbox joined to the log it filled."""
    outbox, log = work_dir(spark, "outbox"), work_dir(spark, "log")
    for _ in range(2):
        reminders.run_daily(products(spark, sf), X.v_reminder_log(spark, sf), X.AS_OF, outbox, log)
    logged = spark.read.parquet(log).select("product_id", "reminder_type", F.to_date("sent_at").alias("sent_on"))
    return spark.read.parquet(outbox).join(logged, ["product_id", "reminder_type"]).select(
        "product_id", "reminder_type", "user_id", "message", "sent_on")


def _receipts(outbox):
    """Receipts of all attempts so far: a third of them failed, by product and attempt."""
    failed = (F.col("product_id") * 7 + F.col("attempt")) % 3 == 0
    return outbox.select("product_id", "reminder_type", "attempt", (~failed).alias("delivered"),
                         F.to_timestamp("as_of").alias("received_at"), "as_of")


@query
def S5_delivery_receipts(spark, sf):
    """Three runs of the day with receipts between them, the second and third run twice, and one of the next day: attempts and the log."""
    outbox, told, log = (work_dir(spark, n) for n in ("outbox", "receipts", "log"))
    stored = products(spark, sf)
    sinks._append_new(X.v_reminder_log(spark, sf).select(F.xxhash64("product_id", "reminder_type").alias("id"), "product_id", "reminder_type",
                                                         F.lit("1990-01-01").cast("timestamp").alias("sent_at")), log, delivery.KEYS)
    for turn in range(3):
        if turn:
            delivery.append_receipts(_receipts(spark.read.schema(delivery.OUTBOX).parquet(outbox)), told)
        for _ in range(min(turn + 1, 2)):
            delivery.run_daily(stored, X.AS_OF, outbox, told, log)
    delivery.run_daily(stored, X.AS_OF + datetime.timedelta(days=1), outbox, told, log)
    logged = spark.read.schema(delivery.LOG).parquet(log).select("product_id", "reminder_type", F.to_date("sent_at").alias("sent_on"))
    return (delivery.day_states(spark, X.AS_OF, outbox, told).join(logged, delivery.KEYS, "left")
            .select("product_id", "reminder_type", "attempt", "state", "sent_on", "message"))


@query
def S6_append_leads(spark, sf):
    folder = work_dir(spark, "leads")
    acts = messages.parse_action(X.v_messages(spark, sf))
    leads = messages.to_leads(acts, X.LEAD_CODES).withColumn("id", F.col("event_id"))
    for _ in range(2):
        sinks.append_leads(leads, folder)
    return spark.read.schema(schemas.LEADS).parquet(folder).select(
        "id", "user_id", "product_id", "service_type", "provider", "status")


@query
def S7_dimensions(spark, sf):
    """Rows of each lookup table with the number of products that use them."""
    p = products(spark, sf)
    by_brand = p.groupBy(F.lower("brand").alias("key")).agg(F.count("*").alias("n"))
    by_category = p.groupBy(F.col("category").alias("key")).agg(F.count("*").alias("n"))
    shops = p.select(F.lower("purchase_platform").alias("shop"))
    by_shop = shops.groupBy(enrich.guide_key("shop").alias("key")).agg(F.count("*").alias("n"))
    parts = [("brand_support", "key", "key", by_brand), ("brand_policy", "key", "key", by_brand),
             ("brand_keyword", "key", "key", by_brand), ("component_coverage", "category", "component", by_category),
             ("bill_guide", "key", "key", by_shop)]
    out = None
    for name, key, entry, counts in parts:
        d = dims.dim(spark, name).select("ord", F.col(key).alias("key"), F.col(entry).alias("entry"))
        used = d.join(counts, "key", "left").select(F.lit(name).alias("dimension"), "ord", "key", "entry",
                                                    F.coalesce("n", F.lit(0)).alias("products"))
        out = used if out is None else out.unionByName(used)
    return out


@query
def S8_message_stream(spark, sf):
    stream = tables.read_messages_stream(spark, sf, files="events.parquet")
    folder = work_dir(spark, "messages")
    append_stream(stream.select("event_id", "user_id", "event_type", "value"), folder,
                  work_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(folder)


# --- projections and filters -------------------------------------------------
@query
def P1_for_user(spark, sf):
    return tables.for_user(products(spark, sf), ONE_USER).select("product_id", "user_id", "product_name")


@query
def P2_by_id(spark, sf):
    return tables.by_id(products(spark, sf), ONE_PRODUCT).select("product_id", "user_id", "product_name", "expiry_date")


@query
def P3_expiry(spark, sf):
    return lifecycle.with_expiry(products(spark, sf).drop("expiry_date")).select(
        "product_id", "purchase_date", "warranty_months", "expiry_date")


@query
def P4_remaining(spark, sf):
    return lifecycle.with_remaining(products(spark, sf), X.AS_OF).select("product_id", "days_remaining", "is_expired")


@query
def P5a_vault_status(spark, sf):
    return lifecycle.vault_status(products(spark, sf), X.AS_OF).select("product_id", "status_icon", "status_note")


@query
def P5b_dossier_status(spark, sf):
    return lifecycle.dossier_status(products(spark, sf), X.AS_OF).select("product_id", "dossier_status")


@query
def P5c_card_status(spark, sf):
    return lifecycle.card_status(products(spark, sf), X.AS_OF).select("product_id", "card_icon", "card_text")


@query
def P6_milestones(spark, sf):
    return lifecycle.milestones(products(spark, sf), X.AS_OF).select("product_id", "expiry_date", "days_left",
                                                                    "reminder_type")


@query
def P7_render_reminder(spark, sf):
    due = lifecycle.milestones(products(spark, sf), X.AS_OF)
    return lifecycle.render_reminder(due).select("product_id", "is_urgent", "message")


@query
def P8_route_intake(spark, sf):
    j = X.v_model_json(spark, sf)
    parsed = j.select("bill_id", "engine_rank", answers.parse_answer("answer").alias("a"),
                      X.pick(X.CAPTIONS, F.col("bill_id")).alias("caption"))
    flat = parsed.select("bill_id", "engine_rank", "caption", F.col("a.image_type").alias("image_type"),
                         F.col("a.detected_issue").alias("detected_issue"))
    return messages.route_intake(flat, "image_type", "caption", "detected_issue").select(
        "bill_id", "engine_rank", "intake_route", "claim_text")


@query
def P10_only_admins(spark, sf):
    return users.only_admins(X.events(spark, sf), X.ADMINS).select("event_id", "user_id", "event_type")


@query
def P11_parse_action(spark, sf):
    return messages.parse_action(X.v_messages(spark, sf)).select("event_id", "kind", "arg", "provider", "product_id")


@query
def P12_route_messages(spark, sf):
    return messages.route_messages(X.v_messages(spark, sf)).select("event_id", "text", "route")


@query
def P13_claim_dossier(spark, sf):
    return enrich.claim_dossier(products(spark, sf), X.v_users(spark, sf), X.AS_OF)


@query
def P14_leads(spark, sf):
    acts = messages.parse_action(X.v_messages(spark, sf))
    return messages.to_leads(acts, X.LEAD_CODES).select("event_id", "user_id", "product_id", "service_type", "provider",
                                                        "status", "referral_url")


# --- joins -------------------------------------------------------------------
@query
def C2_due_reminders(spark, sf):
    return lifecycle.due_reminders(products(spark, sf), X.v_reminder_log(spark, sf), X.AS_OF).select(
        "product_id", "user_id", "reminder_type", "days_left")


@query
def C3_brand_support(spark, sf):
    return enrich.with_brand_support(products(spark, sf)).select(
        "product_id", "brand", "support_key", "support_name", "support_toll_free", "support_whatsapp")


@query
def C4_mentioned_brand(spark, sf):
    return enrich.with_mentioned_brand(X.v_issue_text(spark, sf), "issue").select("event_id", "mentioned_key",
                                                                                 "mentioned_name")


@query
def C5_brand_card(spark, sf):
    asked = products(spark, sf).select("product_id", F.lower("brand").alias("brand_key"))
    return enrich.brand_card(asked).select("product_id", "brand_key", "found", "name", "toll_free", "whatsapp",
                                           "support_url", "warranty_check_url")


@query
def C6_policy_note(spark, sf):
    return enrich.with_policy_note(X.v_issue_text(spark, sf), "brand", "issue").select("event_id", "policy_key",
                                                                                      "brand_policy_note")


@query
def C7_keyword_brand(spark, sf):
    b = X.v_bill_text(spark, sf).withColumn("low", F.lower("text")).withColumn("k", bills.keyword_brand("low"))
    return b.select("bill_id", F.col("k.brand").alias("brand"), F.col("k.category").alias("category"))


@query
def C8_upsert_users(spark, sf):
    """Users active in the event log; those above the known ids are new."""
    known = X.v_users(spark, sf)
    seen = X.events(spark, sf).select((F.col("user_id") + X.NEW_USER_SHIFT).alias("user_id"), "ts", "event_id", F.col("event_type").alias("first_name"))
    return users.upsert_users(known, seen).select("user_id", "first_name", "language", "plan_tier", "vault_limit",
                                                  F.unix_micros("created_at").alias("created_us"))


@query
def C9_cascade_delete(spark, sf):
    """Products of cancelled orders and users who speak Hindi are removed with what hangs on them."""
    p, u = products(spark, sf), X.v_users(spark, sf)
    left = users.cascade_delete(
        {"products": p, "users": u, "reminder_logs": X.v_reminder_log(spark, sf)},
        p.where("order_status = 'P'").select("product_id"), u.where("language = 'hi'").select("user_id"))
    none = F.lit(None).cast("string")
    return (left["products"].select(F.lit("products").alias("tbl"), F.col("product_id").alias("id"), none.alias("tag"))
            .unionByName(left["users"].select(F.lit("users").alias("tbl"), F.col("user_id").alias("id"), none.alias("tag")))
            .unionByName(left["reminder_logs"].select(F.lit("reminder_logs").alias("tbl"), F.col("product_id").alias("id"),
                                                      F.col("reminder_type").alias("tag"))))


def _ids(store, version, label):
    """Keys and, where there is one, the kind of all rows of a version."""
    shown = {"products": ("product_id", None), "users": ("user_id", None), "reminder_logs": ("product_id", "reminder_type")}
    out = None
    for name, (key, tag) in shown.items():
        part = store.read(name, version).select(F.lit(label).alias("version"), F.lit(name).alias("tbl"), F.col(key).alias("id"),
                                                (F.col(tag) if tag else F.lit(None).cast("string")).alias("tag"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def C9_store_delete(spark, sf):
    """The same deletes written as a version of a store, run twice; all tables of the first and the newest version read back."""
    p, u = materialize(products(spark, sf), "products"), X.v_users(spark, sf)  # once: the joins behind it for the log and each delete too
    store = store_changes.open_store(spark, work_dir(spark, "store"), parts=8)
    first = store.commit({"products": p, "users": u, "reminder_logs": X.milestones_reached(p)})
    for _ in range(2):
        store_changes.delete(store, p.where("order_status = 'P'").select("product_id"), u.where("language = 'hi'").select("user_id"))
    return _ids(store, first, "first").unionByName(_ids(store, None, "newest"))


@query
def C8_C12_store_users(spark, sf):
    """New users and chosen languages written as versions of a store."""
    store = store_changes.open_store(spark, work_dir(spark, "store"), parts=8)
    more = {"plan_tier": "string", "vault_limit": "int", "created_at": "timestamp"}
    store.commit({"users": X.v_users(spark, sf).withColumns({n: F.lit(None).cast(t) for n, t in more.items()})})
    store_changes.first_seen(store, X.events(spark, sf).select((F.col("user_id") + X.NEW_USER_SHIFT).alias("user_id"), "ts", "event_id",
                                                               F.col("event_type").alias("first_name")))
    store_changes.choose_languages(store, messages.parse_action(X.v_messages(spark, sf)))
    return store.read("users").select("user_id", "first_name", "language", "plan_tier", F.unix_micros("created_at").alias("created_us"))


@query
def C10_component_coverage(spark, sf):
    return enrich.component_coverage(products(spark, sf), X.AS_OF).select(
        "product_id", "component", "component_months", "component_note", "component_expiry", "is_covered")


@query
def C11_recovery_guide(spark, sf):
    return enrich.with_recovery_guide(products(spark, sf)).select("product_id", "guide_key", "guide_text")


@query
def C12_language(spark, sf):
    return enrich.with_language(X.v_messages(spark, sf), X.v_users(spark, sf), ["event_id"], hot_rows=20).select(
        "event_id", "user_id", "user_lang")


@query
def C12_set_languages(spark, sf):
    acts = messages.parse_action(X.v_messages(spark, sf))
    return users.set_languages(X.v_users(spark, sf), acts).select("user_id", "language")


@query
def C13_offer_context(spark, sf):
    acts = messages.parse_action(X.v_messages(spark, sf))
    offers = acts.where(F.col("kind").isin("extend_warn", "cashify", "lead", "view_prod"))
    return enrich.offer_context(offers, products(spark, sf), X.AS_OF, ["event_id"]).select(
        "event_id", "kind", "product_id", "offer_name", "offer_days")


# --- aggregates and windows --------------------------------------------------
@query
def A1_A2_vault_summary(spark, sf):
    return lifecycle.vault_summary(products(spark, sf), X.v_users(spark, sf), X.AS_OF)


@query
def W1_vault_catalog(spark, sf):
    return lifecycle.vault_catalog(products(spark, sf), X.AS_OF).select(
        "user_id", "position", "product_id", "product_name", "brand", "status_icon", "status_note")


@query
def W2_next_expiring(spark, sf):
    return lifecycle.next_expiring(products(spark, sf)).select("user_id", "product_id", "product_name", "expiry_date")


@query
def W3_request_rate(spark, sf):
    e = X.events(spark, sf).select("event_id", "user_id", "ts")
    return limits.request_rate(e, X.LIMIT_SECONDS).select("event_id", "user_id", "requests_in_window")


@query
def G2_first_acceptable(spark, sf):
    return bills.first_acceptable(X.v_model_json(spark, sf)).select(
        "bill_id", "chosen_engine", *[F.col(f"model_bill.{f}").alias(f)
                                      for f in ("image_type", "product_name", "brand", "price_paid", "warranty_months",
                                                "serial_no", "detected_issue", "purchase_date")])


@query
def G2_model_order(spark, sf):
    """One engine that tries several models in order, and a second one with the model that the first does not know."""
    j = X.v_model_json(spark, sf).withColumn("model", X.pick(X.MODELS, F.col("bill_id") + F.col("engine_rank")))
    place = bills.engine_rank(F.col("model"), *X.MODEL_ORDER)
    ranked = j.withColumns({"place": F.coalesce(place, F.lit(0)), "engine_rank": F.when(place.isNull(), 1).otherwise(0)})
    return bills.first_acceptable(ranked, model="place").select(
        "bill_id", "chosen_engine", "chosen_model", F.col("model_bill.product_name").alias("product_name"))


# --- bill text ---------------------------------------------------------------
def _bill(spark, sf, *fields):
    b = bills.extract_bill(X.v_bill_text(spark, sf), "text", "caption", X.BILL_AS_OF, fields)
    return b.select("bill_id", *[F.col(f"bill.{f}").alias(f) for f in fields])


@query
def B1_bill_record(spark, sf):
    return _bill(spark, sf, *bills.BILL_FIELDS)


@query
def B2_B5_product_name(spark, sf):
    return _bill(spark, sf, "product_name", "brand", "category")


@query
def B6_serial(spark, sf):
    return _bill(spark, sf, "serial_no")


@query
def B7_retailer(spark, sf):
    return _bill(spark, sf, "retailer")


@query
def B8_purchase_date(spark, sf):
    b = _bill(spark, sf, "purchase_date")
    return b.withColumn("parsed", F.coalesce(dates.strict_iso_date("purchase_date"), F.lit(X.BILL_AS_OF)))


@query
def B9_B10_price(spark, sf):
    parts = bills.bill_parts(X.v_bill_text(spark, sf), "text", "caption", X.BILL_AS_OF)
    return parts.select("bill_id", F.array_join(F.array_sort("b_excluded"), ",").alias("excluded"),
                        (F.size("b_candidates") > 0).alias("has_candidates"), F.array_max("b_candidates").alias("max_candidate"),
                        F.col("b_price_paid").alias("price_paid"))


@query
def B11_food(spark, sf):
    return _bill(spark, sf, "is_food_receipt", "product_name", "brand", "category")


@query
def B12_months(spark, sf):
    return _bill(spark, sf, "warranty_months")


@query
def B13_input_choice(spark, sf):
    """Texts of conversations as OCR output: short ones give way to file name and caption."""
    c = X.table(spark, sf, "conversations")
    name = F.concat(F.lit("Invoice_iPhone15_"), F.col("role"), F.lit(".JPG"))
    chosen = bills.choose_text(F.col("text"), name, F.lit("Bought on Amazon"))
    return c.select("conv_id", "turn", chosen.alias("chosen"))


@query
def B1_on_documents(spark, sf):
    """The whole record from long free texts."""
    d = X.dealt(spark, sf, "documents").select("doc_id", "text")
    b = bills.extract_bill(d, "text", None, X.BILL_AS_OF)
    return b.select("doc_id", *[F.col(f"bill.{f}").alias(f) for f in bills.BILL_FIELDS])


@query
def E1_intake(spark, sf):
    return intake.intake(X.v_bill_text(spark, sf), X.v_model_json(spark, sf), X.BILL_AS_OF).select(
        "bill_id", "source", "intake_route", "claim_text", "product_name", "brand", "category", "purchase_platform",
        "warranty_months", "serial_no", "price_paid", "is_food_receipt", "purchase_date", "expiry_date")


# --- scalar functions --------------------------------------------------------
@query
def J1_parse_answer(spark, sf):
    j = X.v_model_json(spark, sf).withColumn("a", answers.parse_answer("answer"))
    return j.select("bill_id", "engine_rank", F.col("a").isNotNull().alias("readable"),
                    *[F.col(f"a.{f}").alias(f) for f in ("image_type", "product_name", "brand", "price_paid", "warranty_months",
                                                         "serial_no", "detected_issue")])


@query
def J2_answer_text(spark, sf):
    """Event properties as answers inside an envelope."""
    e = X.table(spark, sf, "events")
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("message"))).alias("choices")))
    return e.select("event_id", answers.answer_text(envelope).alias("content"))


def _docs(spark, sf):
    return X.dealt(spark, sf, "documents").select("doc_id", "text")


@query
def T1_redact_pii(spark, sf):
    return _docs(spark, sf).select("doc_id", text.redact_pii("text").alias("redacted"))


@query
def T2_sanitize_text(spark, sf):
    pages = X.dealt(spark, sf, "pages")
    return pages.select("page_id", text.sanitize_text("html").alias("safe"),
                        text.sanitize_text("html", V.SHORT_TEXT_MAX_CHARS).alias("short_safe"))


@query
def T3_sanitize_serial(spark, sf):
    return _docs(spark, sf).select("doc_id", text.sanitize_serial("text").alias("serial"))


@query
def T4_first_word(spark, sf):
    return _docs(spark, sf).select("doc_id", text.first_word("text").alias("word"))


def _typed_days(spark, sf):
    """Order dates typed in eight ways."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    typed = (F.when(k % 8 == 0, "today").when(k % 8 == 1, " Yesterday ")
             .when(k % 8 == 2, F.date_format(d, "yyyy-MM-dd")).when(k % 8 == 3, F.date_format(d, "d-M-yyyy"))
             .when(k % 8 == 4, F.date_format(d, "dd/MM/yyyy")).when(k % 8 == 5, F.date_format(d, "d.M.yyyy"))
             .when(k % 8 == 6, F.date_format(d, "31-MM-yyyy")).otherwise("last week"))
    return X.table(spark, sf, "orders").select(k.alias("order_id"), typed.alias("typed"))


@query
def D1_human_date(spark, sf):
    return _typed_days(spark, sf).select(
        "order_id", "typed", dates.parse_human_date("typed", X.AS_OF).alias("edited"),
        dates.parse_human_date("typed", X.AS_OF, V.ENTRY_DATE_FORMATS).alias("entered"))


def _typed_prices(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    typed = (F.when(k % 4 == 0, F.concat(F.lit("Rs. "), F.format_number(p, 2)))
             .when(k % 4 == 1, F.concat(F.lit("₹"), F.format_number(p, 2))).when(k % 4 == 2, "1.2.3")
             .otherwise("free"))
    return X.table(spark, sf, "orders").select(k.alias("order_id"), typed.alias("typed"), p.alias("old"))


@query
def D2_price(spark, sf):
    return _typed_prices(spark, sf).select("order_id", "typed", text.parse_price("typed").alias("price"),
                                           text.parse_price("typed", "old").alias("kept"))


@query
def D3_months(spark, sf):
    typed = X.pick(["6", "24", "custom", " 18 ", "-3", "", "12 months", "60"], F.col("event_id"))
    return X.table(spark, sf, "events").select("event_id", text.parse_months(typed).alias("preset"),
                                               text.parse_months(typed, strict=True).alias("typed_months"))


@query
def D1_D3_rejects(spark, sf):
    """Typed days and months in one pass: what was accepted with its value, what was rejected with a reason and a reply."""
    days = _typed_days(spark, sf).select(F.col("order_id").alias("entry_id"), F.lit("date").alias("field"), "typed")
    typed = X.pick([*X.TYPED_MONTHS, None], F.col("event_id"))
    months = X.table(spark, sf, "events").select(F.col("event_id").alias("entry_id"), F.lit("months").alias("field"), typed.alias("typed"))
    accepted, rejected = entries.write_split(days.unionByName(months), X.AS_OF, work_dir(spark, "entries"))
    return accepted.withColumns({"reason": F.lit(None).cast("string"), "reply": F.lit(None).cast("string")}).unionByName(
        rejected.withColumns({"day": F.lit(None).cast("date"), "months": F.lit(None).cast("int")}))


@query
def D4_formats(spark, sf):
    o = X.table(spark, sf, "orders")
    paid = F.when(F.col("o_orderstatus") == "P", 0.0).when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("order_id"), dates.format_day(F.col("o_orderdate").cast("date")).alias("day"),
                    text.format_price(paid).alias("price"))


# --- claims ------------------------------------------------------------------
@query
def V1_claim_flags(spark, sf):
    return claims.with_claim_flags(X.v_issue_text(spark, sf)).select("event_id", *V.CLAIM_FLAGS)


@query
def V2_diagnose(spark, sf):
    d = claims.diagnose_claims(X.v_issue_text(spark, sf))
    return d.select("event_id", "rule_id", *[F.col(f"diagnosis.{f}").alias(f) for f in claims.DIAGNOSIS_FIELDS[:-1]],
                    F.array_join("diagnosis.action_steps", "|").alias("steps"))


@query
def V3_claim_answer(spark, sf):
    a = claims.claim_answer(X.v_issue_text(spark, sf))
    return a.select("event_id", F.col("diagnosis.verdict").alias("verdict"), F.col("diagnosis.verdict_title").alias("title"),
                    F.col("diagnosis.brand_policy_note").alias("note"), "steps_text", "mentioned_name",
                    "mentioned_whatsapp", "mentioned_warranty_check_url")


# --- folds and streams -------------------------------------------------------
@query
def R1_reminder_backfill(spark, sf):
    return reminders.reminders_backfill(products(spark, sf), X.v_reminder_log(spark, sf), *X.BACKFILL)


@query
def R1_reminder_stream(spark, sf):
    """Products arriving as a stream of files, reminders of one day."""
    incoming, outbox, log = (work_dir(spark, n) for n in ("in", "outbox", "log"))
    products(spark, sf).write.parquet(incoming)
    schema = spark.read.parquet(incoming).schema
    stream = tables.read_messages_stream(spark, incoming, schema)
    X.v_reminder_log(spark, sf).write.parquet(log)
    stream_reminders(stream, X.AS_OF, outbox, log, work_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(outbox).select("product_id", "user_id", "reminder_type", "message")


@query
def R2_limiter(spark, sf):
    return limits.allow_requests(X.events(spark, sf), X.LIMIT_MAX, X.LIMIT_SECONDS).select("event_id", "user_id", "accepted")


def _staged(spark, df):
    """A folder with the rows and, written last, one far later row that closes all windows."""
    folder = work_dir(spark, "in")
    df.write.parquet(folder)
    late = {"user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long"),
            "ts": F.lit("2100-01-01").cast("timestamp")}
    end = spark.range(1).select(*[late.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema])
    end.write.mode("append").parquet(folder)
    return tables.read_messages_stream(spark, folder, df.schema)


def _collect_stream(spark, out):
    folder = work_dir(spark, "out")
    with rocksdb_state(spark):
        append_stream(out, folder, work_dir(spark, "cp")).awaitTermination()
    return spark.read.schema(out.schema).parquet(folder)


@query
def R2_limiter_stream(spark, sf):
    stream = _staged(spark, X.events(spark, sf).select("user_id", "ts", "event_id"))
    return _collect_stream(spark, stream_allow_requests(stream, X.LIMIT_MAX, X.LIMIT_SECONDS)).select(
        "event_id", "user_id", "accepted")


@query
def R2_limiter_arrival(spark, sf):
    """A backlog that arrives at one moment: what a service sees that was away."""
    folder = work_dir(spark, "in")
    X.events(spark, sf).select("user_id", "ts", "event_id").write.parquet(folder)
    stream = tables.read_messages_stream(spark, folder, spark.read.parquet(folder).schema)
    moment = X.ARRIVAL_US
    out = stream_allow_on_arrival(stream, X.LIMIT_MAX, X.LIMIT_SECONDS, lambda: moment)
    with only_with_data(spark):
        found = _collect_stream(spark, out)
    return found.select("event_id", "user_id", F.unix_micros("arrived_at").alias("arrived_us"), "accepted")


def _registrations(df):
    return df.select("user_id", "session_id", "confirmed_id", "product_name", "brand", "category", "purchase_platform",
                     "purchase_date", "warranty_months", "serial_no", "price_paid", *sessions.FILE_FIELDS)


@query
def R3_sessions(spark, sf):
    return _registrations(sessions.confirmed_registrations(X.v_session_events(spark, sf)))


@query
def R3_sessions_stream(spark, sf):
    stream = _staged(spark, X.v_session_events(spark, sf))
    return _registrations(_collect_stream(spark, stream_registrations(stream)))


@query
def R3_idle_sessions(spark, sf):
    """Sessions that end when their user is silent for half a day."""
    return _registrations(sessions.confirmed_registrations(X.v_session_events(spark, sf), X.IDLE_SECONDS))


@query
def R3_idle_sessions_stream(spark, sf):
    stream = _staged(spark, X.v_session_events(spark, sf))
    return _registrations(_collect_stream(spark, stream_registrations(stream, idle_seconds=X.IDLE_SECONDS)))


@query
def R4_route_counts_stream(spark, sf):
    stream = _staged(spark, X.v_messages(spark, sf))
    out = _collect_stream(spark, stream_route_counts(stream))
    return out.select(F.unix_seconds("window_start").alias("window_s"), "route", "messages")


@query
def R5_first_seen_stream(spark, sf):
    stream = tables.read_messages_stream(spark, sf, files="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = work_dir(spark, "users")
    stream_users(stream.select("user_id", "ts", "event_id"), folder, work_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(folder).select("user_id", "language", "plan_tier", "vault_limit",
                                             F.unix_micros("created_at").alias("created_us"))


@query
def R5_first_seen_state(spark, sf):
    """First sight in the state of a stream, forgotten after a year without an event."""
    stream = _staged(spark, X.events(spark, sf).select("user_id", "ts", "event_id"))
    return _collect_stream(spark, stream_first_seen(stream, 366 * 86_400)).select(
        "user_id", "language", "plan_tier", "vault_limit", F.unix_micros("created_at").alias("created_us")).where("user_id >= 0")


@query
def S6_lead_stream(spark, sf):
    folder, incoming = work_dir(spark, "leads"), work_dir(spark, "in")
    X.v_messages(spark, sf).write.parquet(incoming)
    stream = tables.read_messages_stream(spark, incoming, spark.read.parquet(incoming).schema)
    stream_leads(stream, X.LEAD_CODES, folder, work_dir(spark, "cp")).awaitTermination()
    return spark.read.schema(schemas.LEADS).parquet(folder).select(
        "id", "user_id", "product_id", "service_type", "provider", "status", F.unix_micros("created_at").alias("created_us"))
