"""SQL for the comparison engine: what each query of the registry must return."""
from checks import fixtures as X
from checks.fixture_sql import (EDIT_FORMATS, NEEDS, TAG, VIEWS, any_of, day, expiry, first_case, human_date, lit, pick,
                                price, sanitize, serial, strip, title, values, with_views)
from checks.registry import ONE_PRODUCT, ONE_USER
from coverlens import fixed_values as V
from coverlens.operators.users import admin_ids

ORACLE = {}
AS_OF, BILL_DAY = day(X.AS_OF), day(X.BILL_AS_OF)
LEFT = f"CAST(expiry_date - {AS_OF} AS INTEGER)"


def sql(name, views, body, recursive=False):
    ORACLE[name] = with_views(views, body, recursive)


def product(name, body):
    sql(name, ["v_products"], body)


# --- scans, sources, sinks
product("S1_scan_tables", "SELECT product_id, user_id, brand, purchase_date, expiry_date, price_paid FROM v_products")

_suffix = r"lower(regexp_extract(split_part(path, '/', -1), '^.+\.([^.]+)$', 1))"
sql("S2_bill_files", ["v_files"], f"""SELECT doc_id, path, length, extension,
  NOT (NOT is_photo AND coalesce(length > {V.MAX_UPLOAD_BYTES}, FALSE)) AS accepted,
  extension IN ('jpg', 'jpeg', 'png', 'webp') AS is_image
FROM (SELECT *, CASE WHEN is_photo THEN 'jpg' ELSE coalesce(nullif({_suffix}, ''), 'pdf') END AS extension FROM v_files)""")


def _mime(kinds):
    return first_case([(f"{_suffix} = {lit(e)}", lit(m)) for e, m in kinds.items()], lit(V.DEFAULT_MIME))


sql("S3_mime_types", ["v_files"],
    f"SELECT doc_id, {_mime(V.STORAGE_MIME)} AS storage_mime, {_mime(V.MODEL_MIME)} AS model_mime FROM v_files")

sql("S4_append_products", ["v_confirmed"], f"""SELECT user_id, coalesce(nullif(product_name, ''), 'Electronic Appliance') AS product_name,
  coalesce(category, 'General') AS category, coalesce(brand, 'Unknown') AS brand,  -- empty ones are kept
  coalesce(nullif(purchase_platform, ''), 'Local Store') AS purchase_platform,
  coalesce(purchase_date, CAST(confirmed_at AS DATE)) AS purchase_date, coalesce(warranty_months, 12) AS warranty_months,
  {expiry('coalesce(purchase_date, CAST(confirmed_at AS DATE))', 'coalesce(warranty_months, 12)')} AS expiry_date,
  price_paid, 7 AS return_window_days, 'active' AS status, serial_no, invoice_file_id, invoice_file_type, local_invoice_path, epoch_us(confirmed_at) AS created_us FROM v_confirmed""")

# --- reminders
_MILESTONES = f"(VALUES {', '.join(f'({n})' for n in V.REMINDER_DAYS)}) AS m(n)"
_DUE = f"""SELECT p.*, n AS days_left, {TAG} AS reminder_type, expiry_date - n AS as_of FROM v_products p, {_MILESTONES}"""
_MESSAGE = f"""CASE WHEN days_left <= 7 THEN {lit(V.URGENT_HEAD)} ELSE {lit(V.NORMAL_HEAD)} END || chr(10) || chr(10) || 'Your *'
  || product_name || '* warranty expires ' || CASE WHEN days_left > 0 THEN 'in *' || days_left || ' days*' ELSE '*TODAY*' END
  || ' (' || strftime(expiry_date, '%d %b %Y') || ')!' || chr(10) || chr(10) || {lit(V.REMINDER_TAIL)}"""
VIEWS["due_now"] = f"{_DUE} WHERE expiry_date - n = {AS_OF}"
VIEWS["due_range"] = f"{_DUE} WHERE expiry_date - n BETWEEN {day(X.BACKFILL[0])} AND {day(X.BACKFILL[1])}"
NEEDS["due_now"] = NEEDS["due_range"] = ["v_products"]
_UNSENT = "NOT EXISTS (SELECT 1 FROM v_reminder_log l WHERE l.product_id = d.product_id AND l.reminder_type = d.reminder_type)"
_due_views = ["v_reminder_log", "due_now"]
sql("S5_emit_reminders", _due_views,
    f"SELECT product_id, reminder_type, user_id, {_MESSAGE} AS message, {AS_OF} AS sent_on FROM due_now d WHERE {_UNSENT}")
sql("S5_delivery_receipts", _due_views, f"""WITH tried AS (
  SELECT d.*, a.attempt, a.attempt < 3 AND (product_id * 7 + a.attempt) % 3 <> 0 AS good,
    a.attempt < 3 AND (product_id * 7 + a.attempt) % 3 = 0 AS bad
  FROM due_now d, (VALUES (1), (2), (3)) a(attempt) WHERE {_UNSENT}),
handed AS (SELECT *, coalesce(bool_and(bad) OVER (PARTITION BY product_id, reminder_type ORDER BY attempt
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS out, bool_or(good) OVER (PARTITION BY product_id, reminder_type ORDER BY attempt
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS arrived FROM tried)
SELECT product_id, reminder_type, CAST(attempt AS INTEGER) AS attempt, CASE WHEN good THEN 'delivered' WHEN bad THEN 'failed' ELSE 'handed_over' END AS state,
  CASE WHEN arrived THEN {AS_OF} END AS sent_on, {_MESSAGE} AS message FROM handed WHERE out""")
sql("C2_due_reminders", _due_views,
    f"SELECT product_id, user_id, reminder_type, days_left FROM due_now d WHERE {_UNSENT}")
sql("P6_milestones", ["due_now"], "SELECT product_id, expiry_date, days_left, reminder_type FROM due_now")
sql("P7_render_reminder", ["due_now"],
    f"SELECT product_id, days_left <= 7 AS is_urgent, {_MESSAGE} AS message FROM due_now")
sql("R1_reminder_backfill", ["v_reminder_log", "due_range"],
    f"""SELECT product_id, user_id, reminder_type, as_of, days_left, days_left <= 7 AS is_urgent, {_MESSAGE} AS message
FROM due_range d WHERE {_UNSENT}""")
sql("R1_reminder_stream", _due_views,
    f"SELECT product_id, user_id, reminder_type, {_MESSAGE} AS message FROM due_now d WHERE {_UNSENT}")

# --- messages
_kind, _arg = "split_part(text, ':', 1)", "string_split(text, ':')[2]"
_action_digits = "TRY_CAST(CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN {0} END AS BIGINT)"
VIEWS["v_actions"] = f"""SELECT *, {_kind} AS kind, {_arg} AS arg, CASE WHEN {_kind} = 'lead' THEN {_arg} END AS provider,
  CASE WHEN {_kind} IN ({', '.join(map(lit, V.PRODUCT_ACTIONS))}) THEN {_action_digits.format(_arg)}
    WHEN {_kind} = 'lead' THEN {_action_digits.format("string_split(text, ':')[3]")} END AS product_id FROM v_messages"""
NEEDS["v_actions"] = ["v_messages"]
_url = first_case([(f"provider = {lit(p)}", lit(u + X.LEAD_CODES[p])) for p, u in V.REFERRAL_URLS])
VIEWS["v_leads"] = f"""SELECT event_id, user_id, ts, CASE WHEN product_id > 0 THEN product_id END AS product_id,
  CASE WHEN provider IN ('OneAssist', 'Onsitego') THEN 'extended_warranty' ELSE lower(provider) END AS service_type, provider,
  'lead_created' AS status, {_url} AS referral_url FROM v_actions WHERE kind = 'lead'"""
NEEDS["v_leads"] = ["v_actions"]
sql("P11_parse_action", ["v_actions"], "SELECT event_id, kind, arg, provider, product_id FROM v_actions")
sql("P14_leads", ["v_leads"],
    "SELECT event_id, user_id, product_id, service_type, provider, status, referral_url FROM v_leads")
sql("S6_append_leads", ["v_leads"],
    "SELECT event_id AS id, user_id, product_id, service_type, provider, status FROM v_leads")
sql("S6_lead_stream", ["v_leads"], """SELECT event_id AS id, user_id, product_id, service_type, provider, status,
  epoch_us(ts) AS created_us FROM v_leads""")

_cmd = r"lower(regexp_extract(text, '^/([A-Za-z0-9_]+)(@[A-Za-z0-9_]+)?(\s|$)', 1))"
_route = first_case(
    [(f"{_cmd} IN ({', '.join(map(lit, names))})", lit(r)) for r, names in V.COMMAND_ROUTES]
    + [(f"text IN ({', '.join(map(lit, names))})", lit(r)) for r, names in V.BUTTON_ROUTES + V.CALLBACK_EXACT]
    + [("(" + " OR ".join(f"starts_with(text, {lit(p)})" for p in ps) + ")", lit(r)) for r, ps in V.CALLBACK_PREFIXES],
    "'unhandled'")
sql("P12_route_messages", ["v_messages"], f"SELECT event_id, text, {_route} AS route FROM v_messages")
sql("R4_route_counts_stream", ["v_messages"], f"""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_s, {_route} AS route,
  count(*) AS messages FROM v_messages GROUP BY 1, 2""")
ORACLE["S8_message_stream"] = "SELECT event_id, user_id, event_type, value FROM events"
ORACLE["P10_only_admins"] = f"SELECT event_id, user_id, event_type FROM events WHERE user_id IN ({', '.join(map(str, admin_ids(X.ADMINS)))})"

# --- lifecycle
product("P1_for_user", f"SELECT product_id, user_id, product_name FROM v_products WHERE user_id = {ONE_USER}")
product("P2_by_id", f"SELECT product_id, user_id, product_name, expiry_date FROM v_products WHERE product_id = {ONE_PRODUCT}")
product("P3_expiry", "SELECT product_id, purchase_date, warranty_months, expiry_date FROM v_products")
product("P4_remaining", f"SELECT product_id, {LEFT} AS days_remaining, {AS_OF} > expiry_date AS is_expired FROM v_products")
_STATUS = f"""CASE WHEN {LEFT} > 15 THEN '🟢' WHEN {LEFT} >= 0 THEN '🟡' ELSE '🔴' END AS status_icon,
  CASE WHEN {LEFT} > 15 THEN {LEFT} || 'd left' WHEN {LEFT} >= 0 THEN {LEFT} || 'd left (Expiring soon!)'
    ELSE 'Expired ' || abs({LEFT}) || 'd ago' END AS status_note"""
product("P5a_vault_status", f"SELECT product_id, {_STATUS} FROM v_products")
_DOSSIER = f"""CASE WHEN {LEFT} > 0 THEN 'ACTIVE (' || {LEFT} || ' days remaining)' WHEN {LEFT} = 0 THEN 'EXPIRES TODAY'
  ELSE 'EXPIRED (' || abs({LEFT}) || ' days ago)' END"""
product("P5b_dossier_status", f"SELECT product_id, {_DOSSIER} AS dossier_status FROM v_products")
product("P5c_card_status", f"""SELECT product_id,
  CASE WHEN warranty_months = 0 THEN '⚪' WHEN {LEFT} > 0 THEN '🟢' ELSE '🟣' END AS card_icon,
  CASE WHEN warranty_months = 0 THEN {lit(V.NO_WARRANTY_TEXT)} WHEN {LEFT} > 0 THEN '*' || {LEFT} || ' Days Remaining*'
    ELSE '*Expired (' || abs({LEFT}) || ' days ago)*' END AS card_text FROM v_products""")
sql("P13_claim_dossier", ["v_products", "v_users"], f"""SELECT product_id, product_name, brand || ' (' || category || ')' AS brand_and_category,
  coalesce(nullif(model_no, ''), 'Not specified') AS model_no, coalesce(nullif(serial_no, ''), 'Not specified') AS serial_no,
  coalesce(nullif(purchase_platform, ''), 'Direct Retailer') AS purchase_platform,
  strftime(purchase_date, '%d %b %Y') AS purchase_date, warranty_months || ' Months' AS warranty_coverage,
  strftime(expiry_date, '%d %b %Y') AS expiry_date, {_DOSSIER} AS current_status,
  coalesce(nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''), 'Registered Customer') AS customer_name,
  CAST(user_id AS VARCHAR) AS customer_id, nullif(notes, '') AS notes FROM v_products JOIN v_users USING (user_id)""")
sql("A1_A2_vault_summary", ["v_products", "v_users"], f"""SELECT u.user_id, count(p.product_id) AS total,
  count(*) FILTER (WHERE {AS_OF} <= expiry_date) AS active, count(p.product_id) = 0 AS is_empty
FROM v_users u LEFT JOIN v_products p ON p.user_id = u.user_id GROUP BY u.user_id""")
product("W1_vault_catalog", f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY expiry_date, product_id) AS position,
  product_id, product_name, brand, {_STATUS} FROM v_products""")
product("W2_next_expiring", """SELECT user_id, product_id, product_name, expiry_date FROM v_products
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY expiry_date, product_id) = 1""")
ORACLE["W3_request_rate"] = f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN {X.LIMIT_SECONDS * 1000000 - 1} PRECEDING AND CURRENT ROW) AS requests_in_window FROM events"""

# --- lookup tables
_numbered = {n: [(i, *r) for i, r in enumerate(rows)] for n, rows in
             [("brand_support", V.BRAND_SUPPORT), ("brand_policy", V.BRAND_POLICIES), ("component_coverage", V.COMPONENT_COVERAGE),
              ("bill_guide", V.BILL_GUIDES), ("brand_keyword", V.BRAND_KEYWORDS)]}
SUPPORT = values(_numbered["brand_support"],
                 ["ord", "key", "name", "toll_free", "whatsapp", "support_url", "warranty_check_url"])
POLICY = values(_numbered["brand_policy"], ["ord", "key", "note"])
GUIDE = values(_numbered["bill_guide"], ["ord", "key", "txt"])
COVER = values(_numbered["component_coverage"], ["ord", "cat", "component", "months", "note"])
_guide_key = first_case([(f"contains(lower(purchase_platform), {lit(k.split('_')[0])})", lit(k)) for k, _ in V.BILL_GUIDES[:-1]],
                        lit(V.BILL_GUIDES[-1][0]))
_dims = [("brand_support", 1, 1, "lower(brand)"), ("brand_policy", 1, 1, "lower(brand)"), ("brand_keyword", 1, 1, "lower(brand)"),
         ("component_coverage", 1, 2, "category"), ("bill_guide", 1, 1, _guide_key)]
product("S7_dimensions", " UNION ALL ".join(
    f"""SELECT {lit(n)} AS dimension, ord, key, entry, coalesce(c, 0) AS products
FROM {values([(r[0], r[k], r[e]) for r in _numbered[n]], ['ord', 'key', 'entry'])}
LEFT JOIN (SELECT {expr} AS k, count(*) AS c FROM v_products GROUP BY 1) ON k = key""" for n, k, e, expr in _dims))

# C3 by rank of the first matching entry, written as a join here.
product("C3_brand_support", f"""SELECT product_id, brand, key AS support_key, name AS support_name, toll_free AS support_toll_free,
  whatsapp AS support_whatsapp FROM (SELECT p.product_id, p.brand, s.* FROM v_products p LEFT JOIN {SUPPORT.replace('AS t(', 'AS s(')}
  ON contains(lower(trim(p.brand)), s.key) OR contains(s.key, lower(trim(p.brand)))
  QUALIFY row_number() OVER (PARTITION BY p.product_id ORDER BY s.ord) = 1)""")
sql("C4_mentioned_brand", ["v_issue_text"], f"""SELECT event_id, key AS mentioned_key, name AS mentioned_name
FROM (SELECT i.event_id, s.* FROM v_issue_text i LEFT JOIN {SUPPORT.replace('AS t(', 'AS s(')} ON contains(lower(i.issue), s.key)
  QUALIFY row_number() OVER (PARTITION BY i.event_id ORDER BY s.ord) = 1)""")
product("C5_brand_card", f"""SELECT product_id, lower(brand) AS brand_key, key IS NOT NULL AS found, name, toll_free,
  CASE WHEN key IS NOT NULL THEN coalesce(nullif(whatsapp, ''), {lit(V.NO_WHATSAPP)}) END AS whatsapp, support_url,
  warranty_check_url FROM v_products LEFT JOIN {SUPPORT} ON key = lower(brand)""")
_policy_join = f"""LEFT JOIN {POLICY.replace('AS t(', 'AS s(')} ON contains(lower(trim(coalesce(i.brand, ''))), s.key)
  OR contains(lower(coalesce(i.issue, '')), s.key)"""
sql("C6_policy_note", ["v_issue_text"], f"""SELECT event_id, key AS policy_key, note AS brand_policy_note
FROM (SELECT i.event_id, s.* FROM v_issue_text i {_policy_join} QUALIFY row_number() OVER (PARTITION BY i.event_id ORDER BY s.ord) = 1)""")
sql("S1_scan_all_tables", ["v_users", "v_products", "v_reminder_log", "v_leads"], """
SELECT 'users' AS table_name, user_id AS row_key, first_name AS detail FROM v_users
UNION ALL SELECT 'product_warranties', product_id, brand FROM v_products
UNION ALL SELECT 'reminder_logs', product_id, reminder_type FROM v_reminder_log
UNION ALL SELECT 'lead_requests', event_id, service_type FROM v_leads""")
ORACLE["C8_upsert_users"] = with_views(["v_users"], """SELECT user_id, first_name, language, CAST(NULL AS VARCHAR) AS plan_tier,
  CAST(NULL AS INTEGER) AS vault_limit, CAST(NULL AS BIGINT) AS created_us FROM v_users
UNION ALL SELECT user_id + 20, event_type, 'en', 'free', 5, epoch_us(ts) FROM events e
WHERE NOT EXISTS (SELECT 1 FROM v_users u WHERE u.user_id = e.user_id + 20)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
sql("C9_cascade_delete", ["v_products", "v_reminder_log", "v_users"], """WITH gone AS (
  SELECT product_id FROM v_products WHERE order_status = 'P' OR user_id IN (SELECT user_id FROM v_users WHERE language = 'hi'))
SELECT 'products' AS tbl, product_id AS id, CAST(NULL AS VARCHAR) AS tag FROM v_products WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'users', user_id, NULL FROM v_users WHERE coalesce(language, '') <> 'hi'
UNION ALL SELECT 'reminder_logs', product_id, reminder_type FROM v_reminder_log WHERE product_id NOT IN (SELECT product_id FROM gone)""")
_ALL_IDS = """SELECT {v} AS version, 'products' AS tbl, product_id AS id, CAST(NULL AS VARCHAR) AS tag FROM v_products{p}
UNION ALL SELECT {v}, 'users', user_id, NULL FROM v_users{u}
UNION ALL SELECT {v}, 'reminder_logs', product_id, reminder_type FROM v_reminder_log{p}"""
sql("C9_store_delete", ["v_products", "v_reminder_log", "v_users"], f"""WITH gone AS (
  SELECT product_id FROM v_products WHERE order_status = 'P' OR user_id IN (SELECT user_id FROM v_users WHERE language = 'hi'))
{_ALL_IDS.format(v="'first'", p="", u="")}
UNION ALL {_ALL_IDS.format(v="'newest'", p=" WHERE product_id NOT IN (SELECT product_id FROM gone)", u=" WHERE coalesce(language, '') <> 'hi'")}""")
sql("C8_C12_store_users", ["v_users", "v_actions"], """SELECT n.user_id, first_name, coalesce(arg, language) AS language, plan_tier, created_us FROM (
  SELECT user_id, first_name, language, CAST(NULL AS VARCHAR) AS plan_tier, CAST(NULL AS BIGINT) AS created_us FROM v_users
  UNION ALL (SELECT user_id + 20, event_type, 'en', 'free', epoch_us(ts) FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM v_users u WHERE u.user_id = e.user_id + 20)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)) n
LEFT JOIN (SELECT user_id, arg FROM v_actions WHERE kind = 'set_lang'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) a ON a.user_id = n.user_id""")
product("C10_component_coverage", f"""SELECT product_id, component, months AS component_months, note AS component_note,
  {expiry('purchase_date', 'months')} AS component_expiry, {AS_OF} <= {expiry('purchase_date', 'months')} AS is_covered
FROM v_products LEFT JOIN {COVER} ON cat = category""")
product("C11_recovery_guide", f"""SELECT product_id, key AS guide_key, txt AS guide_text FROM v_products JOIN {GUIDE} ON key = {_guide_key}""")
sql("C12_language", ["v_messages", "v_users"], """SELECT event_id, m.user_id, coalesce(nullif(language, ''), 'en') AS user_lang
FROM v_messages m LEFT JOIN v_users u ON u.user_id = m.user_id""")
sql("C12_set_languages", ["v_actions", "v_users"], """SELECT u.user_id, coalesce(arg, language) AS language FROM v_users u
LEFT JOIN (SELECT user_id, arg FROM v_actions WHERE kind = 'set_lang'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) a ON a.user_id = u.user_id""")
sql("C13_offer_context", ["v_actions", "v_products"], f"""SELECT event_id, kind, a.product_id, coalesce(product_name, 'your device') AS offer_name,
  coalesce({LEFT}, 0) AS offer_days FROM v_actions a LEFT JOIN v_products p ON p.product_id = a.product_id
WHERE kind IN ('extend_warn', 'cashify', 'lead', 'view_prod')""")

# --- model answers
_clean = r"""CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^```(json)?\s*', ''), '\s*```$', '') ELSE t END"""
_fields = ["image_type", "product_name", "brand", "price_paid", "warranty_months", "serial_no", "detected_issue", "purchase_date"]
VIEWS["v_answers"] = f"""SELECT bill_id, engine_rank, obj IS NOT NULL AS readable, coalesce(len(json_keys(obj)) > 0, FALSE) AS spoken, {', '.join(f"obj->>'$.{f}' AS {f}" for f in _fields)} FROM (
  SELECT bill_id, engine_rank, CASE WHEN json_valid(c) THEN CASE WHEN starts_with(c, '{{') THEN c END
    WHEN json_valid(regexp_extract(c, '(?s)\\{{.*\\}}')) THEN regexp_extract(c, '(?s)\\{{.*\\}}') END AS obj
  FROM (SELECT *, {_clean} AS c FROM (SELECT *, {strip('answer')} AS t FROM v_model_json)))"""
NEEDS["v_answers"] = ["v_model_json"]
sql("J1_parse_answer", ["v_answers"], f"SELECT bill_id, engine_rank, readable, {', '.join(_fields[:-1])} FROM v_answers")
VIEWS["v_chosen"] = """SELECT bill_id, engine_rank AS chosen_engine, image_type, product_name, brand, TRY_CAST(price_paid AS DOUBLE) AS price_paid,
  TRY_CAST(warranty_months AS INTEGER) AS warranty_months, serial_no, detected_issue, purchase_date
FROM v_answers WHERE image_type IN ('INVOICE', 'PRODUCT_LABEL', 'DEFECT_ISSUE')
QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY engine_rank) = 1"""
NEEDS["v_chosen"] = ["v_answers"]
sql("G2_first_acceptable", ["v_chosen"], "SELECT * FROM v_chosen")
_places = "CASE model WHEN 'vision-large' THEN 0 WHEN 'vision-free' THEN 1 WHEN 'vision-small' THEN 2 END"
sql("G2_model_order", ["v_answers"], f"""SELECT bill_id, chosen_engine, chosen_model, product_name
FROM (SELECT *, CASE WHEN model = 'other' THEN 1 ELSE 0 END AS chosen_engine, coalesce({_places}, 0) AS chosen_model
  FROM (SELECT *, {pick(X.MODELS, 'bill_id + engine_rank')} AS model FROM v_answers)
  WHERE spoken QUALIFY row_number() OVER (PARTITION BY bill_id, chosen_engine ORDER BY chosen_model) = 1)
WHERE image_type IN ('INVOICE', 'PRODUCT_LABEL', 'DEFECT_ISSUE')
QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY chosen_engine) = 1""")
ORACLE["J2_answer_text"] = "SELECT event_id, props AS content FROM events"
_defect = any_of("lower(coalesce(caption, ''))", V.DEFECT_CAPTION_WORDS)
_ROUTE = f"coalesce(image_type = 'DEFECT_ISSUE', FALSE) OR {_defect}"
_CLAIM = "coalesce(nullif(caption, ''), nullif(detected_issue, ''), 'Defective product')"
sql("P8_route_intake", ["v_answers"], f"""SELECT bill_id, engine_rank, CASE WHEN {_ROUTE} THEN 'claim_check' ELSE 'bill' END AS intake_route,
  CASE WHEN {_ROUTE} THEN {_CLAIM} END AS claim_text FROM (SELECT *, {pick(X.CAPTIONS, 'bill_id')} AS caption FROM v_answers)""")

# --- scalar functions
_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"
# RE2 has no look-around: the neighbours are captured, so the pass is made twice for neighbours shared by two numbers.
def _mask(c):
    return rf"regexp_replace({c}, '(^|{_NOT_W})\p{{Nd}}{{10,16}}($|{_NOT_W})', '\1[REDACTED]\2', 'g')"


ORACLE["T1_redact_pii"] = rf"""SELECT doc_id, regexp_replace({_mask(_mask("coalesce(text, '')"))},
  '[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+', '[EMAIL_REDACTED]', 'g') AS redacted FROM documents"""
ORACLE["T2_sanitize_text"] = f"SELECT page_id, {sanitize('html', 200)} AS safe, {sanitize('html', 100)} AS short_safe FROM pages"
ORACLE["T3_sanitize_serial"] = f"SELECT doc_id, {serial('text')} AS serial FROM documents"
ORACLE["T4_first_word"] = rf"""SELECT doc_id, nullif(regexp_extract({strip('text')}, '^[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+'), '') AS word FROM documents"""
_typed = """CASE o_orderkey % 8 WHEN 0 THEN 'today' WHEN 1 THEN ' Yesterday ' WHEN 2 THEN strftime(d, '%Y-%m-%d')
  WHEN 3 THEN strftime(d, '%-d-%-m-%Y') WHEN 4 THEN strftime(d, '%d/%m/%Y') WHEN 5 THEN strftime(d, '%-d.%-m.%Y')
  WHEN 6 THEN strftime(d, '31-%m-%Y') ELSE 'last week' END"""
ORACLE["D1_human_date"] = f"""SELECT order_id, typed, {human_date('typed', AS_OF, EDIT_FORMATS)} AS edited,
  {human_date('typed', AS_OF, EDIT_FORMATS[:2])} AS entered
FROM (SELECT o_orderkey AS order_id, {_typed} AS typed FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders))"""
ORACLE["D2_price"] = f"""SELECT order_id, typed, {price('typed')} AS price, coalesce({price('typed')}, old) AS kept FROM (
  SELECT o_orderkey AS order_id, o_totalprice AS old, CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || format('{{:,.2f}}', o_totalprice)
    WHEN 1 THEN '₹' || format('{{:,.2f}}', o_totalprice) WHEN 2 THEN '1.2.3' ELSE 'free' END AS typed FROM orders)"""
ORACLE["D3_months"] = f"""SELECT event_id,
  coalesce(TRY_CAST(CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]+$') THEN trim(t) END AS INTEGER), 12) AS preset,
  TRY_CAST(CASE WHEN regexp_matches(trim(t), '^[0-9]+$') THEN trim(t) END AS INTEGER) AS typed_months
FROM (SELECT event_id, {pick(["6", "24", "custom", " 18 ", "-3", "", "12 months", "60"], 'event_id')} AS t FROM events)"""
_typed_day = f"{human_date('typed', AS_OF, EDIT_FORMATS)}"
_typed_months = "TRY_CAST(CASE WHEN regexp_matches(trim(typed), '^[0-9]+$') THEN trim(typed) END AS INTEGER)"
ORACLE["D1_D3_rejects"] = f"""WITH typed AS (
  SELECT o_orderkey AS entry_id, 'date' AS field, {_typed} AS typed FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)
  UNION ALL SELECT event_id, 'months', {pick([*X.TYPED_MONTHS, None], 'event_id')} FROM events),
read AS (SELECT *, CASE WHEN field = 'date' THEN {_typed_day} END AS day, CASE WHEN field = 'months' THEN {_typed_months} END AS months FROM typed),
told AS (SELECT *, CASE WHEN day IS NOT NULL OR months IS NOT NULL THEN NULL WHEN coalesce(trim(typed), '') = '' THEN 'blank'
    WHEN field = 'date' THEN CASE WHEN regexp_matches(trim(typed), '^[0-9]+([-/.])[0-9]+[-/.][0-9]+$') THEN 'no such day' ELSE 'unknown form' END
    WHEN regexp_matches(trim(typed), '^-[0-9]+$') THEN 'negative' WHEN regexp_matches(trim(typed), '^[0-9]+$') THEN 'too large'
    ELSE 'no whole number' END AS reason FROM read)
SELECT entry_id, field, typed, day, months, reason, CASE WHEN reason IS NULL THEN NULL WHEN field = 'date' THEN {lit(V.DATE_REPLY)}
  ELSE {lit(V.MONTHS_REPLY)} END AS reply FROM told"""
ORACLE["D4_formats"] = """SELECT o_orderkey AS order_id, strftime(o_orderdate, '%d %b %Y') AS day,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice <> 0 THEN '₹' || format('{:,.2f}', o_totalprice) ELSE 'Recorded' END AS price FROM orders"""

# --- claims
_issue = "lower(coalesce(issue, ''))"
_flags = ", ".join(f"{any_of(_issue, words)} AS {flag}" for flag, words in V.CLAIM_FLAGS.items())
VIEWS["v_flags"] = f"SELECT *, {_issue} AS t, lower(trim(coalesce(brand, ''))) AS b, lower(trim(coalesce(category, ''))) AS c, {_flags} FROM v_issue_text"
NEEDS["v_flags"] = ["v_issue_text"]
sql("V1_claim_flags", ["v_flags"], f"SELECT event_id, {', '.join(V.CLAIM_FLAGS)} FROM v_flags")
_rule = f"""CASE WHEN has_green_line AND {any_of("(b || ' ' || t)", V.GREEN_LINE_BRANDS)} THEN 1
  WHEN has_physical_crack AND NOT has_green_line THEN 2 WHEN has_water_damage THEN 3
  WHEN has_audio_issue OR contains(c, 'earbud') OR contains(t, 'earbud') OR contains(b, 'boat') OR contains(b, 'noise') THEN 4
  WHEN has_appliance_issue OR {any_of('c', V.APPLIANCE_CATEGORIES)} THEN 5 ELSE 6 END"""
_rules = values([(*r[:8], "|".join(r[8]), "\n".join("• " + s for s in r[8])) for r in V.CLAIM_RULES],
                ["rule", "v0", "e0", "verdict_title", "confidence", "explanation", "service_center_advice", "lost_bill_tip",
                 "steps", "steps_text"])
VIEWS["v_verdicts"] = f"""SELECT *, CASE WHEN rule = 6 AND days_since_purchase > 365 THEN 'CONDITIONAL' ELSE v0 END AS verdict,
  CASE WHEN rule = 6 AND days_since_purchase > 365 THEN '🟡' ELSE e0 END AS verdict_emoji
FROM (SELECT *, {_rule} AS r FROM v_flags) JOIN {_rules} ON rule = r"""
NEEDS["v_verdicts"] = ["v_flags"]
sql("V2_diagnose", ["v_verdicts"], f"""SELECT i.event_id, i.rule AS rule_id, verdict, verdict_emoji, verdict_title, confidence, explanation,
  service_center_advice, lost_bill_tip, s.note AS brand_policy_note, steps FROM v_verdicts i {_policy_join}
QUALIFY row_number() OVER (PARTITION BY i.event_id ORDER BY s.ord) = 1""")
VIEWS["v_free_issue"] = """SELECT event_id, user_id, issue, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS category,
  CAST(NULL AS INTEGER) AS days_since_purchase FROM v_issue_text"""
NEEDS["v_free_issue"] = ["v_issue_text"]
VIEWS["v_free_flags"] = VIEWS["v_flags"].replace("FROM v_issue_text", "FROM v_free_issue")
NEEDS["v_free_flags"] = ["v_free_issue"]
VIEWS["v_free"] = VIEWS["v_verdicts"].replace("FROM v_flags", "FROM v_free_flags")
NEEDS["v_free"] = ["v_free_flags"]
sql("V3_claim_answer", ["v_free"], f"""SELECT i.event_id, verdict, verdict_title AS title, s.note, steps_text, g.name AS mentioned_name,
  g.whatsapp AS mentioned_whatsapp, g.warranty_check_url AS mentioned_warranty_check_url FROM v_free i {_policy_join}
LEFT JOIN {SUPPORT.replace('AS t(', 'AS g(')} ON contains(lower(i.issue), g.key)
QUALIFY row_number() OVER (PARTITION BY i.event_id ORDER BY s.ord, g.ord) = 1""")

# --- bill text
def words(options):
    return f"(?:{'|'.join(options)})"


def bill_views(source, key, ocr, caption, prefix):
    """Views of the bill record over any table of texts."""
    x = lit
    lower, text = "lo", "tx"
    brand = first_case([(f"contains(lo, {x(k)})", x(b)) for k, b, _ in V.BRAND_KEYWORDS], x(V.UNKNOWN_BRAND))
    category = first_case([(f"contains(lo, {x(k)})", x(c)) for k, _, c in V.BRAND_KEYWORDS], x(V.GENERAL_CATEGORY))

    def group(c, pattern, flags=""):
        return f"nullif(regexp_extract({c}, {x(flags + pattern)}, 1), '')"
    iphone, galaxy, airdopes = group(lower, V.IPHONE_PATTERN), group(lower, V.GALAXY_PATTERN), group(lower, V.AIRDOPES_PATTERN)
    storage = f"replace(upper({group(text, V.STORAGE_PATTERN, '(?i)')}), ' ', '')"
    colour = title(group(lower, "(" + "|".join(V.IPHONE_COLOURS) + ")"))
    header = any_of("lower(ln[i - 1])", V.ITEM_HEADER_WORDS)
    item = (f"list_filter(ln, lambda l, i: i > 1 AND {header} AND length(l) > 3 AND NOT regexp_matches(l, '^[0-9]+$') "
            f"AND NOT {any_of('lower(l)', V.NOT_AN_ITEM_WORDS)})[1]")
    kept = r"trim(regexp_replace(l, '[^a-zA-Z0-9\s]', '', 'g'))"
    shop = (f"list_filter(ln[1:6], lambda l: lower(l) NOT IN ({', '.join(map(x, V.BILL_TITLE_LINES))}) "
            f"AND length(regexp_replace({kept}, '[^0-9]', '', 'g')) < 8 AND NOT {any_of('lower(l)', V.RETAILER_NOISE_WORDS)} "
            f"AND length({kept}) >= 4 AND NOT {any_of('lower(l)', V.RETAILER_PLACE_WORDS)})[1]")
    dmy = x(V.DAY_MONTH_YEAR_PATTERN)
    d, m, y = (f"TRY_CAST(regexp_extract(tx, {dmy}, {g}) AS INTEGER)" for g in (1, 2, 3))
    iso = f"regexp_extract(tx, {x(V.ISO_DATE_PATTERN)}, {{}})"
    clean = "replace(p, ',', '')"
    value = f"CAST({clean} AS DOUBLE)"
    raw = f"regexp_extract(tx, {x("(?i)" + words(V.TOTAL_WORDS) + V.TOTAL_PATTERN)}, 1)"
    total_text = strip(f"replace(replace({raw}, ',', ''), ' ', '')")
    names = [f"{prefix}{i}" for i in range(4)]
    VIEWS[names[0]] = f"""SELECT *, lower(tx) AS lo FROM (SELECT {key} AS bill_key, {strip(f"{ocr} || chr(10) || {caption}")} AS tx,
  [{strip('l')} for l in string_split({ocr}, chr(10)) if {strip('l')} <> ''] AS ln FROM {source})"""
    VIEWS[names[1]] = f"""SELECT *, {brand} AS kb, {category} AS kc, {iphone} AS ip, {galaxy} AS ga, {airdopes} AS ai,
  {any_of('lo', V.GROOMING_WORDS)} AS gr, {any_of('lo', V.FOOD_WORDS)} AS food, {storage} AS st, {colour} AS co,
  list_distinct(regexp_extract_all(tx, {x("(?i)" + words(V.REFERENCE_WORDS) + V.REFERENCE_NUMBER_PATTERN)}, 1)) AS excluded,
  regexp_extract_all(tx, {x(V.PRICE_PATTERN)}, 1) AS prices,
  CASE WHEN regexp_matches({total_text}, '^[0-9]+(\\.[0-9]{{2}})?$') THEN TRY_CAST({total_text} AS DOUBLE) END AS total,
  {group(lower, V.YEARS_PATTERN)} AS years FROM {names[0]}"""
    VIEWS[names[2]] = f"""SELECT *,
  CASE WHEN ip IS NOT NULL THEN 'Apple' WHEN ga IS NOT NULL THEN 'Samsung' WHEN ai IS NOT NULL THEN 'boAt' ELSE kb END AS br,
  CASE WHEN ip IS NOT NULL OR ga IS NOT NULL THEN 'Smartphone' WHEN ai IS NOT NULL THEN 'Wearable' WHEN gr THEN 'Personal Care' ELSE kc END AS ca,
  CASE WHEN ip IS NOT NULL THEN 'Apple ' || {title('ip')} || CASE WHEN st IS NULL AND nullif(co, '') IS NULL THEN ''
      ELSE ' (' || concat_ws(', ', st, nullif(co, '')) || ')' END
    WHEN ga IS NOT NULL THEN 'Samsung ' || {strip(title('ga'))} WHEN ai IS NOT NULL THEN 'boAt ' || {title('ai')}
    WHEN gr THEN CASE WHEN kb <> 'Unknown Brand' THEN kb || ' ' ELSE '' END || 'Trimmer / Grooming Kit'
    ELSE coalesce({item}, CASE WHEN kb <> 'Unknown Brand' THEN kb || ' Device' ELSE 'Electronic Device' END) END AS na,
  [{value} for p in prices if NOT list_contains(excluded, {clean}) AND {value} BETWEEN 200 AND 500000
    AND length(split_part({clean}, '.', 1)) <= 6 AND NOT ({value} BETWEEN 110000 AND 110099 AND NOT contains(p, '.'))] AS candidates
FROM {names[1]}"""
    VIEWS[names[3]] = f"""SELECT bill_key, 'INVOICE' AS image_type, food AS is_food_receipt, CAST(NULL AS VARCHAR) AS detected_issue,
  'CLAIMABLE' AS is_claimable_verdict, {x(V.BILL_CONSTANTS['verdict_reason'])} AS verdict_reason,
  {x(V.BILL_CONSTANTS['indian_consumer_tip'])} AS indian_consumer_tip,
  CASE WHEN food AND na = 'Electronic Device' THEN {x(V.FOOD_PRODUCT)} ELSE na END AS product_name,
  CASE WHEN food AND na = 'Electronic Device' THEN {x(V.FOOD_BRAND)} ELSE br END AS brand,
  CASE WHEN food AND na = 'Electronic Device' THEN 'Other' ELSE ca END AS category,
  CASE WHEN shop0 = 'Store / Retailer' AND br <> 'Unknown Brand' THEN br || ' Retail Store' ELSE shop0 END AS retailer,
  CASE WHEN {d} <= 31 AND {m} <= 12 AND {y} BETWEEN 2000 AND 2030
      THEN {y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0')
    WHEN {iso.format(1)} <> '' THEN {iso.format(1)} || '-' || {iso.format(2)} || '-' || {iso.format(3)}
    ELSE {x(X.BILL_AS_OF.isoformat())} END AS purchase_date,
  excluded, candidates,
  CASE WHEN len(candidates) > 0 THEN CASE WHEN total BETWEEN 100 AND 500000 THEN total ELSE list_max(candidates) END END AS price_paid,
  coalesce({group('tx', words(V.SERIAL_WORDS) + V.LABELLED_SERIAL_PATTERN, '(?i)')}, {group('tx', V.BARE_IMEI_PATTERN)}) AS serial_no,
  CASE WHEN food THEN 0 WHEN years IS NOT NULL THEN CAST(years AS INTEGER) * 12 WHEN contains(lo, '3 month') THEN 3
    WHEN contains(lo, '6 month') THEN 6 WHEN contains(lo, 'compressor') OR contains(lo, 'motor') THEN 120 ELSE 12 END AS warranty_months
FROM (SELECT *, CASE {' '.join(f"WHEN contains(lo, {x(w)}) THEN {x(r)}" for w, r in V.RETAILER_WORDS)}
    WHEN food AND {any_of('lo', V.BURGER_SHOP_WORDS)} THEN {x(V.BURGER_SHOP)}
    ELSE coalesce({shop}, 'Store / Retailer') END AS shop0 FROM {names[2]})"""
    for a, b in zip(names[1:], names):
        NEEDS[a] = [b]
    return names


_b = bill_views("v_bill_text", "bill_id", "coalesce(text, '')", "coalesce(caption, '')", "v_bill_")
NEEDS[_b[0]] = ["v_bill_text"]
_all = ["image_type", "product_name", "brand", "category", "retailer", "purchase_date", "price_paid", "serial_no",
        "warranty_months", "is_food_receipt", "detected_issue", "is_claimable_verdict", "verdict_reason", "indian_consumer_tip"]
for _name, _fields_of in {"B1_bill_record": _all, "B2_B5_product_name": ["product_name", "brand", "category"],
                          "B6_serial": ["serial_no"], "B7_retailer": ["retailer"], "B12_months": ["warranty_months"],
                          "B11_food": ["is_food_receipt", "product_name", "brand", "category"]}.items():
    sql(_name, [_b[3]], f"SELECT bill_key AS bill_id, {', '.join(_fields_of)} FROM {_b[3]}")
sql("C7_keyword_brand", [_b[1]], f"SELECT bill_id, {first_case([(f'contains(lower(text), {lit(k)})', lit(b)) for k, b, _ in V.BRAND_KEYWORDS], lit(V.UNKNOWN_BRAND))} AS brand, "
    f"{first_case([(f'contains(lower(text), {lit(k)})', lit(c)) for k, _, c in V.BRAND_KEYWORDS], lit(V.GENERAL_CATEGORY))} AS category FROM v_bill_text")
sql("B8_purchase_date", [_b[3]], f"""SELECT bill_key AS bill_id, purchase_date,
  coalesce(CAST(try_strptime(purchase_date, '%Y-%m-%d') AS DATE), {BILL_DAY}) AS parsed FROM {_b[3]}""")
sql("B9_B10_price", [_b[3]], f"""SELECT bill_key AS bill_id, array_to_string(list_sort(excluded), ',') AS excluded,
  len(candidates) > 0 AS has_candidates, list_max(candidates) AS max_candidate, price_paid FROM {_b[3]}""")
ORACLE["B13_input_choice"] = """SELECT conv_id, turn, CASE WHEN length(o) > 15 THEN o ELSE lower('Invoice_iPhone15_' || role || '.JPG Bought on Amazon') END AS chosen
FROM (SELECT *, text AS o FROM conversations)"""
_d = bill_views("documents", "doc_id", "coalesce(text, '')", "''", "v_doc_")
sql("B1_on_documents", [_d[3]], f"SELECT bill_key AS doc_id, {', '.join(_all)} FROM {_d[3]}")

sql("E1_intake", [_b[3], "v_chosen"], f"""WITH j AS (SELECT t.bill_id, t.caption, c.bill_id IS NOT NULL AS has_model,
  CASE WHEN has_model THEN c.image_type ELSE b.image_type END AS image_type, CASE WHEN has_model THEN c.product_name ELSE b.product_name END AS pn,
  CASE WHEN has_model THEN c.brand ELSE b.brand END AS br, CASE WHEN has_model THEN NULL ELSE b.category END AS ca,
  CASE WHEN has_model THEN NULL ELSE b.retailer END AS re, CASE WHEN has_model THEN c.purchase_date ELSE b.purchase_date END AS pd,
  CASE WHEN has_model THEN c.price_paid ELSE b.price_paid END AS price_paid, CASE WHEN has_model THEN c.serial_no ELSE b.serial_no END AS serial_no,
  coalesce(CASE WHEN has_model THEN c.warranty_months ELSE b.warranty_months END, 12) AS warranty_months,
  CASE WHEN has_model THEN FALSE ELSE b.is_food_receipt END AS is_food_receipt,
  CASE WHEN has_model THEN c.detected_issue END AS detected_issue
  FROM v_bill_text t JOIN {_b[3]} b ON b.bill_key = t.bill_id LEFT JOIN v_chosen c ON c.bill_id = t.bill_id),
k AS (SELECT *, coalesce(CAST(try_strptime(left(pd, 10), '%Y-%m-%d') AS DATE), {BILL_DAY}) AS purchase_date FROM j)
SELECT bill_id, CASE WHEN has_model THEN 'model' ELSE 'text' END AS source,
  CASE WHEN {_ROUTE} THEN 'claim_check' ELSE 'bill' END AS intake_route, CASE WHEN {_ROUTE} THEN {_CLAIM} END AS claim_text,
  coalesce(nullif(pn, ''), 'Electronic Device') AS product_name, coalesce(nullif(br, ''), 'Brand') AS brand,
  coalesce(nullif(ca, ''), 'General') AS category, coalesce(nullif(re, ''), 'Store / Retailer') AS purchase_platform,
  warranty_months, serial_no, price_paid, is_food_receipt, purchase_date, {expiry('purchase_date', 'warranty_months')} AS expiry_date FROM k""")

# --- folds
_keep = f"list_filter(f.kept, lambda x: x > e.us - {X.LIMIT_SECONDS * 1000000})"
_LIMITER = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, [us] AS kept, TRUE AS accepted FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN len({_keep}) < {X.LIMIT_MAX} THEN list_append({_keep}, e.us) ELSE {_keep} END,
  len({_keep}) < {X.LIMIT_MAX} FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT event_id, user_id, accepted FROM f"""
ORACLE["R2_limiter"] = ORACLE["R2_limiter_stream"] = _LIMITER
ORACLE["R2_limiter_arrival"] = f"""SELECT event_id, user_id, CAST({X.ARRIVAL_US} AS BIGINT) AS arrived_us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {X.LIMIT_MAX} AS accepted FROM events"""
sql("R3_sessions", ["v_confirmed"], """SELECT user_id, session_id, confirmed_id, product_name, brand, category, purchase_platform,
  purchase_date, warranty_months, serial_no, price_paid, invoice_file_id, invoice_file_type, local_invoice_path FROM v_confirmed""")
ORACLE["R3_sessions_stream"] = ORACLE["R3_sessions"]
sql("R3_idle_sessions", ["v_idle_confirmed"], """SELECT user_id, session_id, confirmed_id, product_name, brand, category, purchase_platform,
  purchase_date, warranty_months, serial_no, price_paid, invoice_file_id, invoice_file_type, local_invoice_path FROM v_idle_confirmed""")
ORACLE["R3_idle_sessions_stream"] = ORACLE["R3_idle_sessions"]
ORACLE["R5_first_seen_stream"] = """SELECT user_id, 'en' AS language, 'free' AS plan_tier, 5 AS vault_limit, epoch_us(ts) AS created_us
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
ORACLE["R5_first_seen_state"] = ORACLE["R5_first_seen_stream"]
