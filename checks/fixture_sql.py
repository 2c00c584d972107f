"""The views of ``fixtures`` and common expressions as SQL for the comparison engine."""
from checks import fixtures as X
from coverlens import fixed_values as V
from coverlens.functions.text import WHITESPACE


def lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def day(d):
    return f"DATE '{d.isoformat()}'"


def pick(values, n):
    return f"([{', '.join(lit(v) for v in values)}])[({n}) % {len(values)} + 1]"


def strip(c):
    return f"trim({c}, {lit(WHITESPACE)})"


def any_of(c, words):
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def first_case(pairs, default="NULL"):
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + f" ELSE {default} END"


def title(c):
    return rf"array_to_string([upper(x[1]) || lower(x[2:]) for x in regexp_extract_all({c}, '(\p{{L}}+|\P{{L}}+)', 1)], '')"


def values(rows, columns):
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"


def expiry(d, months):
    return f"({d} + CAST(trunc({months} * 30.4375) AS INTEGER))"


def sanitize(c, n):
    out = strip(f"coalesce({c}, '')")
    for raw, escaped in V.HTML_ESCAPES:
        out = f"replace({out}, {lit(raw)}, {lit(escaped)})"
    return f"left({out}, {n})"


VIEWS = {}
NEEDS = {"v_reminder_log": ["v_products"], "v_bill_text": ["v_products"]}

VIEWS["v_users"] = """SELECT c_custkey AS user_id, c_name AS first_name, CAST(NULL AS VARCHAR) AS last_name,
  CASE WHEN c_custkey % 4 = 0 THEN 'hi' WHEN c_custkey % 4 <> 1 THEN 'en' END AS language FROM customer"""

_category = first_case([(f"p_type = {lit(k)}", lit(v)) for k, v in X.CATEGORIES.items()])
_months = pick(X.MONTHS, "p_partkey")
VIEWS["v_products"] = f"""SELECT o_orderkey AS product_id, o_custkey AS user_id, p_name AS product_name,
  {pick(X.BRANDS, 'p_partkey')} AS brand, {_category} AS category,
  CASE WHEN p_size > 25 THEN 'M' || p_size END AS model_no,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'SN' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS serial_no,
  {pick(X.PLATFORMS, 'o_orderkey')} AS purchase_platform, CAST(o_orderdate AS DATE) AS purchase_date,
  {_months} AS warranty_months, {expiry('CAST(o_orderdate AS DATE)', _months)} AS expiry_date,
  o_totalprice AS price_paid, o_orderpriority AS notes, o_orderstatus AS order_status
FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
JOIN part ON p_partkey = pk"""

TAG = "CASE WHEN n = 0 THEN 'expired' ELSE n || '_day' END"
VIEWS["v_reminder_log"] = f"""SELECT product_id, {TAG} AS reminder_type
FROM v_products, (VALUES {', '.join(f'({n})' for n in V.REMINDER_DAYS)}) AS m(n)
WHERE order_status = 'F' AND expiry_date - n <= {day(X.AS_OF)}"""

_shown = f"(purchase_date + {X.BILL_SHIFT_DAYS})"
VIEWS["v_bill_text"] = f"""SELECT product_id AS bill_id, user_id, {pick(X.CAPTIONS, 'user_id')} AS caption, array_to_string([
  'TAX INVOICE', coalesce(purchase_platform, 'Ph 98765 43210'),
  'Date: ' || CASE product_id % 3 WHEN 0 THEN strftime({_shown}, '%d-%m-%Y') WHEN 1 THEN strftime({_shown}, '%-d/%-m/%Y')
    ELSE strftime({_shown}, '%Y-%m-%d') END,
  'Particulars',
  CASE product_id % 9 WHEN 0 THEN 'Apple iPhone 15 Pro Max 256 GB Natural Titanium' WHEN 1 THEN 'iphone 13 mini 128gb'
    WHEN 2 THEN 'Samsung Galaxy S22 Ultra' WHEN 3 THEN 'boAt Airdopes 141 Black' WHEN 4 THEN brand || ' Trimmer'
    ELSE brand || ' ' || product_name END,
  CASE WHEN serial_no IS NOT NULL THEN 'S/N: ' || serial_no
    WHEN product_id % 2 = 0 THEN '35' || lpad(CAST(product_id AS VARCHAR), 13, '0') ELSE 'S/N:' END,
  'Order # ' || product_id, {pick(X.COVER_PHRASES, 'product_id')},
  CASE product_id % 4 WHEN 0 THEN 'Grand Total: ' || CAST(floor(price_paid) AS BIGINT)
    WHEN 1 THEN 'Amount Payable = ' || CAST(floor(price_paid) AS BIGINT) || '.50'
    WHEN 2 THEN 'Paid ' || format('{{:,}}', CAST(floor(price_paid) AS BIGINT))
    ELSE 'Итого ' || CAST(floor(price_paid) AS BIGINT) END], chr(10)) AS text
FROM v_products"""

VIEWS["v_issue_text"] = f"""SELECT event_id, user_id, {pick(X.ISSUES, 'event_id')} AS issue, {pick(X.BRANDS, 'user_id')} AS brand,
  {pick(X.ISSUE_CATEGORIES, 'event_id')} AS category,
  CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 800 AS INTEGER) END AS days_since_purchase FROM events"""

VIEWS["v_messages"] = f"SELECT event_id, user_id, ts, {pick(X.MESSAGES, 'event_id')} AS text FROM events"

VIEWS["v_model_json"] = f"""SELECT event_id // 3 AS bill_id, CAST(event_id % 3 AS INTEGER) AS engine_rank,
  {pick(X.ANSWERS, 'event_id // 2')} AS answer FROM events"""

VIEWS["v_files"] = f"""SELECT doc_id, '/in/' || source || '/f' || doc_id || {pick(X.FILE_SUFFIXES, 'doc_id')} AS path,
  CASE WHEN doc_id % 13 <> 0 THEN n_chars * 2000 END AS length, doc_id % 4 = 0 AS is_photo FROM documents"""

# Session events with the parsed value of each edit.
_start = "kind = 'photo'"
VIEWS["v_session_events"] = f"""SELECT user_id, ts, event_id, value AS amount, path AS file_path,
  CASE WHEN doc_id IS NOT NULL THEN 'f' || doc_id END AS file_id, CASE WHEN is_photo THEN 'photo' WHEN NOT is_photo THEN 'document' END AS file_type,
  CASE event_type WHEN 'signup' THEN 'photo' WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'cancel' ELSE 'edit' END AS kind,
  CASE event_type WHEN 'view' THEN {pick(X.EDIT_FIELDS, 'event_id')} WHEN 'click' THEN 'category' END AS field,
  CASE event_type WHEN 'view' THEN {pick(X.EDIT_VALUES, 'event_id // 5')} WHEN 'click' THEN {pick(X.PICKS, 'event_id')} END AS value
FROM events LEFT JOIN (SELECT * FROM v_files WHERE is_photo OR NOT coalesce(length > {V.MAX_UPLOAD_BYTES}, FALSE)) ON doc_id = event_id % {X.FILES}"""
NEEDS["v_session_events"] = ["v_files"]


def human_date(c, as_of, formats):
    t = f"lower({strip(c)})"
    shapes = {"%Y-%m-%d": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%d-%m-%Y": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
              "%d/%m/%Y": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%d.%m.%Y": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"}
    parsed = [(f"regexp_matches({t}, {lit(shapes[f])})", f"CAST(try_strptime({t}, {lit(f)}) AS DATE)") for f in formats]
    return first_case([(f"{t} IN ('today', 'now')", as_of), (f"{t} = 'yesterday'", f"{as_of} - 1")] + parsed)


EDIT_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y"]


def price(c):
    digits = f"regexp_replace({c}, '[^0-9.]', '', 'g')"
    return f"TRY_CAST(CASE WHEN regexp_matches({digits}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN {digits} END AS DOUBLE)"


def serial(c):
    cleaned = strip(f"coalesce({c}, '')")
    return f"left(regexp_replace({cleaned}, '[^A-Za-z0-9\\- ]', '', 'g'), 30)"


_word = rf"regexp_extract({strip('value')}, '^\S+')"
_writes = {
    "product_name": ("'Item ' || event_id", [("field = 'name'", sanitize("value", 200))]),
    "brand": (pick(X.BRANDS, "event_id"), [(f"field = 'name' AND {strip('value')} <> ''", sanitize(_word, 100))]),
    "category": ("'General'", [("field = 'category'", "value")]),
    "purchase_platform": (pick(X.PLATFORMS, "event_id"), [("field = 'retailer'", sanitize("value", 100))]),
    "purchase_date": ("CAST(ts AS DATE) - CAST(event_id % 700 AS INTEGER)",
                      [(f"field = 'date' AND {human_date('value', 'CAST(ts AS DATE)', EDIT_FORMATS)} IS NOT NULL",
                        human_date("value", "CAST(ts AS DATE)", EDIT_FORMATS))]),
    "warranty_months": (_months.replace("p_partkey", "event_id"),
                        [("field = 'warranty' AND regexp_matches(trim(value), '^[0-9]+$')", "TRY_CAST(trim(value) AS INTEGER)")]),
    "serial_no": ("CAST(NULL AS VARCHAR)", [("field = 'serial'", serial("value"))]),
    "invoice_file_id": ("file_id", []), "invoice_file_type": ("file_type", []), "local_invoice_path": ("file_path", []),
    "price_paid": ("amount", [(f"field = 'price' AND {price('value')} IS NOT NULL", price("value"))]),
}
_write_columns = ",\n  ".join(
    "CASE WHEN " + _start + f" THEN {{'v': {init}}} " + " ".join(f"WHEN {c} THEN {{'v': {v}}}" for c, v in edits)
    + f" END AS w_{name}" for name, (init, edits) in _writes.items())
_upto = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_earlier = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
VIEWS["v_session_writes"] = f"""SELECT *, {_write_columns},
  CASE WHEN {_start} THEN TRUE WHEN kind IN ('confirm', 'cancel') THEN FALSE END AS opened,
  CASE WHEN {_start} THEN event_id END AS started FROM v_session_events"""
VIEWS["v_confirmed"] = f"""SELECT user_id, session_id, event_id AS confirmed_id, ts AS confirmed_at,
  {', '.join(f's_{n}.v AS {n}' for n in _writes)} FROM (
  SELECT user_id, ts, event_id, kind, last_value(opened IGNORE NULLS) {_earlier} AS was_open,
    last_value(started IGNORE NULLS) {_upto} AS session_id,
    {', '.join(f'last_value(w_{n} IGNORE NULLS) {_upto} AS s_{n}' for n in _writes)} FROM v_session_writes)
WHERE kind = 'confirm' AND was_open"""
#: The same with sessions that end in a long silence.
_silent = f"coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {X.IDLE_SECONDS * 1_000_000}, FALSE)"
VIEWS["v_idle_writes"] = f"""SELECT * REPLACE (CASE WHEN {_start} THEN TRUE WHEN silent THEN FALSE ELSE opened END AS opened) FROM (
  SELECT *, {_silent} AS silent FROM v_session_writes)"""
VIEWS["v_idle_confirmed"] = VIEWS["v_confirmed"].replace("v_session_writes", "v_idle_writes").replace(
    "SELECT user_id, ts, event_id, kind,", "SELECT user_id, ts, event_id, kind, silent,").replace("AND was_open", "AND was_open AND NOT silent")
NEEDS["v_idle_writes"] = ["v_session_writes"]
NEEDS["v_idle_confirmed"] = ["v_idle_writes"]
NEEDS["v_session_writes"] = ["v_session_events"]
NEEDS["v_confirmed"] = ["v_session_writes"]


def with_views(names, body, recursive=False):
    """The body with the views it needs, in order, as common table expressions."""
    order = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    heads = [f"{n} AS ({VIEWS[n]})" for n in order]
    if body.startswith("WITH "):
        heads.append(body[5:])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + "\n" + body) if heads else body
