"""Text helpers as column expressions: all stay inside JVM code generation."""
from pyspark.sql import Column, functions as F

from coverlens import fixed_values as V

# Every character that str.strip() drops; trim() alone drops spaces only.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def as_col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def or_default(c, default) -> Column:
    """Default for NULL and for the empty string alike."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(as_col(c), F.lit("")), default)


def sql_text(v) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(c, words) -> Column:
    """Is any of the words in the text? A column name makes one short expression of a long list."""
    if isinstance(c, str):
        return F.expr(" OR ".join(f"contains({c}, {sql_text(w)})" for w in words))
    hit = c.contains(words[0])
    for w in words[1:]:
        hit = hit | c.contains(w)
    return hit


def first_case(pairs) -> Column:
    """Value of the first true condition of (condition, value) pairs of SQL text, else NULL."""
    return F.expr("CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs) + " END")


def first_word_of(name, pairs) -> Column:
    """Value of the first (word, value) whose word is in the named column, else NULL."""
    return first_case([(f"contains({name}, {sql_text(w)})", sql_text(v)) for w, v in pairs])


_CLASSES = {r"\w": r"[\p{L}\p{N}_]", r"\d": r"\p{Nd}", r"\s": r"[\s\x1c-\x1f\x85\p{Z}]"}
# Our outer boundaries stand next to a digit; asking for the digit first is what fails soonest.
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?=\p{Nd})(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def unicode_pattern(pattern):
    """Gives \\w \\d \\s and an outer \\b their Unicode meaning.

    Java's own Unicode flag counts combining marks as word characters, which
    would move word boundaries in Devanagari text; so the classes are spelled out.
    """
    if pattern.startswith(r"\b"):
        pattern = NOT_AFTER_WORD + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + NOT_BEFORE_WORD
    for short, spelled in _CLASSES.items():
        pattern = pattern.replace(short, spelled)
    return pattern


def after_words(words, pattern):
    """A pattern behind one of some words. The first letters are looked at first: most positions end there."""
    letters = "".join(sorted({w[0] for w in words}))
    return f"(?=[{letters}])(?:{'|'.join(words)})" + pattern


def title_case(c) -> Column:
    """A capital after every non-letter; initcap() would only break at spaces."""
    runs = F.regexp_extract_all(as_col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def non_blank_lines(c) -> Column:
    """Trimmed lines with their lower-case form, as an array of (line, low)."""
    lines = F.filter(F.transform(F.split(as_col(c), "\n", -1), strip), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))


def bind(value, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redact_pii(c) -> Column:
    """Masks long numbers, then mail addresses.

    A mail address starts where its run of characters starts, so other
    positions need not be tried; texts without an @ are left alone.
    """
    run_start = r"(?<![\p{L}\p{N}_\.-])"
    c = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), unicode_pattern(V.LONG_NUMBER_PATTERN), V.LONG_NUMBER_MASK)
    return bind(c, lambda t: F.when(t.contains("@"), F.regexp_replace(t, run_start + unicode_pattern(V.EMAIL_PATTERN),
                                                                      V.EMAIL_MASK)).otherwise(t))


def sanitize_text(c, max_len=V.TEXT_MAX_CHARS) -> Column:
    """Trim, escape HTML, then cut: an escape may be cut in the middle."""
    c = strip(F.coalesce(as_col(c), F.lit("")))
    for raw, escaped in V.HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.substring(c, 1, max_len)


def sanitize_serial(c) -> Column:
    kept = F.regexp_replace(strip(F.coalesce(as_col(c), F.lit(""))), r"[^A-Za-z0-9\- ]", "")
    return F.substring(kept, 1, V.SERIAL_MAX_CHARS)


def first_word(c) -> Column:
    """First whitespace-separated word, NULL for a blank text."""
    return F.nullif(F.split(strip(c), unicode_pattern(r"\s+"), 2)[0], F.lit(""))


def parse_price(c, old=None) -> Column:
    """Digits and dots of a text as a number; the old value when that fails."""
    digits = F.regexp_replace(as_col(c), r"[^0-9.]", "")
    value = F.when(digits.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.try_cast("double"))
    return value if old is None else F.coalesce(value, as_col(old))


def parse_months(c, strict=False) -> Column:
    """Months of a preset (12 when unreadable) or, strict, of typed text (NULL when unreadable)."""
    c = strip(c)
    if strict:
        return F.when(c.rlike(unicode_pattern(r"^\d+$")), c.try_cast("int"))
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int")), F.lit(V.DEFAULT_WARRANTY_MONTHS))


def format_price(c) -> Column:
    c = as_col(c)
    return F.when(c.isNull() | (c == 0), F.lit(V.PRICE_NOT_GIVEN)).otherwise(
        F.concat(F.lit("₹"), F.format_number(c, 2)))
