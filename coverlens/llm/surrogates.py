"""Personal data replaced by surrogates: keyed, of the same kind and format, one per value and never two alike.

Entities are found in whole texts: mail addresses, secrets (keys named as such and long hexadecimal ones), account and card
numbers, social security numbers, IP addresses, phone numbers, and names behind a form of address. A value is brought to a
canonical form (digits of a number, lower-case address), so that all its mentions share a surrogate, whatever their format.
A surrogate is drawn from a keyed hash of kind and canonical value: digits for digits, letters for letters, a card number
that passes its check digit, a private IP address stays private, a name of the same gender, script and letter case.

Distinctness is checked over the whole corpus: where two values of a kind got the same surrogate, or a surrogate is itself
a value of the corpus, all but the first draw again, until none collide. This runs on the distinct values, in Spark. Only
texts that may hold an entity meet their surrogates in a join; the others pass untouched.

A text is looked at once: the texts that may hold an entity are written apart, and the rest of the work reads these.

Edge cases: null and empty texts stay as they are; repeated rows get equal results; rows that share a doc_id, or have none,
are told apart by their texts; an empty table gives no rows; other columns, whatever their names, are kept by `masked` and
ignored by `report`; a value made of marks alone is no secret.

A format with fewer free values than the corpus has values of it (40 000 addresses of 192.168., say) cannot be drawn from. Its
values take the next value of a keyed order of the whole format: distinct by construction, never the value itself, and maybe
another value of the corpus. So do those of a format of which MOST_DRAWS draws leave some without a surrogate; with two fifths
of a format in use, a draw fails at most four times in five. Where a format cannot be numbered, such values get more letters.
No value stops a run.
"""
import functools
import re

import pandas as pd
from pyspark.sql import functions as F

from coverlens.llm.batches import small_batches
from coverlens.session import materialize

KEY = "corpus surrogates"
MOST_DRAWS = 40

#: Forms of address by the gender they tell, names of secrets, top-level domains with a reserved example name.
ADDRESSES = {"m": ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "господин", "г-н"),
             "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "госпожа", "г-жа")}
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "api_key", "apikey", "api-key", "access_key", "auth")
EXAMPLE_DOMAINS = ("com", "net", "org")
TITLES = ("Dr", "Prof", "Professor", "Doktor")
PASSWORD_NAMES = ("password", "passwd", "pwd", "passwort", "passphrase")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza")

_ADDRESS = "|".join(sorted((re.escape(a) for g in ADDRESSES.values() for a in g), key=len, reverse=True))
#: What a text needs to hold any entity; texts without it are not looked at.
HINT = rf"[0-9@]|{_ADDRESS}|(?:{'|'.join(TITLES)})\. ?[A-Z]|PRIVATE KEY-|{'|'.join(KEY_PREFIXES)}|Bearer |(?i)(?:{'|'.join((*SECRET_NAMES, *PASSWORD_NAMES))})[\"']?\s*[=:]"

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w-])")
_SECRET = re.compile(rf"(?i)(?<![A-Za-z])(?:{'|'.join(SECRET_NAMES)})[\"']?\s*[=:]\s*[\"']?(?=[_+/.\-]{{0,64}}[A-Za-z0-9])([A-Za-z0-9_+/.\-]{{8,}}(?<![.\-]))")
_PASSWORD = re.compile(rf"(?i)(?<![A-Za-z])(?:{'|'.join(PASSWORD_NAMES)})[\"']?\s*[=:]\s*[\"']?(?=[^\s\"']{{0,64}}[0-9!@#$%^&*])(?=[^\s\"']{{0,64}}[A-Za-z0-9])"
                       r"([^\s\"'<>,;]{6,128})")
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(re.escape, KEY_PREFIXES))})[A-Za-z0-9_-]{{12,255}}(?![A-Za-z0-9])")
_BEARER = re.compile(r"(?<!\w)Bearer\s+([A-Za-z0-9._~+/-]{12,}=*)")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]{16,}?)\s*-----END ")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:.]*[\w:])")
_HEX = re.compile(r"(?<!\w)(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,128}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,5}[ .-])\d{2,4}(?:[ .-]\d{2,4}){0,3}(?![\w-])")
#: Whole international numbers, and national ones with a long last group.
_CALL = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){0,2}[ .-]?\d{4,12}|\(0\d{1,4}\) ?\d{4,9}|0\d{1,4}[ /]\d{5,9})(?![\w-])")
_WORD = r"[^\W\d_][\w'’-]*"
_NAME = re.compile(rf"(?<!\w)(?:({_ADDRESS})(\.? )|(?=(?:{'|'.join(TITLES)})\b\.? ))((?:(?:{'|'.join(TITLES)})\b\.? ){{0,3}})({_WORD}(?: {_WORD}){{0,3}})")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def script_of(word):
    import unicodedata
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "")
    return next((s for s in ("CYRILLIC", "GREEK") if name.startswith(s)), "LATIN")


def _iban_fits(value):
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ip6(text):
    """A full or shortened address of more than two groups; None for anything else (times, say)."""
    import ipaddress
    try:
        found = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return found if sum(1 for g in text.split(":") if g) > 2 else None


def entities(text):
    """[(start, end, kind, canonical value)] without overlaps, in order."""
    found = []
    if not text:
        return found
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for p in (_SECRET, _PASSWORD) for m in p.finditer(text)]
    if any(p in text for p in KEY_PREFIXES):
        found += [(m.start(), m.end(), "secret", m[0]) for m in _PREFIXED.finditer(text)]
    if "Bearer" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _BEARER.finditer(text)]
    if "PRIVATE KEY-" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _KEY_BLOCK.finditer(text)]
    if text.count(":") > 1:
        found += [(m.start(), m.end(), "ip6", str(a)) for m in _IP6.finditer(text) for a in [_ip6(m[0])] if a is not None]
    if any(c in text for c in "0123456789"):
        found += [(m.start(), m.end(), "secret", m[0]) for m in _HEX.finditer(text)]
        found += [(m.start(), m.end(), "iban", v) for m in _IBAN.finditer(text) for v in [m[0].replace(" ", "")]
                  if 15 <= len(v) <= 34 and _iban_fits(v)]
        found += [(m.start(), m.end(), "card", d) for m in _CARD.finditer(text) for d in [re.sub(r"\D", "", m[0])] if luhn(d)]
        found += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
        found += [(m.start(), m.end(), "phone", d) for p in (_PHONE, _CALL) for m in p.finditer(text) for d in [re.sub(r"[^\d+]", "", m[0])]
                  if 9 <= len(d) <= 16]
    whole = {}
    for m in _NAME.finditer(text):
        gender = next((g for g, forms in ADDRESSES.items() if m[1] in forms), "n")
        words, at = [], m.start(4)
        for word in m[4].split(" "):
            if not word[0].isupper():
                break
            words.append((at, word))
            at += len(word) + 1
        found += [(at, at + len(w), f"name {gender} {script_of(w)}", w.lower()) for at, w in words]
        if len(words) > 1:
            whole.setdefault(" ".join(w for _, w in words), gender)
    for name, gender in whole.items():  # later mentions of a full name, without a form of address
        at = text.find(name)
        while at >= 0:
            if not (text[at - 1:at].isalnum() or text[at + len(name):at + len(name) + 1].isalnum()):
                start = at
                for w in name.split(" "):
                    found.append((start, start + len(w), f"name {gender} {script_of(w)}", w.lower()))
                    start += len(w) + 1
            at = text.find(name, at + len(name))
    rank = ("email", "secret", "iban", "card", "ssn", "ip", "ip6", "phone", "name")
    kept, taken = [], bytearray(len(text))
    for e in sorted(found, key=lambda e: (rank.index(e[2].split(" ")[0]), e[0], -e[1])):
        if not any(taken[e[0]:e[1]]):
            taken[e[0]:e[1]] = b"\1" * (e[1] - e[0])
            kept.append(e)
    return sorted(kept)


class _Draw:
    """Numbers from a keyed hash, as many as asked for."""

    def __init__(self, key, *what):
        import hmac
        self.state = hmac.new(key.encode(), "\x1f".join(what).encode("utf-8", "surrogatepass"), "sha256").digest()
        self.left = int.from_bytes(self.state, "big")

    def __call__(self, n):
        import hashlib
        if self.left < 1 << 64:
            self.state = hashlib.sha256(self.state).digest()
            self.left = int.from_bytes(self.state, "big")
        self.left, x = divmod(self.left, n)
        return x


_HEXDIGITS = "0123456789abcdef"
_SYLLABLES = {"LATIN": ("bdfgklmnprstv", "aeiou", "a", "nrsl"), "CYRILLIC": ("бвгдклмнрст", "аеиоу", "а", "нрсл"),
              "GREEK": ("βγδκλμνπρστ", "αειου", "α", "σ")}


def _shaped(value, draw):
    """Digits for digits, letters for letters of the same case, other characters as they are."""
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
        digits = _HEXDIGITS if value == value.lower() else _HEXDIGITS.upper()
        return "".join(digits[draw(16)] for _ in value)
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw(10)))
        elif c.isalpha():
            x = "abcdefghijklmnopqrstuvwxyz"[draw(26)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _fixed_parts(ip):
    """How many parts of an address its private range keeps."""
    parts = ip.split(".")
    return 1 if parts[0] in ("10", "127") else 2 if ip.startswith("192.168.") or (parts[0] == "172" and 16 <= int(parts[1]) < 32) else 0


#: First address and size of the private ranges, in order.
_PRIVATE = ((10 << 24, 1 << 24), (127 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16))
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def format_space(kind, value):
    """(format, size, index, value of an index): all values of the format, numbered; None if it cannot be used up."""
    if kind == "ip":
        parts = value.split(".")
        if any(p != str(int(p)) for p in parts):
            return None
        n, fixed = int.from_bytes(map(int, parts), "big"), _fixed_parts(value)
        if fixed:
            bits = 8 * (4 - fixed)
            first = n >> bits << bits
            return ".".join(parts[:fixed]), 1 << bits, n - first, lambda i: ".".join(map(str, (first + i).to_bytes(4, "big")))

        def public(i):
            for first, size in _PRIVATE:
                i += size * (i >= first)
            return ".".join(map(str, i.to_bytes(4, "big")))
        return "", (1 << 32) - sum(x for _, x in _PRIVATE), n - sum(x for first, x in _PRIVATE if first < n), public
    if kind == "card":
        head, free = value[0], len(value) - 2
        return (f"{head} {free}", 10 ** free, int(value[1:-1]),
                lambda i: next(c for d in _DIGITS if luhn(c := f"{head}{i:0{free}d}{d}")))
    if kind not in ("ssn", "phone", "secret") or not value.isascii():
        return None
    kept = (2 if value[1:2] in "17" else 3) if kind == "phone" and value.startswith("+") else 0
    letters = [c if i < kept else next((a for a in (_DIGITS, _LOWER, _LOWER.upper()) if c in a), c) for i, c in enumerate(value)]
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
        return None  # 16^16 at least
    size, index = 1, 0
    for c, a in zip(value, letters):
        size, index = size * len(a), index * len(a) + a.index(c)
        if size > 1 << 62:
            return None  # cannot be used up

    def value_of(i):
        out = []
        for a in reversed(letters):
            i, k = divmod(i, len(a))
            out.append(a[k])
        return "".join(reversed(out))
    return "".join(a[0] for a in letters), size, index, value_of


def next_in_order(index, size, *what):
    """The index after this one in a keyed order of range(size): a permutation without fixed points if size > 1."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def turned(x, rounds, back):
        while True:  # a Feistel network over 2 * half bits, walked until it is back in range
            a, b = x >> half, x & mask
            for r in rounds:
                if back:
                    a, b = b ^ (_Draw(*what, str(r), str(a)).left & mask), a
                else:
                    a, b = b, a ^ (_Draw(*what, str(r), str(b)).left & mask)
            x = a << half | b
            if x < size:
                return x

    return turned((turned(index, range(6), False) + 1) % size, range(5, -1, -1), True)


def _formats(values):
    """(kind, value, format, size) of the values whose format is numbered."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            spaces = [format_space(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x and x[0] for x in spaces], pa.string()),
                                   pa.array([x and min(x[1], 1 << 62) for x in spaces], pa.int64())], ["kind", "value", "format", "size"])

    return values.select("kind", "value").mapInArrow(run, "kind string, value string, format string, size long").where("format is not null")


def overfull(formed):
    """(kind, format) that have fewer free values than the corpus has values."""
    return formed.groupBy("kind", "format", "size").agg(F.count(F.lit(1)).alias("n")).where("2 * n > size").select("kind", "format")


def moved_on(formed, formats, key=KEY):
    """(kind, value, attempt, surrogate) of all values of these formats."""
    def move(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, size, index, value_of = format_space(k, v)
                out.append(value_of(next_in_order(index, size, key, k, name)))
            yield pa.record_batch([*batch.columns, pa.array([0] * len(out), pa.int32()), pa.array(out, pa.string())],
                                  ["kind", "value", "attempt", "surrogate"])

    return (formed.join(formats.distinct(), ["kind", "format"]).select("kind", "value")
            .mapInArrow(move, "kind string, value string, attempt int, surrogate string"))


def surrogate(kind, value, attempt, key=KEY):
    """The attempt-th surrogate of a canonical value."""
    draw = _Draw(key, kind, value, str(attempt))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        hosts = [_shaped(x, draw) for x in labels[:-2]]
        top = labels[-1] if labels[-1] in EXAMPLE_DOMAINS else "org"
        return f"{_shaped(local, draw)}{''.join('abcdefghij'[draw(10)] for _ in range(attempt // 4))}@{'.'.join([*hosts, 'example', top])}"
    if kind == "ip":
        parts = value.split(".")
        fixed = _fixed_parts(value) if attempt <= MOST_DRAWS // 2 else 0
        free = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        return ".".join([*parts[:fixed], *(str(free[draw(len(free))]) if i == 0 else str(draw(256)) for i in range(fixed, 4))])
    if kind == "ip6":
        import ipaddress
        return str(ipaddress.IPv6Address((0x20010db8 << 96) + sum(draw(1 << 16) << 16 * i for i in range(6))))
    if kind == "card":
        body = value[0] + "".join(str(draw(10)) for _ in value[1:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = "".join(str(draw(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw(26)] for c in value[4:])
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "phone" and value.startswith("+"):
        kept = 2 if value[1] in "17" else 3
        return value[:kept] + _shaped(value[kept:], draw)
    if kind.startswith("name "):
        _, gender, script = kind.split(" ")
        consonants, vowels, female, male = _SYLLABLES[script]
        n = max(2, min(4, len(value) // 2)) + attempt // 6
        word = "".join(consonants[draw(len(consonants))] + vowels[draw(len(vowels))] for _ in range(n))
        return word[:-1] + female if gender == "f" else word + male[draw(len(male))] if gender == "m" else word
    longer = "".join("abcdefghij"[draw(10)] for _ in range((attempt - MOST_DRAWS) // 4 + 2)) if attempt > MOST_DRAWS else ""
    return _shaped(value, draw) + longer


def shown(kind, value, mention):
    """A surrogate in the format of the mention it replaces."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(value)
        return "".join(next(rest, "") if c.isalnum() or c == "+" else c for c in mention)
    if kind.startswith("name "):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[0].upper() + value[1:]
    return value


def found_in(texts):
    """(d, h, kind, value): the distinct entities of (d, h, text)."""
    def run(batches):
        import pyarrow as pa
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = [(d, h, k, v) for d, h, t in zip(*(batch.column(i).to_pylist() for i in range(3)))
                    for k, v in {(e[2], e[3]) for e in entities(t)}]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["d", "h", "kind", "value"])

    return texts.select("d", "h", "text").mapInArrow(run, "d long, h long, kind string, value string")


def _drawn(values, key):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            yield pa.record_batch([*batch.columns, pa.array([surrogate(*x, key) for x in zip(kinds, values, attempts)], pa.string())],
                                  ["kind", "value", "attempt", "surrogate"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def assign(values, key=KEY):
    """values: distinct (kind, value). (kind, value, attempt, surrogate), no two surrogates of a kind alike and none a value,
    but for formats that are used up."""
    formed = materialize(_formats(values), "surrogate-formats")
    moved = materialize(moved_on(formed, overfull(formed), key), "surrogates-moved")
    rest = values.join(moved.select("kind", "value"), ["kind", "value"], "left_anti")
    now = materialize(_drawn(rest.withColumn("attempt", F.lit(0)), key), "surrogates")

    def known(*tables):
        return functools.reduce(lambda a, b: a.unionByName(b), tables).distinct().withColumn("taken", F.lit(True))

    own = values.select("kind", F.col("value").alias("surrogate"))
    taken = known(own, moved.select("kind", "surrogate"))
    for turn in range(2 * MOST_DRAWS):
        shared = (now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count(F.lit(1)).alias("n"))
                  .join(taken, ["kind", "surrogate"], "left").where("n > 1 or taken"))
        later = F.struct("attempt", "value") != F.col("first")
        marked = now.join(shared, ["kind", "surrogate"], "left").withColumn(
            "again", F.coalesce("taken", F.lit(False)) | F.coalesce(later, F.lit(False)))
        marked = materialize(marked.select("kind", "value", "attempt", "surrogate", "again"), "surrogates-marked")
        if marked.where("again").isEmpty():
            break
        if turn == MOST_DRAWS:  # numbered formats move as a whole; what is not numbered goes on with longer surrogates
            left = formed.join(marked.where("again").select("kind", "value"), ["kind", "value"], "left_semi")
            more = materialize(moved_on(formed, left.select("kind", "format"), key), "surrogates-moved")
            moved = moved.unionByName(more)
            marked = materialize(marked.join(more.select("kind", "value"), ["kind", "value"], "left_anti"), "surrogates-marked")
            taken = known(own, moved.select("kind", "surrogate"))
        redrawn = _drawn(marked.where("again").withColumn("attempt", F.col("attempt") + 1), key)
        now = materialize(marked.where("not again").drop("again").unionByName(redrawn), "surrogates")
    return now.unionByName(moved)


def masked(docs, key=KEY, count=None):
    """docs with surrogates in `text` and all their columns, and, if asked for, `count`: how many mentions were replaced."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    doc_id = f"c{docs.columns.index('doc_id')}"
    may = F.coalesce(F.col("text").rlike(HINT), F.lit(False)).alias("may")
    apart = materialize(docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], may), "hinted", by=["may"])
    work = apart.withColumn("d", F.coalesce(F.col(doc_id).cast("long"), F.lit(-1))).withColumn("h", F.xxhash64(f"c{at}"))
    hinted = work.where("may")
    found = materialize(found_in(hinted.withColumnRenamed(f"c{at}", "text")), "entities").distinct()
    given = assign(found.select("kind", "value").distinct(), key)
    per_doc = (found.join(given, ["kind", "value"]).groupBy("d", "h")
               .agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("given")))  # a text's own entities

    def run(text, given):
        texts, counts = [], []
        for t, g in zip(text, given):
            if g is None or not len(g):
                texts.append(t)
                counts.append(0)
                continue
            by = {(x["kind"], x["value"]): x["surrogate"] for x in g}
            out, at, here = [], 0, entities(t)
            for start, end, kind, value in here:
                out += [t[at:start], shown(kind, by[kind, value], t[start:end])]
                at = end
            texts.append("".join(out) + t[at:])
            counts.append(len(here))
        return pd.DataFrame({"text": texts, "replaced": counts})

    run.__annotations__ = {"text": pd.Series, "given": pd.Series, "return": pd.DataFrame}
    replace = F.pandas_udf(run, "text string, replaced int")
    hinted = hinted.join(per_doc, ["d", "h"], "left").withColumn("out", replace(f"c{at}", "given"))

    def columns(text, replaced):
        kept = [(text if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
        return kept + ([replaced.alias(count)] if count else [])

    return (hinted.select(columns(F.col("out.text"), F.col("out.replaced")))
            .unionAll(work.where("not may").select(columns(F.col(f"c{at}"), F.lit(0)))))


def report(docs, key=KEY):
    """One row per document: doc_id, text with surrogates, replaced."""
    return masked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, "replaced")
