"""The language of web pages: text likelihoods, declared markup, address and host priors fused by Bayes' rule.

For a page and a language, four sources are multiplied:
  * the likelihood of the visible text under word frequencies of the language, tempered by its length, as words of a page
    are not independent,
  * how often pages of that language declare what this page declares (<html lang>),
  * how often pages of that language have this address suffix, where the suffix or the first path segment names a language,
  * the prior of the host, smoothed towards its site, the site towards all pages; a page's own share is taken out first.

Word frequencies are fitted on a bounded sample of labelled documents (MAX_ROWS per language) and cut to the MAX_WORDS that
tell the languages apart best. The other three are counted over all pages in grouped aggregates of the text's verdicts.

Edge cases: null and empty html leave the text silent; a null url, or one without host, has only the prior of all pages;
an undeclared or unknown language is shown as 'none' and counts as a value like any other; any text can name a language but the empty one; without any labelled document no language is known and
every page gets a null language with confidence 0; repeated rows each get a row; an empty table gives no rows; other columns
are ignored; ties go to the language that comes first in the alphabet.
"""
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coverlens.llm.link_filter import host_of, path_of
from coverlens.session import materialize

MAX_ROWS = 2_000
MAX_WORDS = 20_000
#: Words after which more text does not make the verdict surer, smoothing of words, and strength of the wider prior.
ENOUGH_WORDS = 30
WORD_SMOOTHING = 0.5
PRIOR_STRENGTH = 5.0
VALUE_SMOOTHING = 1.0

_HIDDEN = re.compile(r"(?i)<(?:(script|style|head|nav|footer)\b|!--)")
_CLOSED = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "head", "nav", "footer")} | {None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"(?is)\blang\s*=\s*[\"']?([A-Za-z]{2,3})")
_WORD = re.compile(r"[^\W\d_]+")


def _without_hidden(html):
    """html without comments and hidden elements that are closed, in one pass: what is not closed once is not looked for again."""
    out, at, start, open_ended = [], 0, 0, set()
    while True:
        m = _HIDDEN.search(html, at)
        if m is None:
            return "".join(out) + html[start:] if out else html
        name = m[1] and m[1].lower()
        end = None if name in open_ended else _CLOSED[name].search(html, m.end())
        if end is None:
            open_ended.add(name)
            at = m.end()
        else:
            out += [html[start:m.start()], " "]
            at = start = end.end()


def visible(html):
    """The text between tags; time is proportional to the page, however broken it is."""
    from html import unescape
    shown = _without_hidden(html or "")
    last = shown.rfind(">") + 1  # no tag ends after it
    return unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


def declared_in(html):
    """The language that an html tag declares, in lower case; None without one."""
    at = 0
    while m := _HTML.search(html or "", at):
        end = html.find(">", m.end())
        at = len(html) if end < 0 else end
        found = _LANG.search(html, m.end(), at)
        if found:
            return found[1].lower()
    return None


def words_of(text):
    return _WORD.findall((text or "").lower())


def fit(docs, max_rows=MAX_ROWS, max_words=MAX_WORDS):
    """(languages, {word: log frequencies per language}, log frequencies of other words) from at most max_rows texts each."""
    labelled = docs.where("lang is not null and lang <> '' and doc_id is not null")
    many = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))  # as many rows as languages
    h = F.xxhash64("doc_id")
    # A hash under the bound leaves half as many rows again as are kept, and some; those are then ranked.
    share = F.least(F.lit(1.0), (1.5 * max_rows + 100) / F.col("many"))
    near = (labelled.select("doc_id", "lang").join(F.broadcast(many), "lang")
            .where(h.cast("double") <= F.lit(float(1 << 64)) * share - float(1 << 63)).select("doc_id", "lang").distinct())
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = F.broadcast(near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_rows).select("doc_id", "lang"))  # max_rows a language

    def count(batches):
        from collections import Counter

        import pyarrow as pa
        seen = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        for i in range(0, len(rows), 100_000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 100_000]), (pa.string(), pa.string(), pa.int64()))],
                                  ["lang", "word", "n"])

    counts = materialize(docs.join(ids, ["doc_id", "lang"], "left_semi").select("lang", "text")
                         .mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = {r["lang"]: (r["n"], r["words"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    langs = sorted(totals)
    sums = [F.coalesce(F.sum(F.when(F.col("lang") == g, F.col("n"))), F.lit(0)) for g in langs]
    best = (counts.groupBy("word").agg(F.array(*sums).alias("n")).orderBy(F.array_max("n").desc(), "word").limit(max_words).collect()) if langs else []
    size = sum(w for _, w in totals.values()) + 1
    total = np.array([totals[g][0] for g in langs], float) + WORD_SMOOTHING * size
    table = {r["word"]: np.log((np.array(r["n"], float) + WORD_SMOOTHING) / total).tolist() for r in best}
    return langs, table, np.log(WORD_SMOOTHING / total).tolist()


def text_evidence(pages, model):
    """(page_id, host, site, declared, suffix, likelihood per language, known words) of every page."""
    langs, _, _ = model
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most max_words words

    def run(batches):
        import pyarrow as pa
        langs, table, _ = shared.value
        for batch in batches:
            likelihoods, known, declared = [], [], []
            for html in batch.column(4).to_pylist():
                found = [table[w] for w in words_of(visible(html)) if w in table]
                told = declared_in(html)
                declared.append(told if told in langs else None)
                known.append(len(found))
                z = np.sum(found, axis=0) * min(1.0, ENOUGH_WORDS / len(found)) if found else np.zeros(len(langs))
                p = np.exp(z - z.max()) if len(langs) else z
                likelihoods.append((p / p.sum()).tolist() if len(langs) else [])
            yield pa.record_batch([*batch.columns[:4], pa.array(declared, pa.string()), pa.array(likelihoods, pa.list_(pa.float64())),
                                   pa.array(known, pa.int64())], names)

    names = ["page_id", "host", "site", "suffix", "declared", "likelihood", "known_words"]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    top, segment = F.element_at(F.split(host, r"\."), -1), F.lower(F.regexp_extract(path, "^/([^/]*)/?", 1))
    suffix = F.when(segment.isin(langs), segment).when(top.isin(langs), top)
    site = F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)
    return pages.select("page_id", host.alias("host"), site.alias("site"), suffix.alias("suffix"), "html").mapInArrow(
        run, "page_id long, host string, site string, suffix string, declared string, likelihood array<double>, known_words long")


def detect(pages, docs):
    """One row per page: page_id, lang, confidence, text_lang, declared, suffix, host_prior (of the language)."""
    shown = [F.coalesce(c, F.lit("none")).alias(c) for c in ("declared", "suffix")]
    model = fit(docs)
    langs = model[0]
    found = materialize(text_evidence(pages.withColumn("page_id", F.col("page_id").cast("long")), model), "text-evidence")
    if not langs:
        return found.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"), *shown, F.lit(0.0).alias("host_prior"))
    shares = [F.col("likelihood")[i] for i in range(len(langs))]
    silent = F.col("known_words") == 0
    heard = found.where(~silent)

    def counted(*keys):
        """Shares of each language over all pages, by the given keys."""
        sums = F.array(*[F.sum(s) for s in shares])
        return heard.groupBy(*keys).agg(sums.alias("n")) if keys else heard.agg(sums.alias("n"))

    def listed(key):
        """{value: shares}: at most as many values as languages, and the empty one for none."""
        return {r[key] or "": np.array(r["n"], float) for r in counted(key).collect()}

    everywhere = np.nan_to_num(np.array(counted().first()["n"], dtype=float)) + 1.0
    prior = F.array(*[F.lit(float(x)) for x in everywhere / everywhere.sum()])

    def given(key, values):
        """log P(value | language) as a map from value to an array."""
        total = everywhere - 1 + VALUE_SMOOTHING * (len(langs) + 1)
        rows = {v: np.log((values.get(v, np.zeros(len(langs))) + VALUE_SMOOTHING) / total) for v in [*langs, ""]}
        return F.create_map(*[x for v, p in rows.items() for x in (F.lit(v), F.array(*[F.lit(float(q)) for q in p]))])[F.coalesce(key, F.lit(""))]

    def smoothed(own, wider):
        """Counts without the page's own share, drawn towards the wider prior."""
        less = F.zip_with(own, F.col("mine"), lambda n, m: F.greatest(n - m, F.lit(0.0)))
        total = F.aggregate(less, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(less, wider, lambda n, w: (n + PRIOR_STRENGTH * w) / (total + PRIOR_STRENGTH))

    none = F.array(*[F.lit(0.0)] * len(langs))
    page = (found.join(counted("host").withColumnRenamed("n", "host_n"), "host", "left")
            .join(counted("site").withColumnRenamed("n", "site_n"), "site", "left")
            .withColumn("mine", F.when(silent, none).otherwise(F.col("likelihood")))
            .withColumn("placed", F.col("host") != "")
            .withColumn("site_prior", F.when(F.col("placed"), smoothed(F.coalesce("site_n", none), prior)).otherwise(prior))
            .withColumn("prior", F.when(F.col("placed"), smoothed(F.coalesce("host_n", none), F.col("site_prior"))).otherwise(prior))
            .withColumn("markup", given("declared", listed("declared"))).withColumn("address", given("suffix", listed("suffix"))))
    logs = F.array(*[F.log(shares[i] + 1e-12) + F.log(F.col("prior")[i]) + F.col("markup")[i] + F.col("address")[i]
                     for i in range(len(langs))])
    page = page.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    names = F.array(*[F.lit(g) for g in langs])
    at = F.array_position("logs", F.col("top")).cast("int")
    heaviest = F.array_position("likelihood", F.array_max("likelihood")).cast("int")
    weights = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return page.select("page_id", names[at - 1].alias("lang"), (1 / weights).alias("confidence"),
                       F.when(~silent, names[heaviest - 1]).alias("text_lang"), *shown,
                       F.col("prior")[at - 1].alias("host_prior"))
