"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their beginnings, hashed to 64 bits and taken once per text. A factorization machine
scores a text by a weight per term and an inner product per pair of terms, so that it learns combinations (an insult with
the mention of a group) that a sum of weights misses.

Training uses a bounded sample of labelled rows: the MAX_ROWS rows outside the held-out fold that come first by a hash of
their key. Their terms are counted by class in a grouped aggregation, the MAX_TERMS terms that tell most about the class
(likelihood ratio) are kept, and only the kept terms of the sampled rows reach the driver, where the machine is fitted.
Scoring is one pass over the whole texts and reads nothing but the text.

Edge cases: null and empty texts score as the machine without any term; several labels of one document count as toxic if
one is; null labels are no labels; without a labelled row of either class every text gets the base rate (0.0 without
labels); repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from coverlens.llm.batches import small_batches
from coverlens.session import materialize

#: Labelled rows, terms and factors of the machine.
MAX_ROWS = 20_000
MAX_TERMS = 4_096
FACTORS = 4
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
EPOCHS = 30

_STRIP = ".,;:!?\"'()[]{}<>|*#$%&"


def fold(doc_id):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def words_of(text):
    return {w.strip(_STRIP) for w in (text or "").lower().split()} - {""}


def terms_of(word):
    """Hashes of a word and of its beginnings."""
    import xxhash
    h = xxhash.xxh64_intdigest
    return {h("w " + word)} | {h(f"{n} {word[:n]}") for n in PREFIXES if len(word) >= n}


#: Texts whose terms are counted at once.
COUNTED = 256


def _term_counts(batches):
    """(term, clean, toxic): texts of each class that hold a term, of a portion of texts at a time."""
    import pyarrow as pa
    for whole in batches:
        for at in range(0, whole.num_rows, COUNTED):
            batch = whole.slice(at, COUNTED)
            index, pairs = {}, []
            for text in batch.column("text").to_pylist():
                pairs.append(np.array([index.setdefault(w, len(index)) for w in words_of(text)], np.int32))
            found = [np.fromiter(terms_of(w), np.uint64) for w in index]
            many = np.array([len(t) for t in found], np.int64)
            terms = np.concatenate(found) if found else np.zeros(0, np.uint64)
            first = np.cumsum(many) - many
            word = np.concatenate(pairs) if pairs else np.zeros(0, np.int32)
            n = many[word]
            row = np.repeat(np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]), n)
            term = terms[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)]
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            term, of = np.unique(term[new], return_inverse=True)
            marked = batch.column("toxic").to_numpy()[row[new]]
            both = [np.bincount(of, marked == c, len(term)).astype(np.int64) for c in (0, 1)]
            yield pa.record_batch([pa.array(term.view(np.int64)), *map(pa.array, both)], ["term", "clean", "toxic"])


def sample(docs, labels, max_rows=MAX_ROWS):
    """At most max_rows labelled texts (text, toxic) outside the held-out fold."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _ratio(clean, toxic, n_clean, n_toxic):
    """Log-likelihood ratio of a term and the class, as columns."""
    def part(observed, row, column):
        o = observed.cast("double")
        return F.when(o > 0, o * F.log(o * F.lit(float(n_clean + n_toxic)) / (row * F.lit(float(column))))).otherwise(0.0)
    seen, unseen = clean + toxic, F.lit(n_clean + n_toxic) - clean - toxic
    return (part(clean, seen, n_clean) + part(toxic, seen, n_toxic)
            + part(F.lit(n_clean) - clean, unseen, n_clean) + part(F.lit(n_toxic) - toxic, unseen, n_toxic))


def fit(docs, labels, max_rows=MAX_ROWS, max_terms=MAX_TERMS):
    """The machine: (kept term -> index, w0, w, v)."""
    small_batches(docs.sparkSession)
    rows = materialize(sample(docs, labels, max_rows), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        rate = 1.0 - 1e-9 if n_toxic else 1e-9
        return {}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, FACTORS))
    best = (rows.mapInArrow(_term_counts, "term long, clean long, toxic long").groupBy("term")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
            .where(F.col("clean") + F.col("toxic") >= 3)
            .select("term", _ratio(F.col("clean"), F.col("toxic"), n_clean, n_toxic).alias("ratio"))
            .orderBy(F.col("ratio").desc(), "term").limit(max_terms).collect())
    index = {r["term"] & (1 << 64) - 1: i for i, r in enumerate(best)}

    def active(batches):
        import pyarrow as pa
        find = _finder(index)
        for batch in batches:
            yield pa.record_batch([pa.array([find(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())),
                                   batch.column(1)], ["terms", "toxic"])

    examples = rows.mapInArrow(active, "terms array<int>, toxic int").toPandas()  # at most max_rows rows of max_terms
    order = sorted(range(len(examples)), key=lambda i: (examples.toxic[i], tuple(examples.terms[i])))
    return index, *_train([examples.terms[i] for i in order], examples.toxic.to_numpy(float)[order], len(index))


def _finder(index, remembered=100_000):
    """text -> sorted indices of the kept terms in it."""
    known = {}

    def find(text):
        found = set()
        for w in words_of(text):
            at = known.get(w)
            if at is None:
                if len(known) > remembered:
                    known.clear()
                at = known[w] = tuple(index[t] for t in terms_of(w) if t in index)
            if at:
                found.update(at)
        return sorted(found)

    return find


def _train(terms, toxic, size, seed=7, epochs=EPOCHS, rate=0.1, decay=1e-3, batch=256):
    """Mini-batches with a step size per parameter that falls with its past gradients; logistic loss."""
    rng = np.random.default_rng(seed)
    lengths = np.array([len(t) for t in terms])
    flat = np.concatenate([np.asarray(t, np.int64) for t in terms]) if lengths.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    rate_of = toxic.mean()
    w0, w, v = float(np.log(rate_of / (1 - rate_of))), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(terms))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            n = lengths[rows]
            row = np.repeat(np.arange(len(rows)), n)
            at = flat[np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])] if n.sum() else flat[:0]
            total = np.stack([np.bincount(row, v[at, f], len(rows)) for f in range(FACTORS)], 1)
            square = np.bincount(row, (v[at] ** 2).sum(1), len(rows))
            z = w0 + np.bincount(row, w[at], len(rows)) + 0.5 * ((total ** 2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[rows]) / len(rows)
            e = error.sum()
            g0 += e * e
            w0 -= rate * e / np.sqrt(g0)
            grad_w = np.bincount(at, error[row], size)
            hit = np.flatnonzero(np.bincount(at, minlength=size))
            grad_v = np.stack([np.bincount(at, error[row] * (total[row, f] - v[at, f]), size) for f in range(FACTORS)], 1)
            for p, g, grad in ((w, gw, grad_w), (v, gv, grad_v)):
                d = grad[hit] + decay * p[hit] / len(rows)
                g[hit] += d * d
                p[hit] -= rate * d / np.sqrt(g[hit])
    return w0, w, v


def score_of(found, w0, w, v):
    z = w0
    if len(found):
        z += w[found].sum()
        total = v[found].sum(0)
        z += 0.5 * float((total ** 2).sum() - (v[found] ** 2).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs, model):
    """(doc_id, score) of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms

    def run(batches):
        import pyarrow as pa
        index, w0, w, v = shared.value
        find = _finder(index)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([score_of(find(t.as_py()), w0, w, v) for t in batch.column(1)])],
                                  ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def judge(docs, labels):
    """One row per document: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs, labels):
    """The rows whose score stays under the threshold, with all columns of docs; scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def clean(text):
        index, w0, w, v = shared.value
        find = _finder(index)
        for part in text:
            yield pd.Series([score_of(find(t), w0, w, v) < THRESHOLD for t in part], dtype=bool)

    clean.__annotations__ = {"text": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(clean, "boolean")("text"))
