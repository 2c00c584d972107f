"""Benchmark items in texts, also with other numbers, names or units, by windows of templates.

A text becomes a template: runs of numbers, of names (capitalised words) and of units become one typed placeholder each, other
words are lower-cased without the marks around them. A capital may also start a sentence, so every window is hashed with its
capitalised words read as names and as words, in all combinations; items with names of several words are also compared without
names, for lower-cased copies. Windows of five template words are hashed and joined with the windows
of the benchmark. The windows of one item are gathered by how far they are shifted in the text, and where
both have a placeholder, one value of the item must stand for one value of the text throughout: so a question asked again
with other numbers is found, and chance matches of common templates are not. An item is found if at least COVERAGE of its
windows are.

A text is compared with the items of which it holds one of the rarest windows (see `probes`). A bitmap of fixed size over the benchmark's hashes lets each task drop windows that cannot match; the join decides.

Edge cases: null, empty and wordless texts match nothing, and such items are never found; an item of under five words is
one window of its length; repeated items and rows each count for themselves, rows of one doc_id as one text with all their
matches; empty tables give no rows; other columns are ignored.
"""
import numpy as np
from pyspark.sql import Window, functions as F

from coverlens.llm.batches import small_batches
from coverlens.session import materialize

WINDOW = 5
COVERAGE = 0.8
#: Bits of the bitmap of benchmark hashes: half a megabyte, whatever the benchmark's size.
BITMAP_BITS = 22

#: What counts as a number or a unit besides words with a digit.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs ounce ounces ml l liter liters litre litres "
         "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters "
         "metre metres dollar dollars euro euros cent cents pound pounds mph kmh percent degrees").split()

_MARKS = ".,;:!?\"'()[]{}<>*_-"
_NUMBER, _NAME, _UNIT = 11, 13, 17  # below any hash of a word
PLAIN = 8  # added to the size of windows without names


class _Codes(dict):
    """word -> hash * 16 + 4 if capitalised + 2 if a run of placeholders ends after it + 1 if a sentence does."""

    def __init__(self, limit=400_000):
        super().__init__()
        self.limit = limit
        self.numbers, self.units = set(NUMBER_WORDS), set(UNITS)

    def __missing__(self, word):
        import xxhash
        core = word.strip(_MARKS)
        lower = core.lower()
        if any(c.isdigit() for c in core) or (lower and self.numbers.issuperset(lower.split("-"))):
            code = _NUMBER
        elif lower in self.units:
            code = _UNIT
        else:
            code = (xxhash.xxh64_intdigest(lower) >> 5) + 32
        named = core[:1].isupper() and code > 32
        code = code << 4 | named << 2 | (word[-1] in _MARKS) << 1 | (word[-1] in ".!?:")
        if len(self) < self.limit:
            self[word] = code
        return code


def template(words, codes, names=True, doubts=True, border=None):
    """(starts, first, other, typed, unsure) of a text's slots: the words they start at, their hashes, their other hashes (the
    same where there is none), which are placeholders, and which are names only by the capital that starts a sentence.

    A run of numbers, of units or of capitalised words is one slot. A slot of capitalised words is a name or, the other way,
    starts with an ordinary word. Without names, capitals mean nothing. border: which words begin a text, for several texts."""
    v = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    h = v >> np.uint64(4)
    capital = (v & np.uint64(4)).astype(bool) & names
    kind = np.where(capital, np.uint64(_NAME), h)
    goes_on = (kind[1:] == kind[:-1]) & (kind[1:] < 32) & ~(v[:-1] & np.uint64(2)).astype(bool)
    if border is not None:
        goes_on &= ~border[1:]
    starts = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    long = np.diff(starts, append=len(v)) > 1
    first, word = kind[starts], h[starts]
    named = first == _NAME
    other = np.where(named, np.where(long, word * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(_NAME), word), first)
    unsure = np.zeros(len(starts), bool)
    if not doubts:
        return starts, first, other, first < 32, unsure
    begins = np.concatenate([[True], (v[:-1] & np.uint64(1)).astype(bool)])
    sure = {words[i].strip(_MARKS) for i in np.flatnonzero(capital & ~begins).tolist()}
    for i in np.flatnonzero(named & begins[starts]).tolist():
        unsure[i] = words[starts[i]].strip(_MARKS) not in sure
    return starts, first, other, first < 32, unsure


def window_hashes(h, size, other=None, at=None, use=()):
    """Hashes of the windows of h that start at `at` (all if None); offsets in `use` take the hash of `other`."""
    at = np.arange(max(0, len(h) - size + 1)) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (other if i in use else h)[at + i]
        out ^= out >> np.uint64(29)
    return out


def _readings(first, other, size):
    """(hashes, window starts, offsets read the other way): every window with every choice of readings."""
    n = max(0, len(first) - size + 1)
    yield window_hashes(first, size), np.arange(n), ()
    two = (first != other).astype(np.uint8)
    choices = np.zeros(n, np.uint8)
    for i in range(size):
        choices |= two[i:i + n] << np.uint8(i)
    some = np.flatnonzero(choices)
    choices = choices[some]
    for bits in range(1, 1 << size) if len(some) else ():
        use = [i for i in range(size) if bits >> i & 1]
        at = some[(choices & np.uint8(bits)) == bits]
        if len(at):
            yield window_hashes(first, size, other, at, use), at, use


_SCHEMA = "key long, size int, position int, hash long, slots array<string>, unsure boolean"


def _batch_of(rows):
    import pyarrow as pa
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "size", "position", "hash", "slots", "unsure"])


def _slots(words, starts, ends, typed, i, size, use):
    """The placeholders' words in the window that starts at slot i."""
    out = []
    for k in range(size):
        lo, hi = starts[i + k] + (k in use), ends[i + k]
        if typed[i + k] and lo < hi:
            out.append(" ".join(x.strip(_MARKS).lower() for x in words[lo:hi]))
    return out


def _item_windows(items):
    """(key, size, position, hash, slots, unsure) of the windows of benchmark items. Sizes over PLAIN are of windows in which capitals mean nothing."""
    def run(batches):
        codes = _Codes()

        def add(rows, key, words, named):
            starts, first, other, typed, unsure = template(words, codes, named)
            ends = np.append(starts[1:], len(words))
            size = min(WINDOW, len(starts))
            for w, at, use in _readings(first, other, size):
                for i, x in zip(at.tolist(), w.view(np.int64).tolist()):
                    doubt = any(unsure[i + k] for k in range(size) if k not in use)
                    rows.append((key, size + (0 if named else PLAIN), i, x, _slots(words, starts, ends, typed, i, size, use), doubt))
            return len(starts)

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").split()
                if words:
                    n = add(rows, key, words, True)
                    if n < len(template(words, codes, False)[0]):  # with single names only, their other reading is the plain text
                        add(rows, key, words, False)
            if rows:
                yield _batch_of(rows)

    return items.mapInArrow(run, _SCHEMA)


#: Words of texts that are hashed at once.
PORTION = 1 << 17


def _text_windows(keyed, wanted, bitmap):
    """Likewise of the windows of texts, many texts in one array. wanted: sizes; bitmap: a filter of hashes."""
    plain = [x - PLAIN for x in wanted if x > PLAIN]
    named = [x for x in wanted if x <= PLAIN]

    def run(batches):
        codes, bits = _Codes(), np.frombuffer(bitmap.value, np.uint8)

        def windows(keys, words, border):
            rows = []
            text = np.cumsum(border) - 1
            for names, sizes, mode in ((True, named, 0), (False, plain, PLAIN)):
                if not sizes:
                    continue
                starts, first, other, typed, _ = template(words, codes, names, False, border)
                ends = np.append(starts[1:], len(words))
                of = text[starts]
                begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))[of]  # a text's first slot
                for size in sizes:
                    for w, at, use in _readings(first, other, size):
                        bit = w >> np.uint64(64 - BITMAP_BITS)
                        fits = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        w, at = w[fits], at[fits]
                        fits = of[at] == of[at + size - 1]
                        for i, x in zip(at[fits].tolist(), w[fits].view(np.int64).tolist()):
                            rows.append((keys[of[i]], size + mode, i - int(begin[i]), x, _slots(words, starts, ends, typed, i, size, use), False))
            return rows

        for batch in batches:
            keys, words, first = [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                new = (text.as_py() or "").split()
                if new:
                    keys.append(key.as_py())
                    first.append(len(words))
                    words += new
                if len(words) >= PORTION:
                    border = np.zeros(len(words), bool)
                    border[first] = True
                    rows = windows(keys, words, border)
                    if rows:
                        yield _batch_of(rows)
                    keys, words, first = [], [], []
            if words:
                border = np.zeros(len(words), bool)
                border[first] = True
                rows = windows(keys, words, border)
                if rows:
                    yield _batch_of(rows)

    return keyed.mapInArrow(run, _SCHEMA)


def probes(windows, total, coverage):
    """The windows of each item's rarest positions, one more of these than an item can lack and still be found.

    So a text meets an item only if it holds one of them, and an instruction that many items share brings no text to all of
    them. windows: with `item`, `plain`, `size`, `hash`, `item_position`; a position has a window per reading.
    """
    held = windows.groupBy("size", "hash").agg(F.count_distinct("item").alias("n"))
    positions = (windows.select("item", "plain", "item_position", "size", "hash").distinct().join(held, ["size", "hash"])
                 .groupBy("item", "plain", "item_position").agg(F.sum("n").alias("n")).join(total, ["item", "plain"]))
    order = Window.partitionBy("item", "plain").orderBy("n", "item_position")
    few = (positions.withColumn("nth", F.row_number().over(order))
           .where(F.col("nth") <= F.col("windows") - F.ceil(F.col("windows") * coverage) + 1).select("item", "plain", "item_position"))
    return windows.join(few, ["item", "plain", "item_position"], "left_semi").select("item", "plain", "size", "hash").distinct()


def matches(docs, benchmark, coverage=COVERAGE):
    """(doc_id, item_id, coverage, reparameterised): the items found in each text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = materialize(items, "benchmark-items")
    theirs = materialize(_item_windows(items.select("key", "text")), "benchmark-windows")
    sizes = sorted(r["size"] for r in theirs.select("size").distinct().collect())  # at most WINDOW numbers
    bits = np.zeros(1 << BITMAP_BITS, bool)
    top = F.shiftrightunsigned("hash", 64 - BITMAP_BITS).cast("int")
    bits[theirs.select(top.alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)] = True  # at most 2^BITMAP_BITS numbers
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    ours = _text_windows(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), sizes, bitmap)
    ours = materialize(ours.drop("unsure").withColumnRenamed("key", "doc_id"), "text-windows")
    theirs = theirs.select(F.col("key").alias("item"), "size", F.col("position").alias("item_position"), "hash",
                           F.col("slots").alias("item_slots"), "unsure")
    mode = F.col("size") > PLAIN
    total = theirs.groupBy("item", mode.alias("plain")).agg((F.max("item_position") + 1).alias("windows"))
    theirs = theirs.withColumn("plain", mode)
    pairs = ours.join(probes(theirs, total, coverage), ["size", "hash"]).select("doc_id", "item", "plain").distinct()
    met = pairs.join(theirs, ["item", "plain"]).withColumnRenamed("doc_id", "_doc")
    hits = (met.join(ours.withColumnsRenamed({"size": "_size", "hash": "_hash"}),
                     F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("size") == F.col("_size")) & (F.col("hash") == F.col("_hash")))
            .withColumn("shift", F.col("position") - F.col("item_position")))
    zipped = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    certain = F.when(~F.col("unsure"), F.struct(F.col("item_position").alias("at"), zipped.alias("pairs")))
    every = F.struct(F.col("item_position").alias("at"), zipped.alias("pairs"))
    placed = (hits.groupBy("doc_id", "item", "plain", "shift")
              .agg(F.collect_set(every).alias("every"), F.collect_set(certain).alias("certain")))
    # one value of the item for one value of the text; at most a few readings per word of the item, as the place is fixed
    flat = {k: F.array_distinct(F.flatten(F.transform(k, lambda x: x["pairs"]))) for k in ("every", "certain")}
    placed = placed.select("doc_id", "item", "plain", "every", "certain", *[v.alias(f"{k}_pairs") for k, v in flat.items()])

    def consistent(name):
        return F.size(F.array_distinct(F.transform(name, lambda p: p["a"]))) == F.size(name)
    # words that are names only if a sentence's first word is one are left out where they contradict each other
    best = F.when(consistent("every_pairs"), F.struct(F.col("every").alias("hits"), F.col("every_pairs").alias("pairs"))).when(
        consistent("certain_pairs"), F.struct(F.col("certain").alias("hits"), F.col("certain_pairs").alias("pairs")))
    placed = placed.withColumn("best", best).where("best is not null").select(
        "doc_id", "item", "plain", F.transform("best.hits", lambda x: x["at"]).alias("positions"), F.col("best.pairs").alias("pairs"))
    renamed = F.exists("pairs", lambda p: p["a"] != p["b"])
    found = (placed.groupBy("doc_id", "item", "plain")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).alias("seen"), F.max(renamed).alias("reparameterised"))
             .join(total, ["item", "plain"]).where(F.col("seen") >= coverage * F.col("windows"))
             .groupBy("doc_id", "item").agg(F.max(F.col("seen") / F.col("windows")).alias("coverage"),
                                            F.min("reparameterised").alias("reparameterised")))
    return (found.join(items.select(F.col("key").alias("item"), "item_id"), "item")
            .select("doc_id", "item_id", "coverage", "reparameterised"))


def without_items(docs, benchmark):
    """The rows of docs, with all their columns, in which no item was found."""
    found = matches(docs, benchmark).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_found"]), "left_anti")
