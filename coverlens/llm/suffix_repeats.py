"""Repeated byte strings over all documents, found with suffix arrays of shards, and documents without them.

A byte goes if a string of LEAST bytes that covers it starts anywhere else too, in another document or the same one.

Arrays over shards of whole documents could only be merged by sending every suffix to where its neighbours are, many times
the input. So shards are made of passages: every string of LEAST bytes selects its smallest hash of ANCHOR bytes as its
anchor (about one byte in 85 becomes one), and a passage is what the strings that select one anchor cover. Equal strings have
equal anchors at equal places, so all copies of a string lie in passages of one anchor, and only these have to meet:

* an anchor that occurs once is no copy; where all passages of an anchor are equal, all their strings are copies;
* the different passages of an anchor, each once, go to one shard. A shard sorts its suffixes by Larsson-Sadakane refinement
  (groups of equal rank are split by the ranks of the suffixes that start where the group's common prefix ends, which multiplies it),
  takes common prefixes by Kasai's rule (of a suffix at least one byte less than of the suffix before it in the text), and
  reads runs of common prefixes of LEAST bytes as copies;
* an anchor with many passages fills several shards. Each writes the fingerprints of its strings as sorted runs, cut by
  fingerprint into parts, and the runs of a part are merged by binary search of each in what has been merged before.

Nothing but anchors, passages that differ, and once the texts is shuffled; frequent anchors are counted before the shuffle and split as above.

Edge cases: null texts count as empty; texts shorter than LEAST and empty ones stay whole, with the digest of their bytes;
rows of one doc_id, or without one, and repeated rows are documents of their own, so that equal texts of LEAST bytes and more
go whole; texts of one repeated byte make few different passages; long texts are read in pieces that overlap; a string never
spans two documents; an empty table gives no rows; other columns are ignored.
"""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from coverlens.llm.batches import small_batches
from coverlens.session import materialize

LEAST, ANCHOR = 200, 32
#: Strings of a text hashed at once, bytes of a shard, passages of one anchor in one shard, strings merged at once.
PIECE, SHARD, SLICE, PART = 1 << 17, 1 << 20, 2_048, 1 << 19
MASKS = ["m0", "m1", "m2"]
_MASK = np.uint64((1 << 20) - 1)


def _random(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64)


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Polynomial hashes of substrings modulo 2^64, of random values per byte."""

    def __init__(self, seed, size=PIECE + 4 * LEAST):
        self.value = _random(256, seed)
        base = int(_random(1, seed + 1)[0]) | 1
        self.up, self.down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)

    def sums(self, data):
        if len(data) >= len(self.up):
            raise ValueError("piece too long")
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:len(data)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, sums, start, end):
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


_HASHES = {}


def hashes(seed=11, size=PIECE + 4 * LEAST):
    if (seed, size) not in _HASHES:
        _HASHES[seed, size] = Hashes(seed, size)
    return _HASHES[seed, size]


def smallest_in(values, width):
    """Minima of all windows of `width` values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def spots(data, ends):
    """(text, position, anchor, passage, left, right) of every anchor of concatenated texts; anchor and passage are hashes.

    data: their bytes; ends: where each ends; position: within its text; left, right: where in data its passage is.
    """
    h = hashes()
    reach = LEAST - ANCHOR
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found = []
    strings = len(data) - LEAST + 1
    for first in range(0, len(data), PIECE):  # anchors at first to first + PIECE, with all strings that may select them
        low, high = max(0, first - reach), min(strings, first + PIECE)
        if high <= low:
            break
        start, last = low, min(len(data), high + LEAST)
        sums = h.sums(data[start:last])
        n = high - low
        coded = mixed((sums[ANCHOR:n + reach + ANCHOR] - sums[:n + reach]) * h.down[:n + reach])
        coded &= ~_MASK
        coded |= np.arange(n + reach, dtype=np.uint64)
        chosen = (smallest_in(coded, reach + 1) & _MASK).astype(np.int64)
        texts = slice(*np.searchsorted(ends, [low, high], "right") + np.array([0, 1]))
        inside = np.zeros(n + 1, np.int8)  # strings that one text holds
        a, z = starts[texts] - low, ends[texts] - LEAST + 1 - low
        some = (z > a) & (z > 0) & (a < n)
        np.add.at(inside, np.maximum(a[some], 0), 1)
        np.add.at(inside, np.minimum(z[some], n), -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        chosen = chosen[at]
        if not len(at):
            continue
        begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        left, right = at[begin], at[np.append(begin[1:], len(at)) - 1] + LEAST
        chosen = chosen[begin]
        own = (chosen + low >= first) & (chosen + low < first + PIECE)
        left, right, chosen = left[own], right[own], chosen[own]
        text = np.searchsorted(ends, chosen + low, "right")
        passage = h.of(sums, left, right) + mixed((chosen - left).astype(np.uint64) << np.uint64(16) | (right - chosen).astype(np.uint64))
        found.append((text, chosen + low - starts[text], h.of(sums, chosen, chosen + ANCHOR), mixed(passage), left + low, right + low))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def kinds(spotted):
    """(first, of, times): the first of a text's spots with the same anchor and passage, the kind of every spot, spots per kind."""
    text, anchor, passage = spotted[0], spotted[2], spotted[3]
    key = mixed(anchor) + passage
    order = np.lexsort((key, text))  # stable, so that the first of a kind is its first position
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])])[:len(order)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of, np.bincount(of) if len(of) else of


def joined(texts):
    """(bytes, ends) of texts one after another."""
    data = [_bytes(t) for t in texts]
    return (np.concatenate(data) if data else np.zeros(0, np.uint8)), np.cumsum([len(x) for x in data], dtype=np.int64)


def portions(batch, column, most=1 << 22):
    """The rows of a batch in portions of about `most` bytes of text."""
    size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], np.int64)
    cut = np.cumsum(size) // most
    at = [0, *(np.flatnonzero(cut[1:] != cut[:-1]) + 1).tolist(), batch.num_rows]
    return [batch.slice(i, j - i) for i, j in zip(at, at[1:]) if j > i]


def _bytes(text):
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _spotted(docs):
    """(d, h, position, anchor, passage, times) of the kinds of spots of every document."""
    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in portions(whole, 2):
                spotted = spots(*joined(batch.column(2).to_pylist()))
                first, _, times = kinds(spotted)
                text, position, anchor, passage = (c[first] for c in spotted[:4])
                d, h = (batch.column(i).to_numpy()[text] for i in (0, 1))
                yield pa.record_batch([pa.array(d), pa.array(h), pa.array(position.astype(np.int32)), pa.array(anchor.view(np.int64)),
                                       pa.array(passage.view(np.int64)), pa.array(times.astype(np.int32))],
                                      ["d", "h", "position", "anchor", "passage", "times"])

    return docs.select("d", "h", "text").mapInArrow(run, "d long, h long, position int, anchor long, passage long, times int")


def _pointed(spotted, first, text, position):
    """The kinds of the spots that have these first positions in these texts."""
    code = spotted[0][first] << 32 | spotted[1][first]
    order = np.argsort(code)
    return order[np.searchsorted(code[order], text << 32 | position)]


def cleaned(data, ends, settled, masked):
    """(n_bytes, n_removed, n_spans, kept_sha256) of texts.

    settled: (text, first position) of kinds of spots of which all strings are copies; masked: (text, first position, masks) of others, where bit i is the
    string i bytes before the anchor.
    """
    step = np.zeros(len(data) + 1, np.int64)
    if len(settled[0]) or len(masked[0]):
        spotted = spots(data, ends)
        first, of, _ = kinds(spotted)
        _, _, _, _, left, right = spotted
        whole = np.zeros(len(first), bool)
        whole[_pointed(spotted, first, *settled)] = True
        hit = whole[of]
        step += np.bincount(left[hit], minlength=len(step)) - np.bincount(right[hit], minlength=len(step))
        masks = np.zeros((len(first), 3), "<i8")
        masks[_pointed(spotted, first, *masked[:2])] = masked[2]
        some = np.flatnonzero((masks[of] != 0).any(axis=1))
        at = spotted[1][some] + np.concatenate([[0], ends[:-1]])[spotted[0][some]]
        for i in range(0, len(some), 1 << 14):
            row, back = np.nonzero(np.unpackbits(masks[of[some[i:i + (1 << 14)]]].view(np.uint8), axis=1, bitorder="little"))
            begin = at[i:i + (1 << 14)][row] - back
            step += np.bincount(begin, minlength=len(step)) - np.bincount(begin + LEAST, minlength=len(step))
    gone = np.cumsum(step[:-1]) > 0
    kept = data[~gone]
    new = gone.copy()
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    inner = starts[(starts > 0) & (starts < len(data))]
    new[1:] = gone[1:] & ~gone[:-1]
    new[inner] = gone[inner]
    total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, new))
    removed = total[ends] - total[starts]
    to = ends - total[ends]
    digests = [hashlib.sha256(kept[i:j].data).hexdigest() for i, j in zip((starts - total[starts]).tolist(), to.tolist())]
    return ends - starts, removed, spans[ends] - spans[starts], digests


def suffix_array(data, ends):
    """(order, rank) of all suffixes of concatenated passages; a suffix ends with its passage, equal ones go by passage.

    ends: where each passage ends.
    """
    size, count = len(data), len(ends)
    owner = np.repeat(np.arange(count), np.diff(ends, prepend=0))
    rest = ends[owner] - np.arange(size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for i in range(7):
        key = key << np.uint64(8) | np.where(rest > i, padded[i:i + size], np.uint64(0))
    key = key << np.uint64(8) | np.minimum(rest, 7).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(size, np.int64)

    def ranked(at, sorted_keys, base):
        """Gives equal keys the rank of the first of them; returns which are still with others."""
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[at] = base[begin][group]
        return np.diff(np.append(begin, len(at)))[group] > 1

    several = ranked(order, key[order], np.arange(size))
    places, depth = np.flatnonzero(several), 7
    bits = (size + count).bit_length()
    while len(places):
        at = order[places]
        code = rank[at]
        for i in range(1, 63 // bits):  # as many ranks as fit one number
            ahead = at + i * depth
            code = code << bits | np.where(i * depth < rest[at], rank[np.minimum(ahead, size - 1)] + count, owner[at])
        o = np.argsort(code)
        at, code = at[o], code[o]
        order[places] = at
        several = ranked(at, code, places)
        places, depth = places[several], depth * (63 // bits)
    return order, rank


def common_prefixes(data, ends, order, rank, most=LEAST, steps=None):
    """Common prefix of each suffix in order with the one before it, up to `most`, by Kasai's rule along all passages at once.

    steps: of each passage, how many suffixes are asked for; all if None. Others get 0.
    """
    size = len(data)
    starts = np.concatenate([[0], ends[:-1]])
    stop = np.repeat(ends, ends - starts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(size + 1, np.uint64)
    for i in range(8):
        word[:size] = word[:size] << np.uint64(8) | padded[i:i + size]
    limits = np.array([1 << 8 * b for b in range(8)], np.uint64)
    out = np.zeros(size, np.int32)
    held = np.zeros(len(ends), np.int64)
    steps = ends - starts if steps is None else steps
    for step in range(int(steps.max(initial=0))):
        lane = np.flatnonzero(step < steps)
        i = starts[lane] + step
        j = order[np.maximum(rank[i] - 1, 0)]
        limit = np.where(rank[i] > 0, np.minimum(np.minimum(stop[i] - i, stop[j] - j), most), 0)
        h = np.minimum(np.maximum(held[lane] - 1, 0), limit)
        on = np.flatnonzero(h < limit)
        while len(on):
            differ = word[i[on] + h[on]] ^ word[j[on] + h[on]]
            same = 8 - np.searchsorted(limits, differ, "right")
            h[on] = np.minimum(h[on] + same, limit[on])
            on = on[(same == 8) & (h[on] < limit[on])]
        held[lane] = h
        out[rank[i]] = h
    return out


def copies(passages, before, groups):
    """(passage, back, class, several) of all strings around the anchors of the passages of a shard.

    passages: arrays of bytes; before: bytes before the anchor of each; groups: its anchor. Strings are copies if they are equal, of one anchor
    and equally far before it, that is at another place; several says whether a string has copies here, class is the same for copies.
    """
    data, ends = np.concatenate(passages), np.cumsum([len(p) for p in passages])
    starts = np.concatenate([[0], ends[:-1]])
    first, many = starts, ends - starts - LEAST + 1
    order, rank = suffix_array(data, ends)
    run = np.cumsum(common_prefixes(data, ends, order, rank, steps=many) < LEAST)[rank]
    owner = np.repeat(np.arange(len(ends)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    back = starts[owner] + before[owner] - at
    o = np.lexsort((back, groups[owner], run[at]))
    owner, at, back = owner[o], at[o], back[o]
    key = (run[at], groups[owner], back)
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]) if len(at) else np.zeros(0, bool)
    kind = np.cumsum(new) - 1
    return owner, at, back, kind, np.bincount(kind)[kind] > 1 if len(at) else new


def _as_masks(count, owner, back):
    bits = np.zeros((count, 192), np.uint8)
    bits[owner, back] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _shards(parts):
    """Of (anchor, parts, passage, before, bytes, times), sorted by anchor and slice: masks, and runs of split anchors.

    Rows out: (anchor, passage, m0, m1, m2, part, run); run only for split anchors, then without a passage.
    """
    import pyarrow as pa
    names = ["anchor", "passage", *MASKS, "part", "run"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]

    def solve(rows):
        data = [np.frombuffer(r[5], np.uint8) for r in rows]
        before = np.array([r[4] for r in rows], np.int64)
        groups = np.array([r[0] for r in rows], np.int64)
        often = np.array([r[6] > 1 for r in rows])
        owner, at, back, kind, several = copies(data, before, groups)
        hit = several | often[owner]
        masks = _as_masks(len(rows), owner[hit], back[hit])
        out = [(r[0], r[3], *m, None, None) for r, m in zip(rows, masks.tolist()) if any(m)]
        if rows[0][1] > 1:  # a split anchor has its shards for itself
            once = np.concatenate([[True], kind[1:] != kind[:-1]])
            whole = np.concatenate(data)
            prints = [hashes(seed, SHARD * 2).of(hashes(seed, SHARD * 2).sums(whole), at[once], at[once] + LEAST) for seed in (21, 31)]
            run = np.zeros(len(prints[0]), [("f", "<u8"), ("g", "<u8"), ("passage", "<i8"), ("back", "<i8")])
            run["f"], run["g"] = prints[0] ^ mixed(back[once].astype(np.uint64)), prints[1]
            run["passage"], run["back"] = np.array([r[3] for r in rows])[owner[once]], back[once]
            run = run[np.lexsort((run["g"], run["f"]))]
            part = (run["f"] % np.uint64(rows[0][1])).astype(np.int32)
            out += [(rows[0][0], None, None, None, None, int(p), run[part == p].tobytes()) for p in np.unique(part)]
        return out

    def batch_of(out):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows, size, last = [], 0, None
    for batch in parts:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = row[0], row[2]
            # Passages of one anchor and slice stay together; split anchors are not mixed with others.
            if rows and key != last and (size >= SHARD // 2 or row[1] > 1 or rows[0][1] > 1):
                out += solve(rows)
                rows, size = [], 0
            rows.append(row)
            size, last = size + len(row[5]), key
        if out:
            yield batch_of(out)
    out = solve(rows) if rows else []
    if out:
        yield batch_of(out)


def merge_runs(runs):
    """Of sorted runs of one part, the strings that several runs hold, as an array of all such entries."""
    merged, hits = runs[0], []
    for run in runs[1:]:
        at = np.searchsorted(merged["f"], run["f"])
        near = np.minimum(at, len(merged) - 1)
        met = (merged["f"][near] == run["f"]) & (merged["g"][near] == run["g"])
        hits += [run[met], merged[near[met]]]
        merged = np.insert(merged, at[~met], run[~met])
    return np.concatenate(hits) if hits else runs[0][:0]


_RUN = [("f", "<u8"), ("g", "<u8"), ("passage", "<i8"), ("back", "<i8")]


def _merged(batches):
    """Masks of split anchors from (anchor, part, run), sorted by anchor and part."""
    import pyarrow as pa
    names = ["anchor", "passage", *MASKS]

    def solve(key, runs):
        hits = merge_runs([np.frombuffer(r, _RUN) for r in runs])
        of, owner = np.unique(hits["passage"], return_inverse=True)
        masks = _as_masks(len(of), owner.ravel(), hits["back"])
        return [(key[0], p, *m) for p, m in zip(of.tolist(), masks.tolist())]

    key, runs = None, []
    for batch in batches:
        out = []
        for anchor, part, run in zip(*(c.to_pylist() for c in batch.columns)):
            if (anchor, part) != key:
                out += solve(key, runs) if runs else []
                key, runs = (anchor, part), []
            runs.append(run)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names)
    out = solve(key, runs) if runs else []
    if out:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names)


def _passages(texts):
    """(anchor, parts, slice, passage, before, bytes, times) of the passages that (text, chosen) are to give."""
    schema = "anchor long, parts int, slice int, passage long, before int, bytes binary, times long"

    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in portions(whole, 0):
                data, ends = joined(batch.column(0).to_pylist())
                spotted = spots(data, ends)
                first, _, _ = kinds(spotted)
                text, chosen = _flat(batch.column(1))
                at = first[_pointed(spotted, first, text, chosen["position"])]
                left, right = spotted[4][at], spotted[5][at]
                size = right - left
                to = np.concatenate([[0], np.cumsum(size)])
                held = data[np.arange(to[-1]) + np.repeat(left - to[:-1], size)]
                before = spotted[1][at] + np.concatenate([[0], ends[:-1]])[spotted[0][at]] - left
                yield pa.record_batch([
                    pa.array(spotted[2][at].view(np.int64)), pa.array(chosen["parts"].astype(np.int32)), pa.array(chosen["slice"].astype(np.int32)),
                    pa.array(spotted[3][at].view(np.int64)), pa.array(before.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(held)]),
                    pa.array(chosen["times"])], ["anchor", "parts", "slice", "passage", "before", "bytes", "times"])

    return texts.select("text", "chosen").mapInArrow(run, schema)


def _flat(lists):
    """(row, columns) of an Arrow column of lists of numbers or of records of numbers; null lists are empty."""
    size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), size)
    if not hasattr(flat.type, "num_fields") or not flat.type.num_fields:
        return row, flat.to_numpy(zero_copy_only=False).astype(np.int64)
    return row, {flat.type.field(i).name: c.to_numpy(zero_copy_only=False).astype(np.int64) for i, c in enumerate(flat.flatten())}


def _masks(passages):
    """(anchor, passage, m0, m1, m2): which strings of the different passages of an anchor are copies."""
    solved = materialize(passages.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", "passage")
                         .mapInArrow(_shards, "anchor long, passage long, m0 long, m1 long, m2 long, part int, run binary"), "repeat-shards")
    runs = solved.where("run is not null").select("anchor", "part", "run")
    crossed = runs.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_merged, "anchor long, passage long, m0 long, m1 long, m2 long")
    every = solved.where("run is null").select("anchor", "passage", *MASKS).unionByName(crossed)
    return every.groupBy("anchor", "passage").agg(*[F.bit_or(m).alias(m) for m in MASKS])


def _results(rows, schema):
    """Results of (doc_id, text, settled, masks)."""
    def run(batches):
        import pyarrow as pa
        for whole in batches:
            for batch in portions(whole, 1):
                data, ends = joined(batch.column(1).to_pylist())
                text, masks = _flat(batch.column(3))
                masked = text, masks["position"], np.stack([masks[m] for m in MASKS], 1)
                out = cleaned(data, ends, _flat(batch.column(2)), masked)
                yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
                                      ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "settled", "masks").mapInArrow(run, schema)


def remove_repeats(documents):
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(documents.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("h"), "text")
    spotted = _spotted(docs)
    shared = (spotted.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("passage").alias("low"), F.max("passage").alias("high"))
              .where(F.col("n") > 1).select("anchor", (F.col("low") == F.col("high")).alias("settled")))
    hits = materialize(spotted.join(shared, "anchor"), "repeat-hits")
    spot = F.struct("d", "h", "position")
    once = materialize(hits.where("not settled").groupBy("anchor", "passage").agg(F.min(spot).alias("spot"), F.sum("times").alias("times")), "repeat-passages")
    hot = (once.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
           .select("anchor", F.ceil(F.col("n") * 2 / SLICE).cast("int").alias("slices"),
                   F.greatest(F.lit(2), F.ceil(F.col("n") * (LEAST - ANCHOR + 1) / PART)).cast("int").alias("parts")))
    cut = F.pmod("passage", F.coalesce("slices", F.lit(1))).cast("int")
    chosen = (once.join(hot, "anchor", "left")
              .groupBy("spot.d", "spot.h").agg(F.collect_list(F.struct(F.col("spot.position").alias("position"), F.coalesce("parts", F.lit(1)).alias("parts"),
                                                                       cut.alias("slice"), "times")).alias("chosen")))
    lists = hits.groupBy("d", "h").agg(F.collect_set(F.when(F.col("settled"), F.col("position"))).alias("settled"),  # bounded by the text itself
                                       F.max(~F.col("settled")).alias("open"))
    none = F.lit(None).cast("array<struct<position:int,m0:bigint,m1:bigint,m2:bigint>>")
    read = materialize(docs.join(lists.join(chosen, ["d", "h"], "left"), ["d", "h"], "left").withColumn("waits", F.coalesce("open", F.lit(False))).drop("open"),
                       "repeat-texts", by=["waits"])
    done = _results(read.where("not waits").withColumn("masks", none), schema)
    waiting = read.where("waits")
    masks = _masks(_passages(waiting.where("chosen is not null")))
    found = (hits.where("not settled").select("d", "h", "position", "anchor", "passage").join(masks, ["anchor", "passage"])
             .groupBy("d", "h").agg(F.collect_set(F.struct("position", *MASKS)).alias("masks")))
    return done.unionByName(_results(waiting.join(found, ["d", "h"], "left"), schema))
