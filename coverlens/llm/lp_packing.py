"""Packing of token pieces into sequences by a configuration linear program over the length histogram.

A configuration says how many pieces of each length one sequence holds. The program (as few sequences as possible, every
length's demand covered) has one variable per configuration, so it is never written out: multiplicative weights keep a
price per length, a knapsack table over the capacity finds the configuration of the highest price, and the configurations
found, scaled to the demand, are its solution. It is rounded down; what the rounding leaves is filled sequence by sequence
with the largest lengths that fit, ending on exact fits where one or two lengths give them.

Only the histogram (at most `capacity` numbers) reaches the driver. A piece finds its place by its rank among the pieces of
its length: ranks come from counts per (writing task, length), and no task sees more than its own pieces.

Edge cases: a null or empty text is the end id alone (one piece of length 1); repeated doc_ids are packed as rows of their
own; an empty table gives no rows; other columns are ignored.
"""
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from coverlens.llm.tokens import crc32_of, encoder, ids_of, tokenizer_path
from coverlens.session import materialize

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights, and how strongly a covered length loses weight.
ROUNDS = 300
RATE = 0.5

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                       T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()),
                       T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType())])


def cut(n, capacity):
    """(start, length) of the pieces of n ids: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(docs, path=None, capacity=CAPACITY, end_id=END_ID):
    """Encodes every text and cuts it; `nth` counts the pieces of one length within one task."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

        def packed(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], PIECES.names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py()) + end
                for k, (start, n) in enumerate(cut(len(data) // encode.width, capacity)):
                    ids = data[start * encode.width:(start + n) * encode.width]
                    rows.append((doc_id, k, start, n, crc32_of(ids_of(ids, encode.width)), task, int(seen[n]), ids))
                    seen[n] += 1
                if len(rows) >= 5000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_configuration(value, capacity):
    """Counts per length of the fill with the highest value (value[l] >= 0 per piece of length l), by a knapsack table."""
    lengths = np.flatnonzero(value > 0)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    price = value[lengths]
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, "right")
        best[c], last[c] = best[c - 1], 0
        if k:
            got = best[c - lengths[:k]] + price[:k]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], last[c] = got[i], lengths[i]
    counts, c = {}, capacity
    while c > 0:
        if last[c]:
            counts[int(last[c])] = counts.get(int(last[c]), 0) + 1
        c -= int(last[c]) or 1
    return counts


def fractional(demand, capacity, rounds=ROUNDS, rate=RATE):
    """{configuration: amount} that covers the demand on average, by multiplicative weights."""
    weight = np.where(demand > 0, demand * np.arange(capacity + 1.0), 0.0)
    covered, amounts = np.zeros(capacity + 1), {}
    for _ in range(rounds if weight.any() else 0):
        config = best_configuration(np.divide(weight, demand, out=np.zeros(capacity + 1), where=demand > 0), capacity)
        lengths, counts = np.array(list(config)), np.array(list(config.values()))
        step = float((demand[lengths] / counts).min())
        amounts[tuple(sorted(config.items()))] = amounts.get(tuple(sorted(config.items())), 0.0) + step
        covered[lengths] += counts * step
        weight[lengths] *= np.exp(-rate * counts * step / demand[lengths])
    tokens = np.arange(capacity + 1) * demand
    share = (covered * np.arange(capacity + 1)).sum() / max(tokens.sum(), 1)
    return {c: a / max(share, 1.0) for c, a in amounts.items()}


def solve(demand, capacity):
    """[(configuration, sequences)] that use up the demand (pieces per length) exactly."""
    left = np.asarray(demand, np.int64).copy()
    plan = []

    def use(config, most):
        n = int(min([most, *(left[l] // k for l, k in config)]))
        if n > 0:
            plan.append((config, n))
            for l, k in config:
                left[l] -= n * k

    if left[capacity]:
        use(((capacity, 1),), left[capacity])
    rest = fractional(left.astype(float), capacity)
    for config, amount in sorted(rest.items(), key=lambda x: (-x[1], x[0])):
        use(config, int(amount))
    while left.any():
        config, room = {}, capacity
        free = left.copy()
        while room and free[1:room + 1].any():
            take = [room] if free[room] else _pair(free, room) or [int(np.flatnonzero(free[:room + 1])[-1])]
            for l in take:
                config[l] = config.get(l, 0) + 1
                free[l] -= 1
                room -= l
        use(tuple(sorted(config.items())), left.sum())
    return plan


def _pair(free, room):
    """Two lengths that fill the room exactly, the longer as long as possible; none if there are none."""
    low = np.arange(1, room // 2 + 1)
    fits = (free[low] > 0) & (free[room - low] > 0)
    if room % 2 == 0 and len(low):
        fits[-1] = free[room // 2] > 1
    i = np.flatnonzero(fits)
    return [room - int(low[i[0]]), int(low[i[0]])] if len(i) else []


def slots(plan, capacity):
    """Per length: first ranks, first sequence, pieces per sequence and first offset of each configuration that has it."""
    by_length, sequence = {}, 0
    for config, n in plan:
        offset = 0
        for length, k in sorted(config, reverse=True):
            rows = by_length.setdefault(length, [])
            rank = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append((rank, sequence, k, offset, n * k))
            offset += length * k
        sequence += n
    return {l: np.array([r[:4] for r in rows], np.int64).T for l, rows in by_length.items()}


def pack(found, capacity=CAPACITY):
    """found: stored pieces. Adds sequence_id and offset to each."""
    spark = found.sparkSession
    per_task = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # at most `capacity` rows
        demand[row["length"]] = row["count"]
    places = spark.sparkContext.broadcast(slots(solve(demand, capacity), capacity))
    running = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = per_task.select("task", "length", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("first"))
    ranked = (found.join(first, ["task", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")))

    def place(batches):
        import pyarrow as pa
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                first_rank, first_sequence, k, first_offset = places.value[int(l)]
                i = np.searchsorted(first_rank, rank[at], "right") - 1
                q = rank[at] - first_rank[i]
                sequence[at] = first_sequence[i] + q // k[i]
                offset[at] = first_offset[i] + q % k[i] * l
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(found, packed):
    """The packed sequences themselves: their ids, one row each; a sequence has at most `capacity` ids."""
    whole = packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").join(
        found.select("doc_id", "piece", "start", "length", "ids_crc32", "ids")
        .dropDuplicates(["doc_id", "piece", "start", "length", "ids_crc32"]), ["doc_id", "piece", "start", "length", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return whole.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs, path=None, capacity=CAPACITY, end_id=END_ID):
    """One row per piece with its place; the pieces are written once, so that all passes see the same ranks."""
    return pack(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)
