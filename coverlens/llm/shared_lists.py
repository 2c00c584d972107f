"""Hard negatives from lists that a cluster of anchors shares.

Anchors are the vectors whose id is divisible by ANCHOR_EVERY. They are clustered by direction, and every block of candidates
sorts its rows once per cluster by an upper bound of their score with any member: by Cauchy and the triangle inequality for
angles, a member u of a cluster with centre c and radius r scores at most |u| |x| cos(max(0, angle(x, c) - r)) with a row x.
Every member then walks that one list and stops where the bound falls below the score it still needs. What it has not seen
then cannot be among its results, so results are exact. Positives are found by one walk; their scores set what a second walk
looks for among the rows of other labels.

Blocks hold a bounded number of rows; every anchor visits every block once per walk, streamed, and leaves at most its best
few rows there. At most MAX_CENTRES centres are shared with all tasks.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component take no part; components are
floor(256 x), held within +-2^27 so that a score of up to 64 of them fits a long; vectors of different lengths do not meet, an empty vector meets
empty ones with score 0; repeated rows of one id are rows of their own (each is an anchor, and the other a positive with the
same id); ties go to the smaller id; a positive without a negative in its range gives no row; an empty table gives no rows;
other columns are ignored.
"""
import numpy as np
from pyspark.sql import Window, functions as F

from coverlens.session import materialize

ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
LIMIT = 1 << 27
#: Rows of a small and of a large block, members that share a list, rows of a list walked at once, centres.
SMALL_BLOCK, BLOCK, MANY_BLOCKS = 8_192, 262_144, 256
MEMBERS, STEP, MAX_CENTRES = 256, 1_024, 1_024
_ROW = "block int, kind int, cluster int, dim int, row long, id long, label int, v binary, wanted binary"


def usable(vectors):
    """(row, id, label, v): rows that take part, with the labels and whole components that count."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), x.alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad))
    label = F.when(F.col("id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    whole = F.transform("v", lambda c: F.greatest(F.least(F.floor(c * 256.0), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", label.cast("int").alias("label"), whole.alias("v"))


def _directions(x):
    x = x.astype(float)
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None], size


def _packed(rows, centres):
    """Vectors as bytes, with the nearest of the centres of their length."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CENTRES vectors

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            vectors = [np.asarray(v, np.int64) for v in batch.column("v").to_pylist()]
            cluster = []
            for v in vectors:
                near = shared.value.get(len(v))
                cluster.append(0 if near is None or not len(v) else int(np.argmax(near @ v)))
            yield pa.record_batch([batch.column("row"), batch.column("id"), batch.column("label"), pa.array(cluster, pa.int32()),
                                   pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in vectors])],
                                  ["row", "id", "label", "cluster", "dim", "v"])

    return rows.mapInArrow(run, "row long, id long, label int, cluster int, dim int, v binary")


def _centres(anchors, n):
    """Directions of a fixed sample of anchors by vector length, about one per 64 anchors and at most MAX_CENTRES."""
    some = anchors.orderBy(F.xxhash64("row"), "row").limit(int(min(MAX_CENTRES, -(-n // 64)))).select("v").collect() if n else []
    found = {}
    for r in some:
        found.setdefault(len(r["v"]), []).append(r["v"])
    return {dim: _directions(np.array(v).reshape(len(v), dim))[0] for dim, v in found.items()}


def products(a, b):
    """Exact whole inner products of the rows of a and b."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def shared_list(rows, directions, sizes, members):
    """(order, bounds): the rows of a block by their bound for a cluster, largest first; a bound is per unit of a member's length."""
    own, _ = _directions(members)
    centre, _ = _directions(own.mean(axis=0, keepdims=True))
    radius = np.arccos(np.clip(own @ centre[0], -1, 1)).max() + 1e-7
    away = np.arccos(np.clip(directions @ centre[0], -1, 1)) - radius
    bounds = sizes * np.cos(np.maximum(away, 0)) * (1 + 1e-9) + 1e-9
    order = np.argsort(-bounds, kind="stable")
    return order, bounds[order]


def _best(scores, ids, places, k):
    """The first k by score, then id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order], places[order]


class _Walk:
    """A member's way along a list: what it has found and the score below which nothing counts any more."""

    def __init__(self, k, high=None, low=None):
        self.k, self.high, self.low = k, high, low
        self.found = (np.zeros(0, np.int64),) * 3

    def needs(self):
        full = len(self.found[0]) == self.k
        floor = float(self.found[0][-1]) if full else -np.inf
        return max(floor, -np.inf if self.low is None else self.low)

    def take(self, scores, ids, places):
        keep = scores >= self.needs()
        if self.high is not None:
            keep &= scores <= self.high
        if keep.any():
            self.found = _best(*(np.concatenate([old, new[keep]]) for old, new in zip(self.found, (scores, ids, places))), self.k)


def walk(block, members, walks, same_label):
    """Walks of all members of one cluster along the list of a block. block: (rows, ids, labels, v); walks: a list of _Walk per member."""
    row, ids, labels, v, directions, sizes = block
    own_row, own_label, own = members
    order, bounds = shared_list(v, directions, sizes, own)
    length = np.linalg.norm(own.astype(float), axis=1)
    on = np.arange(len(own))
    for start in range(0, len(order), STEP):
        need = np.array([min((w.needs() for w in walks[m]), default=np.inf) for m in on])
        on = on[length[on] * bounds[start] + 1e-6 >= need]
        if not len(on):
            return
        part = order[start:start + STEP]
        scores = products(own[on], v[part])
        for i, m in enumerate(on):
            fits = (labels[part] == own_label[m]) & (row[part] != own_row[m]) if same_label else labels[part] != own_label[m]
            at = np.flatnonzero(fits)
            for w in walks[m]:
                w.take(scores[i, at], ids[part[at]], row[part[at]])


def _walks(rows, anchors, blocks, same_label):
    """Every anchor along the lists of every block: (anchor row, id, nth wanted, its id and score, found id, row, score)."""
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "cluster", "dim", "row", "id",
                             "label", "v", F.lit(None).cast("binary").alias("wanted"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "cluster", "dim", "row", "id",
                            "label", "v", "wanted")
    names = ["anchor_row", "anchor_id", "nth", "positive_id", "positive_score", "id", "row", "score"]

    def run(batches):
        import pyarrow as pa
        key, held, block, waiting = None, [], None, []

        def vectors(rows, dim):
            return np.frombuffer(b"".join(r[7] for r in rows), "<i8").reshape(len(rows), dim)

        def close():  # the candidates of a block are complete
            v = vectors(held, key[1])
            return (np.array([r[4] for r in held], np.int64), np.array([r[5] for r in held], np.int64), np.array([r[6] for r in held]), v,
                    *_directions(v))

        def ask():
            own = vectors(waiting, key[1])
            wanted = [np.frombuffer(r[8], "<i8").reshape(-1, 2).tolist() if r[8] is not None else [[0, 0]] for r in waiting]
            walks = [[_Walk(POSITIVES)] if same_label else [_Walk(NEGATIVES, s, -(-4 * s // 5)) for _, s in w] for w in wanted]
            walk(block, (np.array([r[4] for r in waiting], np.int64), np.array([r[6] for r in waiting]), own), walks, same_label)
            out = []
            for r, ws, want in zip(waiting, walks, wanted):
                for nth, (w, (pid, ps)) in enumerate(zip(ws, want)):
                    out += [(r[4], r[5], nth, pid, ps, i, at, s) for s, i, at in zip(*(x.tolist() for x in w.found))]
            return out

        def batch_of(out):
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)], names)

        cluster = None
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if (r[0], r[3]) != key:
                    if waiting:
                        out += ask()
                    key, held, block, waiting, cluster = (r[0], r[3]), [], None, [], None
                if r[1] == 0:
                    held.append(r)
                    continue
                if block is None:
                    block, held = close(), []
                if waiting and (r[2] != cluster or len(waiting) >= MEMBERS):
                    out += ask()
                    waiting = []
                cluster = r[2]
                waiting.append(r)
            if out:
                yield batch_of(out)
        if waiting:
            yield batch_of(ask())

    order = ["block", "dim", "kind", "cluster", "row"]
    return (candidates.unionByName(asking).repartition("block", "dim").sortWithinPartitions(*order)
            .mapInArrow(run, ", ".join(f"{n} long" for n in names)))


def _first(found, keys, k):
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(usable(vectors), "list-rows")
    is_anchor = F.col("id") % ANCHOR_EVERY == 0
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks = int(max(1, min(-(-n // SMALL_BLOCK), MANY_BLOCKS), -(-n // BLOCK)))
    rows = materialize(_packed(rows, _centres(rows.where(is_anchor), asking)), "list-vectors")
    anchors = rows.where(is_anchor)
    positives = materialize(_first(_walks(rows, anchors.withColumn("wanted", F.lit(None).cast("binary")), blocks, True), ["anchor_row"], POSITIVES)
                            .select("anchor_row", "rank", "id", "score"), "list-positives")
    each = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # POSITIVES at most

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            wanted = [np.array([(r["id"], r["score"]) for r in p], "<i8").tobytes() for p in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(wanted, pa.binary())], ["row", "wanted"])

    anchors = anchors.join(each.mapInArrow(pack, "row long, wanted binary"), "row")
    found = _first(_walks(rows, anchors, blocks, False), ["anchor_row", "nth"], NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def sql():
    """The same rows by comparing every anchor with every row."""
    return f"""
with rows as (
  select row_number() over () as rid, vec_id as id, case when vec_id % {RELABEL_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
    list_transform(embedding, lambda x: greatest(least(floor(256 * x::double), {LIMIT}), -{LIMIT})::double) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.rid as anchor_row, a.id as anchor_id, a.label = c.label as same, c.rid, c.id, list_inner_product(a.v, c.v)::bigint as score
  from rows a join rows c on len(a.v) = len(c.v) where a.id % {ANCHOR_EVERY} = 0 and a.rid <> c.rid),
positives as (
  select anchor_row, anchor_id, rid, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_row order by score desc, id, rid) <= {POSITIVES}),
ranked as (
  select p.anchor_row, p.anchor_id, p.positive_id, p.positive_score, n.id as negative_id, n.score as negative_score,
    row_number() over (partition by p.anchor_row, p.rid order by n.score desc, n.id, n.rid) as rank
  from positives p join scored n on n.anchor_row = p.anchor_row and not n.same
    and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= {NEGATIVES}"""
