"""Near copies among vectors by spherical-cap filters.

A filter is a direction; a vector passes it if its inner product exceeds a threshold. The directions form a random product
code: the (randomly turned) space is cut into blocks, each block has a small random code, and every combination of one
code word per block is a filter. So there are code_words ^ blocks filters, yet a vector finds all that it exceeds (list
decoding) from its few inner products per block: combinations are built block by block, and a partial one is dropped when
the best the remaining blocks can add does not reach the threshold. Vectors meet in the filters they share and are compared
there in double precision. The threshold is set by the number of filters a random vector should pass, and lowered for a
vector that passes few; recall is measured against brute force in the tests.

The number of code words grows with the number of vectors, so that a filter holds about the same number of unrelated ones
at any size. Copies are one vector with a weight. A filter with many vectors is cut into blocks, and pairs of blocks are
compared by different tasks. A pair counts in the smallest filter it shares only, and a task emits counts per vector and a
spanning forest of its links, never the pairs.

Edge cases: null and zero vectors and those with a null or non-finite component link with nothing; vectors of different
lengths are compared within their length only; repeated rows of one vec_id each get a row, link with each other as copies
and count as vectors of their own; an empty table gives no rows; other columns, the label too, are ignored.
"""
import numpy as np
from pyspark.sql import functions as F

from coverlens.llm.components import components
from coverlens.session import materialize

THRESHOLD = 0.95
BLOCKS = 2
#: Filters a random vector passes on average and any vector at least, unrelated vectors per filter, rows of a filter that one task compares.
PASSED = 20
LEAST = 16
PER_FILTER = 4
UNIT = 2048
SEED = 20


def code(dim, words, blocks=BLOCKS, seed=SEED):
    """(rotation, [code words of each block]) of unit length."""
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    parts = [rng.normal(size=(words, len(part))) for part in np.array_split(np.arange(dim), blocks)]
    return turn, [p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts]


def words_for(n, blocks=BLOCKS):
    """Code words per block, so that n vectors leave about PER_FILTER in each filter."""
    return max(8, int(np.ceil((n * PASSED / PER_FILTER) ** (1 / blocks))))


def threshold_for(dim, words, blocks=BLOCKS, seed=SEED):
    """What a random vector exceeds in PASSED filters on average, found on random vectors."""
    x = np.random.default_rng(seed + 1).normal(size=(128, dim))
    scores = _block_scores(x / np.linalg.norm(x, axis=1, keepdims=True), code(dim, words, blocks, seed))
    low, high = 0.0, float(sum(s.max() for s in scores))
    goal = min(PASSED, float(words) ** blocks / 2)
    for _ in range(14):
        middle = (low + high) / 2
        best = np.mean([np.prod([float((s[i] >= middle - sum(o[i].max() for o in scores if o is not s)).sum()) for s in scores])
                        for i in range(len(x))])
        if best > 200 * goal or np.mean([len(passed([s[i] for s in scores], middle)) for i in range(len(x))]) > goal:
            low = middle
        else:
            high = middle
    return high


def _block_scores(x, coded):
    turn, parts = coded
    turned = x @ turn
    return [t @ p.T for t, p in zip(np.array_split(turned, len(parts), axis=1), parts)]


def passed(scores, least):
    """All filters whose block scores sum to at least `least`, for one vector; scores: one array per block."""
    order = [np.argsort(-s) for s in scores]
    best = [s[o[0]] for s, o in zip(scores, order)]
    ids, sums = np.zeros(1, np.int64), np.zeros(1)
    for k, (s, o) in enumerate(zip(scores, order)):
        need = least - sums - sum(best[k + 1:])
        ranked = s[o]
        many = np.searchsorted(-ranked, -need, "right")  # the first so many words of this block still reach it
        rep = np.repeat(np.arange(len(ids)), many)
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
        ids, sums = ids[rep] * len(s) + o[nth], sums[rep] + ranked[nth]
    return np.sort(ids[sums >= least])


def filters_of(scores, least):
    """The filters a vector exceeds; one that exceeds fewer than LEAST gets a lower threshold, as its near copies do."""
    found = passed(scores, least)
    while len(found) < min(LEAST, np.prod([len(s) for s in scores])):
        least -= 0.02
        found = passed(scores, least)
    return found


def _usable(vectors):
    return (vectors.select("row", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0)
                   & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)))


def unit(v):
    """v at length one, in double precision."""
    x = np.asarray(v, float)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _filtered(classes, n):
    """(filter, node, weight, v, filters) of every class and filter that it passes."""
    def run(batches):
        import pyarrow as pa
        made = {}
        for batch in batches:
            out = []
            for node, weight, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                dim = len(v)
                if dim not in made:
                    words = words_for(n)
                    made[dim] = code(dim, words), threshold_for(dim, words)
                coded, least = made[dim]
                got = filters_of([s[0] for s in _block_scores(unit(v)[None], coded)], least)
                exact = np.array(v, "<f4") if (np.array(v, "<f4") == v).all() else np.array(v, "<f8")
                lists = got.astype("<i8").tobytes()
                out += [(f << 20 | dim, node, weight, exact.tobytes(), lists) for f in got.tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for i in range(0, len(out), 4096):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[i:i + 4096]), kinds)], ["filter", "node", "weight", "v", "filters"])

    return classes.select("node", "weight", "v").mapInArrow(run, "filter long, node long, weight long, v binary, filters binary")


def compare(rows, others, this, threshold):
    """Links of one unit. rows, others: lists of (node, weight, v, filters); others None: among rows. Yields (node, links, root)."""
    left, right = rows, rows if others is None else others
    dim = this & (1 << 20) - 1
    x, y = (np.stack([unit(np.frombuffer(r[2], f"<f{len(r[2]) // dim}")) for r in side]) for side in (left, right))
    this >>= 20
    near = x @ y.T >= threshold
    if others is None:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    lower = [[f for f in np.frombuffer(r[3], "<i8").tolist() if f < this] for r in left], [
        [f for f in np.frombuffer(r[3], "<i8").tolist() if f < this] for r in right]
    column = {f: i for i, f in enumerate(sorted({f for r in lower[0] for f in r}))}
    if column:  # a pair counts where it meets first
        met = []
        for side in lower:
            m = np.zeros((len(side), len(column)), np.float32)
            for i, r in enumerate(side):
                m[i, [column[f] for f in r if f in column]] = 1
            met.append(m)
        near &= met[0] @ met[1].T == 0
    nodes = [[r[0] for r in side] for side in (left, right)]
    weights = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    links = dict(zip(nodes[0], (near @ weights[1]).tolist()))
    if others is not None:
        for node, n in zip(nodes[1], (weights[0] @ near).tolist()):
            links[node] = links.get(node, 0) + n
    root = {node: node for side in nodes for node in side}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, node in enumerate(nodes[0]):
        for j in np.flatnonzero(near[i]).tolist():
            a, b = find(node), find(nodes[1][j])
            root[max(a, b)] = min(a, b)
    return [(node, n, find(node)) for node, n in links.items() if n]


def _links(placed, threshold):
    """(node, links, root) partial results of all units."""
    hot = placed.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > UNIT)
    hot = hot.select("filter", F.ceil(F.col("n") * 2 / UNIT).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    units = (placed.join(hot, "filter", "left").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
             .select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "weight", "v", "filters"))

    def run(batches):
        import pyarrow as pa
        kinds = (pa.int64(), pa.int64(), pa.int64())
        key, rows = None, []

        def done():
            this = key[0]
            if key[1] == key[2]:
                return compare([r[1:] for r in rows], None, this, threshold) if len(rows) > 1 else []
            sides = [[r[1:] for r in rows if r[0] == own] for own in key[1:]]
            return compare(sides[0], sides[1], this, threshold) if all(sides) else []

        for batch in batches:
            out = []
            for f, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (f, i, j) != key:
                    out += done() if rows else []
                    key, rows = (f, i, j), []
                rows.append(row)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["node", "links", "root"])
        out = done() if rows else []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["node", "links", "root"])

    return (units.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
            .mapInArrow(run, "node long, links long, root long"))


def near_copies(vectors, threshold=THRESHOLD):
    """One row per vector: vec_id, n_links, component_id, kept."""
    named = materialize(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    usable = _usable(named)
    classes = materialize(usable.groupBy("v").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"),
                                                  F.min("vec_id").alias("first")), "vector-classes")
    partial = materialize(_links(_filtered(classes, classes.count()), threshold), "vector-links")
    links = partial.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(partial.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    classes = (classes.join(links, "node", "left").join(joined, "node", "left")
               .withColumn("component", F.coalesce("component", "node")).withColumn("links", F.coalesce("links", F.lit(0))))
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(smallest, "component").select("v", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    of_row = usable.join(classes, "v").select("row", "n_links", "component_id")
    out = named.select("row", "vec_id").join(of_row, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
