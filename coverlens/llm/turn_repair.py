"""Repair of conversations with the cheapest edits, and an audit of them.

A conversation's rows, in order of turn, are edited until the initials of their roles read `(s?(ua)+)?`: Keep (0), Rerole to the
role that fits (3), Delete (4; blank and duplicate rows must go) and Insert of an empty turn (3); a truncated row that stays adds
3. The audit is the string of the edits' initials; of equally cheap ones the least counts.

A dynamic program runs over the rows with one cell per state of the grammar. A cell holds its cost and the end of its audit,
a node that shares its prefix with others: nodes are never changed, know their ancestors at distances of powers of two, and
carry a rolling hash of all letters up to them. Two audits of equal cost are compared by lifting both ends to the longest
common prefix, found by comparing hashes, and there by letter; what equal hashes say is verified on the nodes. What all live
cells share is final and goes to the digest at once, so that a long conversation is folded row by row.

Rows are damaged, and repeated rows marked, by joins and aggregates on hashes; the fold then streams over each conversation,
sorted by Spark. One conversation is folded by one task, as its digest is sequential.

Edge cases: null roles, texts, ids and turns read as one space; rows of one turn are in order of role and text, a null turn
comes first; a null conv_id is a conversation like others; roles count by their first letter, an empty or other role can
only be re-roled or deleted; a conversation without rows after damage gets zeros, an empty audit and the digest of nothing;
long conversations and texts go through whole; an empty table gives no rows; other columns are ignored.
"""
import collections
import hashlib

from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
END = ".!?"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after s, after u, after a pair. Next state by initial; state after a turn of the role that fits.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITS = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
_MOD, _BASE = (1 << 61) - 1, 911_382_323_417
#: Rows that wait before the shared part of their edits is looked for.
WAITING = 512


class Node:
    """The end of an audit. ups[k] is the node 2^k edits before.

    A run of rows that all must go is one edit of many letters; all audits have it at the same rows, so comparing edit by
    edit is comparing letter by letter.
    """
    __slots__ = ("letter", "many", "depth", "hash", "ups")

    def __init__(self, parent=None, letter="", many=1):
        self.letter, self.many = letter, many
        if parent is None:
            self.depth, self.hash, self.ups = 0, 0, ()
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * _BASE + (many << 8) + ord(letter)) % _MOD
        ups = [parent]
        while len(ups[-1].ups) >= len(ups):
            ups.append(ups[-1].ups[len(ups) - 1])
        self.ups = tuple(ups)

    def above(self, depth):
        node = self
        while node.depth > depth:
            node = node.ups[(node.depth - depth).bit_length() - 1]
        return node

    def edits(self):
        out, node = [], self
        while node.ups:
            out.append((node.letter, node.many))
            node = node.ups[0]
        return out[::-1]


def _same(a, b):
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.ups[0], b.ups[0]
    return True


def less(a, b):
    """Whether the audit that ends in a comes before the one that ends in b."""
    depth = min(a.depth, b.depth)
    x, y = a.above(depth), b.above(depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _same(x, y) else a.edits() < b.edits()
    for k in reversed(range(len(x.ups))):
        if k < len(x.ups) and x.ups[k].hash != y.ups[k].hash:
            x, y = x.ups[k], y.ups[k]
    return x.letter < y.letter if _same(x.ups[0], y.ups[0]) else a.edits() < b.edits()


def _offer(cells, state, cost, parent, letter, many=1):
    old = cells[state]
    if old is not None and old[0] < cost:
        return
    node = Node(parent, letter, many)
    if old is None or cost < old[0] or less(node, old[1]):
        cells[state] = (cost, node)


def _with_inserts(cells):
    for state in (0, 1, 3, 2, 3):
        if cells[state] is not None:
            _offer(cells, FITS[state], cells[state][0] + INSERT, cells[state][1], "I")
    # What a state can still do, the pair state can do as cheaply, or for one deleted s more.
    if cells[3] is not None:
        for state, more in ((0, DELETE), (1, 0)):
            if cells[state] is not None and cells[3][0] + more < cells[state][0]:
                cells[state] = None
    return cells


class Repair:
    """Folds the rows of one conversation. add(turn, role, text, again) in order, then result()."""

    def __init__(self):
        self.cells = _with_inserts([(0, Node()), None, None, None])
        self.waiting, self.look, self.going = collections.deque(), WAITING, 0
        self.audit, self.digest, self.written, self.state = [], hashlib.sha256(), False, 0
        self.counts = collections.Counter()
        self.last_initial, self.turns = None, [None, None, 0, None]

    def add(self, turn, role, text, again):
        if turn is not None:
            first, _, n, last = self.turns
            self.turns = [turn if first is None else first, turn, n + (turn != last), turn]
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = initial
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in END else None
        self.counts[fault] += 1
        if fault in ("blank", "duplicate"):
            self.going += 1
            return
        self._let_go()
        more = CUT_OFF if fault == "truncated" else 0
        cells = [None] * 4
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell
            _offer(cells, state, cost + DELETE, node, "D")
            kept = NEXT[state].get(initial)
            if kept is not None:
                _offer(cells, kept, cost + KEEP + more, node, "K")
            _offer(cells, FITS[state], cost + REROLE + more, node, "R")
        self.cells = _with_inserts(cells)
        self.waiting.append((role, text))
        if len(self.waiting) >= self.look:
            self._settle()
            self.look = WAITING + 2 * len(self.waiting)

    def _let_go(self):
        """Deletes the rows that had to go since the last other row, in all cells; inserting after them comes before inserting between."""
        if self.going:
            cells = [None] * 4
            for state, cell in enumerate(self.cells):
                if cell is not None:
                    _offer(cells, state, cell[0] + DELETE * self.going, cell[1], "D", self.going)
            self.cells = _with_inserts(cells)
            self.waiting.append(("", ""))
            self.going = 0

    def _settle(self):
        """Applies what all live audits share; they start anew from there."""
        live = [c[1] for c in self.cells if c is not None]
        ends = [n.above(min(n.depth for n in live)) for n in live]
        while any(n is not ends[0] for n in ends):
            ends = [n.ups[0] for n in ends]
        self._apply(ends[0].edits())
        root = Node()
        made = {ends[0]: root}
        for n in live:
            path, node = [], n
            while node not in made:
                path.append(node)
                node = node.ups[0]
            for node in reversed(path):
                made[node] = Node(made[node.ups[0]], node.letter, node.many)
        self.cells = [c and (c[0], made[c[1]]) for c in self.cells]

    def _apply(self, edits):
        for letter, many in edits:
            self.audit.append(letter * many)
            role, text = self.waiting.popleft() if letter != "I" else ("", "")
            if letter == "D":
                continue
            if letter == "K":
                self.state = NEXT[self.state][role[0]]
            else:
                self.state = FITS[self.state]
                role = ROLE[self.state]
            self.digest.update(f"{chr(10) if self.written else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.written = True

    def result(self):
        self._let_go()
        best = self.cells[0]
        other = self.cells[3]
        if best is None or other is not None and (other[0] < best[0] or other[0] == best[0] and less(other[1], best[1])):
            best = other
        self._apply(best[1].edits())
        first, last, n, _ = self.turns
        c = self.counts
        return (0 if first is None else last - first + 1 - n, c["blank"], c["duplicate"], c["truncated"], c["illegal"], best[0],
                "".join(self.audit), self.digest.hexdigest())


def damaged(conversations):
    """(conv_id, turn, role, text) with faults by a hash of id and turn; a dropped row stays as one without role and text."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k == 1, F.lit("")).when(k == 2, F.translate("text", END, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k != 0, F.when(k == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
                       F.when(k != 0, text).alias("text"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _marked(rows):
    """rows with `first`: no row of an earlier turn has the same role and text."""
    keyed = rows.withColumn("h", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b")))
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    early = (keyed.where("role is not null").groupBy("conv_id", "role", "h").agg(F.min(at).alias("at"))
             .select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h"), F.col("at.turn").alias("_t")))
    same = (F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h"))
            & F.col("turn").eqNullSafe(F.col("_t")))
    return keyed.join(early, same, "left").select("conv_id", "turn", "role", "text", F.col("_h").isNotNull().alias("first"))


def _fold(batches):
    import pyarrow as pa
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def batch_of(out):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    now, at, before = None, None, None
    for batch in batches:
        out = []
        for conv, turn, role, text, first in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != at:
                if now is not None:
                    out.append((at, *now.result()))
                now, at, before = Repair(), conv, None
            if role is None:
                continue
            row = (turn, role, text)
            now.add(turn, role, text, not first or row == before)
            before = row
        if out:
            yield batch_of(out)
    if now is not None:
        yield batch_of([(at, *now.result())])


def repaired(rows):
    """One row per conversation of (conv_id, turn, role, text): faults, cost and audit of the cheapest edits, digest of the repaired text."""
    return (_marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_fold, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                               "repaired_sha256 string"))


def repair_damaged(conversations):
    return repaired(damaged(conversations))
