"""Conversation repair, repeated byte strings and shared candidate lists against brute force."""
import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from checks.compare import connect
from coverlens.llm import shared_lists, suffix_repeats, turn_repair

AFTER = {("", "s"): "S", ("", "u"): "U", ("S", "u"): "U", ("U", "a"): "P", ("P", "u"): "U"}


def cheapest_edits(rows):
    """What turn_repair.Repair gives but for the gaps, from the least of all edit strings of the rest at each row."""
    faults, seen = [], set()
    for role, text in rows:
        bare = text.strip(turn_repair.SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, built, inserted):
        options = [(0, "")] if i == len(rows) and built in ("", "P") else []

        def go(cost, letter, *state):
            rest = best(*state) if state[1] is not None else None
            if rest:
                options.append((rest[0] + cost, letter + rest[1]))

        for c in "ua" if inserted < 3 else "":
            go(3, "I", i, AFTER.get((built, c)), inserted + 1)
        if i < len(rows):
            go(4, "D", i + 1, built, 0)
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                go(more, "K", i + 1, AFTER.get((built, rows[i][0][:1])), 0)
                for c in "ua":
                    go(3 + more, "R", i + 1, AFTER.get((built, c)), 0)
        return min(options) if options else None

    cost, audit = best(0, "", 0)
    out, at, last = [], 0, ""
    for letter in audit:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        out.append(f"{role}:{text}")
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repair(rows):
    folded, seen = turn_repair.Repair(), set()
    for i, (role, text) in enumerate(rows):
        folded.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return folded


def test_repair_equals_brute_force(monkeypatch):
    monkeypatch.setattr(turn_repair, "WAITING", 6)
    rnd = random.Random(5)
    for _ in range(1500):
        often = rnd.random() < 0.5
        rows = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "umpire"]),
                 rnd.choice(["", " ", "a.", "b.", "c", "d!", "e"]) if often else f"{rnd.random()}{rnd.choice(['.', ''])}")
                for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 20, 50]))]
        assert repair(rows).result()[1:] == cheapest_edits(rows), rows


def test_audits_compare_by_letter_even_if_hashes_collide(monkeypatch):
    rnd = random.Random(2)
    for mod in (turn_repair._MOD, 3):
        monkeypatch.setattr(turn_repair, "_MOD", mod)
        for _ in range(300):
            shared = turn_repair.Node()
            for c in rnd.choices("DIKR", k=rnd.randint(0, 20)):
                shared = turn_repair.Node(shared, c)
            ends = []
            for _ in range(2):
                node = shared
                for c in rnd.choices("DIKR", k=rnd.randint(0, 20)):
                    node = turn_repair.Node(node, c)
                ends.append(node)
            text = ["".join(c for c, _ in n.edits()) for n in ends]
            assert turn_repair.less(*ends) == (text[0] < text[1])


def test_long_conversation_is_folded_in_bounded_memory():
    rnd = random.Random(3)
    for again in (0.3, 1.0):
        folded, most = turn_repair.Repair(), 0
        for i in range(20_000):
            folded.add(i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", str(i)]), i > 0 and rnd.random() < again)
            most = max(most, len(folded.waiting))
        assert most < 3 * turn_repair.WAITING and len(folded.result()[6]) >= 20_000


def conversations_by_hand(rows):
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *cheapest_edits([r[1:] for r in kept]))
    return out


def test_repair_query(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    rnd = random.Random(8)
    rows += [(9000 + i % 7, rnd.choice([None, *range(6)]), rnd.choice([None, "user", "assistant", "", "system", "tool"]),
              rnd.choice([None, "", "same.", "same.", "x" * 70_000, "aé!"])) for i in range(120)]
    rows += [(None, 1, "user", "no id."), (None, None, None, None), (2 ** 40, -(2 ** 40), "user", "far."), (2 ** 40, 2 ** 40, "assistant", "apart.")]
    given = spark.createDataFrame([(*r, i, "h") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, first int, h string")
    got = {r[0]: tuple(r[1:]) for r in turn_repair.repair_damaged(given).collect()}
    assert got == conversations_by_hand(rows)
    assert turn_repair.repair_damaged(given.limit(0)).count() == 0


def repeats_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted_texts():
    rnd = random.Random(4)
    word = ["".join(rnd.choices("abcdefghé日", k=rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choices(word, k=n))

    passage, line = prose(60), prose(18)
    texts = [None, "", "short", "x" * 1500, "x" * 1500, "ab" * 400, "abc" * 300, "\x00" * 500 + "\x00", prose(300), prose(4000)]
    texts += [prose(20) + passage + prose(20) for _ in range(6)] + [prose(15) + line + prose(15) for _ in range(30)]
    long = prose(500)
    texts += [long, long, long[:700] + "X" + long[701:], long[5:], long + prose(3), passage[:199], passage[:200], passage * 3, "\x00" * 190 + passage]
    return texts


@pytest.mark.parametrize("slice_size", [None, 2])
def test_repeats_equal_brute_force(spark, sf, monkeypatch, slice_size):
    if slice_size:  # nearly every anchor is split, and its shards are merged
        monkeypatch.setattr(suffix_repeats, "SLICE", slice_size)
        monkeypatch.setattr(suffix_repeats, "PART", 300)
    monkeypatch.setattr(suffix_repeats, "PIECE", 4096)
    suffix_repeats._HASHES.clear()
    texts = planted_texts() + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rows = [(i, t, 0, "x", 1) for i, t in enumerate(texts)] + [(None, "no id " * 50, 0, "x", 1), (3, "again " * 50, 0, "x", 1), (3, "again " * 50, 0, "x", 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, d int, masks string, settled int")
    got = collections.Counter(tuple(r) for r in suffix_repeats.remove_repeats(given).collect())
    assert got == collections.Counter((r[0], *w) for r, w in zip(rows, repeats_by_hand([r[1] for r in rows])))
    suffix_repeats._HASHES.clear()


def test_repeats_of_nothing(spark):
    assert suffix_repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(6)
    for _ in range(60):
        parts = [bytes(rnd.choices(b"ab\x00", k=rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8))]
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        order, rank = suffix_repeats.suffix_array(data, ends)
        suffixes = [(p[i:], k) for k, p in enumerate(parts) for i in range(len(p))]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        assert (order[rank] == np.arange(len(data))).all()
        got = suffix_repeats.common_prefixes(data, ends, order, rank, 12)
        for a, b, n in zip(order, order[1:], got[1:]):
            x, y = suffixes[a][0], suffixes[b][0]
            assert n == min(12, next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y))))


def test_hard_negatives_equal_sql(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 12)) * rng.choice([0.1, 1, 8], (900, 1)), 2).astype(np.float32)
    x[200:260] = x[100]
    rows = [(i * 10, v.tolist(), int(rng.integers(0, 3)), 1, 2, "v") for i, v in enumerate(x)]
    rows += [(100, x[5].tolist(), 1, 0, 0, "v"), (None, x[0].tolist(), 1, 0, 0, "v"), (3, None, 1, 0, 0, "v"), (4, x[1].tolist(), None, 0, 0, "v"),
             (5, [float("nan")] * 12, 1, 0, 0, "v"), (6, [None] * 12, 1, 0, 0, "v"), (8, [1.0] * 5, 1, 0, 0, "v"), (9, [], 2, 0, 0, "v"), (10_000_000, [1.0] * 5, 2, 0, 0, "v")]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, row int, cluster int, v string")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    import duckdb
    import tempfile
    path = tempfile.mkdtemp() + "/e.parquet"
    given.select("vec_id", "embedding", "label").toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}'")
    want = collections.Counter(con.sql(f"select {', '.join(names)} from ({shared_lists.sql()})").fetchall())
    got = collections.Counter(tuple(r) for r in shared_lists.mine(given).select(names).collect())
    assert got == want and len(got) > 100
    assert shared_lists.mine(given.limit(0)).count() == 0


def test_hard_negatives_in_many_blocks(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(tuple(r) for r in shared_lists.mine(table).collect())
    monkeypatch.setattr(shared_lists, "SMALL_BLOCK", 16)
    monkeypatch.setattr(shared_lists, "MEMBERS", 2)
    monkeypatch.setattr(shared_lists, "STEP", 4)
    assert sorted(tuple(r) for r in shared_lists.mine(table).collect()) == want and want


def test_hard_negatives_query(spark, sf):
    from coverlens.llm.queries import ORACLE, QUERIES
    got = QUERIES["op13_shared_lists"](spark, sf).toPandas()
    want = connect(sf).sql(ORACLE["op13_shared_lists"]).df()
    keys = ["anchor_id", "positive_id", "rank"]
    assert (got.sort_values(keys).to_numpy() == want[got.columns].sort_values(keys).to_numpy()).all() and len(got) == len(want)
