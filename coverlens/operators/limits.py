"""Request limits: sliding demand and the limiter itself."""
import collections

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from coverlens import fixed_values as V
from coverlens.session import materialize


def _micros(seconds):
    return int(round(seconds * 1_000_000))


def request_rate(events: DataFrame, seconds: float) -> DataFrame:
    """Requests of the same user in (now - seconds, now], the row itself included.

    A row only needs the rows of its own and the previous slice of that
    length, so rows are grouped by (user, slice) and each is repeated once, in
    the next slice. A very active user is spread over as many tasks as there
    are slices.
    """
    width = _micros(seconds)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    both = (events.withColumn("_us", us).withColumn("_own", F.floor(F.col("_us") / width))
            .withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1))))
    w = Window.partitionBy("user_id", "_slice").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (both.withColumn("requests_in_window", F.count("*").over(w))
            .where(F.col("_slice") == F.col("_own")).drop("_us", "_own", "_slice"))


def admit(kept, now, max_requests, width):
    """Decision on one request; ``kept`` are the accepted times still in the window."""
    while kept and kept[0] <= now - width:
        kept.popleft()
    accepted = len(kept) < max_requests
    if accepted:
        kept.append(now)
    return accepted


_BLOCK = ["user_id", "_seg", "_block"]
_DECIDED = [*_BLOCK, "_us", "event_id", "accepted", "carried"]
_DECISIONS = "user_id long, _seg long, _block long, _us long, event_id long, accepted boolean, carried boolean"


def _decide(max_requests, width):
    """Folds batches of rows sorted by block and time; the times a block starts from come first, those it leaves behind last."""
    def left_behind(block, kept):
        return [(*block, t, -1, True, True) for t in kept]

    def decide(batches):
        block, kept = None, collections.deque()
        for pdf in batches:
            out = []
            for *this, now, event, contested, carried in pdf.itertuples(index=False, name=None):
                if this != block:
                    if block:
                        out += left_behind(block, kept)
                    block, kept = this, collections.deque()
                if carried:
                    kept.append(now)
                    continue
                accepted = admit(kept, now, max_requests, width)
                if contested:
                    out.append((*block, now, event, accepted, False))
            yield pd.DataFrame(out, columns=_DECIDED)
        if block:
            yield pd.DataFrame(left_behind(block, kept), columns=_DECIDED)
    return decide


def allow_requests(events: DataFrame, max_requests: int = V.LIMITER_MAX_REQUESTS,
                   seconds: float = V.LIMITER_WINDOW_SECONDS, block_rows: int = 500_000) -> DataFrame:
    """Sliding limiter: rejected requests use up nothing, so each decision depends on earlier ones.

    A request is certainly accepted when even all requests in its window are
    within the limit. That settles most rows without looking at any decision.
    The others form stretches: a new stretch begins where the last unsettled
    request has left the window, because then the accepted requests in the
    window are known. Only stretches are decided in order, each from its own
    start, in parallel.

    A stretch of one user under permanent overload may be long. It is cut into
    blocks of about ``block_rows`` rows. A block needs the at most
    ``max_requests`` times that the block before it left behind, so all blocks
    are decided at once from a guess (none), and those whose guess was wrong
    again, until no guess is: see ``_decide_stretches``. Usually there is one
    block.
    """
    width = _micros(seconds)
    rated = request_rate(events.select("user_id", "event_id", "ts"), seconds)
    rated = rated.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    rated = materialize(rated.select("user_id", "event_id", "_us", F.floor(F.col("_us") / width).alias("_slice"),
                                     (F.col("requests_in_window") > max_requests).alias("contested")), "rated")
    decided = _decide_stretches(rated, max_requests, width, block_rows)
    settled = rated.where(~F.col("contested")).select("user_id", "event_id", "_us", F.lit(True).alias("accepted"))
    return (settled.unionByName(decided)
            .select("user_id", "event_id", F.timestamp_micros("_us").alias("ts"), "accepted"))


def _stretches(rated, width, block_rows):
    """Slices of each stretch with its bounds and block, the slice before it included.

    One row per (user, slice): a user has at most as many as the time span has
    windows, however many requests there are.
    """
    per_slice = rated.groupBy("user_id", "_slice").agg(
        F.count("*").alias("rows"), F.min(F.when(F.col("contested"), F.col("_us"))).alias("lo"),
        F.max(F.when(F.col("contested"), F.col("_us"))).alias("hi"))
    by_user = Window.partitionBy("user_id").orderBy("_slice")
    linked = ((F.lag("_slice").over(by_user) == F.col("_slice") - 1)
              & (F.col("lo") - F.lag("hi").over(by_user) < width))
    seg = Window.partitionBy("user_id", "_seg")
    slices = (per_slice.where(F.col("lo").isNotNull())
              .withColumn("_new", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1))
              .withColumn("_seg", F.sum("_new").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_from", F.min("lo").over(seg) - width).withColumn("_to", F.max("hi").over(seg)))
    before = Window.partitionBy("user_id", "_seg").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_block", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / block_rows))
    reach = F.when(F.col("_new") == 1, F.array(F.col("_slice") - 1, F.col("_slice"))).otherwise(F.array("_slice"))
    return slices.select("user_id", "_seg", "_from", "_to", "_block", F.explode(reach).alias("_slice"))


def _decide_stretches(rated, max_requests, width, block_rows):
    """Decisions on contested rows: one block per stretch at once, several from guesses."""
    spark = rated.sparkSession
    slices = materialize(_stretches(rated, width, block_rows), "stretches")
    last = slices.agg(F.max("_block")).first()[0]
    if last is None:
        return spark.createDataFrame([], "user_id long, event_id long, _us long, accepted boolean")
    rows = (rated.join(slices, ["user_id", "_slice"])
            .where((F.col("_us") > F.col("_from")) & (F.col("_us") <= F.col("_to")))
            .select(*_BLOCK, "_us", "event_id", "contested", F.lit(False).alias("carried")))
    fold = _decide(max_requests, width)
    decided = _settle(rows, fold) if last else _fold_blocks(rows, fold)
    return decided.where("not carried").select("user_id", "event_id", "_us", "accepted")


def _fold_blocks(rows, fold):
    folded = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "_us", "event_id").mapInPandas(fold, _DECISIONS)
    return materialize(folded, "decided", by=["carried"])


#: Rounds in which all blocks with a wrong guess are decided again; later ones decide the first such block of each stretch.
GUESSES = 4


def _settle(rows, fold):
    """Decides blocks until each has started from the times that the block before it left behind.

    Round 0 starts every block from nothing. Two runs over the same requests
    that start from different times meet once they have kept the same ones.
    With k requests between two kept ones that takes some 2k windows of
    irregular requests; a block that is longer leaves behind the same times
    whatever it started from, and round 1 settles all blocks. Shorter blocks
    need some rounds more, as each round brings the right times one block
    further. Requests at even distances never meet, and a flood of thousands
    a second does so late: after ``GUESSES`` rounds only the first wrong block
    of a stretch is decided in a round, one after another, so the work stays
    within ``GUESSES`` + 2 passes over the rows.

    ``blocks`` has a row per block with its current start, end and round; the
    rows of a block are in the folder of its number, so late rounds read only
    the folders that their blocks lie in.
    """
    rows = materialize(rows.repartition(*_BLOCK), "contested", by=["_block"]).select(*rows.columns)
    ends = F.sort_array(F.collect_list(F.when(F.col("carried"), F.col("_us"))))  # at most max_requests times
    in_order = Window.partitionBy("user_id", "_seg").orderBy("_block")
    nothing = F.array().cast("array<long>")

    rounds = _fold_blocks(rows, fold).withColumn("round", F.lit(0))
    blocks = rounds.groupBy(*_BLOCK).agg(ends.alias("end")).withColumns({"start": nothing, "round": F.lit(0)})
    r = 0
    while True:
        due = F.coalesce(F.lag("end").over(in_order), nothing)
        blocks = materialize(blocks.withColumn("due", due).withColumn("wrong", F.col("due") != F.col("start")), "blocks")
        wrong = blocks.where("wrong")
        if r >= GUESSES:
            wrong = wrong.groupBy("user_id", "_seg").agg(F.min_by(F.struct("_block", "due"), "_block").alias("b")).select("user_id", "_seg", "b.*")
        wrong = wrong.select(*_BLOCK, "due")
        few = wrong.agg(F.min("_block").alias("lo"), F.max("_block").alias("hi")).first()
        if few.lo is None:
            break
        r += 1
        carried = wrong.select(*_BLOCK, F.explode("due").alias("_us"), F.lit(-1).cast("long").alias("event_id"),
                               F.lit(False).alias("contested"), F.lit(True).alias("carried"))
        again = rows.where(F.col("_block").between(few.lo, few.hi)).join(wrong.select(*_BLOCK), _BLOCK, "left_semi")
        out = _fold_blocks(again.unionByName(carried), fold).withColumn("round", F.lit(r))
        rounds = rounds.unionByName(out)
        new = out.groupBy(*_BLOCK).agg(ends.alias("new_end"))
        started = wrong.withColumnRenamed("due", "new_start").join(new, _BLOCK, "left")
        fresh = F.col("new_start").isNotNull()
        blocks = (blocks.drop("due", "wrong").join(started, _BLOCK, "left")
                  .select(*_BLOCK, F.when(fresh, F.coalesce("new_end", nothing)).otherwise(F.col("end")).alias("end"),
                          F.coalesce("new_start", "start").alias("start"), F.when(fresh, F.lit(r)).otherwise(F.col("round")).alias("round")))
    return rounds.join(blocks.select(*_BLOCK, "round"), [*_BLOCK, "round"], "left_semi")
