"""Mixes of sources by shares of tokens (problem 7): capped water-filling, then seeded whole and fractional repeats.

A source with T tokens and at most R uses a record can give R * T. Of a budget each source is to give its
share. Sources that can't are clamped at their cap, and what they leave goes to the others in proportion to
their shares, again and again until no cap is exceeded. A source then uses each record as often as all can be
used, and some once more: those with the smallest seeded hashes, up to the tokens wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import bounded_rows, broadcast_if_bounded

#: Rows of a table of targets at most; the water-filling runs on the driver.
MAX_TARGETS = 100_000
#: Hash buckets of a source; only the one in which the wanted tokens run out is looked at record by record.
BUCKETS = 1 << 12

_EPS = 1e-12


def water_fill(budget: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """What each source gives of `budget`: proportional to its share, at most its cap, the rest redistributed.

    Sources of equal ratio of cap to share are clamped together; a share of 0 or less gives nothing. If all
    caps together are less than the budget, every source with a share gives its cap.
    """
    give = dict.fromkeys(shares, 0.0)
    open_ = {s for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    left = float(budget)
    while open_ and left > _EPS:
        level = left / sum(shares[s] for s in open_)
        dry = {s for s in open_ if caps[s] <= level * shares[s] * (1 + _EPS)}
        if not dry:
            for s in open_:
                give[s] = level * shares[s]
            break
        for s in dry:
            give[s] = float(caps[s])
            left -= caps[s]
        open_ -= dry
    return give


def exact_budget(shares: dict[str, float], caps: dict[str, float]) -> float:
    """The largest budget of which every source that has tokens can give its share without being clamped."""
    return min((caps[s] * sum(shares[x] for x in shares if caps.get(x, 0) > 0) / w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0), default=0.0)


_ALLOTMENT = "mix_name string, source string, target_share double, max_repeats long, there long, wanted long, clamped boolean"


def allotments(sizes: DataFrame, targets: DataFrame, budget: str | int = "once") -> DataFrame:
    """mix_name, source, target_share, max_repeats, there (tokens of the source), wanted (tokens to use), clamped.

    `budget`: the tokens of a mix; "once" takes the tokens of its sources used once, "exact" the largest
    number of tokens of which no source is clamped. Repeated rows of `targets` count once; a source named
    twice in a mix has the sum of the shares and the smaller cap; a null cap counts as 1, a null share as 0.
    """
    spark = sizes.sparkSession
    t = targets.select("mix_name", "source", "target_share", "max_repeats").distinct()
    t = t.groupBy("mix_name", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("most"))
    there = sizes.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("there"))
    rows = bounded_rows(t.join(there, "source", "left").fillna(0, ["there"]), MAX_TARGETS, "mix_targets")
    mixes: dict[str, list] = {}
    for r in rows:
        mixes.setdefault(r["mix_name"], []).append(r)
    out = []
    for name, own in mixes.items():
        shares = {r["source"]: r["share"] for r in own}
        caps = {r["source"]: max(0, r["most"]) * r["there"] for r in own}
        tokens = sum(r["there"] for r in own) if budget == "once" else exact_budget(shares, caps) if budget == "exact" else float(budget)
        give = water_fill(tokens, shares, caps)
        out += [(name, r["source"], r["share"], r["most"], r["there"], min(round(give[r["source"]]), caps[r["source"]]), 0 < caps[r["source"]] <= give[r["source"]] + 0.5) for r in own]
    return spark.createDataFrame(out, _ALLOTMENT)


def uses(sizes: DataFrame, targets: DataFrame, budget: str | int = "once", seed: int = 42) -> DataFrame:
    """mix_name, source, doc_id, n_tokens and uses (1 to max_repeats) of every document that is used.

    Whole repeats fall to all records of a source; the fractional one to those with the smallest seeded hashes,
    up to the record whose middle lies within what is wanted: at most half a record off. Records without
    source or tokens take no part; equal hashes are ordered by id; other columns are not read.

    Tokens are first summed by source and hash bucket; only the bucket in which the wanted tokens run out is
    sorted, so no source meets in one task.
    """
    a = allotments(sizes, targets, budget).where("wanted > 0")
    a = broadcast_if_bounded(a.withColumn("whole", F.expr("wanted div there")).withColumn("more", F.expr("wanted % there")), MAX_TARGETS, "allotments")
    docs = sizes.where("n_tokens > 0 and source is not null").select("source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("order"))
    docs = docs.withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(BUCKETS)).cast("int")).withColumn("order", F.struct("bucket", "order", "doc_id"))
    hist = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    # the bucket of each mix in which the fractional tokens run out
    last = hist.join(a.select("mix_name", "source", "more"), "source").where("before <= more and more < before + tokens").select("mix_name", "source", F.col("bucket").alias("last"), F.col("before").alias("start"))
    j = docs.join(a, "source").join(broadcast_if_bounded(last, MAX_TARGETS, "last buckets"), ["mix_name", "source"], "left")
    sure = j.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).withColumn("again", (F.col("bucket") < F.col("last")).cast("long"))
    order = Window.partitionBy("mix_name", "source").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = j.where(F.col("bucket") == F.col("last")).withColumn("sum", F.col("start") + F.sum("n_tokens").over(order))
    edge = edge.withColumn("again", ((F.col("sum") - F.col("n_tokens") / 2) <= F.col("more")).cast("long")).drop("sum")
    both = sure.unionByName(edge).withColumn("uses", F.least(F.col("max_repeats"), F.col("whole") + F.coalesce("again", F.lit(0))))
    return both.where("uses > 0").select("mix_name", "source", "doc_id", "n_tokens", "uses")


def shares(sizes: DataFrame, targets: DataFrame, budget: str | int = "once", seed: int = 42) -> DataFrame:
    """mix_name, source, target_share, wanted_share (after clamping), clamped, used_tokens and reached_share of every source of every mix."""
    used = uses(sizes, targets, budget, seed).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    t = allotments(sizes, targets, budget).select("mix_name", "source", "target_share", "wanted", "clamped").join(used, ["mix_name", "source"], "left").fillna(0, ["used_tokens"])
    mix = Window.partitionBy("mix_name")
    part = lambda c: F.when(F.sum(c).over(mix) > 0, F.col(c) / F.sum(c).over(mix)).otherwise(F.lit(0.0))
    return t.select("mix_name", "source", "target_share", part("wanted").alias("wanted_share"), "clamped", "used_tokens", part("used_tokens").alias("reached_share"))
