"""Order-dependent grouping as rounds of joins.

Greedy "first one in wins" loops are lexicographically-first independent sets: an item leads unless an earlier item it
conflicts with leads. Here the items of one round are decided together, from aggregates, so no group is ever collected
into one task and no group is ever expanded into all of its pairs:

* ``first_wins`` - two items conflict when they share a key (id or title). Each round needs one minimum per key.
* ``similar_leaders`` - two items conflict when their token sets are similar. Items with equal token sets are folded into
  one *signature* first, so copies cost one row; signatures are compared through their rarest tokens (prefix filter, exact
  for the thresholds). A pair meets at its rarest common token if that is in few items; pairs with frequent tokens alone in
  common meet at their rarest three of them together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv
from pressloom.session import cut_lineage


def first_wins(items: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Items kept by a loop that drops an item when an earlier kept one shares either of its two keys.

    ``order`` must be unique. Per round: the earliest undecided item of each key; one that is earliest under both of its
    keys is kept and closes both keys.
    """
    undecided = cut_lineage(items.select(F.col(order).alias("o"), F.col(key_a).alias("a"), F.col(key_b).alias("b")))
    kept = []
    while not undecided.isEmpty():
        by_a = undecided.groupBy("a").agg(F.min(F.struct("o", "b")).alias("m")).select("a", "m.o", "m.b")
        by_b = undecided.groupBy("b").agg(F.min("o").alias("o"))
        winners = cut_lineage(by_a.join(by_b, ["b", "o"]).select("o", "a", "b"))
        kept.append(winners.select(F.col("o").alias(order)))
        undecided = cut_lineage(
            undecided.join(winners.select("a"), "a", "left_anti").join(winners.select("b"), "b", "left_anti")
        )
    winners = reduce(DataFrame.unionByName, kept) if kept else undecided.select(F.col("o").alias(order))
    return items.join(winners, order, "left_semi")


@dataclass(frozen=True)
class Similarity:
    """When two token sets tell the same story, and which leader a follower joins."""

    min_shared: int = fv.SIMILAR_MIN_SHARED
    jaccard: float | None = fv.SIMILAR_JACCARD
    weight_share: float | None = None
    window_hours: int | None = None
    join_latest: bool = False


_TOLERANCE = 1e-9
#: Tokens in more items than this are frequent: no pair meets at one of them alone, so that meetings grow with the tokens and not with their square.
FREQUENT = 128
#: Frequent tokens that two sets must have in common to meet (at most ``min_shared``).
TOGETHER = 3
LOOSE = Similarity()
STRICT = Similarity(
    jaccard=None, weight_share=fv.STRICT_WEIGHT_SHARE, window_hours=fv.STRICT_WINDOW_HOURS, join_latest=True
)


def signatures(items: DataFrame, rule: Similarity) -> DataFrame:
    """One row per distinct token set: a number, tokens rarest first with their weights, how many are not frequent, and its two prefixes.

    Similar sets share ``least`` tokens or more, so the rarest shared one is in the ``index`` prefix of both. The smaller set
    needs more of its tokens, or a share of its weight, from there on: the shorter ``probe`` prefix.
    """
    sets = items.groupBy("sig").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    exploded = sets.select("sig", "n", F.explode("tokens").alias("term"))
    df = exploded.groupBy("term").agg(F.sum("n").alias("df"))
    total = items.agg(F.greatest(F.count(F.lit(1)), F.lit(2)).alias("total"))
    ranked = (
        exploded.join(df, "term")
        .groupBy("sig")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("ranked"))
        .crossJoin(F.broadcast(total))  # one row
    )
    weighted = ranked.select(
        "sig",
        F.transform("ranked", lambda r: r["term"]).alias("tokens"),
        F.transform("ranked", lambda r: F.log(F.col("total") / r["df"])).alias("weights"),
        F.size(F.filter("ranked", lambda r: r["df"] <= FREQUENT)).alias("rare"),
        F.monotonically_increasing_id().alias("n"),
    ).withColumn("weight", F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w))
    size = F.size("tokens")

    def prefix(least: Column) -> Column:
        return F.slice("tokens", F.lit(1), F.greatest(size - least + 1, F.lit(1)).cast("int"))

    out = weighted.withColumn("index", prefix(_least(rule, smaller=False)))
    if not rule.weight_share:
        return out.withColumn("probe", prefix(_least(rule, smaller=True))).withColumn("rank", size.cast("double"))
    ahead = F.aggregate(
        "weights",
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("used")),
        lambda acc, w: F.struct(
            (acc["n"] + F.when(F.col("weight") - acc["used"] >= rule.weight_share * F.col("weight") - _TOLERANCE, 1).otherwise(0)).alias("n"),
            (acc["used"] + w).alias("used"),
        ),
    )["n"]
    return out.withColumn("probe", F.slice("index", F.lit(1), F.greatest(ahead, F.lit(1)))).withColumn("rank", F.col("weight"))


def _least(rule: Similarity, smaller: bool) -> Column:
    """Tokens that a set shares at least with any larger (or smaller) similar one."""
    least = F.lit(rule.min_shared)
    if rule.jaccard:
        share = 2 * rule.jaccard / (1 + rule.jaccard) if smaller else rule.jaccard
        least = F.greatest(least, F.ceil(F.size("tokens") * F.lit(share) - _TOLERANCE).cast("int"))
    return least


def _fits(rule: Similarity) -> Column:
    """Is the first set the smaller one, and can the two be similar by their sizes?"""
    fits = F.struct("p_rank", "p_n") < F.struct("i_rank", "i_n")
    return fits & (F.col("p_rank") >= F.col("i_rank") * rule.jaccard - _TOLERANCE) if rule.jaccard else fits


def _sided(df: DataFrame, side: str, *more: Column) -> DataFrame:
    columns = ("n", "sig", "tokens", "rare", "rank", "weight") + (("weights",) if side == "p" else ())
    return df.select(*more, *[F.col(c).alias(f"{side}_{c}") for c in columns])


def _measured(met: DataFrame, rule: Similarity, once: Callable[[Column], Column]) -> DataFrame:
    """The similar pairs among those that met, where ``once`` holds of the common tokens. These are found once a pair, inside the generator."""
    zipped = F.arrays_zip("p_tokens", "p_weights")

    def measures(common: Column) -> Column:
        weighed = F.aggregate(F.filter(zipped, lambda z: F.array_contains(common, z["p_tokens"])), F.lit(0.0), lambda acc, z: acc + z["p_weights"])
        return F.struct(
            F.size(common).alias("shared"),
            (F.size("p_tokens") + F.size("i_tokens") - F.size(common)).alias("united"),
            F.when(once(common) & (F.size(common) >= rule.min_shared), weighed).alias("weight_shared"),
            F.least("p_weight", "i_weight").alias("weight_smaller"),
        )

    pair = F.transform(F.array(F.array_intersect("p_tokens", "i_tokens")), measures)
    return met.select(
        F.col("p_sig").alias("sig"), F.col("i_sig").alias("other"), F.inline(F.filter(pair, lambda r: r["weight_shared"].isNotNull() & _meets(rule, r)))
    )


def _at_one_token(sigs: DataFrame, rule: Similarity) -> DataFrame:
    """Similar pairs whose rarest common token is not frequent, each produced once, at that token."""

    def postings(prefix: str, side: str) -> DataFrame:
        return _sided(sigs, side, F.posexplode(F.slice(prefix, F.lit(1), F.col("rare"))).alias(f"{side}_at", "term"))

    met = postings("probe", "p").hint("merge").join(postings("index", "i"), "term").where(_fits(rule))
    sizes = F.size("p_tokens"), F.size("i_tokens")
    ahead = F.least(sizes[0] - F.col("p_at"), sizes[1] - F.col("i_at"))
    needed = (sizes[0] + sizes[1]) * (rule.jaccard / (1 + rule.jaccard)) - _TOLERANCE if rule.jaccard else F.lit(rule.min_shared)
    return _measured(met.where(ahead >= needed), rule, lambda common: F.try_element_at(common, F.lit(1)) == F.col("term"))


def _at_frequent_tokens(sigs: DataFrame, rule: Similarity) -> DataFrame:
    """Similar pairs with frequent tokens alone in common, each produced once.

    A set needs ``need`` common tokens among its frequent ones, so the rarest ``together`` of them are among all but its last
    ``need - together``. The rows that meet are numbers; tokens are joined to the pairs that met. They are asked to be merged:
    Spark does not know into how many rows a list of tokens is made.
    """
    together = min(TOGETHER, rule.min_shared)
    often = sigs.withColumn("often", F.slice("tokens", F.col("rare") + 1, F.size("tokens")))

    def postings(side: str) -> DataFrame:
        need = _least(rule, smaller=side == "p")
        if rule.weight_share and side == "p":
            enough = rule.weight_share * F.col("weight") - _TOLERANCE
            heaviest = F.aggregate(
                F.slice("weights", F.col("rare") + 1, F.size("tokens")),
                F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("got")),
                lambda acc, w: F.struct((acc["n"] + F.when(acc["got"] < enough, 1).otherwise(0)).alias("n"), (acc["got"] + w).alias("got")),
            )
            need = F.greatest(need, heaviest["n"] + F.when(heaviest["got"] < enough, 1).otherwise(0))
        spare = F.size("often") - need
        rows = often.select("n", "rank", F.when(spare >= 0, F.slice("often", F.lit(1), spare + together)).alias("rest"), F.lit(0).cast("long").alias("key"))
        for _ in range(together):
            rows = rows.select("n", "rank", "rest", "key", F.posexplode("rest").alias("at", "term")).select(
                "n", "rank", F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), F.xxhash64("key", "term").alias("key")
            )
        return rows.select("key", F.col("n").alias(f"{side}_n"), F.col("rank").alias(f"{side}_rank"))

    met = cut_lineage(postings("p").hint("merge").join(postings("i"), "key").where(_fits(rule)).select("p_n", "i_n").distinct())
    pairs = met.join(_sided(sigs, "p"), "p_n").join(_sided(sigs, "i"), "i_n")
    return _measured(pairs, rule, lambda common: F.array_position("p_tokens", F.try_element_at(common, F.lit(1))) > F.col("p_rare"))


def _directed(sigs: DataFrame, rule: Similarity) -> DataFrame:
    """Similar pairs whose first set is the smaller one, each once."""
    return _at_one_token(sigs, rule).unionByName(_at_frequent_tokens(sigs, rule))


def _mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("other").alias("sig"), F.col("sig").alias("other"), "shared", "united", "weight_shared", "weight_smaller")


def similar_pairs(sigs: DataFrame, rule: Similarity) -> DataFrame:
    """Similar pairs of distinct signatures, in both directions, and every signature with itself."""
    once = cut_lineage(_directed(sigs, rule))
    return once.unionByName(_mirrored(once)).unionByName(_self_pairs(sigs))


def _meets(rule: Similarity, pair: Column) -> Column:
    test = pair["shared"] >= rule.min_shared
    if rule.jaccard:
        test = test & (pair["shared"] / pair["united"] >= rule.jaccard)
    if rule.weight_share:
        test = test & (pair["weight_shared"] >= rule.weight_share * pair["weight_smaller"] - _TOLERANCE)
    return test


def _self_pairs(sigs: DataFrame) -> DataFrame:
    n = F.size("tokens")
    return sigs.select(
        "sig", F.col("sig").alias("other"), n.alias("shared"), n.alias("united"),
        F.col("weight").alias("weight_shared"), F.col("weight").alias("weight_smaller"),
    )


def _bucketed(items: DataFrame, rule: Similarity) -> DataFrame:
    """Time runs backwards: ``o`` is the position in the order, ``t`` the age axis in microseconds."""
    if rule.window_hours is None:
        return items.withColumn("bucket", F.lit(0))
    return items.withColumn("bucket", F.floor(F.col("t") / (rule.window_hours * 3_600_000_000)))


def _window_us(rule: Similarity) -> int:
    return (rule.window_hours or 0) * 3_600_000_000


def _covered(items: DataFrame, leaders: DataFrame, pairs: DataFrame, rule: Similarity) -> DataFrame:
    """Items that have an earlier similar leader inside the window (one summary row per signature and bucket)."""
    spread = pairs.join(leaders.select(F.col("sig"), "o", "t", "bucket"), "sig").select(F.col("other").alias("sig"), "o", "t", "bucket")
    same = spread.select("sig", "bucket", F.col("o").alias("same_o"), F.lit(None).cast("long").alias("next_t"))
    if rule.window_hours is not None:
        older = spread.select("sig", (F.col("bucket") + 1).alias("bucket"), F.lit(None).cast(same.schema["same_o"].dataType).alias("same_o"),
                              F.col("t").alias("next_t"))
        same = same.unionByName(older)
    reach = same.groupBy("sig", "bucket").agg(F.min("same_o").alias("same_o"), F.max("next_t").alias("next_t"))
    hit = (F.col("same_o") < F.col("o")) | (F.col("t") - F.col("next_t") <= _window_us(rule))
    return items.join(reach, ["sig", "bucket"]).where(hit).select("o")


def _decide(batch: DataFrame, pairs: DataFrame, rule: Similarity) -> DataFrame:
    """Leaders of a batch: rounds over one summary row per signature and time bucket, one written table per round."""
    undecided, found = batch, []
    while not undecided.isEmpty():
        summary = undecided.groupBy("sig", "bucket").agg(F.min(F.struct("o", "t")).alias("first"), F.max("t").alias("last_t"))
        summary = summary.select("sig", "bucket", "first.o", "first.t", "last_t")
        seen = pairs.join(summary.withColumnRenamed("sig", "other"), "other")
        rivals = seen.select("sig", "bucket", F.col("o").alias("same_o"), F.lit(None).cast("long").alias("next_t"))
        if rule.window_hours is not None:
            rivals = rivals.unionByName(
                seen.select("sig", (F.col("bucket") + 1).alias("bucket"), F.lit(None).cast(summary.schema["o"].dataType).alias("same_o"),
                            F.col("last_t").alias("next_t"))
            )
        rivals = rivals.groupBy("sig", "bucket").agg(F.min("same_o").alias("same_o"), F.max("next_t").alias("next_t"))
        blocked = (F.col("same_o") < F.col("o")) | (F.col("t") - F.col("next_t") <= _window_us(rule))
        leaders = (
            summary.join(rivals, ["sig", "bucket"], "left")
            .where(~F.coalesce(blocked, F.lit(False)))
            .select("sig", "bucket", "o", "t")
        )
        left = undecided.join(_covered(undecided, leaders, pairs, rule), "o", "left_anti")
        state = cut_lineage(left.join(leaders.select("o", F.lit(True).alias("leads")), "o", "left"))
        found.append(state.where(F.col("leads")).select("sig", "bucket", "o", "t"))
        undecided = state.where(F.col("leads").isNull()).drop("leads")
    return reduce(DataFrame.unionByName, found)


def similar_leaders(items: DataFrame, rule: Similarity = LOOSE) -> DataFrame:
    """``(id, leader, shared, united, weight_shared, weight_smaller)`` for every item with enough tokens.

    ``items``: id, ts, tokens (distinct). Order: newest first, then id. Leaders point at themselves.
    """
    prepared = (
        items.where(F.size("tokens") >= rule.min_shared)
        .withColumn("t", -F.unix_micros("ts"))
        .select("id", "t", F.struct("t", "id").alias("o"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("sig"), "tokens")
    )
    prepared = cut_lineage(_bucketed(prepared, rule))
    sigs = cut_lineage(signatures(prepared, rule))
    everything = prepared.drop("tokens", "id")
    pairs = similar_pairs(sigs, rule)
    leaders = _decide(everything, pairs, rule)
    return _assign(everything, leaders, pairs.join(leaders.select("sig").distinct(), "sig", "left_semi"), rule)


def _assign(items: DataFrame, leaders: DataFrame, pairs: DataFrame, rule: Similarity) -> DataFrame:
    """Each follower joins its earliest (or latest) similar leader; few leaders compete for one signature and bucket."""
    evidence = F.struct("shared", "united", "weight_shared", "weight_smaller").alias("evidence")
    spread = pairs.join(leaders.select("sig", F.col("o").alias("lead"), "bucket"), "sig").select(
        F.col("other").alias("sig"), "lead", "bucket", evidence
    )
    if rule.window_hours is not None:
        spread = spread.unionByName(spread.withColumn("bucket", F.col("bucket") + 1))
    near = F.col("lead") <= F.col("o")
    if rule.window_hours is not None:
        near = near & (F.col("t") - F.col("lead.t") <= _window_us(rule))
    choice = F.max(F.struct("lead", "evidence")) if rule.join_latest else F.min(F.struct("lead", "evidence"))
    matched = items.join(spread, ["sig", "bucket"]).where(near)
    own = matched.join(leaders.select("o"), "o", "left_semi").where(F.col("lead") == F.col("o"))
    others = matched.join(leaders.select("o"), "o", "left_anti")
    return (
        own.unionByName(others)
        .groupBy("o")
        .agg(choice.alias("best"))
        .select(F.col("o.id").alias("id"), F.col("best.lead.id").alias("leader"), "best.evidence.*")
    )
