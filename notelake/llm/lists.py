"""Components of a similarity graph whose candidate pairs are the pairs of common lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, connected_components, width

#: Members drawn from a list to meet the rest of it, on average, and rounds that draw.
PIVOTS, ROUNDS = 4, 5
#: A round that draws uses every so manieth list of a key, others each time.
STRIDE = 7
#: Pairs per posting that one round may look at without pivots.
EASY = 8
#: Share of the pairs that a round must settle, from the second on; where it settles fewer, what is left
#: are no groups of copies.
SETTLED = 0.25
#: Members of a block. Longer lists are compared block against block, each two blocks by themselves.
BLOCK = 256
#: Parts of the lists, by token, whose blocks are shuffled one after the other.
PARTS = 4
_GRAIN = 1 << 20


def clusters(posts: DataFrame, confirm: Callable[[DataFrame], DataFrame], scratch: Scratch, compatible: Column | bool = True, closeness: Column | None = None, rounds: int = ROUNDS, kind: tuple[str, ...] = ()) -> DataFrame | None:
    """``(key, component)`` of the linked keys of ``posts(token, key, place, ...)``; None without candidates.

    ``confirm`` takes ``pairs(a, b)`` and returns the linked ones as ``(src, dst)``. ``compatible`` is a
    condition that linked pairs meet and ``closeness`` an order of partners; both are written over the
    further columns of ``posts`` and the partner's, named with ``_b`` behind. They are evaluated inside
    the join, so pairs that fail are never rows. ``place`` numbers the lists of a key.

    In each round the members of a list meet a few drawn ones of it, and each key is confirmed with at
    most two of those it met: the closest and one that its neighbours choose too. Links merge keys into
    components, and lists whose members are one component are done. When few pairs of different
    components are left in common lists, when a round settled few of them, or after ``rounds`` rounds,
    all compatible ones of these are confirmed, each at the first of its common lists only. Where
    ``compatible`` does not say the same in every list, ``kind`` names the columns that it depends on, and
    a pair is met once in each kind of list. Left out are only pairs that are connected already, so the
    components are those of the full graph, while a group of near copies costs its size and not its square.
    """
    further = [c for c in posts.columns if c not in ("token", "key", "place")]
    total = posts.count()
    closeness = closeness if closeness is not None else F.lit(0)
    component, pairs_before = None, None
    for turn in range(rounds + 1):
        lists = posts.withColumn("label", F.col("key"))
        if component is not None:
            lists = posts.join(component, "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
        groups = lists.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token")
        mixed = groups.agg(F.count("*").alias("labels"), F.sum("c").alias("m"), ((F.sum("c") ** 2 - F.sum(F.col("c") ** 2)) / 2).alias("pairs"))
        mixed = scratch.save(mixed.filter("labels > 1").select("token", "m", "pairs"))
        pairs_left = mixed.agg(F.sum("pairs")).first()[0] or 0
        if not pairs_left:
            scratch.drop(mixed)
            break
        stuck = turn > 1 and pairs_left > (1 - SETTLED) * pairs_before
        last = turn == rounds or stuck or (turn > 0 and pairs_left <= EASY * total + 100_000)
        pairs_before = pairs_left
        used = lists if last else lists.filter(F.pmod(F.col("place") - 1, F.lit(STRIDE)) == turn % STRIDE)
        used = scratch.save(used.join(mixed.select("token", "m"), "token"))
        if last:
            bare, used = used, scratch.save(_with_lists_before(used, kind))
            scratch.drop(bare)
            pairs = _in_parts(used, further, compatible, scratch)
        else:
            drawn = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(_GRAIN)) * F.col("m") <= PIVOTS * _GRAIN
            other = _partners(used.filter(drawn), ["key", "label", *further])
            met = used.join(other, "token").filter((F.col("key") != F.col("key_b")) & (F.col("label") != F.col("label_b")) & compatible)
            near = met.groupBy("key").agg(F.max_by("key_b", closeness).alias("near"), F.min_by("key_b", F.xxhash64("key_b", F.lit(turn))).alias("common"))
            near = near.select("key", F.explode(F.array("near", "common")).alias("b"))
            pairs = near.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
        found = confirm(pairs.distinct())
        edges = scratch.save(found if component is None else found.union(component.filter("key != component")))
        following = scratch.save(connected_components(edges, scratch).select(F.col("node").alias("key"), "component"))
        for done in (mixed, used, edges, *([component] if component is not None else [])):
            scratch.drop(done)
        component = following
        if last:
            break
    return component


def _partners(posts: DataFrame, columns: list[str], by: tuple[str, ...] = ("token",)) -> DataFrame:
    return posts.select(*by, *(F.col(c).alias(f"{c}_b") for c in columns))


def _in_parts(used: DataFrame, further: list[str], compatible: Column | bool, scratch: Scratch) -> DataFrame:
    """The pairs of ``_pairs_of_blocks``, found for a part of the lists at a time: shuffle files of one part are there at once."""
    part = lambda i: used.filter(F.pmod(F.xxhash64("token"), F.lit(PARTS)) == i)
    pairs = [scratch.save(_pairs_of_blocks(part(i), further, compatible).distinct()) for i in range(PARTS)]
    return reduce(DataFrame.union, pairs)


def _pairs_of_blocks(used: DataFrame, further: list[str], compatible: Column | bool) -> DataFrame:
    """The compatible pairs of different labels in each list, at the first list they share.

    A list is dealt into blocks by the key's hash. Two blocks, or one and itself, are one unit of the
    join, so neither a long list nor few bytes put all comparisons into one task.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = used.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("blocks", blocks)
    unit, count = ["token", "i", "j"], width(used.sparkSession)
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own")))
    columns = ["key", "label", *further, "before"]
    left = left.select(*unit, *columns).repartition(count, *unit)
    right = _partners(right, columns, tuple(unit)).repartition(count, *unit)
    order = (F.col("i") < F.col("j")) | (F.col("key") < F.col("key_b"))
    met = left.join(right.hint("merge"), unit).filter(order & (F.col("label") != F.col("label_b")) & compatible)
    met = met.filter(~F.arrays_overlap("before", "before_b"))
    return met.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b"))


def _with_lists_before(used: DataFrame, kind: tuple[str, ...]) -> DataFrame:
    """Postings with the key's smaller lists of their kind, so that a pair can be left to the first list it shares.

    Keys of different labels share no list that is done, so the lists at hand are all they share.
    """
    own = used.groupBy("key", *kind).agg(F.collect_list("token").alias("lists"))
    return used.join(own, ["key", *kind]).withColumn("before", F.filter("lists", lambda other: other < F.col("token"))).drop("lists")
