"""Connected components of a link graph that is known only through buckets of candidates.

Two nodes are linked if they share a bucket and a check confirms them.  Components of all
such links are found without listing the pairs of a bucket, in a fixed number of steps:

1. Each bucket names its most central member, the one that shares the most buckets with the most
   others, and the centre is checked against all other members.  A group of copies around
   one text merges at once, since its text is the centre of all its buckets; a bucket of two is settled.
2. In buckets of up to ``PAIRWISE`` members that still span several components every pair of members of different
   components is checked, which is at most PAIRWISE / 2 pairs a member.
3. Larger ones get step 1 again with other centres, ``ROUNDS`` times in all.  What is left, as groups just below the
   threshold leave it, is cut into blocks of bounded size, and pairs of blocks are
   compared as a whole where they lie: only links come out, no more than a spanning forest of the two blocks' components.
   Members of the component that is most common in a group are compared with the others only.
4. Components of all links are computed once, over what the rounds haven't merged.

So no link between components is lost, a group of n copies costs about n checks, and no group's pairs are written
out.  Buckets are never gathered: they are sums by key and joins on the key, whose skew Spark splits.  In a group of
n members that lie just below the threshold each member's payload is sent to n / BLOCK_MEMBERS tasks.

Tables between the steps are written to the shared folder and deleted when they are used up.  Steps, not rows, are
what costs the driver memory (each leaves records of its plan, stages and tasks), so there are few of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, keep, slices

ROUNDS, SMALL, PAIRWISE = 2, 500_000, 64
#: Members of a block on average, and the sum of their sizes.
BLOCK_MEMBERS, BLOCK_SIZE = 768, 1_500_000


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links`` (a, b); the label is the smallest node of the component.

    Labels sink along links and each node also takes its label's label, so a component of
    diameter d needs about log d rounds.  Each round is written to the shared folder."""
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node").withColumn("was", F.col("node")))
    while True:
        own = labels.select("node", "label")
        near = both.join(own, both["b"] == own["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        sunk = own.join(near, own["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("above"))
        jumped = keep(sunk.join(up, sunk["label"] == up["n"], "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "was"))
        drop(labels)
        labels = jumped
        if labels.filter("was <> label").isEmpty():
            drop(both)
            return labels.select("node", "label")


def _mapped(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links between the labels of their ends, without those inside a component."""
    if labels is None:
        return links.select("a", "b")
    one, two = (labels.select(F.col("node").alias(n), F.col("label").alias(x)) for n, x in (("na", "la"), ("nb", "lb")))
    return links.join(one, F.col("a") == F.col("na"), "left").join(two, F.col("b") == F.col("nb"), "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b")


def _relabel(labels: DataFrame | None, to: DataFrame) -> DataFrame:
    """Labels after those of ``to`` (node, label) have moved."""
    if labels is None:
        return keep(to.select("node", "label"))
    step = to.select(F.col("node").alias("n"), F.col("label").alias("to"))
    moved = labels.join(step, labels["label"] == step["n"], "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = to.select("node", "label").join(labels.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
    return keep(moved.unionByName(fresh))


def _hooked(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after each component has joined the smallest one at most two links away: that merges stars whole.
    Longer chains merge in part, which costs further checks but loses nothing: links are kept until the end."""
    found = _mapped(links, labels)
    both = keep(found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return labels
    once = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "n")
    twice = both.join(once, F.col("b") == F.col("n")).groupBy("a").agg(F.least(F.min("low"), F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    new = _relabel(labels, twice)
    drop(both, *([labels] if labels is not None else []))
    return new


def among(df: DataFrame, column: str, keys: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``column`` is in the first column of ``keys`` (distinct, kept), with its columns ``more``.  The keys are counted:
    up to SMALL of them, a few longs each, are broadcast, so that ``df`` isn't dealt out; beyond, both sides are dealt by key."""
    few = keys.count() <= SMALL
    own = keys.select(F.col(keys.columns[0]).alias("among_key"), *more)
    found = df.join(F.broadcast(own) if few else own, F.col(column) == F.col("among_key"), "inner" if more else "left_semi")
    return found.drop("among_key")


def _forest(nodes: list, labels: list, pairs) -> list[tuple]:
    """Of pairs of positions those that join components so far apart."""
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """``(key, node, label, size)`` of large buckets (key, node, label, size, centre), those with the same centre as one group where
    that makes fewer pairs: a group of near copies fills a bucket in each band with much the same members."""
    apart = rows.groupBy("centre", "key").agg(F.count("*").cast("double").alias("m")).groupBy("centre").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    whole = rows.select("centre", "node").distinct().groupBy("centre").agg(F.count("*").cast("double").alias("m"))
    better = keep(apart.join(whole, "centre").filter(F.col("m") * F.col("m") <= F.col("apart")).select(F.col("centre").alias("u")))
    named = rows.join(better, F.col("centre") == F.col("u"), "left").withColumn("key", F.when(F.col("u").isNull(), F.xxhash64("key", F.lit(0))).otherwise(F.xxhash64("u", F.lit(1))))
    return keep(named.select("key", "node", "label", "size").distinct())


def compare_blocks(rows: DataFrame, pool: DataFrame, prepare: Callable, linked: Callable) -> DataFrame:
    """Links (a, b) between members of different components in large groups.

    ``rows``: (key, node, label, size).  ``pool`` has (node, payload), ``prepare`` makes
    an object of a payload in a worker, and ``linked`` takes two lists of those (the same list twice: each pair within)
    and yields the positions of linked pairs."""
    sums = rows.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("size").alias("s")).groupBy("key").agg(F.max(F.struct("m", "label", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK_MEMBERS, s / BLOCK_SIZE)).cast("int")
    parts = sums.select(F.col("key").alias("k"), F.col("top.label").alias("common"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("others"), blocks(F.col("top.m"), F.col("top.s")).alias("commons"))
    # blocks of the others come first; those of the most common component follow and meet the others' only
    is_common, salt = F.col("label") == F.col("common"), F.xxhash64("node", F.lit("block"))
    own = F.when(is_common, F.col("others") + F.pmod(salt, F.col("commons"))).otherwise(F.pmod(salt, F.greatest(F.col("others"), F.lit(1)))).cast("int")
    dealt = rows.join(parts, F.col("key") == F.col("k")).filter("others > 0").withColumn("own", own)
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_common, F.col("others")).otherwise(F.col("others") + F.col("commons")) - 1)))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "label")
    full = spread.join(pool.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("key", "low", "high", "own", "node", "label", "payload")
    sorted_ = full.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def group_links(group, members):
        low, high = group[1:]
        one, two = ([m for m in members if m[0] == own] for own in (low, high))
        if low == high:
            found = linked([m[3] for m in one], None)
            pairs, both = found, one
        else:
            pairs, both = ((i, len(one) + j) for i, j in linked([m[3] for m in one], [m[3] for m in two])), one + two
        return _forest([m[1] for m in both], [m[2] for m in both], pairs)

    def run(batches):
        import pyarrow as pa

        group, members = None, []

        def out(links):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in slices(batch):
                for key, low, high, own, node, label, payload in zip(*(part.column(i).to_pylist() for i in range(7))):
                    if (key, low, high) != group:
                        if members:
                            yield out(group_links(group, members))
                        group, members = (key, low, high), []
                    members.append((own, node, label, prepare(payload)))
        if members:
            yield out(group_links(group, members))

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def resolve(entries: DataFrame, payloads: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame, DataFrame], DataFrame], prepare: Callable, linked: Callable, counts: str = "", fits: str = "true", known: DataFrame | None = None) -> DataFrame | None:
    """``(node, label)`` of all nodes that have a link, or None if there is no link; labels are the components' smallest nodes.

    ``entries``: (key, node, size) and flags for ``fits``, a condition on a pair that any link meets (columns of its two members end
    in _a and _b).  Repeated entries are allowed; a flag is set if one of them has it.  Where ``counts`` names a flag, a bucket without an entry that has it has no links.  ``payloads`` gives (node, payload)
    of the nodes it is asked for; ``confirm`` takes pairs (a, b), a < b, distinct, and that table, and returns those that are
    links; ``prepare`` and ``linked`` do the same for whole blocks, as in ``compare_blocks``.  ``known``: links (a, b) that need no check."""
    extra = [c for c in entries.columns if c not in ("key", "node")]
    # a row a key is all that the largest shuffle has: whether an entry counts is told by the sign of the least node
    node = F.when(F.expr(counts), F.col("node").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("node").bitwiseAND(F.lit(2**63 - 1))) if counts else F.col("node")
    spread = entries.groupBy("key").agg(F.min(node).alias("low"), F.max(node).alias("high"))
    keys = keep(spread.filter("low < high AND low < 0" if counts else "low < high").select("key"))
    flags = [c for c in extra if c != "size"]
    found = among(entries, "key", keys).groupBy("key", "node", "size")
    shared = keep(found.agg(*(F.max(c).alias(c) for c in flags)) if flags else found.agg(F.lit(0).alias("_")).drop("_"))
    sizes = keep(shared.groupBy("key").agg(F.count("*").alias("entries")).filter("entries > 1"))
    counted = keep(among(shared, "key", sizes, ("entries",)))
    central = keep(counted.groupBy("node").agg(F.sum("entries").alias("weight")))
    pool = payloads(central.select("node"))
    rows = keep(counted.join(central.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).drop("n"))
    drop(keys, shared, sizes, counted, central)
    labels: DataFrame | None = None
    links: list[DataFrame] = [keep(known)] if known is not None else []

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        own = labels.withColumnRenamed("node", "labelled_node")
        return rows.join(own, F.col("node") == F.col("labelled_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("labelled_node")

    def member(rows: DataFrame, end: str) -> DataFrame:
        return rows.select("key", *(F.col(c).alias(c + end) for c in ("node", "label", *extra)))

    def checked(pairs: DataFrame) -> DataFrame:
        found = keep(confirm(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), pool).select("a", "b"))
        links.append(found)
        return found

    def stars(rows: DataFrame, order: list) -> DataFrame:
        """Links of each bucket's first member in ``order`` with the others."""
        first = F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), "node", "label", *extra)).alias("c")
        centres = rows.groupBy("key").agg(first).select("key", *(F.col(f"c.{c}").alias(c + "_a") for c in ("node", "label", *extra)))
        return checked(member(rows, "_b").join(centres, "key").filter("label_a <> label_b").filter(fits))

    by_weight = [-F.col("weight"), F.col("node")]
    labels = _hooked(labels, stars(labelled(rows), by_weight))

    def unsettled(rows: DataFrame, more: int) -> DataFrame:
        """Rows of buckets of more than that many members and several components, with their labels, the members and the first centre."""
        own = keep(labelled(rows.filter(f"entries > {more}")))
        mixed = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.min(F.struct(-F.col("weight"), "node")).alias("c"))
        mixed = keep(mixed.filter(f"low < high AND members > {more}").select(F.col("key").alias("mixed_key"), "members", F.col("c.node").alias("centre")))
        found = keep(among(own, "key", mixed, ("members", "centre")))
        drop(own, mixed)
        return found

    rest = unsettled(rows, 2)
    drop(rows)
    large = rest.filter(f"members > {PAIRWISE}")
    if not large.isEmpty():
        dense = large
        for turn in range(ROUNDS - 1):
            alone = (F.col("label") != F.col("node")).cast("int")
            order = [alone, *by_weight] if turn == 0 else [alone, F.xxhash64("node", F.lit(turn)), F.col("node")]
            labels = _hooked(labels, stars(dense, order))
            before, dense = dense, unsettled(dense.drop("members", "centre", "label"), PAIRWISE)
            drop(before)
        if not dense.isEmpty():
            groups = _groups(dense)
            links.append(keep(compare_blocks(groups, pool, prepare, linked)))
            drop(groups)
            labels = _hooked(labels, links[-1])
        drop(dense)
    few = keep(labelled(rest.filter(f"members <= {PAIRWISE} AND node <> centre").drop("label")))
    checked(member(few, "_a").join(member(few, "_b"), "key").filter("node_a < node_b AND label_a <> label_b").filter(fits))
    left = keep(_mapped(reduce(DataFrame.union, links), labels).distinct())
    if not left.isEmpty():
        merged = components(left)
        old, labels = labels, _relabel(labels, merged)
        drop(merged, *([old] if old is not None else []))
    drop(left, few, rest, pool, *links)
    return labels
