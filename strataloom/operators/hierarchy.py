"""Parent–child rows to full hierarchies by heavy-path decomposition.

Pointer doubling gives, in a number of rounds logarithmic in the depth, every node's root,
depth and subtree size and separates the cycles. Each node's heaviest child continues its
chain; a path from the root crosses few chains (at most log2 of the tree's size), so paths are
joined from chain segments, and the descendants of a node are one interval of the preorder in
which the heavy child comes first. Every step is a join or an aggregation by key; nothing is
gathered by tree, and lineage is cut by reliable checkpoints after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataloom.session import cut_lineage, drop_table

#: Buckets of siblings: the window that numbers them never spans more than this many rows, or one bucket.
SIBLING_BUCKETS = 1024


def _edges(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row per id; a parent that is no id counts as none. Of differing copies the smallest parent holds."""
    nodes = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(parent_col).cast("long")).alias("parent"))
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(ids, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _climb(edges: DataFrame) -> DataFrame:
    """id, parent, ptr, far, depth, low, size after enough rounds of doubling.

    After k rounds: ptr is the 2**k-th ancestor or null, far the highest ancestor within
    2**k - 1 steps and depth the steps to it, low the smallest id among those, size the number of
    nodes at most 2**k - 1 levels below, with the node itself. It ends when a round finishes no
    node (a chain has nodes of every depth, so nothing but cycles is left), the pointers of the
    unfinished nodes cover as many nodes as before (they cover exactly the cycles) and no `low`
    changed.
    """
    state = cut_lineage(edges.select("id", "parent", F.col("parent").alias("ptr"), F.col("id").alias("far"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("low"), F.lit(1).cast("long").alias("size")))
    state_before, step, n, covered = state, 1, None, None
    while True:
        active = state.where("ptr is not null")
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("u_ptr"), F.col("far").alias("u_far"), F.col("depth").alias("u_depth"), F.col("low").alias("u_low"))
        below = active.groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
        moved = active.join(up, "ptr").select(
            "id", "parent", F.col("u_ptr").alias("ptr"), F.col("u_far").alias("far"), (F.lit(step) + F.col("u_depth")).alias("depth"), F.least("low", "u_low").alias("low"), "size", (F.col("u_low") < F.col("low")).alias("lower")
        )
        state = (
            state.where("ptr is null").withColumn("lower", F.lit(False)).unionByName(moved)
            .join(below, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        )
        seen_by, old = Observation(), state_before
        state = state_before = cut_lineage(state, seen_by, n=F.count_if(F.col("ptr").isNotNull()), lower=F.count_if("lower"))
        drop_table(old)
        step *= 2
        now = seen_by.get
        if now["n"] == 0:
            return state.drop("lower")
        image = state.where("ptr is not null").select("ptr").distinct().count() if now["n"] == n else None
        if image is not None and image == covered and not now["lower"]:
            return state.drop("lower")
        n, covered = now["n"], image


def _chains(forest: DataFrame) -> DataFrame:
    """id, head, pos: the chain of each node (named by its top node) and its place in it."""
    heavy = forest.where("parent is not null").groupBy("parent").agg(F.max(F.struct(F.col("size"), (-F.col("id")).alias("neg"))).alias("best"))
    heavy = heavy.select((-F.col("best.neg")).alias("id"), F.lit(True).alias("is_heavy"))
    state = forest.join(heavy, "id", "left").select("id", F.when(F.col("is_heavy"), F.col("parent")).alias("ptr"), F.col("id").alias("head"), F.lit(0).cast("long").alias("pos"))
    open_ends = {"n": F.count_if(F.col("ptr").isNotNull())}
    seen_by, step = Observation(), 1
    state = cut_lineage(state, seen_by, **open_ends)
    while seen_by.get["n"]:
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("u_ptr"), F.col("head").alias("u_head"), F.col("pos").alias("u_pos"))
        moved = state.where("ptr is not null").join(up, "ptr").select("id", F.col("u_ptr").alias("ptr"), F.col("u_head").alias("head"), (F.lit(step) + F.col("u_pos")).alias("pos"))
        seen_by, old = Observation(), state
        state = cut_lineage(state.where("ptr is null").unionByName(moved), seen_by, **open_ends)
        drop_table(old)
        step *= 2
    return state.drop("ptr")


def _chain_prefixes(forest: DataFrame, place: DataFrame, arrays: DataFrame) -> DataFrame:
    """head, prefix: the path from the root to just above each chain, by doubling over the chains."""
    heads = place.where("pos = 0").select("head").join(forest.select(F.col("id").alias("head"), "parent"), "head")
    at = place.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"))
    light = heads.join(at, "parent", "left").join(arrays.select(F.col("head").alias("up"), F.col("ids").alias("up_ids")), "up", "left")
    seen_by, open_ends = Observation(), {"n": F.count_if(F.col("up").isNotNull())}
    state = cut_lineage(light.select("head", "up", F.when(F.col("up").isNotNull(), F.array_join(F.slice("up_ids", F.lit(1), F.col("at").cast("int") + 1), "/")).otherwise("").alias("prefix")), seen_by, **open_ends)
    while seen_by.get["n"]:
        above = state.select(F.col("head").alias("up"), F.col("up").alias("u_up"), F.col("prefix").alias("u_prefix"))
        moved = state.where("up is not null").join(above, "up").select("head", F.col("u_up").alias("up"), F.concat_ws("/", F.when(F.col("u_prefix") != "", F.col("u_prefix")), "prefix").alias("prefix"))
        seen_by, old = Observation(), state
        state = cut_lineage(state.where("up is null").unionByName(moved), seen_by, **open_ends)
        drop_table(old)
    return state.drop("up")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """id, status, root_id, depth, n_desc, id_path of every id.

    status is `tree`, `cycle` (the node lies on a cycle; its own parent is one) or `below_cycle`.
    In a tree, depth counts from 0 at the root and id_path joins the ids from the root by `/`;
    otherwise root_id is the smallest id on the cycle, depth -1 and id_path empty. n_desc counts
    the other nodes that are reached by going down. Rows without id are left out, repeated rows
    count once (of differing parents the smallest holds), a parent that is no id makes a root, and
    an empty table gives an empty result.
    """
    climbed = _climb(_edges(df, id_col, parent_col))
    stuck = climbed.where("ptr is not null")
    on_cycle = stuck.select(F.col("ptr").alias("id")).distinct()
    rings = stuck.join(on_cycle, "id").select("id", F.col("low").alias("ring"))
    lost = stuck.join(rings.select(F.col("id").alias("ptr"), "ring"), "ptr").join(rings.select("id", F.lit(True).alias("ringed")), "id", "left")
    members = lost.groupBy("ring").agg((F.count("*") - 1).alias("others"))
    lost = lost.join(members, "ring").select(
        "id", F.when(F.col("ringed"), "cycle").otherwise("below_cycle").alias("status"), F.col("ring").alias("root_id"), F.lit(-1).cast("long").alias("depth"),
        F.when(F.col("ringed"), F.col("others")).otherwise(F.col("size") - 1).alias("n_desc"), F.lit("").alias("id_path"),
    )
    trees = climbed.where("ptr is null").select("id", "parent", F.col("far").alias("root_id"), "depth", "size")
    place = _chains(trees)
    arrays = place.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    prefixes = _chain_prefixes(trees, place, arrays)
    segment = F.array_join(F.slice("ids", F.lit(1), F.col("pos").cast("int") + 1), "/")
    paths = place.join(prefixes.join(arrays, "head"), "head").select("id", F.concat_ws("/", F.when(F.col("prefix") != "", F.col("prefix")), segment).alias("id_path"))
    found = trees.join(paths, "id").select("id", F.lit("tree").alias("status"), "root_id", "depth", (F.col("size") - 1).alias("n_desc"), "id_path")
    return found.unionByName(lost)


def chain_intervals(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """id, root_id, pre, last: in its tree the descendants of a node are the nodes with pre < x.pre <= last.

    Nodes on or below cycles have no interval and are left out; `hierarchy` reports them.
    """
    trees = _climb(_edges(df, id_col, parent_col)).where("ptr is null").select("id", "parent", F.col("far").alias("root_id"), "size")
    place = _chains(trees)
    # Place among siblings: the heavy child (which heads no chain) first, then by bucket and id. Two short windows instead of one over all siblings.
    kids = trees.where("parent is not null").join(place.select("id", F.col("pos")), "id").withColumn("bucket", F.when(F.col("pos") > 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS))))
    totals = kids.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy("parent").orderBy("bucket")) - F.col("total")).drop("total")
    inside = kids.withColumn("inside", F.sum("size").over(Window.partitionBy("parent", "bucket").orderBy("id")) - F.col("size"))
    offset = inside.join(before, ["parent", "bucket"]).where("pos = 0").select(F.col("id").alias("head"), "parent", (F.col("before") + F.col("inside") + 1).alias("offset"))
    at = place.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"))
    state = place.where("pos = 0").select("head").join(offset, "head", "left").join(at, "parent", "left")
    seen_by, open_ends = Observation(), {"n": F.count_if(F.col("up").isNotNull())}
    state = cut_lineage(state.select("head", "up", (F.coalesce("offset", F.lit(0)) + F.coalesce("at", F.lit(0))).alias("pre")), seen_by, **open_ends)
    while seen_by.get["n"]:
        above = state.select(F.col("head").alias("up"), F.col("up").alias("u_up"), F.col("pre").alias("u_pre"))
        moved = state.where("up is not null").join(above, "up").select("head", F.col("u_up").alias("up"), (F.col("pre") + F.col("u_pre")).alias("pre"))
        seen_by, old = Observation(), state
        state = cut_lineage(state.where("up is null").unionByName(moved), seen_by, **open_ends)
        drop_table(old)
    return (
        place.join(state.drop("up"), "head").join(trees.select("id", "root_id", "size"), "id")
        .select("id", "root_id", (F.col("pre") + F.col("pos")).alias("pre"), (F.col("pre") + F.col("pos") + F.col("size") - 1).alias("last"))
    )
