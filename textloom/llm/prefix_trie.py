"""Conversation prefix trie: nodes by hash prefix sums, an Euler tour of enter and leave arcs, distributed list ranking."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read_table

FAMILY, LENT = 5, 9            # conversation c begins with up to crc32(c) % LENT turns of conversation c - c % FAMILY
BITS = 52                      # of each of the two lanes of a prefix hash
BLOCK = 1 << 10                # turns of a conversation summed in one group: 2^10 lanes of 2^52 fit a long
BASE = 4096                    # elements of a contracted list that one task follows by itself
HOT = 1000                     # a parent with more than 1/HOT of all nodes as children is joined by broadcast: at most HOT rows
CHUNK = 1 << 16                # characters of a list of ids that are passed on as one row
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)``: ``conv_id, pos, a, b, size`` of every turn, and ``conv_id, n`` of every conversation.

    ``a, b`` are two hashes of (role, text), ``size`` the UTF-8 bytes of the text: no text is shuffled. Turns are dealt by ranges
    of (conversation, turn, hashes, row), so one conversation, one turn number or one repeated row may hold any share of the
    table; they are numbered within a range, and each piece of a conversation starts behind the earlier pieces' counts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"), F.octet_length(text).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("turn"), F.asc("a"), F.asc("b"), F.asc("row")]
    rows = scratch.write(rows.repartitionByRange(F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    pieces = rows.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("part", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    turns = rows.withColumn("pos", within).join(starts, ["part", "conv_id"]).select(
        "part", "conv_id", (F.col("start") + F.col("pos")).alias("pos"), "a", "b", "size")
    return turns, pieces


def rebuilt(conversations: DataFrame, scratch: Scratch, family: int = FAMILY, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """``(rows, empty)``: ``conv_id, depth, a, b, size, last`` of every rebuilt turn, and ``conv_id`` of turnless conversations.

    A conversation's share is joined to its pieces (one row per range and conversation), never to its turns by id alone.
    """
    turns, pieces = numbered_turns(conversations, scratch)
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    of = convs.select(F.col("conv_id").alias("root"), F.col("n").alias("root_n"))
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lent if lent else F.lit(0).cast("long")
    convs = scratch.write(
        convs.withColumn("root", F.col("conv_id") - F.col("conv_id") % family).join(of, "root", "left")
        .withColumn("h", share).withColumn("m", F.least("h", F.coalesce("root_n", F.lit(0)))).drop("root_n"), "convs")
    known = pieces.select("part", "conv_id").join(convs.select("conv_id", "n", "h", "m"), "conv_id")
    turns = scratch.write(turns.join(known, ["part", "conv_id"]).drop("part"), "ranked")
    heads = (turns.where(F.col("pos") < max(1, lent)).groupBy(F.col("conv_id").alias("root"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("head")))
    borrowed = (convs.where("m > 0").join(heads, "root")
                .select("conv_id", "n", "h", "m", F.explode(F.slice("head", 1, F.col("m").cast("int"))).alias("t"))
                .select("conv_id", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.size",
                        ((F.col("n") <= F.col("h")) & (F.col("t.pos") == F.col("m"))).alias("last")))
    own = turns.where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "size",
                                        (F.col("pos") == F.col("n")).alias("last"))
    return borrowed.unionByName(own), convs.where("m = 0 and n <= h").select("conv_id")


def lanes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, size, last``, the prefix hash ``h1, h2`` and that of the parent, ``p1, p2``.

    The hash of the first d turns is the sum of a hash of (place, turn) over them, modulo 2^52 in each lane: sums over blocks of
    ``BLOCK`` turns, each moved by the sum of the blocks before it, so that a conversation of any length is no single group.
    """
    mask = F.lit((1 << BITS) - 1)
    rows = (rows.withColumn("t1", F.xxhash64(F.lit(3), "depth", "a", "b").bitwiseAND(mask))
            .withColumn("t2", F.xxhash64(F.lit(4), "b", "a", "depth").bitwiseAND(mask))
            .withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)))
    totals = rows.groupBy("conv_id", "block").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = [F.pmod(F.sum(F.col(s).cast("decimal(38,0)")).over(earlier), F.lit(1 << BITS).cast("decimal(38,0)"))
             .cast("long").alias(f"o{s[1]}") for s in ("s1", "s2")]
    starts = totals.select("conv_id", "block", *moved).where("block > 0")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s1", F.sum("t1").over(so_far)).withColumn("s2", F.sum("t2").over(so_far))
    rows = rows.join(starts, ["conv_id", "block"], "left")
    for i in "12":
        full = F.col(f"s{i}") + F.coalesce(f"o{i}", F.lit(0).cast("long"))
        rows = rows.withColumn(f"h{i}", full.bitwiseAND(mask))
        rows = rows.withColumn(f"p{i}", (F.col(f"h{i}") - F.col(f"t{i}")).bitwiseAND(mask))
    return rows.select("conv_id", "depth", "size", "last", "h1", "h2", "p1", "p2")


KEY = ["depth", "h1", "h2"]


def id_digests(ends: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends_sha256``: SHA-256 of the comma-joined ascending ids of each node in ``ends``.

    Ids are sorted by ranges and joined to texts of up to ``CHUNK`` characters there; only these texts meet in one task per
    node, which feeds them to the digest one after another (the digest itself is sequential) and holds one at a time.
    """
    def chunks(batches):
        key, own, size, number = None, [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k], pa.int64()) for k in key), pa.array([number], pa.int64()), pa.array([",".join(own)])],
                names=[*KEY, "number", "ids"])

        for batch in batches:
            for *k, c in zip(*(batch[x].to_pylist() for x in (*KEY, "conv_id"))):
                if own and (k != key or size > CHUNK):
                    yield out()
                    number, own, size = number + 1, [], 0
                key = k
                own.append(str(c))
                size += len(own[-1]) + 1
        if own:
            yield out()

    def digests(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for *k, ids in zip(*(batch[x].to_pylist() for x in (*KEY, "ids"))):
                if k != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield table(done)
        if key is not None:
            yield table([(*key, state.hexdigest())])

    def table(done):
        *k, d = zip(*done)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in k), pa.array(d)], names=[*KEY, "ends_sha256"])

    kinds = "depth long, h1 long, h2 long"
    order = [*KEY, "conv_id"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        chunks, f"{kinds}, number long, ids string").withColumn("part", F.spark_partition_id())
    return (texts.repartition(*KEY).sortWithinPartitions(*KEY, "part", "number").select(*KEY, "ids")
            .mapInArrow(digests, f"{kinds}, ends_sha256 string"))


def trie_nodes(rows: DataFrame, empty: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct prefix: ``id``, its key, its parent's key, ``conv_id`` (smallest member), members, bytes, digest."""
    members = scratch.write(lanes(rows), "members")
    nodes = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    every = members.where("depth = 1").select("conv_id").unionByName(empty)
    zero = F.lit(0).cast("long")
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(k) for k in KEY), "conv_id", "n_convs", *(zero.alias(c) for c in ("size", "p1", "p2")))
    ends = members.where("last").select(*KEY, "conv_id").unionByName(empty.select(*(zero.alias(k) for k in KEY), "conv_id"))
    nodes = nodes.unionByName(root).join(id_digests(ends), KEY, "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return scratch.write(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def with_parents(nodes: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(families, parents)``: ``id, parent, parent_conv_id`` of every node but the root, and ``id, n_children``.

    Parents of more than ``n / HOT`` children are at most ``HOT`` rows and are broadcast; only the other children are dealt by
    their parent.
    """
    child = nodes.where("depth > 0").select("id", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    parents = scratch.write(
        nodes.select(*KEY, F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(
            child.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")), KEY), "parents")
    hot = F.col("n_children") > n / HOT
    far = parents.where(hot).drop("n_children")
    marked = child.join(F.broadcast(far), KEY, "left")
    near = marked.where("parent is null").drop("parent", "parent_conv_id").join(parents.where(~hot).drop("n_children"), KEY)
    families = marked.where("parent is not null").unionByName(near).select("id", "parent", "parent_conv_id")
    return scratch.write(families, "families"), parents.select(F.col("parent").alias("id"), "n_children")


def tour_arcs(nodes: DataFrame, families: DataFrame, n: int) -> DataFrame:
    """``id, nxt, w0, w1, w2``: the Euler tour as a linked list; arc 2 v enters node v, arc 2 v + 1 leaves it.

    A node's children follow one another by (salt, id): within a salt by a window, from salt to salt by one row each, so the
    children of one parent are never one group. Weights: 1, whether the arc enters a leaf, and the node's own savings.
    """
    salts = max(1, math.isqrt(n))
    salted = families.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    after = salted.select("id", F.lead("id").over(Window.partitionBy("parent", "salt").orderBy("id")).alias("then")).where("then is not null")
    group = salted.groupBy("parent", "salt").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    by_salt = Window.partitionBy("parent").orderBy("salt")
    group = group.select("parent", "low", "high", F.lead("low").over(by_salt).alias("then"), F.row_number().over(by_salt).alias("k"))
    none = F.lit(None).cast("long")
    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    links = (after.select(leave("id").alias("id"), enter("then").alias("nxt"), none.alias("saved"))
             .unionByName(group.select(leave("high").alias("id"), F.coalesce(enter("then"), leave("parent")).alias("nxt"), none.alias("saved")))
             .unionByName(group.where("k = 1").select(enter("parent").alias("id"), enter("low").alias("nxt"), none.alias("saved")))
             .unionByName(nodes.select(enter("id").alias("id"), none.alias("nxt"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
             .unionByName(nodes.select(leave("id").alias("id"), none.alias("nxt"), F.lit(0).cast("long").alias("saved"))))
    arcs = links.groupBy("id").agg(F.max("nxt").alias("nxt"), F.max("saved").alias("w2"))
    leaf = (F.col("id") % 2 == 0) & F.col("nxt").isNull()
    return arcs.select("id", F.when(leaf, F.col("id") + 1).otherwise(F.col("nxt")).alias("nxt"), F.lit(1).cast("long").alias("w0"),
                       leaf.cast("long").alias("w1"), "w2")


W = ("w0", "w1", "w2")


def list_rank(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, s0, s1, s2``: for every element of a linked list ``id, nxt, w0, w1, w2``, the sums of the weights before it.

    Contraction and expansion: in each round the elements whose hash exceeds both neighbours' leave the list (a third of
    them; no two are neighbours), and their predecessor takes over their weight and successor, in one exchange by element.
    At ``BASE`` elements one task follows the list; then the rounds are undone from the last to the first, each element
    standing behind its predecessor's weight of that round. All rounds together move a few times the list. Each round is a
    written table, so a lost executor repeats at most one round.
    """
    back = links.where("nxt is not null").select(F.col("nxt").alias("id"), F.col("id").alias("prv"))
    none = F.lit(None).cast("long")
    both = links.withColumn("prv", none).unionByName(back.select("id", "prv", none.alias("nxt"), *(none.alias(w) for w in W)))
    now = scratch.write(both.groupBy("id").agg(*(F.max(c).alias(c) for c in ("nxt", "prv", *W))), "round-0")
    rounds, count = 0, now.count()
    while count > BASE:
        now = scratch.write(contracted(now, rounds), f"round-{rounds + 1}")
        rounds, count = rounds + 1, now.count()
    levels = [scratch.write(followed(now), "start-base")]
    for r in range(rounds, 0, -1):
        gone = scratch.tables[f"round-{r}"].where("gone is not null").select("gone", "id", *(f"g{i}" for i in range(3)))
        known = levels[0]
        for level in levels[1:]:
            known = known.unionByName(level)
        start = gone.join(known, "id").select(F.col("gone").alias("id"), *((F.col(f"s{i}") + F.col(f"g{i}")).alias(f"s{i}") for i in range(3)))
        levels.append(scratch.write(start, f"start-{r}"))
    scratch.drop(*(f"round-{r}" for r in range(rounds + 1)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def contracted(now: DataFrame, number: int) -> DataFrame:
    """The list without the elements of this round; ``gone``: the element that left behind ``id``, ``g0..g2``: the weight before it."""
    draw = lambda c: F.xxhash64(F.lit(number), c)
    leaves = F.coalesce((draw("id") > draw("prv")) & (draw("id") > draw("nxt")) & F.col("prv").isNotNull()
                        & F.col("nxt").isNotNull(), F.lit(False))
    none = F.lit(None).cast("long")

    def message(to: Column, **has):
        names = ("nxt", "prv", *W, "new_nxt", "new_prv", "a0", "a1", "a2")
        return F.struct(to.alias("id"), *(has.get(c, none).alias(c) for c in names))

    stay = message(F.col("id"), nxt=F.col("nxt"), prv=F.col("prv"), **{w: F.col(w) for w in W})
    to_prv = message(F.col("prv"), new_nxt=F.col("nxt"), **{f"a{i}": F.col(w) for i, w in enumerate(W)})
    to_nxt = message(F.col("nxt"), new_prv=F.col("prv"))
    told = now.select(F.explode(F.when(leaves, F.array(to_prv, to_nxt)).otherwise(F.array(stay))).alias("m")).select("m.*")
    got = told.groupBy("id").agg(*(F.max(c).alias(c) for c in told.columns if c != "id"))
    moved = F.col("new_nxt").isNotNull()
    zero = F.lit(0).cast("long")
    return got.select("id", F.coalesce("new_nxt", "nxt").alias("nxt"), F.coalesce("new_prv", "prv").alias("prv"),
                      *((F.col(w) + F.coalesce(f"a{i}", zero)).alias(w) for i, w in enumerate(W)),
                      F.when(moved, F.col("nxt")).alias("gone"), *(F.when(moved, F.col(w)).alias(f"g{i}") for i, w in enumerate(W)))


def followed(now: DataFrame) -> DataFrame:
    """The sums of a list of at most ``BASE`` elements, from its head to its tail."""
    def run(batches):
        rows = {i: (nxt, prv, w) for b in batches for i, nxt, prv, *w in zip(*(b[c].to_pylist() for c in ("id", "nxt", "prv", *W)))}
        at, total, out = next((i for i, r in rows.items() if r[1] is None), None), [0, 0, 0], []
        while at is not None:
            out.append((at, *total))
            at, _, w = rows[at]
            total = [x + y for x, y in zip(total, w)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "s0", "s1", "s2"])

    return now.select("id", "nxt", "prv", *W).coalesce(1).mapInArrow(run, "id long, s0 long, s1 long, s2 long")


def conversation_trie(conversations: DataFrame, scratch: Scratch, family: int = FAMILY, lent: int = LENT) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations (``lent=0``: of the conversations as they are).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` as the query's contract says, and
    ``id, parent`` (arbitrary numbers that tell nodes of equal conv_id apart).

    Nulls: rows with a null ``conv_id`` belong to no conversation; a null turn comes first; a null role or text is empty.
    Turns of equal number (ties, repeated rows) are ordered by a hash of role and text. An empty table has no node, not even
    a root. Conversations and texts may be of any length; other columns are not read, whatever their names. Nodes are
    told apart by their depth and a hash of 104 bits.
    """
    rows, empty = rebuilt(conversations, scratch, family, lent)
    nodes = trie_nodes(rows, empty, scratch)
    n = nodes.count()
    families, children = with_parents(nodes, n, scratch)
    starts = list_rank(tour_arcs(nodes, families, n), scratch)
    side = lambda c, leave: F.max(F.when(F.col("id") % 2 == leave, F.col(c)))
    sums = starts.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(
        (side("s1", 1) - side("s1", 0)).alias("n_leaves"), (side("s2", 1) - side("s2", 0)).alias("saved_tokens"))
    return (nodes.join(sums, "id").join(families, "id", "left").join(children, "id", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                    "n_leaves", "saved_tokens", "ends_sha256", "id", "parent"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie(read_table(spark, sf_dir, "conversations"), Scratch(spark, "trie"))
    return trie.drop("id", "parent")
