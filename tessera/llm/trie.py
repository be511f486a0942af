"""Prefix trie of conversations by partition refinement.

A node is a distinct sequence of the first d turns (role and text) of a conversation; its
members are the conversations that start with it. All start in one class, the root. A class
is split by its members' next turns; a class of one member is retired, and what is left of
its conversation is emitted as a unary chain without being compared or shuffled again. What
each node holds is then folded back towards the root.

*Turns.* A turn is known by SHA-256 of role and text, so texts never reach a shuffle. A
prefix is known by the exclusive or of 128 bits of each of its turns with its place, a sum
that runs along the conversation, so a class and the turn that splits it make one key.

*Rounds.* Round r splits by the turns of depth 2**r - 1 to 2**(r+1) - 2, twice as many as
the round before, and reads just those of conversations that are still active: at the end
of the round before, they shared their class with others and had turns left. So rounds grow
with the logarithm of the longest shared prefix. Classes are counted by aggregation, so one
that holds most conversations is summed up where its rows are; active conversations are
found by a join on the class, where adaptive execution splits such a class.

*Folding.* The smallest member stands for a node, and from some depth on for all nodes of
its own path. Leaves and savings are put down where a conversation stands for the node, summed
along each conversation from its end, and then over the members of each node: every node
below is put down by exactly one member. So no step goes depth by depth.

*Ends.* The list of the conversations that end at a node is hashed as a stream: ids are joined
by 4,096 consecutive numbers at a time, and these pieces in order. No list is held whole.

A conversation is numbered by a window, streamed and spilled by Spark; no array of its turns is made.

Defined results: null role or text is empty, a null turn comes first, turns of equal number
are ordered by the hash of role and text. Rows without conv_id take no part. Conversations
without turns (after ``spliced``) are members of the root alone. Repeated rows are repeated
turns. An empty table has no node, not even the root. Extra columns are ignored. Ids may be
negative; ``%`` has the sign of the id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Ids of so many consecutive numbers (a power of two: its exponent) are joined at once.
RUN_BITS = 12
#: Rows of a chain that one row is first expanded to.
STEP = 4096


def numbered(conversations: DataFrame, *keep: str) -> DataFrame:
    """(conv_id, pos, mark, bytes): turns numbered from 1, the hash of role and text, and the text's UTF-8 bytes; then the columns ``keep``."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    mark = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"), *keep)
    place = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "mark")
    return rows.withColumn("pos", F.row_number().over(place).cast("long")).select("conv_id", "pos", "mark", "bytes", *keep)


def rooted(rows: DataFrame) -> DataFrame:
    """rows of ``numbered`` with a row of place 0 for each conversation."""
    start = rows.where("pos = 1").select("conv_id", F.lit(0).cast("long").alias("pos"))
    return rows.unionByName(start, allowMissingColumns=True)


def spliced(rows: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of c - c % family, then its own from h on; h = crc32(c) % (most + 1).

    rows are those of ``numbered``; so is what is returned, rooted, with gaps in the places.
    """
    rows = Scratch(rows.sparkSession).table(rows)
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    own = rows.where(F.col("pos") > h).withColumn("pos", F.col("pos") + most)
    all_ = rows.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = rows.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    heads = heads.join(all_, "base").where(F.col("pos") <= F.col("h")).select(*rows.columns)
    start = all_.select("conv_id", F.lit(0).cast("long").alias("pos"))
    return own.unionByName(heads).unionByName(start, allowMissingColumns=True)


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, p1, p2, q1, q2, ends, round): the key of each prefix and of the one before."""
    along = W.partitionBy("conv_id").orderBy("pos")
    out = rows.withColumns({"depth": F.row_number().over(along).cast("long") - 1, "ends": F.lead(F.lit(True)).over(along).isNull()})
    turn = {"x1": F.xxhash64("mark", "depth"), "x2": F.xxhash64("depth", "mark")}
    out = out.withColumns({k: F.when(F.col("depth") > 0, v).otherwise(F.lit(0)) for k, v in turn.items()})
    out = out.withColumns({f"p{k}": F.bit_xor(f"x{k}").over(along.rowsBetween(W.unboundedPreceding, 0)) for k in (1, 2)})
    before = [F.when(F.col("depth") > 0, F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}"))).alias(f"q{k}") for k in (1, 2)]
    return out.select("conv_id", "depth", F.coalesce("bytes", F.lit(0)).alias("bytes"), "p1", "p2", *before, "ends", (F.length(F.bin(F.col("depth") + 1)) - 1).alias("round"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order, joined by commas."""
    node, digest = None, None
    names = ["depth", "p1", "p2", "ends_sha256"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    for b in batches:
        done = []
        for *key, ids in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("depth", "p1", "p2", "ids")), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield out(done)
    if node is not None:
        yield out([(*node, digest.hexdigest())])


def _end_hashes(rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes at which conversations end."""
    run = F.shiftright("conv_id", RUN_BITS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = rows.where("ends").groupBy("depth", "p1", "p2", run.alias("run")).agg(ids.alias("ids"))
    pieces = pieces.repartition("depth", "p1", "p2").sortWithinPartitions("depth", "p1", "p2", "run").select("depth", "p1", "p2", "ids")
    return pieces.mapInArrow(_streamed, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of rooted rows (conv_id, pos, mark, bytes)."""
    scratch = Scratch(rows.sparkSession)
    turns = scratch.table(_prefixes(rows.select("conv_id", "pos", "mark", "bytes")), by="round")
    key, none = ["depth", "p1", "p2"], F.lit(hashlib.sha256(b"").hexdigest())

    # split class by class; who is alone in its class or at its end leaves
    shared, nodes, active = [], [], []
    for r in range(64):
        of = turns.where(F.col("round") == r)
        if active:
            of = of.join(active[-1], "conv_id", "left_semi")
        classes = scratch.table(of.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2")))
        shared.append(of)
        nodes.append(classes)
        last = 2 ** (r + 1) - 2
        several = classes.where((F.col("depth") == last) & (F.col("n_convs") > 1)).select("p1", "p2")
        going = scratch.table(of.where((F.col("depth") == last) & ~F.col("ends")).join(several, ["p1", "p2"], "left_semi").select("conv_id"))
        if going.isEmpty():
            break
        active.append(going)
    both = lambda frames: frames[0] if len(frames) == 1 else both(frames[: len(frames) // 2]).unionByName(both(frames[len(frames) // 2 :]))
    members, nodes = both(shared), both(nodes)

    # tails of retired conversations: from the depth after their last round to their end
    ends = turns.where("ends").select("conv_id", F.col("depth").alias("last"), "round")
    if active:
        until = both([a.withColumn("until", F.lit(r + 1)) for r, a in enumerate(active)]).groupBy("conv_id").agg(F.max("until").alias("until"))
        ends = ends.join(until, "conv_id", "left")
    else:
        ends = ends.withColumn("until", F.lit(0))
    until = F.coalesce("until", F.lit(0))
    tails = scratch.table(ends.where(F.col("round") > until).select("conv_id", F.expr("shiftleft(2L, coalesce(until, 0)) - 1").alias("start"), "last"))

    # parents and children
    up = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    nodes = scratch.table(nodes.join(up, ["depth", "q1", "q2"], "left").drop("q1", "q2"))
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    hung = tails.select("conv_id", (F.col("start") - 1).alias("depth"), F.lit(1).alias("hung"))
    nodes = scratch.table(nodes.join(kids, ["conv_id", "depth"], "left").join(hung, ["conv_id", "depth"], "left").fillna(0, ["kids", "hung"]))

    # fold back
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), (F.col("kids") == 0).cast("long").alias("leaf"))
    from_end = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    sums = members.select("conv_id", *key).join(own, ["conv_id", "depth"], "left").select(*key, F.sum("own").over(from_end).alias("own"), F.sum("leaf").over(from_end).alias("leaf"))
    sums = sums.groupBy(*key).agg(F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    out = nodes.join(sums, key).join(_end_hashes(members), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("kids") + F.col("hung")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )

    chain = tails.withColumn("at", F.explode(F.expr(f"sequence(start, last, {STEP}L)"))).withColumn("depth", F.explode(F.expr(f"sequence(at, least(at + {STEP - 1}, last))")))
    at_end = F.col("depth") == F.col("last")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = chain.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(at_end, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return out.unionByName(chain)


def with_turns(nodes: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """nodes with the named columns (role, text, ...) of their last turn: each distinct prefix's turn once. rows: those that ``prefix_trie`` was given, with the columns."""
    depth = F.row_number().over(W.partitionBy("conv_id").orderBy("pos")).cast("long") - 1
    return nodes.join(rows.select("conv_id", depth.alias("depth"), *columns), ["conv_id", "depth"])
