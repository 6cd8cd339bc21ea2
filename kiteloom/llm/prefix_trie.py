"""The prefix trie of conversations: nodes, sizes and what sharing prefixes would save.

A node is a distinct sequence of first turns. Its owner is its smallest member, and a
conversation that owns a node owns all of its own deeper ones. So a conversation's owned
nodes are a chain at the end of its turns, and the trie is a tree of chains.

1. A running digest (two 64-bit lanes over place, role and text) names every prefix; the
   least conversation of each (depth, digest) is the table of minima.
2. The first owned depth of every conversation is found by binary search: a round joins
   one probe a conversation against the minima, and only turns between the bounds go on
   to the next round, so that all rounds together move about two tables of turns. The
   owner met at the last depth that isn't owned is the chain's parent, or the owner of
   the last node where nothing is owned.
3. Sums over subtrees (members, members' words, words, leaves) are taken chain by chain:
   the chains' own sums first, then those of attached chains by doubling (a chain's
   2^k-th ancestor takes over what the chain has gathered), in as many rounds as the
   depth of the tree of chains has bits, and last within each chain from its end.

With W(m) the words of a member's whole path, the saved tokens of a subtree are the sum
over its members of W(m) - W(parent), less the words of its nodes: sums again.

Defined results: rows without a conv_id take no part; a null role or text is empty; rows
of one turn are ordered by role and md5 of the text, repeated rows are turns of their own;
conversations without turns are members of the root only; no conversation, no rows. Texts
of any length are hashed and counted where they are read and go no further. A conversation
may have any number of turns and a prefix any number of members: ranks and running sums
go by blocks. Only the digest of the ids that end at one node is a stream in one task, as
SHA-256 is, over rows of up to ENDS ids. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import stage
from kiteloom.llm.ordered import rank_within, running

#: A conversation begins as the first of its group does: conversation c - c % GROUP.
GROUP = 20
#: Turns taken over: crc32 of the id modulo this.
SHARED = 4
#: Ids of conversations in one row of the digest's stream at most.
ENDS = 4096
WORD = "[^\\x20\\x09-\\x0D]+"
SUMS = ("members", "member_words", "words", "leaves")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (md5 of the text) and words of every row with a conv_id."""
    text = F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.md5(text).alias("body"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, len) and their turns (conv_id, len, depth from 1, role, body, words)."""
    # texts are read once: dealing by range looks at its input twice
    placed = rank_within(stage(rows, "trie-turns"), "conv_id", ["turn", "role", "body"], "place", "trie-places")
    own = stage(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-own")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    named = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "shared": shared})
    first = named.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    taken = F.least("shared", F.coalesce("there", F.lit(0).cast("long")))
    length = taken + F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    convs = stage(first.select("conv_id", "base", "shared", taken.alias("taken"), length.alias("len")), "trie-conversations")
    what = ["role", "body", "words"]
    starts = placed.filter((F.col("place") < SHARED - 1) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "place", *what)
    heads = convs.join(starts, "base").filter(F.col("place") < F.col("taken")).select("conv_id", "len", (F.col("place") + 1).alias("depth"), *what)
    tails = placed.join(convs, "conv_id").filter(F.col("place") >= F.col("shared")).select("conv_id", "len", (F.col("taken") + F.col("place") - F.col("shared") + 1).alias("depth"), *what)
    return convs.select("conv_id", "len"), heads.unionByName(tails)


def _search(convs: DataFrame, prefixes: DataFrame, root: int) -> DataFrame:
    """conv_id, len, first (least owned depth, len + 1 if none) and above (owner of the node over it; null for the root's owner)."""
    minima = stage(prefixes.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner")), "trie-minima")
    rounds = (convs.agg(F.max("len")).first()[0] or 0).bit_length()
    # a conversation's state: depth low isn't owned (by above instead), depth high is
    begin = {"low": F.lit(0).cast("long"), "high": F.col("len") + 1, "above": F.lit(root).cast("long")}
    active = prefixes.filter(F.col("conv_id") != root).select("conv_id", "depth", "p1", "p2", "len").withColumns(begin)
    found = convs.filter((F.col("len") == 0) & (F.col("conv_id") != root)).withColumns(begin).select("conv_id", "len", "high", "above")
    for k in range(rounds):
        mine = F.col("owner") == F.col("conv_id")
        probes = active.filter(F.col("depth") == F.floor((F.col("low") + F.col("high")) / 2)).join(minima, ["depth", "p1", "p2"])
        told = stage(
            probes.select(
                "conv_id", "len", F.when(mine, F.col("low")).otherwise(F.col("depth")).alias("low"),
                F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above"),
            ), f"trie-told{k}",
        )
        found = found.unionByName(told.filter("high - low = 1").select("conv_id", "len", "high", "above"))
        if k < rounds - 1:
            rest = active.drop("len", "low", "high", "above").join(told.filter("high - low > 1"), "conv_id")
            active = stage(rest.filter("depth > low AND depth < high"), f"trie-active{k}")
    top = convs.filter(F.col("conv_id") == root).select("conv_id", "len", F.lit(0).cast("long").alias("high"), F.lit(None).cast("long").alias("above"))
    return stage(found.unionByName(top).withColumnRenamed("high", "first"), "trie-chains")


def _attached(chains: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """By the node that chains hang from: their number ``hung`` and what they sum up to."""
    return chains.filter("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"), *[F.sum(s).alias(f"hung_{s}") for s in sums])


def _gathered(chains: DataFrame) -> DataFrame:
    """``chains`` with SUMS over all chains below, by doubling."""
    state, k = chains.withColumn("up", F.col("above")), 0
    while not (state := stage(state, f"trie-sums{k}")).filter("up IS NOT NULL").isEmpty():
        given = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(s).alias(f"given_{s}") for s in SUMS])
        further = state.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        more = {s: F.col(s) + F.coalesce(f"given_{s}", F.lit(0)) for s in SUMS}
        state = state.join(given, "conv_id", "left").withColumns(more).join(further, "up", "left").select("conv_id", "first", "above", *SUMS, F.col("further").alias("up"))
        k += 1
    return state.drop("up")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the joined ids of each node, whose rows follow each other in order."""
    at, digest = None, None

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["conv_id", "depth", "ends_sha256"])

    for b in batches:
        done = []
        for conv, depth, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (conv, depth):
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield batch(done)
    yield batch([(*at, digest.hexdigest())] if at is not None else [])


def _end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of every node at which conversations (``member``) end."""
    part = F.floor(F.col("member") / ENDS)  # ids are distinct, so a part has ENDS of them at most
    packed = ends.groupBy("conv_id", "depth", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))
    laid = packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return laid.select("conv_id", "depth", "ids").mapInArrow(_stream, "conv_id long, depth long, ends_sha256 string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def nodes(conversations: DataFrame) -> DataFrame:
    """NODES: one row a node of the trie."""
    convs, built = rebuilt(turns(conversations))
    root = convs.agg(F.min("conv_id")).first()[0]
    if root is None:
        return conversations.sparkSession.createDataFrame([], NODES)
    lanes = {"p1": ("bit_xor", F.xxhash64("depth", "role", "body")), "p2": ("bit_xor", F.xxhash64(F.lit(1), "body", "depth", "role")), "path_words": ("sum", F.col("words"))}
    based = built.select("conv_id", "len", "depth", "role", "body", "words", (F.col("depth") - 1).alias("place"))
    prefixes = stage(running(based, "conv_id", "place", lanes).drop("role", "body", "place"), "trie-prefixes")
    chains = _search(convs, prefixes, root)

    owned = chains.filter("first <= len")
    ends = chains.select(F.when(F.col("first") <= F.col("len"), F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("len").alias("depth"), F.col("conv_id").alias("member"))
    here = ends.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("ending"))
    own = prefixes.join(owned.select("conv_id", "first", "above"), "conv_id").filter("depth >= first").select("conv_id", "len", "first", "above", "depth", "words", "path_words")
    zero = F.lit(0).cast("long")
    top = owned.filter("first = 0").select("conv_id", "len", "first", "above", zero.alias("depth"), zero.alias("words"), zero.alias("path_words"))
    hung = _attached(owned, ())
    ending = F.coalesce("ending", zero)
    local = stage(
        own.unionByName(top).join(here, ["conv_id", "depth"], "left").join(hung, ["conv_id", "depth"], "left").select(
            "conv_id", "len", "first", "above", "depth", "path_words", "words", ending.alias("members"), (ending * F.col("path_words")).alias("member_words"),
            ((F.col("depth") == F.col("len")) & F.col("hung").isNull()).cast("long").alias("leaves"),
        ), "trie-nodes",
    )
    sums = _gathered(local.groupBy("conv_id", "first", "above").agg(*[F.sum(s).alias(s) for s in SUMS]))
    full = local.join(_attached(sums, SUMS), ["conv_id", "depth"], "left")
    totals = {f"all_{s}": ("sum", F.col(s) + F.coalesce(f"hung_{s}", zero)) for s in SUMS}
    summed = running(full, "conv_id", "depth", totals, back=True)
    saved = F.col("all_member_words") - F.col("all_members") * (F.col("path_words") - F.col("words")) - F.col("all_words")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above"))
    return summed.join(_end_digests(ends), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.col("all_members").alias("n_convs"),
        (F.coalesce("hung", zero) + (F.col("depth") < F.col("len")).cast("long")).alias("n_children"), F.col("all_leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
