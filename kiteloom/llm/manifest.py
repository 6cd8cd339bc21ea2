"""A Merkle manifest of a dataset: bottom-up build, top-down proof push.

Every row is a leaf. Per lang, leaves in order of doc_id are hashed in runs of two, level
by level, to a subroot; subroots in order of lang likewise give the root.

Levels are persisted in bands: a table has a row for each run of 2^LEVELS nodes with that
run's digests on every level of the band, and its top is a node of the next band. So a
tree of any size is built by an exchange of 32 nodes' worth a level at the bottom and
next to nothing above. Proofs are pushed down again: a run joins its parent's table by
its place there and takes over the inherited suffix, and each child prepends its own
siblings. A proof is held only by the row that it belongs to, never shuffled for leaves.

Defined results: a null or absent lang is a tree of its own that comes first; null
doc_ids come first in their tree and are never tampered with; rows of one doc_id are
ordered by leaf, and equal rows are leaves of their own with equal digests but their own
places; an empty text counts 0 bytes; a text of any length is hashed in one pass where
it is read and goes no further. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import stage
from kiteloom.llm.ordered import rank_within

LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _item(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and tampered (the leaf as found again, where it was tampered with)."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    items = {c: _item(F.col(c)) for c in FIELDS}
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _sha(*items.values()).alias("h"),
        F.when(touched, _sha(*(items | {"n_chars": _item(more)}).values())).alias("tampered"),
    )


def _folded(start: Column, levels: Column) -> Column:
    """The digests of ``levels`` levels above ``start``, with ``start`` first."""

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
        return F.transform(runs, lambda i: _sha(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))))

    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(start), lambda held, _: F.concat(held, F.array(above(F.element_at(held, -1)))))


def build(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The bands of a forest, bottom first, and (tree, h) of every tree's top.

    ``nodes``: tree, pos (from 0, dense within a tree), h and any columns to carry.
    """
    sizes = stage(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{label}-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 1
    carried = [c for c in nodes.columns if c not in ("tree", "pos")]
    bands, width = [], 1
    while True:
        n = F.ceil(F.col("n") / width).cast("long")
        levels = F.when(n > 1, F.least(F.lit(LEVELS), F.length(F.bin(n - 1)))).otherwise(F.lit(0))
        runs = nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", *carried))).alias("items"))
        held = runs.join(sizes, "tree").select("tree", "run", "items", _folded(F.col("items.h"), levels).alias("levels"))
        bands.append(stage(held, f"{label}-band{len(bands)}"))
        nodes, carried, width = bands[-1].select("tree", F.col("run").alias("pos"), F.element_at("levels", -1)[0].alias("h")), ["h"], width << LEVELS
        if width >= most:
            return bands, nodes.select("tree", "h")


def _siblings(place: Column) -> Column:
    """Of the node at ``place`` of a run: on each level of the band "L" or "R" and its sibling, or "" if it has none."""

    def one(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        return F.coalesce(F.concat(F.when(at % 2 == 0, "R").otherwise("L"), F.get(level, at.bitwiseXOR(F.lit(1)))), F.lit(""))

    return F.transform(F.slice("levels", 1, F.size("levels") - 1), one)


def push(bands: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """Every node of the lowest band with its proof's steps and its tree's ``inherited`` columns.

    ``inherited``: tree, steps (of the tree's top up to the root) and more columns.
    """
    also = [c for c in inherited.columns if c not in ("tree", "steps")]
    above = inherited.withColumn("run", F.lit(0).cast("long"))
    for band in reversed(bands):
        opened = band.join(above, ["tree", "run"]).select("tree", "levels", "steps", *also, F.posexplode("items").alias("place", "item"))
        steps = F.concat(_siblings(F.col("place")), "steps").alias("steps")
        above = opened.select("tree", F.col("item.pos").alias("run"), steps, *also, "item")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    # texts are read once: dealing by range looks at its input twice
    ordered = rank_within(stage(leaves(docs), "manifest-hashed"), "tree", ["doc_id", "h"], "pos", "manifest-leaves")
    bands, subroots = build(ordered, "manifest")
    named = subroots.withColumn("forest", F.lit("")).withColumnRenamed("tree", "name")
    placed = rank_within(named, "forest", ["name"], "pos", "manifest-subroots").select(F.col("forest").alias("tree"), "pos", "h", "name")
    upper, root = build(placed, "manifest-root")
    top = root.select("tree", F.array().cast("array<string>").alias("steps"), F.col("h").alias("root"))
    trees = push(upper, top).select(F.col("item.name").alias("tree"), "steps", F.col("item.h").alias("subroot"), "root")
    rows = push(bands, stage(trees, "manifest-trees"))

    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.substring(s, 2, 64))), 256)
    join = lambda h, s: _sha(F.when(s.startswith("L"), F.substring(s, 2, 64)).otherwise(""), h, F.when(s.startswith("R"), F.substring(s, 2, 64)).otherwise(""))
    folded = F.aggregate("steps", F.coalesce("item.tampered", "item.h"), join)
    found = rows.select(F.col("item.doc_id").alias("doc_id"), F.col("item.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
