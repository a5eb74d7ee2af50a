"""Merkle manifest of a dataset by a cogrouped exchange of subtrees.

Documents are leaves, in one tree per language; the roots of these trees are the leaves
of one more tree. A tree is cut into superblocks of 512 consecutive nodes, which are
whole subtrees of three levels:

1. Up: each superblock is reduced to its root by itself. These roots are the next layer,
   which is cut and reduced in turn until every tree has one node left.
2. Down: each superblock is cogrouped with its own row of the layer above, which carries
   the siblings outside the superblock (the required outer nodes). One ``applyInPandas``
   repeats the local reduction, joins local and outer siblings into proofs and, at the
   leaves, folds every proof.

A superblock holds at most 512 rows whatever the size of its tree, and an outer path seven
digests for each level, so no language is too large. A layer has 1/512 of the rows of
the one below.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.text import quoted
from tabkit.operators.ranking import with_position
from tabkit.session import stage

ARITY = 8
#: Levels of a superblock.
HEIGHT = 3
BLOCK = ARITY**HEIGHT

TREE = ["known", "lang"]
NODES = "known int, lang string, pos long, n long, digest string"
PATHS = "known int, lang string, pos long, path array<string>, subroot string, root string"
#: Ids travel as text, as pandas would make doubles of a column with nulls.
PROVED = (
    "doc_id string, lang string, leaf string, subroot string, root string, proof array<string>, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def height(n: int) -> int:
    """Levels that one superblock of a tree of ``n`` nodes is reduced by."""
    levels = 0
    while n > 1 and levels < HEIGHT:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def reduced(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes to its root."""
    levels = [digests]
    for _ in range(height(n)):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def sibling_paths(levels: list[list[str]], outer: list[str]) -> list[list[str]]:
    """For each node of the lowest level its siblings, as text left and text right of it
    for each level up to the root."""
    paths = [outer]
    for level in reversed(levels[:-1]):
        below = []
        for i in range(len(level)):
            start = i - i % ARITY
            run = level[start : start + ARITY]
            below.append(["".join(run[: i - start]), "".join(run[i - start + 1 :]), *paths[i // ARITY]])
        paths = below
    return paths


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """Layers ``(known, lang, pos, n, digest)`` up to one node a tree; ``n`` counts the
    nodes of the tree in that layer."""

    def up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        top = reduced(block.sort_values("pos")["digest"].tolist(), n)[-1][0]
        return pd.DataFrame({"known": [key[0]], "lang": [key[1]], "pos": [key[2]], "n": [max(1, -(-n // BLOCK))], "digest": [top]})

    layers = [nodes]
    while (layers[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        blocks = layers[-1].select(*TREE, "pos", "n", "digest").groupBy(*TREE, (F.col("pos") / BLOCK).cast("long").alias("block"))
        layers.append(stage(blocks.applyInPandas(up, NODES), "subtrees"))
    return layers


def _down(nodes: DataFrame, paths: DataFrame, finish, schema: str) -> DataFrame:
    """Cogroup the superblocks of a layer with their rows of the layer above."""

    def meet(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        levels = reduced(block["digest"].tolist(), int(block["n"].iloc[0]))
        outer = above.iloc[0]
        return finish(block, outer, sibling_paths(levels, list(outer["path"])))

    left = nodes.groupBy(*TREE, (F.col("pos") / BLOCK).cast("long").alias("block"))
    right = paths.groupBy(*TREE, F.col("pos").alias("block"))
    return left.cogroup(right).applyInPandas(meet, schema)


def _inner(block: pd.DataFrame, outer: pd.Series, paths: list[list[str]]) -> pd.DataFrame:
    made = block[["known", "lang", "pos"]].assign(path=paths)
    return made.assign(subroot=outer["subroot"], root=outer["root"])


def _at_leaves(with_proof: bool):
    def finish(block: pd.DataFrame, outer: pd.Series, paths: list[list[str]]) -> pd.DataFrame:
        root = outer["root"]
        claims = [c if isinstance(c, str) else d for c, d in zip(block["claim"], block["digest"])]
        roots = [folded(c, p) for c, p in zip(claims, paths)]
        return pd.DataFrame(
            {
                "doc_id": block["doc_id"].tolist(),
                "lang": [lang if known else None for known, lang in zip(block["known"], block["lang"])],
                "leaf": block["digest"].tolist(),
                "subroot": outer["subroot"],
                "root": root,
                "proof": paths if with_proof else [None] * len(paths),
                "proof_sha256": [digest("".join(p)) for p in paths],
                "folded_root": roots,
                "verified": [r == root for r in roots],
            }
        )

    return finish


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    tree_col: str = "lang",
    claims: dict[str, Column] | None = None,
    claimed: Column | None = None,
    with_proof: bool = False,
) -> DataFrame:
    """``(doc_id, lang, leaf, subroot, root, proof, proof_sha256, folded_root, verified)``
    for every row.

    A leaf digests the given fields: each ``-`` if null, else its byte count, ``:`` and
    its value. Leaves of one ``tree_col`` value (null is a tree of its own, before all
    others) ascend by id, null first, rows of one id by leaf; equal rows are leaves of
    their own. ``proof`` lists the siblings, as the digests left and right of the path for
    each level (null unless ``with_proof``); ``proof_sha256`` digests them one after another.

    ``claims`` replaces fields by expressions over ``docs`` in the rows where ``claimed``
    holds: what somebody presents as this document. Their leaf is folded instead of the
    true one, with the true siblings, and ``verified`` tells whether the root came out.
    Extra columns are ignored; an empty table gives no rows.
    """
    held = [docs[quoted(c)] for c in fields]
    claim = F.lit(None).cast("string")
    if claims:
        presented = leaf_digest([claims.get(c, docs[quoted(c)]) for c in fields])
        claim = F.when(F.lit(True) if claimed is None else claimed, presented)
    tree = docs[quoted(tree_col)].cast("string")
    leaves = docs.select(
        tree.isNotNull().cast("int").alias("known"),
        F.coalesce(tree, F.lit("")).alias("lang"),
        docs[quoted(id_col)].cast("long").alias("doc_id"),
        leaf_digest(held).alias("digest"),
        claim.alias("claim"),
    )
    # Staged, as the texts would be digested once more to draw the limits of the slices.
    leaves = _placed(stage(leaves, "leaves"), TREE, ["doc_id", "digest"])
    layers = _layers(stage(leaves, "placed"))

    # The roots of the trees are the nodes of one more tree, whose key is constant.
    tops = stage(_placed(layers[-1].select(*TREE, "digest"), [], TREE), "subroots")
    one = [F.lit(0).alias("known"), F.lit("").alias("lang")]
    above = _layers(tops.select(*one, "pos", "n", "digest"))
    empty = F.array().cast("array<string>")
    paths = above[-1].select(*TREE, "pos", empty.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    paths = reduce(lambda p, nodes: _down(nodes, p, _inner, PATHS), reversed(above[:-1]), paths)

    # Back to the trees: the one node of a tree's last layer has the path of its root.
    roots = tops.select(*TREE, F.col("pos").alias("at"), F.col("digest").alias("subroot"))
    paths = stage(
        paths.select(F.col("pos").alias("at"), "path", "root")
        .join(roots, "at")
        .select(*TREE, F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"),
        "outer-paths",
    )
    for nodes in reversed(layers[1:-1]):
        paths = stage(_down(nodes, paths, _inner, PATHS), "outer-paths")
    named = layers[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    proved = _down(named, paths, _at_leaves(with_proof), PROVED)
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def _placed(rows: DataFrame, by: list[str], order_by: list[str]) -> DataFrame:
    """With 0-based ``pos`` and size ``n`` in each tree."""
    placed = with_position(rows, by, order_by, "at", "n")
    return placed.withColumn("pos", F.col("at") - 1).drop("at")
