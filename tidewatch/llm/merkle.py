"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; leaves of a group (``lang``) ascend by id and are reduced pairwise to the group's subroot, subroots by group
name to the root. A node is the SHA-256 hex of its children's hex digests; a last run of one node is hashed as well.

Leaf digests are made by Spark's own functions; from then on rows are narrow. A leaf's place in its group comes from a
range-partitioned sort and counts by (partition, group), so no task holds a group. Aligned runs of 2^height leaves are superblocks:
no pair crosses them below that height. On the way up each superblock is reduced by itself and its root is a node of the next,
2^height times smaller table, until one node is left; the subroots of all groups form one more such tree. On the way down nodes
and the outer nodes above their superblock (siblings on the way to the root, some 40 digests) are cogrouped by superblock in
applyInPandas, which reduces the superblock, joins inner and outer siblings to proofs, and folds each leaf up to the root. A task
sees 2^height rows of one superblock at a time. Both ways take one step for each table, so 10^12 leaves take four.

Nulls are ``-`` in a leaf; a null group is a group, the first one; null ids come first in their group, rows of equal id stand in
order of their leaf and their tampered leaf, equal rows have equal leaves and a place each. An empty table gives an empty result.
Columns that are not part of a leaf are not read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._common import materialise

#: Leaves of a superblock, as a power of two.
HEIGHT = 12

LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """SHA-256 hex of the values, each with its length before it."""
    return F.sha2(F.concat(*map(_part, values)), 256)


def leaves(docs: DataFrame, id_col: str, group_col: str, fields: list[str], count_col: str, tampered: Column) -> DataFrame:
    """(grp, id, leaf, other): other is the leaf with one more in count_col where ``tampered`` says so, else null."""
    more = F.col(count_col).cast("decimal(20,0)") + 1
    changed = leaf([more if f == count_col else F.col(f) for f in fields])
    return docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), F.when(tampered, changed).alias("other"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place within grp by the columns of ``order``, and n, the size of grp."""
    parts = materialise(nodes.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()), "leaf-order")
    counts = parts.groupBy("part", "grp").agg(F.count("*").alias("here"))  # a row for each partition, and one for each group
    before = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("part", F.col("grp").alias("of"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(W.partitionBy("grp")).alias("n"))
    inside = W.partitionBy("part", "grp").orderBy(*order)
    parts = parts.withColumn("pos", F.row_number().over(inside).cast("long"))
    found = parts.join(counts.withColumnRenamed("part", "at"), (F.col("part") == F.col("at")) & F.col("grp").eqNullSafe(F.col("of")))
    return found.select(*nodes.columns, (F.col("pos") + F.col("before") - 1).alias("pos"), "n")


def _levels(n: int, height: int) -> int:
    """How often a superblock of a group of n nodes is reduced."""
    return min(height, (n - 1).bit_length())


def _reduce(digests: list[str], levels: int) -> list[list[str]]:
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([_hash("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def _steps(tree: list[list[str]], i: int) -> list[str]:
    """The way from node i to the superblock's root: at each level the sibling, after ``<`` if it stands left and ``>`` if right; empty if none."""
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append((("<" if j < i else ">") + level[j]) if j < len(level) else "")
        i >>= 1
    return out


def fold(digest: str, steps: list[str]) -> str:
    """The root that a node and its siblings give."""
    for s in steps:
        digest = _hash(s[1:] + digest if s[:1] == "<" else digest + s[1:])
    return digest


def up(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """nodes: (grp, pos, n, digest). The tables from these nodes to one node for each group, each written."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:

        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            n = int(pdf["n"].iloc[0])
            root = _reduce(pdf["digest"].tolist(), _levels(n, height))[-1][0]
            return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "pos": [int(pdf["pos"].iloc[0]) >> height], "n": [-(-n >> height)], "digest": [root]})

        block = F.shiftright("pos", height).alias("block")
        tables.append(materialise(tables[-1].select("grp", "pos", "n", "digest").groupBy("grp", block).applyInPandas(reduce, "grp string, pos long, n long, digest string"), "superblocks"))
        most = -(-most >> height)
    return tables


def down(nodes: DataFrame, outer: DataFrame, height: int = HEIGHT) -> DataFrame:
    """nodes: (grp, pos, n, digest); outer: (grp, pos, steps, subroot, root) of the superblocks' roots. The same for the nodes."""

    def extend(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        tree = _reduce(inner["digest"].tolist(), _levels(int(inner["n"].iloc[0]), height))
        top = above.iloc[0]
        steps = [[*_steps(tree, i), *top["steps"]] for i in range(len(inner))]
        return pd.DataFrame({"grp": inner["grp"], "pos": inner["pos"], "steps": steps, "subroot": top["subroot"], "root": top["root"]})

    block = F.shiftright("pos", height).alias("block")
    pairs = nodes.select("grp", "pos", "n", "digest").groupBy("grp", block).cogroup(outer.groupBy("grp", F.col("pos").alias("block")))
    return pairs.applyInPandas(extend, "grp string, pos long, steps array<string>, subroot string, root string")


def _proofs(rows: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    def prove(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        tree = _reduce(inner["leaf"].tolist(), _levels(int(inner["n"].iloc[0]), height))
        top = above.iloc[0]
        rest, rows = list(top["steps"]), []
        for i, (mine, other) in enumerate(zip(inner["leaf"], inner["other"])):
            steps = [*_steps(tree, i), *rest]
            folded = fold(other if isinstance(other, str) else mine, steps)
            rows.append((mine, top["subroot"], top["root"], _hash("".join(s[1:] for s in steps)), folded, folded == top["root"]))
        made = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        made.insert(0, "id", inner["id"].array)
        return made

    kind = rows.schema["id"].dataType.simpleString()
    block = F.shiftright("pos", height).alias("block")
    pairs = rows.groupBy("grp", block).cogroup(outer.groupBy("grp", F.col("pos").alias("block")))
    return pairs.applyInPandas(prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] | None = None, count_col: str = "n_chars", tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """For every row: its id, leaf, subroot, root, the digest of its proof, the root folded from its (tampered) leaf, and whether that is
    the root. tampered: where count_col is one too high in what is verified; nowhere by default."""
    if height < 1:
        raise ValueError("height must be 1 or more")
    made = leaves(docs, id_col, group_col, fields or LEAF_FIELDS, count_col, F.lit(False) if tampered is None else tampered)
    # ids travel as text: pandas has no whole numbers beside nulls
    rows = materialise(placed(made, ["id", "leaf", "other"]).withColumn("id", F.col("id").cast("string")), "leaves")
    tables = up(rows.select("grp", "pos", "n", F.col("leaf").alias("digest")), height)
    subroots = materialise(tables[-1].select(F.col("grp").alias("name"), F.lit("").alias("grp"), "digest"), "subroots")
    groups = materialise(placed(subroots, ["name"]), "groups")
    over = up(groups.select("grp", "pos", "n", "digest"), height)
    outer = over[-1].select("grp", "pos", F.array().cast("array<string>").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for table in reversed(over[:-1]):
        outer = materialise(down(table, outer, height), "outer-nodes")
    outer = outer.withColumnRenamed("pos", "at").drop("subroot", "grp").join(groups.select("name", F.col("pos").alias("at"), F.col("digest").alias("subroot")), "at")
    outer = outer.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "steps", "subroot", "root")
    for table in reversed(tables[1:-1]):
        outer = materialise(down(table, outer, height), "outer-nodes")
    proofs = _proofs(rows, outer, height)
    return proofs.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
