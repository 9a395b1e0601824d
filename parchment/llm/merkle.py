"""Merkle manifest of a dataset: a tree a source, a tree over the sources, and each row's proof up to the root.

Trees are reduced by superblocks: nodes of a tree whose indices agree after division by fanout^k form a bucket, one task
collapses k levels of it, and the buckets' roots are the nodes of the next, much shorter reduction. A node's proof is
what its bucket gives for the lower levels, and what its bucket's root gets for the upper ones.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, prefix_sum, stored

FANOUT = 16
#: Levels that one task collapses: a bucket has FANOUT ** LEVELS nodes at most.
LEVELS = 3
#: A level of a proof: the digests of a run's other nodes, those before the node and those after it, each concatenated.
PROOF = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: Iterable[Column]) -> Column:
    """The digest of a row's fields: `-` for a null, else its UTF-8 length, `:` and the value."""
    text = [c.cast("string") for c in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text))


def _joined_digest(nodes: list[str]) -> str:
    from hashlib import sha256

    return sha256("".join(nodes).encode()).hexdigest()


def collapsed(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and the `levels` levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([_joined_digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _levels(n: int, levels: int, fanout: int) -> int:
    """How many levels a bucket of a tree with n nodes has above its nodes: as many as the tree, `levels` at most."""
    return next((k for k in range(levels) if fanout**k >= n), levels)


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes: tree (string), n (nodes of the tree), index (from 0 without gaps), node (hex digest), and more columns.

    Gives (tree, root) of each tree, and nodes with `proof`, which leads from the node to its tree's root. A bucket
    has fanout ** levels nodes at most, whatever a tree's size; each reduction is written to the shared folder, so a lost
    executor costs a bucket. There is one reduction for every `levels` levels of the tallest tree.
    """
    block = fanout**levels
    more = [c for c in nodes.columns if c not in ("tree", "n", "index", "node")]
    kind = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in more)

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        n = int(rows["n"].iloc[0])
        tops = collapsed(rows["node"].tolist(), _levels(n, levels, fanout), fanout)[-1]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "n": [-(-n // block)], "index": rows["index"].iloc[:1] // block, "node": tops})

    def prove(rows):
        import pyarrow as pa

        rows = rows.sort_by("index")
        n = rows["n"][0].as_py() if rows.num_rows else 0
        above = collapsed(rows["node"].to_pylist(), _levels(n, levels, fanout), fanout)[:-1]
        proofs = []
        for i in range(rows.num_rows):
            steps = []
            for k, level in enumerate(above):
                at = i // fanout**k
                run = at - at % fanout
                steps.append({"left": "".join(level[run:at]), "right": "".join(level[at + 1 : run + fanout])})
            proofs.append(steps)
        step = pa.struct([("left", pa.string()), ("right", pa.string())])
        return rows.append_column("lower", pa.array(proofs, pa.list_(step)))

    dealt = nodes.withColumn("bucket", F.floor(F.col("index") / block))
    tops = stored(dealt.select("tree", "n", "index", "node", "bucket").groupBy("tree", "bucket").applyInPandas(top, "tree string, n long, index long, node string"), "tops")
    lower = dealt.select("tree", "n", "index", "node", *more, "bucket").groupBy("tree", "bucket").applyInArrow(prove, f"tree string, n long, index long, node string{kind}, bucket long, lower {PROOF}")
    if tops.where("n > 1").isEmpty():
        return tops.select("tree", F.col("node").alias("root")), lower.withColumnRenamed("lower", "proof").drop("bucket")
    roots, upper = reduced(tops, fanout, levels)
    upper = stored(upper.select("tree", F.col("index").alias("bucket"), F.col("proof").alias("upper")), "proofs")
    both = lower.join(upper, ["tree", "bucket"]).withColumn("proof", F.concat("lower", "upper"))
    return roots, both.drop("bucket", "lower", "upper")


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its proof lead to."""
    return F.aggregate(proof, node, lambda h, step: digest(step["left"], h, step["right"]))


def proof_digest(proof: Column) -> Column:
    """The digest of all digests of a proof, level by level from below, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """rows (source, doc_id, leaf and more columns, which stay) with subroot, root and proof.

    Leaves of a source ascend by doc_id, null first, rows of one id by leaf; sources ascend bytewise, null first. Every
    `fanout` consecutive nodes become one until one remains, in each source and then over the sources' subroots. Leaf
    numbers are running sums over ranges that split a source with many rows; sources are rows of a table, only hot
    ones are broadcast beyond the limit. Repeated rows are leaves each; an empty table gives an empty result. The
    texts are only hashed, so their length doesn't matter here.
    """
    taken = {"source", "doc_id", "leaf"}
    more = [c for c in rows.columns if c not in taken]
    inner = F.struct(F.col("source"), F.col("doc_id"), *(F.col(c) for c in more)).alias("row")
    keyed = rows.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tree"), "doc_id", F.col("leaf").alias("node"), inner)
    numbered = stored(prefix_sum(keyed, "tree", ["doc_id", "node"], None, "index").drop("doc_id"), "leaves")
    counts = stored(numbered.groupBy("tree").agg(F.count("*").alias("n")), "counts")
    subroots, proved = reduced(joined(numbered, counts, "tree", 64).select("tree", "n", "index", "node", "row"), fanout, levels)
    one = prefix_sum(subroots.withColumnRenamed("tree", "source_key").withColumn("tree", F.lit("")), "tree", ["source_key"], None, "index")
    one = stored(one.select("tree", F.lit(counts.count()).cast("long").alias("n"), "index", F.col("root").alias("node"), "source_key"), "subroots")
    roots, sources = reduced(one, fanout, levels)
    whole = sources.join(F.broadcast(roots), "tree").select(F.col("source_key").alias("tree"), F.col("node").alias("subroot"), "root", F.col("proof").alias("upper"))
    table = stored(whole.join(counts, "tree"), "sources")
    out = joined(proved.drop("n"), table, "tree", 256 + 1024 * 4)
    return out.select("row.*", F.col("node").alias("leaf"), "subroot", "root", F.concat("proof", "upper").alias("proof"))


def documents_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, source, leaf of each document, and claimed: its leaf where `tampered` holds and A-Z of its text were lower-cased."""
    import string

    changed = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    other = leaf_of(changed if c == "text" else F.col(c) for c in FIELDS)
    leaf = leaf_of(map(F.col, FIELDS))
    return docs.select("doc_id", "source", leaf.alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), other).alias("changed"))


def audit(docs: DataFrame, tampered: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents checked against a later state of them: doc_id, leaf, subroot, root, proof_sha256, folded_root
    (the root that the later leaf leads to by the manifest's proof), verified (it equals root).

    In the later state A-Z of the text are lower-cased where the condition `tampered` holds; where it is null, as for a null
    id, nothing changes, nor does a null text. Very long texts are hashed in place. Other columns are ignored.
    """
    proved = manifest(documents_leaves(docs, tampered), fanout, levels)
    out = proved.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
