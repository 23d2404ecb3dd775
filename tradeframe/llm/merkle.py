"""Merkle manifest of a dataset: a tree of hashes over each group's rows and over the groups, and each row's proof.

A row's rank in its group is read in digits of base 16. Digit by digit, ranks are grouped away: sixteen nodes become one
that holds their structs. After two digits a block of 256 leaves is one row, which nests what its proofs need; only its hash
goes on to the next block of digits, so no row grows with the table. From the top down, each block's proofs come out of its
nested structs by transform and explode; what was found above a block is put to it by grouping both under the block's number,
so there is no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.shared import Saved
from tradeframe.operators.places import ranked

#: Children of a node, and the leaves of a block, two digits.
FAN = 16
BLOCK = FAN * FAN


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value's length in bytes, a colon and the value; a dash where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(nodes: Column) -> Column:
    """Digests of nodes, one behind the other, as hexadecimal text."""
    return F.array_join(F.transform(nodes, lambda x: F.lower(F.hex(x["node"]))), "")


def _node(nodes: Column, several: Column) -> Column:
    """The hash of a run of nodes; a group's only node is no run."""
    return F.when(several, F.unhex(digest(_joined(nodes)))).otherwise(F.get(nodes, F.lit(0))["node"])


def _run(rows: DataFrame, by: Sequence[str], rank: str, several: Column) -> DataFrame:
    """(by..., total, nodes, node): the rows (by..., rank, total, at) that by holds alike, in the order of their ranks."""
    found = rows.groupBy(*by).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), "at"))).alias("nodes"))
    found = found.withColumn("nodes", F.transform("nodes", lambda x: x["at"]))
    return found.withColumn("node", _node(F.col("nodes"), several))


def _block(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., block, total, runs, node) of rows (group..., place, total, at): two digits grouped away. Rows are dealt by
    their block once; both groupings find them there."""
    dealt = rows.withColumns({"run": F.floor(F.col("place") / FAN), "block": F.floor(F.col("place") / BLOCK)}).repartition(*group, "block")
    runs = _run(dealt, [*group, "block", "run"], "place", F.col("total") > 1)
    runs = runs.select(*group, "block", "run", "total", F.struct("node", "nodes").alias("at"))
    return _run(runs, [*group, "block"], "run", F.col("total") > FAN).withColumnRenamed("nodes", "runs")


def _sides(nodes: Column, i: Column, several: Column) -> Column:
    """A level of a proof: the digests before and behind a node in its run, each side joined; no level without a run."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    left, right = F.slice(nodes, F.lit(1), i), F.slice(nodes, i + 2, F.lit(FAN))
    return F.when(several, F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right")))).otherwise(none)


def _proofs(blocks: DataFrame, above: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., place, top, at, proof) of all that is in blocks; above has each block's own (group..., place, top, proof)."""
    lower = blocks.select(*group, "block", "total", "runs")
    upper = above.select(*group, F.col("place").alias("block"), "top", F.col("proof").alias("rest"))
    met = lower.unionByName(upper, allowMissingColumns=True).groupBy(*group, "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("total", "runs", "top", "rest")))
    runs, total = F.col("runs"), F.col("total")

    def run(r: Column, i: Column) -> Column:
        up = F.concat(_sides(runs, i, total > FAN), F.col("rest"))
        return F.transform(r["nodes"], lambda leaf, k: F.struct((F.col("block") * BLOCK + i * FAN + k).alias("place"), leaf.alias("at"), F.concat(_sides(r["nodes"], k, total > 1), up).alias("proof")))

    return met.withColumn("one", F.explode(F.flatten(F.transform(runs, run)))).select(*group, "top", "one.*")


def _tree(rows: DataFrame, group: Sequence[str]) -> tuple[list[Saved], DataFrame]:
    """Blocks of all heights over rows (group..., place, total, at), written, and (group..., node), each group's top."""
    heights: list[Saved] = []
    while True:
        heights.append(Saved(_block(rows, group), "blocks"))
        blocks = heights[-1].df
        if not blocks.where(F.col("total") > BLOCK).limit(1).count():
            return heights, blocks.select(*group, "node")
        rows = blocks.select(*group, F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.struct("node").alias("at"))


def _down(heights: list[Saved], tops: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., place, top, at, proof) of the rows that the tree stands on; tops has (group..., top, proof), of the tops."""
    found = tops.withColumn("place", F.lit(0).cast("long"))
    for i, height in enumerate(reversed(heights)):
        found = _proofs(height.df, found, group)
        if i < len(heights) - 1:  # a block that is alone in its group isn't hashed again above
            found = found.select(*group, "place", "top", "proof")
    return found


def merkle_proofs(rows: DataFrame, group: str, order: str, leaf: str, keep: Sequence[str] = ()) -> DataFrame:
    """(group, order, leaf, keep..., subroot, root, proof) of each row; leaf is a digest, 32 bytes.

    Leaves ascend by `order` in their group, nulls first; rows of equal order stand by their leaves. While a group has
    several nodes, every 16 that follow one another (the last run may have fewer, or one) become the SHA-256 of their
    digests' hexadecimal text. A group's last node is its subroot; the subroots, by group with null first and bytewise, are
    leaves of such a tree again, whose last node is the root. proof: for each level upward the digests before and behind the
    row's own, as hexadecimal text. Empty tables give no rows."""
    own = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(leaf).alias("node"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    placed = ranked(own, ["group"], ["order", "node"], "place", "total")
    at = F.struct("node", "order", *(f"keep{i}" for i in range(len(keep))))
    heights, tops = _tree(placed.select("group", "place", "total", at.alias("at")), ["group"])
    groups = ranked(tops, [], ["group"], "place", "total")
    all_heights, root = _tree(groups.select(F.lit(0).alias("all"), "place", "total", F.struct("node", "group").alias("at")), ["all"])
    proof = F.array().cast("array<struct<left:string,right:string>>").alias("proof")
    subroots = _down(all_heights, root.select("all", F.struct("node").alias("top"), proof), ["all"])
    subroots = subroots.select(F.col("at.group").alias("group"), F.struct(F.col("top.node").alias("root"), F.col("at.node").alias("subroot")).alias("top"), "proof")
    found = _down(heights, subroots, ["group"])
    hexed = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("group").alias(group),
        F.col("at.order").alias(order),
        hexed("at.node").alias(leaf),
        *(F.col(f"at.keep{i}").alias(c) for i, c in enumerate(keep)),
        hexed("top.subroot").alias("subroot"),
        hexed("top.root").alias("root"),
        "proof",
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by a proof."""
    return F.aggregate(proof, leaf, lambda node, level: digest(level["left"], node, level["right"]))


#: What a document's leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(text: Column) -> Column:
    """The digest of a document, with a text in place of its own."""
    return F.unhex(digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS)))


def document_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of documents.

    The proof's digest is of its digests in order. Where 5 divides the crc32 of the decimal id, the text's A-Z are lower-cased
    before the root is worked out again from the leaf and the proof; verified tells whether it is the root. A null id is no
    decimal, so its row isn't tampered with; it comes first in its source. A null in any field is a dash in the leaf, so it
    differs from an empty text. Repeated rows are leaves of their own, beside each other; other columns are not read. Texts
    are read once and not dealt out."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(tampered & (lower != F.col("text")), document_leaf(lower))
    rows = docs.select("doc_id", "source", document_leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    rows = Saved(rows, "leaves").df  # texts are read once: dealing by ranges looks at its rows twice
    found = merkle_proofs(rows, "source", "doc_id", "leaf", keep=["changed"])
    siblings = F.flatten(F.transform("proof", lambda level: F.array(level["left"], level["right"])))
    found = found.withColumns({"proof_sha256": digest(F.array_join(siblings, "")), "folded_root": folded(F.coalesce(F.lower(F.hex("changed")), "leaf"), F.col("proof"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
