"""A trie of the prefixes that conversations share, by ROLLUP over columns of turn ids.

A conversation is cut into blocks of eight turns, a row each, with a column for each turn's id. A block's row also holds a
key of all turns before it, that is of the node where the block before ended, so one GROUP BY block, key, ROLLUP(turn
columns) aggregates the prefixes of all lengths together, and grouping_id tells how long each is. A key is the exclusive or
of two 64-bit hashes of each turn and its place, so that it comes from a running aggregate and blocks needn't wait for one
another. What is summed over a subtree is put to the conversations first: each node's share goes to its smallest member."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.llm.shared import Saved, saved
from tradeframe.operators.places import ranked

#: Turns of a block, each a column.
BLOCK = 8
COLUMNS = [f"t{i}" for i in range(BLOCK)]

#: Places of a stretch: what comes before a row is worked out within its stretch, and for stretches as a whole.
STRETCH = 1 << 15

#: Turns that come from another conversation, at most; conversations of one origin.
COPIED, ORIGIN = 5, 100


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes: 12 of a digest of role and text, 4 for the text's length in code points. Nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.unhex(F.concat(F.substring(whole, 1, 24), F.lpad(F.hex(F.length(text)), 8, "0")))


def _chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 13, 4)), 16, 10).cast("long")


def _hashes(place: Column, turn: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place; zero where there is no turn."""
    none = F.lit(0).cast("long")
    return tuple(F.coalesce(F.when(turn.isNotNull(), h), none) for h in (F.xxhash64(place, turn), F.xxhash64(turn, place, F.lit(1))))


def _xor(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _before(rows: DataFrame, by: str, at: str, values: dict[str, str], xor: bool, size: int) -> DataFrame:
    """Add to rows, for each value and the name it is to have, the sum (or exclusive or) over rows of lower `at` in the
    group. rows have `stretch`, floor(at / size)."""
    total = F.bit_xor if xor else F.sum
    earlier = lambda *p: Window.partitionBy(*p).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = rows.groupBy(by, "stretch").agg(*(total(v).alias(f"__{v}") for v in values))
    whole = whole.select(by, "stretch", *(F.coalesce(total(f"__{v}").over(earlier(by).orderBy("stretch")), zero).alias(f"__{v}") for v in values))
    rows = rows.withColumns({out: F.coalesce(total(v).over(earlier(by, "stretch").orderBy(at)), zero) for v, out in values.items()}).join(whole, [by, "stretch"])
    both = (lambda a, b: a.bitwiseXOR(b)) if xor else (lambda a, b: a + b)
    return rows.withColumns({out: both(F.col(out), F.col(f"__{v}")) for v, out in values.items()}).drop(*(f"__{v}" for v in values))


def _pieces(per_group: DataFrame, n: Column, size: int) -> DataFrame:
    """A row of a group for each stretch that its n rows have, so that a long group's rows meet it in many tasks."""
    return per_group.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / size))))


def turns(conversations: DataFrame) -> DataFrame:
    """(c, place, n, id) of each turn, in the order of `turn` with null first; turns of equal number stand in the order of
    their ids. n: the conversation's turns. Rows of null conv_id are no conversation's and are left out."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"))
    rows = saved(rows, "turns")  # texts are read once
    return ranked(rows, ["c"], ["turn", "id"], "place", "n").select("c", "place", "n", "id")


def rebuilt(rows: DataFrame, size: int = STRETCH) -> DataFrame:
    """(c, place, total, id) of the rebuilt conversations of turns(): the first h turns of conversation c - c % 100 (all it
    has, if fewer; none where there is no such), then c's own after its first h; h is crc32 of the decimal c, modulo 6. A
    conversation without turns has one row of null place and id. total: its turns."""
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % (COPIED + 1)).alias("h")
    convs = rows.where("place = 0").select("c", "n", h, (F.col("c") - F.col("c") % ORIGIN).alias("origin"))
    heads = rows.where((F.col("place") < COPIED) & (F.col("c") % ORIGIN == 0)).select(F.col("c").alias("origin"), "place", "id", F.col("n").alias("origin_n"))
    convs = convs.join(heads.where("place = 0").select("origin", "origin_n"), "origin", "left")
    convs = convs.withColumn("copied", F.least(F.col("h"), F.coalesce("origin_n", F.lit(0))))
    convs = convs.withColumn("total", F.col("copied") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    first = convs.join(heads.select("origin", "place", "id"), "origin").where("place < h").select("c", "place", "total", "id")
    met = rows.withColumn("stretch", F.floor(F.col("place") / size)).join(_pieces(convs.select("c", "h", "copied", "total", "n"), F.col("n"), size).drop("n"), ["c", "stretch"])
    own = met.where("place >= h").select("c", (F.col("place") - F.col("h") + F.col("copied")).alias("place"), "total", "id")
    none = convs.where("total = 0").select("c", F.lit(None).cast("long").alias("place"), "total", F.lit(None).cast("binary").alias("id"))
    return first.unionByName(own).unionByName(none)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(c, stretch, block, total, t0..t7, own1, own2, p1, p2): the blocks of conversations, own1 and own2 of their turns, p1
    and p2 of all turns before them."""
    place, per = F.coalesce("place", F.lit(0)), max(size // BLOCK, 1)
    dealt = rows.withColumns({"block": F.floor(place / BLOCK), "slot": place % BLOCK}).withColumn("stretch", F.floor(F.col("block") / per)).repartition("c", "stretch")
    wide = dealt.groupBy("c", "stretch", "block").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("slot") == i, F.col("id"))).alias(t) for i, t in enumerate(COLUMNS)))
    ones, twos = zip(*(_hashes(F.col("block") * BLOCK + i, F.col(t)) for i, t in enumerate(COLUMNS)))
    wide = wide.withColumns({"own1": _xor(list(ones)), "own2": _xor(list(twos))})
    return _before(wide, "c", "block", {"own1": "p1", "own2": "p2"}, True, per)


def _rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """(k1, k2, depth, level, q1, q2, id, aggregates...): all prefixes at once. k1 and k2 are a node's key, q1 and q2 its
    parent's, id its last turn's. The root is in the first block; other blocks' empty prefixes are nodes of the block before."""
    found = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, {', '.join(COLUMNS)}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP({', '.join(COLUMNS)})",
        blocks=blocks,
    )
    level, last = F.col("level"), F.col("id")
    found = found.withColumn("id", F.coalesce(*(F.when(level == i + 1, F.col(t)) for i, t in enumerate(COLUMNS))))
    found = found.where(last.isNotNull() | ((level == 0) & (F.col("block") == 0)))
    depth = F.col("block") * BLOCK + level
    before = [_hashes(F.col("block") * BLOCK + i, F.when(level > i + 1, F.col(t))) for i, t in enumerate(COLUMNS)]
    at = _hashes(depth - 1, last)
    for k in (0, 1):
        found = found.withColumn(f"q{k + 1}", _xor([F.col(f"p{k + 1}"), *(b[k] for b in before)]))
        found = found.withColumn(f"k{k + 1}", F.col(f"q{k + 1}").bitwiseXOR(at[k]))
    return found.withColumn("depth", depth).drop("block", "p1", "p2", *COLUMNS)


#: A chunk of ids holds those that agree but for so many low bits.
CHUNK_BITS = 11


def _ends(blocks: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends): the digest of the ids of the conversations that end at a node. Ids go in chunks of at most
    2,048, in order; a node's chunks pass through one task, as its digest takes one after the other, but none is kept."""
    last = blocks.where((F.col("block") == F.floor((F.col("total") - 1) / BLOCK)) | (F.col("total") == 0))
    at = last.select(F.col("p1").bitwiseXOR(F.col("own1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("own2")).alias("k2"), F.col("total").alias("depth"), "c", F.shiftright("c", CHUNK_BITS).alias("chunk"))
    chunks = at.groupBy("k1", "k2", "depth", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = chunks.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "chunk")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *at, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if at != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _table(done)
        yield _table([(*node, state.hexdigest())] if node else [])

    return chunks.mapInArrow(digests, "k1 long, k2 long, depth long, ends string")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["k1", "k2", "depth", "ends"])


def prefix_trie(rows: DataFrame, size: int = STRETCH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of
    sequences (c, place, total, id), as rebuilt() gives them: conv_id is the smallest c that starts with the node's turns, and
    with depth names the node, whose last turn is that sequence's turn depth - 1. The root has depth 0 and all sequences.

    saved_tokens sums over a node and all below it the code points of its last text that its members but one needn't hold.
    No rows give no nodes. size: places of a stretch of a long sequence."""
    blocks = Saved(_blocks(rows, size), "blocks").df
    nodes = _rollup(blocks, "count(*) AS n_convs, min(c) AS conv_id, max(total) AS longest")
    saves = F.coalesce((F.col("n_convs") - 1) * _chars(F.col("id")), F.lit(0).cast("long"))
    nodes = nodes.select("k1", "k2", "depth", F.when(F.col("depth") > 0, F.col("q1")).alias("q1"), F.when(F.col("depth") > 0, F.col("q2")).alias("q2"), "n_convs", "conv_id", (F.col("longest") == F.col("depth")).cast("long").alias("leaf"), saves.alias("saves"))
    nodes = saved(nodes, "nodes")

    # what a conversation adds to each node that it is a member of
    shares = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("saves").alias("saves"), F.max("leaf").alias("leaf"), F.max("depth").alias("deepest"))
    shares = _pieces(shares, F.col("deepest"), size).drop("deepest")
    sums = _rollup(blocks.join(shares, ["c", "stretch"]), "sum(saves) AS saves, sum(leaf) AS leaves").select("k1", "k2", "depth", "saves", "leaves")

    # but a node's smallest member has shares of nodes above it as well
    above = _before(nodes.withColumn("stretch", F.floor(F.col("depth") / size)), "conv_id", "depth", {"saves": "above"}, False, size)
    facts = [
        above.select("k1", "k2", "depth", "q1", "q2", "n_convs", "conv_id", (-F.col("above")).alias("saves")),
        sums,
        _ends(blocks),
        nodes.where("depth > 0").select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("children")),
    ]
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    whole = facts.groupBy("k1", "k2", "depth").agg(*(F.max(c).alias(c) for c in ("q1", "q2", "n_convs", "conv_id", "ends")), *(F.sum(c).alias(c) for c in ("saves", "leaves", "children")))
    parents = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return whole.join(parents, ["q1", "q2", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saves").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text). Null roles and texts are empty; null turns come
    first, turns of equal number in the order of their ids, so repeated rows are turns one after the other; rows of null
    conv_id are left out; other columns are not read; an empty table gives no rows."""
    return prefix_trie(saved(rebuilt(turns(conversations)), "rebuilt"))
