"""Document fingerprints: one-permutation MinHash of word shingles, with DataFrame functions alone.

Each shingle is hashed once. The hash's top bits are its bin, and each bin keeps its least hash. An empty bin takes the
value of the first full bin in an order of its own (optimal densification). Of each bin the low bits are stored, as
hexadecimal digits. Likeness is the share of equal bins, less what unlike bins agree in by chance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.llm.shared import Saved

#: Bins, as a power of two, and bits stored of each.
BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS

#: Words of a shingle.
WIDTH = 5


def _word_hashes(text: Column) -> Column:
    words = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _minima(words: Column) -> Column:
    """The least shingle hash of each bin that has one, in ascending order."""
    n = F.size(words)
    width = F.least(n, F.lit(WIDTH))
    at = F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0)))
    one = F.transform(F.slice(words, 1, F.greatest(n, F.lit(1))), lambda w: w)
    many = F.transform(at, lambda i: F.xxhash64(*(words[i + k] for k in range(WIDTH))))
    few = F.array(F.xxhash64(F.concat_ws(" ", F.transform(one, lambda w: w.cast("string")))))
    empty = F.array().cast("array<bigint>")
    return F.when(width == 0, empty).when(n < WIDTH, few).otherwise(F.sort_array(many))


def _first_of_bins(hashes: Column) -> Column:
    """Of sorted hashes those that are the first of their bin; a bin is the top bits, taken as a signed number."""
    shift = 64 - BIN_BITS
    return F.filter(hashes, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(hashes, i - 1), shift)))


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")


def _bins(first: Column) -> Column:
    """The low bits of the least hash of each bin, null where empty: each value after as many nulls as bins were skipped."""
    null = F.lit(None).cast("int")
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    gap = lambda x, i: _bin(x) - 1 - F.when(i == 0, -1).otherwise(_bin(F.get(first, i - 1)))
    parts = F.transform(first, lambda x, i: F.concat(F.array_repeat(null, gap(x, i)), F.array(low(x))))
    return F.concat(F.flatten(parts), F.array_repeat(null, BINS - 1 - F.coalesce(_bin(F.get(first, F.size(first) - 1)), F.lit(-1))))


#: Bins asked one by one before all are.
SOON = 6


def _asked(bin_: Column, nth: Column | int) -> Column:
    """The bin that an empty one asks as its nth: each empty bin asks all of them in an order of its own. The first number is
    odd, so that no bin is asked twice."""
    step = F.shiftright(bin_ * 0x9E3779B1, 7).bitwiseAND(F.lit(BINS - 1)).bitwiseOR(F.lit(1).cast("long"))
    start = F.shiftright((bin_ + 1) * 0x85EBCA6B, 9)
    return (start + step * nth).bitwiseAND(F.lit(BINS - 1)).cast("int")


def _dense(bins: Column) -> Column:
    """Empty bins filled; an empty document has none to fill from and keeps -1 in all."""

    def taken(b: Column) -> Column:
        b = b.cast("long")
        asked = [F.get(bins, _asked(b, F.lit(k))) for k in range(SOON)]
        every = F.transform(F.sequence(F.lit(SOON), F.lit(BINS - 1)), lambda k: F.get(bins, _asked(b, k)))
        return F.coalesce(*asked, F.get(F.filter(every, lambda v: v.isNotNull()), F.lit(0)), F.lit(-1))

    return F.transform(bins, lambda v, b: F.coalesce(v, taken(b)))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the bins of a text, an array of small numbers. One step a projection, so that none is worked out twice."""
    df = df.withColumn(out, _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    for step in (_minima, _first_of_bins, _bins):
        df = df.withColumn(out, step(F.col(out)))
    return df.withColumn(out, _dense(F.col(out)))


def packed(bins: Column) -> Column:
    """Two hexadecimal digits a bin; an empty document's are all blank."""
    return F.array_join(F.transform(bins, lambda v: F.when(v < 0, F.lit("--")).otherwise(F.lpad(F.lower(F.hex(v)), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """An estimate of the Jaccard similarity of two documents' shingles from their bins, from 0 to 1: unlike bins agree
    in their low bits once in 2^BITS, which is taken off. Two empty documents are alike, one is unlike any other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    corrected = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    blank = (F.get(a, F.lit(0)) < 0) | (F.get(b, F.lit(0)) < 0)
    return F.when(blank, (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("double")).otherwise(F.greatest(corrected, F.lit(0.0)))


def with_next(rows: DataFrame, order: list[str], columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Add next_<column> to rows: that of the row that follows in ascending order, nulls first, after the last that of the
    first. Rows that are alike in the order follow one another in any way; prepare adds columns once rows are dealt.

    Rows are dealt by ranges of the order and a number of their own, so ranges are even whatever the values. The first row
    of each range is sent to the range before it as well, behind its own rows, so that each row finds its next beside it."""
    dealt = rows.withColumn("__own", F.monotonically_increasing_id())
    dealt = Saved(dealt.repartitionByRange(*order, "__own").withColumn("range", F.spark_partition_id()), "ranges").df
    heads = dealt.groupBy("range").agg(F.min(F.struct(*order, "__own")).alias("head"))
    everything = Window.partitionBy(F.lit(0))
    # a row a range: ranges without rows are passed over, and the first comes behind the last
    before = F.coalesce(F.lag("range").over(everything.orderBy("range")), F.max("range").over(everything))
    heads = heads.select(F.col("head.__own").alias("__own"), before.alias("range"))
    # two numbers a range, of which there are as many as partitions
    ghosts = dealt.drop("range").join(F.broadcast(heads), "__own")
    whole = prepare(dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))))
    near = Window.partitionBy("range").orderBy("ghost", *order, "__own")
    return whole.withColumns({f"next_{c}": F.lead(c).over(near) for c in columns}).where(~F.col("ghost")).drop("range", "ghost", "__own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text is the row's with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row's text by ascending id (after the last: the first). near_edited and near_next estimate the Jaccard
    similarity of the five-word shingle sets, from fingerprints. Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case;
    fewer than five are one shingle. A null text is empty; rows of null id come first; rows of equal id follow in the
    order of their texts; one row is its own next; other columns are not read; an empty table gives no rows. Ids are
    integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, ["id", "text"], ["text", "own"], lambda rows: add_fingerprint(rows, "text", "own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = add_fingerprint(rows, "edited", "changed")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
