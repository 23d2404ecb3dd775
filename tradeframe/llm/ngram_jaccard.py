"""Similarity join of documents on word shingles by parity sketches.

A sketch is a wide row of bits, cut into B buckets. Each shingle of a document flips one bit: its hash picks the bucket
and the bit. Shingles that two documents share cancel out, so the bits in which their sketches differ are at most the
shingles in which the documents differ. Documents as similar as asked differ in at most d shingles, d known from the
size band, so of B = d + 1 + s buckets s + 1 at least are the same in both: buckets are the keys of the join. A bucket
is kept as the XOR of a random number for each bit that is set. Of its keys a document leaves out the s that most sets
have, such as those of common phrases: the rarest of the s + 1 in common is among those of neither side.

Groups of one bucket are not paired out. Each of its sets is compared with the least of them, the centre, by the exact
shingles. Sets similar to it are linked. Two sets of the group that are not both linked to the centre can only be
similar if they aren't in one component yet and if their sketches, now of a width that suits the set, differ in no more
bits than similar sets differ in shingles: in a group of at most 512 sets those are looked at side by side. In a larger
group, which first goes through rounds of new centres, sets meet on the rarest shingles that tell them from the centre (a
prefix of them, as long as the overlap asks). All that meet are compared by the exact shingles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeframe.llm.components import components
from tradeframe.llm.shared import Saved, over_batches, small_batches
from tradeframe.llm.words import BatchWords, mix, shingle_set


class Bands:
    """Sizes by which sets are told apart; sets of similar size are in the same or neighbouring bands."""

    def __init__(self, threshold: Fraction):
        self.t = threshold

    def band(self, n: int) -> int:
        """n in [t^-k, t^-(k+1)): a set and one larger by 1/t at most are one band apart at most."""
        k = int(log(n) / -log(float(self.t)))
        while self.least(k) > n:
            k -= 1
        while self.least(k + 1) <= n:
            k += 1
        return k

    def least(self, band: int) -> Fraction:
        return (1 / self.t) ** band

    def differ(self, band: int) -> int:
        """Shingles at most in which two similar sets differ, the larger in the band."""
        most = ceil(self.least(band + 1)) - 1
        return floor((1 - self.t) / (1 + self.t) * (2 * most))


def signature(hashes: np.ndarray) -> int:
    """64 bits that stand for a set."""
    if not len(hashes):
        return 0
    both = mix(np.array([np.add.reduce(mix(hashes)), np.bitwise_xor.reduce(hashes), len(hashes)], np.uint64))
    return int(mix(both[:1] + both[1:2] * np.uint64(3) + both[2:] * np.uint64(5))[0].view(np.int64))


def sketch_keys(hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """A set's join keys: the buckets of its sketches for its own band and for the next, in which a larger partner may
    be; and for each key its band and how many of the band's keys may be left out, as one number."""
    keys, rooms = [], []
    own = bands.band(len(hashes))
    bits = mix(hashes)
    for band in (own, own + 1):
        differ = bands.differ(band)
        spare = differ // 8
        buckets = differ + 1 + spare
        which = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        sketch = np.zeros(buckets, np.uint64)
        np.bitwise_xor.at(sketch, which, bits)
        place = mix(np.arange(buckets, dtype=np.uint64) + (np.uint64(band) << np.uint64(32)))
        keys.append(mix(sketch + place))
        rooms.append(np.full(buckets, spare << 1 | band & 1))
    return np.concatenate(keys).view(np.int64), np.concatenate(rooms)


#: Bytes of texts or sets that a Python worker takes at once: what it works out of them is some fifty times as much.
BATCH = 1 << 20

#: The same where a set goes out once a batch, so that larger ones hold more copies.
KEYS_BATCH = 2 << 20


def pack_set(hashes: np.ndarray) -> bytes:
    return hashes.tobytes()


#: Bits of the narrowest parity sketch of a set.
NARROW = 64


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Of a power of two of bits, as many as the set has hashes at least, each flipped by every hash that falls on it. The
    bits in which two sketches of one width differ are at most the hashes that one set alone has. Folding the halves of
    one together gives the sketch of half the width."""
    width = max(NARROW, 1 << max(len(hashes) - 1, 0).bit_length())
    at = mix(hashes ^ np.uint64(0x5EED)) & np.uint64(width - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def sketches_within(sizes: np.ndarray, sketches: list[bytes], apart: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i < j) of a few sets, in unlike components `apart`, that by size and sketches may be similar."""
    num, den = threshold.numerator, threshold.denominator
    n = sizes.astype(np.int64)
    i, j = np.triu_indices(len(n), 1)
    least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    may = (apart[i] != apart[j]) & (den * least >= num * most)
    i, j = i[may], j[may]
    far = (den - num) * (n[i] + n[j]) // (den + num)
    wide = np.array([len(x) for x in sketches])
    keep = np.zeros(len(i), bool)
    for width in np.unique(np.minimum(wide[i], wide[j])):
        rows = np.zeros((len(n), width), np.uint8)
        for k in np.flatnonzero((wide == width) | (wide == 2 * width)):
            x = np.frombuffer(sketches[k], np.uint8)
            rows[k] = x if len(x) == width else x[:width] ^ x[width:]
        words = rows.view(np.uint64)
        of = np.flatnonzero(np.minimum(wide[i], wide[j]) == width)
        for k in range(0, len(of), SIDE_BY_SIDE):
            part = of[k : k + SIDE_BY_SIDE]
            keep[part] = np.bitwise_count(words[i[part]] ^ words[j[part]]).sum(1, dtype=np.int64) <= far[part]
    return i[keep], j[keep]


#: Pairs of sketches that are laid side by side at once.
SIDE_BY_SIDE = 64


def _signed_sets(docs: DataFrame, width: int, keys: Bands | None) -> DataFrame:
    """(id, n, sig) of each row; with keys, (sig, key, room) of each set once a batch."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = BatchWords(batch.column(1))
        found = [shingle_set(words.of(i), width) for i in range(len(words))]
        n, sig = [len(x) for x in found], [signature(x) for x in found]
        if keys is None:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["id", "n", "sig"])
        once = {s: x for s, x in zip(sig, found, strict=True) if len(x)}
        flat = [sketch_keys(x, keys) for x in once.values()]
        none = np.empty(0, np.int64)
        where = np.repeat(np.fromiter(once, np.int64, len(once)), [len(x) for x, _ in flat])
        both = [np.concatenate([none, *(x[i] for x in flat)]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(where), pa.array(both[0]), pa.array(both[1], pa.int32())], ["sig", "key", "room"])

    if keys is None:
        return over_batches(docs, sets, "id bigint, n bigint, sig bigint", most=BATCH)
    return over_batches(docs, sets, "sig bigint, key bigint, room int", most=KEYS_BATCH)


def _first_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): each set with the least set of each group it is in, left out the groups that may be."""
    group = Window.partitionBy("key")
    # one exchange of all keys; of most only one set is found here
    shared = keys.withColumns({"b": F.min("sig").over(group), "top": F.max("sig").over(group), "many": F.count("*").over(group)}).where("b <> top")
    mine = shared.groupBy("sig", "room").agg(F.collect_set(F.struct("many", "key", "b")).alias("groups"))
    spare = F.shiftright("room", 1)
    rarest = F.slice(F.sort_array("groups", asc=False), spare + 1, F.greatest(F.size("groups") - spare, F.lit(0)))
    return mine.select(F.col("sig").alias("a"), F.explode(F.array_distinct(F.transform(rarest, lambda x: x["b"]))).alias("b")).where("a <> b").distinct()


def _sets_of(docs: DataFrame, first: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sig, n, items, sketch) of the wanted signatures: each from the text of its least document. first: (sig, id)."""
    texts = docs.join(first.join(wanted, "sig"), "id").select("sig", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = BatchWords(batch.column(1))
        found = [(sig, x) for i, sig in enumerate(batch.column(0).to_pylist()) if signature(x := shingle_set(words.of(i), width)) == sig]
        # rows of that id with another text are left out
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([pack_set(x) for _, x in found], pa.binary()), pa.array([parity_sketch(x) for _, x in found], pa.binary())], ["sig", "n", "items", "sketch"])

    return over_batches(texts, sets, "sig bigint, n bigint, items binary, sketch binary", most=BATCH).dropDuplicates(["sig"])


def _compare(pairs: DataFrame, sets: DataFrame, threshold: Fraction, keep: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, linked, far, apart) for pairs (a, b): far counts the hashes that are in one set alone, and apart, null
    unless kept, holds them."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "items_a", "items_b", "b", "n_a", "n_b")
    num, den = threshold.numerator, threshold.denominator

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=BATCH):
            linked, far, apart = [], [], []
            for x, y, n, m in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5)), strict=True):
                differ = np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
                both = (n + m - len(differ)) // 2
                linked.append(den * both >= num * (n + m - both))
                far.append(len(differ))
                apart.append(pack_set(differ) if keep else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(linked), pa.array(far, pa.int64()), pa.array(apart, pa.binary())], ["a", "b", "n_a", "n_b", "linked", "far", "apart"])

    return joined.mapInArrow(compare, "a bigint, b bigint, n_a bigint, n_b bigint, linked boolean, far bigint, apart binary")


def _apart_items(rows: DataFrame) -> DataFrame:
    """(item, pair) for each hash in apart; item also stands for the group."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [mix(np.frombuffer(x, np.uint64) + np.uint64(b & (1 << 64) - 1)) for x, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        at = pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items]))
        flat = np.concatenate(items) if items else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(at)], ["item", "pair"])

    return over_batches(rows.select("pair", "apart", "b"), run, "item bigint, pair bigint", most=BATCH)


#: Sets of a group that are laid side by side: at most so many sketches, of an eighth of a byte a word, are one row. A larger
#: group goes through rounds of new centres, and what they leave open is paired by what the sets share.
PAIRED = 512

#: Rounds of new centres at most. They save work, not links.
ROUNDS = 4

#: A round is followed by another if one in so many of the pairs that it compared is a link.
WORTH = 16


def _named(rows: Saved, labels: DataFrame) -> Saved:
    """The rows, which go, with the component that each set a is in now."""
    label = labels.select(F.col("node").alias("a"), F.col("component").alias("now"))
    kept = [c for c in rows.df.columns if c != "component"]
    named = Saved(rows.df.join(label, "a", "left").select(*kept, F.coalesce("now", "a").alias("component")), "named")
    rows.drop()
    return named


def _open(rows: Saved, labels: DataFrame) -> Saved:
    """(b, a, far, component, many) of the sets of groups that, beside the centre, aren't one component: there is no pair left
    in the others, which stay out from then on. many: the group's sets."""
    # written before it is grouped, for it is read twice
    named = _named(rows, labels)
    groups = named.df.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many"))
    out = Saved(named.df.select("b", "a", "far", "component").join(groups.where("low <> high").select("b", "many"), "b"), "open")
    named.drop()
    return out


def _new_centres(rows: DataFrame, settled: bool) -> DataFrame:
    """(a, b): in each large group that is not one component, its sets with a new centre that is in another component. It is
    the set that differs least from the old centre: of copies of one text, edited each in its way, one that hardly is, so
    that it is near to all. Once that is `settled` the sets of the component that most are in have no say: another part
    of the group gets a centre."""
    large = rows.where(F.col("many") > PAIRED)
    say = large
    if settled:
        sizes = large.groupBy("b", "component").count()
        first = sizes.groupBy("b").agg(F.max_by("component", F.struct("count", "component")).alias("first"))
        say = large.join(first, "b").where("component <> first")
    centre = say.groupBy("b").agg(F.min_by(F.struct("a", "component"), F.struct("far", "a")).alias("centre"))
    pairs = large.join(centre, "b").where(F.col("component") != F.col("centre.component"))
    return pairs.select("a", F.col("centre.a").alias("b")).distinct()


def _side_by_side(named: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of the small groups' sets that may be similar and aren't in one component yet. A group is one row, of at most
    PAIRED sets with their sketches."""
    rows = named.join(sets.select(F.col("sig").alias("a"), "n", "sketch"), "a")
    groups = rows.groupBy("b").agg(F.collect_list(F.struct("a", "n", "component", "sketch")).alias("sets"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=BATCH):
            left, right = [], []
            for sets_of in batch.column(1):
                one = sets_of.values
                a, n, component = (one.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                i, j = sketches_within(n, one.field(3).to_pylist(), component, threshold)
                left.append(a[i])
                right.append(a[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (left, right)], ["a", "b"])

    return groups.mapInArrow(pairs, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _members(compared: DataFrame, named: DataFrame) -> DataFrame:
    """(b, a, n, component, size, alone, items) of the sets of groups, compared with what is apart kept: items are what tells
    a set from the centre and other sets of the group have too, (df, item), rarest first; `alone` more are its own."""
    some = named.select("b", "a", "component")
    size = (F.length("apart") / 8).cast("int")
    members = compared.join(some, ["b", "a"]).select(F.xxhash64("a", "b").alias("pair"), "b", "a", F.col("n_a").alias("n"), "component", size.alias("size"), "apart")
    items = _apart_items(members)
    # what one set alone has meets nobody: it only takes the first places of the order
    common = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    lists = items.join(common, "item").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    # no set of a group is without items: at most the centre has its shingles
    return members.drop("apart").join(lists, "pair").drop("pair").withColumn("alone", F.col("size") - F.size("items"))


def _second_pairs(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of one group that may be similar, aren't in one component yet, and share what tells them from the centre."""
    t = float((1 - threshold) / threshold)
    # two sets that differ by d at most, d <= n (1 - t) / t, share all but d of what either has apart: one of its first d + 1
    first = F.greatest(F.floor(F.col("n") * t + 1e-6).cast("int") + 1 - F.col("alone"), F.lit(0))
    prefix = members.select("b", "a", "n", "component", "size", "alone", F.posexplode(F.slice("items", F.lit(1), first)).alias("nth", "it"))
    prefix = prefix.select(F.col("it.item").alias("item"), "a", "n", "component", "size", (F.col("alone") + F.col("nth")).alias("rank"))
    x, y = prefix.alias("x"), prefix.alias("y")
    # d <= (n_x + n_y) (1 - t) / (1 + t): they share (size_x + size_y - d) / 2 at least, so one of each prefix that leaves fewer out
    d = (F.col("x.n") + F.col("y.n")) * float((1 - threshold) / (1 + threshold)) + 1e-6
    share = F.ceil((F.col("x.size") + F.col("y.size") - d) / 2 - 1e-6)
    where = (F.col("x.item") == F.col("y.item")) & (F.col("x.a") < F.col("y.a")) & (F.col("x.component") != F.col("y.component"))
    where &= (share <= F.col("x.size") - F.col("x.rank")) & (share <= F.col("y.size") - F.col("y.rank"))
    where &= (F.col("x.n") >= F.col("y.n") * float(threshold) - 1e-6) & (F.col("y.n") >= F.col("x.n") * float(threshold) - 1e-6)
    return x.join(y, where).select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()


def _closed(compared: Saved, sets: DataFrame, labels: Saved, threshold: Fraction) -> Saved:
    """The components with the links between sets of one group that are not links to its centre."""
    rows = _open(compared, labels.df)
    for nth in range(ROUNDS):
        some = Saved(_new_centres(rows.df, nth > 0), "centres")
        asked = some.df.count()
        new = Saved(_compare(some.df, sets, threshold).where("linked").select("a", "b"), "star") if asked else None
        some.drop()
        found = new.df.count() if new else 0
        worth = found * WORTH > asked
        if found:
            labels = _joined(labels, new)
            # few links close few groups: the rows learn their components, but groups aren't looked for and joined again
            rows = _open(rows, labels.df) if worth else _named(rows, labels.df)
        if not worth:
            break
    small, large = (rows.df.where(on) for on in (F.col("many") <= PAIRED, F.col("many") > PAIRED))
    more = _side_by_side(small, sets, threshold)
    if not large.isEmpty():
        more = more.union(_second_pairs(_members(_compare(large.select("a", "b"), sets, threshold, keep=True), large), threshold)).distinct()
    more = Saved(more, "second")
    rows.drop()
    if not more.df.isEmpty():
        labels = _joined(labels, Saved(_compare(more.df, sets, threshold).where("linked").select("a", "b"), "star"))
    more.drop()
    return labels


def _joined(labels: Saved, new: Saved) -> Saved:
    """The components that more links make of those known; a set and its component's least are a link."""
    out = components(labels.df.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new.df))
    for x in (labels, new):
        x.drop()
    return out


def jaccard_components(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: documents link when the Jaccard similarity of their sets of `width`-word
    shingles is `threshold` or more; component_id is the least id that links lead to, the row's own included.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z in lower case; fewer than `width` words are one shingle. A
    null or empty text has no shingles, no links and itself as component; so does a row of null id, whose component is
    null (its text isn't compared). Rows of equal id and text give equal rows; equal ids with unlike texts are told apart
    by their sets. Other columns are not read. An empty table gives no rows. Ids are integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bands = Bands(threshold)
    signed = Saved(_signed_sets(rows, width, None), "signed")
    known = rows.where(F.col("id").isNotNull())
    # by sums over parts: of a text that a third of all rows have, each task sends one row on
    first = Saved(signed.df.where("id is not null and n > 0").groupBy("sig").agg(F.min("id").alias("id")), "first")
    keys = _signed_sets(known, width, bands)
    pairs = Saved(_first_pairs(keys), "pairs")
    wanted = pairs.df.select(F.col("a").alias("sig")).union(pairs.df.select(F.col("b").alias("sig"))).distinct()
    sets = Saved(_sets_of(known, first.df, wanted, width), "sets")
    compared = Saved(_compare(pairs.df, sets.df, threshold).drop("apart"), "compared")
    links = Saved(compared.df.where("linked").select("a", "b"), "star")
    labels = components(links.df)
    links.drop()
    labels = _closed(compared, sets.df, labels, threshold)
    # written tables on both sides of the joins: Spark then splits a component that very many sets are in
    part = Saved(first.df.join(labels.df, first.df.sig == labels.df.node, "left").select("sig", "id", F.coalesce("component", "sig").alias("part")), "parts")
    least = Saved(part.df.groupBy("part").agg(F.min("id").alias("least")), "least")
    named = Saved(part.df.join(least.df, "part").select("sig", "least"), "named")
    for x in (first, pairs, sets, labels, part, least):
        x.drop()
    # a set of no shingles is in no component; a row of null id has none
    out = signed.df.join(named.df, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id"))).alias("component_id"))
