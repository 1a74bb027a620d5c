"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Every document becomes a set of n-gram hashes; the order of the hashes is the global n-gram order.
Cut into more fragments than two sets over the threshold can differ in n-grams, the order has a
fragment in which both sets are the same, so equal fragments find every candidate pair. The number
of fragments follows from the size class of the smaller set. Sets are held cut into COUNTED fragments;
the overlap of a candidate pair is counted in each of these on its own, and the counts are summed. (A row
for each pair and fragment would say the same in COUNTED times the rows.) Documents with equal sets are
one class and are joined once.

There are fragments to spare: linked sets are the same in more of them than a set may leave out. Fragments
without n-grams are left out first, then those that the most classes hold (of shared passages, mostly).
All sets leave out by the same order of fragments, so the rarest one in which two linked sets are the
same stays with both, and no candidate is lost.

The classes of one fragment are not paired with one another: they are compared with two pivots and
linked, then with other pivots where they still lie in different components. A class of many large
fragments meets two pivots for them all, so that the pairs of a round grow with the classes. When few pairs of
different components are left, these are compared, which keeps every link between components while the
work on a group of near copies grows with its size. A parity sketch of each set, whose bits differ in
no more places than the sets in n-grams, tells most pairs apart before their n-grams are read; a finer
one, with fewer n-grams to a bit, does so for pairs that are close to the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, ascii_words, connected_components, fresh, mix, only, shingle_hashes, trim

#: Each size class reaches up to this times its least size.
CLASS_STEP = 1.5
#: Fragments in which a pair's overlap is counted.
COUNTED = 16
ROOM_BITS = 20
#: Fragments to spare, for each by which linked sets may differ.
SPARE = 0.3
#: A fragment held by so many classes of a task, and so large a share of them, is dealt apart from the rest.
#: Any other is held by less than 16 in a task and a thousandth of all classes, however thinly it is spread.
HOT_LEAST, HOT_SHARE, MOST_BROADCAST = 16, 0.001, 1_000_000
#: Rounds of pivots, at most, and the pairs of different components for each fragment row at which they end.
ROUNDS, FEW = 2, 2
#: A fragment of more classes is a large one: in each round a class meets twice PIVOTS pivots of all its large fragments together.
LARGE, PIVOTS = 8, 8
#: Bits of the finer sketch for each bit of the plain one, up to this size; larger plain sketches serve as both.
FINER, FINE_BITS = 4, 4096
#: Rows of a fragment in each slice of the last comparison.
SLICE = 512


def ngram_set(text: str | None, size: int, hasher: WordHasher) -> np.ndarray:
    return np.unique(shingle_hashes(hasher.of(ascii_words(text)), size))


def class_of(n: int) -> tuple[int, int, int]:
    """Size class of n: its number, least size, and the least size of the next."""
    k, low = 0, 1
    while (high := int(low * CLASS_STEP) + 1) <= n:
        k, low = k + 1, high
    return k, low, high


def fragment_plan(high: int, percent: int) -> tuple[int, int]:
    """Fragments for sets of which the smaller has under `high` n-grams, and how many of them a set may leave out.

    Sets of n and m n-grams with intersection / union >= J differ in at most (n + m)(1 - J)/(1 + J)
    n-grams. One fragment more than that has to be the same in both, and as many more as may be left out.
    """
    n = high - 1
    most = (n + n * 100 // percent) * (100 - percent) // (100 + percent)
    spare = 1 + int(SPARE * most)
    return (most + 1 + spare, spare) if most else (0, 0)


def fragment_keys(grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each fragment of a sorted set, for the size classes of all smaller sets that may link with it.

    With each its room: the number of the size class in the high bits and, in the low ROOM_BITS, how many
    more of the set's fragments for that class may be left out.
    """
    n, out, rooms = len(grams), [grams[:0]], [np.zeros(0, np.int32)]
    least, up_to = -(-n * percent // 100), n
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams))])
    while n and up_to >= least:
        k, low, high = class_of(up_to)
        fragments, spare = fragment_plan(high, percent)
        if fragments:
            of = ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
            bounds = np.searchsorted(of, np.arange(fragments + 1, dtype=np.uint64))
            keys = mix((sums[bounds[1:]] - sums[bounds[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(fragments, dtype=np.uint64) + np.uint64(k << 40))
            empty = bounds[1:] == bounds[:-1]
            room = spare - int(empty.sum())
            # Sets with more empty fragments than they can spare may agree in these alone.
            out.append(keys if room < 0 else keys[~empty])
            rooms.append(np.full(len(out[-1]), k << ROOM_BITS | min(max(room, 0), (1 << ROOM_BITS) - 1), np.int32))
        up_to = low - 1
    return np.concatenate(out), np.concatenate(rooms)


def sketch_bits(n: int) -> int:
    """A power of two, near 0.8 to 1.7 bits for each of n n-grams."""
    return max(64, 1 << int(0.84 * n).bit_length())


def fine_sketch(grams: np.ndarray) -> np.ndarray | None:
    """The finer sketch, null where the plain one is large enough; sets over the threshold have sizes within a factor of two here too."""
    bits = sketch_bits(len(grams))
    return parity_sketch(grams, min(FINER * bits, FINE_BITS)) if bits < FINE_BITS else None


def parity_sketch(grams: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bit k is set where an odd number of n-grams hash to k; of sketch_bits() bits unless others are asked for."""
    bits = bits or sketch_bits(len(grams))
    odd = np.bincount((mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_distance(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the shorter: at most the n-grams in which the sets differ."""

    def fold(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), folded).otherwise(x)

    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _class_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _classes(docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, n, component_id, component for each row of docs; component is null for empty sets (see jaccard_components)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, rows of fragments for each class of equal sets, and the fragments that many classes hold."""
        trim()
        hasher, done, seen, held = WordHasher(), set(), [], 0
        names = ["doc_id", "text_hash", "n", "key", "fragment", "room"]

        def often(classes: int) -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]), return_counts=True)
            keys = keys[count >= HOT_LEAST + classes * HOT_SHARE]
            none = pa.nulls(len(keys), pa.int64())
            return pa.record_batch([none, none, none, none, pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int32())], names)

        def rows(docs: list[tuple], found: list, rooms: list, owner: list) -> pa.RecordBatch:
            n, m = len(docs), sum(map(len, found))
            facts = [pa.array(c, pa.int64()) for c in zip(*docs, strict=True)]
            return pa.record_batch(
                [
                    *(pa.concat_arrays([c, pa.nulls(m, pa.int64())]) for c in facts[:3]),
                    pa.concat_arrays([facts[3], pa.array(np.repeat(np.array(owner, np.int64), [len(x) for x in found]))]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rooms]))]),
                ],
                names,
            )

        for batch in batches:
            facts, found, rooms, owner = [], [], [], []
            for doc, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                grams = ngram_set(text.as_py(), size, hasher)
                key = _class_id(grams)
                facts.append((doc, text_hash, len(grams), key))
                if key not in done:
                    if len(done) < 200_000:
                        done.add(key)
                    keys, room = fragment_keys(grams, percent)
                    found.append(keys)
                    rooms.append(room)
                    owner.append(key)
                    seen.append(keys)
                    held += len(keys)
                    if held > 4_000_000:
                        yield often(len(seen))
                        seen, held = [], 0
                if len(facts) == 2000:
                    yield rows(facts, found, rooms, owner)
                    facts, found, rooms, owner = [], [], [], []
            if facts:
                yield rows(facts, found, rooms, owner)
        yield often(len(seen))

    hashed = docs.select("doc_id", "text", F.xxhash64("text"))
    first = scratch.keep(hashed.mapInArrow(sketch, "doc_id long, text_hash long, n long, key long, fragment long, room int"), "sketch")
    base = scratch.keep(first.where("doc_id is not null").select("doc_id", "text_hash", "n", "key"), "base")
    index = first.where("key is not null and doc_id is null").select("fragment", "key", "room")
    # Fragments that many classes of some task hold are shared for sure: their rows need not meet in one place.
    hot = scratch.keep(first.where("key is null").select("fragment").distinct(), "hot")
    few = hot.count() <= MOST_BROADCAST
    shared = index.join(F.broadcast(hot) if few else hot, "fragment", "left_semi")
    rest = index.join(F.broadcast(hot) if few else hot, "fragment", "left_anti")
    together = Window.partitionBy("fragment")
    rest = rest.select("fragment", "key", "room", F.min("key").over(together).alias("low"), F.max("key").over(together).alias("high")).where("low <> high")
    index = scratch.keep(rest.select("fragment", "key", "room").unionByName(shared).distinct(), "shared")
    scratch.free("sketch", "hot")

    # Of its shared fragments a class leaves out as many as it has room for, those of the most classes first.
    held = index.groupBy("fragment").agg(F.count_distinct("key").alias("classes")).where("classes > 1")
    most = Window.partitionBy("key", "room").orderBy(F.desc("classes"), "fragment")
    ranked = index.join(held, "fragment").withColumn("rank", F.row_number().over(most))
    left = scratch.keep(ranked.where(F.col("rank") > F.col("room").bitwiseAND(F.lit((1 << ROOM_BITS) - 1))).select("fragment", "key").distinct(), "needed")
    ends = left.groupBy("fragment").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    index = scratch.keep(left.join(ends, "fragment"), "index")
    scratch.free("shared", "needed")

    # One text of each class that shares a fragment.
    wanted = scratch.keep(only(base, index.select("key").distinct(), ["key"]).groupBy("key").agg(F.min("doc_id").alias("doc_id")), "wanted")
    cuts = np.array([(f << 64) // COUNTED for f in range(1, COUNTED)], np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its set's size and sketches, and the n-grams of each fragment of the order."""
        trim()
        hasher = WordHasher()
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                out = []
                for text in batch.column(0).slice(k, 1000):
                    g = ngram_set(text.as_py(), size, hasher)
                    out.append((_class_id(g), len(g), parity_sketch(g), fine_sketch(g), [x.view(np.int64) for x in np.split(g, np.searchsorted(g, cuts))]))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "n", "sketch", "fine", "fragments"])

    chosen = only(docs, wanted.select("doc_id").distinct(), ["doc_id"]).select("text").mapInArrow(keyed, "key long, n long, sketch array<long>, fine array<long>, fragments array<array<long>>")
    sets = scratch.keep(only(chosen, wanted.select("key"), ["key"]).dropDuplicates(["key"]), "sets")
    facts = sets.select("key", "n", "sketch", "fine")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, na, nb) -> (u, v) of the pairs whose overlaps, counted in each fragment on its own, sum to the threshold."""
        # Sets are large, pairs are not: only those sets are moved that a pair asks for.
        pairs = scratch.keep(pairs, f"pairs{name}")
        asked = F.broadcast if pairs.count() <= MOST_BROADCAST else lambda keys: keys
        one, other = (sets.select(F.col("key").alias(x), F.col("fragments").alias(f"f{x}")).join(asked(pairs.select(x)), x, "left_semi") for x in "ab")
        partial = F.zip_with("fa", "fb", lambda x, y: F.size(F.array_intersect(x, y)))
        counted = pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", F.aggregate(partial, F.lit(0), lambda total, n: total + n).cast("long").alias("common"))
        return counted.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def near() -> Column:
        """Sizes and sketches allow the threshold."""
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        most = (F.col("na") + F.col("nb")) * (100 - percent)
        plain = sketch_distance(F.col("sa"), F.col("sb")) * (100 + percent) <= most
        return sizes & plain & (sketch_distance(F.coalesce("fa", "sa"), F.coalesce("fb", "sb")) * (100 + percent) <= most)

    side_a, side_b = (facts.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("fine").alias(f"f{x}")) for x in "ab")

    def few_pivots(rows: DataFrame) -> DataFrame:
        """(a, b): each class (key) with both pivots (xp and yp) of its small fragments, and with the first PIVOTS of each, by xo and yo, of all its large ones."""
        small = rows.where(F.col("size") <= LARGE).select("key", F.explode(F.array("xp", "yp")).alias("b"))
        sides = [rows.where((F.col("size") > LARGE) & F.col(p).isNotNull()).select("key", F.lit(p).alias("side"), F.col(o).alias("o"), F.col(p).alias("b")).distinct() for o, p in (("xo", "xp"), ("yo", "yp"))]
        large = sides[0].unionByName(sides[1])
        first = large.withColumn("place", F.row_number().over(Window.partitionBy("key", "side").orderBy("o", "b"))).where(F.col("place") <= PIVOTS)
        return small.unionByName(first.select("key", "b")).where("key <> b").select(F.col("key").alias("a"), "b").distinct()

    pivots = few_pivots(index.select("key", "size", F.col("low").alias("xo"), F.col("low").alias("xp"), F.bitwise_not("high").alias("yo"), F.col("high").alias("yp")))
    links, rows = None, index.select("fragment", "key")
    for k in range(ROUNDS + 1):
        pairs = pivots.join(side_a, "a").join(side_b, "b").where(near()).select("a", "b", "na", "nb")
        found = scratch.keep(verified(pairs, f"{k}"), f"links{k}")
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links, scratch, f"cc{k}", least=False).withColumnRenamed("node", "key")
        part = rows.join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
        held = part.groupBy("fragment", "component").agg(F.count(F.lit(1)).alias("n"))
        still = held.groupBy("fragment").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")).where("parts > 1")
        part = scratch.keep(part.select("fragment", "key", "component").join(still.select("fragment", "pairs", "members"), "fragment"), f"open{k}")
        rows = part.select("fragment", "key")
        left = part.select("fragment", "pairs").distinct().agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")).first().pairs
        if left <= FEW * part.count() or k == ROUNDS:
            break
        # Other pivots for each fragment, so that classes meet other classes than before.
        drawn = [F.min(F.struct(F.xxhash64("key", F.lit(2 * k + x)).alias("o"), F.col("key").alias("p"), F.col("component").alias("c"))).alias(f"p{x}") for x in (0, 1)]
        chosen_pivots = part.groupBy("fragment").agg(F.count(F.lit(1)).alias("size"), *drawn)
        # A pivot of the class's own component has nothing to tell it.
        told = [F.when(F.col(f"p{x}.c") != F.col("component"), F.col(f"p{x}.{c}")).alias(f"{'xy'[x]}{c}") for x in (0, 1) for c in "op"]
        pivots = few_pivots(part.join(chosen_pivots, "fragment").select("key", "size", *told))
    # What is left: classes of different components that share a fragment, told apart by their sketches
    # inside the join. The rows of a large fragment are dealt in slices, each of which meets them all.
    if left:
        full = part.join(facts, "key").withColumn("slices", F.ceil(F.col("members") / SLICE).cast("int"))
        ones = full.select("fragment", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("slice"), "component", F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("fine").alias("fa"))
        others = full.select("fragment", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("component").alias("other"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("fine").alias("fb"))
        pairs = ones.join(others, ["fragment", "slice"]).where(F.col("component") < F.col("other")).where(near()).select("a", "b", "na", "nb").distinct()
        found = scratch.keep(verified(pairs, "-last"), "links-last")
        comps = connected_components(links.unionByName(found), scratch, "cc-last", least=False).withColumnRenamed("node", "key")
    # Components of classes, then the least document of each.
    member = base.where("n > 0").join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = member.join(least, "component").select("doc_id", "text_hash", "n", "component_id", "component")
    return joined.unionByName(base.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id long, text string).

    Two rows link when 100 * intersection >= percent * union of their n-gram sets. A null or wordless
    text has an empty set, links with nothing and is its own component; a text of fewer than `size`
    words has one n-gram, all its words. A null doc_id is dropped. Rows that repeat an id are
    documents of their own; equal texts are one class. Other columns are ignored. An empty table
    gives an empty table. N-grams and classes are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    found = _classes(docs, size, percent, scratch)
    return scratch.last(found.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "components")


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component, unchanged: that with the least doc_id, of equal ids the least hash of the text.

    Of rows that repeat an id and text one stays. Rows without an id stay, and so do all documents
    without words, which are in no component. An empty table stays empty; extra columns stay, whatever
    their names.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.last(_classes(docs, size, percent, scratch).where("component is not null").select("doc_id", "text_hash", "component"), "classes")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    gone = found.join(kept, "component").where(F.struct("doc_id", "text_hash") != F.col("kept")).select("doc_id", "text_hash").distinct()
    again = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    mark, doc = fresh("_hash", docs.columns), fresh("_doc", docs.columns)
    marked = docs.withColumns({mark: F.xxhash64(F.col("text").cast("string")), doc: F.col("doc_id").cast("long")})

    def on(rows: DataFrame, name: str) -> tuple[DataFrame, Column]:
        rows = scratch.keep(rows, name)
        rows = rows.select(F.col("doc_id").alias(f"{doc}_x"), F.col("text_hash").alias(f"{mark}_x"))
        return (F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows), (F.col(doc) == F.col(f"{doc}_x")) & (F.col(mark) == F.col(f"{mark}_x"))

    left = marked.join(*on(gone, "gone"), "left_anti")
    repeats, same = on(again, "again")
    if not repeats.isEmpty():
        left = left.join(repeats, same, "left_anti").unionByName(left.join(repeats, same, "left_semi").dropDuplicates([doc, mark]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
