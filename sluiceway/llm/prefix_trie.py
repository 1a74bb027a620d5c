"""A trie of conversation prefixes, built as a Patricia tree.

A turn is the MD5 of its role and text, and a conversation the array of its turns' hashes; texts are read once
and not shuffled. Equal conversations become one sequence. Sequences are range-partitioned and sorted, and the
common prefix of neighbours in this order gives the tree: its points are the root, the ends of sequences and
the prefixes at which neighbours part. A task walks its sorted run with a stack of the open points and never
creates the unary nodes between them; it adds up what a point's subtree holds while it closes the point.

A subtree may span several runs. Only points on the first or the last sequence of a run can: their depths on
these sequences are found by one join of the points with the boundary sequences (two for each run) and are
opened by every run that passes them, so that each run knows the true parents, and the sums of such a point
are added over the runs. All sums are additive over sequences: with W_d the words of a sequence's first d turns,
l the prefix that it shares with its predecessor and n its conversations, the words that sharing saves below a
point at depth a are the sum of n * (W_end - W_a) less the sum of W_end - W_max(l, a).

Last, every edge is expanded: the unary nodes of an edge have the members and leaves of its lower point, and
save what the point saves and the suffix sum of the edge's words below them, times the members but one.

Turns of equal number go by the hash of role and text; repeated rows are turns of their own. Rows without a
conv_id belong to no conversation. A conversation is one row of 40 bytes a turn. An empty table gives no nodes,
not even a root. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_join
from .mixing import word_count

#: Conversations take their first turns from the first of every so many ids, and fewer turns than this.
FAMILY, SHARED = 20, 4
#: Ids are joined to texts of those that agree beyond so many bits, so that such a group has a bounded size.
ID_BITS = 12

POINT = "point string, depth int, parent string, above int, n long, low long, leaves long, spent long, fresh long, words array<long>, ends_sha256 string, edge boolean"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (t, w) in order): each turn's hash and words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    t = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), t.alias("t"), word_count(F.col("text")).alias("w")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["t"].alias("t"), x["w"].alias("w"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of its family's first; how many, its id's CRC-32 tells."""
    base = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    none = F.array().cast(convs.schema["turns"].dataType)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    joined = convs.join(base, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("shared", none), F.lit(1), h), own).alias("turns"))


def prefix(t: Column, depth: Column) -> Column:
    """The name of the prefix of this depth."""
    return F.md5(F.array_join(F.slice(t, F.lit(1), depth), "").cast("binary"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(t, sums, n, low, ends_sha256): each sequence once, with its turns' hashes, running sums of words, and conversations.

    The ids of a sequence are joined in groups that agree beyond ID_BITS; the digest of a sequence with
    several groups is carried through their texts in order, which holds one group at a time.
    """
    t = F.transform("turns", lambda x: x["t"])
    named = convs.select("conv_id", t.alias("t"), F.transform("turns", lambda x: x["w"]).alias("w")).withColumn("name", prefix(F.col("t"), F.size("t")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    grouped = named.groupBy("name", F.shiftright("conv_id", ID_BITS).alias("at")).agg(F.first("t").alias("t"), F.first("w").alias("w"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["t", "sums", "n", "low", "ends_sha256"]
        name, row, digest = None, None, hashlib.sha256()
        for df in frames:
            out = []
            for r in df.itertuples(index=False):
                if r.name == name:
                    row[2] += r.n
                    digest.update(b"," + r.ids.encode())
                    continue
                if row:
                    out.append((*row, digest.hexdigest()))
                name, row, digest = r.name, [r.t, [0, *itertools.accumulate(map(int, r.w))], r.n, r.low], hashlib.sha256(r.ids.encode())
            yield pd.DataFrame(out, columns=columns)
        if row:
            yield pd.DataFrame([(*row, digest.hexdigest())], columns=columns)

    ordered = grouped.repartition("name").sortWithinPartitions("name", "at")
    return ordered.mapInPandas(joined, "t array<string>, sums array<long>, n long, low long, ends_sha256 string")


def sorted_runs(seqs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sequences with run (the range partition), lcp (turns shared with the one before) and leaf; (run, key) of each run's two ends."""
    runs = scratch.keep(seqs.repartitionByRange("t").withColumn("run", F.spark_partition_id()), "runs")
    ends = scratch.keep(runs.groupBy("run").agg(F.min("t").alias("first"), F.max("t").alias("last")).coalesce(1), "ends")
    by_run = Window.orderBy("run")  # a row for each partition
    beside = ends.select("run", F.lag("last").over(by_run).alias("previous"), F.lead("first").over(by_run).alias("following"))
    within = Window.partitionBy("run").orderBy("t")

    def shared(a: Column, b: Column) -> Column:
        apart = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
        return F.when(a.isNull() | b.isNull(), 0).when(apart > 0, apart - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")

    before, after = F.coalesce(F.lag("t").over(within), "previous"), F.coalesce(F.lead("t").over(within), "following")
    placed = runs.join(F.broadcast(beside), "run").withColumns({"lcp": shared(before, F.col("t")), "leaf": shared(after, F.col("t")) < F.size("t")})
    # A turnless sequence is a leaf only if it stands alone.
    leaf = F.when(F.size("t") == 0, after.isNull()).otherwise(F.col("leaf"))
    placed = placed.withColumn("leaf", leaf).drop("previous", "following")
    keys = ends.select("run", F.explode(F.array("first", "last")).alias("key")).distinct()
    return scratch.keep(placed, "placed"), keys


def boundary_points(placed: DataFrame, keys: DataFrame) -> DataFrame:
    """(run, depth, point): the points that lie on a boundary sequence of a run, whichever run makes them."""
    points = placed.select(F.explode(F.array(prefix(F.col("t"), F.col("lcp")), prefix(F.col("t"), F.size("t")))).alias("point")).distinct()

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples(index=False):
                named, digest = [], hashlib.md5()
                for depth, x in enumerate(r.key, 1):
                    digest.update(x.encode())
                    named.append((r.run, depth, digest.hexdigest()))
                yield pd.DataFrame(named, columns=["run", "depth", "point"])

    on_keys = keys.mapInPandas(names, "run int, depth int, point string").distinct()
    return on_keys.join(points, "point", "left_semi")


class Run:
    """The open points of a sorted run of sequences: a stack of [depth, n, low, leaves, spent, fresh, counted, digest]."""

    def __init__(self, forced: dict[str, int]):
        self.forced = forced
        self.by_depth = sorted({d for d in forced.values() if d})
        self.stack = [[0, 0, None, 0, 0, 0, 0, None]]
        self.names, self.sums, self.turns = [hashlib.md5(b"")], [0], []
        self.started = False

    def name(self, depth: int) -> str:
        return self.names[depth].hexdigest()

    def close(self, depth: int) -> Iterator[tuple]:
        """Points deeper than `depth`, deepest first; a point is opened at `depth` where two sequences part."""
        while self.stack[-1][0] > depth:
            d, n, low, leaves, spent, new, counted, digest = self.stack.pop()
            above = max(self.stack[-1][0], depth)
            yield self.point(d, above, n, low, leaves, spent, new, digest)
            if self.stack[-1][0] < above:
                self.stack.append([above, 0, None, 0, 0, 0, counted, None])
            up = self.stack[-1]
            up[1] += n
            up[2] = low if up[2] is None else up[2] if low is None else min(up[2], low)
            up[3] += leaves
            up[4] += spent
            # Words of this edge that no sequence before has counted; those up to `counted` lie on the run's entry.
            up[5] += new + self.sums[d] - self.sums[max(above, min(counted, d))]

    def point(self, d: int, above: int, n: int, low: int, leaves: int, spent: int, new: int, digest: str | None) -> tuple:
        words = [self.sums[k] - self.sums[k - 1] for k in range(above + 1, d + 1)]
        name = self.name(d)
        return name, d, self.name(above), above, n, low, leaves, spent - n * self.sums[d], new, words, digest, name in self.forced

    def add(self, t: list[str], sums: list[int], n: int, low: int, lcp: int, leaf: bool, digest: str) -> Iterator[tuple]:
        local = lcp if self.started else 0
        yield from self.close(local)
        counted = 0 if self.started else lcp
        self.started = True
        del self.names[local + 1 :]
        for x in t[local:]:
            step = self.names[-1].copy()
            step.update(x.encode())
            self.names.append(step)
        self.sums, self.turns = sums, t
        end = len(t)
        for d in self.by_depth:
            if local < d <= end and self.forced.get(self.name(d)) == d:
                self.stack.append([d, 0, None, 0, 0, 0, counted, None])
        if self.stack[-1][0] < end:
            self.stack.append([end, 0, None, 0, 0, 0, counted, None])
        top = self.stack[-1]
        top[1] += n
        top[2] = low if top[2] is None else min(top[2], low)
        top[3] += leaf
        top[4] += n * sums[end]
        top[7] = digest

    def finish(self) -> Iterator[tuple]:
        yield from self.close(0)
        d, n, low, leaves, spent, new, _, digest = self.stack.pop()
        yield self.name(0), 0, None, -1, n, low, leaves, spent, new, [0], digest, True


def run_points(placed: DataFrame, forced: DataFrame) -> DataFrame:
    """The points that each run makes, with what the run has of their subtrees."""
    wanted = forced.groupBy("run").agg(F.collect_set(F.struct("point", "depth")).alias("forced"))  # two sequences' turns at most
    heads = placed.join(F.broadcast(wanted), "run", "left")
    first = F.row_number().over(Window.partitionBy("run").orderBy("t")) == 1
    ordered = heads.withColumn("forced", F.when(first, F.transform(F.coalesce("forced", F.array().cast("array<struct<point:string,depth:int>>")), lambda x: F.concat_ws(" ", x["depth"].cast("string"), x["point"]))))
    columns = [x.split()[0] for x in POINT.split(", ")]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        for df in frames:
            out: list[tuple] = []
            for r in df.itertuples(index=False):
                if r.forced is not None:
                    if run is not None:
                        out += run.finish()
                    run = Run({x.split()[1]: int(x.split()[0]) for x in r.forced})
                out += run.add(list(r.t), [int(x) for x in r.sums], int(r.n), int(r.low), int(r.lcp), bool(r.leaf), r.ends_sha256)
            yield pd.DataFrame(out, columns=columns)
        if run is not None:
            yield pd.DataFrame(list(run.finish()), columns=columns)

    return ordered.select("run", "t", "sums", "n", "low", "lcp", "leaf", "ends_sha256", "forced").mapInPandas(walk, POINT)


def tree(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The Patricia tree: point, depth, parent, above (the parent's depth), n, low, leaves, saved (of the point), kids, parent_low, words (of the edge), ends_sha256."""
    scratch = scratch or Scratch(conversations.sparkSession)
    convs = scratch.keep(sequences(conversations), "conversations")
    seqs = scratch.keep(distinct_sequences(rebuilt(convs)), "sequences")
    placed, keys = sorted_runs(seqs, scratch)
    made = scratch.keep(run_points(placed, boundary_points(placed, keys)), "points")
    sums = [F.first(c).alias(c) for c in ("depth", "parent", "above")] + [F.sum("n").alias("n"), F.min("low").alias("low"), *(F.sum(c).alias(c) for c in ("leaves", "spent", "fresh"))] + [F.first("words").alias("words"), F.max("ends_sha256").alias("ends_sha256")]
    spanning = made.where("edge").groupBy("point").agg(*sums)
    whole = scratch.keep(made.where("NOT edge").drop("edge").select(*spanning.columns).unionByName(spanning), "tree")
    kids = whole.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n"))
    # A parent may have a third of all points as children: such parents are broadcast.
    parents = scratch.keep(kids.join(whole.select(F.col("point").alias("parent"), F.col("low").alias("parent_low")), "parent"), "parents")
    below = hot_join(whole.where("parent IS NOT NULL").withColumnRenamed("n", "members"), parents, ["parent"], whole.count()).withColumnRenamed("members", "n")
    root = whole.where("parent IS NULL").withColumn("parent_low", F.lit(None).cast("long"))
    counted = parents.select(F.col("parent").alias("point"), F.col("n").alias("kids"))
    every = below.unionByName(root).join(counted, "point", "left").withColumn("kids", F.coalesce("kids", F.lit(0)).cast("long"))
    saved = F.col("spent") - F.col("fresh") + (F.col("n") - 1) * F.element_at("words", -1)
    return every.withColumn("saved", saved).drop("spent", "fresh")


def nodes(points: DataFrame) -> DataFrame:
    """Every node of the trie: the points, and the unary nodes of their edges by suffix sums of the edges' words."""
    spread = points.withColumn("at", F.explode(F.sequence(F.col("above") + 1, F.col("depth")))).withColumn("top", F.col("at") == F.col("above") + 1)
    at_point = F.col("at") == F.col("depth")
    # The edge's words from this node down to just above its point.
    suffix = F.aggregate(F.slice("words", F.col("at") - F.col("above"), F.col("depth") - F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spread.select(
        F.col("low").alias("conv_id"),
        F.col("at").cast("long").alias("depth"),
        F.when(F.col("top"), F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_point, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * suffix).alias("saved_tokens"),
        F.coalesce(F.when(at_point, F.col("ends_sha256")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; the columns of nodes()."""
    return nodes(tree(conversations))
