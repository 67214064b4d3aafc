"""Connected groups and candidate search for similarity joins; nothing is collected.

`crowded` finds the bucket keys that several nodes have, in one shuffle. `link` finds the connected groups
that a similarity makes from such buckets. In a hub turn, every node of a bucket that is not yet one group is
compared with that bucket's hub, the node that meets most others; from the second turn on with up to HUBS of
different groups. Nodes that a turn joins need no comparison with each other, so turns make
large groups of alike nodes one group in linear time. They go on while they shrink what is left, or while many
of the pairs they compare are alike. The rest is decided exactly, among the nodes that `hopeful` leaves: in each bucket that still has several groups, every pair of nodes of different groups that
has not been compared is, dealt over parts of a bounded size. Large tables of buckets are gone through in
shares of their keys, so that only one share's shuffle files are on disk at a time; results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.scratch import discard, partitions, stash, stash_all

#: Nodes outside a bucket's largest group that one task compares with the bucket.
PART = 256
#: Pairs of a group that are looked at at once.
PAIRS = 500_000
#: Hub turns end where the pairs left, before `fit`, are at most this many times the rows of the buckets.
FEW = 16
#: or where a turn leaves more than this share of the pairs that were left before it, and fewer than ALIKE of those it compared were alike;
SLOW, ALIKE = 0.85, 0.1
#: at the latest after so many turns. Hubs of a bucket from the second turn on.
TURNS, HUBS = 6, 8
#: Rows of buckets that are shuffled at once, and the most shares: each share reads the whole table.
SHARE, SHARES = 1_000_000, 4


def shares(rows: int) -> int:
    """Into how many shares of their keys so many rows are cut."""
    return min(SHARES, -(-rows // SHARE)) if rows else 1


def share(rows: DataFrame, i: int, n: int) -> DataFrame:
    """Rows of the i-th of n shares of all keys."""
    return rows if n == 1 else rows.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i)


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars already: no u has two edges or is another's v."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node each node of edges (a, b) is connected with, itself included.

    Alternates large-star and small-star steps until the edges are stars. Null ends are dropped.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        earlier, now = now, stash(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(earlier)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def neighbours(source: Iterator[pa.RecordBatch], own: tuple[str, ...] = ("node",)) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, *own), those whose key another row has, equal rows once, and the first and
    last of all: their keys may go on in the next partition. Holds one batch and one row."""
    held, shares = None, True
    for batch in source:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = table.column("key").to_numpy()
        twin = key[1:] == key[:-1]
        for name in own:
            column = table.column(name)
            twin = twin & pc.equal(column.slice(1), column.slice(0, len(key) - 1)).to_numpy()
        fresh = np.flatnonzero(np.concatenate(([True], ~twin)))
        table, key = table.take(pa.array(fresh)), key[fresh]
        up = np.concatenate(([shares], key[1:] == key[:-1]))
        chosen = np.flatnonzero(up[:-1] | (key[1:] == key[:-1]))
        if len(chosen):
            yield from table.take(pa.array(chosen)).combine_chunks().to_batches()
        held, shares = table.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(up[-1])
    if held is not None:
        yield held


def crowded(rows: DataFrame, name: str = "buckets", own: tuple[str, ...] = ("node",)) -> DataFrame:
    """Rows (key bigint, node and what else there is) whose key has two rows or more, each (key, *own) once, written.

    Rows are dealt by ranges of (key, *own), so a key of any number of nodes spreads over tasks. At a border
    between tasks a row may come along whose key no other node has. `rows` is read twice, and twice more for
    each share of many: give a written table.
    """
    n = shares(rows.count())
    ordered = (share(rows, i, n).repartitionByRange("key", *own).sortWithinPartitions("key", *own) for i in range(n))
    return stash_all((x.mapInArrow(lambda source: neighbours(source, own), rows.schema) for x in ordered), name)


def open_keys(rows: DataFrame) -> DataFrame:
    """Of rows (key, node, root): per key with several groups its largest (most), its nodes (n) and those outside the largest."""
    groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return per.select("key", F.col("m.root").alias("most"), "n", (F.col("n") - F.col("m.n")).alias("outside"))


def blocks(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Rows of open keys, dealt so that any two of one bucket with different roots are together in one group (key, i, j) or more.

    A bucket is cut into blocks of about `size`, those of its largest group apart from the others, and a group is two of
    them, the second one's rows with `far`, or one. Blocks of the largest group do not meet each other. The rows of a
    group are in one partition, one after another, those with `far` last.
    """
    some = F.col("n") > size
    parts = keys.select("key", "most", F.when(some, F.ceil(F.col("outside") / size)).otherwise(1).cast("int").alias("p"), F.when(some, F.ceil((F.col("n") - F.col("outside")) / size)).otherwise(0).cast("int").alias("q"))
    own = rows.join(parts, "key").withColumn("inside", (F.col("root") == F.col("most")) & (F.col("q") > 0))
    block = F.when(F.col("inside"), F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).otherwise(F.pmod(F.xxhash64("node"), F.col("p"))).cast("int")
    others = F.when(F.col("inside"), F.col("p")).otherwise(F.col("p") + F.col("q"))
    own = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("far", F.col("block") > F.col("other"))
    own = own.drop("most", "p", "q", "inside", "block", "other")
    # A number of partitions keeps Spark from putting groups together by their bytes: their work grows with pairs.
    return own.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "far")


def grouped(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches of `blocks` as tables of whole groups, and row numbers x and y of some of their pairs, of all in turn."""

    def parts(table: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(new))
        far = np.concatenate(([0], np.cumsum(table.column("far").to_numpy())))
        nears = (ends - first) - (far[ends] - far[first])
        near = np.flatnonzero(np.diff(far) == 0)
        owner = np.searchsorted(first, near, "right") - 1
        # A row meets all of the other block, or those behind it in its own.
        begin = np.where(nears[owner] < (ends - first)[owner], first[owner] + nears[owner], near + 1)
        alone = table.column("i").to_numpy()[near] < table.column("j").to_numpy()[near]
        times = np.where(alone & (nears[owner] == (ends - first)[owner]), 0, ends[owner] - begin)
        at = 0
        sums = np.cumsum(times)
        while at < len(near):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
            own = times[at:to]
            x = np.repeat(near[at:to], own)
            yield table, x, np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(begin[at:to], own)
            at = to

    held = None
    for batch in source:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        names = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in names])))
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield from parts(table.slice(0, cut).combine_chunks(), new[:cut])
        held = table.slice(cut)
    if held is not None:
        yield from parts(held.combine_chunks(), np.arange(held.num_rows) == 0)


def across(rows: DataFrame, keys: DataFrame, fit: Column, times: Column | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of one bucket with different roots that fit: in how many buckets (n) and `times`. rows: key, node, root, mark.

    One side of such a pair is outside its bucket's largest group, so nodes of that group do not meet each
    other. Those outside are dealt over parts of about PART, so that no task gets a whole large bucket.
    `times`: in how many buckets a pair must fit, from mark and x_mark of one of them.
    """
    keys = keys.select("key", "most", F.ceil(F.col("outside") / PART).cast("int").alias("parts"))
    own = rows.join(keys, "key").withColumn("outside", F.col("root") != F.col("most"))
    left = own.filter("outside").select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("mark").alias("x_mark"))
    right = own.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "root", "mark", "outside")
    met = left.join(right, ["key", "part"]).filter((F.col("root") != F.col("x_root")) & (~F.col("outside") | (F.col("x") < F.col("node"))) & fit)
    met = met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), (F.lit(1) if times is None else times).alias("times"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"))


def with_hubs(rows: DataFrame, keys: DataFrame | None, fit: Column, turn: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, of nodes and hubs of their buckets that fit. rows: key, node, root, mark, meets; keys: the open ones, if not all are.

    A bucket's hub is the node outside its largest group that meets most others. Of open buckets, groups are dealt
    over HUBS lots, another deal each turn, and each lot has a hub: the node of all that meets most others is often like none of them.
    """
    if keys is None:
        own, inside, lot = rows, F.lit(0), ()
    else:
        own = rows.join(keys.select("key", "most"), "key")
        inside = (F.col("root") == F.col("most")).cast("int")
        lot = (F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(HUBS)).alias("lot"),)
    order = F.struct(inside, -F.col("meets"), "node")
    hubs = own.groupBy("key", *lot).agg(F.min_by(F.struct(F.col("node").alias("hub"), F.col("root").alias("hub_root"), F.col("mark").alias("hub_mark")), order).alias("h")).select("key", "h.*")
    return own.join(hubs, "key").filter(fit & (F.col("root") != F.col("hub_root"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def link(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, mark: str | None = None, fit: Callable[[str, str], Column] | None = None, times: Callable[[str, str], Column] | None = None, hopeful: Callable[[DataFrame], DataFrame] | None = None, able: Callable[[str, str], Column] | None = None,
    meet: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, root) of all nodes with a verified link. buckets: a written table (key, node), keys crowded; it is deleted once read.

    verify takes pairs (a, b), a < b, and returns those that are alike. With `mark`, buckets
    also have a column of that name, and nodes whose marks do not `fit` are known to be unlike.
    `times` is the number of buckets that nodes with such marks share if they are alike, 1 if left out.
    hopeful takes the nodes (node) that the last turn would compare and returns (node, hope) of those of them that can
    be alike to another of them; nodes whose hopes are not `able` are known to be unlike. A node's marks are then the same in all its buckets.
    meet takes the last turn's rows (key, node, root, mark) and open keys (see open_keys) and returns a written table of the
    alike pairs (a, b) that `across` and verify would; without it, those have a row for each pair.
    """
    plain = buckets.select("key", "node", (F.lit(0) if mark is None else F.col(mark)).alias("mark"))
    # How many rows a node meets in its buckets: copies of one original have more in common with it than with each other.
    meets = plain.join(plain.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("node").agg(F.sum("n").alias("meets"))
    plain = stash(plain.join(meets, "node"), f"{name}-met")
    discard(buckets)
    fits = (lambda a, b: F.lit(True)) if fit is None else fit
    labels, tested, turn, before, alike, size = None, [], 0, None, 1.0, 0
    while True:
        if turn == 0:
            last, rows, keys = False, plain.withColumn("root", F.col("node")), None
            dealt = size = plain.count()
        else:
            rows = plain.withColumn("root", F.col("node")) if labels is None else plain.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            rows = stash(rows, f"{name}-rows")
            keys = stash(open_keys(rows), f"{name}-open")
            left, held, spread = keys.agg(F.sum(F.col("outside") * F.col("n")), F.sum("n"), F.sum(F.col("n") * F.ceil(F.col("outside") / PART))).first()
            if not left:
                break
            if 4 * held < 3 * size:
                # A bucket that is one group stays one: its rows have served.
                whole, rows, size = rows, stash(rows.join(keys.select("key"), "key", "left_semi"), f"{name}-rows"), held
                discard(whole, plain)
                plain = stash(rows.drop("root"), f"{name}-met")
            last = left <= FEW * held or turn >= TURNS or before is not None and left > SLOW * before and alike < ALIKE
            if last and hopeful is not None:
                all_rows, all_keys = rows, keys
                rows = rows.join(keys.select("key"), "key", "left_semi")
                rows = rows.join(hopeful(rows.select("node").distinct()), "node")
                rows = rows.join(rows.groupBy("node").agg(F.collect_list("key").alias("own")), "node").withColumn("mark", F.struct("mark", "hope", "own")).drop("hope", "own")
                rows = stash(rows, f"{name}-rows")
                keys = stash(open_keys(rows), f"{name}-open")
                discard(all_rows, all_keys)
                left, held, spread = keys.agg(F.sum(F.col("outside") * F.col("n")), F.sum("n"), F.sum(F.col("n") * F.ceil(F.col("outside") / PART))).first()
                if not left:
                    break
            before, dealt = left, spread if last else held
        if last and meet is not None:
            found = meet(rows, keys)
            if not found.isEmpty():
                edges = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
                labels = components(edges, f"{name}-roots")
            discard(found, rows, keys)
            break
        n, several = shares(int(dealt)), None
        cut = [(share(rows, i, n), keys if keys is None else share(keys, i, n)) for i in range(n)]
        if last:
            both = fits("mark", "x_mark") if hopeful is None else fits("mark.mark", "x_mark.mark") & able("mark.hope", "x_mark.hope")
            if hopeful is not None and times is None:
                # A pair that fits in one of its buckets fits in all: the smallest key gives it.
                both = both & (F.array_min(F.array_intersect("mark.own", "x_mark.own")) == F.col("key"))
            met = [across(*x, both, None if times is None else times("mark", "x_mark")) for x in cut]
        else:
            met = [with_hubs(*x, fits("mark", "hub_mark"), turn) for x in cut]
        if n > 1:
            several = stash_all(met, f"{name}-shares")
            # A pair may be met in several shares.
            pairs = several.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("times").alias("times")) if last else several.distinct()
        else:
            pairs = met[0]
        if last:
            pairs = pairs.filter("n >= times").select("a", "b")
        if tested:
            # All earlier turns at once: a join for each would shuffle, and make, the same pairs again.
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = stash(pairs, f"{name}-pairs")
        discard(several)
        turn += 1
        found = stash(verify(pairs), f"{name}-edges")
        alike = (edges_found := found.count()) / max(1, pairs.count())
        if edges_found:
            edges = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
            labels = components(edges, f"{name}-roots")
        if last:
            break
        tested.append(pairs)
        discard(found, *([rows, keys] if keys is not None else []))
    discard(*tested, plain)
    if labels is None:
        kind = buckets.schema["node"].dataType
        return buckets.sparkSession.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    return labels
