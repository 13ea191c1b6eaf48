"""What several corpus operators share: lineage cuts, executor-side caches, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.links import star_edges

#: White space that separates words: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's spark.checkpoint.dir, or a local one where none is set (tests)."""
    sc = spark.sparkContext
    if (named := sc.getConf().get("spark.checkpoint.dir")) is not None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends, or by discard()."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/t"


def discard(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path.rpartition("/")[0])
    fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spark's setting by which the shuffle files of a finished execution go at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, which survives the loss of any executor. The shuffle files that
    it took are deleted."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new plan, which heeds the setting
    finally:
        spark.conf.set(_CLEANUP, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: More keys than this can't each hold over one in HEAVY of all rows, so that many rows of a few numbers is what a join may broadcast.
HEAVY = 100_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows.join(facts, key, how), where facts has one row per key and its column n says how many rows have it, of total in all.

    Keys of over total / HEAVY rows are at most HEAVY; their facts are broadcast and their rows stay where they are. Of all
    other keys none has more than one in HEAVY of the rows, and those are shuffled. So no key, however common, gathers in a task.
    rows and facts should be cheap to read twice.
    """
    met = rows.join(F.broadcast(facts.where(F.col(n) > total // HEAVY)), key, "left")
    others = met.where(F.col(n).isNull()).select(*rows.columns)
    return met.where(F.col(n).isNotNull()).unionByName(others.join(facts.where(F.col(n) <= total // HEAVY), key, how))


#: Links of a part that one task contracts.
PART = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200, part: int = PART) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the component's smallest node.

    A distributed union-find. Links are dealt by their greater node to parts of about `part` links, whose tasks each replace
    them by stars: every node of a part's component linked to its smallest. As stars have a node at most once as the greater
    one, no node gathers more links than there were parts, however many neighbours it has. Then links to a node that is itself
    linked to a smaller one are moved there, and so on, until all stars are disjoint. Nulls and self-loops carry no link. Each
    round is checkpointed.
    """
    links = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(links.mapInArrow(_stars(part), "hi long, lo long"))
    for _ in range(max_rounds):
        e = cut(e.repartition(max(1, -(-e.count() // part)), "hi").mapInArrow(_stars(None), "hi long, lo long"))
        ends = e.select(F.col("hi").alias("n"), F.col("lo").alias("m"), F.lit(1).alias("h"), F.lit(0).alias("l")).union(e.select("lo", F.lit(None), F.lit(0), F.lit(1)))
        ends = cut(ends.groupBy("n").agg(F.min("m").alias("m"), F.sum("h").alias("h"), F.sum("l").alias("l")).where("h > 1 or (h = 1 and l > 0)"))
        if not ends.count():
            break
        e = join_hot(e, ends.where("h > 0 and l > 0").select(F.col("n").alias("lo"), "m", "l"), "lo", "l", e.count(), "left").select("hi", F.coalesce("m", "lo").alias("lo"))
    else:
        raise RuntimeError("components have not settled")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo"), F.col("lo")).distinct())


def _stars(part: int | None):
    """Contracts runs of about `part` links, or all links of a task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def out():
            node, root = star_edges(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("hi", "lo")))
            return pa.RecordBatch.from_pydict({"hi": pa.array(node, pa.int64()), "lo": pa.array(root, pa.int64())})

        for b in batches:
            held.append(b)
            size += b.num_rows
            if part and size >= part:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def deal_blocks(members: DataFrame, id_col: str, size_col: str, block: int = 512, blocks: Column | None = None, part: tuple[int, int] = (0, 1), group: str = "root") -> DataFrame:
    """members of groups of size_col rows, dealt so that every pair of a group meets in one sub-group of bounded size.

    Adds _i, _j and _own. A group of up to block rows is one sub-group (0, 0). A larger one is hashed into blocks (as many as the
    column blocks says, if given), and block pair (i, j) is a sub-group: rows of equal _own there meet in (i, i) only. With part
    (k, n), only the k-th of n shares of all sub-groups is dealt; group names a group then.
    """
    n = F.ceil(F.col(size_col) / block).cast("int") if blocks is None else blocks
    own, last = F.pmod(F.xxhash64(id_col), n).cast("int"), F.sequence(F.lit(0), n - 1)
    if part[1] > 1:
        last = F.filter(last, lambda w: F.pmod(F.xxhash64(group, F.least("_own", w), F.greatest("_own", w)), F.lit(part[1])) == part[0])
    dealt = members.withColumn("_own", own).withColumn("_with", F.explode(last))
    return dealt.withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with")).drop("_with")


def whole_groups(batches, keys: list[str], rows: int = 16_384, size: int = 16 << 20):
    """Arrow tables of complete groups, with the row at which each group starts, from batches sorted by keys. A table has about so many
    rows or bytes, and at least one group."""
    import numpy as np
    import pyarrow as pa

    held: list = []

    def starts(table):
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
                held = table.slice(at[-1]).to_batches()
            else:
                held = table.to_batches()
    if held and sum(x.num_rows for x in held):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def pair_indices(starts, n: int, own=None, crossed=None, at_once: int = 1 << 17):
    """(a, b) index arrays of all pairs within each group; in groups that are crossed, only pairs of unequal own."""
    import numpy as np

    if not n:
        return
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    row = np.arange(n)
    after = ends - row - 1
    total = np.cumsum(after)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + at_once, "right")))
        count = after[lo:hi]
        a = np.repeat(row[lo:hi], count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        if own is not None:
            fits = ~crossed[a] | (own[a] != own[b])
            a, b = a[fits], b[fits]
        if len(a):
            yield a, b
        lo = hi
