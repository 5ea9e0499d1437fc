"""Connected components of links between labels, and the shared folder where rounds are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import evenly

#: Rounds of stars after which components must be settled; else an error.
ROUNDS = 60
#: Links of one map that may be joined in one task (16 bytes each); beyond it, rounds of stars are run.
GROUP_LINKS = 2_000_000


#: Bytes in a join's memory for one of a file, at most or so: whole numbers of pixels and labels are packed tightly.
PACKED = 100

_folders: dict[tuple[str, str | None], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, which driver and executors share; it is deleted when Spark ends.

    Where that is unset, a local session, as in tests, gets a temporary folder; on a cluster it is an error, as each
    machine would write to its own disk.
    """
    app, given = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if (app, given) not in _folders:
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"{(given or 'file://' + tempfile.gettempdir()).rstrip('/')}/terrasheet-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[app, given] = at
    return _folders[app, given]


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, lost executors don't matter.

    The planner takes the files' size for that of the rows, which are up to PACKED times larger; so tables whose rows may pass
    its limit aren't broadcast, which would collect them in the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark.read.schema(df.schema).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return own.hint("merge") if size * PACKED > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() else own


def in_groups(df: DataFrame, by: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """What function makes of df's groups, the rows with equal `by`: it gets many small groups at once, one after another in a
    frame, and each of them whole. A task holds a batch of rows and one group at most.

    For groups of few rows, of which one by one most time would go into the making of frames. parts: partitions, else all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last group so far
        for rows in batches:
            if not len(rows):
                continue
            last = {c: rows[c].iloc[-1] for c in by}
            as_last = lambda own: np.logical_and.reduce([own[c].isna() if pd.isna(last[c]) else own[c] == last[c] for c in by])
            others = np.flatnonzero(~as_last(rows))
            cut = others[-1] + 1 if len(others) else 0
            if cut or held and not as_last(held[-1].iloc[-1:]).all():
                yield function(pd.concat([*held, rows.iloc[:cut]], ignore_index=True))
                held = []
            held.append(rows.iloc[cut:])
        if held:
            yield function(pd.concat(held, ignore_index=True))

    return (df.repartition(parts, *by) if parts else evenly(df, *by)).sortWithinPartitions(*by).mapInPandas(run, schema)


def groups_of(rows: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, in the order of `by`, and the first row of each group."""
    code = rows.groupby(by, dropna=False).ngroup().to_numpy()
    return code, np.unique(code, return_index=True)[1]


def dense(code: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 without gaps, in the order of (code, value), equal for equal ones."""
    order = np.lexsort((value, code))
    fresh = (code[order][1:] != code[order][:-1]) | (value[order][1:] != value[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, fresh))[: len(order)]
    return out


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links in order, and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(k) for k in range(len(nodes))]]


def connected(links: DataFrame, group_links: int = GROUP_LINKS, keys: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """(keys, node, label) for the nodes of links (keys, a, b) that aren't the least of their component: the least node.

    If no key has more than group_links links, each one's are joined in one task, with those of many other keys. Else rounds of large and small stars: a
    node's greater neighbours, then itself and its smaller ones, are linked to the least of its neighbourhood. Their number
    grows with the logarithm of the longest path.
    """
    edges = settled(links.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    most = edges.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= group_links:
        kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)

        def joined(rows: pd.DataFrame) -> pd.DataFrame:
            code, first = groups_of(rows, list(keys))
            code, node = np.tile(code, 2), np.concatenate([rows.a.to_numpy(), rows.b.to_numpy()])
            number = dense(code, node)
            at = np.unique(number, return_index=True)[1]
            nodes, least = least_reachable(number[: len(rows)], number[len(rows) :])
            other = nodes != least
            nodes, least = at[nodes[other]], at[least[other]]
            own = rows.iloc[first[code[nodes]]]
            return pd.DataFrame({**{k: own[k].to_numpy() for k in keys}, "node": node[nodes], "label": node[least]})

        return in_groups(edges, list(keys), joined, f"{kinds}, node long, label long")
    before = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.toDF(*keys, "node", "label")
        before = state
        both = edges.union(edges.select(*keys, "b", "a")).toDF(*keys, "u", "v")
        least = both.groupBy(*keys, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(lower, [*keys, "u"]).select(*keys, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settled(small.select(*keys, "e.a", "e.b").where("a <> b").distinct())
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
