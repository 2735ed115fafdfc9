"""Connected components of links between texts, by joins and minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise

# Links a task gathers before it reduces and hands them on.
GATHERED = 1_000_000
KIND = "a long, b long"


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: the least node reachable, of every node in a link.

    ``links`` has columns ``a`` and ``b``; null ends are left out. Each round gives
    a link's lesser end way to the least node below it, by a join, and then connects
    all that one node has links to, until every node has one link, to a node that
    has none. The number of rounds grows with the logarithm of the longest path.
    Links are stored first and reduced in as few tasks as ``GATHERED`` links each allow:
    few links need no round at all, and a group of many links that all tasks found is
    not reduced to as many copies of itself. After that each task has at most one link
    for each node before links are dealt by node, so a node brings together no more
    links than tasks wrote.
    """
    proper = materialise(links.select("a", "b").where("a != b"), "links")
    tasks = max(1, -(-proper.count() // GATHERED))
    links = materialise(proper.coalesce(tasks).mapInArrow(_reduced, KIND), "links")
    while tasks > 1 and not _settled(links):
        least = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        moved = links.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        links = materialise(_met(moved), "links")
    links = links.distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node of these links to the least it reaches by them."""
    names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = places[: len(a)], places[len(a) :]
    least = np.arange(len(names))
    while True:
        before = least.copy()
        x, y = least[one], least[other]
        # Both ends and what they pointed at take the lesser of the two.
        low = np.minimum(x, y)
        for at in (one, other, x, y):
            np.minimum.at(least, at, low)
        while not np.array_equal(further := least[least], least):
            least = further
        if np.array_equal(least, before):
            break
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[moved], names[least[moved]]


def _reduced(batches):
    """The links of a task, reduced to one for each node of at most about twice ``GATHERED`` links."""
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size > 2 * GATHERED:
            a, b = (np.concatenate(x) for x in zip(*held))
            # The links of the last node may go on in the next batch.
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if (a != a[-1]).any() else 0
            if cut:
                yield _batch(*_forest(a[:cut], b[:cut]))
            held, size = [(a[cut:], b[cut:])], len(a) - cut
    if size:
        yield _batch(*_forest(*(np.concatenate(x) for x in zip(*held))))


def _met(links: DataFrame) -> DataFrame:
    """Links ``a > b`` that connect the same nodes, after all links of one ``a`` have met."""
    return links.repartition("a").sortWithinPartitions("a").mapInArrow(_reduced, KIND)


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _settled(links: DataFrame) -> bool:
    """Whether every node has links to one node at most, and to none if it ends one."""
    begun = links.select(F.col("a").alias("node"), "b")
    ended = links.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b"))
    by_node = begun.unionByName(ended).groupBy("node").agg(
        F.min("b").alias("least"), F.max("b").alias("most"), F.max(F.col("b").isNull()).alias("ends")
    )
    return by_node.where("least < most or (least is not null and ends)").isEmpty()
