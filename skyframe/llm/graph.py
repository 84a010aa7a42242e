"""Connected components of links between documents, without a key that grows with a component.

Links are first joined inside every task, so a task passes on one pointer per node, from a node to a smaller one.  In each
round a node's pointers meet under its own key, where there is at most one from each task: the smallest stays, and the
others become pointers to it.  Then every pointer takes the step its target takes.  A target with very many
nodes is never grouped: its one pointer is a row of the small side of a join, which is broadcast when its size allows
and otherwise salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.operators.stats import attach
from skyframe.session import materialise

_POINTERS = "node bigint, root bigint"


def _pointers(a: str, b: str):
    """Rows (a, b) of a task as (node, smallest node reached), one row per node that is not the smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1)], names=["node", "root"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; ``links`` is (a, b).

    Links that repeat, run both ways or join a node to itself change nothing; without links there are no rows.
    """
    found = materialise(links.select("a", "b").mapInArrow(_pointers("a", "b"), _POINTERS), "pointers")
    while True:
        # a task has one pointer per node, so a node has no more parents than there are tasks
        parents = found.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("p"))
        single = materialise(parents.select("node", F.element_at("p", 1).alias("root"), F.slice("p", 2, F.size("p")).alias("others")), "pointers")
        joined = single.select(F.explode("others").alias("a"), F.col("root").alias("b"))
        found = single.select("node", "root")
        # the pointer of a node that is a target
        further = materialise(found.join(found.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("next")), "targets")
        others = not joined.isEmpty()
        if further.isEmpty() and not others:
            return found
        stepped = attach(found, further, ["root"], "left").select("node", F.coalesce("next", "root").alias("root"))
        if others:
            stepped = stepped.unionByName(joined.mapInArrow(_pointers("a", "b"), _POINTERS))
        found = materialise(stepped, "pointers")
