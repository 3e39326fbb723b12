"""Connected components of link tables, by DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop links that close a cycle within 100,000 links: what is left joins the same nodes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100_000):
            part = batch.slice(at, 100_000)
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            up: dict = {}

            def root(x, up=up):
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    keep.append(i)
            yield part.take(pa.array(keep, pa.int64()))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): label is the least node that links reach.

    Rounds of neighbour minimum and pointer jumping until nothing changes; each round is written to
    the shared folder. Null ends and loops are ignored; an empty table gives an empty table. Ties and
    repeated links change nothing.
    """
    kind = links.schema["a"].dataType
    clean = links.select("a", F.col("b").cast(kind)).where("a is not null and b is not null and a <> b")
    clean = cut(clean.select("a", "b").mapInArrow(_forest, clean.select("a", "b").schema).distinct())
    both = cut(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        step = step.join(top, "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = cut(step)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
