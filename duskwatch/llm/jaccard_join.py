"""N-gram Jaccard join: an exact metric-space join of shingle sets with pivots, Voronoi regions and windows.

Jaccard distance and the size of the symmetric difference are metrics; two sets link at a similarity of
``percent`` / 100 or more.

1. Equal sets are one class. A class is a point; everything after runs on points.
2. First pivots: the single shingles. The distance of a set to ``{s}`` is below 1 only if it holds s,
   so a point belongs to the cells of its shingles alone, and in a fixed order of all shingles two
   linked sets share one of their first n - ceil(t n) + 1: these are the windows of this level.
   Frequent shingles come last in that order.
3. Large cells are split again: pivots drawn from the cell make Voronoi regions, and a point within
   twice its reach of a region's border is replicated to it (triangle inequality; distances are taken
   between vectors of counts, which never exceed the symmetric difference). Regions recurse.
4. Cells of few points join exactly: sizes and vectors bound the similarity, then sets are intersected.
5. A region that pivots cannot split is a heap of near copies. Each point is compared with its nearest
   pivots; the links make components. Points outside the largest component of their region are then a
   query set that is joined with the whole region in blocks, so no link between components is lost.

A document's component is the least id that links reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import BROADCAST_ROWS, cut, documents, keyed_rows, settled
from .words import list_array, mix, row_groups, shingle_hashes, text_buffer, word_hashes

BUCKETS = 64
#: Shingles in more cells than this come last in the order of shingles; at most MOST_FREQUENT are kept for that.
FREQUENT, MOST_FREQUENT = 64, 1 << 17
#: Points that a cell may have before it is split, pivots of a split and its levels.
REGION, PIVOTS, LEVELS = 128, 8, 3
#: Counts of the finer vectors that stand for whole sets in large joins; points and queries of a block.
FINE, BLOCK, QUERIES = 256, 1024, 4096


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _binary(rows: np.ndarray) -> pa.Array:
    """Binary column from a uint8 matrix."""
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _sets_of(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int, k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (int64, in the order of shingles), their rows and the size of each row's set."""
    words, rows = word_hashes(buf, offsets, lo, hi, lower=True)
    value, where = shingle_hashes(words, rows, k)
    value = value.view(np.int64)
    order = np.lexsort((value, where))
    value, where = value[order], where[order]
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (where[1:] != where[:-1])
        value, where = value[fresh], where[fresh]
    if len(frequent) and len(value):
        late = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
        if late.any():
            order = np.lexsort((value, late, where))
            value, where = value[order], where[order]
    return value, where, np.bincount(where, minlength=hi - lo)


def _nodes(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 16-byte name of each set, from sums of hashes of its members and its size."""
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros((len(sizes), 2), np.uint64)
    for j, salt in enumerate((0x51ED270B7A649E11, 0xA24BAED4963EE407)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value.view(np.uint64) ^ np.uint64(salt)))))
        out[:, j] = mix(sums[begin[1:]] - sums[begin[:-1]] + sizes.astype(np.uint64))
    return out.view(np.uint8).reshape(len(sizes), 16)


def _prefix(value: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum(sizes) - sizes
    many = np.where(sizes > 0, sizes - _least(sizes, percent) + 1, 0)
    return value[np.arange(len(value)) - np.repeat(begin, sizes) < np.repeat(many, sizes)], many


def _cells(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(0))
        for lo, hi in row_groups(offsets):
            value, _, sizes = _sets_of(buf, offsets, lo, hi, k, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(_prefix(value, sizes, percent)[0])], ["cell"])


def _points(batches: Iterator[pa.RecordBatch], k: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        for lo, hi in row_groups(offsets):
            value, where, sizes = _sets_of(buf, offsets, lo, hi, k, frequent)
            bucket = (value.view(np.uint64) >> np.uint64(58)).astype(np.int64)
            vector = np.minimum(np.bincount(where * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)
            first, many = _prefix(value, sizes, percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), _binary(_nodes(value, sizes)), list_array(first, many, pa.int64()), _binary(vector)],
                ["doc_id", "n", "node", "prefix", "vec"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(0))
        for lo, hi in row_groups(offsets):
            value, _, sizes = _sets_of(buf, offsets, lo, hi, k, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([_binary(_nodes(value, sizes)), list_array(value, sizes, pa.int64())], ["node", "set"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether vectors and sizes leave room for a link."""
    far = np.abs(a.astype(np.int16) - b).sum(1)
    return far * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _small_cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of points of a cell that may link; rows come sorted by cell and size, a cell has few."""
    carry = None
    schema = None

    def pairs(table: pa.RecordBatch) -> pa.RecordBatch:
        cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        vec = _matrix(table.column("vec"), BUCKETS)
        left, right = [], []
        i = np.arange(len(cell))
        for lag in range(1, len(cell)):
            i = i[i + lag < len(cell)]
            i = i[cell[i] == cell[i + lag]]
            if not len(i):
                break
            j = i + lag
            ok = (percent * n[j] <= 100 * n[i]) & (home[i] | home[j])
            a, b = i[ok], j[ok]
            ok = _close(vec[a], vec[b], n[a], n[b], percent)
            left.append(a[ok])
            right.append(b[ok])
        a = pa.array(np.concatenate(left or [np.zeros(0, np.int64)]))
        b = pa.array(np.concatenate(right or [np.zeros(0, np.int64)]))
        return pa.RecordBatch.from_arrays([table.column("node").take(a), table.column("node").take(b)], ["a", "b"])

    for batch in batches:
        schema = batch.schema
        table = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        cell = table.column("cell").to_numpy()
        if not len(cell):
            continue
        end = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
        if end:
            yield pairs(table.slice(0, end))
        carry = table.slice(end)
    if carry is not None and schema is not None:
        yield pairs(carry)


def _to_pivots(batches: Iterator[pa.RecordBatch], percent: int, star: bool) -> Iterator[pa.RecordBatch]:
    """With ``star``, pairs of each point with its two nearest pivots; else its rows in the regions whose windows it is in."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        vec = _matrix(batch.column("vec"), BUCKETS).astype(np.int16)
        pivots = batch.column("pivots")
        offsets = np.frombuffer(pivots.buffers()[1], np.int32)[pivots.offset : pivots.offset + len(pivots) + 1]
        own = np.repeat(np.arange(len(n)), np.diff(offsets))
        flat = pivots.values.slice(offsets[0], offsets[-1] - offsets[0])
        p_vec = _matrix(flat.field("vec"), BUCKETS)
        far = np.abs(vec[own] - p_vec).sum(1)
        begin = (offsets[:-1] - offsets[0]).astype(np.int64)
        nearest = np.minimum.reduceat(far, begin)
        if star:
            rank = np.empty(len(far), np.int64)
            order = np.lexsort((np.arange(len(far)), far, own))
            rank[order] = np.arange(len(far)) - begin[own[order]]
            p_n = flat.field("n").to_numpy()
            ok = np.flatnonzero((rank < 2) & (far * (100 + percent) <= (n[own] + p_n) * (100 - percent)))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own[ok])), flat.field("node").take(pa.array(ok))], ["a", "b"])
        else:
            reach = n * (100 - percent) / percent
            first = np.zeros(len(far), bool)
            at = np.flatnonzero(far == nearest[own])
            first[at[np.unique(own[at], return_index=True)[1]]] = True
            ok = np.flatnonzero(far <= nearest[own] + 2 * reach[own])
            rows = pa.array(own[ok])
            cell = batch.column("cell").to_numpy()[own[ok]]
            region = mix(cell.view(np.uint64) + mix((ok - begin[own[ok]] + 1).astype(np.uint64))).view(np.int64)
            home = first[ok] & batch.column("home").to_numpy(zero_copy_only=False)[own[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(region), batch.column("node").take(rows), pa.array(n[own[ok]]), batch.column("vec").take(rows), pa.array(home)], ["cell", "region", "node", "n", "vec", "home"])


POINT = "cell long, node binary, n long, vec binary, home boolean"


def _with_pivots(points: DataFrame, salt: int, many: int) -> DataFrame:
    """Points with ``many`` pivots of their cell at most: of each slot of a hash, the point of least hash."""
    slot = F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(many))
    least = points.groupBy("cell", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit(salt + 1), "node").alias("h"), "node", "n", "vec")).alias("p"))
    pivots = least.groupBy("cell").agg(F.sort_array(F.collect_list("p")).alias("pivots"))
    pivots = cut(pivots)
    n = pivots.count()
    return points.join(F.broadcast(pivots) if n * many <= BROADCAST_ROWS // 32 else pivots, "cell")


def _split(points: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Regions of few points, and regions that pivots cannot split, from cells of many points."""
    small, tight = None, None
    for level in range(LEVELS):
        made = _with_pivots(points, 100 + level, PIVOTS).mapInArrow(lambda b: _to_pivots(b, percent, False), "cell long, region long, node binary, n long, vec binary, home boolean")
        made = cut(made)
        was = points.groupBy("cell").agg(F.count("*").alias("was"))
        now = made.groupBy("cell").agg(F.count("*").alias("now"))
        apart = was.join(now, "cell").where("now <= 2 * was").select("cell")
        whole = points.join(apart, "cell", "left_anti")
        tight = whole if tight is None else tight.unionByName(whole)
        regions = made.join(apart, "cell", "left_semi").drop("cell").withColumnRenamed("region", "cell")
        sizes = regions.groupBy("cell").agg(F.count("*").alias("size"))
        regions = cut(regions.join(sizes, "cell"))
        few = regions.where(F.col("size") <= REGION).drop("size").select("cell", "node", "n", "vec", "home")
        small = few if small is None else small.unionByName(few)
        points = regions.where(F.col("size") > REGION).drop("size").select("cell", "node", "n", "vec", "home")
        if points.isEmpty():
            return small, tight
    return small, tight.unionByName(points)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = part.column("set")
            size = lists.value_lengths().to_numpy().astype(np.int64)
            bucket = (lists.flatten().to_numpy().view(np.uint64) >> np.uint64(56)).astype(np.int64)
            counts = np.bincount(np.repeat(np.arange(len(size)), size) * FINE + bucket, minlength=len(size) * FINE)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(size), _binary(np.minimum(counts, 255).astype(np.uint8).reshape(-1, FINE))], ["node", "n", "fine"])


def _close_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _matrix(batch.column("x"), FINE), _matrix(batch.column("y"), FINE)
        ok = pa.array(_close(x, y, batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy(), percent))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are as similar as asked: by finer vectors first, then by exact intersection."""
    left, right = fine.select(F.col("node").alias("a"), F.col("n").alias("n_x"), F.col("fine").alias("x")), fine.select(F.col("node").alias("b"), F.col("n").alias("n_y"), F.col("fine").alias("y"))
    pairs = cut(pairs.join(left, "a").join(right, "b").mapInArrow(lambda b: _close_pairs(b, percent), "a binary, b binary"))
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _block_links(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Pairs that may link, of a block of a region and its points outside the largest component."""
    a, b = [], []
    if left.num_rows and right.num_rows:
        left, right = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
        names, labels = left.column("node").to_pylist(), np.array(left.column("label").to_pylist(), object)
        fine, n = _matrix(left.column("fine"), FINE), left.column("n").to_numpy()
        queries = zip(right.column("node").to_pylist(), right.column("label").to_pylist(), _matrix(right.column("fine"), FINE), right.column("n").to_numpy(), strict=True)
        for node, label, q, n_q in queries:
            for i in np.flatnonzero(_close(fine, q[None, :], n, n_q, percent) & (labels != label)):
                a.append(node)
                b.append(names[i])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _rest_pairs(tight: DataFrame, labels: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link components of regions that pivots could not split."""
    rows = tight.select("cell", "node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = rows.groupBy("cell", "label").count()
    top = counts.groupBy("cell").agg(F.max(F.struct("count", "label"))["label"].alias("top"), F.sum("count").alias("size"), F.max("count").alias("most")).where("most < size")
    rows = cut(rows.join(top, "cell").withColumns({"blocks": F.ceil(F.col("size") / BLOCK).cast("int"), "parts": F.ceil((F.col("size") - F.col("most")) / QUERIES).cast("int")}))
    names = ["cell", "block", "part", "node", "label", "n", "fine"]
    query = rows.where("label <> top").withColumn("part", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = whole.join(fine, "node").select(names), cut(query.join(fine, "node").select(names))
    keys = ["cell", "block", "part"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda x, y: _block_links(x, y, percent), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Texts of fewer than k words are one shingle; null, empty and blank texts have none, link with nothing
    and are their own component. Repeated rows and equal sets are of one component. Rows without an id
    take part, but their id never names a component unless all of it are without. An empty table gives
    an empty table; columns other than doc_id and text are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    data = docs.select("doc_id", "text")
    cells = data.select("text").mapInArrow(lambda b: _cells(b, k, percent), "cell long").groupBy("cell").count()
    hot = cells.where(F.col("count") > FREQUENT).orderBy(F.desc("count"), "cell").limit(MOST_FREQUENT).select("cell").toPandas()
    frequent = np.sort(hot["cell"].to_numpy(np.int64))
    rows = cut(data.mapInArrow(lambda b: _points(b, k, percent, frequent), f"doc_id {kind}, n long, node binary, prefix array<bigint>, vec binary"))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("vec").alias("vec"))
    classes = cut(classes)
    member = classes.select("node", F.explode("prefix").alias("cell")).repartition("cell")  # one exchange for counts and join
    sizes = member.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    points = cut(member.join(sizes, "cell").join(classes.select("node", "n", "vec"), "node").withColumn("home", F.lit(True)))
    columns = ["cell", "node", "n", "vec", "home"]
    small, tight = points.where(F.col("size") <= REGION).select(columns), None
    large = points.where(F.col("size") > REGION).select(columns)
    if not large.isEmpty():
        more, tight = _split(large, percent)
        small = small.unionByName(more)
    near = small.repartition("cell").sortWithinPartitions("cell", "n", "node").mapInArrow(lambda b: _small_cells(b, percent), "a binary, b binary")
    if tight is not None:
        tight = cut(tight)
        near = near.unionByName(_with_pivots(tight, 300, 16).mapInArrow(lambda b: _to_pivots(b, percent, True), "a binary, b binary"))
    pairs = cut(near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    nodes = nodes.union(tight.select("node")) if tight is not None else nodes
    wanted = cut(classes.join(nodes.distinct(), "node", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct())
    sets = cut(keyed_rows(data, wanted, "doc_id", wanted.count()).select("text").mapInArrow(lambda b: _full_sets(b, k), "node binary, set array<bigint>"))
    if not sets.groupBy("node").count().where("count > 1").isEmpty():  # ids that repeat
        sets = cut(sets.dropDuplicates(["node"]))
    fine = cut(sets.mapInArrow(_fine, "node binary, n long, fine binary"))
    links = cut(_links(pairs, sets, fine, percent))
    labels = components(links)
    if tight is not None:
        more = cut(_links(cut(_rest_pairs(tight, labels, fine, percent)), sets, fine, percent))
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    labelled = classes.select("node", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = labelled.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    by_node = labelled.join(component, "label").select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(by_node, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns kept.

    Rows that share an id stay or go together; rows without an id stay.
    """
    gone = settled(lambda: join(docs, k, percent).where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))  # packed: no name of theirs can clash
    kept = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of 3-word shingles and the least id that links at 0.9 reach, as in ``join``.

    Nulls, empty texts, repeated rows, an empty table and other columns as stated there; a very long text gives its whole
    set; a likeness of just 0.9 is a link.
    """
    return join(documents(spark, sf_dir), k=3, percent=90)
