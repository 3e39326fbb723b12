"""Substring dedup: lines and their sentences are hashed, repeated ones are removed but for their first place.

Sentences within lines (a paragraph is a line) are normalised (lower case, single blanks). A sentence of
``UNIT_WORDS`` words or more is a unit; a shorter one is joined with those after it, and with those before
it, to units of ``JOINED_WORDS`` words. Digests of units are grouped over the whole corpus, and the earliest
by (doc_id, offset) keeps its place. Repeated units that follow one another make a passage; passages of
``PASSAGE_WORDS`` words or more are removed, with their original offsets (code points) and the document that
keeps the text. A whole line that repeats an earlier whole line goes whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, documents, keyed, text_digests, unpacked, with_found

#: Shorter sentences are joined to units of JOINED_WORDS; a passage of repeated units has at least PASSAGE_WORDS words.
UNIT_WORDS, JOINED_WORDS, PASSAGE_WORDS = 3, 8, 20
_UNIT = re.compile(r"[^\n.!?…]+[.!?…]*|[.!?…]+")
SPAN = "struct<start:bigint,`end`:bigint,words:bigint,keeper:bigint,keepers:array<bigint>>"
#: A digest is frequent from so many units on; beyond 2^19 x this many units the bound grows, so frequent digests are 2^19 at most.
FREQUENT = 1 << 14


def _digest(words: list[str], kind: bytes) -> bytes:
    return blake2b(" ".join(words).lower().encode(), digest_size=16, person=kind).digest()


def _line_units(own: list[tuple[int, int, int, list[str]]]) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """Units of one line, from its sentences (place of the first word, start, end, words)."""
    joined = set()
    for i, (_, _, _, words) in enumerate(own):
        if len(words) >= UNIT_WORDS:
            joined.add((i, i))
            continue
        for step in (1, -1):
            n, j = len(words), i
            while n < JOINED_WORDS and 0 <= j + step < len(own):
                j += step
                n += len(own[j][3])
            if n >= JOINED_WORDS:
                joined.add((min(i, j), max(i, j)))
    for i, j in joined:
        words = own[i][3] if i == j else [w for x in own[i : j + 1] for w in x[3]]
        yield own[i][0], own[i][1], own[j][2], len(words), False, _digest(words, b"" if i == j else b"joined")
    words = [w for x in own for w in x[3]]
    if len(words) < PASSAGE_WORDS:  # the units of a longer line cover it
        yield own[0][0], own[0][1], own[-1][2], len(words), True, _digest(words, b"line")


def units(text: str) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """(ord, start, end, words, line, digest) of each unit of a text, and of each line of fewer than
    ``PASSAGE_WORDS`` words; ord is the place of its first word, the end is exclusive and leaves out blanks."""
    at = offset = 0
    for line in text.split("\n"):
        own = []
        for m in _UNIT.finditer(line):
            words = m.group().split()
            if words:
                start, end = m.span()
                own.append((at, offset + start + len(m.group()) - len(m.group().lstrip()), offset + end - len(m.group()) + len(m.group().rstrip()), words))
                at += len(words)
        if own:
            yield from _line_units(own)
        offset += len(line) + 1


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "k1", "k2", "ord", "start", "end", "words", "line", "digest"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows, cols = [], ([], [], [], [], [], [])
            for i, text in enumerate(part.column(3).to_pylist()):
                for unit in units(text or ""):
                    rows.append(i)
                    for col, v in zip(cols, unit, strict=True):
                        col.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in range(3)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def spans_of(own: list[dict], least: int) -> list[dict]:
    """Passages of ``least`` words or more of sorted repeated units, and the whole lines outside of them."""

    def runs(some: list[dict], gap: int) -> list[dict]:
        spans: list[dict] = []
        to = -1
        for u in some:
            if spans and u["ord"] <= to - gap:
                to = max(to, u["ord"] + u["words"])
                spans[-1]["end"] = max(spans[-1]["end"], u["end"])
                spans[-1]["words"] = to - spans[-1]["ord"]
                spans[-1]["keepers"].add(u["keeper"])
            else:
                to = u["ord"] + u["words"]
                spans.append({k: u[k] for k in ("ord", "start", "end", "words", "keeper")} | {"keepers": {u["keeper"]}})
        return spans

    out, lines, at = [], runs([u for u in own if u["line"]], 1), 0
    for run in runs(own, 0):
        inside = []
        while at < len(lines) and lines[at]["ord"] < run["ord"] + run["words"]:
            inside.append(lines[at])
            at += 1
        out += [run] if run["words"] >= least else inside
    return [{k: s[k] for k in ("start", "end", "words", "keeper")} | {"keepers": sorted(s["keepers"], key=lambda x: (x is None, x))} for s in out]


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [spans_of(own, least) for own in batch.column(3).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("keeper", pa.int64()), ("keepers", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], ["doc_id", "k1", "k2", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, spans) of the rows with something to remove; spans are sorted and don't overlap, and name all
    documents that keep a part of them. Frequent digests, a bounded number, are sent to the tasks that hold the units.

    Null and empty texts have no units. Rows that repeat an id and its text count as one document,
    told from others by the digests k1 and k2 of the text; rows without an id rank last. An empty table gives an empty table; columns other
    than doc_id and text are not read.
    """
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_digests(), "text")
    rows = cut(data.mapInArrow(_unit_rows, "doc_id long, k1 long, k2 long, ord int, start int, `end` int, words int, line boolean, digest binary"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2", "start", "end")
    many = rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    # what overlaps its own first place stays, else nothing would keep the text
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))
    apart = other | (F.col("start") >= F.col("first.end"))
    many = cut(many)
    least = max(FREQUENT, rows.count() >> 19)
    hot = F.broadcast(many.where(F.col("n") > least).drop("n"))
    common = rows.join(F.broadcast(many.where(F.col("n") > least).select("digest")), "digest", "left_anti").join(many.where(F.col("n") <= least).drop("n"), "digest")
    later = rows.join(hot, "digest").unionByName(common).where(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2", "start", "end") > F.col("first")).where(apart)
    found = later.groupBy("doc_id", "k1", "k2").agg(F.array_sort(F.collect_set(F.struct("ord", "start", "end", "words", "line", F.col("first.doc_id").alias("keeper")))).alias("us"))
    return found.mapInArrow(lambda b: _merge(b, PASSAGE_WORDS), f"doc_id long, k1 long, k2 long, spans array<{SPAN}>").where(F.size("spans") > 0)


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of their texts, all columns kept; n_chars, where present, follows."""

    def without(text, own):
        cuts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("end"))), F.transform(own, lambda s: F.struct(s["end"].alias("end"))))
        stops = F.concat(F.transform(own, lambda s: s["start"]), F.array(F.length(text).cast("long")))
        return F.array_join(F.zip_with(cuts, stops, lambda a, b: F.substring(text, a["end"].cast("int") + 1, (b - a["end"]).cast("int"))), "")

    both = with_found(keyed(docs), spans)
    return unpacked(both, docs.columns, F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("spans"))))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what is removed, with offsets and the documents that keep it."""
    docs = documents(spark, sf_dir)
    keys = docs.select(F.col("doc_id").alias("id"), *text_digests(), F.length("text").cast("long").alias("n_chars"))  # the text itself stays out of the exchange
    rows = with_found(keys, repeated_passages(docs)).withColumnRenamed("id", "doc_id")
    cuts = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    return rows.select(
        "doc_id", "n_chars", F.size(cuts).cast("long").alias("n_removed"), F.aggregate(cuts, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.transform(cuts, lambda s: s["start"]).alias("starts"), F.transform(cuts, lambda s: s["end"]).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.transform(cuts, lambda s: s["keepers"])))).alias("kept_in"),
    )
