"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into words at their blanks (no piece spans a word's border). Words are exploded into substrings
of bounded length, which are equi-joined to the piece table (a broadcast of the model's fixed vocabulary);
the edges are grouped by word and folded. The public model is of the merge (BPE) kind: the path of best
score sum through its lattice is not what it encodes, so the fold applies the model's merges to the
lattice, the best-ranked edge over two neighbouring symbols first, leftmost of equals; it gives the
library's ids. Characters without a piece become their bytes.

1. The words of the whole corpus are counted. The most frequent, ``DICTIONARY`` at most, are encoded once:
   their edges are found by the equi-join, grouped by a shuffle and folded by a higher-order aggregate.
2. Texts are never exchanged: that dictionary, of bounded size, goes to the tasks that hold them. Words
   that it lacks get the same lattice and the same fold where they stand, whatever their length.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of the broadcast dictionary at most, and their length; all other words are encoded where they stand.
DICTIONARY, DICTIONARY_CHARS = 1 << 18, 48
WORD = "\n|▁+[^▁\n]*|[^▁\n]+"
_BYTE = re.compile("<0x[0-9A-F]{2}>")


def piece_table(model: str = MODEL) -> list[tuple[int, str, float]]:
    """(id, piece, score) of the model; pieces for single bytes are named ``<0xNN>``."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(i, m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i))]


def _words(text: Column) -> Column:
    """Words of the text as the model sees it: a blank in front, blanks as ``▁``; no text, no words."""
    seen = F.when(F.length(text) > 0, F.concat(F.lit("▁"), F.translate(text, " ", "▁"))).otherwise(F.lit(""))
    return F.regexp_extract_all(seen, F.lit(WORD), F.lit(0))


def words_of_text(text: str | None) -> list[str]:
    """The same words of one text in a task."""
    return re.findall(WORD, "▁" + text.replace(" ", "▁")) if text else []


def _pieces(spark: SparkSession, table: list[tuple[int, str, float]]) -> tuple[DataFrame, int]:
    """(piece, id, rank) of all pieces but single bytes, and the length of the longest."""
    own = [(p, i, -score) for i, p, score in table if not _BYTE.fullmatch(p)]
    return F.broadcast(spark.createDataFrame(own, "piece string, id int, rank double")), max(len(p) for p, _, _ in own)


def _edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, s, n, piece, id, rank) for each piece in a word and each of its characters."""
    spans = words.withColumn("s", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    spans = spans.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s")))))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("n")))
    return spans.join(pieces, "piece", "left").where("id IS NOT NULL OR n = 1")


def encode_words(words: DataFrame, model: str = MODEL) -> DataFrame:
    """(word, ids) for a table (word) of distinct words, by a fold whose cost grows with the square of a word's length."""
    table = piece_table(model)
    ids = {p: i for i, p, _ in table}
    edges = _edges(words, *_pieces(words.sparkSession, table))
    edge = F.struct("rank", F.col("s").alias("s"), (F.col("s") + F.col("n")).alias("e"), "id")
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), edge))).alias("every"))
    grouped = grouped.withColumn("many", F.filter("every", lambda x: x["e"] - x["s"] > 1))

    def merge(bounds: Column, _: Column) -> Column:
        # many is sorted by rank and place: the first that spans two symbols is merged
        fit = F.filter("many", lambda x: F.get(bounds, F.nullif(F.array_position(bounds, x["s"]), F.lit(0)).cast("int") + 1) == x["e"])
        # an array of one binds the best edge, which would else be looked for again for each bound
        return F.get(F.transform(F.array(F.get(fit, F.lit(0))), lambda best: F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b: (b <= best["s"]) | (b >= best["e"])))), F.lit(0))

    start = F.sequence(F.lit(0), F.length("word"))
    steps = F.when(F.size("many") > 0, F.sequence(F.lit(1), F.length("word") - 1)).otherwise(F.array().cast("array<int>"))
    merged = grouped.withColumn("bounds", F.aggregate(steps, start, merge))
    digits = lambda s, e: F.hex(F.encode(F.substring("word", s + 1, e - s), "UTF-8"))
    first_byte = ids["<0x00>"]

    def of_bytes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first_byte)

    def piece_ids(s: Column, i: Column) -> Column:
        e = F.get("bounds", i + 1)
        known = F.transform(F.filter("every", lambda x: (x["s"] == s) & (x["e"] == e)), lambda x: x["id"])
        return F.get(F.transform(F.array(known), lambda k: F.when(F.size(k) > 0, k).otherwise(of_bytes(digits(s, e)))), F.lit(0))

    return merged.select("word", F.flatten(F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), piece_ids)).alias("ids"))


def _dictionary(texts: DataFrame, most: int, model: str) -> DataFrame:
    """(word, ids) of the words of ``texts`` that are frequent, ``most`` at most.

    Words fall into classes by the logarithm of their count; whole classes are taken, the most frequent first.
    """
    counts = texts.select(F.explode(_words(F.col("text"))).alias("word")).where(F.length("word") <= DICTIONARY_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts.where("n > 1").select("word", F.floor(F.log2("n") * 8).cast("int").alias("grade")))
    room, least = most, 1 << 30
    for grade, n in counts.groupBy("grade").count().orderBy(F.desc("grade")).collect():  # a few hundred grades
        if n > room:
            break
        room, least = room - n, grade
    return cut(encode_words(counts.where(F.col("grade") >= least).select("word"), model))


def _fold_long(word: str, ranks: dict[str, float]) -> list[str]:
    """Symbols of a long word, by a heap of the edges over neighbouring symbols: n log n."""
    size = len(word)
    end, start = list(range(1, size + 1)), list(range(-1, size))  # end of the symbol at a place; place of the one before it
    heap = [(ranks[word[a : a + 2]], a, a + 1, a + 2) for a in range(size - 1) if word[a : a + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, m, e = heapq.heappop(heap)
        if end[a] != m or end[m] != e:
            continue
        end[a], end[m] = e, -1
        if e < size:
            start[e] = a
        for x, y in ((start[a], a), (a, e)):
            if x >= 0 and y < size and (rank := ranks.get(word[x : end[y]])) is not None:
                heapq.heappush(heap, (rank, x, y, end[y]))
    out, a = [], 0
    while a < size:
        out.append(word[a : end[a]])
        a = end[a]
    return out


def _fold(word: str, ranks: dict[str, float]) -> list[str]:
    """Symbols of one word: of the lattice's edges over two neighbouring symbols the best one is merged, leftmost of
    equals, until there is none. An edge is looked up when its two symbols come to stand side by side."""
    if len(word) > DICTIONARY_CHARS:
        return _fold_long(word, ranks)
    none, get, parts = float("inf"), ranks.get, list(word)
    near = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while near:
        best = min(near)
        if best == none:
            break
        i = near.index(best)
        parts[i] += parts.pop(i + 1)
        del near[i]
        if i < len(near):
            near[i] = get(parts[i] + parts[i + 1], none)
        if i:
            near[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


def _spelt(table: list[tuple[int, str, float]]) -> list[bytes]:
    """The bytes of each id."""
    pieces = {i: p for i, p, _ in table}
    return [bytes([int(p[3:5], 16)]) if _BYTE.fullmatch(p) else p.replace("▁", " ").encode() for p in (pieces.get(i, "") for i in range(max(pieces) + 1))]


def _text(ids: list[int], spelt: list[bytes]) -> str:
    return b"".join(map(spelt.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _encoded(batches: Iterator[pa.RecordBatch], shared: Broadcast, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Ids of whole texts: of the dictionary's words by look-up, of others by their own lattice; with ``decoded``, their text too."""
    words, offsets, ids, table = shared.value
    known = {w: ids[4 * a : 4 * b] for w, a, b in zip(words, offsets, offsets[1:])}
    ranks = {p: -score for _, p, score in table if not _BYTE.fullmatch(p)}
    numbers, first_byte, spelt = {p: i for i, p, _ in table if p in ranks}, next(i for i, p, _ in table if p == "<0x00>"), _spelt(table)

    def coded(word: str) -> bytes:
        parts = _fold(word, ranks)
        own = list(map(numbers.get, parts))
        if None in own:  # a character without a piece becomes its bytes
            own = [i for p, i in zip(parts, own) for i in ((i,) if i is not None else (first_byte + b for b in p.encode()))]
        return array("i", own).tobytes()

    names = ["doc_id", "text", "ids", *["decoded"] * decoded]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            packed = [b"".join([known.get(w) or coded(w) for w in words_of_text(t)]) for t in part.column(1).to_pylist()]
            sizes = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(sizes[-1]), [None, pa.py_buffer(b"".join(packed))])
            more = [pa.array([_text(memoryview(p).cast("i").tolist(), spelt) for p in packed], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(sizes), values), *more], names)


def encode(docs: DataFrame, model: str = MODEL, dictionary: int = DICTIONARY, decoded: bool = False) -> DataFrame:
    """(doc_id, text, ids) per row of ``docs``; with ``decoded``, the text of the ids in the same pass.

    Null and empty texts get no ids. A text's own ``▁`` decodes as a blank, as in the library. Repeated rows give
    repeated rows, null ids stay null, an empty table gives an empty table; columns other than doc_id and text
    are not read. A very long text is encoded in one task, words of any length are folded.
    """
    data = docs.select("doc_id", "text")
    coded = _dictionary(data, dictionary, model).toArrow()  # ``dictionary`` rows of words of DICTIONARY_CHARS at most
    lists = pa.concat_arrays(coded.column("ids").chunks) if coded.num_rows else pa.array([], pa.list_(pa.int32()))
    offsets = [0, *np.cumsum(lists.value_lengths().to_numpy()).tolist()]
    flat = lists.flatten().to_numpy().astype(np.int32).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast((coded.column("word").to_pylist(), offsets, flat, piece_table(model)))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>" + ", decoded string" * decoded
    return data.mapInArrow(lambda b: _encoded(b, shared, decoded), kind)


def _decoded(batches: Iterator[pa.RecordBatch], spelt: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        texts = [_text(ids.values.to_numpy().tolist() if ids.is_valid else [], spelt) for ids in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """``coded`` with a column ``decoded``: the text of ``ids`` (null ids: empty)."""
    spelt = _spelt(piece_table(model))
    kind = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])
    return coded.mapInArrow(lambda b: _decoded(b, spelt), kind)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, and whether decoding them gives the text back."""
    coded = encode(documents(spark, sf_dir), decoded=True)
    return coded.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))
