"""Cross-tokenizer alignment: groups of tokens between byte offsets at which both token sequences end.

Each text is encoded by a byte-level merge tokenizer (A) and by a piece model (B); ends of tokens are byte offsets.
An interval between shared ends is divided near its middle: the ends of A around the middle are looked up among
the ends of B by bisection, in a window that grows until one is found; both halves go on the same way, and an
interval without a shared end inside is a group. All intervals of many documents are divided at the same time, level by
level, by array operations.

Counts of id pairs that end together are taken over the whole corpus: each task adds up its own pairs, a shuffle by
pair adds those. The most frequent pairs, a bounded number, go to the tasks that hold the documents' pairs; links of
other pairs are joined by a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, documents

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that are sent to all tasks at most, and pairs that a task adds up before it hands them on.
FREQUENT, HELD = 1 << 20, 1 << 21
#: Characters of text that are aligned at a time.
CHARS = 1 << 17
# The pattern that splits text before the merges, as the tokenizer's file implies it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes no version of Unicode has changed; texts with others go through the file's own library.
_OTHER = re.compile("[^\x00-ɏ -⁯]")
_LONG_WORD = re.compile(r"[^\s]{5000}|\s{5000}")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their ids and the text of their ids with what follows them in a list of groups."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        own = json.loads(a_file)
        letters, special = byte_of_letter(), {t["content"] for t in own["added_tokens"]}
        vocabulary = {bytes(map(letters.__getitem__, t)): i for t, i in own["model"]["vocab"].items() if t not in special}
        self.a_bytes = [b""] * (max(own["model"]["vocab"].values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = t
        merged = [own["model"]["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in own["model"]["merges"]]
        self._a_file, self._fast, self._slow = a_file, None, None
        if merged == sorted(merged, key=lambda i: (i is None, i)) and sorted(vocabulary.values()) == list(range(len(vocabulary))):  # ids are in the order of the merges
            import tiktoken

            self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        words = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]
        self.words = np.array(words, object)

    def a_ids(self, text: str) -> np.ndarray:
        if self._fast is not None and not _OTHER.search(text) and not _LONG_WORD.search(text):
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._a_file.decode())
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both; none where there is no text or where the tokens' bytes are not the text's."""
        none = np.zeros(0, np.int64)
        a, b = [], []
        for text, ids in zip(texts, self._b.encode([t or "" for t in texts], num_threads=1)):
            x = self.a_ids(" " + text) if text else none
            whole = (" " + (text or "")).encode()
            fine = bool(text) and b"".join(map(self.a_bytes.__getitem__, x.tolist())) == whole and b"".join(map(self.b_bytes.__getitem__, ids)) == whole
            a.append(x if fine else none)
            b.append(np.array(ids, np.int64) if fine else none)
        return a, b


@functools.lru_cache(2)
def _pair(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def shared_ends(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rising ends of tokens) of the ends that both have.

    ``last_a`` and ``last_b`` are the places of the documents' last ends, which are shared. Intervals are pairs of
    place ranges; each ends with a shared end. Per round, an interval's window around its middle is bisected for;
    the hit nearest to the middle divides it, without one the window grows fourfold, and an interval that was searched
    whole is a group.
    """
    cuts_a, cuts_b = [last_a], [last_b]
    lo, hi = np.concatenate(([0], last_a[:-1] + 1)), last_a.copy()  # places inside: lo to hi, hi excluded; the shared end stands at hi
    blo, bhi = np.concatenate(([0], last_b[:-1] + 1)), last_b.copy()
    reach = np.ones(len(lo), np.int64)
    while True:
        open_ = (lo < hi) & (blo < bhi)
        lo, hi, blo, bhi, reach = lo[open_], hi[open_], blo[open_], bhi[open_], reach[open_]
        if not len(lo):
            break
        middle = (lo + hi - 1) // 2
        first, stop = np.maximum(lo, middle - reach + 1), np.minimum(hi, middle + reach)
        sizes = stop - first
        starts = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes)
        ends = a[places]
        hit = b[np.searchsorted(b, ends)] == ends  # the last end of all is shared, so there is always a place
        far = places - np.repeat(middle, sizes)
        near = np.minimum.reduceat(np.where(hit, 2 * np.abs(far) + (far > 0), np.iinfo(np.int64).max), starts)
        found = near < np.iinfo(np.int64).max
        cut_a = np.where(found, middle + np.where(near & 1, near >> 1, -(near >> 1)), 0)
        fa = cut_a[found]
        fb = np.searchsorted(b, a[fa])
        cuts_a.append(fa)
        cuts_b.append(fb)
        again = ~found & ((first > lo) | (stop < hi))
        lo, hi, blo, bhi, reach = (
            np.concatenate(x)
            for x in (
                (lo[found], fa + 1, lo[again]),
                (fa, hi[found], hi[again]),
                (blo[found], fb + 1, blo[again]),
                (fb, bhi[found], bhi[again]),
                (np.ones(2 * len(fa), np.int64), reach[again] * 4),
            )
        )
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _aligned(texts: list[str | None], pair: Pair) -> tuple[dict[str, np.ndarray], list[str], list[np.ndarray], list[np.ndarray]]:
    """Figures per text, digests of the groups, and each text's distinct linked pairs with their numbers."""
    a_lists, b_lists = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
    n_groups, digests = np.zeros(len(texts), np.int64), [""] * len(texts)
    pairs, numbers = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    real = np.flatnonzero(n_a)
    if len(real):
        a, b = np.concatenate([a_lists[i] for i in real]), np.concatenate([b_lists[i] for i in real])
        at_a, at_b = _starts(n_a[real]), _starts(n_b[real])
        cut_a, cut_b = shared_ends(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]), at_a[1:] - 1, at_b[1:] - 1)
        # every token's place in the written list: A's tokens of a group, then B's
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        before_b, upto_a = np.repeat(cut_b + 1 - size_b, size_a), np.repeat(cut_a + 1, size_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + before_b] = 2 * a + last_a
        written[np.arange(len(b)) + upto_a] = 2 * (len(pair.a_bytes) + b) + last_b
        words = pair.words[written].tolist()
        codes = a[cut_a] * len(pair.b_bytes) + b[cut_b]
        at_cut = np.searchsorted(cut_a, at_a)
        for k, i in enumerate(real):
            n_groups[i] = at_cut[k + 1] - at_cut[k]
            digests[i] = hashlib.sha256(b"".join(words[at_a[k] + at_b[k] : at_a[k + 1] + at_b[k + 1]])[:-1]).hexdigest()
            pairs[i], numbers[i] = np.unique(codes[at_cut[k] : at_cut[k + 1]], return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups}, digests, pairs, numbers


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _lists(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(np.array([len(p) for p in parts], np.int64)).astype(np.int32)), pa.array(np.concatenate(parts).astype(kind)))


def _align(batches: Iterator[pa.RecordBatch], files: Broadcast, code: np.dtype) -> Iterator[pa.RecordBatch]:
    pair = _pair(*files.value)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in _chunks(texts):
            figures, digests, pairs, numbers = _aligned(texts[lo:hi], pair)
            columns = [pa.array(figures["n_a"]), pa.array(figures["n_b"]), pa.array(figures["n_groups"]), pa.array(digests), _lists(pairs, code), _lists(numbers, np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "numbers"])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().astype(np.int64)


def _summed(codes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(codes, return_inverse=True)
    return own, np.bincount(at, numbers, len(own)).astype(np.int64) if len(own) else np.zeros(0, np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs and how many of its links hold them, added up a few million at a time."""
    codes, numbers, held = [], [], 0
    send = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(np.concatenate(codes), np.concatenate(numbers))], ["pair", "n"])
    for batch in batches:
        codes.append(_flat(batch, "pairs"))
        numbers.append(_flat(batch, "numbers"))
        held += len(codes[-1])
        if held > 2 * HELD:
            own = _summed(np.concatenate(codes), np.concatenate(numbers))
            codes, numbers, held = [own[0]], [own[1]], len(own[0])
            if held > HELD:
                yield send()
                codes, numbers, held = [], [], 0
    if held:
        yield send()


def _scored(batches: Iterator[pa.RecordBatch], frequent: Broadcast, rest: bool) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum over the frequent pairs; with ``rest``, the other pairs and their numbers."""
    codes, counts, best = frequent.value
    for batch in batches:
        own, numbers = _flat(batch, "pairs"), _flat(batch, "numbers")
        sizes = batch.column(batch.schema.get_field_index("pairs")).value_lengths().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
        known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
        at = np.where(known, at, 0)
        ends = _starts(sizes)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
        count_sum, n_best = (total(np.where(known, numbers * x[at], 0) if len(codes) else np.zeros(len(own), np.int64)) for x in (counts, best))
        kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("pairs", "numbers")]
        names = [f.name for f in batch.schema if f.name not in ("pairs", "numbers")]
        more = []
        if rest:
            left = np.concatenate(([0], np.cumsum(~known)))[ends].astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(left), pa.array(own[~known])), pa.ListArray.from_arrays(pa.array(left), pa.array(numbers[~known]))]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best), pa.array(count_sum), *more], [*names, "n_best", "count_sum", *["pairs", "numbers"][: len(more)]])


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    A null or empty text, and one whose tokens' bytes are not a blank and the text, has no tokens: zeros and ''.
    Repeated rows give repeated rows and count as often, null ids stay null, pairs with equal counts are all best, an
    empty table gives an empty one; only doc_id and text are read, so other columns may have any names. A very long
    text is encoded and divided whole, in one task. Both files are read by the driver; ``frequent`` bounds what is
    sent to tasks, not what is counted.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes()))
    pair = _pair(*files.value)
    width, n_codes = len(pair.b_bytes), len(pair.a_bytes) * len(pair.b_bytes)
    code, sql = (np.int32, "int") if n_codes < 2**31 else (np.int64, "long")
    data = docs.select("doc_id", "text")
    own = f"doc_id {data.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string"
    aligned = data.mapInArrow(lambda b: _align(b, files, code), f"{own}, pairs array<{sql}>, numbers array<int>")
    aligned = cut(aligned.withColumn("row_no", F.monotonically_increasing_id()))

    counts = cut(aligned.select("pairs", "numbers").mapInArrow(_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.pmod("pair", F.lit(width)).alias("b")
    highest = F.broadcast(counts.groupBy(b_id).agg(F.max("n").alias("highest")))  # one row for each id of B at most
    counts = counts.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    rest = counts.count() > frequent
    head = (counts.orderBy(F.desc("n"), "pair").limit(frequent) if rest else counts).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "best")))
    kind = f"{own}, row_no long, n_best long, count_sum long"
    scored = aligned.mapInArrow(lambda b: _scored(b, shared, rest), kind + ", pairs array<long>, numbers array<long>" * rest)
    if rest:
        scored = cut(scored)
        links = scored.select("row_no", F.explode(F.arrays_zip("pairs", "numbers")).alias("l")).select("row_no", F.col("l.pairs").alias("pair"), F.col("l.numbers").alias("times"))
        more = links.join(counts, "pair").groupBy("row_no").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best")).alias("more_best"))
        scored = scored.join(more, "row_no", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of both tokenizers, groups, links and the corpus-wide counts of the linked pairs.

    As many groups as links: a link stands at each shared end, which ends a group. Nulls, empty and very long texts,
    ties, repeated rows, an empty table and other columns as in ``align``.
    """
    return align(documents(spark, sf_dir))
