"""Secret scans: fixed patterns, and novelty of strings beside sensitive words under a primed zstandard.

One pass over the texts finds the spans of the fixed patterns and the candidates: runs of 16 or more characters
that keys are written in, begun within 64 characters after a sensitive word, with both letters and digits or with
changing case. Only spans, candidates and the text around them go on. Identifiers near candidates are counted over
the whole corpus, once for each distinct window, so that copies weigh nothing; the most frequent ones, a bounded
number, prime the compressor together with the text on both sides. A candidate's marginal bytes are what it adds to
an empty frame; they are set against the bytes that a random string of its alphabet needs. Names, words of the
dictionary and strings that the surrounding text repeats cost a few bytes; a key costs its full length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, documents

#: Patterns of the contract, in the order of their kinds, with the least number of characters (of group 2, or of all).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run of 32 or more is the same match as a whole run, filtered by length
)
KINDS = ("assign", "access", "hex", "novel")
#: Words that make the characters after them sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "authorization", "private_key", "access_key", "privatekey", "accesskey")
NEAR, WINDOW, LEAST = 64, 256, 16
#: Identifiers that prime the compressor at most, and the share of a random string's bytes from which a candidate counts as incompressible.
IDENTIFIERS, NOVEL = 2000, 0.9

_BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT = re.compile("|".join(SENSITIVE), re.ASCII | re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_IDENTIFIER = r"[A-Za-z_]{3,24}"


def _list_of(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


def _ddl(kind: pa.DataType) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return "array<struct<" + ", ".join(f"{f.name}: {names[f.type]}" for f in kind.value_type) + ">>"


_SPAN = _list_of(kind=pa.string(), start=pa.int64(), end=pa.int64())
_CANDIDATE = _list_of(start=pa.int64(), end=pa.int64(), value=pa.string(), before=pa.string(), after=pa.string())
_NOVEL = _list_of(start=pa.int64(), end=pa.int64(), value=pa.string(), marginal=pa.int64(), novelty=pa.float64())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap within a kind, by start and kind."""
    low = text.lower()  # only tells whether a word can be there at all
    possible = {"assign": any(w in low for w in _BASE_WORDS), "access": "AKIA" in text, "hex": True}
    found = [(m.start(), k, m.end()) for k, (kind, pattern, group, least) in enumerate(BASE) if possible[kind] for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def mixed(value: str) -> bool:
    """Two letters and two digits, or three changes of case: unlike a plain word."""
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    turns = sum(a.isupper() != b.isupper() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
    return digits >= 2 and letters >= 2 or turns >= 3


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the runs that begin at most ``NEAR`` characters after a sensitive word, each once, in order."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found: dict[int, int] = {}
    done = 0  # a run is looked at once, however many sensitive words stand before it
    for word in _CONTEXT.finditer(text):
        at = max(word.end(), done)
        while at <= word.end() + NEAR and (run := _RUN.search(text, at, word.end() + NEAR + LEAST)):
            run = _RUN.match(text, run.start())  # to its own end
            if run.start() - word.end() > NEAR:
                break
            if mixed(run[0]):
                found[run.start()] = run.end()
            at = done = run.end()
    return sorted(found.items())


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            spans, near = [], []
            for text in part.column(1):
                text = text.as_py() or ""
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)])
                near.append([{"start": a, "end": b, "value": text[a:b], "before": text[max(a - WINDOW, 0) : a], "after": text[b : b + WINDOW]} for a, b in candidates(text)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPAN), pa.array(near, _CANDIDATE)], ["doc_id", "base", "near"])


def capacity(value: str) -> int:
    """Bytes that a random string of this length and alphabet (hex digits, else 64 characters) needs."""
    return max(1, math.ceil(len(value) * (4 if re.fullmatch("[0-9a-fA-F]+", value) else 6) / 8))


def marginal_bytes(value: str, around: bytes, identifiers: bytes) -> int:
    """Bytes that ``value`` adds to an empty frame of a compressor primed with identifiers and the text around."""
    primer = identifiers + around
    level = zstandard.ZstdCompressionParameters.from_level(19, source_size=len(value), dict_size=len(primer), write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
    press = zstandard.ZstdCompressor(compression_params=level, dict_data=words)
    return len(press.compress(value.encode())) - len(press.compress(b""))


def identifiers_near(found: DataFrame, most: int) -> list[str]:
    """The most frequent identifiers (letters and ``_``) around candidates, ``most`` at most, rarest first.

    Each distinct window counts once. The sensitive strings themselves are no part of a window.
    """
    windows = found.select(F.explode("near").alias("c")).select("c.before", "c.after").distinct()
    words = windows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", "before", "after"), F.lit(rf"\b{_IDENTIFIER}\b"), F.lit(0)))).alias("word"))
    top = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(most)
    return [r.word for r in top.collect()][::-1]  # ``most`` words of 24 letters at most


def scan(docs: DataFrame, most: int = IDENTIFIERS, novel: float = NOVEL) -> DataFrame:
    """(doc_id, base, novel) per row of ``docs``: spans of the fixed patterns, and of incompressible strings
    outside them as array<struct<start, end, value, marginal, novelty>>.

    Null and empty texts have no spans. Repeated rows give repeated rows, null ids stay null, an empty table gives
    an empty one; only doc_id and text are read, so other columns may have any names. A very long text is
    scanned whole, text by text; what goes on of it are windows of ``WINDOW`` characters. Identifiers of equal
    count are taken in the order of their letters.
    """
    data = docs.select("doc_id", "text")
    id_type = data.schema["doc_id"].dataType.simpleString()
    found = cut(data.mapInArrow(_found, f"doc_id {id_type}, base {_ddl(_SPAN)}, near {_ddl(_CANDIDATE)}"))
    primer = "\n".join(identifiers_near(found, most)).encode()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, near in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = []
                for c in near:
                    if any(s["start"] <= c["start"] and c["end"] <= s["end"] for s in base):
                        continue  # reported already
                    cost = marginal_bytes(c["value"], c["after"].encode() + c["before"].encode(), primer)
                    share = cost / capacity(c["value"])
                    if share >= novel:
                        own.append({"start": c["start"], "end": c["end"], "value": c["value"], "marginal": cost, "novelty": share})
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _NOVEL)], ["doc_id", "base", "novel"])

    return found.mapInArrow(measured, f"doc_id {id_type}, base {_ddl(_SPAN)}, novel {_ddl(_NOVEL)}")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts and digest of the fixed patterns' spans, and all spans with the incompressible strings.

    A null or empty text has no spans: counts of 0, the digest of an empty string and empty ``spans``. Repeated rows,
    null ids, other columns, very long texts and an empty table as in ``scan``.
    """
    found = scan(documents(spark, sf_dir))
    mark = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = F.transform("novel", lambda s: F.struct(F.lit("novel").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(F.array_join(F.transform("base", mark), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, mark), ",").alias("spans"), F.size("novel").cast("long").alias("n_novel"),
    )
