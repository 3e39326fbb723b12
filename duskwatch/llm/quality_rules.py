"""Quality rules, line first: judge each line, drop the failed ones, then reject a document that lost too much."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import documents, unpacked
from .words import PIECE, row_groups, shingle_hashes, text_buffer, word_hashes, word_spans

SPACE = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    #: A line of at least so many words has to hold one of ``.!?:;`` or a closing quote.
    long_line: int = 8
    #: Navigation: of the words of a line, more than this percentage are separators.
    separators: int = 20
    #: Punctuation: of the words of a line, more than this percentage are outdone in number by symbols and doubled ``!!``.
    symbols: int = 30
    #: A document is rejected if more than this percentage of its word characters stood in failed lines.
    lost: int = 50


#: Separators of menus, and marks of boilerplate.
SEPARATOR_WORDS = ("|", "»", "«", ">", "<", "·", "•", "/", "::", "-")
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie", "all rights reserved", "terms of use", "privacy policy",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal",
)
_MARKS = re.compile("|".join(map(re.escape, BOILERPLATE)))
#: A line of code opens a block at its end or closes one at its beginning.
CODE = r"\{\s*$|^\s*\}"
_CODE = re.compile(CODE)
_STOP = re.compile("[.!?:;…。！？]")
_NOISE = re.compile("[#*$%&|<>~^=]|!!")
_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")


def line_fails(words: list[str], line: str, rules: LineRules = LineRules()) -> str | None:
    """The first rule that a line with words breaks: ``navigation``, ``boilerplate``, ``punctuation`` or None."""
    if 100 * sum(w in SEPARATOR_WORDS for w in words) > rules.separators * len(words):
        return "navigation"
    if _MARKS.search(line.lower()) or _CODE.search(line):
        return "boilerplate"
    if 100 * len(_NOISE.findall(line)) > rules.symbols * len(words):
        return "punctuation"
    if len(words) >= rules.long_line and not _STOP.search(line):
        return "punctuation"
    return None


def clean_text(text: str, rules: LineRules = LineRules()) -> tuple[str, int, int, int]:
    """The text without failed lines, word characters lost, lines failed and repeated lines with a word."""
    keep, lost, failed, again, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        words = _BLANKS.split(line.strip(SPACE))
        if words == [""]:
            keep.append(line)
            continue
        again += line in seen
        seen.add(line)
        if line_fails(words, line, rules):
            failed += 1
            lost += sum(map(len, words))
        else:
            keep.append(line)
    return "\n".join(keep), lost, failed, again


def _repeated_words(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row that stand in a window of five found twice or more in it."""
    m = len(words) - 4
    if m <= 0:
        return np.zeros(n_rows, np.int64)
    hashes, where = shingle_hashes(words, rows, 5, short=False)
    begin = np.flatnonzero(rows[:m] == rows[4:])
    order = np.lexsort((hashes, where))
    same = (hashes[order][1:] == hashes[order][:-1]) & (where[order][1:] == where[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin[twice], 1)
    np.add.at(edge, begin[twice] + 5, -1)
    return np.bincount(rows[np.cumsum(edge)[:-1] > 0], minlength=n_rows)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_lines long, lost_chars long"


def _measured(batches: Iterator[pa.RecordBatch], rules: LineRules, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column("text"))
        for lo, hi in row_groups(offsets, PIECE):  # counts of bytes take eight times the room of the bytes
            n = hi - lo
            words, rows = word_hashes(buf, offsets, lo, hi)
            first, last = word_spans(buf, offsets, lo, hi)
            data = buf[offsets[lo] : offsets[hi]]
            letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            at = offsets[lo]
            chars = np.bincount(rows, letters[last + 1 - at] - letters[first - at], minlength=n).astype(np.int64)
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
            symbols = symbols[offsets[lo + 1 : hi + 1] - at] - symbols[offsets[lo:hi] - at]
            n_words = np.bincount(rows, minlength=n)
            repeats = _repeated_words(words, rows, n)
            base = (n_words < 10) | (100 * repeats > 20 * n_words)
            part = batch.slice(lo, n)
            seen = [clean_text(t or "", rules) for t in part.column("text").to_pylist()]
            lost = np.array([x[1] for x in seen], np.int64)
            kept = ~base & (100 * lost <= rules.lost * chars)
            own = [part.column(i) for i in range(part.num_columns)]
            if keep_text:
                own[part.schema.get_field_index("text")] = pa.array([x[0] for x in seen], pa.string())
            more = [n_words, chars, symbols, np.array([x[3] for x in seen], np.int64), repeats, base, kept, np.array([x[2] for x in seen], np.int64), lost]
            yield pa.RecordBatch.from_arrays(own + [pa.array(x) for x in more], batch.schema.names + [x.split()[0] for x in SCHEMA.split(", ")])


def measure(docs: DataFrame, rules: LineRules = LineRules(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs`` with ``columns``, the measures and the verdict ``kept``.

    Null and empty texts have no words: all counts are 0 and ``base_failed`` holds. Repeated rows give
    repeated rows, null ids stay null, an empty table gives an empty table, other columns are not read.
    A line without a word never fails and never counts as repeated. A very long text is measured whole, in one batch of its own.
    """
    data = docs.select(*columns, docs["text"].alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema)
    return data.mapInArrow(lambda b: _measured(b, rules, False), f"{kind}, {SCHEMA}").drop("text")


def keep_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns kept, texts without their failed lines.

    ``n_chars``, where present, is brought up to date. Columns of the same name as a measure are no
    problem: only the text travels with a private copy of the row. Null and empty texts go, as too short; repeated rows stay or go
    together; an empty table gives an empty one; a very long text is judged line by line and whole.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]  # the text travels once
    packed = docs.select(F.struct(*others).alias("row"), "text")
    kind = T.StructType([*packed.schema.fields, *T.StructType.fromDDL(SCHEMA).fields])  # a schema, as names may need no quotes
    done = packed.mapInArrow(lambda b: _measured(b, rules, True), kind).where("kept")
    return unpacked(done, docs.columns, F.col("text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base measures and both verdicts.

    Null and empty texts have no words and fail. Repeated rows give repeated rows, null ids stay null, an empty table gives an
    empty one, other columns are not read, a very long text is measured whole. No ranks are formed, so there are no ties.
    """
    return measure(documents(spark, sf_dir)).drop("failed_lines", "lost_chars")


_SEPS = ", ".join(f"'{x}'" for x in SEPARATOR_WORDS)
_BOIL = " OR ".join([*(f"contains(low, '{x.replace(chr(39), chr(39) * 2)}')" for x in BOILERPLATE), f"regexp_matches(line, '{CODE}')"])
_R = LineRules()
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i) WHERE len(w) >= 5),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 5)) AS v(k) GROUP BY rid),
ln AS (SELECT rid, j, line, lower(line) AS low, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS lw
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM d)),
lw AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY j) > 1 AS again, list_sum(list_transform(lw, lambda x: length(x))) AS chars,
         (100 * len(list_filter(lw, lambda x: x IN ({_SEPS}))) > {_R.separators} * len(lw) OR {_BOIL}
          OR 100 * len(regexp_extract_all(line, '[#*$%&|<>~^=]|!!')) > {_R.symbols} * len(lw)
          OR (len(lw) >= {_R.long_line} AND NOT regexp_matches(line, '[.!?:;…。！？]'))) AS bad
       FROM ln WHERE len(lw) > 0),
l AS (SELECT rid, count_if(again) AS dups, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM lw GROUP BY rid),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {_R.lost} * word_chars AS kept FROM b
"""
