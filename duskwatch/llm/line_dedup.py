"""Line dedup: an exact set-similarity join of lines.

A line's tokens are its five-word shingles (of one to four words, all of them as one). Lines of equal
words are one class, whose rank is that of its first line. In any fixed order of tokens two sets of
similarity t share one of their first n - ceil(t n) + 1 (prefix filter); sizes (length filter) and the
places of the shared token (positional filter) bound the similarity before full sets are intersected.
A line goes if an earlier line, kept or not, is as similar as ``PERCENT``.

1. Tokens in the order of their first words' hashes: only the prefix is hashed, and no count of all tokens
   is needed. Classes that share a token of their prefixes with another class are left, with their sets.
2. Their prefixes in the order of token hashes. In cells of ``FEW`` classes or less all are compared, in
   larger ones each with the earliest.
3. Classes of larger cells that this leaves open, and all of their cells, count their tokens and order
   them by rarity; whatever then shares a token of its prefix is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import with_shingles
from .store import BROADCAST_ROWS, cut, discard, documents, keyed, keyed_rows, settled, text_digests, unpacked, with_found

PERCENT = 80
#: Lines of fewer words are kept: every line with a word is compared.
LEAST_WORDS = 1
#: A class of more lines than a 1 / MANY of all, and than COPIES, enters the join as one row.
MANY, COPIES = 1 << 16, 64
#: Cells of more classes are first compared with their earliest class only, then by rarity.
FEW = 64


def _needed(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def _prefix_size(n: Column) -> Column:
    return n - _needed(n) + 1


def _plain(text: Column) -> Column:
    """Lower case, all white space but line ends as blanks."""
    return F.lower(F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_lines, line_no, line) of the plain texts."""
    split = docs.select("doc_id", *text_digests(), F.split(_plain(F.coalesce("text", F.lit(""))), "\n").alias("all"))
    return split.select("doc_id", "k1", "k2", F.size("all").alias("n_lines"), F.posexplode("all").alias("line_no", "line"))


def _words() -> Column:
    return F.array_remove(F.split("line", " "), "")


def _with_sets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``set``, the sorted distinct tokens of the column ``line``."""
    lines = with_shingles(lines.withColumn("w", F.transform(_words(), lambda x: F.xxhash64(x))).drop("line"), "w", "s")
    return lines.withColumn("set", F.sort_array(F.array_distinct("s"))).drop("w", "s")


def _with_prefix(lines: DataFrame, least_words: int) -> DataFrame:
    """``lines`` with m, d1, d2 (two digests of the words) and ``prefix`` instead of ``line``.

    m is the number of shingles, repeats counted, 0 for a line of too few words. In the order of (hash of the
    first word, token) the prefix holds the tokens that a prefix filter asks for, and those of equal first words.
    """
    low = (1 << 32) - 1
    w = F.col("w")
    token = lambda at: F.xxhash64(*[F.get(w, at + j) for j in range(5)])
    lines = lines.withColumn("w", _words()).drop("line")
    size = F.when(F.size(w) >= least_words, F.greatest(F.size(w) - 4, F.least(F.size(w), F.lit(1)))).otherwise(0)
    lines = lines.withColumns({"m": size, "d1": F.xxhash64("w"), "d2": F.xxhash64(F.lit(7), "w")})
    # the upper half of the first word's hash, and the place
    keys = F.transform(F.slice(w, F.lit(1), F.col("m")), lambda x, i: F.xxhash64(x).bitwiseAND(~low).bitwiseOR(i.cast("long")))
    lines = lines.withColumn("keys", F.sort_array(keys)).withColumn("last", F.get("keys", _prefix_size(F.col("m")) - 1).bitwiseOR(low))
    tied = F.get("keys", _prefix_size(F.col("m"))) <= F.col("last")
    first = F.when(tied, F.filter("keys", lambda k: k <= F.col("last"))).otherwise(F.slice("keys", F.lit(1), _prefix_size(F.col("m"))))
    lines = lines.withColumn("prefix", F.array_distinct(F.transform(first, lambda k: token(k.bitwiseAND(low).cast("int")))))
    # a line that repeats shingles may have too few distinct ones there: then all of them
    every = F.array_distinct(F.transform("keys", lambda k: token(k.bitwiseAND(low).cast("int"))))
    own = F.when(F.size("prefix") >= _prefix_size(F.col("m")), F.col("prefix")).when(F.col("m") > 0, every)
    return lines.withColumn("prefix", own).drop("w", "keys", "last")


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2", "line_no")


def _shared(entries: DataFrame, who: str) -> DataFrame:
    """Entries (cell, ...) of the cells with more than one value of ``who``, the cells' number of rows as ``members`` and least ``who`` as ``lo``."""
    dealt = entries.repartition("cell")
    # the counts ask for all columns, so that the exchange written for them serves the join as well
    all_ = [F.max(c).alias(f"_{c}") for c in entries.columns if c not in ("cell", who)]
    many = dealt.groupBy("cell").agg(F.count("*").alias("members"), F.min(who).alias("lo"), F.max(who).alias("hi"), *all_)
    kept = F.col("lo") < F.col("hi")
    for c in entries.columns:
        kept = kept & F.col(f"_{c}").isNotNull() if c not in ("cell", who) else kept
    return dealt.join(many.where(kept).select("cell", "members", "lo").hint("shuffle_hash"), "cell")


def _may_match(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Length filter, and positional filter: the tokens from the shared one on, and those before it that
    any other class has (all but ``alone``), have to suffice."""
    most = F.least(a["n"] - a["pos"], b["n"] - b["pos"]) + F.least(a["pos"] - a["alone"], b["pos"] - b["alone"])
    return (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * PERCENT) & (most * (100 + PERCENT) >= (a["n"] + b["n"]) * PERCENT)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(o) of the later ones of the pairs (a, b) whose sets are similar."""
    nodes = cut(pairs.select(F.col("a").alias("o")).union(pairs.select("b")).distinct())
    own = keyed_rows(sets, nodes, "o", nodes.count())
    left, right = own.select(F.col("o").alias("a"), F.col("set").alias("x")), own.select(F.col("o").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    enough = F.size(F.array_intersect("x", "y")) * (100 + PERCENT) >= PERCENT * (F.size("x") + F.size("y"))
    return both.where(enough).select(F.col("a").alias("o")).distinct()


def _sets(docs: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """(o, set, n) of the first lines of the classes ``known`` (o, rank), each once."""
    wanted = known.groupBy(*[F.col(f"rank.{c}").alias(f"_{c}") for c in ("doc_id", "k1", "k2")]).agg(F.collect_list(F.struct("rank.line_no", "o")).alias("wanted"))
    wanted = F.broadcast(wanted) if n_known <= BROADCAST_ROWS else wanted
    same = docs["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    texts = docs.select("doc_id", "text", *text_digests()).join(wanted, same).select("wanted", F.split("text", "\n").alias("all"))
    found = texts.select(F.explode(F.transform("wanted", lambda x: F.struct(x["o"].alias("o"), F.get("all", x["line_no"]).alias("line")))).alias("x"))
    sets = cut(_with_sets(found.select("x.o", _plain(F.col("x.line")).alias("line"))).select("o", "set", F.size("set").alias("n")))
    if sets.count() == n_known:
        return sets
    once = cut(sets.groupBy("o", "n").agg(F.first("set").alias("set")).select("o", "set", "n"))  # rows that repeat an id and its text
    discard(sets)
    return once


def _entries(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(cell, d1) of the prefixes."""
    bound = max(COPIES, lines.count() // MANY)
    hot = classes.where(F.col("copies") > bound).select("d1", "d2")  # fewer than MANY classes
    rows = lines.where("m > 0").select("d1", "d2", "prefix")
    once = rows.join(F.broadcast(hot), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.first("prefix").alias("prefix"))
    rows = rows.join(F.broadcast(hot), ["d1", "d2"], "left_anti").unionByName(once) if not hot.isEmpty() else rows
    return rows.select(F.explode("prefix").alias("cell"), "d1")


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(cell, o, n, pos, alone) of the prefixes of ``sets`` (o, set), their tokens ordered by how many of them have each."""
    shared = _shared(sets.select("o", F.size("set").alias("n"), F.explode("set").alias("cell")).select("cell", "o", "n"), "o")
    # tokens that one class alone has are its rarest: they come first and need no row of their own
    own = shared.groupBy("o", "n").agg(F.sort_array(F.collect_list(F.struct("members", "cell"))).alias("t"))
    placed = own.select("o", "n", (F.col("n") - F.size("t")).alias("alone"), F.posexplode("t").alias("at", "u"))
    placed = placed.select("u.cell", "o", "n", (F.col("alone") + F.col("at")).alias("pos"), "alone")
    return cut(placed.where(F.col("pos") < _prefix_size(F.col("n"))))


def _sides(late: DataFrame, early: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (a, b, n_a, n_b, ...) of entries of one cell, b before a, that sizes and places allow."""
    names = ("o", "n", "pos", "alone", *more)
    a, b = ({c: F.col(f"{c}_{x}") for c in names} for x in "ab")
    late, early = (t.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in names]) for t, x in ((late, "a"), (early, "b")))
    met = late.join(early, "cell").where((b["o"] < a["o"]) & _may_match(a, b))
    return met.select(a["o"].alias("a"), b["o"].alias("b"), *[side[c].alias(f"{c}_{x}") for c in ("n", *more) for side, x in ((a, "a"), (b, "b"))])


def _shared_enough(met: DataFrame) -> DataFrame:
    """(a, b) whose number of common cells can suffice: all common tokens of the prefix that ends first are among
    them, but for those in large cells, of which a class has ``wide``; the rest of the set may be common too."""
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "wide_a", "wide_b")])
    rest = F.greatest(F.col("n_a") - _prefix_size(F.col("n_a")), F.col("n_b") - _prefix_size(F.col("n_b")))
    most = F.col("c") + F.least("wide_a", "wide_b") + rest
    return cut(pairs.where(most * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT).select("a", "b"))


def later_matches(docs: DataFrame, least_words: int = 3) -> DataFrame:
    """(doc_id, k1, k2, line_no) of the lines to remove.

    Null and empty texts, blank lines and lines of fewer than ``least_words`` words lose nothing. Rows
    that repeat an id and its text count as one document and lose the same lines;
    the digests k1 and k2 of the text tell it from others. Documents without an id rank last. An empty table
    gives an empty table; columns other than doc_id and text are not read. A very long text is taken line by
    line, a very long line as one array of its tokens.
    """
    return _matches(docs, least_words)[1]


def _matches(docs: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(id, k1, k2, n_lines) of every row of ``docs``, and the lines to remove."""
    docs = docs.select("doc_id", "text")
    whole = cut(_with_prefix(_lines(docs), least_words))
    rows = cut(whole.where("m > 0 OR line_no = 0").drop("prefix"))
    lines = rows.where("m > 0").drop("m", "n_lines")
    classes = cut(lines.groupBy("d1", "d2").agg(F.min(_rank()).alias("rank"), F.count("*").alias("copies")))
    some = cut(_shared(_entries(whole, classes), "d1").select("d1").distinct())
    n_some = some.count()
    discard(whole)
    # o numbers the classes in the order of their ranks
    known = cut(keyed_rows(classes, some, "d1", n_some).orderBy("rank").withColumn("o", F.monotonically_increasing_id()))
    sets = _sets(docs, known, known.count())
    prefixes = sets.select("o", "n", F.posexplode(F.slice("set", F.lit(1), _prefix_size(F.col("n")))).alias("pos", "cell"))
    entries = cut(_shared(prefixes.select("cell", "o", "n", "pos"), "o").select("cell", "o", "n", "pos", "members", "lo", F.lit(0).alias("alone")))
    wide = entries.where(F.col("members") > FEW).groupBy("o").agg(F.count("*").alias("wide"))
    marked = cut(entries.join(wide, "o", "left").withColumn("wide", F.coalesce("wide", F.lit(0))))
    discard(entries)
    few = marked.where(F.col("members") <= FEW)
    large = marked.where(F.col("members") > FEW)
    first = large.where(F.col("o") == F.col("lo")).select("cell", F.struct("o", "n", "pos", "alone").alias("f"))
    to_first = large.where(F.col("o") != F.col("lo")).join(first, "cell")
    to_first = to_first.where(_may_match({c: F.col(c) for c in ("n", "pos", "alone")}, {c: F.col(f"f.{c}") for c in ("n", "pos", "alone")}))
    to_first = to_first.select(F.col("o").alias("a"), F.col("f.o").alias("b"), F.col("n").alias("n_a"), F.col("f.n").alias("n_b"), F.col("wide").alias("wide_a"), F.col("wide").alias("wide_b"))
    pairs = _shared_enough(_sides(few, few, ("wide",)).unionByName(to_first))
    many = large.select("cell", "o", (F.col("o") != F.col("lo")).alias("open"))
    gone = cut(_similar(pairs, sets))
    many = cut(many.join(gone.withColumn("_gone", F.lit(True)), "o", "left").select("cell", "o", (F.col("open") & F.col("_gone").isNull()).alias("open")))
    open_ = many.where("open")
    rest = _by_rarity(sets.join(many.join(open_.select("cell").distinct(), "cell", "left_semi").select("o").distinct(), "o", "left_semi"))
    more = cut(_sides(rest.join(open_.select("o").distinct(), "o", "left_semi"), rest).select("a", "b").distinct())
    gone = cut(gone.union(_similar(more, sets)).distinct())
    discard(marked, sets, pairs, many, rest, more)  # all that is left to do reads rows, classes, known and gone
    out = cut(known.join(gone, "o", "left_semi").select("d1", "d2", "rank", F.lit(True).alias("gone")))
    kept = classes.where("copies > 1").join(out, ["d1", "d2"], "left_anti").select("d1", "d2", "rank", F.lit(False).alias("gone"))
    marked = out.unionByName(kept)
    found = lines.join(marked.hint("shuffle_hash"), ["d1", "d2"]).where(F.col("gone") | (_rank() != F.col("rank"))).select("doc_id", "k1", "k2", "line_no")
    return rows.where("line_no = 0").select(F.col("doc_id").alias("id"), "k1", "k2", "n_lines"), found


def _listed(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "k1", "k2").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, removed): numbers of the lines to remove, from 0, of the documents that lose some."""
    return _listed(later_matches(docs, LEAST_WORDS))


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without later matching lines, all columns and all rows kept; n_chars, where present, follows.

    A document whose lines all go keeps an empty text.
    """
    both = with_found(keyed(docs), settled(lambda: removed_lines(docs)))
    left = F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    return unpacked(both, docs.columns, F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines and the numbers of those removed."""
    rows, found = _matches(documents(spark, sf_dir), LEAST_WORDS)
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    both = with_found(rows, _listed(found))
    return both.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
