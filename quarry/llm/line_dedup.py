"""Near-duplicate line removal by a deletion-neighbourhood join, with DataFrame functions only.

A line is its lower-cased words (runs of letters and digits). Two lines are near when one word inserted, deleted
or replaced turns one into the other; lines under ``min_words`` words only when equal. A line goes when
an earlier line, by (doc_id, line number), is near it; each dropped line names the earliest such line.

Emitting every deletion variant of every line of a corpus would multiply it by the words of a line, so lines
that can't have a neighbour are set aside first, without loss: one edit leaves the first or the last
half of the words as it was. Each line gives a key for either half (lengths are powers of two, so that
lines one word apart mostly share them); keys are reduced to their smallest and largest line hash before the
shuffle, and only lines on a key with two different hashes go on. These emit themselves and all their
one-word deletions as hashed keys. Lines that agree with the same place taken out are near each other, and so are a line and
what another leaves; so each key is reduced to its earliest lines, and each line meets these alone, never all others
of its group. The edit distance to the earliest is verified on the words. Equal lines are one row (their
earliest place) in all of this.

Defined results: null and empty texts and lines without words give nothing; rows that repeat a doc_id and line
number are one place and don't displace each other; a null doc_id sorts first; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, norm, h): lines that have words, numbered from 0 over all lines of the text; one pattern pass a text."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    return split.select("doc_id", "line_no", F.trim("line").alias("norm")).where("norm <> ''").withColumn("h", F.xxhash64("norm"))


def _grid(n: Column) -> Column:
    """The largest power of two up to ``n``; 1 for less."""
    return F.call_function("shiftleft", F.lit(1), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"))


def halves(rows: DataFrame, min_words: int) -> DataFrame:
    """``rows`` with ``keys``: hashes of the first and of the last half of the words, for its own length and one less."""
    out = rows.withColumn("n", F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    out = out.withColumn("g", _grid(F.shiftright(F.col("n") - 1, 1))).withColumn("g1", _grid(F.shiftright(F.col("n") - 2, 1)))

    def pair(g: str) -> list[Column]:
        first, last = F.call_function("substring_index", "norm", F.lit(" "), F.col(g)), F.call_function("substring_index", "norm", F.lit(" "), -F.col(g))
        return [F.xxhash64(F.lit("a"), F.col(g), first), F.xxhash64(F.lit("z"), F.col(g), last)]

    keys = F.when(F.col("n") < min_words, F.array().cast("array<bigint>")).when(F.col("g") == F.col("g1"), F.array(*pair("g"))).otherwise(F.array(*pair("g"), *pair("g1")))
    return out.withColumn("keys", keys)


def within_one(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced, or none, turns array ``a`` into ``b``."""
    na, nb = F.size(a), F.size(b)
    most = F.greatest(na, nb)
    # get() past the end is null, so the arrays differ at the latest where the shorter one ends
    differs = F.transform(F.sequence(F.lit(0), most), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i == most))
    p = F.array_position(differs, F.lit(True)).cast("int") - 1
    tail = lambda x, at: F.slice(x, at + 1, most + 1)
    return F.when(F.abs(na - nb) > 1, False).when(na == nb, tail(a, p + 1) == tail(b, p + 1)).when(na > nb, tail(a, p + 1) == tail(b, p)).otherwise(tail(a, p) == tail(b, p + 1))


def near_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per dropped line: doc_id, line_no, keep_doc_id, keep_line_no, edits (0 or 1)."""
    place = F.struct("doc_id", "line_no")
    known = common.save(halves(lines(docs, id_col, text_col), min_words).select("doc_id", "line_no", "h", "keys", "norm"), "keys")

    # Equal lines: the earliest place of those that occur more than once.
    equal = known.groupBy("h").agg(F.min(place).alias("own"), F.count("*").alias("n")).where("n > 1").select("h", "own")

    # Lines on a half key that a different line has too: one row per different line, with its earliest place.
    hot = known.select("h", F.explode("keys").alias("key")).groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    hot = common.save(hot.select("key"), "halves")
    hot = common.maybe_broadcast(hot, hot.count(), 16)
    some = known.select("h", F.explode("keys").alias("key")).join(hot, "key", "left_semi").select("h").distinct()
    some = common.save(some, "shared")
    some = common.maybe_broadcast(some, some.count(), 16)
    may = known.select("doc_id", "line_no", "h", "norm").join(some, "h", "left_semi")
    may = common.save(may.groupBy("h").agg(F.min(place).alias("place"), F.first("norm").alias("norm")), "lines")

    # Variants. Two lines are near when the same place taken out leaves the same words (role 1), or when one is what
    # the other (role 2) leaves, the whole of it (role 3).
    split = may.select("h", "place", F.split("norm", " ").alias("words")).select("h", "place", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("i"))
    cut = F.concat_ws(" ", F.slice("words", 1, F.greatest(F.col("i") - 1, F.lit(0))), F.slice("words", F.col("i") + 1, F.size("words")))
    split = split.select("h", "place", "i", F.when(F.col("i") == 0, F.concat_ws(" ", "words")).otherwise(cut).alias("rest"))
    role = lambda n: F.lit(n).alias("role")
    whole_key, part_key = F.xxhash64(F.lit("w"), "rest").alias("key"), F.xxhash64(F.lit("s"), "i", "rest").alias("key")
    roles = F.when(F.col("i") == 0, F.array(F.struct(whole_key, role(3)))).otherwise(F.array(F.struct(part_key, role(1)), F.struct(whole_key, role(2))))
    variants = split.select("h", "place", F.explode(roles).alias("x")).select("h", "place", "x.key", "x.role")
    one = F.struct("place", "h")
    groups = variants.groupBy("key").agg(F.min(F.when(F.col("role") < 3, one)).alias("part"), F.min(F.when(F.col("role") == 3, one)).alias("whole"), F.count("*").alias("n"), F.max("role").alias("top"))
    groups = common.save(groups.where("n > 1 and (top = 1 or top = 3 and part is not null)").select("key", "part", "whole"), "groups")
    met = variants.join(common.maybe_broadcast(groups, groups.count(), 120), "key")
    earlier = F.when(F.col("role") == 2, F.col("whole")).otherwise(F.col("part"))
    near = met.select("h", "place", earlier.alias("e")).where("e.place < place").groupBy("h").agg(F.min("e").alias("e")).select("h", F.col("e.place").alias("near"), F.col("e.h").alias("eh"))
    a, b = may.select("h", F.col("norm").alias("a")), may.select(F.col("h").alias("eh"), F.col("norm").alias("b"))
    # both lines are split once a pair: bound to a variable, not to an expression that each word would evaluate again
    pair = F.array(F.struct(F.split("a", " ").alias("a"), F.split("b", " ").alias("b")))
    checked = near.join(a, "h").join(b, "eh").where(F.transform(pair, lambda x: within_one(x["a"], x["b"]))[0]).select("h", "near")

    # Decisions by line hash, then the places that fall under them.
    verdict = checked.join(equal, "h", "full_outer").join(may.select("h", F.col("place").alias("own1")), "h", "left")
    verdict = common.save(verdict.select("h", F.coalesce("own", "own1").alias("own"), "near"), "verdicts")
    hit = known.select("h", place.alias("place")).join(common.maybe_broadcast(verdict, verdict.count(), 64), "h")
    by_near = F.col("near") < F.col("place")
    by_equal = F.col("own") < F.col("place")
    keep = F.when(by_near & by_equal, F.least("near", "own")).when(by_near, F.col("near")).when(by_equal, F.col("own"))
    out = hit.withColumn("keep", keep).where("keep is not null")
    return out.select(F.col("place.doc_id").alias("doc_id"), F.col("place.line_no").cast("long").alias("line_no"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").cast("long").alias("keep_line_no"), F.when(F.col("keep") == F.col("own"), 0).otherwise(1).cast("long").alias("edits"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of the texts."""
    gone = dropped.groupBy("doc_id").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.coalesce(F.array_contains("__gone", i.cast("long")), F.lit(False)))
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__gone", "__id")
