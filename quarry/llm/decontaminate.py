"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Text becomes words whose numbers, names (capitalised words inside a sentence) and units (after a number) carry
a type mark and their value: ``#12 %kg @alice``. The template keeps the marks alone, so a question with other numbers or
names has the same template. Windows of ``window`` template words are hashed, at every word of the
benchmark and of the documents, so any shared run of ``window`` words meets; an item of fewer words is one window of its own length. Of the windows
of one run only the first is followed up (the word before it differs), as far as the templates of document and item agree. Runs at one
offset are one copy, and their slots must be consistent: a value of the item stands for one value of the document wherever it occurs in the
runs (two of the item may become the same one); what lies outside the runs doesn't count. A run must have as many plain words as slots,
unless its values are the item's own, so that templates of slots alone (nouns are capitalised in some languages) match nothing.
``matched`` is the number of the item's words that lie in a consistent copy, each once, however often the document repeats it.

The benchmark side is broadcast only when the counted windows and words are small (``common.BROADCAST_BYTES``), then documents don't move at
all; else hashed windows meet in a shuffled join and texts with hits follow by id. Verification runs in the scan's stage on the words at hand, and what
is shuffled is one small row per run, pre-aggregated by (document, item, offset).

Defined results: null and empty texts and items match nothing; items of fewer words than a window match where they lie whole, and with their own values
if they are numbers, names and units alone; rows that repeat a doc_id count together, of those that repeat an item_id the best covered counts; empty tables give no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Unit words that become typed placeholders after a number: fixed values.
UNITS = "mm cm m km kg g mg lb lbs oz ml l liters litres meters metres miles feet inches hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents cent euros euro pounds pound percent degrees".split()


def canonical(text: Column) -> Column:
    """Lower-case words, one blank apart, with typed marks before numbers (#), names (@) and units (%)."""
    t = F.translate(F.coalesce(text, F.lit("")), "#@%", "   ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu})", "@")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}.,])(?=\d)", "#")
    t = F.regexp_replace(t, rf"(?i)(#\S+\s+)({'|'.join(UNITS)})\b", "$1%$2")
    t = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", "_")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}#@%_]+", " "))


def template(canon: Column) -> Column:
    return F.regexp_replace(canon, r"([#@%])\S+", "$1")


def _mark(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(first.isin("#", "@", "%"), first).otherwise(word)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 6, min_cover: float = 0.5, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, matched, item_words, coverage, same_slots."""
    items = benchmark.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item_id"), F.split(canonical(F.col(item_text_col)), " ").alias("item")).where("item[0] <> ''")
    items = common.save(items, "items")
    length = F.least(F.size("item"), F.lit(window))
    wins = items.select("no", "item", length.alias("words"), F.explode(F.sequence(F.lit(0), F.size("item") - length)).alias("at"))
    key = F.xxhash64(F.concat_ws(" ", F.transform(F.slice("item", F.col("at") + 1, F.col("words")), _mark)))
    # the template word before; a document's first word has "|" there
    before = F.when(F.col("at") > 0, _mark(F.col("item")[F.greatest(F.col("at") - 1, F.lit(0))])).otherwise("")
    wins = common.save(wins.select("no", "words", "at", key.alias("key"), before.alias("before")), "windows")
    windows = wins.count()
    words = items.agg(F.coalesce(F.sum(F.size("item") * 24 + F.octet_length(F.concat_ws(" ", "item"))), F.lit(0))).first()[0]
    short = sorted(r.words for r in wins.where(F.col("words") < window).select("words").distinct().collect())  # window - 1 values at most
    wins = wins.drop("words")

    text = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canon"))
    # at every word, it and the window after it (shorter at the end) as text: one pass of a pattern
    found = F.regexp_extract_all(F.concat(F.lit("| "), template(F.col("canon"))), F.lit(rf"(?=(\S+(?: \S+){{1,{window}}}))\S+ "), F.lit(1))
    spread = text.select("doc_id", "canon", F.posexplode(found).alias("nth", "part"))
    part = F.expr("substring(part, instr(part, ' ') + 1)")
    keys = [F.xxhash64(part), *(F.xxhash64(F.substring_index(part, " ", n)) for n in short)]
    spread = spread.withColumn("key", F.explode(F.array(*keys)) if short else keys[0])
    first = F.substring_index("part", " ", 1) != F.col("before")
    if windows * 160 <= common.BROADCAST_BYTES:
        hits = spread.join(F.broadcast(wins), "key").where(first)
    else:  # only ids and hashes are shuffled to the windows, if the keys are few only those of the benchmark; the texts of documents with a hit are joined back
        if windows * 32 <= common.BROADCAST_BYTES:
            spread = spread.join(F.broadcast(wins.select("key").distinct()), "key", "left_semi")
        met = spread.select("doc_id", "nth", "key", F.substring_index("part", " ", 1).alias("part")).join(wins, "key").where(first).withColumnRenamed("doc_id", "__id")
        hits = text.join(met, text["doc_id"].eqNullSafe(F.col("__id"))).drop("__id")

    # What follows the join in its stage is the slice of words that the item may go on in. Neither a filter on slots (it would be pushed
    # into the join) nor the text may cross the stage's end: rows are buffered there.
    hits = hits.join(common.maybe_broadcast(items, 1, words), "no")
    rest = F.slice("item", F.col("at") + 1, F.size("item"))
    said = F.slice(F.split("canon", " "), F.col("nth") + 1, F.size("item") - F.col("at"))
    pairs = F.zip_with(rest, said, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    plain = (F.size("item") >= window) | F.exists("item", lambda x: ~x.rlike("^[#@%]"))
    hits = hits.select("doc_id", "no", "item_id", (F.col("nth") - F.col("at")).alias("shift"), "at", F.size("item").cast("long").alias("item_words"), plain.alias("plain"), pairs.alias("pairs"))
    other = F.array_position(F.transform("pairs", lambda x: F.coalesce(_mark(x["a"]) != _mark(x["b"]), F.lit(True))), True)
    run = F.when(other > 0, F.slice("pairs", F.lit(1), (other - 1).cast("int"))).otherwise(F.col("pairs"))
    hits = hits.select("doc_id", "no", "item_id", "shift", "at", "item_words", "plain", run.alias("run"))
    slots = F.array_distinct(F.filter("run", lambda x: x["a"].rlike("^[#@]")))
    literal = F.size(F.filter("run", lambda x: ~x["a"].rlike("^[#@%]")))
    hits = hits.select("doc_id", "no", "item_id", "shift", "at", "item_words", "plain", F.size("run").alias("length"), slots.alias("slots"), literal.alias("literal"))
    same = ~F.exists("slots", lambda x: x["a"] != x["b"])
    hits = hits.where(same | (F.col("plain") & (2 * F.col("literal") >= F.col("length"))))
    stretch = F.struct("at", "length")
    laid = hits.groupBy("doc_id", "no", "shift").agg(F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"), F.collect_set(stretch).alias("runs"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda x: x["a"]))) == F.size("slots")
    laid = laid.where(consistent).select("doc_id", "no", "item_id", "item_words", "runs", same.alias("same"))
    both = laid.groupBy("doc_id", "no").agg(F.first("item_id").alias("item_id"), F.first("item_words").alias("item_words"), F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"), F.min("same").alias("same_slots"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["length"] - 1))))
    both = both.select("doc_id", "item_id", "item_words", F.size(covered).cast("long").alias("matched"), "same_slots")
    both = both.withColumn("coverage", F.col("matched") / F.col("item_words")).where((F.col("coverage") >= min_cover) & (F.col("matched") >= F.least(F.lit(min_words), F.col("item_words"))))
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched", "item_words", "same_slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.item_words", "best.coverage", "best.same_slots")
