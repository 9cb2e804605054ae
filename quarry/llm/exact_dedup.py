"""Exact deduplication through a cuckoo-filter index.

Texts are equal when identical after each run of ASCII white space became one space. A row's
normalised text is reduced to its SHA-256 in the JVM; only digests, ids and row numbers move.

* :class:`CuckooIndex` holds live digests: short fingerprints in four-slot buckets answer a lookup,
  a fingerprint hit is verified against the full key kept for that slot, keys can be inserted and
  deleted, and a failed chain of evictions doubles the table, which is refilled from the stored keys.
* Each map task pre-aggregates its rows in such an index (so a text that fills a third of the table
  leaves a task as one row per flush), the partial entries are dealt by digest and merged in a second
  index, a smaller keeper replacing the live entry. Memory is bounded by ``flush`` in both phases.
* Groups of several rows are verified on their content: the normalised texts, bucketed by digest and reduced to one
  per text in each task before they move, must be one text a digest; two are an error.
* ``apply_changes`` keeps an index over time: documents come and go, digests are inserted and deleted.

Defined results: a null text counts as empty; a null doc_id sorts after all others; of rows that
repeat doc_id and text the first in table order stays, so each group keeps exactly one row; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

FLUSH = 200_000


class CuckooIndex:
    """Cuckoo filter over digests (bytes, eight at least) with the keys and a value beside each slot."""

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, capacity: int = 1024) -> None:
        self.false_hits = self.resizes = 0
        self._keys: list[bytes | None] = []
        self._values: list[object] = []
        self._free: list[int] = []
        self._clear(max(2, capacity // self.SLOTS))

    def _clear(self, buckets: int) -> None:
        size = 1 << (buckets - 1).bit_length()
        self._mask = size - 1
        self._prints = [0] * (size * self.SLOTS)
        self._refs = [0] * (size * self.SLOTS)

    def __len__(self) -> int:
        return len(self._keys) - len(self._free)

    def _home(self, key: bytes) -> tuple[int, int]:
        h = int.from_bytes(key[:8], "little")
        return (h >> 48) or 1, h & self._mask

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self._mask

    def _slot(self, key: bytes) -> int:
        """The slot that holds ``key``, verified against the stored key; -1 if none."""
        print_, bucket = self._home(key)
        prints, slots = self._prints, self.SLOTS
        for b in (bucket, self._other(bucket, print_)):
            for s in range(b * slots, b * slots + slots):
                if prints[s] == print_:
                    if self._keys[self._refs[s]] == key:
                        return s
                    self.false_hits += 1
        return -1

    def get(self, key: bytes) -> object | None:
        s = self._slot(key)
        return None if s < 0 else self._values[self._refs[s]]

    def insert(self, key: bytes, value: object) -> None:
        """Adds a key that isn't live."""
        if self._free:
            ref = self._free.pop()
            self._keys[ref], self._values[ref] = key, value
        else:
            ref = len(self._keys)
            self._keys.append(key)
            self._values.append(value)
        if not self._place(ref):
            self._resize()

    def _place(self, ref: int) -> bool:
        print_, bucket = self._home(self._keys[ref])
        prints, refs, slots = self._prints, self._refs, self.SLOTS
        for b in (bucket, self._other(bucket, print_)):
            for s in range(b * slots, b * slots + slots):
                if not prints[s]:
                    prints[s], refs[s] = print_, ref
                    return True
        for kick in range(self.MAX_KICKS):
            s = bucket * slots + (ref + kick) % slots
            prints[s], print_ = print_, prints[s]
            refs[s], ref = ref, refs[s]
            bucket = self._other(bucket, print_)
            for s in range(bucket * slots, bucket * slots + slots):
                if not prints[s]:
                    prints[s], refs[s] = print_, ref
                    return True
        return False

    def _resize(self) -> None:
        """Doubles the buckets until every stored key finds a place."""
        buckets = self._mask + 1
        live = [i for i, k in enumerate(self._keys) if k is not None]
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(i) for i in live):
                return

    def delete(self, key: bytes) -> bool:
        s = self._slot(key)
        if s < 0:
            return False
        ref = self._refs[s]
        self._prints[s] = 0
        self._keys[ref] = self._values[ref] = None
        self._free.append(ref)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self._keys, self._values) if k is not None)


_ENTRY = "digest binary, keep_id long, keep_row long, n long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("n", pa.int64())])


def _entries(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    found = list(index.items())
    for at in range(0, len(found), 20_000):
        part = found[at : at + 20_000]
        columns = [[k for k, _ in part], [v[1] for _, v in part], [v[2] for _, v in part], [v[3] for _, v in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def merge_entries(batches: Iterable[pa.RecordBatch], flush: int = FLUSH, by_range: bool = False) -> Iterator[pa.RecordBatch]:
    """Merges rows (digest, keep_id, keep_row, n[, part]) of equal digests.

    Entries leave when the index holds ``flush`` of them; with ``by_range`` only where the column
    ``part``, by which the rows are sorted, changes, so that each digest leaves once."""
    index, last = CuckooIndex(4096), None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for i, (digest, keep_id, row, n) in enumerate(zip(*columns[:4])):
            if len(index) >= flush and (not by_range or columns[4][i] != last):
                yield from _entries(index)
                index = CuckooIndex(4096)
            if by_range:
                last = columns[4][i]
            new = (keep_id is None, keep_id, row, n)
            old = index.get(digest)
            if old is None:
                index.insert(digest, new)
                continue
            first = old if _before(old, new) else new
            index.delete(digest)  # the live entry makes room for the merged one
            index.insert(digest, (*first[:3], old[3] + n))
    yield from _entries(index)


def _before(a: tuple, b: tuple) -> bool:
    if a[0] != b[0]:
        return b[0]
    return (a[2] <= b[2]) if a[0] else (a[1], a[2]) <= (b[1], b[2])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest): the SHA-256 of each normalised text and the row's number."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), common.SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"))


def clashes(docs: DataFrame, repeated: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest): those of ``repeated`` under which ``docs`` has different texts."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), common.SPACE, " ")
    content = docs.select(text.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    small = common.maybe_broadcast(repeated, repeated.count(), 64)
    content = content.join(small, "digest", "left_semi").groupBy("digest", "content").agg(F.lit(1).alias("one"))
    return content.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    rows = common.save(digests(docs, id_col, text_col), "digests")
    partial = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n")).mapInArrow(lambda it: merge_entries(it), _ENTRY)
    part = F.conv(F.hex(F.substring("digest", 9, 2)), 16, 10).cast("int")
    dealt = partial.withColumn("part", part).repartition("digest").sortWithinPartitions("part")
    index = common.save(dealt.mapInArrow(lambda it: merge_entries(it, by_range=True), _ENTRY), "index")
    if not clashes(docs, index.where("n > 1").select("digest"), text_col).isEmpty():
        raise ValueError("different texts share a digest")
    return rows.join(index, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Live (digest, n) of rows (digest, n, part) sorted by part."""
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64())])

    def live(index: CuckooIndex) -> pa.RecordBatch:
        found = list(index.items())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], schema=schema)

    index, last = CuckooIndex(4096), None
    for batch in batches:
        for digest, n, part in zip(*(c.to_pylist() for c in batch.columns)):
            if part != last and len(index) >= FLUSH:
                yield live(index)
                index = CuckooIndex(4096)
            last, old = part, index.get(digest)
            if old is not None:
                index.delete(digest)
            if (old or 0) + n:
                index.insert(digest, (old or 0) + n)
    yield live(index)


def apply_changes(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(digest, n): the live digests and how many documents have each, after documents came and went; all three tables have (digest, n).

    Digests of which more go than there are is an error of the caller; they get a negative n. Null digests don't count; empty tables change nothing."""
    ship(index.sparkSession)
    rows = index.select("digest", "n").unionByName(added.select("digest", "n")).unionByName(removed.select("digest", (-F.col("n")).alias("n")))
    rows = rows.where("digest is not null").groupBy("digest", (F.col("n") < 0).alias("gone")).agg(F.sum("n").alias("n")).drop("gone")
    part = F.conv(F.hex(F.substring("digest", 9, 2)), 16, 10).cast("int")
    return rows.withColumn("part", part).repartition("digest").sortWithinPartitions("part").mapInArrow(_changed, "digest binary, n long")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat an earlier one's text.

    Rows go by doc_id; where a doc_id that repeats has a dropped row, that id's rows are told apart by digest
    and rows equal in both are reduced to one."""
    found = common.save(exact_dedup(docs), "exact")
    gone = found.where(~F.col("kept"))
    told = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.col("kept").cast("int")).alias("all"), F.max(F.col("kept").cast("int")).alias("any"))
    mixed = told.where("n > 1 and all = 0 and any = 1")
    if mixed.isEmpty():
        return common.drop_ids(docs, gone.select("doc_id").distinct())
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), common.SPACE, " "), 256)
    keys = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__digest", digest)
    marked = marked.join(keys, marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    return marked.dropDuplicates(["doc_id", "__digest"]).drop("__digest")
