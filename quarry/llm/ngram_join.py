"""Exact Jaccard self-join of documents' five-word shingle sets by universe partitioning.

Two sets link when 100 * |A & B| >= 80 * |A | B|, that is when they differ in at most
H = (|A| + |B|) / 9 shingles. The method, on classes of documents with equal sets:

1. Profile. One pass over the texts gives each document its set size, a 128-bit hash of the set (its class) and a histogram of
   the set, and counts all shingles in a fixed-size sketch, whose heavy places are kept.
2. Signatures. Sets fall into size bands (powers of two). A band cuts the universe of shingles into segments by hash. Linked sets
   have Sum |A_i ^ B_i| <= H over the segments, so segments whose allocation comes to more than H units suffice: a segment taken exactly
   (equal subsets) is one unit, with its one-deletion neighbourhood (subsets one shingle apart) two, skipped none.
   Each band has ``deletions`` segments of two units, twice as wide as the others, which are taken always, and exact ones, of which a
   set skips its costliest and indexes as many as the units left ask for. Cost is the count of a subset's rarest shingle, so empty segments
   and passages that many documents share are skipped first. Cost and order depend on the subset alone: if no wide segment
   matches, a linked pair differs in at most H - 2 * deletions exact ones, and the cheapest that it has in common is indexed by both.
   The numbers of either kind are the cheapest of a range of mixes, by signatures emitted and false partners expected from the sketch.
   A set also indexes under the band below where a smaller partner may lie there.
3. Groups. Classes on one key form a group; equal groups are taken once. Keys of subsets that are common by the sketch are dealt by
   key and class, so none gathers in one task. In each group all members are held against its hub,
   the member with the most shared keys: what sizes and histograms allow (|h(A) - h(B)|_1 <= H) is verified exactly. Links so far give components; only groups that still lie in several
   components go on: cut into blocks of some hundred members, whose pairs are dealt over tasks, and of these only possible pairs across
   components are verified. So no link between components is lost, and groups aren't expanded into all pairs.
4. Components by alternating star contraction, as tables; nothing is collected. Which texts are needed for verification is told to tasks by a bitmap of fixed size,
   the join selects exactly.

Verification compares the whole sets of 64-bit shingle hashes. Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case.

Defined results: null and empty texts and texts without words have the empty set, size 0, and are alone; texts of one to four words have one shingle, the
whole sequence; repeated rows and equal texts are one class; a null doc_id joins a component but can't name it (all-null components get
null); an empty table gives no rows; extra columns are not read. ``docs`` is scanned three times and has to give the same rows each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common
from .components import components

WIDTH = 5
SKETCH_BITS, HEAVY = 20, 1 << 16
BINS = 256
#: Bits of the bitmap that tells tasks which sets are wanted.
FILTER_BITS = 25
#: Members of a block of a group; rows of one key from which it is dealt by class too; partners of a hub that share a copy of its set.
BLOCK, HOT, PARTNERS = 1024, 100_000, 256
_NEVER = 1 << 40
_SLICE = 1 << 20

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15 | 1)
_COEF = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = _U(pow(int(_B), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (_B, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of the bytes."""
    inside = ~_SPACES[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _B)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _words, in slices that end at white space."""
    if len(raw) <= 2 * _SLICE:
        return _words(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw) and not _SPACES[raw[end]]:
            end += 1
        starts, hashes = _words(raw[at:end])
        parts.append((starts + at, hashes))
        at = end
    return np.concatenate([s for s, _ in parts]), np.concatenate([h for _, h in parts])


def _shingles(w: np.ndarray) -> np.ndarray:
    """Sorted different shingle hashes of a document's word hashes."""
    n = len(w)
    if not n:
        return w
    width = min(n, WIDTH)
    h = np.full(n - width + 1, width, _U)
    for j in range(width):
        h += w[j : n - width + 1 + j] * _COEF[j]
    return np.unique(mix(h))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    part: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "replace"))
        size += len(part[-1]) + 1
        if size < _SLICE and i + 1 < len(texts):
            continue
        lengths = np.array([len(p) + 1 for p in part])
        starts, hashes = word_hashes(np.frombuffer(b"\n".join(part), np.uint8))
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _shingles(hashes[a:b])
        part, size = [], 0


def histogram(s: np.ndarray) -> bytes | None:
    """Counts of a set's members, at most about eight to a bin, so that unlike sets differ whatever their size; capped at 255."""
    if not len(s):
        return None
    size = max(BINS, 1 << (len(s) // 8).bit_length())
    return np.minimum(np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def fold(bins: np.ndarray, size: int) -> np.ndarray:
    """A histogram on fewer bins, a power of two."""
    return bins.reshape(-1, size).sum(0, dtype=np.int32)


def class_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two hashes of a set."""
    a = mix(s ^ _U(0x1234567 + seed)).sum(dtype=_U)
    b = mix(s ^ _U(0xABCDEF0987 + seed)).sum(dtype=_U)
    return int(mix(np.array([a + _U(len(s))]))[0].astype(np.int64)), int(b.astype(np.int64))


def bound(n: int) -> int:
    """The most shingles by which a set of n can differ from a linked one of n or more."""
    return (n + 5 * n // 4) // 9


@dataclass(frozen=True)
class Band:
    """``segments`` of a size band, the first ``deletions`` of them with one-deletion neighbourhoods (True: all)."""

    segments: int
    deletions: int

    def __post_init__(self) -> None:
        if self.deletions is True:
            object.__setattr__(self, "deletions", self.segments)


def _excess(n: int, p: float, skip: int) -> float:
    """About how many of n segments are crowded, each with probability p, beyond those that may be skipped."""
    mean, spread = n * p, math.sqrt(max(n * p * (1 - p), 1e-12))
    z = (mean - skip) / spread
    return spread * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) + (mean - skip) * 0.5 * math.erfc(-z / math.sqrt(2)) if z > -8 else 0.0


def cost(band: Band, typical: float, units: int, rare: float, crowd: float) -> float:
    """Signatures that a set of ``typical`` members emits, and the false partners they cost: ``crowd`` a key without a rare shingle."""
    wide, exact = band.deletions, band.segments - band.deletions
    members = typical / (exact + 2 * wide)
    left = max(0, units - 2 * wide)
    wrong = _excess(exact, math.exp(-rare * members), exact - left) if left else 0.0
    # Variants of a subset without rare shingles have the same partners, a group that is taken once; of one with a single rare
    # shingle one variant is crowded. A single segment is the whole set: sets on one variant of it differ in two shingles at most.
    if wide and band.segments > 1:
        m = 2 * members * rare
        wrong += wide * math.exp(-m) * (1 + m)
    return wide * (1 + 2 * members) + left + crowd * wrong


def bands(counts: dict[int, tuple[int, int]], heavy: int, common_share: float) -> dict[int, Band]:
    """The cheapest allocation of each size band. ``counts``: classes and shingles by band; ``heavy``: shingle occurrences in heavy
    places of the sketch; ``common_share``: share of the classes that hold a common shingle."""
    out = {}
    classes = sum(n for n, _ in counts.values())
    for k, (n, size) in counts.items():
        top, typical = (1 << (k + 1)) - 1, size / n
        # passages are as long in short sets as in long ones
        rare = 1 - min(0.9, heavy / classes / typical)
        most, units = bound(top) + 1, bound(int(typical)) + 1
        wide = sorted({0, *(most * i // 16 for i in range(1, 8)), -(-most // 2)})
        plans = [Band(d + max(0, width - 2 * d), d) for d in wide for width in (most, top // 3 + 2, top // 2 + 1) if width >= most]
        plans.append(Band(-(-most // 2), True))
        out[k] = min(plans, key=lambda b: (round(cost(b, typical, units, rare, 4 * n * common_share), 1), b.deletions, b.segments))
    return out


def signatures(s: np.ndarray, plan: dict[int, Band], heavy: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys that a set indexes, for its band and perhaps the one below, and which of them are common by the sketch."""
    n, out, hot = len(s), [], []
    if n < 4:  # links to equal sets only
        return out, hot
    own = n.bit_length() - 1
    below = (1 << own) - 1
    todo = [(own, bound(n) + 1)]
    if below >= 4 and 4 * n <= 5 * below:
        todo.append((own - 1, (n + below) // 9 + 1))
    value = mix(s ^ _U(0x5E65ED))
    weigh = heavy[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    for k, need in todo:
        band = plan.get(k)
        if band is None:  # nothing of that size
            continue
        m, wide = band.segments, band.deletions
        seg = ((mix(s + _U(977 * k)) >> _U(32)) % _U(m + wide)).astype(np.int64)
        seg = np.where(seg < 2 * wide, seg >> 1, seg - wide)
        full = np.zeros(m, _U)
        np.add.at(full, seg, value)
        rarest = np.full(m, _NEVER, np.int64)
        np.minimum.at(rarest, seg, weigh)
        tag = mix(np.arange(m, dtype=_U) + _U(k * 1_000_003))
        if wide:
            inside = np.flatnonzero(seg < wide)
            inside = inside[np.lexsort((weigh[inside], seg[inside]))]
            at, w = seg[inside], weigh[inside]
            first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            follows = np.concatenate([np.where(first[1:], _NEVER, w[1:]), [_NEVER]])[: len(at)]
            out.append(mix(np.concatenate([full[:wide] + tag[:wide], full[at] - value[inside] + tag[at]])))
            hot.append(np.concatenate([rarest[:wide], np.where(first, follows, rarest[at])]) >= HOT)
        need -= 2 * wide
        if need > 0:
            keys, price = mix(full[wide:] + tag[wide:]), rarest[wide:]
            if need < len(keys):
                cheap = np.lexsort((keys, price))[:need]
                keys, price = keys[cheap], price[cheap]
            out.append(keys)
            hot.append(price >= HOT)
    return out, hot


_PROFILE = "doc_id long, n long, c long, c2 long, bins binary"
_PROFILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("bins", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _profile(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        ids = batch.column(0)
        n, c, c2, bins, places = [], [], [], [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            a, b = class_of(s, seed)
            n.append(len(s))
            c.append(a)
            c2.append(b)
            bins.append(histogram(s))
            places.append(s >> _U(64 - SKETCH_BITS))
            if len(places) >= 512:
                counts += np.bincount(np.concatenate(places).astype(np.int64), minlength=len(counts))
                places = []
        if places:
            counts += np.bincount(np.concatenate(places).astype(np.int64), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(c2, pa.int64()), pa.array(bins, pa.binary())], schema=_PROFILE_SCHEMA)
    found = np.flatnonzero(counts >= max(4, 4 * counts.mean()))
    for at in range(0, len(found), 20_000):
        f = found[at : at + 20_000]
        none = pa.nulls(len(f), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(np.full(len(f), -1)), pa.array(f), pa.array(counts[f]), pa.nulls(len(f), pa.binary())], schema=_PROFILE_SCHEMA)


_INDEX = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def _index(batches: Iterator[pa.RecordBatch], seed: int, plan: dict[int, Band], places: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    heavy = np.zeros(1 << SKETCH_BITS, np.int64)
    heavy[places] = counts
    seen: set[int] = set()
    for batch in batches:
        keys, owners, hot, size = [], [], [], 0

        def packed(keys: list[np.ndarray], owners: list[np.ndarray], hot: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(hot))], schema=_INDEX)

        for s in shingle_sets(batch.column(0).to_pylist()):
            c, _ = class_of(s, seed)
            if c in seen:
                continue
            if len(seen) < 500_000:  # a class that is forgotten is indexed again
                seen.add(c)
            for k, often in zip(*signatures(s, plan, heavy)):
                keys.append(k)
                owners.append(np.full(len(k), c, np.int64))
                hot.append(often)
                size += len(k)
            if size >= 100_000:
                yield packed(keys, owners, hot)
                keys, owners, hot, size = [], [], [], 0
        if keys:
            yield packed(keys, owners, hot)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(starts of the runs of equal values in the first column, columns) of pieces that end with a run."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            if rest.column(0)[-1].as_py() == t.column(0)[-1].as_py():
                rest = pa.concat_tables([rest, t])
                continue
            t = pa.concat_tables([rest, t])
        key = t.column(0).to_numpy()
        cut = int(np.flatnonzero(key[:-1] != key[1:])[-1]) + 1 if key[0] != key[-1] else 0
        rest = t.slice(cut)
        if cut:
            key = key[:cut]
            yield np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), t.slice(0, cut).columns
    if rest is not None:
        key = rest.column(0).to_numpy()
        yield np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), rest.columns


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class) rows of the keys with several classes; rows (key, class, hot) come sorted by key. Groups are named by their members,
    those of hot keys, of which a task sees a part, by the key."""
    done: set[int] = set()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often = batch.column(2)
            if pc.any(often).as_py():
                passed.append(batch.filter(often).select([0, 1]).cast(_PAIR))
                batch = batch.filter(pc.invert(often))
            yield batch

    passed: list[pa.RecordBatch] = []
    for starts, (_, column, _) in _runs(whole(batches)):
        yield from passed
        passed.clear()
        owner = column.to_numpy()
        ends = np.concatenate([starts[1:], [len(owner)]])
        many = ends - starts > 1
        a, b, size = [], [], 0
        for lo, hi in zip(starts[many].tolist(), ends[many].tolist()):
            members = np.unique(owner[lo:hi])
            if len(members) < 2:
                continue
            name = int(mix(members.astype(_U)).sum(dtype=_U).astype(np.int64))
            if name in done:
                continue
            if len(done) < 500_000:
                done.add(name)
            a.append(np.full(len(members), name, np.int64))
            b.append(members)
            size += len(members)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_PAIR)
                a, b, size = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_PAIR)
    yield from passed


def _sets(batches: Iterator[pa.RecordBatch], seed: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class, set) of the classes that may be wanted, each once a task if it can be helped."""
    seen: set[int] = set()
    schema = pa.schema([("c", pa.int64()), ("s", pa.binary())])
    for batch in batches:
        c, s, size = [], [], 0
        for one in shingle_sets(batch.column(0).to_pylist()):
            k, _ = class_of(one, seed)
            if k in seen:
                continue
            at = k & ((1 << FILTER_BITS) - 1)
            if not (int(wanted[at >> 6]) >> (at & 63)) & 1:
                continue
            if len(seen) < 500_000:
                seen.add(k)
            c.append(k)
            s.append(one.tobytes())
            size += len(s[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.binary())], schema=schema)
                c, s, size = [], [], 0
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.binary())], schema=schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified (a, b) of rows (a, b, set of b) sorted by (a, salt) with a's own row, b = a, before the others."""
    own: np.ndarray | None = None
    for batch in batches:
        at, a, b = None, [], []
        for x, y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = np.frombuffer(raw.as_buffer(), _U)
            if x == y:
                own = s.copy()
            elif own is not None:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= 80 * (len(own) + len(s) - both):
                    a.append(x)
                    b.append(y)
        del at
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sizes and histograms allow a link; rows (a, b, n of a, n of b, bins of a, bins of b)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            m, n = part.column(2).to_numpy(), part.column(3).to_numpy()
            ok = 5 * np.minimum(m, n) >= 4 * np.maximum(m, n)
            x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
            for i in np.flatnonzero(ok):
                one, two = np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8)
                size = min(len(one), len(two))
                ok[i] = 9 * int(np.abs(fold(one, size) - fold(two, size)).sum()) <= m[i] + n[i]
            yield part.select([0, 1]).filter(pa.array(ok)).cast(_PAIR)


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and histograms don't rule out."""
    a = classes.select(F.col("c").alias("a"), F.col("n").alias("an"), F.col("bins").alias("ab"))
    b = classes.select(F.col("c").alias("b"), F.col("n").alias("bn"), F.col("bins").alias("bb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "an", "bn", "ab", "bb").mapInArrow(_possible, "a long, b long")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose sizes and histograms allow a link; rows (pair of blocks, class, component, n, bins, which block: 0 for a block with itself)."""
    for starts, columns in _runs(batches):
        c, comp, n, side = (columns[i].to_numpy() for i in (1, 2, 3, 5))
        bins = columns[4].to_pylist()
        a, b = [], []
        for lo, hi in zip(starts, [*starts[1:], len(c)]):
            order = lo + np.argsort(n[lo:hi], kind="stable")
            gn, gc, gk, gs = n[order], c[order], comp[order], side[order]
            gb = [np.frombuffer(bins[i], np.uint8) for i in order]
            last = np.searchsorted(gn, 5 * gn // 4, "right")
            size, folded = 0, np.zeros((0, 0), np.int16)
            for i in range(hi - lo):
                js = np.arange(i + 1, last[i])
                js = js[(gk[js] != gk[i]) & ((gs[js] != gs[i]) | (gs[i] == 0))]
                if not len(js):
                    continue
                if len(gb[i]) != size:  # sizes ascend, and with them the bins
                    size, at = len(gb[i]), i
                    folded = np.stack([fold(g, size) for g in gb[i:]]).astype(np.int16)
                for part in np.array_split(js, max(1, len(js) * size // (1 << 20))):
                    if len(part):
                        far = np.abs(folded[part - at] - folded[i - at]).sum(1, dtype=np.int32)
                        ok = part[9 * far <= gn[part] + gn[i]]
                        a.append(np.full(len(ok), gc[i]))
                        b.append(gc[ok])
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)


def across(groups: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """The possible pairs (a < b) across components of the groups that lie in several.

    Groups are cut into blocks by a hash of the class, and each pair of blocks is a task's work of its own."""
    placed = groups.join(found.select(F.col("v").alias("c"), "root"), "c", "left").select("g", "c", F.coalesce("root", "c").alias("k"))
    open_ = placed.groupBy("g").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("m")).where("low <> high and m > 2")
    open_ = open_.select("g", F.ceil(F.col("m") / BLOCK).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("c"), F.col("cuts")).cast("int")
    left = placed.join(open_, "g").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    block = F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))
    left = left.select(block.alias("g"), "c", "k", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"))
    left = left.join(classes.select("c", "n", "bins"), "c").select("g", "c", "k", "n", "bins", "side")
    return left.repartition("g").sortWithinPartitions("g").mapInArrow(_across, "a long, b long").distinct()


def _bitmap(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS places, those of the ids ``c`` set; of a fixed size whatever their number."""
    at = F.col("c").bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bits"))
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint64)
    return out


def _verify(docs: DataFrame, pairs: DataFrame, seed: int, tag: str) -> DataFrame:
    """The linked ones of different pairs (a, b) of classes."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("c"))))
    sets = docs.select("text").mapInArrow(lambda it: _sets(it, seed, shared.value), "c long, s binary").groupBy("c").agg(F.first("s").alias("s"))
    # Of a pair, the class with more partners is the hub, if it has many. The hub's set goes once to each of its salts, every partner's set to its hub.
    busy = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("k")).where(F.col("k") > PARTNERS)
    busy = common.save(busy, "busy")
    few = common.maybe_broadcast(busy, busy.count(), 32)
    routes = pairs.join(few.toDF("a", "ka"), "a", "left").join(few.toDF("b", "kb"), "b", "left")
    ka, kb = F.coalesce("ka", F.lit(1)), F.coalesce("kb", F.lit(1))
    routes = routes.select(F.when(kb > ka, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(kb > ka, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest(ka, kb) / PARTNERS).alias("salts"))
    routes = routes.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    routes = routes.unionByName(routes.select("a", F.col("a").alias("b"), "salt").distinct())
    rows = routes.join(sets, routes["b"] == sets["c"]).select("a", "b", "s", "salt")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", (F.col("a") != F.col("b")))
    out = common.save(rows.select("a", "b", "s").mapInArrow(_compare, "a long, b long").distinct(), tag)
    shared.destroy()
    common.discard(busy)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for attempt in range(seed, seed + 8):
        made = common.save(docs.mapInArrow(lambda it, k=attempt: _profile(it, k), _PROFILE), "profile")
        rows = made.where("n >= 0")
        classes = common.save(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.min("c2").alias("low"), F.max("c2").alias("high")), "classes")
        if classes.where("low <> high").isEmpty():
            break
        common.discard(made, classes)  # two sets share a name: other hashes
    else:
        raise RuntimeError("different sets shared a 64-bit name under eight seeds")
    seed = attempt

    sketch = made.where("n = -1").groupBy("c").agg(F.sum("c2").alias("k")).orderBy(F.desc("k"), "c").limit(HEAVY).toArrow()
    places, often = sketch.column(0).to_numpy(), sketch.column(1).to_numpy()
    sizes = classes.where("n >= 4").groupBy((F.length(F.bin("n")) - 1).alias("k")).agg(F.count("*"), F.sum("n")).collect()
    counts = {k: (n, size) for k, n, size in sizes}
    total = sum(n for n, _ in counts.values())
    share = float(often[:100].sum() / 100) / max(1, total)
    plan = bands(counts, int(often.sum()), min(1.0, share))

    tools = spark.sparkContext.broadcast((plan, places, often))
    index = docs.select("text").mapInArrow(lambda it: _index(it, seed, *tools.value), "a long, b long, hot boolean")
    # a common key is dealt by class too
    sorted_ = index.repartition(F.when(F.col("hot"), F.xxhash64("a", "b")).otherwise(F.col("a"))).sortWithinPartitions("a")
    groups = common.save(sorted_.mapInArrow(_groups, "a long, b long").distinct().toDF("g", "c"), "groups")
    tools.destroy()

    # Every member against its group's hub.
    degree = groups.groupBy("c").agg(F.count("*").alias("d"))
    ranked = groups.join(degree, "c")
    hub = ranked.groupBy("g").agg(F.max(F.struct("d", "c")).alias("hub")).select("g", F.col("hub.c").alias("a"))
    star = common.save(groups.join(hub, "g").where("c <> a").select("a", F.col("c").alias("b")).distinct(), "star")
    near = common.save(possible(star, classes), "possible")
    links = _verify(docs, near, seed, "links")
    common.discard(near)
    found = components(links)

    # What still lies in several components.
    more = across(groups, found, classes)
    for x, y in (("a", "b"), ("b", "a")):
        more = more.join(star, (more["a"] == star[x]) & (more["b"] == star[y]), "left_anti")
    more = common.save(more, "across")
    common.discard(groups, star)
    if not more.isEmpty():
        extra = _verify(docs, more, seed, "more")
        found = components(links.unionByName(extra))
        common.discard(extra)
    common.discard(more, links)

    named = classes.join(found.select(F.col("v").alias("c"), "root"), "c", "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("c", "component_id")
    out = rows.join(named, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
