from collections import defaultdict
from fractions import Fraction

from quarry.llm import mixture

DOCS = "doc_id long, text string, source string, key string, size string, shard string"


def brute_seats(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(caps))):
        best = max((i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


def test_sainte_lague():
    for weights, seats, caps in [([5, 3, 1], 20, [99] * 3), ([5, 3, 1], 20, [4, 99, 99]), ([1, 1, 1], 4, [9] * 3), ([0, 2], 3, [9, 9]), ([7, 5, 5, 1], 0, [3] * 4), ([3, 1], 50, [10, 10]), ([100, 1], 7, [50, 50]), ([], 3, [])]:
        assert mixture.sainte_lague([float(w) for w in weights], seats, caps) == brute_seats(weights, seats, caps)
    assert sum(mixture.sainte_lague([2e11, 1e11, 7.0], 10**9, [10**12] * 3)) == 10**9


def test_targets():
    got = mixture.targets([100, 100, 1000], [5, 2, 1], Fraction(3, 2), 2)
    assert got == [200, 200, 1400]
    got = mixture.targets([1000, 1000, 1000], [5, 2, 1], Fraction(3, 2), 2)
    assert got[0] == 2000 and got[1] == Fraction(2500 * 2, 3) and sum(got) == 4500
    assert mixture.targets([0, 0], [5, 2], Fraction(3, 2), 2) == [0, 0]


def rows(spark, seed=0):
    given = [(i, " ".join(["w"] * ((i * 37 + seed) % 200)), f"s{i % 4}", "k", "z", "h") for i in range(400)]
    given += [(400, None, "s0", "k", "z", "h"), (401, "a b c", None, "k", "z", "h"), (402, "", "s1", None, None, None), (3, "dup dup", "s2", "", "", ""), (3, "dup dup", "s2", "", "", ""), (403, "x " * 20_000, "s3", "", "", "")]
    return given, spark.createDataFrame(given, DOCS)


def test_mix(spark):
    given, docs = rows(spark)
    out = mixture.mix(docs, shard_words=2000).collect()
    assert len(out) == len(given)
    size = {s: sum(len((t or "").split()) for _, t, x, *_ in given if x == s) for s in {r[2] for r in given}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixture.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], Fraction(3, 2), 2)))
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - float(goal[r.source])) < 1e-6
    for s in order:
        shards = -(-size[s] // 2000)
        assert abs(taken[s] - goal[s]) <= 16 * (1 + 2 * shards), s
    key = lambda r: repr((r.doc_id, r.size, r.source))
    again = mixture.mix(docs, shard_words=2000).collect()
    assert sorted((key(r), r.taken) for r in out) == sorted((key(r), r.taken) for r in again)


def test_mix_of_nothing(spark):
    assert mixture.mix(spark.createDataFrame([], DOCS)).count() == 0
    out = mixture.mix(spark.createDataFrame([(1, None, None, "", "", "")], DOCS)).collect()
    assert [(r.size, r.taken, r.target) for r in out] == [(0, 0, 0.0)]


def brute_mix(rows, shard_words, block=16, epochs=2):
    """Takes by hand: rows (key of source, draw, doc_id, place, size, shard), quotas by seats one after the other, then passes over the stream of a shard."""
    sizes = defaultdict(int)
    for key, *_, size, _ in rows:
        sizes[key] += size
    keys = sorted(sizes)
    goal = mixture.targets([sizes[k] for k in keys], [(5, 2, 1)[i % 3] for i in range(len(keys))], Fraction(3, 2), epochs)
    shard_size = defaultdict(int)
    for key, *_, size, shard in rows:
        shard_size[key, shard] += size
    caps = [sum(epochs * -(-w // block) for (k, _), w in shard_size.items() if k == key) for key in keys]
    seats = brute_seats([float(g) for g in goal], round(sum(goal) / block), caps)
    seats = [c if g == epochs * sizes[k] else s for k, g, s, c in zip(keys, goal, seats, caps)]
    taken = {}
    for key, n in zip(keys, seats):
        shards = sorted(s for k, s in shard_size if k == key)
        words = [shard_size[key, s] for s in shards]
        for shard, got, total in zip(shards, brute_seats([float(w) for w in words], n, [epochs * -(-w // block) for w in words]), words):
            left = min(got * block, epochs * total)
            stream = sorted((r[1:5] for r in rows if r[0] == key and r[5] == shard), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
            while left > 0:
                for draw, _, place, size in stream:
                    taken[place] = taken.get(place, 0) + min(left, size)
                    left -= min(left, size)
    return taken


def test_taken_words_equal_brute_force(spark):
    from pyspark.sql import functions as F

    given, docs = rows(spark, 5)
    docs = docs.coalesce(1)
    placed = docs.select("doc_id", "source", F.xxhash64("doc_id", F.lit(7)).alias("draw"), F.monotonically_increasing_id().alias("place"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("size")).collect()
    total = defaultdict(int)
    for r in placed:
        total[r.source] += r.size
    listed = [("1" if r.source is None else f"0{r.source}", r.draw, r.doc_id, r.place, r.size, r.draw % max(1, -(-total[r.source] // 3000))) for r in placed]
    want = brute_mix(listed, 3000)
    got = sorted((repr(r.doc_id), r.size, r.taken) for r in mixture.mix(docs, shard_words=3000).collect())
    assert got == sorted((repr(r.doc_id), r.size, want.get(r.place, 0)) for r in placed) and sum(want.values()) > 1000
