import hashlib
import random
import re

import pytest

from quarry.llm import exact_dedup, ngram_join
from quarry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "x", "y", 1) for i, t in rows], DOCS)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_cuckoo_index():
    index, keys = exact_dedup.CuckooIndex(8), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.insert(k, i)
    assert index.resizes > 0 and len(index) == 3000
    assert all(index.get(k) == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) for k in keys[:4]] == [None, 1, None, 3] and len(index) == 1500
    index.insert(keys[0], "again")
    assert index.get(keys[0]) == "again" and len(list(index.items())) == 1501
    alike = exact_dedup.CuckooIndex(8)  # equal fingerprints and buckets, different keys: verified
    alike.insert(b"12345678a", 1)
    assert alike.get(b"12345678b") is None and alike.false_hits == 1


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (None, "a b"), (7, "x"), (7, "x"), (8, "é" * 50_000), (4, " "), (6, "\x0b")]
    got = {(r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        keep = min(j for j in same if j is not None)
        want.add((i, hashlib.sha256(norm(t).encode()).hexdigest(), keep, len(same), i == keep))
    assert {x for x in got if x[0] != 7} == {x for x in want if x[0] != 7}
    assert sorted(x[4] for x in got if x[0] == 7) == [False, True]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_content_is_verified(spark, monkeypatch):
    rows = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "x" * 100_000), (6, "x" * 100_000)]
    table = docs(spark, rows)
    every = exact_dedup.digests(table).select("digest").distinct()
    assert exact_dedup.clashes(table, every).count() == 0
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.substring(exact_dedup.F.lit("00" * 32), 1, 64))
    with pytest.raises(ValueError, match="share a digest"):
        exact_dedup.exact_dedup(table)


def test_apply_changes(spark, monkeypatch):
    rng = random.Random(3)
    key = lambda i: hashlib.sha256(str(i).encode()).digest()
    monkeypatch.setattr(exact_dedup, "FLUSH", 10)
    schema = "digest binary, n long"
    old = {key(i): rng.randint(1, 3) for i in range(300)}
    new = [(key(rng.randrange(400)), 1) for _ in range(500)] + [(None, 1)]
    total = dict(old)
    for k, n in new:
        if k is not None:
            total[k] = total.get(k, 0) + n
    gone = [(k, rng.choice([n, 1])) for k, n in total.items() if rng.random() < 0.5]
    got = exact_dedup.apply_changes(*(spark.createDataFrame(x, schema) for x in (list(old.items()), new, gone)))
    for k, n in gone:
        total[k] -= n
    assert {bytes(r.digest): r.n for r in got.collect()} == {k: n for k, n in total.items() if n}
    none = spark.createDataFrame([], schema)
    assert exact_dedup.apply_changes(none, none, none).count() == 0


def test_merge_flushes():
    import pyarrow as pa

    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("n", pa.int64()), ("part", pa.int32())])
    rows = [(bytes([i % 7]) * 32, i, i, 1, i % 7) for i in range(70)]
    rows.sort(key=lambda r: r[4])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    out = [r for b in exact_dedup.merge_entries([batch.slice(0, 33), batch.slice(33)], flush=2, by_range=True) for r in b.to_pylist()]
    assert sorted((r["keep_id"], r["n"]) for r in out) == [(i, 10) for i in range(7)]
    out = [r for b in exact_dedup.merge_entries([batch.select([0, 1, 2, 3])], flush=3) for r in b.to_pylist()]
    assert sum(r["n"] for r in out) == 70


def test_keep_first(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None), (5, "")]
    kept = exact_dedup.keep_first(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == docs(spark, []).columns


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=50)
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one two"), (4, "ONE  two"), (5, "Éa"), (6, "éa"), (7, "a b c d e"), (8, "a b c d e f"), (9, "a b c d e f g h i"), (10, "a b c d e f g h")]
    for i in range(11, 150):
        kind = rng.random()
        if kind < 0.4 or i < 20:
            w = rng.choices(words, k=rng.choice([4, 5, 6, 8, 9, 12, 30, 80, 200]))
        elif kind < 0.5:
            w = rng.choices(words, k=8) + passage + rng.choices(words, k=8)
        else:
            w = (rng.choice(rows)[1] or "x").split()
            w = list(w) or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
                w = w or ["x"]
        rows.append((i, " ".join(w)))
    base = rng.choices(words, k=120)
    for i in range(150, 190):  # a large group of near copies
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows.append((190, " ".join(rng.choices(words, k=30_000))))
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(1 for i, (_, c) in want.items() if c != i) > 40


def test_ngram_join_with_deletions(spark, monkeypatch):
    """The other allocation, for all bands, finds the same."""
    monkeypatch.setattr(ngram_join, "bands", lambda counts, heavy, share: {k: ngram_join.Band(max(1, -(-(ngram_join.bound((2 << k) - 1) + 1) // 2)), True) for k in counts})
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None)], key=str)


def test_bands_choose_by_cost():
    few = ngram_join.bands({2: (1000, 5000), 8: (1000, 300_000)}, 0, 0.0)
    assert not few[2].deletions and not few[8].deletions
    many = ngram_join.bands({2: (1_000_000, 5_000_000), 8: (1000, 300_000)}, 2_000_000, 0.1)
    assert many[2] == ngram_join.Band(1, True) and not many[8].deletions


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, 1), (9, 2), (3, 2), (5, 6), (6, 6)]])
def test_components(spark, edges):
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert all(got.get(v, v) == root for v, root in want.items())


def test_bands_mix_allocations():
    """Where most shingles are common, some segments of larger bands take their one-deletion neighbourhoods; every plan has units enough."""
    for rare in (0.9, 0.5, 0.2):
        for k, typical in ((2, 5), (3, 11), (4, 22), (6, 90), (8, 300), (11, 3000)):
            n = 1_000_000
            band = ngram_join.bands({k: (n, n * typical)}, int(n * typical * (1 - rare)), 0.1)[k]
            assert band.segments + band.deletions >= ngram_join.bound((2 << k) - 1) + 1
    for k, typical in ((4, 20), (6, 90), (8, 330)):
        mixed = ngram_join.bands({k: (10**6, typical * 10**6)}, int(0.85 * typical * 10**6), 0.1)[k]
        assert 0 < mixed.deletions < mixed.segments


@pytest.mark.parametrize("part", [0.25, 0.5])
def test_ngram_join_with_mixed_allocations(spark, monkeypatch, part):
    """A part of the units in one-deletion neighbourhoods, the rest exact; small blocks, every key dealt by class, several copies of a hub's set."""

    def plan(counts, heavy, share):
        units = {k: ngram_join.bound((2 << k) - 1) + 1 for k in counts}
        return {k: ngram_join.Band(n + 1 - int(n * part), max(1, int(n * part))) if n > 2 else ngram_join.Band(1, True) for k, n in units.items()}

    monkeypatch.setattr(ngram_join, "bands", plan)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    rows = corpus(int(part * 100))
    want = brute(rows)
    for hot in (1, 3, ngram_join.HOT):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
        assert got == want


def test_ngram_join_of_texts_around_a_shared_passage(spark, monkeypatch):
    """The plan itself mixes both allocations here, and finds what brute force finds."""
    rng, plans, own = random.Random(8), [], ngram_join.bands
    monkeypatch.setattr(ngram_join, "bands", lambda *a: plans.append(own(*a)) or plans[-1])
    passage = [f"p{i}" for i in range(18)]
    rows = []
    for i in range(700):
        w = [f"x{rng.randrange(9)}" for _ in range(rng.randrange(6))] + passage[: rng.choice([10, 14, 18])] + [f"y{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert any(b.deletions for k, b in plans[-1].items() if k > 2), plans


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError, match="settled"):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)
    nulls = spark.createDataFrame([(None, 1), (2, None), (3, 3), (4, 5), (5, 4)], "a long, b long")
    assert {(r.v, r.root) for r in components(nulls).collect()} >= {(5, 4)} and components(nulls.limit(0)).count() == 0
