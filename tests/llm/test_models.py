import random
import zlib

import numpy as np

from quarry.llm import language_id, toxicity

BASE = {"en": ["the", "and", "tion", "ing", "th", "er"], "de": ["der", "sch", "ung", "ein", "ü", "keit"], "fr": ["le", "eau", "ou", "é", "tre", "ment"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(BASE[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.new(["a", "b", "c"])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, y = rng.integers(97, 105, (5, 4)), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for name in net.params:
        flat = net.params[name].reshape(-1)
        where = np.flatnonzero(g[name].reshape(-1))
        for i in rng.choice(where, min(4, len(where)), replace=False):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = net.gradients(x, y)[0]
            flat[i] = old - e
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 2e-3


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 60)), lang, "x") for i, lang in enumerate(random.Random(2).choices(list(BASE), k=360))]
    extra = [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "123 456 !!", "en", "x"), (None, text(rng, "de", 9), None, "x"), (1003, "ß" * 200_000, None, "x"), (1004, text(rng, "fr", 30), None, "x"), (1004, text(rng, "fr", 30), None, "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    net = language_id.train(docs)
    assert net.langs == ["de", "en", "fr"]
    out = language_id.identify(docs, net).collect()
    assert len(out) == len(rows) + len(extra)
    by = {r.doc_id: r for r in out}
    held = [(by[i].lang_pred, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows) and len(held) > 50
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "de" and not by[None].held_out and by[1004].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([(1, "abc", None, "")], "doc_id long, text string, lang string, score string")
    assert language_id.train(none) is None and language_id.identify(none, None).first().lang_pred == "und"


def test_words_are_cached_exactly():
    rng = random.Random(3)
    net = language_id.fit(*language_id.sample_words([text(rng, k, 40) for k in BASE], list(BASE)), epochs=1)
    texts = [text(rng, "en", 50), "x" * 100 + " é", "a", ""]
    whole = language_id.Reader(net).label(texts)
    single = [language_id.Reader(net).label([t]) for t in texts]
    assert whole[0] == [s[0][0] for s in single] and np.allclose(whole[1], [s[1][0] for s in single], atol=1e-5)


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = text(rng, rng.choice(list(BASE)), rng.randint(5, 80)).split()
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "moron", "Scum"]))
        rows.append((i, " ".join(words), "x"))
        if i % 5 < 4:
            labels.append((i, int(bad), int(bad)))
    labels += [(3, None, 0), (None, 1, 1), (10_000, 1, 1)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "the idiot " * 30_000, "x"), (None, "the moron", "x"), (7, "repeated id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: t for i, t, _ in labels if i is not None and t is not None}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    held = [(by[i].predicted, truth[i]) for i in truth if i in by and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert by[2002].predicted == 1 and by[2000].score == by[2001].score
    one = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in one.collect()} == {0}


def test_features():
    assert len(toxicity.features(None)) == 0 and len(toxicity.features("")) == 0
    long = "abc def " * 100_000  # several pieces: no n-gram is lost or counted twice
    assert set(toxicity.features(long)) == set(toxicity.features("abc def " * 10))


def test_language_id_learns_every_language(spark, monkeypatch):
    docs = spark.range(5500).selectExpr("id AS doc_id", "concat('word', id) AS text", "concat('lang', id % 1100) AS lang")
    monkeypatch.setattr(language_id, "fit", lambda words, langs: set(langs))
    assert len(language_id.train(docs)) == 1100


def test_log_count_ratios_equal_brute_force():
    texts, toxic = ["you fool", "a calm day", "fool fool", "day é", None, "calm"], np.array([1.0, 0, 1, 0, 1, 0])
    ratio, seen = toxicity.log_count_ratios([toxicity.features(t) for t in texts], toxic)

    def grams(t):
        t = f" {(t or '').lower()} "
        return {t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}

    def place(g):  # of a gram alone: the hash of its code points
        return next(int(p[1]) for p, n in zip(toxicity.places(g), toxicity.GRAMS) if n == len(g))

    for g in set().union(*map(grams, texts)):
        has = [g in grams(t) for t in texts]
        p, q = (sum(h and y == k for h, y in zip(has, toxic)) + 1 for k in (1, 0))
        assert seen[place(g)] == sum(has) and abs(ratio[place(g)] - np.log(p / q)) < 1e-9
    assert seen.sum() == sum(len(grams(t)) for t in texts)


def test_windows_label_each_byte_once():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 1000):
        raw = np.arange(n, dtype=np.int64).astype(np.uint8)
        inner = [w[language_id.CONTEXT : -language_id.CONTEXT] for w in language_id.windows(raw)]
        joined = np.concatenate(inner) if inner else np.zeros(0, np.uint8)
        assert (joined[:n] == raw).all() and (joined[n:] == 32).all() and len(joined) - n < language_id.STEP
    words = "the and of the thing " * 60  # the context runs over words and window ends
    for a, b in zip(language_id.windows(language_id.spelled(words)), language_id.windows(language_id.spelled(words))[1:]):
        assert (a[-2 * language_id.CONTEXT :] == b[: 2 * language_id.CONTEXT]).all()


def test_models_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert language_id.train(docs) is None and language_id.identify(docs, None).count() == 0
    assert toxicity.toxicity(docs, marks).count() == 0


def test_toxicity_sample_is_bounded_and_settled(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 90, f"text {i} {'scum' if i % 90 % 3 == 0 else 'fine'}") for i in range(180)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    one, two = toxicity.train(docs, marks), toxicity.train(docs.orderBy("text").repartition(3), marks)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    monkeypatch.setattr(toxicity, "MAX_PLACES", 400)
    assert not np.array_equal(toxicity.train(docs, marks).weights, one.weights)
