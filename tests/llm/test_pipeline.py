import re

import corpus_pipeline
from quarry.llm import common, decontaminate, toxicity


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages(spark, data):
    """Each stage on its own input: decisions take effect, columns stay, nothing else goes."""
    docs = common.table(spark, data, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        last = stage is corpus_pipeline.STAGES[-1][1]
        out = common.save(stage(spark, docs, data), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        gone = set(before) - set(after)
        if not last:
            assert out.columns == columns and all(after[i].text == before[i].text for i in after)
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_column(docs, toxicity.train(docs, common.table(spark, data, "labels"))).collect()}
            assert gone == {i for i, s in scores.items() if s >= 0.5}
        elif name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(norm(before[i].text), i)
            assert set(after) == set(first.values())
        elif name == "benchmark decontamination":
            assert gone == {r.doc_id for r in decontaminate.contaminated(docs, common.table(spark, data, "benchmark")).collect()}
        elif last:
            assert all(r.taken > 0 for r in after.values())
        docs, before = out, after


def test_null_ids_and_empty_tables(spark, data):
    docs = spark.createDataFrame([(None, "a b c d e f", None, None, None), (1, "a b c d e f", "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.save(stage(spark, out, data), "test")
        assert out.columns == docs.columns


def test_decontamination_by_row(spark, data):
    leak = common.table(spark, data, "benchmark").orderBy("item_id").first().text
    rows = [(1, leak), (1, "clean text"), (None, leak), (None, "clean too"), (2, None), (3, f"before {leak} after"), (4, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_contaminated(spark, docs, data)
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, "clean text"), (None, "clean too"), (2, None), (4, "clean text")]))


def test_run_equals_brute_force(spark, data):
    """All stages end to end, each by hand but for the classifier's scores, the mix's takes and the canonical words."""
    from test_dedup import brute
    from test_text import brute_contaminated

    from pyspark.sql import functions as F

    from quarry.llm import mixture

    table = common.table(spark, data, "documents")
    model = toxicity.train(table, common.table(spark, data, "labels"))
    score = model.scorer()
    docs = [r for r in table.collect() if score(r.text) < 0.5]
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    docs = [r for r in docs if first[norm(r.text)] == r.doc_id]
    groups = brute([(r.doc_id, r.text) for r in docs])
    docs = [r for r in docs if groups[r.doc_id][1] == r.doc_id]
    left = spark.createDataFrame(docs, table.schema)
    words = lambda df, i: {r[0]: r[1].split() for r in df.select(i, decontaminate.canonical(F.col("text"))).collect() if r[1]}
    found = {i for i, _ in brute_contaminated(words(left, "doc_id"), words(common.table(spark, data, "benchmark"), "item_id"))}
    left = spark.createDataFrame([r for r in docs if r.doc_id not in found], table.schema)
    want = {(r.doc_id, r.taken) for r in mixture.mix(left).collect() if r.taken > 0}
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, data).collect()} == want and want


def test_stages_with_ties_repeats_and_clashing_columns(spark, data):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " more", "b"), (3, " ".join(f"w{i}" for i in range(30_000)), "c"), (4, None, "d"), (5, "", "e")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, k, k, k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, __key string, component_id string, digest string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.save(stage(spark, docs.drop("__key"), data), "test")
        assert out.columns == docs.drop("__key").columns and out.where("doc_id = 3").count() == 1
