"""The pipeline against plain versions of its stages."""

import random

import corpus_pipeline
from flatjet.llm import queries

from .test_operators import COLUMNS, brute_components, brute_removed, brute_sets, check_packing, prose


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    base, passage, item = prose(rng, 90), prose(rng, 40), prose(rng, 40)
    near = base.split()
    near[40] = "other"
    texts = [base, " ".join(near), base, prose(rng, 70) + " " + passage, prose(rng, 70) + " " + passage, prose(rng, 60) + " " + item + " " + prose(rng, 60), "", None, "123 !!", passage]
    texts += [prose(rng, 120) for _ in range(20)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    sets = brute_sets(now)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = brute_components(sets, links)
    now = [(i, t) for i, t in now if group[i] == i]
    now = [(i, kept if gone else t) for (i, t), (_, gone, kept) in zip(now, brute_removed(now), strict=True) if kept or not gone]
    now = [(i, t) for i, t in now if item not in t]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in now}
    check_packing(now, got, queries.tokenizer_path(), 2048)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids_of_different_texts(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    near = " ".join(["edited", *c.split()[1:]])
    rows = [(5, a), (5, b), (3, a), (6, c), (6, near), (6, c), (7, c), (8, d), (8, e), (9, None), (9, f), (None, f)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], COLUMNS)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    want = [(3, a), (5, b), (6, min(c, near)), (8, d), (8, e), (9, None), (9, f), (None, f)]
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in want)


def test_columns_with_clashing_names(spark, tmp_path):
    rng = random.Random(9)
    passage = prose(rng, 40)
    rows = [(1, "en", prose(rng, 50) + " " + passage), (2, "en", passage + " " + prose(rng, 50)), (None, "en", prose(rng, 60))]
    names = ["language", "confidence", "n_words", "n_removed", "kept_text", "factors", "component_id", "mark", "held", "score"]
    docs = spark.createDataFrame([(i, t, lang, "src", len(t), *[f"{n}{i}" for n in names]) for i, lang, t in rows], COLUMNS + "".join(f", {n} string" for n in names))
    spark.createDataFrame([(0, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted((r.doc_id or -1, *[r[n] for n in names]) for r in got.collect()) == sorted((i or -1, *[f"{n}{i}" for n in names]) for i, _, _ in rows)


def test_leaks_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(10)
    item = prose(rng, 40)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, prose(rng, 50)), (5, prose(rng, 20) + " " + item), (5, prose(rng, 50)), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], COLUMNS)
    got = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in [rows[1], *rows[3:]])
