"""The pipeline against its stages done by brute force."""

from collections import Counter

from tests.llm.test_dedup import brute_components, brute_lines, brute_spans
from tests.llm.test_tokens import check_packing

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]

    toxic = stages["toxicity"](spark, docs, SF).cache()
    assert toxic.columns == names and 0 < toxic.count() <= docs.count()

    edited = stages["line_dedup"](spark, toxic, SF).cache()
    assert sorted(edited.columns) == sorted(names)
    lines = brute_lines([(r.doc_id, r.text) for r in toxic.collect()])
    want = Counter((i, text) for i, _, dropped, text in lines if text or not dropped)
    assert sum(want.values()) < sum(lines.values())  # some are all repeated lines
    assert Counter((r.doc_id, r.text) for r in edited.collect()) == want
    assert all(r.n_chars == len(r.text) for r in edited.collect())

    single = stages["minhash_near_dedup"](spark, edited, SF).cache()
    found = brute_components([(r.doc_id, r.text) for r in edited.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, _, kept) in found.items() if kept}

    clean = stages["suffix_array_dedup"](spark, single, SF).cache()
    rows = single.collect()
    spans = {r.doc_id: s[3].decode("utf-8", "ignore") for r, s in zip(rows, brute_spans([r.text for r in rows], 200), strict=True) if s[3] or not s[1]}
    assert {r.doc_id: r.text for r in clean.collect()} == spans

    used, least = check_packing(clean, stages["best_fit_packing"](spark, clean, SF), 2048)
    assert used <= least + 1


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0


def written(docs, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_nulls_repeated_rows_and_no_labels(spark, docs, tmp_path):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    folder = written(docs.select(NAMES), none, tmp_path)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder).cache()
        assert sorted(rows.columns) == sorted(NAMES), name
        held = rows.collect()
        assert any(not r.text for r in held) and any(r.doc_id is None for r in held), name
        assert len(held) == docs.count() if name == "toxicity" else len(held) > 6, name
    used, least = check_packing(rows, corpus_pipeline.STAGES[-1][1](spark, rows, folder), 2048)
    assert used <= least + 1


def test_rows_of_one_id_go_by_their_texts(spark, tmp_path):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = spark.createDataFrame([(1, one, "en", "s", 1), (4, one + " more", "en", "s", 1), (4, two, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, one), (4, two)]


def test_empty_table(spark, empty, tmp_path):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert corpus_pipeline.run(spark, written(empty.select(NAMES), none, tmp_path)).count() == 0
