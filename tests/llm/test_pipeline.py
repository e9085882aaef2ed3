import random
from collections import Counter

import corpus_pipeline
from lattix.llm import language_mix, ngram_join
from tests.llm.cases import corpus, frame, words
from tests.llm.test_pairs_and_search import brute_components, brute_contamination


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    rows = [(*r[:2], "en", *r[3:]) for r in corpus(seed=5, n=30)]
    items = [(1, " ".join(rows[3][1].split()[:14]) + " and more words than ten in a row"), (2, " ".join(rows[9][1].split()[-12:]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows).drop("key", "n", "segment", "score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(r)[:5] for r in docs.collect()]
        if name != "mix":
            assert docs.columns == columns
        if name == "language_id":
            assert Counter(after) == Counter(r for r in before if r[1] and any(c.isalpha() for c in r[1]))
        elif name == "dedup_lines":
            assert {r[0] for r in after} <= {r[0] for r in before} and all(r[1].strip() and r[4] == len(r[1]) for r in after)
        elif name == "near_duplicates":
            want = {i for i, n, c in brute_components(before) if i == c}
            assert sorted(r[0] for r in after if r[0] is not None) == sorted(want - {None})
        elif name == "decontaminate":
            hit = {k[0] for k in brute_contamination(before, items) if k[-1]}
            assert hit and Counter(after) == Counter(r for r in before if r[0] not in hit)
        else:
            assert Counter(after) == Counter(before) and len({r.position for r in docs.collect()}) == len(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_rows_without_an_id_and_with_one_id(spark):
    r = random.Random(12)
    a, b, c, d = (words(r, 40, [f"w{i}" for i in range(500)]) for _ in range(4))
    rows = [(None, a), (None, b + " more"), (None, b), (1, c), (1, d), (2, c + " more"), (1, c), (None, ""), (None, "")]
    docs = frame(spark, [(i, text, "en", "a", len(text), 1, 1, "x", 0.0) for i, text in rows]).drop("key", "n", "segment", "score")
    got = Counter((x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    near = got.keys() & {(None, b), (None, b + " more")}
    assert len(near) == 1 and got == Counter([(None, a), *near, (1, c), (1, d), (None, ""), (None, "")])
    assert ngram_join.similar_sets(docs.where("doc_id is null")).links.count() == 1


def test_contaminated_rows_go_by_their_own_text(spark, tmp_path):
    """Without an id as with one, and no other row of the same id with them."""
    r = random.Random(3)
    item, clean, more = words(r, 14), "nothing of it is in here", "quite another text that is clean as well"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + item), (5, item + " then"), (5, clean), (6, more), (None, more), (5, clean), (7, None), (None, ""), (5, item + " then")]
    docs = frame(spark, [(i, text, "en", "a", 0, 1, 1, "x", 0.0) for i, text in rows]).drop("key", "n", "segment", "score")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter(x for x in rows if item not in (x[1] or ""))


def test_keys_that_meet_are_noticed(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "__key long, text string")
    assert not corpus_pipeline._clash(rows) and corpus_pipeline._clash(rows.union(spark.createDataFrame([(2, "c")], rows.schema)))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, []).drop("key", "n", "segment", "score").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert 0 < language_mix.MIN_SHARE < 0.5
