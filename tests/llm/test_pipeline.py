import random

import corpus_pipeline
from tidewatch.llm import pii, quality, simhash


def test_stages_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        after.append(spark.createDataFrame(out.collect(), out.schema))
        docs = after[-1]
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(x.columns == names for x in after[:-1])
    first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(first, quality.fit(first, spark.read.parquet(f"{sf}/labels.parquet"))).filter("kept").collect()}
    assert {r.doc_id for r in after[0].collect()} == kept
    ids = {r.doc_id: r.component_id for r in simhash.near_duplicates(after[0]).collect()}
    assert {r.doc_id for r in after[1].collect()} == {i for i, c in ids.items() if i == c}
    assert after[3].count() == after[2].count() and pii.with_base_spans(after[3]).filter("exists(base, x -> x.kind = 'email')").count() == 0
    assert after[4].filter("not round_trip").count() == 0 and after[4].count() == after[3].count()


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns[:2] == ["doc_id", "lang"]


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty, very long and repeated texts, and columns named as the stages' own; then no row at all."""
    draw = random.Random(4)
    good = " ".join("".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(79)) + " "
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None), (None, good + "x", "en", None, 1), (3, "", "en", "a", 0), (4, "word " * 30_000, "en", "a", 1), (5, good + "mail a@b.org", "en", "a", 9)]
    names = "base kept score fp spans decoded _row _key _one _email _ip _card _phone _doc _added _cuts".split()
    own = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    full = spark.createDataFrame([(*r, *names) for r in rows], own)
    tables = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, docs in (("full", full), ("none", full.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        for table, schema in tables.items():
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{table}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # 2 and 3 have no words, 4 repeats itself; others may be near copies of 1, which stays once
        ids = [r.doc_id for r in got]
        assert (ids.count(1) == 1 and set(ids) <= {1, 5, None}) if name == "full" else ids == []
        assert all(r.round_trip for r in got)
