import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import quality


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = quality.judge(docs, model).collect()
    for r in rows:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.score >= model.threshold)
    again = quality.fit(docs.repartition(3), spark.read.parquet(f"{sf}/labels.parquet"))
    assert again.threshold == model.threshold


def test_poor_labels_go_and_good_ones_stay(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed")
    by = {r.quality: r.part for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("part")).collect()}
    assert by[1] > 0.99 and by[0] < 0.05


def test_threshold():
    assert quality.best_threshold({1.0: 10}, {0.0: 5}, 10.0) == 0.5
    assert quality.best_threshold({}, {0.0: 5}, 10.0) == float("-inf")


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for docs in (odd, empty):
        rows = quality.judge(docs, quality.fit(docs, labels)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
    assert quality.fit(odd, labels.limit(0)).threshold == float("-inf")
