"""SQL functions against the Columns of the same meaning."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import math as M
from tidewatch.functions import text as T

TEXTS = [
    None, "", " ", "plain words", "it's \\ back\\slash 'quoted' \"twice\"", "@amy and (@bob_1 hi @c", "see HTTP://A.org/x?y='z' and b.example.com or a.gg/k, a.gg/k", "mail a.b@c-d.org or +1 (555) 123-4567 from 10.0.0.1",
    "token abcdefghijklmnopqrstuvwxyz0123456789ABCD 12345678901234567", "h e l l o you", "a b c", "привет мир 你好 héllo", "soooooo   goooood...__--~~^^ `x`", "!!!", "4.2.1-beta+7 (<build>) " + "9" * 60, "\U0001f600\U0001f600\U0001f600 é", "tab\tnew\nline odd space",
]
PAIRS = {
    "redact_identifiers": T.redact_identifiers, "finish_match": T.finish_match, "fingerprint_of": T.fingerprint_of, "letters_joined_of": T.collapse_letter_spacing, "count_mentions": T.count_mentions,
    "extract_urls": T.extract_urls, "scripts_used": T.scripts_used, "trigrams": T.trigrams, "version_label": T.version_label, "is_ascii": T.is_ascii, "utf16_length": T.utf16_length,
}
ARRAYS = [None, [], [0.5], [0.5, 0.25, 2.0, -1.0], [3.0, 3.0, 3.0], [1.0, 2.0, 4.0], [0.0, 0.0], [1.0, -1.0]]


@pytest.fixture(scope="module")
def registered(spark):
    return T.register_functions(spark)


def test_texts(spark, registered):
    assert set(PAIRS) <= set(registered) and len(registered) == len(set(registered)) >= 24
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = rows.select("i", *(x for name, f in PAIRS.items() for x in (F.expr(f"{name}(t)").alias(f"sql_{name}"), f(F.col("t")).alias(f"col_{name}"))))
    for r in got.collect():
        for name in PAIRS:
            assert r[f"sql_{name}"] == r[f"col_{name}"], (name, TEXTS[r.i])


def test_arrays(spark, registered):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ARRAYS)], "i int, x array<double>")
    pairs = {"noisy_or": M.noisy_or_array, "array_mean": M.array_mean, "array_cv": M.array_cv}
    got = rows.select("i", *(y for name, f in pairs.items() for y in (F.expr(f"{name}(x)").alias(f"sql_{name}"), f(F.col("x")).alias(f"col_{name}"))))
    for r in got.collect():
        for name in pairs:
            assert r[f"sql_{name}"] == r[f"col_{name}"], (name, ARRAYS[r.i])
    times = spark.createDataFrame([([1, 4, 9],), ([5],), ([],)], "x array<bigint>")
    assert all(a == b for a, b in times.select(F.expr("deltas(x)"), M.deltas(F.col("x"))).collect())


def test_native(spark, registered):
    """No function of texts or numbers leaves the JVM."""
    rows = spark.createDataFrame([("a",)], "t string").select(*(F.expr(f"{name}(t)") for name in PAIRS))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
