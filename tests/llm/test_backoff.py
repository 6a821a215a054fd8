import math
from collections import Counter

import pytest

from tidewatch.llm import backoff, queries


def brute(rows, order):
    texts = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).encode().split() for _, t in rows]
    own = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in texts]
    all_ = [sum((o[k] for o in own), Counter()) for k in range(order)]
    n = sum(map(len, texts))
    out = []
    for w, o in zip(texts, own):
        total = 0.0
        for i in range(len(w)):
            k, f = min(order, i + 1), 0.0
            while True:
                g = tuple(w[i - k + 1 : i + 1])
                c = all_[k - 1][g] - o[k - 1][g]
                if k == 1:
                    total += f + math.log(max(c, 1) / max(n - len(w), 1))
                    break
                if c > 0:
                    total += f + math.log(c / (all_[k - 2][g[:-1]] - o[k - 2][g[:-1]]))
                    break
                f, k = f + math.log(backoff.ALPHA), k - 1
        out.append((len(w), total / len(w) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_same_as_brute_force(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the"), (9004, "qqq zzz"), (9004, "qqq zzz")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda x: (x[0], x[1], x[2] or 0)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(rows, order))), key=key)
    got = sorted(((r.doc_id, r.n_words, r.score) for r in backoff.score(docs, order).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-8)


def test_odd_rows(odd, empty):
    assert backoff.score(odd).count() == odd.count() and backoff.score(empty).count() == 0


def test_query_counts_trigrams(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((r[0], *b) for r, b in zip(rows, brute(rows, 3)))
    got = sorted((r.doc_id, r.n_words, r.score) for r in queries.op7_stupid_backoff(spark, sf).collect())
    assert len(got) == len(want) and all(g[:2] == w[:2] and (g[2] or 0) == pytest.approx(w[2] or 0, abs=1e-8) for g, w in zip(got, want))


def test_many_blocks_prefixes_and_repeated_rows(spark, monkeypatch):
    """Small blocks and many prefixes, of more bits than six bytes leave; a row repeated thousands of times."""
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(40)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(30)))) for i in range(200)] + [(7777, "once upon a time there was a row")] * 3000
    want = sorted((r[0], *b) for r, b in zip(rows, brute(rows, 3)))
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).cache()
    for bits in (None, 12, 18):
        got = sorted((r.doc_id, r.n_words, r.score) for r in backoff.score(df, 3, prefix_bits=bits).collect())
        assert len(got) == len(want) and all(g[:2] == w[:2] and (g[2] or 0) == pytest.approx(w[2] or 0, abs=1e-8) for g, w in zip(got, want))


def test_rows_hold_as_many_ngrams_at_any_size(spark):
    """Between 0.1 and 30 GB a row's bytes of text stay within what rounding up to a power of two does; on random texts of
    two sizes the bytes of a row's n-grams are taken."""
    import random

    for n in (100 << 20, 500 << 20, 3 << 30, 30 << 30):
        blocks, bits = backoff.sides(n)
        assert backoff.CELL_BYTES / 2.2 <= n / (blocks << bits) <= backoff.CELL_BYTES
        assert n // blocks <= backoff.BLOCK_BYTES and n >> bits <= backoff.PREFIX_BYTES
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(20_000)]
    per_row = []
    for n_docs in (1000, 16_000):  # 0.6 and 9.6 MB
        df = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=100))) for i in range(n_docs)], "doc_id long, text string")
        blocks, bits = backoff.sides(n_docs * 600)
        own = backoff.own_grams(backoff.packed(df, blocks, "doc_id", "text"), 3, bits)
        per_row.append(own.filter("n = 3").selectExpr("avg(octet_length(grams))").first()[0])
    assert 0.4 < per_row[0] / per_row[1] < 2.5


def test_gaps_round_trip():
    import numpy as np

    rnd = np.random.default_rng(6)
    for bits in (4, 9, 16, 20):
        width = min(48, 64 - bits)
        for n in (1, 2, 3, 1400):
            for top in (n, 3 * n, 1 << width):
                low = np.sort(rnd.choice(top, n, replace=False)) if top < 10_000 else np.unique(rnd.integers(0, top, n, dtype=np.uint64))
                low = low.astype(np.uint64)
                found = (low << np.uint64(max(16 - bits, 0))) | np.uint64(5 << (64 - bits))
                data = backoff._gaps(found, bits)
                assert (backoff._from_gaps(data) == low).all()
    assert len(data) < 5.1 * 1400
