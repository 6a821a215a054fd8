import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from tidewatch.llm import fingerprints as fp


def brute(rows):
    """rows: (id, text). What the query returns, in plain Python."""
    rows = [(i, t or "") for i, t in rows]
    n = len(rows)
    words = lambda t: {w for w in re.split("[\\x20\\x09-\\x0D]+", t.lower()) if w}
    h = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = {}
    for _, t in rows:
        for w in words(t):
            df[h(w) % fp.BUCKETS] = df.get(h(w) % fp.BUCKETS, 0) + 1  # 2^16 divides 2^64: the sign doesn't matter

    def print_of(t):
        votes = [0] * 64
        for w in words(t):
            weight = (n // df.get(h(w) % fp.BUCKETS, 1)).bit_length()
            for b in range(64):
                votes[b] += weight if h(w) >> b & 1 else -weight
        return sum(1 << b for b in range(64) if votes[b] > 0)

    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, signed(h(r[1]))))
    prints = [print_of(t) for _, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(k + 1) % n][1]
        changed = t[: len(t) - q] + after[:q]
        other = print_of(changed)
        share = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        near = sum(bin(prints[k] ^ p).count("1") <= fp.RADIUS for p in prints) - 1 if i is not None and i % 100 == 0 else None
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f"{prints[k]:016x}", f"{other:016x}", share(prints[k], other), share(prints[k], prints[(k + 1) % n]), near))
    return sorted(map(repr, out))


def texts(n, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)] + ["The", "the", "OF"]
    rows = [(i, r.choice([" ", "\t", "\n\n"]).join(r.choice(vocab) for _ in range(r.randrange(1, 60)))) for i in range(n)]
    return rows + [(n + i, rows[5][1]) for i in range(40)] + [(n + 100 + i, rows[6][1] + f" x{i}") for i in range(40)]


ODD = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (103, "one"), (103, "one"), (103, "two words"), (None, "no id at all"), (None, None), (104, "x" * 9000), (105, "word " * 3000), (200, "😀 é 😀 abc def")]


@pytest.mark.parametrize("rows", [texts(150), texts(20) + ODD, ODD, [(1, "alone in the table here")], [(1, "a b c d"), (1, "a b c d")]], ids=["plain", "odd", "only odd", "one row", "one row twice"])
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, key string, fp int, n int")
    got = fp.documents(df).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_empty_table(spark, empty):
    assert fp.documents(empty).collect() == []


@pytest.mark.parametrize("radius,blocks", [(0, 2), (3, 5), (4, 6), (6, 8)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(40)]
    found = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            x = b
            for bit in r.sample(range(64), r.randrange(0, radius + 3)):
                x ^= 1 << bit
            found.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    index = spark.createDataFrame([(x,) for x in signed], "fp long")
    queries = index.filter(F.pmod("fp", F.lit(7)) == 0)
    asked = [r.fp for r in queries.collect()]
    got = sorted(tuple(r) for r in fp.search(index, queries, radius, blocks).collect())
    distance = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == sorted((q, x, distance(q, x)) for q in asked for x in signed if distance(q, x) <= radius)


def test_likeness_tells_edited_from_unrelated(spark, sf):
    got = fp.documents(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.7 and got[1] < 0.6


def test_main_path_has_no_python(spark, sf, monkeypatch):
    plans = []
    keep = fp.materialise
    monkeypatch.setattr(fp, "materialise", lambda df, name: plans.append(df) or keep(df, name))
    plans.append(fp.documents(spark.read.parquet(f"{sf}/documents.parquet")))
    for df in plans:
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
