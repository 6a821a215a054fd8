import random
import re

import numpy as np
import xxhash

from tidewatch.llm import simhash


def components(values, distance=4):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def near(seed=1):
    random.seed(seed)
    out = {random.getrandbits(64) for _ in range(200)}
    for x in list(out)[:60]:
        for _ in range(random.randrange(1, 8)):
            y = x
            for b in random.sample(range(64), random.randrange(1, 7)):
                y ^= 1 << b
            out.add(y)
    x = next(iter(out))
    for _ in range(600):
        y = x
        for b in random.sample(range(64), random.randrange(1, 4)):
            y ^= 1 << b
        out.add(y)
    return np.array(sorted(out), np.uint64)


def test_links_connect_what_brute_force_connects(spark):
    values = near()
    want = components(values)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for rows in (20_000, 150):  # the second cuts subtrees into blocks
        edges = simhash.links(df, rows)
        found = {r.member: r.root for r in simhash.components(edges).collect()}
        names = [found.get(int(v), int(v)) for v in values.view(np.int64)]
        groups = {}
        for n, w in zip(names, want):
            assert groups.setdefault(n, w) == w
        assert len(set(names)) == len(set(want))


def test_budgets_let_some_rotation_through():
    random.seed(2)
    for _ in range(2000):
        bits = set(random.sample(range(64), 4))
        ok = False
        for r in range(5):
            order = [b for i in range(5) for b in range(sum(simhash.BLOCKS[: (r + i) % 5]), sum(simhash.BLOCKS[: (r + i) % 5 + 1]))]
            budget, n, good = simhash.budgets(r), 0, True
            for depth, b in enumerate(order, 1):
                n += b in bits
                good &= n <= budget[depth]
            ok |= good
        assert ok


def test_whole_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    values = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    for i, v, c in zip(ids, values, components(values)):
        assert got[i] == (f"{int(v):016x}", ids[c])


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert by[(3, "0" * 16)] == 2 and by[(2, "0" * 16)] == 2 and by[(4, "0" * 16)] == 2
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.keep_one(empty).count() == 0
