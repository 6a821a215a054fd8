import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tidewatch.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos int, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def climb(nodes):
    """The levels of a tree, from its leaves to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        out.append((i % 2, run[1 - i % 2] if len(run) == 2 else None))
        i //= 2
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for q, g in enumerate(names):
        for p, r in enumerate(groups[g]):
            steps = way(trees[g], p) + way(top, q)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            x = leaf((r[0], r[1], r[2], r[3] + 1, r[4]) if bad else r)
            for right, s in steps:
                x = h(x) if s is None else h(s, x) if right else h(x, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*(s for _, s in steps if s)), x, x == root))
    return sorted(map(repr, out))


def rows(n, langs, seed=2):
    r = random.Random(seed)
    made = [(i * 3, r.choice(["web", None, "news"]), r.choice(langs), r.choice([5, 70, None]), r.choice(["text é😀", "", None, "abc " * r.randrange(9)])) for i in range(n)]
    return made + [(None, None, langs[0], None, None), (None, "x", langs[0], 1, "y"), made[0], made[0], (9, "a", "~z", 2**63 - 1, "z" * 50000)]


@pytest.mark.parametrize("height", [1, 3, 12])
@pytest.mark.parametrize("n,langs", [(40, ["en", None, "é", "e"]), (133, ["en"]), (30, [str(i) for i in range(29)])])
def test_equals_brute_force(spark, n, langs, height):
    data = rows(n, langs)
    df = spark.createDataFrame([(*r, "g", 1, "l") for r in data], SCHEMA)
    got = merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, height=height)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(data)


def test_empty_one_row_and_groups_of_one(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == []
    for data in ([(1, "s", None, 2, "t")], [(i, "s", f"l{i}", 2, "t") for i in range(5)]):
        df = spark.createDataFrame([(*r, "g", 1, "l") for r in data], SCHEMA)
        assert sorted(repr(tuple(r)) for r in merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).collect()) == brute(data)


def test_without_tampering_everything_is_verified(spark, sf):
    got = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"), height=4)
    assert got.filter("verified").count() == got.count() > 0
    with pytest.raises(ValueError):
        merkle.manifest(got, height=0)
