"""SimHash near-duplicates with a binary-trie self-join.

Fingerprints: A-Z lower-cased words, 4-word shingles with repeats, XXH64 (seed 42); a bit is set where over half the
shingles set it. Fewer words make one shingle, no word makes fingerprint zero, which links like any other.

Links: distinct fingerprints are the leaves of a binary trie. Pairs of nodes are walked together, level by level, adding
up differing bits; a pair goes as soon as its bits exceed the budget of its depth. If two fingerprints differ in at most
k bits over m blocks, some rotation of the blocks keeps every prefix of i blocks within i*k/m differing bits (cycle
lemma), so the trie of each rotation is walked with that budget: its first block must be equal, which makes it the key by
which Spark deals out the subtrees, and small budgets near the root keep the walk near-linear. Every candidate is checked
by its full distance, so links are exact.

Inside a subtree only a spanning forest of the links is returned (node pairs inside one found component are skipped), so a
group of n near copies gives n - 1 rows. A subtree with more than ``block_rows`` fingerprints is descended further in Spark,
by as many of its next bits as its size asks for: they lie in the second block, where one differing bit at most is allowed, so
a node meets itself and one node for each bit. So a row is sent to 14 tasks at most, however many fingerprints there are.
Components over the forest come from alternating large-star and small-star
steps, each written to the shared folder.

Null and empty texts have fingerprint zero. Rows that repeat an id, and rows without id, are fingerprinted each; an empty
table gives an empty result. Further columns pass through, those named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm._common import free_name, materialise, schema_with, slices, with_column

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
#: Widths of the blocks of a fingerprint; one more than the distance, so that some rotation starts with an equal block.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints that share a rotation's first block and are walked by one task; beyond it the next bits part them.
BLOCK_ROWS = 20_000
#: Rows that a task gathers before it walks their subtrees together.
ROWS_AT_ONCE = 50_000
#: Node pairs of one step, and leaf pairs below which two nodes are compared leaf by leaf.
STEP, FEW = 16_384, 64

_BITS = np.array([[b >> k & 1 for k in range(8)] for b in range(256)])


def fingerprint(data: bytes) -> int:
    w = data.lower().split()  # on bytes: A-Z alone, and just \x20 and \x09-\x0D
    if not w:
        return 0
    digest, n = xxhash.xxh64_intdigest, SHINGLE_WORDS
    found = [b" ".join(s) for s in zip(*(w[k:] for k in range(n)))] if len(w) >= n else [b" ".join(w)]
    h = np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found))
    by_byte = np.bincount((h.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * by_byte.ravel() > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fp", keep_text: bool = True) -> DataFrame:
    """Adds the 64-bit fingerprint of every whole text as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(d or b"") for d in batch.column(text_col).cast(pa.binary()).to_pylist()], np.uint64)
            yield with_column(batch if keep_text else batch.drop_columns(text_col), out_col, pa.array(found.view(np.int64)))

    return docs.mapInArrow(run, schema_with(docs if keep_text else docs.drop(text_col), out_col, T.LongType()))


def budgets(rotation: int) -> list[int]:
    """Differing bits allowed after each number of leading bits."""
    out = [0]
    for i in range(1, len(BLOCKS) + 1):
        width = BLOCKS[(rotation + i - 1) % len(BLOCKS)]
        out += [i * DISTANCE // len(BLOCKS)] * width
    return out


class Forest:
    """Components of 0..n-1 as they are found: label is the least member known, changes counts label changes up to a place."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
        self._mark()

    def one(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Whether both ranges lie in the same component."""
        c, label = self.changes, self.label
        return (c[hi1 - 1] == c[lo1]) & (c[hi2 - 1] == c[lo2]) & (label[lo1] == label[lo2])


def walk(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: list[int]) -> np.ndarray:
    """fps: rotated fingerprints, sorted within each range [lo, hi) of equal first ``depth`` bits. Returns each place's
    component: the least place that it is linked to."""
    forest, ones = Forest(len(fps)), {}
    some = hi - lo > 1
    stack = [(depth, lo[some], hi[some], lo[some], hi[some], np.zeros(some.sum(), np.int64))]
    while stack:
        depth, *pairs = stack.pop()
        if len(pairs[0]) > STEP:
            stack.append((depth, *(x[:-STEP] for x in pairs)))
            pairs = [x[-STEP:] for x in pairs]
        open_ = ~forest.one(*pairs[:4])
        lo1, hi1, lo2, hi2, bits = (x[open_] for x in pairs)
        product = (hi1 - lo1) * (hi2 - lo2)
        few = (product <= FEW) | (depth == 64)
        if few.any():
            n = product[few]
            of = np.repeat(np.flatnonzero(few), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (hi2 - lo2)[of]
            i, j = lo1[of] + at // width, lo2[of] + at % width
            near = np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE
            forest.join(i[near], j[near])
        lo1, hi1, lo2, hi2, bits = (x[~few] for x in (lo1, hi1, lo2, hi2, bits))
        if not len(lo1):
            continue
        if depth not in ones:
            set_ = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(set_.astype(np.int64))])
        c, most = ones[depth], budget[depth + 1]
        mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        self_ = lo1 == lo2
        made = [
            (lo1, mid1, mid2, hi2, bits + 1),  # differing bits first: equal ones are popped first and make components early
            *([(mid1[~self_], hi1[~self_], lo2[~self_], mid2[~self_], bits[~self_] + 1)] if not self_.all() else []),
            (lo1, mid1, lo2, mid2, bits),
            (mid1, hi1, mid2, hi2, bits),
        ]
        for a, b, x, y, e in made:
            good = (b > a) & (y > x) & (e <= most) & ~((a == x) & (b - a == 1))
            if good.any():
                stack.append((depth + 1, a[good], b[good], x[good], y[good], e[good]))
    return forest.label


def _forest_rows(rotation: int, group: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least) in true fingerprints for the subtrees of one rotation."""
    order = np.lexsort((rotated, group))
    group, rotated = group[order], rotated[order]
    lo = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    label = walk(rotated, lo, np.append(lo[1:], len(group)), BLOCKS[rotation], budgets(rotation))
    linked = np.flatnonzero(label != np.arange(len(label)))
    turn = np.uint64(sum(BLOCKS[:rotation]))
    back = lambda x: x if not turn else (x >> turn) | (x << (np.uint64(64) - turn))
    return back(rotated[linked]), back(rotated[label[linked]])


def _walk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rotation, part, fp), groups of equal (rotation, part) standing together."""

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r, part, fp = rows
        for rotation in np.unique(r):
            own = r == rotation
            a, b = _forest_rows(int(rotation), part[own], fp[own].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(held, batch.columns)]
        if len(held[0]) >= ROWS_AT_ONCE:
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(ends):
                cut = ends[-1] + 1
                yield from done([x[:cut] for x in held])
                held = [x[cut:] for x in held]
    if len(held[0]):
        yield from done(held)


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fps: distinct fingerprints in column fp. Returns (a, b), a forest that connects exactly what is linked."""
    turned = []
    for r, width in enumerate(BLOCKS):
        s = sum(BLOCKS[:r])
        rotated = F.col("fp") if not s else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))
        turned.append(F.struct(F.lit(r).cast("long").alias("rotation"), F.shiftrightunsigned(rotated, 64 - width).alias("key"), rotated.alias("fp")))
    rows = fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    sizes = rows.groupBy("rotation", "key").agg(F.count("*").alias("n"))  # 5 * 2^13 rows at most
    rows = rows.join(F.broadcast(sizes), ["rotation", "key"])
    bits = F.least(F.ceil(F.log2(F.col("n") / block_rows)).cast("int") + 1, F.lit(min(BLOCKS)))
    rows = rows.withColumn("bits", F.when(F.col("n") > block_rows, bits).otherwise(0))
    width = F.element_at(F.array(*map(F.lit, BLOCKS)), F.col("rotation").cast("int") + 1)
    node = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(64) - width - F.col("bits")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)
    rows = rows.withColumn("node", F.when(F.col("bits") > 0, node).otherwise(0))
    other = lambda i: F.col("node").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))
    others = F.transform(F.sequence(F.lit(1), F.col("bits")), lambda i: other(i - 1))
    nodes = F.concat(F.array("node"), F.when(F.col("bits") > 0, others).otherwise(F.array().cast("array<bigint>")))
    cells = F.transform(nodes, lambda o: F.least(F.col("node"), o) * (1 << max(BLOCKS)) + F.greatest(F.col("node"), o))
    rows = rows.select("rotation", "key", F.explode(cells).alias("cell"), "fp").select("rotation", F.xxhash64("key", "cell").alias("part"), "fp")
    return rows.repartition("rotation", "part").sortWithinPartitions("rotation", "part").mapInArrow(_walk_groups, "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(member, root) for every a and b of the edges; root is the least member of the component."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = sign(edges)
    while seen[0]:
        edges = materialise(_stars(materialise(_stars(edges, True), "large-star"), False), "small-star")
        if (now := sign(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("member"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("member"), F.col("b").alias("root")).distinct())


#: Keys of documents that go (16 bytes each) are broadcast up to so many; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, with all its columns: that of the least id (rows without id come last,
    rows of equal id by fingerprint and hash); of rows alike in id and text one stays, by least of all columns."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("\x00"), F.col(text_col))
    prints = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    prints = materialise(with_fingerprint(prints, "text", keep_text=False), "simhash")
    roots = materialise(components(links(prints.select("fp").distinct())), "roots").withColumnRenamed("member", "fp")
    rows = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "key")).alias("best"))
    chosen = materialise(best.select("best.key"), "kept-keys")
    gone = materialise(prints.select("key").distinct().join(chosen, "key", "left_anti"), "gone-keys")
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    row, other, one = (free_name(docs, c) for c in ("row", "key", "one"))
    as_other = lambda df: df.select(F.col("key").alias(other))
    kept, same = docs.withColumn(row, key), F.col(row) == F.col(other)
    kept = kept.join(F.broadcast(as_other(gone)) if few else as_other(gone), same, "left_anti")
    alike = as_other(prints.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").join(chosen, "key", "left_semi"))
    if alike.isEmpty():
        return kept.drop(row)
    alike = materialise(alike, "alike-keys")
    several = kept.join(alike, same, "left_semi").groupBy(row).agg(F.min(F.struct(*docs.columns)).alias(one)).select(f"{one}.*")
    return kept.join(alike, same, "left_anti").drop(row).unionByName(several)


def component_ids(prints: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the least id that can be reached from it."""
    fps = materialise(prints.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "fingerprints")
    found = materialise(components(links(fps.select("fp"))).withColumnRenamed("member", "fp").join(fps, "fp"), "members")
    roots = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(roots, "root").select("fp", "component_id")
    return fps.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; one row of each component has component_id = id."""
    prints = materialise(with_fingerprint(docs.select(id_col, text_col), text_col, keep_text=False), "simhash")
    joined = prints.join(component_ids(prints, id_col), "fp")
    return joined.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
