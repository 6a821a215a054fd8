"""Document fingerprints: SimHash over weighted terms, searched by permuted block tables. DataFrame functions only.

A text's terms are its distinct lower-cased words. A term's XXH64 (seed 42) votes on 64 signed bits with the term's weight: the
number of binary digits of N / df, where N counts all texts and df the texts that hold a term of the same bucket (2^16 buckets of
the hash, so the weights are a table of at most 65,536 rows whatever the corpus, and that table may be broadcast). A bit is 1 where
the votes for it outweigh those against. Votes for bits j and j + 32 are added up in the two halves of one long, so a text has 32
sums, made in generated code, and never a group larger than its own terms.

Permuted block tables: a fingerprint is cut into blocks; two that differ in ``radius`` bits at most agree on some choice of
``blocks - radius`` whole blocks. Each choice is a table keyed by those blocks, so an equal key in some table finds every
partner; the full distance decides, and a pair counts in the first table that finds it. Rows of a key are dealt over ``SALTS``
tasks, so that a key of many fingerprints is no single task.

Null texts are empty; texts without a word have fingerprint zero. Rows without id come after all ids, rows of equal id follow each
other by their text's hash, equal rows by nothing (they are alike: of n all but one are followed by a copy of themselves). An
empty table gives an empty result. Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._common import materialise

BUCKETS = 1 << 16
RADIUS = 3
BLOCKS = 5
SALTS = 8

#: What tells rows apart: whether the id is missing, the id, the text's hash.
ROW = ["none", "id", "key"]
_NEXT, _PREVIOUS = ([f"{side}_{c}" for c in ROW] for side in ("next", "previous"))


def terms(text: Column) -> Column:
    """The distinct lower-cased words of a text. White space becomes a space first: splitting at one character needs no pattern."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_distinct(F.array_remove(F.split(F.lower(text), " "), ""))


def fit_weights(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, weight) for every bucket of term hashes that the texts use, and one row with bucket -1 for all others."""
    text, n = F.coalesce(F.col(text_col), F.lit("")), docs.count()
    held = docs.select(F.explode(terms(text)).alias("term")).groupBy(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("df"))
    digits = lambda x: F.length(F.bin(x)).cast("long").alias("weight")
    other = docs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("bucket"), digits(F.lit(n)))
    return held.select("bucket", digits(F.floor(F.lit(n) / F.col("df")))).unionByName(other)


def _bits(sums: list[Column], total: Column) -> Column:
    """The fingerprint from 32 sums of two halves each."""
    out = F.lit(0).cast("long")
    for j, s in enumerate(sums):
        for bit, votes in ((j, s.bitwiseAND(0xFFFFFFFF)), (j + 32, F.shiftrightunsigned(s, 32))):
            one = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * votes > total, F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def with_fingerprints(rows: DataFrame, weights: DataFrame, by: list[str], text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """(by, out_col): one fingerprint for each combination of the columns ``by``, which must tell the texts apart."""
    said = rows.select(*by, F.explode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    said = said.select(*by, F.xxhash64("term").alias("h"), F.col("term").isNotNull().alias("some")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    other = weights.filter("bucket = -1").first()["weight"]
    said = said.join(F.broadcast(weights), "bucket", "left")
    said = said.select(*by, "h", F.when(F.col("some"), F.coalesce("weight", F.lit(other))).otherwise(0).alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(0x100000001) * F.col("w")).alias(f"s{j}") for j in range(32)]
    voted = said.groupBy(*by).agg(F.sum("w").alias("total"), *lanes)
    return voted.select(*by, _bits([F.col(f"s{j}") for j in range(32)], F.col("total")).alias(out_col))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits that each block table is keyed by, as signed longs."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be 0 or more and less than blocks, blocks 64 at most")
    cut = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(blocks)]
    found = [sum(chosen) for chosen in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def search(index: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """index and queries: distinct fingerprints in column fp. Returns (query, fp, distance) for all within the radius."""
    keyed = masks(radius, blocks)

    def tables(df: DataFrame, name: str, salt: Column) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("cell")) for i, m in enumerate(keyed)))
        out = df.select(F.col("fp").alias(name), F.explode(cells).alias("x")).select(name, "x.*")
        return out.withColumn("salt", salt)

    left = tables(queries, "query", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = tables(index, "found", F.pmod(F.xxhash64("found"), F.lit(SALTS)).cast("int"))
    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(keyed)))
    b = right.select(F.col("at").alias("b_at"), F.col("cell").alias("b_cell"), F.col("salt").alias("b_salt"), "found")
    near = (F.col("at") == F.col("b_at")) & (F.col("cell") == F.col("b_cell")) & (F.col("salt") == F.col("b_salt")) & (F.bit_count(apart) <= radius) & (first == F.col("at"))
    return left.join(b, near).select("query", F.col("found").alias("fp"), F.bit_count(apart).alias("distance"))


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(none, id, key, text), a row for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return found.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("key"), "text")


def neighbours(rows: DataFrame) -> DataFrame:
    """For each different row: how often it occurs (n), its length, the row that follows it and the one before, after the last the
    first. Narrow rows are range-partitioned; only the first and last row of each partition meet in one task."""
    narrow = rows.groupBy(*ROW).agg(F.count("*").alias("n"), F.min(F.length("text")).cast("long").alias("n_chars"))
    placed = materialise(narrow.repartitionByRange(*ROW).withColumn("part", F.spark_partition_id()), "row-order")
    row, inside, along = F.struct(*ROW, "n_chars"), W.partitionBy("part").orderBy(*ROW), W.orderBy("part")
    ends = placed.groupBy("part").agg(F.min(row).alias("least"), F.max(row).alias("most"))  # a row for each partition
    everything = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("least").over(along), F.first("least").over(everything)).alias("after"),
        F.coalesce(F.lag("most").over(along), F.last("most").over(everything)).alias("before"),
    )
    led = placed.withColumn("next", F.lead(row).over(inside)).withColumn("previous", F.lag(row).over(inside)).join(ends, "part")
    led = led.withColumn("next", F.coalesce("next", "after")).withColumn("previous", F.coalesce("previous", "before"))
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ROW]
    quarter = lambda c: F.floor(F.col(c) / 4).cast("int")
    return led.select(*ROW, "n", "n_chars", quarter("n_chars").alias("cut"), *side("next"), *side("previous"), quarter("previous.n_chars").alias("asked"))


def edited(rows: DataFrame, several: bool) -> DataFrame:
    """rows: different rows with their neighbours. (none, id, key, edited, n_chars, next_*, times, copy): each text with its last quarter
    replaced by the beginning of the next one; all but one of equal rows (copy 1) are followed by themselves. Texts are shuffled once; of the next text only what is asked for travels.
    several: whether any row occurs more than once."""
    heads = rows.select(*(F.col(p).alias(c) for p, c in zip(_PREVIOUS, ROW)), F.left("text", F.col("asked")).alias("head"))
    kept = rows.select(*ROW, "text", "n", "n_chars", "cut", *_NEXT).join(heads, ROW)
    front = F.left("text", F.col("n_chars").cast("int") - F.col("cut"))
    one = F.lit(1).cast("long")
    if not several:
        return kept.select(*ROW, F.concat(front, "head").alias("edited"), "n_chars", *_NEXT, one.alias("times"), F.lit(0).alias("copy"))
    last = F.struct(one.alias("times"), F.lit(0).alias("copy"), F.col("head"), *_NEXT)
    copies = F.struct((F.col("n") - 1).alias("times"), F.lit(1).alias("copy"), F.left("text", F.col("cut")).alias("head"), *(F.col(c).alias(x) for c, x in zip(ROW, _NEXT)))
    kept = kept.select(*ROW, front.alias("front"), "n_chars", F.explode(F.array(last, copies)).alias("x")).filter("x.times > 0")
    return kept.select(*ROW, F.concat("front", "x.head").alias("edited"), "n_chars", *(f"x.{c}" for c in _NEXT), "x.times", "x.copy")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: DataFrame | None = None, radius: int = RADIUS) -> DataFrame:
    """For every document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and for ids that 100
    divides n_near, the number of other documents within the radius."""
    if weights is None:
        weights = materialise(fit_weights(docs, text_col), "term-weights")
    rows = rows_of(docs, id_col, text_col)
    order = materialise(neighbours(rows), "neighbours")
    several = not order.filter("n > 1").isEmpty()
    rows = (rows.dropDuplicates(ROW) if several else rows).join(order, ROW)
    by = [*ROW, "n_chars", "edited_sha256", *_NEXT, "times", "copy"]
    changed = with_fingerprints(edited(rows, several).withColumn("edited_sha256", F.sha2("edited", 256)), weights, by, "edited", "edited_fp")
    own = with_fingerprints(rows, weights, ROW)
    prints = materialise(changed.join(own, ROW), "fingerprints")
    of_next = prints.select(*(F.col(c).alias(x) for c, x in zip(ROW, _NEXT)), F.col("fp").alias("next_fp")).dropDuplicates(_NEXT)
    counts = prints.groupBy("fp").agg(F.sum("times").alias("n"))
    asked = ~F.col("none") & (F.col("id") % 100 == 0)
    found = search(counts.select("fp"), prints.filter(asked).select("fp").distinct(), radius)
    near = found.join(counts, "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("found"))
    done = prints.join(of_next, _NEXT).join(near, "fp", "left").withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return done.select(
        F.when(~F.col("none"), F.col("id")).alias(id_col),
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("found")).alias("n_near"),
    )
