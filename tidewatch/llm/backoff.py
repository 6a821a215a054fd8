"""Language-model scores by stupid backoff, leave-one-out, from counts over all documents.

A word after its context scores c(context word) / c(context) if other documents hold that n-gram, else ``alpha`` times the
score with the context's first word left out; a single word scores c(word) / N, one that no other document holds counts as
seen once. Counts leave out the scored document itself, else every n-gram of it would be known. A document's score is the
mean natural logarithm over its words.

N-grams are hashes. Documents fall into blocks by hash; each block's distinct n-grams with counts go to the count tables,
dealt out by hash prefix, packed into one row for each block and prefix. Equal hashes meet there, are summed, and the sums go
back to their blocks in the same order, where they are joined to the documents' n-grams and summed per document. So each
distinct n-gram of a block crosses the network once, however often it occurs; a frequent one adds at most a row for each
block. Blocks and prefixes both grow with the square root of the texts' bytes, so that a row holds as many n-grams at any
size, until they reach what fits a task's memory (BLOCK_BYTES, PREFIX_BYTES: from 32 GB on; at 1 TB a row holds a thirtieth
of that, some 45 n-grams of a length). There are never more rows than n-grams, as empty ones aren't sent. A prefix and the 48
bits after it tell n-grams apart (64 bits in all at most): among N distinct ones some N^2 / 2^(49 + bits) pairs are taken for
one another.

Documents cross twice, to be counted and to be scored, packed by block and compressed. A document repeated in a batch crosses
once with its number of copies, so that a row that is repeated millions of times doesn't fill its block.

Words are A-Z lower-cased runs of other characters than space and \\x09-\\x0D. Null and empty texts have no word and a null
score. Repeated rows count as documents of their own. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import materialise
from tidewatch.llm.quality import forget_words, word_hashes

ALPHA = 0.4
#: Bytes of text whose n-grams of one length go to one row, from one block and one hash prefix.
CELL_BYTES = 8 << 10
#: The most bytes of text in a block, and the most whose n-grams of one length share a hash prefix.
BLOCK_BYTES = PREFIX_BYTES = 16 << 20
#: How hard texts are compressed, which cross the network twice.
TEXT_LEVEL = 6
#: The least bits of a prefix. The next 48 bits are sent.
PREFIX_BITS = 4
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)  # fixed, so that every block hashes alike


def block_grams(texts: list[bytes | None], order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document number of each word, and for each length up to order the n-gram that ends at each word (zero where the
    document has too few words before it)."""
    hashes = [word_hashes(t.lower()) if t else np.zeros(0, np.uint64) for t in texts]
    forget_words()
    doc = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    grams = [_mixed(words)]
    for k in range(1, order):
        g = np.zeros(len(words), np.uint64)
        whole = doc[k:] == doc[:-k]
        g[k:][whole] = _mixed(grams[-1][k - 1 : -1] * np.uint64(3) + words[k:])[whole] if k > 1 else _mixed(_mixed(words[:-1]) * np.uint64(3) + words[1:])[whole]
        grams.append(g)
    keep = np.uint64((1 << 64) - (1 << max(16 - bits, 0)))  # the bits that are sent
    return doc, [np.where(g == 0, g, np.maximum(g & keep, ~keep + np.uint64(1))) for g in grams]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    x = x ^ (x >> _SHIFT)
    return np.maximum(x, np.uint64(1))


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-grams of a block, their counts, and for each place its n-gram's number (-1 where there is none)."""
    there = g != 0
    found, number, n = np.unique(g[there], return_inverse=True, return_counts=True)
    at = np.full(len(g), -1)
    at[there] = number
    return found, n, at


def _parts(found: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted n-grams that share a prefix."""
    prefix = (found >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else []
    for a, b in zip(starts, [*starts[1:], len(prefix)]):
        yield int(prefix[a]), slice(a, b)


def _gaps(found: np.ndarray, bits: int) -> bytes:
    """Sorted n-grams of one prefix as the gaps between their next 48 bits: of each gap as many low bits as an average gap has,
    and what is left as so many zeros before a one. A row of 1,400 n-grams takes five bytes for each in place of six."""
    low = (found >> np.uint64(max(16 - bits, 0))) & np.uint64((1 << min(48, 64 - bits)) - 1)
    gaps = np.diff(low, prepend=np.uint64(0))
    k = max(1, (int(low[-1]) // len(low)).bit_length() - 1)
    fine = np.packbits(np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :])
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    coarse = np.zeros(ends[-1] + 1, np.uint8)
    coarse[ends] = 1
    return bytes([k]) + len(low).to_bytes(8, "little") + fine.tobytes() + np.packbits(coarse).tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    k, n = data[0], int.from_bytes(data[1:9], "little")
    n_fine = (n * k + 7) // 8
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - k :] = np.unpackbits(np.frombuffer(data, np.uint8, n_fine, 9), count=n * k).reshape(n, k)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=9 + n_fine)))
    coarse = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    return np.cumsum((coarse << np.uint64(k)) + np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _numbers(values: np.ndarray) -> bytes:
    """Counts as compressed bytes of the least width; most are one."""
    wide = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(k).max)
    return bytes([np.dtype(wide).itemsize]) + len(values).to_bytes(8, "little") + pa.compress(values.astype(wide).tobytes(), codec="zstd", asbytes=True)


def _from_numbers(data: bytes) -> np.ndarray:
    kind, n = np.dtype(f"u{data[0]}"), int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], n * kind.itemsize, codec="zstd", asbytes=True), kind).astype(np.int64)


def sides(n_bytes: int) -> tuple[int, int]:
    """Number of blocks and bits of a prefix for texts of so many bytes."""
    side = max(1, isqrt(n_bytes * CELL_BYTES))
    return n_bytes // min(side, BLOCK_BYTES) + 1, max(PREFIX_BITS, (n_bytes // min(side, PREFIX_BYTES)).bit_length())


def packed(docs: DataFrame, n_blocks: int, id_col: str, text_col: str) -> DataFrame:
    """(block, docs): ids, texts and numbers of copies of a block's documents from one batch, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=TEXT_LEVEL))
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["block", "id", "text"], use_threads=False).aggregate([([], "count_all")])
            rows = rows.rename_columns(["block", "id", "text", "copies"])
            block = rows.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            parts = [(int(block[part[0]]), part) for part in np.split(order, cuts) if len(part)]
            blobs = []
            for _, part in parts:
                to = pa.BufferOutputStream()
                own = rows.select(["id", "text", "copies"]).take(pa.array(part))
                with pa.ipc.new_stream(to, own.schema, options=options) as stream:
                    stream.write_table(own)
                blobs.append(to.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], ["block", "docs"])

    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(n_blocks)).cast("int")
    return docs.select(block.alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "block int, docs binary")


def _unpacked(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs])


def own_grams(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """(n, prefix, block, grams, counts): each block's distinct n-grams of each length."""

    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        own = _unpacked(rows.column("docs"))
        copies = own.column("copies").to_numpy()
        doc, grams = block_grams(own.column("text").cast(pa.binary()).to_pylist(), order, bits)
        out: list[tuple] = []
        for n, g in enumerate(grams, 1):
            found, count, at = distinct(g)
            if (copies > 1).any():
                there = at >= 0
                count = np.bincount(at[there], copies[doc[there]], len(found)).astype(np.int64)
            out += [(n, p, block, _gaps(found[part], bits), _numbers(count[part])) for p, part in _parts(found, bits)]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(columns[i], pa.int32() if i < 3 else pa.binary()) for i in range(5)], ["n", "prefix", "block", "grams", "counts"])

    return blocks.groupBy("block").applyInArrow(run, "n int, prefix int, block int, grams binary, counts binary")


def totals(own: DataFrame) -> DataFrame:
    """(n, prefix, block, occurrences, totals): for every block's n-grams, in their order, the counts over all blocks;
    occurrences are the block's own, summed."""

    def add_up(rows: list[tuple]) -> pa.RecordBatch:
        grams, counts = [_from_gaps(r[3]) for r in rows], [_from_numbers(r[4]) for r in rows]
        _, number = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts)).astype(np.int64)[number]
        parts = np.split(total, np.cumsum([len(g) for g in grams])[:-1])
        keys = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
        own_sums = pa.array([int(c.sum()) for c in counts], pa.int64())
        return pa.RecordBatch.from_arrays([*keys, own_sums, pa.array([_numbers(t) for t in parts], pa.binary())], ["n", "prefix", "block", "occurrences", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "prefix", "block")))):
                if held and held[0][:2] != key[:2]:
                    yield add_up(held)
                    held = []
                held.append((*key, batch.column("grams")[i].as_py(), batch.column("counts")[i].as_py()))
        if held:
            yield add_up(held)

    dealt = own.repartition("n", "prefix").sortWithinPartitions("n", "prefix", "block")
    return dealt.mapInArrow(run, "n int, prefix int, block int, occurrences long, totals binary")


def block_scores(texts: list[bytes | None], sums: list[np.ndarray], n_words: int, alpha: float, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and mean log score of each text; sums: for each length the totals of the block's sorted n-grams."""
    doc, grams = block_grams(texts, len(sums), bits)
    words = np.bincount(doc, minlength=len(texts))
    others = []  # for each length, occurrences of the n-gram that ends at a place in other documents
    for g, total in zip(grams, sums):
        found, count, at = distinct(g)
        if len(found) != len(total):
            raise ValueError("a block was read otherwise than it was counted")
        left = np.zeros(len(g), np.int64)
        once = at >= 0
        left[once] = total[at[once]] - 1
        # only what the block holds more than once may stand in its document again
        again = np.flatnonzero(once)[count[at[once]] > 1]
        _, number, own = np.unique(at[again] * len(texts) + doc[again], return_inverse=True, return_counts=True)
        left[again] = total[at[again]] - own[number]
        others.append(left)
    n = np.maximum(n_words - words[doc], 1)
    score = np.log(np.maximum(others[0], 1) / n) + (len(sums) - 1) * np.log(alpha)
    for k in range(1, len(sums)):
        context = np.concatenate([np.zeros(1, np.int64), others[k - 1][:-1]])
        known = (others[k] > 0) & (context > 0)
        score[known] = np.log(others[k][known] / context[known]) + (len(sums) - 1 - k) * np.log(alpha)
    # a document's first words have no longer context to back off from
    if len(doc):
        place = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(words)[:-1]])[doc]
        score -= np.maximum(len(sums) - 1 - place, 0) * np.log(alpha)
    total = np.bincount(doc, score, minlength=len(texts)) if len(doc) else np.zeros(len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return words, total / words


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, prefix_bits: int | None = None) -> DataFrame:
    """(id, n_words, score) for every row."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n_blocks, bits = sides(n_bytes)
    bits = prefix_bits or bits
    blocks = packed(docs, n_blocks, id_col, text_col)
    sums = materialise(totals(own_grams(blocks, order, bits)), "ngram-totals")
    n_words = sums.filter("n = 1").agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _unpacked(left.column("docs"))
        of: list[list] = [[] for _ in range(order)]
        for n, prefix, t in sorted(zip(right.column("n").to_pylist(), right.column("prefix").to_pylist(), range(right.num_rows))):
            of[n - 1].append(_from_numbers(right.column("totals")[t].as_py()))
        words, mean = block_scores(own.column("text").cast(pa.binary()).to_pylist(), [np.concatenate([*x, np.zeros(0, np.int64)]) for x in of], n_words, alpha, bits)
        each = np.repeat(np.arange(own.num_rows), own.column("copies").to_numpy())
        words, mean = words[each], np.round(mean, 9)[each]
        return pa.table({"id": own.column("id").take(pa.array(each)), "n_words": pa.array(words, pa.int64()), "score": pa.array(mean, pa.float64(), mask=words == 0)})

    id_kind = dict(docs.dtypes)[id_col]
    scored = blocks.groupBy("block").cogroup(sums.select("block", "n", "prefix", "totals").groupBy("block")).applyInArrow(run, f"id {id_kind}, n_words long, score double")
    return scored.withColumnRenamed("id", id_col)
