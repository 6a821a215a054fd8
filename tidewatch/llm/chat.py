"""Chat formatting into a prefix tree.

Conversations that begin with the same turns share those turns' nodes. Every node is formatted and tokenised once; nodes
stand in depth-first order in one packed sequence. A node carries the position id of its first token (the tokens of its
ancestors) and the intervals of the sequence that its tokens attend to besides their own node's earlier ones: its
ancestors, neighbouring intervals merged.

A node is named by the chained hash of its turns. Nodes are ordered by the names at their branchings and then by depth,
which is depth-first order without long paths: a run of single children adds nothing. Offsets come from per-partition sums
of a range-partitioned sort. What belongs to a conversation is streamed in sorted order; no conversation, tree or hot first
turn is ever gathered.

The template marks turns by control strings; where a text holds one, or a backslash, a backslash goes before it, and comes
off again when texts are read back. Special tokens of the vocabulary are never made from a text: their names are plain
characters there.

Null role and text are empty. Turns are ordered by turn, ties and repeated rows by role and text and each counts; rows
without conv_id are one conversation of id null. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import materialise
from tidewatch.llm.bpe import vocabulary

#: Control strings around each known role's text; other roles are written out.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": ("<a>", "</s>")}
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"\\|</?[as]>|\[/?INST\]|<</?(?:SYS>>|ROLE)")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def pieces(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, for and after a text."""
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = f"{OTHER[0]}{role.encode().hex()}{OTHER[1]}", OTHER[2]
    return before, escape(text), after


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (before, after) in TEMPLATE.items():
        if formatted.startswith(before) and formatted.endswith(after):
            return role, unescape(formatted[len(before) : len(formatted) - len(after)])
    name, _, rest = formatted.removeprefix(OTHER[0]).partition(OTHER[1])
    return bytes.fromhex(name).decode(), unescape(rest.removesuffix(OTHER[2]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns))


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(df: DataFrame, order: list[str], run: Any, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Streams rows, dealt by conv_id and sorted, through run (an iterator of rows to an iterator of rows)."""
    schema = pa.schema([(n, k) for n, k, _ in columns])
    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return dealt.mapInArrow(lambda batches: _out(run(_rows(batches)), schema), ", ".join(f"{n} {k}" for n, _, k in columns))


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, node, parent, role, text): each turn with its node's and its parent's name."""

    def chain(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, place, parent = (), 0, b""
        for conv_id, _, role, text in rows:
            if last != (conv_id,):
                last, place, parent = (conv_id,), 0, b""
            r, t = role.encode(), text.encode()
            node = hashlib.sha256(parent + len(r).to_bytes(8, "big") + r + t).digest()[:16]
            yield conv_id, place, node, parent, role, text
            place, parent = place + 1, node

    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [("conv_id", pa.int64(), "long"), ("place", pa.int64(), "long"), ("node", pa.binary(), "binary"), ("parent", pa.binary(), "binary"), ("role", pa.string(), "string"), ("text", pa.string(), "string")]
    return _streamed(turns, ["turn", "role", "text"], chain, kinds)


def _branch_keys(turns: DataFrame, branching: DataFrame) -> DataFrame:
    """(node, key): the names chosen at branchings on the way to a node, one after the other."""

    def keys(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, key = (), b""
        for conv_id, _, node, chosen in rows:
            if last != (conv_id,):
                last, key = (conv_id,), b""
            key += node if chosen else b""
            yield node, key

    # all roots stand side by side, so their common parent needs no join
    root = turns.filter("place = 0").select("conv_id", "place", "node", F.lit(True).alias("chosen"))
    later = turns.filter("place > 0").join(branching, "parent", "left").select("conv_id", "place", "node", F.col("many").isNotNull().alias("chosen"))
    marked = root.unionByName(later)
    return _streamed(marked, ["place"], keys, [("node", pa.binary(), "binary"), ("key", pa.binary(), "binary")])


def pack(turns: DataFrame, vocab_path: str) -> DataFrame:
    """The packed sequence: a row for each node with its tokens, start, tokens under the loss mask (from, to within the
    node) and formatted length. turns: as members() returns them, written once."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        vocab = vocabulary(vocab_path)
        kinds = [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("n_chars", pa.int64())]

        def rows() -> Iterator[tuple]:
            for node, parent, depth, role, text in _rows(batches):
                ids, cuts, said = array("i"), [], pieces(role, text)
                for piece in said:
                    vocab.encode(piece, ids, special=False)
                    cuts.append(len(ids))
                loss = (cuts[0], cuts[1]) if role == LOSS_ROLE else (0, 0)
                yield node, parent, depth, ids.tolist(), *loss, sum(map(len, said))

        yield from _out(rows(), pa.schema(kinds))

    nodes = turns.groupBy("node").agg(F.first("parent").alias("parent"), F.first("place").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = materialise(nodes.mapInArrow(tokenise, "node binary, parent binary, depth long, token_ids array<int>, loss_from int, loss_to int, n_chars long"), "chat-nodes")
    branching = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("many")).filter("many > 1")
    branching = materialise(branching, "chat-branchings")
    keys = _branch_keys(turns.select("conv_id", "place", "node", "parent"), branching).groupBy("node").agg(F.first("key").alias("key"))
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = nodes.select("node", "depth", F.size("token_ids").cast("long").alias("n")).join(keys, "node")
    ordered = ordered.repartitionByRange(n, "key", "depth").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "chat-order")  # range bounds are sampled: later steps must all see these
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each partition
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("key", "depth").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sums), "part")
    return nodes.join(starts.select("node", (F.col("base") + F.col("inner")).alias("start")), "node")


def attention(turns: DataFrame, packed: DataFrame) -> DataFrame:
    """(node, position, attends): position id of the first token, and ancestors' intervals [from, to) of the sequence."""

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, position, spans = (), 0, []
        for conv_id, _, node, start, n in rows:
            if last != (conv_id,):
                last, position, spans = (conv_id,), 0, []
            yield node, position, [{"from": a, "to": b} for a, b in spans]
            position += n
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + n)
            else:
                spans.append((start, start + n))

    placed = turns.select("conv_id", "place", "node").join(packed.select("node", "start", F.size("token_ids").cast("long").alias("n")), "node")
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    found = _streamed(placed.select("conv_id", "place", "node", "start", "n"), ["place"], follow, [("node", pa.binary(), "binary"), ("position", pa.int64(), "long"), ("attends", kind, "array<struct<from: bigint, to: bigint>>")])
    return found.groupBy("node").agg(F.first("position").alias("position"), F.first("attends").alias("attends"))


def prefix_tree(conversations: DataFrame, vocab_path: str) -> tuple[DataFrame, DataFrame]:
    """(packed nodes with position and attends, members without texts)."""
    turns = materialise(members(conversations), "chat-turns")
    packed = materialise(pack(turns, vocab_path), "chat-packed")
    packed = materialise(packed.join(attention(turns, packed), "node"), "chat-tree")
    return packed, turns.select("conv_id", "place", "node")


def read_back(packed: DataFrame, turns: DataFrame, vocab_path: str) -> DataFrame:
    """Per conversation, from its nodes' tokens alone: n_turns, formatted_chars, and length and SHA-256 of its turns and of
    what the loss mask covers. Turns must stand at the positions that their ancestors leave."""

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        vocab, last, own = vocabulary(vocab_path), None, None
        for conv_id, _, ids, a, b, position in rows:
            if last != (conv_id,):
                if last:
                    yield finish(last[0], own)
                last, own = (conv_id,), [0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if position != own[5]:
                raise ValueError(f"conversation {conv_id}: a turn stands at position {position}, its ancestors end at {own[5]}")
            formatted, covered = vocab.decode(ids), unescape(vocab.decode(ids[a:b]))
            role, text = parse(formatted)
            own[0], own[1], own[3], own[5] = own[0] + 1, own[1] + len(formatted), own[3] + len(covered), own[5] + len(ids)
            own[2].update(f"{role}\n{text}\n".encode())
            own[4].update(covered.encode())
        if last:
            yield finish(last[0], own)

    def finish(conv_id: int | None, own: list) -> tuple:
        return conv_id, own[0], own[2].hexdigest(), own[3], own[4].hexdigest(), own[1]

    rows = turns.join(packed.select("node", "token_ids", "loss_from", "loss_to", "position"), "node").select("conv_id", "place", "token_ids", "loss_from", "loss_to", "position")
    kinds = [("conv_id", pa.int64(), "long"), ("n_turns", pa.int64(), "long"), ("turns_sha256", pa.string(), "string"), ("loss_chars", pa.int64(), "long"), ("loss_sha256", pa.string(), "string"), ("formatted_chars", pa.int64(), "long")]
    return _streamed(rows, ["place"], digest, kinds)
