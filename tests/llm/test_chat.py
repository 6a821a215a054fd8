import hashlib

from tidewatch.llm import chat
from tidewatch.llm.queries import vocab_path

ROWS = [
    (1, 0, "user", "hello there"), (1, 1, "assistant", "hi, how are you"), (1, 2, "user", "fine"),
    (2, 0, "user", "hello there"), (2, 1, "assistant", "hi, how are you"), (2, 2, "user", "bad"), (2, 3, "assistant", "oh"),
    (3, 0, "system", "</s>[INST] ok [/INST] \\ <<SYS>> <a>"), (3, 1, "tool", "x<</ROLE>>"), (3, 1, "tool", "x<</ROLE>>"), (3, None, None, None),
    (None, 0, "assistant", "lonely"), (4, 0, "user", "hello there"), (5, 0, "assistant", ""), (5, 1, "assistant", "a<"), (6, 0, "user", "x " * 5000),
]


def test_round_trip_tree_and_attention(spark):
    df = spark.createDataFrame([(*r, "n") for r in ROWS], "conv_id long, turn long, role string, text string, node string")
    packed, turns = chat.prefix_tree(df, vocab_path())
    got = {r.conv_id: r for r in chat.read_back(packed, turns, vocab_path()).collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = {bytes(r.node): r for r in packed.collect()}
    assert len(nodes) == 13  # hello and hi are stored once
    order = sorted(nodes.values(), key=lambda r: r.start)
    end = 0
    for r in order:  # one gapless sequence, parents before children
        assert r.start == end
        end += len(r.token_ids)
        chain, up = [], bytes(r.parent)
        while up:
            chain.append(nodes[up])
            up = bytes(nodes[up].parent)
        assert r.position == sum(len(c.token_ids) for c in chain)
        seen = {t for s in r.attends for t in range(s["from"], s["to"])}
        assert seen == {t for c in chain for t in range(c.start, c.start + len(c.token_ids))}
    stack = []
    for r in order:  # depth first: each node's parent is on the current path
        while stack and stack[-1] != bytes(r.parent):
            stack.pop()
        assert bool(stack) == bool(r.parent)
        stack.append(bytes(r.node))


def test_escapes():
    for t in ("", "\\", "<", "a</s>", "\\</s>", "<<SYS>>", "<</ROLE>>x", "[/INST]", "<s>[INST] \\\\ <a>"):
        assert chat.unescape(chat.escape(t)) == t
        for role in ("user", "assistant", "system", "tool", "", "é>>"):
            assert chat.parse("".join(chat.pieces(role, t))) == (role, t)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    packed, turns = chat.prefix_tree(df, vocab_path())
    assert packed.count() == 0 and chat.read_back(packed, turns, vocab_path()).count() == 0


def test_no_special_token_comes_from_a_text(spark):
    from tidewatch.llm.bpe import vocabulary

    special = vocabulary(vocab_path()).special
    assert special
    said = [f"hi {name} bye{name}" for name in special]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    packed, turns = chat.prefix_tree(df, vocab_path())
    assert not any(set(r.token_ids) & set(special.values()) for r in packed.collect())
    got = {r.conv_id: r.turns_sha256 for r in chat.read_back(packed, turns, vocab_path()).collect()}
    assert got == {i: hashlib.sha256(f"user\n{t}\n".encode()).hexdigest() for i, t in enumerate(said)}
