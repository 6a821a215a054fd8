import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from tidewatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(text):
    out = array("i")
    bpe.vocabulary(PATH).encode(text, out)
    return out.tolist()


def test_same_ids_as_the_library():
    random.seed(1)
    some = lambda: random.choice([random.randrange(0x20, 0x250), random.randrange(0x110000), 32, 10, 0x3000])
    texts = ["".join(chr(c) for c in (some() for _ in range(60)) if not 0xD800 <= c < 0xE000) for _ in range(500)]
    texts += ["a<|endoftext|>b <|endoftext|>", "x" * 3000, " \n\t  x  ", "", "don't we'll 12 345"]
    theirs = Tokenizer.from_file(PATH)
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert encoded(text) == e.ids
        assert bpe.vocabulary(PATH).decode(e.ids) == theirs.decode(e.ids, skip_special_tokens=False) == text


def test_short_and_long_words_merge_alike():
    v = bpe.vocabulary(PATH)
    for w in ("x" * 50, "thhaheonst", "é" * 20, "abcabcabcabc"):
        assert bpe.merge_short([v.byte_ids[b] for b in w.encode()], v) == bpe.merge_long([v.byte_ids[b] for b in w.encode()], v)


def test_odd_rows(odd, empty):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") for r in rows)
    assert rows[2].token_ids == [] and rows[0].key == "k"
    both = bpe.encode(odd, PATH, decoded_col="decoded").collect()
    assert [(r.token_ids, r.decoded) for r in both] == [(r.token_ids, r.decoded) for r in rows]
    assert bpe.encode(empty, PATH).count() == 0
