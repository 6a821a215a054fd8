import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if good(k, m[0]))


def test_base_spans_and_sanitised_texts(spark, sf):
    random.seed(3)
    bits = ["a@b.c", "x", "@", ".", "1", "22", "333", " ", "-", "+", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256", "+1 (555) 123-4567", "é", "😀", "b.org", "_", "%", "\n"]
    texts = ["".join(random.choices(bits, k=random.randrange(40))) for _ in range(1500)] + [None, "", "a@b.com_x@y.org"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = pii.find(df)
    rows = pii.sanitise(found).select("i", "text", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.b == brute(texts[r.i]) and r.s.startswith(r.b)
        assert (r.text == texts[r.i]) == (r.s == "") or texts[r.i] is None
        assert not any(m[0] in (r.text or "") and len(m[0]) > 12 for k, p in PATTERNS.items() if k == "email" for m in re.finditer(p, texts[r.i] or ""))


def test_revealing_terms(spark):
    common = [(100 + i, f"the weather was fine on day number {w} and people were out in the sun") for i, w in enumerate("one two three four five six seven eight nine ten".split() * 6)]
    told = [(i, f"{w} the agent Zorblax wrote from z.q@secret.org about the weather on that day") for i, w in enumerate("alpha beta gamma delta".split())]
    clean = [(50, "the weather and the sun, nothing else was there on that day, though Zorblax was")]
    df = spark.createDataFrame(common + told + clean, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(pii.find(df)).collect()}
    assert all("Zorblax" not in rows[i].text and "@" not in rows[i].text and "weather" in rows[i].text for i in range(4))
    assert all(rows[i].text == t for i, t in common + clean)


def test_long_runs_take_linear_time(spark):
    texts = ["a." * 50_000 + "@x.y", "a@" + "b." * 50_000 + "c", "1 " * 50_000 + "1", "1" * 100_000, "+1" + " " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.b for r in pii.with_base_spans(df).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()}
    assert got == {0: "email:0:100004", 1: "email:0:100003", 2: "", 3: "", 4: ""}


def test_odd_rows(odd, empty):
    rows = pii.sanitise(pii.find(odd)).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.text for r in rows}[7].endswith("[EMAIL] [IP]")
    assert pii.sanitise(pii.find(empty)).count() == 0


def hypergeometric(n, df, ne, total):
    return sum(math.comb(df, k) * math.comb(total - df, ne - k) for k in range(n, min(df, ne) + 1)) / math.comb(total, ne)


def brute_disclosures(texts, d):
    docs, values = [], {}
    for t in set(texts):
        base, bare = set(), t
        for k, p in PATTERNS.items():
            for m in re.finditer(p, t):
                if good(k, m[0]):
                    digits = re.sub("[^0-9]", "", m[0])
                    value = f"{k}:{digits if k in ('card', 'phone') else m[0].lower()}"
                    shared = {"email": f"email*{m[0].split('@')[-1].lower()}", "ip": f"ip*{m[0].rsplit('.', 1)[0]}", "card": f"card*{digits[:6]}", "phone": f"phone*{digits[:4]}"}[k]
                    base |= {value, shared}
                    values.setdefault(shared, set()).add(value)
                    bare = bare.replace(m[0], " " * len(m[0]))
        docs.append((base, {w for w in re.split("[^a-z]+", bare.lower()) if len(w) >= 3}))
    docs = [({e for e in b if len(values.get(e, "ab")) > 1}, ts) for b, ts in docs]
    total = len(docs)
    ne = {e: sum(e in b for b, _ in docs) for b, _ in docs for e in b}
    pairs = {(e, t) for b, ts in docs for e in b for t in ts}
    for least in range(1, total // 2 + 1):
        tested = [(e, t) for e, t in pairs if ne[e] >= least]
        if len(tested) <= d.chance * math.comb(total, least):
            break
    out = {}
    tested = set(tested)
    for e, t in pairs:
        n, df = sum(e in b and t in ts for b, ts in docs), sum(t in ts for _, ts in docs)
        if (e, t) not in tested or hypergeometric(n, df, ne[e], total) * len(tested) > d.chance:
            continue
        z, p = d.deviations, n / df
        s = (p + z * z / (2 * df) - z * math.sqrt(p * (1 - p) / df + z * z / (4 * df * df))) / (1 + z * z / df)
        if s >= d.generalise:
            out[e, t] = round(s, 9)
    return out


def test_disclosures_against_brute_force(spark):
    """Names far from their spans, entities of one to six texts, common and rare words, copies."""
    random.seed(5)
    word = lambda n: "".join(random.choices("abcdefghijklmnop", k=n))
    usual = [word(6) for _ in range(60)]
    texts = []
    for e in range(12):
        name = f"name{word(5)}"
        for _ in range(e // 2 + 1):
            body = random.choices(usual, k=40)
            texts.append(f"{name.title()} {' '.join(body)} {word(7)} u{e}@mail.org {random.choice(usual)}")
        texts += [f"{name} {' '.join(random.choices(usual, k=10))}"] * (e % 3)
    texts += [" ".join(random.choices(usual, k=20)) for _ in range(150)]
    texts += texts[:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = pii.disclosures(pii.with_base_spans(df), pii.Disclosure()).collect()
    want = brute_disclosures(texts, pii.Disclosure())
    assert {(r.entity, r.term): round(r.disclosure, 9) for r in got} == want
    by_value = {e for e, _ in want if ":" in e}
    assert len(by_value) >= 6 and min(sum(f"{e[6:]} " in t for t in set(texts)) for e in by_value) == 2


def test_a_name_far_from_its_span_goes(spark):
    usual = "the weather was fine on that day and people were out in the sun " * 5
    told = [(i, f"Zorblax, {usual} {w} wrote z.q@secret.org") for i, w in enumerate("alpha beta gamma delta epsilon".split())]
    common = [(100 + i, f"{usual} on day number {w} {x}") for i, (w, x) in enumerate((w, x) for w in "one two three four five six".split() for x in "abcdefgh")]
    rows = {r.doc_id: r.text for r in pii.sanitise(pii.find(spark.createDataFrame(told + common, "doc_id int, text string"))).collect()}
    assert all("Zorblax" not in rows[i] and "weather" in rows[i] for i, _ in told) and all(rows[i] == t for i, t in common)


def _corpus(more, seed=2):
    """Names that go with the addresses of one domain; a word once beside an address; and as many unrelated texts as asked for,
    30 of which hold an address of their own."""
    draw = random.Random(seed)
    usual = ["".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(80)]
    some = lambda n: " ".join(draw.choices(usual, k=n))
    rare = lambda: "".join(draw.choices("qrstuvwxyz", k=9))
    names = ["Krellington", "Osterby", "Quamsworth", "Jellicote"]
    told = [(i, f"{some(12)} {names[i % 4]} {some(12)} u{i}@corp{i % 4}.org {some(5)}") for i in range(48)]
    one = [(90, f"{some(20)} q.x@other.net Vosstrand {some(9)}")]
    rest = [(100 + i, f"{some(14)} {rare()} {some(14)}" + (f" {rare()}@x{i}y.net" if i < 30 else "")) for i in range(more)]
    return names, told, one, rest


@pytest.mark.parametrize("more", [1000, 10_000])
def test_disclosure_needs_evidence_whatever_the_corpus(spark, more):
    """Planted names are all found, words that stand once beside an address never, and the verdicts on a fixed set of pairs are the
    same in a corpus ten times as large."""
    names, told, one, rest = _corpus(more)
    df = spark.createDataFrame(told + one + rest, "doc_id int, text string")
    found = {(r.entity, r.term): r.disclosure for r in pii.disclosures(df, pii.Disclosure()).collect()}
    assert set(found) == {(f"email*corp{k}.org", n.lower()) for k, n in enumerate(names)}
    z = pii.Disclosure().deviations
    assert all(abs(x - 12 / (12 + z * z)) < 1e-9 for x in found.values())  # 12 of 12 documents
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    assert all([x.kind for x in rows[i].spans] == ["email", "removed"] for i, _ in told)
    assert all(len(rows[i].spans) == len(rows[i].base) for i, _ in one + rest)
    clean = {r.doc_id: r.text for r in pii.sanitise(pii.find(df)).filter("doc_id <= 90").collect()}
    assert not any(n in clean[i] for i, _ in told for n in names) and "Vosstrand" in clean[90]


def test_evidence_grows_with_documents(spark):
    """Beside the entity alone: one document is no evidence, two generalise, eleven remove."""
    draw = random.Random(3)
    some = lambda n: " ".join("".join(draw.choices("abcdefgh", k=3)) for _ in range(n))
    told = [(f"n{n}", f"{some(9)} Tolliver{'abcdefghijklm'[n]} {some(9)} v{n}x{i}@firm{n}.org") for n in (1, 2, 3, 7, 11, 12) for i in range(n)]
    df = spark.createDataFrame(told + [("", some(20)) for _ in range(1500)], "doc_id string, text string")
    kinds = {}
    for r in pii.find(df).filter("size(base) > 0").collect():
        kinds.setdefault(r.doc_id, set()).update(x.kind for x in r.spans if x.value.startswith("Tolliver"))
    assert kinds == {"n1": set(), "n2": {"name"}, "n3": {"name"}, "n7": {"name"}, "n11": {"removed"}, "n12": {"removed"}}


def test_columns_named_like_its_own_pass_through(spark):
    names = ["_email", "_ip", "_card", "_phone", "_doc", "_added", "_cuts", "base_", "values", "terms"]
    df = spark.createDataFrame([(1, "write a@b.org", *names)], "doc_id int, text string, " + ", ".join(f"`{c}` string" for c in names))
    row = pii.sanitise(pii.find(df)).first()
    assert row.text == "write [EMAIL]" and [row[c] for c in names] == names


def test_many_spans(spark):
    import time

    text = " ".join(f"u{i}@m.org or 10.0.{i % 200}.{i % 250} said" for i in range(8000))
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id int, text string")
    start = time.perf_counter()
    row = pii.sanitise(pii.find(df)).filter("doc_id = 1").select(F.size("base").alias("n"), "text").first()
    assert row.n == 16_000 and row.text == " ".join(["[EMAIL] or [IP] said"] * 8000) and time.perf_counter() - start < 60
