from tidewatch.llm import decontam

Q = "Last week the farmer Alice Miller sold 12 apples to her friend Bob and then Alice bought 3 kg of pears. How many apples did Bob get?"
ITEMS = [(1, Q), (2, "short one"), (3, None), (None, Q), (4, "")]


def test_copies_and_reparameterised_questions(spark):
    docs = spark.createDataFrame(
        [
            (10, "Some intro words here. Last week the farmer Carol Smith sold 55 apples to her friend Dan and then Carol bought 9 kg of pears. How many apples did Dan get? And more"),
            (11, Q),
            (11, Q),
            (12, "Last week the farmer Carol Smith sold 55 apples to her friend Dan and then Zed bought 9 kg of pears. How many apples did Quo get?"),
            (13, "nothing of the kind"),
            (14, None),
            (None, Q),
            (15, Q.upper()),
            (16, Q.lower()),
            (17, "Last week the farmer sold apples to a friend"),
        ],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: (r.item_id, r.kind) for r in decontam.find(docs, items).collect()}
    assert found == {10: (1, "reparameterised"), 11: (1, "copy"), None: (1, "copy"), 15: (1, "copy"), 16: (1, "copy")}
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [12, 13, 14, 17]


def windows(text):
    w = [x for x in ("".join(c for c in t if c.isalpha()) for t in text.lower().split()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_against_word_windows(spark, sf):
    """The given items hold neither numbers nor names in a row, so plain word windows tell the same."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()}
    texts = [(r.doc_id, set(windows(r.text))) for r in docs.collect()]
    want = set()
    for r in items.collect():
        own = windows(r.text)
        for d, there in texts:
            covered = {i + k for i, x in enumerate(own) if x in there for k in range(5)}
            if len(covered) >= 0.9 * (len(own) + 4):
                want.add((d, r.item_id))
    assert want and want <= got and len(got - want) <= 1


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find(odd, items).count() == 0
    assert decontam.clean(odd, items).count() == odd.count() and decontam.clean(odd, items).columns == odd.columns
    assert decontam.find(empty, items).count() == 0 and decontam.find(odd, items.limit(0)).count() == 0


def test_names_that_open_sentences_and_number_words(spark):
    items = [(1, "Tom has 3 apples. Ann has 4 apples. Bob has 5 pears. How many pieces of fruit do they have"), (2, "Tom buys 3 pens. Mary buys 2 pens. How many pens do they have in total"), (3, "the baker sold three loaves and then baked twenty-five more before the shop closed at noon")]
    docs = [
        (10, "Intro. Eve has 7 apples. Dan has 6 apples. Kim has 9 pears. How many pieces of fruit do they have"),
        (11, "\"Eve buys 7 pens.\nKim buys 4 pens. How many pens do they have in total\""),
        (12, "the baker sold nine loaves and then baked 40 more before the shop closed at noon"),
        (13, items[0][1]),
        (14, "How many pens do they have in total? Eve has none."),
    ]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontam.find(docs, items).collect()}
    assert got == {(10, 1, "reparameterised"), (11, 2, "reparameterised"), (12, 3, "reparameterised"), (13, 1, "copy")}


PEOPLE = "Alice Bob Carol Dan Eve Frank Grace Henry Iris Jack Kim Liam Mona Nils Olga Paul".split()


def question(rnd, words, values):
    """A made question whose slots 0..n are used again and again."""
    said = []
    for slot in [*range(len(values)), *rnd.choices(range(len(values)), k=3)]:
        said += [*rnd.choices(words, k=3), str(values[slot])]
    return " ".join([*said, *rnd.choices(words, k=4)])


def test_generated_slots_copies_and_variants(spark):
    """Items with repeated names and numbers; documents with a copy, variants, copy and variant, two variants, or values that
    don't agree."""
    import random

    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    docs, items, want = [], [], set()
    for i in range(60):
        seed = rnd.random()
        of = lambda values: question(random.Random(seed), words, values)  # noqa: E731,B023
        values = lambda: [*rnd.sample(PEOPLE, 2), *rnd.sample(range(2, 99), 2)]
        first = values()
        items.append((i, of(first)))
        filler = lambda: " ".join(rnd.choices(words, k=30))
        a, b = of(values()), of(values())
        for j, (body, kind) in enumerate(((of(first), "copy"), (a, "reparameterised"), (f"{of(first)}\n{filler()} {b}", "copy"), (f"{a}. {filler()} {b}", "reparameterised"), (f"{a} {a}", "reparameterised"))):
            docs.append((i * 10 + j, f"{filler()} {body} {filler()}"))
            want.add((i * 10 + j, i, kind))
        # each place has another value: no slot agrees
        rest = iter([*rnd.sample(PEOPLE, 16), *range(100, 140)])
        odd = " ".join(next(rest) if w in PEOPLE else str(rnd.randrange(1000, 9999)) if w.isdigit() else w for w in of(first).split())
        docs.append((i * 10 + 9, f"{filler()} {odd}"))
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.kind) for r in got.collect()}
    assert len(want & got) >= 0.98 * len(want) and not any(d % 10 == 9 for d, _, _ in got), (len(want), want - got, got - want)
    assert {(d, i) for d, i, _ in got} <= {(d, i) for d, i, _ in want}


def test_short_items_formulas_and_scripts_without_spaces(spark):
    items = [(1, "12 * 7 + 5 = ?"), (2, "Capital of Peru?"), (3, "Yes"), (4, "二つの三角形の面積を求めなさい"), (5, "?!"), (6, "the sum of two odd numbers is even in every case")]
    docs = [
        (10, "So 12 * 7 + 5 = 89."), (11, "So 12 * 7 - 5 = 79."), (12, "The capital of Peru is Lima"), (13, "yes, it is"), (14, "Yes."), (15, "問題:二つの三角形の面積を求めなさい。"),
        (16, "二つの円"), (17, "?!"), (18, "We know: the sum of two odd numbers is even in every case!"), (19, None),
    ]
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10, 1), (12, 2), (14, 3), (15, 4), (18, 6)}


def test_items_that_share_phrasing(spark):
    """Documents that hold only what all items share meet none of them in full; the whole of one is found."""
    import random

    rnd = random.Random(3)
    own = lambda: " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(12))
    shared = "please read the following text with care and then answer the question about the market in the north"
    items = [(i, f"{shared} {own()}") for i in range(8)]
    docs = [(10, items[2][1]), (11, f"{shared} {own()}"), (12, f"{own()} {items[5][1]} {own()}"), (13, " ".join(items[4][1].split()[8:]))]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    windows = decontam.item_windows(items, decontam.Decontamination(), "item_id", "text").cache()
    rare = decontam._anchors(windows, decontam.Decontamination())
    assert rare.groupBy("window").count().filter("count > 2").isEmpty() and 0 < rare.count() < windows.count()
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()} == {(10, 2), (12, 5)}
