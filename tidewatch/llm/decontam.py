"""Benchmark decontamination by template canonicalisation.

Names, numbers and units become typed placeholders, each a token of its own; everything else is lower-cased and stripped
of punctuation, and characters of scripts without spaces are tokens of their own. Windows of five template tokens are hashed
and hash-joined between documents and benchmark items. What matches along about one alignment is an occurrence: a document
holds an item if the windows of some occurrence cover at least ``coverage`` of the item's coverable tokens and the slots agree
in it: wherever the item repeats a value, the occurrence repeats whatever it put in that value's place. So a copied question
is found, and one with other numbers and names as well, and several in one document don't spoil each other.

A capitalised word where a text, line, sentence or quotation may open is a name or not. Items are windowed both ways, each
with its own coverage; documents have further windows where such words are names. Both ways have the same token places.

Windows that many items share are not joined at first. What covers enough of an item must match some window of any run of
its windows that is long enough; documents meet each item's rarest such run, and only documents and items that met there are
compared in full. Items without a usable window (too short, or hardly an ordinary word) are found by their exact tokens,
numbers and signs included: of three tokens or more anywhere in a document, shorter ones as a whole document.

Only DataFrame functions. Document windows never meet in a shuffle while the benchmark's windows fit a checked broadcast;
beyond it both sides are joined by window hash. All later steps work on matched windows alone.

Null and empty texts, and items without any token, match nothing. Rows that repeat a document give one finding for the
document and item; an empty table gives no finding. Further columns are ignored, or kept by clean().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._common import free_name, materialise

#: Placeholders: private-use characters, so that no text's own tokens are taken for them.
NAME, NUMBER, UNIT = "", "", ""
#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km mg g kg t ml cl l lb lbs oz ft feet foot inch inches yard yards mile miles mph kmh degree degrees percent percentage second seconds minute minutes hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros pound pounds litre litres liter liters gallon gallons meter meters metre metres gram grams kilogram kilograms kilometers kilometres"
).split()
#: Around a capitalised word that may open a sentence; it stays a word of its token.
OPEN, SHUT = "\ue00a", "\ue00b"
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen"
).split()
_NUMBER_WORD = rf"(?=[zotfsenhmbdZOTFSENHMBD])(?<![a-zA-Z])(?<![\p{{L}}\p{{M}}\p{{N}}])(?i:{'|'.join(NUMBER_WORDS)})(?![\p{{L}}\p{{M}}\p{{N}}])"
#: A capitalised word in the middle of a sentence; any other one; a number with its separators, or in words; a unit behind
#: a number (group 1). Each begins with what rules out most places at a glance.
NAME_PATTERN = r"\p{Lu}(?<=[\p{Ll}\p{N},;:)] \p{Lu})[\p{L}\p{M}]*"
OPENING_PATTERN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}])(?!{_NUMBER_WORD})\p{{Lu}}[\p{{L}}\p{{M}}]*"
NUMBER_PATTERN = rf"[0-9]+(?:[.,:/][0-9]+)*+|{_NUMBER_WORD}(?:[ -]{_NUMBER_WORD})*+"
UNIT_PATTERN = rf"{NUMBER} ( ?(?i:%|(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])))"


@dataclass(frozen=True)
class Decontamination:
    window: int = 5
    coverage: float = 0.8
    consistency: float = 0.8
    literals: int = 2
    #: Tokens by which values of several words, or left out words, may shift an occurrence.
    slack: int = 8


#: Benchmark windows (some 50 bytes each) and found documents that are broadcast at most; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
BROADCAST_FOUND = 500_000


def _unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("")), F.lit(SHUT), F.lit(""))


def _named(text: Column) -> Column:
    return F.regexp_replace(text, NAME_PATTERN, f" {NAME} ")


def _numbered(text: Column, names: bool = True) -> Column:
    return F.regexp_replace(_named(text) if names else text, NUMBER_PATTERN, f" {NUMBER} ")


#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = "[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u2e80-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{3ffff}]"


def _spaced(text: Column) -> Column:
    """With spaces around characters of scripts without any; ASCII texts have none and aren't looked through."""
    return F.when(F.octet_length(text) > F.length(text), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)


def _bare(text: Column) -> Column:
    placed = F.regexp_replace(_spaced(text), UNIT_PATTERN, f"{NUMBER} {UNIT} ")
    return F.regexp_replace(F.lower(placed), rf"(?![a-z ])[^\p{{L}}\p{{M}}\s{NAME}{NUMBER}{UNIT}{OPEN}{SHUT}]++", "")


def _tokens(bare: Column) -> Column:
    return F.array_remove(F.split(bare, r"\s+"), "")


def template(text: Column, names: bool = True) -> Column:
    """The template tokens of a text; without names, these stay words."""
    return _tokens(_bare(_numbered(_unmarked(text), names)))


def opened_text(text: Column) -> Column:
    """The same tokens, spaced, with words that may open a sentence between OPEN and SHUT."""
    marked = F.regexp_replace(_named(_unmarked(text)), OPENING_PATTERN, f"{OPEN}$0{SHUT}")
    return _bare(F.regexp_replace(marked, NUMBER_PATTERN, f" {NUMBER} "))


def opened(text: Column) -> Column:
    return _tokens(opened_text(text))


def _as_names(opened: Column) -> Column:
    """Opening words as names."""
    return F.regexp_replace(opened, rf"{OPEN}\S*+", NAME)


def slot_values(text: Column) -> tuple[Column, Column, Column]:
    """The values of the name, number and unit placeholders, each kind in order."""
    numbered = _numbered(text)
    return F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0)), F.regexp_extract_all(_named(text), F.lit(NUMBER_PATTERN), F.lit(0)), F.regexp_extract_all(numbered, F.lit(UNIT_PATTERN), F.lit(1))


def _windows(df: DataFrame, d: Decontamination) -> DataFrame:
    """Explodes column tokens into (window, pos); texts with too few tokens vanish."""
    places = F.sequence(F.lit(1), F.size("tokens") - (d.window - 1))
    hashed = F.transform(places, lambda i: F.xxhash64(*(F.get("tokens", i + (k - 1)) for k in range(d.window))))
    return df.filter(F.size("tokens") >= d.window).select("*", F.posexplode(hashed).alias("pos", "window")).drop("tokens")


def _both_windows(df: DataFrame, d: Decontamination) -> DataFrame:
    """(..., pos, window) of column opened: every window with opening words as words, those that hold one with it as a name
    too. Tokens are laid beside their successors, so that no expression runs for each place but in generated code."""
    words, names = _tokens(_unmarked(F.col("opened"))), _tokens(_as_names(F.col("opened")))
    keys = [c for c in df.columns if c != "opened"]
    # a generator, so that the tokens are made once
    df = df.select(*keys, F.inline(F.array(F.struct(words.alias("words"), names.alias("names")))))
    most = F.size("words")
    beside = F.arrays_zip(*(F.slice(c, F.lit(k + 1), most).alias(f"{c}{k}") for c in ("words", "names") for k in range(d.window)))
    rows = df.filter(most >= d.window).select(*keys, F.posexplode(beside).alias("pos", "x"))
    hashed = lambda kind: F.xxhash64(*(F.col(f"x.{kind}{k}") for k in range(d.window)))
    rows = rows.filter(F.col(f"x.words{d.window - 1}").isNotNull()).select(*keys, "pos", hashed("words").alias("w"), hashed("names").alias("n"))
    # hashes are equal where no opening word stands
    pair = F.when(F.col("w") == F.col("n"), F.array("w")).otherwise(F.array("w", "n"))
    return rows.select(*keys, "pos", F.explode(pair).alias("window"))


def item_windows(items: DataFrame, d: Decontamination, id_col: str, text_col: str) -> DataFrame:
    """(item, way, window, ipos, coverable): windows with enough ordinary tokens, and how many tokens such windows cover. Items
    have them with and without names placed, so that a copy in small or large letters, where no name stands out, is found
    (way 1), and with opening words as names (way 2)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.inline(F.array(*(F.struct(F.lit(w).alias("way"), t.alias("tokens")) for w, t in ((1, template(text)), (1, template(text, False)), (2, _tokens(_as_names(opened_text(text)))))))))
    plain = F.transform("tokens", lambda t: F.when(t.isin(NAME, NUMBER, UNIT), 0).otherwise(1))
    tokens = tokens.withColumn("plain", plain)
    found = _windows(tokens, d)
    found = found.filter(F.aggregate(F.slice("plain", F.col("pos") + 1, F.lit(d.window)), F.lit(0), lambda a, x: a + x) >= d.literals)
    found = found.select("item", "way", "window", F.col("pos").alias("ipos")).distinct()
    size = found.groupBy("item", "way").agg(_covered(F.collect_set("ipos"), d).alias("coverable"))
    return found.join(size, ["item", "way"])


def _covered(places: Column, d: Decontamination) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (d.window - 1))))))


def _key(id_col: str, text_col: str) -> Column:
    """Tells documents apart even where ids are missing or repeated."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\x00"), F.col(text_col))


def _slots(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, value, opening) of every placeholder and, as names, of opening words; df has key and text."""
    values = slot_values(F.col("text"))
    df = df.withColumn("values", F.map_from_arrays(F.array(F.lit(NAME), F.lit(NUMBER), F.lit(UNIT)), F.array(*values)))
    df = df.withColumn("tokens", template(F.col("text")))
    placed = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("kind"), i.alias("pos"))), lambda x: x["kind"].isin(NAME, NUMBER, UNIT))
    df = df.withColumn("placed", placed)

    def slots(kind: str) -> Column:
        own = F.filter("placed", lambda x: x["kind"] == kind)
        value = lambda i: F.lower(F.trim(F.get(F.element_at("values", F.lit(kind)), i)))
        return F.transform(own, lambda x, i: F.struct(x["pos"].alias("pos"), x["kind"].alias("kind"), value(i).alias("value")))

    first = F.filter(F.transform(opened(F.col("text")), lambda t, i: F.struct(i.alias("pos"), F.lit(NAME).alias("kind"), F.regexp_extract(t, f"{OPEN}([^{SHUT}]*)", 1).alias("value"))), lambda x: x["value"] != "")
    both = df.select(key, F.explode(F.concat(*map(slots, (NAME, NUMBER, UNIT)))).alias("s"), F.lit(False).alias("opening"))
    both = both.unionByName(df.select(key, F.explode(first).alias("s"), F.lit(True).alias("opening")))
    return both.select(key, "s.pos", "s.kind", "s.value", "opening")


def _anchors(windows: DataFrame, d: Decontamination) -> DataFrame:
    """(window, item, way): of each item's runs of places that any match must touch, the one whose windows fewest items share.
    A run of q places leaves q - 4 tokens or more uncovered if none of its windows matches."""
    keys = ["item", "way"]
    common = windows.groupBy("window").agg(F.count("*").alias("shared"))
    rows = windows.join(common, "window").withColumn("rank", F.dense_rank().over(W.partitionBy(*keys).orderBy("ipos")).cast("long"))
    q = F.floor(F.col("coverable") * (1 - d.coverage)).cast("long") + d.window
    places = rows.groupBy(*keys, "rank").agg(F.sum("shared").alias("shared"), F.first(q).alias("q"))
    running = W.partitionBy(*keys).orderBy("rank")
    places = materialise(places.withColumn("upto", F.sum("shared").over(running)), "item-places")
    ends = places.select(*keys, (F.col("rank") - F.col("q") + 1).alias("rank"), F.col("upto").alias("end"))
    runs = places.join(ends, [*keys, "rank"]).withColumn("cost", F.col("end") - F.col("upto") + F.col("shared"))
    best = runs.groupBy(*keys).agg(F.min_by("rank", F.struct("cost", "rank")).alias("from"))
    kept = rows.join(best, keys, "left").filter(F.col("from").isNull() | F.col("rank").between(F.col("from"), F.col("from") + q - 1))
    return kept.select("window", *keys).distinct()


def _sized(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _literal(text: Column) -> Column:
    """The exact tokens of a text: lower case, with numbers and the signs of formulas."""
    bare = F.regexp_replace(_spaced(F.lower(text)), r"[^\p{L}\p{M}\p{N}\s+*/=<>^%-]++", "")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def _exact(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_key, item): documents that hold the exact tokens of an item. rows: doc_key, text; items: item, text."""
    said = lambda df: df.withColumn("said", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))
    three = lambda: F.transform(F.sequence(F.lit(0), F.size("tokens") - 3), lambda i: F.xxhash64(*(F.get("tokens", i + k) for k in range(3))))
    items = said(items.select("item", _literal(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0))
    items = materialise(items.withColumn("whole", F.size("tokens") < 3), "exact-items")
    docs = rows.select("doc_key", _literal(F.col("text")).alias("tokens"))
    short = items.filter("whole").select("item", "said")
    as_whole = said(docs.filter(F.size("tokens").between(1, 2))).join(_sized(short, BROADCAST_WINDOWS), "said").select("doc_key", "item")
    own = items.filter("NOT whole").select("item", F.explode(three()).alias("window"))
    shared = own.groupBy("window").agg(F.count("*").alias("n"))
    anchor = own.join(shared, "window").groupBy("item").agg(F.min_by("window", F.struct("n", "window")).alias("window"))
    anchor = materialise(anchor, "exact-anchors")
    met = docs.filter(F.size("tokens") >= 3).select("doc_key", F.explode(three()).alias("window")).join(_sized(anchor, BROADCAST_WINDOWS), "window")
    met = materialise(met.select("doc_key", "item").distinct(), "exact-met")
    keys = _sized(met.select("doc_key").distinct(), BROADCAST_FOUND)
    texts = said(docs.join(keys, "doc_key", "left_semi").dropDuplicates(["doc_key"])).select("doc_key", F.col("said").alias("text"))
    inside = met.join(texts, "doc_key").join(items.select("item", "said"), "item").filter(F.contains("text", "said"))
    return as_whole.unionByName(inside.select("doc_key", "item")).distinct()


def _occurrences(hits: DataFrame, d: Decontamination) -> DataFrame:
    """(doc_key, item, way, anchor, dpos, ipos, start, coverage): the hits of each occurrence that covers enough. An
    occurrence is anchored where hits start, and takes in what starts within the slack."""
    pair = ["doc_key", "item", "way"]
    enough = lambda df, keys: df.groupBy(*keys).agg((_covered(F.collect_set("ipos"), d) / F.first("coverable")).alias("coverage")).filter(F.col("coverage") >= d.coverage)
    whole = enough(hits, pair)  # no occurrence covers more than all together
    hits = materialise(hits.join(whole.select(*pair), pair, "left_semi").withColumn("start", F.col("dpos") - F.col("ipos")), "window-near")
    anchors = hits.select(*pair, F.col("start").alias("anchor")).distinct()
    steps = F.sequence(F.lit(-d.slack), F.lit(d.slack))
    near = hits.select("*", F.explode(F.transform(steps, lambda x: F.col("start") + x)).alias("anchor")).join(anchors, [*pair, "anchor"])
    return near.join(enough(near, [*pair, "anchor"]), [*pair, "anchor"])


def find(
    docs: DataFrame, items: DataFrame, d: Decontamination = Decontamination(), doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_key, doc_id, item_id, coverage, n_slots, consistency, kind): one row for each document and item that it holds;
    kind is copy or reparameterised, of the best occurrence: copies first. doc_key is of documents with this id and text."""
    windows = materialise(item_windows(items, d, item_id, item_text), "item-windows")
    rows = docs.select(_key(doc_id, doc_text).alias("doc_key"), F.col(doc_id).alias("doc"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"))
    texts = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    tokens = lambda df: df.select("doc_key", opened_text(F.col("text")).alias("opened"))
    rare = materialise(_anchors(windows, d), "item-anchors")
    met = _both_windows(tokens(rows), d).join(_sized(rare, BROADCAST_WINDOWS), "window").select("doc_key", "item", "way").distinct()
    met = materialise(met, "window-met")
    of = lambda found: rows.join(_sized(found.select("doc_key").distinct(), BROADCAST_FOUND), "doc_key", "left_semi").dropDuplicates(["doc_key"])
    held = materialise(of(met), "met-documents")  # few: whatever follows reads these alone
    hits = _both_windows(tokens(held), d).withColumnRenamed("pos", "dpos").join(_sized(windows, BROADCAST_WINDOWS), "window")
    hits = materialise(hits.select("doc_key", "item", "way", "dpos", "ipos", "coverable").join(met, ["doc_key", "item", "way"]), "window-hits")
    pair = ["doc_key", "item", "way"]
    near = materialise(_occurrences(hits, d), "window-occurrences")
    doc_slots = _slots(held.join(near.select("doc_key").distinct(), "doc_key", "left_semi"), "doc_key").select("doc_key", F.col("pos").alias("dpos"), "kind", F.col("value").alias("said"))
    item_slots = _slots(texts, "item")
    item_slots = item_slots.select("item", F.col("pos").alias("ipos"), "kind", "value", "opening", F.explode(F.when(F.col("opening"), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("way"))
    at = near.select(*pair, "anchor", "start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(d.window - 1)), lambda k: F.struct((F.col("dpos") + k).alias("dpos"), (F.col("ipos") + k).alias("ipos")))).alias("x"))
    # sentences built alike match each other: a place is read along the alignment that is nearest to the occurrence's
    at = at.groupBy(*pair, "anchor", F.col("x.ipos").alias("ipos")).agg(F.min_by("x.dpos", F.struct(F.abs(F.col("start") - F.col("anchor")), "start")).alias("dpos"))
    at = at.join(item_slots, ["item", "way", "ipos"]).join(doc_slots, ["doc_key", "dpos", "kind"])
    agreed = at.groupBy(*pair, "anchor", "kind", "value").agg(F.min("opening").alias("opening"), F.count_distinct("said").alias("n_said"), F.count_distinct("ipos").alias("n_slots"), F.max(F.col("said") != F.col("value")).alias("other"))
    # an opening word that stays the same is no slot that agrees
    agreed = agreed.filter(~F.col("opening") | F.col("other")).groupBy(*pair, "anchor").agg(F.sum("n_slots").alias("n_slots"), (F.count("*") / F.sum("n_said")).alias("consistency"), F.max("other").alias("other"))
    whole = near.groupBy(*pair, "anchor").agg(F.first("coverage").alias("coverage")).join(agreed, [*pair, "anchor"], "left")
    whole = whole.withColumns({"consistency": F.coalesce("consistency", F.lit(1.0)), "other": F.coalesce("other", F.lit(False)), "n_slots": F.coalesce("n_slots", F.lit(0).cast("long"))})
    whole = whole.filter(F.col("consistency") >= d.consistency)
    rank = F.struct("other", "way", -F.col("coverage"), -F.col("consistency"), F.col("anchor"))
    best = whole.groupBy("doc_key", "item").agg(F.min_by(F.struct("coverage", "n_slots", "consistency", "other"), rank).alias("b")).select("doc_key", "item", "b.*")
    wordless = texts.join(windows.select("item").distinct(), "item", "left_anti")
    if not wordless.isEmpty():
        found = _exact(rows, wordless).withColumns({"coverage": F.lit(1.0), "n_slots": F.lit(0).cast("long"), "consistency": F.lit(1.0), "other": F.lit(False)})
        best = materialise(best.unionByName(found), "window-exact")
        held = of(best)
    best = materialise(best.join(held.select("doc_key", "doc"), "doc_key"), "window-found")
    return best.select(
        "doc_key", F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.round("coverage", 6).alias("coverage"), "n_slots",
        F.round("consistency", 6).alias("consistency"), F.when(F.col("other"), "reparameterised").otherwise("copy").alias("kind"),
    )


def clean(docs: DataFrame, items: DataFrame, d: Decontamination = Decontamination(), doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = materialise(find(docs, items, d, doc_id, doc_text).select("doc_key").distinct(), "contaminated")
    key = free_name(docs, "found")
    found = _sized(found.select(F.col("doc_key").alias(key)), BROADCAST_FOUND)
    return docs.join(found, _key(doc_id, doc_text) == F.col(key), "left_anti")
