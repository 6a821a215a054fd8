"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers, leftmost and non-overlapping per
kind, matches that fail their test dropped. The protected entities are their values, and what values share: the domain of an
address, the network of an IP address, the first digits of a card or phone number. From the whole corpus comes how strongly a
term reveals an entity: PMI(t; e) = log(P(e | t) / P(e)), where P(e | t) = n / df(t) with n documents holding the term and the
entity and df(t) holding the term (equal texts counted once). The disclosure is what PMI leaves of P(e | t) by evidence: the
lower end of its Wilson interval, so the surety with which who sees the term can name the entity. It grows with n: a term that
occurs beside the entity alone has 0.27 after one document, 0.43 after two, 0.80 after eleven. In documents that hold an
entity, terms at or over ``generalise`` become a placeholder of their shape, those at or over ``remove`` vanish. Words of e-mail
addresses are no terms. As neither n nor df depends on other texts, texts that hold neither term nor entity change no disclosure.

An entity that most documents hold would be named by any term. So PMI must be no chance as well: the hypergeometric probability
of n or more common documents, times the pairs tested, is ``chance`` at most. At best a chance is 1 / C(N, n(e)), so entities of
too few documents are not tested (Tarone's rule); which these are follows from the data.

Only DataFrame functions. Whole texts are read; terms are counted in partial sums, and no text is shuffled but those of
documents that hold an entity and a revealing term.

Null and empty texts have no span. Rows that repeat a document, have no id or share one are each treated by their own
text; equal texts count once in the statistics. Ties at a threshold count as over it. Further columns pass through, those
named as a result are replaced. Spans are placed and merged by scans of blocks, which takes little more than linear time;
sanitise() cuts pieces out of the text, whose cost per document is spans times length, at the speed of copying.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import free_name, materialise

#: The contract's patterns, made possessive and kept from starting inside a run that can't match, so that long runs take
#: linear time. None changes which spans match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: What stands for a span in sanitised text.
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS} | {"name": "[NAME]", "term": "[TERM]", "removed": ""}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Disclosure:
    #: Probability that any term at all is taken for a disclosing one by chance.
    chance: float = 0.05
    #: Standard deviations between the share of a term's documents that hold the entity and the lower end of its interval.
    deviations: float = 1.645
    generalise: float = 0.4
    remove: float = 0.8


#: Entities, terms or places that are broadcast at most (some 100 bytes each); more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Elements of a block of a scan.
SCAN_BLOCK = 128


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """Struct (out: emitted values, state: the last one) of a running state over an array. Blocks are scanned one by one and
    put together at the end, as one array that grows by every element would be copied as often as there are elements."""
    empty, blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    grow = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out"))
    keep = lambda a, made: F.struct(made["state"].alias("state"), F.concat(a["out"], F.array(made["out"])).alias("out"))

    def whole(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / SCAN_BLOCK).cast("int"))
        block = lambda a, i: F.aggregate(F.slice(all_, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), F.struct(a["state"].alias("state"), empty.alias("out")), grow)
        add = lambda a, i: F.aggregate(F.array(block(a, i)), a, keep)
        return F.aggregate(numbers, F.struct(start.alias("state"), blocks.alias("out")), add, lambda a: F.struct(F.flatten(a["out"]).alias("out"), a["state"].alias("state")))

    return _once(items, whole)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made a single time however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cuts(text: Column, pattern: Column, found: Column) -> Column:
    """Start of each match in found, in code points: lengths of the pieces between matches and of the matches, summed."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.transform(found, lambda m: F.length(m)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return scan(steps, F.lit(0), lambda at, s: at + s["p"] + s["m"], lambda at, s: at + s["p"], "int")["out"]


def _spans(text: Column, pattern: Column, found: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the matches."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    made = F.zip_with(_cuts(text, pattern, found), found, lambda s, m: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
    return F.when(F.size(found) > 0, made).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: digits.substr(n - i, F.lit(1)).cast("int")
    weighed = lambda i: F.when(i % 2 == 1, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def with_base_spans(docs: DataFrame, text_col: str = "text", out_col: str = "base") -> DataFrame:
    """Adds array<struct<kind, start, end, value>>: by kind as listed, then by start; end is exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
    mark = {"email": "@", "ip": ".", "phone": "+"}
    held = {}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind in mark:
            found = F.when(F.contains(text, F.lit(mark[kind])), found).otherwise(F.array().cast("array<string>"))
        held[kind] = free_name(docs, kind)
        docs = docs.withColumn(held[kind], found)
    n = lambda v: F.length(_digits(v))
    good = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda x: n(x["value"]).between(13, 19) & luhn(_digits(x["value"])),
        "phone": lambda x: n(x["value"]).between(9, 15),
    }
    parts = [F.filter(_spans(text, F.lit(p), F.col(held[k]), k), good[k]) for k, p in patterns.items()]
    return docs.withColumn(out_col, F.concat(*parts)).drop(*held.values())


def _values(base: Column) -> Column:
    """Of each span (value, shared): its own entity, and that of the domain, network or first digits that it shares."""
    part = {"email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 3), "card": lambda v: F.left(v, F.lit(6)), "phone": lambda v: F.left(v, F.lit(4))}
    plain = lambda x: F.when(x["kind"].isin("card", "phone"), _digits(x["value"])).otherwise(F.lower(x["value"]))
    both = lambda k, v: F.struct(F.concat(k, F.lit(":"), v).alias("value"), F.concat(k, F.lit("*"), F.coalesce(*(F.when(k == n, of(v)) for n, of in part.items()))).alias("shared"))
    return F.array_distinct(F.transform(base, lambda x: _once(plain(x), lambda v: both(x["kind"], v))))


#: Letters in a row.
_WORD = r"\p{L}+"


def _bare(text: Column) -> Column:
    """The text without e-mail addresses; other spans hold no letters."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)


def _terms(text: Column) -> Column:
    """Words of three letters or more outside base spans, each once."""
    own = F.regexp_extract_all(F.lower(_bare(F.coalesce(text, F.lit("")))), F.lit(r"\p{L}{3,}+"), F.lit(0))
    return F.array_distinct(own)


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series from x + 8 on."""
    z, low = x + 8.0, x + 1.0
    for i in range(2, 8):
        low = low * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - F.log(low)


def _log_choose(a: Column, b: Column) -> Column:
    return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)


def _log_chance(n: Column, df: Column, ne: Column, total: Column) -> Column:
    """ln P(n or more common documents of df and ne in total); the tail is bounded by a geometric series, 0 below the mean."""
    next_ = (df - n) * (ne - n) / ((n + 1.0) * (total - df - ne + n + 1.0))
    first = _log_choose(df, n) + _log_choose(total - df, ne - n) - _log_choose(total, ne)
    return F.when(next_ < 1, first - F.log(1 - next_)).otherwise(0.0)


def wilson(n: Column, df: Column, z: float) -> Column:
    """Lower end of the Wilson interval of n out of df, z standard deviations down."""
    p = n / df
    spread = z * F.sqrt(p * (1 - p) / df + z * z / (4 * df * df))
    return (p + z * z / (2 * df) - spread) / (1 + z * z / df)


#: Levels of n(e) that are told apart for Tarone's rule; any level keeps the rule valid.
MOST_NEEDED = 64


def _testable(levels: DataFrame, size: str, total: int, d: Disclosure) -> tuple[int, int]:
    """Least n(e) that can reach significance, and the pairs tested then; levels has ne and a number of pairs."""
    by = levels.groupBy(F.least("ne", F.lit(float(MOST_NEEDED))).alias("ne")).agg(F.sum(size).alias("m")).collect()
    most = max(min(MOST_NEEDED, total // 2), 1)
    for k in range(1, most + 1):
        m = sum(int(r["m"]) for r in by if r["ne"] >= k)
        if m <= d.chance * math.comb(total, k):
            break
    return k, m


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, text, base, values, terms) of the texts that hold an entity, written once."""
    own = docs.select(F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"))
    # a generator, so that the filter doesn't make the spans a second time
    found = with_base_spans(own).withColumn("base", F.explode(F.array("base"))).filter(F.size("base") > 0)
    return materialise(found.select("doc", "text", "base", _values(F.col("base")).alias("values"), _terms(F.col("text")).alias("terms")), "marked-texts")


def _with_entity(marked: DataFrame, *columns: str) -> DataFrame:
    """A row for each entity of each text."""
    entities = F.array_distinct(F.concat(F.transform("values", lambda x: x["value"]), F.transform("values", lambda x: x["shared"])))
    return marked.select(*columns, F.explode(entities).alias("entity"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def disclosures(docs: DataFrame, d: Disclosure, text_col: str = "text", marked: DataFrame | None = None) -> DataFrame:
    """(entity, term, disclosure) at or over generalise. Equal texts count once: each of n copies weighs 1 / n, so that all
    sums are partial before a shuffle."""
    marked = _marked(docs, text_col) if marked is None else marked
    copies = docs.groupBy(F.xxhash64(text_col).alias("doc")).agg(F.count("*").alias("copies"))
    copies = materialise(copies, "text-copies")
    total = copies.count()
    copies = _sized(copies.filter("copies > 1"))
    weigh = lambda df: df.join(copies, "doc", "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))
    summed = F.round(F.sum("weight"))
    n = F.lit(float(max(total, 2)))
    strength = lambda df: wilson(F.col("n"), F.greatest(df, F.col("n")), d.deviations)
    weighed = weigh(marked)
    by_entity = _with_entity(weighed, "weight", "terms").withColumn("id", F.xxhash64("entity"))
    # what one value alone has is that value once more, and no further entity
    shared = marked.select(F.explode("values").alias("x")).groupBy("x.shared").agg((F.min("x.value") == F.max("x.value")).alias("single"))
    single = shared.filter("single").select(F.col("shared").alias("entity"))
    held = by_entity.groupBy("id").agg(F.first("entity").alias("entity"), summed.alias("ne")).join(single, "entity", "left_anti")
    held = materialise(held, "entities")
    # entities cross the network as hashes
    both = by_entity.select("id", "weight", F.explode("terms").alias("term")).groupBy("id", "term").agg(summed.alias("n"))
    both = materialise(both.join(_sized(held.select("id", "ne")), "id"), "term-pairs")
    least, tested = _testable(both.withColumn("pairs", F.lit(1)), "pairs", total, d)
    # a term's documents are at least those that hold it beside any entity: what falls short even so needs no counting
    seen = weighed.select("weight", F.explode("terms").alias("term")).groupBy("term").agg(summed.alias("seen"))
    both = both.join(seen, "term").filter((F.col("ne") >= least) & (strength(F.col("seen")) >= d.generalise))
    both = materialise(both.drop("seen"), "term-candidates")
    terms = weigh(docs.select(F.xxhash64(text_col).alias("doc"), _terms(F.col(text_col)).alias("terms"))).select("weight", F.explode("terms").alias("term"))
    found = both.join(terms.groupBy("term").agg(summed.alias("df")), "term")
    told = (F.col("ne") >= least) & (_log_chance(F.col("n"), F.col("df"), F.col("ne"), n) <= math.log(d.chance / max(tested, 1)))
    found = found.filter(told).withColumn("disclosure", strength(F.col("df")))
    return found.filter(F.col("disclosure") >= d.generalise).join(_sized(held.select("id", "entity")), "id").select("entity", "term", "disclosure")


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _term_spans(marked: DataFrame, told: DataFrame, d: Disclosure) -> DataFrame:
    """(doc, added): spans of disclosing terms of every text that holds any, by kind, then by start."""
    texts = marked.dropDuplicates(["doc"])
    strongest = _with_entity(texts, "doc").join(_sized(told), "entity").groupBy("doc", "term").agg(F.max("disclosure").alias("s"))
    strongest = materialise(strongest, "text-terms")
    texts = texts.join(_sized(strongest.select("doc").distinct()), "doc", "left_semi")
    # addresses are taken as a whole, so that no word is found in one; one that begins after a letter of another alphabet
    # is looked at by itself
    pattern = F.lit(f"{EMAIL}|{_WORD}")
    words = F.regexp_extract_all("text", pattern, F.lit(0))
    starts = F.arrays_zip(_cuts(F.col("text"), pattern, words).alias("start"), words.alias("value"))
    emails = F.filter("base", lambda b: b["kind"] == "email")
    in_email = lambda x: x["value"].rlike(r"[^\x00-\x7F]") & F.exists(emails, lambda b: (b["start"] < x["start"] + F.length(x["value"])) & (x["start"] < b["end"]))
    own = F.filter(starts, lambda x: (F.length(x["value"]) >= 3) & ~F.contains(x["value"], F.lit("@")) & ~in_email(x))
    places = texts.select("doc", F.inline(own)).withColumn("term", F.lower("value"))
    said = places.join(strongest, ["doc", "term"]).withColumn("end", F.col("start") + F.length("value"))
    kind = F.when(F.col("s") >= d.remove, "removed").when(F.col("value").rlike(r"^\p{Lu}"), "name").otherwise("term")
    by_doc = said.select("doc", F.struct(kind.alias("kind"), "start", "end", "value").alias("x"))
    return materialise(by_doc.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("added")), "term-spans")


def find(docs: DataFrame, d: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """Adds base and spans (base spans, then disclosing terms of kinds name, removed and term) to every row."""
    marked = _marked(docs, text_col)
    told = materialise(disclosures(docs.select(text_col), d, text_col, marked), "disclosures")
    added = _term_spans(marked, told, d)
    n_places = added.agg(F.coalesce(F.sum(F.size("added")), F.lit(0))).first()[0]
    key, more = free_name(docs, "doc"), free_name(docs, "added")
    added = added.select(F.col("doc").alias(key), F.col("added").alias(more))
    rows = with_base_spans(docs.drop("base", "spans"), text_col).withColumn(key, F.xxhash64(text_col))
    rows = rows.join(F.broadcast(added) if n_places <= BROADCAST_TERMS else added, key, "left")
    return rows.withColumn("spans", F.concat("base", F.coalesce(more, F.array().cast(f"array<{SPAN}>")))).drop(key, more)


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by one without its spans: overlapping ones are merged, the first one's placeholder stands for all."""
    text = F.col(text_col)
    order = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    own = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    kind = "struct<kind:string,start:int,end:int>"
    apart = lambda a, x: a["end"] <= x["start"]
    none = F.struct(F.lit("").alias("kind"), F.lit(-1).alias("start"), F.lit(0).alias("end"))
    # the span that is open; it is emitted by the first one that begins behind it
    step = lambda a, x: F.when(apart(a, x), own(x)).otherwise(a.withField("end", F.greatest(a["end"], x["end"])))
    merged = scan(order, none, step, lambda a, x: F.when(apart(a, x), a), kind)
    cuts, names_of = free_name(found, "cuts"), F.create_map(*(F.lit(x) for pair in PLACEHOLDER.items() for x in pair))
    whole = _once(merged, lambda m: F.filter(F.concat(m["out"], F.array(m["state"])), lambda x: x["start"] >= 0))
    rows = found.withColumn(cuts, F.when(F.size("spans") > 0, whole).otherwise(F.array().cast(f"array<{kind}>")))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])
    parts = F.transform(cuts, lambda x, i: F.concat(text.substr(begin(i) + 1, x["start"] - begin(i)), F.element_at(names_of, x["kind"])))
    tail = text.substr(F.element_at(cuts, -1)["end"] + 1, F.length(text))
    return rows.withColumn(text_col, F.when(F.size(cuts) > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)).drop(cuts)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
