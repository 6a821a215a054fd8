"""URL filter: rules first, then a ratio of character language models.

Two variable-order Markov models read accepted and rejected urls character by character. Each order is smoothed by the
next shorter one, P(c|h) = (n(hc) + s P(c|h')) / (n(h) + s). A url's score is the mean over its characters of
ln P_accepted - ln P_rejected, both after the longest context that was seen often enough.

Seeds make rejected examples: urls with a listed term in host or path. Urls with one further behind are no examples; all
others are accepted ones, though many of them are bad hosts that no seed names. So no host vouches for itself: hosts fall
into folds, and a url is scored by models of the other folds' urls alone. What looks more like rejected urls of other hosts
than like accepted ones is then blocked, whether or not it holds a seed. The threshold is calibrated on these held-out
scores: of those at or below 0 that lose at most ``lost_accepted`` of the accepted examples, the one that parts both kinds
best.

Only DataFrame functions. The models read host, path, query and fragment with digits alike; counting and scoring run over
distinct such shapes, each weighed by its rows, and shapes' scores are joined back to the rows.

A null url, or one without ``://``, has empty host and path, fits no rule and is allowed. Repeated rows are judged alike.
With no accepted or no rejected url to learn from, what no rule decides is allowed. Urls of any length are read whole.
Further columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import after_scheme, free_name, materialise, url_host, url_path


@dataclass(frozen=True)
class UrlFilter:
    """rules: (verdict, host and path). reject_terms: seeds, words that make a url an example of rejected ones."""

    rules: Sequence[tuple[str, str]] = ()
    reject_terms: Sequence[str] = ()
    longest_context: int = 4
    seen_often: int = 3
    smoothing: float = 4.0
    lost_accepted: float = 0.05
    folds: int = 10


#: Characters that the models tell apart; digits count as one, all others as another.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./_%~?=&#:@-"
#: Models and score tables of up to so many rows (some 20 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, under = rule.split("/", 1)
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{under}")
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def shape_of(url: Column) -> Column:
    """What the models read: all that follows ``://`` with an end, digits as 0, strange characters as one."""
    whole = F.lower(after_scheme(url))
    plain = F.regexp_replace(F.regexp_replace(whole, "[0-9]", "0"), f"[^{ALPHABET.replace('-', '')}-]", "*")
    return F.when(url_host(url) == "", F.lit("")).otherwise(F.concat(plain, F.lit("$")))


def _with_grams(shapes: DataFrame, longest: int) -> DataFrame:
    """A row for each character of each shape and each context length: gram = context and character, at its place."""
    padded = F.concat(F.lit("^" * longest), F.col("shape"))
    places = shapes.select("*", F.explode(F.sequence(F.lit(1), F.length("shape"))).alias("place"))
    rows = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(longest))).alias("order"))
    return rows.withColumn("gram", padded.substr(F.col("place") + longest - F.col("order"), F.col("order") + 1))


def _model(examples: DataFrame, f: UrlFilter) -> DataFrame:
    """Per gram, with an entry for each fold: the rows of accepted (a) and rejected (r) examples of all other folds that hold
    it, and those that hold its context (ta, tr). examples: shape, fold, rejected, n."""
    names = [f"{kind}{k}" for kind in "ar" for k in range(f.folds)]
    mine = lambda kind, k: F.sum(F.when((F.col("rejected") == (kind == "r")) & (F.col("fold") == k), F.col("n")).otherwise(0))
    counts = _with_grams(examples, f.longest_context).groupBy("gram").agg(*(mine(c[0], int(c[1:])).alias(c) for c in names))
    counts = materialise(counts.withColumn("context", F.expr("left(gram, length(gram) - 1)")), "url-grams")
    # contexts of different lengths are never equal: the text of a context starts at its own length
    context = F.struct("context", F.length("gram").alias("n"))
    totals = counts.groupBy(context.alias("c")).agg(*(F.sum(c).alias(f"t{c}") for c in names))
    both = counts.join(totals, context == F.col("c"))

    def others(prefix: str) -> Column:
        whole = sum((F.col(f"{prefix}{k}") for k in range(1, f.folds)), F.col(f"{prefix}0"))
        return F.array(*(whole - F.col(f"{prefix}{k}") for k in range(f.folds)))

    return materialise(both.select("gram", *(others(p).alias(p) for p in ("a", "r", "ta", "tr"))), "url-model")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _scores(shapes: DataFrame, model: DataFrame, f: UrlFilter) -> DataFrame:
    """Adds score: the mean ratio after each character's longest known context, by the models of other folds."""
    known = _with_grams(shapes.select("id", "shape", "fold"), f.longest_context).join(_sized(model), "gram")
    values = ("a", "r", "ta", "tr")
    known = known.select("id", "place", "order", *(F.get(v, F.col("fold")).alias(v) for v in values))
    at = lambda v, k: F.max(F.when(F.col("order") == k, F.col(v))).alias(f"{v}{k}")
    by_place = known.groupBy("id", "place").agg(*(at(v, k) for v in values for k in range(f.longest_context + 1)))
    flat = F.struct(F.lit(1.0 / (len(ALPHABET) + 3)).alias("pa"), F.lit(1.0 / (len(ALPHABET) + 3)).alias("pr"))
    orders = F.array(*(F.struct(*(F.coalesce(f"{v}{k}", F.lit(0)).alias(v) for v in values)) for k in range(f.longest_context + 1)))
    s = F.lit(f.smoothing)
    longer = lambda p, x: F.when(x["ta"] + x["tr"] < f.seen_often, p).otherwise(
        F.struct(((x["a"] + s * p["pa"]) / (x["ta"] + s)).alias("pa"), ((x["r"] + s * p["pr"]) / (x["tr"] + s)).alias("pr"))
    )
    ratio = F.aggregate(orders, flat, longer, lambda p: F.log(p["pa"]) - F.log(p["pr"]))
    by_shape = by_place.groupBy("id").agg(F.sum(ratio).alias("total"))
    return shapes.join(by_shape, "id").withColumn("score", F.round(F.col("total") / F.length("shape"), 6)).drop("total")


def threshold_of(scored: DataFrame, f: UrlFilter) -> float | None:
    """See the module's docstring; None without examples of both kinds. scored: score, n, rejected (null: no example)."""
    bucket = F.round(F.greatest(F.least("score", F.lit(10.0)), F.lit(-10.0)), 3)  # 20,001 rows at most
    rows = scored.filter("rejected IS NOT NULL").groupBy(bucket.alias("score")).agg(
        F.sum(F.when(F.col("rejected"), F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(F.col("rejected"), 0).otherwise(F.col("n"))).alias("a")
    )
    rows = sorted(map(tuple, rows.collect()))
    all_r, all_a = sum(r for _, r, _ in rows), sum(a for _, _, a in rows)
    if not all_r or not all_a:
        return None
    best, found, r, a = 0.0, -10.0, 0, 0
    for i, (score, n_r, n_a) in enumerate(rows):
        r, a = r + n_r, a + n_a
        if score >= 0 or a > f.lost_accepted * all_a:
            break
        if r / all_r - a / all_a >= best:  # up to the next score that occurs nothing changes
            best, found = r / all_r - a / all_a, min(0.0, rows[i + 1][0] if i + 1 < len(rows) else 0.0)
    return found


def judge(pages: DataFrame, f: UrlFilter, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, score and verdict (allow or block) to every row."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    said, shape = free_name(pages, "said"), free_name(pages, "shape")
    rows = pages.withColumn(shape, shape_of(url)).withColumns({"host": url_host(url), "path": url_path(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), f.rules)
    rows = rows.withColumns({"rule": rule, said: verdict})
    terms = f"(^|[^a-z])({'|'.join(f.reject_terms)})([^a-z]|$)" if f.reject_terms else "(?!)"
    front = F.regexp_extract("shape", "^[^?#]*", 0)
    is_bad = F.when(front.rlike(terms), True).when(F.col("shape").rlike(terms), F.lit(None)).otherwise(False)
    shapes = rows.filter(F.col(shape) != "").groupBy(F.col(shape).alias("shape")).agg(F.count("*").alias("n"))
    fold = F.pmod(F.xxhash64(F.regexp_extract("shape", "^[^/?#]*", 0)), F.lit(f.folds)).cast("int")
    shapes = materialise(shapes.withColumns({"rejected": is_bad, "fold": fold, "id": F.xxhash64("shape")}), "url-shapes")
    scored = materialise(_scores(shapes, _model(shapes.filter("rejected IS NOT NULL"), f), f), "url-scores")
    least = threshold_of(scored, f)
    method = F.lit("allow") if least is None else F.when(F.col("score") < least, F.lit("block")).otherwise(F.lit("allow"))
    rows = rows.drop("score", "verdict").join(_sized(scored.select(F.col("shape").alias(shape), "score")), shape, "left")
    return rows.withColumn("verdict", F.coalesce(F.col(said), method)).drop(shape, said)
