"""URL filter: host and path rules first, then mined association rules.

FP-growth mines token combinations of URLs with a bad label; rules are pruned by support, by
confidence, by lift over the base rate where that is beyond chance, and where a shorter rule
is as confident. URLs are matched through an inverted index from token to rules. All of it
is DataFrame work, and rules are never collected.

Defined cases: a null url or one without "://" has an empty host and path and no tokens,
matches no rule and is allowed; repeated tokens count once, however many a url has; repeated
rows get the same verdict; without labelled rows of both kinds, or with no rule left,
everything that no host rule names is allowed; ties between host rules go to the longer text,
then to the first listed; an empty table has no rows; extra columns are kept, but host, path,
rule and verdict take the place of input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Saved, named, others, packed, unpacked

#: (verdict, host and path) as the contract gives them.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_COUNT = 20
MIN_LIFT = 1.5
#: Chance that any one of the combinations tried passes though it means nothing, about.
DOUBT = 0.01
WIDTH = 8  # tokens of a row that FP-growth combines; where a row has more, all triples are counted besides
MAX_TOKENS = 3  # of a rule
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host and each parent domain, path segments with their depth, the
    ending, names of query arguments, whether there is a fragment."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    # a segment without a digit at its depth; those with digits are too many to recur
    segments = F.filter(F.transform(F.split(p, "/"), lambda s, k: F.concat(F.lit("p"), k.cast("string"), F.lit(":"), F.regexp_replace(s, r"[0-9]+", "0"))), lambda s: ~s.rlike(r"^p\d+:$"))
    ending = F.filter(F.array(F.concat(F.lit("x:"), F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))), lambda s: s != "x:")
    arguments = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([A-Za-z_][^=&#]*)="), F.lit(1)), lambda a: F.concat(F.lit("q:"), a))
    fragment = F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(parents, segments, ending, arguments, fragment))
    return F.when(url.isNull() | (F.instr(url, "://") == 0), F.array().cast("array<string>")).otherwise(every)


def _held(rows: DataFrame) -> DataFrame:
    """row, bad, token: one row for each token of a labelled row."""
    return rows.select("row", "bad", F.explode("tokens").alias("token"))


def _evidence(n: Column, bad: Column, base: float) -> Column:
    """Standard deviations that `bad` of n rows lie above the base rate."""
    return (bad - n * base) / F.sqrt(n * (base * (1 - base)))


def mined(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, doubt: float = DOUBT, width: int = WIDTH) -> DataFrame:
    """Rules (rule, antecedent, rows, bad, confidence, lift) from columns `tokens` (distinct)
    and `bad` (boolean).

    FP-growth runs over the bad rows alone, each with its `width` strongest tokens: tokens
    that occur in the same rows count as one, and strength is the evidence of the token by
    itself. So a row has 2^width combinations at most, however many tokens a url has. Tokens
    that are weak by themselves may still be strong together: pairs are counted of all
    frequent tokens of a row, and if rows have more tokens than `width`, triples too. The rows and the confidence of each frequent combination are then
    counted over all labelled rows and all their tokens, by the same inverted index that
    matches urls."""
    spark = labelled.sparkSession
    saved = Saved(spark, "rules")
    rows = saved.save(labelled.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    empty = spark.createDataFrame([], "rule long, antecedent array<string>, rows long, bad long, confidence double, lift double")
    if not 0 < bad < n:
        return empty
    base, least = bad / n, max(min_count, min_support * n)
    mark = F.xxhash64("row").cast("decimal(38,0)")
    tokens_ = _held(rows).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"), F.sum(mark).alias("mark")).where(F.col("k") >= least)
    # tokens of the same rows have one name, the smallest
    tokens_ = tokens_.groupBy("n", "k", "mark").agg(F.min("token").alias("token")).select("token", _evidence(F.col("n"), F.col("k"), base).alias("z"))
    strong = _held(rows.where("bad")).join(tokens_, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("z", "token")), asc=False).alias("best"))
    items = saved.save(strong.select(F.slice("best.token", 1, width).alias("items"), F.array_sort("best.token").alias("every")))
    if items.isEmpty():
        return empty
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / items.count())).fit(items.select("items")).freqItemsets
    found = found.where(F.size("items") <= MAX_TOKENS).select(F.array_sort("items").alias("antecedent"))
    pairs = items.select(F.explode(_in_order("every")).alias("antecedent")).groupBy("antecedent").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    pairs = saved.save(pairs.select("antecedent"))
    found = found.union(pairs)
    if not items.where(F.size("every") > width).isEmpty():  # FP-growth has not seen all of these
        found = found.union(_triples(saved, items, pairs, least))
    found = found.distinct()
    found = saved.save(found.withColumn("rule", F.monotonically_increasing_id()))
    tried = found.count()
    met = met_by(_held(rows), found, "row", "bad")
    counted = met.groupBy("rule").agg(F.count("*").alias("rows"), F.sum(F.col("bad").cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("rows")
    # so many combinations are tried that chance alone would pass a fixed bound
    needed = math.sqrt(2 * math.log(max(2, tried) / doubt))
    sure = counted.where((F.col("bad") >= least) & (rate >= min_confidence) & (rate >= min_lift * base) & (_evidence(F.col("rows"), F.col("bad"), base) >= needed))
    kept = saved.save(sure.join(found, "rule").select("rule", "antecedent", "rows", "bad", rate.alias("confidence"), (rate / base).alias("lift")))
    # a rule adds nothing to a part of it that is as confident
    part = F.array_union(F.transform("antecedent", lambda t: F.array(t)), F.transform("antecedent", lambda t: F.array_except("antecedent", F.array(t))))
    parts = kept.where(F.size("antecedent") > 1).select("rule", "confidence", F.explode(F.filter(part, lambda p: F.size(p) > 0)).alias("part"))
    dull = parts.join(kept.select(F.col("antecedent").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("rule").distinct()
    return saved.save(kept.join(dull, "rule", "left_anti"))


def _in_order(every: str) -> Column:
    """All pairs of an array's entries, in its order."""
    return F.flatten(F.transform(every, lambda x, i: F.transform(F.slice(every, i + 2, F.size(every)), lambda y: F.array(x, y))))


def _triples(saved: Saved, items: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """antecedent: all triples that at least `least` rows hold. items: every (tokens in order);
    pairs: antecedent (all pairs that are so frequent). Every pair of such a triple is one of
    them, so no row lists all combinations of its tokens: a pair meets the third tokens that
    both of its own are frequent with, and the row says which of these it has."""
    frequent = saved.save(pairs.select(F.col("antecedent")[0].alias("x"), F.col("antecedent")[1].alias("y")))
    third = frequent.join(frequent.withColumnRenamed("y", "z"), "x").where("y < z").join(frequent.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    third = third.groupBy("x", "y").agg(F.collect_list("z").alias("zs"))
    held = items.select("every", F.explode(_in_order("every")).alias("p")).select("every", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    met = held.join(third, ["x", "y"]).select("x", "y", F.explode(F.array_intersect("every", "zs")).alias("z"))
    return met.groupBy("x", "y", "z").agg(F.count("*").alias("k")).where(F.col("k") >= least).select(F.array("x", "y", "z").alias("antecedent"))


def met_by(held: DataFrame, rules: DataFrame, *row: str) -> DataFrame:
    """(*row, rule): which rules (rule, antecedent) rows meet. held: *row and `token`, each
    token of a row once. The rules' inverted index, token to rule, is joined on the token; a
    rule is met if as many of its tokens are found as it has."""
    index = rules.select("rule", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    met = held.join(index, "token").groupBy(*row, "rule").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").select(*row, "rule")


def named_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...] = HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest host rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried first: it is outermost
        name, _, start = text.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, labels: DataFrame, *, key: str = "page_id", label_key: str = "doc_id", url: str = "url", rules: tuple[tuple[str, str], ...] = HOST_RULES, **how) -> tuple[DataFrame, DataFrame]:
    """pages with host, path, rule, verdict; and the mined rules. labels: label_key, quality,
    toxic; a row is bad if any of its labels has quality 0 or toxic 1."""
    said = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("_key")).agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("bad is not null")
    labelled = pages.select(named(key).alias("_key"), named(url).alias("_url")).join(said, "_key").select(tokens(F.col("_url")).alias("tokens"), "bad")
    learnt = mined(labelled, **how)
    own = others(pages, "host", "path", "rule", "verdict")
    out = pages.select(packed(own), named(url).alias("_url")).select("_row", "_url", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"))
    rule, verdict = named_rule(F.col("host"), F.col("path"), rules)
    out = out.select("*", rule.alias("rule"), verdict.alias("_named"))
    if learnt.isEmpty():
        out = out.withColumn("_met", F.lit(False))
    else:
        # a url's verdict is looked up by the url; only those that no host rule names are tried
        held = out.where("_named is null").select("_url", F.explode(tokens(F.col("_url"))).alias("token"))
        index = learnt.select(F.explode("antecedent").alias("token")).distinct()
        hits = met_by(held.join(index, "token", "left_semi").distinct(), learnt, "_url").select("_url", F.lit(True).alias("_met")).distinct()
        out = out.join(hits, "_url", "left")
    verdict = F.coalesce("_named", F.when(F.coalesce("_met", F.lit(False)), "block").otherwise("allow"))
    return out.select(*unpacked(own), "host", "path", "rule", verdict.alias("verdict")), learnt
