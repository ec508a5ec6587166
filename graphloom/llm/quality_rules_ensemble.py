"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow trees are grown on text statistics, every path of every tree becomes a
conjunctive rule, a lasso logistic regression gives each rule a weight (most get
none), and what is left is compiled into one Spark column expression.

Defined cases: a null text has the statistics of an empty one; an empty text gets the
score of the rules that hold for zeros; identical rows get identical scores; a label
that occurs several times counts by its mean (0.5 or more is 1); rows without a label,
or with a null id, are scored but not learnt from; with no labels, or labels of one
class only, the score is that class's rate (0.5 without any); an empty table has no rows;
extra columns are kept, but score and predicted take the place of input columns of these names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, named, others, packed, small, unpacked

#: Labelled rows that the trees and the lasso see at most: those with the smallest
#: hash of their id. Statistics and scores are computed over all rows.
FIT_ROWS = 20_000
THRESHOLD = 0.3

_COUNTS = {
    "n_words": WORD,
    "n_upper": r"\p{Lu}",
    "n_letters": r"\p{L}",
    "n_digits": r"[0-9]",
    "n_symbols": r"[#*$%&|<>{}=@_^~\[\]\\]",
    "n_marks": r"[!?]",
    "n_stops": r"[.,;:]",
}


def statistics(text: Column) -> dict[str, Column]:
    """Counts over a whole text, as columns; `rates` makes statistics of them."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, r"[\x20\x09-\x0D]+")
    lines = F.split(text, "\n")
    return {
        **{name: F.regexp_count(text, F.lit(p)) for name, p in _COUNTS.items()},
        "n_chars": F.length(text),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_lines": F.size(lines),
        "n_distinct_lines": F.size(F.array_distinct(lines)),
    }


def rates() -> dict[str, Column]:
    def over(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "upper": over("n_upper", "n_letters"),
        "letters": over("n_letters", "n_chars"),
        "digits": over("n_digits", "n_chars"),
        "symbols": over("n_symbols", "n_words"),
        "marks": over("n_marks", "n_words"),
        "stops": over("n_stops", "n_words"),
        "word_length": over("n_letters", "n_words"),
        # log V / log N hardly moves with the length of a text, unlike V / N
        "distinct": F.log1p(F.col("n_distinct").cast("double")) / F.log1p(F.greatest("n_words", F.lit(1)).cast("double")),
        "line_words": F.log1p(over("n_words", "n_lines")),
        "distinct_lines": over("n_distinct_lines", "n_lines"),
    }


FEATURES = ("upper", "letters", "digits", "symbols", "marks", "stops", "word_length", "distinct", "line_words", "distinct_lines")
Rule = tuple[tuple[int, bool, float], ...]  # (feature, greater, bound) of each condition


def tree_rules(debug: str) -> set[Rule]:
    """The path to every node but the root, from a tree's printed form."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[int, bool, float]]] = []  # (indentation, condition) down to here
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3] == ">", float(m[4])))]
            rules.add(tuple(sorted({x for _, x in path})))
    return rules


@dataclass
class RuleEnsemble:
    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Probability of label 1 as one expression over the columns FEATURES."""
        total = F.lit(float(self.intercept))
        for rule, weight in sorted(self.weights.items()):
            total = total + F.when(condition(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for feature, greater, bound in rule:
        x = F.col(FEATURES[feature])
        out = out & ((x > bound) if greater else (x <= bound))
    return out


def fit(labelled: DataFrame, *, trees: int = 20, depth: int = 3, lasso: float = 0.001, rows: int = FIT_ROWS, seed: int = 7) -> RuleEnsemble:
    """labelled: an id column `key`, FEATURES and `label` (0.0 or 1.0). At most `rows` of
    them (a documented bound on the driver and on the one partition they are put in, so
    that every run sees them in the same order) are fitted on."""
    sample = labelled.select("key", *FEATURES, "label").orderBy(F.xxhash64("key"), "key").limit(rows).coalesce(1)
    sample = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample).select("x", "label", *FEATURES).cache()
    try:
        n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < ones < n:
            rate = (ones + 0.5) / (n + 1)
            return RuleEnsemble(math.log(rate / (1 - rate)))
        forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=max(1, n // 1000), featureSubsetStrategy="onethird", maxBins=64).fit(sample)
        rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
        holds = sample.select("label", *[condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
        holds = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(holds).select("rules", "label").cache()
        lr = LogisticRegression(featuresCol="rules", regParam=lasso, elasticNetParam=1.0, maxIter=40, standardization=False).fit(holds)
        holds.unpersist()
        weights = {r: w for r, w in zip(rules, lr.coefficients.toArray(), strict=True) if abs(w) > 1e-9}
        return RuleEnsemble(float(lr.intercept), weights)
    finally:
        sample.unpersist()


def _once(name: str, columns: dict[str, Column]) -> Column:
    """The columns as one struct that is computed once a row: exploding an array of one keeps
    the optimiser from copying what is in it to every place where it is used."""
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(name)


def with_statistics(rows: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """A column `_row` of the columns `kept`, and FEATURES."""
    counts = rows.select(packed(kept), _once("_s", statistics(named(text)))).select("_row", "_s.*")
    return counts.select("_row", _once("_f", {n: c.cast("double") for n, c in rates().items()})).select("_row", "_f.*")


def learnt(docs: DataFrame, labels: DataFrame, train: Column, *, text: str = "text", key: str = "doc_id", target: str = "quality", rows: int = FIT_ROWS, **how) -> RuleEnsemble:
    """The ensemble fitted on at most `rows` labelled rows, those with the smallest hashes of
    their ids; `train` tells which of docs may be learnt from."""
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(target) >= 0.5).cast("double").alias("label")).where("label is not null")
    # labels of rows that are not learnt from take no place among those that are
    said = said.join(docs.where(train).select(named(key).alias("key")), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(rows)
    mine = docs.where(train).select(named(key).alias("key"), named(text).alias("text")).join(small(said), "key")
    return fit(with_statistics(mine, "text", ["key", "label"]).select("_row.key", "_row.label", *FEATURES), rows=rows, **how)


def score_documents(docs: DataFrame, labels: DataFrame, train: Column, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, keep_text: bool = False, **how) -> tuple[DataFrame, RuleEnsemble]:
    """All columns of docs (the text only with keep_text), with `score` and `predicted`, and
    the ensemble. Every text is read once more for its score; nothing is shuffled."""
    model = learnt(docs, labels, train, text=text, key=key, **how)
    own = others(docs, "score", "predicted", *([] if keep_text else [text]))
    scored = with_statistics(docs, text, own).select("_row", _once("_p", {"score": model.score()})).select("_row", "_p.score")
    return scored.select(*unpacked(own), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), model
