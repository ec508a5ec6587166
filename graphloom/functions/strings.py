"""String measures and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def characters(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), ""))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, lower-cased."""
    low = F.lower(text)
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda k: F.substr(low, k, F.lit(2)))))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def block_keys(text: Column, prefix: int = 4) -> Column:
    """tok: and the first characters of each word of more than two characters."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) > 2), lambda w: F.concat(F.lit("tok:"), F.left(w, F.lit(prefix)))))


def squeezed(text: Column) -> Column:
    """Without zero-width characters; white space runs are one space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"[ \t\n\x0B\f\r]+", " "))


def content_key(*columns: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the columns' canonical text."""
    return F.left(F.sha2(F.concat_ws("|", *columns), 256), F.lit(24))


#: The digit of each consonant.
SOUNDEX = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def soundex(word: Column) -> Column:
    """First letter and three digits; letters without a digit do not part equal digits."""
    letters, digits = "".join(SOUNDEX), "".join(d * len(k) for k, d in SOUNDEX.items())
    up = F.upper(word)
    tail = F.translate(F.regexp_replace(F.substr(up, F.lit(2)), f"[^{letters}]", ""), letters, digits)
    for digit in SOUNDEX.values():
        tail = F.regexp_replace(tail, f"{digit}+", digit)
    return F.when(word == "", "").otherwise(F.left(F.concat(F.left(up, F.lit(1)), tail, F.lit("000")), F.lit(4)))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity; half of the matched characters that are out of order count against it."""
    none = F.array().cast("array<int>")

    def of(s: Column) -> Column:
        x, y, n, m = s["x"], s["y"], F.size(s["x"]), F.size(s["y"])
        reach = F.greatest((F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))

        def step(met: Column, i: Column) -> Column:
            low, high = F.greatest(F.lit(0), i - reach), F.least(i + reach, m - 1)
            free = F.filter(F.sequence(low, high), lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(met["j"], j))
            found = F.when(low <= high, F.get(free, 0))
            return F.struct(F.when(found.isNull(), met["i"]).otherwise(F.array_append(met["i"], i)).alias("i"), F.when(found.isNull(), met["j"]).otherwise(F.array_append(met["j"], found)).alias("j"))

        met = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(none.alias("i"), none.alias("j")), step)
        return F.struct(met.alias("met"), F.transform(met["i"], lambda i: F.get(x, i)).alias("p"), F.transform(F.array_sort(met["j"]), lambda j: F.get(y, j)).alias("q"), n.alias("n"), m.alias("m"))

    def score(s: Column) -> Column:
        k = F.size(s["p"])
        apart = F.size(F.filter(F.zip_with(s["p"], s["q"], lambda u, v: u != v), lambda w: w))
        return F.when(k == 0, 0.0).otherwise((k / s["n"] + k / s["m"] + (k - apart / 2) / k) / 3)

    # arrays of one bind a value to a name, so that it is computed once
    letters = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.transform(F.transform(letters, of), score)[0])


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro, raised by a tenth of what is missing for each equal leading character, four at most."""
    same = F.lit(0)
    for k in range(4, 0, -1):
        same = F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))), F.greatest(same, F.lit(k))).otherwise(same)
    return F.transform(F.array(F.struct(jaro(a, b).alias("s"), (same * 0.1).alias("bonus"))), lambda x: x["s"] + x["bonus"] * (1 - x["s"]))[0]


def string_similarity(a: Column, b: Column, method: str = "jaro_winkler") -> Column:
    """Of trimmed lower-cased texts; 0 if either is missing or empty."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    score = {"jaro_winkler": lambda: jaro_winkler(x, y), "levenshtein": lambda: levenshtein_similarity(x, y), "cosine": lambda: jaccard(bigrams(x), bigrams(y))}[method]()
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(score)


def property_similarity(pairs: list[tuple[Column, Column]], method: str = "jaro_winkler") -> Column:
    """Mean over properties: texts by their similarity, other values 1 if equal, else 0.5; one
    that either side lacks is no evidence, 0.5. `pairs` are (left, right) as texts."""
    each = [F.when(x.isNull() | y.isNull(), 0.5).otherwise(string_similarity(x, y, method)) for x, y in pairs]
    return sum(each, F.lit(0.0)) / max(1, len(each))


def relation_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of relations; 0.5 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that are not null."""
    total = sum((F.coalesce(w * x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def rejected(a: Column, b: Column, type_a: Column, type_b: Column, *, min_length_ratio: float = 0.3, min_token_overlap: float = 0.0) -> Column:
    """Why a pair need not be scored: type_mismatch, length_ratio_below_x, token_overlap_below_x;
    null if it must be. A missing name or type rejects nothing."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    long = [F.array_distinct(F.filter(F.split(F.regexp_replace(t, "[_-]", " "), " +"), lambda w: F.length(w) > 2)) for t in (x, y)]
    share = F.size(F.array_intersect(*long)) / F.least(F.size(long[0]), F.size(long[1]))
    out = F.when(type_a != type_b, "type_mismatch").when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), F.lit(None).cast("string")).when(ratio < min_length_ratio, f"length_ratio_below_{min_length_ratio}")
    return out.when((F.size(long[0]) > 0) & (F.size(long[1]) > 0) & (share < min_token_overlap), f"token_overlap_below_{min_token_overlap}") if min_token_overlap else out


#: Titles that are no part of a name.
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sir", "Madam")


def without_titles(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~w.isin(*TITLES))
    return F.array_join(words, " ")
