"""Languages of texts by profiles of letter trigrams that labelled texts give.

A text is lower-cased, every run of other characters than letters counts as one space, and so
do its two ends. A profile holds how likely each trigram is in each language (add-one
smoothed logarithms in thousandths). These are whole numbers, so sums do not depend on the
order of rows. Trigrams that no labelled text has say nothing.

The profile grows with the alphabet and not with the texts; it is a saved table, so its size
is known when it is joined, and it is broadcast only below the session's threshold. Each text
is first added up by trigrams in its own row, so a trigram that is in every text has one row a text.

Defined cases: a text that is null, or shorter than `min_chars` without the white space around
it, or without any known trigram, has the default language at confidence 0; labelled rows with
a null label or text teach nothing; rows with one key are read as one text; of equal scores
the smaller name comes first; a profile of no rows gives the default language to all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from graphloom.operators.loops import Saved

#: Languages are columns of the profile: the bound of what the driver reads.
MAX_LANGUAGES = 1000
MIN_CHARS = 10
CHARS = 500_000  # characters that are counted together, about
_ENDS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}]+", " ")


def trigrams(text: Column) -> Column:
    """array<string>: all trigrams of letters and single spaces, repeats included, by one pass."""
    # a lookahead finds matches that overlap; half a surrogate pair is no letter
    return F.filter(F.regexp_extract_all(_plain(text), F.lit("(?=(...))"), F.lit(1)), lambda g: F.regexp_like(g, F.lit(r"^[\p{L} ]{3}$")))


def _counts(plain: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Each trigram of each text once: the place of the text, the trigram, how often it occurs."""
    texts = pc.fill_null(plain, "")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    code = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside = text[:-2] == text[2:]
    each = pa.table({"at": text[:-2][inside], "code": code[inside]}).group_by(["at", "code"], use_threads=False).aggregate([([], "count_all")])
    known, place = np.unique(each["code"].to_numpy(), return_inverse=True)
    letters = np.stack([known >> 42, known >> 21 & 0x1FFFFF, known & 0x1FFFFF], axis=1).astype(np.uint32)
    grams = pa.array(letters.view("U3").ravel().tolist(), pa.string())
    return each["at"].to_numpy(), grams.take(pa.array(place)), each["count_all"].combine_chunks()


@F.pandas_udf(StructType([StructField("gram", ArrayType(StringType())), StructField("n", ArrayType(LongType()))]))
def _windows(plain: pd.Series) -> pd.DataFrame:
    at, gram, n = _counts(pa.array(plain, pa.string()))
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(1, len(plain)))
    return pd.DataFrame({"gram": np.split(gram.to_numpy(zero_copy_only=False)[order], ends), "n": np.split(n.to_numpy()[order], ends)}, index=plain.index)


def counted(text: Column) -> Column:
    """array<struct<gram, n>>: each of the text's trigrams once, with how often it occurs."""
    found = _windows(_plain(text))
    return F.arrays_zip(found["gram"].alias("gram"), found["n"].alias("n"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.utf8_length(batch["_plain"]), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHARS)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(size)], strict=True):
            part = batch.slice(start, end - start)
            at, gram, n = _counts(part["_plain"])
            bare = np.setdiff1d(np.arange(len(part)), at)
            keys = [part[c].take(pa.array(np.concatenate([at, bare]))) for c in part.schema.names[:-1]]
            told = [pa.concat_arrays([x, pa.nulls(len(bare), x.type)]) for x in (gram, n)]
            yield pa.RecordBatch.from_arrays([*keys, *told], names=[*part.schema.names[:-1], "gram", "n"])


def _gram_rows(docs: DataFrame, keys: list[Column | str], text: Column) -> DataFrame:
    """keys, gram, n: what `counted` has of each text, in rows; a text that has none has one row of
    nulls. Texts are counted by some characters at a time, so a task holds no more of them than
    that, however many or long they are."""
    rows = docs.select(*keys, _plain(text).alias("_plain"))
    kept = StructType([*rows.schema.fields[:-1], StructField("gram", StringType()), StructField("n", LongType())])
    return rows.mapInArrow(_rows, kept)


@dataclass(frozen=True)
class Profile:
    """weights: gram, w (array<long>, one place a language, in the order of `languages`)."""

    weights: DataFrame
    languages: tuple[str, ...]


def profile(docs: DataFrame, *, text: str = "text", label: str = "lang") -> Profile:
    """What the trigrams of labelled texts tell about their language."""
    saved = Saved(docs.sparkSession, "languages")
    told = _gram_rows(docs.where(F.col(label).isNotNull()), [F.col(label).cast("string").alias("lang")], F.col(text))
    counts = saved.save(told.where("gram is not null").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: not languages?")
    of = {r.lang: r.n for r in sizes}
    known = counts.agg(F.countDistinct("gram")).scalar()
    each = counts.groupBy("gram").agg(F.count("*").alias("_n"), *[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"_{k}") for k, name in enumerate(of)])

    def weight(k: int, size: int) -> Column:
        return F.round(1000 * F.log((F.col(f"_{k}") + 1) / (known + F.lit(size)))).cast("long")

    weights = F.array(*[weight(k, n) for k, n in enumerate(of.values())]) if of else F.array().cast("array<long>")
    return Profile(saved.save(each.select("gram", weights.alias("w"))), tuple(of))


def ranked(docs: DataFrame, known: Profile, *, key: str | list[str], text: str = "text", top: int | None = None, default: str = "en", min_chars: int = MIN_CHARS) -> DataFrame:
    """key columns, rank, language, confidence: the `top` languages of each text (all, if not
    given), likeliest first. Confidence is a language's share of the mean likelihoods a trigram,
    so it does not go to 1 with a text's length."""
    keys = [key] if isinstance(key, str) else key
    enough = F.length(F.regexp_replace(text, _ENDS, "")) >= min_chars
    # a file of few row groups is read by as few tasks
    rows = docs.select(*keys, text).repartition(*keys)
    met = _gram_rows(rows, keys, F.when(enough, F.col(text))).join(known.weights, "gram", "left")
    sums = [F.sum(F.col("n") * F.get("w", F.lit(k))).alias(f"_{k}") for k in range(len(known.languages))]
    scored = met.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n"))), F.lit(0)).alias("_n"), *sums)

    def place(k: int, name: str) -> Column:
        return F.struct((-F.col(f"_{k}")).alias("loss"), F.lit(name).alias("language"))

    order = F.array_sort(F.array(*[place(k, name) for k, name in enumerate(known.languages)])) if known.languages else F.array().cast("array<struct<loss:bigint,language:string>>")
    unknown = F.array(F.struct(F.lit(default).alias("language"), F.lit(0.0).alias("confidence")))

    def share(x: Column) -> Column:
        others = F.aggregate("_order", F.lit(0.0), lambda s, y: s + F.exp((x["loss"] - y["loss"]) / (1000.0 * F.col("_n"))))
        return F.struct(x["language"].alias("language"), (1 / others).alias("confidence"))

    told = scored.select(*keys, "_n", order.alias("_order"))
    best = F.col("_order") if top is None else F.slice("_order", 1, top)
    out = told.select(*keys, F.posexplode(F.when(F.col("_n") > 0, F.transform(best, share)).otherwise(unknown)).alias("_k", "_l"))
    return out.select(*keys, (F.col("_k") + 1).alias("rank"), "_l.*")


def detected(docs: DataFrame, known: Profile, *, key: str | list[str], text: str = "text", default: str = "en", min_confidence: float = 0.0, min_chars: int = MIN_CHARS) -> DataFrame:
    """key columns, language, confidence: the likeliest language, or the default (with the
    likeliest one's confidence) if that is below `min_confidence`."""
    best = ranked(docs, known, key=key, text=text, top=1, default=default, min_chars=min_chars).drop("rank")
    return best.withColumn("language", F.when(F.col("confidence") >= min_confidence, F.col("language")).otherwise(default))


def is_language(docs: DataFrame, known: Profile, language: str, *, key: str | list[str], text: str = "text", min_confidence: float = 0.5, **how) -> DataFrame:
    """key columns, matches: whether `language` is the likeliest, with `min_confidence`."""
    best = ranked(docs, known, key=key, text=text, top=1, **how)
    keys = [key] if isinstance(key, str) else key
    return best.select(*keys, ((F.col("language") == language) & (F.col("confidence") >= min_confidence)).alias("matches"))
