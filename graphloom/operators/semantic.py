"""Chunks of sentences that are alike: a text is cut where neighbouring sentences are least so.

A sentence's vector counts its lower-cased words in hashed buckets. Only neighbours in a text
are compared, so a text is cut in its own row; only
texts are dealt out, once."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from graphloom.functions.text import sentences

BUCKETS = 64
_WORD = re.compile(r"[^ \t\n\r\f\x0B]+")


@lru_cache(1 << 16)
def _bucket(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big") % BUCKETS


@F.pandas_udf(ArrayType(DoubleType()))
def _cosines(texts: pd.Series) -> pd.Series:
    def each(lowered):
        out, last, size = [], None, 0
        for sentence in lowered:
            now = Counter(map(_bucket, _WORD.findall(sentence)))
            own = sum(c * c for c in now.values())
            if last is not None:
                dot = sum(c * last[b] for b, c in now.items())
                out.append(dot / math.sqrt(size * own) if dot else 0.0)
            last, size = now, own
        return out

    return texts.map(each)


def similarities(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """(id, sentences, similarities) of each text with a sentence: the cosine of every sentence and
    the next one, 0 if one has no words."""
    # a file of few row groups is read by as few tasks
    cut = rows.select(key, text).repartition(key).select(F.col(key).alias("id"), sentences(F.col(text)).alias("sentences")).where(F.size("sentences") > 0)
    return cut.withColumn("similarities", _cosines(F.transform("sentences", lambda s: F.lower(s))))


def nearest_rank(numbers: Column, quantile: float) -> Column:
    return F.get(F.array_sort(numbers), F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.size(numbers))).cast("int") - 1)


def semantic_chunks(rows: DataFrame, *, key: str, text: str, quantile: float = 0.25) -> DataFrame:
    """(id, chunk, first, sentences, text): runs of sentences, joined by a space. A text is cut
    behind each sentence whose similarity to the next is below the text's quantile (nearest
    rank). Keys are distinct; texts without a sentence have no chunk."""
    found = similarities(rows, key=key, text=text).withColumn("level", nearest_rank(F.col("similarities"), quantile))
    behind = F.transform("similarities", lambda x, n: F.when(x < F.col("level"), n + 1))
    found = found.withColumn("firsts", F.concat(F.array(F.lit(0)), F.filter(behind, lambda n: n.isNotNull())))
    after = F.coalesce(F.get("firsts", F.col("chunk") + 1), F.size("sentences"))
    each = found.select("id", "sentences", "firsts", F.posexplode("firsts").alias("chunk", "first"))
    each = each.select("id", "chunk", "first", F.slice("sentences", F.col("first") + 1, after - F.col("first")).alias("own"))
    return each.select("id", "chunk", "first", F.size("own").cast("long").alias("sentences"), F.array_join("own", " ").alias("text"))
