"""Every operator and stage with columns named like its own temporaries, with dots and
backticks in names, and on empty, repeated, null and very long input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_topk, language_masks, line_chunks, mixing, ngram_ratio, pieces, quality_rules_ensemble, shards, simhash_anchors, url_rules
from graphloom.llm.common import fold
from graphloom.llm.queries import MODEL

from tests.llm.test_operators import prose

#: Names that operators use inside, and names that need quoting.
CLASH = "_row _text _key _id _node _n _m _full _below _gone _th _h _s _f _p _named _tokens _met _url _print _rest _text_node _copy members pattern own full below g i m s key label row id node anchor component bytes range at task offset place fingerprint_ block part asks v bucket raw trusted token rule_ a.b c`d".split()
LONG = 60_000


def texts():
    rnd = random.Random(17)
    out = [prose(rnd, 60) + "\n" + prose(rnd, 20) for _ in range(30)]
    return [*out, None, "", " \n\t", out[0], out[0], "x" * LONG, "word " * (LONG // 5), "\n" * 5000, "é" * 1000 + " 文字 \U0001F600"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 7 else None, t, "en" if k % 2 else "de", f"s{k % 3}" if k % 5 else None, 1, *["old"] * len(CLASH)) for k, t in enumerate(texts())]
    rows += [rows[2], rows[2]]
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 3 and 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")


MODEL_BYTES = pieces.model_bytes(MODEL)
OPERATORS = {
    "quality": lambda d, l: quality_rules_ensemble.score_documents(d, l, fold("doc_id", 5) > 0, keep_text=True, trees=2, rows=50)[0],
    "ratio": lambda d, l: ngram_ratio.judged(d, ngram_ratio.trusted_ids(l)),
    "shards": lambda d, l: shards.sharded(d, 3),
    "urls": lambda d, l: url_rules.judged(d, l, key="doc_id", url="text", min_count=2)[0],
    "lines": lambda d, l: line_chunks.deduplicated(d, runs=True),
    "simhash": lambda d, l: simhash_anchors.near_components(d),
    "one of each": lambda d, l: simhash_anchors.one_of_each(d),
    "mixing": lambda d, l: mixing.mixed(d)[0],
    "pieces": lambda d, l: pieces.encoded(d, MODEL_BYTES),
    "languages": lambda d, l: language_masks.identified(d, fold("doc_id", 3) != 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_column_is_lost_or_met(name, docs, labels):
    out = OPERATORS[name](docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() or name == "one of each"
    for c in CLASH:
        assert c in out.columns and {r[c] for r in rows} == {"old"}
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


def test_pipeline_stages_on_awkward_input(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.collect()


def test_long_urls(spark):
    long = "http://a.example.org/en/1" + "/seg" * 40_000 + "?" + "&".join(f"q{k}=1" for k in range(3000))
    pages = spark.createDataFrame([(1, long), (2, "http://x.net/" + "y" * LONG), (3, "http://" + "h." * 2000 + "net/")], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judged(pages, spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))[0].collect()}
    assert (got[1].rule, got[1].verdict, got[2].rule, got[3].verdict) == ("example.org/en/1", "block", None, "allow")


def test_vectors_with_awkward_columns(spark):
    data = [(k, [float(k % 5), 1.0], *["old"] * 4) for k in range(60)] + [(None, [1.0, 1.0], *["old"] * 4), (80, [1e7, -1e7], *["old"] * 4), (81, [], *["old"] * 4), (100, [], *["old"] * 4)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, place string, score string, `a.b` string, v string")
    got = exact_topk.top(d, F.col("vec_id") % 20 == 0, 3).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 80, 100}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(81, 0)]
    assert [r.score for r in got if r.query_id == 80 and r["rank"] == 1] == [64 * 64 * 10**7 * 3]
