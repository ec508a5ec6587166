"""The corpus pipeline's stages on a small table, each judged on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from graphloom.llm import pieces
from graphloom.llm.queries import MODEL

from tests.llm.test_operators import WORDS, prose


def test_stages(spark, tmp_path):
    rnd = random.Random(12)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    data = []
    for k in range(200):
        text = "\n".join(prose(rnd, 40, vocabulary) for _ in range(3))
        if k % 5 == 0:
            text = "".join(f"{w}### " for w in text.upper().split())
        data.append((k, text, "en", f"s{k % 3}", len(text)))
    passage = prose(rnd, 60, vocabulary)
    good = [r for r in data if r[0] % 5]
    for k, r in enumerate(good[:6]):
        data.append((300 + k, r[1] + "\n" + passage, "en", "s1", 0))
    data += [(400, good[20][1], "en", "s2", 0), (401, " ".join(good[21][1].split()[:-1]) + " changed", "en", "s2", 0), (402, None, None, None, None), (403, "", "en", "s0", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 5 > 0), 0) for r in data[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        now = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = now.collect()
        if name != names[-1]:
            assert now.columns == docs.columns
    classified = {r.doc_id for r in seen[names[0]]}
    assert all((k in classified) == bool(k % 5) for k in range(200))
    lines = {r.doc_id: r.text for r in seen[names[1]]}
    assert set(lines) == classified
    assert sum(passage in (t or "") for t in lines.values()) == 1
    near = {r.doc_id for r in seen[names[2]]}
    assert 400 not in near and good[20][0] in near and all(r[0] in near for r in good[30:])
    mixed = [r.doc_id for r in seen[names[3]]]
    assert set(mixed) <= near and max(mixed.count(k) for k in set(mixed)) <= 2
    machine = pieces.Transducer(pieces.model_bytes(MODEL))
    text = {r.doc_id: r.text for r in seen[names[3]]}
    for r in seen[names[4]]:
        assert (machine.decode(machine.encode(text[r.doc_id])) if text[r.doc_id] is not None else None) == text[r.doc_id]
        assert list(r.ids or []) == ([] if text[r.doc_id] is None else machine.encode(text[r.doc_id]).tolist())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[names[4]])


def test_last_stage_decodes(spark, tmp_path):
    texts = ["plain words", "", None, "é ü 文字 \U0001F600"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.tokenised(spark, docs, str(tmp_path)).collect()}
    machine = pieces.Transducer(pieces.model_bytes(MODEL))
    for k, t in enumerate(texts):
        assert got[k].decoded == (None if t is None else machine.decode(machine.encode(t)))
        assert got[k].lossless == (got[k].decoded == t)
