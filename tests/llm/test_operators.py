"""Every operator of the corpus part against brute force, and on awkward inputs."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import exact_topk, language_masks, line_chunks, mixing, ngram_ratio, pieces, quality_rules_ensemble, shards, simhash_anchors, url_rules
from graphloom.llm.common import fold
from graphloom.llm.components import crowded, linked
from graphloom.llm.queries import MODEL
from graphloom.operators.loops import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score string, fingerprint string, ids string, row string, g string"
WORDS = "the of and to in that was with for on be at by this from or had not are but some what there we can out other were all your when up use word how said an each she".split()


def prose(rnd, n, words=WORDS):
    out = []
    for k in range(n):
        out.append(rnd.choice(words) + (rnd.choice("abcdefgh") if rnd.random() < 0.6 else ""))
    return " ".join(out)


def rows():
    """Ordinary, null, empty, blank, long, copied, repeated and clashing rows."""
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(5, 120)) for _ in range(60)]
    texts += [None, "", " \t\n\x0b ", "word", "a b", texts[0], texts[0], texts[1] + " x", prose(rnd, 9000), "é ü 文字 \U0001F600", "### $$$ %%%", "12 34 5678"]
    texts += ["same same same same same same " * 10, "line one here\nline one here\n\nline two"]
    out = [(k, t, ["en", "de", None][k % 3], f"s{k % 4}" if k % 7 else None, 1, 5, "x", "y", "z", "r", "g") for k, t in enumerate(texts)]
    out.append((None, "no id at all", "en", "s0", 1, 5, "x", "y", "z", "r", "g"))
    return [*out, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(60)] + [(1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_scores_every_row(spark, docs, none, labels):
    out, model = quality_rules_ensemble.score_documents(docs, labels, fold("doc_id", 5) > 0, rows=100, trees=3)
    got = out.collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    assert len(by_id[3]) == 1
    assert quality_rules_ensemble.score_documents(none, labels, F.lit(True))[0].count() == 0
    one_class, model = quality_rules_ensemble.score_documents(docs, labels.where("quality = 1"), F.lit(True))
    assert not model.weights and one_class.count() == len(rows())


def test_quality_separates_what_statistics_separate(spark):
    rnd = random.Random(5)
    data = [(k, prose(rnd, 60) if k % 3 else "".join(f"{w}!! " for w in prose(rnd, 60).upper().split())) for k in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    out, model = quality_rules_ensemble.score_documents(d, lab, fold("doc_id", 5) > 0)
    held = out.where(fold("doc_id", 5) == 0).collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert model.weights


def test_tree_rules_are_paths():
    text = "x\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    a, b = (0, False, 0.5), (1, False, 2.0)
    assert quality_rules_ensemble.tree_rules(text) == {(a,), (a, b), (a, (1, True, 2.0)), ((0, True, 0.5),)}


def brute_base(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_ngram_base_figures(spark, docs, none, labels):
    got = ngram_ratio.judged(docs, ngram_ratio.trusted_ids(labels)).collect()
    text = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        want = brute_base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r.llr >= ngram_ratio.THRESHOLD)
    assert ngram_ratio.judged(none, ngram_ratio.trusted_ids(labels)).count() == 0
    assert {r.llr for r in ngram_ratio.judged(docs, ngram_ratio.trusted_ids(labels.limit(0))).collect()} == {0.0}


def test_ngram_ratio_is_the_mean_log_ratio(spark, docs, labels):
    trusted = ngram_ratio.trusted_ids(labels)
    ratios = ngram_ratio.log_ratios(docs, trusted)
    r = ngram_ratio.judged(docs, trusted).where("doc_id = 4").first()
    data = np.frombuffer({x[0]: x[1] for x in rows()}[4].encode(), np.uint8)
    code, ok = ngram_ratio.ngrams(data, np.array([0, len(data)]), ngram_ratio.N, ngram_ratio.BUCKETS)
    assert ok.all() and abs(ratios[code].mean() - r.llr) < 1e-8


def test_ngram_target_counts_every_trusted_row(spark):
    n = 20_300
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    # as many ids without a document, which must not take the place of others
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = ngram_ratio.trusted_ids(labels)
    assert trusted.count() == 2 * n
    # the target is the whole corpus, so no n-gram is commoner in it
    assert not ngram_ratio.log_ratios(texts, trusted).any()


@pytest.mark.parametrize("shard_count", [1, 7])
def test_shards_near_equal_and_gapless(spark, docs, none, shard_count):
    got = shards.sharded(docs, shard_count).collect()
    assert len(got) == len(rows())
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        text = {x[0]: x[1] for x in rows()}[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        by[r.shard].append(r)
    largest = max(r["size"] for r in got)
    for s, rs in by.items():
        assert 0 <= s < shard_count and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / shard_count) <= 1.05 * largest
    assert shards.sharded(none, 3).count() == 0


def test_shards_split_one_hot_group(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text over and over").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    sizes = [r["b"] for r in shards.sharded(d, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8


def test_host_rules():
    def longest(url):
        at = url.find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        h, tail = rest[:cut].lower(), rest[cut:]
        p = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(v, r) for v, r in url_rules.HOST_RULES if (h == r.split("/", 1)[0] or h.endswith("." + r.split("/", 1)[0])) and p.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=lambda x: len(x[1]), default=(None, None)), h, p

    test_host_rules.brute = longest


def test_urls(spark, labels):
    test_host_rules()
    urls = ["http://A.Example.ORG/es/1", "https://org/", "https://org", "http://x.example.org/en/123?a=1", "http://notexample.org/en/1", "ftp://b.com/de/x#f", "http://com/fr/", "http://b.com/frx", "no scheme.com/de/", "", None, "http://h.net/p/q.html?utm=1&x=2#t", "://com/de/", "http://u@b.COM/de/é"]
    pages = spark.createDataFrame([(k, u, "host?", 3) for k, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, rule int")
    got, _ = url_rules.judged(pages, labels)
    got = got.collect()
    assert len(got) == len(urls) + 3
    for r in got:
        (verdict, rule), h, p = test_host_rules.brute(r.url or "")
        assert (r.host, r.path, r.rule) == (h, p, rule) and r.verdict == (verdict or "allow")
    assert url_rules.judged(pages.limit(0), labels)[0].count() == 0


def as_set(rules):
    return {(tuple(r.antecedent), r.rows, r.bad) for r in rules.collect()}


def test_url_rules_are_mined(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 5}.net/{'spam' if k % 4 == 0 else 'news'}/{k}?{'ref=1' if k % 2 else 'x=2'}") for k in range(200)], "page_id long, url string")
    lab = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 160)], "doc_id long, quality int, toxic int")
    got, rules = url_rules.judged(pages, lab, min_count=3)
    assert (("p1:spam",), 40, 40) in as_set(rules) and all(len(a) == 1 or "p1:spam" not in a for a, _, _ in as_set(rules))
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got.collect())


def test_url_rules_against_all_combinations(spark):
    from itertools import combinations
    from math import log, sqrt

    rnd = random.Random(31)
    rows = []
    for k in range(600):
        have = sorted(t for t in "abcdef" if rnd.random() < 0.4)
        bad = rnd.random() < (0.95 if {"a", "b"} <= set(have) else 0.9 if "c" in have and "d" not in have else 0.1)
        rows.append((have, bad))
    rules = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_count=5)
    rows = [r for r in rows if r[0]]
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    least = max(5, url_rules.MIN_SUPPORT * n)
    every = {c: (sum(set(c) <= set(t) for t, _ in rows), sum(b and set(c) <= set(t) for t, b in rows)) for k in (1, 2, 3) for c in combinations("abcdef", k)}
    every = {c: x for c, x in every.items() if x[1] >= least}
    needed = sqrt(2 * log(len(every) / url_rules.DOUBT))
    sure = {c: (m, b) for c, (m, b) in every.items() if b / m >= max(url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT * base) and (b - m * base) / sqrt(m * base * (1 - base)) >= needed}
    want = {(c, m, b) for c, (m, b) in sure.items() if not any(set(d) < set(c) and sure[d][1] / sure[d][0] >= b / m for d in sure)}
    assert as_set(rules) == want and len(want) >= 2


def test_a_pair_of_weak_tokens_beside_many_strong_ones(spark):
    rnd = random.Random(17)
    rows = []
    for _ in range(4000):
        have = [f"s{k:02d}" for k in range(12) if rnd.random() < 0.5]
        pair = rnd.random() < 0.06
        have += ["a", "b"] if pair else ["a"] * (rnd.random() < 0.5) or ["b"]
        rows.append((sorted(have), pair or rnd.random() < 0.03 * sum(t[0] == "s" for t in have)))
    rules = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_count=5)
    n = sum({"a", "b"} <= set(t) for t, _ in rows)
    assert (("a", "b"), n, n) in as_set(rules)


def test_url_rules_need_evidence(spark):
    rnd = random.Random(5)
    rows = [([f"t{rnd.randrange(40)}", f"u{rnd.randrange(9)}"], rnd.random() < 0.3) for _ in range(3000)]
    assert url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_count=3).count() == 0


@pytest.mark.parametrize("depth", [12, 30, 300])
def test_deep_url_templates_are_mined_in_time(spark, depth):
    import time

    rnd = random.Random(depth)
    start = time.time()
    pages = [(k, ("http://x.net/a/" if k % 3 == 0 else "http://x.net/b/") + "/".join(f"s{i}" for i in range(depth) if i % 7 or rnd.random() < 0.9)) for k in range(120)]
    lab = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    got, rules = url_rules.judged(spark.createDataFrame(pages, "page_id long, url string"), lab, min_count=5)
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got.collect()) >= 100
    assert time.time() - start < 60


def test_texts_of_very_many_lines(spark):
    import time

    def text(n):
        return "\n".join(f"line {i * 7919 % 1000003} has some words of its own {i}" for i in range(n))

    start = time.time()
    long = text(100_000)
    data = [(1, long), (2, "first\n" + long + "\nlast"), (3, "\n" * 50_000)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_chunks.deduplicated(spark.createDataFrame(data, "doc_id long, text string"), runs=True).collect()}
    assert got == {1: (long, 0), 2: ("first\nlast", 100_000), 3: ("\n" * 50_000, 0)}
    assert time.time() - start < 120


def brute_chunks(text, window=line_chunks.WINDOW, divisor=line_chunks.DIVISOR, long_line=line_chunks.LONG_LINE, spark=None):
    lines = text.split("\n")

    def xx(value, seed):
        return xxhash.xxh64_intdigest(value, seed)

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def hashed_long(v, seed):
        return signed(xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed & ((1 << 64) - 1)))

    hs = [signed(xx(x.encode(), 42)) for x in lines]
    is_long = [len(x.encode().split()) >= long_line for x in lines]

    def rolled(k):
        total = 0
        for back in range(window - 1, -1, -1):
            h = hashed_long(total, 42)
            total = hashed_long(hs[k - back], h) if k - back >= 0 else h
        return total

    starts = [k for k in range(len(lines)) if k == 0 or is_long[k] or is_long[k - 1] or rolled(k - 1) % divisor == 0]
    ends = [*starts[1:], len(lines)]
    return [(a, b - a, "\n".join(lines[a:b])) for a, b in zip(starts, ends)]


def brute_lines(data, min_words=line_chunks.MIN_WORDS):
    places = defaultdict(set)
    for doc_id, text in data:
        for at, n, chunk in brute_chunks(text) if text is not None else ():
            words = len(chunk.encode().split())
            if (n > 1 and words >= min_words) or words >= line_chunks.LONG_LINE:
                places[chunk].add((doc_id is not None, doc_id or 0, signed_text(text), at))
    out = {}
    for doc_id, text in data:
        if text is None:
            out[doc_id, text] = (None, 0)
            continue
        kept, gone = [], 0
        for at, n, chunk in brute_chunks(text):
            me = (doc_id is not None, doc_id or 0, signed_text(text), at)
            if chunk in places and min(places[chunk]) != me and me in places[chunk]:
                gone += n
            else:
                kept.append(chunk)
        out[doc_id, text] = ("\n".join(kept), gone)
    return out


def signed_text(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_line_chunks_against_brute_force(spark, none):
    rnd = random.Random(9)
    pool = [prose(rnd, rnd.randint(1, 70)) for _ in range(30)] + ["", "  "]
    data = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for k in range(120)]
    data += [(200, None), (201, ""), (None, data[0][1]), data[5], data[5], (202, data[7][1]), (203, "\n\n\n"), (204, " ".join(pool * 20))]
    d = spark.createDataFrame([(a, b, 7, "x") for a, b in data], "doc_id long, text string, removed_lines int, _gone string")
    want = brute_lines(data)
    got = line_chunks.deduplicated(d).collect()
    assert len(got) == len(data)
    original = defaultdict(list)
    for a, b in data:
        original[a].append(b)
    for r in got:
        assert any((r.text, r.removed_lines) == want[r.doc_id, t] for t in original[r.doc_id])
    assert sum(r.removed_lines for r in got) > 20
    assert line_chunks.deduplicated(none).count() == 0


def test_short_passages_go_from_edge_to_edge(spark):
    rnd = random.Random(4)

    def line(n):
        return " ".join(f"w{rnd.getrandbits(40):x}" for _ in range(n))

    data, want = [], {}
    for case in range(60):
        lengths = [rnd.randint(0, 49) for _ in range(rnd.randint(2, 9))]
        while sum(lengths) < line_chunks.LONG_LINE:
            lengths.append(rnd.randint(1, 12))
        passage = [line(n) for n in [rnd.randint(1, 49), *lengths, rnd.randint(1, 49)]]
        for copy in range(3):
            head, tail = ([line(rnd.randint(1, 40)) for _ in range(rnd.randint(0, 3))] for _ in range(2))
            data.append((10 * case + copy, "\n".join([*head, *passage, *tail])))
            want[10 * case + copy] = (len(passage), "\n".join([*head, *tail])) if copy else (0, data[-1][1])
    refrain = [line(10) for _ in range(2)] * 20
    data.append((1000, "\n".join(refrain)))
    data.append((1001, "\n".join(f"{k}" for k in range(300)) + "\n" + "\n" * 80 + "end"))
    data.append((1002, "first\n" + data[-1][1]))
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_chunks.deduplicated(d, runs=True).collect()}
    assert {k: got[k] for k in want} == want
    assert 0 < got[1000][0] < 40 and got[1000][1].startswith("\n".join(refrain[:5]))
    assert got[1001][0] == 0 and got[1002] == (381, "first")


def test_chunk_boundaries_resist_shifts(spark):
    rnd = random.Random(1)
    passage = "\n".join(prose(rnd, 12) for _ in range(40))
    d = spark.createDataFrame([(1, "head one\n" + passage), (2, "another head\nand more\n" + passage + "\ntail")], "doc_id long, text string")
    second = line_chunks.deduplicated(d).where("doc_id = 2").first()
    assert second.removed_lines >= 30 and second.text.startswith("another head")


def test_golay_and_hamming_are_perfect_covers():
    for code in (simhash_anchors.GOLAY, simhash_anchors.HAMMING):
        points = np.random.default_rng(1).integers(0, 1 << code.n, 500)
        bit, error = simhash_anchors._tables(code)
        assert max(bin(int(e)).count("1") for e in error) == code.radius
        near = simhash_anchors.anchor_of(code, points)
        for k in range(code.n):  # a neighbour's anchor is the same or another word's
            assert ((simhash_anchors.anchor_of(code, points ^ (1 << k)) == near).mean()) < 1
        assert len(np.unique(simhash_anchors.anchor_of(code, np.arange(1 << min(code.n, 15))))) <= 1 << (code.n - code.check_bits)


@pytest.mark.parametrize(("bands", "threshold"), [(simhash_anchors.WIDE, 2), (simhash_anchors.THREE, 8)])
def test_anchors_meet(bands, threshold):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    a, b = (simhash_anchors.anchors(v.view(np.int64), bands) for v in (x, y))
    meet = {(int(i), int(n)) for i, n in zip(*a)} & {(int(i), int(n)) for i, n in zip(*b)}
    assert {i for i, _ in meet} == set(range(300))


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not low:
        return 0
    grams = [b" ".join(low[i : i + 3]) for i in range(len(low) - 2)] or [b" ".join(low)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark, docs, none):
    got = simhash_anchors.near_components(docs).collect()
    assert len(got) == len(rows())
    text = {r[0]: r[1] for r in rows()}
    prints = {k: brute_fingerprint(t) for k, t in text.items()}
    for r in got:
        assert r.fingerprint & (1 << 64) - 1 == prints[r.doc_id]
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in keys:
        least[find(k)] += [k] if k is not None else []
    for r in got:
        assert r.component_id == min(least[find(r.doc_id)], default=None)
    assert simhash_anchors.near_components(none).count() == 0


def test_similar_groups_against_brute_force(spark, none):
    rnd = random.Random(11)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    data = []
    for k in range(12):
        base = [rnd.choice(vocabulary) for _ in range(200)]
        for v in range(4):
            words = list(base)
            for _ in range(v * 2):
                words[rnd.randrange(200)] = rnd.choice(vocabulary)
            data.append((4 * k + v, " ".join(words)))
    data += [(100, None), (101, ""), (102, " "), (103, data[0][1]), (103, data[0][1]), (None, data[5][1]), (104, "two words"), (105, "two  words")]
    d = spark.createDataFrame(data, "doc_id long, text string")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    got = {(r.doc_id, r.node): r.group_id for r in simhash_anchors.similar_groups(d).collect()}
    by_id = {i: g for (i, _), g in got.items()}
    want = met = 0
    for i, (a, x) in enumerate(data):
        for b, y in data[:i]:
            gx, gy = grams(x), grams(y)
            if a is not None and b is not None and len(gx & gy) >= 0.8 * len(gx | gy):
                want += 1
                met += by_id[a] == by_id[b]
    assert met >= 0.95 * want  # fingerprints of similar texts may differ in more bits
    assert all(g is None or g // 4 == i // 4 for i, g in by_id.items() if i is not None and i < 48)
    assert by_id[101] == by_id[102] == by_id[100]
    kept = simhash_anchors.one_of_each(d)
    groups = len(set(by_id.values()))
    assert kept.count() == groups and kept.columns == d.columns
    assert simhash_anchors.one_of_each(none).count() == 0


def test_similar_groups_with_blocks_changed(spark):
    rnd = random.Random(21)
    data, want = [], set()

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    def fresh(n):
        return [f"w{rnd.getrandbits(40):x}" for _ in range(n)]

    for k in range(60):
        n = rnd.choice([20, 60, 300, 1000])
        base = fresh(n)
        share = 0.18 + 0.04 * rnd.random()
        if k % 2:
            other = base + fresh(int(n * share))
        else:
            cut = max(1, int(n * share / 2) - 4)
            at = rnd.randrange(n - cut)
            other = base[:at] + fresh(cut) + base[at + cut :]
        a, b = grams(base), grams(other)
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * k)
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash_anchors.similar_groups(d).collect()}
    assert len(want) > 40
    assert {k for k in range(0, 120, 2) if got[k + 1] == k} == want


def test_dense_groups_emit_no_pairs(spark):
    rnd = random.Random(2)
    nodes = [rnd.getrandbits(3) | 5 << 20 | k << 40 for k in range(400)]
    v = spark.createDataFrame([(1, n) for n in set(nodes)], "anchor long, node long")
    got = linked(crowded(v), lambda x, y: F.lit(True)).select("component").distinct().collect()
    assert [r[0] for r in got] == [min(nodes)]


def test_links_that_only_few_anchors_show(spark):
    """Chains whose neighbours share one anchor of many, among anchors that link nothing."""
    rnd = random.Random(12)
    rows = [(1000 + k, n) for k in range(60) for n in (k, k + 1)] + [(5000 + rnd.randrange(12), n) for n in range(80) for _ in range(6)]
    v = spark.createDataFrame(rows, "anchor long, node long")
    got = {r.node: r.component for r in linked(crowded(v), lambda x, y: F.abs(F.col(f"{x}.node") - F.col(f"{y}.node")) <= 1).collect()}
    shared = {a: {n for m, n in rows if m == a} for a in {a for a, _ in rows}}
    parent = list(range(81))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for ns in shared.values():
        for n in ns:
            if n + 1 in ns:
                x, y = sorted((find(n), find(n + 1)))
                parent[y] = x
    assert all(got.get(n, n) == find(n) for n in range(81))


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    parent = list(range(1000))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: find(k) for e in edges for k in e if e[0] != e[1]}
    assert got == want


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing_meets_targets(spark, docs, none):
    out, sources = mixing.mixed(docs)
    got = out.collect()
    assert len(got) == len(rows())
    sizes = Counter()
    taken = Counter()
    for r in got:
        words = len((r.text or "").encode().split())
        assert r["size"] == words and 0 <= r.copies <= 2
        sizes[r.source] += words
        taken[r.source] += words * r.copies
    goal = brute_targets(sizes)
    largest = max(r["size"] for r in got)
    for s in sizes:
        assert sources[s][0] == sizes[s] and abs(sources[s][1] - goal[s]) < 1e-6
        assert abs(taken[s] - goal[s]) <= largest
    again = mixing.mixed(docs)[0].collect()
    assert sorted((str(r.doc_id), r.copies) for r in again) == sorted((str(r.doc_id), r.copies) for r in got)
    assert mixing.mixed(none)[0].count() == 0


def test_flow_prefers_fresh_words():
    got = mixing.routed({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 60})
    assert got == {("a",): 100, ("a", "b"): 70, ("b",): 10} or sum(got.values()) == 180
    assert all(got[p] <= n for p, n in {("a",): 100, ("a", "b"): 100, ("b",): 10}.items())
    assert mixing.routed({("a",): 10}, {"a": 20}) == {("a",): 20}


def test_the_bound_on_labels_counts_rows_that_are_learnt_from(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(0, 400, 8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality_rules_ensemble, "fit", lambda labelled, **how: fitted.extend(r.key for r in labelled.collect()))
    quality_rules_ensemble.learnt(docs, labels, F.col("doc_id") >= 80, rows=30)
    assert len(set(fitted)) == len(fitted) == 30 and all(k >= 80 and k % 8 == 0 for k in fitted)
    fitted.clear()
    quality_rules_ensemble.learnt(docs, labels, F.col("doc_id") >= 80, rows=1000)
    assert sorted(fitted) == list(range(80, 400, 8))


def test_pieces_equal_the_library(spark, docs, none):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    model = pieces.model_bytes(MODEL)
    got = pieces.encoded(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert list(r.ids) == sp.encode(r.text) and r.decoded == sp.decode(sp.encode(r.text))
    back = pieces.decoded(pieces.encoded(docs, model, decode=False), model).where("text is not null")
    assert back.where("decoded <> text").count() == 0
    assert pieces.encoded(none, model).count() == 0


def test_pieces_on_random_strings():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    machine = pieces.Transducer(pieces.model_bytes(MODEL))
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abc etnhi  \n\té中文字😀.,-0123456789的▁") for _ in range(rnd.randint(0, 90))) for _ in range(1500)]
    texts += [" " * k for k in range(40)] + ["a" * 500, "xyz" * 300, "\x00a"]
    for text, ids in zip(texts, machine.encode_all(texts), strict=True):
        assert ids.tolist() == sp.encode(text), text


def test_pieces_of_one_character():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    machine = pieces.Transducer(pieces.model_bytes(MODEL))
    single = [p for p in machine.pieces if len(p) == 1]
    assert sum(ord(c) > 0xFFFF for c in single) > 20
    for text in [t for c in single for t in (c, f"a {c} b", c + c, f"x{c}")] + ["\U0010ffff", "\U0001f600\U0010ffff"]:
        assert machine.encode(text).tolist() == sp.encode(text), text


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(k, data):
    return bytes([k << 3 | 2]) + varint(len(data)) + data


def test_unigram_models_take_the_best_path():
    import struct

    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -6.0, "▁a": -4.0, "ba": -4.2}
    model = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s)) for p, s in [("<unk>", 0.0), *scores.items()])
    model = model.replace(field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0), field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0))
    machine = pieces.Transducer(model + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01"))

    def best(text):
        table = [(0.0, [])] + [None] * len(text)
        for j in range(1, len(text) + 1):
            table[j] = min((table[i][0] - scores[text[i:j]], table[i][1] + [text[i:j]]) for i in range(j) if table[i] and text[i:j] in scores)
        return table[-1]

    for text in ("abab", "aabba", "bababa", "ab aba"):
        got = [machine.pieces[k] for k in machine.encode(text)]
        weight, _ = best("▁" + text.replace(" ", "▁"))
        assert "".join(got) == "▁" + text.replace(" ", "▁") and abs(-sum(scores[p] for p in got) - weight) < 1e-5


def test_charsmap_is_rewritten():
    spm = pytest.importorskip("sentencepiece")
    try:
        norm = spm.SentencePieceNormalizer(rule_name="nfkc")
        proto = norm.serialized_model_proto()
    except Exception:
        pytest.skip("no normaliser in this build")
    spec = next(v for k, v in pieces._fields(proto) if k == 3)
    charsmap = dict(pieces._fields(spec)).get(2, b"")
    rules = {k.decode(): v.decode() for k, v in pieces._rewrites(charsmap).items()}
    assert rules.get("Ａ") == "A" and rules.get("ﬁ") == "fi" and len(rules) > 1000


def test_languages(spark, docs, none):
    rnd = random.Random(4)
    tongue = {"aa": ["zra", "zro", "zrin", "zrek"], "bb": ["ulm", "ulp", "uldo", "ulnä"], "cc": ["kiik", "kaak", "kook", "kyyk"]}
    data = [(k, " ".join(rnd.choice(tongue[l]) + rnd.choice(tongue[l]) for _ in range(30)), l) for k in range(300) for l in [sorted(tongue)[k % 3]]]
    data += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ...", "bb"), (1003, "ÄÖÜ", None), (1004, "qqqqq", None), (None, data[0][1], None), data[7], data[7]]
    d = spark.createDataFrame([(*r, 1.5) for r in data], "doc_id long, text string, lang string, score double")
    got = language_masks.identified(d, fold("doc_id", 3) != 1).collect()
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == r.lang
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002}
    assert language_masks.identified(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_masks.identified(d, F.lit(False)).collect()} == {"und"}


def test_bloom_masks_have_no_false_negatives(spark):
    d = spark.createDataFrame([("the quick brown fox " * 20, "en"), ("der schnelle braune fuchs " * 20, "de")], "text string, lang string")
    f = language_masks.learn(d)
    for k, text in enumerate(["der schnelle braune fuchs ", "the quick brown fox "]):
        data = np.frombuffer((text * 20).encode(), np.uint8)
        code, ok = language_masks.codes(data, np.array([0, len(data)]))
        assert ((f.masks(code[ok]) >> k) & 1).all()


def brute_topk(data, k):
    whole = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = tuple(int(np.floor(64 * float(x))) for x in v)
            whole.setdefault(i, set()).add(w)
    out = []
    for q in whole:
        if q % 20 == 0:
            mine = min(whole[q])
            best = sorted((-sum(a * b for a, b in zip(mine, v)), c) for c in whole if c != q for v in whole[c] if len(v) == len(mine))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_topk_is_exact(spark, block):
    rng = np.random.default_rng(7)
    data = [(int(k), [float(x) for x in rng.integers(-3, 4, 8) / 2]) for k in range(260)]
    data += [(300, None), (301, [1.0] * 3), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [None] * 8), (305, []), (320, data[0][1]), data[40], (None, data[1][1]), (21, data[5][1]), (340, [2.0, -1.0, 0.0]), (360, [])]
    d = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, score string")

    def got(rows):
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top(rows, F.col("vec_id") % 20 == 0, 5, block_rows=block).collect())

    assert got(d) == brute_topk(data, 5)
    assert got(d.where("vec_id in (0, 1, 2)")) == brute_topk(data[:3], 5)
    assert got(d.limit(0)) == []


def test_topk_blocks_are_bound_by_components(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = [(k, [float(x) for x in rng.integers(-3, 4, 50)]) for k in range(120)] + [(200, [1.0] * 300), (201, [0.5] * 300)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for entries in (9000, 100):  # blocks of 30 rows; of one, as the longest vector is larger
        monkeypatch.setattr(exact_topk, "BLOCK_ENTRIES", entries)
        got = exact_topk.top(d, F.col("vec_id") % 40 == 0, 5)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == [x for x in brute_topk(data, 5) if x[0] % 40 == 0]


def test_topk_reads_fewer_entries_than_there_are():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    near = np.floor(64 * (centres[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 32)))).astype(np.int64)
    flat = np.floor(64 * rng.normal(size=(4000, 32))).astype(np.int64)
    for vectors, most in ((near, 0.6), (flat, 0.95)):
        lists = exact_topk.Lists(np.arange(4000), vectors)
        of, who, score = lists.best(vectors[:64], np.arange(64), 10)
        every = vectors[:64] @ vectors.T
        every[np.arange(64), np.arange(64)] = -(10**12)
        for j in range(64):
            best = np.lexsort((np.arange(4000), -every[j]))[:10]
            assert who[of == j].tolist() == best.tolist() and score[of == j].tolist() == every[j][best].tolist()
        assert 0 < lists.entries_read < most * 64 * vectors.size
