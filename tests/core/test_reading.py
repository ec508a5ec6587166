"""Languages, pronouns, cleaning and encodings against plain Python."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.functions import cleaning as C
from graphloom.functions import encodings as EN
from graphloom.operators import languages as L
from graphloom.operators import references as RF
from graphloom.sources.tables import table

SF = "/root/testdata/sf0.001"

# ---- languages -------------------------------------------------------------------------


def grams(text):
    plain = re.sub(r"[^a-zà-öø-ÿß𐐀-𐑏]+", " ", f" {text.lower()} ")
    return Counter(plain[i : i + 3] for i in range(len(plain) - 2))


def brute_ranked(train, texts):
    counts = {}
    for text, lang in train:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    known = set().union(*counts.values())
    size = {lang: c.total() for lang, c in counts.items()}
    out = {}
    for key, text in texts:
        have = {g: n for g, n in grams(text or "").items() if g in known}
        n = sum(have.values())
        if len((text or "").strip()) < 10 or not n:
            out[key] = [("en", 0.0)]
            continue
        score = {lang: sum(k * round(1000 * math.log((c[g] + 1) / (len(known) + size[lang]))) for g, k in have.items()) for lang, c in counts.items()}
        out[key] = [(lang, 1 / sum(math.exp((o - s) / (1000 * n)) for o in score.values())) for lang, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))]
    return out


def test_languages_equal_brute_force(spark):
    train = [("der die das und ist nicht größer", "de"), ("the and of that is not larger", "en"), ("le la les des est pas plus grand", "fr"), (None, "fr"), ("que los", None), ("the the the", "en"), ("", "de")]
    texts = [(0, "das ist größer und schön"), (1, "that is the larger house"), (2, "kurz"), (3, None), (4, ""), (5, "12345 67890 !!!"), (6, "плюс минус равно"), (7, "the 😀 and 𐐀𐐁𐐂 of"), (8, "   the \n\n "), (9, "les the der " * 2000)]
    known = L.profile(spark.createDataFrame(train, "text string, lang string"))
    got = {}
    for r in L.ranked(spark.createDataFrame(texts, "id long, text string"), known, key="id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.language, r.confidence))
    want = brute_ranked(train, texts)
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert [x for x, _ in got[k]] == [x for x, _ in w], k
        assert [c for _, c in got[k]] == pytest.approx([c for _, c in w]), k
    sure = L.detected(spark.createDataFrame(texts, "id long, text string"), known, key="id", min_confidence=0.99, default="xx")
    assert {r.language for r in sure.collect()} == {"xx"}
    is_german = {r.id: r.matches for r in L.is_language(spark.createDataFrame(texts, "id long, text string"), known, "de", key="id", min_confidence=0.1).collect()}
    assert is_german[0] and not is_german[1] and not is_german[3]


def test_no_labelled_rows_give_the_default(spark):
    none = L.profile(spark.createDataFrame([], "text string, lang string"))
    got = L.detected(spark.createDataFrame([(1, "whatever it may be"), (2, None)], "id long, text string"), none, key="id", default="de").collect()
    assert {(r.id, r.language, r.confidence) for r in got} == {(1, "de", 0.0), (2, "de", 0.0)}


def test_languages_of_texts_not_learnt_from(spark):
    docs = table(spark, SF, "documents")
    known = L.profile(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND length(text) > 40")
    told = L.detected(rest, known, key="doc_id").join(rest.select("doc_id", "lang"), "doc_id").select((F.col("language") == F.col("lang")).cast("int").alias("right"))
    assert told.agg(F.avg("right")).first()[0] > 0.97


# ---- pronouns --------------------------------------------------------------------------

PATTERNS = {"PERSON": "[A-Z][a-z]{2,}", "DATE": "[0-9]{4,}", "ORG": "[A-Z][a-z]{2,} Inc"}


def brute_mentions(text):
    found = [(m.start(), m.end(), label, m.group()) for label, p in PATTERNS.items() for m in re.finditer(p, text)]
    found = [m for m in found if m[3].lower() not in RF.SUITS]
    return found, [(m.start(), m.end(), "pronoun", m.group()) for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in RF.SUITS]


def brute_resolved(text):
    names, pronouns = brute_mentions(text)
    out = []
    for p in pronouns:
        before = [m for m in names if m[1] < p[0]]
        fit = [m for m in before if m[2] in RF.SUITS[p[3].lower()]] or before
        out.append((p, min(fit, key=lambda m: (-m[1], m[0], m[2])) if fit else None))
    return names, out


def some_texts():
    rnd = random.Random(3)
    words = ["Alan", "Berta", "4711", "2024", "Acme Inc", "he", "She", "ITS", "their", "they", "them", "works", "über", "hé", "the", "😀", "\n", ".", "They"]
    return [None, "", "he", "Alan he", "Alanhe", "Alan.he", "Alan,  she", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150))) for _ in range(30)]]


def test_pronouns_and_chains_equal_brute_force(spark):
    rows = list(enumerate(some_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    resolved = RF.resolved(RF.placed(docs, key="doc_id", patterns=PATTERNS), key="doc_id")
    got = {(r.doc_id, r.start, r.stop, r.label, r.entity, r.antecedent and (r.antecedent.start, r.antecedent.stop, r.antecedent.label, r.antecedent.entity)) for r in resolved.collect()}
    want, chains = set(), {}
    for d, t in rows:
        names, pronouns = brute_resolved(t or "")
        want |= {(d, *m, None) for m in names} | {(d, *p, a) for p, a in pronouns}
        for m in names:
            chains.setdefault((d, m[3].lower()), []).append((m, False))
        for p, a in pronouns:
            if a:
                chains.setdefault((d, a[3].lower()), []).append((p, True))
    assert got == want
    for r in RF.chains(resolved, key="doc_id").collect():
        members = chains.pop((r.doc_id, r.entity))
        first = min((m[0], m[2], m[3]) for m, p in members if not p)
        assert (r.first, r.label, r.representative, r.last, r.mentions, r.pronouns) == (*first, max(m[1] for m, _ in members), len(members), sum(p for _, p in members))
    assert all(len(m) == 1 for m in chains.values())


# ---- cleaning --------------------------------------------------------------------------

AWKWARD = [
    None, "", " ", "  x　", "a\t\tb \r\n  c\n\n \n\nd", "<p>Tom &amp;amp; &lt;b&gt; &nbsp; &#39;x&#39; &copy; &#233; & Co;</p>\n<br/>\n<i>last</i>",
    "“Quoted” – ‘so’ — and…", "Amélie Zürich ﬁne Ångström ß 😀", "they're BILL'S o'neil", "﻿zero​width‍", "    four\tone", "<SCRIPT x>\nbad()</script >ok<iframe src='javascript:x'></iframe> JavaScript:y data:image/png;base64,AAA",
    "x" * 100_000 + "  \t" + "é" * 50_000, "line\x0bvertical\x1cfile\x85next",
]


def py_html(t):
    t = re.sub(r"<[^>]+>", "", t)
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        t = t.replace(entity, char)
    return re.sub(r"&#?\w+;", "", t)


def py_line(t):
    return re.sub(r" +", " ", re.sub(r"[\t\n\r]+", " ", t)).strip()


def py_paragraphs(t):
    return re.sub(r"\n\s*\n", "\n\n", re.sub(r" +", " ", t.replace("\t", " "))).strip()


def py_plain(t):
    for a, b in (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "...")):
        t = t.replace(a, b)
    return t


def py_marks(t):
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


def py_visible(t):
    return re.sub("[​-‍﻿]", "", re.sub(r"\s+", " ", t.strip()))


CASES = {
    "trimmed": (C.trimmed, str.strip),
    "html": (C.without_html, py_html),
    "line": (C.one_line, py_line),
    "paragraphs": (C.paragraphs, py_paragraphs),
    "plain": (C.plain_characters, lambda t: re.sub(r"[^a-zA-Z0-9\s]", "", t)),
    "plain_spaces": (lambda c: C.plain_characters(c, lines=False), lambda t: re.sub(r"[^a-zA-Z0-9 ]", "", t)),
    "plain_none": (lambda c: C.plain_characters(c, spaces=False), lambda t: re.sub(r"[^a-zA-Z0-9]", "", t)),
    "punctuation": (C.punctuation, py_plain),
    "unix": (C.line_breaks, lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
    "windows": (lambda c: C.line_breaks(c, "windows"), lambda t: t.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "\r\n")),
    "spaces": (C.indented, lambda t: t.replace("\t", "    ")),
    "tabs": (lambda c: C.indented(c, "tabs"), lambda t: t.replace("    ", "\t")),
    "empty_lines": (C.without_empty_lines, lambda t: "\n".join(s for s in t.strip().split("\n") if s.strip())),
    "visible": (C.visible, py_visible),
    "kept": (lambda c: C.visible(c, whitespace=True), lambda t: re.sub("[​-‍﻿]", "", re.sub(r"\n\s*\n", "\n", t.strip()))),
    "marks": (C.without_marks, py_marks),
    "title": (lambda c: C.cased(c, "title"), str.title),
    "compact": (lambda c: C.formatted(c, "compact"), lambda t: re.sub(r"\s+", " ", t).strip()),
    "preserve": (lambda c: C.formatted(c, "preserve"), str.strip),
    "cleaned": (lambda c: C.cleaned(c, plain=True), lambda t: re.sub(r"[^a-zA-Z0-9 ]", "", py_line(unicodedata.normalize("NFC", py_html(t)))).strip()),
    "normalised": (lambda c: C.normalised(c, marks=False, case="title"), lambda t: py_marks(py_plain(py_paragraphs(unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")))).title().strip()),
    **{form: (lambda c, form=form: C.unicode_form(c, form), lambda t, form=form: unicodedata.normalize(form, t)) for form in C.FORMS},
}


def test_cleaning_equals_python(spark):
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "id long, t string")
    got = {r.id: r for r in rows.select("id", *[f(F.col("t")).alias(name) for name, (f, _) in CASES.items()]).collect()}
    for k, t in enumerate(AWKWARD):
        for name, (_, want) in CASES.items():
            assert got[k][name] == (None if t is None else want(t)), (name, (t or "")[:60])


def test_harmless_and_lines_of_html(spark):
    rows = spark.createDataFrame([(AWKWARD[11],), (None,)], "t string")
    got = rows.select(C.harmless(F.col("t")).alias("a"), C.harmless(F.col("t"), data_urls=True).alias("b"), C.without_html(F.lit("<p>one</p> <p> </p><b>two</b>"), lines=True).alias("c")).collect()
    assert got[0].a == "ok y data:image/png;base64,AAA" and got[0].b == "ok y AAA" and got[0].c == "one\ntwo"
    assert got[1].a is None and got[1].b is None
    with pytest.raises(ValueError):
        C.unicode_form(F.col("t"), "NFX")


# ---- encodings -------------------------------------------------------------------------


def test_encodings(spark):
    text = "Größe naïve café 12"
    cases = [
        (None, None, None), (b"", "utf-8", ""), (b"plain", "ascii", "plain"), (text.encode(), "utf-8", text), (b"\xef\xbb\xbf" + text.encode(), "utf-8", text), (b"\xef\xbb\xbf", "utf-8", ""),
        (b"\xff\xfe" + text.encode("utf-16-le"), "utf-16-le", text), (b"\xfe\xff" + text.encode("utf-16-be"), "utf-16-be", text), (b"\xff\xfe\x00\x00" + text.encode("utf-32-le"), "utf-32-le", text),
        (text.encode("utf-16-le"), "utf-16-le", text), (text.encode("utf-16-be"), "utf-16-be", text), (text.encode("latin-1"), "iso-8859-1", text), ("“é”".encode("cp1252"), "windows-1252", "“é”"),
        (text.encode() * 5000, "utf-8", text * 5000), ("日本".encode(), "utf-8", "日本"),
    ]
    rows = spark.createDataFrame([(k, d) for k, (d, _, _) in enumerate(cases)], "id int, d binary")
    d = F.col("d")
    got = {r.id: r for r in rows.select("id", EN.detected(d).alias("e"), EN.as_text(d).alias("t"), EN.without_mark(d).alias("w"), EN.is_valid(d, "utf-8").alias("u"), EN.is_valid(d, "utf-16-le").alias("v")).collect()}
    for k, (data, encoding, plain) in enumerate(cases):
        r = got[k]
        assert (r.e.encoding, r.t) == (encoding, plain), k
        if data is None:
            assert r.w is None and r.u is None and r.v is None
            continue
        assert 0 <= r.e.confidence <= 1
        bare = data[3:] if data[:3] == b"\xef\xbb\xbf" else data[2:] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data
        assert bytes(r.w) == bare

        def valid(encoding, data=data):
            try:
                data.decode(encoding)
                return True
            except UnicodeDecodeError:
                return False

        assert (r.u, r.v) == (valid("utf-8"), valid("utf-16-le")), k


# ---- guards ----------------------------------------------------------------------------

PRIVATE = (("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"), ("phone", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"), ("credit_card", r"\b(?:\d[ -]?){13,16}\b"))


def test_guards_equal_python(spark):
    from graphloom.functions import guards as GU

    texts = [
        None, "", "write a.b+c@d-e.fg. or ä@ö.ü", "a@b.c+x@y.z a@b.c@d.e", "@x.y x@y x@.z", "123-45-6789 1123-45-67890 é123-45-6789 x_123-45-6789", "555-123-4567 555.123 4567 555 123\n4567",
        "4111 1111 1111 1111 next 4111-1111-1111-1111, 12345678901234567890", "A Bomb and malWARE, me@x.org", "x" * 200_000 + "@y.z", "a.b" * 3000, "1 " * 3000,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    t = F.col("t")
    got = {r.id: r for r in rows.select("id", GU.redacted(t).alias("r"), GU.guarded(t).alias("g"), GU.guarded(t, private=False, terms=" NEXT, ,or ").alias("o"), GU.guarded(t, terms=None).alias("n")).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        if text is None:
            assert r.r.text is None and r.r.redactions is None and not r.g.blocked and r.g.term is None
            continue
        left, counts = text, {}
        for kind, pattern in PRIVATE:
            left, counts[kind] = re.subn(pattern, f"[redacted:{kind}]", left)
        assert (r.r.text, {kind: r.r[kind] for kind in counts}, r.r.redactions) == (left, counts, sum(counts.values())), text[:80]
        term = next((x for x in ("bomb", "weapon", "malware", "ransomware") if x in left.lower()), None)
        assert (r.g.text, r.g.redactions, r.g.blocked, r.g.term) == (left, sum(counts.values()), term is not None, term)
        other = next((x for x in ("next", "or") if x in text.lower()), None)
        assert (r.o.text, r.o.redactions, r.o.term) == (text, 0, other) and not r.n.blocked
