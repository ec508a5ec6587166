"""What whole texts are written in, whom their pronouns stand for, and how they are cleaned."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import cleaning as C
from graphloom.functions import encodings as EN
from graphloom.functions import guards as GU
from graphloom.operators import languages as L
from graphloom.operators import references as RF
from graphloom.sources.tables import table

Q, S = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


# ---- languages -------------------------------------------------------------------------


def _grams_sql(rows: str, columns: str, text: str = "text") -> str:
    return f"SELECT {columns}, unnest(list_transform(range(1, len(cs) - 1), lambda i: cs[i] || cs[i + 1] || cs[i + 2])) AS gram FROM (SELECT {columns}, string_split(regexp_replace(' ' || lower({text}) || ' ', '[^\\p{{L}}]+', ' ', 'g'), '') AS cs FROM {rows})"


def _ranked_sql(rows: str, keys: str) -> str:
    return f"""WITH g AS ({_grams_sql('documents WHERE lang IS NOT NULL', 'lang')}), c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL),
z AS (SELECT lang, sum(n) AS size FROM c GROUP BY 1), v AS (SELECT count(DISTINCT gram) AS v FROM c),
w AS (SELECT gram, lang, round(1000 * ln((coalesce(n, 0) + 1) / (v + size)))::BIGINT AS w FROM (SELECT DISTINCT gram FROM c) CROSS JOIN z CROSS JOIN v LEFT JOIN c USING (gram, lang)),
t AS ({_grams_sql(f"{rows} WHERE length(trim(text, E' \\t\\n\\x0B\\f\\r')) >= 10", keys)}), n AS (SELECT {keys}, gram, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT {keys}, lang, sum(n * w)::BIGINT AS score, sum(n)::BIGINT AS n FROM n JOIN w USING (gram) GROUP BY ALL),
f AS (SELECT {keys}, lang, score, 1 / list_sum(list_transform(list(score) OVER (PARTITION BY {keys}), lambda o: exp((o - score) / (1000.0 * n)))) AS confidence, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, lang) AS rank FROM s)"""


@query("language_detected", f"{_ranked_sql('documents', 'doc_id')} SELECT doc_id, coalesce(f.lang, 'en') AS language, round(coalesce(confidence, 0.0::DOUBLE), 6) AS confidence FROM documents d LEFT JOIN (SELECT * FROM f WHERE rank = 1) f USING (doc_id)")
def _(spark, sf):
    """The language of each document, by profiles of all labelled documents."""
    docs = table(spark, sf, "documents")
    out = L.detected(docs, L.profile(docs), key="doc_id")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("language_ranked", f"{_ranked_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn, coalesce(f.rank, 1)::INTEGER AS rank, coalesce(f.lang, 'en') AS language, round(coalesce(confidence, 0.0::DOUBLE), 6) AS confidence FROM conversations c LEFT JOIN (SELECT * FROM f WHERE rank <= 3) f USING (conv_id, turn)")
def _(spark, sf):
    """The three likeliest languages of each turn of a conversation."""
    known = L.profile(table(spark, sf, "documents"))
    out = L.ranked(table(spark, sf, "conversations"), known, key=["conv_id", "turn"], top=3)
    return out.withColumn("confidence", F.round("confidence", 6))


# ---- pronouns --------------------------------------------------------------------------

NAMES = {"NAME": r"(?<!\p{L})\p{Lu}\p{Ll}{2,}(?!\p{L})", "NUMBER": "[0-9]{3,}"}
SUITS = {"he": ("NAME",), "him": ("NAME",), "his": ("NAME",), "she": ("NAME",), "her": ("NAME",), "it": ("NUMBER",), "its": ("NUMBER",), "they": ("NAME", "NUMBER"), "them": ("NAME", "NUMBER"), "their": ("NAME", "NUMBER")}
_PRONOUNS = ", ".join(f"'{p}'" for p in SUITS)


def _tokens_sql(p: str) -> str:
    return f"SELECT doc_id, e, stop - length(e) AS start, stop FROM (SELECT doc_id, e, sum(length(g) + length(e)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (SELECT doc_id, unnest(e) AS e, unnest(g[1:len(e)]) AS g, generate_subscripts(e, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS e, regexp_split_to_array(text, '{p}') AS g FROM documents)))"


_RESOLVED = rf"""m AS (SELECT *, CASE WHEN lower(e) IN ({_PRONOUNS}) THEN 'pronoun' ELSE 'NAME' END AS label FROM ({_tokens_sql('[\\p{L}]+')}) WHERE lower(e) IN ({_PRONOUNS}) OR regexp_full_match(e, '\p{{Lu}}\p{{Ll}}{{2,}}') UNION ALL SELECT *, 'NUMBER' FROM ({_tokens_sql('[0-9]{3,}')})),
x AS (SELECT *, label = 'pronoun' AS p, CASE WHEN label = 'pronoun' THEN start ELSE stop END AS place, CASE WHEN label <> 'pronoun' THEN {{'e': e, 'start': start}} END AS it FROM m),
y AS (SELECT *, last_value(it IGNORE NULLS) OVER w AS any_, last_value(CASE WHEN label = 'NAME' THEN it END IGNORE NULLS) OVER w AS name_, last_value(CASE WHEN label = 'NUMBER' THEN it END IGNORE NULLS) OVER w AS number_ FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY place, p DESC, start DESC, label DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN p THEN CASE WHEN lower(e) IN ('it', 'its') THEN coalesce(number_, any_) WHEN lower(e) IN ('they', 'them', 'their') THEN any_ ELSE coalesce(name_, any_) END END AS a FROM y)"""


def _resolved(spark, sf):
    rows = RF.placed(table(spark, sf, "documents"), key="doc_id", patterns=NAMES, suits=SUITS)
    return RF.resolved(rows, key="doc_id", suits=SUITS)


@query("coreference_pronouns", f"WITH {_RESOLVED} SELECT doc_id, e AS pronoun, CAST(start AS INTEGER) AS start, a.e AS antecedent, CAST(a.start AS INTEGER) AS antecedent_start FROM r WHERE p")
def _(spark, sf):
    """Each pronoun of each document, and the name or number that it stands for."""
    rows = _resolved(spark, sf).where(F.col("label") == RF.PRONOUN)
    return rows.select("doc_id", F.col("entity").alias("pronoun"), "start", F.col("antecedent.entity").alias("antecedent"), F.col("antecedent.start").alias("antecedent_start"))


@query("coreference_chains", f"WITH {_RESOLVED} SELECT doc_id, lower(CASE WHEN p THEN a.e ELSE e END) AS entity, arg_min(e, start) FILTER (WHERE NOT p) AS representative, arg_min(label, start) FILTER (WHERE NOT p) AS label, CAST(min(start) FILTER (WHERE NOT p) AS INTEGER) AS first, CAST(max(stop) AS INTEGER) AS last, count(*) AS mentions, count(*) FILTER (WHERE p) AS pronouns FROM r WHERE NOT p OR a IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    """The names and numbers that a document speaks of more than once, pronouns included."""
    return RF.chains(_resolved(spark, sf), key="doc_id")


# ---- cleaning --------------------------------------------------------------------------


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '{C.EDGES}', '', 'g')"


def _html_sql(x: str) -> str:
    out = f"regexp_replace({x}, '{C.TAG}', '', 'g')"
    for entity, char in C.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({out}, '{C.OTHER_ENTITY}', '', 'g')"


def _line_sql(x: str) -> str:
    return _trim_sql(f"regexp_replace(regexp_replace({x}, '[\\t\\n\\r]+', ' ', 'g'), ' +', ' ', 'g')")


def _paragraphs_sql(x: str) -> str:
    return _trim_sql(f"regexp_replace(regexp_replace(replace({x}, chr(9), ' '), ' +', ' ', 'g'), '\\n{C.WHITE}*\\n', chr(10) || chr(10), 'g')")


def _punctuation_sql(x: str) -> str:
    for char, plain in C.TYPOGRAPHIC:
        x = f"replace({x}, '{char}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


_PAGE = _trim_sql(_line_sql(f"nfc_normalize({_html_sql('html')})"))


@query("text_pages_cleaned", f"SELECT page_id, md5(c) AS digest, length(c)::INTEGER AS n_chars, md5(regexp_replace(c, '[^a-zA-Z0-9 ]', '', 'g')) AS plain FROM (SELECT page_id, {_PAGE} AS c FROM pages)")
def _(spark, sf):
    """Pages without tags, entities and line breaks, and their letters and digits alone."""
    c = table(spark, sf, "pages").select("page_id", C.cleaned(F.col("html")).alias("c"))
    return c.select("page_id", F.md5("c").alias("digest"), F.length("c").alias("n_chars"), F.md5(C.plain_characters(F.col("c"), lines=False)).alias("plain"))


_BREAKS = "regexp_replace(nfc_normalize(text), '\\r\\n|\\r', chr(10), 'g')"


@query("text_normalised", f"SELECT doc_id, md5({_trim_sql(f'lower(strip_accents({_punctuation_sql(_paragraphs_sql(_BREAKS))}))')}) AS digest, md5({_trim_sql(f'''regexp_replace(text, '{C.WHITE}+', ' ', 'g')''')}) AS compact FROM documents")
def _(spark, sf):
    """Documents in one Unicode form and case, without diacritics, and in compact format."""
    text = F.col("text")
    norm = C.normalised(text, case="lower", marks=False)
    return table(spark, sf, "documents").select("doc_id", F.md5(norm).alias("digest"), F.md5(C.formatted(text, "compact")).alias("compact"))


_WIDE = "[^\\x{0}-\\x{ff}]"


@query("encoding_detected", f"""WITH d AS (SELECT doc_id, text, doc_id % 6 AS k, regexp_matches(text, '[^\\x{{1}}-\\x{{7f}}]') AS high, regexp_matches(text, '{_WIDE}') AS wide, regexp_matches(text, '[\\x{{80}}-\\x{{9f}}]') AS control FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN k = 0 THEN 'utf-8' WHEN k IN (1, 2) THEN CASE k WHEN 1 THEN 'utf-16-le' ELSE 'utf-16-be' END WHEN k = 3 THEN 'utf-16-le' WHEN NOT high THEN 'ascii' WHEN k = 4 OR wide THEN 'utf-8' WHEN control THEN 'windows-1252' ELSE 'iso-8859-1' END AS encoding, md5(text) AS digest FROM d""")
def _(spark, sf):
    """Documents as bytes of several encodings: which one it is, and the text again."""
    docs = table(spark, sf, "documents").where("text <> ''")
    text, k = F.col("text"), F.col("doc_id") % 6

    def marked(mark: str, encoding: str):
        return F.concat(F.unhex(F.lit(mark)), F.encode(text, encoding))

    narrow = (k == 5) & ~F.regexp_like(text, F.lit(_WIDE))
    data = F.when(k == 0, marked("EFBBBF", "UTF-8")).when(k == 1, marked("FFFE", "UTF-16LE")).when(k == 2, marked("FEFF", "UTF-16BE")).when(k == 3, F.encode(text, "UTF-16LE")).when(narrow, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    read = docs.select("doc_id", data.alias("data")).select("doc_id", "data", EN.detected(F.col("data")).alias("e"))
    return read.select("doc_id", F.col("e.encoding").alias("encoding"), F.md5(EN.as_text(F.col("data"), F.col("e.encoding"))).alias("digest"))


# ---- guards ----------------------------------------------------------------------------

_GUARDS = (("email", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"), ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"), ("phone", r"\b[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}\b"), ("credit_card", r"\b(?:[0-9][ -]?){12,15}[0-9](?:[ -]\b|[ -]([\p{L}\p{N}])|\b)"))  # boundaries of RE2 know ASCII only: a letter behind is matched and put back


def _guards_sql(rows: str, columns: str) -> str:
    steps, before = [f"g0 AS (SELECT {columns}, text, {', '.join(f'0 AS {kind}' for kind, _ in _GUARDS)} FROM {rows})"], "g0"
    for k, (kind, pattern) in enumerate(_GUARDS, 1):
        steps.append(f"g{k} AS (SELECT * REPLACE (regexp_replace(text, '{pattern}', '[redacted:{kind}]{chr(92) + '1' if kind == 'credit_card' else ''}', 'g') AS text, len(regexp_extract_all(text, '{pattern}'))::INTEGER AS {kind}) FROM {before})")
        before = f"g{k}"
    return f"WITH {', '.join(steps)}"


_TERMS = ("license", "benchmark", "password")


@query("text_redacted", f"{_guards_sql('documents', 'doc_id')} SELECT doc_id, md5(text) AS digest, {', '.join(kind for kind, _ in _GUARDS)} FROM g{len(_GUARDS)}")
def _(spark, sf):
    """Documents with private data replaced by its kind, and how much there was of each."""
    r = table(spark, sf, "documents").select("doc_id", GU.redacted(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r.text").alias("digest"), *[F.col(f"r.{kind}").alias(kind) for kind, _ in GU.PRIVATE])


@query("text_guarded", f"{_guards_sql('documents', 'doc_id')} SELECT doc_id, {' + '.join(kind for kind, _ in _GUARDS)} AS redactions, coalesce(term IS NOT NULL, false) AS blocked, term FROM (SELECT *, CASE {' '.join(f'''WHEN contains(lower(text), '{t}') THEN '{t}' ''' for t in _TERMS)} END AS term FROM g{len(_GUARDS)})")
def _(spark, sf):
    """Documents that guards stop, by which term, after private data has gone."""
    r = table(spark, sf, "documents").select("doc_id", GU.guarded(F.col("text"), terms=_TERMS).alias("r"))
    return r.select("doc_id", "r.redactions", "r.blocked", "r.term")
