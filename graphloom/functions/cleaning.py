"""Cleaning and normalising of whole texts as column expressions.

White space is what Unicode calls so, in one pattern that Java and RE2 read alike. All but the
Unicode forms and title case (which need tables of characters, and get Arrow batches) stays
in the JVM. A null text gives null, an empty one stays empty."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = f"[{_WHITE}]"
EDGES = f"^{WHITE}+|{WHITE}+$"
TAG = "<[^>]+>"
#: Entities that become characters, in this order; all others go.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
OTHER_ENTITY = r"&#?[\p{L}\p{N}_]+;"
#: Typographic characters and what stands for them.
TYPOGRAPHIC = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}]"


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, EDGES, "")


def without_html(text: Column, *, lines: bool = False) -> Column:
    """Tags go (with `lines`, a line break stands for each and empty lines go), known entities
    become characters, others go."""
    out = F.regexp_replace(text, TAG, "\n" if lines else "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, OTHER_ENTITY, "")
    return without_empty_lines(out) if lines else out


def one_line(text: Column) -> Column:
    """Tabs and line breaks become spaces, of several spaces in a row one stays."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]+", " "), " +", " "))


def paragraphs(text: Column) -> Column:
    """Tabs and runs of spaces become one space, of white space lines between two line breaks
    one empty line stays."""
    out = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " +", " ")
    return trimmed(F.regexp_replace(out, f"\n{WHITE}*\n", "\n\n"))


def plain_characters(text: Column, *, spaces: bool = True, lines: bool = True) -> Column:
    """Letters a to z and digits alone; white space stays if both are allowed, else spaces."""
    kept = _WHITE if spaces and lines else " " if spaces else ""
    return F.regexp_replace(text, f"[^a-zA-Z0-9{kept}]", "")


def punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses as plain ones."""
    for char, plain in TYPOGRAPHIC:
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def line_breaks(text: Column, kind: str = "unix") -> Column:
    """All line breaks as those of one kind, unix or windows; each break stays one."""
    return F.regexp_replace(text, "\r\n|\r|\n", {"unix": "\n", "windows": "\r\n"}[kind])


def indented(text: Column, kind: str = "spaces") -> Column:
    """A tab is four spaces, or four spaces are a tab."""
    tab, spaces = F.lit("\t"), F.lit("    ")
    return {"spaces": F.replace(text, tab, spaces), "tabs": F.replace(text, spaces, tab)}[kind]


def without_empty_lines(text: Column) -> Column:
    """Trimmed, without the lines that hold white space alone."""
    return F.array_join(F.filter(F.split(trimmed(text), "\n", -1), lambda s: F.regexp_like(s, F.lit(f"[^{_WHITE}]"))), "\n")


def harmless(text: Column, *, data_urls: bool = False) -> Column:
    """Scripts, frames and script addresses go, embedded data's heads too if told so."""
    for element in ("script", "iframe"):
        text = F.regexp_replace(text, rf"(?is)<{element}[^>]*>.*?</{element}(?:{WHITE}[^>]*)?>", "")
    text = F.regexp_replace(text, "(?i)javascript:", "")
    return F.regexp_replace(text, "(?i)data:[^;]*;base64,", "") if data_urls else text


def visible(text: Column, *, whitespace: bool = False) -> Column:
    """Trimmed, white space as single spaces (or, if it is kept, empty lines dropped), then
    without characters of no width."""
    text = trimmed(text)
    text = F.regexp_replace(text, f"\n{WHITE}*\n", "\n") if whitespace else F.regexp_replace(text, f"{WHITE}+", " ")
    return F.regexp_replace(text, ZERO_WIDTH, "")


def _by_text(f):
    @F.pandas_udf("string")
    def batch(text: pd.Series) -> pd.Series:
        return text.map(f, na_action="ignore")

    return batch


def unicode_form(text: Column, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(f"not a Unicode form: {form}")
    return _by_text(lambda t: t if t.isascii() else unicodedata.normalize(form, t))(text)


def without_marks(text: Column) -> Column:
    """Letters without their diacritics: decomposed, marks of no width dropped."""

    def bare(t: str) -> str:
        return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    return _by_text(bare)(text)


def cased(text: Column, case: str) -> Column:
    """lower, upper, or title: the first letter of each run of letters large, others small."""
    if case == "title":
        return _by_text(str.title)(text)
    return {"lower": F.lower, "upper": F.upper, "preserve": lambda t: t}[case](text)


def formatted(text: Column, kind: str = "standard") -> Column:
    """standard: as `paragraphs`; compact: all white space runs are one space; preserve: trimmed."""
    if kind == "compact":
        text = F.regexp_replace(text, f"{WHITE}+", " ")
    return {"standard": paragraphs, "compact": trimmed, "preserve": trimmed}[kind](text)


def cleaned(text: Column, *, html: bool = True, whitespace: bool = True, form: str | None = "NFC", plain: bool = False, spaces: bool = True) -> Column:
    """In this order: tags and entities, Unicode form, white space, characters."""
    if html:
        text = without_html(text)
    if form:
        text = unicode_form(text, form)
    if whitespace:
        text = one_line(text)
    if plain:
        text = plain_characters(text, spaces=spaces, lines=False)
    return trimmed(text)


def normalised(text: Column, *, form: str = "NFC", case: str = "preserve", marks: bool = True, breaks: str = "unix") -> Column:
    """In this order: Unicode form, line breaks, white space, punctuation, diacritics (dropped
    unless `marks`), case."""
    text = punctuation(paragraphs(line_breaks(unicode_form(text, form))))
    text = cased(text if marks else without_marks(text), case)
    return trimmed(text if breaks == "unix" else line_breaks(text, breaks))
