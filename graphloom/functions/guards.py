"""Guards over whole texts: private data replaced by its kind, and blocked terms.

Kinds are replaced one after the other, so a kind is counted in the text that the kinds before
it have left. A null text gives null fields, and is not blocked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of private data in their order, and the terms that are blocked if no
# others are given. Classes are those of Unicode.
PRIVATE = (
    # an address can only begin where its run of characters does: time stays linear in the run
    ("email", r"(?U)(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+\.[\w.-]+"),
    ("ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", r"(?U)\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"),
    ("credit_card", r"(?U)\b(?:\d[ -]?){13,16}\b"),
)
BLOCKED = ("bomb", "weapon", "malware", "ransomware")


def redacted(text: Column) -> Column:
    """struct<text, redactions, and a count of each kind>."""
    def replaced(kind: str, pattern: str):
        return lambda s: s.withField(kind, F.regexp_count(s["text"], F.lit(pattern))).withField("text", F.regexp_replace(s["text"], pattern, f"[redacted:{kind}]"))

    out = F.array(F.struct(text.alias("text")))
    for kind, pattern in PRIVATE:
        # an array of one binds a step's text to a name, so that it is computed once
        out = F.transform(out, replaced(kind, pattern))
    first, *others = [kind for kind, _ in PRIVATE]
    return F.transform(out, lambda s: s.withField("redactions", sum((s[kind] for kind in others), s[first])))[0]


def blocking_term(text: Column, terms: Sequence[str] | str = BLOCKED) -> Column:
    """The first of the terms (also as a text, parted by commas) that stands in the text, in any
    case; else null. Without any term the usual ones count."""
    parts = terms.split(",") if isinstance(terms, str) else terms
    known = [t for t in (p.strip().lower() for p in parts) if t] or list(BLOCKED)
    return F.get(F.filter(F.array(*map(F.lit, known)), lambda t: F.contains(F.lower(text), t)), F.lit(0))


def guarded(text: Column, *, private: bool = True, terms: Sequence[str] | str | None = BLOCKED) -> Column:
    """struct<text, redactions, blocked, term>: what comes through the guards. Terms are looked
    for in what is left of the text; None: no term is blocked."""
    first = redacted(text) if private else F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("redactions"))

    def judged(s: Column) -> Column:
        term = F.lit(None).cast("string") if terms is None else blocking_term(s["text"], terms)
        return F.struct(s["text"].alias("text"), s["redactions"].alias("redactions"), term.isNotNull().alias("blocked"), term.alias("term"))

    return F.transform(F.array(first), judged)[0]
