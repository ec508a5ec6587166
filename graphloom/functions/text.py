"""Text cleaning, masking, normalising and pattern extraction as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns are RE2 and Java alike, so that plain SQL gives the same rows.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
LONG_NUMBER = r"\b[0-9]{13,19}\b"
TAG = r"<[^>]*>"
SCRIPT = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
CAPITALISED = r"[A-Z][a-z]+ [A-Z][a-z]+"
YEAR = r"\b(19|20)[0-9]{2}\b"


def masked(text: Column) -> Column:
    """Mail addresses, IPv4 addresses and card-like numbers replaced by their kinds."""
    out = F.regexp_replace(text, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, IPV4, "[IP]")
    return F.regexp_replace(out, LONG_NUMBER, "[NUMBER]")


def without_tags(html: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go; white space is one space."""
    out = F.regexp_replace(F.regexp_replace(html, SCRIPT, " "), COMMENT, " ")
    out = F.regexp_replace(out, TAG, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0B]+", " "))


def between(html: Column, tag: str) -> Column:
    """Content of the first element of a kind, or null."""
    got = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.nullif(got, F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def number(text: Column) -> Column:
    """1,234.5 / $1.2M / 45% / 3e4 as a double, else null."""
    t = F.upper(F.trim(F.regexp_replace(text, r"[$€£,\s]", "")))
    scale = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).when(t.endswith("%"), 0.01).otherwise(1.0)
    return F.regexp_replace(t, r"[KMB%]$", "").try_cast("double") * scale


#: Factors to the base unit of each dimension (metre, kilogram, second).
UNITS = {
    "m": ("length", 1.0), "km": ("length", 1000.0), "cm": ("length", 0.01), "mi": ("length", 1609.344), "ft": ("length", 0.3048), "in": ("length", 0.0254),
    "kg": ("mass", 1.0), "g": ("mass", 0.001), "lb": ("mass", 0.45359237), "oz": ("mass", 0.028349523125),
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0),
}


def converted(value: Column, source: str, target: str) -> Column:
    (a, x), (b, y) = UNITS[source], UNITS[target]
    if a != b:
        raise ValueError(f"{source} and {target} measure different things")
    return value * (x / y)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(text: Column, size: int) -> Column:
    """The text in blocks of `size` characters, by one pass: to reach a place of a text takes as
    long as the text before it, to reach a block does not."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _window(blocks: Column, size: int, start: Column) -> Column:
    """`size` characters from start on, of a text in blocks of that size."""
    k = F.floor(start / size).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))
    return F.substr(two, start - k * size + 1, F.lit(size))


def _folded(items: Column, state: dict[str, Column], out: str, step: Callable[[Column, Column], Column]) -> Column:
    """struct<s, outs>: a fold whose steps append to the field `out` (of that type) of their
    state; outs holds all that was appended. What was appended moves on every FOLD items, so
    a step copies that many at most, not all so far."""
    empty = F.array().cast(out)

    def cleared(s: Column | None) -> Column:
        return F.struct(*[(v if s is None else s[k]).alias(k) for k, v in state.items()], empty.alias("out"))

    def group(now: Column, k: Column) -> Column:
        some = F.aggregate(F.slice(items, k * FOLD + 1, F.lit(FOLD)), now["s"], step)
        return _bound(some, lambda s: F.struct(cleared(s).alias("s"), F.array_append(now["outs"], s["out"]).alias("outs")))

    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / FOLD).cast("int") - 1, F.lit(0)))
    zero = F.struct(cleared(None).alias("s"), F.array().cast(f"array<{out}>").alias("outs"))
    return F.aggregate(groups, zero, group, lambda x: F.struct(x["s"].alias("s"), F.flatten(x["outs"]).alias("outs")))


def chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """array<struct<start, chunk>> of character windows; the last one ends with the text."""
    step = size - overlap

    def of(t: Column) -> Column:
        n = F.greatest(F.ceil((F.length(t) - overlap) / step), F.lit(1)).cast("int")
        return _bound(_blocks(t, size), lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k * step).alias("start"), _window(b, size, k * step).alias("chunk"))))

    return _bound(text, of)


def word_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """array<struct<start, chunk>> of windows of words, joined by single spaces."""
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    step = size - overlap
    n = F.greatest(F.ceil((F.size(words) - overlap) / step), F.lit(1)).cast("int")
    bound = F.array(F.struct(words.alias("w"), n.alias("n")))
    return F.transform(bound, lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda k: F.struct((k * step).alias("start"), F.array_join(F.slice(b["w"], k * step + 1, F.lit(size)), " ").alias("chunk"))))[0]


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def pascal_case(name: Column) -> Column:
    return F.replace(F.initcap(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", " "))), F.lit(" "), F.lit(""))


def camel_case(name: Column) -> Column:
    p = pascal_case(name)
    return F.concat(F.lower(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))


FOLD = 64  # steps of a fold between moves of what they put out
SEPARATORS = ("\n\n", "\n", ". ", " ")
_ENDS = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """array<struct<start, end, chunk>>: windows of `size` characters that end behind the last
    paragraph, line, sentence or word in them, the first of these that lies in the second half;
    the next window starts `overlap` characters before the end."""
    if 2 * overlap >= size:
        raise ValueError("an overlap takes less than half a window")
    span = "array<struct<start:int,end:int,chunk:string>>"

    def ended(window: Column, start: Column, length: Column) -> Column:
        cut = F.lit(size)
        for separator in reversed(separators):
            # where the last one begins; below 0 if there is none
            place = F.length(window) - F.length(F.substring_index(window, separator, -1)) - len(separator)
            cut = _bound(place, lambda at: F.when(at > size * 0.5, at + len(separator)).otherwise(cut)) if separator else cut
        return F.when(start + size >= length, length).otherwise(start + cut)

    def of(t: Column) -> Column:
        length = F.length(t)
        most = F.ceil(length / (size * 0.5 - overlap)).cast("int") + 1

        def walk(known: Column) -> Column:
            blocks, length = known["blocks"], known["length"]

            def step(now: Column, _: Column) -> Column:
                start = now["start"]

                def cut(window: Column) -> Column:
                    def to(end: Column) -> Column:
                        # the last window holds the rest of the text
                        after = F.when(start + size >= length, length).otherwise(F.greatest(start + 1, end - overlap))
                        fresh = F.struct(start.alias("start"), end.alias("end"), F.substr(window, F.lit(1), end - start).alias("chunk"))
                        return F.struct(after.alias("start"), F.array_append(now["out"], fresh).alias("out"))

                    return _bound(ended(window, start, length), to)

                return F.when(start >= length, now).otherwise(_bound(_window(blocks, size, start), cut))

            found = _folded(F.sequence(F.lit(1), most), {"start": F.lit(0)}, span, step)["outs"]
            return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(c["end"] == length, c["chunk"]).otherwise(F.regexp_replace(c["chunk"], _ENDS, "")).alias("chunk")))

        known = F.struct(_blocks(t, size).alias("blocks"), length.alias("length"))
        return F.filter(_bound(known, walk), lambda c: c["chunk"] != "")

    return _bound(text, of)


def packed(parts: Column, size: int, glue: str, *, most: int | None = None) -> Column:
    """array<struct<n, chunk>>: parts put together in order until the next one would make more
    than `size` characters (glue included), or `most` parts are in; a larger part stays whole."""
    def step(now: Column, part: Column) -> Column:
        full = (now["n"] > 0) & ((F.length(now["chunk"]) + len(glue) + F.length(part) > size) | (F.lit(False) if most is None else now["n"] >= most))

        def with_(full: Column) -> Column:
            closed = F.array_append(now["out"], F.struct(now["n"].alias("n"), now["chunk"].alias("chunk")))
            joined = F.when(now["n"] == 0, part).otherwise(F.concat(now["chunk"], F.lit(glue), part))
            return F.struct(F.when(full, 1).otherwise(now["n"] + 1).alias("n"), F.when(full, part).otherwise(joined).alias("chunk"), F.when(full, closed).otherwise(now["out"]).alias("out"))

        return _bound(full, with_)

    def of(parts: Column) -> Column:
        found = _folded(parts, {"n": F.lit(0), "chunk": F.lit("")}, "array<struct<n:int,chunk:string>>", step)
        return _bound(found, lambda x: F.when(x["s"]["n"] > 0, F.array_append(x["outs"], F.struct(x["s"]["n"].alias("n"), x["s"]["chunk"].alias("chunk")))).otherwise(x["outs"]))

    return _bound(parts, of)


def paragraph_chunks(text: Column, size: int = 1200) -> Column:
    """array<string>: paragraphs put together up to `size` characters, a longer one cut into
    pieces of that size; none of an empty text."""
    paragraphs = F.transform(F.split(F.regexp_replace(text, _ENDS, ""), r"\n[ \t\n\x0B\f\r]*\n"), lambda p: F.regexp_replace(p, _ENDS, ""))
    return F.transform(packed(F.flatten(F.transform(paragraphs, lambda p: _blocks(p, size))), size, "\n\n"), lambda c: c["chunk"])


def sections(text: Column, header: str) -> Column:
    """array<string>: the text cut before every match of the header pattern."""
    marked = F.split(F.regexp_replace(text, f"({header})", "\u0001$1"), "\u0001")
    return F.filter(marked, lambda s: s != "")


def nested_chunks(text: Column, outer: int, inner: int) -> Column:
    """array<struct<parent, child, chunk>>: windows of `outer` characters, each in windows of `inner`."""
    def pieces(n: Column, size: int) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.ceil(n / size), F.lit(1)).cast("int") - 1)

    whole = F.when(F.length(text) == 0, F.array(text)).otherwise(_blocks(text, outer))
    parents = F.transform(whole, lambda t, p: F.struct(p.alias("p"), t.alias("t")))
    return F.flatten(F.transform(parents, lambda x: F.transform(pieces(F.length(x["t"]), inner), lambda c: F.struct(x["p"].alias("parent"), c.alias("child"), F.substr(x["t"], c * inner + 1, F.lit(inner)).alias("chunk")))))


#: Patterns of entities (their texts may be matched by several) and confidence.
ENTITIES = {
    "PERSON": r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b",
    "ORG": r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* (?:Inc|Corp|LLC|Ltd|Company)\b",
    "GPE": r"\b[A-Z][a-z]+ (?:City|State|Country|Nation)\b",
    "DATE": r"\b[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}\b",
    "MONEY": r"\$[0-9][0-9,]*(?:\.[0-9]{2})?",
    "PERCENT": r"\b[0-9]+(?:\.[0-9]+)?%",
}
ENTITY_CONFIDENCE = {"PERSON": 0.7, "ORG": 0.7, "GPE": 0.7, "DATE": 0.7, "MONEY": 0.75, "PERCENT": 0.75}
#: What stands between a subject and an object.
RELATIONS = {
    "founded_by": r"[.,]? (?:was )?(?:founded|established|created|started|co-founded) by ",
    "located_in": r" (?:is located in|is headquartered in|is based in|in) ",
    "works_for": r" (?:works for|works at|work for|work at|joined|was hired by|serves at) ",
    "born_in": r" (?:was born in|born in|hails from|is originally from) ",
    "acquired_by": r" (?:was acquired by|acquired by|is owned by) ",
}
#: The same between an object and its subject.
INVERSE = {
    "founded_by": r"[.,]? (?:founded|established|created|started|co-founded|is the founder of|is founder of) ",
    "acquired_by": r" (?:acquired|bought) ",
}
#: Words that tell an event.
EVENTS = {
    "acquisition": r"\b(?:acquired|acquisition|buying|bought|merger|merged)\b",
    "partnership": r"\b(?:partnered|partnership|collaborate|collaboration)\b",
    "launch": r"\b(?:launch|launched|releasing|released|unveil|unveiled)\b",
    "investment": r"\b(?:invest|invested|investment|funding|raised)\b",
    "legal": r"\b(?:sue|sued|lawsuit|litigation|legal action)\b",
}


def entities(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """array<struct<label, entity, confidence>>: all matches of every pattern, in order."""

    def found(label: str, pattern: str) -> Column:
        confidence = F.lit(ENTITY_CONFIDENCE.get(label, 0.7)).alias("confidence")
        return F.transform(all_of(text, pattern), lambda e: F.struct(F.lit(label).alias("label"), e.alias("entity"), confidence))

    return F.concat(*[found(label, p) for label, p in (patterns or ENTITIES).items()])


def relations(text: Column, entity: str, patterns: dict[str, str] | None = None, inverse: dict[str, str] | None = None) -> Column:
    """array<struct<subject, relation, object>>: two entities with a relation's words between;
    of `inverse` words the object comes first (see INVERSE)."""

    def found(name: str, middle: str, subject: int) -> Column:
        whole = F.lit(f"({entity}){middle}({entity})")
        return F.zip_with(F.regexp_extract_all(text, whole, F.lit(subject)), F.regexp_extract_all(text, whole, F.lit(3 - subject)), lambda s, o: F.struct(s.alias("subject"), F.lit(name).alias("relation"), o.alias("object")))

    forward = [found(name, middle, 1) for name, middle in (patterns or RELATIONS).items()]
    return F.concat(*forward, *[found(name, middle, 2) for name, middle in (inverse or {}).items()])


def places(text: Column, pattern: str, reach: int = 100) -> Column:
    """array<struct<entity, start, stop, after>>: every match of a pattern, where it stands (in
    characters, from 0, stop excluded) and the `reach` characters after it, by one pass over
    the text. A null text gives null."""
    spot = "struct<entity:string,start:int,stop:int>"

    def step(s: Column, x: Column) -> Column:
        start, stop = s["at"] + x["gap"], s["at"] + x["gap"] + F.length(x["e"])
        return F.struct(stop.alias("at"), F.array_append(s["out"], F.struct(x["e"].alias("entity"), start.alias("start"), stop.alias("stop"))).alias("out"))

    def of(t: Column) -> Column:
        found = all_of(t, pattern)
        each = F.zip_with(found, F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), lambda e, g: F.struct(e.alias("e"), F.length(g).alias("gap")))
        placed = _bound(each, lambda x: _folded(x, {"at": F.lit(0)}, f"array<{spot}>", step))["outs"]
        return _bound(_blocks(t, reach), lambda b: F.transform(placed, lambda p: F.struct(p["entity"].alias("entity"), p["start"].alias("start"), p["stop"].alias("stop"), _window(b, reach, p["stop"]).alias("after"))))

    return F.when(text.isNotNull(), _bound(text, of))


def events(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """array<struct<event, trigger>> of all trigger words, whatever their case."""

    def found(name: str, pattern: str) -> Column:
        return F.transform(all_of(text, f"(?i){pattern}"), lambda t: F.struct(F.lit(name).alias("event"), F.lower(t).alias("trigger")))

    return F.concat(*[found(name, p) for name, p in (patterns or EVENTS).items()])


def matched(entity: Column, text: Column) -> Column:
    """How well a text names an entity: 1 if equal, up to 0.9 by length if it is a part, at
    least 0.88 on word edges, else 0."""
    low, e = F.lower(F.trim(text)), F.lower(F.trim(entity))
    part = 0.9 * F.least(F.length(low), F.length(e)) / F.greatest(F.length(low), F.length(e)) + 0.1
    edge = F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.concat(F.lit(" "), e, F.lit(" "))) | F.contains(F.concat(F.lit(" "), e, F.lit(" ")), F.concat(F.lit(" "), low, F.lit(" ")))
    return F.when(low == e, 1.0).when((low == "") | (e == ""), 0.0).when(edge, F.greatest(part, F.lit(0.88))).when(F.contains(low, e) | F.contains(e, low), part).otherwise(0.0)


#: Words that tell how a question is bound in time.
INTENTS = (("between", r"\bbetween ([0-9]{4}-[0-9]{2}-[0-9]{2}) and [0-9]{4}-[0-9]{2}-[0-9]{2}"), ("before", r"\bbefore ([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("after", r"\bafter ([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("during", r"\bduring ([0-9]{4})"), ("at", r"\b(?:at|on) ([0-9]{4}-[0-9]{2}-[0-9]{2})"))


def rewritten_question(question: Column) -> Column:
    """struct<intent, moment, question>: a temporal phrase taken out of a question."""
    intent, moment, left = F.lit(None).cast("string"), F.lit(None).cast("string"), question
    for name, pattern in reversed(INTENTS):
        hit = question.rlike(pattern)
        intent, moment = F.when(hit, name).otherwise(intent), F.when(hit, F.regexp_extract(question, pattern, 1)).otherwise(moment)
        left = F.when(hit, F.regexp_replace(question, pattern, "")).otherwise(left)
    return F.struct(intent.alias("intent"), moment.alias("moment"), F.trim(F.regexp_replace(F.regexp_replace(left, " +", " "), r" +([?.!])$", "$1")).alias("question"))


def without_bom(data: Column) -> Column:
    """Bytes without a byte order mark of UTF-8."""
    return F.when(F.hex(F.substr(data, F.lit(1), F.lit(3))) == "EFBBBF", F.substr(data, F.lit(4))).otherwise(data)


def as_utf8(data: Column) -> Column:
    """Text of bytes: as UTF-8 where they are valid, else as Latin-1."""
    plain = without_bom(data)
    return F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")).otherwise(F.decode(plain, "ISO-8859-1"))


def mail(message: Column) -> Column:
    """struct<sender, recipient, subject, thread, body> of a message: folded header lines are
    joined, the body starts after the first empty line, a thread is a subject without Re:, Fwd:."""
    text = F.replace(message, F.lit("\r\n"), F.lit("\n"))
    place = F.locate("\n\n", text)
    head = F.regexp_replace(F.when(place > 0, F.substr(text, F.lit(1), place - 1)).otherwise(text), r"\n[ \t]+", " ")

    def header(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))

    subject = header("Subject")
    thread = F.lower(F.trim(F.regexp_replace(subject, r"(?i)^((re|fwd?):[ ]*)+", "")))
    return F.struct(header("From").alias("sender"), header("To").alias("recipient"), subject.alias("subject"), thread.alias("thread"), F.when(place > 0, F.substr(text, place + 2)).otherwise("").alias("body"))


def code_structure(code: Column) -> Column:
    """struct<functions, classes, imports, comments> of Python text, names in order."""
    def names(pattern: str) -> Column:
        return F.regexp_extract_all(code, F.lit(pattern), F.lit(1))

    imports = F.concat(names(r"(?m)^[ \t]*import ([A-Za-z_][A-Za-z0-9_.]*)"), names(r"(?m)^[ \t]*from ([A-Za-z_.][A-Za-z0-9_.]*) import"))
    return F.struct(names(r"(?m)^[ \t]*(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)").alias("functions"), names(r"(?m)^[ \t]*class ([A-Za-z_][A-Za-z0-9_]*)").alias("classes"), imports.alias("imports"), names(r"(?m)#[ \t]*(.*)$").alias("comments"))


def whole_entity_chunks(text: Column, size: int, entity: str) -> Column:
    """array<struct<start, chunk>>: windows of `size` characters that end behind the entity, if
    one lies across their end. `entity` is a pattern without line ends."""
    spans = F.array().cast("array<struct<start:int,chunk:string>>")

    def step(now: Column, t: Column, length: Column) -> Column:
        start = now["start"]
        end = start + size
        window = F.substr(t, start + 1, F.lit(2 * size))
        # an array of one binds the window to a name, so that it is cut out once
        places = F.transform(F.array(window), lambda w: F.aggregate(F.regexp_extract_all(w, F.lit(f"({entity})"), F.lit(1)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("extra")), lambda a, e: _across(a, e, w, size)))[0]
        stop = F.least(end + places["extra"], length)
        fresh = F.struct(start.alias("start"), F.substr(t, start + 1, stop - start).alias("chunk"))
        return F.when(start >= length, now).otherwise(F.struct(stop.alias("start"), F.array_append(now["out"], fresh).alias("out")))

    def of(t: Column) -> Column:
        length = F.length(t)
        return F.aggregate(F.sequence(F.lit(1), F.ceil(length / size).cast("int") + 1), F.struct(F.lit(0).alias("start"), spans.alias("out")), lambda now, _: step(now, t, length))["out"]

    return F.transform(F.array(text), of)[0]


def _across(state: Column, entity: Column, window: Column, size: int) -> Column:
    """Where the next entity ends in the window, and by how much one lies across `size`."""
    begin = state["at"] + F.instr(F.substr(window, state["at"] + 1), entity) - 1
    end = begin + F.length(entity)
    return F.struct(end.alias("at"), F.when((begin < size) & (end > size), end - size).otherwise(state["extra"]).alias("extra"))
