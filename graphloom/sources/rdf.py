"""RDF syntaxes as triples: Turtle (N-Triples with it) and RDF/XML, file by file.

Files are read by Spark, so from any store, and each is parsed by the task that has it. A
triple is (s, p, o, kind, language, datatype): kind tells whether o is an iri, a blank node or
a literal. Blank nodes are named by their file, as two files' names do not mean the same."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TRIPLES = "s string, p string, o string, kind string, language string, datatype string"
Triple = tuple[str, str, str, str, str | None, str | None]
#: Fixed by the standards.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
    |(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^)
    |(?P<blank>_:[^\s<>"'();,\[\]\#]*[^\s<>"'();,\[\]\#.])
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<name>(?:[^\s<>"'();,\[\]\#:@^.]|\.(?=[^\s<>"'();,\[\]\#]))*:(?:(?:[^\s<>"'();,\[\]\#\\.]|\\.|\.(?=[^\s<>"'();,\[\]\#]))*))
    |(?P<bare>[A-Za-z]+)
    |(?P<mark>[.;,()\[\]])""",
    re.VERBOSE | re.DOTALL,
)


def _unescaped(text: str) -> str:
    one = lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3])
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.DOTALL) if "\\" in text else text


class Turtle:
    """The statements of one text, in order."""

    def __init__(self, text: str, base: str = "", scope: str = "") -> None:
        self.text, self.at, self.base, self.scope, self.names, self.made = text, 0, base, scope, {}, 0
        self.kind, self.value, self.out = "", "", []
        self._next()

    def _next(self) -> None:
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise ValueError(f"no Turtle at {self.at}: {self.text[self.at : self.at + 40]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return
        self.kind, self.value = "end", ""

    def _take(self, value: str) -> None:
        if self.value != value or self.kind == "text":
            raise ValueError(f"{value} is wanted at {self.at}, not {self.value!r}")
        self._next()

    def triples(self) -> Iterator[Triple]:
        while self.kind != "end":
            word = self.value.lower()
            if self.kind in ("word", "bare") and word.lstrip("@") in ("prefix", "base"):
                self._directive(word)
            else:
                self._statement()
            yield from self.out
            self.out = []

    def _directive(self, word: str) -> None:
        self._next()
        name = ""
        if word.endswith("prefix"):
            name = self.value
            self._next()
        iri = urljoin(self.base, _unescaped(self.value[1:-1])) if self.base else _unescaped(self.value[1:-1])
        self._next()
        if name:
            self.names[name[:-1]] = iri
        else:
            self.base = iri
        if word[0] == "@":
            self._take(".")

    def _statement(self) -> None:
        bare = self.value == "[" and self.kind == "mark"
        subject = self._term()[0]
        if not (bare and self.value == "." and self.kind == "mark"):
            self._properties(subject)
        self._take(".")

    def _properties(self, subject: str) -> None:
        while True:
            if self.kind == "bare" and self.value == "a":
                verb = RDF + "type"
                self._next()
            else:
                verb = self._term()[0]
            while True:
                self.out.append((subject, verb, *self._term()))
                if self.value != "," or self.kind != "mark":
                    break
                self._next()
            while self.value == ";" and self.kind == "mark":
                self._next()
            if self.kind == "mark" and self.value in ".]":
                return

    def _fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}.{self.made}"

    def _term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.kind, self.value
        self._next()
        if kind == "iri":
            iri = _unescaped(value[1:-1])
            return urljoin(self.base, iri) if self.base else iri, "iri", None, None
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.names:
                raise ValueError(f"the prefix {prefix}: is not known")
            return self.names[prefix] + re.sub(r"\\(.)", r"\1", local), "iri", None, None
        if kind == "blank":
            return f"_:{self.scope}.{value[2:]}", "blank", None, None
        if kind == "text":
            return self._literal(_unescaped(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1]))
        if kind == "number":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", None, XSD + name
        if kind == "bare" and value in ("true", "false"):
            return value, "literal", None, XSD + "boolean"
        if kind == "mark" and value == "[":
            node = self._fresh()
            if self.value != "]" or self.kind != "mark":
                self._properties(node)
            self._take("]")
            return node, "blank", None, None
        if kind == "mark" and value == "(":
            return self._list()
        raise ValueError(f"a term is wanted at {self.at}, not {value!r}")

    def _literal(self, text: str) -> tuple[str, str, str | None, str | None]:
        if self.kind == "word" and self.value == "^^":
            self._next()
            return text, "literal", None, self._term()[0]
        if self.kind == "word":
            language = self.value[1:]
            self._next()
            return text, "literal", language, None
        return text, "literal", None, None

    def _list(self) -> tuple[str, str, str | None, str | None]:
        first, last = None, None
        while self.value != ")" or self.kind != "mark":
            node, item = self._fresh(), self._term()
            if last:
                self.out.append((last, RDF + "rest", node, "blank", None, None))
            first, last = first or node, node
            self.out.append((node, RDF + "first", *item))
        self._take(")")
        nil = (RDF + "nil", "iri", None, None)
        if not first:
            return nil
        self.out.append((last, RDF + "rest", *nil))
        return first, "blank", None, None


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag


class RdfXml:
    """The triples of one document's node elements."""

    def __init__(self, data: bytes, base: str = "", scope: str = "") -> None:
        self.data, self.base, self.scope, self.made = data, base, scope, 0

    def triples(self) -> Iterator[Triple]:
        root = ElementTree.fromstring(self.data)
        nodes = list(root) if _name(root.tag) == RDF + "RDF" else [root]
        base, language = root.get(XML + "base", self.base), root.get(XML + "lang")
        for node in nodes:
            out: list[Triple] = []
            self._node(node, base, language, out)
            yield from out

    def _fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}.{self.made}"

    def _iri(self, value: str, base: str) -> str:
        return urljoin(base, value) if base else value

    def _node(self, e, base: str, language: str | None, out: list[Triple]) -> tuple[str, str]:
        base, language = e.get(XML + "base", base), e.get(XML + "lang", language)
        rdf = lambda name: e.get(f"{{{RDF}}}{name}")
        if rdf("about") is not None:
            subject, kind = self._iri(rdf("about"), base), "iri"
        elif rdf("ID") is not None:
            subject, kind = self._iri("#" + rdf("ID"), base), "iri"
        else:
            subject, kind = f"_:{self.scope}.{rdf('nodeID')}" if rdf("nodeID") else self._fresh(), "blank"
        if _name(e.tag) != RDF + "Description":
            out.append((subject, RDF + "type", _name(e.tag), "iri", None, None))
        for name, value in e.attrib.items():
            if _name(name) == RDF + "type":
                out.append((subject, RDF + "type", self._iri(value, base), "iri", None, None))
            elif name[0] == "{" and not name.startswith((f"{{{RDF}}}", XML)):
                out.append((subject, _name(name), value, "literal", language, None))
        count = 0
        for inner in e:
            verb = _name(inner.tag)
            if verb == RDF + "li":
                count += 1
                verb = f"{RDF}_{count}"
            self._property(subject, verb, inner, base, language, out)
        return subject, kind

    def _property(self, subject: str, verb: str, e, base: str, language: str | None, out: list[Triple]) -> None:
        base, language = e.get(XML + "base", base), e.get(XML + "lang", language)
        rdf = lambda name: e.get(f"{{{RDF}}}{name}")
        parse = rdf("parseType")
        if rdf("resource") is not None:
            out.append((subject, verb, self._iri(rdf("resource"), base), "iri", None, None))
        elif rdf("nodeID") is not None:
            out.append((subject, verb, f"_:{self.scope}.{rdf('nodeID')}", "blank", None, None))
        elif parse == "Collection":
            items = [self._node(x, base, language, out) for x in e]
            cells = [self._fresh() for _ in items]
            out.append((subject, verb, cells[0] if cells else RDF + "nil", "blank" if cells else "iri", None, None))
            for k, (cell, (item, kind)) in enumerate(zip(cells, items, strict=True)):
                out.append((cell, RDF + "first", item, kind, None, None))
                out.append((cell, RDF + "rest", *((cells[k + 1], "blank") if k + 1 < len(cells) else (RDF + "nil", "iri")), None, None))
        elif parse == "Resource":
            node = self._fresh()
            out.append((subject, verb, node, "blank", None, None))
            for inner in e:
                self._property(node, _name(inner.tag), inner, base, language, out)
        elif parse == "Literal":
            text = (e.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in e)
            out.append((subject, verb, text, "literal", None, RDF + "XMLLiteral"))
        elif len(e):
            for inner in e:
                node, kind = self._node(inner, base, language, out)
                out.append((subject, verb, node, kind, None, None))
        else:
            kind = rdf("datatype")
            out.append((subject, verb, e.text or "", "literal", None if kind else language, self._iri(kind, base) if kind else None))


def read_rdf(spark: SparkSession, path: str, form: str, *, base: str = "", pattern: str | None = None) -> DataFrame:
    """(s, p, o, kind, language, datatype) of the files below path. form: turtle (N-Triples are
    Turtle) or rdf_xml. What cannot be parsed is an error that names the file."""
    if form not in ("turtle", "rdf_xml"):
        raise ValueError(f"unknown form {form}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in TRIPLES.split(", ")]
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scope = f"{zlib.crc32(file.encode()):08x}"
                content = data.as_py()
                if not content.strip():
                    continue
                reader = Turtle(content.decode("utf-8"), base, scope) if form == "turtle" else RdfXml(content, base, scope)
                rows: list[Triple] = []
                try:
                    for triple in reader.triples():
                        rows.append(triple)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                except (ValueError, ElementTree.ParseError) as e:
                    raise ValueError(f"{file}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content").mapInArrow(run, TRIPLES)
