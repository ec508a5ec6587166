"""Sinks: triples and graphs as lines of text, written by all tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(value: Column) -> Column:
    """A string literal with backslash, quote and line ends escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def ntriples(facts: DataFrame, base: str) -> DataFrame:
    def iri(c: Column) -> Column:
        return F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))

    return facts.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), quoted(F.col("o")), F.lit(".")).alias("value"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    made = nodes.select(F.format_string("MERGE (n:%s {id: %s}) SET n.name = %s", F.initcap("type"), quoted(F.col("id")), quoted(F.col("name"))).alias("value"))
    tied = edges.select(F.format_string("MATCH (a {id: %s}), (b {id: %s}) MERGE (a)-[:%s]->(b)", quoted(F.col("src")), quoted(F.col("dst")), F.upper("type")).alias("value"))
    return made.union(tied)


def xml_text(value: Column) -> Column:
    out = value
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Element lines (part 0 nodes, part 1 edges); a writer puts the head and tail around."""
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="type">'), xml_text(F.col("type")), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"/>')).alias("value"))
    return n.union(e)


def turtle(facts: DataFrame, base: str) -> DataFrame:
    """One statement block of each subject, its predicates in order. facts: s, p, o (literals)."""
    def iri(c: Column) -> Column:
        return F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))

    pairs = F.array_sort(F.collect_list(F.concat_ws(" ", iri(F.col("p")), quoted(F.col("o")))))
    return facts.groupBy("s").agg(F.array_join(pairs, " ; ").alias("pairs")).select(F.concat(iri(F.col("s")), F.lit(" "), "pairs", F.lit(" .")).alias("value"))


def json_ld(rows: DataFrame, key: str, kind: str, properties: list[str], base: str) -> DataFrame:
    """One node object a row, for a file of JSON lines."""
    fields = [F.concat(F.lit(base), key).alias("@id"), F.lit(kind).alias("@type"), *properties]
    return rows.select(F.to_json(F.struct(*fields)).alias("value"))


def rdf_xml(rows: DataFrame, key: str, properties: list[str], base: str) -> DataFrame:
    """One rdf:Description a row; a writer puts the head and tail around."""
    inner = [F.concat(F.lit(f"<x:{p}>"), xml_text(F.col(p).cast("string")), F.lit(f"</x:{p}>")) for p in properties]
    return rows.select(F.concat(F.lit(f'<rdf:Description rdf:about="{base}'), xml_text(F.col(key)), F.lit('">'), *inner, F.lit("</rdf:Description>")).alias("value"))


def rdf_documents(lines: DataFrame, prefixes: dict[str, str], *, rows: int = 1000) -> DataFrame:
    """Lines of `rdf_xml` as whole documents of about `rows` descriptions, one a row."""
    parts = max(1, -(-lines.count() // rows))
    names = "".join(f' xmlns:{p}="{iri}"' for p, iri in {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", **prefixes}.items())
    held = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("inner"))
    return held.select(F.concat(F.lit(f"<rdf:RDF{names}>\n"), "inner", F.lit("\n</rdf:RDF>")).alias("value"))


def yaml(rows: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """One list item a row, with quoted values."""
    lines = [F.concat(F.lit(f"\n  {p}: "), quoted(F.col(p).cast("string"))) for p in properties]
    return rows.select(F.concat(F.lit("- id: "), quoted(F.col(key).cast("string")), *lines).alias("value"))


def aql(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """INSERT statements for a document and an edge collection."""
    n = nodes.select(F.concat(F.lit("INSERT "), F.to_json(F.struct(F.col("id").alias("_key"), "type", "name")), F.lit(" INTO nodes")).alias("value"))
    e = edges.select(F.concat(F.lit("INSERT "), F.to_json(F.struct(F.concat(F.lit("nodes/"), "src").alias("_from"), F.concat(F.lit("nodes/"), "dst").alias("_to"), "type")), F.lit(" INTO edges")).alias("value"))
    return n.union(e)


def owl_class(name: Column, parent: Column, base: str) -> Column:
    """A class declaration in Turtle; without a parent it is a top class."""
    top = F.concat(F.lit(f"<{base}"), name, F.lit("> a owl:Class"))
    return F.concat(top, F.when(parent.isNull(), "").otherwise(F.concat(F.lit(f" ; rdfs:subClassOf <{base}"), parent, F.lit(">"))), F.lit(" ."))


def owl_property(name: Column, kind: str, domain: Column, range_: Column, base: str) -> Column:
    return F.concat(F.lit(f"<{base}"), name, F.lit(f"> a owl:{kind} ; rdfs:domain <{base}"), domain, F.lit(f"> ; rdfs:range <"), range_, F.lit("> ."))


def shacl_shape(name: Column, properties: list[tuple[str, str, int]], base: str) -> Column:
    """A node shape in Turtle. properties: (path, datatype, least count)."""
    inner = [F.lit(f" ; sh:property [ sh:path <{base}{path}> ; sh:datatype xsd:{kind}" + (f" ; sh:minCount {least}" if least else "") + " ]") for path, kind, least in properties]
    return F.concat(F.lit(f"<{base}"), name, F.lit(f"Shape> a sh:NodeShape ; sh:targetClass <{base}"), name, F.lit(">"), *inner, F.lit(" ."))


def arrow_files(df: DataFrame, path: str) -> DataFrame:
    """Every partition as one Arrow IPC file in a folder that all executors share, written by
    its task: (file, rows)."""
    names = df.schema

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(path, exist_ok=True)
        task = TaskContext.get()
        file = f"{path}/part-{task.partitionId():05d}.arrow"
        # a task that is run twice renames the same bytes to the same name
        draft, sink, rows = f"{file}.{uuid.uuid4().hex}", None, 0
        for batch in batches:
            if sink is None:
                sink = pa.ipc.new_file(draft, batch.schema)
            sink.write_batch(batch)
            rows += batch.num_rows
        if sink is not None:
            sink.close()
            os.replace(draft, file)
            yield pa.RecordBatch.from_pydict({"file": [file], "rows": [rows]})

    return df.select(*names.names).mapInArrow(write, "file string, rows long")


def written(df: DataFrame, path: str, form: str, *, mode: str = "errorifexists", by: list[str] | None = None, **options) -> None:
    """parquet, csv, json, orc or text; partitioned by columns if given."""
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).format(form).save(path)
