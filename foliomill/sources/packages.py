"""Document packages as DataFrames: files, JSON records with their lines, XML nodes.

The listing walks each package where it lies (a shared file system), so that names starting with `_` or `.` and symbolic links are
seen; Spark's own file sources skip the former and follow the latter.
"""

from __future__ import annotations

import hashlib
import os
import stat
import unicodedata
from collections.abc import Collection, Iterator, Mapping, Sequence
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "package string, path string, kind string, size long, sha256 string, content binary"
NODES = "package string, path string, seq int, parent int, depth int, tag string, id string, line int, attrs map<string,string>, own_text string, full_text string, trail string, flat string, spaced string, error string"
#: Characters of nodes, roughly, that go back to Spark at a time.
PARSED_CHARS = 4 << 20
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"


def files(spark: SparkSession, roots: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each folder, file, link or other entry below each (package, root)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, root in zip(batch["package"], batch["root"], strict=True):
                rows = []
                for at, folders, names in os.walk(root):
                    for name in sorted(folders + names):
                        full = os.path.join(at, name)
                        mode = os.lstat(full).st_mode
                        kind = "link" if stat.S_ISLNK(mode) else "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "other"
                        data = None
                        if kind == "file":
                            with open(full, "rb") as f:
                                data = f.read()
                        rows.append((package, os.path.relpath(full, root).replace(os.sep, "/"), kind, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), data))
                yield pd.DataFrame(rows, columns=["package", "path", "kind", "size", "sha256", "content"])

    given = spark.createDataFrame(list(roots), "package string, root string")
    return given.repartition(max(1, min(len(roots), 200)), "package").mapInPandas(walk, FILES)


def texts(found: DataFrame) -> DataFrame:
    """Text files without their byte order mark."""
    raw = found.filter("kind = 'file'").filter(F.col("path").rlike(r"\.(json|jsonl|xml|sha256)$"))
    body = F.when(F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF")), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return raw.select("package", "path", "content", F.try_validate_utf8(body.cast("string")).alias("text"))


def json_lines(text: DataFrame, path: str) -> DataFrame:
    """(package, path, line, json), blank lines left out; lines part at LF only."""
    t = text.filter(F.col("path") == path).select("package", "path", F.posexplode(F.split("text", "\n", -1)).alias("nth", "json"))
    return t.filter(F.trim(F.regexp_replace("json", r"[\s]", "")) != "").select("package", "path", (F.col("nth") + 1).alias("line"), "json")


def parse_xml(data: bytes) -> tuple[list[dict], str | None, int | None]:
    """Nodes in document order; entities and document types are refused; (nodes, error, its line)."""
    nodes: list[dict] = []
    stack: list[int] = []
    parser = expat.ParserCreate(namespace_separator="|")
    parser.buffer_text, parser.buffer_size = True, max(len(data), 1)  # one call for each run of text

    def start(tag: str, attrs: dict) -> None:
        named = {k.replace(XLINK + "|", "xlink:").replace(XML + "|", "xml:"): v for k, v in attrs.items()}
        nodes.append({"parent": stack[-1] if stack else None, "depth": len(stack), "tag": tag, "id": named.get("id"), "line": parser.CurrentLineNumber, "attrs": named, "own": [], "full": [], "trail": (nodes[stack[-1]]["trail"] if stack else "") + "/" + tag})
        stack.append(len(nodes) - 1)

    def text(data: str) -> None:
        nodes[stack[-1]]["own"].append(data)
        for i in stack:
            nodes[i]["full"].append(data)

    def refuse(*_: object) -> None:
        raise ValueError("document types are not allowed")

    parser.StartElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, text, refuse
    parser.EndElementHandler = lambda _: stack.pop()
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as e:
        return [], str(e), parser.CurrentLineNumber
    return nodes, None, None


def _flat(text: str) -> str:
    """NFC, runs of white space as single blanks."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def parsed(found: DataFrame, path: str = "content/document.xml", texts: Mapping[str, Collection[str]] | None = None) -> DataFrame:
    """One row for each element of each (package, content); for one that does not parse one row with its error. `trail` holds the tags from
    the root on; `flat` is the text of elements with an id and of paragraphs in NFC with single blanks, `spaced` the same with blanks between runs of text. `texts` names, by column, the tags whose own_text, full_text, flat and spaced are wanted; others are null."""
    types = {"int": pa.int32(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in NODES.split(", ")])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def said(column: str, tag: str) -> bool:
        return texts is None or tag in texts.get(column, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for package, data in zip(*batch.columns, strict=True):
                package = package.as_py()
                nodes, error, line = parse_xml(data.as_py())
                if error:
                    rows.append((package, path, 0, None, 0, None, None, line, [], None, None, None, None, None, error))
                for i, n in enumerate(nodes):
                    tag, runs = n["tag"], n["full"]
                    read = n["id"] is not None or tag == "p"
                    full = "".join(runs) if said("full_text", tag) else None
                    own = "".join(n["own"]) if said("own_text", tag) else None
                    flat = _flat("".join(runs)) if read and said("flat", tag) else None
                    spaced = _flat(" ".join(x for x in runs if x.strip())) if read and said("spaced", tag) else None
                    rows.append((package, path, i, n["parent"], n["depth"], tag, n["id"], n["line"], list(n["attrs"].items()), own, full, n["trail"], flat, spaced, None))
                    size += 200 + sum(len(x) for x in (full, flat, spaced) if x)
                    if size > PARSED_CHARS:  # elements hold the texts of those inside them: rows go on in bounded portions
                        yield table(rows)
                        rows, size = [], 0
        if rows:
            yield table(rows)

    return found.select("package", "content").mapInArrow(run, NODES)


def xml_nodes(found: DataFrame, path: str = "content/document.xml") -> DataFrame:
    """The elements of a file of each package."""
    return parsed(found.filter((F.col("path") == path) & (F.col("kind") == "file")), path)
