"""Requirement archives (ZIP with one ReqIF XML and images): scanned as binary files, parsed on the executors, a file a time.

The XML is pulled from the compressed member an object at a time. A broken archive (no ZIP, damaged, encrypted, empty, no or
malformed ReqIF) gives one row of kind "error" and no artifact; an object that can't be parsed is left out.
"""

from __future__ import annotations

import io
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

PARSED = (
    "source_file string, kind string, seq long, id string, internal_id string, type string, text string, heading string, "
    "source_id string, target_id string, content binary, error string"
)
IMAGE_ENDS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".tiff", ".webp")
#: Parts of an attribute's name that make it the text, or the heading.
TEXT_NAMES = ("text", "info", "desc", "req", "content", "detail")
HEADING_NAMES = ("heading", "name")
FOREIGN_ID = "ReqIF.ForeignID"


def read_archives(spark: SparkSession, folder: str, glob: str = "*.reqifz") -> DataFrame:
    """path, content of every archive below folder; few a task, since a row is a whole file. Spark lists no files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _ref(element, kind: str) -> str | None:
    """The text of the reference inside the child called kind."""
    return next((x.text for child in element if _local(child.tag) == kind for x in child), None)


def _value(element) -> str:
    """The markup inside THE-VALUE, without prefixes of names."""
    for child in element:
        if _local(child.tag) == "THE-VALUE":
            for x in child.iter():
                x.tag = _local(x.tag)
            return "".join([child.text or "", *(ElementTree.tostring(x, encoding="unicode") for x in child)])
    return ""


WANTED = {"SPEC-OBJECT-TYPE", "SPEC-RELATION-TYPE", "SPEC-OBJECT", "SPEC-RELATION"}


def _pulled(stream) -> Iterator[tuple[str, ElementTree.Element]]:
    """Each of WANTED once it is complete. What is read leaves the tree at once, so the tree never holds more than one of them."""
    above, inside = [], 0
    for event, x in ElementTree.iterparse(stream, events=("start", "end")):
        name = _local(x.tag) if isinstance(x.tag, str) else ""
        if event == "start":
            above.append(x)
            inside += name in WANTED
            continue
        above.pop()
        if name in WANTED:
            inside -= 1
            if not inside:
                yield name, x
        if not inside and above:
            above[-1].remove(x)


class _Lookups:
    """Names by id, small beside the objects: of object and relation types, of attributes, and of each type's foreign id."""

    def __init__(self) -> None:
        self.object_type: dict[str, str] = {}
        self.relation_type: dict[str, str] = {}
        self.attribute: dict[str, str] = {}
        self.foreign_id: dict[str, str] = {}

    def add(self, kind: str, x) -> None:
        own = x.get("IDENTIFIER")
        if own and x.get("LONG-NAME"):
            (self.object_type if kind == "SPEC-OBJECT-TYPE" else self.relation_type)[own] = x.get("LONG-NAME")
        if kind == "SPEC-OBJECT-TYPE":
            for a in x.iter():
                if _local(a.tag) in ("ATTRIBUTE-DEFINITION-STRING", "ATTRIBUTE-DEFINITION-XHTML"):
                    self.attribute[a.get("IDENTIFIER")] = a.get("LONG-NAME") or a.get("IDENTIFIER")
                    if a.get("LONG-NAME") == FOREIGN_ID and _local(a.tag).endswith("STRING"):
                        self.foreign_id[own] = a.get("IDENTIFIER")

    def rows(self) -> Iterator[dict]:
        for kind, names in vars(self).items():
            yield from ({"kind": "lookup", "type": kind, "seq": k, "id": i, "text": n} for k, (i, n) in enumerate(names.items()))


def _object(x, seq: int, known: _Lookups) -> dict:
    internal, type_id = x.get("IDENTIFIER", "UNKNOWN"), _ref(x, "TYPE")
    row = {"kind": "object", "seq": seq, "id": internal, "internal_id": internal, "type": known.object_type.get(type_id, ""), "text": "", "heading": ""}
    for v in x.iter():
        name = _local(v.tag)
        if name == "ATTRIBUTE-VALUE-STRING" and _ref(v, "DEFINITION") == known.foreign_id.get(type_id, ""):
            row["id"] = v.get("THE-VALUE") or internal
        elif name == "ATTRIBUTE-VALUE-XHTML":
            called = (known.attribute.get(_ref(v, "DEFINITION")) or _ref(v, "DEFINITION") or "").lower()
            part = "text" if any(n in called for n in TEXT_NAMES) else "heading" if any(n in called for n in HEADING_NAMES) else None
            if part:
                row[part] = _value(v)
    return row


def parse_xml(opened: Callable[[], IO[bytes]]) -> Iterator[dict]:
    """Lookups, objects and relations of a ReqIF document, in document order. It is read twice: types may follow what uses them,
    and a document that breaks off gives nothing."""
    known, late, seen = _Lookups(), False, False
    with opened() as stream:
        for kind, x in _pulled(stream):
            if kind.endswith("TYPE"):
                known.add(kind, x)
            late |= seen and kind == "SPEC-OBJECT"
            seen |= kind == "SPEC-RELATION"
    yield from known.rows()
    outer: dict[str, str] = {}
    # relations need the ids of all objects: one more pass if some come before them
    for wanted in [{"SPEC-OBJECT"}, {"SPEC-RELATION"}] if late else [{"SPEC-OBJECT", "SPEC-RELATION"}]:
        places = Counter()
        with opened() as stream:
            for kind, x in _pulled(stream):
                seq = places[kind]
                places[kind] += 1
                if kind not in wanted:
                    continue
                if kind == "SPEC-OBJECT":
                    try:
                        row = _object(x, seq, known)
                    except Exception:  # one object that can't be read is left out
                        continue
                    outer[row["internal_id"]] = row["id"]
                    yield row
                elif all(ends := [_ref(x, "SOURCE"), _ref(x, "TARGET")]):
                    name = known.relation_type.get(_ref(x, "TYPE"), "")
                    yield {"kind": "relation", "seq": seq, "id": x.get("IDENTIFIER"), "type": name, "source_id": outer.get(ends[0], ends[0]), "target_id": outer.get(ends[1], ends[1])}


def parse_archive(content: bytes | None) -> Iterator[dict]:
    """Rows of an archive. Whatever is wrong with it is a row of kind error: nothing that one file holds ends the job. An image that
    can't be read is an error of its own, with its name as id."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            names = archive.namelist()
            member = next((n for n in names if n.lower().endswith(".reqif")), None)
            if member:
                yield from parse_xml(lambda: archive.open(member))
            else:
                yield {"kind": "error", "error": "no ReqIF member"}
            for k, n in enumerate(names):
                if n.lower().endswith(IMAGE_ENDS):
                    try:
                        yield {"kind": "image", "seq": k, "id": n, "content": archive.read(n)}
                    except Exception as error:
                        yield {"kind": "error", "id": n, "error": type(error).__name__}
    except Exception as error:
        yield {"kind": "error", "error": type(error).__name__}


#: Rows, and bytes of images, that leave the worker at once.
ROWS, BYTES = 2_000, 1 << 24


def parse_archives(files: DataFrame) -> DataFrame:
    """Rows (PARSED) of kinds lookup, object, relation, image, error of files (path, content). A worker holds one compressed archive
    and one batch of rows, never a document's tree."""
    ship(files.sparkSession)
    fields = [c.split() for c in PARSED.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in ("path", "content"))):
                held, size = [], 0
                for row in parse_archive(content.as_py()):
                    held.append(row | {"source_file": path.as_py()})
                    size += len(row.get("content") or b"")
                    if len(held) == ROWS or size > BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, PARSED)


def lookups_of(parsed: DataFrame) -> DataFrame:
    """source_file, lookup (object_type, relation_type, attribute, foreign_id), identifier, value."""
    return parsed.where("kind = 'lookup'").select("source_file", F.col("type").alias("lookup"), F.col("id").alias("identifier"), F.col("text").alias("value"))


def scan_report(parsed: DataFrame) -> DataFrame:
    """source_file, objects, relations, images, errors (different ones, sorted): one row an archive, broken ones included."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return parsed.groupBy("source_file").agg(
        of("object").alias("objects"), of("relation").alias("relations"), of("image").alias("images"), F.sort_array(F.collect_set(F.when(F.col("kind") == "error", F.col("error")))).alias("errors")
    )


def artifacts_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'object'").select("source_file", "seq", "internal_id", "id", "type", "text", "heading")


def relations_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'relation'").select("source_file", "seq", "id", "source_id", "target_id", F.col("type").alias("relation_type_name"))


def images_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'image'").select("source_file", F.col("id").alias("name"), "content", F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("hash"))
