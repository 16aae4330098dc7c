"""BibTeX and RIS files as references.

``read_bibliography`` lists and reads files with Spark's binary source, so that any store that Spark reads will do, and
splits them in tasks. ``BibliographySource`` is the same as a data source, for ``spark.read.format("bibliography")``: its
partitions are ranges of files. Entries are split by balanced braces or quotes (BibTeX) and by tags (RIS), over any number
of lines. An entry that can't be read is a row with its text in ``malformed`` and nothing else; text between entries is
no entry. Files are taken as UTF-8; other bytes become replacement characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ENTRY = "path string, ord int, kind string, cite_key string, title string, authors array<string>, year int, journal string, doi string, pmid string, url string, malformed string"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]

# The tags of the formats and the columns that they fill; of several tags the first that is there.
BIBTEX_FIELDS = {"title": ("title",), "year": ("year", "date"), "journal": ("journal", "journaltitle", "booktitle"), "doi": ("doi",), "pmid": ("pmid",), "url": ("url",)}
RIS_FIELDS = {"title": ("TI", "T1", "CT"), "year": ("PY", "Y1", "DA"), "journal": ("JO", "JF", "T2", "JA"), "doi": ("DO",), "pmid": ("AN",), "url": ("UR", "L1")}
RIS_AUTHORS = ("AU", "A1")
NOT_ENTRIES = ("comment", "preamble")

_RIS_TAG = re.compile(r"^([A-Z][A-Z0-9])  -(?: (.*))?$")
_YEAR = re.compile(r"\d{4}")


def _end_of_group(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``, or -1; escaped braces don't count."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def _plain(value: str) -> str:
    """A field's text without grouping braces and with single blanks."""
    return " ".join(re.sub(r"(?<!\\)[{}]", "", value).replace("\\&", "&").replace("\\%", "%").split())


def _bibtex_value(text: str, at: int, words: dict[str, str]) -> tuple[str, int]:
    """A field's value, parts joined by ``#``, and the place after it."""
    parts = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise ValueError("no value")
        if text[at] == "{":
            end = _end_of_group(text, at)
            if end < 0:
                raise ValueError("open brace")
            parts.append(text[at + 1 : end - 1])
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth):
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            if end >= len(text):
                raise ValueError("open quote")
            parts.append(text[at + 1 : end])
            end += 1
        else:
            found = re.compile(r"[^\s,#{}\"]+").match(text, at)
            if not found:
                raise ValueError("no value")
            end = found.end()
            parts.append(words.get(found[0].lower(), found[0]))
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text) or text[at] != "#":
            return "".join(parts), at
        at += 1


def _bibtex_fields(body: str, words: dict[str, str]) -> dict[str, str]:
    fields, at = {}, 0
    while at < len(body):
        found = re.compile(r"[\s,]*([A-Za-z][\w:-]*)\s*=").match(body, at)
        if not found:
            if body[at:].strip(" \t\r\n,"):
                raise ValueError("no field")
            break
        value, at = _bibtex_value(body, found.end(), words)
        if body[at : at + 1] not in ("", ","):
            raise ValueError("no comma")
        fields.setdefault(found[1].lower(), value)
    return fields


def _first(fields: dict[str, str], names: tuple[str, ...]) -> str | None:
    return next((v for n in names if (v := _plain(fields.get(n, "")))), None)


def bibtex_entries(text: str) -> Iterator[dict]:
    """The entries of a BibTeX text, with abbreviations of ``@string`` put in."""
    words: dict[str, str] = {}
    at = 0
    while (found := re.compile(r"(?m)^[ \t]*@([A-Za-z]+)\s*\{").search(text, at)) is not None:
        kind, open_at = found[1].lower(), found.end() - 1
        end = _end_of_group(text, open_at)
        if end < 0:  # never closed: the next entry begins at the next line that looks like one
            again = re.compile(r"(?m)^[ \t]*@[A-Za-z]+\s*\{").search(text, found.end())
            at = again.start() if again else len(text)
            yield {"malformed": text[found.start() : at].strip()}
            continue
        at, body = end, text[open_at + 1 : end - 1]
        if kind in NOT_ENTRIES:
            continue
        try:
            if kind == "string":
                words |= {k: v for k, v in _bibtex_fields(body, words).items()}
                continue
            key, comma, rest = body.partition(",")
            if not key.strip() or "=" in key or not comma:
                raise ValueError("no key")
            fields = _bibtex_fields(rest, words)
        except ValueError:
            yield {"malformed": text[found.start() : end].strip()}
            continue
        names = [_plain(a) for a in re.split(r"\s+and\s+", fields.get("author", fields.get("editor", "")).strip())]
        year = _YEAR.search(_first(fields, BIBTEX_FIELDS["year"]) or "")
        yield {"kind": kind, "cite_key": key.strip(), "authors": [a for a in names if a], "year": int(year[0]) if year else None} | {c: _first(fields, BIBTEX_FIELDS[c]) for c in ("title", "journal", "doi", "pmid", "url")}


def ris_entries(text: str) -> Iterator[dict]:
    """The entries of a RIS text: from ``TY`` to ``ER``; lines without a tag go on with the one before."""
    fields: dict[str, list[str]] | None = None
    seen: list[str] = []
    last = None
    for line in [*text.splitlines(), None]:
        tag = _RIS_TAG.match(line.rstrip()) if line is not None else None
        if line is None or (tag and tag[1] == "TY" and fields is not None):
            if seen and any(x.strip() for x in seen):
                yield {"malformed": "\n".join(seen).strip()}
            fields, seen = None, []
        if line is None:
            return
        if tag and tag[1] == "TY":
            if seen and any(x.strip() for x in seen):
                yield {"malformed": "\n".join(seen).strip()}
            fields, seen, last = {"TY": [(tag[2] or "").strip()]}, [line], "TY"
            continue
        seen.append(line)
        if fields is None:
            continue
        if tag and tag[1] == "ER":
            value = lambda c, fields=fields: next((" ".join(v.split()) for t in RIS_FIELDS[c] for v in fields.get(t, []) if v.strip()), None)
            year = _YEAR.search(value("year") or "")
            authors = [" ".join(a.split()) for t in RIS_AUTHORS for a in fields.get(t, []) if a.strip()]
            key = next((v.strip() for v in fields.get("ID", []) if v.strip()), None)
            yield {"kind": fields["TY"][0].lower(), "cite_key": key, "authors": authors, "year": int(year[0]) if year else None} | {c: value(c) for c in ("title", "journal", "doi", "pmid", "url")}
            fields, seen = None, []
        elif tag:
            last = tag[1]
            fields.setdefault(last, []).append(tag[2] or "")
        elif line.strip():
            fields[last][-1] += f" {line.strip()}"


def entries(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of ``ENTRY`` of a file; RIS by its name or by a first tag, else BibTeX."""
    text = content.decode("utf-8", "replace").lstrip("\ufeff")
    is_ris = path.lower().endswith(".ris") or re.match(r"\s*TY  -", text)
    for n, found in enumerate(ris_entries(text) if is_ris else bibtex_entries(text)):
        yield (path, n, *(found.get(c) for c in _NAMES[2:]))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), *[pa.string()] * 5]
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def parse_files(files: DataFrame) -> DataFrame:
    """``ENTRY`` rows of files (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _table(list(entries(path, content or b"")))

    return files.select("path", "content").mapInArrow(read, ENTRY)


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """``ENTRY`` rows of all .bib and .ris files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return parse_files(files.filter(F.lower("path").rlike(r"\.(bib|ris)$")))


def to_references(found: DataFrame, session_id: str) -> DataFrame:
    """(session_id, ref_num, authors, title, year, journal, doi, pmid): the entries that could be read, numbered by file and place."""
    from pyspark.sql.window import Window

    good = found.filter("malformed IS NULL").withColumn("session_id", F.lit(session_id))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("path", "ord")).cast("long")
    return good.select("session_id", number.alias("ref_num"), "authors", F.coalesce("title", F.lit("")).alias("title"), "year", "journal", "doi", "pmid")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    #: Files of a partition.
    FILES = 64

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        listed = where.get_file_info(fs.FileSelector(root, recursive=True)) if where.get_file_info(root).type == fs.FileType.Directory else [where.get_file_info(root)]
        paths = sorted(f.path for f in listed if f.type == fs.FileType.File and re.search(r"(?i)\.(bib|ris)$", f.path))
        return [_Files(paths[i : i + self.FILES]) for i in range(0, len(paths), self.FILES)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where = fs.FileSystem.from_uri(self.options["path"])[0] if "://" in self.options["path"] else fs.LocalFileSystem()
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                yield _table(list(entries(path, f.read())))


class BibliographySource(DataSource):
    """``spark.dataSource.register(BibliographySource)``, then ``spark.read.format("bibliography").load(folder)``; the folder is one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
