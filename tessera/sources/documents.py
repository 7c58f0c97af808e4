"""One text written in parallel, in order: a Spark data source with a writer.

Rows are dealt out by ranges of their order. Each task writes its rows as a file of its own and tells the driver, as its
commit message, the file, its size and the sections that it begins and ends in. The driver sees nothing else: from the messages it
writes a manifest, which puts the files and what belongs between them in order, and only then there is a document. A task
that is run twice leaves a file that no manifest names; if the job fails, its files go.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"
SHAPE = {"head": "", "between": "\n", "joint": "\n", "tail": "\n"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str | None
    size: int
    rows: int
    first: int
    last: int


class DocumentWriter(DataSourceWriter):
    """Rows: section (a number), text. Texts of a section are parted by `between`, sections by `joint`, once for each step."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.shape = {k: options.get(k, v) for k, v in SHAPE.items()}

    def _glue(self, before: int, after: int) -> str:
        return self.shape["joint"] * (after - before) or self.shape["between"]

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, path = _place(self.path)
        name, rows, size, first, last = f"part-{uuid.uuid4()}", 0, 0, 0, 0
        out = None
        for section, text in iterator:
            if out is None:
                system.create_dir(path, recursive=True)
                out, first = io.BufferedWriter(system.open_output_stream(f"{path}/{name}"), 1 << 20), section
            data = ((self._glue(last, section) if rows else "") + text).encode()
            out.write(data)
            rows, size, last = rows + 1, size + len(data), section
        if out is not None:
            out.close()
        return Written(TaskContext.get().partitionId(), name if rows else None, size, rows, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _place(self.path)
        parts, section, begun = [{"text": self.shape["head"]}], 0, False
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            parts += [{"text": self._glue(section, m.first) if begun else self.shape["joint"] * m.first}, {"file": m.name, "size": m.size, "rows": m.rows}]
            section, begun = m.last, True
        parts.append({"text": self.shape["tail"], "after": section})
        system.create_dir(path, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-") and f.base_name not in {p.get("file") for p in parts}]
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps({"parts": parts, "sections": section, "shape": self.shape}).encode())
        for file in old:
            system.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _place(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{path}/{m.name}")


class DocumentSink(DataSource):
    """Options: path; head, between, joint, tail: what stands before, between texts, between sections and behind. In place of an older document."""

    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_document(rows: DataFrame, path: str, order: tuple[str, ...], **shape: str) -> None:
    """rows: section, text and the columns of `order`. path: a folder that all executors share, or a URI of a store."""
    rows.sparkSession.dataSource.register(DocumentSink)
    dealt = rows.repartitionByRange("section", *order).sortWithinPartitions("section", *order).select("section", "text")
    writer = dealt.write.format("ordered_document").mode("append").option("path", path)
    for key, value in shape.items():
        writer = writer.option(key, value)
    writer.save()


def read_document(path: str, sections: int | None = None) -> Iterator[str]:
    """The document in pieces. sections: the number of its last one; those that got no rows at the end are empty."""
    system, folder = _place(path.rstrip("/"))
    with system.open_input_stream(f"{folder}/{MANIFEST}") as file:
        made = json.loads(file.read())
    for part in made["parts"]:
        if "after" in part and sections is not None:
            yield made["shape"]["joint"] * (sections - part["after"])
        if "text" in part:
            yield part["text"]
        else:
            with system.open_input_stream(f"{folder}/{part['file']}") as file:
                yield from io.TextIOWrapper(io.BufferedReader(file, 1 << 20), encoding="utf-8", newline="")
