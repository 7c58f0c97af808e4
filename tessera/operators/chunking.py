"""Overlapping line chunks. Where a text is cut follows from prefix sums of its lines' sizes, by jumps from cut to cut, so the time is linear in the text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1000
BACK = 2
#: White space as Unicode lists it.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of texts that are turned into chunks before they are handed on.
HANDED = 4 << 20
KINDS = {"file_path": pa.string(), "ordinal": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string()}


def lines_of(content: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    lines = F.split(content, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(F.length(content) > 0, F.transform(lines, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(F.array().cast("array<string>"))


def cuts(sizes: np.ndarray, fixed: bool = False) -> list[tuple[int, int, int, int, int]]:
    """low, high, then, upto, first: a chunk is the lines low..high-1 and then..upto-1 (from 0); first: its start line. sizes: bytes of each line with its end.

    When the buffer reaches SIZE bytes at line c, the next one begins with the lines from o - 1 on up to c, o = max(c - BACK, 0).
    Near the top that reaches past c; those lines then come twice, and the start line is 0, unless fixed is set.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    out, low, high, then, first, kept = [], 0, 0, 0, 1, 0
    while True:
        upto = max(int(np.searchsorted(before, before[then] + SIZE - kept)), then + 1)
        if upto > n:
            break
        out.append((low, high, then, upto, first))
        o = max(upto - BACK, 0)
        low = max(o - 1, 0)
        high = min(upto if fixed else low + upto - o + 1, n)
        then, first, kept = upto, max(o, 1) if fixed else o, int(before[high] - before[low])
    out.append((low, high, then, n, first))
    return out


def _chunked(content: str, fixed: bool, texts: bool = True) -> Iterator[tuple[int, int, int, str | None]]:
    """ordinal, start_line, end_line, content; the last only if texts is set."""
    data = content.encode()
    if b"\r" in data:
        data = data.replace(b"\r\n", b"\n").removesuffix(b"\r")
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    ends = marks if data.endswith(b"\n") else np.append(marks, len(data))
    begins = np.concatenate([[0], marks + 1])[: len(ends)]
    found = cuts(ends - begins + 1, fixed)
    for ordinal, (low, high, then, upto, first) in enumerate(found):
        last = ordinal + 1 == len(found)
        text = None
        if texts or last:
            parts = [data[begins[a] : ends[b - 1]] for a, b in ((low, high), (then, upto)) if b > a]
            text = b"\n".join(parts).decode().strip(SPACES)
        if text or not last:  # only the rest behind the last full chunk may be blank and then falls away
            yield ordinal, first, upto, text


def chunks(files: DataFrame, path: str = "path", content: str = "content", fixed: bool = False, columns: Sequence[str] = tuple(KINDS)) -> DataFrame:
    """file_path, ordinal, start_line, end_line, content of every chunk, or only columns of these; files without text have none. Texts of chunks are made only if content is asked for."""
    asked = [(n, c) for n, c in enumerate(KINDS) if c in columns]
    texts = "content" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in asked]
        waiting = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text:
                    name = name.as_py()
                    for made in _chunked(text, fixed, texts):
                        row = (name, *made)
                        for column, (n, _) in zip(rows, asked):
                            column.append(row[n])
                    waiting += len(text)
                if waiting > HANDED:
                    yield _batch(rows, asked)
                    rows, waiting = [[] for _ in asked], 0
        yield _batch(rows, asked)

    kinds = {"file_path": "string", "content": "string"}
    return files.select(path, content).mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'int')}" for _, c in asked)).select(*columns)


def _batch(rows: list[list], asked: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, KINDS[c]) for x, (_, c) in zip(rows, asked)], names=[c for _, c in asked])
