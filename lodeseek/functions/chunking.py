"""Source text to chunks: functions and classes of Python files, else whole files.

The definitions of a Python file depend on each other in sequence: where one ends decides
what may start next. A fold over the lines in Spark SQL copies its whole result at every
line, so its cost grows with the square of a file. Here Arrow batches of files go through
two searches per definition, for its start and for its end, over the text as a whole; the
cost is linear and a line costs no Python step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.arrays import row_ranges
from lodeseek.functions.text import file_name, not_blank
from lodeseek.schemas import CHUNK_ARRAY

_CHUNKS = pa.list_(
    pa.struct(
        [
            ("chunk_type", pa.string()),
            ("name", pa.string()),
            ("content", pa.string()),
            ("start_line", pa.int32()),
            ("end_line", pa.int32()),
        ]
    )
)

# Bytes of files whose chunks are Python objects at a time.
BYTES_AT_ONCE = 1 << 20

# White space within a line.
_GAP = r"[^\S\n]"
_START = re.compile(
    rf"^(?P<indent>{_GAP}*)"
    rf"(?:def{_GAP}+(?P<function>\w+){_GAP}*\(|class{_GAP}+(?P<class>\w+))",
    re.MULTILINE,
)
# The first line that ends a class: filled, and starting with neither blank nor tab.
_CLASS_END = re.compile(rf"^(?![ \t]|{_GAP}*$)", re.MULTILINE)


def _function_end(indent: int) -> re.Pattern:
    """The first line that ends a function: filled, not deeper indented, no comment.

    The `re` module keeps compiled patterns, so asking again costs a lookup.
    """
    deeper = rf" {{{indent + 1}}}|\t{{{indent // 4 + 1}}}"
    return re.compile(rf"^(?!{deeper}|{_GAP}*(?:#|$))", re.MULTILINE)


def _definitions(text: str) -> Iterator[tuple]:
    """Top-most definitions of a file, in order: a chunk each."""
    at, line = 0, 1  # a line start, and its number
    while opened := _START.search(text, at):
        start = opened.start()
        line += text.count("\n", at, start)
        kind = "function" if opened["function"] else "class"
        end = _function_end(len(opened["indent"])) if opened["function"] else _CLASS_END
        following = text.find("\n", opened.end()) + 1
        closed = end.search(text, following) if following else None
        # Without the line feed before the line that ends it.
        chunk = text[start : closed.start() - 1] if closed else text[start:]
        last = line + chunk.count("\n")
        yield kind, opened[kind], chunk, line, last
        if not closed:
            return
        at, line = closed.start(), last + 1


def definition_lists(texts: pa.Array) -> pa.Array:
    """The chunks of a batch of files, few of them as Python objects at a time."""
    names = [f.name for f in _CHUNKS.value_type]

    def chunks(some: pa.Array) -> pa.Array:
        found = [
            None if text is None else [dict(zip(names, chunk)) for chunk in _definitions(text)]
            for text in some.to_pylist()
        ]
        return pa.array(found, _CHUNKS)

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = [chunks(texts[some]) for some in row_ranges(sizes, BYTES_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], _CHUNKS)


def python_definitions(content: Column) -> Column:
    """Function and class chunks of a Python file; NULL for NULL."""

    @F.arrow_udf(CHUNK_ARRAY)
    def find(texts: pa.Array) -> pa.Array:
        return definition_lists(texts)

    return find(content)


def file_chunk(content: Column, file_path: Column) -> Column:
    """One chunk for the whole file; lines are counted with a trailing empty one."""
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.array(
        F.struct(
            F.lit("file").alias("chunk_type"),
            file_name(file_path).alias("name"),
            content.alias("content"),
            F.lit(1).alias("start_line"),
            (feeds + 1).alias("end_line"),
        )
    ).cast(CHUNK_ARRAY)


def chunks_of(content: Column, file_path: Column, language: Column) -> Column:
    """Chunks of a file: definitions in Python, else the file.

    A Python file without definitions is one file chunk, unless it is blank.
    """
    # Other files are not sent to Python, nor are Python files without either keyword.
    searched = F.when(
        (language == "python") & (content.contains("def") | content.contains("class")), content
    )
    definitions = python_definitions(searched)
    return (
        F.when(F.size(definitions) > 0, definitions)
        .when((language != "python") | not_blank(content), file_chunk(content, file_path))
        .otherwise(F.array().cast(CHUNK_ARRAY))
    )
