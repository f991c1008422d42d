"""Paths, file contents and model inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.registry import ModelSpec

# File name extensions that are indexed, with their language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".rb": "ruby",
    ".php": "php",
    ".sql": "sql",
    ".sh": "bash",
    ".md": "markdown",
}

# Directories that are never indexed.
SKIPPED_DIRECTORIES = [
    "node_modules",
    ".git",
    "__pycache__",
    ".venv",
    "venv",
    "dist",
    "build",
    ".next",
    ".cache",
    "vendor",
    "target",
]

EMBEDDED_CHARS = 500
# A window of a long content begins so many characters after the one before.
WINDOW_STEP = 400
STORED_CHARS = 10_000

# Any character but white space. Java's (?U)\s lacks the separators U+001C to U+001F.
NOT_SPACE = r"[^\s\x1c-\x1f]"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of the file name in lower case; '' for none or a bare dotfile."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def language_of(path: Column) -> Column:
    """Language by extension, NULL when the file is not indexed."""
    known = F.create_map(
        *[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair]
    )
    return F.element_at(known, extension(path))


def in_skipped_directory(path: Column) -> Column:
    """True when any component of a path relative to its root is a skipped directory."""
    return F.arrays_overlap(
        F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])
    )


# An escape character from the private-use area, and the two codes it introduces.
_ESCAPE = "\ue0f1"


def lenient_utf8(content: Column) -> Column:
    """Bytes as text: undecodable bytes are dropped, line ends become a line feed.

    Decoding marks bad bytes with U+FFFD. A U+FFFD which the file really contains is
    escaped before that and restored after, so only bad bytes are dropped. Files which
    are valid UTF-8 skip all of it.
    """
    raw = content.cast("string")
    escaped = F.replace(
        F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")),
        F.lit("\ufffd"),
        F.lit(_ESCAPE + "1"),
    )
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit("\ufffd"), F.lit(""))
    restored = F.replace(
        F.replace(cleaned, F.lit(_ESCAPE + "1"), F.lit("\ufffd")),
        F.lit(_ESCAPE + "0"),
        F.lit(_ESCAPE),
    )
    decoded = F.when(F.is_valid_utf8(raw), raw).otherwise(restored)
    return F.regexp_replace(decoded, r"\r\n?", "\n")


def not_blank(content: Column) -> Column:
    return F.coalesce(content.rlike("(?U)" + NOT_SPACE), F.lit(False))


def decoded_text(value: Column) -> Column:
    """Bytes as UTF-8 text, any other type as its text form; bytes that are no UTF-8: NULL.

    Only the row that holds them is without text; the others are not held up.
    """
    return F.try_validate_utf8(value.cast("string"))


def embedding_text(
    chunk_type: Column, name: Column, content: Column, file_path: Column, language: Column
) -> Column:
    """What is embedded for a chunk: its heading and the first 500 characters."""
    head = F.substring(content, 1, EMBEDDED_CHARS)
    return F.concat(_heading(chunk_type, name, file_path, language), head)


def embedding_windows(
    chunk_type: Column, name: Column, content: Column, file_path: Column, language: Column
) -> Column:
    """The whole chunk as an array of texts to embed: its heading and 500 characters each.

    The first is `embedding_text`; every other begins 400 characters after the one before, so
    that a passage at the end of one is whole in the next. The last reaches the end.
    """
    beyond = F.greatest(F.char_length(content) - EMBEDDED_CHARS, F.lit(0))
    last = F.ceil(beyond / WINDOW_STEP).cast("int")
    heading = _heading(chunk_type, name, file_path, language)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.concat(heading, F.substring(content, i * WINDOW_STEP + 1, F.lit(EMBEDDED_CHARS))),
    )


def _heading(chunk_type: Column, name: Column, file_path: Column, language: Column) -> Column:
    definition = F.concat(language, F.lit(" "), chunk_type, F.lit(" "), name, F.lit(": "))
    whole_file = F.concat(file_path, F.lit(": "))
    return F.when(chunk_type.isin("function", "class"), definition).otherwise(whole_file)


def with_role_prefix(text: Column, spec: ModelSpec, role: str) -> Column:
    prefix = spec.role_prefix(role)
    return F.concat(F.lit(prefix), text) if prefix else text


def stored_content(content: Column) -> Column:
    """The stored part of a chunk; line numbers and vectors come from all of it."""
    return F.substring(content, 1, STORED_CHARS)


def tokens(text: Column, max_length: int | None = None) -> Column:
    """Lower-case words (runs of letters and digits), cut at ``max_length`` tokens."""
    # The last piece of a split with a limit is the unsplit rest. Two pieces more than
    # wanted leave room for it and for an empty one before the first word.
    pieces = -1 if max_length is None else max_length + 2
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", pieces), "")
    return words if max_length is None else F.slice(words, 1, max_length)


def first_words(text: Column, count: int) -> Column:
    """A text up to the end of its word number ``count``, with all between the words."""
    pieces = F.split(text, r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])", count + 1)
    return F.when(text.isNotNull(), F.array_join(F.slice(pieces, 1, count), ""))


def padded_ids(ids: Column, length: int) -> Column:
    """Token numbers filled with 0 up to ``length``."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), missing))


def attention_mask(ids: Column, length: int) -> Column:
    """1 for each token, 0 for the fill up to ``length``."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(
        F.array_repeat(F.lit(1).cast("bigint"), F.size(ids)),
        F.array_repeat(F.lit(0).cast("bigint"), missing),
    )
