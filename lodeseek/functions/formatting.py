"""Search hits as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_LENGTH = 20
PREVIEW_CHARS = 300
PREVIEW_LINES = 8


def similarity_bar(similarity: Column) -> Column:
    """Full blocks for the score, cut towards zero, light blocks for the rest.

    A negative score has no full block and more than twenty light ones.
    """
    full = (similarity * BAR_LENGTH).cast("int")
    return F.concat(
        F.repeat(F.lit("█"), F.greatest(full, F.lit(0))),
        F.repeat(F.lit("░"), F.greatest(F.lit(BAR_LENGTH) - full, F.lit(0))),
    )


def score_line(similarity: Column) -> Column:
    return F.concat(
        F.lit("["), F.format_string("%.3f", similarity), F.lit("] "), similarity_bar(similarity)
    )


def location_label(
    repo_name: Column,
    file_path: Column,
    chunk_type: Column,
    name: Column,
    start_line: Column,
    end_line: Column,
) -> Column:
    """``repo/path :: type name (Lstart-end)``, without the parts that are missing."""
    named = F.coalesce(name != "", F.lit(False))
    placed = F.coalesce(start_line != 0, F.lit(False))
    return F.concat(
        repo_name,
        F.lit("/"),
        file_path,
        F.when(named, F.concat(F.lit(" :: "), chunk_type, F.lit(" "), name)).otherwise(""),
        F.when(
            placed,
            F.concat(
                F.lit(" (L"),
                start_line.cast("string"),
                F.lit("-"),
                F.coalesce(end_line.cast("string"), F.lit("None")),
                F.lit(")"),
            ),
        ).otherwise(""),
    )


def preview(content: Column) -> Column:
    """The first 300 characters as at most eight marked lines.

    The number of further lines is told only when there are more than eight line
    feeds, so nine lines show eight and no remark.
    """
    shown = F.when(
        F.length(content) > PREVIEW_CHARS,
        F.concat(F.substring(content, 1, PREVIEW_CHARS), F.lit("...")),
    ).otherwise(content)
    lines = F.split(shown, "\n", -1)
    feeds = F.size(lines) - 1
    marked = F.transform(
        F.slice(lines, 1, PREVIEW_LINES), lambda line: F.concat(F.lit("  │ "), line)
    )
    remark = F.when(
        feeds > PREVIEW_LINES,
        F.concat(
            F.lit("\n  │ ... ("),
            (feeds - PREVIEW_LINES).cast("string"),
            F.lit(" more lines)"),
        ),
    ).otherwise("")
    return F.concat(F.array_join(marked, "\n"), remark)


def result_text(show_content: bool = True) -> Column:
    """A hit, with the columns of the search result, as the text shown for it."""
    column = F.col
    head = F.concat(
        score_line(column("similarity")),
        F.lit("\n  📁 "),
        location_label(
            column("repo_name"),
            column("file_path"),
            column("chunk_type"),
            column("name"),
            column("start_line"),
            column("end_line"),
        ),
    )
    if not show_content:
        return head
    return F.concat(head, F.lit("\n"), preview(column("content")))
