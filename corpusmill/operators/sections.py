"""Markdown text to sections, and their pages from a section list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusmill.functions.text import (
    clean_heading,
    trim_all,
    unix_newlines,
    without_page_markers,
)

_HEADING = r"(?d)^(#{1,6})[ \t]+([^\r\n]+)"
SECTION = "struct<title:string,level:smallint,content:string,page_start:int,page_end:int>"
#: Entries of the section list, from the cursor on, that a heading may match.
WINDOW = 4


def split_sections(markdown: Column, fallback_title: Column) -> Column:
    """Sections of a Markdown text, as an array of SECTION without pages.

    A section is an ATX heading and the text up to the next; text before the
    first heading and headings without body are dropped. Without any section
    the whole text is one, titled ``fallback_title``. A blank text has none; a
    null text gives null.
    """
    text = without_page_markers(unix_newlines(markdown))
    parts = F.split(text, r"(?md)^(?=#{1,6}[ \t]+[^\r\n]+$)")

    def section(part: Column) -> Column:
        return F.struct(
            trim_all(F.regexp_extract(part, _HEADING, 2)).alias("title"),
            F.length(F.regexp_extract(part, _HEADING, 1)).cast("smallint").alias("level"),
            trim_all(F.regexp_replace(part, _HEADING, "")).alias("content"),
            F.lit(None).cast("int").alias("page_start"),
            F.lit(None).cast("int").alias("page_end"),
        )

    headed = F.filter(F.transform(parts, section), lambda s: (s.level > 0) & (s.content != ""))
    whole = F.struct(
        fallback_title.cast("string").alias("title"),
        F.lit(1).cast("smallint").alias("level"),
        trim_all(text).alias("content"),
        F.lit(None).cast("int").alias("page_start"),
        F.lit(None).cast("int").alias("page_end"),
    )
    return (
        F.when(markdown.isNull(), F.lit(None))
        .when(F.size(headed) > 0, headed)
        .when(trim_all(text) != "", F.array(whole))
        .otherwise(F.array().cast(f"array<{SECTION}>"))
    )


def stamp_pages(sections: Column, listed: Column) -> Column:
    """``sections`` with pages from ``listed`` (title, page_start, page_end).

    Both are in document order. A section takes the pages of the first entry
    with an equal cleaned title among the WINDOW entries from the cursor on,
    and the cursor moves behind it; without one it keeps no pages and the
    cursor stays. A fold inside the row: no join can express it.
    """
    entries = F.transform(
        listed,
        lambda j: F.struct(
            clean_heading(j.title).alias("title"),
            j.page_start.cast("int").alias("page_start"),
            j.page_end.cast("int").alias("page_end"),
        ),
    )
    start = F.struct(
        F.array().cast(f"array<{SECTION}>").alias("done"), F.lit(1).cast("int").alias("cursor")
    )

    def step(state: Column, s: Column) -> Column:
        near = F.slice(entries, state.cursor, F.lit(WINDOW))
        title = clean_heading(s.title)
        at = F.array_position(F.transform(near, lambda e: F.coalesce(e.title, F.lit(""))), title)
        hit = F.when(at > 0, F.try_element_at(near, at.cast("int")))
        stamped = F.struct(
            s.title.alias("title"),
            s.level.alias("level"),
            s.content.alias("content"),
            F.when(at > 0, hit.page_start).otherwise(s.page_start).alias("page_start"),
            F.when(at > 0, hit.page_end).otherwise(s.page_end).alias("page_end"),
        )
        return F.struct(
            F.concat(state.done, F.array(stamped)).alias("done"),
            (F.when(at > 0, state.cursor + at.cast("int")).otherwise(state.cursor))
            .cast("int")
            .alias("cursor"),
        )

    folded = F.aggregate(sections, start, step, lambda state: state.done)
    usable = (F.size(sections) > 0) & (F.size(listed) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), folded).otherwise(sections)
