"""Readers: files and markup to tables of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.cells: list[tuple[int, int, int, str]] = []
        self.tag, self.text, self.silent, self.table, self.row, self.column, self.cell = None, [], 0, -1, -1, -1, None

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if self.tag and text:
            self.out.append((self.tag, text))
        self.tag, self.text = None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in BLOCKS:
            self.close_block()
            self.tag = tag
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.column, self.cell = self.column + 1, []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == self.tag:
            self.close_block()
        elif tag in ("td", "th") and self.cell is not None:
            self.cells.append((self.table, self.row, self.column, " ".join("".join(self.cell).split())))
            self.cell = None

    def handle_data(self, data):
        if not self.silent:
            if self.cell is not None:
                self.cell.append(data)
            elif self.tag:
                self.text.append(data)


def _parsed(html: str | None) -> _Blocks:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ix, kind, text) of headings, paragraphs and list items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, k, kind, text) for i, html in zip(b.page_id, b.html, strict=True) for k, (kind, text) in enumerate(_parsed(html).out)], columns=["page_id", "ix", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ix int, kind string, text string")


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, column, text) of table cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *cell) for i, html in zip(b.page_id, b.html, strict=True) for cell in _parsed(html).cells], columns=["page_id", "table", "row", "column", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table int, row int, column int, text string")


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon-separated files with a header, as the master lists and audits come."""
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)
