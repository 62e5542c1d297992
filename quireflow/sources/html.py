"""HTML pages as blocks, with the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements that make blocks, and elements whose content isn't text.
KINDS = {"title": "heading", "h1": "heading", "h2": "heading", "h3": "heading", "p": "paragraph", "li": "list", "nav": "header", "header": "header", "footer": "footer", "td": "table", "pre": "code", "figcaption": "caption"}
SILENT = {"script", "style"}
SCHEMA = "page_id long, ord long, type string, text string"


class BlockParser(HTMLParser):
    """Collects (type, text); a block ends where the next begins, so unclosed paragraphs are no matter."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.kind, self.held, self.silent, self.around = "paragraph", [], 0, []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((self.kind, text))
        self.held = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in KINDS:
            self.flush()
            if tag in ("nav", "header", "footer"):
                self.around.append(tag)
            self.kind = KINDS[self.around[-1]] if self.around else KINDS[tag]
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in KINDS:
            self.flush()
            if self.around and self.around[-1] == tag:
                self.around.pop()
            self.kind = KINDS[self.around[-1]] if self.around else "paragraph"

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)


def parse(page: str) -> list[tuple[str, str]]:
    p = BlockParser()
    p.feed(page)
    p.close()
    p.flush()
    return p.blocks


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, type, text of pages (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, kind, text) for i, page in zip(b["page_id"], b["html"], strict=True) for k, (kind, text) in enumerate(parse(page or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "type", "text"])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)
