"""HTML pages to typed text blocks and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers
from ..plans.registry import query
from ..plans.session import table

DROPPED = ("script", "style", "noscript", "iframe", "svg")
OUTSIDE = ("nav", "footer", "header", "aside", "form")
BREAKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "main")
CONTENT = ("article", "main")
LEAST_CHARS = 8
#: Elements without an end (fixed values).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Lines(HTMLParser):
    """Collects text lines of the page, and apart those inside the content container; a small helper of html_blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.all, self.content = [[]], [[]]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in VOID:
            self.open.append(tag)
        if tag in BREAKS:
            self.all.append([])
            self.content.append([])

    def handle_endtag(self, tag: str) -> None:
        # An element ends with its parent: what was left open inside it is closed too.
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag in BREAKS:
            self.all.append([])
            self.content.append([])

    def handle_data(self, data: str) -> None:
        # A content container does not stand in a header or menu, so one that begins there shows that its end is missing.
        main = max((i for i, t in enumerate(self.open) if t in CONTENT), default=-1)
        if not any(t in DROPPED or t in OUTSIDE and i > main for i, t in enumerate(self.open)):
            self.all[-1].append(data)
            if main >= 0:
                self.content[-1].append(data)

    def lines(self) -> list[str]:
        found = [x for x in (" ".join("".join(parts).split()) for parts in self.content) if x]
        return found or [x for x in (" ".join("".join(parts).split()) for parts in self.all) if x]


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, lines): the visible text lines of each page's content container, or of its body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html in batch.column(1).to_pylist():
                parser = _Lines()
                parser.feed(html or "")
                parser.close()
                out.append(parser.lines())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["page_id", "lines"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, lines array<string>")


def kept_lines(lines: Column) -> Column:
    """Lines of eight characters or more without boilerplate words or low-signal patterns, the first of equals."""
    good = lambda x: (F.length(x) >= LEAST_CHARS) & ~_any(x, markers.BOILERPLATE) & ~x.rlike("|".join(f"(?:{p})" for p in markers.LOW_SIGNAL_LINES))
    return F.array_distinct(F.filter(lines, good))


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def title_of(html: Column) -> Column:
    """The first h1, else h2, else title, tags removed."""
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1), "<[^>]*>", "")), F.lit("")) for t in ("h1", "h2", "title")]
    return F.coalesce(*found)


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overview row and the text blocks of each page; a notice where nothing readable is left."""
    pages = table(spark, sf_dir, "pages")
    lines = html_lines(pages).select("page_id", kept_lines(F.col("lines")).alias("lines"))
    blocks = F.transform("lines", lambda x: F.struct(F.when(F.length(x) <= 40, "heading").otherwise("paragraph").alias("type"), x.alias("text")))
    total = F.aggregate("lines", F.lit(0), lambda acc, x: acc + F.length(x))
    overview = F.array(F.struct(F.lit("paragraph").alias("type"), F.concat(F.size("lines").cast("string"), F.lit(" blocks")).alias("text")))
    notice = F.array(F.struct(F.lit("ocr_notice").alias("type"), F.lit("no readable text").alias("text")))
    return lines.select("page_id", F.posexplode(F.when(total < 12, notice).otherwise(F.concat(overview, blocks))).alias("block", "b")).select("page_id", "block", "b.type", "b.text")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '') AS h1, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS n_links, len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: contains(lower(x), '.pdf') OR contains(lower(x), 'download'))) AS n_files FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links, and links to files of each page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    files = F.filter(links, lambda x: F.lower(x).contains(".pdf") | F.lower(x).contains("download"))
    h1 = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", h1.alias("h1"), F.size(links).cast("long").alias("n_links"), F.size(files).cast("long").alias("n_files"))
