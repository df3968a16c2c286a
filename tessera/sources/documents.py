"""Documents as sources: media types, HTML fragments, links and tables, spreadsheets, word files, archives.

Each reader takes a DataFrame with a document's bytes or text and gives rows for what is inside, by Arrow batches;
rows are independent, so a large set is read in parallel as its files are dealt. The standard library
parses; PDF and binary XLS are not read (no parser is at hand), which media_type says.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_folder

#: Limits of an archive: entries, bytes of an entry, bytes of all.
ENTRIES, ENTRY_BYTES, ALL_BYTES = 32, 10 << 20, 25 << 20
_BLOCKS = {"p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "title", "div"}
_SILENT = {"script", "style", "noscript", "template"}


def media_type(content: Column, name: Column, header: Column | None = None) -> Column:
    """The type of a document by its first bytes, then by its header, then by its name."""
    start = F.hex(F.substring(content, 1, 8))
    ends = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    zipped = F.when(ends == "xlsx", "XLSX").when(ends == "docx", "DOCX").otherwise("ZIP")
    by_bytes = F.when(start.startswith("25504446"), "PDF").when(start.startswith("504B0304"), zipped).when(start.startswith("D0CF11E0"), "XLS").when(start.startswith("89504E47"), "PNG").when(start.startswith("FFD8FF"), "JPEG")
    text = F.lower(F.decode(F.substring(content, 1, 256), "iso-8859-1"))
    by_text = F.when(text.rlike(r"<!doctype html|<html|<head|<body"), "HTML")
    by_header = F.when(header.contains("html"), "HTML").when(header.contains("json"), "JSON") if header is not None else F.lit(None)
    by_name = F.when(ends.isin("htm", "html"), "HTML").when(ends == "json", "JSON").when(ends == "csv", "CSV")
    return F.coalesce(by_bytes, by_text, by_header, by_name, F.lit("UNKNOWN"))


def readable(kind: Column) -> Column:
    """What a document's type lets be done: PARSE, OCR_REQUIRED or UNSUPPORTED."""
    return F.when(kind.isin("HTML", "XLSX", "DOCX", "ZIP", "JSON", "CSV"), "PARSE").when(kind.isin("PNG", "JPEG"), "OCR_REQUIRED").otherwise("UNSUPPORTED")


class _Page(HTMLParser):
    """Text blocks, links and table cells of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.cells: list[tuple[int, int, int, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.link: list[str] | None = None
        self.table, self.row, self.column, self.cell = -1, -1, -1, None

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.open[-1] if self.open else "", text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in _BLOCKS or tag in _SILENT:
            self._flush()
            self.open.append(tag)
        if tag == "a":
            self.links.append((given.get("href") or "", ""))
            self.link = []
        elif tag == "img":
            self.links.append((given.get("src") or "", given.get("alt") or ""))
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.column, self.cell = self.column + 1, []

    def handle_endtag(self, tag):
        if tag in _BLOCKS or tag in _SILENT:
            self._flush()
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag == "a" and self.link is not None:
            href, _ = self.links[-1] if self.links else ("", "")
            if self.links:
                self.links[-1] = (href, " ".join("".join(self.link).split()))
            self.link = None
        elif tag in ("td", "th") and self.cell is not None:
            self.cells.append((self.table, self.row, self.column, " ".join("".join(self.cell).split())))
            self.cell = None

    def handle_data(self, data):
        if self.open and self.open[-1] in _SILENT:
            return
        self.text.append(data)
        if self.link is not None:
            self.link.append(data)
        if self.cell is not None:
            self.cell.append(data)

    @classmethod
    def of(cls, html: str | None) -> _Page:
        page = cls()
        page.feed(html or "")
        page.close()
        page._flush()
        return page


#: Rows of parts that a task holds before it hands them on.
PARTS_AT_ONCE = 4_096


def _exploded(df: DataFrame, key: str, body: str, schema: T.StructType, parts: Callable[[object], list[tuple]]) -> DataFrame:
    """key and, for each part of the body, a row."""
    full = T.StructType([df.schema[key], *schema.fields])
    at_once = PARTS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in full]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=full.names)

        # what goes out follows the parts of few bodies, however many bodies come in together
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                found, k = parts(value.as_py()), k.as_py()
                for i in range(0, len(found), at_once):
                    rows += [(k, *part) for part in found[i : i + at_once]]
                    if len(rows) >= at_once:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    return df.select(key, body).mapInArrow(run, full)


def html_fragments(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Text blocks of a page with their tag, place and print."""
    schema = T.StructType([T.StructField("tag", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("sha256", T.StringType())])
    return _exploded(pages, key, html, schema, lambda x: [(tag, i, text, hashlib.sha256(text.encode()).hexdigest()) for i, (tag, text) in enumerate(_Page.of(x).blocks)])


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links and images of a page in order, with their titles."""
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("title", T.StringType())])
    return _exploded(pages, key, html, schema, lambda x: [(i, href, title) for i, (href, title) in enumerate(_Page.of(x).links)])


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of a page's tables."""
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("sheet", "row", "column")), T.StructField("value", T.StringType())])
    return _exploded(pages, key, html, schema, lambda x: _Page.of(x).cells)


def chosen_links(links: DataFrame, host: str, keep: str, drop: str) -> DataFrame:
    """Links on a host whose title has what is wanted and not what is unwanted."""
    return links.filter(F.col("href").rlike(rf"^(https?://{host})?/") & F.col("title").rlike(keep) & ~F.col("title").rlike(drop))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_cells(data: bytes) -> list[tuple]:
    """(sheet, row, column, value) of a workbook; merged ranges give their value to each of their cells."""
    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
        column = 0
        for c in letters:
            column = column * 26 + ord(c) - 64
        return int(digits) - 1, column - 1

    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        for sheet, name in enumerate(names):
            cells: dict[tuple[int, int], str] = {}
            for e in ElementTree.fromstring(book.read(name)).iter():
                if _local(e.tag) == "c" and e.get("r"):
                    value = "".join(v.text or "" for v in e.iter() if _local(v.tag) in ("v", "t"))
                    cells[place(e.get("r"))] = shared[int(value)] if e.get("t") == "s" and value else value
                elif _local(e.tag) == "mergeCell":
                    (top, left), (bottom, right) = map(place, e.get("ref").split(":"))
                    value = cells.get((top, left), "")
                    cells |= {(r, c): value for r in range(top, bottom + 1) for c in range(left, right + 1)}
            out += [(sheet, r, c, v) for (r, c), v in sorted(cells.items()) if v != ""]
    return out


def workbook_cells(files: DataFrame, key: str, content: str) -> DataFrame:
    """Cells of XLSX workbooks."""
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("sheet", "row", "column")), T.StructField("value", T.StringType())])
    return _exploded(files, key, content, schema, _sheet_cells)


def _word_blocks(data: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as doc:
        root = ElementTree.fromstring(doc.read("word/document.xml"))
    inside = {id(p) for cell in root.iter() if _local(cell.tag) == "tc" for p in cell.iter() if _local(p.tag) == "p"}
    out = []
    for p in (e for e in root.iter() if _local(e.tag) == "p"):
        text = " ".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").split())
        if text:
            out.append(("cell" if id(p) in inside else "paragraph", len(out), text))
    return out


def word_fragments(files: DataFrame, key: str, content: str) -> DataFrame:
    """Paragraphs and table cells of DOCX files, in order."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())])
    return _exploded(files, key, content, schema, _word_blocks)


def _zip_entries(data: bytes) -> list[tuple]:
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in (i for i in archive.infolist() if not i.is_dir()):
            total += info.file_size
            status = "TOO_MANY" if len(out) >= ENTRIES else "TOO_LARGE" if info.file_size > ENTRY_BYTES or total > ALL_BYTES else "OK"
            out.append((info.filename, info.file_size, status, archive.read(info) if status == "OK" else None))
    return out


def archive_entries(files: DataFrame, key: str, content: str) -> DataFrame:
    """Entries of ZIP archives; those beyond the limits are named, without their bytes."""
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType())])
    return _exploded(files, key, content, schema, _zip_entries)


def headed_rows(cells: DataFrame, by: list[str], fields: dict[str, list[str]], depth: int = 31) -> DataFrame:
    """Rows of a table under the best header row: the first of those among `depth` that name most fields.

    fields: name and the words that may head its column. Gives by, row and a column per field; rows that repeat the
    header are left out.
    """
    label = F.coalesce(*(F.when(F.lower(F.trim("value")).isin([w.lower() for w in words]), F.lit(name)) for name, words in fields.items()))
    named = cells.withColumn("field", label)
    heads = named.filter(F.col("field").isNotNull() & (F.col("row") < depth)).groupBy(*by, "row").agg(F.countDistinct("field").alias("hits"))
    best = heads.groupBy(*by).agg(F.min(F.struct((-F.col("hits")).alias("h"), F.col("row").alias("head"))).alias("x")).select(*by, F.col("x.head").alias("head"), (-F.col("x.h")).alias("hits"))
    columns = named.join(best, by).filter("row = head and field is not null").groupBy(*by, "field", "head", "hits").agg(F.min("column").alias("column"))
    body = cells.join(columns, [*by, "column"]).filter("row > head")
    repeated = named.join(best, by).filter("row > head and field is not null").groupBy(*by, "row", "hits").agg(F.countDistinct("field").alias("again")).filter("again = hits").select(*by, "row")
    return body.groupBy(*by, "row").pivot("field", list(fields)).agg(F.first("value")).join(repeated, [*by, "row"], "left_anti")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series, header: pd.Series) -> pd.Series:
    """Text of bytes, by a byte order mark, the header, or a meta tag; UTF-8 otherwise. Spark decodes few charsets itself."""
    def one(data: bytes | None, said: str | None) -> str | None:
        if data is None:
            return None
        if data.startswith(b"\xef\xbb\xbf"):
            return data[3:].decode("utf-8", "replace")
        found = re.search(r"charset=([\w-]+)", said or "", re.I) or re.search(r"charset=[\"']?([\w-]+)", data[:1024].decode("latin-1"), re.I)
        name = found[1].lower() if found else "utf-8"
        try:
            return data.decode("gb18030" if name in ("gbk", "gb2312") else name, "replace")
        except LookupError:
            return data.decode("utf-8", "replace")

    return pd.Series([one(d, h) for d, h in zip(content, header, strict=True)], dtype=object)


def pages_to_rows(pages: DataFrame, body: str, item_schema: str, total: str | None = None) -> DataFrame:
    """Items of JSON listing pages, with the total that the page declares: a listing is complete if counts agree."""
    schema = f"items array<struct<{item_schema}>>" + (f", {total} bigint" if total else "")
    parsed = pages.withColumn("_page", F.from_json(body, schema))
    out = parsed.withColumn("item", F.explode("_page.items"))
    out = out.withColumn("declared", F.col(f"_page.{total}")) if total else out
    return out.drop("_page")


def followed(pages: DataFrame, url: str, next_url: str, start: str) -> DataFrame:
    """Pages reached from a first one by their next link, each once, with their step; a loop ends it.

    The jump that each page makes is doubled in every turn, and so are the pages that are reached: a chain of n pages takes
    about log2(n) turns, each a join that is checkpointed. Of pages with one address, the least link counts.
    """
    checkpoint_folder(pages.sparkSession)
    links = pages.groupBy(url).agg(F.min(next_url).alias(next_url)).filter(F.col(url).isNotNull())
    seen = links.filter(F.col(url) == start).select(url, F.lit(0).cast("long").alias("step")).checkpoint()
    jumps, size = links.select(F.col(url).alias("_from"), F.col(next_url).alias("_to")).join(links.select(F.col(url).alias("_to")), "_to", "left_semi").checkpoint(), 1
    while True:
        ahead = seen.join(jumps, F.col(url) == F.col("_from")).select(F.col("_to").alias(url), (F.col("step") + size).alias("step"))
        wider = seen.unionByName(ahead).groupBy(url).agg(F.min("step").alias("step")).checkpoint()
        if wider.count() == seen.count():
            break
        seen = wider
        twice = jumps.select(F.col("_from").alias("_start"), F.col("_to").alias("_from")).join(jumps, "_from")
        jumps, size = twice.select(F.col("_start").alias("_from"), "_to").checkpoint(), 2 * size
    return links.join(seen, url).select(url, next_url, F.col("step").cast("int").alias("step"))


def _array_after(text: str, marker: str) -> str | None:
    """The bracketed list that follows a marker and a colon or an equals sign in a script, without its comments; what stands in strings and comments is no bracket."""
    masked, bare, i, n = list(text), list(text), 0, len(text)
    while i < n:
        quoted = text[i] in "'\"`"
        if quoted:
            end = i + 1
            while end < n and text[end] != text[i]:
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, n)
        elif text.startswith("//", i):
            end = next((j for j in range(i, n) if text[j] in "\r\n"), n)
        elif text.startswith("/*", i):
            found = text.find("*/", i + 2)
            end = n if found < 0 else found + 2
        else:
            i += 1
            continue
        masked[i:end] = " " * (end - i)
        if not quoted:
            bare[i:end] = " " * (end - i)
        i = end
    plain = "".join(masked)
    starts = [m.end() - 1 for m in re.finditer(rf"(?<![A-Za-z0-9_$]){re.escape(marker)}\s*[:=]\s*\[", plain)]
    if len(starts) != 1:
        return None
    depth = 0
    for at in range(starts[0], n):
        depth += (plain[at] == "[") - (plain[at] == "]")
        if depth == 0:
            return "".join(bare[starts[0] : at + 1])
    return None


def embedded_items(pages: DataFrame, key: str, html: str, marker: str, item_schema: str) -> DataFrame:
    """Objects of the one list that follows a marker in a page's scripts, as JavaScript writes them: names and quotes of any kind, comments, a comma at the end.

    key, place and item; pages without such a list, or with several, give none.
    """
    schema = T.StructType([T.StructField("list", T.StringType())])
    lists = _exploded(pages, key, html, schema, lambda x: [(found,)] if x and (found := _array_after(x, marker)) else [])
    plain = F.regexp_replace("list", r",\s*([\]}])", "$1")
    options = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
    return lists.select(key, F.posexplode(F.from_json(plain, f"array<struct<{item_schema}>>", options)).alias("place", "item"))
