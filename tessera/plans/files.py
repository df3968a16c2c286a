"""Postings as files of every kind, and read back: workbooks, word files, archives, charsets, tables and cards in HTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import cards
from tessera.sources import documents as src

#: Postings of a file.
SIZE = 40
_FILE = f"p_partkey // {SIZE}"


def _written(spark: SparkSession, sf: str, make: Callable[[int, list[dict]], bytes]) -> DataFrame:
    """file, content: each SIZE parts in a row as one file."""
    def run(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["p_partkey"])
        return pa.table({"file": pa.array([found[0]["file"]], pa.int64()), "content": pa.array([make(found[0]["file"], found)], pa.binary())})

    parts = table(spark, sf, "part").withColumn("file", F.floor(F.col("p_partkey") / SIZE))
    return parts.groupBy("file").applyInArrow(run, "file long, content binary")


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


#: What may stand above a column.
HEADS = {"title": ["岗位名称", "招聘岗位"], "kind": ["类别"], "size": ["人数", "招聘人数"], "code": ["代码"]}


def workbook(file: int, rows: list[dict]) -> bytes:
    """A title, up to two remarks, a header whose words and order vary, and rows; the kind stands once for neighbours that share it, in a merged cell; a header again in the midst."""
    names = list(HEADS) if file % 2 else list(reversed(HEADS))
    head = [HEADS[n][file % len(HEADS[n])] for n in names]
    texts, cells, merged = [], [], []

    def shared(text: str) -> int:
        texts.append(text)
        return len(texts) - 1

    def put(row: int, column: int, value: object) -> None:
        ref = f"{'ABCDEFG'[column]}{row + 1}"
        cells.append((row, f'<c r="{ref}"><v>{value}</v></c>' if isinstance(value, int) else f'<c r="{ref}" t="s"><v>{shared(value)}</v></c>'))

    put(0, 0, f"招聘计划 {file}")
    at = 1 + file % 3
    if at > 1:
        put(1, 1, "人数")  # a remark that looks like one column's head
    for column, word in enumerate(head):
        put(at, column, word)
    at += 1
    kind = names.index("kind")
    begin = 0
    for i, r in enumerate(rows):
        if i == len(rows) // 2 and file % 4 == 3:
            for column, word in enumerate(head):
                put(at, column, word)
            at += 1
        if i == 0 or r["p_type"] != rows[i - 1]["p_type"] or (i == len(rows) // 2 and file % 4 == 3):
            put(at, kind, r["p_type"])
            begin = at
        elif at > begin:
            merged = [m for m in merged if m[0] != begin] + [(begin, at)]
        for column, name in enumerate(names):
            if name != "kind":
                put(at, column, {"title": r["p_name"], "size": r["p_size"], "code": f"C{r['p_partkey']}"}[name])
        at += 1
    lines = "".join(f"<row>{''.join(x for y, x in cells if y == row)}</row>" for row in range(at))
    spans = "".join(f'<mergeCell ref="{"ABCDEFG"[kind]}{a + 1}:{"ABCDEFG"[kind]}{b + 1}"/>' for a, b in merged)
    sheet = f'<worksheet xmlns="s"><sheetData>{lines}</sheetData><mergeCells>{spans}</mergeCells></worksheet>'
    strings = "".join(f"<si><t>{escape(t)}</t></si>" for t in texts)
    return _zip({"xl/worksheets/sheet1.xml": sheet.encode(), "xl/sharedStrings.xml": f'<sst xmlns="s">{strings}</sst>'.encode()})


@query(f"SELECT {_FILE} AS file, p_name AS title, p_type AS kind, CAST(p_size AS VARCHAR) AS size, 'C' || p_partkey AS code FROM part")
def workbook_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks under their best header row, columns by the words above them, merged cells in full."""
    cells = src.workbook_cells(_written(spark, sf, workbook), "file", "content")
    return src.headed_rows(cells, ["file", "sheet"], HEADS).select("file", "title", "kind", "size", "code")


def word_file(file: int, rows: list[dict]) -> bytes:
    """A paragraph for the file, then a table row of two cells for each part, and a paragraph in runs after every tenth."""
    p = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{escape(t)}</w:t></w:r>" for t in runs) + "</w:p>"
    body = [p(f"附件 {file}")]
    for i, r in enumerate(rows):
        body.append(f"<w:tbl><w:tr><w:tc>{p(r['p_name'])}</w:tc><w:tc>{p(str(r['p_size']), ' 人')}</w:tc></w:tr></w:tbl>")
        if i % 10 == 9:
            body.append(p("以上", " 共 ", str(i + 1)) + p("  "))
    return _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{"".join(body)}</w:body></w:document>'.encode()})


@query(f"""WITH r AS (SELECT {_FILE} AS file, p_name, p_size, row_number() OVER (PARTITION BY {_FILE} ORDER BY p_partkey) - 1 AS i FROM part)
  SELECT DISTINCT file, 0 AS place, 'paragraph' AS kind, '附件 ' || file AS text FROM r UNION ALL SELECT file, CAST(1 + 2 * i + i // 10 AS INTEGER), 'cell', p_name FROM r UNION ALL SELECT file, CAST(2 + 2 * i + i // 10 AS INTEGER), 'cell', p_size || ' 人' FROM r UNION ALL SELECT file, CAST(3 + 2 * i + i // 10 AS INTEGER), 'paragraph', '以上 共 ' || (i + 1) FROM r WHERE i % 10 = 9""")
def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs and table cells of word files, in order."""
    return src.word_fragments(_written(spark, sf, word_file), "file", "content").select("file", "place", "kind", "text")


def archive(file: int, rows: list[dict]) -> bytes:
    """A text for each part; a folder, which is no entry; every sixth archive has one entry beyond the limit of bytes."""
    files = {"texts/": b""} | {f"texts/{r['p_partkey']}.txt": r["p_name"].encode() for r in rows}
    return _zip(files | ({"big.bin": b"\0" * (src.ENTRY_BYTES + 1)} if file % 6 == 5 else {}))


@query(f"""WITH r AS (SELECT {_FILE} AS file, p_partkey, p_name, row_number() OVER (PARTITION BY {_FILE} ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY {_FILE}) AS n FROM part)
  SELECT file, 'texts/' || p_partkey || '.txt' AS entry, octet_length(encode(p_name)) AS size, CASE WHEN i > {src.ENTRIES} THEN 'TOO_MANY' ELSE 'OK' END AS status, CASE WHEN i <= {src.ENTRIES} THEN p_name END AS text FROM r
  UNION ALL SELECT DISTINCT file, 'big.bin', {src.ENTRY_BYTES + 1}, CASE WHEN n >= {src.ENTRIES} THEN 'TOO_MANY' ELSE 'TOO_LARGE' END, NULL FROM r WHERE file % 6 = 5""")
def archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of archives, with those that the limits leave out."""
    entries = src.archive_entries(_written(spark, sf, archive), "file", "content")
    return entries.select("file", "entry", "size", "status", F.decode("content", "utf-8").alias("text"))


CHARSETS = (("gbk", "text/html; charset=GBK", "{}"), ("utf-8-sig", None, "{}"), ("gb18030", None, '<meta charset="gb2312">{}'), ("utf-8", "text/html", "{}"), ("utf-8", "text/html; charset=nonsense", "{}"), ("latin-1", "text/plain; charset=ISO-8859-1", None))


def encoded(file: int, rows: list[dict]) -> bytes:
    """The names of a file's parts in one of several charsets."""
    name, _, frame = CHARSETS[file % len(CHARSETS)]
    text = "，".join(r["p_name"] for r in rows) if frame else "é".join(r["p_name"] for r in rows)
    return (frame or "{}").format(text).encode(name)


@query(f"""SELECT {_FILE} AS file, CASE WHEN {_FILE} % 6 = 2 THEN '<meta charset="gb2312">' ELSE '' END || CASE WHEN {_FILE} % 6 = 5 THEN string_agg(p_name, 'é' ORDER BY p_partkey) ELSE string_agg(p_name, '，' ORDER BY p_partkey) END AS text FROM part GROUP BY {_FILE}""")
def charset_texts(spark: SparkSession, sf: str) -> DataFrame:
    """texts by their byte order mark, header or meta tag."""
    files = _written(spark, sf, encoded)
    header = F.element_at(F.array(*(F.lit(h).cast("string") for _, h, _ in CHARSETS)), (F.col("file") % len(CHARSETS) + 1).cast("int"))
    return files.select("file", src.decoded(F.col("content"), header).alias("text"))


def page(file: int, rows: list[dict]) -> bytes:
    """Two tables of a page: one of links only, one of postings; and blocks of text with signs, silent parts and open tags."""
    head = "".join(f"<th>{HEADS[n][file % len(HEADS[n])]}</th>" for n in ("code", "title", "size"))
    body = "".join(f"<tr><td>C{r['p_partkey']}</td><td> {escape(r['p_name'])} <b>&amp;</b></td><td>{r['p_size']}</td></tr>" for r in rows)
    return f"<html><head><title>T &lt;{file}&gt;</title><style>td{{}}</style></head><body><script>var x='<p>no</p>';</script><table><tr><td>a</td></tr></table><h1>计划</h1><p>第 {file} 页<br>共 {len(rows)} 条<table><tr>{head}</tr>{body}</table><p>完</body></html>".encode()


@query(f"SELECT {_FILE} AS file, 'C' || p_partkey AS code, p_name || ' &' AS title, CAST(p_size AS VARCHAR) AS size FROM part")
def html_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the table of a page that has the wanted columns."""
    pages = _written(spark, sf, page).withColumn("html", F.decode("content", "utf-8"))
    fields = {k: HEADS[k] for k in ("code", "title", "size")}
    return src.headed_rows(src.html_cells(pages, "file", "html"), ["file", "sheet"], fields).select("file", "code", "title", "size")


@query(f"""WITH n AS (SELECT {_FILE} AS file, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT {_FILE} AS file, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY {_FILE} ORDER BY p_partkey) - 1 AS i FROM part),
  b AS (SELECT file, 0 AS place, 'title' AS tag, 'T <' || file || '>' AS text FROM n UNION ALL SELECT file, 1, 'td', 'a' FROM n UNION ALL SELECT file, 2, 'h1', '计划' FROM n UNION ALL SELECT file, 3, 'p', '第 ' || file || ' 页 共 ' || n || ' 条' FROM n
    UNION ALL SELECT file, 4 + k, 'th', CASE k WHEN 0 THEN '代码' WHEN 1 THEN CASE WHEN file % 2 = 0 THEN '岗位名称' ELSE '招聘岗位' END ELSE CASE WHEN file % 2 = 0 THEN '人数' ELSE '招聘人数' END END FROM n, (SELECT unnest(range(3)) AS k)
    UNION ALL SELECT file, 7 + 3 * i + k, 'td', CASE k WHEN 0 THEN 'C' || p_partkey WHEN 1 THEN p_name || ' &' ELSE CAST(p_size AS VARCHAR) END FROM r, (SELECT unnest(range(3)) AS k) UNION ALL SELECT file, 7 + 3 * n, 'p', '完' FROM n)
  SELECT file, CAST(place AS INTEGER) AS place, tag, text, sha256(text) AS sha256 FROM b""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of text of pages, in order, with their prints."""
    pages = _written(spark, sf, page).withColumn("html", F.decode("content", "utf-8"))
    return src.html_fragments(pages, "file", "html").select("file", "place", "tag", "text", "sha256")


def group_page(file: int, rows: list[dict]) -> bytes:
    """Companies of a group, each with its postings below it or the words that there are none; some without a name or a list, others with more between; and cards of notices."""
    out = []
    for r in rows:
        k = r["p_partkey"]
        title = "" if k % 11 == 0 else f"<div class='title'>{escape(r['p_name'])} 公司</div>"
        out.append(f"<div class='remodel big' id='{'' if k % 3 == 0 else f'c{k}'}'>{title}<p>公司地址：杭州市{r['p_size']}号 电话 0571-8{k % 10**6:06d}1 邮箱 hr{k}@example.cn</p></div>")
        if k % 5 != 0:
            out.append("<br>" if k % 2 else "<p>间隔</p>")
            posts = " 暂无岗位 " if k % 4 == 1 else f"<ul><li>{escape(r['p_type'])}</li></ul>"
            out.append(f"<div class='postDiv'>{posts}</div>")
    items = "".join(f"<div class='li'><a href='newDet_{r['p_partkey']}_8.html'><div class='ar'><span>{'' if r['p_partkey'] % 9 == 0 else escape(r['p_name'])}</span></div></a></div>" for r in rows[:10])
    return f"<html><body><div class='colre'><div class='recruit'>招聘岗位</div>{''.join(out)}</div><div id='pd1Data'>{items}<div class='li'>no link</div></div></body></html>".encode()


_GROUPS = f"""WITH r AS (SELECT {_FILE} AS file, p_partkey AS k, p_name, p_size, row_number() OVER (PARTITION BY {_FILE} ORDER BY p_partkey) AS i FROM part), s AS (SELECT *, k % 4 = 1 AS empty FROM r WHERE k % 5 <> 0 AND k % 11 <> 0)"""


@query(f"""{_GROUPS} SELECT file, CASE WHEN k % 3 <> 0 THEN 'c' || k END AS anchor, p_name || ' 公司' AS name, CASE WHEN empty THEN 'EMPTY_CONFIRMED' ELSE 'CONTENT_FOUND' END AS state, '杭州市' || p_size || '号' AS address, '0571-8' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') || '1' AS phone, 'hr' || k || '@example.cn' AS email FROM s""")
def group_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of a group's page, each with what stands in the list below it."""
    pages = _written(spark, sf, group_page).withColumn("html", F.decode("content", "utf-8"))
    return cards.company_sections(pages, "file", "html").select("file", "anchor", "name", "state", "address", "phone", "email")


@query(f"""{_GROUPS}, n AS (SELECT file, count(*) AS sections, count(*) FILTER (empty) AS empty FROM s GROUP BY file), a AS (SELECT file, count(*) FILTER (i <= 10 AND k % 9 <> 0) AS cards FROM r GROUP BY file)
  SELECT file, coalesce(sections, 0) AS sections, coalesce(empty, 0) AS empty_sections, cards, CASE WHEN sections = empty THEN 'EMPTY_CONFIRMED' WHEN sections > 0 THEN 'CONTENT_FOUND' ELSE 'EMPTY_INFERRED' END AS state, CASE WHEN cards > 0 THEN 'CONTENT_FOUND' ELSE 'EMPTY_INFERRED' END AS cards_state FROM a LEFT JOIN n USING (file)""")
def page_states(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page has postings, says that it has none, or says nothing."""
    pages = _written(spark, sf, group_page).withColumn("html", F.decode("content", "utf-8"))
    return cards.page_states(pages, "file", "html").select("file", "sections", "empty_sections", "cards", "state", "cards_state")
