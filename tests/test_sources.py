"""Readers of documents, and streams against their row by row form."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.sources import documents as src
from tessera.streaming import feeds

HTML = """<html><head><title>T &amp; U</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><p>One <b>two</b></p><a href="/x.pdf">File</a>
<table><tr><th>Title</th><th>Count</th></tr><tr><td>Dev</td><td>3</td></tr><tr><th>Title</th><th>Count</th></tr><tr><td>Ops</td><td>1</td></tr></table></body></html>"""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_html(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id int, html string")
    texts = [r.text for r in src.html_fragments(pages, "id", "html").orderBy("place").collect()]
    assert texts[0] == "T & U" and "One two" in texts and not any("no" == t or "var" in t for t in texts)
    assert [(r.href, r.title) for r in src.html_links(pages, "id", "html").collect()] == [("/x.pdf", "File")]
    rows = src.headed_rows(src.html_cells(pages, "id", "html"), ["id", "sheet"], {"title": ["title", "post"], "count": ["count"]})
    assert sorted((r.title, r["count"]) for r in rows.collect()) == [("Dev", "3"), ("Ops", "1")]


def test_office_files(spark):
    sheet = '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c></row></sheetData><mergeCells><mergeCell ref="B1:B2"/></mergeCells></worksheet>'
    book = zipped({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<sst xmlns="x"><si><t>shared</t></si></sst>'})
    word = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    files = spark.createDataFrame([("a.xlsx", book), ("b.docx", word), ("c.zip", zipped({f"{i}.txt": "x" for i in range(40)}))], "name string, content binary")
    kinds = {r.name: r.kind for r in files.select("name", src.media_type(F.col("content"), F.col("name")).alias("kind")).collect()}
    assert kinds == {"a.xlsx": "XLSX", "b.docx": "DOCX", "c.zip": "ZIP"}
    cells = {(r.row, r.column): r.value for r in src.workbook_cells(files.filter("name = 'a.xlsx'"), "name", "content").collect()}
    assert cells == {(0, 0): "shared", (0, 1): "7", (1, 0): "in", (1, 1): "7"}
    assert [(r.kind, r.text) for r in src.word_fragments(files.filter("name = 'b.docx'"), "name", "content").collect()] == [("paragraph", "Hello"), ("cell", "cell")]
    entries = src.archive_entries(files.filter("name = 'c.zip'"), "name", "content").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in entries} == {"OK": 32, "TOO_MANY": 8}


def test_charset_and_json(spark):
    df = spark.createDataFrame([(bytearray("中文".encode("gbk")), "text/html; charset=GBK"), (bytearray(b"\xef\xbb\xbfabc"), None), (bytearray('<meta charset="gb2312">中'.encode("gbk")), None)], "b binary, h string")
    assert [r.t for r in df.select(src.decoded("b", "h").alias("t")).collect()] == ["中文", "abc", '<meta charset="gb2312">中']
    pages = spark.createDataFrame([(1, '{"items":[{"title":"a"},{"title":"b"}],"total":3}')], "page int, body string")
    assert [(r.item.title, r.declared) for r in src.pages_to_rows(pages, "body", "title: string", "total").collect()] == [("a", 3), ("b", 3)]
    links = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("p9", None)], "url string, next string")
    assert [(r.url, r.step) for r in src.followed(links, "url", "next", "p1").orderBy("step").collect()] == [("p1", 0), ("p2", 1), ("p3", 2)]
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(300)], "url string, next string")
    assert sorted((r.step, r.url) for r in src.followed(chain, "url", "next", "p0").collect()) == [(i, f"p{i}") for i in range(300)]


@pytest.mark.parametrize(
    "observations, want",
    [
        ([("OK", "a", 0), ("OK", "a", 1), ("NOT_MODIFIED", None, 2), ("OK", "b", 3)], ["ADDED", "UNCHANGED", "UNCHANGED", "UPDATED"]),
        ([("OK", "a", 0), ("GONE", None, 3600), ("GONE", None, 7200), ("GONE", None, 7200 + 6 * 3600), ("OK", "a", 90000)], ["ADDED", "UNCHANGED", "UNCHANGED", "DEACTIVATED", "UPDATED"]),
        ([("OK", "a", 0), ("GONE", None, 1), ("OK", "a", 2), ("GONE", None, 90000)], ["ADDED", "UNCHANGED", "UNCHANGED", "UNCHANGED"]),
        ([("FAILURE", None, 0), ("GONE", None, 1), ("OK", "a", 2), ("FAILURE", None, 3)], ["NONE", "NONE", "ADDED", "NONE"]),
    ],
)
def test_document_steps(observations, want):
    state, got = None, []
    for kind, print_, at in observations:
        name, _, state = feeds.step(state, kind, print_, at)
        got.append(name)
    assert got == want


def test_stream_equals_steps(spark):
    """The stream gives what the steps give, event by event."""
    from tessera.queries import QUERIES

    rows = feeds.observed(spark.read.parquet(f"{SF}/events.parquet")).orderBy("ts", "event_id").collect()
    states, want = {}, set()
    for r in rows:
        name, process, states[r.document] = feeds.step(states.get(r.document), r.kind, r["print"], r.ts.timestamp())
        if name in ("ADDED", "UPDATED", "DEACTIVATED"):
            want.add((r.document, r.event_id, name, process))
    assert want == {tuple(r) for r in QUERIES["stream_change_feed"](spark, SF).collect()}


def test_page_filter_reaches_the_scan(spark):
    """Filters and columns of a plan are those of its scan."""
    from tessera.queries import QUERIES

    plan = QUERIES["semi_exists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan


class Handle:
    """What a processor sees of its state."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.discard(at)


def test_a_document_with_many_observations():
    """A million rows of one key pass in parts: memory stays that of a part; what comes in several batches is the same."""
    import tracemalloc

    import pandas as pd

    kinds = ["OK", "NOT_MODIFIED", "GONE", "FAILURE", "GONE"]

    def parts(n, start=0):
        for at in range(start, start + n, 10_000):
            ids = range(at, at + 10_000)
            yield pd.DataFrame({"event_id": ids, "us": [i * 4 * 3600 * 10**6 for i in ids], "kind": [kinds[(i * 2654435761 >> 7) % 5] for i in ids], "print": [f"p{i // 50}" for i in ids]})

    handle, machine = Handle(), feeds.DocumentStates()
    machine.init(handle)
    tracemalloc.start()
    rows = sum(len(out) for out in machine.handleInputRows((1,), parts(1_000_000), None))
    assert rows >= 1_000_000 and tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    one, many = [], []
    for found, steps in ((one, [(40_000, 0)]), (many, [(10_000, i) for i in range(0, 40_000, 10_000)])):
        handle, machine = Handle(), feeds.DocumentStates()
        machine.init(handle)
        for n, start in steps:
            found += [(None if pd.isna(r[1]) else r[1], *r[2:4]) for out in machine.handleInputRows((1,), parts(n, start), None) for r in out.itertuples(index=False)]
            assert len(handle.timers) <= 1
    assert one == many and {x for _, x, _ in one} >= {"ADDED", "UPDATED", "DEACTIVATED", "CONFIRM_DUE"}
    late = pd.concat(list(machine.handleInputRows((1,), iter([next(parts(10_000))]), None)))
    assert set(late.transition) == {"LATE"}


def test_change_log(spark, tmp_path):
    """Row groups and filters that cannot match are left out; equal times at the cursor are told apart by id; a resumed read gives each change once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.sources import changelog as log

    log.registered(spark)
    rows = [(i, i // 7) for i in range(1000)]  # seven changes at a time
    stamp = lambda t: pa.array([x * 1_000_000 for x in t], pa.timestamp("us"))

    def write(name, part):
        pq.write_table(pa.table({"id": pa.array([i for i, _ in part], pa.int64()), "at": stamp([t for _, t in part]), "what": [f"c{i}" for i, _ in part]}), tmp_path / "log" / name, row_group_size=100)

    (tmp_path / "log").mkdir()
    write("a.parquet", rows[:500])
    options = {"path": str(tmp_path / "log")}
    full = spark.read.format("changes").options(**options).load()
    assert full.count() == 500 and full.rdd.getNumPartitions() == 5
    late = full.filter("at >= timestamp_ntz'1970-01-01 00:01:00' and what <> 'c450'")
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "1970" not in plan and "c450" in plan and late.rdd.getNumPartitions() == 1
    assert {r.id for r in late.collect()} == {i for i, t in rows[:500] if t >= 60 and i != 450}
    after = {"afterAt": str(30 * 1_000_000), "afterKey": "212"}
    for extra, ids in ((after, {i for i, t in rows[:500] if (t, i) > (30, 212)}), ({"afterAt": "999000000", "afterKey": "0"}, set())):
        assert {r.id for r in spark.read.format("changes").options(**options, **extra).load().collect()} == ids

    seen = []
    for part in (rows[:0], rows[500:704], rows[704:1000]):  # 704 is in the midst of equal times
        if part:
            write(f"{part[0][0]}.parquet", part)
        stream = spark.readStream.format("changes").options(**options).load()
        seen.append(feeds.drained(stream, str(tmp_path / "out")).count())
    assert seen == [500, 704, 1000]
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "out")).collect()) == [i for i, _ in rows]


def test_fragments_hold_all_text(spark):
    """The blocks of every page together are its text, in order, less what no one sees; and each is one line with its print."""
    import hashlib
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(120)
    found = {}
    for r in src.html_fragments(pages, "page_id", "html").orderBy("page_id", "place").collect():
        found.setdefault(r.page_id, []).append(r.text)
        assert r.text == " ".join(r.text.split()) != "" and r.sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    for r in pages.collect():
        seen = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|noscript|template)\b.*?</\1\s*>", "", r.html)
        want = html.unescape(re.sub(r"(?s)<[^>]*>", "", seen))
        assert "".join("".join(found.get(r.page_id, [])).split()) == "".join(want.split()), r.page_id
