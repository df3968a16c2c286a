"""Sections and cards of group pages by hand: which list is whose, and what a page says of itself."""

from tessera.sources import cards

PAGE = """<div class='remodel' id='a'><span class="title">甲 公司</span><p>公司地址：西湖区1号 电话0571-87654321 x@y.cn<br>13812345678</p></div>
<div><div class='postDiv'>elsewhere</div></div><p>x</p><div class='postDiv'>暂无岗位</div>
<div class="remodel"><div class="title">乙</div></div><div class="remodel"><div class='title'>丙</div></div><div class="postDiv x"><ul><li>岗位</ul></div><div class="postDiv">second</div>
<div class="remodel"><p>no name</p></div><div class="postDiv">y</div>
<div id="pd1Data"><div class="li"><a href="/newDet_12_8.html">z</a><div class="ar"><span>题 目</span><span>日</span></div></div><div class="li"><div class="ar"><span>no link</span></div></div></div>"""


def test_sections(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<div class='remodel'><i class=title>甲</i></div><div class='postDiv'> 暂无岗位\n</div>")], "id int, html string")
    got = [(r.id, r.name, r.anchor, r.state, r.address, r.phone, r.email) for r in cards.company_sections(df, "id", "html").orderBy("id", "place").collect()]
    assert got == [(1, "甲 公司", "a", "EMPTY_CONFIRMED", "西湖区1号", "0571-87654321", "x@y.cn"), (1, "丙", None, "CONTENT_FOUND", None, None, None), (4, "甲", None, "EMPTY_CONFIRMED", None, None, None)]
    assert [(r.title, r.href, r.item) for r in cards.notice_cards(df, "id", "html").collect()] == [("题 目", "/newDet_12_8.html", "12")]
    states = {r.id: (r.sections, r.empty_sections, r.cards, r.state, r.cards_state) for r in cards.page_states(df, "id", "html").collect()}
    assert states == {1: (2, 1, 1, "CONTENT_FOUND", "CONTENT_FOUND"), 2: (0, 0, 0, "EMPTY_INFERRED", "EMPTY_INFERRED"), 3: (0, 0, 0, "EMPTY_INFERRED", "EMPTY_INFERRED"), 4: (1, 1, 0, "EMPTY_CONFIRMED", "EMPTY_INFERRED")}
