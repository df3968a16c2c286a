"""Guides and grounded answers by hand: items over page ends, what is wrong with them, and what an answer may rest on."""

from tessera.plans.guides import grounded
from tessera.sources.guides import guide_items

PAGES = [
    (1, 2, "答：可以\r\n 的。\n二、关于报名\n3．不是题\n3. 报名 后能改吗？不能。"),
    (1, 1, "应聘指南\n一、关于年龄条件\n1. 年龄怎么\n  算？算到 2025 年\n3 月。\n2.应届毕业生要\n体检吗？"),
    (2, 1, "1.没有章节？有答案\n一、其他有关问题\n2.没有问号\n4. 跳号？是。\n5. 没有答案？"),
    (3, 1, None),
    (4, 1, ""),
]


def test_guide_items(spark):
    df = spark.createDataFrame(PAGES, "guide int, page int, text string")
    got = {(r.guide, r.number): r for r in guide_items(df, "guide", "page", "text").collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 1): "OK", (1, 2): "OK", (1, 3): "OK", (2, 1): "NO_SECTION", (2, 2): "NO_QUESTION_MARK", (2, 4): "NUMBER_GAP", (2, 5): "NO_ANSWER"}
    first, second, third = got[1, 1], got[1, 2], got[1, 3]
    assert (first.section_number, first.section, first.question, first.answer) == ("一", "关于年龄条件", "年龄怎么算？", "算到2025年3月。")
    assert (second.question, second.answer, second.start_page, second.end_page) == ("应届毕业生要体检吗？", "答：可以的。", 1, 2)
    assert second.tags == ["age", "fresh_graduate", "medical_exam"] and third.tags == ["registration"]
    assert (third.section, third.question, third.answer) == ("关于报名", "报名后能改吗？", "不能。")
    assert first.rule_id.startswith("rule_") and len({r.rule_id for r in got.values()}) == 7


def test_grounded(spark):
    ask = "要不要现在确认「性别」？"
    answers = [
        (1, "这个范围内没有找到岗位。", [1], False), (2, "这个范围内没有找到岗位。", [2], False), (3, "这个范围内没有找到岗位。", [3], False), (4, "随便说说", [1], False), (5, "这个范围内没有找到岗位。", None, False), (6, "你想看哪个城市或区县的岗位？", None, True), (7, ask, [4], False), (8, ask, [1], False),
        (9, "要不要现在确认「体重」？", [4], False), (10, "这次读不到，要不要稍后再试？", [5], False), (11, "下面是你关注的岗位，以及自上次查看以来的变化。", [5], False), (12, "下面是你关注的岗位，以及自上次查看以来的变化。", [9], False), (13, None, [1], False), (14, "你想看哪个城市或区县的岗位？", [], False), (15, "这次读不到，要不要稍后再试？", [2], False),
    ]
    none = []
    seen = [(1, "search_jobs", True, 0, True, 0, none), (2, "search_jobs", True, 3, True, 0, none), (3, "search_jobs", True, 0, None, 0, none), (4, "pending_confirmations", True, 2, True, 0, [("GENDER", 77)]), (5, "watchlist", False, 0, True, 0, none)]
    observations = [(a, *o) for a, *_ in answers for o in seen]
    a = spark.createDataFrame(answers, "answer int, text string, basis array<int>, clarifying boolean")
    o = spark.createDataFrame(observations, "answer int, number int, tool string, ok boolean, n int, complete boolean, unreadable int, waiting array<struct<fact: string, posting: bigint>>")
    got = {r.answer: (r.violations, r.posting) for r in grounded(a, o).collect()}
    assert got == {
        1: ([], None), 2: (["NOT_APPLICABLE:SEARCH_FOUND_NOTHING"], None), 3: (["NOT_APPLICABLE:SEARCH_FOUND_NOTHING"], None), 4: (["UNKNOWN_TEMPLATE"], None), 5: (["UNGROUNDED"], None), 6: ([], None), 7: ([], 77), 8: (["UNBOUND_CONFIRMATION"], None),
        9: (["UNKNOWN_TEMPLATE"], None), 10: ([], None), 11: (["FAILED_OBSERVATION:5"], None), 12: (["NO_OBSERVATION:9"], None), 13: (["UNKNOWN_TEMPLATE"], None), 14: (["UNGROUNDED"], None), 15: (["NOT_APPLICABLE:READ_FAILED"], None),
    }
