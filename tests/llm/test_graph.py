"""Components of random links, chains and stars against a search."""

import random
from collections import Counter

from tessera.llm.graph import components


def test_components(spark):
    r = random.Random(4)
    for links in ([(r.randrange(80), r.randrange(80)) for _ in range(60)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(30)] + [(40, 41), (50, 50)], [(3, 1), (3, 2)], []):
        near: dict[int, set[int]] = {}
        for a, b in links:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = {}
        for n in sorted(near):
            todo = [] if n in want else [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += near[x]
        got = [(x.node, x.comp) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
        assert Counter(got) == Counter(want.items())


def test_scratch_of_two_threads(spark):
    """What a thread keeps in its block outlives the block of another, and goes with its own."""
    import threading

    from tessera.llm.storage import kept, scratch

    told, done, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            kept(spark.range(3), "other")
            told.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        told.wait(60)
        mine = kept(spark.range(5), "mine")
        done.set()
        thread.join()
        seen.append(mine.count())
        with scratch(spark):
            inner = kept(spark.range(7), "inner")
        folders = [f.inputFiles()[0] for f in (mine,)]
    assert seen == [5] and folders
    import os

    assert not os.path.exists(folders[0].removeprefix("file://"))
    assert not any(os.path.exists(f.removeprefix("file://")) for f in inner.inputFiles())
