"""Listings against a reader that goes page by page, for random pages in every mode."""

import random
import re

import pytest

from tessera.queries import QUERIES
from tessera.sources import listings
from tests.conftest import SF

COLUMNS = "entry int, page long, print string, url string, next string, total long, total_pages long, current long"


def read(e, pages):
    """One entry, page after page. pages: number -> (print, url, next, total, total_pages, current, links, items)."""
    seen, items, prints, urls, total, total_pages, run, raw = set(), set(), set(), set(), None, None, 0, 0
    mode, size, limit = e["mode"], e["page_size"], e["page_limit"]

    def end(reason, page, found):
        if reason in listings.COMPLETE:
            status = "COMPLETE"
        else:
            status = "PARTIAL" if reason == "CAMPAIGN_STATE_ONLY" or (reason == "PAGE_LIMIT" and not e["historical"]) else "ERROR"
        return reason, status, page, found

    count = lambda: raw if mode in ("SUFFIX", "LINKED") else len(seen)
    for page in range(1, limit + 1):
        if page not in pages:
            return end("NOT_CAPTURED", page - 1, count() if page > 1 else 0)
        print_, url, following, said, said_pages, current, links, listed = pages[page]
        links = set(links)
        before, before_items = len(seen), len(items)
        seen |= links
        items |= set(listed)
        raw += len(links)
        found, added = (len(items), len(items) - before_items) if e["by_items"] else (len(seen), len(seen) - before)
        changed = said is not None and total is not None and said != total
        total = said if total is None else total
        pages_changed = said_pages is not None and total_pages is not None and said_pages != total_pages
        total_pages = said_pages if total_pages is None else total_pages
        again, visited = print_ in prints, url in urls
        urls.add(url)
        if mode != "NUMBERED" or links:
            prints.add(print_)
        stop = None
        if mode == "NUMBERED":
            if changed:
                stop = "TOTAL_CHANGED"
            elif pages_changed:
                stop = "TOTAL_PAGES_CHANGED"
            elif current is not None and current != page:
                stop = "UNEXPECTED_PAGE"
            elif not links:
                run += 1
                stop = "EMPTY_PAGE" if run > e["confirmations"] else None
            elif run:
                stop = "EMPTY_MIDDLE_PAGE"
            elif again:
                stop = "REPEATED_PAGE"
            elif (total is not None and found >= total) or (total_pages is not None and page >= total_pages):
                if total is not None and found != total:
                    stop = "COUNT_MISMATCH"
                else:
                    stop = "REPORTED_LAST_PAGE_REACHED" if total_pages is not None and page >= total_pages else "REPORTED_TOTAL_REACHED"
        elif mode in ("DECLARED_TOTAL", "JSON"):
            if said is None:
                stop = "NO_TOTAL"
            elif changed:
                stop = "TOTAL_CHANGED"
            elif again and ((page - 1) * size if mode == "DECLARED_TOTAL" else found - added) < total:
                stop = "REPEATED_PAGE"
            elif mode == "JSON" and not links and found < total:
                stop = "EMPTY_MIDDLE_PAGE"
            elif page > 1 and not added and found < total:
                stop = "NOTHING_NEW"
            elif page * size >= total:
                stop = "COUNT_MISMATCH" if found != total else "REPORTED_TOTAL_REACHED"
        elif mode == "SUFFIX":
            stop = "REPEATED_PAGE" if again else "EMPTY_PAGE" if not links else None
        elif mode == "LINKED":
            stop = "CYCLE" if visited else "REPEATED_PAGE" if again else "NO_NEXT_LINK" if following is None else None
        else:
            stop = "DATASET_PARSED" if mode == "DATASET" else "CAMPAIGN_STATE_ONLY"
        if stop:
            return end(stop, page, count())
    return end("PAGE_LIMIT", limit, count())


def test_listing_ends(spark):
    rng = random.Random(6)
    entries, pages, links, items, want, taken = [], [], [], [], {}, {}
    for n in range(900):
        mode = listings.MODES[n % 7]
        e = {"entry": n, "mode": mode, "page_size": 3, "page_limit": rng.choice([2, 4, 9]), "confirmations": rng.choice([0, 0, 1]), "by_items": rng.random() < 0.2, "historical": rng.random() < 0.7}
        n_pages, own, given, at = rng.randint(0, 6), {}, rng.random() < 0.6, 0
        total = rng.choice([3 * n_pages, 3 * n_pages - 1, 3 * n_pages + 1]) if given else None
        for page in range(1, n_pages + 1 + rng.randint(0, 2)):
            k = rng.choice([3] * 12 + [0, 2]) if page <= n_pages else 0
            found = [f"/{i if rng.random() < 0.96 else 0}" for i in range(at, at + k)]
            at += k
            body = (f"b{page}" if rng.random() < 0.95 else "b1", f"u{page}" if rng.random() < 0.95 else "u1", None if page >= n_pages else "next", total if total is None or rng.random() < 0.97 else total + 1, n_pages if n % 3 == 0 else None, page if rng.random() < 0.97 else 1)
            if rng.random() < 0.97:
                own[page] = (*body, found, found[: len(found) - (rng.random() < 0.1)])
        entries.append(e)
        for page, (*body, found, listed) in own.items():
            pages.append((n, page, *body))
            links += [(n, page, i, u) for i, u in enumerate(found)]
            items += [(n, page, u) for u in listed]
        want[n] = read(e, own)
        if want[n][1] != "ERROR":
            for page in range(1, want[n][2] + 1):
                for u in own[page][6]:
                    taken.setdefault((n, u), page)
    e = spark.createDataFrame(entries, "entry int, mode string, page_size int, page_limit int, confirmations int, by_items boolean, historical boolean")
    p, l, i = (spark.createDataFrame(x, s) for x, s in ((pages, COLUMNS), (links, "entry int, page long, place int, uri string"), (items, "entry int, page long, uri string")))
    ends = listings.listing_ends(e, p, l, i).cache()
    got = {r.entry: (r.reason, r.status, r.pages, r.raw_count) for r in ends.collect()}
    assert {k: (v, want[k], next(x for x in entries if x["entry"] == k)) for k, v in got.items() if v != want[k]} == {}
    assert {r for r, *_ in want.values()} >= {*listings.COMPLETE, "TOTAL_CHANGED", "UNEXPECTED_PAGE", "EMPTY_MIDDLE_PAGE", "REPEATED_PAGE", "COUNT_MISMATCH", "NO_TOTAL", "NOTHING_NEW", "CYCLE", "NOT_CAPTURED", "PAGE_LIMIT"}
    accepted = listings.accepted_links(ends, l, l.uri != "/1").collect()
    assert {(r.entry, r.uri): r.page for r in accepted} == {k: v for k, v in taken.items() if k[1] != "/1"} and len(accepted) == len({(r.entry, r.uri) for r in accepted})


def test_merged_links(spark):
    accepted = spark.createDataFrame([(1, 1, 0, "/a"), (2, 1, 0, "/a"), (2, 1, 1, "/b"), (3, 1, 0, "/a")], "entry int, page int, place int, uri string")
    entries = spark.createDataFrame([(1, "s", "LISTING", 0), (2, "s", "LIFECYCLE", 1), (3, "t", "LISTING", 2)], "entry int, source string, role string, place int")
    assert sorted((r.source, r.uri, r.entry) for r in listings.merged_links(accepted, entries).collect()) == [("s", "/a", 2), ("s", "/b", 2), ("t", "/a", 3)]


@pytest.mark.parametrize("name", ["listing_reads", "listing_links", "listing_evidence"])
def test_pages_stay_off_the_driver(spark, name):
    """However small Spark takes them for, parts, pages and links go to no other task by way of the driver: only the rows of entries do."""
    df = QUERIES[name](spark, SF)
    df.collect()
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\].*?, (Build\w+)", df._jdf.queryExecution().executedPlan().toString())
    assert joins and {re.sub(r"#\w+", "", keys) for keys, _ in joins} <= {"entry", "p_brand, p_type", "entry, year"}
    assert {side for keys, side in joins if "p_brand" in keys} == {"BuildRight"}
