"""Listings read page by page: captured pages of each entry are gone through in order until the listing ends.

How a listing ends depends on the entry's mode. What the pages so far say (distinct links, declared totals, empty
pages, repeated prints) are running windows over an entry's pages; the first page that settles the matter is the
end, and what lies behind it was never read. So the walk needs one exchange by entry, and no page is held beside another.
Entries are a catalogue and go to all tasks; pages and links are many and never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.joins import exchanged

#: Ends that prove that all of a listing was read.
COMPLETE = ("EMPTY_PAGE", "REPORTED_LAST_PAGE_REACHED", "REPORTED_TOTAL_REACHED", "NO_NEXT_LINK", "DATASET_PARSED")
MODES = ("NUMBERED", "DECLARED_TOTAL", "JSON", "SUFFIX", "LINKED", "DATASET", "CAMPAIGN")


def _ends(mode: Column) -> Column:
    """What a page settles, or null: each mode looks in its own order."""
    is_, col = mode.eqNullSafe, F.col
    empty, repeated = col("raw") == 0, col("repeated")
    changed, wrong = col("total") != col("first_total"), col("found") != col("known_total")
    short = col("found") < col("known_total")
    stale = (col("page") > 1) & (col("added") == 0) & short
    at_total, last = col("found") >= col("known_total"), col("page") >= col("known_pages")
    numbered = (
        F.when(changed, "TOTAL_CHANGED").when(col("total_pages") != col("first_pages"), "TOTAL_PAGES_CHANGED").when(col("current") != col("page"), "UNEXPECTED_PAGE")
        .when(empty & (col("empty_run") > col("confirmations")), "EMPTY_PAGE").when(empty, F.lit(None))
        .when(col("empty_run") > 0, "EMPTY_MIDDLE_PAGE").when(repeated, "REPEATED_PAGE")
        .when((at_total | last) & wrong, "COUNT_MISMATCH").when(last, "REPORTED_LAST_PAGE_REACHED").when(at_total, "REPORTED_TOTAL_REACHED")
    )
    covered = col("page") * col("page_size") >= col("known_total")
    by_total = F.when(wrong, "COUNT_MISMATCH").otherwise("REPORTED_TOTAL_REACHED")
    stated = F.when(col("total").isNull(), "NO_TOTAL").when(changed, "TOTAL_CHANGED")
    declared = stated.when(repeated & ((col("page") - 1) * col("page_size") < col("known_total")), "REPEATED_PAGE").when(stale, "NOTHING_NEW").when(covered, by_total)
    json = stated.when(repeated & (col("found") - col("added") < col("known_total")), "REPEATED_PAGE").when(empty & short, "EMPTY_MIDDLE_PAGE").when(stale, "NOTHING_NEW").when(covered, by_total)
    suffix = F.when(repeated, "REPEATED_PAGE").when(empty, "EMPTY_PAGE")
    linked = F.when(col("visited"), "CYCLE").when(repeated, "REPEATED_PAGE").when(col("next").isNull(), "NO_NEXT_LINK")
    return F.when(is_("NUMBERED"), numbered).when(is_("DECLARED_TOTAL"), declared).when(is_("JSON"), json).when(is_("SUFFIX"), suffix).when(is_("LINKED"), linked).when(is_("DATASET"), "DATASET_PARSED").when(is_("CAMPAIGN"), "CAMPAIGN_STATE_ONLY").otherwise("UNSUPPORTED_MODE")


def _distinct(links: DataFrame, name: str) -> DataFrame:
    """Of each entry and page: its distinct addresses, and those that no page before had (name_new)."""
    first = F.row_number().over(W.partitionBy("entry", "uri").orderBy("page")) == 1
    own = links.filter(F.col("uri").isNotNull()).select("entry", "page", "uri").distinct().withColumn("new", first)
    return own.groupBy("entry", "page").agg(F.count(F.lit(1)).alias(name), F.count_if("new").alias(f"{name}_new"))


def listing_pages(entries: DataFrame, pages: DataFrame, links: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The captured pages of each entry with what they add and what they settle (event, or null).

    entries: entry, mode, page_size, page_limit, confirmations, by_items, historical. pages: entry, page, print, url, next, total, total_pages,
    current (null where the page says nothing; no row or a null print: not fetched). links: entry, page, uri; items: the same for the listed items that the declared
    total counts, where by_items says so. Pages beyond an entry's limit are not looked at; of a page that was captured twice, any one.
    """
    rows = pages.filter(F.col("print").isNotNull()).dropDuplicates(["entry", "page"]).join(F.broadcast(entries), "entry").filter(F.col("page").between(1, F.col("page_limit")))
    rows = exchanged(rows, _distinct(links, "raw"), ["entry", "page"], "left")
    rows = exchanged(rows, _distinct(items, "item"), ["entry", "page"], "left") if items is not None else rows.withColumns({"item": F.lit(0), "item_new": F.lit(0)})
    # an entry has at most page_limit pages; dealt by entry once, its windows need no other exchange
    rows = rows.fillna(0, ["raw", "raw_new", "item", "item_new"]).repartition("entry")
    walk = W.partitionBy("entry").orderBy("page")
    so_far = walk.rowsBetween(W.unboundedPreceding, W.currentRow)
    # only pages that are not empty have prints in numbered listings
    same = W.partitionBy("entry", "print", (F.col("mode") == "NUMBERED") & (F.col("raw") == 0)).orderBy("page")
    added = F.when(F.col("by_items"), F.col("item_new")).otherwise(F.col("raw_new"))
    return (
        rows.withColumns({"added": added, "repeated": F.row_number().over(same) > 1, "visited": F.row_number().over(W.partitionBy("entry", "url").orderBy("page")) > 1})
        .withColumns({
            "found": F.sum("added").over(so_far), "first_total": F.first("total", ignorenulls=True).over(so_far), "first_pages": F.first("total_pages", ignorenulls=True).over(so_far),
            "empty_run": F.count_if(F.col("raw") == 0).over(so_far), "raw_sum": F.sum("raw").over(so_far), "raw_found": F.sum("raw_new").over(so_far), "place": F.row_number().over(walk),
        })
        .withColumns({"known_total": F.col("first_total"), "known_pages": F.col("first_pages")})
        # behind a page that is missing nothing was read
        .filter(F.col("place") == F.col("page"))
        .withColumn("event", _ends(F.col("mode")))
    )


def listing_ends(entries: DataFrame, pages: DataFrame, links: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """How each entry's listing ended: entry, mode, reason, status (COMPLETE, PARTIAL, ERROR), pages (read), raw_count.

    A listing whose pages were not captured to their end, or not ended by the limit, is an ERROR; within a bounded
    incremental read the limit makes it PARTIAL. An entry without pages is NOT_CAPTURED.
    """
    walked = listing_pages(entries, pages, links, items)
    at = F.min(F.when(F.col("event").isNotNull(), F.struct("page", "event", "raw_sum", "raw_found")))
    ended = walked.groupBy("entry").agg(at.alias("end"), F.max(F.struct("page", F.lit(None).cast("string").alias("event"), "raw_sum", "raw_found")).alias("last"))
    rows = entries.select("entry", "mode", "page_limit", "historical").join(ended, "entry", "left").withColumn("x", F.coalesce("end", "last"))
    reason = F.coalesce(F.col("x.event"), F.when(F.col("x.page") >= F.col("page_limit"), "PAGE_LIMIT").otherwise("NOT_CAPTURED"))
    # the state of a campaign is all that its page shows: no history is proved by it
    partial = ((reason == "PAGE_LIMIT") & ~F.col("historical")) | (reason == "CAMPAIGN_STATE_ONLY")
    status = F.when(reason.isin(*COMPLETE), "COMPLETE").when(partial, "PARTIAL").otherwise("ERROR")
    raw = F.when(F.col("mode").isin("SUFFIX", "LINKED"), F.col("x.raw_sum")).otherwise(F.col("x.raw_found"))
    return rows.select("entry", "mode", reason.alias("reason"), status.alias("status"), F.coalesce("x.page", F.lit(0)).alias("pages"), F.coalesce(raw, F.lit(0)).alias("raw_count"))


def accepted_links(ends: DataFrame, links: DataFrame, wanted: Column) -> DataFrame:
    """Links of the pages that were read, each address once (the first page and place), where wanted holds; none of a listing that is an ERROR."""
    read = links.join(F.broadcast(ends.filter("status <> 'ERROR'").select("entry", "pages")), "entry").filter((F.col("page") <= F.col("pages")) & wanted)
    first = F.row_number().over(W.partitionBy("entry", "uri").orderBy("page", "place"))
    return read.withColumn("turn", first).filter("turn = 1").drop("turn", "pages")


def merged_links(accepted: DataFrame, entries: DataFrame) -> DataFrame:
    """Links of all entries of a source, each address once: entries on life cycles go first, then by their order (S03). entries: entry, source, role, place."""
    own = accepted.join(F.broadcast(entries.select("entry", "source", "role", F.col("place").alias("entry_place"))), "entry")
    first = F.row_number().over(W.partitionBy("source", "uri").orderBy(F.when(F.col("role") == "LIFECYCLE", 0).otherwise(1), "entry_place", "page", "place"))
    return own.withColumn("turn", first).filter("turn = 1").drop("turn", "entry_place")


def evidence_by_year(entries: DataFrame, ends: DataFrame, accepted: DataFrame, years: list[int]) -> DataFrame:
    """What the entries of each source prove for each year (S09, A21): source, year, pages, raw, accepted, filtered, failed, complete, reason.

    entries: entry, source, required, years (none: all), gaps (years whose archive is known to have a gap); accepted: entry, year. An entry that is an
    ERROR counts as failed; a year is complete if required entries apply to it, none has a gap, and all were read to their end.
    """
    n = accepted.groupBy("entry", "year").agg(F.count(F.lit(1)).alias("own"))
    whole = accepted.groupBy("entry").agg(F.count(F.lit(1)).alias("all"))
    grid = entries.select("entry", "source", "required", "years", "gaps").withColumn("year", F.explode(F.array(*map(F.lit, years)))).filter((F.size("years") == 0) | F.array_contains("years", F.col("year")))
    x = grid.join(ends.select("entry", "status", "pages", "raw_count"), "entry").join(n, ["entry", "year"], "left").join(whole, "entry", "left").fillna(0, ["own", "all"])
    read, required = F.col("status") != "ERROR", F.col("required")
    filtered = F.greatest(F.col("raw_count") - F.when(F.col("status") == "COMPLETE", F.col("all")).otherwise(F.col("own")), F.lit(0))
    total = lambda c: F.sum(F.when(read, c).otherwise(0)).cast("long")
    found = x.groupBy("source", "year").agg(
        total(F.col("pages")).alias("pages"), total(F.col("raw_count")).alias("raw"), total(F.col("own")).alias("accepted"), total(filtered).alias("filtered"), F.count_if(~read).alias("failed"),
        F.count_if(required).alias("_required"), F.count_if(required & F.array_contains("gaps", F.col("year"))).alias("_gaps"), F.count_if(required & (F.col("status") == "COMPLETE")).alias("_complete"),
    )
    none, gap, done = F.col("_required") == 0, F.col("_gaps") > 0, F.col("_required") == F.col("_complete")
    reason = F.when(none, "NO_APPLICABLE_REQUIRED_ENTRY").when(gap, "KNOWN_OFFICIAL_ARCHIVE_GAP").when(done, "ALL_REQUIRED_ENTRIES_COMPLETE").otherwise("REQUIRED_ENTRY_INCOMPLETE")
    return found.withColumns({"complete": ~none & ~gap & done, "reason": reason}).drop("_required", "_gaps", "_complete")
