"""Boilerplate lines by their frequency within a site, in DataFrame operations only.

A line's ratio is the number of its host's pages that contain it, divided by the host's pages; lines whose
ratio exceeds a limit are dropped. Lines are compared without leading and trailing spaces; blank lines never count.

Two options soften this, both off unless asked for: ``min_pages`` spares lines of fewer pages (on a host of
a few pages every line has a high ratio), and ``keep_whole`` spares pages that consist of boilerplate alone
(copies of a page, not frames around content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Rows, save

#: Boilerplate lines up to which they are broadcast (about 40 bytes each); beyond it they are joined by shuffle.
BROADCAST_LINES = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _lines(text: Column | str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 1) -> DataFrame:
    """host, line_key, n_pages, host_pages of lines on more than ``max_ratio`` of the host's pages and on ``min_pages`` or more.

    At most (mean number of lines a page) / max_ratio lines for a host. Rows without a host form one host
    (null). A hot host or line only adds partial counts, which meet as one row a task.
    """
    rows = pages.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(text), _key)).alias("keys"))
    counts = rows.select("host", F.explode("keys").alias("line_key")).groupBy("host", "line_key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = rows.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("host_pages"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").where(F.col("n_pages") > F.col("host_pages") * F.lit(max_ratio))


def drop_lines(
    pages: DataFrame, page_id: str = "doc_id", host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 1, keep_whole: bool = False, counts: bool = True
) -> DataFrame:
    """All rows with their columns, ``text`` without boilerplate lines; with ``counts`` also n_lines and n_dropped (lines that are not blank).

    Null text stays null with 0 lines, and a page that loses all its lines has an empty text or blank lines alone;
    blank lines stay where they are. Repeated rows each count as a page. Own columns named n_lines or n_dropped
    are replaced where ``counts`` is set and stay where it is not.
    """
    found = save(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    rows = Rows(pages)
    body = rows.df.select("row", rows.col(host).alias("host"), rows.col(text).alias("text"), rows.col(page_id).alias("id"))
    if found.count() <= BROADCAST_LINES:
        listed = found.groupBy(F.col("host").alias("bad_host")).agg(F.collect_list("line_key").alias("bad"))
        joined = body.join(F.broadcast(listed), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    else:
        own = body.select(F.col("id").alias("bad_id"), F.col("host").alias("bad_host"), F.explode(F.array_distinct(F.transform(_lines("text"), _key))).alias("own_key"))
        hit = own.join(found, own.bad_host.eqNullSafe(found.host) & (own.own_key == found.line_key)).groupBy("bad_id", "bad_host").agg(F.collect_set("own_key").alias("bad"))
        joined = body.join(hit, F.col("id").eqNullSafe(F.col("bad_id")) & F.col("host").eqNullSafe(F.col("bad_host")), "left")
    zero = F.lit(0)
    rest = F.when(F.col("bad").isNotNull(), F.filter(F.split("text", "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains("bad", _key(x))))
    lines = F.coalesce(F.size(_lines("text")), zero)
    left = F.size(F.filter("rest", lambda x: F.trim(x) != ""))
    whole = F.col("rest").isNull() | ((left == 0) if keep_whole else F.lit(False))
    new = {text: F.when(whole, F.col("text")).otherwise(F.array_join("rest", "\n"))}
    if counts:
        new |= {"n_lines": lines.cast("long"), "n_dropped": F.when(whole, zero).otherwise(lines - left).cast("long")}
    return rows.back(joined.withColumn("rest", rest), **new)
