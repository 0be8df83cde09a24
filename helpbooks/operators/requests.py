"""Page requests resolved against books and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .links import listed


def resolved(requests: DataFrame, books: DataFrame, entries: DataFrame, fold: bool = False) -> DataFrame:
    """requests (request_id, ts, url) with ``status`` and, for 200, ``content_type``.

    Malformed addresses are 400, unsafe paths 403, unknown books and missing
    entries 404. Unless ``fold`` resolves dot segments first, as a browser does, any
    ``..`` segment is unsafe, also a plain one. Hosts compare in lower case, paths in any case.
    """
    scheme = F.try_parse_url("url", F.lit("PROTOCOL"))
    r = requests.withColumns({"host": F.lower(paths.request_book(F.col("url"))), "page": F.when(scheme.isNotNull(), F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")))})
    r = r.withColumn("page", paths.percent_decoded(paths.folded(F.col("page")) if fold else F.col("page"))).withColumn("page_key", paths.path_key(F.col("page")))
    known = books.select(F.lower("book_id").alias("host")).distinct().withColumn("known", F.lit(True))
    have = listed(entries).select(F.lower("book_id").alias("host"), F.col("path_key").alias("page_key")).distinct().withColumn("have", F.lit(True))
    j = r.join(known, "host", "left").join(have, ["host", "page_key"], "left")
    bad = F.col("page").isNull() | F.col("host").isNull()
    status = F.when(bad, 400).when(~paths.is_safe_path(F.col("page")), 403).when(F.col("known").isNull() | F.col("have").isNull(), 404).otherwise(200)
    out = j.withColumn("status", status.cast("int"))
    return out.select(*requests.columns, "status", F.when(F.col("status") == 200, paths.mime_type(F.col("page"))).alias("content_type"))


def status_counts(resolved_requests: DataFrame) -> DataFrame:
    return resolved_requests.groupBy("status", "content_type").agg(F.count("*").alias("requests"))
