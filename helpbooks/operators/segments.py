"""An index that changes: segments, tombstones and merging.

Each batch of changes makes one segment, which is an index of its new pages
(``index.write``), and marks what earlier segments hold of the same pages, of pages
that are gone and of closed books as dead. A manifest lists the live segments
after each batch; it is written last, so a batch that is tried again starts from
the manifest before it and overwrites what it had written.

Once ``FAN`` segments are of one level, they become one of the next, without their
dead pages; a page is thus written again as often as there are levels, and a batch
looks up its pages in a number of segments that grows with the logarithm of the
number of batches. The words of a page that dies are taken from the dictionary at
once, so counts are always those of an index built anew.

A change is a page (book_id, path, title, text) or, with ``gone``, its removal; a
removal without a path closes the book. Removals are about what earlier batches
hold: a page that comes in the same batch stays. Of several texts of a page in one
batch the one of the greatest hash counts, and a page that is there already with
the same text is passed over. A null ``gone`` is false; changes without a book are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INDEX_ABOUT, INDEX_PAGES, INDEX_POSTINGS, INDEX_TERMS, PAGES_TEXT, POSTINGS
from . import index, search

FAN = 4
CHANGES = f"{PAGES_TEXT}, gone boolean"
_MANIFEST = "segment string, level int, batch long"
_DEAD = "book_id string, path string, segment string, batch long"
_GONE = "term string, df long, tf long, lead string, segment string, batch long"
_KEY = ["book_id", "path"]


def start(spark: SparkSession, folder: str) -> None:
    """An index without pages below ``folder``, unless there is one."""
    for name, schema in (("manifest", "segment string, level int"), ("dead", "book_id string, path string, segment string"), ("gone", "term string, df long, tf long, lead string, segment string")):
        spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{folder}/{name}/batch=-1")


def live(spark: SparkSession, folder: str, before: int | None = None) -> list[tuple[str, int]]:
    """(segment, level) of the last manifest, or of the last one before a batch."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    found = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row
    return sorted((r["segment"], r["level"]) for r in found.collect())


def _table(spark: SparkSession, folder: str, name: str, schema: str, segments: list[str]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], f"{schema}, segment string")
    return spark.read.schema(f"{schema}, segment string").parquet(f"{folder}/{name}").filter(F.col("segment").isin(segments))


def _dead(spark: SparkSession, folder: str, segments: list[str], before: int | None) -> DataFrame:
    rows = spark.read.schema(_DEAD).parquet(f"{folder}/dead").filter(F.col("segment").isin(segments))
    return (rows if before is None else rows.filter(F.col("batch") < before)).select("segment", *_KEY)


def _held(spark: SparkSession, folder: str, name: str, schema: str, segments: list[str], before: int | None = None) -> DataFrame:
    """Rows of a table of the live segments without those of dead pages."""
    return _table(spark, folder, name, schema, segments).join(_dead(spark, folder, segments, before), ["segment", *_KEY], "left_anti")


def change(changes: DataFrame, folder: str, batch: int, fan: int = FAN) -> None:
    """Apply a batch of changes (``CHANGES``; ``gone`` may be missing). Batches are numbered upwards from 0; applying one again gives the same index."""
    spark = changes.sparkSession
    gone = F.coalesce("gone", F.lit(False)) if "gone" in changes.columns else F.lit(False)
    asked = changes.filter("book_id is not null").select(*_KEY, "title", "text", gone.alias("gone"))
    segments = live(spark, folder, batch)
    names = [s for s, _ in segments]
    put = asked.filter("not gone and path is not null")
    held = _held(spark, folder, "pages", INDEX_PAGES, names, batch).select("segment", *_KEY, "sha256")
    best = put.groupBy(*_KEY).agg(F.max(F.sha2("text", 256)).alias("sha256"))  # hashes alone; texts move only where they are new
    new = best.join(held.drop("segment"), [*_KEY, "sha256"], "left_anti").select(*_KEY)
    texts = put.join(new, _KEY, "left_semi").withColumn("sha256", F.sha2("text", 256))
    fresh = texts.groupBy(*_KEY).agg(F.max_by(F.struct("title", "text", "sha256"), "sha256").alias("p")).select(*_KEY, "p.*")
    name = f"s{batch}"
    index.write(fresh, folder, f"/segment={name}")
    written = spark.read.schema(INDEX_PAGES).parquet(f"{folder}/pages/segment={name}").select(*_KEY)
    replaced = held.join(written, _KEY, "left_semi")
    removed = held.join(asked.filter("gone and path is not null").select(*_KEY).distinct(), _KEY, "left_semi")
    closed = held.join(asked.filter("gone and path is null").select("book_id").distinct(), "book_id", "left_semi")
    lost = removed.unionByName(closed).join(put.select(*_KEY), _KEY, "left_anti")
    replaced.unionByName(lost).select(*_KEY, "segment").distinct().write.mode("overwrite").parquet(f"{folder}/dead/batch={batch}")
    now = spark.read.schema("book_id string, path string, segment string").parquet(f"{folder}/dead/batch={batch}")
    texts = _table(spark, folder, "pages", INDEX_PAGES, names).join(now, ["segment", *_KEY], "left_semi")
    words = search.stored_postings(texts, "segment").withColumn("lead", index.lead(F.col("term")))
    counts = words.groupBy("lead", "term", "segment").agg(F.count_if("first_field").alias("df"), F.sum("tf").alias("tf"))
    counts.select("term", "df", "tf", "lead", "segment").write.mode("overwrite").parquet(f"{folder}/gone/batch={batch}")
    segments = _merged(spark, folder, [*segments, (name, 0)], batch, fan)
    spark.createDataFrame(segments, "segment string, level int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def _merged(spark: SparkSession, folder: str, segments: list[tuple[str, int]], batch: int, fan: int) -> list[tuple[str, int]]:
    """The live segments after ``fan`` or more of one level have become one of the next."""
    level = 0
    while any(at >= level for _, at in segments):
        names = [s for s, at in segments if at == level]
        if len(names) >= fan:
            name = f"m{batch}-{level + 1}"
            part = f"/segment={name}"
            pages = _held(spark, folder, "pages", INDEX_PAGES, names).drop("segment")
            index.write_parts(pages, _held(spark, folder, "postings", INDEX_POSTINGS, names).drop("segment"), folder, part)
            segments = [x for x in segments if x[1] != level] + [(name, level + 1)]
        level += 1
    return segments


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """``schemas.POSTINGS`` of the pages that are there."""
    rows = _held(spark, folder, "postings", INDEX_POSTINGS, [s for s, _ in live(spark, folder)])
    return rows.select(*(x.split()[0] for x in POSTINGS.split(", ")))


def open_index(spark: SparkSession, folder: str) -> index.Index:
    """The index as it is now, for ``index.find`` and ``index.fuzzy_find``; counts are those of the pages that are there."""
    names = [s for s, _ in live(spark, folder)]
    pages = _held(spark, folder, "pages", INDEX_PAGES, names).drop("segment")
    gone = spark.read.schema(_GONE).parquet(f"{folder}/gone").filter(F.col("segment").isin(names)).select("term", (-F.col("df")).alias("df"), (-F.col("tf")).alias("tf"), "lead")
    each = _table(spark, folder, "terms", INDEX_TERMS, names).select("term", "df", "tf", "lead").unionByName(gone)
    terms = each.groupBy("lead", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("tf > 0")
    words = _table(spark, folder, "about", INDEX_ABOUT, names).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("all")).crossJoin(gone.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("less")))  # one row each
    about = pages.agg(F.count_if("has_words").alias("pages")).crossJoin(words.select((F.col("all") + F.col("less")).alias("words")))  # one row each
    return index.Index(pages, _held(spark, folder, "postings", INDEX_POSTINGS, names).drop("segment"), terms, about)


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """``index.merged_statistics`` of the live segments. Pages that have died since their segment was written still count, until it is merged."""
    return index.merged_statistics(_table(spark, folder, "about", INDEX_ABOUT, [s for s, _ in live(spark, folder)]))


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Remove the segments that the last manifest doesn't list, and return their names. No batch or reader of an earlier manifest may be at work."""
    names = {s for s, _ in live(spark, folder)}
    held = {r[0] for r in spark.read.schema(f"{INDEX_ABOUT}, segment string").parquet(f"{folder}/about").select("segment").distinct().collect()}
    for name in sorted(held - names):
        for table in ("pages", "postings", "terms", "about"):
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/segment={name}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return sorted(held - names)
