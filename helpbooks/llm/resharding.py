"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

Every old shard is cut into blocks: documents of more than a set share of all
bytes are blocks of their own (there can only be so many), the others fall into
a fixed number of buckets by the hash of their text. Equal texts are thus in one
block and stay together, unless they are more than a ``GROUP``-th of a new shard:
those, too, are blocks of their own, and are cut up by the hash of the id, or by
the rows' numbers where even rows of one text and id are more than that. The
driver sees one row per block, never per document; the number of blocks has a
bound that does not grow with the data.

The flow network has an arc from each old shard to each new one; staying costs
nothing and moving costs the bytes moved. Successive shortest paths give the
cheapest flow that fills the new capacities. Whole blocks then carry the flow,
long ones first; what one old shard sends too much or too little the next makes
up for, so shards are equal to about one small block, and the bytes moved are
those of the flow to the same measure. Rows look their block's shard up in a
broadcast map, so assigning needs no shuffle. Then the shards that gain or lose
rows are written anew, from the files of the old layout, and all rows are read
back. A slot is a row's rank in its shard by the hash of its text and by its
id, so shards and slots depend on the documents alone, and reruns agree.

Null texts have size 1 (their line end); empty ones too. A text longer than a
shard fills one by itself. Null and repeated ids are rows like any other. An
empty table gives an empty result. Columns of any name are kept: where documents
have a column ``shard``, the layout's own gets another name (``free_name``).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Hash buckets an old shard; with LARGE it bounds what the driver plans over.
BUCKETS = 1024
#: A document of over 1/LARGE of all bytes is a block of its own (fewer than LARGE exist).
LARGE = 4096
BLOCK = "old int, large boolean, bucket long, part int"
KEYS = [x.split()[0] for x in BLOCK.split(", ")]
#: Equal texts of over 1/GROUP of a new shard are cut up.
GROUP = 16
#: Bytes that a task writes, into a file for each shard.
TASK_BYTES = 512_000_000


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or the first longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _hash_shard(mixed: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(mixed, 17), F.lit(shards)).cast("int")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_blocks(rows: DataFrame, old_shards: int, new_shards: int, buckets: int = BUCKETS, large: int = LARGE) -> tuple[DataFrame, list[tuple[tuple, int]]]:
    """rows (old, mixed, id, file, at, size, ...) plus ``large``, ``bucket`` and ``part``, and the bytes of each block.

    ``mixed`` is the hash of a row's text, ``file`` and ``at`` are its place.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    is_large = F.col("size") > max(1, total // large)
    d = rows.withColumn("large", is_large).withColumn("bucket", F.when(is_large, F.col("mixed")).otherwise(F.pmod("mixed", F.lit(buckets))))
    whole = [tuple(r) for r in d.groupBy(*KEYS[:3]).agg(F.sum("size"), F.count("*")).collect()]  # bounded: see BUCKETS and LARGE
    mean, most = max(1, total // (old_shards * buckets)), max(1, total // (new_shards * GROUP))
    heavy = [tuple(k) for *k, size, n in whole if size > most and n > 1]
    if not heavy:
        return d.withColumn("part", F.lit(0)), [((*k, 0), size) for *k, size, _ in whole]
    spark = rows.sparkSession
    own = d.join(F.broadcast(spark.createDataFrame(heavy, BLOCK.rsplit(", ", 1)[0])), KEYS[:3], "left_semi")
    groups = own.groupBy("old", "mixed").agg(F.sum("size").alias("all"), F.count("*").alias("n")).filter((F.col("all") > most) & (F.col("n") > 1))
    hot = groups.select("old", "mixed", F.least(8 * F.col("n"), F.ceil(F.col("all") / mean)).cast("int").alias("parts"))
    hot = spark.createDataFrame(hot.collect(), "old int, mixed long, parts int")  # fewer than GROUP x new shards
    id_hash = F.xxhash64("id")
    alike = own.join(F.broadcast(hot), ["old", "mixed"]).groupBy("old", "mixed", id_hash.alias("same"), "file").agg(F.sum("size").alias("all"), F.min("at").alias("first"), F.count("*").alias("n"))
    many = alike.groupBy("old", "mixed", "same").agg(F.sum("all").alias("all"), F.sum("n").alias("rows")).filter((F.col("all") > most) & (F.col("rows") > 1)).drop("all", "rows")  # as few
    before = F.coalesce(F.sum("n").over(Window.partitionBy("old", "mixed", "same").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = alike.join(F.broadcast(many), ["old", "mixed", "same"], "left_semi").select("old", "mixed", "same", "file", (before - F.col("first")).alias("shift"))  # a row for each of these and each file
    d = d.join(F.broadcast(hot), ["old", "mixed"], "left").withColumn("same", id_hash).join(F.broadcast(numbered), ["old", "mixed", "same", "file"], "left")
    part = F.pmod(F.coalesce(F.col("shift") + F.col("at"), F.col("same")), F.col("parts"))
    split = {"large": F.col("large") | F.col("parts").isNotNull(), "bucket": F.when(F.col("parts").isNotNull(), F.col("mixed")).otherwise(F.col("bucket")), "part": F.coalesce(part, F.lit(0)).cast("int")}
    d = d.withColumns(split).drop("parts", "same", "shift")
    return d, [(tuple(r)[:4], r[4]) for r in d.groupBy(*KEYS).agg(F.sum("size")).collect()]  # at most twice as many


def min_cost_flow(supply: list[int], demand: list[int], home: list[int | None]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j that fill ``demand`` and move the fewest bytes; home[i] is where staying costs nothing.

    Successive shortest paths over the bipartite network source-old-new-sink,
    by breadth of cost (0 or 1 an arc, -1 or 0 back).
    """
    n, m = len(supply), len(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(demand)
    cost = [[0 if home[i] == j else 1 for j in range(m)] for i in range(n)]
    while any(left) and any(room):
        # Bellman-Ford from all old shards that still hold bytes
        dist_o, dist_n = [0 if x else None for x in left], [None] * m
        via_o, via_n = [None] * n, [None] * m
        for _ in range(n + m):
            changed = False
            for i in range(n):
                if dist_o[i] is not None:
                    for j in range(m):
                        d = dist_o[i] + cost[i][j]
                        if dist_n[j] is None or d < dist_n[j]:
                            dist_n[j], via_n[j], changed = d, i, True
            for (i, j), f in flow.items():
                if f and dist_n[j] is not None and (dist_o[i] is None or dist_n[j] - cost[i][j] < dist_o[i]):
                    dist_o[i], via_o[i], changed = dist_n[j] - cost[i][j], j, True
            if not changed:
                break
        j = min((j for j in range(m) if room[j] and dist_n[j] is not None), key=lambda j: dist_n[j])
        path, at = [], j
        while True:
            i = via_n[at]
            path.append((i, at, 1))
            if via_o[i] is None:
                break
            path.append((i, via_o[i], -1))
            at = via_o[i]
        amount = min(left[i], room[j], *(flow[x, y] for x, y, s in path if s < 0))
        for x, y, s in path:
            flow[x, y] += s * amount
        left[i] -= amount
        room[j] -= amount
    return {k: v for k, v in flow.items() if v}


def plan_blocks(blocks: list[tuple[tuple, int]], new_shards: int) -> dict[tuple, int]:
    """New shard of each block (key, bytes), whose old shard comes first in its key. Capacities are equal; old shard i stays at new shard i."""
    by_old = defaultdict(list)
    for key, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        by_old[key[0]].append((key, size))
    olds, total = sorted(by_old), sum(size for _, size in blocks)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = min_cost_flow([sum(size for _, size in by_old[o]) for o in olds], capacity, [o if 0 <= o < new_shards else None for o in olds])
    out, owed = {}, [0] * new_shards
    for k, o in enumerate(olds):
        due = {j: f + owed[j] for (i, j), f in flow.items() if i == k}
        for key, size in by_old[o]:  # long blocks first, each to the new shard that is owed most
            j = max(due, key=lambda j: (due[j], j == o, -j))
            out[key] = j
            due[j] -= size
        for j, left in due.items():
            owed[j] = left
    # Where a block that leaves goes costs the same everywhere, so all of them fill up what those that stay leave free.
    size_of, room = dict(blocks), list(capacity)
    for key, j in out.items():
        if j == key[0]:
            room[j] -= size_of[key]
    for key in sorted((key for key, j in out.items() if j != key[0]), key=lambda key: (-size_of[key], key)):
        out[key] = max(range(new_shards), key=lambda j: (room[j], -j))
        room[out[key]] -= size_of[key]
    return out


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")


def _long_tasks(rows: DataFrame, total: int) -> DataFrame:
    """Rows of ``total`` bytes in tasks of about ``TASK_BYTES``, or three a core, so that files are not many and small; without a shuffle."""
    return rows.coalesce(max(3 * rows.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES))


def lay_out(docs: DataFrame, path: str, shards: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write docs below ``path`` as a layout of hash shards, a folder shard=N each."""
    name = free_name("shard", docs.columns)
    total = docs.agg(F.sum(_size(text))).first()[0] or 0
    placed = _long_tasks(docs, total).withColumn(name, _hash_shard(_text_hash(F.col(text)), shards))
    placed.sortWithinPartitions(name, _text_hash(F.col(text)), doc_id).write.partitionBy(name).parquet(path)  # equal rows lie together


class Layout:
    """The files of a layout of documents with given columns. An empty layout has no rows.

    Files that a resharding wrote also say from which old shard a row came.
    """

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType):
        self.spark, self.path, self.columns = spark, path, columns
        self.shard, self.came_from = (free_name(x, columns.names) for x in ("shard", "_old_shard"))

    def read(self) -> DataFrame:
        """Its rows: ``row`` (the columns), ``shard``, ``came_from``, ``file`` and ``at``, the row's number in it."""
        schema = T.StructType([*self.columns, T.StructField(self.came_from, T.IntegerType()), T.StructField(self.shard, T.IntegerType())])
        d = self.spark.read.schema(schema).parquet(self.path)
        return d.select(F.struct(*(d[c] for c in self.columns.names)).alias("row"), F.col(self.shard).alias("shard"), F.col(self.came_from).alias("came_from"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))

    def rewrite(self, placed: DataFrame, old_shards: int, total: int) -> list[int]:
        """Write the shards that gain or lose rows; the others keep their old files. Returns the shards written or removed.

        ``placed`` has ``row``, ``shard`` and ``old``, and ``total`` bytes. It may read this layout: new files replace the old ones of
        their shard only when all are written. Afterwards it must not be read again. A row for each pair of an old
        and a new shard reaches the driver.
        """
        pairs = [tuple(r) for r in placed.select("old", "shard").distinct().collect()]
        touched = sorted({s for a, b in pairs if a != b for s in (a, b)})
        moved = placed.filter(F.col("shard").isin(touched) | (F.col("shard") >= old_shards))
        rows = moved.select(*(F.col("row")[c].alias(c) for c in self.columns.names), F.col("old").alias(self.came_from), F.col("shard").alias(self.shard))
        _long_tasks(rows, total).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.shard).parquet(self.path)
        for s in set(touched) - {b for _, b in pairs}:  # it lost all its rows
            common.remove(self.spark, f"{self.path}/{self.shard}={s}")
        return touched


def read_placed(layout: DataFrame, touched: list[int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document of a layout in which ``touched`` are the shards last written: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    ``law`` is ``bytes``: sizes of new shards are as near equal as blocks allow. Slots are ranks by hash of text and id:
    these are sorted in ranges, without the texts, and each range counts on from those before it.
    """
    own = F.col("row")[text]
    rows = layout.select("shard", F.when(F.col("shard").isin(touched), F.col("came_from")).otherwise(F.col("shard")).alias("old_shard"), F.col("row")[doc_id].alias("doc_id"), _text_hash(own).alias("mixed"), F.xxhash64("file", "at").alias("place"), own.alias("text"))
    sized = rows.select("shard", "old_shard", "doc_id", "mixed", "place", _size("text").alias("size"), _crc())
    key = ["shard", "mixed", "doc_id", "old_shard", "place"]
    ranked = common.written(sized.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("n", F.monotonically_increasing_id()), "slots")[0]
    task = F.shiftright("n", 33).alias("task")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("shard", task).agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    starts = counts.select("shard", "task", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))  # a row for each task and shard in it
    out = ranked.withColumn("task", task).join(F.broadcast(starts), ["shard", "task"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def reshard_layout(spark: SparkSession, path: str, columns: T.StructType, old_shards: int = 12, new_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Reshard the layout below ``path`` in place: plan from its files, rewrite the affected shards, and read all back (``read_placed``)."""
    layout = Layout(spark, path, columns)
    own_id, own_text = F.col("row")[doc_id], F.col("row")[text]
    rows = layout.read().select("row", F.col("shard").alias("old"), _text_hash(own_text).alias("mixed"), own_id.alias("id"), "file", "at", (F.coalesce(F.octet_length(own_text), F.lit(0)) + 1).cast("long").alias("size"))
    d, blocks = with_blocks(rows, old_shards, new_shards)
    where = spark.createDataFrame([(*key, s) for key, s in plan_blocks(blocks, new_shards).items()], f"{BLOCK}, shard int")
    touched = layout.rewrite(d.join(F.broadcast(where), KEYS).select("row", "shard", "old"), old_shards, sum(size for _, size in blocks))
    return read_placed(layout.read(), touched, text, doc_id)


def reshard_documents(docs: DataFrame, path: str, old_shards: int = 12, new_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lay docs out as ``old_shards`` hash shards below ``path``, then reshard those files."""
    lay_out(docs, path, old_shards, text, doc_id)
    return reshard_layout(docs.sparkSession, path, docs.schema, old_shards, new_shards, text, doc_id)
