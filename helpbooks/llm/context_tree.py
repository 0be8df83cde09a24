"""Context-tree weighting over bytes as a language model of documents.

Every byte is eight binary decisions; a decision's context is the bits of the
byte so far and the last 0 to ``depth`` bytes. Krichevsky-Trofimov estimates of
all depths are mixed with the weights that context-tree weighting gives them
from the training text. Those estimates depend on counts alone, so training is
a distributed count of byte n-grams (depth + 1 bytes, each with its training
count): the tree's nodes are sums over them. The fitted model is then frozen and
every document is scored with it.

* ``observed``: one pass; each task sends its different n-grams and words once.
* ``predicted``: n-grams are dealt out by their last ``anchor`` context bytes.
  Each task builds the subtrees below, some whole contexts at a time: with three
  bytes fixed, depth 5 leaves at most 2**24 n-grams of a context. Only sums for
  shallower nodes go up, and the mixture of those comes back down: through the
  driver while they are few, else as tables, a byte further up, where there are at
  most 255 x 256 nodes, and down again by a join; results are the same.
* ``scored``: one pass; frequent n-grams and words (more than 1 in ``FREQUENT``
  of the training text, so at most ``FREQUENT`` of each) are looked up in the
  task, all others go through a join.

Texts are scored as UTF-8 with A-Z in lower case, followed by an end symbol that
no text can hold; the score is log10 of the probability of all of it. Null texts
are empty (the end symbol alone). A null id counts as an empty one, which is a
training id. Repeated rows are documents of their own. Very long texts are scored
whole, one at a time. With no training text all bits have probability 1/2, and an
empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textarrays as ta

DEPTH = 5
FREQUENT = 1 << 21
#: Nodes just above the anchor that go through the driver; more of them are a table that is joined.
MOST_ABOVE = 500_000
END = 255
#: Bytes of context by which n-grams are dealt out.
ANCHOR = 3
#: N-grams of whole contexts that a task takes at a time (one context can have more).
_TAKEN = 250_000
_HELD = 1_500_000  # different keys that a task holds before it sends them


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word hashes as negative longs (n-grams are not negative)."""
    return (ta.word_hashes(data, start, end) | np.uint64(1 << 63)).view(np.int64)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text number): for each byte and each end symbol its context and itself, the oldest byte highest."""
    n, size = len(offsets) - 1, np.diff(offsets)
    text = np.repeat(np.arange(n), size + 1)
    padded = np.full(len(data) + n * (depth + 1), END, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * depth + np.arange(n), size)] = ta.LOWER[data]
    codes = np.zeros(max(0, len(padded) - depth), np.int64)  # of every place, also of those that straddle two texts
    for k in range(depth + 1):
        codes <<= 8
        codes |= padded[k : k + len(codes)]
    return codes[np.arange(len(text)) + text * depth], text


def observed(docs: DataFrame, depth: int = DEPTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, n): training counts of words and n-grams; n-grams of held-out texts alone are there with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            if keys:
                k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
            keys.clear()
            counts.clear()

        for b in batches:
            out = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in ta.slices(b.column(1)):
                train = ~out[lo:hi]
                codes, owner = grams(data, offsets, depth)
                k, n = np.unique((codes << 1) | train[owner], return_counts=True)
                keys.append(k >> 1)
                counts.append(np.where(k & 1, n, 0))
                start, end, owner = ta.words(data, offsets)
                w, n = np.unique(word_keys(data, start, end)[train[owner]], return_counts=True)
                keys.append(w)
                counts.append(n)
                held += len(k) + len(w)
                if held > 2 * _HELD:
                    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
                    keys[:], counts[:], held = [k], [n], len(k)
                    if held > _HELD:
                        yield from merged()
                        held = 0
        yield from merged()

    common.small_batches(docs.sparkSession)
    rows = docs.select(is_held_out(doc_id).alias("out"), common.text_bytes(text).alias("text")).mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) of non-negative integers n."""
    x = n.astype(np.float64) + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):  # up to where the series is exact to double precision
        small = x < 8
        shift -= np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / x
    series = y * (1 / 12 - y**2 * (1 / 360 - y**2 * (1 / 1260 - y**2 / 1680)))
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def log_factorial(n: np.ndarray) -> np.ndarray:
    x = n.astype(np.float64) + 1
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + y * (1 / 12 - y**2 * (1 / 360 - y**2 * (1 / 1260 - y**2 / 1680)))


_SMALL = 4096  # counts below it are looked up
_GAMMA_HALF, _FACTORIAL = log_gamma_half(np.arange(_SMALL)), log_factorial(np.arange(_SMALL))


def _looked_up(table: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], n: np.ndarray) -> np.ndarray:
    out = table.take(n.astype(np.int64), mode="clip")
    large = np.flatnonzero(n >= len(table))
    out[large] = exact(n[large])
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any order of so many zeros and ones."""
    gamma = _looked_up(_GAMMA_HALF, log_gamma_half, zeros) + _looked_up(_GAMMA_HALF, log_gamma_half, ones)
    return gamma - np.log(np.pi) - _looked_up(_FACTORIAL, log_factorial, zeros + ones)


LOG_HALF = np.log(0.5)


class Levels:
    """Nodes of depths ``depth`` down to ``least``, from n-grams whose subtrees are all here."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int, least: int):
        self.depth, self.least = depth, least
        symbol, context = codes & 255, codes >> 8
        turned = np.zeros_like(context)
        for k in range(depth):  # the latest byte highest, so that a node's subtree stands together
            turned |= ((context >> (8 * k)) & 255) << (8 * (depth - 1 - k))
        self.bit = np.empty((len(codes), 8), np.int8)
        self.place = np.empty((len(codes), 8), np.int64)  # of each bit's node among the deepest
        by_context, parts, found = np.argsort(turned, kind="stable"), [], 0
        for step in range(8 if len(codes) else 0):  # longer prefixes are greater, so the steps' nodes follow each other
            prefix, self.bit[:, step] = (1 << step) | (symbol >> (8 - step)), (symbol >> (7 - step)) & 1
            order = by_context[np.argsort(prefix[by_context].astype(np.uint8), kind="stable")]
            keys = ((prefix << (8 * depth)) | turned)[order]
            first = np.append(True, keys[1:] != keys[:-1])
            start, weight, bit = np.flatnonzero(first), n[order].astype(np.float64), self.bit[order, step]
            self.place[order, step] = found + np.cumsum(first) - 1
            parts.append((keys[start], np.add.reduceat(weight * (1 - bit), start), np.add.reduceat(weight * bit, start)))
            found += len(start)
        keys, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        below = None
        self.nodes = []  # from the deepest: (keys, zeros, ones, log weighted, share of own estimate, parent's place)
        for d in range(depth, least - 1, -1):
            own = log_kt(zeros, ones)
            total = own if below is None else np.logaddexp(LOG_HALF + own, LOG_HALF + below)
            share = np.ones(len(own)) if below is None else np.exp(LOG_HALF + own - total)
            start = np.flatnonzero(np.append(True, (keys[1:] >> 8) != (keys[:-1] >> 8))) if len(keys) else np.zeros(0, int)
            parent = np.zeros(len(keys), int)
            parent[start[1:]] = 1
            self.nodes.append((keys, zeros, ones, total, share, np.cumsum(parent)))
            if len(keys):
                keys, zeros, ones, below = keys[start] >> 8, np.add.reduceat(zeros, start), np.add.reduceat(ones, start), np.add.reduceat(total, start)
        self.above = (keys, zeros, ones, np.zeros(0) if below is None else below)

    def below_anchor(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys of the nodes above the anchor, mixed probability of a one from the anchor down), by deepest node."""
        top, p, at = np.zeros(0, np.int64), None, np.arange(len(self.nodes[0][0]))
        for keys, zeros, ones, _, share, parent in self.nodes:
            own = (ones + 0.5) / (zeros + ones + 1)
            p = own if p is None else share[at] * own[at] + (1 - share[at]) * p
            top, at = (keys >> 8)[at], parent[at]
        return top, p


def top_down(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a, b): for the nodes of ``depth``, P(one) = a + b * (mixed probability from below)."""
    order = np.argsort(keys)
    levels, (keys, zeros, ones, below) = [], (keys[order], zeros[order], ones[order], below[order])
    for _ in range(depth + 1):
        own = log_kt(zeros, ones)
        total = np.logaddexp(LOG_HALF + own, LOG_HALF + below)
        levels.append((keys, np.exp(LOG_HALF + own - total), (ones + 0.5) / (zeros + ones + 1)))
        start = np.flatnonzero(np.append(True, (keys[1:] >> 8) != (keys[:-1] >> 8)))
        keys, zeros, ones, below = keys[start] >> 8, np.add.reduceat(zeros, start), np.add.reduceat(ones, start), np.add.reduceat(total, start)
    a, b, known = None, None, None
    for keys, share, own in reversed(levels):
        if a is None:
            a, b = share * own, 1 - share
        else:
            at = np.searchsorted(known, keys >> 8)
            a, b = a[at] + b[at] * share * own, b[at] * (1 - share)
        known = keys
    return levels[0][0], a, b


def log10_of(codes: np.ndarray, n: np.ndarray, depth: int, anchor: int, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each n-gram's last byte, given the mixture above the anchor."""
    levels = Levels(codes, n, depth, anchor)
    top, p = levels.below_anchor()
    keys, a, b = above
    at = np.searchsorted(keys, top)
    one = (a[at] + b[at] * p)[levels.place]
    return np.log10(np.where(levels.bit == 1, one, 1 - one)).sum(1)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns, without the context, of some whole contexts at a time, of rows (key, n, context, ...) that are sorted by context."""
    columns: list[list[np.ndarray]] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        columns = [[*(columns[k] if columns else []), c.to_numpy()] for k, c in enumerate(b.columns)]
        held += b.num_rows
        if held >= _TAKEN:
            columns = [[np.concatenate(x)] for x in columns]
            at = columns[2][0]
            cut = int(np.searchsorted(at, at[-1]))  # the last context may go on
            if cut:
                yield tuple(x[0][:cut] for k, x in enumerate(columns) if k != 2)
                columns = [[x[0][cut:]] for x in columns]
                held -= cut
    if held:
        yield tuple(np.concatenate(x) for k, x in enumerate(columns) if k != 2)


def _mixed_above(sums: DataFrame, depth: int) -> DataFrame:
    """(node, a, b) for nodes (node, zeros, ones, below) of ``depth``, two at least, as ``top_down`` has them; the driver sees their parents alone."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            node, zeros, ones, below = (c.to_numpy() for c in batch.columns)
            kt = log_kt(zeros, ones)
            total = np.logaddexp(LOG_HALF + kt, LOG_HALF + below)
            yield node, zeros, ones, total, np.exp(LOG_HALF + kt - total), (ones + 0.5) / (zeros + ones + 1)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, zeros, ones, total, _, _ in shares(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node >> 8, zeros, ones, total)], names=["node", "zeros", "ones", "below"])

    parents = sums.mapInArrow(up, "node long, zeros double, ones double, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    got = parents.toArrow()
    shipped = sums.sparkSession.sparkContext.broadcast(top_down(*(got.column(c).to_numpy() for c in ("node", "zeros", "ones", "below")), depth - 1))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a, b = shipped.value
        for node, _, _, _, share, own in shares(batches):
            at = np.searchsorted(known, node >> 8)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, a[at] + b[at] * share * own, b[at] * (1 - share))], names=["node", "a", "b"])

    return sums.mapInArrow(down, "node long, a double, b double")


def predicted(table: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, most_above: int = MOST_ABOVE) -> DataFrame:
    """(key, n, x): each n-gram's log10 probability under the frozen tree. ``table``: (key, n) of n-grams alone."""
    spark = table.sparkSession
    anchor = min(anchor, depth)
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * anchor)) - 1))
    dealt = table.select("key", "n", context.alias("context")).repartition("context").sortWithinPartitions("context")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _contexts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in Levels(codes, n, depth, anchor).above], names=["node", "zeros", "ones", "below"])

    sums = dealt.mapInArrow(up, "node long, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    sums = common.cut(sums)
    if anchor > 2 and sums.count() > most_above:  # at an anchor of two bytes there are at most 255 x 256 nodes above it
        return _predicted_by_join(dealt, sums, depth, anchor)
    got = sums.toArrow()
    above = top_down(*(got.column(c).to_numpy() for c in ("node", "zeros", "ones", "below")), anchor - 1) if got.num_rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    shipped = spark.sparkContext.broadcast(above)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _contexts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(log10_of(codes, n, depth, anchor, shipped.value))], names=["key", "n", "x"])

    return dealt.mapInArrow(down, "key long, n long, x double")


def _predicted_by_join(dealt: DataFrame, sums: DataFrame, depth: int, anchor: int) -> DataFrame:
    """``predicted`` of n-grams (key, n, context) dealt by context, with the nodes above the anchor as a table: each context is sent those that it hangs from, of which there are at most 255."""

    def hangs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in _contexts(batches):
            keys = Levels(codes, n, depth, anchor).nodes[-1][0]
            context = np.zeros_like(keys)
            for k in range(anchor):  # the latest byte lowest again
                context |= ((keys >> (8 * k)) & 255) << (8 * (anchor - 1 - k))
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(keys >> 8)], names=["context", "node"])

    above = dealt.mapInArrow(hangs, "context long, node long").join(_mixed_above(sums, anchor - 1), "node")  # a node has 256 contexts at most
    none = {"long": F.lit(0).cast("long"), "double": F.lit(0.0)}
    grams_ = dealt.select("key", "n", "context", F.lit(1).alias("gram"), none["double"].alias("a"), none["double"].alias("b"))
    nodes = above.select(F.col("node").alias("key"), none["long"].alias("n"), "context", F.lit(0).alias("gram"), "a", "b")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, gram, a, b in _contexts(batches):
            own = gram == 1
            known, first = np.unique(key[~own], return_index=True)
            codes, n = key[own], n[own]
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(log10_of(codes, n, depth, anchor, (known, a[~own][first], b[~own][first])))], names=["key", "n", "x"])

    return grams_.unionByName(nodes).repartition("context").sortWithinPartitions("context").mapInArrow(down, "key long, n long, x double")


PARTS = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, key long, n long"


def scored(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the code length, the end symbol counting as a byte)."""
    spark = docs.sparkSession
    table = common.cut(observed(docs, depth, text, doc_id))
    is_word, is_end = F.col("key") < 0, F.col("key").bitwiseAND(F.lit(255)) == END
    t = table.agg(F.sum(F.when(is_word, F.col("n"))), F.count(F.when(is_word, 1)), F.sum(F.when(~is_word, F.col("n"))), F.sum(F.when(~is_word & is_end, F.col("n")))).first()
    n_words, n_distinct, n_symbols, n_ends = (int(x or 0) for x in t)
    train, distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    floor = float(train + 0.5 * (distinct + 1))
    words = table.filter(is_word).select("key", "n", F.log10((F.col("n") + 0.5) / floor).alias("x"))
    model = common.cut(words.unionByName(predicted(table.filter(~is_word), depth)))
    often = F.when(is_word, F.col("n") >= max(1, n_words / frequent)).otherwise(F.col("n") >= max(1, n_symbols / frequent))  # at most `frequent` of each
    top = model.filter(often).select("key", "x").toArrow()
    keys, values = top.column("key").to_numpy(), top.column("x").to_numpy()
    order = np.argsort(keys)
    shipped = spark.sparkContext.broadcast((keys[order], values[order].astype(np.float64)))
    end_value = float(np.log10((n_ends + 0.5) / floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shipped.value
        split = int(np.searchsorted(known, 0))
        tables = ((known[:split], value[:split]), (known[split:], value[split:]))

        def looked_up(k: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
            own, x = tables[which]
            if not len(own):
                return np.zeros(len(k)), np.zeros(len(k), bool)
            at = np.minimum(np.searchsorted(own, k), len(own) - 1)
            hit = own[at] == k
            return np.where(hit, x[at], 0.0), hit

        for b in batches:
            rid, ids, out = (b.column(k) for k in range(3))
            for lo, hi, data, offsets in ta.slices(b.column(3)):
                m = hi - lo
                start, end, owner = ta.words(data, offsets)
                w, inverse = np.unique(word_keys(data, start, end), return_inverse=True)
                x, hit = looked_up(w, 0)
                x, hit = x[inverse], hit[inverse]
                base = np.bincount(owner, weights=x, minlength=m) + end_value
                n_known = np.bincount(owner, weights=hit, minlength=m).astype(np.int64) + (n_ends > 0)
                n_tokens = np.bincount(owner, minlength=m) + 1
                g, g_owner = grams(data, offsets, depth)
                u, g_inverse = np.unique(g, return_inverse=True)
                y, g_hit = looked_up(u, 1)
                score = np.bincount(g_owner, weights=y[g_inverse], minlength=m)
                rows = [pa.array([None] * m, pa.int64())] * 2
                part = [rid.slice(lo, m), ids.slice(lo, m), out.slice(lo, m), pa.array(n_tokens), pa.array(n_known), pa.array(np.diff(offsets)), pa.array(base), pa.array(score), *rows]
                yield pa.RecordBatch.from_arrays(part, names=[c.split()[0] for c in PARTS.split(", ")])
                for which, place, who in ((w, inverse[~hit], owner[~hit]), (u, g_inverse[~g_hit[g_inverse]], g_owner[~g_hit[g_inverse]])):
                    if len(place):
                        pair, n = np.unique(who * np.int64(len(which)) + place, return_counts=True)
                        own = rid.slice(lo, m).to_numpy()[pair // len(which)]
                        none = [pa.nulls(len(pair), k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.array(own), *none, pa.array(which[pair % len(which)]), pa.array(n)], names=[c.split()[0] for c in PARTS.split(", ")])

    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), is_held_out(doc_id).alias("out"), common.text_bytes(text).alias("text"))
    path = os.path.join(common.shared_dir(spark), f"scores-{uuid.uuid4().hex}")
    base.mapInArrow(run, PARTS).write.parquet(path)
    parts = spark.read.schema(PARTS).parquet(path)
    rest = parts.filter("key is not null").select("rid", "key", "n").join(model.filter(~often).select("key", F.col("n").alias("c"), "x"), "key", "left")
    word, found = F.col("key") < 0, F.col("x").isNotNull() & (F.col("c") > 0)
    value = F.coalesce("x", F.when(word, F.lit(float(np.log10(0.5 / floor)))).otherwise(F.lit(0.0)))
    rest = rest.groupBy("rid").agg(F.sum(F.when(word & found, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.when(word, value * F.col("n")).otherwise(0.0)).alias("more_base"), F.sum(F.when(~word, value * F.col("n")).otherwise(0.0)).alias("more_score"))
    whole = parts.filter("key is null").join(rest, "rid", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
