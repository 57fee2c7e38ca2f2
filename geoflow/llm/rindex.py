"""Repeated-passage removal with run-length (r-index) blocks over content-keyed fragments.

A 200-byte string that occurs twice has the same smallest 16-gram hash at both places. Texts are therefore cut into
fragments, the maximal runs of window starts with one smallest hash, and only fragments of equal hash are brought
together. Those that share no more than a phrase around that gram go first. Each task indexes the others block by block:
suffix order, run-compressed Burrows-Wheeler transform, the text positions of run heads and run ends, and from these
alone, streamed in text order, how far every position matches another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import documents, in_arrow, spill

WINDOW, GRAM = 200, 16
#: Bytes of distinct fragments that a block of the index holds; a hash with more is dealt out by whole windows.
BLOCK = 1 << 20
#: Bytes of small keys that are indexed together, and bytes of text that are keyed at once: their arrays stay in cache.
PACK, SLICE = 1 << 16, 1 << 17
#: Parts that the places of a window around its smallest gram are seen in.
PARTS = 4
#: Symbols of the first sort, and positions from which a key and a place no longer fit one number.
SYMBOLS, PACKED = 4, 1 << 21

_rng = np.random.default_rng(4)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BASE = int(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 1 << 64)


_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first `n` powers of `base`; those of short texts are kept in the process."""
    if n <= 2 * BLOCK and base in _kept:
        return _kept[base][:n]
    out = np.full(max(n, 2 * BLOCK), base, "uint64")
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    _kept.setdefault(base, out[: 2 * BLOCK].copy())
    return out[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of `data` up to each position, modulo 2**64."""
    return np.concatenate([np.zeros(1, "uint64"), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype="uint64")])


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from `start` to `end`, whatever their place."""
    inverse = _powers(_INVERSE, len(sums))
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype("uint64") * np.uint64(0xD6E8FEB86659FD93))


def _over(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least (or greatest, by `pick`) of each `width` values in a row, by doubling."""
    k = 1
    while 2 * k <= width:
        h, k = pick(h[:-k], h[k:]), 2 * k
    return pick(h[: len(h) - (width - k)], h[width - k :])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the `gram` bytes at each position that has as many."""
    padded, n = np.zeros(-(-len(data) // 8) * 8 + 8 + gram, "uint8"), len(data)
    padded[:n] = data
    words = np.empty(-(-len(data) // 8) * 8 + gram, "uint64")
    for k in range(8):
        words[k::8] = padded[k : k + len(words[k::8]) * 8].view("<u8")
    h = np.zeros(n, "uint64")
    for k in range(0, gram, 8):
        h ^= words[k : k + n]
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return _mix(h[: max(n - gram + 1, 0)])


def fragments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one smallest gram hash: text, first start, number of starts, hash, content hash, again.

    `again` marks runs whose smallest gram comes twice so near that a window may repeat within the run itself.
    """
    size = np.array([len(t) for t in texts], "int64")
    data = np.frombuffer(b"".join(texts), "uint8")
    has = np.flatnonzero(size >= window)
    if not len(has):
        return tuple(np.zeros(0, k) for k in ("int64", "int64", "int64", "uint64", "uint64", "bool"))
    h = gram_hashes(data, gram)
    width = window - gram + 1
    least = _over(h, width, np.minimum)
    end = np.cumsum(size)
    begin = end - size
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    new[begin[has]] = new[end[has] - window + 1] = True
    run = np.flatnonzero(new)
    starts, lengths = run[:-1], np.diff(run)
    which = np.searchsorted(end, starts, "right")
    inside = starts - begin[which] <= size[which] - window  # no window that goes on into the next text
    which, starts, lengths = which[inside], starts[inside], lengths[inside]
    keys = least[starts]
    # grams that are the smallest of some window: only there can a window equal one of its own run
    smallest = np.zeros(len(h) + width - 1, "uint64")
    smallest[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_over(smallest, width, np.maximum) == h)
    at = at[np.argsort(h[at], kind="stable")]
    value = h[at]
    again = np.isin(keys, value[1:][(value[1:] == value[:-1]) & (np.diff(at) <= width)])
    content = substring_hashes(prefix_sums(data), starts, starts + lengths + window - 1)
    return which, starts - begin[which], lengths, keys, content, again


def may_repeat(keys: np.ndarray, strings: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which fragments (whole keys) can hold a window that repeats; never False for one that does.

    Where all fragments of a key hold its gram once, equal windows have it at the same place. Windows with the gram in
    one of PARTS ranges of places share the bytes common to that range, so a fragment that shares none of these parts
    with another one of its key shares no window.
    """
    size = np.array([len(s) for s in strings], "int64")
    data = np.frombuffer(b"".join(strings), "uint8")
    end = np.cumsum(size)
    begin = end - size
    at = np.flatnonzero(gram_hashes(data, gram) == np.repeat(keys, size)[: max(len(data) - gram + 1, 0)])
    which = np.searchsorted(end, at, "right")
    at, which = at[at + gram <= end[which]], which[at + gram <= end[which]]
    _, key = np.unique(keys, return_inverse=True)
    keep = np.isin(key, key[np.bincount(which, minlength=len(size)) != 1])
    at, which = at[~keep[which]], which[~keep[which]]
    sums, reach = prefix_sums(data), window - gram
    for part in range(PARTS):
        first, last = at - reach * part // PARTS, at + window - reach * (part + 1) // PARTS
        ok = (first >= begin[which]) & (last <= end[which])
        shared = _mix(substring_hashes(sums, first[ok], last[ok]) ^ keys[which[ok]])
        _, same, times = np.unique(shared, return_inverse=True, return_counts=True)
        keep[which[ok][times[same] > 1]] = True
    return keep


class RunIndex:
    """The run-length index of a block of strings, kept apart by ends that equal nothing."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], "int64")
        self.starts = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), "int64")
        inside = np.ones(len(text), bool)
        inside[self.starts + size] = False
        text[inside] = np.frombuffer(b"".join(strings), "uint8").astype("int64") + 1
        left = np.repeat(self.starts + size, size + 1) - np.arange(len(text))
        self.text, self.left = text, left
        self._sort(int(size.max(initial=0)))
        order = self.order
        before = np.where(order > 0, text[order - 1], 0)  # the transform; 0 where a string begins
        head = np.ones(len(order), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(head)
        self.runs = len(heads)
        tails = np.append(heads[1:], len(order)) - 1
        #: Positions at run heads with the row above, and at run ends with the row below: all that matching needs.
        self.head, self.above = order[heads], np.where(heads > 0, order[heads - 1], -1)
        self.tail, self.below = order[tails], np.where(tails + 1 < len(order), order[np.minimum(tails + 1, len(order) - 1)], -1)

    def _sort(self, longest: int) -> None:
        """Order of all positions by prefix doubling to the strings' ends; equal rests stay in text order."""
        text, left = self.text, self.left
        n, k = len(text), SYMBOLS
        place, key = np.arange(n), np.zeros(n, "int64")
        for j in range(k):
            key <<= 9
            key[: n - j] |= np.where(left[: n - j] > j, text[j:], 0)
        self.levels = []
        while True:
            # key and place in one number where they fit: sorting numbers is several times faster than sorting places
            if n < PACKED:
                packed = key << 21 | place
                packed.sort()
                order, sorted_key = packed & (PACKED - 1), packed >> 21
            else:
                order = np.argsort(key, kind="stable")
                sorted_key = key[order]
            rank = np.empty(n, "int32")
            step = np.zeros(n, "int32")
            step[1:] = sorted_key[1:] != sorted_key[:-1]
            rank[order] = np.cumsum(step, dtype="int32")
            self.levels.append((k, rank))
            if k >= longest:
                break
            bits = 21 if n < PACKED else 31
            key = rank.astype("int64") << bits
            key[: n - k] |= np.where(left[: n - k] > k, rank[k:] + 1, 0)
            k *= 2
        self.order = order[left[order] > 0]

    def _common(self, p: np.ndarray, q: np.ndarray, least: int = 1) -> np.ndarray:
        """Longest common extensions of pairs of positions; 0 where there is none, or surely none of `least` symbols."""
        near = q >= 0
        for rank in [rank for k, rank in self.levels if k <= least][-1:]:
            near &= rank[p] == rank[np.maximum(q, 0)]
        out = np.zeros(len(p), "int64")
        out[near] = self._extension(p[near], q[near])
        return out

    def _extension(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n, off = len(self.text), np.zeros(len(p), "int64")
        for k, rank in reversed(self.levels):
            same = rank[np.minimum(p + off, n - 1)] == rank[np.minimum(q + off, n - 1)]
            off += np.where(same, k, 0)
        same = np.ones(len(p), bool)
        for _ in range(SYMBOLS - 1):  # what is left below the first level
            same &= (off < self.left[p]) & (off < self.left[q])
            same &= self.text[np.minimum(p + off, n - 1)] == self.text[np.minimum(q + off, n - 1)]
            off += same
        return np.minimum(off, np.minimum(self.left[p], self.left[q]))

    def matching(self, least: int = 1) -> np.ndarray:
        """For every text position, the length of its longest match with another position; exact from `least` on.

        Inside a run the neighbour of a position is the neighbour of the one before it, moved by one, so its match is
        one shorter: only run heads and run ends are compared, the rest is streamed in text order.
        """
        n, best = len(self.text), 0
        for at, other in ((self.head, self.above), (self.tail, self.below)):
            value, since = np.zeros(n, "int64"), np.zeros(n, "int64")
            value[at], since[at] = self._common(at, other, least), at
            since = np.maximum.accumulate(since)
            best = np.maximum(best, value[since] - (np.arange(n) - since))
        return best

    def repeated(self, window: int) -> list[np.ndarray]:
        """For each string, the starts of its windows that also start elsewhere in the block."""
        hit = np.flatnonzero((self.matching(window) >= window) & (self.left >= window))
        which = np.searchsorted(self.starts, hit, "right") - 1
        return np.split(hit - self.starts[which], np.searchsorted(which, np.arange(1, len(self.starts))))


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


def _keyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, sum, start, n, key, content, again): the fragments of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from geoflow.llm.bpe import _rows_at_once

        names = ["id", "sum", "start", "n", "key", "content", "again"]
        for whole in batches:
            for batch in _rows_at_once(whole, "text", SLICE):
                which, start, n, key, content, again = fragments([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")], window, gram)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("sum").take(take), pa.array(start), pa.array(n), pa.array(key.view("int64")), pa.array(content.view("int64")), pa.array(again)], names)

    return in_arrow(docs, run, "id long, sum long, start long, n long, key long, content long, again boolean")


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, content, times, bytes) of one place of each wanted fragment."""
    by = wanted.groupBy(F.col("place.id").alias("_id"), F.col("place.sum").alias("_sum")).agg(F.collect_list(F.struct("key", "content", "times", "place.start", "place.n")).alias("cuts"))
    rows = docs.join(by, docs.id.eqNullSafe(by._id) & (docs["sum"] == by._sum)).select("text", "cuts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            seen, out = set(), ([], [], [], [])
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                data = text.as_buffer().to_pybytes()
                for c in cuts.as_py():
                    if (c["key"], c["content"]) not in seen:
                        seen.add((c["key"], c["content"]))
                        for column, x in zip(out, (c["key"], c["content"], c["times"], data[c["start"] : c["start"] + c["n"] + window - 1]), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["key", "content", "times", "bytes"])

    return in_arrow(rows, run, "key long, content long, times long, bytes binary").dropDuplicates(["key", "content"])


def indexed(rows: list[tuple[int, int, bytes]], window: int = WINDOW, gram: int = GRAM, pack: int = PACK) -> Iterator:
    """(key, content, spans) of `rows` (key, content, bytes), whole keys in order, that hold windows that repeat."""
    keep = may_repeat(np.array([r[0] for r in rows], "int64").view("uint64"), [r[2] for r in rows], window, gram)
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    size, packs = 0, [[]]
    for row in rows:
        if size >= pack and packs[-1][-1][0] != row[0]:
            packs.append([])
            size = 0
        packs[-1].append(row)
        size += len(row[2])
    for some in packs if rows else []:
        for (key, content, _), hits in zip(some, RunIndex([r[2] for r in some]).repeated(window), strict=True):
            if len(hits):
                yield key, content, _runs(hits)


def _index_blocks(strings: DataFrame, window: int, gram: int, block: int) -> DataFrame:
    """(key, content, spans): window starts, as (first, last), that repeat among the fragments of a key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answer(rows: list) -> pa.RecordBatch:
            found = list(indexed(rows, window, gram))
            spans = [[{"first": a, "last": b} for a, b in r[2]] for r in found]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array(spans, kind)], ["key", "content", "spans"])

        rows, size = [], 0
        for batch in batches:
            for key, content, data in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "bytes")), strict=True):
                if rows and rows[-1][0] != key and size >= block:
                    yield answer(rows)
                    rows, size = [], 0
                rows.append((key, content, data))
                size += len(data)
        if rows:
            yield answer(rows)

    # partitions hold whole keys in order, and a block whole keys of about `block` bytes
    return in_arrow(strings.select("key", "content", "bytes").repartition("key").sortWithinPartitions("key", "content"), run, "key long, content long, spans array<struct<first:long,last:long>>")


def _by_windows(strings: DataFrame, window: int) -> DataFrame:
    """As `_index_blocks`, for keys with too many bytes for one block: one row a window, counted by its hash.

    A window's hash is 128 bits, of two independent halves with the key. Windows spread evenly whatever the key holds.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, content, data in zip(*(batch.column(c) for c in ("key", "content", "bytes")), strict=True):
                data = np.frombuffer(data.as_py(), "uint8")
                start = np.arange(len(data) - window + 1)
                h = substring_hashes(prefix_sums(data), start, start + window)
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key.as_py())), pa.array(np.full(n, content.as_py())), pa.array(start), pa.array(h.view("int64"))], ["key", "content", "first", "h"])

    rows = in_arrow(strings, run, "key long, content long, first long, h long")
    # a table, so that adaptive execution can split a window that very many fragments share
    more = spill(rows.groupBy("key", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "h"), "windows")
    hits = rows.join(more, ["key", "h"]).groupBy("key", "content").agg(F.collect_list(F.struct("first", F.col("first").alias("last"))).alias("spans"))
    return hits


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(id, sum, spans): byte spans (from, to) of each text that a repeated window covers; `docs` has id, sum, text."""
    keyed = _keyed(docs, window, gram)
    common = spill(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("of_key"), F.max("again").alias("any")).where("of_key > 1 OR any").select("key"), "common")
    places = spill(keyed.join(common, "key"), "fragments")
    kinds = spill(places.groupBy("key", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "sum", "start", "n")).alias("place"), F.max("again").alias("again")), "kinds")
    sizes = spill(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("place.n") + window).alias("bytes"), F.max("again").alias("any")).where("kinds > 1 OR any").select("key", "bytes"), "sizes")
    sized = spill(kinds.join(sizes, "key"), "sized")
    strings = spill(_cut_out(docs, sized, window).join(sizes.withColumnRenamed("bytes", "total"), "key"), "strings")
    found = _index_blocks(strings.where(F.col("total") <= block), window, gram, block).union(_by_windows(strings.where(F.col("total") > block), window))
    # a fragment that comes several times repeats as a whole
    whole = kinds.where("times > 1").select("key", "content", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("place.n") - 1).alias("last"))).alias("spans"))
    found = spill(found.where(F.size("spans") > 0).union(whole), "found")
    hit = places.join(found, ["key", "content"]).select("id", "sum", F.transform("spans", lambda s: F.struct((F.col("start") + s["first"]).alias("from"), (F.col("start") + s["last"] + window).alias("to"))).alias("spans"))
    return hit.groupBy("id", "sum").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row: the UTF-8 bytes left when repeated windows are cut out.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else in the table, in the same text
    or another; judged on the input. Null is empty; repeated rows are copies of each other and lose all windows;
    shorter texts stay whole. `kept` is binary, as a cut may part a character; with `digest`, kept_sha256 instead.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("sum", F.xxhash64("text"))
    spans = repeated_spans(docs, window, block=block)
    spans = spill(spans, "spans").select(F.col("id").alias("_id"), F.col("sum").alias("_sum"), "spans")
    rows = docs.join(spans, docs.id.eqNullSafe(spans._id) & (docs["sum"] == spans._sum), "left").select("id", "text", "spans")

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        for batch in batches:
            n, gone, count, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, merged = text.as_buffer().to_pybytes(), []
                for s in spans.as_py() or []:
                    if merged and s["from"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["to"])
                    else:
                        merged.append([s["from"], s["to"]])
                left = b"".join(data[a:b] for a, b in zip([0, *(m[1] for m in merged)], [*(m[0] for m in merged), len(data)], strict=True))
                n.append(len(data))
                gone.append(len(data) - len(left))
                count.append(len(merged))
                kept.append(sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], [id, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return in_arrow(rows, run, f"`{id}` long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest=True)
