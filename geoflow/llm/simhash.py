"""SimHash near-dedup with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import components, documents, fresh, in_arrow, spill
from geoflow.llm.shingles import shingle_hashes

BITS = 64
#: Fingerprints in a bucket that are compared with each other; larger buckets get finer keys.
BUCKET = 64
#: Slots of a set's parity sketch; texts of a place that meet in one task; common shingles that are known to every task.
BITMAP, BLOCK, LATE = 256, 1000, 100_000


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, seed: int = 42, also: dict[str, int] | None = None) -> DataFrame:
    """`df` without `text`, with `fp` (64 bits as a long), and with fingerprints of `also` (column name to words).

    A-Z are lower-cased, words are runs of anything but ASCII white space, and each shingle of `words` words (repeats
    count; a shorter text is one shingle) votes with its XXH64. A bit is set where over half of the shingles set it.
    Null, empty and blank texts have fingerprint 0. Columns of these names in `df` are replaced.
    """
    made = {"fp": words, **(also or {})}
    keep = [c for c in df.columns if c not in (text, *made)]
    own = fresh(df, "_text")
    df = df.select(*keep, F.col(text).cast("string").alias(own))
    schema = df.drop(own).schema
    for name in made:
        schema = schema.add(name, "long", True)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights = np.uint64(1) << np.arange(BITS, dtype="uint64")

        def one(value: str | None, words: int) -> int:
            h = shingle_hashes(value, words, seed)
            n = len(h)
            votes = np.zeros(BITS, "int64")
            for k in range(0, n, 1 << 16):
                votes += np.unpackbits(h[k : k + (1 << 16)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
            return int(weights[2 * votes > n].sum(dtype="uint64").astype("int64"))

        for batch in batches:
            fps = [[one(x.as_py(), n) for x in batch.column(own)] for n in made.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in fps)], [*keep, *made])

    return in_arrow(df, run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def chains(free: list[int], segments: dict[int, int], budget: int) -> list[tuple[int, ...]]:
    """The longest chains of consecutive segments, around the ring of `free`, whose budget is below one bit.

    If all segments together differ in at most `budget` bits, there is a start from which every chain of l segments
    differs in at most l * budget / len(free) bits. While that is below 1, the chain must be equal.
    """
    n = len(free)
    length = -(-n // budget) - 1 if budget else n
    return [tuple(sorted(free[(i + k) % n] for k in range(length))) for i in range(n)] if length else []


class Ring:
    """Keys for pairs within `budget` bits: masks of equal chains, and finer masks for full buckets."""

    def __init__(self, budget: int = 2, segments: int = 16):
        if BITS % segments or budget >= segments:
            raise ValueError("segments must divide 64 and outnumber the differing bits")
        width = BITS // segments
        self.budget, self.count, self.width = budget, segments, width
        self.part = {i: ((1 << width) - 1) << (i * width) for i in range(segments)}

    def first(self) -> list[tuple[int, ...]]:
        return sorted(set(chains(list(range(self.count)), self.part, self.budget)))

    def finer(self, fixed: tuple[int, ...]) -> list[tuple[int, ...]]:
        free = [i for i in range(self.count) if i not in fixed]
        return sorted({tuple(sorted(fixed + c)) for c in chains(free, self.part, self.budget)}) if len(free) > self.budget else []

    def mask(self, fixed: tuple[int, ...]) -> int:
        return _signed(sum(self.part[i] for i in fixed))

    def holds(self, x: Column) -> Column:
        """The pigeonring test of a difference `x`: from some start, every chain stays within its share of the budget."""
        starts = []
        for i in range(self.count):
            mask, tests = 0, []
            for length in range(1, self.count):
                mask |= self.part[(i + length - 1) % self.count]
                most = length * self.budget // self.count
                if (length + 1) * self.budget // self.count > most or length == self.count - 1:  # the longest chain of each budget implies the shorter ones
                    tests.append(F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) <= most)
            test = tests[0]
            for t in tests[1:]:
                test = test & t
            starts.append(test)
        out = starts[0]
        for s in starts[1:]:
            out = out | s
        return out


def links(fps: DataFrame, budget: int = 2, segments: int = 16, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u < v) of distinct fingerprints of `fps` (column fp) that differ in at most `budget` bits: all of them.

    Rows are keyed by the bits of each equal chain that the pigeonring principle allows. Buckets of up to `bucket`
    fingerprints are compared, chain budgets first, then the full Hamming distance. Fuller buckets are keyed again by
    chains of their other segments, which must again hold an equal one, until few segments are free: no bucket is
    capped, and none holds all pairs of a large group. Nulls have no links.
    """
    ring = Ring(budget, segments)
    rows = fps.where("fp IS NOT NULL").select("fp").distinct()
    masks = {m: ring.mask(m) for m in ring.first()}
    rows = rows.select("fp", F.explode(F.array(*map(F.lit, masks.values()))).alias("mask"))
    found = []
    while masks:
        last = {m: ring.finer(m) for m in masks}
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = keyed.join(sizes, ["mask", "key"])
        full = spill(full.select("mask", "key", "fp", "n"), "buckets")
        splits = F.lit(False) if not any(last.values()) else (F.col("n") > bucket) & F.col("mask").isin([masks[m] for m in masks if last[m]])
        group = full.where(~splits).groupBy("mask", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        close = lambda a, b: (F.bit_count(a.bitwiseXOR(b)) <= budget) & ring.holds(a.bitwiseXOR(b))
        pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & close(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
        found.append(group.select(F.explode(pairs).alias("p")).select("p.*"))
        rows = full.where(splits).select("fp", "mask")
        if not any(last.values()) or rows.isEmpty():
            break
        schema = T.StructType([T.StructField("mask", T.LongType()), T.StructField("finer", T.ArrayType(T.LongType()))])
        steps = fps.sparkSession.createDataFrame([(masks[m], [ring.mask(f) for f in to]) for m, to in last.items()], schema)
        masks = {f: ring.mask(f) for to in last.values() for f in to}
        # at most one row a mask: bounded by segments and budget, not by the data
        rows = rows.join(F.broadcast(steps), "mask").select("fp", F.explode("finer").alias("mask")).distinct()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()  # several chains may find a pair


def simhash_groups(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of `df`: its id, `fp`, and component_id, the least id reachable over links of `budget` bits.

    Texts without words have fingerprint 0 and are linked as any other. Rows with a null id take part in links and get
    their group's least id (null if it has none). Repeated ids are rows each.
    """
    fps = spill(fingerprints(df.select(F.col(id), F.col(text)), text, words, seed), "fingerprints")
    least = spill(fps.groupBy("fp").agg(F.min(id).alias("least")), "distinct")
    linked = components(spill(links(least, budget), "links"))
    both = least.join(linked, least.fp == linked.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of = both.groupBy("label").agg(F.min("least").alias("component_id"))
    named = spill(both.join(of, "label").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select(id, "fp", "component_id")


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(sum, _text): the texts of `docs` with the sums in `asked` (sum), once each; other texts are not dealt where few are asked."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("sum", F.xxhash64("_text"))
    return texts.join(asked.distinct(), "sum", "left_semi").groupBy("sum").agg(F.first("_text").alias("_text"))


def _sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(sum, set): the sorted hashes of the shingles of the texts with the sums in `asked`, each text hashed once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view("int64") for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("sum"), pa.array(sets, pa.list_(pa.int64()))], ["sum", "set"])

    return spill(in_arrow(_texts(docs, asked), run, "sum long, set array<long>"), "sets")


def _wide(h) -> bytes:
    """Whether the number of hashes in each slot is odd, a bit a slot, four slots or more a hash."""
    import numpy as np

    slots = 1 << max(8, (4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(slots - 1)).astype("int64"), minlength=slots) & 1).astype("uint8"), bitorder="little").tobytes()


def _left_by_wide(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """`pairs` (a, b) whose wide sketches leave room for this similarity: nearly only those that have it, and all of them.

    A sketch of twice the slots folds to the smaller by joining its halves.
    """
    wide = known.select("sum", "n", "wide")
    both = pairs.join(wide.select(F.col("sum").alias("a"), F.col("n").alias("x"), F.col("wide").alias("_a")), "a").join(wide.select(F.col("sum").alias("b"), F.col("n").alias("y"), F.col("wide").alias("_b")), "b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("_a"), batch.column("_b"), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = (np.frombuffer(c.as_buffer(), "uint64") for c in (a, b))
                while len(a) > len(b):
                    a = a[: len(a) // 2] ^ a[len(a) // 2 :]
                while len(b) > len(a):
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                keep.append(int(np.bitwise_count(a ^ b).sum()) <= (x + y) * ((1 - similarity) / (1 + similarity)) + 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return spill(in_arrow(both.select("a", "b", "x", "y", "_a", "_b"), run, "a long, b long"), "near")


def _alike(pairs: DataFrame, known: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """`pairs` (a, b: text sums) whose sets of shingles of `words` words have at least this Jaccard similarity."""
    pairs = _left_by_wide(spill(pairs.select("a", "b").distinct(), "candidates"), known, similarity)
    sets = _sets(docs, pairs.select(F.col("a").alias("sum")).union(pairs.select(F.col("b").alias("sum"))), words)
    both = pairs.join(sets.select(F.col("sum").alias("a"), F.col("set").alias("_a")), "a").join(sets.select(F.col("sum").alias("b"), F.col("set").alias("_b")), "b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("_a"), batch.column("_b"), strict=True):
                x, y = (c.values.to_numpy().view("uint64") for c in (a, b))
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return spill(in_arrow(both.select("a", "b", "_a", "_b"), run, "a long, b long"), "alike")


def _prefix(h, common, similarity: float):
    """The first of a set of n hashes, so many that two sets of this similarity must share one; those in `common` (sorted) come last."""
    import numpy as np

    most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    if len(common):  # looked up one by one: np.isin would sort all of `common` again for each text
        h = h[np.argsort(common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h, kind="stable")]
    return h[:most].view("int64").tolist() if len(h) else [0]


def _common_places(docs: DataFrame, words: int, similarity: float, bucket: int, most: int = LATE) -> list[int]:
    """The most common of the shingles that more than `bucket` texts would have in their prefixes by hash alone, `most` at most.

    Which ones these are changes the cost of the search, not its result.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            places = [_prefix(np.unique(shingle_hashes(t.as_py(), words)), (), similarity) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int64()))], ["places"])

    rows = in_arrow(docs.select(F.col("text").cast("string")), run, "places array<long>").select(F.explode("places").alias("place"))
    sizes = rows.groupBy("place").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > bucket)
    return sorted(r["place"] for r in sizes.orderBy(F.desc("size"), "place").limit(most).collect())


def _sketches(docs: DataFrame, words: int, similarity: float, late: list[int]) -> DataFrame:
    """(sum, least, n, b0-b3, wide, places) of each distinct text of `docs` (id, text): the size of its set of shingles,
    whether the number of them in each of 256 slots is odd, the same of many slots (see `_wide`), and the prefix of the set, of which two alike sets must share one.

    The prefix is the least-hashed shingles, those in `late` (sorted) after all others: any one order for all texts is
    right, and one with common shingles last makes small places. A text without words has the one place 0.
    """
    rows = docs.select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("sum", F.xxhash64("_text"))
    schema = T.StructType.fromDDL("id long, sum long, n int, b0 long, b1 long, b2 long, b3 long, wide binary, places array<long>")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        common = np.sort(np.array(late, "int64").view("uint64"))
        for batch in batches:
            sizes, odd, wide, out = [], np.zeros((batch.num_rows, BITMAP // 64), "int64"), [], []
            for k, t in enumerate(batch.column("_text")):
                h = np.unique(shingle_hashes(t.as_py(), words))
                odd[k] = np.packbits((np.bincount((h & np.uint64(BITMAP - 1)).astype("int64"), minlength=BITMAP) & 1).astype("uint8"), bitorder="little").view("int64")
                sizes.append(len(h))
                wide.append(_wide(h))
                out.append(_prefix(h, common, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sum"), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(BITMAP // 64)), pa.array(wide, pa.binary()), pa.array(out, pa.list_(pa.int64()))], schema.names)

    known = in_arrow(rows, run, schema).groupBy("sum").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in schema.names[2:]))
    return spill(known, "sketches")


def _places(known: DataFrame) -> DataFrame:
    """(place, size, first, sum): the places that at least two texts come to, with the least sum of each."""
    rows = known.select("sum", F.explode("places").alias("place"))
    of = rows.groupBy("place").agg(F.count(F.lit(1)).alias("size"), F.min("sum").alias("first")).where("size > 1")
    return spill(rows.join(of, "place").select("place", "size", "first", "sum"), "places")


def _may_be_alike(similarity: float) -> Column:
    """Whether the sketches x and y leave room for this similarity; true of every pair that has it.

    Two sets differ in at least as many shingles as slots whose numbers of shingles are not both odd or both even, so
    the sketches of alike sets are within a budget of bits. By pigeonring, from some segment on, every chain of
    consecutive segments is then within its share of the budget: most pairs fail that for chains of one or two before
    the full distance, which implies it for longer ones. With those, the condition was over 8,000 bytes of code, which
    the JVM does not compile.
    """
    x, y, n = F.col("x.n"), F.col("y.n"), BITMAP // 64
    budget = (x + y) * ((1 - similarity) / (1 + similarity)) + 1e-6
    differ = [F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(n)]
    chained = [(differ[i] * n <= budget) & ((differ[i] + differ[(i + 1) % n]) * n <= budget * 2) for i in range(n)]
    return (F.least(x, y) >= F.greatest(x, y) * similarity - 1e-6) & reduce(Column.__or__, chained) & (sum(differ[1:], differ[0]) <= budget)


def _within_places(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of `rows` (place, sum, label, main, s, blocks) that meet in a place, have different labels and may be alike.

    Those of the place's main label meet only others.
    """
    mine, others = F.pmod(F.xxhash64("sum"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("label <> main").select("place", mine.alias("i"), others.alias("j"), F.col("sum").alias("a"), F.col("label").alias("of_a"), F.col("s").alias("x"))
    right = rows.select("place", mine.alias("j"), others.alias("i"), F.col("sum").alias("b"), F.col("label").alias("of_b"), (F.col("label") == F.col("main")).alias("mains"), F.col("s").alias("y"))
    met = left.join(right, ["place", "i", "j"]).where((F.col("of_a") != F.col("of_b")) & (F.col("mains") | (F.col("a") < F.col("b"))) & _may_be_alike(similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts, links) of `docs` (id, text): distinct texts (sum, least id), and pairs (u, v) of sums that are alike.

    Every two texts of this similarity are linked, or in one component by other links. First each text is compared with
    the leader (least id) of its fingerprint over single words and with the first text of each of its places, the
    shingles of its prefix: as many comparisons as texts and places, and they link a group of copies. Then the texts of
    a place that are still in different components are compared pair by pair, those of the largest component of the
    place only with others. Places of more than `block` texts are dealt in blocks; none is capped.
    """
    known = _sketches(docs, words, similarity, _common_places(docs, words, similarity, bucket))
    places = _places(known)
    sketch = known.select("sum", F.struct("n", "b0", "b1", "b2", "b3").alias("s"))

    def sketched(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sketch.select(F.col("sum").alias("a"), F.col("s").alias("x")), "a").join(sketch.select(F.col("sum").alias("b"), F.col("s").alias("y")), "b")
        return both.where(_may_be_alike(similarity)).select("a", "b")

    sums = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    coarse = fingerprints(docs.select("id", "text", sums.alias("sum")), "text", 1).groupBy("sum").agg(F.first("fp").alias("fp"), F.min("id").alias("least"))
    coarse = spill(coarse, "coarse")
    leaders = coarse.groupBy("fp").agg(F.min(F.struct("least", "sum")).alias("r"))
    own = coarse.join(leaders, "fp").select(F.col("sum").alias("a"), F.col("r.sum").alias("b")).where("a <> b")
    found = _alike(sketched(own.union(places.select(F.col("sum").alias("a"), F.col("first").alias("b")).where("a <> b")).distinct()), known, docs, words, similarity)
    label = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = places.join(label, places["sum"] == label.node, "left").select("place", "size", "sum", F.coalesce("label", "sum").alias("label"))
    parts = named.groupBy("place", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = parts.groupBy("place").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1")
    rows = spill(named.join(mixed, "place").join(sketch, "sum").select("place", "sum", "label", "main", "s", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "mixed")
    found = found.unionByName(_alike(_within_places(rows, similarity), known, docs, words, similarity))
    return known.select("sum", "least"), found.select(F.col("a").alias("u"), F.col("b").alias("v"))


def simhash_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`df` with one document of each near-duplicate group: that of the least id. See `near_links`.

    Groups are the components of links between texts of at least `similarity`. Rows with a null id stay; repeated ids
    stay or go together; null texts are empty, and texts without words are alike.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    texts, linked = near_links(docs, words, similarity)
    label = components(spill(linked, "near"))
    both = texts.join(label, texts["sum"] == label.node, "left").select("sum", "least", F.coalesce("label", "sum").alias("label"))
    of = both.groupBy("label").agg(F.min("least").alias("kept"))
    kept = spill(both.join(of, "label").select("sum", "kept"), "kept")
    sums = docs.select("id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sum"))
    gone = fresh(df, "_gone")
    drop = spill(sums.join(kept, "sum").where("kept < id").select(F.col("id").alias(gone)).distinct(), "copies")
    return df.join(drop, F.col(id).cast("long") == F.col(gone), "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
