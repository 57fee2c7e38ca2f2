"""Line dedup: documents that share lines are aligned, and common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import documents, fresh, in_arrow, spill


def _numbered(lines: list, first: int) -> dict[tuple, int]:
    """The place of each line that is not blank, by the line and how often it came before."""
    seen, at = defaultdict(int), {}
    for k, x in enumerate(lines, first):
        if x is not None:
            at[x, seen[x]] = k
            seen[x] += 1
    return at


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), in order: equal ends first, then lines unique in both, then between them.

    Where no line is unique in both, the n-th occurrences of a line are matched; so no line that is not blank is left in
    both of two facing regions.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        at = {x: k for k, x in enumerate(a[i:m], i) if in_a[x] == 1}
        pairs = [(at[x], k) for k, x in enumerate(b[j:n], j) if in_b[x] == 1 and x in at]
        if all(a[p] is None for p, _ in pairs) and not in_a.keys().isdisjoint(in_b.keys() - {None}):
            at = _numbered(a[i:m], i)
            pairs = [(at[x], k) for x, k in _numbered(b[j:n], j).items() if x in at]
        # the longest increasing run of places in a
        tops, piles, back = [], [], []
        for k, (p, _) in enumerate(pairs):
            x = bisect_left(tops, p)
            back.append(piles[x - 1] if x else -1)
            tops[x : x + 1], piles[x : x + 1] = [p], [k]
        chain, k = [], piles[-1] if piles else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        if chain:
            out += chain
            ends = [(i - 1, j - 1), *chain, (m, n)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def common_lines(a: list[int | None], b: list[int | None]) -> list[int]:
    """Places in `b` of the aligned blocks that hold a line of text, and of the lines of `a` outside of them; None stands for a blank line."""
    gone, block, last = [], [], (-2, -2)
    for p, q in [*patience(a, b), (-9, -9)]:
        if (p, q) != (last[0] + 1, last[1] + 1):
            if any(b[x] is not None for x in block):
                gone += block
            block = []
        block.append(q)
        last = (p, q)
    # lines that moved, and further repeats of a line, align by themselves
    known, taken = set(a) - {None}, set(gone)
    return gone + [q for q, x in enumerate(b) if x in known and q not in taken]


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(id, sum, gone, partners): places of the lines that each text of `docs` (id, sum, text) has from earlier ones.

    Order: id (null last), then the hash of the text. Every shared line leads to the earliest document that has it; so
    each is in some partner, and a text has at most as many partners as lines, whatever the size of a group of copies.
    """
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    lined = spill(docs.select("id", "sum", F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("sum").alias("sum")).alias("doc"), trimmed.alias("lines")).dropDuplicates(["id", "sum"]), "lines")
    rows = lined.select("doc", F.posexplode("lines").alias("pos", "h")).where("h IS NOT NULL")
    # a table of its own, so that the join stands alone and adaptive execution can split a line of very many documents
    kinds = spill(rows.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first"), "shared")
    shared = rows.join(kinds, "h").where(F.col("doc") > F.col("first"))
    pairs = spill(shared.select("doc", "first").distinct(), "pairs")
    both = pairs.join(lined.select(F.col("doc").alias("first"), F.col("lines").alias("a")), "first").join(lined.select("doc", F.col("lines").alias("b")), "doc")
    both = both.select("doc.id", "doc.sum", F.col("first.id").alias("partner"), "a", "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gone = [common_lines(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sum"), batch.column("partner"), pa.array(gone, pa.list_(pa.int32()))], ["id", "sum", "partner", "gone"])

    aligned = in_arrow(both, run, "id long, sum long, partner long, gone array<int>").where(F.size("gone") > 0)
    return aligned.groupBy("id", "sum").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.array_sort(F.collect_set("partner")).alias("partners"))


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with `text` less the blocks of lines that an earlier document has, and n_lines, n_deleted and partners.

    Lines are compared without the white space around them; blank lines go only within a block. Null texts stay null,
    empty ones empty. Rows alike in id and text are one document: neither is the later. Columns of `df` named like a
    result are replaced.
    """
    keep = [c for c in df.columns if c not in ("n_lines", "n_deleted", "partners")]
    df = df.select(*keep)
    docs = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("sum", F.xxhash64("text"))
    own = fresh(df, "_found")
    found = spill(duplicate_lines(docs.select("id", "sum", "text")), "gone").select(F.struct("id", "sum", "gone", "partners").alias(own))
    rows = df.join(found, F.col(id).cast("long").eqNullSafe(F.col(f"{own}.id")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col(f"{own}.sum")), "left")
    lines = F.split(F.col(text), "\n")
    gone = F.col(f"{own}.gone")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.select(
        *(F.when(gone.isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in keep),
        F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.col(f"{own}.partners"), F.array().cast("array<bigint>")).alias("partners"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "partners", F.sha2("text", 256).alias("kept_sha256"), "text")
