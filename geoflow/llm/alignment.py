"""Cross-tokenizer alignment: texts are cut where no token of either vocabulary can cross, distinct segments are aligned once, documents are composed of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import documents, give_back, in_arrow, partitions, spill

#: Stands for a space in the pieces of the second tokenizer.
SPACE = "▁"
#: White space that may begin a cut, if the vocabulary allows it.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of segments that one call of the tokenizers gets.
AT_ONCE = 1 << 20
#: Blocks of texts whose segments meet in one bucket.
TOGETHER = 16
#: Codes of an alignment besides token ids: after a token within a group, before B's tokens, after a group, after a segment.
SEPARATORS = [",", "|", ";", ""]

class Tokenizers:
    """Two tokenizers, the bytes of their tokens, and where texts may be cut.

    A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback that leaves texts as they
    are but for a space in front. A's pattern never joins white space to what stands before it. For B, a cut before a
    white-space character needs that no piece holds it after another character (for others than the space, not after a
    space either, since B puts one in front of a segment).
    """

    def __init__(self, path_a: str, path_b: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from geoflow.llm.bpe import _byte_of

        with open(path_a, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said["model"]["type"] != "BPE" or said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(not x["special"] for x in said.get("added_tokens", [])):
            raise ValueError(f"{path_a} is not a plain byte-level BPE")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        stand, vocab = _byte_of(), said["model"]["vocab"]
        of_a = [b""] * (max([*vocab.values(), *(x["id"] for x in said.get("added_tokens", []))]) + 1)
        for token, i in vocab.items():
            of_a[i] = bytes(stand[c] for c in token) if all(c in stand for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if sum(self.b.is_byte(i) for i in range(len(pieces))) < 256 or self.b.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError(f"{path_b} changes texts or lacks bytes")
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in of], "int64") for of in (of_a, of_b))
        self.start_a, self.start_b = (np.cumsum(x) - x for x in (self.size_a, self.size_b))
        self.pool_a, self.pool_b = (np.frombuffer(b"".join(of), "uint8") for of in (of_a, of_b))
        self.lead = self.b.piece_to_id(SPACE)
        self.as_they_are = not _charsmap(self.b.serialized_model_proto())
        self.cuts = "".join(c for c in WHITE if not any(self._joins(p, c) for p in pieces))
        inner = f"(?:[^\\S{re.escape(self.cuts)}]\\s*\\S*)*"
        self.segment = re.compile(f"\\s*\\S+{inner}|\\s+") if self.cuts else re.compile(".+", re.S)
        self.plain = " " in self.cuts and "\n" in self.cuts
        most = max(len(of_a), len(of_b))
        self.names = [*map(str, range(most)), *SEPARATORS]
        self.kind = "<u2" if len(self.names) < 1 << 16 else "<u4"

    @staticmethod
    def _joins(piece: str, c: str) -> bool:
        """Whether `piece` holds white space `c` after something that a cut would part it from."""
        piece = piece.replace(SPACE, " ")
        return any(y == c and (not x.isspace() or (x == " " and c != " ")) for x, y in zip(piece, piece[1:], strict=False))

    def fits(self, text: str) -> bool:
        """Whether B's pieces give the text again; A's always do."""
        return SPACE not in text and (self.as_they_are or self.b.normalize(text) == SPACE + text.replace(" ", SPACE))

    def segments(self, text: str) -> list[str]:
        """Segments of a text with a space in front."""
        words = text.split() if self.plain else []
        if words and " ".join(words) == text:  # lone spaces, nothing else
            return [f" {x}" for x in words]
        if words and " ".join(words) == text.replace("\n", " "):
            return [x if x[0] == "\n" else f" {x}" for x in text.replace("\n", " \n").split(" ")]
        return self.segment.findall(" " + text)

    def _ids_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments as they are, without the space that it puts in front."""
        out = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [ids if s[0] == " " and len(s) > 1 else [self.lead] if s == " " else ids[1:] for s, ids in zip(segments, out, strict=True)]

    def align(self, segments: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(codes, pairs, upto) of distinct segments: each one's groups as codes, a token and what comes after it, all links as A's id << 32 | B's id, and where each segment's end."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self._ids_b(segments)
        n_a, n_b = (np.array([len(x) for x in ids], "int64") for ids in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), "int64", int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        whole = np.frombuffer("".join(segments).encode(), "uint8")
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        for ids, ends, size, start, pool in ((a, ends_a, self.size_a, self.start_a, self.pool_a), (b, ends_b, self.size_b, self.start_b, self.pool_b)):
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - (ends - size[ids]), size[ids])
            if not np.array_equal(pool[at], whole):
                raise ValueError("tokens do not give a segment again")
        # cuts where tokens of both end; a group's tokens of A come before its tokens of B
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        group = np.concatenate([np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), group))
        comma, bar, semi, end = range(len(self.names) - 4, len(self.names))
        after = np.full(len(order), comma)
        after[last_a], after[len(a) + last_b] = bar, semi
        after = after[order]
        stop = np.cumsum(n_a + n_b)
        after[stop - 1] = end
        codes = np.column_stack([np.concatenate([a, b])[order], after]).ravel().astype(self.kind)
        upto = np.searchsorted(common, np.cumsum([len(s.encode()) for s in segments]), "right")
        return np.split(codes, 2 * stop[:-1]) if len(stop) else [], a[last_a] << 32 | b[last_b], upto

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(numbers, pairs, upto, groups) of segments one after the other: n_a, n_b and n_groups as rows, links, where each segment's end, and the groups as text."""
        bar, semi, end = range(len(self.names) - 3, len(self.names))
        tokens, after = np.frombuffer(data, self.kind).astype("int64").reshape(-1, 2).T
        stop = np.flatnonzero(after == end) + 1
        last_a, last_b = np.flatnonzero(after == bar), np.flatnonzero(after >= semi)
        of_b = np.cumsum(after == bar) - (after == bar) > np.cumsum(after >= semi) - (after >= semi)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[stop], prepend=0)
        upto = np.searchsorted(last_b, stop)
        said = list(map(self.names.__getitem__, np.column_stack([tokens, after]).ravel().tolist()))
        groups = ["".join(said[2 * x : 2 * y]) for x, y in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
        return np.stack([total(~of_b), total(of_b), np.diff(upto, prepend=0)]), tokens[last_a] << 32 | tokens[last_b], upto, groups


def _charsmap(model: bytes) -> bool:
    """Whether a sentencepiece model has rules that change characters: field 2 of its normalizer, which is field 3 of the model."""

    def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
        def number(at: int) -> tuple[int, int]:
            value = shift = 0
            while True:
                byte = data[at]
                value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
                if byte < 128:
                    return value, at

        at = 0
        while at < len(data):
            key, at = number(at)
            if key & 7 == 2:
                size, at = number(at)
                yield key >> 3, data[at : at + size]
                at += size
            else:
                at = number(at)[1] if key & 7 == 0 else at + (8 if key & 7 == 1 else 4)

    return any(inner for n, normalizer in fields(model) if n == 3 for k, inner in fields(normalizer) if k == 2)


def _packed(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(b, k, size, t): one row a block of texts, a block being a batch: their lengths, -1 where a text has no tokens, and the texts as compressed UTF-8."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        both, part = Tokenizers(path_a, path_b), TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            texts = [x.encode() if x and both.fits(x) else None for x in batch.column("t").to_pylist()]
            size = [-1 if x is None else len(x) for x in texts]
            data = pa.compress(b"".join(x for x in texts if x is not None), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), batch.column("k")), pa.array([size], pa.list_(pa.int32())), pa.array([data], pa.binary())], ["b", "k", "size", "t"])

    return in_arrow(df, run, T.StructType([T.StructField("b", T.LongType()), T.StructField("k", T.ArrayType(df.schema["k"].dataType)), T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("t", T.BinaryType())]))


def _texts(size: list[int], data: bytes) -> Iterator[str | None]:
    """The texts of a block."""
    import pyarrow as pa

    whole, at = pa.decompress(data, sum(x for x in size if x > 0), codec="zstd", asbytes=True), 0
    for x in size:
        yield None if x < 0 else whole[at : at + x].decode()
        at += max(0, x)


def _bucket(segment: str, buckets: int) -> int:
    from zlib import crc32

    return crc32(segment.encode()) % buckets


def _words(blocks: DataFrame, path_a: str, path_b: str, buckets: int) -> DataFrame:
    """(bucket, b, s, n): the distinct segments of each block by buckets, in the order of their first place, and how often they occur."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        both = Tokenizers(path_a, path_b)
        for batch in batches:
            for b, size, data in zip(batch.column("b").to_pylist(), batch.column("size").to_pylist(), batch.column("t").to_pylist(), strict=True):
                count: Counter = Counter()
                for text in _texts(size, data):
                    if text is not None:
                        count.update(both.segments(text))
                by: dict[int, list[str]] = {}
                for s in count:
                    by.setdefault(_bucket(s, buckets), []).append(s)
                if by:
                    yield pa.RecordBatch.from_arrays([pa.array(by, pa.int32()), pa.array([b] * len(by), pa.int64()), pa.array(by.values(), pa.list_(pa.string())), pa.array([[count[s] for s in ss] for ss in by.values()], pa.list_(pa.int64()))], ["bucket", "b", "s", "n"])

    return in_arrow(blocks.select("b", "size", "t"), run, "bucket int, b long, s array<string>, n array<long>")


def _aligned(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(b, bucket, codes, pair, count): the alignments of each block's segments in a bucket, one after the other and
    compressed; and a row a bucket with its id pairs and their counts."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        both = _cached(path_a, path_b)
        table = table.combine_chunks()
        coded = pc.list_flatten(table.column("s")).combine_chunks().dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        times = np.bincount(which, weights=pc.list_flatten(table.column("n")).to_numpy(), minlength=len(distinct)).astype("int64")
        codes, pairs, counts, at = [], [np.zeros(0, "int64")], [np.zeros(0, "int64")], 0
        while at < len(distinct):
            to, size = at, 0
            while to < len(distinct) and size < AT_ONCE:
                size += len(distinct[to])
                to += 1
            some, linked, upto = both.align(distinct[at:to])
            codes += some
            pairs.append(linked)
            counts.append(np.repeat(times[at:to], np.diff(upto, prepend=0)))
            at = to
        pair, of = np.unique(np.concatenate(pairs), return_inverse=True)
        count = np.bincount(of, weights=np.concatenate(counts), minlength=len(pair)).astype("int64")
        bucket = table.column("bucket")[0].as_py()
        codes_size = np.array([x.nbytes for x in codes], "int64")
        stop = np.cumsum(pc.list_value_length(table.column("s")).to_numpy())
        packed = [pa.compress(b"".join([codes[i].tobytes() for i in which[x:y].tolist()]), codec="zstd", asbytes=True) for x, y in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
        size = [int(codes_size[which[x:y]].sum()) for x, y in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
        none, longs = pa.nulls(table.num_rows, pa.list_(pa.int64())), pa.list_(pa.int64())
        out = pa.table({"b": pa.chunked_array([table.column("b").combine_chunks(), pa.nulls(1, pa.int64())]), "bucket": pa.array([bucket] * (table.num_rows + 1), pa.int32()), "size": pa.array([*size, None], pa.int64()), "codes": pa.array([*packed, None], pa.binary())} | {n: pa.chunked_array([none, pa.array([x], longs)]) for n, x in (("pair", pair), ("count", count))})
        give_back()
        return out

    return words.groupBy("bucket").applyInArrow(run, "b long, bucket int, size long, codes binary, pair array<long>, count array<long>")


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False) -> DataFrame:
    """`df` less `text`, with n_a, n_b, n_groups, n_links, n_best, count_sum and the groups of each text.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are plain
    text. Groups are `a1,a2|b1` joined by `;`, or, with `digest`, their SHA-256. A link is a pair of tokens that end
    together, one a group; an id pair's count is its links over all of `df`; n_best counts links whose pair is the most
    frequent of its B id, ties included. Null and empty texts, and those that B's pieces do not give again, have zeros
    and an empty string. Texts go whole, of any length; a text without white space is one segment. Repeated rows stay and
    count each; an empty table gives no row; columns named like a result are replaced.

    Texts are written by blocks of a batch. Each block's distinct segments go to buckets by their hash, so that a frequent
    one comes once a block; a bucket aligns each distinct segment once and sends every block its part back. Of two tokens
    that end together one is the end of the other, so there are no more id pairs than bytes in both vocabularies: their
    counts fit the tasks that compose the blocks.
    """
    last = "groups_sha256" if digest else "groups"
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last]
    keep = [c for c in df.columns if c != text and c not in made]
    packed = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(1).alias("one"))
    blocks = spill(_packed(df.select(packed.alias("k"), F.col(text).cast("string").alias("t")), path_a, path_b), "blocks")
    buckets = max(partitions(df.sparkSession), blocks.count() // TOGETHER)
    found = spill(_aligned(_words(blocks, path_a, path_b, buckets), path_a, path_b), "aligned")
    links = found.where("b IS NULL").select(F.explode(F.arrays_zip("pair", "count")).alias("x")).groupBy("x.pair").agg(F.sum("x.count").alias("count"))
    links = links.toPandas().sort_values("pair")  # bounded by the vocabularies, see above
    pair, count = links["pair"].to_numpy("int64"), links["count"].to_numpy("int64")
    to = pair & 0xFFFFFFFF
    most = np.zeros(int(to.max(initial=0)) + 1, "int64")
    np.maximum.at(most, to, count)
    best = count == most[to]

    schema = T.StructType([T.StructField("k", blocks.schema["k"].dataType.elementType), *(T.StructField(n, T.LongType()) for n in made[:-1]), T.StructField(last, T.StringType())])

    def compose(left, right):
        from hashlib import sha256

        import pyarrow as pa

        both = _cached(path_a, path_b)
        tables = []
        for row in range(left.num_rows):  # one a block
            # segments by their first place, and the texts as places
            first: dict[str, int] = {}
            texts = [None if x is None else np.array([first.setdefault(s, len(first)) for s in both.segments(x)], "int64") for x in _texts(left.column("size")[row].as_py(), left.column("t")[row].as_py())]
            by: dict[int, list[int]] = {}
            for s, i in first.items():
                by.setdefault(_bucket(s, buckets), []).append(i)
            order = [i for b in right.column("bucket").to_pylist() for i in by[b]]
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            first.clear()
            numbers, linked, upto, groups = both.read(b"".join(pa.decompress(c.as_py(), n.as_py(), codec="zstd", asbytes=True) for c, n in zip(right.column("codes"), right.column("size"), strict=True)))
            where = np.searchsorted(pair, linked)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[where])])[upto], prepend=0) for x in (best.astype("int64"), count)] if len(linked) else [upto, upto]
            numbers = np.stack([*numbers, numbers[2], *sums])
            out, said = np.zeros((len(numbers), len(texts)), "int64"), [""] * len(texts)
            for i, x in enumerate(texts):
                if x is not None:
                    which = place[x]
                    out[:, i] = numbers[:, which].sum(1)
                    joined = ";".join(map(groups.__getitem__, which.tolist()))
                    said[i] = sha256(joined.encode()).hexdigest() if digest else joined
            tables.append(pa.Table.from_arrays([left.column("k")[row].values, *(pa.array(x, pa.int64()) for x in out), pa.array(said, pa.string())], ["k", *made]))
        del numbers, groups, texts
        give_back()
        return pa.concat_tables(tables)

    out = blocks.groupBy("b").cogroup(found.where("b IS NOT NULL").select("b", "bucket", "size", "codes").groupBy("b")).applyInArrow(compose, schema)
    return out.select(*(["k.*"] if keep else []), *made)


_CACHE: dict = {}


def _cached(path_a: str, path_b: str) -> Tokenizers:
    """One pair of tokenizers a worker."""
    if (path_a, path_b) not in _CACHE:
        _CACHE.clear()
        _CACHE[path_a, path_b] = Tokenizers(path_a, path_b)
    return _CACHE[path_a, path_b]


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
