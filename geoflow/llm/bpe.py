"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.llm.common import documents, fresh, in_arrow

#: Pre-tokenization of byte-level BPE (fixed value), with white space written out.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NONE = np.int64(1) << 62
#: Words of up to so many symbols go through the trees side by side.
SHORT = 64
#: Bytes of distinct pieces and their ids that a task remembers, bytes that each takes besides, and symbols in one array of trees.
MEMO, BESIDES, AT_ONCE = 32 << 20, 300, 1 << 20


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Symbols, pair ranks and token bytes of a byte-level `tokenizers` file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"]
        if said["model"]["type"] != "BPE" or said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        stand, vocab = _byte_of(), said["model"]["vocab"]
        special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        if any(" " in x or not x for x in special):
            raise ValueError("added tokens with spaces are not supported")
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(stand[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        self.symbol = np.zeros(256, "int64")
        for c, b in stand.items():
            self.symbol[b] = vocab[c]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"])]
        keys = np.array([a << 32 | b for a, b, _ in pairs], "int64")
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype("int64"), np.array([c for *_, c in pairs], "int64")
        self.lengths = np.array([len(t) for t in tokens], "int64")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), "uint8")
        self.words = regex.compile(PATTERN)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they do not merge, or one is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def side_by_side(self, words: list[bytes]) -> list[np.ndarray]:
        """Merge words of up to SHORT bytes, all in step: one segment tree a word, as rows of one array."""
        n, size = len(words), np.array([len(w) for w in words])
        leaves = 1 << max(1, int(size.max() - 1).bit_length())
        symbols = np.full((n, leaves + 1), -1, "int64")
        inside = np.arange(leaves + 1) < size[:, None]
        symbols[inside] = self.symbol[np.frombuffer(b"".join(words), "uint8")]
        after, before = np.tile(np.arange(1, leaves + 2), (n, 1)), np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), NONE)
        rank = self.rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, leaves:] = np.where(rank < NONE, rank * leaves + np.arange(leaves), NONE)
        width = leaves
        while width > 1:  # build the inner nodes, level by level
            width //= 2
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])

        def update(rows, at, rank):
            node = at + leaves
            tree[rows, node] = np.where(rank < NONE, rank * leaves + at, NONE)
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % leaves, root // leaves
            gone = after[rows, at]
            symbols[rows, at] = self.merged[rank]
            symbols[rows, gone] = -1
            then = after[rows, gone]
            after[rows, at] = then
            inner = then <= leaves
            before[rows[inner], then[inner]] = at[inner]
            right = np.where(inner, symbols[rows, np.minimum(then, leaves)], -1)
            hole = np.minimum(gone, leaves - 1)  # the last symbol begins no pair
            real = gone < leaves
            if real.any():
                update(rows[real], hole[real], np.full(real.sum(), NONE))
            update(rows, at, self.rank(symbols[rows, at], right))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                update(rows[has], left[has], self.rank(symbols[rows[has], left[has]], symbols[rows[has], at[has]]))
            rows = rows[tree[rows, 1] < NONE]
        return np.split(symbols[symbols >= 0], np.cumsum((symbols >= 0).sum(1))[:-1])

    def alone(self, word: bytes) -> np.ndarray:
        """Merge one long word; the same tree in a list."""
        symbols = self.symbol[np.frombuffer(word, "uint8")]
        first = self.rank(symbols[:-1], symbols[1:])
        table = self._table()
        n = len(symbols)
        leaves = 1 << (n - 1).bit_length()
        none = int(NONE)
        tree = [none] * (2 * leaves)
        tree[leaves : leaves + n - 1] = [r * leaves + i if r < none else none for i, r in enumerate(first.tolist())]
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        symbols, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def update(at, rank):
            node = at + leaves
            tree[node] = none if rank is None else rank * leaves + at
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            symbols[at], symbols[gone] = int(self.merged[rank]), -1
            after[at] = then = after[gone]
            if then < n:
                before[then] = at
            update(gone, None)
            update(at, table.get((symbols[at], symbols[then])) if then < n else None)
            if before[at] >= 0:
                update(before[at], table.get((symbols[before[at]], symbols[at])))
        return np.array([s for s in symbols if s >= 0], "int64")

    @lru_cache(1)  # noqa: B019
    def _table(self) -> dict:
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct pre-tokens."""
        data = [w.encode() for w in words]
        out: list = [None] * len(data)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(data):
            if len(w) < 2:
                out[i] = self.symbol[np.frombuffer(w, "uint8")]
            elif len(w) > SHORT:
                out[i] = self.alone(w)
            else:
                by.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for bits, them in by.items():
            step = max(1, AT_ONCE >> (bits + 2))
            for k in range(0, len(them), step):
                part = them[k : k + step]
                for i, ids in zip(part, self.side_by_side([data[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of `ids`, gathered from the token bytes."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - (ends - size), size)
        return self.pool[at].tobytes()


class Encoder:
    """Ids of whole texts: distinct pieces once, distinct pre-tokens of new pieces once."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.pieces: dict[str, np.ndarray] = {}
        self.held = 0

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        v, new = self.v, []
        for p in pieces:
            parts = v.cut.split(p) if v.cut is not None else [p]
            new.append([x for i, part in enumerate(parts) for x in ([part] if i % 2 else v.words.findall(part))] if len(parts) > 1 else v.words.findall(p))
        distinct = list(dict.fromkeys(w for ws in new for w in ws if w not in v.special))
        ids = dict(zip(distinct, v.encode_words(distinct), strict=True)) | {w: np.array([i]) for w, i in v.special.items()}
        return [ids[ws[0]] if len(ws) == 1 else np.concatenate([ids[w] for w in ws]) if ws else np.zeros(0, "int64") for ws in new]

    def texts(self, texts) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow array."""
        from geoflow.llm.pieces import flat

        pieces, counts = flat(texts)
        coded = pieces.dictionary_encode()
        distinct, memo = coded.dictionary.to_pylist(), self.pieces
        new = [p for p in distinct if p not in memo]
        found = dict(zip(new, self.encode_pieces(new), strict=True))
        each = [memo[p] if p in memo else found[p] for p in distinct]
        for p, x in found.items():  # frequent pieces come early
            if self.held >= MEMO:
                break
            if len(p) < 64:
                memo[p] = x.astype("int32")
                self.held += BESIDES + len(p) + x.size * 4
        size = np.array([len(x) for x in each], "int64")
        start = np.cumsum(size) - size
        pool = np.concatenate([np.zeros(0, "int64"), *each])
        which = coded.indices.to_numpy(zero_copy_only=False)
        stop = np.cumsum(counts)
        for a, b in zip(stop - counts, stop, strict=True):
            w = which[a:b]
            n = size[w]
            ends = np.cumsum(n)
            yield pool[np.arange(ends[-1] if len(w) else 0) + np.repeat(start[w] - (ends - n), n)]


def _rows_at_once(batch, column: str, most: int = 2 << 20):
    """Slices of an Arrow batch with about `most` bytes in `column`."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids: `df` without `text`, with token ids and the decoded text.

    Special strings inside texts become their special ids. Null and empty texts have no ids and decode to "". With
    `digest`, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 stand for the
    two. Rows stay as they are, repeated ones too; columns of `df` named like a result are replaced.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {"n_tokens": "long", "ids": T.ArrayType(T.IntegerType()), "decoded": "string"}
    keep = [c for c in df.columns if c != text and c not in made]
    own = fresh(df, "_text")
    df = df.select(*keep, F.col(text).cast("string").alias(own))
    schema = df.drop(own).schema
    for name, kind in made.items():
        schema = schema.add(name, kind, True)

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        encoder = Encoder(path)
        for whole in batches:
            coded = encoder.texts(whole.column(own))  # distinct words of the whole batch once; only what comes out is sliced
            for batch in _rows_at_once(whole, own):
                n, a, b = [], [], []
                for ids in islice(coded, batch.num_rows):
                    n.append(len(ids))
                    data = ids.astype("<u4")
                    back = encoder.v.decode(ids)
                    back = back.decode("utf-8", "replace")
                    a.append(sha256(data.tobytes()).hexdigest() if digest else ids.astype("int32"))
                    b.append(sha256(back.encode()).hexdigest() if digest else back)
                columns = [pa.array(n, pa.int64()), pa.array(a, pa.string() if digest else pa.list_(pa.int32())), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *made])

    return in_arrow(df, run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
