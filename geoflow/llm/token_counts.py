"""Token counts of whole texts with public tokenizers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import documents, fresh, in_arrow

#: Bytes of text that one call of the tokenizer gets.
BATCH_BYTES = 1 << 20
#: Bytes of distinct pieces that a task remembers the length of, and bytes that each takes besides.
MEMO, BESIDES = 32 << 20, 180


class _Counter:
    """Lengths by a tokenizer file: `.json` (tokenizers) or `.model` (sentencepiece)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.piecewise, self.memo, self.held = False, {}, 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import json

            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            pre = said.get("pre_tokenizer") or {}
            # only here is a space between two non-spaces a safe boundary
            self.piecewise = said.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in said.get("added_tokens", []))
            self.many = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def balanced(self, texts: list[str]) -> list[int]:
        """Lengths of `texts`, asked for in batches of about BATCH_BYTES."""
        out, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text) if text.isascii() else len(text.encode())
            if size >= BATCH_BYTES:
                out += self.many(texts[start : i + 1])
                start, size = i + 1, 0
        return out + self.many(texts[start:]) if start < len(texts) else out

    def lengths(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from geoflow.llm.pieces import flat

        if not self.piecewise:
            return np.array(self.balanced(pc.fill_null(texts, "").to_pylist()), "int64")
        pieces, counts = flat(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        memo = self.memo
        new = [x for x in distinct if x not in memo]
        found = dict(zip(new, self.balanced(new), strict=True))
        each = np.array([memo[x] if x in memo else found[x] for x in distinct], "int64")
        for x, n in found.items():  # frequent pieces come early
            if self.held >= MEMO:
                break
            if len(x) < 64:
                memo[x] = n
                self.held += BESIDES + len(x)
        ends = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])]) if len(distinct) else np.zeros(1, "int64")
        stop = np.cumsum(counts)
        return ends[stop] - ends[stop - counts]


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """`df` without `text`, with n_bytes, n_tokens and over_limit of each whole text.

    Only lengths leave the Arrow function. Texts are cut at boundaries that no pre-token crosses, and the pieces are
    encoded in batches of equal bytes, each distinct one once; where a tokenizer has no such boundary, texts stay
    whole. Null or empty texts have 0 tokens; repeated rows are counted each; an empty table gives no row. Columns of
    `df` named like a result are replaced.
    """
    keep = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    own = fresh(df, "_text")
    df = df.select(*keep, F.col(text).cast("string").alias(own))
    schema = df.drop(own).schema.add("n_bytes", "long", True).add("n_tokens", "long", True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = _Counter(path)
        for batch in batches:
            texts = batch.column(own)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = counter.lengths(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), size, pa.array(n, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    return in_arrow(df, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
