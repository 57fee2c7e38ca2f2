"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest

from geoflow.llm import alignment
from geoflow.llm.bpe import _byte_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """A function: results of whole texts, without segments."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, stand = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_of()
    a.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    byte = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def one(text):
        if not text:
            return [], [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_x, bytes_y = [bytes(stand[c] for c in names[i]) for i in x], [byte(i) for i in y]
        if not b"".join(bytes_x) == b"".join(bytes_y) == (" " + text).encode():
            return [], [], []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 300 else running(parts)
        return x, y, (ends(bytes_x), ends(bytes_y))

    def running(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    def results(texts):
        links, each = Counter(), []
        for text in texts:
            x, y, ends = one(text)
            groups, mine, i, j = [], [], 0, 0
            if x:
                at_x, at_y = ({e: k for k, e in enumerate(es)} for es in ends)
                for e in sorted(at_x.keys() & at_y.keys()):
                    groups.append(",".join(map(str, x[i : at_x[e] + 1])) + "|" + ",".join(map(str, y[j : at_y[e] + 1])))
                    mine.append((x[at_x[e]], y[at_y[e]]))
                    i, j = at_x[e] + 1, at_y[e] + 1
            links.update(mine)
            each.append((len(x), len(y), groups, mine))
        most = Counter()
        for (_, y), n in links.items():
            most[y] = max(most[y], n)
        return [(nx, ny, len(g), len(m), sum(links[p] == most[p[1]] for p in m), sum(links[p] for p in m), hashlib.sha256(";".join(g).encode()).hexdigest() if nx else "") for nx, ny, g, m in each]

    return results


def odd_texts():
    rng = random.Random(5)
    parts = ["the", "it's", "’s", "é", "日本語", "\U0001f600", "▁", "<s>", "</s>", "<0x41>", "<|endoftext|>", "'re", "123", "x;", "{", "});", "\r", "\r\n", "\n\n", "  ", "\t", " ", "\xa0", "　", "\x1c", "\x85", "ü" * 3, "a" * 40, "!!!", " \r", "\n ", "\v", "\x00", "é", "ﬁ"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    return [None, "", " ", "  ", "\n", " \n ", "one", "x" * 20000, "word " * 5000, "a▁b", "x ▁ y", *out, *out[:5]]


def test_alignment_of_the_documents(spark, sf, plain):
    got = {r["doc_id"]: tuple(r[c] for c in MADE) for r in alignment.op13_alignment(spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == dict(zip([i for i, _ in rows], plain([t for _, t in rows]), strict=True))


def test_alignment_of_odd_texts(spark, plain):
    texts = odd_texts()
    rows = [(i, t, "k", "b", 1, None) for i, t in enumerate(texts)] + [(None, "null id", "k", "b", 1, None)]
    df = spark.createDataFrame(rows, "id long, text string, k string, b string, n_a int, s string").repartition(5)
    got = alignment.align(df, A, B, digest=True)
    assert got.columns == ["id", "k", "b", "s", *MADE]
    want = plain([*texts, "null id"])
    assert {r["id"]: tuple(r[c] for c in MADE) for r in got.collect()} == dict(zip([*range(len(texts)), None], want, strict=True))
    assert sum(w[0] == 0 for w in want) < 150


def test_groups_and_empty_tables(spark):
    one = alignment.align(spark.createDataFrame([("Hello world",)], "text string"), A, B).collect()
    assert len(one) == 1 and one[0]["groups"].count("|") == one[0]["n_groups"] == one[0]["n_links"] == one[0]["n_best"] == one[0]["count_sum"]
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_where_texts_may_be_cut():
    both = alignment.Tokenizers(A, B)
    assert " " in both.cuts and "\n" in both.cuts and "\r" not in both.cuts
    for text in odd_texts():
        assert "".join(both.segments(text or "")) == " " + (text or "")
    assert both.segments("a  b\r\nc\n") == [" a", "  b\r\nc", "\n"]
