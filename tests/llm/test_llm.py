"""The training-data operators against brute force, libraries and hand-made cases."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from geoflow.llm import bpe, html, licenses, lines, quality, queries, rindex, simhash, sketch, templates, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sum string, fp string, label string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t ", "one", "Ünïcode \U0001f600 text", "a b c d e f", "a b c d e f", "x" * 5000, "word " * 3000, "line\n\nline\nother", "<|endoftext|> it's  two   spaces 123"]


def docs(spark, texts, first=1):
    """Documents with clashing extra columns; the last row has a null id, the first comes twice."""
    rows = [(i, t, None, "s", None, "x", "y", None) for i, t in enumerate(texts, first)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id text", None, None, None, None, None, None)], DOCS) if rows else spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_and_counts_equal_the_library(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r for r in bpe.op5_bpe(spark, sf).collect()}
    n = {r["doc_id"]: r for r in token_counts.op10_token_counts(spark, sf).collect()}
    assert got.keys() == n.keys() == texts.keys()
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False).encode()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back))
        assert (n[i]["n_bytes"], n[i]["n_tokens"], n[i]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 512)


def test_bpe_and_counts_odd_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    df = docs(spark, ODD)
    for row in bpe.bpe_round_trip(df, PATH).where("doc_id IS NOT NULL").collect():
        want = t.encode(ODD[row["doc_id"] - 1] or "", add_special_tokens=False).ids
        assert row["ids"] == want and row["decoded"] == t.decode(want, skip_special_tokens=False)
    counts = token_counts.token_counts(df, PATH)
    assert counts.count() == len(ODD) + 2
    assert all(r["n_tokens"] == len(t.encode(ODD[r["doc_id"] - 1] or "", add_special_tokens=False).ids) for r in counts.where("doc_id IS NOT NULL").collect())
    model = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["n_tokens"] == len(p.encode(ODD[r["doc_id"] - 1] or "")) for r in model.where("doc_id IS NOT NULL").collect())


def _repeats(texts, window):
    """Brute force: kept bytes and runs of each text."""
    seen = {}
    for k, data in enumerate(texts):
        for i in range(len(data) - window + 1):
            seen.setdefault(data[i : i + window], []).append((k, i))
    gone = [np.zeros(len(x), bool) for x in texts]
    for places in seen.values():
        for k, i in places if len(places) > 1 else []:
            gone[k][i : i + window] = True
    return [(int(g.sum()), int((np.diff(np.concatenate([[0], g.view("int8")])) == 1).sum()), bytes(np.frombuffer(x, "uint8")[~g])) for g, x in zip(gone, texts, strict=True)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_repeats_equal_brute_force(spark, block):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared, twice = word(90), word(40)
    texts = [word(50) + shared + word(30), shared[:60] + word(20) + shared[30:], twice + word(9) + twice, "z" * 100, word(30), "", shared, "ab" * 60, *ODD[3:]]
    df = docs(spark, texts)
    rows = [*texts, texts[0], "null id text"]
    want = _repeats([x.encode() for x in rows], 20)
    got = rindex.remove_repeats(df, window=20, block=block).collect()
    assert len(got) == len(rows)
    by = {i: w for i, w in enumerate(want[:-2], 1)}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == by[r["doc_id"]]


def test_repeats_over_a_table(spark, sf, texts):
    got = {r["doc_id"]: r for r in rindex.op4_suffix_dedup(spark, sf).collect()}
    ids = sorted(texts)
    for i, (gone, spans, kept) in zip(ids, _repeats([texts[i].encode() for i in ids], 200), strict=True):
        assert (got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (gone, spans, sha(kept))


def _fp(text, words=3):
    w = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    w = [x for x in w if x]
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r for r in simhash.op7_simhash(spark, sf).collect()}
    fps = {i: _fp(t) for i, t in texts.items()}
    assert {i: f"{x:016x}" for i, x in fps.items()} == {i: r["fingerprint"] for i, r in got.items()}
    of = {i: i for i in fps}
    for _ in range(10):
        of = {i: min(of[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}
    assert of == {i: r["component_id"] for i, r in got.items()}


def test_ring_finds_every_link(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(90)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, bucket=8).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800)]
    own = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(6)]
    copy = [*own[0][:150], "changed", *own[0][151:]]
    rows = [" ".join(w) for w in own] + [" ".join(copy), " ".join(own[1]), None, " "]
    left = sorted(r["doc_id"] for r in simhash.simhash_dedup(docs(spark, rows)).where("doc_id IS NOT NULL").distinct().collect())
    assert left == [1, 2, 3, 4, 5, 6, 9]
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_texts_unlike_their_leader_meet(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(120)]
    shuffled = [rng.sample(words, len(words)) for _ in range(4)]  # the same words, so the same coarse fingerprint
    near = [[*w[:60], "other", *w[61:]] for w in shuffled[1:]]
    rows = [" ".join(w) for w in shuffled + near]
    known, linked = simhash.near_links(docs(spark, rows).selectExpr("doc_id AS id", "text"))
    of = {r["sum"]: r["least"] for r in known.collect()}
    assert {tuple(sorted((of[r["u"]], of[r["v"]]))) for r in linked.collect()} == {(2, 5), (3, 6), (4, 7)}


def test_cost_of_a_prefix_does_not_follow_the_common_shingles():
    rng = np.random.default_rng(5)
    common = np.unique(rng.integers(0, 1 << 64, simhash.LATE, "uint64"))
    texts = [np.unique(np.concatenate([rng.integers(0, 1 << 64, 400, "uint64"), rng.choice(common, n)])) for n in (0, 1, 20, 300)]
    few = np.unique(np.concatenate([common[:50], texts[2][:50]]))
    for h in [*texts, common[:7], common[-7:], texts[0][:1], texts[0][:0]]:
        for known in (common, few):
            last = np.isin(h, known)
            want = np.concatenate([h[~last], h[last]])[: len(h) - -(-len(h) * 4 // 5) + 1]
            assert simhash._prefix(h, known, 0.8) == (want.view("int64").tolist() if len(h) else [0])

    def seconds(known):
        began = time.perf_counter()
        for h in texts * 10:
            simhash._prefix(h, known, 0.8)
        return time.perf_counter() - began

    assert min(seconds(common) for _ in range(3)) < 20 * min(seconds(few) for _ in range(3))


def test_the_pair_test_is_short_enough_to_be_compiled(spark, tmp_path, capsys):
    rng = random.Random(17)
    base = [rng.getrandbits(256) for _ in range(3)]
    texts = []
    for k in range(60):
        bits = base[k % 3]
        for _ in range(rng.randint(0, 40)):
            bits ^= 1 << rng.randrange(256)
        texts.append((k % 2, k, k // 2, 1, (rng.randint(80, 125), *(int.from_bytes(bits.to_bytes(32)[i : i + 8], signed=True) for i in range(0, 32, 8))), 2))
    schema = "place long, sum long, label long, main long, s struct<n: int, b0: long, b1: long, b2: long, b3: long>, blocks int"
    spark.createDataFrame(texts, schema).write.parquet(f"{tmp_path}/mixed")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = simhash._within_places(spark.read.parquet(f"{tmp_path}/mixed"), 0.8)
        got = sorted((r["a"], r["b"]) for r in met.collect())
        met.distinct().explain("codegen")
        sizes = [int(x.split(";")[0]) for x in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    far = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[1:], y[1:], strict=True))
    alike = lambda x, y: min(x[0], y[0]) >= 0.8 * max(x[0], y[0]) - 1e-6 and far(x, y) <= (x[0] + y[0]) / 9 + 1e-6
    met = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if a[0] == b[0] and a[2] != b[2] and alike(a[4], b[4])]
    assert got == sorted((a[1], b[1]) for a, b in met) and got
    assert sizes and max(sizes) < 8000


def test_near_copies_against_all_pairs(spark, documents, texts):
    sets = {i: frozenset(map(int, simhash.shingle_hashes(t, 5))) for i, t in texts.items()}
    of = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in pairs:
            of[i] = of[j] = min(of[i], of[j])
    want, got = {i for i in of if of[i] == i}, {r["doc_id"] for r in simhash.simhash_dedup(documents).collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(sets) - len(want))


def _kept(spark, rows):
    return sorted(r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")).collect())


def test_near_copies_of_a_text_that_is_alike_to_its_leader(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    swapped = lambda w, *at: [w[i + 1] if i in at else w[i - 1] if i - 1 in at else x for i, x in enumerate(w)]
    a = swapped(words, 30, 60, 90, 120)  # the same words, so one coarse fingerprint
    c = swapped(a, 150, 180, 210, 240)
    sets = [set(map(int, simhash.shingle_hashes(" ".join(w), 5))) for w in (words, a, c)]
    alike = lambda x, y: len(x & y) / len(x | y)
    assert alike(sets[0], sets[1]) >= 0.8 and alike(sets[1], sets[2]) >= 0.8 > alike(sets[0], sets[2])
    assert _kept(spark, [" ".join(w) for w in (words, a, c)]) == [1]


@pytest.mark.parametrize("length", [10, 20, 30, 50])
def test_short_near_copies_go(spark, length):
    rng = random.Random(length)
    rows = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(length + 1)]
        rows += [" ".join(words[:length]), " ".join(words)]  # one word more
    assert _kept(spark, rows) == list(range(1, len(rows), 2))


def test_places_of_many_blocks(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80)]
    rows = []
    for _ in range(60):
        at = set(rng.sample(range(80), rng.randint(1, 4)))
        rows.append(" ".join(f"{x}{rng.random()}" if i in at else x for i, x in enumerate(words)))
    sets = [set(map(int, simhash.shingle_hashes(t, 5))) for t in rows]
    pairs = [(i, j) for i in range(60) for j in range(60) if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    of = list(range(60))
    for _ in range(60):
        for i, j in pairs:
            of[i] = of[j] = min(of[i], of[j])
    known, linked = simhash.near_links(spark.createDataFrame(list(enumerate(rows)), "id long, text string"), bucket=8, block=7)
    least = {r["sum"]: r["least"] for r in known.collect()}
    links = [(least[r["u"]], least[r["v"]]) for r in linked.collect()]
    got = list(range(60))
    for _ in range(60):
        for i, j in links:
            got[i] = got[j] = min(got[i], got[j])
    assert got == of and {tuple(sorted(x)) for x in links} <= set(pairs)


def test_fingerprints(spark, sf, texts, documents):
    got = {r["doc_id"]: r for r in sketch.op6_fingerprints(spark, sf).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b = texts[i], texts[j]
        cut = len(a) // 4
        edited = a[: len(a) - cut] + b[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), sha(edited.encode()))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(sketch.Sketch.of(a)), str(sketch.Sketch.of(edited)))
        assert r["near_next"] == pytest.approx(sketch.Sketch.of(a).resemblance(sketch.Sketch.of(b)))
    assert sketch.edited_fingerprints(docs(spark, ODD)).count() == len(ODD) + 2
    assert sketch.edited_fingerprints(docs(spark, [])).count() == 0
    of = sketch.merged(documents.join(sketch.fingerprint(documents.select("doc_id", "text")), "doc_id"), "lang")
    hashes = {}
    for r in documents.collect():
        hashes.setdefault(r["lang"], []).append(sketch.shingle_hashes(r["text"], 5))
    for r in of.collect():
        whole = sketch.Sketch(np.concatenate(hashes[r["lang"]]))
        assert (r["n_sketches"], r["fingerprint"]) == (len(hashes[r["lang"]]), str(whole))
        assert r["distinct_shingles"] == pytest.approx(whole.distinct()) == pytest.approx(len(np.unique(np.concatenate(hashes[r["lang"]]))), rel=0.3)
    a, b = sketch.Sketch(np.arange(0, 1000, dtype="uint64") * np.uint64(1 << 50)), sketch.Sketch(np.arange(500, 1500, dtype="uint64") * np.uint64(1 << 50))
    assert str(a.merge(b)) == str(sketch.Sketch(np.concatenate([a.hashes, b.hashes])))


def test_quality(spark, sf):
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    good, bad = [got[i]["score"] for i in held if labels[i]], [got[i]["score"] for i in held if not labels[i]]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs(spark, ODD), none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 0), (5, 1), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    assert quality.quality_scores(docs(spark, ODD), some).count() == len(ODD) + 2
    assert quality.quality_scores(docs(spark, []), some).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


def test_decontamination(spark):
    item = "A train leaves the old station at 40 mph and travels for 3 hours before it stops near the river; how far does it go in total today?"
    other = item.replace("40", "75").replace("3 hours", "8 hours")
    mixed = item + " " + other
    texts = [f"before {item} after", f"before {other} after", "a clean text about trains that leave the old station", None, "", mixed.replace("A train", "One"), "short one here"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in templates.contaminated(docs(spark, texts), bench).collect()}
    assert {(1, 1), (2, 1), (7, 4)} <= got and not {i for i, _ in got} & {3, 4, 5}
    left = {r["doc_id"] for r in templates.decontaminate(docs(spark, texts), bench).collect()}
    assert {3, 4, 5, None} <= left and not left & {1, 2, 7}
    assert templates.contaminated(docs(spark, texts), bench.where("item_id > 9")).count() == 0
    assert templates.contaminated(docs(spark, []), bench).count() == 0


def test_each_occurrence_of_an_item_is_judged_by_itself(spark):
    item = "A train leaves the old station at 40 mph and travels for 3 hours before it stops near the river; how far does it go in total today?"
    other, third = item.replace("40", "75"), item.replace("40", "90")
    mixed = item.replace("40 mph", "40 mph and then at 50 mph").replace("at 40", "at 20 or 40")
    texts = [f"{item} {other}", f"first {other} then some words between them and then {third} end", f"{item} More of the text is here, and it leaves the old station at 55 mph and goes on.", mixed + " nothing else"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in templates.contaminated(docs(spark, texts), bench).collect()}
    assert {1, 2, 3} <= got.keys() and all(got[i]["n_windows"] >= templates.MATCHES for i in (1, 2, 3))


def test_one_number_in_two_roles_may_become_two(spark):
    item = "Maria has 5 loaves of bread in the kitchen and later she bakes 5 cakes for the school fair on the green; how many things does she have then?"
    texts = [item.replace("5 loaves", "7 loaves").replace("5 cakes", "9 cakes"), item.replace("5", "8"), item, f"{item} {item.replace('5', '6')}", "Maria has 5 loaves of bread"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["n_slots"] for r in templates.contaminated(docs(spark, texts), bench).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2}


def test_windows_gathered_from_places_that_disagree_do_not_count(spark):
    item = "one two three 5 four six eight nine ten red 7 blue green grey white black brown pink"
    w = item.split()
    parts = [" ".join(["12" if x == "5" else "13" if x == "7" else x for x in w[i : i + 8]]) if i % 2 else " ".join(w[i : i + 8]) for i in range(3, 10)]
    texts = [" far from it all are very many other words ".join(parts), item]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in templates.contaminated(docs(spark, texts), bench).where("doc_id IS NOT NULL").collect()] == [2]


def test_items_of_slots_only_are_found_verbatim(spark):
    series, scores = "2 4 6 8 10 12 14 16 18 20 22 24 26 28 30", "totals Anna Berg 12 Carl Dahl 15 Emil Falk 19 Greta Holm 23 Ivar Juhl 31"
    texts = [f"some words before {series} and after", f"the {scores} so far", series.replace("2 4", "3 5").replace("1", "7"), "clean text with 1 2 3 numbers"]
    bench = spark.createDataFrame([(1, series), (2, scores)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in templates.contaminated(docs(spark, texts), bench).collect()} == {(1, 1), (2, 2)}


def test_benchmark_passages_are_found(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in templates.op1_decontamination(spark, sf).collect()}
    whole = {(i, k) for i, t in texts.items() for k, x in items.items() if x in t}
    assert whole and whole <= got


def test_licenses(spark):
    notice = dict(enumerate(licenses.LICENSES))
    long = "word " * 500
    texts = [f"{long}{notice[3][1]} {long}", "Licensed under the Apache License, Version 2.0. And more text follows here.", "Nothing of the kind is said in this text at all.", None, "", "This work is licensed under the GNU General Public License, version 3."]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs(spark, texts)).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (6, "GPL-3.0")}
    assert 1 - (1 - licenses.LIKENESS**licenses.ROWS) ** licenses.bands() >= licenses.SURE
    assert licenses.license_matches(docs(spark, [])).count() == 0


def test_a_license_beside_a_better_match_counts(spark):
    bsd = next(t for n, t in licenses.LICENSES if n == "BSD").replace("are met", "hold here")
    apache = licenses.LICENSES[5][1].replace("express or implied", "express or tacit")
    texts = [f"Licensed under the MIT License. {bsd}", f"{apache} Licensed under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs(spark, texts)).collect()}
    assert got == {(1, "MIT"), (1, "BSD"), (2, "Apache-2.0"), (2, "MIT"), (3, "GPL-3.0")}


def test_lines(spark):
    shared = "\n".join(f"shared line number {i}" for i in range(6))
    texts = ["head one\n" + shared + "\nown end", "another head\n" + shared + "\nother end", None, "", "quite alone\nwith lines"]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got[1]["n_deleted"] == 0 and got[1]["text"] == texts[0]
    assert got[2]["text"] == "another head\nother end" and got[2]["n_deleted"] == 6 and got[2]["partners"] == [1]
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == texts[4]
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_every_frequent_line_of_a_stretch_has_a_partner(spark):
    a, b = "passage a is here", "passage b is here"
    texts = [f"head\n{a}\ntail", f"other head\n{b}\nother tail", *(f"of a {i}\n{a}\nend a {i}" for i in range(25)), *(f"of b {i}\n{b}\nend b {i}" for i in range(30)), f"mine\n{a}\n{b}\nmy end"]
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")).collect()}
    assert got[len(texts)]["text"] == "mine\nmy end" and got[len(texts)]["partners"] == [1, 2]


def test_lines_that_are_not_unique_are_aligned():
    a, b = ["x", "s", "s", "t", "t", "y"], ["p", "s", "q", "s", "t", "r", "t", "z"]
    assert lines.common_lines(a, b) == [1, 3, 4, 6]
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice([None, 1, 2, 3, 4, 5]) for _ in range(rng.randrange(14))] for _ in range(2))
        ends = [(-1, -1), *lines.patience(a, b), (len(a), len(b))]
        assert all(not ({*a[p + 1 : q]} & {*b[r + 1 : s]}) - {None} for (p, r), (q, s) in zip(ends, ends[1:], strict=False))


def test_patience():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))


PAGE = """<html><head><title>t</title><script>var a;</script></head><body><nav>menu</nav><header>top</header><main><article><h1>Name &amp; more</h1><p>First  <b>bold</b>\ntext {i}.</p>
<ul><li>one<li>two</ul><div>Same on every page</div></article></main><aside>side</aside><div class="comments"><p>reader says</p></div><footer>foot</footer></body></html>"""


def _pages(spark, rows):
    df = spark.createDataFrame([(i, u, h, "mine", 1) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string, text string, n_chars int")
    return {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}


def test_html(spark):
    got = _pages(spark, [*((f"https://a.example/{i}", PAGE.replace("{i}", str(i))) for i in range(8)), (None, None), ("x", ""), ("http://b.example/", "<p>alone</p> tail"), ("http://b.example/1", "<p>unclosed <i>text")])
    assert got[3] == "First bold text 3."  # the heading, the list and the div are on every page of the host
    assert got[8] == got[9] == "" and got[10] == "alone\ntail" and got[11] == "unclosed text"
    alone = html.main_text(PAGE.replace("{i}", "1"))
    assert alone == "Name & more\nFirst bold text 1.\none\ntwo\nSame on every page"
    assert html.extract_text(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_templates_alone_decide_where_no_element_tells(spark):
    page = "<body><div><p>Our shop and our team</p><p>Call us</p></div><div><p>Story {i} begins.</p><p>It ends {i}.</p></div><div>All rights <b>kept</b></div></body>"
    rows = [(f"https://a.example/{i}", page.replace("{i}", str(i))) for i in range(6)]
    got = _pages(spark, [*rows, *rows[:2], ("https://other.example/", rows[0][1])])
    assert all(got[i] == f"Story {i}  begins.\nIt ends {i}.".replace("  ", " ") for i in range(6)) and got[6] == got[0] and got[7] == got[1]
    assert got[8] == "Our shop and our team\nCall us\nStory 0 begins.\nIt ends 0.\nAll rights kept"


def test_copies_of_an_article_are_no_template(spark):
    same = ("https://a.example/x", "<div><p>One article that was stored often.</p></div>")
    got = _pages(spark, [same] * 9 + [("https://a.example/y", "<div><p>Another.</p></div>")])
    assert set(got.values()) == {same[1][8:-10], "Another."}


def test_hostile_pages_take_time_by_their_length():
    for page in ("<div>x" * 20000, '<a href="x>y' * 20001, '<a ">"' * 20000, "<i>" * 4000 + "<div>x" * 4000, "<div>" * 4000 + "<dd></dd>" * 4000, "<" * 200000, "<p><b>x" * 5000, "x" * 2_000_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 5
    assert html.main_text("<article><p>a &lt; b<math><mi>x</mi></math></p><div class='related work'>gone</div><div class='share-price'>kept</div></article>") == "a < bx\nkept"


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    n, all_docs = out.count(), documents.count()
    assert 0.3 * all_docs < n < all_docs
    assert out.join(documents, "doc_id", "left_anti").isEmpty()
    empty = spark.createDataFrame([], documents.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
