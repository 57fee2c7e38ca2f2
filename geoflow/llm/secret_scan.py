"""Secret scan: three base patterns, and windows of high Shannon entropy in candidate strings; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import documents, held

#: Base patterns (fixed values): name, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: Candidate strings, and their character classes in the order of choice: name, whole pattern (None: MIXED), alphabet, window, least entropy in bits.
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
CLASSES = [
    ("entropy_hex", "[0-9a-f]*([0-9][a-f]|[a-f][0-9])[0-9a-f]*", "0123456789abcdef", 16, 3.0),
    ("entropy_upper", "[0-9A-Z]*([0-9][A-Z]|[A-Z][0-9])[0-9A-Z]*", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16, 3.3),
    ("entropy_base64", None, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-", 20, 3.85),
]
#: What a candidate of the widest class must hold.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
#: Candidates that are no secrets: placeholders, runs of the alphabet, UUIDs, and digests of nothing by MD5, SHA-1 and SHA-256.
ALLOW = "example|sample|placeholder|dummy|changeme|your|xxxx|0123456|1234567|abcdefg|qwerty|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^d41d8cd98f00b204e9800998ecf8427e$|^da39a3ee5e6b4b0d3255bfef95601890afd80709$|^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$"
#: Fixed point of the entropy sums, and window ends that one fold goes through.
POINT, CHUNK = 1 << 20, 1024
SPAN = "array<struct<start:int,kind:int,end:int>>"
KINDS = [*(b[0] for b in BASE), *(c[0] for c in CLASSES)]


def weight(n: int) -> int:
    """n log2 n in fixed point."""
    return round(n * math.log2(n) * POINT) if n else 0


def limit(window: int, bits: float) -> int:
    """The greatest sum of weights of a window's counts at which its entropy is at least `bits`."""
    return math.floor((math.log2(window) - bits) * window * POINT)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _running(steps: Column) -> Column:
    """Running sums of an array, folded in chunks of 256 so that the work stays in proportion."""
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(_last(acc), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    n = F.ceil(F.size(steps) / 256).cast("int")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none), lambda c: F.aggregate(F.slice(steps, c * 256 + 1, 256), none, grow))
    so_far = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(_last(acc) + _last(x))))
    added = lambda p, base: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: y + F.get(base, i))))
    return _let(parts, lambda p: _let(so_far(p), lambda base: added(p, base)))


def _matches(text: Column, pattern: str) -> Column:
    """(found, gaps): matches of a pattern and the texts around them, looked for only where there is one."""
    any_ = F.rlike(text, F.lit(pattern))
    none = F.array().cast("array<string>")
    return F.struct(F.when(any_, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("found"), F.when(any_, F.split(text, pattern, -1)).otherwise(none).alias("gaps"))


def _ends(m: Column) -> Column:
    """Where each match ends, in code points."""
    found = m["found"]
    return _let(F.zip_with(F.slice(m["gaps"], 1, F.size(found)), found, lambda g, f: F.length(g) + F.length(f)), _running)


def _folded(codes: Column, size: int, window: int, most: int) -> Column:
    """Windows of high entropy among the first CHUNK that end in `codes`, as joined spans (start, end)."""
    span = "array<struct<start:int,end:int>>"
    weights = F.array(*(F.lit(weight(n)) for n in range(window + 2)))
    of = lambda n: F.get(weights, n)
    pairs = F.transform(codes, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.when(i >= window, F.get(codes, i - window)), F.lit(0)).alias("z"), i.alias("i")))
    zero = F.struct(F.array_repeat(F.lit(0), size + 1).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("a"), F.lit(-1).alias("b"), F.array().cast(span).alias("done"))

    def step(st: Column, e: Column) -> Column:
        x, z, n, i = e["x"], e["z"], st["n"], e["i"]
        # the character that leaves, then the one that enters
        less = F.when(z > 0, of(F.get(n, z) - 1) - of(F.get(n, z))).otherwise(0)
        now = F.get(n, x) - F.when((x == z) & (z > 0), 1).otherwise(0)
        s = (st["s"] + less + of(now + 1) - of(now)).cast("long")
        counts = F.when(x == z, n).otherwise(F.transform(n, lambda c, k: c + F.when(k == x, 1).when(k == z, -1).otherwise(0)))

        def then(s: Column) -> Column:
            hit = (i >= window - 1) & (s <= most)
            new = hit & (st["b"] < i - window + 1)
            done = F.when(new & (st["b"] > 0), F.concat(st["done"], F.array(F.struct(st["a"].alias("start"), st["b"].alias("end"))))).otherwise(st["done"])
            return F.struct(counts.alias("n"), s.alias("s"), F.when(new, i - window + 1).otherwise(st["a"]).alias("a"), F.when(hit, i + 1).otherwise(st["b"]).alias("b"), done.alias("done"))

        return _let(s, then)

    last = lambda st: F.when(st["b"] > 0, F.concat(st["done"], F.array(F.struct(st["a"].alias("start"), st["b"].alias("end"))))).otherwise(st["done"])
    return F.aggregate(pairs, zero, step, last)


def _joined(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    n = F.size(spans)
    starts = F.filter(spans, lambda s, i: (i == 0) | (s["start"] > F.get(spans, i - 1)["end"]))
    ends = F.filter(spans, lambda s, i: (i == n - 1) | (F.get(spans, i + 1)["start"] > s["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def high_entropy(run: Column, alphabet: str, window: int, bits: float) -> Column:
    """Joined spans (start, end) of `run` where a sliding window of its characters reaches an entropy, by incremental counts.

    Long runs are folded in chunks that overlap by a window, so that no step copies more than one chunk's spans.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c))
    n = lambda c: F.greatest(F.lit(1), F.ceil((F.size(c) - window + 1) / CHUNK).cast("int"))
    one = lambda c, k: _let(F.slice(c, k * CHUNK + 1, CHUNK + window - 1), lambda part: _folded(part, len(alphabet), window, limit(window, bits)))
    moved = lambda spans, k: F.transform(spans, lambda s: F.struct((s["start"] + k * CHUNK).alias("start"), (s["end"] + k * CHUNK).alias("end")))
    return _let(codes, lambda c: _let(F.flatten(F.transform(F.sequence(F.lit(0), n(c) - 1), lambda k: moved(one(c, k), k))), _joined))


def _spans_in(run: Column, end: Column, kind: int) -> Column:
    """Spans of high entropy of a candidate that ends at `end`, by one character class."""
    _, _, alphabet, window, bits = CLASSES[kind - len(BASE)]
    start = end - F.length(run)
    moved = lambda s: F.struct((start + s["start"]).cast("int").alias("start"), F.lit(kind).alias("kind"), (start + s["end"]).cast("int").alias("end"))
    return F.transform(high_entropy(run, alphabet, window, bits), moved)


def _entropy_spans(run: Column, end: Column, allow: str) -> Column:
    """The same by the first character class that the candidate fits; none for allowed ones."""
    none = F.array().cast(SPAN)
    out = F.when(F.rlike(F.lower(run), F.lit(allow)), none)
    for kind, (_, pattern, _, window, _) in enumerate(CLASSES, len(BASE)):
        fits = F.length(run) >= window
        for p in [f"^{pattern}$"] if pattern else MIXED:
            fits = fits & F.rlike(run, F.lit(p))
        out = out.when(fits, _spans_in(run, end, kind))
    return out.otherwise(none)


def _base_spans(found: Column, ends: Column, kind: int) -> Column:
    """Spans of a base pattern's matches that are long enough."""
    _, pattern, group, least = BASE[kind]
    span = lambda f, e: F.struct((e - F.length(f)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.when(F.length(F.regexp_extract(f, pattern, group) if group else f) >= least, e.cast("int")).alias("end"))
    return F.filter(F.zip_with(found, ends, span), lambda s: s["end"].isNotNull()).cast(SPAN)


def scan(df: DataFrame, text: str = "text", allow: str = ALLOW) -> DataFrame:
    """`df` less `text`, with n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, comma-joined).

    Base patterns are leftmost non-overlapping per kind; their spans always stay. Candidate strings of 16 characters and
    more add the windows whose Shannon entropy reaches the bound of the candidate's character class, joined where they
    overlap, unless the candidate matches `allow`; such a span may lie on a base span. Offsets count code points of the
    whole text, ends exclusive. Null and empty texts have no spans; texts of any length are scanned whole; repeated rows
    stay; ties in start go by kind, then end; an empty table gives no row. Columns named like a result are replaced.
    """
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    keep = [c for c in df.columns if c != text and c not in made]
    d = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("k") if keep else F.struct(F.lit(1)).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    d = held(d, "m", F.struct(*(_matches(t, p).alias(name) for name, p, *_ in BASE), _matches(t, CANDIDATE).alias("run"))).drop("t")
    d = held(d, "e", F.struct(*(_ends(F.col(f"m.{name}")).alias(name) for name in [*(b[0] for b in BASE), "run"])))
    base = [_base_spans(F.col(f"m.{name}.found"), F.col(f"e.{name}"), kind) for kind, (name, *_) in enumerate(BASE)]
    more = F.flatten(F.zip_with(F.col("m.run.found"), F.col("e.run"), lambda f, e: _entropy_spans(f, e, allow)))
    d = held(d, "s", F.struct(F.array_sort(F.flatten(F.array(*base))).alias("base"), more.alias("more")))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("s.base", lambda s: s["kind"] == kind)).cast("long")
    return d.select(
        *([F.col("k.*")] if keep else []),
        *(count(kind).alias(f"n_{name}") for kind, (name, *_) in enumerate(BASE)),
        F.sha2(said(F.col("s.base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("s.base", "s.more"))).alias("spans"),
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"))
