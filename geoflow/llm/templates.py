"""Benchmark decontamination by canonical templates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoflow.llm.common import documents, fresh, held, spill

#: Tokens of a template window; matching windows from which a document counts as contaminated, or all of a shorter item.
WINDOW, MATCHES = 8, 6
#: Windows of the benchmark up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST = 1_000_000

# Units of measure, as fixed values.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons tonne tonnes "
    "ml l litre litres liter liters gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "degree degrees celsius fahrenheit percent dollar dollars cent cents euro euros usd eur mph kmh kph w kw kwh watt watts volt volts v hz khz mhz ghz b kb mb gb tb"
).split()
# Number words, as fixed values.
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice"
).split()
SLOTS = ("<num>", "<unit>", "<name>")
#: Begins a word that begins a sentence, in cleaned texts.
MARK = "\x02"
SPACE, SENTENCE = "[\\x09-\\x0d \\x02]++", r"([.!?:][\"')\]]*+) "
HEAD, TAIL = r"[^\p{L}\p{N}$€£+\- \x02]++", r"[^\p{L}\p{N}% ]++(?= )"
EDGES = rf"(?<=[ \x02]){HEAD}(?:{TAIL})?|(?<=[\p{{L}}\p{{N}}% ]){TAIL}"
_WORDS = "|".join(NUMBERS)
#: A number and the unit written to it, which become two words.
ATTACHED = rf"(?<=[ \x02])([+\-]?[$€£]?[0-9][0-9.,:/]*+)((?i:{'|'.join(UNITS)}))(?= )"
NUMBER = rf"(?<=[ \x02])(?:[+\-]?[$€£]?[0-9][0-9.,:/]*+%?+|(?i:(?:{_WORDS})(?:-(?:one|{_WORDS}))*+))(?= )"
UNIT = rf"(?<=<num> )(?i:{'|'.join(UNITS)})(?= )"
NAME = r"(?<= )\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)*+(?= )"


def cleaned(text: Column) -> Column:
    """Words with one space before and after each, less the punctuation at their edges; MARK before those that begin a
    sentence; a number and a unit written together as two. The whole text is rewritten at once: one pass of a pattern
    costs far less than a call a word.
    """
    spaced = F.ltrim(F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), SPACE, " "))
    bare = F.regexp_replace(F.concat(F.lit(f" {MARK}"), F.regexp_replace(spaced, SENTENCE, f"$1 {MARK}")), EDGES, "")
    return F.regexp_replace(bare, ATTACHED, "$1 $2")


def _words(clean: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.translate(clean, MARK, "")), " "), "")


def template(clean: Column) -> Column:
    """Template tokens: <num>, <unit>, <name>, else the word in lower case.

    A number is written in digits or words (but for "one", which mostly is none); a unit follows it; a name is a
    capitalised word. Neither of the last two begins a sentence.
    """
    return _words(F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, NUMBER, "<num>"), UNIT, "<unit>"), NAME, "<name>"))


def values(clean: Column) -> Column:
    """The words themselves, as many as `template` has tokens."""
    return _words(clean)


def is_slot(token: Column) -> Column:
    return token.isin(*SLOTS)


def rolled(items: Column, size: int, join) -> Column:
    """`join` over every `size` consecutive items, by doubling: runs of 1, 2, 4, ... put together; [] where there are fewer."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  a lambda's variable is computed once

    def step(runs: Column, power: int, rest: int, out: Column | None) -> Column:
        """`runs`: of `power` items; `rest`: how many more such runs, in binary; `out`: what the lower bits gave."""
        if rest & 1:
            out = runs if out is None else F.zip_with(runs, F.slice(out, power + 1, 1 << 30), join)
        if rest == 1:
            return out
        wider = F.zip_with(runs, F.slice(runs, power + 1, 1 << 30), join)
        return once(wider, lambda r: step(r, power * 2, rest >> 1, out))

    return once(items, lambda x: F.slice(step(x, 1, size, None), 1, F.greatest(F.size(x) - size + 1, F.lit(0))))


def window_hashes(tokens: Column, size: int) -> Column:
    """Hashes of every window of `size` tokens, in order."""
    return rolled(F.transform(tokens, lambda x: F.xxhash64(x)), size, lambda a, b: F.xxhash64(a, b))


def dense_hashes(tokens: Column, said: Column, size: int) -> Column:
    """Hashes of the values of every window of more placeholders than words; null for other windows."""
    slots = rolled(F.transform(tokens, lambda x: is_slot(x).cast("int")), size, lambda a, b: a + b)
    both = F.zip_with(tokens, said, lambda x, v: F.when(is_slot(x), F.xxhash64(x, v)).otherwise(F.xxhash64(x)))
    return F.zip_with(slots, rolled(both, size, lambda a, b: F.xxhash64(a, b)), lambda n, h: F.when(n * 2 > size, h))


def benchmark_windows(benchmark: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(item, at, size, h, total, usual, slots, dense): each item's windows; items shorter than a window are one window.

    Windows of more placeholders than words say too little (`dense`), unless they are their item's only one: they stand
    with the values of their slots. `total` counts all windows of an item, `usual` those that are not dense.
    """
    items = held(benchmark.select(F.col(id).alias("item"), F.col(text).cast("string").alias("text")), "c", cleaned(F.col("text")))
    items = held(items, "t", template(F.col("c"))).where("item IS NOT NULL AND size(t) > 0").withColumn("size", F.least(F.lit(window), F.size("t")))
    of = lambda make: F.coalesce(*(F.when(F.col("size") == s, make(s)) for s in range(1, window + 1)))
    items = items.withColumn("h", of(lambda s: window_hashes(F.col("t"), s))).withColumn("v", of(lambda s: dense_hashes(F.col("t"), values(F.col("c")), s)))
    items = items.withColumn("slots", of(lambda s: rolled(F.transform("t", lambda x: is_slot(x).cast("int")), s, lambda a, b: a + b)))
    items = items.withColumn("usual", F.when(F.size("h") > 1, F.size(F.filter("v", lambda x: x.isNull()))).otherwise(F.size("h")))
    each = items.select("item", "size", F.size("h").alias("total"), "usual", F.posexplode(F.arrays_zip("h", "v", "slots")).alias("at", "x"))
    dense = F.col("x.v").isNotNull() & (F.col("total") > 1)
    return each.select("item", "at", "size", F.when(dense, F.col("x.v")).otherwise(F.col("x.h")).alias("h"), "total", "usual", F.col("x.slots").alias("slots"), dense.alias("dense"))


def _by(*columns: str):
    return Window.partitionBy(*columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, matches: int = MATCHES) -> DataFrame:
    """(id, item_id, n_windows, item_windows, n_slots) for each document that holds a benchmark item.

    Both sides become templates, and windows of `window` template tokens meet in a hash join. A pair counts from
    `matches` different windows of the item, or all of a shorter item, or all that are not dense where those are fewer;
    dense windows (see `benchmark_windows`) meet only with equal values. Where windows have slots, each slot of the
    item must have one value (n_slots slots) throughout the document, or in one occurrence that has as many windows by
    itself: hits at one distance between document and item, or at near distances. So a number that stands in two roles
    may become two numbers, a stray window or a second copy takes no hit away, and a pair is left out only if its
    windows are gathered from places that disagree. Null or empty texts and items match nothing; a repeated row gives
    its pairs once; rows with null ids are left out; ties do not arise, as every window that meets counts.
    """
    asked = spill(benchmark_windows(benchmark, item_id, item_text, window), "benchmark")
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL")
    small = asked.count() <= BROADCAST
    kinds = {(r["size"], r["dense"]) for r in asked.select("size", "dense").distinct().collect()} or {(window, False)}  # at most `window` + 1
    keys = asked.select("size", "dense", "h").distinct()
    texts = held(docs.withColumn("sum", F.xxhash64("text")), "c", cleaned(F.col("text"))).select("id", "sum", "c")
    texts = held(texts, "t", template(F.col("c")))
    made = lambda s, dense: dense_hashes(F.col("t"), values(F.col("c")), s) if dense else window_hashes(F.col("t"), s)
    each = F.array(*(F.struct(F.lit(s).alias("size"), F.lit(dense).alias("dense"), made(s, dense).alias("h")) for s, dense in sorted(kinds)))
    rows = texts.select("id", "sum", F.explode(each).alias("w")).select("id", "sum", "w.size", "w.dense", F.posexplode("w.h").alias("pos", "h")).where("h IS NOT NULL")
    rows = spill(rows.join(F.broadcast(keys) if small else keys, ["size", "dense", "h"], "left_semi"), "windows")
    hits = rows.join(F.broadcast(asked) if small else asked, ["size", "dense", "h"]).select("id", "sum", "pos", "item", "at", "size", "total", "usual", "slots", "dense")
    counts = [F.size(F.collect_set("at")).cast("long").alias("n_windows"), F.size(F.collect_set(F.when(~F.col("dense"), F.col("at")))).alias("n_usual")]
    counts += [F.first("total").alias("item_windows"), F.first("usual").alias("usual"), F.sum("slots").alias("slots")]
    of_all = F.col("n_windows") >= F.least(F.lit(matches), F.col("item_windows"))
    enough = of_all | ((F.col("usual") > 0) & (F.col("n_usual") >= F.least(F.lit(matches), F.col("usual"))))
    pairs = spill(hits.groupBy("id", "sum", "item").agg(*counts).where(enough), "pairs")
    # slot values, only of pairs that have slots: over the whole text (level 0), near distances (1), one distance (2)
    open_pairs = pairs.where("slots > 0").select("id", "sum", "item")
    by = _by("id", "sum", "item").orderBy("diagonal")
    occurrences = hits.join(open_pairs, ["id", "sum", "item"]).withColumn("diagonal", F.col("pos") - F.col("at"))
    occurrences = occurrences.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) >= F.col("size")).cast("int"), F.lit(0)))
    occurrences = occurrences.withColumn("run", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, 0)).cast("long"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), part.cast("long").alias("part")) for k, part in enumerate((F.lit(0), F.col("run"), F.col("diagonal")))))
    occurrences = spill(occurrences.withColumn("l", F.explode(levels)).select(*hits.columns, "l.level", "l.part"), "occurrences")
    one = ["id", "sum", "item", "level", "part"]
    whole = occurrences.groupBy(*one).agg(*counts).where(enough)
    places = occurrences.where("slots > 0").select(*one, F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.struct((F.col("pos") + k).alias("p"), (F.col("at") + k).alias("q")))).alias("x")).select(*one, "x.p", "x.q").distinct()
    said = docs.select("id", F.xxhash64("text").alias("sum"), "text").join(open_pairs.select("id", "sum").distinct(), ["id", "sum"])
    said = held(said.dropDuplicates(["id", "sum"]), "raw", values(cleaned(F.col("text")))).select("id", "sum", "raw")
    items = held(benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")), "t", template(cleaned(F.col("text")))).select("item", "t")
    filled = places.join(said, ["id", "sum"]).join(items, "item").where(is_slot(F.get("t", F.col("q")))).select(*one, "q", F.get("raw", F.col("p")).alias("value"))
    judged = filled.groupBy(*one, "q").agg(F.count_distinct("value").alias("ways")).groupBy(*one).agg(F.count(F.lit(1)).alias("n_slots"), (F.max("ways") == 1).alias("consistent"))
    held_in = whole.select(*one).join(judged, one, "left").where(F.coalesce("consistent", F.lit(True)))
    held_in = held_in.groupBy("id", "sum", "item").agg(F.max("n_slots").alias("n_slots"))
    out = pairs.where("slots = 0").withColumn("n_slots", F.lit(0).cast("long")).unionByName(pairs.where("slots > 0").join(held_in, ["id", "sum", "item"]))
    out = out.groupBy("id", "item").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"))
    return out.select(F.col("id").alias(id), F.col("item").alias("item_id"), "n_windows", F.col("item_windows").cast("long"), F.col("n_slots").cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    own = fresh(docs, "_gone")
    gone = spill(contaminated(docs, benchmark, id, text, **options).select(F.col(id).alias(own)).distinct(), "leaks")
    return docs.join(gone, F.col(id) == F.col(own), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
