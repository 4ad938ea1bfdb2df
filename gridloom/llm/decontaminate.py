"""Benchmark decontamination by template canonicalisation.

Texts become words without the punctuation at their edges. A template replaces
numbers, quantities and units by typed placeholders, and lower-cases the rest;
a second template also replaces capitalised words by a name placeholder. Every
five-word window of a template is hash-joined with the windows of the benchmark
items' templates; windows with fewer than LITERALS literal words are too vague
to count and are left out on the benchmark's side. An item without any other
window, such as one of under five words or mostly of numbers, is matched word by
word instead: its first words, five at most, are the window that is joined, and
the whole of it must follow there; an item of one or two words, which stand in
any text, matches only a text that has no other words.

A document that matches enough of an item's windows is a candidate. Its slots
must be consistent: each value that the item has in a slot stands for the one
value that the document most often has in its stead, and a window with another
value doesn't count. That is settled for the whole document, and for each place
where the item may lie in it by itself, as a document can hold an item more than
once with different values; the best of them counts. A document that still holds
SHARE / PARTS of an item's windows or more is contaminated by it: a copy has the
same values, a re-parameterised question has others throughout.

A place is a band of half an item's length of offsets between the document's and
the item's windows. Bands overlap by half, so that one holds a copy with up to a
quarter of its length put in or left out, and none holds two copies.

All of it is DataFrame functions. The benchmark's windows are broadcast if their
counted bytes allow and joined by shuffle otherwise. Null texts have no words and
match nothing; very long texts are taken whole, a row per window; where two
values are as frequent in a slot, the greater counts; a null doc_id or item_id is
carried along; repeated rows are judged alike, each on its own; empty tables give
an empty result; other columns are ignored by :func:`query` and kept by
:func:`clean`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, materialise, small_side

WORDS = 5
#: Share of an item's windows, as SHARE / PARTS; literal words that a window must have.
SHARE, PARTS = 4, 5
LITERALS = 3
#: An item of fewer words must be all of a text's.
ANYWHERE = 3
# Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mile", "miles", "mg", "g", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pounds", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a", "j", "kj", "n", "pa", "kpa", "k", "c", "f",
    "usd", "eur", "gbp", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "kb", "mb", "gb", "tb", "meter", "meters", "metre", "metres", "degrees", "degree",
)

_EDGE = r"(?<!\S)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]++(?!\S)"
_NUMBER = r"\p{Nd}[\p{Nd}.,:/]*"
_ANY_UNIT = "|".join(UNITS)


def forms(text: Column) -> tuple[Column, Column, Column]:
    """Words of a text, and of its templates without and with names, as arrays of one length."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _EDGE, ""), r"\s+", " "))
    units = F.regexp_replace(bare, rf"(?<!\S){_NUMBER}(?:{_ANY_UNIT})(?!\S)", "<qty>")
    # a unit counts after a number alone, so numbers go last; their own match ends before the space
    units = F.regexp_replace(units, rf"(?<!\S)({_NUMBER}) (?:{_ANY_UNIT})(?!\S)", "$1 <unit>")
    # most texts hold no digit, which is soon seen
    numbers = F.when(bare.rlike(r"\p{Nd}"), F.regexp_replace(units, rf"(?<!\S){_NUMBER}(?!\S)", "<num>")).otherwise(bare)
    names = F.regexp_replace(numbers, r"(?<!\S)\p{Lu}\S*", "<name>")
    return tuple(F.split(F.lower(x), " ") for x in (bare, numbers, names))


def windows(table: DataFrame, *keep: str, exact: Sequence[int] = ()) -> DataFrame:
    """One row per window and form: the columns of ``keep``, place, form and h; ``said``, ``t1`` and ``t2`` hold all words.

    Forms 1 and 2 are templates of WORDS words; form 0 is the words themselves, in windows of as many as ``exact`` lists.
    """
    said, t1, t2 = forms(F.col("text"))
    least = min([WORDS, *exact])
    worded = table.select(*keep, said.alias("said"), t1.alias("t1"), t2.alias("t2")).filter((F.size("said") >= least) & (F.col("said")[0] != ""))
    placed = worded.select(*keep, "said", "t1", "t2", F.explode(F.sequence(F.lit(0), F.size("said") - least)).alias("place"))
    kinds = [F.struct(F.lit(n).alias("form"), F.xxhash64(F.lit(n), _slice(t)).alias("h")) for n, t in ((1, "t1"), (2, "t2"))]
    kinds += [F.struct(F.lit(0).alias("form"), F.xxhash64(F.lit(0), _slice("said", n)).alias("h")) for n in exact]
    hashed = placed.select(*keep, "said", "t1", "t2", "place", F.explode(F.array(*kinds)).alias("w"))
    return hashed.select(*keep, "said", "t1", "t2", "place", F.col("w.form").alias("form"), F.col("w.h").alias("h"))


def _slice(words: str, n: int | Column = WORDS) -> Column:
    return F.slice(F.col(words), F.col("place") + 1, n)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items, written: those that are specific enough, and the beginning of items that have none.

    ``whole`` has all words of the latter, and is null in the former.
    """
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text").cast("string").alias("text"))
    items = materialise(items, "benchmark-items")
    w = windows(items, "item", "item_id").filter(F.col("place") <= F.size("said") - WORDS).withColumn("t", F.when(F.col("form") == 1, _slice("t1")).otherwise(_slice("t2")))
    literal = F.size(F.filter("t", lambda x: ~x.startswith("<")))
    w = w.filter((literal >= LITERALS) & ((F.col("form") == 1) | F.array_contains("t", "<name>")))
    w = w.select("item", "item_id", F.col("place").alias("item_place"), "form", "h", F.col("t").alias("kinds"), _slice("said").alias("item_said"), F.lit(None).cast("array<string>").alias("whole"))
    w = materialise(w, "benchmark-windows")
    vague = items.join(w.select("item").distinct(), "item", "left_anti").select("item", "item_id", forms(F.col("text"))[0].alias("whole")).filter(F.col("whole")[0] != "")
    first = F.slice("whole", 1, WORDS)
    vague = vague.select("item", "item_id", F.lit(0).alias("item_place"), F.lit(0).alias("form"), F.xxhash64(F.lit(0), first).alias("h"), first.alias("kinds"), first.alias("item_said"), "whole")
    return materialise(w.union(vague), "benchmark-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, item_id, n_windows, n_matched) for every contaminated document and item."""
    bench = benchmark_windows(benchmark)
    vague = bench.filter("form = 0")
    exact = [r[0] for r in vague.select(F.size("item_said")).distinct().collect()]  # five numbers at most
    longest = vague.agg(F.max(F.size("whole"))).first()[0] or 0
    band = F.greatest(F.lit(2), F.call_function("div", F.max("item_place") - F.min("item_place") + WORDS, F.lit(2))).cast("bigint")
    totals = materialise(bench.groupBy("item").agg(F.countDistinct("item_place").alias("n_windows"), band.alias("band")), "benchmark-sizes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    w = windows(rows, "row", "doc_id", "text_key", exact=exact)
    follows = _slice("said", F.greatest(F.when(F.col("form") == 0, F.lit(longest)).otherwise(F.lit(WORDS)), F.lit(WORDS)))
    w = w.withColumn("n_words", F.size("said"))
    size = F.lit(120) + 2 * F.octet_length(F.concat_ws(" ", "kinds", "item_said", "whole"))
    if (bench.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        hit = w.join(F.broadcast(bench), ["h", "form"]).withColumn("doc_said", follows)
    else:
        # the whole text's words can't go through a shuffle with every window
        hit = w.withColumn("doc_said", follows).drop("said", "t1", "t2").join(bench, ["h", "form"])
    same = F.slice("doc_said", 1, F.size("whole")) == F.col("whole")
    hit = hit.filter(F.col("whole").isNull() | (same & ((F.size("whole") >= ANYWHERE) | (F.col("n_words") == F.size("whole")))))
    pair = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.struct(F.get("kinds", k).alias("kind"), F.get("item_said", k).alias("a"), F.get("doc_said", k).alias("b")))
    slots = F.filter(pair, lambda p: p["kind"].startswith("<"))
    hit = hit.withColumn("pairs", F.when(F.col("form") > 0, slots).otherwise(F.slice(slots, 1, 0)))
    hit = materialise(hit.select("row", "doc_id", "text_key", "item", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("offset"), "pairs"), "benchmark-hits")

    enough = PARTS * F.countDistinct("item_place") >= SHARE * F.first("n_windows")
    sized = hit.join(small_side(totals), "item")
    candidate = sized.groupBy("row", "item").agg(enough.alias("enough")).filter("enough").select("row", "item")
    # half bands by number; a whole band is named after its first half, the whole document is null
    half = F.floor(2 * F.col("offset") / F.col("band"))
    at = sized.join(candidate, ["row", "item"], "left_semi").withColumn("at", F.explode(F.array(F.lit(None).cast("bigint"), half - 1, half)))
    found = materialise(at.drop("offset", "band").distinct(), "benchmark-candidates")

    here = ["row", "item", "at"]
    slots = found.select(*here, F.explode("pairs").alias("p")).groupBy(*here, "p.kind", "p.a", "p.b").agg(F.count("*").alias("c"))
    value = slots.groupBy(*here, "kind", "a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))
    # an item's slots are few: as many as it has words
    mapping = value.groupBy(*here).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "a"), "b"))).alias("mapping"))
    mapping = mapping.select(*(F.col(c).alias(f"m_{c}") for c in here), "mapping")
    judged = found.join(mapping, (F.col("row") == F.col("m_row")) & (F.col("item") == F.col("m_item")) & F.col("at").eqNullSafe(F.col("m_at")), "left")
    fits = F.forall("pairs", lambda p: F.try_element_at("mapping", F.struct(p["kind"], p["a"])) == p["b"])
    whole = ["row", "doc_id", "text_key", "item", "item_id"]
    out = judged.filter((F.size("pairs") == 0) | fits).groupBy(*whole, "at").agg(F.first("n_windows").alias("n_windows"), F.countDistinct("item_place").alias("n_matched"))
    out = out.groupBy(*whole).agg(F.first("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"))
    return out.filter(PARTS * F.col("n_matched") >= SHARE * F.col("n_windows")).drop("item")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_matched")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, unchanged."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = small_side(materialise(bad, "contaminated"))
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (key == bad["bad_key"]), "left_anti")
