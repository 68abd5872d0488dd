"""Operator 4: benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units of both sides become typed placeholders, so a question
with other parameters keeps its template. Windows of template words are hashed
and joined; where a document holds enough of an item's windows, the values in
their slots are compared: one value of the item must stand for one value of the
document throughout. Items whose windows are no evidence (shorter ones, lists of
numbers) are found by their own words, verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.shared import stored

WINDOW = 8
#: A window with fewer plain words is no evidence.
LEAST_PLAIN = 4
#: Words that an item found verbatim has at least.
LEAST_WORDS = 4
#: Share of an item's windows that a document holds when it is contaminated.
COVERAGE = 0.3
#: Share of an item's slot values that stand for one value each.
CONSISTENT = 0.75
#: Rows of item windows up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 500_000

# Placeholders, units and patterns. None of the replacements adds or removes white space.
NUMBER, NAME, UNIT = "§n", "§p", "§u"
UNITS = "km|kg|kilograms?|kilometers?|kilometres?|meters?|metres?|miles?|feet|foot|inch|inches|cm|mm|mg|ml|grams?|liters?|litres?|pounds?|ounces?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|points?|gallons?|mph|m|g|l|h|s"
_NUMBERS = r"\d+(?:[.,:/]\d+)*"
_ATTACHED = rf"(?<={NUMBER})(?:(?:{UNITS})(?![\p{{L}}\d])|[%°€])"
_APART = rf"(?<={NUMBER} )(?:{UNITS})(?![\p{{L}}\d])"
#: Words that begin sentences; any other capitalised word there may be a name.
OPENERS = (
    "A|After|All|An|And|Are|As|At|Before|But|By|Can|Could|Did|Do|Does|Each|Every|Find|For|From|Given|Had|Has|Have|He|Her|His|How|I|If|In|Is|It|Its|Let|Many|No|Not|Of|On|One|Or|Our|She|Should|So|Some|Suppose"
    "|That|The|Their|Then|There|These|They|This|Those|To|Two|Was|We|Were|What|When|Where|Which|While|Who|Why|Will|With|Would|You|Your"
)
_NAMES = rf"(?=\p{{Lu}})(?:(?<=[\p{{Ll}},;:§] )\p{{Lu}}[\p{{L}}'’-]+|(?<![\p{{L}}\d'’§-])(?!(?:{OPENERS})(?!\p{{L}}))\p{{Lu}}['’]?\p{{L}}*\p{{Ll}}[\p{{L}}'’-]*)"
#: Between words; marks at a word's end belong to what separates it.
_SPACE = r"[ \t\n\r\x0B\f]+"
_BETWEEN = r"[.,;:!?]*[ \t\n\r\x0B\f]+"


def _template(text: Column) -> Column:
    numbers = text
    for pattern, to in ((_NUMBERS, NUMBER), (_ATTACHED, UNIT), (_APART, UNIT)):
        numbers = F.regexp_replace(numbers, pattern, to)
    any_digit = text.contains("0")
    for digit in "123456789":
        any_digit |= text.contains(digit)
    return F.lower(F.regexp_replace(F.when(any_digit, numbers).otherwise(text), _NAMES, NAME))


def _rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), F.rtrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\r\x0b\f.,;:!?")).alias("text"))


def _windows(df: DataFrame, length: int) -> DataFrame:
    """df with a row a window of so many of its words: at (word that it starts with), hash.

    The windows' hashes are doubled in length step by step, and the last step
    overlaps. The outer explode keeps the optimiser from repeating the steps in
    a filter; it adds rows without a hash, which no join finds.
    """
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)) if length == 1 else F.col("words"))
    done = 1
    while done < length:
        step = min(done, length - done)
        df = df.withColumn("h", F.zip_with("h", F.slice("h", F.lit(step + 1), F.size("words")), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))))
        done += step
    return df.select(*(c for c in df.columns if c != "h"), F.posexplode_outer("h").alias("at", "hash"))


def windows(rows: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """key, text, words (of its template), at, hash of all windows of template words."""
    return _windows(_rows(rows, key).withColumn("words", F.split(_template(F.col("text")), _BETWEEN)), window)


def _part(words: str | Column, window: int) -> Column:
    return F.slice(words, F.col("at") + 1, F.lit(window))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows that are evidence: item_id, item_at, hash, item_raw, item_words, n (windows of the item); of equal windows of an item the first."""
    plain = F.size(F.filter("words", lambda w: ~w.contains("§")))
    rows = windows(benchmark, "item_id", window).where("item_id is not null and hash is not null")
    rows = rows.select("item_id", "at", "hash", _part("words", window).alias("words"), _part(F.split("text", _BETWEEN), window).alias("raw")).where(plain >= LEAST_PLAIN)
    rows = rows.groupBy("item_id", "hash").agg(F.min(F.struct("at", "raw", "words")).alias("w"))
    n = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    return rows.join(n, "item_id").select("item_id", F.col("w.at").alias("item_at"), "hash", F.col("w.raw").alias("item_raw"), F.col("w.words").alias("item_words"), "n")


def _verbatim(docs: DataFrame, benchmark: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """The result's rows for the items that have no window in ``items``: all their windows of own words are there, in one place; None if there are no such items.

    An item of fewer words than a window is one window of its length.
    """
    own = F.split(F.lower(F.col("text")), _BETWEEN)
    rest = _rows(benchmark, "item_id").withColumn("words", own).where(F.col("item_id").isNotNull() & (F.size(F.filter("words", lambda w: w != "")) >= LEAST_WORDS))
    rest = rest.withColumn("length", F.least(F.size("words"), F.lit(window))).join(items.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "words", "length")
    rest = stored(rest, "verbatim-items")
    lengths = [r["length"] for r in rest.select("length").distinct().collect()]  # window of them at most
    out = None
    for length in lengths:
        hashes = _windows(rest.where(F.col("length") == length), length).where("hash is not null").select("item_id", F.col("at").alias("item_at"), "hash")
        hashes = stored(hashes.join(hashes.groupBy("item_id").agg(F.count("*").alias("n")), "item_id"), "verbatim-windows")
        few = hashes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
        found = _windows(_rows(docs, "doc_id").withColumn("words", own), length).where("doc_id is not null").select("doc_id", "at", "hash")
        found = found.join(F.broadcast(hashes) if few else hashes, "hash").groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("first"))
        found = found.agg(F.countDistinct("item_at").alias("n_windows"), F.min("n").alias("item_windows")).where("n_windows = item_windows")
        found = found.groupBy("doc_id", "item_id").agg(F.min("n_windows").alias("n_windows"), F.min("item_windows").alias("item_windows"), F.min("first").alias("first_word"))
        last = F.col("first_word") + F.col("item_windows") + F.lit(length - 2)
        found = found.select("doc_id", "item_id", "n_windows", "item_windows", F.lit(1.0).alias("coverage"), F.col("first_word").cast("int").alias("first_word"), last.cast("int").alias("last_word"), F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed"))
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document and item that it holds: doc_id, item_id, n_windows, item_windows, coverage, first_word, last_word, n_slots, n_changed.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    Null or empty texts hold nothing, null ids of documents give no rows,
    repeated rows give one row. Items without a window that is evidence count as
    held where all their words stand in a row (n_slots 0); those of fewer than
    LEAST_WORDS words are never found, as any text may hold these. An empty
    table gives no rows.
    """
    items = stored(item_windows(benchmark, window), "items")
    few = items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = windows(docs, "doc_id", window).where("doc_id is not null").join(F.broadcast(items) if few else items, "hash")
    has_slots = F.exists("item_words", lambda w: w.contains("§"))
    found = found.withColumn("raw", F.when(has_slots, _part(F.split("text", _BETWEEN), window)))
    slots = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.struct(F.element_at("item_words", i).alias("kind"), F.lower(F.element_at("item_raw", i)).alias("item_value"), F.lower(F.element_at("raw", i)).alias("value"))),
        lambda s: s["kind"].contains("§"),
    )
    found = stored(found.select("doc_id", "item_id", "at", "item_at", "n", slots.alias("slots")), "item-windows")
    covered = found.groupBy("doc_id", "item_id", "item_at").agg(F.min("n").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    covered = covered.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.min("n").alias("item_windows"), F.min("first").alias("first_word"), (F.max("last") + window - 1).alias("last_word"))
    covered = covered.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= COVERAGE)

    shift = (F.col("at") - F.col("item_at")).alias("shift")
    trim = lambda v: F.regexp_replace(v, r"[.,;:!?]+\z", "")
    values = found.select("doc_id", "item_id", shift, F.explode("slots").alias("s"))
    values = values.select("doc_id", "item_id", "shift", "s.kind", trim(F.col("s.item_value")).alias("item_value"), trim(F.col("s.value")).alias("value")).distinct()
    per_value = values.groupBy("doc_id", "item_id", "shift", "kind", "item_value").agg(F.count("*").alias("values"), F.max((F.col("item_value") != F.col("value")).cast("int")).alias("changed"))
    per_item = per_value.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed"), F.avg((F.col("values") == 1).cast("double")).alias("consistent"))
    out = covered.join(per_item, ["doc_id", "item_id"], "left").where(F.coalesce("consistent", F.lit(1.0)) >= CONSISTENT)
    out = out.select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "first_word", "last_word", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))
    others = _verbatim(docs, benchmark, items, window)
    return out if others is None else out.unionByName(others)
