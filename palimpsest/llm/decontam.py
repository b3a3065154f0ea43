"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, units after numbers and capitalised words become typed placeholders wherever they
stand, case and punctuation go, and windows of five template words, two plain ones among
them, are hash-joined with those of the benchmark.  To find the documents, every second run
of four words is probed with the runs of four in the benchmark's windows: whatever its
offset, a window of five holds one that starts at an even word, so no window is missed.
Documents that a probe finds are compared in full, and the values that stand in the slots
of the matching windows must replace those of the item consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import flag_ids, written

WIDTH = 5
#: Plain words that a window needs, so that rows of names or numbers match nothing.
PLAIN = 2
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
# Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl dl l liter liters litre litres gallon gallons "
    "s sec ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "w kw kwh v a ohm hz khz mhz ghz pa kpa bar j kj cal kcal n c f k percent dollars dollar cents cent euros euro usd eur gbp mph kmh"
)
_UNIT = "(?i:" + "|".join(sorted(UNITS.split(), key=len, reverse=True)) + ")"
_NUMBERS = rf"(?<![\p{{L}}\p{{N}}])([0-9]++(?:[.,][0-9]++)*+)(?:\s?({_UNIT})(?![\p{{L}}\p{{N}}]))?"
_NAMES = rf"(?<![\p{{L}}\p{{N}}{NUMBER}-{NAME}])(\p{{Lu}}\p{{L}}+)"
_JUNK = rf"(?:[^\p{{L}}\p{{N}}.,{NUMBER}-{NAME}]|[.,](?![0-9])|(?<![0-9])[.,])++"
#: Texts beyond this many characters in all are not broadcast.
BROADCAST_CHARS = 16_000_000


def valued_template(text: Column) -> Column:
    """Words in lower case joined by one space; a slot is its placeholder followed by its value."""
    marked = F.regexp_replace(text, _NUMBERS, f" {NUMBER}$1 {UNIT}$2 ")
    marked = F.regexp_replace(marked, f"{UNIT} ", "")
    text = F.when(text.rlike("[0-9]"), marked).otherwise(text)
    text = F.regexp_replace(text, _NAMES, f" {NAME}$1")
    return F.trim(F.regexp_replace(F.lower(text), _JUNK, " "))


def template(valued: Column) -> Column:
    """The template without slot values."""
    return F.regexp_replace(valued, f"([{NUMBER}-{NAME}])[^ ]+", "$1")


def _windows(words: str) -> Column:
    """All windows of WIDTH words of an array column, as (pos, window) rows by posexplode."""
    last = F.size(words) - WIDTH
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(F.col(words), i + 1, F.lit(WIDTH)), " "))
    return F.posexplode(F.when(last >= 0, made).otherwise(F.array().cast("array<string>"))).alias("pos", "window")


def _split(df: DataFrame, keys: list[str]) -> DataFrame:
    valued = df.select(*keys, valued_template(F.col("text")).alias("valued"))
    return valued.select(*keys, F.split("valued", " ").alias("values"), F.split(template(F.col("valued")), " ").alias("words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_percent: int = 40, least_windows: int = 3) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, reparameterised: leaked items of each document.

    A pair is returned if at least ``least_percent`` % (and ``least_windows``) of the item's
    five-word template windows occur in the document on alignments whose slot values are
    consistent: each value of the item is replaced by one value only.  reparameterised: some
    slot has another value than in the item.  Windows with fewer than PLAIN plain words are
    not counted; items without others (or of fewer than five words), null and empty texts and rows with a null doc_id or item_id match nothing; rows that repeat a doc_id count
    as one document; other columns are ignored; an empty table gives an empty result.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.dropDuplicates(["item_id"])
    items = _split(items, ["item_id"]).where(F.size("words") >= WIDTH)
    known = items.select("item_id", "values", _windows("words")).withColumnRenamed("pos", "item_pos")
    known = known.where(F.size(F.filter(F.split("window", " "), lambda w: ~w.isin(NUMBER, UNIT, NAME))) >= PLAIN)
    known = known.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    size = items.agg(F.sum(F.length(F.array_join("words", " "))).alias("chars")).first()
    few = (size["chars"] or 0) <= BROADCAST_CHARS
    small = F.broadcast if few else (lambda df: df)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flat = texts.select("doc_id", template(valued_template(F.col("text"))).alias("flat"))
    # tried at word starts only and without backtracking, so a long word costs its length
    run = WIDTH - 1
    chunk = F.lit(rf"(?<![^ ])(?:[^ ]++ ){{{run - 1}}}[^ ]++")
    probes = F.concat(*(F.regexp_extract_all(F.regexp_replace("flat", rf"^(?:[^ ]++ ){{{k}}}", "") if k else F.col("flat"), chunk, F.lit(0)) for k in range(0, run, 2)))
    words = F.split("window", " ")
    runs = known.select(F.explode(F.array(*(F.array_join(F.slice(words, k, run), " ") for k in (1, 2)))).alias("run")).distinct()
    probed = flat.select("doc_id", F.explode(probes).alias("run")).join(small(runs), "run", "left_semi").select("doc_id").distinct()
    # several joins read these few ids; unwritten, each would probe all texts again
    probed = written(probed, "probed")
    chosen = flag_ids(texts, probed.select(F.col("doc_id").alias("id")), "maybe").where("maybe").drop("maybe").join(probed, "doc_id", "left_semi")
    full = _split(chosen, ["doc_id"])
    rows = full.select("doc_id", "values", _windows("words"))
    met = rows.join(small(known.withColumnRenamed("values", "item_values")), "window")
    pick = lambda v, at: F.slice(F.col(v), F.col(at) + 1, F.lit(WIDTH))
    slots = F.filter(F.arrays_zip(pick("item_values", "item_pos").alias("i"), pick("values", "pos").alias("d")), lambda s: F.substring(s["i"], 1, 1).isin(NUMBER, UNIT, NAME))
    met = met.select("doc_id", "item_id", "n", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), slots.alias("slots"))
    swaps = met.where(F.size("slots") > 0).select("doc_id", "item_id", "shift", F.explode("slots").alias("s"))
    swaps = swaps.groupBy("doc_id", "item_id", "shift", F.col("s.i").alias("i")).agg(F.min("s.d").alias("x"), F.max("s.d").alias("y"))
    swaps = swaps.groupBy("doc_id", "item_id", "shift").agg(
        F.max((F.col("x") != F.col("y")).cast("int")).alias("mixed"), F.max((F.col("x") != F.col("i")).cast("int")).alias("changed"), F.count("*").alias("slots")
    )
    lines = met.groupBy("doc_id", "item_id", "n", "shift").agg(F.collect_set("item_pos").alias("at"))
    lines = lines.join(swaps, ["doc_id", "item_id", "shift"], "left").where("coalesce(mixed, 0) = 0")
    pairs = lines.groupBy("doc_id", "item_id", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"),
        F.coalesce(F.max("slots"), F.lit(0)).cast("long").alias("n_slots"),
        (F.coalesce(F.max("changed"), F.lit(0)) > 0).alias("reparameterised"),
    )
    pairs = pairs.withColumn("n_windows", F.col("n"))
    kept = pairs.where((100 * F.col("n_matched") >= least_percent * F.col("n_windows")) & (F.col("n_matched") >= F.least(F.lit(least_windows), F.col("n_windows"))))
    return kept.select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "reparameterised")
