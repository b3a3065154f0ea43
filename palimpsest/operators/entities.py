"""Entity resolution by exact candidate indexes (C09): no pair of alike names is lost, and only likely ones are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vector import cosine
from palimpsest.operators.shared import stored

#: Names of up to SHORT characters are found by their deletion neighbourhoods, names from LONG on by segments.
SHORT, LONG, EDITS = 14, 13, 2
GRAM = 3


def _variants(name: Column) -> Column:
    """The name with up to two characters left out: names within two edits have one in common."""
    each = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    once = F.concat(F.array(name), each(name))
    return F.array_distinct(F.concat(once, F.flatten(F.transform(once, each))))


def _segment(length: Column, k: int) -> tuple[Column, Column]:
    """(first character, size) of segment k of EDITS + 1 even ones."""
    base, parts = F.floor(length / (EDITS + 1)).cast("int"), EDITS + 1
    longer = (length % parts).cast("int")  # the last ones are longer by one
    size = base + F.when(F.lit(k) >= parts - longer, 1).otherwise(0)
    begin = F.lit(1) + k * base + F.greatest(F.lit(0), F.lit(k) - (parts - longer))
    return begin, size


def _own_segments(name: Column) -> Column:
    """Keys (length, segment, text) of a name: of two edits, one segment of three is left as it is."""
    n = F.length(name)
    rows = []
    for k in range(EDITS + 1):
        begin, size = _segment(n, k)
        rows.append(F.concat_ws("\x1f", n.cast("string"), F.lit(str(k)), F.substring(name, begin, size)))
    return F.array(*rows)


def _sought_segments(name: Column) -> Column:
    """Keys that names within two edits of this one may have."""
    n, rows = F.length(name), []
    for more in range(-EDITS, EDITS + 1):
        for k in range(EDITS + 1):
            begin, size = _segment(n + more, k)
            for shift in range(-EDITS, EDITS + 1):
                at = begin + shift
                key = F.concat_ws("\x1f", (n + more).cast("string"), F.lit(str(k)), F.substring(name, at, size))
                rows.append(F.when((at >= 1) & (at + size - 1 <= n), key))
    return F.array_distinct(F.array_compact(F.array(*rows)))


def _within_edits(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): candidates for two edits, of tables a (a) and b (b) of distinct names."""
    short = a.where(F.length("a") <= SHORT).select("a", F.explode(_variants(F.col("a"))).alias("key"))
    short = short.join(b.where(F.length("b") <= SHORT).select("b", F.explode(_variants(F.col("b"))).alias("key")), "key")
    long_ = a.where(F.length("a") >= LONG).select("a", F.explode(_sought_segments(F.col("a"))).alias("key"))
    long_ = long_.join(b.where(F.length("b") >= LONG).select("b", F.explode(_own_segments(F.col("b"))).alias("key")), "key")
    pairs = short.unionByName(long_).select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b", EDITS) >= 0)


def _grams(name: Column, size: int) -> Column:
    return F.when(F.length(name) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(name, i, size)))).otherwise(F.array().cast("array<string>"))


def _inside(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): a lies in b.  a is looked up by its rarest gram of GRAM characters in b, a shorter one by itself."""
    short = [r.n for r in a.where(F.length("a") < GRAM).select(F.length("a").alias("n")).distinct().collect()]
    rows = b.select("b", F.explode(_grams(F.col("b"), GRAM)).alias("gram"))
    for n in short:
        rows = rows.unionByName(b.select("b", F.lit("").alias("gram")) if n == 0 else b.select("b", F.explode(_grams(F.col("b"), n)).alias("gram")))
    counts = rows.groupBy("gram").agg(F.count("*").alias("n"))
    own = a.select("a", F.explode(F.when(F.length("a") < GRAM, F.array("a")).otherwise(_grams(F.col("a"), GRAM))).alias("gram"))
    # a gram that b lacks has no partner
    found = own.join(counts, "gram", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    return found.where("least.n > 0").select("a", F.col("least.gram").alias("gram")).join(rows, "gram").where(F.contains("b", "a")).select("a", "b")


def _alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of alike_names, some of them twice, of stored tables a (a) and b (b) of distinct lower-case names."""
    turned = _inside(b.select(F.col("b").alias("a")), a.select(F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return _within_edits(a, b).unionByName(_inside(a, b)).unionByName(turned)


def alike_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """T26 over two tables (name): distinct pairs (a, b) of lower-case names that are equal, one inside the other, or within two edits."""
    a = stored(names.where("name is not null").select(F.lower("name").alias("a")).distinct(), "names")
    b = stored(known.where("name is not null").select(F.lower("name").alias("b")).distinct(), "known")
    return _alike(a, b).distinct()


def resolve_entities(names: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """Name, id of the known entity it is (null: a new one), exact.

    names: name, vector; known: id, name, vector, position.  A name that equals a known one
    but for case is the first such, by position; else it is the first of the alike names
    (one inside the other, or within two edits) whose vector has cosine >= ``least``.
    Vectors belong to names.  Names that repeat are one row, null names are left out; of
    known entities of one name only the first can be found.
    """
    asked = names.where("name is not null").groupBy("name").agg(F.first("vector").alias("vector"))
    asked = stored(asked.withColumn("a", F.lower("name")), "asked")
    firsts = known.where("name is not null").groupBy(F.col("name").alias("known_name")).agg(F.min(F.struct("position", "id")).alias("at"), F.min_by("vector", F.struct("position", "id")).alias("known_vector"))
    firsts = stored(firsts.withColumn("b", F.lower("known_name")), "firsts")
    exact = asked.select("name", "a").join(firsts.select(F.col("b").alias("a"), "at"), "a").groupBy("name").agg(F.min("at").alias("at"))
    exact = stored(exact, "exact")
    # alike names are sought for what is left; vectors are met at the known name, so pairs travel without them
    rest = stored(asked.join(exact, "name", "left_anti"), "rest")
    known_names = stored(firsts.select("b").distinct(), "known")
    rows = _alike(stored(rest.select("a").distinct(), "names"), known_names).join(firsts, "b").join(rest, "a")
    near = rows.where(F.round(cosine("vector", "known_vector"), 9) >= least).groupBy("name").agg(F.min("at").alias("at"))
    found = exact.select("name", F.col("at")["id"].alias("id"), F.lit(True).alias("exact")).unionByName(near.select("name", F.col("at")["id"].alias("id"), F.lit(False).alias("exact")))
    return asked.select("name").join(found, "name", "left").select("name", "id", F.coalesce("exact", F.lit(False)).alias("exact"))


def with_aliases(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """Known (id, name, aliases, ...) with the other names that were found to be them, sorted."""
    more = resolved.where("id is not null").groupBy("id").agg(F.collect_set("name").alias("_more"))
    rows = known.join(more, "id", "left")
    united = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array_remove(F.coalesce("_more", F.array().cast("array<string>")), F.col("name")))
    return rows.select(*(c for c in known.columns if c != "aliases"), F.array_sort(united).alias("aliases"))
