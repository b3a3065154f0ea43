"""Secret scans over an incremental blob ledger, by DataFrame functions alone.

Every version of a document is addressed by the SHA-256 of its text.  The ledger holds the
findings of each (blob, rule version) pair that was ever scanned; a scan reads only pairs
that are not in it, from one path of each blob, appends them, and joins the findings of
every blob back to all paths that hold it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import flag_ids, fresh_name, shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern without empty matches; a match counts if ``group`` of it has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules come first, in this order.
BASE_RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _placed(rows: Column, rank: int, rule: Rule) -> Column:
    """Spans of the matches (gap, len, size) that count, where each starts after all gaps up to it and all matches before it.

    The rows are added up in blocks of about the root of their number, so that lists are
    appended to only within a block: n * sqrt(n) copies, not n * n.
    """
    none = F.array().cast(SPANS)

    def spans(block: Column, at: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            stop = start + x["len"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
            return F.struct(stop.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def blocks(row: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(row))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(row) / width).cast("int") - 1), lambda k: F.slice(row, k * width + 1, width))

    def starts(parts: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def add(acc: Column, part: Column) -> Column:
            after = F.aggregate(part, acc["at"], lambda n, x: n + x["gap"] + x["len"])
            return F.struct(after.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(parts, begin, add, lambda acc: acc["out"])

    return _let(rows, lambda row: _let(blocks(row), lambda parts: F.flatten(F.zip_with(parts, starts(parts), spans))))


def _spans(text: str, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, in code points.

    The pieces between the matches (split) and the matches themselves alternate, so a match
    starts at the length of all pieces up to it and all matches before it.
    """
    quoted = F.lit(rule.pattern)
    length = lambda x: F.length(x).cast("bigint")
    pieces = F.transform(F.split(F.col(text), rule.pattern, -1), length)
    whole = F.transform(F.regexp_extract_all(F.col(text), quoted, F.lit(0)), length)
    if rule.group:
        sized = F.transform(F.regexp_extract_all(F.col(text), quoted, F.lit(rule.group)), length)
        rows = F.arrays_zip(pieces.alias("gap"), whole.alias("len"), sized.alias("size"))
    else:
        rows = F.transform(F.arrays_zip(pieces.alias("gap"), whole.alias("len")), lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), x["len"].alias("size")))
    # the piece behind the last match has no match
    rows = F.filter(rows, lambda x: x["len"].isNotNull())
    return F.when(F.col(text).rlike(rule.pattern), _placed(rows, rank, rule)).otherwise(F.array().cast(SPANS))


def find_spans(text: str = "text", rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans (start, rank, stop, kind) of the rules, by start, then the rules' order."""
    return F.array_sort(F.concat(*(_spans(text, r, k) for k, r in enumerate(rules))))


def span_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where it was never written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"blob binary, rule_version string, spans {SPANS}"
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans of every row of docs (doc_id, text), through the ledger at ``ledger_path``.

    One path of each unseen blob is scanned: its doc_id is looked up in a bitmap of fixed
    size that is broadcast, so texts are scanned where they are read and never shuffled; a
    row that only shares a bit is scanned too and dropped by the join that follows.  A null
    text is an empty one; null and repeated doc_ids are ordinary paths; other columns are
    ignored; an empty table gives an empty result and leaves the ledger as it was.  Without
    a path the ledger is a new one in the shared folder.
    """
    spark = docs.sparkSession
    version = rule_version(rules)
    if ledger_path is None:
        ledger_path = f"{shared_dir(spark)}/palimpsest/ledger-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    seen = _ledger(spark, ledger_path).where(F.col("rule_version") == version).select("blob")
    unseen = paths.groupBy("blob").agg(F.min(key).alias("path")).join(seen, "blob", "left_anti")
    chosen = flag_ids(texts.withColumn("doc_id", key), unseen.select(F.col("path").alias("id")), "maybe").where("maybe")
    found = chosen.select(F.col("doc_id").alias("path"), F.unhex(F.sha2("text", 256)).alias("blob"), find_spans("text", rules).alias("spans"))
    found = found.join(unseen, ["blob", "path"], "left_semi").dropDuplicates(["blob"])
    found.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)
    known = _ledger(spark, ledger_path).where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    # two scans at a time may both have added a blob
    known = known.dropDuplicates(["blob"])
    joined = paths.join(known, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact_secrets(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by ``[kind]`` (of the first of overlapping spans); same columns.

    n_chars, if docs has it, becomes the length of a text that changed.  Rows without a
    finding pass as they are and are not shuffled; nulls stay null.
    """
    found = scan_secrets(docs, ledger_path, rules).where((F.size("spans") > 0) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "blob"])
    maybe, own_blob, own_spans = (fresh_name() for _ in range(3))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    flagged = flag_ids(docs.where("doc_id is not null"), found.select(F.col("doc_id").alias("id")), maybe)
    sure = flagged.where(~F.col(maybe)).drop(maybe)
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    spans = found.select(F.col("doc_id"), F.col("blob").alias(own_blob), F.col("spans").alias(own_spans))
    unsure = flagged.where(F.col(maybe)).withColumn(own_blob, blob).join(spans, ["doc_id", own_blob], "left")
    # a row without an id is scanned in place
    nameless = find_spans("text", rules)
    nameless = docs.where("doc_id is null").withColumn(own_spans, F.when(F.size(nameless) > 0, nameless))
    unsure = unsure.select(*columns, own_spans).unionByName(nameless)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        plain = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], plain, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.col(own_spans).isNotNull(), F.aggregate(own_spans, begin, cut, end)).otherwise(F.col("text"))
    unsure = unsure.withColumn("text", clean)
    if "n_chars" in docs.columns:
        unsure = unsure.withColumn("n_chars", F.when(F.col(own_spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return sure.unionByName(unsure.select(*columns))
