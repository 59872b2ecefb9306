"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of a file is addressed by the digest of its content, so one content is one blob
however many paths and versions hold it. The ledger records which blob has been scanned
under which version of which rule, and what was found. A scan reads the text of those blobs alone
for which a pair of blob and rule version is missing; findings are then joined back to all
paths. The ledger also keeps which paths have ever held which blob, so that a secret is reported at a path
whose content has changed since. Findings and paths are written before the record of the scan, so a job that fails between
them scans again and finds the same.

Matches are found leftmost first, without overlap, per rule: ``split`` gives the lengths of
what lies between matches and ``regexp_extract_all`` the matches, and running sums over both give
positions in code points.

A null text counts as empty. Rows with equal path and text are one version; a null path is
a path like others. Columns other than the named ones are not read. An empty table scans nothing.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from steward.llm.shared import written


@dataclass(frozen=True)
class Rule:
    """What a secret looks like. ``least`` is how long group ``group`` of a match must be.

    A new pattern needs a new version: blobs are then scanned again under this rule alone.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one class are found whole, so asking for their length in the pattern finds the same
# as dropping short ones later; ``assign`` drops later, as a match that fails still uses up text.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, r"xox[abeoprs]-[A-Za-z0-9-]{16,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment_key", 1, r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps_key", 1, r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = (*BASE, *MORE)

_SCANNED = "blob binary, rules array<string>"
_FOUND = "blob binary, rule string, start int, end int"


def versions(files: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text): every version with the digest of its content."""
    content = F.coalesce(F.col(text), F.lit(""))
    return files.select(
        F.col(path).alias("path"), F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("text")
    )


def _read(spark: SparkSession, ledger: str, name: str, schema: str | T.StructType) -> DataFrame:
    """A table of the ledger; one that was never written is empty."""
    path = os.path.join(ledger, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _matches(rule: Rule) -> Column:
    """Array of (rule, at, gap, size, good) for one rule: a match and the gap before it."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.transform(F.split("text", rule.pattern, -1), F.char_length)
    kind = "array<struct<rule:string,at:int,gap:int,size:int,good:boolean>>"
    # Of a match only its length and verdict are kept; its own text may start with another
    # alternative, so the group is taken from the match itself.
    good = (
        (lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
        if rule.group
        else (lambda m: F.lit(True))
    )
    each = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(rule.key).alias("rule"),
            i.alias("at"),
            F.get(gaps, i).alias("gap"),
            F.char_length(m).alias("size"),
            good(m).alias("good"),
        ),
    )
    asked = F.array_contains("todo", rule.key) & F.rlike("text", pattern)
    return F.when(asked, each.cast(kind)).otherwise(F.array().cast(kind))


def scan(files: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks, add it there, and give (path, blob) of all versions."""
    spark = files.sparkSession
    paths = written(versions(files, path, text).select("path", "blob"), "paths")
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = _read(spark, ledger, "scanned", _SCANNED).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen")
    )
    blobs = paths.groupBy("blob").agg(F.min("path").alias("holder"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    due = written(
        blobs.join(seen, "blob", "left").select("blob", "holder", todo.alias("todo")).filter(F.size("todo") > 0), "due"
    )
    # Texts stream past a table of digests, so they are moved but not sorted.
    texts = versions(files, path, text)
    held = (texts["blob"] == due["blob"]) & texts["path"].eqNullSafe(due["holder"])
    read = texts.join(due.hint("shuffle_hash"), held).select(
        due["blob"], "todo", "text", F.monotonically_increasing_id().alias("copy")
    )
    hits = read.select("blob", "copy", F.explode(F.concat(*[_matches(r) for r in rules])).alias("hit"))
    order = Window.partitionBy("blob", "copy", "hit.rule").orderBy("hit.at")
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(order).cast("int")
    placed = hits.select("blob", "hit.*", end.alias("end")).filter("good")
    found = placed.select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end").distinct()
    found.write.mode("append").parquet(os.path.join(ledger, "found"))
    _keep_paths(paths, ledger)
    due.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(os.path.join(ledger, "scanned"))
    return paths


def _keep_paths(paths: DataFrame, ledger: str) -> None:
    """Add the pairs of path and blob that the ledger does not know yet."""
    known = _read(paths.sparkSession, ledger, "paths", paths.schema)
    same = paths["path"].eqNullSafe(known["path"]) & (paths["blob"] == known["blob"])
    paths.join(known, same, "left_anti").distinct().write.mode("append").parquet(os.path.join(ledger, "paths"))


def history(files: DataFrame, ledger: str, path: str = "doc_id") -> DataFrame:
    """(path, blob) of every version any scan into the ledger has seen, each once; ``by_path`` adds what was found.

    Of ``files`` only the type of ``path`` is taken.
    """
    kind = T.StructType([T.StructField("path", files.schema[path].dataType), T.StructField("blob", T.BinaryType())])
    return _read(files.sparkSession, ledger, "paths", kind).distinct()


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the current rule versions; spans sorted by start, then by rule."""
    number = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    found = _read(spark, ledger, "found", _FOUND).withColumn("number", number).filter("number is not null")
    span = F.struct("start", "number", "end", F.element_at(F.split("rule", "@"), 1).alias("kind"))
    return found.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def by_path(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) of every version; no findings are an empty array.

    A blob may be held by very many paths: this join is one that Spark splits at runtime.
    """
    found = findings(paths.sparkSession, ledger, rules)
    kind = found.schema["spans"].dataType
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with what sorted ``spans`` cover replaced; spans that overlap share a mask."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, span: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        parts = F.when(
            span["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.concat(gap, F.lit(mask))))
        ).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), parts.alias("parts"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, add, close))


def redacted(files: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``files`` with the secrets of their blobs masked; the other columns as they were.

    ``files`` must have been scanned into the ledger. A null text stays null.
    """
    names = files.columns
    blob, spans = "_blob", "_spans"
    while {blob, spans} & set(names):
        blob, spans = blob + "_", spans + "_"
    found = findings(files.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    # Where no rule's pattern occurs nothing was found, so such texts need not be moved.
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(rule.pattern))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = files.filter(hit).withColumn(blob, digest).join(found, blob, "left")
    masked = F.when(F.col(spans).isNull(), F.col(text)).otherwise(redact(F.col(text), F.col(spans)))
    changed = joined.select(*[masked.alias(c) if c == text else F.col(f"`{c}`") for c in names])
    return files.filter(~hit).unionByName(changed)
