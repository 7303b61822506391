"""Secret scans over every historical version of a text, each distinct text scanned once.

A version is content-addressed by the SHA-256 of its text. A ledger, a Parquet
folder, records which (blob, rule and rule version) pairs have been scanned and
what was found. A run scans only pairs the ledger lacks, appends them, and joins
the findings back to all paths that hold the blob. Equal texts are combined
before the shuffle, so one text that many paths share costs one row a task.

The ledger names rules by kind and version; their order is that of the list a
reader gives, so lists may be reordered and grow between runs.

Only DataFrame expressions are used. Null texts count as empty. Very long texts
are scanned whole; the work grows with their length and, for one text, with its
findings, not with the square of either. Findings that start at the same place
stand in the order of the rules. Repeated rows and ids are rows of their own. An
empty table gives no rows and an empty ledger entry. Columns of the input are
carried through, but for one named as the column of findings, which is replaced;
helper names start with ``__``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import folds


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those with a shorter ``group`` than ``least`` are dropped.

    ``literal``: what every match holds. Texts without it are passed over.
    ``plain``: the pattern for engines without possessive loops and lookahead.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = False
    literal: str = ""
    plain: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values. Runs of at least the least length are asked for where that finds the same matches as dropping shorter ones.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True, literal="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
]
#: A private key from BEGIN to END. Without END, to the end of what looks like its body: header fields, long base64
#: or padded runs between spaces, line ends (escaped ones too), quotes or comment marks, and whole lines of any length.
#: All loops are possessive, so long bodies need no stack.
_END_OF_LINE = r"(?:\r?\n|(?:\\r)?\\n)"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_END_OF_LINE}[\x20\t]*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+"
    r"""|(?:[\s"'`,+#*>|]|\\[nrt])*+(?:[A-Za-z0-9+/=]{20,}+|[A-Za-z0-9+/]++=++(?![A-Za-z0-9]))"""
    rf"""|(?:[\x20\t]*+{_END_OF_LINE})++[\x20\t]*+[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n"'`]|\\[rn]|\z)))*+)"""
)
#: The same for a key with its END; without END, only lines of the long and the padded kind belong to it.
PEM_PLAIN = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_END_OF_LINE}[\x20\t]*(?:Proc-Type|DEK-Info):[^\r\n\\]*"
    r"""|(?:[\s"'`,+#*>|]|\\[nrt])*(?:[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/]+=+))*)"""
)
RULES = [
    *BASE_RULES,
    Rule("pem", PEM, version=2, literal="PRIVATE KEY-----", plain=PEM_PLAIN),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literal="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", literal="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", literal="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", literal="eyJ"),
]

SPAN = "struct<start:bigint,stop:bigint,rule:string>"
FINDINGS = "array<struct<start:bigint,rank:int,stop:bigint,rule:string>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points. What lies between matches gives their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(between, found, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("size")))

    def placed(pieces: Column) -> Column:
        before = folds.running(F.transform(pieces, lambda x: x["gap"] + x["size"]), F.lit(0).cast("long"), lambda a, b: a + b)
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), F.lit(rule.key).alias("rule"))
        return F.zip_with(pieces, before, span)

    spans = folds.let(F.slice(lengths, 1, F.size(found)), placed)
    if rule.least:
        groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        spans = F.filter(spans, lambda x, i: F.length(F.get(groups, i)) >= rule.least)
    has = F.contains(text, F.lit(rule.literal)) & text.rlike(rule.pattern) if rule.literal else text.rlike(rule.pattern)
    return F.when(has, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p)


LEDGER = f"blob string, rules array<string>, findings array<{SPAN}>"


def update_ledger(versions: DataFrame, ledger: str, *, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at path ``ledger`` lacks, append it, and return the whole ledger."""
    spark = versions.sparkSession
    keys = F.array(*(F.lit(r.key) for r in rules))
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if _exists(versions, ledger):
        seen = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
        seen = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    else:
        todo = keys
    blobs = blobs.withColumn("todo", todo).where(F.size("todo") > 0)
    found = [F.when(F.array_contains("todo", r.key), _spans(F.col("text"), r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules]
    new = blobs.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("findings"))
    new.write.option("compression", "zstd").parquet(f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}")
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)


def findings_of(ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``blob, findings`` of every blob in which the given rule versions found something; ranks are places in ``rules``."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    place = lambda x: (F.array_position(keys, x["rule"]) - 1).cast("int")
    mine = F.filter("findings", lambda x: F.array_contains(keys, x["rule"]))
    mine = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), place(x).alias("rank"), x["stop"].alias("stop"), x["rule"].alias("rule")))
    mine = ledger.select("blob", mine.alias("findings")).where(F.size("findings") > 0)
    every = mine.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("every"))
    once = F.filter("every", lambda x, i: (i == 0) | (x != F.get("every", i - 1)))  # two runs at the same time may both have scanned a blob
    return every.select("blob", once.alias("findings"))


def scan_versions(versions: DataFrame, ledger: str, *, text_col: str = "text", rules: list[Rule] = RULES, into: str = "findings") -> DataFrame:
    """The input's columns and ``into``: spans by start, then rule, in code points, end exclusive."""
    found = findings_of(update_ledger(versions, ledger, text_col=text_col, rules=rules), rules).select(F.col("blob").alias("__blob"), F.col("findings").alias("__found"))
    paths = versions.drop(into).withColumn("__blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    none = F.array().cast(FINDINGS)
    return paths.join(found, "__blob", "left").select(*(F.col(f"`{c}`") for c in versions.columns if c != into), F.coalesce("__found", none).alias(into))


def kind_of(x: Column) -> Column:
    return F.substring_index(x["rule"], "@", 1)


def count_of(findings: str, rule: Rule) -> Column:
    return F.size(F.filter(findings, lambda x: x["rule"] == rule.key)).cast("long")


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", kind_of(x), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(scanned: DataFrame, *, text_col: str = "text", findings: str = "findings") -> DataFrame:
    """Put ``[kind]`` in place of every finding in the text; overlapping ones share the first's. Drops ``findings``."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(f"`{findings}`")
    zero = F.lit(0).cast("long")
    stops = F.transform(spans, lambda x: x["stop"])

    def pieces(part) -> Column:
        one = lambda x, at: F.when(x["start"] >= at, F.concat(part(at, x["start"] - at), F.lit("["), kind_of(x), F.lit("]"))).otherwise("")
        tail = folds.let(F.array_max(stops), lambda at: part(at, F.length(text) - at))
        return F.concat(F.array_join(F.zip_with(spans, folds.running(stops, zero, lambda a, b: F.greatest(a, b)), one), ""), tail)

    clean = F.when(F.size(spans) > 0, folds.parts(text, F.size(spans), pieces)).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, clean).drop(findings)
