"""Secret scans through a ledger of contents: each content meets each version of a rule once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strom.llm.shared import salted_lookup


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` are kept if group ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# fixed values: kinds and patterns the contract names; the last two are added
ASSIGN = (
    "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE_RULES = (Rule("assign", 1, ASSIGN, 2, 12), Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18), Rule("hex", 1, "[0-9a-f]{16,}", 0, 16))
RULES = (*BASE_RULES, Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), Rule("hosted", 1, "gh[oprsu]_[A-Za-z0-9]+", 0, 36))
SCANS = "blob string, rules array<string>, found array<struct<rule:string,start:int,end:int>>"


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _located(rule: Rule, parts: str, whole: str, value: str) -> Column:
    """Code point spans: the lengths of what lies between the matches and of the matches add up."""
    steps = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("gap"), F.col(whole).alias("whole"), F.col(value).alias("value"))
    empty = F.expr("named_struct('at', 0, 'found', cast(array() as array<struct<rule:string,start:int,end:int>>))")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        hit = F.array(F.struct(F.lit(rule.key).alias("rule"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(state["found"], hit)).otherwise(state["found"]).alias("found"))

    return F.aggregate(steps, empty, step, lambda state: state["found"])


def scan_contents(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text, todo: keys of rules not yet run) as rows of the ledger."""
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int>>)")
    frame, located = blobs, []
    for i, rule in enumerate(rules):
        pattern, wanted = F.lit(rule.pattern), F.array_contains("todo", rule.key)
        frame = frame.withColumns({
            f"_w{i}": F.when(wanted, F.regexp_extract_all("text", pattern, 0)),
            f"_v{i}": F.when(wanted, F.regexp_extract_all("text", pattern, rule.group)) if rule.group else F.lit(None),
        })
    for i, rule in enumerate(rules):
        any_hit = F.coalesce(F.size(f"_w{i}") > 0, F.lit(False))
        frame = frame.withColumn(f"_p{i}", F.when(any_hit, F.split("text", rule.pattern, -1)))
        found = _located(rule, f"_p{i}", f"_w{i}", f"_v{i}" if rule.group else f"_w{i}")
        located.append(F.when(any_hit, found).otherwise(none))
    return frame.select("blob", F.col("todo").alias("rules"), F.concat(*located).alias("found"))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Findings of every version of every path; only contents and rules that the ledger has not paired yet are scanned.

    A content is known by its SHA-256. One row per distinct content is kept (combined before the shuffle), rules already in the
    ledger are taken off, the rest is scanned whole and appended to ``ledger`` in one write: its rows say what was scanned as
    well as what was found, so a job that dies before its commit leaves nothing and is simply run again. Findings then meet
    all paths by salted look-up, as one content may be in a third of them.

    Columns: id, blob, found (rule, start, end; code points). Null text is empty, repeated rows give a row each.
    """
    spark = versions.sparkSession
    keys = [r.key for r in rules]
    text = F.coalesce(F.col(text_column), F.lit(""))
    contents = versions.select(content_address(F.col(text_column)).alias("blob"), text.alias("text")).distinct()
    known = read_ledger(spark, ledger)
    if known is None:
        todo = contents.withColumn("todo", F.array(*map(F.lit, keys)))
    else:
        seen = known.select("blob", F.explode("rules").alias("_rule")).groupBy("blob").agg(F.collect_set("_rule").alias("_seen"))
        left = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("_seen", F.array().cast("array<string>")))
        todo = contents.join(seen, "blob", "left").withColumn("todo", left).drop("_seen").where(F.size("todo") > 0)
    scan_contents(todo, rules).write.mode("append").parquet(ledger)
    hits = read_ledger(spark, ledger).select("blob", F.explode("found").alias("_f")).where(F.col("_f.rule").isin(keys)).distinct()
    per_blob = hits.groupBy("blob").agg(F.collect_list("_f").alias("found"))
    paths = versions.select(F.col(id_column), content_address(F.col(text_column)).alias("blob"))
    none = F.expr("cast(array() as array<struct<rule:string,start:int,end:int>>)")
    joined = salted_lookup(paths, per_blob, ["blob"], F.col(id_column))
    return joined.select(id_column, "blob", F.coalesce("found", none).alias("found"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger so far, or None if nothing was ever written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(SCANS).parquet(ledger)


def new_ledger(root: str) -> str:
    return f"{root}/secret-ledger-{uuid.uuid4().hex}"


def span_digests(found: DataFrame, id_column: str = "doc_id", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.key) for r in rules])
    numbered = F.transform("found", lambda f: F.struct(
        f["start"].alias("start"), F.array_position(kinds, f["rule"]).alias("kind"), f["end"].alias("end"), F.split_part(f["rule"], F.lit("@"), F.lit(1)).alias("name")))
    frame = found.select(id_column, F.array_sort(numbered).alias("_all"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["name"], f["start"], f["end"])), ",")

    def counted(rule: Rule) -> Column:
        return F.size(F.filter("_all", lambda f: f["name"] == rule.kind)).cast("bigint").alias(f"n_{rule.kind}")

    own = F.filter("_all", lambda f: f["kind"] <= len(base))
    return frame.select(id_column, *map(counted, base), F.sha2(told(own), 256).alias("base_sha256"), told(F.col("_all")).alias("spans"))
