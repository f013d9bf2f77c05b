"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is named by the SHA-256 of its text.  The ledger is a folder with two
tables: which blobs have been scanned under which version of the rules, and what was found.  A scan takes the
distinct blobs that the ledger lacks for its rule version, reads the text of one path of each,
adds the findings and then the blobs to the ledger, and joins the findings of all blobs back to all
paths.  A run that fails in between leaves blobs unscanned, never scanned without findings; findings
added twice count once.

A rule is (kind, pattern, group, least): the matches of the pattern, leftmost and not overlapping,
whose group has at least so many characters.  Places are code points, the end excluded.  They come
from the lengths of the matches and of the text between them, summed along each text.

Nulls: a null text is an empty one; a null path is a path like any other.  Repeated rows get the same
findings.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Steps, exists, free_names

# The kinds every scan must find, in this order.
BASE_RULES = (
    (
        "assign",
        "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
# A private key runs from its BEGIN line to its END line, with no other such line between them.  Without an
# END it runs over header fields and base64 text to the last base64 line; the last lines may be short.  No
# repetition is bounded.  Those of groups are possessive, which the engine runs as loops, so it neither
# recurses over a long body nor tries a part of it twice.
_KEY_LINE = "(?:BEGIN|END) [A-Z\\x20]*PRIVATE KEY-----"
_KEY_END = f"(?:[^-]++|-(?!----{_KEY_LINE}))*+-----END [A-Z\\x20]*PRIVATE KEY-----"
_KEY_FIELDS = "(?:[\\x20\\t\\r\\n]*+[A-Z][A-Za-z]*+-[A-Za-z]++:(?:[^\\r\\n-]++|-(?!----))*+)*+"
_KEY_TEXT = "(?:[A-Za-z0-9+/=\\x20\\t\\r\\n\\x22\\x27\\x5c]*[A-Za-z0-9+/=]{16})?[A-Za-z0-9+/=]*"
_KEY_LINES = (
    "(?:[\\x20\\t]*[\\r\\n]++(?:[\\x20\\t]*+[A-Za-z0-9+/]++={0,2}+[\\x20\\t]*+(?:\\r?\\n|\\z))++)?"
)
# Forms of published key and token formats.
MORE_RULES = (
    (
        "private_key",
        f"-----BEGIN [A-Z\\x20]*PRIVATE KEY-----(?:{_KEY_END}|{_KEY_FIELDS}{_KEY_TEXT}{_KEY_LINES})",
        0,
        1,
    ),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 28),
)
RULES = BASE_RULES + MORE_RULES
REPLACEMENT = "[SECRET]"


def rule_version(rules=RULES) -> str:
    """A name that changes with any change of the rules."""
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _lengths(text: Column, rules) -> Column:
    """Per rule the lengths (text before a match, match, its group) of all matches, in order."""
    kinds = []
    for order, (_, pattern, group, least) in enumerate(rules):
        p = F.lit(pattern)
        matches = F.regexp_extract_all(text, p, F.lit(0))
        groups = F.regexp_extract_all(text, p, F.lit(group)) if group else matches
        size = lambda x: F.length(x)
        found = F.arrays_zip(
            F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), size).alias("before"),
            F.transform(matches, size).alias("match"),
            F.transform(groups, size).alias("group"),
        )
        none = F.array().cast("array<struct<before:int,match:int,group:int>>")
        kinds.append(
            F.struct(
                F.lit(order).alias("order"),
                F.lit(least).alias("least"),
                F.when(text.rlike(pattern), found).otherwise(none).alias("found"),
            )
        )
    return F.filter(F.array(*kinds), lambda k: F.size(k["found"]) > 0)


def find(texts: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind_order, start, end) of all findings in texts (blob, text)."""
    kinds = texts.select("blob", F.explode(_lengths(F.col("text"), rules)).alias("k"))
    each = kinds.select("blob", "k.order", "k.least", F.posexplode("k.found").alias("at", "m"))
    each = each.dropDuplicates(["blob", "order", "at"])  # a path may hold the same text in two rows
    along = Window.partitionBy("blob", "order").orderBy("at")
    before = F.sum("m.before").over(along.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.sum("m.match").over(along.rowsBetween(Window.unboundedPreceding, -1))
    start = (before + F.coalesce(earlier, F.lit(0))).cast("long")
    return (
        each.withColumn("start", start)
        .filter(F.col("m.group") >= F.col("least"))
        .select("blob", F.col("order").alias("kind_order"), "start", (F.col("start") + F.col("m.match")).alias("end"))
    )


def _ledger(steps: Steps, folder: str, table: str, schema: str) -> DataFrame:
    """A table of the ledger; one that isn't there is empty, one that can't be read is an error."""
    if exists(steps.spark, f"{folder}/{table}"):
        return steps.spark.read.schema(schema).parquet(f"{folder}/{table}")
    return steps.spark.createDataFrame([], schema)


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, blob, spans (array of kind, start, end; sorted).

    ``ledger`` is the folder that remembers scanned blobs; without one, the scan starts a new one.
    """
    steps = Steps(docs.sparkSession, "secrets")
    folder = ledger or f"{steps.folder}/ledger"
    version = rule_version(rules)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob(F.col("text")).alias("blob"))
    versions = steps.store(named, "versions")
    scanned = _ledger(steps, folder, "scanned", "blob string, rules string").filter(F.col("rules") == version)
    unseen = steps.store(
        versions.groupBy("blob").agg(F.min("doc_id").alias("path")).join(scanned, "blob", "left_anti"), "unseen"
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        blob(F.col("text")).alias("name"),
    )
    fresh = unseen.join(
        texts, (F.col("blob") == F.col("name")) & F.col("path").eqNullSafe(F.col("doc_id"))
    ).select("blob", "text")
    once = F.lit(version).alias("rules")
    find(fresh, rules).distinct().select("*", once).write.mode("append").parquet(f"{folder}/findings")
    unseen.select("blob", once).write.mode("append").parquet(f"{folder}/scanned")

    schema = "blob string, kind_order int, start long, end long, rules string"
    known = _ledger(steps, folder, "findings", schema).filter(F.col("rules") == version).drop("rules")
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    entry = F.struct("start", "kind_order", "end")
    found = steps.store(
        known.distinct()
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(entry)).alias("e"))
        .select(
            "blob",
            F.transform(
                "e", lambda x: F.struct(F.get(kinds, x["kind_order"]).alias("kind"), x["start"], x["end"])
            ).alias("spans"),
        ),
        "found",
    )
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return versions.join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", nothing).alias("spans")
    )


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _redacted(text: Column, spans: Column, replacement: str) -> Column:
    """The text with each run of overlapping spans replaced."""
    merge = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(-1))),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.get(done, F.size(done) - 1)["start"].alias("start"),
                        F.greatest(F.get(done, F.size(done) - 1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )

    def cut(runs: Column) -> Column:
        def kept(run: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(runs, i - 1)["end"], F.lit(0).cast("long"))
            return F.substring(text, (begin + 1).cast("int"), (run["start"] - begin).cast("int"))

        last = F.get(runs, F.size(runs) - 1)["end"]
        rest = F.substring(text, (last + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(runs, kept), replacement), F.lit(replacement), rest)

    return F.element_at(F.transform(F.array(merge), cut), 1)


def redact(docs: DataFrame, ledger: str | None = None, rules=RULES, replacement: str = REPLACEMENT) -> DataFrame:
    """``docs`` with the findings of a scan replaced in ``text``; all other columns stay.

    Only rows whose text matches a rule meet the findings; the others pass as they are.
    """
    name, other, spans = free_names(docs, "name", "blob", "spans")
    found = (
        scan(docs, ledger, rules)
        .filter(F.size("spans") > 0)
        .groupBy(F.col("blob").alias(other))
        .agg(F.first("spans").alias(spans))
    )
    found = Steps(docs.sparkSession, "redact").store(found, "found")
    suspect = F.coalesce(F.col("text").rlike("|".join(f"(?:{r[1]})" for r in rules)), F.lit(False))
    replaced = F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        _redacted(F.col("text"), F.col(spans), replacement)
    )
    hit = (
        docs.filter(suspect)
        .withColumn(name, blob(F.col("text")))
        .join(found, F.col(name) == F.col(other), "left")
        .withColumn("text", replaced)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
    return docs.filter(~suspect).unionByName(hit)
