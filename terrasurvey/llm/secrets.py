"""Secret scanning by an incremental ledger of blobs."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: name: (version, pattern, group whose length counts, least length, base rule). Order is the order of kinds at one place.
RULES = {
    "assign": (1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones needn't be matched to be dropped
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
    # what follows a run of token letters is looked at once for each run, so that time is linear in runs of nothing but the prefix
    "jwt": (2, r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?(?P<span>eyJ[A-Za-z0-9_-]{8,}+\..*?\.[A-Za-z0-9_-]+)", 0, 0),
    "forge": (1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    "userinfo": (1, r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s:/@]+:[^\s:/@]{3,}@", 0, 0),
}
BASE = ("assign", "access", "hex")

FINDINGS = "array<struct<kind:string,start:long,end:long>>"
#: A ledger's row: a blob, the rule versions that it was scanned by at one time, and what they found.
LEDGER = "blob string, rules array<string>, findings array<struct<rule:string,start:long,end:long>>"


def scan(text: str, rules: dict) -> list[dict]:
    """Spans of every rule in code points, by start, then in the rules' order. A span is the whole match, or its group `span` where there is one."""
    found = []
    for order, (kind, (_, pattern, group, least)) in enumerate(rules.items()):
        compiled = re.compile(pattern)
        span = compiled.groupindex.get("span", 0)
        for m in compiled.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(span), order, kind, m.end(span)))
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def rule_version(kind: str, rule: tuple) -> str:
    """A rule's name with a digest of all that decides what it finds: a changed rule is another version."""
    return f"{kind}@{hashlib.sha256(repr(rule[:4]).encode()).hexdigest()[:12]}"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_blobs(versions: DataFrame, ledger: DataFrame, rules: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of every version, the new ledger).

    versions: one row for each path and version of a text, with any key columns and `text`. A blob is a distinct text, named
    by its SHA-256. The ledger has which versions of which rules a blob was scanned by before, and what they found: only pairs of a blob and a
    rule version that it doesn't have are scanned, each once, so that a new rule runs alone over known blobs. Findings of the present
    rule versions are then joined back to all rows with this text (key columns, `blob`, `findings`: spans by start, then in the rules'
    order). Rows of one text, however many, go through the shuffle once for each task, not each row.

    Null text counts as empty and has no findings; very long texts are scanned whole; repeated rows keep their number; an empty
    table gives no rows; other columns stay, whatever their names, but `blob` and `findings` are replaced.

    The ledger is the caller's: write it as a table beside the corpus after each run and hand it to the next. Started from an empty one, every
    blob is scanned.
    """
    rules = rules or RULES
    named = {rule_version(kind, rule): kind for kind, rule in rules.items()}
    present = F.array(*map(F.lit, named))
    columns = [c for c in versions.columns if c.lower() not in ("blob", "findings", "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("body")).dropDuplicates(["blob"])
    known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))
    unseen = F.array_except(present, F.coalesce("known", F.array().cast("array<string>")))
    blobs = blobs.join(known, "blob", "left").select("blob", "body", unseen.alias("rules")).where(F.size("rules") > 0)

    def run(batches):
        for batch in batches:
            found = []
            for body, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = scan(body, {name: rules[named[name]] for name in wanted})
                found.append([{"rule": x["kind"], "start": x["start"], "end": x["end"]} for x in spans])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], ["blob", "rules", "findings"])

    book = ledger.unionByName(stored(blobs.mapInArrow(run, LEDGER)))
    # most blobs have no findings: only the others take part in the join
    blob, spans, order = fresh(columns, "blob_", "spans", "order")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("x.rule"))
    hits = book.select("blob", F.explode("findings").alias("x")).where(F.col("x.rule").isin(*named))
    place = F.array_position(present, F.col("x.rule"))
    hits = hits.groupBy(F.col("blob").alias(blob)).agg(F.sort_array(F.collect_list(F.struct(F.col("x.start").alias("start"), place.alias(order), F.col("x.end").alias("end"), kind.alias("kind")))).alias(spans))
    out = versions.select(*columns, F.sha2(text, 256).alias("blob")).join(hits, F.col("blob") == F.col(blob), "left")
    findings = F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(*columns, "blob", F.coalesce(findings, F.array().cast(FINDINGS)).alias("findings")), book


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_blobs(table(spark, sf_dir, "documents").select("doc_id", "text"), empty_ledger(spark))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))
