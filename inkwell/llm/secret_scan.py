"""Secret scan over a history of texts, kept up by a ledger of scanned blobs.

Every version of every path is content-addressed: its blob id is the SHA-256 of
its text, so copies, reverts and renames are one blob. The ledger is a Parquet
table with one row per scan of a blob: the rule versions applied and what they
found. A rule's version is a hash of its definition, so a changed rule is a new
one. A scan takes from the ledger what it holds, reads only texts of blobs that
some rule version has not seen, applies only the missing rules, appends what it
found, and joins findings back to all paths. A lost or repeated run leaves no
half-written rows, and rows that two runs both wrote agree.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import batch, join_spread, map_rows, stored
from inkwell.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, non-overlapping)
    whose ``group`` has at least ``least`` characters. Patterns are ASCII."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def version(self) -> str:
        told = repr((self.kind, self.pattern, self.group, self.least, self.ignore_case))
        return f"{self.kind}@{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]

    def compile(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: Fixed patterns and lengths of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # runs of 16 and more: shorter ones would be dropped, and a run is never cut
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)

#: Further kinds: key blocks, signed tokens, credentials in addresses, authorisation headers.
MORE = (
    Rule("key_block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("signed_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@'\"]{1,100}:[^\s/@'\"]{3,100}@[A-Za-z0-9]"),
    Rule("bearer", r"\bBearer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)
RULES = (*BASE, *MORE)

#: One row per scan of a blob: the rule versions applied, and what they found.
LEDGER_SCHEMA = "blob binary, rules array<string>, found array<struct<rule: string, start: long, end: long>>"


def blob_id(text: str = "text") -> Column:
    """SHA-256 of a text (null: of the empty one), 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def new_ledger(spark: SparkSession) -> str:
    """A place for an empty ledger in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/inkwell-secret-ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The scans so far; none where there is no ledger yet. A pair of blob and
    rule version that two runs scanned stands twice, with equal findings."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def _scan(rules: tuple[Rule, ...]):
    found = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"blob": pa.binary(), "rules": pa.list_(pa.string()), "found": found}

    def run(batches):
        ready = {r.version: (r, r.compile()) for r in rules}
        for rb in batches:
            spans = []
            for text, missing in zip(rb.column("text").to_pylist(), rb.column("missing").to_pylist()):
                hits = ((v, span) for v in missing for span in ready[v][0].spans(text or "", ready[v][1]))
                spans.append([{"rule": v, "start": a, "end": b} for v, (a, b) in hits])
            yield batch(kinds, {"blob": rb.column("blob"), "rules": rb.column("missing"), "found": spans})

    return run


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, address: list[str] | None = None) -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks, append it, and return the rows
    of ``versions`` as (the ``address`` columns, blob), without their texts.

    ``address`` names the columns that tell one version from another (all but
    text unless given). One row of each unseen blob is read, the first by a
    hash of its address.
    """
    spark = versions.sparkSession
    address = [c for c in versions.columns if c != "text"] if address is None else address
    here = versions.select(F.struct(*address).alias("_at") if address else F.lit(0).alias("_at"), blob_id().alias("blob"), "text")
    here = here.withColumn("_row", F.xxhash64(F.to_json(F.struct("_at"))))
    paths = stored(here.drop("text"), "blobs")

    wanted = F.array(*[F.lit(r.version) for r in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    unseen = paths.groupBy("blob").agg(F.min("_row").alias("_row")).join(seen, "blob", "left")
    missing = F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))
    unseen = unseen.select("blob", "_row", missing.alias("missing")).filter(F.size("missing") > 0)
    # texts are only read once more where they are to be scanned, and not sorted for it
    texts = here.select("blob", "_row", "text").join(unseen.hint("shuffle_hash"), ["blob", "_row"])
    map_rows(texts.select("blob", "text", "missing"), _scan(rules), LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    return paths


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, address: list[str] | None = None) -> DataFrame:
    """The rows of ``versions`` as (``address`` columns, blob, spans): spans is
    an array of (start, rule, end), rule by its place in ``rules``, in code
    points, ends exclusive, sorted.

    Null texts are empty ones. Rows that repeat are each returned. Empty tables
    give no rows and leave the ledger as it is.
    """
    paths = update_ledger(versions, ledger, rules, address)
    number = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
    hit = read_ledger(versions.sparkSession, ledger).filter(F.size("found") > 0).select("blob", F.explode("found").alias("f"))
    span = F.struct(F.col("f.start").alias("start"), number[F.col("f.rule")].alias("rule"), F.col("f.end").alias("end"))
    hit = hit.filter(F.col("f.rule").isin([r.version for r in rules])).select("blob", span.alias("span"))
    held = hit.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    out = join_spread(paths, held, ["blob"], F.col("_row"))
    none = F.array().cast("array<struct<start: long, rule: int, end: long>>")
    return out.select("_at", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rule"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per row: doc_id, a count per base kind, base_sha256, spans, blob.

    Documents are versions whose path is doc_id. ``rules`` come on top of the
    base kinds. Without a ``ledger`` a new one is begun in the checkpoint
    folder. Null and empty texts have no spans. Only doc_id and text are read.
    """
    every = (*BASE, *rules)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = findings(d, ledger or new_ledger(docs.sparkSession), every)
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["rule"])
    count = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(F.col("_at.doc_id").alias("doc_id"), *count, F.sha2(joined(base, every), 256).alias("base_sha256"), joined(F.col("spans"), every).alias("spans"), "blob")
