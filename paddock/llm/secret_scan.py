"""Secret scans that read each version of a text once per rule version.

A *blob* is a text named by its SHA-256.  The ledger is a table of blobs, the rule versions
each was scanned with, and what they found.  A scan names the blobs of all paths, asks the
ledger which (blob, rule version) pairs it lacks, reads only those texts, one copy of each,
appends what it finds, and joins the ledger back to every path that holds a blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import scratch_path

FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob binary, scanned array<string>, found {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; those whose ``group`` is shorter than ``least`` are dropped.

    ``hints``: a text without any of them (in lower case) is not searched.
    """

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The first three rules are given; the rest name well-known token formats.
RULES = (
    Rule(
        "assign", 1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII, 2, 6, ("password", "passwd", "secret", "token", "api"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    # Up to the matching END line, else over the header and base64 lines that follow.
    Rule(
        "private_key", 2,
        r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END \1PRIVATE KEY-----"
        r"|(?:\s*(?:\\[rn])*[A-Za-z-]++:\x20[^\r\n]*+(?=[\r\n]))*+"
        r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+)*+(?:(?:(?<=[A-Za-z0-9+/=]{40})(?:\s|\\[rn])++)[A-Za-z0-9+/=]++(?=\s|\\|\Z))?)",
        hints=("private key",),
    ),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", hints=("eyj",)),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]++@", hints=("://",)),
)
BASE = ("assign", "access", "hex")


def _scanner(rules: tuple[Rule, ...]) -> Callable[[str, list[str]], list[tuple[int, int, int, str]]]:
    compiled = [(rank, rule, re.compile(rule.pattern, rule.flags)) for rank, rule in enumerate(rules)]

    def scan(text: str, missing: list[str]) -> list[tuple[int, int, int, str]]:
        low = text.lower()
        found = []
        for rank, rule, pattern in compiled:
            if rule.name not in missing or rule.hints and not any(hint in low for hint in rule.hints):
                continue
            for match in pattern.finditer(text):
                if match.end(rule.group) - match.start(rule.group) >= rule.least:
                    found.append((match.start(), rank, match.end(), rule.kind))
        return sorted(found)

    return scan


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if none was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...], key: str, text: str) -> None:
    """Scan what the ledger lacks and append it; a lost job leaves the ledger as it was."""
    spark = docs.sparkSession
    wanted = F.array(*(F.lit(rule.name) for rule in rules))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"))
    # One path of each blob carries its text.
    carriers = (
        docs.select(F.col(key).alias("carrier"), _blob(text).alias("blob"))
        .groupBy("blob")
        .agg(F.min("carrier").alias("carrier"))
        .join(seen, "blob", "left")
        .withColumn("missing", F.array_except(wanted, F.coalesce("scanned", F.array().cast("array<string>"))))
        .where(F.size("missing") > 0)
        .drop("scanned")
    )
    texts = docs.select(F.col(key).alias("path"), F.coalesce(text, F.lit("")).alias("text")).withColumn("name", _blob("text"))
    unseen = texts.join(
        carriers.hint("shuffle_hash"),
        texts["path"].eqNullSafe(carriers["carrier"]) & (texts["name"] == carriers["blob"]),
    ).select("blob", "missing", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            missing = batch.column(1).to_pylist()
            found = [
                [dict(zip(("start", "rank", "end", "kind"), span)) for span in scan(x.as_py(), names)]
                for x, names in zip(batch.column(2), missing)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, kind)], names=["blob", "scanned", "found"]
            )

    unseen.mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def _blob(text: str):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_secrets(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``findings``: spans (start, rank of the rule, end, kind) by start, then rule.

    Offsets are code points, ends exclusive.  ``ledger`` is the folder of the ledger (a new
    one in the shared work folder if not given); what it holds for these rule versions is
    not scanned again.  Null text: empty, nothing found.  Repeated rows and null keys each
    keep their row.  An input column ``findings`` is replaced.
    """
    ledger = ledger or scratch_path(docs.sparkSession, "blob-ledger")
    docs = docs.drop("findings")
    update_ledger(docs, ledger, rules, key, text)
    kinds = {rule.kind: rank for rank, rule in enumerate(rules)}
    current = F.array(*(F.lit(rule.name) for rule in rules))
    # A row holds the findings of its own scan; other versions of a rule are left out.
    found = (
        read_ledger(docs.sparkSession, ledger)
        .where(F.arrays_overlap("scanned", current))
        .withColumn("kinds", F.transform(F.array_intersect("scanned", current), lambda x: F.split_part(x, F.lit("@"), F.lit(1))))
        .withColumn("found", F.filter("found", lambda x: F.array_contains(F.col("kinds"), x["kind"])))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
    )
    rank = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return (
        docs.withColumn("__blob", _blob(text))
        .join(found.withColumnRenamed("blob", "__blob"), "__blob", "left")
        .withColumn(
            "findings",
            F.array_sort(F.array_distinct(F.transform(
                F.coalesce("found", F.array().cast(FINDINGS)),
                lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["kind"]).alias("rank"),
                                   x["end"].alias("end"), x["kind"].alias("kind")),
            ))),
        )
        .drop("__blob", "found")
    )


def redacted(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` with every found span of ``text`` replaced by ``mark``, without ``findings``.

    Overlapping spans become one mark.
    """
    names = scanned.columns
    at, spans = names.index(text), names.index("findings")

    def run(batches):
        for batch in batches:
            texts = []
            for value, found in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist()):
                if found:
                    parts, last = [], 0
                    for span in found:
                        if span["start"] >= last:
                            parts += [value[last : span["start"]], mark]
                        last = max(last, span["end"])
                    value = "".join(parts) + value[last:]
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(columns) if i != spans], names=[n for i, n in enumerate(names) if i != spans]
            )

    return scanned.mapInArrow(run, scanned.drop("findings").schema)


def op8(docs: DataFrame) -> DataFrame:
    """Counts and digests of the findings of :func:`scan_secrets`."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    def of(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    # Only the digest leaves the join, so the texts are named before it and dropped.
    scanned = scan_secrets(docs.select("doc_id", "text"))
    return scanned.select(
        "doc_id", *(of(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )
