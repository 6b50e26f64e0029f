"""Secret scan over an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger holds, for each (blob, rule version) ever
scanned, its findings. A scan hashes the given versions, sends each unseen blob once to a task that runs the rules, appends
the findings to the ledger, and joins the ledger back to all paths. Blobs travel compressed and are dropped early where a
partition holds several copies, so a text that a third of all paths share crosses the shuffle once per partition at most.

Defined cases: null texts are empty blobs; a very long text is one blob, scanned whole; repeated paths each get their row; spans
that start together go by kind, then by end; a blob that is in the ledger twice counts once; an empty table gives an empty
result; other columns, whatever their names, are ignored or kept as they are. Spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookupforge.llm.common import bound_batches, fresh, new_dir, table, tidy

RULE_VERSION = "1"
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: Base patterns. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What this method adds: private key blocks, signed web tokens, credentials in URLs, known token prefixes.
EXTRA = (
    ("pem", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url", "://", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/@]{3,100}@")),
    ("prefix", "_", re.compile(r"\b(?:gh[pousr]|sk_live|sk_test|xox[abp])[_-][A-Za-z0-9-]{16,}")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in EXTRA))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings in order of start, then of kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def all_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    more = [(kind, *m.span()) for kind, hint, pat in EXTRA if hint in text for m in pat.finditer(text)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if more else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sha, compressed bytes), each blob once per partition."""
    seen: set[bytes] = set()
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        sha, blob = [], []
        for t in b.column(0).to_pylist():
            raw = (t or "").encode()
            d = hashlib.sha256(raw).digest()
            if d not in seen:
                seen.add(d)
                sha.append(d)
                blob.append(press.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(blob, pa.binary())], names=["sha", "blob"])
    tidy()


_LEDGER = "sha binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch], version: str) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for sha, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if sha in seen:
                continue
            seen.add(sha)
            text = zstandard.ZstdDecompressor().decompress(blob.as_py()).decode()
            base = base_spans(text)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            for col, x in zip(out, (sha, version, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base))), strict=True):
                col.append(x)
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _LEDGER.split(", ")])
    tidy()


def ledger_entries(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """One entry for each blob: an append that was tried again may have left several, which are alike."""
    rows = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version)
    return rows.drop("rule_version").dropDuplicates(["sha"])


def scan_versions(docs: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION, fresh: bool = False) -> DataFrame:
    """Scan what the ledger (a folder that all executors share) lacks, add it there, and return one row for each path.

    ``fresh``: the ledger folder is known to be new. Columns: path, sha, n_assign, n_access, n_hex, base_sha256, spans.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    paths = docs.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("sha"))
    blobs = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_blobs, "sha binary, blob binary")
    if not fresh:
        known = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version).select("sha")
        blobs = blobs.join(known, "sha", "left_anti")
    found = blobs.repartition("sha").mapInArrow(lambda it: _scan(it, rule_version), _LEDGER)
    found.write.mode("append").parquet(ledger)
    entries = ledger_entries(spark, ledger, rule_version)
    return paths.join(entries, "sha", "left").withColumnRenamed("path", path)


def _redact(text: str, spans: str) -> str:
    """Each run of overlapping spans becomes [secret]."""
    at, out = 0, []
    for x in spans.split(","):
        _, a, z = x.rsplit(":", 2)
        a, z = int(a), int(z)
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def _rewrite(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column(b.num_columns - 1).to_pylist()
        if any(spans):
            texts = [_redact(t, s) if s and t else t for t, s in zip(b.column(at).to_pylist(), spans, strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
        yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1]))
    tidy()


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with every found secret replaced; all rows and columns stay, ``n_chars`` follows where it exists.

    The scan goes through a new ledger; only the texts with findings are looked up again, by their SHA-256.
    """
    spark = docs.sparkSession
    ledger = new_dir(spark, "secret-ledger")
    scan_versions(docs, ledger, docs.columns[0], text, fresh=True)
    sha, found = fresh(docs, "sha"), fresh(docs, "spans")
    hits = ledger_entries(spark, ledger).where("spans <> ''").select(F.col("sha").alias(sha), F.col("spans").alias(found))
    keyed = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    both = keyed.join(hits, sha, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    at = docs.columns.index(text)
    out = both.mapInArrow(lambda it: _rewrite(it, at), docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out


def op4_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, new_dir(spark, "secret-ledger"), fresh=True)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
