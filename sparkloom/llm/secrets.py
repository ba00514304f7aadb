"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger keeps, for each
blob and rule version, what was found (empty findings included). A scan reads only the blobs that
the ledger lacks under the present rules, appends them, and joins findings back to every path that
holds the blob.

Texts aren't shuffled: of each unseen blob one row is chosen, and the chosen rows' hashes set bits of a bitmap of at most
2 ** MAX_BITS bits, which is broadcast; a row whose bit is set is scanned where it is read. A bit that is set by chance costs
a scan and no more, since findings are made unique by blob before they are appended.

Null text is the empty blob, with its path's row kept. Repeated rows and copies share one blob and
one scan; each row gets the findings. Null paths are paths like others. Texts are scanned whole,
whatever their length. An empty table gives an empty result. Other columns are carried untouched;
the added columns are given names that no column of the input has, see `scan`."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import cut, new_path, numbered

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "forge", "chat")

#: kind -> (pattern, group that must be long enough, its least length). The first three are the base.
RULES = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
}
BASE = ("assign", "access", "hex")

#: A change of any rule is a new version, which scans all blobs anew.
RULE_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

#: A match of this many characters stands for any run that is long enough: a run of one class is
#: matched whole or not at all, so short ones need not be made into matches first.
_FAST = {k: re.compile(p) for k, (p, _, _) in RULES.items()} | {"hex": re.compile(r"[0-9a-f]{16,}"), "access": re.compile(r"AKIA[A-Z0-9]{14,}")}
#: Without one of these in it, a text can't match the rule.
_NEEDS = {"access": "AKIA", "jwt": "eyJ", "pem": "PRIVATE KEY-----", "forge": "gh", "chat": "xox"}


def find(text: str) -> list[dict]:
    """All findings in a text, by start and then kind as listed; code points, end exclusive."""
    out = []
    for rank, kind in enumerate(KINDS):
        if kind in _NEEDS and _NEEDS[kind] not in text:
            continue
        _, group, least = RULES[kind]
        out += [(m.start(), rank, m.end()) for m in _FAST[kind].finditer(text) if m.end(group) - m.start(group) >= least]
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(out)]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([find(t.as_py() or "") for t in b.column("text")], _ARROW_FINDINGS)
        yield pa.RecordBatch.from_arrays([b.column("blob"), found], ["blob", "findings"])


class Ledger:
    """A Parquet table (blob, rule_version, findings) at a path that all executors reach.
    Appends are whole or not at all; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def read(self, version: str = RULE_VERSION) -> DataFrame:
        schema = f"blob binary, rule_version string, findings {FINDINGS}"
        jvm, path = self.spark._jvm, self.path
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).where(F.col("rule_version") == version)

    def append(self, findings: DataFrame, version: str = RULE_VERSION) -> None:
        findings.select("blob", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(self.path)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


#: Bits of the greatest bitmap, as a power of two: 2**20 rows of a word and its place, some 40 MB. Bits for each chosen row.
MAX_BITS, BITS_A_ROW = 26, 16


def _bitmap(chosen: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(word, bits) with the bit of each row of chosen (path, blob), n of them, set; and the power of two of bits."""
    power = min(MAX_BITS, max(10, math.ceil(math.log2(max(1, n) * BITS_A_ROW))))
    bit = _bit(power)
    return chosen.select((bit / 64).cast("int").alias("word"), _one(bit).alias("set")).groupBy("word").agg(F.bit_or("set").alias("set")), power


def _bit(power: int) -> Column:
    return F.pmod(F.xxhash64("path", "blob"), F.lit(1 << power))


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def update(ledger: Ledger, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan the blobs of docs that the ledger lacks; return (key, blob) of every row."""
    paths = cut(docs.select(F.col(key).alias("path"), blob_of(F.col(text)).alias("blob")))
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = cut(first.join(ledger.read().select("blob"), "blob", "left_anti"))
    n = unseen.count()
    if not n:
        return paths
    marks, power = _bitmap(unseen, n)
    marks = F.broadcast(cut(marks).select(F.col("word").alias("__word"), F.col("set").alias("__set")))
    texts = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    texts = texts.withColumn("bit", _bit(power)).withColumn("word", (F.col("bit") / 64).cast("int"))
    some = texts.join(marks, (F.col("word") == F.col("__word")) & (F.col("__set").bitwiseAND(_one(F.col("bit"))) != 0), "left_semi")
    found = some.select("blob", "text").transform(map_arrow, _scan_batches, f"blob binary, findings {FINDINGS}")
    # rows that fell on a bit by chance, and rows that repeat as a whole, go here
    ledger.append(found.groupBy("blob").agg(F.first("findings").alias("findings")).join(unseen.select("blob"), "blob", "left_semi"))
    return paths


def scan(docs: DataFrame, ledger: Ledger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: (key, findings). The ledger is brought up to date first."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = update(ledger, docs, key, text)
    some = ledger.read().where(F.size("findings") > 0).select("blob", "findings")
    none = F.array().cast(FINDINGS)
    return paths.join(some, "blob", "left").select(F.col("path").alias(key), F.coalesce("findings", none).alias("findings"))


def spans_of(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


MASK = "[SECRET]"


def mask(text: str, findings: list[dict]) -> str:
    """The text with every span (overlapping ones together) replaced by MASK."""
    out, at, upto = [], 0, -1
    for f in sorted(findings, key=lambda f: (f["start"], f["end"])):
        if f["start"] >= upto:
            out += [text[at : f["start"]], MASK]
        upto = max(upto, f["end"])
        at = upto
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ledger: Ledger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all findings masked in their texts; rows, columns (whatever their names) and null texts stay.

    Findings are sorted by start, so a fold over them leaves the stretches to mask, overlapping ones together, and
    what stands between them is put together in the JVM."""
    ledger = ledger or Ledger(docs.sparkSession)
    update(ledger, docs, key, text)
    some = ledger.read().where(F.size("findings") > 0).select(F.col("blob").alias("__blob"), _stretches(F.col("findings")).alias("__masks"))
    at = f"c{docs.columns.index(text)}"
    joined = numbered(docs).join(some, blob_of(F.col(at)) == F.col("__blob"), "left")
    masks = F.col("__masks")
    between = F.transform(masks, lambda m, i: F.concat(F.substring(F.col(at), F.coalesce(F.get(masks, i - 1)["end"], F.lit(0)) + 1, m["start"] - F.coalesce(F.get(masks, i - 1)["end"], F.lit(0))), F.lit(MASK)))
    clean = F.when(masks.isNull(), F.col(at)).otherwise(F.concat(F.array_join(between, ""), F.substring(F.col(at), F.element_at(masks, -1)["end"] + 1, F.length(at))))
    return joined.select(*[(clean if f"c{i}" == at else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)


def _stretches(findings: Column) -> Column:
    """(start, end) of findings by start, those that overlap as one."""
    spans = F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, f: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))
        return F.when((F.size(done) == 0) | (f["start"] >= last["end"]), F.concat(done, F.array(f))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(spans, none, add)
