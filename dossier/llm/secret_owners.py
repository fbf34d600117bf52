"""Secrets in texts, and who owns them across the corpus.

Candidates are found in whole texts. Their hashes are counted by distinct repositories and distinct owners over
all rows: a value that many owners have is a copied example, one that a single owner has looks live. That count decides the
spans the method adds: opaque strings outside the base kinds join the spans where one owner alone has them. All opaque
strings are listed apart with their class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import text_slices
from dossier.session import stage

#: The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "opaque")

#: A run that mixes capitals, small letters and digits like a generated key does.
OPAQUE = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{28,}(?![A-Za-z0-9_-])")
OPAQUE_PARTS = (re.compile(r"[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]"), re.compile(r"[a-z][^a-z]*[a-z][^a-z]*[a-z]"), re.compile(r"[0-9][^0-9]*[0-9][^0-9]*[0-9]"))
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OWNERS_OF_EXAMPLE = 3


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, sorted. A run of small hex digits of the full length is what a greedy match of any length finds."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Generated-looking runs that no base span touches; one sweep over both, as both come by start."""
    found, at, reach = [], 0, 0
    for m in OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and all(p.search(m[0]) for p in OPAQUE_PARTS):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.string())]))
    for batch in batches:
        for piece in text_slices(batch, "text"):
            spans, digests = [], []
            for text in piece.column("text").to_pylist():
                base = base_spans(text or "")
                every = sorted(base + opaque_spans(text or "", base))
                spans.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for s, k, e, v in every])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "owner": piece.column("owner"), "repository": piece.column("repository"), "spans": pa.array(spans, kind), "base_sha256": pa.array(digests, pa.string())})


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners over (hash, owner, repository) rows. Copies are combined before each shuffle; a null owner or repository counts as one of its own."""
    one = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    places = found.select("hash", one("owner").alias("owner"), one("repository").alias("repository")).distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    # A repository name is taken within its owner.
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, owners_of_example: int = OWNERS_OF_EXAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_owned, n_shared, opaque_spans for every row of ``docs``.

    ``spans`` joins kind:start:end of all spans by start, then kind; base spans always stay, opaque ones where one owner has
    the value. ``opaque_spans`` joins class:start:end of every opaque span, whatever its class. Base spans count as n_example with ``owners_of_example`` owners or more, as n_owned with one, else as n_shared;
    the classes of opaque spans are example, owned and shared by the same bounds.
    Offsets are code points, ends exclusive. Null and empty texts have no spans and the hash of the empty string. Repeated
    rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col("text").cast("string").alias("text"))
    span = "array<struct<start:bigint,kind:int,end:bigint,hash:string>>"
    scanned = stage(source.mapInArrow(_scan, f"doc_id long, owner string, repository string, spans {span}, base_sha256 string").withColumn("_row", F.monotonically_increasing_id()))
    flat = scanned.filter("size(spans) > 0").select("_row", "owner", "repository", F.explode("spans").alias("s")).select("_row", "owner", "repository", "s.*")
    known = stage(ownership(flat))
    judged = flat.select("_row", "start", "kind", "end", "hash").join(known, "hash")
    names = F.array(*[F.lit(k) for k in KINDS])
    keep = (F.col("kind") < 3) | (F.col("n_owners") == 1)
    label = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    base = F.col("kind") < 3
    kind = F.when(F.col("n_owners") >= owners_of_example, "example").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    classed = F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string"))
    per_row = judged.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("start", "kind", label.alias("label"))))).alias("labels"),
        F.array_sort(F.collect_list(F.when(~base, F.struct("start", "kind", classed.alias("label"))))).alias("opaque"),
        count(base & (F.col("n_owners") >= owners_of_example)).alias("n_example"),
        count(base & (F.col("n_owners") == 1)).alias("n_owned"),
        count(base & (F.col("n_owners") > 1) & (F.col("n_owners") < owners_of_example)).alias("n_shared"),
    )
    columns = ["doc_id", "spans", "base_sha256", "labels", "n_example", "n_owned", "n_shared", "opaque"]
    some = scanned.filter("size(spans) > 0").join(per_row, "_row").select(*columns)
    none = scanned.filter("size(spans) = 0").select("doc_id", "spans", "base_sha256", *[F.lit(None).cast(per_row.schema[c].dataType).alias(c) for c in columns[3:]])
    joined = some.union(none)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["label"]), ","), F.lit(""))
    return joined.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), "base_sha256", text("labels").alias("spans"), zero("n_example"), zero("n_owned"), zero("n_shared"), text("opaque").alias("opaque_spans"))
