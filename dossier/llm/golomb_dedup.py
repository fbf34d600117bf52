"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Every task fingerprints its rows and sends each owner of a hash range one block: its sorted distinct hashes as Golomb-Rice
coded gaps. An owner decodes its blocks and answers with one bitmap per block, a bit for each hash that another task has
as well. Rows under a set bit, or whose hash their own task has twice, are suspects; only texts with a suspect's
fingerprint are grouped, by their bytes. All other rows are known to be alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, partitions, probably_in
from dossier.session import stage

FLUSH_BITS = 20


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as a head (count, remainder bits, first value) and two bit streams: unary quotients, fixed-width remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=values[:1])
    mean = max(int(values[-1] - values[0]) // max(n - 1, 1), 1)
    k = max(mean.bit_length() - 1, 0)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    rest = (gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)
    low = np.unpackbits(rest, axis=1)[:, 64 - k :] if k else np.empty((n, 0), np.uint8)
    head = np.array([n, k, len(unary)], "<u4").tobytes() + values[:1].astype("<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(block: bytes) -> np.ndarray:
    n, k, length = (int(x) for x in np.frombuffer(block, "<u4", 3))
    first = np.frombuffer(block, "<u8", 1, 12)[0]
    ends = 20 + (length + 7) // 8
    unary = np.unpackbits(np.frombuffer(block, np.uint8, ends - 20, 20), count=length)
    stops = np.flatnonzero(unary)
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=ends), count=n * k).reshape(n, k)
        wide = np.zeros((n, 64), np.uint8)
        wide[:, 64 - k :] = bits
        gaps = (gaps << np.uint64(k)) | np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps) + first


def _send(owners: int):
    """(doc_id, h, sha) batches -> a row for each (kind 0) and a coded block for each owner (kind 1)."""

    def flush(source: int, ids: list, hashes: list, shas: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes).view(np.uint64)
        n = len(h)
        values, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        owner = ((values >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rank = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
        rows = pa.table({"kind": np.zeros(n, np.int64), "source": np.full(n, source), "owner": owner[inverse], "doc_id": pa.chunked_array(ids), "h": h.view(np.int64), "sha": pa.chunked_array(shas), "rank": rank[inverse], "twice": times[inverse] > 1, "row": (source << FLUSH_BITS) + np.arange(n)})
        blocks = [golomb_encode(values[a:b]) for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]
        m = len(blocks)
        none = lambda kind: pa.nulls(m, kind)
        coded = pa.table({"kind": np.ones(m, np.int64), "source": np.full(m, source), "owner": owner[starts], "doc_id": none(pa.int64()), "h": none(pa.int64()), "sha": pa.array(blocks, pa.binary()), "rank": none(pa.int64()), "twice": none(pa.bool_()), "row": none(pa.int64())})
        yield from rows.to_batches(max_chunksize=50_000)
        yield from coded.to_batches(max_chunksize=1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushes, count = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if count and count + batch.num_rows > 1 << FLUSH_BITS:
                yield from flush((part << 20) + flushes, *held)
                held, count, flushes = ([], [], []), 0, flushes + 1
            held[0].append(batch.column("doc_id"))
            held[1].append(batch.column("h").to_numpy())
            held[2].append(batch.column("sha"))
            count += batch.num_rows
        if count:
            yield from flush((part << 20) + flushes, *held)
        del held
        give_back()

    return run


def _answer(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """One owner's blocks -> a bitmap for each block that holds a hash of another block."""
    lists = [golomb_decode(b) for b in blocks["sha"]]
    values = np.concatenate(lists)
    _, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    ends = np.cumsum([len(x) for x in lists])
    maps = [shared[e - len(x) : e] for x, e in zip(lists, ends, strict=True)]
    found = [(s, np.packbits(m, bitorder="little").tobytes()) for s, m in zip(blocks["source"], maps, strict=True) if m.any()]
    return pd.DataFrame({"source": [f[0] for f in found], "owner": [key[0]] * len(found), "bits": [f[1] for f in found]}).astype({"source": "int64", "owner": "int64"})


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and repeats for every row of ``docs`` (doc_id bigint, text string).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays, a
    null id being smallest; of several rows with that id one stays, and ``repeats`` counts them. An empty table gives
    no rows; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    printed = source.select("doc_id", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"))
    owners = partitions(docs.sparkSession)
    sent = stage(printed.mapInArrow(_send(owners), "kind long, source long, owner long, doc_id long, h long, sha binary, rank long, twice boolean, row long"))
    rows = sent.filter("kind = 0")
    answers = sent.filter("kind = 1").select("source", "owner", "sha").groupBy("owner").applyInPandas(_answer, "source long, owner long, bits binary")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("rank") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("rank") % 8).cast("int")).bitwiseAND(1) == 1
    marked = rows.join(answers, ["source", "owner"], "left")
    marked = stage(marked.select("doc_id", "h", "sha", "row", (F.col("twice") | F.coalesce(bit, F.lit(False))).alias("suspect")))

    suspects = marked.filter("suspect")
    texts = probably_in(source.select("doc_id", "text"), F.xxhash64("text"), suspects.select("h").distinct())
    groups = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    best = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"))
    same = suspects.groupBy("sha", "doc_id").agg(F.count("*").alias("repeats")).groupBy("sha").agg(F.max_by("repeats", F.struct("doc_id")).alias("repeats"))
    verdict = groups.join(best, "sha").join(same, "sha").select("sha", "keep_id", "group_size", F.col("best.row").alias("keep_row"), "repeats")
    text_sha = F.lower(F.hex("sha")).alias("text_sha256")
    judged = suspects.join(verdict, "sha").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), text_sha, "repeats")
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha, F.lit(1).cast("long").alias("repeats"))
    return alone.union(judged)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns.

    Rows that may have to go are found by a bounded filter and joined; the others pass without a shuffle. Rows that repeat
    both id and text become one of them. Columns may have any names; an empty table gives no rows.
    """
    groups = stage(exact_groups(docs))
    touched = groups.filter("not kept").select("text_sha256").distinct()
    keep = groups.filter("kept").join(touched, "text_sha256", "left_semi").select("text_sha256", "keep_id", "repeats")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    hashed = docs.select(F.struct("*").alias("row"), sha.alias("sha"))
    found = probably_in(hashed, F.col("sha"), touched, mark="maybe")
    clear = found.filter("not maybe").select("row.*")
    doubt = found.filter("maybe").select("row", "sha")
    kept = doubt.join(touched.withColumnRenamed("text_sha256", "sha"), "sha", "left_anti").select("row.*")
    wanted = keep.select(F.col("text_sha256").alias("sha"), "keep_id", "repeats")
    winners = doubt.join(wanted, "sha").filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    single = winners.filter("repeats = 1").select("row.*")
    several = winners.filter("repeats > 1").dropDuplicates(["sha"]).select("row.*")
    return clear.union(kept).union(single).union(several)
