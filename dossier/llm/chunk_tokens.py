"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where the tokenizer is back in step.

The tokenizer cuts a text into words by a pattern that looks ahead but never back, and merges inside words only. So if a
word starts at the same place in two chunks, and it is a true word start in the first, all that follows is the same in both.
A word start of the first chunk is proven when two more whole words follow it in the chunk and the longest special string
could still be seen whole after it. Pairs of chunks without a common proven start are encoded again with twice the chunk
and the overlap, in the end as one chunk.

Short texts are counted by their units, cut where the pattern always begins a word. The library counts a unit once for as long
as it is remembered; a tokenizer file that may look across such places gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, probably_in, text_slices
from dossier.session import stage

CHUNK = 32_768
OVERLAP = 512
LIMIT = 512

# A unit ends before a blank that follows one of _SEEN, none of which is white space, and before one of _STOPS that follows a
# letter: there the pattern always begins a word.
_SEEN, _LETTERS, _STOPS = "!-~\u00a1-\u024f\u0370-\u03ff\u0400-\u052f", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ",.;:!?"
UNIT = re.compile(f"(?s:.)[^ {_STOPS}]*(?:(?:(?<![{_SEEN}]) +|(?<![{_LETTERS}])[{_STOPS}]+)[^ {_STOPS}]*)*")
UNIT_CHARS = 64
UNITS_KEPT = 1 << 18


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def cuts_in_units(path: str) -> bool:
    """Whether a text's tokens are those of its units: the byte-level pattern on the text as it is, and no added token that a cut could split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"[\s{_STOPS}]", t["content"])) for t in spec["added_tokens"])
    return plain and added and model.get("type") == "BPE" and not model.get("dropout")


class UnitCounts(dict):
    """Token counts by unit, as the library gives them; forgotten when there are too many."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)

    def of(self, texts: list[str]) -> list[int]:
        units = [UNIT.findall(text) for text in texts]
        every = set().union(*units)
        new = list(every.difference(self))
        if len(self) + len(new) > UNITS_KEPT:
            self.clear()
            new = list(every)
        self.update(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        counts = [sum(map(self.__getitem__, found)) for found in units]
        for u in new:
            if len(u) > UNIT_CHARS:
                del self[u]
        return counts


@lru_cache(maxsize=2)
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)


def word_starts(encoding, low: int, high: int) -> list[tuple[int, int]]:
    """(offset, tokens before it) of the word starts with low <= offset < high."""
    out = []
    words, offsets = encoding.word_ids, encoding.offsets
    for i in range(len(words)):
        at = offsets[i][0]
        if low <= at < high and (i == 0 or words[i] != words[i - 1] or words[i] is None) and (i == 0 or offsets[i - 1][1] == at):
            out.append((at, i))
    return out


def proven(encoding, length: int, low: int, margin: int) -> list[tuple[int, int]]:
    """The word starts from ``low`` on that text after the chunk can't change."""
    return [x for x in word_starts(encoding, low, length + 1)[:-2] if x[0] <= length - margin]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, units = tokenizer(path), unit_counts(path) if cuts_in_units(path) else None
        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 20):
                texts = piece.column("text").to_pylist()
                counts = units.of(texts) if units is not None else [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "n_bytes": piece.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64())})
        give_back()

    return run


def _encode(path: str, overlap: int):
    ends = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        margin = max((len(a.content) for a in t.get_added_tokens_decoder().values()), default=0)
        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 20):
                texts, starts = piece.column("text").to_pylist(), piece.column("start").to_pylist()
                heads, tails, counts = [], [], []
                for e, text, start in zip(t.encode_batch(texts, add_special_tokens=False), texts, starts, strict=True):
                    counts.append(len(e))
                    heads.append([{"at": start + a, "n": n} for a, n in word_starts(e, 0, overlap)])
                    tails.append([{"at": start + a, "n": n} for a, n in proven(e, len(text), max(len(text) - overlap, 0), margin)])
                yield pa.record_batch({"key": piece.column("key"), "idx": piece.column("idx"), "n_tokens": pa.array(counts, pa.int64()), "head": pa.array(heads, ends), "tail": pa.array(tails, ends)})

    return run


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens of each distinct text of ``long`` (key, text); n_tokens is null where two chunks have no common proven start."""
    stride = chunk - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / stride) - 1, F.lit(0)).cast("int")
    cut = long.select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    start = F.col("idx").cast("long") * stride
    pieces = cut.select("key", "idx", start.alias("start"), F.substring(F.col("text"), (start + 1).cast("int"), F.lit(chunk)).alias("text"))
    spread = pieces.groupBy("key", "idx").agg(F.first("start").alias("start"), F.first("text").alias("text"))
    done = stage(spread.mapInArrow(_encode(path, overlap), "key long, idx int, n_tokens long, head array<struct<at:bigint,n:bigint>>, tail array<struct<at:bigint,n:bigint>>"))
    ahead = done.select("key", (F.col("idx") - 1).alias("idx"), F.col("head").alias("next_head"))
    pairs = done.join(ahead, ["key", "idx"])
    at = F.array_min(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next_head", lambda x: x["at"])))
    pairs = pairs.withColumn("at", at)
    tokens = lambda c: F.get(F.filter(c, lambda x: x["at"] == F.col("at")), F.lit(0))["n"]
    gain = pairs.select("key", (tokens("tail") - tokens("next_head")).alias("n"))
    ends = done.groupBy("key").agg(F.max_by("n_tokens", "idx").alias("n"))
    return gain.union(ends).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.when(F.col("n").isNull(), 1)).alias("open")).select("key", F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, as the tokenizer file counts whole texts.

    No begin, end or added special tokens; special strings inside texts as the library takes them; nothing is cut or
    padded. Null counts as empty: no bytes, no tokens. Repeated rows are counted once and returned as often as they are
    there; an empty table gives no rows; other columns are ignored. Texts longer than ``chunk`` characters go the chunked way.
    """
    if chunk < 2 * overlap:
        raise ValueError("a chunk must hold two overlaps")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = source.filter(F.length("text") <= chunk).mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    long = source.filter(F.length("text") > chunk).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = stage(long.select("doc_id", "key", "n_bytes"))
    parts = []
    if not rows.isEmpty():
        todo, size, lap = long.select("key", "text"), chunk, overlap
        while True:
            counted = stage(_spliced(todo, path, size, lap))
            parts.append(counted.filter("n_tokens is not null"))
            failed = counted.filter("n_tokens is null").select("key")
            if failed.isEmpty():
                break
            todo = probably_in(long.select("key", "text"), F.col("key"), failed).join(failed, "key", "left_semi")
            size, lap = size * 2, lap * 2
    out = short
    for part in parts:
        out = out.union(rows.join(part, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
