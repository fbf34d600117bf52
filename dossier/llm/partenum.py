"""Jaccard join on word n-grams by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct n-grams. Two sets with similarity >= t differ in at most
(1 - t) / (1 + t) * (|r| + |s|) features. Sets are put into size bands [l, l / t]; a set signs for its own band and the
next one, so a similar pair always meets in the band of the larger set. There the hash domain is cut into groups and
each group into parts, more parts than the pair can differ in, and every subset of ``parts - dirty`` parts of a group
gives one signature: the hash of the set's features in it. A pair that differs in at most that many features leaves
some signed subset untouched, so it shares a signature.

Signatures travel packed: each task sends one block per owner with 6 bytes a signature, set by set, and the number of
each set's signatures. Equal sets are one set id from the start. Owners return the sets that meet, as distinct
member lists. Each list is compared with one leader first; after that only members of different components are
still compared, by sketch and in blocks inside tasks, so a large group of near copies costs its size and not its square
and no pairs are written out. Before features are fetched, an odd sketch of each set (about a bit per feature, the
parity of the features in each of many buckets) rules pairs out: sketches differ in at most as many bits as sets in features.

A passage that very many texts share makes lists of texts that have nothing else in common. A similar pair does not share one
signature but at least as many as a set signs less those that the differing features can spoil. A set with fewer signatures
than that in lists of more than c sets leaves all of those: what it is similar to, it still meets in a shorter one. The
smallest such c is taken; at c = 1 the set has no similar one at all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import give_back, mix64, partitions, probably_in, text_slices
from dossier.llm.components import connected_components
from dossier.session import stage

FLUSH = 1 << 19
WORD_CACHE = 1 << 16
SLACK = 1.15
SMALL_BAND = 24
SMALL_SET = 8
BLOCK = 1024
SLICE_ROWS = 100_000
CROWDS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096)


class WordHashes(dict):
    """Word -> 64-bit hash, emptied when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix64(acc ^ h[i : len(h) - n + 1 + i])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def set_id(features: np.ndarray) -> int:
    """One id for a set, the same whatever the task: hash of the sorted features."""
    return xxhash.xxh3_64_intdigest(features.tobytes()) if len(features) else 0


def band_limits(size: int, threshold: float) -> tuple[int, int]:
    """(number, upper end) of the band of a size: [1, 1], [2, floor(2 / t)], ..."""
    low, number = 1, 0
    while True:
        high = floor(low / threshold + 1e-9)
        if size <= high:
            return number, high
        low, number = high + 1, number + 1


def plan_of(high: int, threshold: float) -> tuple[int, int, int, int]:
    """(differing features, groups, parts in a group, dirty parts in a group) of a band with that upper end."""
    differ = floor(2 * high * (1 - threshold) / (1 + threshold) + 1e-9)
    if differ == 0:
        return 0, 1, 1, 0
    parts, dirty, slack = (3, 1, 2 * SLACK) if high <= SMALL_BAND else (2, 1, SLACK)
    groups = max(differ // (dirty + 1) + 1, ceil(slack * (differ + 1) / (dirty + 1)))
    return differ, groups, parts, dirty


def signatures(features: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The PartEnum signatures of one set, whether each is for the next band, and how many of its own and its next band every similar set of that band shares at least.

    In a set of at most SMALL_SET features every feature is a part of its own: it signs each subset that can be
    an intersection with a similar set. Bands are only needed there to meet larger sets.
    """
    n = len(features)
    out, upper, sure = [], [], [1, 1]
    number, high = band_limits(n, threshold)
    bands = [(number, high), (number + 1, floor((high + 1) / threshold + 1e-9))]
    mixed = mix64(features)
    if n <= SMALL_SET:
        for m in range(max(1, ceil(threshold * n - 1e-9)), n + 1):
            chosen = np.array(list(itertools.combinations(range(n), m)))
            with np.errstate(over="ignore"):
                out.append(mix64(mixed[chosen].sum(axis=1, dtype=np.uint64)))
                upper.append(np.zeros(len(chosen), bool))
        bands = [x for x in bands if x[1] > SMALL_SET and n >= threshold * (SMALL_SET + 1)]
    for b, top in bands:
        _, groups, parts, dirty = plan_of(top, threshold)
        total = groups * parts
        part = (features >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.zeros(total, np.uint64)
        sums[part[starts].astype(np.int64)] = np.add.reduceat(mixed, starts)
        filled = np.zeros(total, bool)
        filled[part[starts].astype(np.int64)] = True
        sums, filled = sums.reshape(groups, parts), filled.reshape(groups, parts)
        tag = np.uint64((b + 1) << 40)
        differ = floor((n + min(top, floor(n / threshold + 1e-9))) * (1 - threshold) / (1 + threshold) + 1e-9)
        clean = 0
        for k, chosen in enumerate(itertools.combinations(range(parts), parts - dirty)):
            some = filled[:, chosen].any(axis=1)
            value = np.zeros(groups, np.uint64)
            for c in chosen:
                value = mix64(value ^ sums[:, c])
            place = np.arange(groups, dtype=np.uint64) * np.uint64(8) + np.uint64(k)
            out.append(mix64(value[some] ^ mix64(place[some] + tag)))
            clean += int(some.sum())
            upper.append(np.full(int(some.sum()), b > number))
        # A part that differs spoils at most this many subsets. If that could leave only empty ones, sign the empty one too.
        left = clean - differ * comb(parts - 1, parts - dirty - 1)
        if n > SMALL_SET:
            sure[int(b > number)] = left
        if left <= 0:
            out.append(mix64(np.array([tag], np.uint64)))
            upper.append(np.array([b > number]))
    return np.concatenate(out), np.concatenate(upper), sure


def odd_sketch(features: np.ndarray) -> bytes:
    """Parities of the feature counts in 2**k buckets of the hash domain, 64 <= 2**k, about one bucket per feature."""
    bits = max(6, int(len(features)).bit_length())
    at = (features >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Lower bound of the number of features in which two sets differ; the longer sketch is folded to the shorter."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in sorted((x, y), key=len))
    return int((x ^ (y.reshape(len(x), -1).sum(axis=1, dtype=np.int64) & 1).astype(np.uint8)).sum())


def _may_link(percent: int):
    """Pairs with sizes and sketches -> the pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("sa").to_numpy() + batch.column("sb").to_numpy()
            most = sizes * (100 - percent) // (100 + percent)
            ka, kb = batch.column("ka").to_pylist(), batch.column("kb").to_pylist()
            keep = np.fromiter((sketch_distance(x, y) <= m for x, y, m in zip(ka, kb, most, strict=True)), bool, batch.num_rows)
            yield pa.record_batch({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})
        give_back()

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key of a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _forest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of candidate pairs, the nearest ones that join the roots without a circle."""
    _, at = np.unique(roots, return_inverse=True)
    up = list(range(int(at.max()) + 1))
    left = len(up) - 1
    for k in np.argsort(distance, kind="stable"):
        x, y = int(at[i[k]]), int(at[j[k]])
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            left -= 1
            yield int(i[k]), int(j[k])
            if not left:
                return


def _apart(percent: int, forest: bool):
    """Groups of sets (gid, set_id, root, size, sketch), sorted by gid -> pairs of different roots that sizes and sketches allow.

    All of them, or with ``forest`` only as many as could join the group's roots, the nearest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [], []
        for rows in _runs(batches, "gid"):
            ids, roots, sizes = (rows.column(c).to_numpy() for c in ("set_id", "root", "size"))
            sketches = rows.column("sketch").to_pylist()
            sums = sizes[:, None] + sizes[None, :]
            may = (roots[:, None] != roots[None, :]) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :]))
            may &= ids[:, None] < ids[None, :]
            most = sums * (100 - percent) // (100 + percent)
            apart = np.zeros(may.shape, np.float32)
            if len(ids) > 8:
                short = min(map(len, sketches))
                bits = np.stack([(np.unpackbits(np.frombuffer(k, np.uint8)).reshape(8 * short, -1).sum(axis=1, dtype=np.int64) & 1) for k in sketches]).astype(np.float32)
                ones = bits.sum(axis=1)
                apart = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
                may &= apart <= most
            i, j = np.nonzero(may)
            pairs = _forest(i, j, apart[i, j], roots) if forest and len(i) else zip(i, j, strict=True)
            for x, y in pairs:
                if sketch_distance(sketches[x], sketches[y]) <= most[x, y]:
                    found_a.append(ids[x])
                    found_b.append(ids[y])
            if len(found_a) > 50_000:
                yield pa.record_batch({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})
                found_a, found_b = [], []
        yield pa.record_batch({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})
        give_back()

    return run


def _pack(sigs: np.ndarray, upper: np.ndarray, owner_of: np.ndarray, index: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(owner, block) of signatures that come set by set (``index`` rises), so a block needs only each set's number of them."""
    order = np.argsort(owner_of, kind="stable")
    sigs, upper, owner_of, index = sigs[order], upper[order], owner_of[order], index[order]
    starts = np.flatnonzero(np.concatenate(([True], owner_of[1:] != owner_of[:-1])))
    for lo, hi in zip(starts, [*starts[1:], len(sigs)], strict=True):
        used, counts = np.unique(index[lo:hi], return_counts=True)
        kind = np.uint16 if counts.max() < 1 << 16 else np.uint32
        head = np.array([hi - lo, len(used), kind().itemsize], np.uint32).tobytes()
        six = sigs[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        yield int(owner_of[lo]), head + ids[used].tobytes() + sizes[used].tobytes() + counts.astype(kind).tobytes() + six + np.packbits(upper[lo:hi]).tobytes()


def _unpack(block: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, index of each one's set, ids and sizes of the sets, next-band marks)."""
    m, k, width = np.frombuffer(block, np.uint32, 3, 0)
    at = 12
    ids = np.frombuffer(block, np.uint64, k, at)
    sizes = np.frombuffer(block, np.uint32, k, at := at + 8 * int(k))
    counts = np.frombuffer(block, np.uint16 if width == 2 else np.uint32, k, at := at + 4 * int(k))
    local = np.repeat(np.arange(k, dtype=np.int32), counts)
    at += int(k) * int(width)
    wide = np.zeros((int(m), 8), np.uint8)
    wide[:, :6] = np.frombuffer(block, np.uint8, 6 * int(m), at).reshape(-1, 6)
    upper = np.unpackbits(np.frombuffer(block, np.uint8, offset=at + 6 * int(m)), count=int(m))
    return wide.view("<u8").ravel(), local, ids, sizes, upper


def _scan(width: int, threshold: float, owners: int):
    """Arrow batches of (doc_id, th, text) -> rows of members with their sketches (kind 0) and signature blocks (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array([h[0] for h in held], np.uint64)
            sizes = np.array([h[1] for h in held], np.uint32)
            sigs, upper = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            index = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            owner = ((sigs >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24)).astype(np.int64)
            for o, block in _pack(sigs, upper, owner, index, ids, sizes):
                yield pa.record_batch({"kind": [1], "doc_id": pa.array([None], pa.int64()), "th": pa.array([None], pa.int64()), "set_id": pa.array([None], pa.int64()), "n_shingles": pa.array([o], pa.int64()), "bytes": pa.array([block], pa.binary()), "sure": pa.array([None], pa.int32()), "sure_next": pa.array([None], pa.int32())})

        for batch in batches:
            for piece in text_slices(batch, "text"):
                ids, sizes, sketches, surely = [], [], [], []
                for text in piece.column("text").to_pylist():
                    features = shingle_set(text, width, cache)
                    ids.append(sid := set_id(features))
                    sizes.append(len(features))
                    sketches.append(odd_sketch(features))
                    surely.append((1, 1))
                    if len(features) and sid not in seen:
                        seen.add(sid)
                        sigs, upper, surely[-1] = signatures(features, threshold)
                        held.append((sid, len(features), sigs, upper))
                        count += len(held[-1][2])
                        if count >= FLUSH:
                            yield from flush()
                            held, count, seen = [], 0, set()
                n = piece.num_rows
                yield pa.record_batch({"kind": np.zeros(n, np.int64), "doc_id": piece.column("doc_id"), "th": piece.column("th"), "set_id": pa.array(np.array(ids, np.uint64).view(np.int64)), "n_shingles": pa.array(sizes, pa.int64()), "bytes": pa.array(sketches, pa.binary()), "sure": pa.array([x[0] for x in surely], pa.int32()), "sure_next": pa.array([x[1] for x in surely], pa.int32())})
        if held:
            yield from flush()
        del held, seen, cache
        give_back()

    return run


def _meet(blocks: pa.Table) -> pa.Table:
    """One owner's blocks -> the distinct lists of sets that share a signature, as (bucket, set_id, size, upper, times, length) rows.

    ``times`` counts the signatures that a list stands for, ``length`` its sets.
    """
    parts = [_unpack(x.as_buffer()) for x in blocks.column("bytes")]
    sigs = np.concatenate([x[0] for x in parts])
    shift = np.cumsum([0, *(len(x[2]) for x in parts[:-1])])
    index = np.concatenate([x[1] + np.int32(n) for x, n in zip(parts, shift, strict=True)])
    every_id, every_size, upper = (np.concatenate([x[k] for x in parts]) for k in (2, 3, 4))
    del parts
    order = np.argsort(sigs)
    sigs = sigs[order]
    same = sigs[1:] == sigs[:-1]
    met = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    order, sigs = order[met], sigs[met]
    ids, sizes, upper = every_id[index[order]], every_size[index[order]], upper[order]
    order = np.lexsort((ids, sigs))
    sigs, ids, sizes, upper = sigs[order], ids[order], sizes[order], upper[order]
    first = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])))[: len(sigs)]
    sigs, ids, sizes, upper = sigs[first], ids[first], sizes[first], upper[first]
    if not len(sigs):
        return pa.table({c: np.empty(0, np.int64) for c in ("bucket", "set_id", "size", "upper", "times", "length")})
    starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    lengths = np.diff(np.append(starts, len(sigs)))
    starts, lengths = starts[lengths > 1], lengths[lengths > 1]
    if not len(starts):
        return pa.table({c: np.empty(0, np.int64) for c in ("bucket", "set_id", "size", "upper", "times", "length")})
    rows = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.cumsum(lengths) - lengths
    names = mix64(np.add.reduceat(mix64(ids[rows] ^ upper[rows].astype(np.uint64)), ends) ^ lengths.astype(np.uint64))
    _, keep, times = np.unique(names, return_index=True, return_counts=True)
    many = np.zeros(len(names), np.int64)
    many[keep] = times
    kept = np.zeros(len(names), bool)
    kept[keep] = True
    mask = np.repeat(kept, lengths)
    give_back()
    return pa.table({"bucket": np.repeat(names, lengths)[mask].view(np.int64), "set_id": ids[rows][mask].view(np.int64), "size": sizes[rows][mask].astype(np.int64), "upper": upper[rows][mask].astype(np.int64), "times": np.repeat(many, lengths)[mask], "length": np.repeat(lengths, lengths)[mask].astype(np.int64)})


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for piece in text_slices(batch, "text"):
                found = [shingle_set(t, width, cache) for t in piece.column("text").to_pylist()]
                ids = np.array([set_id(f) for f in found], np.uint64).view(np.int64)
                yield pa.record_batch({"set_id": pa.array(ids), "features": pa.array([f.tobytes() for f in found], pa.binary())})
        del cache
        give_back()

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            fa, fb = batch.column("fa"), batch.column("fb")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(fa[i].as_buffer(), np.uint64), np.frombuffer(fb[i].as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.record_batch({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})
        give_back()

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id bigint, text string).

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Two documents link when
    100 * |intersection| >= percent * |union| of their n-gram sets; component_id is the smallest doc_id reachable.
    Null, empty and wordless texts have n_shingles 0 and their own doc_id. Repeated rows are kept and fall in one
    component. A null doc_id stays null in its row; its component is the smallest non-null id of the group, if any. An
    empty table gives no rows; other columns are ignored. Features and sets are told apart by 64-bit hashes.
    """
    spark, threshold = docs.sparkSession, percent / 100
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    owners = 2 * partitions(spark)
    scanned = stage(source.mapInArrow(_scan(width, threshold, owners), "kind long, doc_id long, th long, set_id long, n_shingles long, bytes binary, sure int, sure_next int"))
    members = scanned.filter("kind = 0").select("doc_id", "th", "set_id", "n_shingles")
    blocks = scanned.filter("kind = 1").select(F.col("n_shingles").alias("owner"), "bytes")
    met = stage(blocks.groupBy("owner").applyInArrow(_meet, "bucket long, set_id long, size long, upper long, times long, length long"))
    hits = met.groupBy("set_id", "upper").agg(*[F.sum(F.when(F.col("length") > c, F.col("times")).otherwise(0)).alias(f"h{c}") for c in CROWDS])
    surely = scanned.filter("kind = 0 and n_shingles > 0").select("set_id", F.explode(F.create_map(F.lit(0), "sure", F.lit(1), "sure_next")).alias("upper", "sure"))
    surely = surely.groupBy("set_id", "upper").agg(F.max("sure").alias("sure"))
    limit = F.coalesce(*[F.when(F.col(f"h{c}") < F.col("sure"), F.lit(c)) for c in CROWDS], F.lit(1 << 62))
    limits = hits.join(surely, ["set_id", "upper"]).select("set_id", "upper", limit.alias("most")).filter("most > 1")
    lists = met.join(limits, ["set_id", "upper"]).filter("length <= most").select("bucket", "set_id", "size").distinct()
    lists = stage(lists)

    involved = lists.select("set_id").distinct()
    known = scanned.filter("kind = 0 and n_shingles > 0").select("set_id", "th", F.col("bytes").alias("sketch")).join(involved, "set_id", "left_semi")
    known = stage(known.groupBy("set_id").agg(F.min("th").alias("th"), F.first("sketch").alias("sketch")))

    def verify(likely: DataFrame) -> DataFrame:
        """The linked ones of written pairs (a, b)."""
        wanted = known.join(likely.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id", "left_semi").select("th")
        near = probably_in(source.select("th", "text"), F.col("th"), wanted)
        sets = stage(near.select("text").mapInArrow(_sets(width), "set_id long, features binary").dropDuplicates(["set_id"]))
        side = lambda x: sets.select(F.col("set_id").alias(x), F.col("features").alias(f"f{x}"))
        return likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb").mapInArrow(_linked(percent), "a long, b long")

    fits = f"100 * least(sa, sb) >= {percent} * greatest(sa, sb)"
    leader = lists.groupBy("bucket").agg(F.max(F.struct("size", "set_id")).alias("l")).select("bucket", F.col("l.set_id").alias("b"), F.col("l.size").alias("sb"))
    stars = lists.join(leader, "bucket").select(F.col("set_id").alias("a"), "b", F.col("size").alias("sa"), "sb").filter("a <> b").filter(fits).distinct()
    side = lambda x: known.select(F.col("set_id").alias(x), F.col("sketch").alias(f"k{x}"))
    likely = stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_may_link(percent), "a long, b long")
    first = stage(verify(stage(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())))
    roots = stage(connected_components(first))

    def rest(roots: DataFrame, forest: bool) -> DataFrame:
        """Pairs of different components in one list that may link.

        Lists with the same main component are taken together, in slices of bounded size, so that a set's sketch goes to few
        places; slices are compared in blocks.
        """
        named = lists.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        counted = named.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("k"), F.sum("count").alias("rows"))
        mixed = counted.filter("k > 1").select("bucket", F.col("m.root").alias("main"), "rows")
        slices = mixed.groupBy("main").agg(F.ceil(F.sum("rows") / SLICE_ROWS).alias("slices"))
        placed = mixed.join(slices, "main").select("bucket", F.xxhash64("main", F.pmod(F.xxhash64("bucket"), F.col("slices"))).alias("gid"))
        groups = stage(named.join(placed, "bucket").select("gid", "set_id", "root", "size").distinct())
        blocks = groups.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
        spread = groups.join(blocks, "gid").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        spread = spread.select(F.xxhash64("gid", F.least("block", "other"), F.greatest("block", "other")).alias("gid"), "set_id", "root", "size")
        spread = spread.join(known.select("set_id", "sketch"), "set_id").repartition(partitions(spark), "gid").sortWithinPartitions("gid")
        return stage(spread.mapInArrow(_apart(percent, forest), "a long, b long").distinct())

    # A leader may be the odd one of its list. So the nearest pairs that could join what is apart come first, then all that still are.
    edges = first.union(stage(verify(rest(roots, forest=True))))
    edges = edges.union(stage(verify(rest(stage(connected_components(edges)), forest=False))))
    final = connected_components(edges)

    labelled = members.join(final.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    labelled = stage(labelled)
    smallest = labelled.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = labelled.filter("n_shingles > 0").join(smallest, "root").select("doc_id", "n_shingles", "component_id")
    return grouped.union(labelled.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, with all their columns; rows with a null id stay.

    Rows that may have to go are found by a bounded filter and joined; the others pass without a shuffle. Rows that repeat
    an id stay or go together. Columns may have any names; an empty table gives no rows.
    """
    groups = jaccard_components(docs, width, percent)
    gone = stage(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    found = probably_in(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id")), F.col("doc_id"), gone, mark="maybe")
    return found.filter("not maybe").select("row.*").union(found.filter("maybe").join(gone, "doc_id", "left_anti").select("row.*"))
