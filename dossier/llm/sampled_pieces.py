"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice holds every way to write it in pieces of the vocabulary; a segmentation has the probability
exp(sum of piece weights) / Z. The search tree branches on the next piece. With backward sums over the lattice the
mass of every subtree is known, so the search can carry the largest Gumbel-perturbed log-probability of each
subtree and always opens the best one (A*, the bound is exact): the path that wins inherits the maximum,
all subtrees that branch off it together get one Gumbel cut off below it and wait in the queue. Opened, that set gives up one
subtree, drawn by mass, and the others wait on below its value. The i-th complete text taken from the queue is
the i-th sample without replacement, and the next best value gives the inclusion scores.

No piece holds a space symbol after another character, so a lattice is a chain of word lattices; these are kept per word,
and a whole batch of texts walks down its best subtrees at once. Random numbers are hashes of (seed, row key, sample,
position): a row always gets the same samples.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from math import exp, expm1, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import GOLDEN, MIX_A, MIX_B, give_back, mix64, ragged, text_slices

SPACE = "▁"
SAMPLES = 2
ALPHA = 0.2
NODE_CACHE = 1 << 20
SLOT_BITS = 20
HASH_BASE = np.uint64(0x100000001B3)
MASK = 0xFFFFFFFFFFFFFFFF
SURE = -1e-12
VANISHED = -745.0  # exp() of less is 0 in double precision


class Pieces:
    """The vocabulary: piece texts, sampling weights, byte pieces, and prefix hashes for the lattice search.

    The model's scores are negative merge ranks. The weight of a piece is ``-alpha * log(2 - score)`` for each of its
    occurrences less a constant per piece, so that few and frequent pieces are likely; ``alpha`` sharpens as it grows.
    """

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece as spm

        self.model = spm.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.texts = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = np.zeros(256, np.int32)
        normal = []
        for i in range(n):
            if self.model.is_byte(i):
                self.bytes[int(self.texts[i][3:-1], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                normal.append(i)
        self.longest = max(len(self.texts[i]) for i in normal)
        # Pieces of spaces only carry no rank; they weigh as the first piece does.
        score = {i: min(0.0, s) if (s := self.model.get_score(i)) > -1e8 else 0.0 for i in normal}
        self.weight = np.zeros(n)
        for i in normal:
            self.weight[i] = -1.0 - alpha * np.log(2.0 - score[i])
        whole, prefix = {}, set()
        for i in normal:
            h = 0
            for k, c in enumerate(self.texts[i], 1):
                h = (h * int(HASH_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                prefix.add(h)
            whole[h] = i
        self.prefixes = np.array(sorted(prefix), np.uint64)
        self.prefix_piece = np.array([whole.get(int(h), -1) for h in self.prefixes], np.int32)
        # One look finds most prefixes: their place by the mixed hash's leading bits. Slots that several want send to a search.
        slot = (mix64(self.prefixes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << SLOT_BITS) > 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the prefixes, -1 for none."""
        slot = (mix64(h) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at = self.slots[slot]
        miss = np.flatnonzero((at < 0) | (self.prefixes[at] != h))
        rest = miss[self.crowded[slot[miss]]]
        at[miss] = -1
        if len(rest):
            found = np.minimum(np.searchsorted(self.prefixes, h[rest]), len(self.prefixes) - 1)
            at[rest] = np.where(self.prefixes[found] == h[rest], found, -1)
        return at


@lru_cache(maxsize=2)
def pieces(path: str, alpha: float) -> Pieces:
    """One vocabulary per worker."""
    return Pieces(path, alpha)


class Lattices:
    """Word lattices, one node per character, appended word by word; edge probabilities are conditional on the node."""

    def __init__(self, vocabulary: Pieces, most: int = NODE_CACHE) -> None:
        self.v, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # first node
        self.first = np.empty(0, np.int32)  # of a node: its first edge
        self.left = np.empty(0, np.int32)  # of a node: characters to its word's end
        self.above = np.empty(0)  # of an edge: node number + probability of the node's edges up to it
        self.piece = np.empty(0, np.int32)
        self.length = np.empty(0, np.int16)
        self.logp = np.empty(0)

    def starts(self, words: list[str]) -> np.ndarray:
        """First node of each word; unknown words are added together."""
        if len(self.first) > self.most:
            self.clear()
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        miss = at < 0
        if miss.any():
            late = list(compress(words, miss.tolist()))
            self._add(list(dict.fromkeys(late)))
            at[miss] = np.fromiter(map(self.words.__getitem__, late), np.int64, len(late))
        return at

    def _add(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(text)
        left = np.repeat(ends, sizes) - np.arange(n)
        alive, h = np.arange(n), np.zeros(n, np.uint64)
        src, dst_len, piece = [], [], []
        for k in range(1, self.v.longest + 1):
            fits = left[alive] >= k
            alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            with np.errstate(over="ignore"):
                h = h * HASH_BASE + text[alive + k - 1] + np.uint64(1)
            at = self.v.find(h)
            hit = at >= 0
            alive, h, at = alive[hit], h[hit], at[hit]
            found = self.v.prefix_piece[at]
            is_piece = found >= 0
            src.append(alive[is_piece])
            piece.append(found[is_piece])
            dst_len.append(np.full(int(is_piece.sum()), k))
        src, piece, length = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, piece, dst_len))
        single = np.zeros(n, bool)
        single[src[length == 1]] = True
        bare = np.flatnonzero(~single)  # characters that no piece writes go to bytes: piece -1
        src, piece, length = np.concatenate((src, bare)), np.concatenate((piece, np.full(len(bare), -1))), np.concatenate((length, np.ones(len(bare), np.int64)))
        weight = np.where(piece >= 0, self.v.weight[piece], 4 * self.v.weight.min())
        order = np.argsort(src * (self.v.longest + 1) - length)  # longest first: it is mostly the likeliest, so few edges are looked at
        src, piece, length, weight = src[order], piece[order], length[order], weight[order]
        counts = np.bincount(src, minlength=n)
        first = np.concatenate(([0], np.cumsum(counts)))
        # Backward sums, for all characters at the same distance from their word's end together: their edges are laid side by side.
        beta = np.zeros(n + 1)
        most = int(left.max()) if n else 0
        by = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")
        counts = counts[by]
        offs = np.cumsum(counts) - counts
        edges = np.repeat(first[by] - offs, counts) + np.arange(len(src))
        ahead = src + length
        ahead = np.where(length == left[src], n, ahead)[edges]
        along = weight[edges]
        groups = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=most + 1)[1:])))
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = int(offs[a]), int(offs[b]) if b < n else len(src)
            s = along[lo:hi]
            s += beta[ahead[lo:hi]]
            top = np.maximum.reduceat(s, offs[a:b] - lo)
            beta[by[a:b]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, counts[a:b])), offs[a:b] - lo))
        score = np.empty(len(src))
        score[edges] = along
        logp = score - beta[src]
        p = np.exp(logp)
        run = np.cumsum(p)
        before = np.concatenate(([0.0], run))[first[:-1]]
        base = len(self.first)
        above = np.minimum(run - before[src], 1.0)
        above[first[1:] - 1] = 1.0
        shift = len(self.piece)
        self.first = np.concatenate((self.first, (first[:-1] + shift).astype(np.int32)))
        self.left = np.concatenate((self.left, left.astype(np.int32)))
        self.above = np.concatenate((self.above, above + src + base))
        self.piece, self.length, self.logp = np.concatenate((self.piece, piece.astype(np.int32))), np.concatenate((self.length, length.astype(np.int16))), np.concatenate((self.logp, logp))
        places = base + ends - sizes
        self.words.update(zip(words, places.tolist(), strict=True))

    def edges(self, node: int) -> slice:
        return slice(self.first[node], self.first[node + 1] if node + 1 < len(self.first) else len(self.piece))

    def walk(self, nodes: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw edges from each node to its word's end: edges of all walkers one after the other, and how many each has. ``keys`` seed each walker."""
        who, taken, rounds = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), []
        live = nodes < ends
        who, nodes, ends, keys = who[live], nodes[live], ends[live], keys[live]
        while len(nodes):
            u = uniform(keys + (ends - nodes).astype(np.uint64))
            edge, aim = self.first[nodes], nodes + u
            late = np.flatnonzero(self.above[edge] <= aim)
            while len(late):
                edge[late] += 1
                late = late[self.above[edge[late]] <= aim[late]]
            rounds.append((who, edge))
            taken[who] += 1
            nodes = nodes + self.length[edge]
            live = nodes < ends
            who, nodes, ends, keys = who[live], nodes[live], ends[live], keys[live]
        edges = np.empty(int(taken.sum()), np.int64)
        at = np.cumsum(taken) - taken
        for step, (who, edge) in enumerate(rounds):
            edges[at[who] + step] = edge
        return edges, taken


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix64(keys) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def uniform_of(key: int) -> float:
    """The number that ``uniform`` gives for one key."""
    x = key + int(GOLDEN) & MASK
    x = (x ^ x >> 30) * int(MIX_A) & MASK
    x = (x ^ x >> 27) * int(MIX_B) & MASK
    return (((x ^ x >> 31) >> 12) + 0.5) / float(1 << 52)


def cut_gumbel(log_mass: float, bound: float, u: float) -> float:
    """Gumbel maximum of subtrees with the given log mass, conditioned to lie below ``bound``, from a number in (0, 1)."""
    # exp(-g) = exp(-bound) + e / mass, with e = -log(u)
    a, b = -bound, log(-log(u)) - log_mass
    return -(max(a, b) + log1p(exp(-abs(a - b))))


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), also where the probability itself would be 0 in double precision."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))


_WORDS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Sampler:
    def __init__(self, path: str, alpha: float, samples: int, seed: int, most: int = NODE_CACHE) -> None:
        self.v, self.samples, self.seed = pieces(path, alpha), samples, seed
        self.lattices = Lattices(self.v, most)

    def run(self, texts: list[str | None], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(text, sample, edges as piece ids, log-probability, perturbed value, log of the inclusion score) of each sample."""
        split = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        start = self.lattices.starts([w for words in split for w in words])
        size = self.lattices.left[start].astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
        base = mix64(keys ^ mix64(np.full(len(keys), self.seed, np.uint64)))
        order = np.cumsum(size) - size  # position of each word in the batch, to tell repeated words of a text apart
        queues: list[list] = [[] for _ in texts]
        done: list[list] = [[] for _ in texts]
        live = [i for i, words in enumerate(split) if words]
        bases = base.tolist()
        todo = [(i, int(bounds[i]), None, None, -log(-log(uniform_of(bases[i]))), 0.0) for i in live]
        for r in range(self.samples):
            # Walk all opened subtrees of this round to complete texts.
            if not todo:
                break
            begin = np.array([x[1] for x in todo])
            count = bounds[np.array([x[0] for x in todo]) + 1] - begin
            heads = np.cumsum(count) - count
            words = np.repeat(begin - heads, count) + np.arange(count.sum())
            nodes, ends = start[words], start[words] + size[words]
            for t, (_, _, at, *_) in enumerate(todo):
                if at is not None:
                    nodes[heads[t]] = at
            text_of = np.repeat(np.array([x[0] for x in todo]), count)
            seeds = mix64(base[text_of] ^ mix64((order[words] - order[bounds[text_of]]).astype(np.uint64) + np.uint64((r + 1) << 48)))
            edges, taken = self.lattices.walk(nodes, ends, seeds)
            word_cuts = np.concatenate(([0], np.cumsum(taken)))
            chances = self.lattices.logp[edges]
            for t, (i, _, _, prefix, g, mass) in enumerate(todo):
                lo, hi = word_cuts[heads[t]], word_cuts[heads[t] + count[t]]
                lp = chances[lo:hi]
                gain = float(lp.sum())
                path = edges[lo:hi] if prefix is None else np.concatenate((prefix, edges[lo:hi]))
                done[i].append((path, mass + gain, g))
                if len(lp) and lp.min() < SURE:
                    value = cut_gumbel(mass + log(-expm1(gain)), g, uniform_of(bases[i] ^ (r + 77) * int(GOLDEN) & MASK))
                    ends_of = word_cuts[heads[t] + 1 : heads[t] + count[t] + 1] - lo
                    heapq.heappush(queues[i], (-value, r, 0, len(path) - (hi - lo), path, lp, begin[t], ends_of, mass, ()))
            if r + 1 == self.samples:
                break
            todo = [self._open(i, queues[i], bases[i], r) for i in live if queues[i]]
        for i, found in enumerate(done):
            limit = -queues[i][0][0] if queues[i] else -np.inf
            for rank, (path, total, g) in enumerate(found):
                yield i, rank, path, total, float(g), log_inclusion(total - limit)

    def _open(self, i: int, queue: list, base: int, r: int) -> tuple:
        """Take the best waiting set of subtrees, draw one of them by mass and leave the others waiting below its value.

        The set holds what branches off a path behind its first ``skip`` edges, less the ``gone`` (place, edge) pairs.
        Branches whose share is 0 in double precision are left out of the draw.
        """
        value, tag, times, skip, path, lp, word, ends_of, mass, gone = heapq.heappop(queue)
        lat = self.lattices
        before = np.cumsum(lp) - lp
        before = before[: int(np.searchsorted(-before, -VANISHED, side="right"))]
        share = np.where(lp[: len(before)] < SURE, np.exp(before) * -np.expm1(lp[: len(before)]), 0.0)

        def others(s: int, gone: tuple) -> np.ndarray:
            own = int(path[skip + s])
            node = int(np.searchsorted(lat.first, np.int32(own), side="right")) - 1
            span = lat.edges(node)
            out = {own} | {e for at, e in gone if at == s}
            return np.array([e for e in range(span.start, span.stop) if e not in out], np.int64)

        for s in {at for at, _ in gone}:
            share[s] = exp(before[s]) * np.exp(lat.logp[others(s, gone)]).sum()
        sums = np.cumsum(share)
        spot = mix64(np.array([base + (r + 1 << 40) & MASK, base + (r + 1 << 41) & MASK, base + (r + 1 << 42) & MASK], np.uint64))
        u = uniform(spot)
        s = min(int(np.searchsorted(sums, u[0] * sums[-1], side="right")), int(np.flatnonzero(share)[-1]))
        edges = others(s, gone)
        p = np.exp(lat.logp[edges])
        win = int(edges[min(int(np.searchsorted(np.cumsum(p), u[1] * p.sum(), side="right")), len(edges) - 1)])
        gone = (*gone, (s, win))
        share[s] = exp(before[s]) * np.exp(lat.logp[others(s, gone)]).sum()
        left = float(share.sum())
        if left > 0:
            heapq.heappush(queue, (-cut_gumbel(mass + log(left), -value, float(u[2])), tag, times + 1, skip, path, lp, word, ends_of, mass, gone))
        node = int(np.searchsorted(lat.first, np.int32(win), side="right")) - 1
        at_word = int(word) + int(np.searchsorted(ends_of, s, side="right"))
        return i, at_word, node + int(lat.length[win]), np.concatenate((path[: skip + s], [win])), -value, mass + float(before[s]) + float(lat.logp[win])

    def ids(self, path: np.ndarray, text: str) -> np.ndarray:
        """Piece ids of a path; characters without a piece become their UTF-8 bytes."""
        found = self.lattices.piece[path]
        if (found >= 0).all():
            return found
        ends = np.cumsum(self.lattices.length[path])
        shown = SPACE + text.replace(" ", SPACE)
        out, done = [], 0
        for at in np.flatnonzero(found < 0):
            raw = np.frombuffer(shown[ends[at] - 1].encode("utf-8", "surrogatepass"), np.uint8)
            out += [found[done:at], self.v.bytes[raw]]
            done = int(at) + 1
        return np.concatenate([*out, found[done:]])


def sample_segmentations(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = 5, slice_bytes: int = 1 << 20, node_cache: int = NODE_CACHE) -> DataFrame:
    """doc_id, sample, ids, n_pieces, log_prob, perturbed, log_inclusion: up to ``samples`` distinct segmentations of every whole text.

    Samples come in falling order of ``perturbed``. ``log_inclusion`` is the log of the chance that a segmentation
    with that probability is drawn, given the next best value; 0 if the lattice has no further path. A text with fewer segmentations gives as many rows
    as it has. Null and empty texts give one row with no pieces. Random numbers follow from ``seed`` and the id: repeated rows
    give repeated samples, a null id is a key of its own. An empty table gives no rows; other columns are ignored. A worker takes texts of
    ``slice_bytes`` at a time and forgets its word lattices beyond ``node_cache`` nodes: less of either is less memory and more time, with equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, alpha, samples, seed, node_cache)
        for batch in batches:
            for piece in text_slices(batch, "text", slice_bytes):
                texts = piece.column("text").to_pylist()
                keys = piece.column("key").to_numpy().view(np.uint64)
                rows = [(i, rank, sampler.ids(path, texts[i]), lp, g, q) for i, rank, path, lp, g, q in sampler.run(texts, keys)]
                rows += [(i, 0, np.empty(0, np.int32), 0.0, 0.0, 0.0) for i, t in enumerate(texts) if not t]
                if not rows:
                    continue
                which, rank, ids, lp, g, q = zip(*rows, strict=True)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id").take(pa.array(which)), "sample": pa.array(rank, pa.int32()), "ids": ragged(np.concatenate(([0], np.cumsum(sizes))), np.concatenate(ids), pa.int32()),
                    "n_pieces": pa.array(sizes), "log_prob": pa.array(lp, pa.float64()), "perturbed": pa.array(g, pa.float64()), "log_inclusion": pa.array(q, pa.float64()),
                })
        del sampler
        give_back()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("row"), F.col("doc_id").cast("long")).alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, sample int, ids array<int>, n_pieces long, log_prob double, perturbed double, log_inclusion double")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``text``: the pieces joined, byte pieces put back together, the leading space symbol taken off.

    Null ids give a null text, no ids an empty one. A space symbol (U+2581) of the original comes back as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model, ALPHA)
        for batch in batches:
            lists = batch.column("ids")
            texts = [None if x is None else v.model.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    from pyspark.sql.types import StringType, StructType

    bare = encoded.drop("text")
    return bare.mapInArrow(run, StructType(list(bare.schema.fields)).add("text", StringType()))
