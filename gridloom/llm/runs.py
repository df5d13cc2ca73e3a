"""Runs of periodic words: every stretch whose words repeat with a smallest period q at least three times.

Block convolution at dyadic scales: at scale B (8, 16, 32, …) the words of a text are cut into aligned
blocks of B words.  A stretch of period q in [B, 2B) (from 1 at the first scale) that is long enough
holds such a block and its next occurrence, so each block is laid over the window of the 2B - 1 places
that follow it: the sum of squared differences of word numbers is one convolution, computed by number
theoretic transforms modulo primes whose product exceeds the largest possible sum.  A zero is an exact
occurrence, its distance a period.  Each (block, distance) seeds an extension to both sides, by ranks
of all stretches of 1, 2, 4, … words, until a word differs from the one at that distance.

Nothing that can be a run is skipped.  A block is left out only if one of its words does not come
again within the next 2B - 1 words, or if it lies with its whole window inside a run of at most half
its length, where every occurrence is a multiple of the known period.

Words are 64-bit hashes of their bytes.  The work of a text is near-linear in its words; batches of
texts are worked on together, each text in one task.

Edge cases: null and empty texts, and texts of separators only, have no words: no runs, the digest of
the empty string.  Of runs with the same stretch only the smallest period counts.  Overlapping runs
all count.  Repeated rows get equal results; texts of any length are searched whole; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import text_slices, to_workers, word_hashes

FIRST = 8  # words of the smallest block
SHORTEST, REPEATS = 24, 3
#: Primes k * 2^m + 1 below 2^31 and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Elements transformed at a time.
CHUNK = 1 << 18


def _ntt(a: np.ndarray, p: int, g: int, back: bool = False) -> np.ndarray:
    """Transform modulo ``p`` along the last axis (a power of two); ``back`` inverts it."""
    n = a.shape[-1]
    m = np.uint64(p)
    place = np.zeros(1, np.int64)
    while len(place) < n:
        place = np.concatenate([2 * place, 2 * place + 1])
    a = a[..., place]
    size = 1
    while size < n:
        root = pow(g, (p - 1) // (2 * size), p)
        root = pow(root, p - 2, p) if back else root
        w = np.ones(1, np.uint64)
        while len(w) < size:
            w = np.concatenate([w, w * np.uint64(pow(root, len(w), p)) % m])
        v = a.reshape(*a.shape[:-1], n // (2 * size), 2, size)
        odd = v[..., 1, :] * w % m
        even = v[..., 0, :]
        up, down = even + odd, even + (m - odd)
        a = np.stack([np.where(up >= m, up - m, up), np.where(down >= m, down - m, down)], axis=-2).reshape(a.shape)
        size *= 2
    return a * np.uint64(pow(n, p - 2, p)) % m if back else a


def occurrences(pattern: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each row, where the B numbers of ``pattern`` stand in the 3B - 1 of ``window``: a mask over 2B places."""
    b = pattern.shape[1]
    largest = b * int(max(pattern.max(), window.max())) ** 2
    zero = np.ones((len(pattern), 2 * b), dtype=bool)
    reach = 1
    for p, g in PRIMES:
        m = np.uint64(p)
        t = np.zeros((len(window), 4 * b), np.uint64)
        t[:, : window.shape[1]] = window % m
        x = np.zeros_like(t)
        x[:, :b] = pattern[:, ::-1] % m
        product = _ntt(_ntt(t, p, g) * _ntt(x, p, g) % m, p, g, back=True)[:, b - 1 : 3 * b - 1]
        squares = np.cumsum(np.pad(t * t % m, ((0, 0), (1, 0))), axis=1)  # at most 4B terms below 2^31
        own = (pattern % m) ** np.uint64(2) % m
        total = own.sum(axis=1, keepdims=True) + squares[:, b : 3 * b] - squares[:, : 2 * b]
        zero &= total % m == np.uint64(2) * product % m
        reach *= p
        if reach > largest:
            return zero
    raise ValueError("a text of more than 2^30 words")


class Ranks:
    """Numbers of all stretches of 1, 2, 4, … words; equal numbers mean equal stretches."""

    def __init__(self, words: np.ndarray, longest: int):
        self.n, self.levels = len(words), [words]
        span = 1
        while span < longest:
            last = self.levels[-1]
            pair = last[: max(0, len(last) - span)].astype(np.int64) * (int(last.max()) + 1) + last[span:]
            if not len(pair):
                break
            self.levels.append(np.unique(pair, return_inverse=True)[1])
            span *= 2

    def same(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal, forwards (1) or backwards (-1, not counting i and j themselves)."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, span = self.levels[k], 1 << k
            a, b = (i + done, j + done) if step == 1 else (i - done - span, j - done - span)
            fits = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(rank))
            done += span * (fits & (rank[np.where(fits, a, 0)] == rank[np.where(fits, b, 0)]))
        return done


def _covered(lo: np.ndarray, hi: np.ndarray, runs: np.ndarray, most: int) -> np.ndarray:
    """Whether [lo, hi) lies inside one of ``runs`` (start, end, period) with a period of at most ``most``."""
    r = runs[runs[:, 2] <= most]
    if not len(r):
        return np.zeros(len(lo), bool)
    r = r[np.argsort(r[:, 0], kind="stable")]
    at = np.searchsorted(r[:, 0], lo, side="right")
    reach = np.maximum.accumulate(r[:, 1])
    return (at > 0) & (reach[np.maximum(at, 1) - 1] >= hi)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of the texts whose words are ``words[first[k]:first[k + 1]]``."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((np.arange(len(words)), words, text))
    again = np.full(len(words), len(words) + 1, np.int64)  # distance to the next place of the same word
    if len(words) > 1:
        a, b = order[:-1], order[1:]
        pair = (words[a] == words[b]) & (text[a] == text[b])
        again[a[pair]] = b[pair] - a[pair]
    # texts with no block of recurring words at any scale have no runs
    scales, size = [], FIRST
    while size == FIRST or REPEATS * size <= (sizes.max() if len(sizes) else 0):
        blocks = len(words) // size
        if blocks:
            s = np.arange(blocks) * size
            alive = again[: blocks * size].reshape(blocks, size).max(axis=1) <= 2 * size - 1
            s = s[alive]
            s = s[text[s] == text[s + size - 1]]
            if len(s):
                scales.append((size, s))
        size *= 2
    if not scales:
        return none
    used = np.unique(np.concatenate([text[s] for _, s in scales]))
    # the texts that are left, each followed by a word of its own
    take = np.concatenate([np.arange(first[k], first[k + 1]) for k in used])
    shift = np.zeros(len(sizes), np.int64)
    start = np.concatenate([[0], np.cumsum(sizes[used] + 1)])
    shift[used] = start[:-1] - first[used]
    number = np.unique(words[take], return_inverse=True)[1] + 1
    w = np.zeros(start[-1], np.int64)
    at = take + shift[text[take]]
    w[at] = number
    w[start[1:] - 1] = number.max() + 1 + np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), sizes[used] + 1)
    ranks, runs = None, np.zeros((0, 3), np.int64)
    for size, s in scales:
        s = s + shift[text[s]]
        stop = start[owner[s] + 1] - 1
        s, stop = (x[~_covered(s, np.minimum(s + 3 * size, stop), runs, size // 2)] for x in (s, stop))
        seeds = []
        rows = max(1, CHUNK // (4 * size))
        for c in range(0, len(s), rows):
            p, e = s[c : c + rows], stop[c : c + rows]
            place = p[:, None] + 1 + np.arange(3 * size - 1)
            inside = place < e[:, None]
            window = np.where(inside, w[np.where(inside, place, 0)], 0)
            pattern = w[p[:, None] + np.arange(size)]
            # words are numbered anew in each block, so that few primes do
            row = np.arange(len(p))[:, None] * (int(w.max()) + 1)
            known = np.unique(row + pattern)
            before = np.searchsorted(known, row)
            index = np.minimum(np.searchsorted(known, row + window), len(known) - 1)
            window = np.where(known[index] == row + window, index - before + 1, 0).astype(np.uint64)
            hit = occurrences((np.searchsorted(known, row + pattern) - before + 1).astype(np.uint64), window)
            row, d = np.nonzero(hit[:, : 2 * size - 1])
            seeds.append(np.stack([p[row], d + 1], axis=1))
        seeds = np.concatenate(seeds) if seeds else np.zeros((0, 2), np.int64)
        if size > FIRST:
            seeds = seeds[seeds[:, 1] >= size]  # shorter periods belong to earlier scales
        seeds = seeds[~_covered(seeds[:, 0], seeds[:, 0] + seeds[:, 1] + size, runs, size // 2)]
        if not len(seeds):
            continue
        if ranks is None:
            ranks = Ranks(w, int(sizes[used].max()))
        a, d = seeds.T
        lo = a - ranks.same(a, a + d, -1)
        hi = a + d + ranks.same(a, a + d, 1)
        got = np.stack([lo, hi, d], axis=1)[hi - lo >= np.maximum(SHORTEST, REPEATS * d)]
        got = np.concatenate([runs, got])
        got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
        runs = got[np.concatenate([[True], (np.diff(got[:, :2], axis=0) != 0).any(axis=1)])] if len(got) else got
    if not len(runs):
        return none
    k = owner[runs[:, 0]]
    out = np.stack([used[k], runs[:, 0] - start[k], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def best_run(runs: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the greatest exact length / period; ties to the smaller start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on of the document are replaced by its words a .. a + p - 1 in turn; for one id of ten."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse_runs(docs: DataFrame, tail=repeated_tail) -> DataFrame:
    """Runs of every text, the strongest of them, and the digest of the text with each run cut to its first period.

    ``tail`` (doc_id, words) names texts whose end is replaced by a repetition before the search; None for none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, offs in text_slices(batch, "text"):
                ids = batch.column(0).slice(lo, hi - lo)
                hashes, first = word_hashes(b, offs, fold=False)
                take, moved = np.arange(len(hashes)), np.zeros(hi - lo, bool)
                for k, i in enumerate(ids.to_pylist() if tail else ()):
                    t = tail(i, int(first[k + 1] - first[k]))
                    if t:
                        moved[k] = True
                        at = np.arange(first[k] + t[0], first[k + 1])
                        take[at] = first[k] + t[0] + (at - first[k] - t[0]) % t[1]
                found = find_runs(hashes[take], first)
                cut, begin = np.zeros(len(take) + 1, np.int64), first[found[:, 0]] + found[:, 1]
                np.add.at(cut, begin + found[:, 3], 1)
                np.add.at(cut, begin + found[:, 2], -1)
                keep = np.cumsum(cut) == 0
                part = np.searchsorted(found[:, 0], np.arange(hi - lo + 1))
                rows = []
                for k in range(hi - lo):
                    mine = found[part[k] : part[k + 1], 1:]
                    best = best_run(mine) if len(mine) else (None, None, None)
                    listed = "".join(f"{s},{n},{p}\n" for s, n, p in mine.tolist())
                    words = b[offs[k] : offs[k + 1]].tobytes().split()  # bytes split at the same six separators
                    here = slice(first[k], first[k + 1])
                    if moved[k] or len(mine):
                        words = [words[j] for j in (take[here] - first[k])[keep[here]]]
                    text = b" ".join(words)
                    milli = None if best[0] is None else 1000 * best[1] // best[2]
                    rows.append((len(mine), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                                 names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return to_workers(docs.select("doc_id", "text"), run, SCHEMA.format(kind))
