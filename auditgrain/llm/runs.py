"""Periodic runs of words, by a harmonic grid of longest common extensions.

A run of period q that is long enough covers two neighbouring points of a grid of step q. So for each q
the words at grid points i and i + q are compared, n/1 + n/2 + ... pairs for a text of n words; where
they agree, the longest common extensions of the pair to both sides give the stretch of period q.

An extension first compares words, as many as lead both places to a sampled one, and one cover period
at least. Most end there. The others are answered by a difference-cover structure: only suffixes at
places whose number modulo v lies in a perfect difference set are sorted, their common prefixes are
kept in a sparse table, and a range minimum between the two samples is the rest of the extension.
Many texts are worked on as one array, with a mark of its own behind each, so that no extension leaves
its text; the texts that need the structure are few, and only those are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import column, pieces, schema_of, texts_of, words

#: Perfect difference set: every difference modulo the period occurs for exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Least words of a run.
SHORTEST = 12
#: Characters of text that a task works on at once (one text at least), and pairs of a grid.
CHARS, PAIRS = 1_500_000, 1_000_000


class Extensions:
    """Longest common extensions to the right in an array of word numbers.

    The array ends with `PERIOD` numbers that occur nowhere else, and so does each text in it with one.
    """

    def __init__(self, x: np.ndarray, cover: Sequence[int] = COVER, period: int = PERIOD):
        self.x, self.v = x, period
        self.first = np.zeros(period, np.int64)  # first[d]: the residue r of the cover for which r + d is one too
        for a in cover:
            for b in cover:
                self.first[(b - a) % period] = a
        n = len(x) - period
        self.samples = np.concatenate([np.arange(r, n + 1, period, dtype=np.int64) for r in sorted(cover)])
        self.number = np.full(n + 1, -1, np.int64)
        self.number[self.samples] = np.arange(len(self.samples))
        self._sort()

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling, and common prefixes of neighbours in that order.

        `levels[k]` ranks the samples by their first 2^k blocks of v words; the sample v words on is
        the next one in `samples`, or none at the end of its residue, where a text mark makes it unique.
        """
        m, blocks = len(self.samples), np.lib.stride_tricks.sliding_window_view(self.x.astype(">u4"), self.v)
        cells = np.ascontiguousarray(blocks[self.samples]).view(f"V{4 * self.v}").ravel()
        rank = np.unique(cells, return_inverse=True)[1].ravel().astype(np.int64)
        levels, ahead = [rank], 1
        while m and rank.max() < m - 1:
            after = np.zeros(m, np.int64)
            after[: max(m - ahead, 0)] = rank[ahead:] + 1  # a block with an end mark differs from all others, whatever follows
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1].ravel().astype(np.int64)
            levels.append(rank)
            ahead *= 2
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[k][a] == levels[k][b])
            common[same] += self.v << k
            a[same] += 1 << k
            b[same] += 1 << k
        common += compare(self.x, self.samples[a], self.samples[b], self.v)
        self.table, span = [common], 1
        while 2 * span <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at sampled places i and j, i != j: the least between their ranks."""
        a, b = self.rank[self.number[i]], self.rank[self.number[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def shift(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i, and from j, to the next places that are both sampled; below v."""
        return (self.first[(j - i) % self.v] - i) % self.v


def compare(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, step: int = 1) -> np.ndarray:
    """Words that agree from i and j on, in direction `step`, at most `most`; ends at the marks by itself."""
    out, at = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(most):
        alike = x[i + step * k] == x[j + step * k]
        at, i, j = at[alike], i[alike], j[alike]
        if not len(at):
            break
        out[at] += 1
    return out


def grid(sizes: np.ndarray, starts: np.ndarray, shortest: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) for all texts and periods, in portions of about `pairs`: the points of each period's grid.

    A stretch of at least max(shortest, 2q) words has max(shortest - q, q) places i with i + q inside,
    so a grid of that step meets it.
    """
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    q = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    step = np.maximum(shortest - q, q)
    wide = np.maximum(sizes[text] - q, 0)
    count = -(-wide // step)
    ends = np.cumsum(count)
    begin = 0
    while begin < len(q):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + pairs, side="right")))
        c = count[begin:stop]
        own = np.repeat(np.arange(begin, stop), c)
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield starts[text[own]] + k * step[own], q[own]
        begin = stop


def marked(numbers: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, a mark of its own before the first and behind each; and where they start.

    `most` is beyond all word numbers. Behind the last text stand as many marks as the structure may look ahead.
    """
    sizes = np.array([len(x) for x in numbers], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    out = np.empty(int(sizes.sum()) + len(sizes) + 1 + PERIOD, np.int64)
    places = np.concatenate([starts - 1, np.arange(len(out) - PERIOD - 1, len(out))])
    out[places] = most + np.arange(len(places))
    for s, x in zip(starts, numbers, strict=True):
        out[s : s + len(x)] = x
    return out, starts


def find_runs(numbers: list[np.ndarray], shortest: int = SHORTEST, pairs: int = PAIRS) -> list[np.ndarray]:
    """All runs of each text, given as word numbers: rows of (start, length, period) by start, then period."""
    if not numbers:
        return []
    sizes = np.array([len(x) for x in numbers], np.int64)
    most = max([int(x.max()) + 1 for x in numbers if len(x)], default=0)
    x, starts = marked(numbers, most)
    found: list[tuple[np.ndarray, ...]] = []  # (i, q, words to the right, words to the left)
    for i, q in grid(sizes, starts, shortest, pairs):
        alike = np.flatnonzero(x[i] == x[i + q])
        i, q = i[alike], q[alike]
        # what agrees for a whole cover period needs the structure
        right = compare(x, i, i + q, PERIOD)
        left = compare(x, i - 1, i + q - 1, PERIOD, -1)
        long = (right == PERIOD) | (left == PERIOD) | ((right + left >= q) & (right + left + q >= shortest))
        found.append((i[long], q[long], right[long], left[long]))
    if not found:
        return [np.empty((0, 3), np.int64)] * len(numbers)
    i, q, right, left = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(starts, i, side="right") - 1

    pending = np.flatnonzero((right == PERIOD) | (left == PERIOD))
    if len(pending):
        needed, own = np.unique(text[pending], return_inverse=True)
        some = [numbers[t] for t in needed]
        forward, place = marked(some, most)
        backward, turned = marked([y[::-1] for y in some], most)
        size = sizes[needed]
        at = i[pending] - starts[text[pending]]
        for mine, values, origin, y in ((right, forward, place[own] + at, 1), (left, backward, turned[own] + size[own] - at, -1)):
            far = np.flatnonzero(mine[pending] == PERIOD)
            if not len(far):
                continue
            # in the reversed text the mirror of i + q - 1 is q before that of i - 1
            a = origin[far]
            b = a + y * q[pending[far]]
            tree = Extensions(values)
            ahead = tree.shift(a, b)  # below the period, hence already compared
            mine[pending[far]] = ahead + tree.between(a + ahead, b + ahead)
    whole = (right + left >= q) & (right + left + q >= shortest)
    i, q, right, left, text = i[whole], q[whole], right[whole], left[whole], text[whole]

    # one stretch is met at many points and with multiples of its period: the smallest is kept
    rows = np.unique(np.stack([text, i - left - starts[text], right + left + q, q], axis=1), axis=0)
    if len(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(numbers) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts, cuts[1:], strict=False)]


class _Numbers(dict):
    """Word -> its number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in some run after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


#: Columns that `periodic_runs` adds.
RESULT = "runs array<struct<start: long, length: long, period: long>>, n_runs long, start long, length long, period long, exponent_milli long, collapsed string"
FIELDS = ("runs", "n_runs", "start", "length", "period", "exponent_milli", "collapsed")


def _lists(found: list[np.ndarray]) -> pa.Array:
    """The runs of each text as an array of structs."""
    rows = np.concatenate(found)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def periodic_runs(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), shortest: int = SHORTEST) -> DataFrame:
    """All runs of the words of every whole text.

    A run is a stretch of consecutive words with smallest period q, at least max(shortest, 2q) long,
    that no neighbouring word extends. Returns the columns of `keep` and: `runs` (start, length and
    period of each, by start, then period), `n_runs`, `start`, `length` and `period` of the longest
    (ties: smallest start, then period) and `exponent_milli`, 1000 times its length over its period,
    floored; `collapsed`, the words joined by one blank without those that some run has after its
    first period.

    A null, empty or blank text has no run, four nulls and an empty `collapsed`. Each row stands for
    itself, so that ties and repeated rows do not matter; further columns are left out, so that names
    cannot clash; an empty table gives an empty one. A text is one task's work, in portions of pairs.
    """
    names = list(keep)
    if set(names) & set(FIELDS):
        raise ValueError("kept columns have the name of a result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, chars=CHARS):
            split = [words(x) for x in texts_of(batch, text)]
            number = _Numbers()
            found = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split], shortest)
            best, kept = [], []
            for w, runs in zip(split, found, strict=True):
                if len(runs):
                    top = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best.append((*top, 1000 * top[1] // top[2]))
                    w = [x for x, out in zip(w, covered(len(w), runs).tolist(), strict=True) if not out]
                else:
                    best.append((None,) * 4)
                kept.append(" ".join(w))
            longest = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, n) for n in names), _lists(found), pa.array([len(r) for r in found], pa.int64()), *longest, pa.array(kept, pa.string())],
                names=[*names, *FIELDS],
            )

    used = list(dict.fromkeys([*names, text]))
    return df.select(*used).mapInArrow(run, f"{schema_of(df, names)}, {RESULT}")


def run_lines(runs: Column) -> Column:
    """The column `runs` as one text with a line `start,length,period` for each."""
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def planted(text: Column, key: Column) -> Column:
    """The text, or for one key in ten (by CRC-32 of the key as decimal) its words with a period put in.

    With h the checksum, g = h / 10 floored and n words: from word a = g mod n on, word i is word
    a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8) floored. A null key or text stays as it is.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    every = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    put = F.element_at(F.transform(F.array(every), lambda w: F.when(F.size(w) > 0, made(w)).otherwise("")), 1)
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)) & text.isNotNull(), put).otherwise(text)
