"""Packing documents into sequences of a fixed length, by best fit and swap-based local search.

Tokenising gives each document's pieces (length and digest; ids on request), without a
shuffle. Pieces are dealt evenly into groups of about ``GROUP`` documents and each group is
packed in one task: best fit, then swap-based local search. The emptiest bin that is not
full gives one or two of its pieces to another bin and takes none, one or two back
(moves, one-for-one, one-for-two, two-for-one): first exchanges that fill the other bin to
the brim, else the one that raises the sum of squared fills most. The search of a group ends
at its lower bound or where no exchange of any two bins raises that sum; it looks at all
pieces of all bins, and no piece is ever dropped.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import flat_map_rows
from millrace.session import ship

CAPACITY, END, GROUP = 1024, 2, 8192
#: About so many bytes are a token, to estimate the number of pieces before texts are read as ids.
TOKEN_BYTES = 4
VOCABULARY = "byte_bpe_50k"
#: Characters on which the two tokenizer libraries' patterns surely agree; texts with others take the slower one.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞₠-₿]")


def encoder(name: str = VOCABULARY):
    """A function from a text to its ids (uint32) as the ``tokenizers`` library gives them.

    The same merges run in ``tiktoken`` where both surely agree, as it takes a quarter of
    the time; other texts go through ``tokenizers`` itself.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if PLAIN.search(text) or "<|" in text:
            return np.asarray(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole if it fits, else full ones after a shorter first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenised(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""

    def make():
        ids = encoder()

        def one(i, text):
            got = np.append(ids(text) if text else np.empty(0, "<u4"), np.uint32(END)).astype("<u4")
            for p, (start, n) in enumerate(cuts(len(got), capacity)):
                part = got[start : start + n]
                yield (i, p, start, n, zlib.crc32(part.tobytes()), *([part.astype(int).tolist()] if with_ids else []))

        return one

    return flat_map_rows(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, decreasing: bool = True) -> list[list[int]]:
    """Best fit, of the longest first or in the order given; bins as lists of positions in ``lengths``."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit g: some bin has a gap of g
    for i in np.argsort(-lengths, kind="stable").tolist() if decreasing else range(len(lengths)):
        n = int(lengths[i])
        fits = present >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                present ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        gap -= n
        by_gap[gap].append(b)
        present |= 1 << gap
    return bins


class Search:
    """Local search over the bins of one group; ``run`` gives those that are left."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int = CAPACITY):
        self.size, self.capacity = lengths.tolist(), capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.version = [0] * len(bins)  # what is offered of a bin holds for one version of it
        #: By the most that a bin takes in such an exchange: ``(bin, version, length given back, pieces given back)``.
        self.offers: list[list[tuple[int, int, int, tuple[int, ...]]]] = [[] for _ in range(2 * capacity + 1)]
        self.live, self.need = sum(f > 0 for f in self.fill), -(-sum(self.fill) // capacity)
        for b in range(len(bins)):
            self._offer(b)

    def _sums(self, b: int) -> dict[int, tuple[int, ...]]:
        """Pieces for each different length that one or two pieces of the bin have together, and none for 0."""
        same: dict[int, list[int]] = {}
        for i in self.bins[b]:
            same.setdefault(self.size[i], []).append(i)
        out: dict[int, tuple[int, ...]] = {0: ()} | {n: (own[0],) for n, own in same.items()}
        lengths = sorted(same)
        for k, n in enumerate(lengths):
            if len(same[n]) > 1:
                out.setdefault(2 * n, (same[n][0], same[n][1]))
            for m in lengths[k + 1 :]:
                out.setdefault(n + m, (same[n][0], same[m][0]))
        return out

    def _offer(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap and self.fill[b]:
            for n, pieces in self._sums(b).items():
                self.offers[n + gap].append((b, self.version[b], n, pieces))

    def _current(self, most: int) -> list:
        self.offers[most] = [e for e in self.offers[most] if self.version[e[0]] == e[1]]
        return self.offers[most]

    def _find(self, s: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
        """``(pieces given, bin, pieces taken back)`` of the exchange to make out of bin ``s``."""
        mine = self._sums(s)
        del mine[0]
        outs = sorted(mine, key=lambda n: (len(mine[n]), -n))
        two = lambda give, back: len(give) == len(back) == 2
        for out in outs:  # fills the other bin, so it surely raises the sum
            for b, _, n, back in reversed(self._current(out)):
                if b != s and n < out and not two(mine[out], back):
                    return mine[out], b, back
        best, found = 0, None
        for out in outs:
            for most in range(out + 1, 2 * self.capacity + 1):
                for b, _, n, back in self._current(most) if self.offers[most] else ():
                    more = out - n
                    gain = 2 * more * (self.fill[b] - self.fill[s] + more)
                    if b != s and more > 0 and gain > best and not two(mine[out], back):
                        best, found = gain, (mine[out], b, back)
        return found

    def _swap(self, s: int, give: tuple[int, ...], b: int, back: tuple[int, ...]) -> None:
        more = sum(self.size[i] for i in give) - sum(self.size[i] for i in back)
        self.bins[s] = [i for i in self.bins[s] if i not in give] + list(back)
        self.bins[b] = [i for i in self.bins[b] if i not in back] + list(give)
        self.fill[s] -= more
        self.fill[b] += more
        for x in (s, b):
            self.version[x] += 1
            self._offer(x)
        self.live -= not self.fill[s]

    def run(self) -> list[list[int]]:
        gained = True
        while gained and self.live > self.need:
            gained = False
            heap = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(heap)
            while heap and self.live > self.need:
                f, s = heapq.heappop(heap)
                if f != self.fill[s] or not (found := self._find(s)):
                    continue  # tried anew in the next pass, if this one gains anything
                give, b, back = found
                self._swap(s, give, b, back)
                gained = True
                for x in (s, b):
                    if 0 < self.fill[x] < self.capacity:
                        heapq.heappush(heap, (self.fill[x], x))
        return [b for b in self.bins if b]


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int = CAPACITY) -> list[list[int]]:
    """Exchanges out of the emptiest bins until the lower bound or no gain; ``bins`` is not changed."""
    return Search(lengths, bins, capacity).run()


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def packed(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: dealt into so many groups and packed one by one.

    The hash that deals them has a piece's place in its table beside document and digest, so
    that rows that repeat do not meet in one group.
    """
    ship(pieces.sparkSession)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = p.length.to_numpy(np.int64)
        full = int((lengths == capacity).sum())
        bins = [[i] for i in range(full)] + [[i + full for i in b] for b in pack_lengths(lengths[full:], capacity)]
        sequence, offset = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        base = int(p._group.iloc[0]) << 32
        for n, b in enumerate(bins):
            sequence[b] = base + n
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return p.assign(sequence_id=sequence, offset=offset).drop(columns="_group")

    kind = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pieces.withColumn("doc_id", F.col("doc_id").cast("string")).schema)
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(max(1, groups)))
    dealt = pieces.withColumn("_group", group).withColumn("doc_id", F.col("doc_id").cast("string"))
    return dealt.groupBy("_group").applyInPandas(pack, kind + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end token. Null doc_ids and repeated rows are
    packed as documents of their own; an empty table gives no rows. A text of any length is
    cut whole, and its pieces are dealt over the groups. Extra columns are ignored.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    return packed(tokenised(docs), -(-(size.n + (size.bytes or 0) // (TOKEN_BYTES * CAPACITY)) // group))
