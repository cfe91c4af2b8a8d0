"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected groups.

A document is its set of hashed shingles. Equal sets are one node. All shingles have one
global order: first those that a bitmap over all documents shows to be of one set only, then
the others by how far their frequency stands out in a sketch; so a prefix avoids passages that
many documents share, and its shingles of one set need no row at all. Two sets that
are similar enough share at least ``l`` shingles among the first ``n - need + l`` of
each; every document picks its own ``l`` (and so its prefix) by the cost that the sketch
estimates for it: rows to look at and candidates to verify. A pair is verified if its
prefixes share at least the smaller of the two ``l`` (more if the sizes say so).

The bitmap has about as many cells as the texts have shingles, whatever their number, at most
``MOST_CELLS``; where it fills up, more shingles count as shared, which costs rows but changes no
result. Tasks hand on the cells they meet as the gaps between them.

Groups, not pairs, are the result, so that large groups of near copies cost no square of
rows: while shared prefix shingles promise many pairs, each shingle's documents are
compared with one of them only (another in each round) and groups found so far are contracted.
What remains is tested in full: pairs of rows for short lists, and for long lists blocks of
prefixes of bounded size, two to a task, in which only documents of different groups meet.
Either way a pair must share as many prefix shingles as it calls for before whole sets are
moved, and those of named sets only; for pairs of rows, the shingles of both by ranges of hashes must
also leave room for a link. Whole sets stay in the files of the tasks that made them; copies of
one set in several of them are told apart by their place. No link between different groups is left unseen.

Shingles and sets are 64-bit hashes; among ``n`` sets two different ones collide with probability
below ``n * n / 2**65``.

Edge cases: NULL and empty texts (or texts of blanks) are empty sets, alone in their
groups; a text of fewer words than a shingle is one shingle; rows that repeat a doc_id are
nodes by their texts; the group of a row without id is named by the smallest id in it
(NULL if none); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import give_back, keep, release, small_batches, trimmed
from starfold.llm.graph import components

#: Counters of the frequency sketch; deviations above the mean counter from which a frequency stands out.
SKETCH, DEVIATIONS = 1 << 19, 6.0
#: Bounds of the bitmap's cells, bytes of text for each cell, and cells of one of the pieces it is made in.
LEAST_CELLS, MOST_CELLS, BYTES_A_CELL, PIECE = 1 << 20, 1 << 29, 6, 1 << 20
#: Cells (4 bytes each) a task holds before it hands them on.
HELD = 4_000_000
#: Longest ``l``; cost of verifying a candidate in rows of a prefix list.
MOST_SHARED, VERIFY_COST = 16, 8.0
#: Lists up to this length are tested as pairs of rows; longer ones in blocks of so many rows and bytes at most.
SHORT_LIST, BLOCK_ROWS, BLOCK_BYTES = 24, 8_192, 12 << 20
#: Rounds with one centre per list, at most; they end when the lists promise few pairs, or when a
#: round closes fewer than this share of the open rows.
ROUNDS, LEAST_GAIN = 6, 0.1
#: A list of ids up to this length is broadcast (16 MB); a longer one is joined by a shuffle.
SMALL_LIST = 1_000_000
#: Bits of the filter that picks the sets to be fetched.
FILTER_BITS = 1 << 25
#: Ranges of hashes (a power of two) in which the shingles of a set are counted.
RANGES = 128

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def hashed(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and of its shingles of ``size`` words, by place.

    Words end at blanks and 0x09-0x0D; fewer words than ``size`` are one shingle.
    """
    words = text.encode().translate(_FOLD).split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not words:
        return h, h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = _mix(out * _A + h[j : j + n])
    return h, out


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(hashed(text, size)[1])


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return (h % np.uint64(cells)).astype(np.int64)


def set_id(hashes: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


class Threshold:
    """Similarity ``num / den`` in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_shared(self, n: int) -> int:
        """Shared shingles that a set of ``n`` needs with any similar one."""
        return -(-self.num * n // self.den)

    def least_of_pair(self, n: int, m: int) -> int:
        """Shared shingles that sets of ``n`` and ``m`` need to be similar."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def linked(self, shared, n, m):
        return self.den * shared >= self.num * (n + m - shared)


class Order:
    """The global order of shingles, from the sketch and the bitmap over all documents."""

    def __init__(self, counts: np.ndarray, shared: np.ndarray):
        mean = float(counts.mean())
        stands_out = counts - int(mean + DEVIATIONS * math.sqrt(mean) + 1)
        self.excess = np.clip(stands_out, 0, 2**31 - 1).astype(np.int32)
        self.bits = shared

    def is_shared(self, h: np.ndarray) -> np.ndarray:
        """Whether a shingle may be one of two different sets."""
        at = _cell(h, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def prefix(self, s: np.ndarray, limit: Threshold) -> tuple[np.ndarray, int]:
        """The shared shingles in the prefix of a set, and the number of them it calls for."""
        n = len(s)
        shared, excess = self.is_shared(s), self.excess[_cell(s, SKETCH)]
        order = np.lexsort((excess, shared))  # stable: ties stay in the order of their hashes
        need = limit.least_shared(n)
        base = n - need + 1
        lists = np.cumsum(np.where(shared, 1.0 + excess, 0.0)[order[: base + MOST_SHARED - 1]])
        best, cost = 1, math.inf
        for times in range(1, min(MOST_SHARED, need) + 1):
            rows = lists[base + times - 2]
            now = rows + VERIFY_COST * rows / times**2
            if now < cost - 1e-9:
                best, cost = times, now
        first = order[: base + best - 1]
        return s[first[shared[first]]], best


def _packed(cells: np.ndarray) -> bytes:
    """Rising cells of a piece as the numbers of cells between them; a byte 255 stands for 255 and goes on."""
    gaps = np.diff(cells, prepend=-1) - 1
    wide = gaps // 255
    out = np.full(len(gaps) + wide.sum(), 255, dtype=np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(wide)] = gaps % 255
    coder = zlib.compressobj(strategy=zlib.Z_HUFFMAN_ONLY)
    return coder.compress(out.tobytes()) + coder.flush()


def _unpacked(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    ends = gaps < 255
    return np.cumsum(gaps + ends.astype(np.int64))[ends] - 1


def _in_ranges(s: np.ndarray) -> bytes:
    """How many shingles of a set are in each range of hashes, in as few bytes as hold them."""
    counts = np.bincount((s >> np.uint64(65 - RANGES.bit_length())).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _most_common(p: bytes, q: bytes) -> int:
    """Shingles that two sets can share at most, by their counts in ranges."""
    p, q = (np.frombuffer(raw, dtype=np.uint8 if len(raw) == RANGES else np.uint32) for raw in (p, q))
    return int(np.minimum(p, q).sum(dtype=np.int64))


def describe(docs: DataFrame, size: int) -> tuple[DataFrame, Order]:
    """(doc_id, n_shingles, sid) of every row, and the order of shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cells = -(-min(max(LEAST_CELLS, total // BYTES_A_CELL), MOST_CELLS) // PIECE) * PIECE
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "sid": pa.int64(), "piece": pa.int32(), "once": pa.binary(), "twice": pa.binary()}
    schema = "doc_id long, n_shingles long, sid long, piece int, once binary, twice binary"

    def batch_of(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, done, held = np.zeros(SKETCH, dtype=np.int32), set(), []

        def hand_on() -> Iterator[pa.RecordBatch]:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(at, np.arange(0, cells + 1, PIECE, dtype=np.uint32))
            for k in range(len(edges) - 1):
                part = slice(edges[k], edges[k + 1])
                if edges[k] < edges[k + 1]:
                    own = at[part].astype(np.int64) - k * PIECE
                    yield batch_of(1, piece=[k], once=[_packed(own)], twice=[_packed(own[times[part] > 1])])

        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            names = [set_id(s) if len(s) else None for s in sets]
            fresh = []
            for name, s in zip(names, sets):
                if name is not None and name not in done:
                    done.add(name)
                    fresh.append(s)
            held += [_cell(s, cells).astype(np.uint32) for s in fresh]
            yield batch_of(len(sets), doc_id=batch.column("doc_id"), n_shingles=[len(s) for s in sets], sid=names)
            if fresh:
                at, times = np.unique(_cell(np.concatenate(fresh), SKETCH), return_counts=True)
                counts[at] += times.astype(np.int32)
            if sum(map(len, held)) >= HELD:
                yield from hand_on()
        if held:
            yield from hand_on()
        yield batch_of(1, piece=[-1], once=[zlib.compress(counts.tobytes(), 1)])

    both = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema), "sets")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice"))):
                one, two = _unpacked(once), _unpacked(twice)
                old = seen.setdefault(k, [np.zeros(PIECE, dtype=bool), np.zeros(PIECE, dtype=bool)])
                old[1][two] = True
                old[1][one[old[0][one]]] = True
                old[0][one] = True
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array(list(seen), pa.int32()),
            "twice": pa.array([zlib.compress(np.packbits(v[1], bitorder="little").tobytes(), 1) for v in seen.values()], pa.binary()),
        })

    pieces = both.filter("piece >= 0").select("piece", "once", "twice")
    merged = pieces.repartition(min(cells // PIECE, 512), "piece").mapInArrow(trimmed(merge), "piece int, twice binary")
    shared = np.zeros(cells // 8, dtype=np.uint8)
    for r in merged.collect():  # as many bytes as the bitmap has, at most
        shared[r["piece"] * PIECE // 8 : (r["piece"] + 1) * PIECE // 8] = np.frombuffer(zlib.decompress(r["twice"]), dtype=np.uint8)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("once").to_pylist():
                counts += np.frombuffer(zlib.decompress(raw), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"once": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    rows = keep(both.filter("piece IS NULL").select("doc_id", "n_shingles", "sid"), "set-names")
    counts = np.zeros(SKETCH, dtype=np.int64)
    for r in both.filter("piece = -1").select("once").repartition(16).mapInArrow(trimmed(add), "once binary").collect():
        counts += np.frombuffer(zlib.decompress(r["once"]), dtype=np.int64)
    release(both)
    return rows, Order(counts, shared)


def prefix_rows(docs: DataFrame, size: int, limit: Threshold, order: Order) -> DataFrame:
    """token, sid, n for every prefix shingle that different sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            tokens, sids, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, size)
                if not len(s):
                    continue
                sid = set_id(s)
                if sid in done:
                    continue
                done.add(sid)
                first, _ = order.prefix(s, limit)
                tokens.append(first)
                sids.append(np.full(len(first), sid, dtype=np.int64))
                sizes.append(np.full(len(first), len(s), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes))],
                    names=["token", "sid", "n"],
                )

    every = keep(docs.select("text").mapInArrow(trimmed(run), "token long, sid long, n long"), "prefixes")
    sets = Window.partitionBy("token").orderBy("sid")
    near = every.repartition("token").distinct().select("*", F.lag("sid").over(sets).alias("lo"), F.lead("sid").over(sets).alias("hi"))
    out = keep(near.filter("lo IS NOT NULL OR hi IS NOT NULL").select("token", "sid", "n"), "shared-prefixes")
    del near
    release(every)
    return out


class Sets(NamedTuple):
    """Sets as tasks wrote them (with ``place``, a number of its own for each row), and the place of each sid to read it from."""

    rows: DataFrame
    places: DataFrame

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The sets that ``rows`` (written) name, once each; with a list of places that is short enough to broadcast, no other set moves."""
        ids = rows.select(F.explode(F.array(*columns)).alias("sid")).distinct()
        at = keep(self.places.join(ids, "sid", "left_semi").select("place"), "named-sets")
        return self.rows.join(F.broadcast(at) if at.count() <= SMALL_LIST else at, "place", "left_semi")


def fetch_sets(docs: DataFrame, wanted: DataFrame, size: int, limit: Threshold, order: Order) -> Sets:
    """sid, n, hashes (8 bytes each, sorted), prefix (likewise), shared and ranges of the sets in ``wanted`` (distinct sid).

    A bitmap of fixed size picks them from the texts in tasks, which write them; what it lets through besides, and
    copies of a set that another task wrote, stay where they are and are read from no place.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = batch.column("sid").to_numpy() & (FILTER_BITS - 1)
            np.bitwise_or.at(mask, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        byte = np.flatnonzero(mask)
        yield pa.RecordBatch.from_pydict({"byte": pa.array(byte.astype(np.int32)), "bits": pa.array(mask[byte].astype(np.int32))})

    filled = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    found = wanted.select("sid").mapInArrow(trimmed(bits), "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled[found.column("byte").to_numpy()] = found.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = shingles(text, size)
                if not len(s):
                    continue
                sid = set_id(s)
                at = sid & (FILTER_BITS - 1)
                if sid not in done and filled[at >> 3] >> (at & 7) & 1:
                    done.add(sid)
                    first, shared = order.prefix(s, limit)
                    out.append((sid, len(s), s.tobytes(), first.tobytes(), shared, _in_ranges(s)))
            if out:
                columns = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["sid", "n", "hashes", "prefix", "shared", "ranges"]
                )

    picked = docs.select("text").mapInArrow(trimmed(run), "sid long, n long, hashes binary, prefix binary, shared int, ranges binary")
    rows = keep(picked.withColumn("place", F.monotonically_increasing_id()), "picked-sets")
    return Sets(rows, keep(rows.groupBy("sid").agg(F.min("place").alias("place")), "set-places"))


def verified(pairs: DataFrame, sets: Sets, limit: Threshold) -> DataFrame:
    """The linked ones of ``pairs`` (a, b; written).

    The multi-match test and the counts in ranges come first and move no whole set; whole sets move for the pairs that pass them.
    """

    def both(rows: DataFrame, *columns: str) -> DataFrame:
        some = sets.named(rows, "a", "b")
        sides = [some.select(F.col("sid").alias(k), F.struct(*columns).alias(v)) for k, v in (("a", "x"), ("b", "y"))]
        return rows.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")

    def common(p: bytes, q: bytes) -> int:
        p, q = (np.frombuffer(raw, dtype=np.uint64) for raw in (p, q))
        return len(np.intersect1d(p, q, assume_unique=True))

    def match(x: dict, y: dict) -> bool:
        # the prefix that ends first lacks at most what its set may lack of the pair's need
        need = limit.least_of_pair(x["n"], y["n"])
        calls = min(need - limit.least_shared(z["n"]) + z["shared"] for z in (x, y))
        return limit.linked(_most_common(x["ranges"], y["ranges"]), x["n"], y["n"]) and common(x["prefix"], y["prefix"]) >= calls

    def link(x: dict, y: dict) -> bool:
        return limit.linked(common(x["hashes"], y["hashes"]), len(x["hashes"]) // 8, len(y["hashes"]) // 8)

    def passing(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
                good = pa.array([test(u, v) for u, v in zip(x, y)], pa.bool_())
                yield batch.select(["a", "b"]).filter(good)

        return run

    near = keep(both(pairs, "n", "prefix", "shared", "ranges").mapInArrow(trimmed(passing(match)), "a long, b long"), "near-pairs")
    return both(near, "hashes").mapInArrow(trimmed(passing(link)), "a long, b long")


def _in_range(limit: Threshold, n, m):
    """Sizes that can be similar."""
    return (limit.den * F.least(n, m)) >= (limit.num * F.greatest(n, m))


def _candidates(x: int, token: int, prefixes: list, flat: np.ndarray, owner: np.ndarray, n: np.ndarray, slack: np.ndarray, limit: Threshold) -> np.ndarray:
    """Which sets pass the multi-match test with set ``x`` and meet it in no list of a smaller token."""
    lo = np.searchsorted(flat, prefixes[x], side="left")
    wide = np.searchsorted(flat, prefixes[x], side="right") - lo
    places = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
    shared = np.bincount(owner[places], minlength=len(prefixes))
    least = np.zeros(len(prefixes), dtype=np.uint64)
    least[owner[places][::-1]] = flat[places][::-1]  # tokens rise, so the smallest is written last
    need = -(-limit.num * (n[x] + n) // (limit.num + limit.den))
    ok = (shared >= np.maximum(need + np.minimum(slack[x], slack), 1)) & (least == np.uint64(token))
    return ok & (limit.den * np.minimum(n[x], n) >= limit.num * np.maximum(n[x], n))


class _Block:
    """Members of two blocks of one list, as they come to a task."""

    def __init__(self, key: tuple, members: pa.Table, limit: Threshold):
        self.limit, self.token = limit, np.int64(key[0].as_py()).view(np.uint64)
        self.sid, self.comp, self.at, self.n, l = (members.column(c).to_numpy() for c in ("sid", "comp", "at", "n", "shared"))
        self.prefixes = [np.sort(np.frombuffer(b.as_py(), dtype=np.uint64)) for b in members.column("prefix")]
        self.flat, self.owner = self._index(self.prefixes)
        _, self.group = np.unique(self.comp, return_inverse=True)
        self.slack = l - -(-limit.num * self.n // limit.den)
        self.across = key[1].as_py() != key[2].as_py()

    @staticmethod
    def _index(sets: list) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    def seekers(self) -> np.ndarray:
        """Members outside the commonest group."""
        return np.flatnonzero(self.group != np.bincount(self.group).argmax())

    def candidates(self, x: int) -> np.ndarray:
        ok = _candidates(x, self.token, self.prefixes, self.flat, self.owner, self.n, self.slack, self.limit) & (self.group != self.group[x])
        return ok & (self.at != self.at[x]) if self.across else ok


def _block_links(rows: DataFrame, sets: Sets, limit: Threshold) -> DataFrame:
    """Links between different groups in long lists, enough to join what any link joins.

    ``rows`` (token, sid, comp, n; written) are dealt into blocks of their list, sized by whole sets, two to a task. First
    with their prefixes: members that pass the multi-match test with one of another group stay. Then these
    alone with whole sets: a member that its task has joined to another is not compared with it again.
    """
    spread = keep(rows.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.col("n") * 8 + 64).alias("bytes")), "long-lists")
    parts = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    per = spread.select("token", parts.alias("parts"))
    placed = (
        rows.join(F.broadcast(per) if spread.count() <= SMALL_LIST else per, "token")
        .withColumn("at", F.pmod(F.xxhash64("sid", "token"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "token", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "sid", "comp",
        )
    )
    fields = ["token", "i", "j", "at", "sid", "comp"]

    def stay(key, members):
        block = _Block(key, members, limit)
        open_ = np.zeros(len(block.sid), dtype=bool)
        for x in block.seekers():
            found = block.candidates(x)
            if found.any():
                open_ |= found
                open_[x] = True
        if members.nbytes > BLOCK_BYTES // 8:
            del block
            give_back()
        return members.select(fields).filter(pa.array(open_))

    def link(key, members):
        block = _Block(key, members, limit)
        whole = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in members.column("hashes")]
        flat, owner = block._index(whole)
        up = list(range(int(block.group.max()) + 1))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        out = []
        for x in block.seekers():
            ok = block.candidates(x)
            if not ok.any():
                continue
            lo = np.searchsorted(flat, whole[x], side="left")
            wide = np.searchsorted(flat, whole[x], side="right") - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
            shared = np.bincount(owner[places], minlength=len(whole))
            for y in np.flatnonzero(ok & limit.linked(shared, block.n[x], block.n)):
                a, b = root(block.group[x]), root(block.group[y])
                if a != b:
                    up[a] = b
                    out.append((int(block.sid[x]), int(block.sid[y])))
        if members.nbytes > BLOCK_BYTES // 8:
            del block, whole, flat, owner
            give_back()
        return pa.table({"a": pa.array([min(o) for o in out], pa.int64()), "b": pa.array([max(o) for o in out], pa.int64())})

    with_prefix = placed.join(sets.named(rows, "sid").select("sid", "n", "shared", "prefix"), "sid")
    left = keep(
        with_prefix.groupBy("token", "i", "j").applyInArrow(stay, "token long, i int, j int, at int, sid long, comp long"), "open-blocks"
    )
    return left.join(sets.named(left, "sid").select("sid", "n", "shared", "prefix", "hashes"), "sid").groupBy("token", "i", "j").applyInArrow(link, "a long, b long")


def memberships(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, sid (name of the set, NULL if it is empty), component (a set of its group) of every row."""
    limit = Threshold(num, den)
    rows, order = describe(docs, size)
    lists = prefix_rows(docs, size, limit, order)
    wanted = keep(lists.select("sid").distinct(), "wanted-sets")
    member = None
    if not wanted.isEmpty():
        sets = fetch_sets(docs, wanted, size, limit, order)
        links = _links(lists, sets, limit)
        member = components(links).withColumnRenamed("node", "sid")
        release(*sets)
    release(lists, wanted)
    if member is None:
        return rows.withColumn("component", F.col("sid"))
    return rows.join(member, "sid", "left").select("doc_id", "n_shingles", "sid", F.coalesce("component", "sid").alias("component"))


def groups(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = keep(memberships(docs, size, num, den), "memberships")
    named = rows.filter("sid IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _links(lists: DataFrame, sets: Sets, limit: Threshold) -> DataFrame:
    """Links whose components are those of all links."""
    spark = lists.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    tried = links
    n_rows = open_rows = lists.count()
    now = lists.withColumn("comp", F.col("sid"))
    for turn in range(ROUNDS + 1):
        if turn:
            member = components(links).withColumnRenamed("node", "sid")
            # groups only grow: a list without pairs of different groups gets none
            now = held.select("token", "sid", "n").join(member, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")
        hub = F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), F.col("sid").alias("s"), F.col("comp").alias("k"), F.col("n").alias("m"))
        per = now.select("token", "comp", F.lit(1).alias("c"), hub.alias("hub"))  # at first each set is its own group
        if turn:
            per = per.repartition("token").groupBy("token", "comp").agg(F.count("*").alias("c"), F.min("hub").alias("hub"))
        left = per.groupBy("token").agg(
            F.sum("c").alias("all"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.min("hub").alias("hub")
        ).filter("pairs > 0")
        now = keep(now.join(left, "token"), "open-lists")
        if turn:
            release(held)
        held = now
        promised = now.groupBy("token").agg(F.first("pairs").alias("p")).agg(F.sum("p")).first()[0] or 0
        before, open_rows = open_rows, now.count()
        if promised <= 2 * n_rows or turn == ROUNDS or turn and open_rows > (1 - LEAST_GAIN) * before:
            break
        spokes = now.filter(
            (F.col("comp") != F.col("hub.k")) & _in_range(limit, F.col("n"), F.col("hub.m"))
        ).select(F.least("sid", "hub.s").alias("a"), F.greatest("sid", "hub.s").alias("b")).distinct()
        fresh = keep(spokes.join(tried, ["a", "b"], "left_anti"), "spokes")
        found = keep(verified(fresh, sets, limit), "links")
        tried = tried.unionByName(fresh)
        if found.isEmpty():
            continue
        links = links.unionByName(found)
    short, long_ = now.filter(F.col("all") <= SHORT_LIST), now.filter(F.col("all") > SHORT_LIST)
    a = short.select("token", F.col("sid").alias("a"), F.col("comp").alias("ka"), F.col("n").alias("na"))
    b = short.select("token", F.col("sid").alias("b"), F.col("comp").alias("kb"), F.col("n").alias("nb"))
    pairs = a.join(b, "token").filter(
        (F.col("a") < F.col("b")) & (F.col("ka") != F.col("kb")) & _in_range(limit, F.col("na"), F.col("nb"))
    ).select("a", "b").distinct()
    fresh = keep(pairs.join(tried, ["a", "b"], "left_anti"), "short-pairs")
    rest = verified(fresh, sets, limit).unionByName(_block_links(long_.select("token", "sid", "comp", "n"), sets, limit))
    return keep(links.unionByName(rest).distinct(), "links")


def keep_first(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` without the documents of a group other than its first; same columns.

    The first of a group is the one with the smallest doc_id (of several with that id, the one whose set
    has the smallest name). Rows without words stay, as do rows without id; of rows with the same id and the
    same set one stays (the one whose text hashes lowest). Texts that share an id but no group all stay.
    """
    known = memberships(docs, size, num, den).filter("doc_id IS NOT NULL")
    first = known.filter("sid IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "sid")).alias("first"))
    judged = known.join(first, "component", "left").select(
        "doc_id", "sid", (F.col("sid").isNull() | (F.struct("doc_id", "sid") == F.col("first"))).alias("stays")
    )
    per = keep(
        judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("stays").alias("all_stay"), F.max("stays").alias("some_stay")), "decided"
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = per.filter("rows = 1 AND NOT all_stay").select(F.col("doc_id").alias("id"))
    many = per.filter("rows > 1").select(F.col("doc_id").alias("id"))
    n_once, n_many = per.agg(F.count_if((F.col("rows") == 1) & ~F.col("all_stay")), F.count_if(F.col("rows") > 1)).first()
    small = lambda ids, n: F.broadcast(ids) if n <= SMALL_LIST else ids
    id_ = F.col("row")["doc_id"].cast("long")
    out = whole.join(small(once, n_once), id_ == F.col("id"), "left_anti")
    if n_many:
        own = keep(judged.join(small(many, n_many), F.col("doc_id") == F.col("id"), "left_semi").filter("stays").distinct(), "repeated-ids")
        again = _with_set_id(whole.join(small(many, n_many), id_ == F.col("id"), "left_semi"), size)
        kept = again.join(own, (id_ == F.col("doc_id")) & F.col("set").eqNullSafe(F.col("sid")), "left_semi")
        best = F.struct(F.xxhash64(F.col("row")["text"]).alias("h"), F.col("row")["text"].alias("t"))
        kept = kept.groupBy(id_.alias("id"), "set").agg(F.min_by("row", best).alias("row")).select("row")
        out = out.join(small(many, n_many), id_ == F.col("id"), "left_anti").unionByName(kept)
    return out.select("row.*")


def _with_set_id(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (row: struct with text) with the name of each text's set."""
    texts = rows.withColumn("text", F.col("row")["text"])
    schema = T.StructType([*texts.schema.fields, T.StructField("set", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            names = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=["row", "text", "set"])

    return texts.mapInArrow(trimmed(run), schema).drop("text")
