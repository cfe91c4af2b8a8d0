"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one automaton. A document streams its words through it; the
state gives the longest match that ends at each word. A match of ``window`` words or
more hits its words; an item of fewer words is hit where it occurs whole. Items are
dealt into blocks of bounded size, one automaton each. With several blocks, each is a pass of
its own over the texts, whose few hits are written; they are united by text (two hashes of 64
bits and the length), so a worker holds one automaton at a time.

Edge cases: a NULL or empty text has no words and no hits; an item without words (or
NULL) is no window; an item without an id hits words but is not listed; items that
share an id count once; without items nothing is hit; repeated documents are treated
alike; other columns are kept, as one struct, and may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import keep, small_batches, trimmed

WINDOW = 10
#: Words of the items in one automaton (about twice as many states, some 150 MB at this bound).
BLOCK_WORDS = 150_000

#: Lower-cases A-Z; every byte outside 0-9, a-z and the non-ASCII range becomes a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

_SPAN = "array<struct<first:bigint,last:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of all items; ``listed[s]`` are the items holding the window that state ``s`` stands for."""

    _made: dict[bytes, Automaton] = {}

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.listed: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, words in items:
            self._list(name, words)
        # the nearest state at or above each one that stands for a whole short item
        self.above = [-1] * len(self.step)
        if self.short:
            for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
                self.above[s] = s if s in self.short else self.above[self.link[s]]

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        """The automaton of these items, built once per worker."""
        key = hashlib.sha256(repr((window, items)).encode()).digest()
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(items, window)
        return cls._made[key]

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The part of ``q`` that is one word longer than ``p``, as a state of its own."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _list(self, name: str | None, words: list[bytes]) -> None:
        names = set() if name is None else {name}
        state = 0
        for i, w in enumerate(words, 1):
            state = self.step[state][w]
            if i >= self.window:
                self.listed.setdefault(self._suffix(state, self.window), set()).update(names)
        if 0 < len(words) < self.window:
            at = self._suffix(state, len(words))
            self.short.setdefault(at, (len(words), set()))[1].update(names)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first and last word, merged, in order) and the items whose windows occur."""
        step, link, length, window = self.step, self.link, self.length, self.window
        above, short = self.above, self.short
        marks: list[tuple[int, int]] = []
        ends: set[int] = set()
        state = size = 0
        for i, w in enumerate(words):
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                ends.add(self._suffix(state, window))
                marks.append((i - window + 1, i))
            if short:
                at = above[state]
                if at == state and size < short[at][0]:
                    at = above[link[at]]
                if at >= 0:
                    marks.append((i - short[at][0] + 1, i))
                    ends.add(-at)
        items: set[str] = set()
        for s in ends:
            if s > 0:
                items |= self.listed[s]
                continue
            at = -s
            while at >= 0:
                items |= short[at][1]
                at = above[link[at]]
        return _merged(marks), items


def _merged(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(marks):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The items (item, text, block) with words, dealt into blocks of about ``BLOCK_WORDS`` words, and the number of blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(words_of(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["item", "text", "n"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    counted = keep(items.mapInArrow(trimmed(count), "item string, text string, n long").filter("n > 0"), "benchmark-items")
    number = max(1, math.ceil((counted.agg(F.sum("n")).first()[0] or 0) / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(number)).cast("int").alias("block")
    return counted.select("item", "text", block), number


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs``), n_words, spans (hit words, merged), items (ids that occur) of every row."""
    small_batches(docs.sparkSession)
    items, blocks = _blocks(benchmark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if blocks == 1:
        return _pass(rows, items, window).drop("text")
    key = [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(6)).alias("k2"), F.length("text").alias("k3")]
    texts = rows.select("text", *key)
    found = []
    for number in range(blocks):
        hit = _pass(texts, items.filter(F.col("block") == number), window).filter(F.size("spans") > 0)
        found.append(keep(hit.select("k1", "k2", "k3", "spans", "items").dropDuplicates(["k1", "k2", "k3"]), "benchmark-hits"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    united = all_.groupBy("k1", "k2", "k3").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = rows.select("row", "text", *key).join(united, ["k1", "k2", "k3"], "left")
    return _counted(joined.select("row", "text", "spans", "items")).drop("text")


def _with_words(docs: DataFrame, added: Callable[[list[list[bytes]], pa.RecordBatch], tuple[list, list]]) -> DataFrame:
    """``docs`` with n_words, and with the spans and items that ``added`` gives for the words of the texts of a batch."""
    base = [f for f in docs.schema.fields if f.name not in ("spans", "items")]
    schema = T.StructType([*base, *T._parse_datatype_string(f"n_words long, spans {_SPAN}, items array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            spans, items = added(words, batch)
            new = [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], _SPAN_TYPE),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in base), *new], names=[f.name for f in schema.fields])

    return docs.mapInArrow(trimmed(run), schema)


def _pass(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``docs`` (with text) scanned for one block of items, which goes through the driver: ``BLOCK_WORDS`` words, or one longer item."""
    block = sorted(((r["item"], words_of(r["text"])) for r in items.collect()), key=repr)

    def match(words: list[list[bytes]], _: pa.RecordBatch) -> tuple[list, list]:
        automaton = Automaton.of(block, window)
        found = [automaton.match(w) for w in words]
        return [s for s, _ in found], [i for _, i in found]

    return _with_words(docs, match)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` (with text, spans, items of all blocks) with merged spans and n_words."""

    def merge(_: list[list[bytes]], batch: pa.RecordBatch) -> tuple[list, list]:
        spans = [_merged([(p["first"], p["last"]) for p in s or ()]) for s in batch.column("spans").to_pylist()]
        return spans, [i or () for i in batch.column("items").to_pylist()]

    return _with_words(docs, merge)


def n_hit():
    """Hit words of a scanned document."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        F.col("row")["doc_id"].alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list) -> str:
    """``text`` without the hit words and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : places[s["first"]][0]])
        at = places[s["last"]][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    span_words: int | None = None,
    coverage: float = 0.0,
) -> DataFrame:
    """``docs`` cleaned, with the same columns.

    A document goes if more than ``coverage`` of its words are hit. In those that stay,
    spans of at least ``span_words`` hit words (default: every span) are cut out.
    """
    scanned = scan(docs, benchmark, window)
    kept = scanned.filter(F.col("n_words") * coverage >= n_hit())
    if coverage <= 0:
        return kept.select("row.*")
    schema, at = docs.schema, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("row").flatten()
            texts = [
                without_spans(t, [s for s in own if s["last"] - s["first"] + 1 >= (span_words or 1)]) if own else t
                for t, own in zip(arrays[at].to_pylist(), batch.column("spans").to_pylist())
            ]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return kept.select("row", "spans").mapInArrow(trimmed(cut), schema)


#: The query op6 in SQL.
SQL = """
WITH items AS (
  SELECT item_id::varchar AS item, regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT k FROM windows
), grams AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM docs, sizes, unnest(range(1, len(w) - k + 2)) AS r(i)
), found AS (SELECT doc_id, i, grams.k AS k, item FROM grams JOIN windows USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit,
       coalesce(listed.n, 0)::bigint AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
