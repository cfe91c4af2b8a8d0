"""Collocations from a weighted de Bruijn graph of words.

Texts fall into pieces and words. First a count of word and word-pair hashes marks, in a bitmap of
fixed size, what may be frequent; a pair that is not splits its piece into runs, since no
frequent phrase spans it. (A bit set by chance only keeps a run longer: counts are exact, of real words.)
The graph's nodes are three words, its edges four: every edge is counted, and so is the
last node of every run, its last pair and its last word. Shorter counts follow from these: a
node's count is the flow along its outgoing edges plus the runs that end in it, a pair's the flow
through the nodes it begins plus the runs it ends, and a word's likewise.

Frequent edges that join at nodes with one way in and one way out are compacted into paths (by
pointer doubling; a path is stored in stretches of bounded length). Paths give the four-word
candidates, and cover the nodes along them once each.

Edge cases: a NULL text has no words, a NULL language is ``und``; repeated rows and ids count
every time; ties in a score fall to the smaller cut, ties in a rank to count and phrase; no
rows, or no phrase frequent enough, give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import drop_shuffles, keep, partitions, release, small_batches
from starfold.llm.spans import PAD, hash_spans, pair

#: Least count of a phrase; a longer one covers it at this share of its count; phrases reported of a language.
LEAST, COVER, TOP = 30, (80, 100), 2_000
#: Bits of the bitmap of words and pairs that may be frequent (a full bitmap prunes nothing; results stay the same).
FILTER_BITS = 27
#: Bits of a hash that are counted, and those of them that name a range (of ``FILTER_BITS - PART_BITS`` bits in the bitmap, three at least).
KEY_BITS, PART_BITS = 40, 12
#: Bytes of text worked on at once, hashes held by a task before they are passed on, edges of a stored path.
BLOCK, HELD, STRETCH = 1 << 22, 1 << 22, 1_024
#: Difference of the second hash's seed.
LANE = 0x94D049BB133111EB
#: Copies of a word's count, so that a common word's phrases meet it in several tasks.
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_BREAKS = [bytes([c]) for c in b".,;:!?\n\x0b\x0c\r"]


def _stretches(raw: bytes, most: int) -> Iterator[bytes]:
    """``raw`` in stretches that end at breaks, of ``most`` bytes where there is a break in reach."""
    at = 0
    while len(raw) - at > most:
        end = max(raw.rfind(b, at, at + most) for b in _BREAKS)
        if end < 0:
            end = min((e for b in _BREAKS if (e := raw.find(b, at + most)) >= 0), default=len(raw) - 1)
        yield raw[at : end + 1]
        at = end + 1
    if at < len(raw):
        yield raw[at:]


class Words:
    """The words of one block of texts: places in the lower-cased bytes, languages, links and hashes."""

    def __init__(self, raw: list[bytes], langs: list[int]):
        data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(PAD), dtype=np.uint8)
        kind = _KIND[data]
        kind[-PAD:] = _BREAK
        self.data = _LOWER[data]
        word = (kind == 0).view(np.int8)
        edge = np.diff(word, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        #: whether word i + 1 follows word i in a piece
        self.link = np.append(breaks[self.start[1:]] == breaks[self.end[:-1] - 1], False) if len(self.start) else np.zeros(0, bool)
        bounds = np.cumsum([len(r) + 1 for r in raw])
        self.lang = np.array(langs, dtype=np.int64)[np.searchsorted(bounds, self.start, side="right")] if len(self.start) else np.zeros(0, np.int64)

    def hashes(self, seeds: list[int], lane: int = 0) -> np.ndarray:
        """Hash of every word with its language (``seeds`` has one a language)."""
        return hash_spans(self.data, self.start, self.end, np.array(seeds, dtype=np.uint64)[self.lang] ^ np.uint64(lane * LANE))

    def strings(self, which: np.ndarray) -> pa.Array:
        return pa.array([self.data[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.end[which].tolist())], pa.binary()).cast(pa.string())


def _pairs(h: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Hash of the pair that begins at each linked word."""
    at = np.flatnonzero(link)
    return pair(h[at], h[at + 1])


def _seed(lang: str) -> int:
    h = 0xCBF29CE484222325
    for c in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Blocks of about ``BLOCK`` bytes of text with the languages in them."""
    raw, langs, names, size = [], [], {}, 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for text, lang in zip(texts, batch.column("lang").to_pylist()):
            if not text.is_valid:
                continue
            for part in _stretches(text.as_py(), BLOCK):
                raw.append(part)
                langs.append(names.setdefault(lang, len(names)))
                size += len(part)
                if size >= BLOCK:
                    yield Words(raw, langs), list(names)
                    raw, langs, names, size = [], [], {}, 0
    if raw:
        yield Words(raw, langs), list(names)


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, all lowest ones first: the upper ones are alike and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def may_be_frequent(texts: DataFrame, least: int, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap (``bits`` sets its fixed size) of the hashes of words and pairs that occur ``least`` times or more.

    Tasks count the upper ``KEY_BITS`` bits of hashes, which are passed on in packed ranges; a range is also a page of
    the bitmap. Counts stop at what two bytes hold, and so does the threshold.
    """
    inside, page = KEY_BITS - PART_BITS, 1 << (bits - PART_BITS)
    most = (1 << 16) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            edges = np.searchsorted(keys, np.arange((1 << PART_BITS) + 1, dtype=np.uint64) << np.uint64(inside))
            parts = np.flatnonzero(np.diff(edges))
            own = (keys & np.uint64((1 << inside) - 1)).astype(np.uint32)
            counts = np.minimum(counts, most).astype(np.uint16)
            spans = [slice(a, b) for a, b in zip(edges[parts], edges[parts + 1])]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(parts.astype(np.int32)),
                "keys": pa.array([_planes(np.diff(own[x], prepend=np.uint32(0))) for x in spans], pa.binary()),
                "counts": pa.array([_planes(counts[x]) for x in spans], pa.binary()),
            })

        for words, names in _blocks(batches):
            h = words.hashes([_seed(n) for n in names])
            for keys in (h, _pairs(h, words.link)):
                u, c = np.unique(keys >> np.uint64(64 - KEY_BITS), return_counts=True)
                held.append((u, c.astype(np.int64)))
                size += len(u)
            if size > HELD:
                held = [_tally(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*_tally(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            keys, counts = _tally(held)
            marks = np.zeros(page, dtype=bool)
            marks[keys[counts >= min(least, most)] >> np.uint32(inside + PART_BITS - bits)] = True
            return pa.RecordBatch.from_pydict({
                "part": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()),
            })

        for batch in batches:
            for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                if part != now:
                    if held:
                        yield done()
                    now, held, size = part, [], 0
                held.append((np.cumsum(_from_planes(keys, np.uint32), dtype=np.uint32), _from_planes(counts, np.uint16).astype(np.int64)))
                size += len(held[-1][0])
                if len(held) > 1 and size > HELD:
                    held = [_tally(held)]
                    size = len(held[0][0]) // 2
        if held:
            yield done()

    packed = texts.mapInArrow(run, "part int, keys binary, counts binary")
    ranged = packed.repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part")
    marks = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in ranged.mapInArrow(merge, "part int, bits binary").toLocalIterator():
        marks[r["part"] * page // 8 :][: page // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return marks


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - (len(marks) * 8).bit_length() + 1)).astype(np.int64)
    return (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _word_ids(words: Words, seeds: list[int], where: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word at ``where`` (equal for equal words of a language), and a place of each."""
    _, first, ids = np.unique(h[where], return_index=True, return_inverse=True)
    other = words.hashes(seeds, lane=1)[where]
    if (other != other[first][ids]).any():  # two words with one hash: tell them apart by their bytes
        names: dict = {}
        text = [(int(k), words.data[a:b].tobytes()) for k, a, b in zip(words.lang[where], words.start[where], words.end[where])]
        ids = np.array([names.setdefault(t, len(names)) for t in text])
        _, first = np.unique(ids, return_index=True)
    return ids, where[first]


def graph(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """lang, gram, size, n: edges (4 words), ends of runs (3, 2 and 1 words) and the count of all words (0)."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words, names in _blocks(batches):
            seeds = [_seed(n) for n in names]
            lang_names = pa.array(names, pa.string())
            totals = np.bincount(words.lang, minlength=len(names))
            yield _rows(lang_names, pa.array([""] * len(names)), 0, totals)
            h = words.hashes(seeds)
            kept = _marked(bits, h)
            link = words.link.copy()
            at = np.flatnonzero(link)
            link[at] = _marked(bits, _pairs(h, link)) & kept[at] & kept[at + 1]
            where = np.flatnonzero(kept)
            if not len(where):
                continue
            local, places = _word_ids(words, seeds, where, h)
            ids = np.full(len(h), -1, dtype=np.int64)
            ids[where] = local
            name = words.strings(places)
            lang = words.lang[places]
            ahead = lambda k: np.append(link[k:], np.zeros(k, bool))[: len(link)]
            behind = lambda k: np.append(np.zeros(k, bool), link)[: len(link)]
            two, three = link & ahead(1), link & ahead(1) & ahead(2)
            ends = kept & ~link
            chosen = {
                4: np.flatnonzero(three),
                3: np.flatnonzero(ends & behind(1) & behind(2)) - 2,
                2: np.flatnonzero(ends & behind(1)) - 1,
                1: np.flatnonzero(ends),
            }
            # exact numbers for pairs, so that two of them name an edge
            linked = np.flatnonzero(link)
            pair = np.zeros(len(h), dtype=np.int64)
            if len(linked):
                pair[linked] = np.unique(ids[linked] << 32 | ids[linked + 1], return_inverse=True)[1]
            for size, start in chosen.items():
                if not len(start):
                    continue
                key = {
                    4: lambda s: pair[s] << 32 | pair[s + 2],
                    3: lambda s: pair[s] << 32 | ids[s + 2],
                    2: lambda s: pair[s],
                    1: lambda s: ids[s],
                }[size](start)
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                s = start[first]
                parts = [name.take(pa.array(ids[s + k])) for k in range(size)]
                gram = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                yield _rows(lang_names.take(pa.array(lang[ids[s]])), gram, size, counts)

    def _rows(lang: pa.Array, gram: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": lang, "gram": gram, "size": pa.array(np.full(len(n), size, np.int32)), "n": pa.array(n.astype(np.int64))})

    made = texts.mapInArrow(run, "lang string, gram string, size int, n long")
    return made.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def flows(parts: DataFrame) -> dict[int, DataFrame]:
    """Counts of 1, 2 and 3 words (lang, gram, n), each from the one above and the ends of runs."""
    of = lambda k: parts.filter(F.col("size") == k).select("lang", "gram", "n")
    out, above = {}, of(4)
    for size in (3, 2, 1):
        into = above.select("lang", F.substring_index("gram", " ", size).alias("gram"), "n").unionByName(of(size))
        above = out[size] = keep(into.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"phrases-{size}")
        drop_shuffles(parts.sparkSession)
    return out


def compact(edges: DataFrame) -> DataFrame:
    """lang, head, stretch, words, weights: edges joined along nodes with one way in and one way out.

    ``weights[i]`` is the count of ``words[i : i + 4]``. Edges of a closed cycle stay single.
    """
    tail, front = F.substring_index("gram", " ", -3), F.substring_index("gram", " ", 3)
    ways_in = edges.groupBy("lang", tail.alias("node")).agg(F.count("*").alias("ways"), F.first("gram").alias("before")).filter("ways = 1")
    ways_out = edges.groupBy("lang", front.alias("node")).agg(F.count("*").alias("ways"), F.first("gram").alias("gram")).filter("ways = 1")
    step = ways_in.select("lang", "node", "before").join(ways_out.select("lang", "node", "gram"), ["lang", "node"])
    step = step.filter("before <> gram").select("lang", "gram", "before")
    # up: an edge further up the path, and how far; NULL at the head
    now = keep(
        edges.join(step, ["lang", "gram"], "left").select(
            "lang", "gram", "n", F.coalesce("before", "gram").alias("up"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("far"),
            F.col("before").isNull().alias("done"),
        ),
        "phrases-up",
    )
    open_ = now.filter(~F.col("done")).count()
    while open_:
        higher = now.select("lang", F.col("gram").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        there = now.filter("done")
        onward = now.filter(~F.col("done")).join(higher, ["lang", "up"]).select(
            "lang", "gram", "n", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")
        )
        before, now = now, keep(there.unionByName(onward), "phrases-up")
        release(before)
        last, open_ = open_, now.filter(~F.col("done")).count()
        if open_ == last:
            break  # cycles only
    head = F.when(F.col("done"), F.col("up")).otherwise(F.col("gram"))
    far = F.when(F.col("done"), F.col("far")).otherwise(0)
    rows = now.select("lang", head.alias("head"), far.alias("far"), "gram", "n").withColumn("stretch", F.floor(F.col("far") / STRETCH))
    path = F.array_sort(F.collect_list(F.struct("far", "gram", "n")))
    grouped = rows.groupBy("lang", "head", "stretch").agg(path.alias("path"))
    heads = F.slice(F.split(F.col("path")[0]["gram"], " "), 1, 3)
    return grouped.select(
        "lang", "head", "stretch",
        F.concat(heads, F.transform("path", lambda e: F.substring_index(e["gram"], " ", -1))).alias("words"),
        F.transform("path", lambda e: e["n"]).alias("weights"),
    )


def collocations(docs: DataFrame, least: int = LEAST, cover: tuple[int, int] = COVER, bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase that no longer one covers."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    marks = may_be_frequent(texts, least, bits)
    drop_shuffles(docs.sparkSession)  # of the hashes, before the edges move
    parts = keep(graph(texts, marks), "phrases-graph")
    drop_shuffles(docs.sparkSession)
    counts = flows(parts)
    frequent = F.col("n") >= least
    paths = keep(compact(parts.filter((F.col("size") == 4) & frequent).select("lang", "gram", "n")), "phrases-paths")
    at = F.posexplode("weights").alias("at", "n")
    four = paths.select("lang", "words", at).select("lang", F.array_join(F.slice("words", F.col("at") + 1, 4), " ").alias("gram"), "n")
    # every node of a path is covered by the edges beside it
    nodes = paths.select("lang", "words", "weights", F.explode(F.sequence(F.lit(0), F.size("weights"))).alias("at")).select(
        "lang",
        F.array_join(F.slice("words", F.col("at") + 1, 3), " ").alias("gram"),
        F.greatest(F.get("weights", F.col("at") - 1), F.get("weights", F.col("at"))).alias("longer"),
    )
    three = counts[3].filter(frequent)
    # a node's count is at least that of any edge through it, so nodes alone decide which pairs are covered
    pairs = three.select("lang", F.explode(F.array(F.substring_index("gram", " ", 2), F.substring_index("gram", " ", -2))).alias("gram"), F.col("n").alias("longer"))
    covers = nodes.unionByName(pairs).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    shorter = three.withColumn("size", F.lit(3)).unionByName(counts[2].filter(frequent).withColumn("size", F.lit(2)))
    wide = "decimal(20,0)"
    uncovered = shorter.join(covers, ["lang", "gram"], "left").filter(
        F.col("longer").isNull() | (F.lit(cover[1]) * F.col("longer").cast(wide) < F.lit(cover[0]) * F.col("n").cast(wide))
    )
    candidates = keep(
        uncovered.select("lang", "gram", F.col("n").alias("a"), "size").unionByName(four.select("lang", "gram", F.col("n").alias("a"), F.lit(4).alias("size"))),
        "phrases-candidates",
    )
    release(paths)
    return _scored(candidates, counts, parts, least)


def _scored(candidates: DataFrame, counts: dict[int, DataFrame], parts: DataFrame, least: int) -> DataFrame:
    """The lowest-scoring cut of every candidate."""
    frequent = F.col("n") >= least
    salt = F.pmod(F.xxhash64("lang", "gram"), F.lit(SALTS))
    cut = candidates.select("lang", "gram", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    side = cut.select(
        "lang", "gram", "a", "size", "k",
        F.explode(F.array(
            F.struct(F.lit("l").alias("side"), F.col("k").alias("words"), F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("k")).alias("part")),
            F.struct(F.lit("r").alias("side"), (F.col("size") - F.col("k")).alias("words"), F.call_function("substring_index", F.col("gram"), F.lit(" "), F.col("k") - F.col("size")).alias("part")),
        )).alias("p"),
    ).select("lang", "gram", "a", "k", "p.side", "p.part", F.when(F.col("p.words") == 1, salt).otherwise(0).alias("salt"))
    known = counts[3].filter(frequent).unionByName(counts[2].filter(frequent)).withColumn("salt", F.lit(0).cast("long"))
    words = counts[1].filter(frequent).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    known = known.unionByName(words).withColumnRenamed("gram", "part").withColumnRenamed("n", "f")
    met = side.join(known, ["lang", "part", "salt"])
    value = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = met.groupBy("lang", "gram", "a", "k").agg(value("l").alias("l"), value("r").alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    total = parts.filter(F.col("size") == 0).select("lang", F.col("n"))
    return lowest.join(total, "lang").select("lang", F.col("gram").alias("phrase"), "a", "low.l", "low.r", "n", "low.score")


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` phrases of each language, with their rank."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The query op11 in SQL.
SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM piece),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
inner_ AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS gram, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS m) WHERE m < k) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inner_ USING (lang, gram) WHERE longer IS NULL OR 100::hugeint * longer < 80::hugeint * a
), cut AS (
  SELECT lang, gram, a, j, array_to_string(w[1 : j], ' ') AS p, array_to_string(w[j + 1 : k], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
), scored AS (
  SELECT cut.lang, cut.gram, a, j, x.f AS l, y.f AS r, (2000000::hugeint * a) // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.gram = p JOIN f y ON y.lang = cut.lang AND y.gram = q
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank,
       gram AS phrase, a, l, r, n, score::bigint AS score
FROM low JOIN n USING (lang)
QUALIFY rank <= 2000
"""
