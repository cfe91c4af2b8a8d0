"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs
to). Tokens flow from each pattern to its sources and from there to the targets; every
further repetition of a pattern's tokens costs more than the one before (convex), so
repetition is used only where a target needs it. Each pattern's routed tokens turn into
a threshold on a seeded hash: documents below it are taken, in hash order, until the
tokens are reached.

The driver holds one number per pattern and repetition; more than ``MAX_PATTERNS``
patterns are refused with an error. Thresholds are found from the token sums of 4096
hash ranges per pattern; only the range in which a threshold falls is ordered row by row.

Edge cases: a NULL source is a source of its own, last in order; a NULL or empty text has
size 0 and is taken zero words; rows that repeat a doc_id share a hash and are taken
alike; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from starfold.llm.common import keep

SEED = "mix-1"
WEIGHTS, SHARE, REPEATS = (3, 1, 2), Fraction(3, 2), 2
MAX_PATTERNS = 100_000
#: Thresholds of up to this many patterns are broadcast (a few MB).
FEW_PATTERNS = 20_000
#: Above and below every hash.
ALL, NONE = "g", ""

#: Runs of other characters than blank and 0x09-0x0D.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def label(source):
    """A source's name in patterns; NULL sorts last and differs from every string."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(
    sizes: dict[str, int],
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    repeats: int = REPEATS,
    total: int | None = None,
) -> dict[str, Fraction]:
    """Share ``share`` of all tokens by cyclic weights in label order; nobody above ``repeats`` times its size.

    ``total`` counts every document once; it is less than the sum of ``sizes`` where sources overlap.
    """
    order = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str, Fraction] = {}
    rest, open_ = share * (sum(sizes.values()) if total is None else total), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > repeats * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        for s in above:
            out[s] = Fraction(repeats * sizes[s])
            rest -= out[s]
        open_ -= above
    return out


class Flow:
    """Min-cost flow by shortest augmenting paths on a small graph."""

    def __init__(self):
        self.edges: list[list] = []  # to, capacity, cost; the reverse edge is at index ^ 1
        self.out: dict = {}

    def add(self, a, b, capacity: int, cost: int) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.edges))
            self.edges.append([y, c, k])
        return len(self.edges) - 2

    def run(self, s, t) -> None:
        while True:
            best, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out.get(a, ()):
                    b, c, k = self.edges[e]
                    if c > 0 and best[a] + k < best.get(b, best[a] + k + 1):
                        best[b], via[b] = best[a] + k, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if t not in best:
                return
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount

    def used(self, e: int) -> int:
        return self.edges[e ^ 1][1]


def route(
    patterns: dict[tuple[str, ...], int], wanted: dict[str, Fraction], repeats: int = REPEATS
) -> dict[tuple[str, ...], list[int]]:
    """Tokens of each pattern taken in its first, second, ... repetition."""
    flow, layers = Flow(), {}
    for p, size in patterns.items():
        layers[p] = [flow.add("from", ("p", p), size, 2 * r + 1) for r in range(repeats)]
        for source in p:
            flow.add(("p", p), ("s", source), size * repeats, 0)
    for source, t in wanted.items():
        flow.add(("s", source), "to", round(t), 0)
    flow.run("from", "to")
    return {p: [flow.used(e) for e in edges] for p, edges in layers.items()}


def measured(docs: DataFrame, sources: str | None = None) -> DataFrame:
    """doc_id, size, pattern, hash of every document; ``sources`` names an array column of memberships."""
    members = F.col(sources) if sources else F.array("source")
    labels = F.array_sort(F.array_distinct(F.transform(members, label)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), labels.alias("pattern"),
        seeded("doc_id").alias("h"),
    )


def seeded(doc_id: str):
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


class Mix:
    """Thresholds per pattern for the documents of ``rows`` (as from ``measured``)."""

    def __init__(self, rows: DataFrame, repeats: int = REPEATS):
        spark = rows.sparkSession
        sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
        if len(sums) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
        sizes = {tuple(r["pattern"]): r["size"] for r in sums}
        self.source_size: dict[str, int] = {}
        for p, size in sizes.items():
            for source in p:
                self.source_size[source] = self.source_size.get(source, 0) + size
        self.target = targets(self.source_size, repeats=repeats, total=sum(sizes.values()))
        self.routed = route(sizes, self.target, repeats)
        self.thresholds = self._thresholds(spark, rows, sizes)

    def _thresholds(self, spark: SparkSession, rows: DataFrame, sizes: dict) -> DataFrame:
        """pattern, layer, cut: a document is taken in this repetition if its hash is at most ``cut``."""
        schema = "pattern array<string>, layer int, cut string"
        fixed, open_ = [], []
        for p, layers in self.routed.items():
            for k, tokens in enumerate(layers):
                if 0 < tokens < sizes[p]:
                    open_.append((list(p), k, tokens))
                else:
                    fixed.append((list(p), k, ALL if tokens else NONE))
        done = spark.createDataFrame(fixed, schema)
        if not open_:
            return done
        goals = spark.createDataFrame(open_, "pattern array<string>, layer int, tokens long")
        ranges = rows.groupBy("pattern", F.substring("h", 1, 3).alias("b")).agg(F.sum("size").alias("part"))
        before = F.sum("part").over(Window.partitionBy("pattern").orderBy("b")) - F.col("part")
        hit = (
            ranges.withColumn("before", before)
            .join(goals, "pattern")
            .filter((F.col("before") <= F.col("tokens")) & (F.col("tokens") < F.col("before") + F.col("part")))
        )
        same = rows.withColumn("b", F.substring("h", 1, 3)).join(hit, ["pattern", "b"])
        one = same.groupBy("pattern", "layer", "b", "before", "tokens", "h").agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("pattern", "layer").orderBy("h"))
        middle = F.col("before") + upto - F.col("s") / 2
        cuts = (
            one.withColumn("middle", middle)
            .groupBy("pattern", "layer")
            .agg(F.coalesce(F.max(F.when(F.col("middle") <= F.col("tokens"), F.col("h"))), F.first("b")).alias("cut"))
        )
        return done.unionByName(cuts)

    def takes(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``pattern`` and ``h``) and how often each is taken: column ``times``."""
        wide = self.thresholds.groupBy("pattern").agg(F.collect_list("cut").alias("cuts"))
        if len(self.routed) <= FEW_PATTERNS:
            wide = F.broadcast(wide)
        joined = rows.join(wide, "pattern", "left")
        times = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + (F.col("h") <= c).cast("long"))
        return joined.withColumn("times", F.coalesce(times, F.lit(0).cast("long"))).drop("cuts")

    def by_source(self, spark: SparkSession) -> DataFrame:
        rows = [(s, self.source_size[s], float(round(t, 6))) for s, t in self.target.items()]
        return spark.createDataFrame(rows, "label string, source_size long, target double")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document of a mix in which every document has one source."""
    rows = keep(measured(docs), "mix-rows")
    mix = Mix(rows)
    taken = mix.takes(rows).withColumn("label", F.col("pattern")[0])
    return taken.join(mix.by_source(docs.sparkSession), "label").select(
        "doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, repeated as often as it takes them, with the columns of ``docs``."""
    mixed = Mix(keep(measured(docs), "mix-rows"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(
        F.struct(*names).alias("doc"), F.array(label(F.col("source"))).alias("pattern"), seeded("doc_id").alias("h")
    )
    taken = mixed.takes(keyed).filter((F.col("times") > 0) & F.col("doc")["text"].rlike(WORDS))
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc.*")


#: The query op7 in SQL.
SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
         md5('mix-1:' || coalesce(doc_id::varchar, 'null')) AS h
  FROM documents
), s AS (SELECT source, sum(size)::bigint AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS k
  FROM s
), o AS (
  SELECT *, 1.5::double * sum(n) OVER () AS total,
         coalesce(sum(2 * n) OVER (ORDER BY 2 * n / k, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(k) OVER (ORDER BY 2 * n / k DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS rest
  FROM w
), l AS (SELECT max((total - below) / rest) FILTER ((total - below) / rest <= 2 * n / k) AS level FROM o
), t AS (
  SELECT source, n, round(least(2 * n::double, coalesce(k * level, 2 * n::double)), 6) AS target FROM w, l
), q AS (
  SELECT *, least(n, round_even(target, 0))::bigint AS f1, greatest(0, round_even(target, 0) - n)::bigint AS f2 FROM t
), c AS (
  SELECT d.*, n, target, f1, f2,
         sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, n AS source_size, target,
       (size * ((f1 >= n OR (f1 > 0 AND middle <= f1))::int + (f2 >= n OR (f2 > 0 AND middle <= f2))::int))::bigint AS taken
FROM c
"""
