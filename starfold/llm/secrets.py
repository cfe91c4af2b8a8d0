"""Secret scan with DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beside them, two
first-order Markov models over characters, one of random strings and one of ordinary
identifiers, give each further token a log-likelihood ratio; tokens above a threshold
per character and in total are spans of kind ``markov``. The models are counted from
labelled samples and folded into one table of log ratios, 129 x 128 numbers, that enters the
plan as a constant.

Edge cases: a NULL text is empty; an empty text has no spans; a text without model
(no samples) gets base spans only; repeated documents are treated alike; other columns
are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import keep

#: Kinds in their order, patterns, group whose length counts, least length.
_WORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
KINDS = (
    ("assign", _WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),  # a run from its first AKIA on, if long enough
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
MARKOV = "markov"

#: Tokens the models judge: runs of these characters from ``LEAST`` on.
TOKEN, LEAST = r"[A-Za-z0-9+/_-]{16,}", 16
#: Documents with a fixed span that give the labelled samples, at most.
SAMPLES = 2_000
#: Matches of a text that are placed in one walk.
SLICE = 256
#: Weight, in counts, of a character's chance alone against its chance after another.
BACKING = 8.0
#: A token is random if its log ratio is at least this much per step, and in total.
PER_STEP, TOTAL = 0.5, 12.0
#: Ordinary identifiers and numbers: what stands outside the fixed spans.
ORDINARY = r"[A-Za-z0-9_]{6,40}"


def _found(text, kind: str, pattern: str, group: int, least: int):
    """Matches of ``pattern`` with places, leftmost first and not overlapping, short ones dropped.

    Splitting at the pattern gives the texts between the matches; lengths add up to places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.zip_with(between, matches, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), judged,
                       lambda x, j: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("n"), j.alias("j"),
                                             x["m"].alias("m")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("out"))

    def span(first, end, body):
        return F.struct(first.alias("first"), end.alias("end"), F.lit(kind).alias("kind"), body.alias("body"))

    def walk(state, s):
        first = state["at"] + s["gap"]
        fits = s["m"].isNotNull() & (F.length(s["j"]) >= least)
        return F.struct(
            (first + F.coalesce(s["n"], F.lit(0))).alias("at"),
            F.when(fits, F.concat(state["out"], F.array(span(first, first + s["n"], s["j"])))).otherwise(state["out"]).alias("out"),
        )

    # Each step of a walk copies the spans so far, so it goes over short slices, which are then moved to their places.
    def sliced(z):
        starts = F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), F.lit(SLICE))
        return F.transform(starts, lambda i: F.aggregate(F.slice(z, i, SLICE), start, walk))

    before = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))

    def joined(parts):
        offsets = F.aggregate(
            parts, before, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        )["all"]
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["out"], lambda s: span(s["first"] + o, s["end"] + o, s["body"]))))

    return F.when(text.rlike(pattern), _let(_let(sizes, sliced), joined)).otherwise(_none())


def _let(value, use):
    """``use`` of ``value``, which is computed once a row however often it is named."""
    return F.transform(F.array(value), use)[0]


def _none():
    return F.expr("CAST(array() AS array<struct<first:int,end:int,kind:string,body:string>>)")


def base_spans(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, ``more`` and for each fixed kind its spans (first, end in code points, kind, body)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    return rows.select("doc_id", "text", *more, *[_found(F.col("text"), *k).alias(k[0]) for k in KINDS])


def samples(docs: DataFrame, each: int = SAMPLES) -> DataFrame:
    """Labelled samples (sample, random): bodies of fixed spans, and the distinct other words of texts, in both cases.

    The sample of documents is bounded: the ``each`` lowest seeded hashes among all and among
    those with a fixed span, so the models do not depend on the order of rows.
    """
    has, rest = F.lit(False), F.coalesce("text", F.lit(""))
    for kind in KINDS:
        has, rest = has | F.col("text").rlike(kind[1]), F.regexp_replace(rest, kind[1], " ")
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(11)).alias("_h"))

    def lowest(part: DataFrame) -> DataFrame:
        """The rows up to the ``each``-th lowest hash; texts are not sorted."""
        cut = part.select("_h").orderBy("_h").limit(each).agg(F.max("_h")).first()[0]
        return part.filter(F.col("_h") <= (-(2**63) if cut is None else cut)).drop("_h")

    some = lowest(rows.filter(has)).unionByName(lowest(rows))
    some = keep(
        base_spans(some.withColumn("rest", rest), "rest").select(
            F.concat("assign.body", "access.body", "hex.body").alias("bodies"),
            F.array_distinct(F.regexp_extract_all("rest", F.lit(ORDINARY), F.lit(0))).alias("words"),
        ),
        "secret-samples",
    )
    random = some.select(F.explode("bodies").alias("sample"), F.lit(True).alias("random"))
    words = some.select(F.explode("words").alias("sample"))
    both_cases = words.unionByName(words.select(F.upper("sample").alias("sample")))
    return random.unionByName(both_cases.withColumn("random", F.lit(False))).distinct()


def train(labelled: DataFrame) -> list[float] | None:
    """Log ratios by (context + 1) * 128 + character; context 0 is the start. ``None`` without both classes.

    The table has 129 x 128 entries whatever the samples are.
    """
    code = lambda i: F.ascii(F.substring(F.col("sample"), i, 1))
    steps = F.transform(
        F.sequence(F.lit(1), F.length("sample")),
        lambda i: F.when(i == 1, F.ascii(F.col("sample").substr(F.lit(1), F.lit(1)))).otherwise(
            (F.ascii(F.col("sample").substr(i - 1, F.lit(1))) + 1) * 128 + F.ascii(F.col("sample").substr(i, F.lit(1)))
        ),
    )
    counted = (
        labelled.filter("sample RLIKE '^[ -~]+$'")
        .select("random", F.explode(steps).alias("step"))
        .groupBy("random", "step")
        .count()
    )
    counts = {True: {}, False: {}}
    for r in counted.collect():
        counts[r["random"]][r["step"]] = r["count"]
    if not counts[True] or not counts[False]:
        return None
    out = [0.0] * (129 * 128)
    rows = {side: [0] * 129 for side in counts}
    for side, table in counts.items():
        for step, n in table.items():
            rows[side][step // 128] += n
    single = {side: [0.1] * 128 for side in counts}
    for side, table in counts.items():
        for step, n in table.items():
            single[side][step % 128] += n

    def chance(side: bool, step: int) -> float:
        """Counts of the context, smoothed by the chance of the character alone."""
        alone = single[side][step % 128] / sum_of[side]
        return (counts[side].get(step, 0) + BACKING * alone) / (rows[side][step // 128] + BACKING)

    sum_of = {side: sum(v) for side, v in single.items()}
    for step in range(len(out)):
        out[step] = round(math.log(chance(True, step)) - math.log(chance(False, step)), 6)
    return out


def ratio(token, model: list[float]):
    """Log-likelihood ratio of a token of ASCII characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    start = F.struct(F.lit(0).alias("context"), F.lit(0.0).alias("sum"))

    def add(state, c):
        here = F.ascii(c)
        value = F.get(table, state["context"] * 128 + here)
        return F.struct((here + 1).alias("context"), (state["sum"] + value).alias("sum"))

    return F.aggregate(F.split(token, ""), start, add)["sum"]


def scan(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """doc_id, base (array of spans by place and kind), spans (base and model spans)."""
    found = base_spans(docs)
    order = {k[0]: i for i, k in enumerate(KINDS)} | {MARKOV: len(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    ordered = lambda spans: F.array_sort(
        F.transform(spans, lambda s: F.struct(s["first"].alias("first"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    found = found.withColumn("base", F.concat(*[k[0] for k in KINDS]))
    if model is None:
        return found.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.col("base")).alias("spans"))
    tokens = _found(F.col("text"), MARKOV, TOKEN, 0, LEAST)
    free = F.filter(
        tokens, lambda t: ~F.exists("base", lambda b: (b["first"] < t["end"]) & (t["first"] < b["end"]))
    )
    score = lambda t: ratio(t["body"], model)
    random = F.filter("free", lambda t: score(t) >= F.greatest(F.lit(TOTAL), PER_STEP * (t["end"] - t["first"])))
    return (
        found.select("doc_id", "base", free.alias("free"))
        .select("doc_id", "base", random.alias("more"))
        .select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", "more")).alias("spans"))
    )


def digest(scanned: DataFrame) -> DataFrame:
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(k[0]) for k in KINDS],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
