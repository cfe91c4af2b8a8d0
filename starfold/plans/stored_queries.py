"""Registered queries over tables that are written first: streams, org tables, bucketed tables, checked batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold import schemas
from starfold.operators import ingest, integrity, partials, similarity, summary
from starfold.plans import queries as base
from starfold.plans.queries import PRELUDE, SQL, query
from starfold.session import shared_dir, staged
from starfold.sources.orgtable import OrgTable
from starfold.sources.samples import AS_OF, BULK_ORDER, Samples
from starfold.sources.textindex import TextIndex
from starfold.sources.vectorclusters import VectorClusters
from starfold.streaming import ingest as stream
from starfold.streaming import model as streamed_model

_BUCKETS = 8


def _folder(s: Samples, name: str) -> str:
    return f"{shared_dir(s.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _org_table(s: Samples, name: str, schema, rows: DataFrame | None = None) -> OrgTable:
    return OrgTable(s.spark, _folder(s, name), schema, _BUCKETS).create(rows)


# -- statistics from partial sums ---------------------------------------------------

_MERGED = f", merged AS ({SQL['review_upsert'].removeprefix(PRELUDE)})"


def _stream_partials(s: Samples) -> DataFrame:
    """Partials of the feed streamed in two micro-batches; the second one changes reviews of the first."""
    folder = _folder(s, "partials")
    base.streamed(s, partials=folder)
    return stream.read_partials(s.spark, folder)


@query("stats_incremental", _MERGED + base.stats_sql("bulk_companies", "merged"))
def _(s: Samples) -> DataFrame:
    """Totals of every company from the partials of a stream: no review is read."""
    return partials.org_stats(s.bulk_companies(), _stream_partials(s))


@query("trends_incremental", _MERGED + base.trend_sql("strftime(d, '%Y-W%W')", "merged"))
def _(s: Samples) -> DataFrame:
    return partials.trends(_stream_partials(s), "week")


@query("stars_incremental", _MERGED + """
, found AS (SELECT org_id, round(stars)::int AS star, count(*) AS c FROM merged GROUP BY ALL)
SELECT org_id, star, sum(c)::bigint AS review_count FROM (
  SELECT org_id, star, c FROM found WHERE org_id IN (SELECT org_id FROM bulk_companies)
  UNION ALL SELECT org_id, s, 0 FROM bulk_companies CROSS JOIN unnest([1, 2, 3, 4, 5]) t(s)) GROUP BY ALL""")
def _(s: Samples) -> DataFrame:
    return partials.star_histogram(s.bulk_companies(), _stream_partials(s))


# -- streamed vectors, refreshed model -----------------------------------------------


def _stream_vectors(s: Samples) -> tuple[OrgTable, OrgTable]:
    """Vectors and assignments after two micro-batches of vectors.

    The first one holds two thirds of the vectors, half of these turned round; the second one
    holds the rest, and the turned ones as they should be.
    """
    vectors = _org_table(s, "vectors", schemas.REVIEW_VECTORS)
    assigned = _org_table(s, "assigned", streamed_model.OWNED_ASSIGNMENTS)
    step = streamed_model.VectorIngest(vectors, assigned, staged(s.topics(), "topics"), ("arrival",), 0.3)
    rows = s.vectors().select("review_id", "org_id", "model", "text_embedding")
    k = F.col("review_id") % 3
    turned = F.transform("text_embedding", lambda x: -x)
    first = rows.filter(k < 2).withColumn("text_embedding", F.when(k == 0, turned).otherwise(F.col("text_embedding")))
    root = _folder(s, "vector-stream")
    for number, landed in enumerate((first, rows.filter(k != 1))):
        landed.withColumn("arrival", F.lit(number)).write.mode("append").parquet(f"{root}/landing")
        schema = s.spark.read.parquet(f"{root}/landing").schema
        feed = s.spark.readStream.schema(schema).parquet(f"{root}/landing")
        stream.start(feed, step, f"{root}/progress").awaitTermination()
    return vectors, assigned


@query("stream_classify", "SELECT review_id, topic_id, round(similarity, 6) + 0 AS similarity, org_id FROM assigned030")
def _(s: Samples) -> DataFrame:
    """Assignments of a stream of vectors: each micro-batch stores, classifies and replaces by key."""
    return _stream_vectors(s)[1].read().select("review_id", "topic_id", F.round("similarity", 6).alias("similarity"), "org_id")


class KnownVectors:
    """An embedder that looks the vectors of the sample up by id."""

    model = "sample"

    def __init__(self, vectors: DataFrame):
        self.known = vectors.select(F.col("review_id").alias("id"), F.col("text_embedding").alias("embedding"))

    def embed(self, df: DataFrame) -> DataFrame:
        return df.drop("text").join(self.known, "id")


@query("model_refresh", f"""
SELECT org_id, topic_id, t10 / 10.0::double AS score, n AS review_count, {base.CONFIDENCE} AS confidence
FROM score_rows WHERE as_of = '{AS_OF}'""")
def _(s: Samples) -> DataFrame:
    """Scores after a refresh of the whole model: backlog embedded, everything assigned and scored, in two steps of orgs."""
    have = s.vectors().join(s.reviews().filter("text <> '' AND id % 3 > 0").select(F.col("id").alias("review_id")), "review_id", "left_anti")
    tables = {
        "reviews": _org_table(s, "reviews", schemas.REVIEWS, s.reviews()),
        "review_embeddings": _org_table(s, "vectors", schemas.REVIEW_VECTORS, have),
        "review_topics": _org_table(s, "assigned", streamed_model.OWNED_ASSIGNMENTS),
        "company_scores": _org_table(s, "scores", schemas.SCORES),
    }
    topics = staged(s.topics(), "topics")
    for part in ("role = 'mine'", "role <> 'mine'"):
        streamed_model.refresh_model(
            tables, s.companies(), topics, KnownVectors(s.vectors()), AS_OF, s.companies().filter(part), threshold=0.1
        )
    return tables["company_scores"].read().drop("computed_at")


# -- changes of some orgs only --------------------------------------------------------


@query("assignments_replace_stored", SQL["assignments_replace"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """New assignments of some orgs, written into the buckets of these orgs."""
    mine = s.companies().filter(F.col("role") == "mine")
    owner = s.reviews().select(F.col("id").alias("review_id"), "org_id")
    old = similarity.classify(s.vectors(), None, s.topics(), 0.1).join(owner, "review_id")
    table = _org_table(s, "assigned", streamed_model.OWNED_ASSIGNMENTS, old)
    fresh = similarity.classify(s.vectors().join(mine, "org_id", "left_semi"), None, s.topics(), 0.3)
    table.replace_orgs(fresh.join(owner, "review_id"), mine)
    return table.read().select("review_id", "topic_id", F.round("similarity", 6).alias("similarity"))


@query("org_remove_stored", """
SELECT 'reviews' AS table_name, org_id, id::varchar AS key FROM reviews WHERE org_id NOT IN (SELECT org_id FROM companies WHERE role = 'tracked')
UNION ALL SELECT 'review_embeddings', r.org_id, review_id::varchar FROM vectors v JOIN reviews r ON r.id = v.review_id
  WHERE r.org_id NOT IN (SELECT org_id FROM companies WHERE role = 'tracked')
UNION ALL SELECT 'company_scores', org_id, coalesce(topic_id::varchar, '') FROM score_rows
  WHERE as_of = '2025-12-01' AND org_id NOT IN (SELECT org_id FROM companies WHERE role = 'tracked')""")
def _(s: Samples) -> DataFrame:
    """Rows that stay when orgs are removed from stored tables."""
    gone = s.companies().filter(F.col("role") == "tracked").select("org_id")
    out = None
    scores = base.model_scores(s)
    for name, schema, rows, key in (
        ("reviews", schemas.REVIEWS, s.reviews(), "id"),
        ("review_embeddings", schemas.REVIEW_VECTORS, s.vectors(), "review_id"),
        ("company_scores", schemas.SCORES, scores, "topic_id"),
    ):
        table = _org_table(s, name, schema, rows)
        table.remove_orgs(gone)
        part = table.read().select(F.lit(name).alias("table_name"), "org_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query("review_upsert_bucketed", SQL["review_upsert"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """A batch merged into a table that is bucketed by key: the table is not shuffled."""
    current, batch = base.two_batches(s)
    name = f"reviews_{uuid.uuid4().hex}"
    current.write.bucketBy(_BUCKETS, ingest.REVIEW_KEY).sortBy(ingest.REVIEW_KEY).option("path", _folder(s, "bucketed")).saveAsTable(name)
    merged = ingest.merge_reduced(s.spark.table(name), ingest.reduce_batch(batch, BULK_ORDER))
    return merged.select("review_key", "org_id", "date", "text", "stars", "business_response")


# -- failed syncs -----------------------------------------------------------------------


def _stream_lines(s: Samples):
    """A store into which lines of raw reviews were streamed in two batches; some lines are cut off.

    All lines of the orgs that are tracked are cut, and every eleventh line of the others.
    """
    from starfold.sources.store import Store

    docs = s.raw("documents").join(s.companies().select(F.col("org_id").alias("source"), "role"), "source")
    line = F.to_json(F.struct(
        F.col("source").alias("org_id"), F.concat(F.lit("user "), F.col("doc_id").cast("string")).alias("author_text"),
        F.lit("2025-01-01").alias("date_content"), F.substring("text", 1, 60).alias("body_text"),
    ))
    broken = (F.col("role") == "tracked") | (F.col("doc_id") % 11 == 0)
    lines = docs.select("doc_id", F.when(broken, F.substring_index(line, ',"author_text"', 1)).otherwise(line).alias("value"))
    root = _folder(s, "lines")
    store = Store(s.spark, f"{root}/tables", buckets=_BUCKETS)
    step = stream.ReviewIngest(store)
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        lines.filter(part).select("value").write.mode("append").text(f"{root}/landing")
        stream.start(stream.read_landing(s.spark, f"{root}/landing"), step, f"{root}/progress").awaitTermination()
    return store


_LINES = """
, lines AS (
  SELECT d.source AS org_id, 1 + doc_id % 2 AS batch, c.role = 'tracked' OR doc_id % 11 = 0 AS broken
  FROM documents d JOIN companies c ON c.org_id = d.source
), logged AS (
  SELECT batch AS seq, org_id, count(*) FILTER (NOT broken) AS good, count(*) FILTER (broken) AS bad FROM lines GROUP BY ALL)"""


@query("sync_log_errors", _LINES + """
SELECT seq, org_id, good AS reviews_added, CASE WHEN good = 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN bad > 0 THEN bad || ' unreadable lines' END AS error_message FROM logged""")
def _(s: Samples) -> DataFrame:
    """The log of a stream with unreadable lines: an org without a readable one shows an error."""
    return _stream_lines(s).read("sync_log").select("seq", "org_id", "reviews_added", "status", "error_message")


@query("sync_status_errors", _LINES + """
, last AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) AS k FROM logged)
SELECT c.org_id, c.name, c.role, (SELECT coalesce(sum(good), 0)::bigint FROM logged g WHERE g.org_id = c.org_id) AS reviews_in_db,
       coalesce(CASE WHEN good = 0 THEN 'error' ELSE 'ok' END, '—') AS last_status
FROM companies c LEFT JOIN last l ON l.org_id = c.org_id AND k = 1""")
def _(s: Samples) -> DataFrame:
    """The status report after such a stream."""
    store = _stream_lines(s)
    status = summary.sync_status(s.companies(), store.read("reviews"), store.read("sync_log"))
    return status.select("org_id", "name", "role", "reviews_in_db", "last_status")


# -- checked batches -------------------------------------------------------------------


def checked_tables(s: Samples) -> dict[str, DataFrame]:
    """All tables of the model, each with some rows that refer to nothing, by rule."""
    assigned = staged(base.assigned(s, 0.3), "assigned")
    scores = base.model_scores(s)
    ids = F.col("review_id")
    return {
        "companies": s.companies(),
        "company_relations": s.proposed_relations().unionByName(
            s.proposed_relations().filter("priority = 11").withColumn("company_org_id", F.concat(F.lit("x"), F.col("company_org_id")))
        ),
        "reviews": s.reviews().withColumn("org_id", F.when(F.col("id") % 41 == 5, F.lit("nowhere")).otherwise(F.col("org_id"))),
        "sync_log": s.sync_log(),
        "topic_templates": s.topics().withColumn("org_id", F.when(F.col("id") % 29 == 2, F.lit("gone")).otherwise(F.col("org_id")))
        .withColumn("parent_id", F.when(F.col("id") % 31 == 3, F.col("id") + 10_000_000).otherwise(F.col("parent_id"))),
        "review_embeddings": s.vectors().withColumn("review_id", F.when(ids % 37 == 4, ids + 50_000_000).otherwise(ids)),
        "review_topics": assigned.withColumn("review_id", F.when(ids % 43 == 6, ids + 50_000_000).otherwise(ids))
        .withColumn("topic_id", F.when(ids % 19 == 7, F.col("topic_id") + 10_000_000).otherwise(F.col("topic_id"))),
        "company_scores": scores.withColumn("org_id", F.when(F.col("topic_id") % 13 == 1, F.lit("unscored")).otherwise(F.col("org_id")))
        .withColumn("topic_id", F.when(F.col("topic_id") % 17 == 2, F.col("topic_id") + 10_000_000).otherwise(F.col("topic_id"))),
    }


_CHECKED = """
, c_relations AS (
  SELECT * FROM proposed UNION ALL SELECT 'x' || company_org_id, competitor_org_id, priority, notes FROM proposed WHERE priority = 11
), c_reviews AS (SELECT * REPLACE (CASE WHEN id % 41 = 5 THEN 'nowhere' ELSE org_id END AS org_id) FROM reviews
), c_topics AS (SELECT * REPLACE (CASE WHEN id % 29 = 2 THEN 'gone' ELSE org_id END AS org_id,
                                  CASE WHEN id % 31 = 3 THEN id + 10000000 ELSE parent_id END AS parent_id) FROM topics
), c_vectors AS (SELECT * REPLACE (CASE WHEN review_id % 37 = 4 THEN review_id + 50000000 ELSE review_id END AS review_id) FROM vectors
), c_assigned AS (
  SELECT CASE WHEN review_id % 43 = 6 THEN review_id + 50000000 ELSE review_id END AS review_id,
         CASE WHEN (CASE WHEN review_id % 43 = 6 THEN review_id + 50000000 ELSE review_id END) % 19 = 7 THEN topic_id + 10000000 ELSE topic_id END AS topic_id
  FROM assigned030
), c_scores AS (
  SELECT CASE WHEN topic_id % 13 = 1 THEN 'unscored' ELSE org_id END AS org_id,
         CASE WHEN topic_id % 17 = 2 THEN topic_id + 10000000 ELSE topic_id END AS topic_id
  FROM score_rows WHERE as_of = '2025-12-01'
), uses AS (
  SELECT 'company_relations' AS table_name, 'company_org_id' AS column_name, company_org_id AS value FROM c_relations
    WHERE company_org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'company_relations', 'competitor_org_id', competitor_org_id FROM c_relations WHERE competitor_org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'reviews', 'org_id', org_id FROM c_reviews WHERE org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'sync_log', 'org_id', org_id FROM sync_log WHERE org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'topic_templates', 'org_id', org_id FROM c_topics WHERE org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'topic_templates', 'parent_id', parent_id::varchar FROM c_topics WHERE parent_id NOT IN (SELECT id FROM c_topics)
  UNION ALL SELECT 'review_embeddings', 'review_id', review_id::varchar FROM c_vectors WHERE review_id NOT IN (SELECT id FROM c_reviews)
  UNION ALL SELECT 'review_topics', 'review_id', review_id::varchar FROM c_assigned WHERE review_id NOT IN (SELECT id FROM c_reviews)
  UNION ALL SELECT 'review_topics', 'topic_id', topic_id::varchar FROM c_assigned WHERE topic_id NOT IN (SELECT id FROM c_topics)
  UNION ALL SELECT 'company_scores', 'org_id', org_id FROM c_scores WHERE org_id NOT IN (SELECT org_id FROM companies)
  UNION ALL SELECT 'company_scores', 'topic_id', topic_id::varchar FROM c_scores WHERE topic_id NOT IN (SELECT id FROM c_topics)
)"""


@query("fk_orphans_all", _CHECKED + "SELECT table_name, column_name, value, count(*) AS row_count FROM uses GROUP BY ALL")
def _(s: Samples) -> DataFrame:
    """All eleven references, each met by most rows and missed by some."""
    return integrity.orphans(checked_tables(s))


@query("upsert_quarantine", _CHECKED + """
, fresh AS (
  SELECT row_number() OVER (PARTITION BY review_key ORDER BY l_shipdate, l_suppkey, l_partkey) AS k, review_key,
         CASE WHEN l_partkey % 23 = 1 THEN 'nobody' ELSE org_id END AS org_id FROM bulk
), judged AS (
  SELECT 'reviews' AS table_name, review_key AS key,
         org_id NOT IN (SELECT org_id FROM bulk_companies) AS a, k > 1 AS b, 'org_id not in companies' AS ra, 'review_key repeated' AS rb FROM fresh
  UNION ALL SELECT 'company_relations', company_org_id || '|' || competitor_org_id, company_org_id NOT IN (SELECT org_id FROM companies),
         competitor_org_id NOT IN (SELECT org_id FROM companies), 'company_org_id not in companies', 'competitor_org_id not in companies' FROM c_relations
  UNION ALL SELECT 'topic_templates', id::varchar, org_id NOT IN (SELECT org_id FROM companies),
         parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM c_topics), 'org_id not in companies', 'parent_id not in topic_templates' FROM c_topics
  UNION ALL SELECT 'review_topics', review_id || '|' || topic_id, review_id NOT IN (SELECT id FROM c_reviews),
         topic_id NOT IN (SELECT id FROM c_topics), 'review_id not in reviews', 'topic_id not in topic_templates' FROM c_assigned
  UNION ALL SELECT 'review_embeddings', review_id::varchar, review_id NOT IN (SELECT id FROM c_reviews), false, 'review_id not in reviews', '' FROM c_vectors
  UNION ALL SELECT 'company_scores', org_id || '|' || coalesce(topic_id::varchar, ''), org_id NOT IN (SELECT org_id FROM companies),
         topic_id IS NOT NULL AND topic_id NOT IN (SELECT id FROM c_topics), 'org_id not in companies', 'topic_id not in topic_templates' FROM c_scores
  UNION ALL SELECT 'sync_log', seq::varchar, org_id NOT IN (SELECT org_id FROM companies), false, 'org_id not in companies', '' FROM sync_log
)
SELECT table_name, key, NOT (a OR b) AS accepted, concat_ws('; ', CASE WHEN a THEN ra END, CASE WHEN b THEN rb END) AS reasons FROM judged""")
def _(s: Samples) -> DataFrame:
    """Batches of seven tables, split into accepted and quarantined rows with their reasons."""
    tables = checked_tables(s)
    feed = s.bulk().withColumn("org_id", F.when(F.col("l_partkey") % 23 == 1, F.lit("nobody")).otherwise(F.col("org_id")))
    jobs = [("reviews", feed, {"companies": s.bulk_companies()}, BULK_ORDER, ["review_key"])]
    keys = {
        "company_relations": ["company_org_id", "competitor_org_id"], "topic_templates": ["id"], "review_topics": ["review_id", "topic_id"],
        "review_embeddings": ["review_id"], "company_scores": ["org_id", "topic_id"], "sync_log": ["seq"],
    }
    jobs += [(name, tables[name], tables, (), key) for name, key in keys.items()]
    out = None
    for name, rows, parents, order, key in jobs:
        good, bad = integrity.split_batch(name, rows, parents, order)
        said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).alias("key")
        both = good.select(said, F.lit(True).alias("accepted"), F.lit("").alias("reasons")).unionByName(
            bad.select(said, F.lit(False).alias("accepted"), F.array_join(integrity.REASONS, "; ").alias("reasons"))
        )
        part = both.select(F.lit(name).alias("table_name"), "key", "accepted", "reasons")
        out = part if out is None else out.unionByName(part)
    return out


@query("org_remove_rows", """
, gone AS (SELECT org_id FROM companies WHERE role = 'tracked'),
lost AS (SELECT id FROM reviews WHERE org_id IN (FROM gone)),
lost_topics AS (SELECT id FROM topics WHERE org_id IN (FROM gone))
SELECT 'companies' AS table_name, org_id AS key FROM companies WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'company_relations', company_org_id || '|' || competitor_org_id FROM relations
  WHERE company_org_id NOT IN (FROM gone) AND competitor_org_id NOT IN (FROM gone)
UNION ALL SELECT 'reviews', id::varchar FROM reviews WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'sync_log', seq::varchar FROM sync_log WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'topic_templates', id::varchar FROM topics WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'review_embeddings', review_id::varchar FROM vectors WHERE review_id NOT IN (FROM lost)
UNION ALL SELECT 'review_topics', review_id || '|' || topic_id FROM assigned030 WHERE review_id NOT IN (FROM lost) AND topic_id NOT IN (FROM lost_topics)
UNION ALL SELECT 'company_scores', org_id || '|' || coalesce(topic_id::varchar, '') FROM score_rows
  WHERE as_of = '2025-12-01' AND org_id NOT IN (FROM gone)""")
def _(s: Samples) -> DataFrame:
    """Every row that stays in any table when orgs are removed."""
    tables = base.model(s) | {"company_scores": base.model_scores(s)}
    left = ingest.remove_orgs(tables, tables["companies"].filter(F.col("role") == "tracked"))
    keys = {
        "companies": ["org_id"], "company_relations": ["company_org_id", "competitor_org_id"], "reviews": ["id"], "sync_log": ["seq"],
        "topic_templates": ["id"], "review_embeddings": ["review_id"], "review_topics": ["review_id", "topic_id"], "company_scores": ["org_id", "topic_id"],
    }
    out = None
    for name, key in keys.items():
        said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
        part = left[name].select(F.lit(name).alias("table_name"), said.alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


# -- searches that skip what cannot match ------------------------------------------------


@query("search_text_indexed", SQL["search_text"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """Text search that reads the buckets with all trigrams of the query."""
    return TextIndex(s.spark, _folder(s, "text-index"), 64).create(s.reviews()).search("The_onEd")


@query("search_text_indexed_filtered", SQL["search_text_filtered"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    return TextIndex(s.spark, _folder(s, "text-index"), 64).create(s.reviews()).search("RE%thE", org_id="src7", stars="2-4")


@query("semantic_search_pruned", SQL["semantic_search"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """Exact search by meaning that reads the clusters whose bound allows it."""
    clusters = VectorClusters(s.spark, _folder(s, "clusters"), 16).create(s.vectors())
    found, _ = clusters.search(s.reviews(), base.QUERY_VECTOR)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("semantic_search_pruned_filtered", SQL["semantic_search_filtered"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    clusters = VectorClusters(s.spark, _folder(s, "clusters"), 16).create(s.vectors())
    found, _ = clusters.search(s.reviews(), base.QUERY_VECTOR, org_id="src5", stars="3-5")
    return found.withColumn("similarity", F.round("similarity", 6))
