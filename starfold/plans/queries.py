"""Registered queries: each operator over the sample tables, with the same result in plain SQL.

``@query(name, sql)`` pairs a Spark plan with SQL over the generated tables.
The SQL may use the CTEs of ``PRELUDE``. Queries without SQL give ``None``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold import schemas
from starfold.functions import calendar as cal
from starfold.functions import vectors as vec
from starfold.operators import (
    configdoc,
    embedding,
    ingest,
    integrity,
    listing,
    normalize,
    scoring,
    similarity,
    summary,
    topics as topic_ops,
)
from starfold.plans import sqlsurface
from starfold.session import shared_dir
from starfold.sources.samples import AS_OF, BULK_ORDER, BULK_SPLIT, Samples

Plan = Callable[[Samples], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}

PRELUDE = """
WITH companies AS (
  SELECT source AS org_id, 'Org ' || source AS name,
         CASE WHEN min(doc_id) % 7 <> 3 THEN 3.0::double + (min(doc_id) % 20) * 0.1::double END AS rating,
         count(*)::int AS review_count,
         CASE WHEN min(doc_id) % 20 < 4 THEN 'mine' WHEN min(doc_id) % 20 < 14 THEN 'competitor'
              ELSE 'tracked' END AS role,
         CASE WHEN min(doc_id) % 20 % 2 = 0 THEN 'auto_service' ELSE 'cafe' END AS service_type,
         min(doc_id) % 20 AS n
  FROM documents GROUP BY source
), relations AS (
  SELECT a.org_id AS company_org_id, b.org_id AS competitor_org_id, s.step AS priority,
         'step ' || s.step AS notes
  FROM companies a CROSS JOIN (VALUES (1), (5)) s(step) JOIN companies b ON b.n = (a.n + s.step) % 20
  WHERE a.role = 'mine'
), proposed AS (
  SELECT org_id AS company_org_id, 'src' || (n + s.step) AS competitor_org_id, s.step + 10 AS priority,
         CASE WHEN s.step <> 2 THEN 'proposed' END AS notes
  FROM companies CROSS JOIN (VALUES (1), (2), (7)) s(step)
), sync_log AS (
  SELECT o_orderkey AS seq, 'src' || (o_custkey % 18) AS org_id,
         CASE WHEN o_orderkey % 4 = 0 THEN 'full' ELSE 'incremental' END AS sync_type,
         CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey % 50 END::bigint AS reviews_added,
         0::bigint AS reviews_updated,
         o_orderdate::date::varchar || 'T08:00:00Z' AS started_at,
         o_orderdate::date::varchar || 'T08:05:00Z' AS finished_at,
         CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN 'timed out' END AS error_message
  FROM orders
), reviews_base AS (
  SELECT doc_id AS id, source AS org_id, 'user ' || ((doc_id // 20) % 97) AS author_name,
         CASE WHEN doc_id % 17 <> 0 THEN (2023 + (doc_id // 20) % 3) || '-'
              || lpad((1 + (doc_id * 7) % 12)::varchar, 2, '0') || '-'
              || lpad((1 + (doc_id * 11) % 28)::varchar, 2, '0') END AS date,
         CASE WHEN (doc_id // 20) % 23 = 3 THEN NULL WHEN (doc_id // 20) % 29 = 4 THEN '' ELSE text END AS text,
         CASE WHEN n_chars % 53 = 0 THEN NULL WHEN n_chars % 13 = 0 THEN n_chars % 5 + 0.5::double
              ELSE (n_chars % 5 + 1)::double END AS stars,
         (n_chars % 7)::int AS likes, (n_chars % 3)::int AS dislikes,
         CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org/r/' || doc_id END AS review_url,
         CASE WHEN (doc_id // 7) % 3 = 0 THEN 'reply'
              WHEN (doc_id // 7) % 3 = 1 AND n_chars % 11 = 0 THEN '' END AS business_response,
         n_chars
  FROM documents
), reviews AS (
  SELECT * EXCLUDE (n_chars),
         CASE WHEN review_url <> '' THEN review_url ELSE 'sha256:' || sha256(concat(
           coalesce(org_id, ''), '|', coalesce(author_name, ''), '|', coalesce(date, ''), '|',
           substr(coalesce(text, ''), 1, 100))) END AS review_key
  FROM reviews_base
), bulk AS (
  SELECT l_suppkey::varchar AS org_id, l_orderkey || '-' || l_linenumber AS review_key,
         l_shipdate::date::varchar AS date, p_name AS text,
         (1 + l_quantity::bigint % 5)::double AS stars,
         CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS business_response,
         l_shipdate, l_suppkey, l_partkey
  FROM lineitem JOIN part ON p_partkey = l_partkey
), bulk_companies AS (
  SELECT s_suppkey::varchar AS org_id, s_name AS name,
         CASE WHEN s_acctbal >= 0 THEN 4.0::double END AS rating FROM supplier
), vectors AS (
  SELECT vec_id AS review_id, embedding AS text_embedding FROM embeddings
  WHERE vec_id IN (SELECT doc_id FROM documents)
), labels AS (
  SELECT d.source AS org_id, c.n, e.label, e.label % 4 AS grp, arg_min(e.embedding, e.vec_id) AS embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN companies c ON c.org_id = d.source
  GROUP BY ALL
), topics AS (
  SELECT n * 1000 + 900 + grp AS id, org_id, NULL::bigint AS parent_id, 'Group ' || grp AS name,
         (grp * 100)::bigint AS position, NULL::float[] AS embedding
  FROM (SELECT DISTINCT org_id, n, grp FROM labels UNION ALL SELECT org_id, n, 9 FROM companies)
  UNION ALL
  SELECT n * 1000 + label, org_id, n * 1000 + 900 + grp, 'Topic ' || label, (grp * 100 + label + 1)::bigint,
         CASE WHEN label <> 9 THEN embedding END
  FROM labels
), matches AS (
  SELECT v.review_id, t.id AS topic_id, r.org_id,
         round(list_cosine_similarity(v.text_embedding::double[], t.embedding::double[]), 12) AS similarity
  FROM vectors v JOIN reviews r ON r.id = v.review_id JOIN topics t ON t.org_id = r.org_id
  WHERE t.parent_id IS NOT NULL AND t.embedding IS NOT NULL
), assigned030 AS (
  SELECT review_id, topic_id, similarity, org_id FROM matches WHERE similarity >= 0.3
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY similarity DESC, topic_id) <= 3
), assigned010 AS (
  SELECT review_id, topic_id, similarity, org_id FROM matches WHERE similarity >= 0.1
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY similarity DESC, topic_id) <= 3
), moments AS (
  SELECT unnest(['2025-12-01', '2025-06-01']) AS as_of
), leaf_scores AS (
  SELECT as_of, t.org_id, t.id AS topic_id, t.parent_id, t.name, t.position, count(r.id) AS n,
         coalesce(floor(sum(coalesce(r.stars, 0) * 2 * w.w) / sum(w.w) * 10 + 0.5)::bigint, 0) AS t10
  FROM moments CROSS JOIN topics t
  LEFT JOIN assigned010 a ON a.topic_id = t.id
  LEFT JOIN reviews r ON r.id = a.review_id AND r.date IS NOT NULL
  LEFT JOIN LATERAL (SELECT CASE WHEN date_diff('day', r.date::date, as_of::date) <= 180 THEN 2.0
                                 WHEN date_diff('day', r.date::date, as_of::date) <= 360 THEN 1.5
                                 ELSE 1.0 END::double AS w WHERE r.id IS NOT NULL) w ON true
  WHERE t.parent_id IS NOT NULL GROUP BY ALL
), parent_scores AS (
  SELECT l.as_of, t.org_id, t.id AS topic_id, t.name, t.position, coalesce(sum(l.n), 0)::bigint AS n,
         coalesce(floor(sum(l.t10 * l.n) / nullif(sum(l.n), 0)::double + 0.5)::bigint, 0) AS t10
  FROM topics t LEFT JOIN leaf_scores l ON l.parent_id = t.id
  WHERE t.parent_id IS NULL AND l.as_of IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT as_of, org_id, id, name, position, 0, 0 FROM topics CROSS JOIN moments
  WHERE parent_id IS NULL AND id NOT IN (SELECT parent_id FROM leaf_scores)
), overall_scores AS (
  SELECT p.as_of, c.org_id, c.name, coalesce(sum(p.n), 0)::bigint AS n,
         coalesce(floor(sum(p.t10 * p.n) / nullif(sum(p.n), 0)::double + 0.5)::bigint, 0) AS t10
  FROM companies c JOIN parent_scores p ON p.org_id = c.org_id GROUP BY ALL
), score_rows AS (
  SELECT as_of, org_id, topic_id, t10, n FROM leaf_scores
  UNION ALL SELECT as_of, org_id, topic_id, t10, n FROM parent_scores
  UNION ALL SELECT as_of, org_id, NULL, t10, n FROM overall_scores
)
"""

CONFIDENCE = "CASE WHEN n >= 20 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END"


def query(name: str, sql: str | None = None, prelude: bool = True) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = (PRELUDE if prelude else "") + sql
        return plan

    return add


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    return PLANS[name](Samples(spark, path))


REVIEW_COLUMNS = (
    "id", "org_id", "review_key", "author_name", "date", "text", "stars", "likes", "dislikes",
    "review_url", "business_response",
)
_REVIEWS = ", ".join(REVIEW_COLUMNS)


# -- sources and listings ---------------------------------------------------------


@query("reviews_scan", f"SELECT {_REVIEWS} FROM reviews")
def _(s: Samples) -> DataFrame:
    return listing.list_reviews(s.reviews(), ordered=False).select(*REVIEW_COLUMNS)


@query("companies_by_role", "SELECT org_id, name, rating, role FROM companies WHERE role = 'competitor' ORDER BY name")
def _(s: Samples) -> DataFrame:
    return listing.list_companies(s.companies(), "competitor").select("org_id", "name", "rating", "role")


@query("review_key", "SELECT id, review_key FROM reviews")
def _(s: Samples) -> DataFrame:
    return ingest.with_review_key(s.reviews().drop("review_key")).select("id", "review_key")


@query("reviews_since", f"SELECT {_REVIEWS} FROM reviews WHERE date >= '2025-03-01'")
def _(s: Samples) -> DataFrame:
    return listing.list_reviews(s.reviews(), since="2025-03-01", ordered=False).select(*REVIEW_COLUMNS)


@query("reviews_star_range", f"SELECT {_REVIEWS} FROM reviews WHERE stars >= 1 AND stars <= 3")
def _(s: Samples) -> DataFrame:
    return listing.list_reviews(s.reviews(), stars="1-3★", ordered=False).select(*REVIEW_COLUMNS)


_NEWEST = "ORDER BY date DESC NULLS LAST, id"


@query("reviews_list", f"""
SELECT {_REVIEWS} FROM reviews WHERE date >= '2024-01-01' AND stars >= 4 AND stars <= 5
QUALIFY row_number() OVER (PARTITION BY org_id {_NEWEST}) <= 20""")
def _(s: Samples) -> DataFrame:
    return listing.list_reviews(s.reviews(), since="2024-01-01", stars="4-5", limit=20).select(*REVIEW_COLUMNS)


@query("reviews_recent", f"SELECT {_REVIEWS} FROM reviews {_NEWEST} LIMIT 25")
def _(s: Samples) -> DataFrame:
    return listing.newest(s.reviews(), 25).select(*REVIEW_COLUMNS)


@query("unanswered", f"""
SELECT id, org_id, split_part(date, 'T', 1) AS date, stars, text, author_name, review_url FROM reviews
WHERE business_response IS NULL
QUALIFY row_number() OVER (PARTITION BY org_id {_NEWEST.replace("date", "reviews.date")}) <= 50""")
def _(s: Samples) -> DataFrame:
    return listing.unanswered(s.reviews())


@query("digest", f"""
SELECT id, org_id, split_part(date, 'T', 1) AS date, stars,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text,
       business_response IS NOT NULL AS has_response,
       CASE WHEN business_response <> '' THEN business_response END AS response
FROM reviews QUALIFY row_number() OVER (PARTITION BY org_id {_NEWEST.replace("date", "reviews.date")}) <= 50""")
def _(s: Samples) -> DataFrame:
    return listing.digest(s.reviews(), responses=True)


@query("search_text", """
SELECT id, org_id, date, stars, text, author_name, business_response IS NOT NULL AS has_response
FROM reviews
WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the_oned%'
ORDER BY date DESC NULLS LAST, id LIMIT 50""")
def _(s: Samples) -> DataFrame:
    return listing.search_text(s.reviews(), "The_onEd")


@query("search_text_filtered", """
SELECT id, org_id, date, stars, text, author_name, business_response IS NOT NULL AS has_response
FROM reviews
WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%re%the%'
  AND stars >= 2 AND stars <= 4 AND org_id = 'src7'
ORDER BY date DESC NULLS LAST, id LIMIT 50""")
def _(s: Samples) -> DataFrame:
    return listing.search_text(s.reviews(), "RE%thE", org_id="src7", stars="2-4")


@query("competitors_of", """
SELECT company_org_id, c.org_id, name, rating, role
FROM relations JOIN companies c ON c.org_id = competitor_org_id""")
def _(s: Samples) -> DataFrame:
    return listing.competitors_of(s.companies(), s.relations()).select(
        "company_org_id", "org_id", "name", "rating", "role"
    )


# -- ingestion --------------------------------------------------------------------


def two_batches(s: Samples) -> tuple[DataFrame, DataFrame]:
    """The bulk feed in two batches, the first one already reduced to a table."""
    early = F.col("l_shipdate") < F.lit(BULK_SPLIT).cast("timestamp_ntz")
    feed = s.bulk()
    current = ingest.reduce_batch(feed.filter(early), BULK_ORDER).drop("n")
    return current, feed.filter(~early)


@query("review_upsert", """
SELECT review_key, arg_min(org_id, o) AS org_id, arg_min(date, o) AS date, arg_max(text, o) AS text,
       arg_max(stars, o) AS stars,
       arg_max(struct_pack(v := business_response), o).v AS business_response
FROM (SELECT *, (l_shipdate, l_suppkey, l_partkey) AS o FROM bulk) GROUP BY review_key""")
def _(s: Samples) -> DataFrame:
    current, batch = two_batches(s)
    return ingest.upsert_reviews(current, batch, BULK_ORDER).select(
        "review_key", "org_id", "date", "text", "stars", "business_response"
    )


def streamed(s: Samples, partials: str | None = None):
    """A store that the feed was streamed into: the lines up to the split date, then the later ones."""
    from starfold.sources.store import Store
    from starfold.streaming import ingest as stream

    lines = s.raw("lineitem")
    early = F.col("l_shipdate") < F.lit(BULK_SPLIT).cast("timestamp_ntz")
    root = f"{shared_dir(s.spark)}/stream-{uuid.uuid4().hex}"
    store = Store(s.spark, f"{root}/tables", buckets=8)
    step = stream.ReviewIngest(store, prepare=s.bulk, order_by=BULK_ORDER, partials=partials)
    for landed in (lines.filter(early), lines.filter(~early)):
        landed.write.mode("append").parquet(f"{root}/landing")
        feed = s.spark.readStream.schema(lines.schema).parquet(f"{root}/landing")
        stream.start(feed, step, f"{root}/progress").awaitTermination()
    return store


@query("stream_ingest", SQL["review_upsert"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """The feed read as a stream and merged into a stored table, in two micro-batches."""
    reviews = streamed(s).read("reviews")
    return reviews.select("review_key", "org_id", "date", "text", "stars", "business_response")


@query("review_upsert_counts", f"""
, keyed AS (
  SELECT review_key, count(*) FILTER (WHERE l_shipdate < '{BULK_SPLIT}') AS c1,
         count(*) FILTER (WHERE l_shipdate >= '{BULK_SPLIT}') AS c2 FROM bulk GROUP BY 1)
SELECT 1 AS batch, count(*) FILTER (WHERE c1 > 0) AS added, (sum(c1) - count(*) FILTER (WHERE c1 > 0))::bigint AS updated FROM keyed
UNION ALL
SELECT 2, count(*) FILTER (WHERE c1 = 0 AND c2 > 0), (sum(c2) - count(*) FILTER (WHERE c1 = 0 AND c2 > 0))::bigint FROM keyed
""")
def _(s: Samples) -> DataFrame:
    current, batch = two_batches(s)
    early = F.col("l_shipdate") < F.lit(BULK_SPLIT).cast("timestamp_ntz")
    none = current.limit(0)
    first = ingest.upsert_counts(none, s.bulk().filter(early)).select(F.lit(1).alias("batch"), "*")
    return first.unionByName(ingest.upsert_counts(current, batch).select(F.lit(2).alias("batch"), "*"))


@query("stream_log", SQL["review_upsert_counts"].removeprefix(PRELUDE))
def _(s: Samples) -> DataFrame:
    """What the log says about the two micro-batches of the streamed feed."""
    return streamed(s).read("sync_log").groupBy(F.col("seq").cast("int").alias("batch")).agg(
        F.sum("reviews_added").alias("added"), F.sum("reviews_updated").alias("updated")
    )


@query("company_upsert", """
, cur AS (
  SELECT 's' || s_suppkey AS org_id, s_name AS name, CASE WHEN s_acctbal >= 0 THEN 4.0::double END AS rating,
         10 AS review_count, CASE WHEN s_nationkey < 5 THEN 'mine' ELSE 'competitor' END AS role FROM supplier
), inc AS (
  SELECT 's' || k AS org_id, CASE WHEN k % 3 <> 0 THEN 'New ' || k END AS name,
         CASE WHEN k % 4 <> 0 THEN (c % 5)::double END AS rating, CASE WHEN k % 5 <> 0 THEN c::int END AS review_count,
         CASE WHEN k % 2 = 0 THEN 'mine' ELSE 'tracked' END AS role
  FROM (SELECT l_suppkey + 1 AS k, count(*) AS c FROM lineitem GROUP BY 1)
)
SELECT org_id, coalesce(inc.name, cur.name) AS name, coalesce(inc.rating, cur.rating) AS rating,
       coalesce(inc.review_count, cur.review_count) AS review_count, coalesce(inc.role, cur.role) AS role
FROM cur FULL JOIN inc USING (org_id)""")
def _(s: Samples) -> DataFrame:
    return ingest.upsert_companies(s.current_companies(), s.incoming_companies())


@query("company_upsert_fields", """
, cur AS (
  SELECT 's' || s_suppkey AS org_id, s_name AS name, 'nation ' || s_nationkey AS address,
         CASE WHEN s_suppkey % 2 = 0 THEN ['a', s_name] END AS categories, 'cafe' AS service_type, 'mine' AS role FROM supplier
), inc AS (
  SELECT 's' || (s_suppkey + 1) AS org_id, CASE WHEN s_suppkey % 3 = 0 THEN 'at ' || s_name END AS address,
         CASE WHEN s_suppkey % 4 = 0 THEN [s_name] END AS categories, CASE WHEN s_suppkey % 5 = 0 THEN 'auto_service' END AS service_type FROM supplier
)
SELECT org_id, cur.name AS name, coalesce(inc.address, cur.address) AS address,
       array_to_string(coalesce(inc.categories, cur.categories), '|') AS categories,
       coalesce(inc.service_type, cur.service_type) AS service_type,
       CASE WHEN inc.org_id IS NULL THEN cur.role ELSE 'tracked' END AS role
FROM cur FULL JOIN inc USING (org_id)""")
def _(s: Samples) -> DataFrame:
    """Address, categories and service type of known companies survive NULLs; an absent role is the default."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    rows = s.raw("supplier")
    current = rows.select(
        F.concat(F.lit("s"), k.cast("string")).alias("org_id"), name.alias("name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("address"),
        F.when(k % 2 == 0, F.array(F.lit("a"), name)).alias("categories"), F.lit("cafe").alias("service_type"), F.lit("mine").alias("role"),
    )
    incoming = rows.select(
        F.concat(F.lit("s"), (k + 1).cast("string")).alias("org_id"), F.when(k % 3 == 0, F.concat(F.lit("at "), name)).alias("address"),
        F.when(k % 4 == 0, F.array(name)).alias("categories"), F.when(k % 5 == 0, F.lit("auto_service")).alias("service_type"),
    )
    merged = ingest.upsert_companies(current, incoming)
    return merged.withColumn("categories", F.when(F.col("categories").isNotNull(), F.array_join("categories", "|")))


_KNOWN = """company_org_id IN (SELECT org_id FROM companies) AND competitor_org_id IN (SELECT org_id FROM companies)"""


@query("relation_add", f"""
SELECT company_org_id, competitor_org_id, priority, notes FROM relations
UNION ALL
SELECT company_org_id, competitor_org_id, NULL, NULL FROM proposed p
WHERE {_KNOWN} AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.company_org_id = p.company_org_id
                               AND r.competitor_org_id = p.competitor_org_id)""")
def _(s: Samples) -> DataFrame:
    return ingest.add_relations(s.relations(), s.proposed_relations(), s.companies())


@query("relations_rejected", f"SELECT DISTINCT company_org_id, competitor_org_id FROM proposed WHERE NOT ({_KNOWN})")
def _(s: Samples) -> DataFrame:
    return ingest.rejected_relations(s.proposed_relations(), s.companies())


@query("relation_upsert", f"""
SELECT company_org_id, competitor_org_id,
       CASE WHEN p.priority IS NOT NULL THEN p.priority ELSE r.priority END AS priority,
       CASE WHEN p.priority IS NOT NULL THEN p.notes ELSE r.notes END AS notes
FROM relations r FULL JOIN (SELECT * FROM proposed WHERE {_KNOWN}) p USING (company_org_id, competitor_org_id)""")
def _(s: Samples) -> DataFrame:
    return ingest.upsert_relations(s.relations(), s.proposed_relations(), s.companies())


@query("relation_remove", """
SELECT * FROM relations r WHERE NOT EXISTS (
  SELECT 1 FROM proposed p WHERE r.company_org_id = p.company_org_id AND r.competitor_org_id = p.competitor_org_id)""")
def _(s: Samples) -> DataFrame:
    return ingest.remove_relations(s.relations(), s.proposed_relations())


@query("org_remove", """
, gone AS (SELECT org_id FROM companies WHERE role = 'tracked'),
lost AS (SELECT id FROM reviews WHERE org_id IN (FROM gone)),
lost_topics AS (SELECT id FROM topics WHERE org_id IN (FROM gone))
SELECT 'companies' AS table_name, count(*) AS row_count, sum(n)::bigint AS key_sum FROM companies WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'company_relations', count(*), sum(priority)::bigint FROM relations
  WHERE company_org_id NOT IN (FROM gone) AND competitor_org_id NOT IN (FROM gone)
UNION ALL SELECT 'reviews', count(*), sum(id)::bigint FROM reviews WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'sync_log', count(*), sum(seq)::bigint FROM sync_log WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'topic_templates', count(*), sum(id)::bigint FROM topics WHERE org_id NOT IN (FROM gone)
UNION ALL SELECT 'review_embeddings', count(*), sum(review_id)::bigint FROM vectors WHERE review_id NOT IN (FROM lost)
UNION ALL SELECT 'review_topics', count(*), sum(topic_id)::bigint FROM assigned030
  WHERE review_id NOT IN (FROM lost) AND topic_id NOT IN (FROM lost_topics)
""")
def _(s: Samples) -> DataFrame:
    keys = {
        "companies": "n", "company_relations": "priority", "reviews": "id", "sync_log": "seq",
        "topic_templates": "id", "review_embeddings": "review_id", "review_topics": "topic_id",
    }
    tables = model(s)
    left = ingest.remove_orgs(tables, tables["companies"].filter(F.col("role") == "tracked"))
    out = None
    for name, key in keys.items():
        part = left[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
            F.sum(key).cast("bigint").alias("key_sum"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def model(s: Samples) -> dict[str, DataFrame]:
    return {
        "companies": s.companies(),
        "company_relations": s.relations(),
        "reviews": s.reviews(),
        "sync_log": s.sync_log(),
        "topic_templates": s.topics(),
        "review_embeddings": s.vectors(),
        "review_topics": assigned(s, 0.3),
    }


def model_scores(s: Samples) -> DataFrame:
    """Rows of the score table at ``AS_OF``."""
    return scoring.score_rows(s.companies(), s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)


def assigned(s: Samples, threshold: float, method: str = "blocks") -> DataFrame:
    return similarity.classify(s.vectors(), s.reviews(), s.topics(), threshold, method=method)


@query("sync_log_append", """
SELECT * FROM sync_log
UNION ALL
SELECT (SELECT max(seq) FROM sync_log) + 1 + n, org_id, 'full', review_count, 0, '2025-12-01T08:00:00Z', NULL, 'ok', NULL
FROM companies""")
def _(s: Samples) -> DataFrame:
    log = s.sync_log()
    start = log.agg(F.max("seq")).scalar()
    new = s.companies().select(
        (start + 1 + F.col("n")).alias("seq"), "org_id", F.lit("full").alias("sync_type"),
        F.col("review_count").cast("bigint").alias("reviews_added"),
        F.lit(0).cast("bigint").alias("reviews_updated"),
        F.lit("2025-12-01T08:00:00Z").alias("started_at"), F.lit("ok").alias("status"),
    )
    return ingest.append_sync(log, new)


@query("topics_replace", """
, listed AS (SELECT org_id FROM companies WHERE role = 'mine')
SELECT t.org_id, p.name AS parent_name, t.name, t.embedding IS NOT NULL AS has_vector
FROM topics t LEFT JOIN topics p ON p.id = t.parent_id WHERE t.org_id NOT IN (FROM listed)
UNION ALL SELECT DISTINCT org_id, NULL, 'Group ' || grp, false FROM labels WHERE org_id IN (FROM listed) AND n % 3 <> 1
UNION ALL SELECT org_id, 'Group ' || grp, 'Topic ' || label, false FROM labels WHERE org_id IN (FROM listed) AND n % 3 <> 1
""")
def _(s: Samples) -> DataFrame:
    listed = configdoc.accepted(s.config()).filter(F.col("role") == "mine")
    out = ingest.replace_topics(s.topics(), configdoc.topic_rows(listed), listed)
    up = topic_ops.parents(out).select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return out.join(up, "parent_id", "left").select(
        "org_id", "parent_name", "name", F.col("embedding").isNotNull().alias("has_vector")
    )


@query("assignments_replace", """
SELECT review_id, topic_id, round(similarity, 6) + 0 AS similarity FROM assigned010
WHERE org_id NOT IN (SELECT org_id FROM companies WHERE role = 'mine')
UNION ALL
SELECT review_id, topic_id, round(similarity, 6) + 0 FROM assigned030
WHERE org_id IN (SELECT org_id FROM companies WHERE role = 'mine')""")
def _(s: Samples) -> DataFrame:
    mine = s.companies().filter(F.col("role") == "mine")
    fresh = similarity.classify(s.vectors().join(mine, "org_id", "left_semi"), None, s.topics(), 0.3)
    return ingest.replace_assignments(assigned(s, 0.1), fresh, s.reviews(), mine).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query("scores_upsert", f"""
SELECT org_id, topic_id, t10 / 10.0::double AS score, n AS review_count, {CONFIDENCE} AS confidence FROM score_rows
WHERE as_of = CASE WHEN org_id IN (SELECT org_id FROM companies WHERE role = 'mine') THEN '2025-12-01' ELSE '2025-06-01' END""")
def _(s: Samples) -> DataFrame:
    companies, mine = s.companies(), s.companies().filter(F.col("role") == "mine")
    topics = s.topics()
    old = schemas.conform(
        scoring.score_rows(companies, topics, assigned(s, 0.1), s.reviews(), "2025-06-01"), schemas.SCORES
    )
    new = scoring.score_rows(
        mine, topics.join(mine, "org_id", "left_semi"), assigned(s, 0.1), s.reviews(), AS_OF
    )
    return ingest.upsert_scores(old, new).drop("computed_at")


@query("sync_mode", """
SELECT org_id, CASE WHEN org_id IN (SELECT org_id FROM sync_log WHERE status = 'ok') THEN 'incremental' ELSE 'full' END AS sync_type
FROM companies""")
def _(s: Samples) -> DataFrame:
    return ingest.sync_mode(s.companies(), s.sync_log())


@query("last_sync", "SELECT * FROM sync_log QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) = 1")
def _(s: Samples) -> DataFrame:
    return ingest.last_sync(s.sync_log())


@query("fk_orphans", """
SELECT 'company_relations' AS table_name, 'competitor_org_id' AS column_name, competitor_org_id AS value, count(*) AS row_count
FROM proposed WHERE competitor_org_id NOT IN (SELECT org_id FROM companies) GROUP BY 3
UNION ALL SELECT 'sync_log', 'org_id', org_id, count(*) FROM sync_log
WHERE org_id NOT IN (SELECT org_id FROM companies) GROUP BY 3
UNION ALL SELECT 'reviews', 'org_id', org_id, count(*) FROM bulk
WHERE org_id NOT IN (SELECT org_id FROM companies) GROUP BY 3
UNION ALL SELECT 'review_embeddings', 'review_id', review_id::varchar, count(*) FROM vectors GROUP BY 3
""")
def _(s: Samples) -> DataFrame:
    tables = model(s) | {
        "company_relations": s.proposed_relations(),
        "reviews": s.bulk_reviews().withColumn("id", F.lit(None).cast("bigint")),
    }
    tables.pop("review_topics")
    return integrity.orphans(tables)


@query("unique_violations", """
SELECT 'reviews' AS table_name, review_key AS key, count(*) AS row_count FROM bulk GROUP BY 2 HAVING count(*) > 1""")
def _(s: Samples) -> DataFrame:
    return integrity.repeated_keys(model(s) | {"reviews": s.bulk_reviews()})


@query("result_json", """
SELECT to_json({'id': id, 'org_id': org_id, 'review_key': review_key, 'author_name': author_name, 'date': date, 'text': text,
       'stars': stars, 'likes': likes, 'dislikes': dislikes, 'review_url': review_url, 'business_response': business_response})::varchar AS json
FROM reviews""")
def _(s: Samples) -> DataFrame:
    return sqlsurface.as_json(s.reviews().select(*REVIEW_COLUMNS))


@query("json_lists", """
SELECT to_json({'org_id': org_id, 'stars': stars, 'ids': ids})::varchar AS json FROM (
  SELECT org_id, list(DISTINCT stars ORDER BY stars) FILTER (stars IS NOT NULL) AS stars, list(id ORDER BY id) AS ids FROM reviews GROUP BY 1)""")
def _(s: Samples) -> DataFrame:
    rows = s.reviews().groupBy("org_id").agg(
        F.array_sort(F.collect_set("stars")).alias("stars"), F.array_sort(F.collect_list("id")).alias("ids")
    )
    return sqlsurface.as_json(rows)


# -- configuration ---------------------------------------------------------------------


@query("config_flatten", """
SELECT DISTINCT org_id, NULL AS parent_name, 'Group ' || grp AS name, n % 3 <> 1 AS own FROM labels WHERE n % 3 <> 1 AND n <> 19
UNION ALL SELECT org_id, 'Group ' || grp, 'Topic ' || label, true FROM labels WHERE n % 3 <> 1 AND n <> 19""")
def _(s: Samples) -> DataFrame:
    rows = configdoc.topic_rows(configdoc.accepted(s.config()))
    up = topic_ops.parents(rows).select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return rows.join(up, "parent_id", "left").select("org_id", "parent_name", "name", F.lit(True).alias("own"))


@query("config_companies", """
SELECT org_id, name, role, CASE WHEN n % 2 = 1 THEN service_type ELSE 'auto_service' END AS service_type
FROM companies WHERE n <> 19""")
def _(s: Samples) -> DataFrame:
    return configdoc.company_rows(configdoc.accepted(s.config()))


@query("config_relations", "SELECT * FROM relations")
def _(s: Samples) -> DataFrame:
    return configdoc.relation_rows(configdoc.accepted(s.config()))


@query("config_rejected", "SELECT n AS pos, org_id, name, CASE WHEN n = 19 THEN 'owner' ELSE role END AS role, CASE WHEN n = 19 THEN 'role' ELSE 'topics' END AS reason FROM companies WHERE n IN (16, 19)")
def _(s: Samples) -> DataFrame:
    return configdoc.rejected(s.config())


_INHERITED = """
, listed AS (SELECT org_id, n, name, role, CASE WHEN n % 2 = 1 THEN service_type ELSE 'auto_service' END AS st
             FROM companies WHERE n <> 19),
donors AS (SELECT st, arg_min(org_id, n) AS donor FROM listed
           WHERE n % 3 <> 1 AND org_id IN (SELECT org_id FROM labels) GROUP BY st),
owners AS (SELECT l.org_id, l.name, l.role, CASE WHEN n = 16 THEN NULL WHEN n % 3 = 1 THEN donor ELSE org_id END AS owner
           FROM listed l LEFT JOIN donors USING (st))
"""


@query("topics_inherit", _INHERITED + """
SELECT o.org_id, 'Group ' || grp AS parent_name, 'Topic ' || label AS name
FROM owners o JOIN labels l ON l.org_id = o.owner""")
def _(s: Samples) -> DataFrame:
    config = configdoc.inherit_topics(configdoc.accepted(s.config()))
    return config.select("org_id", F.explode("topics").alias("t")).select(
        "org_id", F.col("t.name").alias("parent_name"), F.explode("t.subtopics").alias("name")
    )


@query("config_topic_counts", _INHERITED + """
SELECT o.org_id, o.name, o.role, count(DISTINCT grp)::int AS parent_topics, (count(DISTINCT grp) + count(label))::int AS all_topics
FROM owners o LEFT JOIN labels l ON l.org_id = o.owner GROUP BY ALL""")
def _(s: Samples) -> DataFrame:
    return configdoc.topic_counts(configdoc.inherit_topics(configdoc.accepted(s.config())))


# -- normalisation ------------------------------------------------------------------------


_TRIM = r"'^[\s\x{0B}\pZ\x{FEFF}]+|[\s\x{0B}\pZ\x{FEFF}]+$', '', 'g')"
_DIGITS = "regexp_extract(url, '([0-9].*)$', 1)"
_LINKS = """regexp_extract_all(html, 'href="/([^"]*)"', 1)"""


@query("normalize_reviews", f"""
SELECT page_id, 'p' || page_id AS org_id,
  nullif(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), {_TRIM}, '') AS author_name,
  url AS author_icon_url, url AS author_profile_url, NULL::varchar AS date,
  nullif(regexp_replace(CASE WHEN page_id % 5 = 0 THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1)
         ELSE regexp_extract(html, '<article>(.*)</article>', 1, 's') END, {_TRIM}, '') AS text,
  CASE WHEN page_id % 2 = 0
       THEN coalesce(try_cast(regexp_extract(replace(replace({_DIGITS}, '?', ',5'), ',', '.'),
            '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS double), 0)
       ELSE coalesce(list_sum([CASE WHEN contains(x, 'th') THEN 0.0::double
            WHEN contains(x, 'e') THEN 0.5::double ELSE 1.0::double END FOR x IN {_LINKS}]), 0) END AS stars,
  coalesce(try_cast(nullif(regexp_extract({_DIGITS}, '^[0-9]+'), '') AS int), 0) AS likes,
  coalesce(try_cast(nullif(regexp_extract(reverse(url), '^[0-9]+'), '') AS int), 0) AS dislikes,
  'https://yandex.ru/maps/org/p' || page_id || '/reviews?reviews%5BpublicId%5D='
    || nullif(split_part(regexp_replace(url, '/$', ''), '/', -1), '') || '&utm_source=review' AS review_url,
  nullif(regexp_replace(regexp_extract(html, '<footer>(.*)</footer>', 1, 's'), {_TRIM}, '') AS business_response
FROM pages""", prelude=False)
def _(s: Samples) -> DataFrame:
    raw = s.raw_reviews()
    clean = normalize.normalize_reviews(raw)
    return clean.withColumn("page_id", F.substring("org_id", 2, 20).cast("bigint"))


@query("normalize_companies", f"""
SELECT 'p' || page_id AS org_id,
  nullif(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), {_TRIM}, '') AS name,
  try_cast(nullif(replace(regexp_extract(url, '([0-9]+[.,][0-9]+|[0-9]+)', 1), ',', '.'), '') AS double) AS rating,
  try_cast(nullif(regexp_extract({_DIGITS}, '^[0-9]+'), '') AS int) AS review_count, NULL::varchar AS address,
  array_to_string([x FOR x IN {_LINKS} IF NOT contains(x, 'th')], '|') AS categories
FROM pages""", prelude=False)
def _(s: Samples) -> DataFrame:
    return normalize.normalize_companies(s.raw_companies()).withColumn(
        "categories", F.array_join("categories", "|")
    )


@query("total_counts", f"""
SELECT 'p' || page_id AS org_id, coalesce(nullif(try_cast(nullif(regexp_extract({_DIGITS}, '^[0-9]+'), '') AS int), 0), 1)::bigint AS total_count
FROM pages""", prelude=False)
def _(s: Samples) -> DataFrame:
    return normalize.total_counts(
        normalize.normalize_companies(s.raw_companies()), normalize.normalize_reviews(s.raw_reviews())
    )


@query("vector_decode", """
SELECT vec_id, (pos - 1)::int AS pos, embedding[pos]::double AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) t(pos)""", prelude=False)
def _(s: Samples) -> DataFrame:
    blobs = s.raw("embeddings").select("vec_id", vec.encode_f32("embedding").alias("blob"))
    return blobs.select("vec_id", F.posexplode(vec.decode_f32("blob")).alias("pos", "v")).select(
        "vec_id", "pos", F.col("v").cast("double").alias("value")
    )


@query("vector_text", """
SELECT vec_id, (pos - 1)::int AS pos, embedding[pos]::double AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) t(pos)""", prelude=False)
def _(s: Samples) -> DataFrame:
    texts = s.raw("embeddings").select("vec_id", vec.format_vector_text(F.col("embedding")).alias("t"))
    return texts.select("vec_id", F.posexplode(vec.parse_vector_text(F.col("t")).cast("array<float>")).alias("pos", "v")).select(
        "vec_id", "pos", F.col("v").cast("double").alias("value")
    )


# -- statistics -----------------------------------------------------------------------------


def stats_sql(companies: str, reviews: str, where: str = "") -> str:
    return f"""
SELECT c.org_id, c.name, c.rating, count(r.org_id) AS total_reviews,
       floor(coalesce(avg(r.stars), 0) * 100 + 0.5) / 100 AS avg_stars,
       coalesce(floor(count(r.business_response) / nullif(count(r.org_id), 0) * 100 + 0.5) / 100, 0) AS response_rate,
       count(*) FILTER (WHERE r.text <> '') AS reviews_with_text, min(r.date) AS first_date, max(r.date) AS last_date
FROM {companies} c LEFT JOIN (SELECT * FROM {reviews} {where}) r ON r.org_id = c.org_id GROUP BY ALL"""


@query("org_stats", stats_sql("companies", "reviews"))
def _(s: Samples) -> DataFrame:
    return summary.org_stats(s.companies(), s.reviews())


@query("org_stats_since", stats_sql("companies", "reviews", "WHERE date >= '2025-11-20'"))
def _(s: Samples) -> DataFrame:
    return summary.org_stats(s.companies(), s.reviews(), since="2025-11-20")


@query("org_stats_bulk", stats_sql("bulk_companies", "bulk"))
def _(s: Samples) -> DataFrame:
    return summary.org_stats(s.bulk_companies(), s.bulk_reviews())


@query("star_histogram", """
, found AS (SELECT org_id, round(stars)::int AS star, count(*) AS c FROM reviews GROUP BY ALL)
SELECT org_id, star, sum(c)::bigint AS review_count FROM (
  SELECT org_id, star, c FROM found
  UNION ALL SELECT org_id, s, 0 FROM companies CROSS JOIN unnest([1, 2, 3, 4, 5]) t(s)) GROUP BY ALL""")
def _(s: Samples) -> DataFrame:
    return summary.star_histogram(s.companies(), s.reviews())


def trend_sql(label: str, reviews: str = "reviews", limit: int | None = None) -> str:
    top = f"QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY period DESC NULLS LAST) <= {limit}" if limit else ""
    return f"""
, days AS (SELECT *, date::date AS d FROM {reviews} WHERE date IS NOT NULL)
SELECT org_id, {label} AS period, count(*) AS review_count, round(avg(stars), 2) AS avg_stars
FROM days GROUP BY 1, 2 {top}"""


@query("trends_month", trend_sql("strftime(d, '%Y-%m')"))
def _(s: Samples) -> DataFrame:
    return summary.trends(s.reviews(), "month")


@query("trends_week", trend_sql("strftime(d, '%Y-W%W')"))
def _(s: Samples) -> DataFrame:
    return summary.trends(s.reviews(), "week")


@query("trends_quarter", trend_sql("year(d) || '-Q' || quarter(d)", limit=4))
def _(s: Samples) -> DataFrame:
    return summary.trends(s.reviews(), "quarter", limit=4)


@query("trends_week_bulk", trend_sql("strftime(d, '%Y-W%W')", "bulk"))
def _(s: Samples) -> DataFrame:
    return summary.trends(s.bulk_reviews(), "week")


@query("trends_bad_dates", """
, moved AS (
  SELECT org_id, stars, CASE WHEN n_chars % 15 IN (4, 9) THEN NULL ELSE CASE n_chars % 5 WHEN 0 THEN date::date + 1 WHEN 1 THEN date::date - 1
         WHEN 2 THEN date_trunc('month', date::date)::date + 30 WHEN 3 THEN NULL ELSE date::date END END AS d
  FROM reviews_base WHERE date IS NOT NULL OR n_chars % 5 = 3)
SELECT org_id, strftime(d, '%Y-%m') AS period, count(*) AS review_count, round(avg(stars), 2) AS avg_stars
FROM moved GROUP BY ALL""")
def _(s: Samples) -> DataFrame:
    return summary.trends(s.odd_dates(), "month")


@query("compare", """
, totals AS (SELECT org_id, count(*) AS c, avg(stars) AS a FROM reviews GROUP BY 1),
sides AS (SELECT org_id AS company_org_id, org_id, 0 AS side FROM companies
          UNION ALL SELECT company_org_id, competitor_org_id, 1 FROM relations)
SELECT company_org_id, (row_number() OVER (PARTITION BY company_org_id ORDER BY side, c.name, c.org_id) - 1)::int AS rank,
       c.org_id, c.name, c.rating, c.review_count, coalesce(t.c, 0) AS reviews_in_db, round(t.a, 9) AS avg_stars
FROM sides s JOIN companies c ON c.org_id = s.org_id LEFT JOIN totals t ON t.org_id = c.org_id""")
def _(s: Samples) -> DataFrame:
    return summary.compare(s.companies(), s.relations(), s.reviews()).withColumn(
        "avg_stars", F.round("avg_stars", 9)
    )


@query("compare_one", """
, totals AS (SELECT org_id, count(*) AS c, avg(stars) AS a FROM reviews GROUP BY 1),
sides AS (SELECT org_id AS company_org_id, org_id, 0 AS side FROM companies
          UNION ALL SELECT company_org_id, competitor_org_id, 1 FROM relations)
SELECT company_org_id, (row_number() OVER (PARTITION BY company_org_id ORDER BY side, c.name, c.org_id) - 1)::int AS rank,
       c.org_id, c.name, c.rating, c.review_count, coalesce(t.c, 0) AS reviews_in_db, round(t.a, 9) AS avg_stars
FROM sides s JOIN companies c ON c.org_id = s.org_id LEFT JOIN totals t ON t.org_id = c.org_id
WHERE company_org_id = 'src1'""")
def _(s: Samples) -> DataFrame:
    return summary.compare(s.companies(), s.relations(), s.reviews(), "src1").withColumn(
        "avg_stars", F.round("avg_stars", 9)
    )


@query("sync_status", """
, last AS (SELECT * FROM sync_log QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY seq DESC) = 1)
SELECT c.org_id, c.name, c.role, (SELECT count(*) FROM reviews r WHERE r.org_id = c.org_id) AS reviews_in_db,
       coalesce(l.finished_at, 'never') AS last_sync, coalesce(l.sync_type, '—') AS last_sync_type,
       coalesce(l.status, '—') AS last_status
FROM companies c LEFT JOIN last l ON l.org_id = c.org_id""")
def _(s: Samples) -> DataFrame:
    return summary.sync_status(s.companies(), s.reviews(), s.sync_log())


@query("recency_weight", """
SELECT id, CASE WHEN date_diff('day', date::date, DATE '2025-12-01') <= 180 THEN 2.0
                WHEN date_diff('day', date::date, DATE '2025-12-01') <= 360 THEN 1.5 ELSE 1.0 END::double AS weight
FROM reviews""")
def _(s: Samples) -> DataFrame:
    return s.reviews().select("id", cal.recency_weight(F.col("date"), AS_OF).alias("weight"))


# -- vectors and topics -------------------------------------------------------------------------


@query("cosine_pairs", """
SELECT v.review_id, t.id AS topic_id, round(list_cosine_similarity(v.text_embedding::double[], t.embedding::double[]), 6) + 0 AS similarity
FROM vectors v JOIN reviews r ON r.id = v.review_id JOIN topics t ON t.org_id = r.org_id
WHERE t.embedding IS NOT NULL""")
def _(s: Samples) -> DataFrame:
    return similarity.similarity_pairs(
        similarity.owned_vectors(s.vectors(), None),
        similarity.classifiers(s.topics()), ["org_id"],
    ).select("review_id", "topic_id", F.round("similarity", 6).alias("similarity"))


def _assigned_sql(name: str) -> str:
    return f"SELECT review_id, topic_id, round(similarity, 6) + 0 AS similarity FROM {name}"


@query("classify_030", _assigned_sql("assigned030"))
def _(s: Samples) -> DataFrame:
    return assigned(s, 0.3, "blocks").withColumn("similarity", F.round("similarity", 6))


@query("classify_010", _assigned_sql("assigned010"))
def _(s: Samples) -> DataFrame:
    return assigned(s, 0.1, "blocks").withColumn("similarity", F.round("similarity", 6))


@query("classify_pairs", _assigned_sql("assigned010"))
def _(s: Samples) -> DataFrame:
    return assigned(s, 0.1, "pairs").withColumn("similarity", F.round("similarity", 6))


@query("vector_mismatches", """
, uneven AS (SELECT review_id, r.org_id, CASE WHEN review_id % 5 = 0 THEN 3 ELSE len(text_embedding) END AS length
             FROM vectors v JOIN reviews r ON r.id = v.review_id)
SELECT org_id, count(*) AS vectors, count(*) FILTER (WHERE length <> 64) AS mismatched FROM uneven
WHERE org_id IN (SELECT org_id FROM topics WHERE parent_id IS NOT NULL AND embedding IS NOT NULL) GROUP BY 1""")
def _(s: Samples) -> DataFrame:
    short = F.when(F.col("review_id") % 5 == 0, F.slice("text_embedding", 1, 3)).otherwise(F.col("text_embedding"))
    return similarity.vector_mismatches(s.vectors().withColumn("text_embedding", short), None, s.topics())


@query("has_vectors", "SELECT count(*) > 0 AS any_vectors FROM vectors")
def _(s: Samples) -> DataFrame:
    return s.vectors().select("review_id").limit(1).agg((F.count(F.lit(1)) > 0).alias("any_vectors"))


@query("vectors_save", """
SELECT review_id, CASE WHEN review_id % 3 = 0 THEN 'newer' ELSE 'sample' END AS model,
       round(list_sum(text_embedding::double[]) * CASE WHEN review_id % 3 = 0 THEN 2 ELSE 1 END, 4) + 0 AS total FROM vectors
UNION ALL SELECT -review_id - 1, 'newer', round(list_sum(text_embedding::double[]) * 2, 4) + 0 FROM vectors WHERE review_id % 3 = 0""")
def _(s: Samples) -> DataFrame:
    """A third of the vectors is embedded anew, and as many reviews get their first vector."""
    doubled = F.transform("text_embedding", lambda x: (x * 2).cast("float"))
    again = s.vectors().filter("review_id % 3 = 0").withColumn("text_embedding", doubled).withColumn("model", F.lit("newer"))
    first = again.withColumn("review_id", -F.col("review_id") - 1)
    current = schemas.conform(s.vectors(), schemas.REVIEW_VECTORS)
    total = F.aggregate("text_embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return ingest.save_vectors(current, again.unionByName(first)).select("review_id", "model", F.round(total, 4).alias("total"))


class LengthEmbedder:
    """A vector of counts that SQL can restate: all characters, letters a, blanks."""

    model = "lengths"

    def embed(self, df: DataFrame) -> DataFrame:
        text = F.col("text")
        without = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
        vector = F.array(F.length(text), without("a"), without(" ")).cast("array<float>")
        return df.select(*[c for c in df.columns if c != "text"], vector.alias("embedding"))


_LENGTHS = """[length({t}), length({t}) - length(replace({t}, 'a', '')), length({t}) - length(replace({t}, ' ', ''))]"""


def _spread(rows: DataFrame, *keys: str, vector: str) -> DataFrame:
    return rows.select(*keys, *[F.col(vector)[k].cast("double").alias(f"v{k}") for k in range(3)])


_BY_PLACE = ", ".join(f"(v[{k + 1}])::double AS v{k}" for k in range(3))


@query("embed_lengths", f"""
SELECT review_id, org_id, {_BY_PLACE} FROM (
  SELECT id AS review_id, org_id, {_LENGTHS.format(t="text")} AS v FROM reviews
  WHERE text <> '' AND id NOT IN (SELECT review_id FROM vectors))""")
def _(s: Samples) -> DataFrame:
    rows = embedding.embed_reviews(s.reviews(), s.vectors(), LengthEmbedder())
    return _spread(rows, "review_id", "org_id", vector="text_embedding")


@query("embed_force", f"""
SELECT review_id, {_BY_PLACE} FROM (SELECT id AS review_id, {_LENGTHS.format(t="text")} AS v FROM reviews WHERE text <> '')""")
def _(s: Samples) -> DataFrame:
    """Every text is embedded anew and replaces the vector it had."""
    new = embedding.embed_reviews(s.reviews(), s.vectors(), LengthEmbedder(), force=True)
    saved = ingest.save_vectors(schemas.conform(s.vectors(), schemas.REVIEW_VECTORS), new).filter("model = 'lengths'")
    return _spread(saved, "review_id", vector="text_embedding")


@query("embed_topics", f"""
SELECT id, {_BY_PLACE} FROM (SELECT id, {_LENGTHS.format(t="name")} AS v FROM topics WHERE embedding IS NULL)""")
def _(s: Samples) -> DataFrame:
    new = embedding.embed_topics(s.topics(), LengthEmbedder())
    saved = ingest.save_topic_vectors(s.topics(), new).join(new.select("id"), "id", "left_semi")
    return _spread(saved, "id", vector="embedding")


@query("search_mode", """
SELECT 'text' AS mode, id FROM (
  SELECT id, date FROM reviews
  WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%'
  ORDER BY date DESC NULLS LAST, id LIMIT 50)
UNION ALL SELECT 'semantic', id FROM (
  SELECT r.id FROM vectors v JOIN reviews r ON r.id = v.review_id WHERE r.text <> ''
  ORDER BY round(list_cosine_similarity(v.text_embedding::double[], [1.0::double FOR i IN range(64)]), 12) DESC, r.id LIMIT 50)""")
def _(s: Samples) -> DataFrame:
    """Semantic with vectors and an embedder that works; text without vectors."""
    from starfold.plans import search

    ones = embedding.BatchEmbedder(lambda texts: [[1.0] * 64 for _ in texts], "ones")
    out = None
    for vectors in (s.vectors(), s.vectors().limit(0)):
        mode, rows = search.search(s.spark, s.reviews(), vectors, "the", ones)
        part = rows.select(F.lit(mode).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("classify_top3", """
SELECT review_id, topic_id FROM matches
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY similarity DESC, topic_id) <= 3""")
def _(s: Samples) -> DataFrame:
    return assigned(s, -1.0).select("review_id", "topic_id")


@query("classified_counts", """
SELECT c.org_id, (SELECT count(DISTINCT review_id) FROM assigned030 a WHERE a.org_id = c.org_id) AS classified FROM companies c""")
def _(s: Samples) -> DataFrame:
    return topic_ops.classified_counts(s.companies(), s.reviews(), assigned(s, 0.3))


@query("unembedded", """
SELECT id, org_id, text FROM reviews WHERE text <> '' AND id NOT IN (SELECT review_id FROM vectors)""")
def _(s: Samples) -> DataFrame:
    return embedding.unembedded(s.reviews(), s.vectors())


@query("embedding_coverage", """
SELECT c.org_id, (SELECT count(*) FROM reviews r WHERE r.org_id = c.org_id AND text <> '') AS reviews_with_text,
       (SELECT count(*) FROM reviews r WHERE r.org_id = c.org_id AND id IN (SELECT review_id FROM vectors)) AS reviews_embedded,
       (SELECT count(*) FROM topics t WHERE t.org_id = c.org_id) AS topics,
       (SELECT count(embedding) FROM topics t WHERE t.org_id = c.org_id) AS topics_embedded
FROM companies c""")
def _(s: Samples) -> DataFrame:
    return embedding.coverage(s.companies(), s.reviews(), s.vectors(), s.topics())


@query("embed_backlog", """
SELECT id AS review_id, 'hashing-256' AS model, 256 AS dim, 1.0::double AS length
FROM reviews WHERE text <> '' AND id NOT IN (SELECT review_id FROM vectors)""")
def _(s: Samples) -> DataFrame:
    rows = embedding.embed_reviews(s.reviews(), s.vectors(), embedding.HashingEmbedder())
    return rows.select(
        "review_id", "model", F.size("text_embedding").alias("dim"),
        F.round(vec.norm(F.col("text_embedding")), 4).alias("length"),
    )


_HITS = """
SELECT r.id, r.org_id, r.date, r.stars, r.text, r.author_name, r.business_response IS NOT NULL AS has_response,
       round(list_cosine_similarity(v.text_embedding::double[], {query}), 6) + 0 AS similarity
FROM vectors v JOIN reviews r ON r.id = v.review_id WHERE r.text <> '' {where}
ORDER BY round(list_cosine_similarity(v.text_embedding::double[], {query}), 12) DESC, r.id LIMIT {limit}"""

#: A fixed query vector, by rule.
QUERY_VECTOR = [((i * 7) % 13 - 6) / 10.0 for i in range(64)]
_QUERY_SQL = "[((i * 7) % 13 - 6) / 10.0::double FOR i IN range(64)]"


@query("semantic_search", _HITS.format(query=_QUERY_SQL, where="", limit=50))
def _(s: Samples) -> DataFrame:
    return similarity.semantic_search(s.reviews(), s.vectors(), QUERY_VECTOR).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query("semantic_search_filtered", _HITS.format(
    query=_QUERY_SQL, where="AND r.org_id = 'src5' AND r.stars >= 3 AND r.stars <= 5", limit=50))
def _(s: Samples) -> DataFrame:
    return similarity.semantic_search(
        s.reviews(), s.vectors(), QUERY_VECTOR, org_id="src5", stars="3-5"
    ).withColumn("similarity", F.round("similarity", 6))


@query("similar_by_review", _HITS.format(
    query="(SELECT text_embedding::double[] FROM vectors WHERE review_id = 11)", where="", limit=10))
def _(s: Samples) -> DataFrame:
    return similarity.similar_to_review(s.reviews(), s.vectors(), 11).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query("topic_hierarchy", """
SELECT p.org_id, p.id AS parent_id, p.name AS parent_name, p.position AS parent_position,
       t.id AS topic_id, t.name, t.position
FROM topics p LEFT JOIN topics t ON t.parent_id = p.id WHERE p.parent_id IS NULL""")
def _(s: Samples) -> DataFrame:
    return topic_ops.hierarchy(s.topics())


_LEAVES = """
, leaves AS (
  SELECT t.org_id, t.id AS topic_id, t.parent_id, t.name, t.position, count(r.id) AS n, coalesce(avg(r.stars), 0) AS m
  FROM topics t LEFT JOIN assigned010 a ON a.topic_id = t.id LEFT JOIN reviews r ON r.id = a.review_id
  WHERE t.parent_id IS NOT NULL GROUP BY ALL)
"""


@query("topic_stats", _LEAVES + """
SELECT org_id, topic_id, parent_id, name, n AS review_count, floor(m * 10 + 0.5) / 10 AS avg_stars FROM leaves""")
def _(s: Samples) -> DataFrame:
    return topic_ops.topic_stats(s.topics(), assigned(s, 0.1), s.reviews())


@query("topic_tree", _LEAVES + """
, heads AS (
  SELECT t.org_id, t.id AS topic_id, t.name, t.position, coalesce(sum(l.n), 0)::bigint AS review_count,
         floor(coalesce(sum(l.m * l.n) / nullif(sum(l.n), 0), 0) * 10 + 0.5) / 10 AS avg_stars
  FROM topics t LEFT JOIN leaves l ON l.parent_id = t.id WHERE t.parent_id IS NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY review_count DESC, position, topic_id)::int AS rank FROM heads)
SELECT org_id, rank, 0 AS level, topic_id, NULL::bigint AS parent_id, name, review_count, avg_stars FROM ranked
UNION ALL
SELECT l.org_id, h.rank, 1, l.topic_id, l.parent_id, l.name, l.n, floor(l.m * 10 + 0.5) / 10
FROM leaves l JOIN ranked h ON h.topic_id = l.parent_id""")
def _(s: Samples) -> DataFrame:
    return topic_ops.topic_tree(s.topics(), assigned(s, 0.1), s.reviews())


@query("topic_tree_json", _LEAVES + """
, heads AS (
  SELECT t.org_id, t.id AS topic_id, t.name, t.position, coalesce(sum(l.n), 0)::bigint AS review_count,
         floor(coalesce(sum(l.m * l.n) / nullif(sum(l.n), 0), 0) * 10 + 0.5) / 10 AS avg_stars,
         coalesce(list({'topic_id': l.topic_id, 'name': l.name, 'review_count': l.n, 'avg_stars': floor(l.m * 10 + 0.5) / 10}
                       ORDER BY l.position, l.topic_id) FILTER (l.topic_id IS NOT NULL), []) AS children
  FROM topics t LEFT JOIN (SELECT l.*, t.position FROM leaves l JOIN topics t ON t.id = l.topic_id) l ON l.parent_id = t.id
  WHERE t.parent_id IS NULL GROUP BY ALL)
SELECT org_id, row_number() OVER (PARTITION BY org_id ORDER BY review_count DESC, position, topic_id)::int AS rank,
       to_json({'topic_id': topic_id, 'name': name, 'review_count': review_count, 'avg_stars': avg_stars, 'children': children})::varchar AS json
FROM heads""")
def _(s: Samples) -> DataFrame:
    """Every parent topic as one JSON object with its subtopics in document order."""
    tree = topic_ops.topic_tree_nested(s.topics(), assigned(s, 0.1), s.reviews())
    shown = F.struct("topic_id", "name", "review_count", "avg_stars", "children")
    return tree.select("org_id", "rank", F.to_json(shown).alias("json"))


# -- scores ------------------------------------------------------------------------------------------


@query("subtopic_score", f"""
SELECT org_id, topic_id, name, t10 / 10.0::double AS score, n AS review_count, {CONFIDENCE} AS confidence
FROM leaf_scores WHERE as_of = '{AS_OF}'""")
def _(s: Samples) -> DataFrame:
    return scoring.subtopic_scores(s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)


_RANKED = f"""
, ranked AS (
  SELECT org_id, row_number() OVER (PARTITION BY org_id ORDER BY t10 DESC, position, topic_id)::int AS rank,
         topic_id, name, t10, n FROM parent_scores WHERE as_of = '{AS_OF}')
"""


@query("parent_score", _RANKED + f"""
SELECT org_id, rank, topic_id, name, t10 / 10.0::double AS score, n AS review_count, {CONFIDENCE} AS confidence FROM ranked""")
def _(s: Samples) -> DataFrame:
    return scoring.parent_scores(s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)


@query("overall_score", f"""
SELECT org_id, name, t10 / 10.0::double AS overall_score, n AS total_reviews FROM overall_scores WHERE as_of = '{AS_OF}'""")
def _(s: Samples) -> DataFrame:
    return scoring.overall_scores(s.companies(), s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)


@query("score_full", f"""
SELECT org_id, topic_id, t10 / 10.0::double AS score, n AS review_count, {CONFIDENCE} AS confidence
FROM score_rows WHERE as_of = '{AS_OF}'""")
def _(s: Samples) -> DataFrame:
    return scoring.score_rows(s.companies(), s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)


@query("score_compare", _RANKED + """
, pairs AS (SELECT company_org_id AS org_a, competitor_org_id AS org_b FROM relations),
a AS (SELECT org_a, org_b, name, t10, rank FROM pairs JOIN ranked ON org_id = org_a),
b AS (SELECT org_a, org_b, name, t10, rank FROM pairs JOIN ranked ON org_id = org_b),
both_sides AS (SELECT org_a, org_b, name, coalesce(a.t10, 0) AS ta, coalesce(b.t10, 0) AS tb, a.rank AS ra, b.rank AS rb
         FROM a FULL JOIN b USING (org_a, org_b, name))
SELECT org_a, org_b, row_number() OVER (PARTITION BY org_a, org_b ORDER BY ra NULLS LAST, rb, name)::int AS place, name,
       ta / 10.0::double AS score_a, tb / 10.0::double AS score_b, (ta - tb) / 10.0::double AS delta,
       CASE WHEN ta - tb >= 5 THEN '✅' WHEN ta - tb <= -5 THEN '❌' ELSE '' END AS marker
FROM both_sides""")
def _(s: Samples) -> DataFrame:
    heads = scoring.parent_scores(s.topics(), assigned(s, 0.1), s.reviews(), AS_OF)
    pairs = s.relations().select(
        F.col("company_org_id").alias("org_a"), F.col("competitor_org_id").alias("org_b")
    )
    return scoring.compare_scores(heads, pairs)


# -- raw SQL ----------------------------------------------------------------------------------------------

SQL_TEXTS = {
    "sql_join_agg": """
SELECT c.role, count(*) AS reviews, count(DISTINCT r.org_id) AS orgs, round(avg(r.stars), 4) AS avg_stars
FROM reviews r JOIN companies c ON c.org_id = r.org_id
WHERE r.date >= '2024-01-01' GROUP BY c.role""",
    "sql_cte_window": """
SELECT org_id, id, date, likes FROM (
  SELECT org_id, id, date, likes,
         row_number() OVER (PARTITION BY org_id ORDER BY likes DESC, id) AS place FROM reviews) t
WHERE place <= 3""",
    "sql_setops": """
SELECT org_id FROM companies WHERE role = 'mine'
UNION
SELECT competitor_org_id FROM relations
EXCEPT
SELECT org_id FROM companies WHERE rating IS NULL""",
    "sql_subquery": """
SELECT r.id, r.org_id, r.likes FROM reviews r
WHERE r.likes > (SELECT avg(likes) FROM reviews x WHERE x.org_id = r.org_id)
  AND r.org_id IN (SELECT org_id FROM companies WHERE role <> 'tracked')""",
    "sql_rollup": """
SELECT c.role, c.org_id, count(*) AS reviews
FROM reviews r JOIN companies c ON c.org_id = r.org_id GROUP BY ROLLUP (c.role, c.org_id)""",
}


def _add_sql(name: str, text: str) -> None:
    @query(name, text)
    def _(s: Samples) -> DataFrame:
        tables = {"reviews": s.reviews(), "companies": s.companies(), "relations": s.relations()}
        return sqlsurface.query(s.spark, text, tables)


for _name, _text in SQL_TEXTS.items():
    _add_sql(_name, _text)


from starfold.plans import stored_queries  # noqa: E402,F401  (registers its queries here)
