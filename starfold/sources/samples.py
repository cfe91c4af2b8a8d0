"""The model's tables derived from the generated benchmark tables.

``documents`` play the reviews of 20 orgs (the document sources), ``lineitem``
the bulk feed with repeated keys, ``embeddings`` the review and topic vectors,
``orders`` the sync log and ``pages`` raw page attributes. NULLs, empty texts
and half stars are introduced by rule, since the generated tables hold none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starfold.operators.ingest import with_review_key

AS_OF = "2025-12-01"
BULK_ORDER = ("l_shipdate", "l_suppkey", "l_partkey")
BULK_SPLIT = "1998-06-01"


def once(build: Callable[[Samples], DataFrame]) -> Callable[[Samples], DataFrame]:
    """Build a table's plan on first use and hand out the same plan afterwards."""

    @wraps(build)
    def get(self: Samples) -> DataFrame:
        if build.__name__ not in self._plans:
            self._plans[build.__name__] = build(self)
        return self._plans[build.__name__]

    return get


class Samples:
    """Lazy tables over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._schemas: dict[str, StructType] = {}
        self._plans: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A generated table. Its schema is read from the file once."""
        file = f"{self.path}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(self._schemas[name]).parquet(file)

    # -- organisations -------------------------------------------------------

    @once
    def companies(self) -> DataFrame:
        per = self.raw("documents").groupBy(F.col("source").alias("org_id")).agg(
            F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("docs")
        )
        return per.selectExpr(
            "org_id",
            "concat('Org ', org_id) AS name",
            "IF(low % 7 <> 3, 3.0D + low % 20 * 0.1D, NULL) AS rating",
            "int(docs) AS review_count",
            "CASE WHEN low % 20 < 4 THEN 'mine' WHEN low % 20 < 14 THEN 'competitor' ELSE 'tracked' END AS role",
            "IF(low % 20 % 2 = 0, 'auto_service', 'cafe') AS service_type",
            "low % 20 AS n",
        )

    @once
    def relations(self) -> DataFrame:
        """Each own company against the orgs one and five places further on."""
        orgs = self.companies().select("org_id", "role", "n")
        step = F.explode(F.array(F.lit(1), F.lit(5))).alias("step")
        own = orgs.filter(F.col("role") == "mine").select(
            F.col("org_id").alias("company_org_id"), F.col("n").alias("own_n"), step
        )
        target = orgs.select(F.col("org_id").alias("competitor_org_id"), F.col("n").alias("k"))
        return own.withColumn("k", (F.col("own_n") + F.col("step")) % 20).join(target, "k").select(
            "company_org_id",
            "competitor_org_id",
            F.col("step").cast("int").alias("priority"),
            F.concat(F.lit("step "), F.col("step").cast("string")).alias("notes"),
        )

    def proposed_relations(self) -> DataFrame:
        """Pairs that partly exist, partly are new and partly name an unknown org."""
        n = F.col("n")
        return (
            self.companies()
            .select(F.col("org_id").alias("company_org_id"), "n",
                    F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("step"))
            .select(
                "company_org_id",
                F.concat(F.lit("src"), (n + F.col("step")).cast("string")).alias("competitor_org_id"),
                (F.col("step") + 10).cast("int").alias("priority"),
                F.when(F.col("step") != 2, F.lit("proposed")).alias("notes"),
            )
        )

    @once
    def sync_log(self) -> DataFrame:
        o = F.col
        day = o("o_orderdate").cast("date").cast("string")
        failed = o("o_orderstatus") == "P"
        return self.raw("orders").select(
            o("o_orderkey").alias("seq"),
            F.concat(F.lit("src"), (o("o_custkey") % 18).cast("string")).alias("org_id"),
            F.when(o("o_orderkey") % 4 == 0, "full").otherwise("incremental").alias("sync_type"),
            F.when(failed, 0).otherwise(o("o_custkey") % 50).cast("bigint").alias("reviews_added"),
            F.lit(0).cast("bigint").alias("reviews_updated"),
            F.concat(day, F.lit("T08:00:00Z")).alias("started_at"),
            F.concat(day, F.lit("T08:05:00Z")).alias("finished_at"),
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(failed, "timed out").alias("error_message"),
        )

    # -- reviews ---------------------------------------------------------------

    @once
    def reviews(self) -> DataFrame:
        seen = self.raw("documents").selectExpr(
            "doc_id AS id",
            "source AS org_id",
            "concat('user ', doc_id div 20 % 97) AS author_name",
            "IF(doc_id % 17 <> 0, concat_ws('-', 2023 + doc_id div 20 % 3, lpad(doc_id * 7 % 12 + 1, 2, '0'),"
            " lpad(doc_id * 11 % 28 + 1, 2, '0')), NULL) AS date",
            "CASE WHEN doc_id div 20 % 23 = 3 THEN NULL WHEN doc_id div 20 % 29 = 4 THEN '' ELSE text END AS text",
            "CASE WHEN n_chars % 53 = 0 THEN NULL WHEN n_chars % 13 = 0 THEN n_chars % 5 + 0.5D"
            " ELSE n_chars % 5 + 1.0D END AS stars",
            "int(n_chars % 7) AS likes",
            "int(n_chars % 3) AS dislikes",
            "IF(doc_id % 3 <> 0, concat('https://example.org/r/', doc_id), NULL) AS review_url",
            "CASE WHEN doc_id div 7 % 3 = 0 THEN 'reply'"
            " WHEN doc_id div 7 % 3 = 1 AND n_chars % 11 = 0 THEN '' END AS business_response",
        )
        return with_review_key(seen)

    def odd_dates(self) -> DataFrame:
        """Reviews whose dates carry times and zones, roll over, or cannot be read."""
        chars, date = F.col("n_chars"), F.col("date")
        docs = self.raw("documents").select(F.col("doc_id").alias("id"), "n_chars")
        return self.reviews().join(docs, "id").withColumn(
            "date",
            F.when(chars % 5 == 0, F.concat(date, F.lit("T23:30:00-05:00")))
            .when(chars % 5 == 1, F.concat(date, F.lit("T01:15:00+03:00")))
            .when(chars % 5 == 2, F.concat(F.substring(date, 1, 8), F.lit("31")))
            .when(chars % 5 == 3, F.lit("yesterday"))
            .when(chars % 15 == 4, F.concat(date, F.lit("T99:99:99")))
            .when(chars % 15 == 9, F.concat(date, F.lit("T10:00:00+23:59")))
            .otherwise(date),
        ).drop("n_chars")

    def bulk(self, lines: DataFrame | None = None) -> DataFrame:
        """The feed of 'lineitem': several rows per review key, with the columns that order them."""
        lines = self.raw("lineitem") if lines is None else lines
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        return lines.join(part, "l_partkey").selectExpr(
            "string(l_suppkey) AS org_id",
            "concat_ws('-', l_orderkey, l_linenumber) AS review_key",
            "string(date(l_shipdate)) AS date",
            "p_name AS text",
            "bigint(l_quantity) % 5 + 1.0D AS stars",
            "IF(l_returnflag <> 'R', l_returnflag, NULL) AS business_response",
            *BULK_ORDER,
        )

    @once
    def bulk_reviews(self) -> DataFrame:
        """The feed as plain reviews, one per row."""
        return self.bulk().drop(*BULK_ORDER)

    def bulk_companies(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").cast("string").alias("org_id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") >= 0, F.lit(4.0)).alias("rating"),
        )

    def current_companies(self) -> DataFrame:
        """Suppliers as companies already stored."""
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.concat(F.lit("s"), k.cast("string")).alias("org_id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") >= 0, F.lit(4.0)).alias("rating"),
            F.lit(10).alias("review_count"),
            F.when(F.col("s_nationkey") < 5, "mine").otherwise("competitor").alias("role"),
        )

    def incoming_companies(self) -> DataFrame:
        """Companies found in the feed: their keys are shifted by one, so one is new."""
        key = F.col("l_suppkey") + 1
        per = self.raw("lineitem").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c"))
        k, c = F.col("k"), F.col("c")
        return per.select(
            F.concat(F.lit("s"), k.cast("string")).alias("org_id"),
            F.when(k % 3 != 0, F.concat(F.lit("New "), k.cast("string"))).alias("name"),
            F.when(k % 4 != 0, (c % 5).cast("double")).alias("rating"),
            F.when(k % 5 != 0, c.cast("int")).alias("review_count"),
            F.when(k % 2 == 0, "mine").alias("role"),
        )

    # -- vectors and topics ------------------------------------------------------

    @once
    def vectors(self) -> DataFrame:
        docs = self.raw("documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("org_id"))
        return self.raw("embeddings").select(
            F.col("vec_id").alias("review_id"),
            F.lit("sample").alias("model"),
            F.col("embedding").alias("text_embedding"),
        ).join(docs, "review_id")

    @once
    def _labels(self) -> DataFrame:
        """Each label an org's reviews carry, with the vector of its first review."""
        docs = self.raw("documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("org_id"))
        orgs = self.companies().select("org_id", "n")
        return (
            self.raw("embeddings").join(docs, "vec_id")
            .groupBy("org_id", "label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
            .join(orgs, "org_id")
            .withColumn("grp", F.col("label") % 4)
        )

    @once
    def topics(self) -> DataFrame:
        """Two levels per org: labels under four groups, plus a group without subtopics.

        Label 9 has no vector yet.
        """
        labels = self._labels()
        leaves = labels.selectExpr(
            "n * 1000 + label AS id",
            "org_id",
            "n * 1000 + 900 + grp AS parent_id",
            "concat('Topic ', label) AS name",
            "bigint(grp * 100 + label + 1) AS position",
            "IF(label <> 9, embedding, NULL) AS embedding",
        )
        groups = labels.select("org_id", "n", "grp").distinct().unionByName(
            self.companies().select("org_id", "n", F.lit(9).alias("grp"))
        )
        heads = groups.selectExpr(
            "n * 1000 + 900 + grp AS id",
            "org_id",
            "bigint(NULL) AS parent_id",
            "concat('Group ', grp) AS name",
            "bigint(grp * 100) AS position",
            "CAST(NULL AS array<float>) AS embedding",
        )
        return heads.unionByName(leaves)

    def config(self) -> DataFrame:
        """A configuration document: companies with competitors and the labels as topics.

        The topics of one company are neither a list nor inherited.
        """
        labels = self._labels()
        groups = labels.groupBy("org_id", "grp").agg(
            F.array_sort(F.collect_list(F.concat(F.lit("Topic "), F.col("label").cast("string")))).alias("subtopics")
        )
        topic = F.struct("grp", F.concat(F.lit("Group "), F.col("grp").cast("string")).alias("name"), "subtopics")
        topics = groups.groupBy("org_id").agg(
            F.transform(
                F.array_sort(F.collect_list(topic)), lambda t: F.struct(t["name"], t["subtopics"])
            ).alias("topics")
        )
        rel = self.relations().groupBy(F.col("company_org_id").alias("org_id")).agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("competitor_org_id").alias("org_id"), "priority", "notes"))
            ).alias("competitors")
        )
        n = F.col("n")
        return (
            self.companies().drop("rating", "review_count")
            .join(topics, "org_id", "left").join(rel, "org_id", "left")
            .select(
                n.alias("pos"), "org_id", "name",
                F.when(n == 19, "owner").otherwise(F.col("role")).alias("role"),
                F.when(n % 2 == 1, F.col("service_type")).alias("service_type"),
                "competitors",
                F.when(n % 3 != 1, F.col("topics")).alias("topics"),
                ((n % 3 == 1) & (n != 16)).alias("inherit"),
                (n == 16).alias("malformed"),
            )
        )

    # -- raw page attributes --------------------------------------------------------

    def raw_reviews(self) -> DataFrame:
        html, url, page = F.col("html"), F.col("url"), F.col("page_id")
        star = lambda c: (
            F.when(c.contains("th"), "star _empty").when(c.contains("e"), "star _half").otherwise("star _full")
        )
        digits = F.regexp_extract(url, r"([0-9].*)$", 1)
        return self.raw("pages").select(
            page.alias("page_id"),
            F.concat(F.lit("p"), page.cast("string")).alias("org_id"),
            F.concat(F.lit("  "), F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit("\n\t")).alias("author_text"),
            F.concat(F.lit("width:1px;background:url('"), url, F.lit("') x")).alias("avatar_style"),
            url.alias("profile_href"),
            F.lit(None).cast("string").alias("date_content"),
            (page % 2 == 0).alias("has_rating_tag"),
            F.replace(digits, F.lit("?"), F.lit(",5")).alias("rating_content"),
            F.transform(F.regexp_extract_all(html, F.lit('href="/([^"]*)"'), 1), star).alias("star_classes"),
            F.when(page % 5 == 0, F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1)).alias("spoiler_text"),
            F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1).alias("body_text"),
            F.array(
                F.struct(F.lit("Лайк").alias("label"), digits.alias("count_text")),
                F.struct(F.lit("Дизлайк").alias("label"), F.reverse(url).alias("count_text")),
            ).alias("reactions"),
            F.regexp_extract(html, r"(?s)<footer>(.*)</footer>", 1).alias("response_text"),
        )

    def raw_companies(self) -> DataFrame:
        html, url = F.col("html"), F.col("url")
        return self.raw("pages").select(
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("org_id"),
            F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1).alias("name_text"),
            url.alias("rating_text"),
            F.regexp_extract(url, r"([0-9].*)$", 1).alias("review_count_content"),
            F.lit("   ").alias("address_text"),
            F.transform(
                F.regexp_extract_all(html, F.lit('href="/([^"]*)"'), 1),
                lambda c: F.when(c.contains("th"), " ").otherwise(F.concat(F.lit(" "), c)),
            ).alias("category_texts"),
        )
