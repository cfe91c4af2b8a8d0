"""Keyed ingestion: upserts, inserts, removals and replacements of the model's tables.

Every function maps current rows plus incoming rows to the new rows; storing
them is left to the caller. Incoming rows are reduced per key first (partial
aggregation absorbs a hot key before the shuffle). Reduced rows lie by key, so
joining them to the current table moves only the table's rows, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold import schemas
from starfold.functions import text as tx

#: Columns a repeated review overwrites. All others keep their first value.
MUTABLE = ("text", "stars", "likes", "dislikes", "business_response", "updated_at")
REVIEW_KEY = "review_key"


def with_review_key(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn(
        REVIEW_KEY,
        tx.review_key(*[F.col(c) for c in ("org_id", "review_url", "author_name", "date", "text")]),
    )


def reduce_batch(batch: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row per review key: first value of the fixed columns, last value of the mutable ones.

    ``order_by`` must order the rows of a key totally. ``n`` is the number of
    rows the batch held for the key.
    """
    known = {f.name for f in schemas.REVIEWS}
    helpers = {REVIEW_KEY, *(c for c in order_by if c not in known)}
    fixed = [c for c in batch.columns if c not in MUTABLE and c not in helpers]
    moving = [c for c in batch.columns if c in MUTABLE and c not in helpers]
    order = F.struct(*order_by)
    return (
        batch.groupBy(REVIEW_KEY)
        .agg(
            F.min_by(F.struct(*fixed), order).alias("first"),
            F.max_by(F.struct(*moving), order).alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(REVIEW_KEY, "first.*", "last.*", "n")
    )


def _moving(current: DataFrame, reduced: DataFrame) -> list[str]:
    have = set(reduced.columns)
    return [c for c in current.columns if c in MUTABLE and c in have]


def merge_reduced(current: DataFrame, reduced: DataFrame, changes: bool = False) -> DataFrame:
    """Current reviews with a reduced batch merged in, by one join that reads each side once.

    With ``changes`` the rows carry ``change`` (``schemas.CHANGE``), from which counts and partial sums follow
    without another join; ``current`` are stored reviews then.
    """
    have, moving = set(reduced.columns), set(_moving(current, reduced))
    hit = F.col("inc._hit")

    def pick(c: str) -> Column:
        if c == REVIEW_KEY:
            return F.col(c)
        if c in moving:
            return F.when(hit, F.col(f"inc.{c}")).otherwise(F.col(f"cur.{c}")).alias(c)
        if c in have:
            return F.when(F.col("cur._old"), F.col(f"cur.{c}")).otherwise(F.col(f"inc.{c}")).alias(c)
        return F.col(f"cur.{c}").alias(c)

    change = []
    if changes:
        known = F.coalesce("cur._old", F.lit(False))
        moved = known & ~F.col("inc.org_id").eqNullSafe(F.col("cur.org_id"))
        seen = F.struct(
            F.col("inc.n").alias("rows"),
            F.when(moved, F.col("inc.org_id")).alias("org_id"),
            known.alias("known"),
            F.col("cur.stars").alias("stars"),
            F.when(known, F.col("cur.business_response").isNotNull()).alias("responded"),
            F.col("cur.has_text").alias("has_text"),
        )
        change = [F.when(hit, seen).cast(schemas.CHANGE).alias("change")]
    return (
        current.withColumn("_old", F.lit(True)).alias("cur")
        .join(reduced.withColumn("_hit", F.lit(True)).alias("inc"), REVIEW_KEY, "full")
        .select(*[pick(c) for c in current.columns], *change)
    )


def upsert_reviews(current: DataFrame, batch: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Current reviews with a batch merged in by review key."""
    return merge_reduced(current, reduce_batch(batch, order_by))


def _counts(joined: DataFrame, by: Sequence[str]) -> DataFrame:
    added = F.when(F.col("_known").isNull(), 1).otherwise(0)
    totals = (
        F.coalesce(F.sum(added), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum(F.col("n") - added), F.lit(0)).cast("bigint").alias("updated"),
    )
    return joined.groupBy(*by).agg(*totals) if by else joined.agg(*totals)


def counts_of_changes(changed: DataFrame) -> DataFrame:
    """Rows that a merged batch added and updated, per org it named: the first row of an unknown key adds, all others update."""
    org = F.coalesce("change.org_id", "org_id").alias("org_id")
    return _counts(changed.select(org, F.col("change.rows").alias("n"), F.when(F.col("change.known"), 1).alias("_known")), ["org_id"])


def upsert_counts(current: DataFrame, batch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a raw batch; ``by`` may name columns that are fixed per key, such as the org."""
    reduced = batch.groupBy(*by, REVIEW_KEY).agg(F.count(F.lit(1)).alias("n"))
    known = current.select(REVIEW_KEY, F.lit(1).alias("_known"))
    return _counts(reduced.join(known, REVIEW_KEY, "left"), by)


def upsert_companies(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known fields survive a NULL in the incoming row; the role is always overwritten.

    ``incoming`` holds one row per ``org_id``; an absent or NULL role means the default.
    """
    have = set(incoming.columns)
    role = F.col("role") if "role" in have else F.lit(None).cast("string")
    incoming = incoming.withColumn("role", F.coalesce(role, F.lit(schemas.DEFAULT_ROLE)))
    have.add("role")

    def merged(c: str) -> Column:
        if c == "org_id":
            return F.col("org_id")
        if c not in have:
            return F.col(f"cur.{c}").alias(c)
        if c == "created_at":
            return F.coalesce(F.col("cur.created_at"), F.col("inc.created_at")).alias(c)
        return F.coalesce(F.col(f"inc.{c}"), F.col(f"cur.{c}")).alias(c)

    return (
        current.alias("cur")
        .join(incoming.alias("inc"), "org_id", "full")
        .select(*[merged(c) for c in current.columns])
    )


def sync_companies(current: DataFrame, found: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Merge what a sync found out about tracked companies; their roles stay as they are.

    The last value found for a field counts, as if the rows had been merged one
    by one; orgs that are not tracked are left out.
    """
    fields = [c for c in found.columns if c != "org_id" and c not in order_by and c in current.columns]
    order = F.struct(*order_by)
    last = found.groupBy("org_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]
    )
    return upsert_companies(current, last.join(current.select("org_id", "role"), "org_id"))


RELATION_KEY = ("company_org_id", "competitor_org_id")


def _tracked_pairs(pairs: DataFrame, companies: DataFrame) -> DataFrame:
    known = companies.select("org_id").distinct()
    for side in RELATION_KEY:
        pairs = pairs.join(known.withColumnRenamed("org_id", side), side, "left_semi")
    return pairs


def rejected_relations(pairs: DataFrame, companies: DataFrame) -> DataFrame:
    """Pairs that name an org nobody tracks, once each."""
    keys = list(RELATION_KEY)
    wanted = pairs.select(*keys).distinct()
    return wanted.join(_tracked_pairs(wanted, companies), keys, "left_anti")


def add_relations(current: DataFrame, pairs: DataFrame, companies: DataFrame) -> DataFrame:
    """Insert pairs of tracked companies that are not related yet; see ``rejected_relations`` for the others."""
    fresh = (
        _tracked_pairs(pairs.dropDuplicates(list(RELATION_KEY)), companies)
        .join(current.select(*RELATION_KEY), list(RELATION_KEY), "left_anti")
        .select(*RELATION_KEY)
    )
    if "created_at" in current.columns:
        fresh = fresh.withColumn("created_at", F.current_timestamp())
    return current.unionByName(fresh, allowMissingColumns=True)


def upsert_relations(current: DataFrame, incoming: DataFrame, companies: DataFrame) -> DataFrame:
    """Priority and notes of an existing pair are overwritten, also by NULL; its creation time stays."""
    incoming = _tracked_pairs(incoming, companies).select(
        *RELATION_KEY, "priority", "notes", F.lit(True).alias("hit")
    )
    keys = list(RELATION_KEY)
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in ("priority", "notes"):
            out.append(F.when(F.col("inc.hit"), F.col(f"inc.{c}")).otherwise(F.col(f"cur.{c}")).alias(c))
        elif c == "created_at":
            fresh = F.when(F.col("cur.old").isNull(), F.current_timestamp())
            out.append(F.coalesce(F.col("cur.created_at"), fresh).alias(c))
        else:
            out.append(F.col(f"cur.{c}").alias(c))
    known = current.withColumn("old", F.lit(True))
    return known.alias("cur").join(incoming.alias("inc"), keys, "full").select(*out)


def remove_relations(current: DataFrame, pairs: DataFrame) -> DataFrame:
    return current.join(pairs.select(*RELATION_KEY), list(RELATION_KEY), "left_anti")


def remove_orgs(tables: dict[str, DataFrame], orgs: DataFrame) -> dict[str, DataFrame]:
    """Drop orgs and everything that hangs on them, in every table given.

    Embeddings and assignments go with their reviews; assignments also go with
    their topics; relations go when either side goes.
    """
    gone = orgs.select("org_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "company_relations":
            for side in RELATION_KEY:
                df = df.join(gone.withColumnRenamed("org_id", side), side, "left_anti")
        elif "org_id" in df.columns:
            df = df.join(gone, "org_id", "left_anti")
        out[name] = df
    if "reviews" in tables:
        lost = tables["reviews"].join(gone, "org_id", "left_semi").select(F.col("id").alias("review_id"))
        for name in ("review_embeddings", "review_topics"):
            if name in out:
                out[name] = out[name].join(lost, "review_id", "left_anti")
    if "topic_templates" in tables and "review_topics" in out:
        lost = tables["topic_templates"].join(gone, "org_id", "left_semi").select(F.col("id").alias("topic_id"))
        out["review_topics"] = out["review_topics"].join(lost, "topic_id", "left_anti")
    return out


def append_sync(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Log rows are only ever added; ``seq`` orders them."""
    return log.unionByName(schemas.conform(entries, log.schema))


def replace_topics(current: DataFrame, incoming: DataFrame, listed: DataFrame) -> DataFrame:
    """Replace all topics of the listed orgs; an org listed without topics loses its own.

    Ids depend on org and names alone, so a topic that stays keeps its vector.
    """
    orgs = listed.select("org_id").distinct()
    vectors = current.select("id", F.col("embedding").alias("_kept"))
    fresh = incoming.join(vectors, "id", "left").withColumn("embedding", F.col("_kept")).drop("_kept")
    return current.join(orgs, "org_id", "left_anti").unionByName(
        schemas.conform(fresh, current.schema)
    )


def latest_by(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows win over current rows with the same key; ``incoming`` is unique by key.

    NULL keys compare equal (the overall score row has no topic).
    """
    def same(c: str) -> Column:
        return F.col(f"cur.{c}").eqNullSafe(F.col(f"inc.{c}"))

    condition = same(keys[0])
    for c in keys[1:]:
        condition = condition & same(c)
    stays = current.alias("cur").join(incoming.select(*keys).alias("inc"), condition, "left_anti")
    return stays.unionByName(incoming.select(*current.columns))


def save_vectors(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Review vectors by review id, the new one winning."""
    return latest_by(current, schemas.conform(incoming, current.schema), ["review_id"])


def save_topic_vectors(topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """Set the vector of the topics named in ``vectors(id, embedding)``."""
    new = vectors.select("id", F.col("embedding").alias("_new"), F.lit(True).alias("_hit"))
    return (
        topics.join(new, "id", "left")
        .withColumn("embedding", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("embedding")))
        .select(*topics.columns)
    )


def replace_assignments(
    current: DataFrame, incoming: DataFrame, reviews: DataFrame, orgs: DataFrame
) -> DataFrame:
    """Replace the assignments of all reviews of the given orgs."""
    covered = reviews.join(orgs.select("org_id").distinct(), "org_id", "left_semi")
    stays = current.join(covered.select(F.col("id").alias("review_id")), "review_id", "left_anti")
    return stays.unionByName(incoming.select(*current.columns))


def upsert_scores(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return latest_by(current, schemas.conform(incoming, current.schema), ["org_id", "topic_id"])


def sync_mode(companies: DataFrame, log: DataFrame, force_full: bool = False) -> DataFrame:
    """``incremental`` for an org that has had a successful sync, else ``full``."""
    done = log.filter(F.col("status") == "ok").groupBy("org_id").agg(F.lit(True).alias("done"))
    mode = F.when(F.col("done") & F.lit(not force_full), "incremental").otherwise("full")
    return companies.join(done, "org_id", "left").select("org_id", mode.alias("sync_type"))


def last_sync(log: DataFrame) -> DataFrame:
    """The newest log row of every org."""
    rest = [c for c in log.columns if c not in ("org_id", "seq")]
    return (
        log.groupBy("org_id")
        .agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), F.col("seq")).alias("row"))
        .select("org_id", "seq", "row.*")
    )
