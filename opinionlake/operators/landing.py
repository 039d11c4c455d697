"""Landing batches: known keys, identity, upsert, collection budgets, deletion.

Budgets are decided on one row per thread - how many candidates it has and how many were accepted
before it - so no task ranks the rows of a whole job.
"""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates
from opinionlake.operators import ranks
from opinionlake.session import cut_lineage

JOB = ["report_id", "source"]


# ---- keys ---------------------------------------------------------------------------------
def checkpoint_keys(items: DataFrame, keys=("report_id", "source")) -> DataFrame:
    """Distinct known keys of a job: item ids and content hashes."""
    both = F.explode(F.array_compact(F.array("id", "content_hash"))).alias("key")
    return items.select(*keys, both).distinct()


def only_new(incoming: DataFrame, known: DataFrame, keys=("source",)) -> DataFrame:
    """Rows none of whose id, hash or aliases is known. Equi joins on exploded keys, no OR join."""
    wanted = F.array_distinct(F.concat(F.array("id", "content_hash"), F.coalesce("aliases", F.array().cast("array<string>"))))
    seen = (
        incoming.select(*keys, "ordinal", F.explode(wanted).alias("key"))
        .join(known.select(*keys, "key").distinct(), [*keys, "key"], "left_semi")
        .select("ordinal")
        .distinct()
    )
    return incoming.join(seen, "ordinal", "left_anti")


def match_stored(incoming: DataFrame, stored: DataFrame, scope=("source",)) -> DataFrame:
    """``match_id``/``match_by``: stored item by id, else by content hash, else by alias."""
    scope = list(scope)
    by_id = stored.groupBy(*scope, F.col("id").alias("_key")).agg(F.min("item_key").alias("_by_id"))
    by_hash = stored.groupBy(*scope, F.col("content_hash").alias("_key")).agg(F.min("item_key").alias("_by_hash"))
    aliased = incoming.select(*scope, "ordinal", F.posexplode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("_pos", "_key"))
    by_alias = (
        aliased.join(by_id, [*scope, "_key"])
        .groupBy("ordinal")
        .agg(F.min_by("_by_id", "_pos").alias("_by_alias"))
    )
    out = (
        incoming.withColumn("_key", F.col("id"))
        .join(by_id, [*scope, "_key"], "left")
        .withColumn("_key", F.col("content_hash"))
        .join(by_hash, [*scope, "_key"], "left")
        .join(by_alias, "ordinal", "left")
        .drop("_key")
    )
    how = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_hash").isNotNull(), "hash").when(F.col("_by_alias").isNotNull(), "alias")
    return out.withColumns({"match_id": F.coalesce("_by_id", "_by_hash", "_by_alias"), "match_by": how}).drop("_by_id", "_by_hash", "_by_alias")


def resolve(incoming: DataFrame, stored: DataFrame, scope=("source",)) -> DataFrame:
    """``ordinal``, ``item_key``: the item that each row of a batch belongs to when rows are taken in ordinal order.

    A row belongs to the item that has its id, else to the one with its content hash, else to the first known alias, else to a new item.
    Known are stored items and, by id, every earlier row of the batch; by hash, of the batch only rows that made a new item. So all rows of
    one id go where its first row goes, and that row's target is fixed by minima over ids and hashes: a stored item, an earlier id of the
    batch, or a new item. Chains of earlier ids are followed by doubling, until none is left.
    """
    scope = list(scope)
    first = incoming.groupBy(*scope, "id").agg(F.min_by(F.struct("ordinal", "content_hash", "aliases"), "ordinal").alias("_f"))
    ids = first.select(*scope, "id", F.col("_f.ordinal").alias("first"), F.col("_f.content_hash").alias("content_hash"), F.col("_f.aliases").alias("aliases"))
    by_id = stored.groupBy(*scope, F.col("id").alias("_key")).agg(F.min("item_key").alias("_by_id"))
    by_hash = stored.groupBy(*scope, F.col("content_hash").alias("_key")).agg(F.min("item_key").alias("_by_hash"))
    placed = ids.withColumn("_key", F.col("id")).join(by_id, [*scope, "_key"], "left").withColumn("_key", F.col("content_hash")).join(by_hash, [*scope, "_key"], "left")
    placed = placed.withColumn("_stored", F.coalesce("_by_id", "_by_hash")).drop("_key", "_by_id", "_by_hash")
    asked = placed.filter(F.col("_stored").isNull()).select(*scope, "first", F.posexplode("aliases").alias("_pos", "_key"))
    known = by_id.unionByName(ids.select(*scope, F.col("id").alias("_key"), F.col("first").alias("_at")), allowMissingColumns=True)
    named = asked.join(known, [*scope, "_key"]).filter(F.col("_at").isNull() | (F.col("_at") < F.col("first")))
    # At one place a stored item (no _at) comes before an id of the batch, which leads to the same item.
    target = named.groupBy("first").agg(F.min_by(F.struct("_by_id", "_at"), F.struct("_pos", F.coalesce("_at", F.lit(-(1 << 62))))).alias("_alias"))
    placed = placed.join(target, "first", "left")
    makes = F.col("_stored").isNull() & F.col("_alias").isNull()
    roots = placed.groupBy(*[F.col(c).alias(f"_s_{c}") for c in scope], F.col("content_hash").alias("_h")).agg(F.min(F.when(makes, F.col("first"))).alias("_root"))
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in scope] + [F.col("content_hash").eqNullSafe(F.col("_h"))]
    placed = placed.join(roots, on, "left")
    copy = F.col("_stored").isNull() & (F.col("_root") < F.col("first")) & F.col("content_hash").isNotNull()
    parent = F.when(F.col("_stored").isNotNull(), None).when(copy, F.col("_root")).otherwise(F.col("_alias._at"))
    key = F.when(F.col("_stored").isNotNull(), F.col("_stored")).when(copy, None).when(F.col("_alias").isNotNull(), F.col("_alias._by_id")).otherwise(
        F.concat(F.lit("new"), F.col("first").cast("string"))
    )
    chain = cut_lineage(placed.select(*scope, "id", "first", parent.alias("parent"), key.alias("item_key")))
    while not chain.filter(F.col("item_key").isNull()).isEmpty():
        up = chain.select(F.col("first").alias("_n"), F.col("parent").alias("_p"), F.col("item_key").alias("_k"))
        met = chain.join(up, F.col("parent") == F.col("_n"), "left")
        chain = cut_lineage(met.select(*scope, "id", "first", F.col("_p").alias("parent"), F.coalesce("item_key", "_k").alias("item_key")))
    named = chain.select(*[F.col(c).alias(f"_s_{c}") for c in scope], F.col("id").alias("_id"), "item_key")
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in scope] + [F.col("id").eqNullSafe(F.col("_id"))]
    return incoming.join(named, on).select("ordinal", "item_key")


#: Fields of a stored item that a batch may renew; the date and its precision besides.
_RENEWED = ("title", "board", "text", "relative_date", "owner_reply", "rating", "platform_data")


def upsert(stored: DataFrame, incoming: DataFrame, scope=("source",)) -> DataFrame:
    """Merge a batch into the stored items; all columns of the stored items come back.

    Of an item found again, the renewed fields take the newest non-empty value, the date and its precision always the last row's, even null;
    all else stays. A new item has the other columns from its first row, null where the batch lacks them.
    """
    keyed = incoming.join(resolve(incoming, stored, scope), "ordinal")
    types = dict(incoming.dtypes)
    renewed = [c for c in stored.columns if c in _RENEWED and c in types]
    dated = [c for c in ("published_at", "date_precision") if c in types and c in stored.columns]
    rest = [c for c in stored.columns if c not in ("item_key", *renewed, *dated) and c in types]
    filled = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") if types[c] == "string" else F.col(c).isNotNull()
    merged = keyed.groupBy("item_key").agg(
        F.max_by(F.struct(*dated), "ordinal").alias("_date"),
        F.min_by(F.struct(*rest), "ordinal").alias("_first"),
        *[F.max_by(c, F.when(filled(c), F.col("ordinal"))).alias(f"_new_{c}") for c in renewed],
    )
    both = stored.withColumn("_old", F.lit(True)).join(merged, "item_key", "full")
    value = {c: F.coalesce(f"_new_{c}", c) for c in renewed}
    value |= {c: F.when(F.col("_date").isNotNull(), F.col(f"_date.{c}")).otherwise(F.col(c)) for c in dated}
    value |= {c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_first.{c}")) for c in rest}
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in stored.columns])


def add_membership(existing: DataFrame, observed: DataFrame, job: str = "report_id") -> DataFrame:
    """New (job, item) links, each once, with ordinals continuing after the job's maximum."""
    fresh = observed.groupBy(job, "id").agg(F.min("ordinal").alias("_seen")).join(existing.select(job, "id"), [job, "id"], "left_anti")
    highest = existing.groupBy(job).agg(F.max("ordinal").alias("_top"))
    ranked = ranks.block_rank(fresh, [job], "_seen", "_n")
    top = F.coalesce("_top", F.lit(0).cast("bigint"))
    return ranked.join(highest, job, "left").select(job, "id", (top + F.col("_n")).alias("ordinal"))


# ---- budgets ------------------------------------------------------------------------------
@dataclasses.dataclass(frozen=True)
class Budget:
    date_from: dt.date
    date_to: dt.date
    max_posts: int
    max_comments: int
    per_thread: int


def thread_plan(batch: DataFrame, budget: Budget, board_rules: bool = False) -> DataFrame:
    """One row per thread with its decision and how many of its candidates are accepted.

    ``batch`` carries ``is_new``. ``board_rules`` switches to the board variant: a thread without a
    dated post is a partial parse, and the thread cap is named before the comment cap.
    """
    post, comment = F.col("content_type") == "post", F.col("content_type") == "comment"
    day = dates.local_day(F.col("published_at"))
    inside = day.between(F.lit(budget.date_from), F.lit(budget.date_to))
    per_thread = batch.groupBy(*JOB, "thread_source_id").agg(
        F.min("ordinal").alias("first_ordinal"),
        F.count("*").alias("items"),
        F.min_by(F.struct(day.alias("day"), "is_new"), F.when(post, F.col("ordinal"))).alias("_post"),
        F.count_if(comment & F.col("is_new")).alias("_all_new"),
        F.count_if(comment & F.col("is_new") & F.coalesce(inside, F.lit(False))).alias("_dated_new"),
        F.count_if(comment & F.col("is_new") & day.isNull()).alias("_undated_new"),
        F.count_if(comment & ~F.col("is_new")).alias("stored_comments"),
        F.count_if(~F.col("is_new")).alias("duplicates"),
    )
    has_post = F.col("_post").isNotNull()
    post_day, post_new = F.col("_post.day"), F.coalesce(F.col("_post.is_new"), F.lit(False))
    in_range = post_day.between(F.lit(budget.date_from), F.lit(budget.date_to))
    if board_rules:
        early = F.when(~has_post | post_day.isNull(), "article_parse_partial").when(~in_range, "filtered")
    else:
        early = F.when(has_post & post_day.isNull(), "unknown_date").when(has_post & ~in_range, "filtered")
    plan = per_thread.withColumn("_early", early)
    wants_post = (F.col("_early").isNull() & post_new).cast("bigint")
    plan = ranks.block_sum(plan.withColumn("_wants", wants_post), JOB, "first_ordinal", F.col("_wants"), "_posts")
    over = (F.col("_wants") == 1) & (F.col("_posts") > budget.max_posts)
    plan = plan.withColumn("decision", F.coalesce("_early", F.when(over, "post_limit"), F.lit("open")))
    candidates = F.when(F.col("decision") != "open", 0).when(has_post, F.col("_all_new")).otherwise(F.col("_dated_new"))
    room = F.greatest(F.lit(budget.per_thread) - F.col("stored_comments"), F.lit(0))
    plan = plan.withColumn("candidates", candidates.cast("bigint")).withColumn("survivors", F.least("candidates", room))
    plan = ranks.block_sum(plan, JOB, "first_ordinal", F.col("survivors"), "_through")
    before = F.col("_through") - F.col("survivors")
    left = F.greatest(F.lit(budget.max_comments) - before, F.lit(0))
    if board_rules:
        hit_thread = F.col("candidates") > F.col("survivors")
        hit_comment = F.col("survivors") > left
    else:
        hit_thread = (F.col("candidates") > F.col("survivors")) & (F.col("survivors") < left)
        reached = before + F.least(F.col("candidates") - 1, F.col("survivors"))
        hit_comment = (F.col("candidates") > 0) & (reached >= budget.max_comments)
    capped = F.lit(budget.max_comments > 0)
    return plan.select(
        *JOB, "thread_source_id", "first_ordinal", "items", "decision", "candidates", "survivors",
        "stored_comments", "duplicates", has_post.alias("has_post"), before.alias("before"),
        F.least("survivors", left).alias("accepted_comments"),
        ((F.col("decision") == "open") & (F.col("_wants") == 1)).alias("accepts_post"),
        (capped & hit_thread).alias("thread_limit_hit"),
        (capped & hit_comment).alias("comment_limit_hit"),
        F.when(~has_post, F.col("_undated_new")).otherwise(0).alias("undated_comments"),
    )


def budgeted_select(batch: DataFrame, budget: Budget, board_rules: bool = False) -> DataFrame:
    """The accepted rows of a batch."""
    plan = thread_plan(batch, budget, board_rules).select(*JOB, "thread_source_id", "has_post", "accepts_post", "accepted_comments", "decision")
    day = dates.local_day(F.col("published_at"))
    inside = F.coalesce(day.between(F.lit(budget.date_from), F.lit(budget.date_to)), F.lit(False))
    rows = batch.filter("is_new").join(plan.filter("decision = 'open'"), [*JOB, "thread_source_id"])
    posts = rows.filter((F.col("content_type") == "post") & F.col("accepts_post"))
    posts = ranks.top_rows(posts, [*JOB, "thread_source_id"], [F.col("ordinal")], 1)
    comments = rows.filter((F.col("content_type") == "comment") & (F.col("has_post") | inside) & (F.col("accepted_comments") > 0))
    comments = ranks.top_rows(comments, [*JOB, "thread_source_id"], [F.col("ordinal")], max(budget.per_thread, 1), rank="_j")
    comments = comments.filter(F.col("_j") <= F.col("accepted_comments")).drop("_j")
    return posts.unionByName(comments).select(*batch.columns)


def cap_reasons(batch: DataFrame, budget: Budget, board_rules: bool = False) -> DataFrame:
    """Every candidate comment with ``accepted`` or the cap that refused it."""
    plan = thread_plan(batch, budget, board_rules)
    day = dates.local_day(F.col("published_at"))
    inside = F.coalesce(day.between(F.lit(budget.date_from), F.lit(budget.date_to)), F.lit(False))
    rows = batch.filter("is_new and content_type = 'comment'").join(
        plan.filter("decision = 'open'").select(*JOB, "thread_source_id", "has_post", "survivors", "before"), [*JOB, "thread_source_id"]
    )
    rows = rows.filter(F.col("has_post") | inside)
    rows = ranks.block_rank(rows, [*JOB, "thread_source_id"], "ordinal", "_j")
    thread_full = F.col("_j") > F.col("survivors")
    budget_gone = F.col("before") + F.least(F.col("_j") - 1, F.col("survivors")) >= budget.max_comments
    if board_rules:
        reason = F.when(thread_full, "thread_comment_limit").when(budget_gone, "comment_limit")
    else:
        reason = F.when(budget_gone, "comment_limit").when(thread_full, "thread_comment_limit")
    return rows.select(*JOB, "thread_source_id", "id", F.coalesce(reason, F.lit("accepted")).alias("outcome"))


def budget_metrics(plan: DataFrame, budget: Budget, board_rules: bool = False) -> DataFrame:
    """Counters and partial reasons per (job, source)."""
    done = plan.groupBy(*JOB).agg(
        F.count_if("accepts_post").alias("posts"),
        F.sum("accepted_comments").alias("comments"),
        F.sum(F.when(F.col("decision") == "open", F.col("duplicates")).otherwise(0)).alias("duplicate_items"),
        F.sum(F.when(F.col("decision") == "unknown_date", F.col("items")).otherwise(F.col("undated_comments"))).alias("unknown_date_items"),
        F.count_if(F.col("decision") == "filtered").alias("filtered_threads"),
        F.bool_or(F.col("decision") == "post_limit").alias("_post"),
        F.bool_or((F.col("decision") == "unknown_date") | (F.col("undated_comments") > 0)).alias("_undated"),
        F.bool_or(F.col("decision") == "article_parse_partial").alias("_parse"),
        F.bool_or("thread_limit_hit").alias("_thread"),
        F.bool_or("comment_limit_hit").alias("_comment"),
    )
    reached = (F.col("posts") >= budget.max_posts) & (F.col("comments") >= budget.max_comments)
    full = (F.col("posts") >= budget.max_posts) & ~reached
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_post") & ~F.lit(board_rules) | full, "post_limit"),
            F.when(F.col("_undated") & ~F.lit(board_rules), "unknown_date"),
            F.when(F.col("_parse"), "article_parse_partial"),
            F.when(F.col("_thread"), "thread_comment_limit"),
            F.when(F.col("_comment"), "comment_limit"),
        )
    )
    out = done.withColumns({"reached": reached, "reasons": F.array_sort(reasons)})
    return out.drop("_post", "_undated", "_parse", "_thread", "_comment")


def stop_reason(reached: Column, reasons: Column, board_rules: bool = False, network_error: Column | None = None) -> Column:
    """struct(stop_reason, complete): the first matching reason of the source's fixed order."""
    order = C.BOARD_STOP_ORDER if board_rules else C.FORUM_STOP_ORDER

    def present(reason: str) -> Column:
        hit = F.array_contains(reasons, reason)
        # A refused URL counts as a partially read public page.
        return hit | F.array_contains(reasons, "invalid_url") if reason == "public_page_partial" else hit

    found = F.coalesce(*[F.when(present(r), r) for r in order])
    fallback = F.lit("search_exhausted" if board_rules else "input_exhausted")
    ok = reached | (F.size(reasons) == 0)
    if network_error is None:
        return F.struct(F.coalesce(F.when(reached, "target_reached"), found, fallback).alias("stop_reason"), ok.alias("complete"))
    failed = F.when(network_error.isin("public_source_blocked", "public_source_unavailable"), network_error)
    return F.struct(
        F.coalesce(failed, F.when(reached, "target_reached"), found, fallback).alias("stop_reason"),
        (ok & network_error.isNull()).alias("complete"),
    )


# ---- subjects, deletion, import use -------------------------------------------------------
def upsert_subjects(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Find the subject by place URL, else by key; update non-null fields, else insert."""
    by_url = stored.filter("maps_url is not null").groupBy("maps_url").agg(F.min("subject_id").alias("_by_url"))
    by_key = stored.filter("subject_key is not null").groupBy("subject_key").agg(F.min("subject_id").alias("_by_key"))
    found = requests.join(by_url, "maps_url", "left").join(by_key, "subject_key", "left")
    target = F.coalesce("_by_url", "_by_key", F.concat(F.lit("new:"), F.coalesce("maps_url", "subject_key")))
    found = found.withColumn("subject_id", target)
    fields = ("maps_url", "subject_key", "name", "address", "average_rating", "total_review_count")
    latest = found.groupBy("subject_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("request_no"))).alias(f"_new_{c}") for c in fields]
    )
    merged = stored.join(latest, "subject_id", "full")
    keep_old = ("subject_key",)
    return merged.select(
        "subject_id",
        *[F.coalesce(c, f"_new_{c}").alias(c) if c in keep_old else F.coalesce(f"_new_{c}", c).alias(c) for c in fields],
    )


def orphans(membership: DataFrame, job: str) -> DataFrame:
    """Items that belong to ``job`` and to no other: one grouped pass instead of a self join."""
    mine = F.col("job_id") == job
    per_item = membership.groupBy("item_id").agg(F.bool_or(mine).alias("_mine"), F.bool_and(mine).alias("_only"))
    return per_item.filter("_mine and _only").select("item_id")


def delete_job(tables: dict[str, DataFrame], membership: DataFrame, job: str) -> dict[str, DataFrame]:
    """The tables without the job's own rows; items and vectors lose only the job's orphans."""
    gone = orphans(membership, job)
    out = {}
    for name, df in tables.items():
        if name in ("items", "embeddings"):
            out[name] = df.join(gone, "item_id", "left_anti")
        else:
            out[name] = df.filter(F.col("job_id") != job)
    out["membership"] = membership.filter(F.col("job_id") != job)
    return out


def import_use(requested: DataFrame, batches: DataFrame) -> DataFrame:
    """Why a request may not use its import batches: missing, invalid or already used, else ok."""
    joined = requested.join(batches, "import_id", "left")
    reason = (
        F.when(F.col("validation_status").isNull(), "missing")
        .when(F.col("validation_status") != "VALID", "invalid")
        .when(F.col("used_by").isNotNull(), "used")
        .otherwise("ok")
    )
    return joined.withColumn("reason", reason)


# ---- roll-ups -----------------------------------------------------------------------------
def kind_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(*JOB).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("content_type") == "post").alias("posts"),
        F.count_if(F.col("content_type") == "comment").alias("comments"),
    )


def thread_state(items: DataFrame) -> DataFrame:
    """Per thread: stored comments, whether its post is stored, and the post's URL.

    One row per thread instead of one list per job, so a job may have any number of threads.
    """
    thread = F.coalesce(F.expr("nullif(thread_source_id, '')"), F.col("id"))
    post = F.col("content_type") == "post"
    return items.filter(F.col("content_type").isin("post", "comment")).groupBy(*JOB, thread.alias("thread")).agg(
        F.count_if(F.col("content_type") == "comment").alias("comment_count"),
        F.bool_or(post).alias("has_post"),
        F.max(F.when(post, F.expr("nullif(source_url, '')"))).alias("thread_url"),
    )


def collection_target(config: DataFrame) -> DataFrame:
    """Target per source (review cap, or posts + comments) and per job (their sum)."""
    maps = F.col("source") == "google_maps"
    forum = F.coalesce("max_posts", F.lit(0)) + F.coalesce("max_comments", F.lit(0))
    return config.withColumn("target", F.when(maps, F.coalesce("max_reviews", F.lit(500))).otherwise(forum).cast("bigint"))


def collection_rollup(runs: DataFrame) -> DataFrame:
    """One collection record per job from its source runs (at most one per source)."""
    reason = F.when(
        F.expr("nullif(stop_reason, '') is not null") & ~F.col("complete"), F.concat_ws(":", "source", "stop_reason")
    )
    out = runs.groupBy("job_id").agg(
        F.sum("target").alias("target_count"),
        F.sum("collected").alias("actual_count"),
        F.bool_and("complete").alias("complete"),
        F.array_join(F.array_sort(F.collect_set(reason)), ";").alias("_reasons"),
        F.bool_or(F.col("status") == "BLOCKED").alias("_blocked"),
    )
    empty = F.col("actual_count") == 0
    status = F.when(empty & F.col("_blocked"), "BLOCKED").when(empty, "FAILED").otherwise("READY_FOR_ANALYSIS")
    shown = F.col("_reasons")
    stop = F.when(empty, F.when(shown == "", "no_data").otherwise(shown)).when(F.col("complete"), "all_complete").otherwise(shown)
    return out.select(
        "job_id", "target_count", "actual_count", (F.col("complete") & ~empty).alias("complete"), status.alias("status"), stop.alias("stop_reason")
    )


def run_usage(runs: DataFrame, price_in: float | None, price_out: float | None) -> DataFrame:
    """Tokens, time and reuse per plan; cost is null when a price is unknown."""
    out = runs.groupBy("plan_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.bool_or(F.col("attempts") > 1).alias("reused"),
    )
    if price_in is None or price_out is None:
        return out.withColumn("cost", F.lit(None).cast("double"))
    return out.withColumn("cost", (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)
