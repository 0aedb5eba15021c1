"""Scores of crawls: penalties with diminishing returns, bonuses, weights and caps; all runs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from . import topk

CATEGORIES = list(config.WEIGHTS)


def category_map(spark) -> DataFrame:
    """issue_type, category, multiplier: a fixed table of 44 rows."""
    rows = [(t, c, m) for c, types in config.CATEGORY.items() for t, m in types.items()]
    return spark.createDataFrame(rows, "issue_type string, category string, multiplier double")


def occurrence_multiplier(n) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    out = F
    for most, m in config.TIERS:
        out = out.when(c <= most, m)
    return out.otherwise(config.TIER_REST)


def base_penalty(severity="severity") -> Column:
    return F.coalesce(*(F.when(F.col(severity) == s, v) for s, v in config.BASE_PENALTY.items()))


def penalties(issues: DataFrame, run: str = "run", collation: bool = True) -> DataFrame:
    """run, category, issue_type, severity (of the first occurrence), occurrences, penalty.

    Occurrences of a type are ranked by URL (as a reader sorts them), then order
    of issue. All beyond the last tier weigh alike: the first of each type pass
    and the others are counted by severity, in one reading of the issues. Types
    without a category give nothing.
    """
    rows = issues.select(run, "issue_type", "severity", "url", "ord")
    url = F.expr("collate(url, 'UNICODE')") if collation else F.col("url")
    d = topk.bounded(rows, [run, "issue_type"], [url, "ord"], config.TIERS[-1][0], ["severity"])
    d = d.join(F.broadcast(category_map(issues.sparkSession)), "issue_type")
    lost = base_penalty() * F.col("multiplier") * F.col("_n") * occurrence_multiplier("rank")
    return d.groupBy(run, "category", "issue_type").agg(F.min_by("severity", "rank").alias("severity"), F.sum("_n").alias("occurrences"), F.sum(lost).alias("penalty"))


def signals(pages: DataFrame, issues: DataFrame, run: str = "run") -> DataFrame:
    """run and one boolean for each positive signal, and what the caps ask. Pages need ord, page_type, final_url, outcome, status, indexing_state, images_missing_alt, has_viewport, lang, n_broken; issues need ord of their page as page_ord."""
    i = issues.groupBy(run).agg(
        F.count_if(F.col("issue_type").isin("missing_canonical", "canonical_external_domain")).alias("n_canonical"),
        F.count_if(F.col("issue_type") == "indexable_page_missing_from_sitemap").alias("n_missing"), F.count_if(F.col("issue_type") == "orphaned_sitemap_page").alias("n_orphaned"),
        F.count_if(F.col("issue_type") == "missing_podcast_episode_schema").alias("n_schema"), F.count_if(F.col("severity") == "critical").alias("n_critical"),
    )
    home = F.col("page_type") == "homepage"
    p = pages.groupBy(run).agg(
        F.count("*").alias("n"), F.min_by(F.struct("final_url", "status", "indexing_state"), F.when(home, F.col("ord"))).alias("home"), F.count_if(home).alias("n_home"),
        F.count_if(F.col("indexing_state") == "noindex_unexpected").alias("n_unexpected"), F.count_if(F.col("n_broken") > 0).alias("n_broken"),
        F.count_if(F.col("page_type") == "episode").alias("n_episode"), F.count_if(F.col("images_missing_alt") > 0).alias("n_alt"),
        F.count_if(~F.col("has_viewport")).alias("n_viewport"), F.count_if(F.coalesce("lang", F.lit("")) == "").alias("n_lang"), F.count_if(F.col("outcome") != "ok").alias("n_failed"),
    )
    d = p.join(i, run, "left").fillna(0, ["n_canonical", "n_missing", "n_orphaned", "n_schema", "n_critical"])
    has_home = F.col("n_home") > 0
    some = F.col("n") > 0
    no = lambda c: F.col(c) == 0
    false = lambda c: F.coalesce(c, F.lit(False))
    return d.select(
        run, false(has_home & F.startswith("home.final_url", F.lit("https://"))).alias("https_enabled"), no("n_canonical").alias("valid_canonicals"), no("n_unexpected").alias("no_unexpected_noindex"),
        (no("n_missing") & no("n_orphaned")).alias("valid_sitemap_coverage"), no("n_broken").alias("no_broken_links"), ((F.col("n_episode") > 0) & no("n_schema")).alias("structured_data_present"),
        (some & no("n_alt")).alias("all_images_have_alt_text"), (some & no("n_viewport")).alias("valid_viewport"), (some & no("n_lang")).alias("valid_lang_tag"),
        (F.col("n_critical") > 0).alias("any_critical_issue"), false(has_home & (F.col("home.status") >= 500)).alias("homepage_5xx"),
        false(has_home & (F.col("home.indexing_state") == "noindex_unexpected")).alias("homepage_unexpected_noindex"),
        F.when(some, F.col("n_failed") / F.col("n") >= config.UNCRAWLABLE).otherwise(True).alias("site_uncrawlable"),
    )


# --- fixed values: signal, category, bonus
SIGNALS = [
    ("https_enabled", "technical", 2), ("valid_canonicals", "onPage", 2), ("no_unexpected_noindex", "indexing", 3), ("valid_sitemap_coverage", "indexing", 2), ("no_broken_links", "internalLinks", 3),
    ("structured_data_present", "content", 2), ("all_images_have_alt_text", "onPage", 2), ("valid_viewport", "technical", 1), ("valid_lang_tag", "onPage", 1),
]


def score_label(score) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    out = F
    for least, name in config.LABELS:
        out = out.when(c >= least, name)
    return out.otherwise(config.LABEL_REST)


def capped(raw: Column) -> Column:
    """(score, name) after the caps whose flags are set; the name is null unless one lowers the score."""
    caps = F.array(*(F.when(F.col(name) & (F.lit(float(most)) < raw), F.struct(F.lit(float(most)).alias("score"), F.lit(name).alias("name"))) for name, most in config.CAPS))
    return F.coalesce(F.array_min(F.filter(caps, lambda x: x.isNotNull())), F.struct(raw.alias("score"), F.lit(None).cast("string").alias("name")))


def scores(pages: DataFrame, issues: DataFrame, run: str = "run") -> DataFrame:
    """run, one score a category, raw, overall_score, cap_applied, label. Runs without pages have no row here; see `empty_score`."""
    by_type = penalties(issues, run)
    lost = by_type.groupBy(run).agg(*(F.sum(F.when(F.col("category") == c, F.col("penalty")).otherwise(0.0)).alias(f"lost_{c}") for c in CATEGORIES))
    d = signals(pages, issues, run).join(lost, run, "left").fillna(0.0, [f"lost_{c}" for c in CATEGORIES])
    return finished(d)


def finished(d: DataFrame) -> DataFrame:
    parts = {}
    for c in CATEGORIES:
        bonus = sum((F.when(F.col(s), float(b)).otherwise(0.0) for s, k, b in SIGNALS if k == c), F.lit(0.0))
        parts[f"score_{c}"] = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col(f"lost_{c}") + F.least(bonus, F.lit(float(config.MOST_BONUS)))))
    d = d.withColumns(parts)
    d = d.withColumn("raw", sum((F.col(f"score_{c}") * w for c, w in config.WEIGHTS.items()), F.lit(0.0)))
    d = d.withColumn("cap", capped(F.col("raw"))).withColumn("overall_score", F.floor(F.col("cap.score") + 0.5).cast("int")).withColumn("cap_applied", F.col("cap.name"))
    return d.withColumn("label", score_label("overall_score")).drop("cap", *(f"lost_{c}" for c in CATEGORIES))


def empty_score(spark) -> DataFrame:
    """The score of a crawl without pages."""
    always = {"valid_canonicals", "no_unexpected_noindex", "valid_sitemap_coverage", "no_broken_links"}
    flags = [F.lit(s in always).alias(s) for s, _, _ in SIGNALS] + [F.lit(n == "site_uncrawlable").alias(n) for n, _ in config.CAPS]
    return finished(spark.range(1).select(*flags, *(F.lit(0.0).alias(f"lost_{c}") for c in CATEGORIES)))


def with_delta(snapshots: DataFrame) -> DataFrame:
    """Snapshots (site_id, run_id, started_at, overall_score) with the change since the site's run before."""
    before = F.lag("overall_score").over(Window.partitionBy("site_id").orderBy("started_at", "run_id"))
    return snapshots.withColumn("score_delta", F.col("overall_score") - before)


def backfill(runs: DataFrame, snapshots: DataFrame, force: bool = False) -> DataFrame:
    """Successful runs that still need a score (all of them with `force`)."""
    todo = runs.filter("status = 'success'")
    return todo if force else todo.join(snapshots.select(F.col("run_id").alias("id")), "id", "left_anti")


def inferred_outcome(status="status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.isNull(), "network_error").when(s.between(200, 399), "ok").otherwise("http_error")
