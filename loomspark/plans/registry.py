"""Queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.functions import scalars as X
from loomspark.functions import text as S
from loomspark.functions.permute import permuted_sql
from loomspark.operators import agreement, corpus, judge, matching, metrics, progressive, ratings, scoring, split, tagging, training, upkeep
from loomspark.plans import tables as t
from loomspark.sources import jsonl, runlog, versions

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
WEIGHTS = {"f0": 2, "f1": 4, "f2": 3}
ACCURATE = "count(*) AS n, count(*) FILTER (p = y) AS hits, count(*) FILTER (y) AS n_positive, count(*) FILTER (p = y AND y) AS hits_positive, count(*) FILTER (NOT y) AS n_negative, count(*) FILTER (p = y AND NOT y) AS hits_negative"


def query(sql: str | None = None):
    """Register a query; its SQL may use the tables of ``tables.WITH``."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = t.WITH + sql
        return f

    return add


@query("SELECT row_id, digest, token_count FROM corpus")
def normalize_digest(spark, sf):
    return t.corpus(spark, sf).select("row_id", "digest", "token_count")


@query(f"SELECT row_id, token_count FROM corpus WHERE token_count BETWEEN {t.LOW} AND {t.HIGH}")
def token_range_filter(spark, sf):
    return t.corpus(spark, sf).where(F.col("token_count").between(t.LOW, t.HIGH)).select("row_id", "token_count")


@query(f"SELECT row_id, length({t._norm('text')}) AS chars FROM corpus WHERE length({t._norm('text')}) <= 8192")
def char_limit_filter(spark, sf):
    n = F.length(S.normalize(F.col("text"))).cast("long")
    return t.corpus(spark, sf).select("row_id", n.alias("chars")).where("chars <= 8192")


@query("SELECT min(row_id) AS row_id, digest FROM corpus GROUP BY digest")
def exact_dedup_first(spark, sf):
    return corpus.first_of_each(t.corpus(spark, sf).select("row_id", "digest"), "digest")


@query("SELECT row_id, digest FROM corpus WHERE digest NOT IN (SELECT digest FROM exclusions)")
def exclusion_anti_join(spark, sf):
    return corpus.exclude(t.corpus(spark, sf).select("row_id", "digest"), t.exclusions(spark, sf))


@query("SELECT count(*) AS documents, sum(token_count)::BIGINT AS tokens, count(*) FILTER (b) AS excluded_documents, coalesce(sum(token_count) FILTER (b), 0)::BIGINT AS excluded_tokens FROM (SELECT *, digest IN (SELECT digest FROM exclusions) AS b FROM corpus)")
def exclusion_audit(spark, sf):
    return corpus.audit(t.keys(spark, sf), t.exclusions(spark, sf))


@query(f"SELECT row_id, token_count, digest FROM eligible WHERE cum - token_count < {t.TARGET}")
def token_budget_prefix(spark, sf):
    return corpus.build(t.keys(spark, sf), t.exclusions(spark, sf), t.LOW, t.HIGH, t.TARGET).select("row_id", "token_count", "digest")


@query(f"SELECT row_id, token_count, digest FROM eligible WHERE cum - token_count < {2 * t.TARGET}")
def resumed_budget(spark, sf):
    """A build that stopped at half its budget, carried on, is the build in one go."""
    pool, banned = t.keys(spark, sf), t.exclusions(spark, sf)
    part = corpus.build(pool, banned, t.LOW, t.HIGH, t.TARGET)
    return corpus.build(pool, banned, t.LOW, t.HIGH, 2 * t.TARGET, kept=part).select("row_id", "token_count", "digest")


@query("SELECT row_id, digest FROM (SELECT min(row_id) AS row_id, digest FROM corpus GROUP BY digest) ORDER BY row_id LIMIT 500")
def count_limited_corpus(spark, sf):
    return corpus.count_prefix(corpus.first_of_each(t.keys(spark, sf).select("row_id", "digest"), "digest"), 500)


@query(f"""SELECT reason, count(*) AS documents, sum(token_count)::BIGINT AS tokens FROM (SELECT token_count, CASE WHEN token_count < {t.LOW} THEN 'short' WHEN token_count > {t.HIGH} THEN 'long' WHEN b THEN 'excluded'
  WHEN row_number() OVER (PARTITION BY digest, token_count BETWEEN {t.LOW} AND {t.HIGH} AND NOT b ORDER BY row_id) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM (SELECT *, digest IN (SELECT digest FROM exclusions) AS b FROM corpus)) GROUP BY reason""")
def rejection_report(spark, sf):
    x = corpus.reasons(t.keys(spark, sf), t.exclusions(spark, sf), t.LOW, t.HIGH)
    return x.groupBy("reason").agg(F.count("*").alias("documents"), F.sum("token_count").alias("tokens"))


@query(f"""SELECT reason, count(*) AS documents, sum(token_count)::BIGINT AS tokens FROM (SELECT *, sum(k) OVER (ORDER BY row_id) AS cum FROM (SELECT *, CASE WHEN reason = 'kept' THEN token_count ELSE 0 END AS k FROM (
  SELECT row_id, token_count, CASE WHEN token_count < {t.LOW} THEN 'short' WHEN token_count > {t.HIGH} THEN 'long' WHEN b THEN 'excluded'
  WHEN row_number() OVER (PARTITION BY digest, token_count BETWEEN {t.LOW} AND {t.HIGH} AND NOT b ORDER BY row_id) > 1 THEN 'duplicate' ELSE 'kept' END AS reason
  FROM (SELECT *, digest IN (SELECT digest FROM exclusions) AS b FROM corpus)))) WHERE cum - k < {t.TARGET} GROUP BY reason""")
def rejections_until_target(spark, sf):
    return corpus.rejections(t.keys(spark, sf), t.exclusions(spark, sf), t.LOW, t.HIGH, t.TARGET)


@query("SELECT count(*) AS documents, sum(token_count)::BIGINT AS tokens, count(*) - count(DISTINCT digest) AS duplicates FROM corpus")
def existing_summary(spark, sf):
    return corpus.summary(t.keys(spark, sf))


@query("SELECT row_id FROM corpus WHERE row_id % 50 = 7")
def misaligned_rows(spark, sf):
    """An output in which every fiftieth text has changed, against its input."""
    source = t.corpus(spark, sf).select("row_id", "text")
    changed = F.when(F.col("row_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return corpus.misaligned(source.withColumn("text", changed), source)


@query("SELECT file, count(*) AS texts, count(DISTINCT digest) AS digests FROM exclusions GROUP BY file")
def multi_exclusion_union(spark, sf):
    return t.exclusions(spark, sf).groupBy("file").agg(F.count("*").alias("texts"), F.countDistinct("digest").alias("digests"))


@query("SELECT row_id, filter, model, rating::DOUBLE AS rating FROM ratings")
def rated_long_form(spark, sf):
    """Nested ratings as JSON text, read back to long form."""
    long = t.ratings(spark, sf)
    entry = F.struct("model", "rating", F.lit("why").alias("explanation"), F.lit("").alias("quote"))
    nested = long.groupBy("row_id", "filter").agg(F.collect_list(entry).alias("l")).groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("filter", "l"))).alias("ratings"))
    rows = nested.select("row_id", F.parse_json(F.to_json(F.struct("ratings"))).alias("value"))
    return ratings.explode_ratings(rows, X.rating_for_rater).select("row_id", "filter", "model", "rating")


VARIANTS = ["7", "7.0", "7.5", "-1", "11", "true", '"7"', "null"]


@query(f"SELECT row_id, row_id % {len(VARIANTS)} = 0 AS rater, row_id % {len(VARIANTS)} < 3 AS training FROM corpus")
def rating_validity_variants(spark, sf):
    """Which entries the rater and the trainer take, for eight kinds of rating."""
    kind = F.get(F.array(*map(F.lit, VARIANTS)), (F.col("row_id") % len(VARIANTS)).cast("int"))
    entry = F.parse_json(F.concat(F.lit('{"model":"m","explanation":"","quote":"","rating":'), kind, F.lit("}")))
    return t.corpus(spark, sf).select("row_id", X.rating_for_rater(entry).alias("rater"), X.rating_for_training(entry).alias("training"))


@query("SELECT filter, count(DISTINCT row_id) AS rated, (SELECT count(*) FROM corpus) AS documents FROM ratings GROUP BY filter")
def rated_status(spark, sf):
    return agreement.status(t.corpus(spark, sf), t.ratings(spark, sf))


@query("SELECT d.row_id, l.filter, l.model FROM corpus d CROSS JOIN layout l ANTI JOIN ratings USING (row_id, filter, model)")
def pending_pairs(spark, sf):
    return ratings.pending(t.corpus(spark, sf), t.layout(spark), t.ratings(spark, sf))


@query("SELECT count(*) FILTER (m > 0) AS missing_documents, count(*) AS documents, sum(m)::BIGINT AS missing_ratings, sum(n)::BIGINT AS ratings FROM (SELECT row_id, count(*) AS n, count(*) FILTER (rating IS NULL) AS m FROM corpus CROSS JOIN layout LEFT JOIN ratings USING (row_id, filter, model) GROUP BY row_id)")
def missing_stats(spark, sf):
    return ratings.missing_stats(t.corpus(spark, sf), t.layout(spark), t.ratings(spark, sf))


@query("SELECT row_id, filter, model, coalesce(rating, 5)::BIGINT AS rating FROM corpus CROSS JOIN layout LEFT JOIN ratings USING (row_id, filter, model)")
def merge_missing_only(spark, sf):
    new = t.corpus(spark, sf).select("row_id").crossJoin(F.broadcast(t.layout(spark).select("filter", "model"))).withColumn("rating", F.lit(5).cast("long"))
    return ratings.merge_missing(t.ratings(spark, sf), new)


LAST_MATCHED = """(SELECT ann_id, coalesce(e, s) AS row_id FROM hand LEFT JOIN (SELECT text, max(row_id) AS e FROM corpus GROUP BY text) x USING (text)
  LEFT JOIN (SELECT left(text, 200) AS p, min(row_id) AS s FROM corpus GROUP BY 1) y ON y.p = left(hand.text, 200))"""


@query(f"""SELECT (SELECT count(row_id) FROM {LAST_MATCHED}) AS matched_rows, sum(a)::BIGINT AS added_ratings, sum(n - a)::BIGINT AS collisions FROM (
  SELECT row_id, l.filter, l.model, count(*) AS n, (max(r.rating) IS NULL)::BIGINT AS a FROM {LAST_MATCHED} m CROSS JOIN layout l LEFT JOIN ratings r USING (row_id, filter, model) GROUP BY ALL)""")
def overlay_merge_stats(spark, sf):
    """An overlay of every rating on the last row of each hand text."""
    found = matching.match(t.hand(spark, sf), t.corpus(spark, sf), exact_last=True).select("ann_id", "row_id")
    overlay = t.hand(spark, sf).select("ann_id").crossJoin(F.broadcast(t.layout(spark).select("filter", "model")))
    return ratings.overlay_stats(t.ratings(spark, sf), overlay, found)


@query("SELECT row_id, CASE WHEN count(r.rating) = 9 THEN string_agg((r.rating * 100)::BIGINT::VARCHAR, ',' ORDER BY idx) END AS targets FROM corpus CROSS JOIN layout LEFT JOIN ratings r USING (row_id, filter, model) GROUP BY row_id")
def target_vector(spark, sf):
    """Targets as whole thousandths, joined in layout order."""
    x = ratings.targets(t.corpus(spark, sf), t.layout(spark), t.ratings(spark, sf))
    return x.select("row_id", F.when(F.col("targets").isNotNull(), F.array_join(F.transform("targets", lambda v: F.round(v * 1000).cast("long")), ",")).alias("targets"))


@query("SELECT count(*) FILTER (n < 9) AS incomplete, count(*) AS documents FROM (SELECT row_id, count(r.rating) AS n FROM corpus LEFT JOIN ratings r USING (row_id) GROUP BY row_id)")
def incomplete_rows(spark, sf):
    x = ratings.targets(t.corpus(spark, sf), t.layout(spark), t.ratings(spark, sf))
    return x.agg(F.count_if(F.col("targets").isNull()).alias("incomplete"), F.count("*").alias("documents"))


@query("SELECT ann_id, row_id, how FROM matched")
def exact_prefix_match(spark, sf):
    return matching.match(t.hand(spark, sf), t.corpus(spark, sf))


@query("SELECT row_id, count(*) AS annotations FROM matched GROUP BY row_id HAVING count(*) > 1")
def match_uniqueness_violations(spark, sf):
    return matching.clashes(matching.match(t.hand(spark, sf), t.corpus(spark, sf)))


@query("SELECT row_id FROM corpus WHERE row_id NOT IN (SELECT row_id FROM matched)")
def overlap_exclusion(spark, sf):
    """Rows left for training when the first match of each hand text goes."""
    found = matching.match(t.hand(spark, sf), t.corpus(spark, sf)).where("row_id is not null")
    return t.corpus(spark, sf).select("row_id").join(found.select("row_id").distinct(), "row_id", "left_anti")


@query("SELECT row_id FROM corpus WHERE left(text, 200) IN (SELECT left(text, 200) FROM hand)")
def overlap_all_matches(spark, sf):
    return matching.all_matches(t.hand(spark, sf), t.corpus(spark, sf))


@query("SELECT row_id FROM corpus ORDER BY sha256('7:' || row_id) LIMIT (SELECT greatest(1, round_even(count(*) * 0.05, 0))::BIGINT FROM corpus)")
def hash_validation_split(spark, sf):
    return split.hash_sample(t.corpus(spark, sf).select("row_id"), 0.05, 7)


UPSAMPLED = "SELECT row_id, coalesce(max(w), 1)::BIGINT AS weight FROM (SELECT row_id, CASE WHEN sum(rating) >= 2 * count(*) THEN CASE filter WHEN 'f0' THEN 2 WHEN 'f1' THEN 4 ELSE 3 END END AS w FROM ratings GROUP BY row_id, filter) GROUP BY row_id"


@query(UPSAMPLED)
def upsample_weights(spark, sf):
    return split.upsample_weights(t.ratings(spark, sf), WEIGHTS)


@query(f"SELECT row_id, weight, unnest(range(1, weight + 1)) AS copy FROM ({UPSAMPLED})")
def upsampled_training(spark, sf):
    return split.replicate(split.upsample_weights(t.ratings(spark, sf), WEIGHTS))


@query("SELECT (SELECT count(*) FROM corpus) AS documents, (SELECT count(*) FROM hand) AS hand, (SELECT count(DISTINCT row_id) FROM matched) AS overlap, (SELECT count(*) FROM (SELECT row_id FROM ratings GROUP BY row_id HAVING count(*) = 9)) AS complete, " + f"(SELECT sum(weight)::BIGINT FROM ({UPSAMPLED})) AS training_rows")
def split_summary(spark, sf):
    docs, long = t.corpus(spark, sf), t.ratings(spark, sf)
    found = matching.match(t.hand(spark, sf), docs)
    parts = [
        docs.agg(F.count("*").alias("documents")),
        t.hand(spark, sf).agg(F.count("*").alias("hand")),
        found.agg(F.countDistinct("row_id").alias("overlap")),
        ratings.targets(docs, t.layout(spark), long).agg(F.count("targets").alias("complete")),
        split.upsample_weights(long, WEIGHTS).agg(F.sum("weight").alias("training_rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("SELECT row_id, filter, n, mean FROM scores")
def mean_per_filter(spark, sf):
    return agreement.scores(t.ratings(spark, sf)).select("row_id", "filter", "n", "mean")


@query("SELECT row_id, filter, most FROM scores")
def max_per_filter(spark, sf):
    return agreement.scores(t.ratings(spark, sf)).select("row_id", "filter", "most")


@query("SELECT row_id, filter, variance FROM scores")
def model_variance(spark, sf):
    return agreement.scores(t.ratings(spark, sf)).select("row_id", "filter", "variance")


@query("SELECT row_id, filter, n, spread FROM scores WHERE n >= 2 AND spread >= 5")
def high_disagreement(spark, sf):
    return agreement.high_disagreement(t.ratings(spark, sf)).select("row_id", "filter", "n", "spread")


@query("SELECT filter, bin, count(mean) AS documents FROM (SELECT DISTINCT filter FROM ratings) CROSS JOIN range(11) b(bin) LEFT JOIN scores USING (filter) WHERE FALSE GROUP BY ALL".replace("LEFT JOIN scores USING (filter) WHERE FALSE GROUP BY ALL", "LEFT JOIN (SELECT filter, round(mean, 0)::BIGINT AS bin, mean FROM scores) USING (filter, bin) GROUP BY ALL"))
def mean_histogram(spark, sf):
    return agreement.histogram(t.ratings(spark, sf))


RANKED = "row_number() OVER (PARTITION BY filter ORDER BY {0} DESC NULLS LAST, row_id) AS rank"


@query(f"SELECT row_id, filter, error, {RANKED.format('error')} FROM (SELECT row_id, filter, round(abs(mean - target), 6) AS error FROM scores JOIN human USING (row_id, filter))")
def hand_label_error_ranking(spark, sf):
    x = agreement.scores(t.ratings(spark, sf)).join(t.human(spark, sf), ["row_id", "filter"])
    return agreement.ranked(x.select("row_id", "filter", F.round(F.abs(F.col("mean") - F.col("target")), 6).alias("error")), "error")


@query(f"SELECT row_id, filter, variance, {RANKED.format('variance')} FROM scores")
def variance_ranking(spark, sf):
    return agreement.ranked(agreement.scores(t.ratings(spark, sf)).select("row_id", "filter", "variance"), "variance")


@query(f"SELECT row_id, filter, mean, rank FROM (SELECT row_id, filter, mean, {RANKED.format('mean')} FROM scores) WHERE abs(rank - 200) <= 75")
def doc_ranking_page(spark, sf):
    return agreement.page(agreement.ranked(agreement.scores(t.ratings(spark, sf)).select("row_id", "filter", "mean"), "mean"), 200)


CORRELATED = """SELECT filter, model_a, model_b, n, CASE WHEN n >= 2 AND n * xx - sx * sx > 0 AND n * yy - sy * sy > 0 THEN round(greatest(-1.0, least(1.0, (n * xy - sx * sy)::DOUBLE / sqrt((n * xx - sx * sx)::DOUBLE * (n * yy - sy * sy)::DOUBLE))), 9) END AS r FROM (
  SELECT a.filter, a.model AS model_a, b.model AS model_b, count(*) AS n, sum(a.rating) AS sx, sum(b.rating) AS sy, sum(a.rating * a.rating) AS xx, sum(b.rating * b.rating) AS yy, sum(a.rating * b.rating) AS xy
  FROM ratings a JOIN ratings b USING (row_id, filter) GROUP BY ALL)"""


@query(CORRELATED)
def pairwise_correlation(spark, sf):
    return agreement.correlations(t.ratings(spark, sf))


@query(f"SELECT filter, model_a, model_b, round((r - avg(r) OVER w) / stddev_pop(r) OVER w, 6) AS z FROM ({CORRELATED}) WINDOW w AS (PARTITION BY filter)")
def correlation_zscores(spark, sf):
    return agreement.correlation_zscores(t.ratings(spark, sf))


@query("""SELECT filter, model, count(target) AS n_human, round(avg(abs(rating - target)), 6) AS mae_human, count(o) AS n_others, round(avg(o), 6) AS mae_others FROM (
  SELECT r.*, target, CASE WHEN n > 1 THEN abs(rating - (s - rating) / (n - 1)::DOUBLE) END AS o FROM (SELECT *, sum(rating) OVER w AS s, count(*) OVER w AS n FROM ratings WINDOW w AS (PARTITION BY row_id, filter)) r LEFT JOIN human USING (row_id, filter)) GROUP BY ALL""")
def model_mae(spark, sf):
    return agreement.model_errors(t.ratings(spark, sf), t.human(spark, sf))


@query(f"SELECT filter, {ACCURATE} FROM (SELECT filter, mean >= 5 AS p, label >= 1 AS y FROM scores JOIN human USING (row_id, filter)) GROUP BY filter")
def threshold_accuracy_mean(spark, sf):
    return agreement.threshold_accuracy(agreement.scores(t.ratings(spark, sf)), t.human(spark, sf), 5.0, "mean")


@query(f"SELECT filter, {ACCURATE} FROM (SELECT filter, most >= 5 AS p, label >= 1 AS y FROM scores JOIN human USING (row_id, filter)) GROUP BY filter")
def threshold_accuracy_max(spark, sf):
    return agreement.threshold_accuracy(agreement.scores(t.ratings(spark, sf)), t.human(spark, sf), 5.0, "most")


@query("SELECT filter, count(*) AS n, round(avg(s), 6) AS accuracy, count(*) FILTER (label = 1) AS n_positive, round(avg(s) FILTER (label = 1), 6) AS accuracy_positive, count(*) FILTER (label = 0) AS n_negative, round(avg(s) FILTER (label = 0), 6) AS accuracy_negative FROM (SELECT filter, label, CASE WHEN label = 1 THEN mean / 10 ELSE 1 - mean / 10 END AS s FROM scores JOIN human USING (row_id, filter) WHERE label IN (0, 1)) GROUP BY filter")
def probabilistic_accuracy(spark, sf):
    x = agreement.scores(t.ratings(spark, sf)).join(t.human(spark, sf), ["row_id", "filter"])
    return metrics.probabilistic_accuracy(x.withColumn("p", F.col("mean") / 10))


SCORED = "FROM logits l JOIN ratings r ON l.row_id = r.row_id AND l.filter = r.filter AND l.judge = r.model GROUP BY l.filter"


def _scored(spark, sf):
    return t.logits(spark, sf).withColumnRenamed("judge", "model").join(t.ratings(spark, sf), ["row_id", "filter", "model"])


@query(f"SELECT l.filter, count(*) AS n, round(avg(greatest(logit, 0) - logit * rating / 10 + ln(1 + exp(-abs(logit)))), 6) AS loss {SCORED}")
def bce_loss(spark, sf):
    return _scored(spark, sf).groupBy("filter").agg(F.count("*").alias("n"), F.round(F.avg(X.bce_with_logits(F.col("logit"), F.col("rating") / 10)), 6).alias("loss"))


@query(f"SELECT l.filter, count(*) AS n, round(avg(abs(1 / (1 + exp(-logit)) - rating / 10)), 6) AS mae {SCORED}")
def validation_mae(spark, sf):
    return _scored(spark, sf).groupBy("filter").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(X.sigmoid(F.col("logit")) - F.col("rating") / 10)), 6).alias("mae"))


@query("""SELECT step, round(CASE WHEN step < w THEN (step + 1) / w::DOUBLE WHEN step < n - d THEN 1.0 ELSE 0.5 * (1 + cos(pi() * least((step - (n - d)) / d::DOUBLE, 1.0))) END, 6)::DOUBLE AS multiplier
  FROM log, (SELECT n, greatest(1, round_even(n * 0.05, 0))::BIGINT AS w, greatest(1, round_even(n * 0.2, 0))::BIGINT AS d FROM (SELECT max(step) AS n FROM log))""")
def lr_schedule(spark, sf):
    """The rate's multiplier at each step of the training log."""
    log = t.training_log(spark, sf)
    total = log.agg(F.max("step")).first()[0]
    return log.select("step", F.round(X.learning_rate(F.col("step"), total, 0.05, 0.2), 6).alias("multiplier"))


@query("SELECT step, loss FROM log ORDER BY loss, step LIMIT 1")
def best_checkpoint(spark, sf):
    return metrics.best_checkpoint(t.training_log(spark, sf))


@query("SELECT step, round(avg(loss) OVER (ORDER BY step ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), 6) AS average FROM log")
def moving_average_16(spark, sf):
    return metrics.moving_average(t.training_log(spark, sf), "loss").select("step", F.round("average", 6).alias("average"))


@query("""SELECT step, round(step / right_end::DOUBLE, 6) AS x, round((loss - bottom) / (top - bottom), 6) AS y FROM log, (SELECT greatest(0.0, lo - pad) AS bottom, hi + pad AS top, greatest(1, 20000, last) AS right_end FROM (
  SELECT *, greatest(0.01::DOUBLE, (hi - lo) * 0.1::DOUBLE, hi * 0.05::DOUBLE) AS pad FROM (SELECT min(loss) AS lo, max(loss) AS hi, max(step) AS last FROM log)))""")
def loss_curve(spark, sf):
    return metrics.loss_curve(t.training_log(spark, sf), 20_000).select("step", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT (step - 1) // 50 AS \"window\", max(step) AS step, round(avg(loss), 6) AS loss FROM log GROUP BY 1 HAVING count(*) = 50")
def tumbling_train_loss(spark, sf):
    return metrics.windowed_loss(t.training_log(spark, sf), 50)


BATCHED = "SELECT row_id, token_count, row_number() OVER (ORDER BY token_count, row_id) - 1 AS rank, (row_number() OVER (ORDER BY token_count, row_id) - 1) // 256 AS batch FROM corpus"


@query(BATCHED)
def length_batches(spark, sf):
    return scoring.length_batches(t.keys(spark, sf).select("row_id", "token_count"), 256)


@query(f"SELECT sum(t)::BIGINT AS tokens, sum(p)::BIGINT AS padded_tokens FROM (SELECT sum(token_count) AS t, max(token_count) * count(*) AS p FROM ({BATCHED}) GROUP BY batch)")
def padding_waste(spark, sf):
    return scoring.padding_waste(scoring.length_batches(t.keys(spark, sf).select("row_id", "token_count"), 256))


@query("SELECT row_id, filter, judge, round(logit, 6) AS logit FROM logits")
def linear_head_scores(spark, sf):
    return t.logits(spark, sf).withColumn("logit", F.round("logit", 6))


@query("SELECT row_id, filter, round(avg(1 / (1 + exp(-logit))), 6) AS p FROM logits GROUP BY ALL")
def filter_mean_probability(spark, sf):
    return scoring.filter_means(t.logits(spark, sf).withColumn("p", X.sigmoid(F.col("logit"))))


@query("SELECT row_id, filter, judge, round(1 / (1 + exp(-logit)), 6) AS p FROM logits")
def tags_long(spark, sf):
    """Tags nested and taken apart again."""
    tags = scoring.nest_tags(t.logits(spark, sf).withColumn("p", X.sigmoid(F.col("logit"))))
    x = tags.select("row_id", F.explode("tags").alias("filter", "m")).select("row_id", "filter", F.explode("m").alias("judge", "p"))
    return x.withColumn("p", F.round("p", 6))


@query("SELECT DISTINCT filter, model FROM ratings")
def distinct_filters_models(spark, sf):
    return t.ratings(spark, sf).select("filter", "model").distinct()


@query("SELECT row_id, sha256('Rate this: ' || text || chr(10) || 'Rate how far f zero applies.') AS prompt_sha256 FROM corpus")
def prompt_text(spark, sf):
    p = S.prompt("Rate this: {document}", F.col("text"), "Rate how far {trait} applies.", "f_zero")
    return t.corpus(spark, sf).select("row_id", F.sha2(p, 256).alias("prompt_sha256"))


@query(f"SELECT row_id, CASE WHEN length(n) > 200 THEN left(n, 200) || '...' ELSE n END AS snippet FROM (SELECT row_id, {t._norm('text')} AS n FROM corpus)")
def snippets(spark, sf):
    return t.corpus(spark, sf).select("row_id", S.snippet(F.col("text")).alias("snippet"))


@query("SELECT row_id, filter, model, rating FROM ratings")
def rating_tag_parse(spark, sf):
    answer = F.concat(F.lit("draft <rating>3</rating> final <rating>"), F.col("rating").cast("string"), F.lit("</rating><explanation> so\nit is </explanation>"))
    return t.ratings(spark, sf).select("row_id", "filter", "model", S.parse_response(answer)["rating"].cast("long").alias("rating"))


@query("SELECT row_id, CASE WHEN greatest(a, b, c) IS NULL THEN NULL WHEN a >= 7 THEN 1 WHEN greatest(a, b) >= 7 THEN 2 WHEN greatest(a, b, c) >= 7 THEN 3 ELSE 4 END AS level FROM (SELECT row_id, max(mean) FILTER (filter = 'f0') AS a, max(mean) FILTER (filter = 'f1') AS b, max(mean) FILTER (filter = 'f2') AS c FROM scores GROUP BY row_id)")
def stratified_levels(spark, sf):
    """The first of the nested filters whose mean reaches 7, else level 4."""
    x = agreement.scores(t.ratings(spark, sf)).groupBy("row_id").agg(*(F.max(F.when(F.col("filter") == f"f{k}", F.col("mean"))).alias(c) for k, c in enumerate("abc")))
    most = F.greatest("a", "b", "c")
    level = F.when(most.isNull(), F.lit(None)).when(F.col("a") >= 7, 1).when(F.greatest("a", "b") >= 7, 2).when(most >= 7, 3).otherwise(4)
    return x.select("row_id", level.alias("level"))


@query("""SELECT row_id, filter, model, CASE WHEN row_id % 4 < 3 THEN rating::INT END AS rating, ['a' || chr(10) || 'b' || chr(10) || 'c', 'open', 'x', NULL][row_id % 4 + 1] AS explanation, ['q', '', '', NULL][row_id % 4 + 1] AS quote FROM ratings""")
def response_parse_full(spark, sf):
    """Rating, explanation and quote of answers with drafts, damaged tags and long explanations."""
    forms = ["<rating>3</rating> <rating>{0}</rating><explanation> a\nb\nc\nd </explanation><quote> q </quote>", "<rating>{0}<explanation>open", "<RATING>{0}</RATING><Explanation>x</Explanation>", "<rating>{0}</rating>"]
    form = F.get(F.array(*map(F.lit, forms)), (F.col("row_id") % 4).cast("int"))
    answer = F.replace(form, F.lit("{0}"), F.col("rating").cast("string"))
    return t.ratings(spark, sf).select("row_id", "filter", "model", S.parse_response(answer).alias("e")).select("row_id", "filter", "model", "e.*")


PLACED = permuted_sql("(SELECT row_number() OVER (ORDER BY row_id) - 1 AS x FROM corpus)", "(SELECT count(*) FROM corpus)", 7)


@query(f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS x FROM corpus) JOIN {PLACED} USING (x)
  WHERE place < (SELECT greatest(1, round_even(count(*) * 0.05, 0))::BIGINT FROM corpus)""")
def exact_sample_split(spark, sf):
    """A validation sample by a seeded permutation of the rows."""
    return split.exact_sample(t.corpus(spark, sf).select("row_id"), 0.05, 7)


BATCHES = "((SELECT count(*) FROM corpus) + 255) // 256"


@query(f"SELECT place AS position, x AS batch FROM {permuted_sql(f'(SELECT x FROM range({BATCHES}) t(x))', f'({BATCHES})', 7)}")
def batch_order(spark, sf):
    """The batches of 256 rows in a seeded order."""
    n = t.corpus(spark, sf).count()
    return scoring.batch_order(spark, -(-n // 256), 7)


@query()
def tags_nested(spark, sf):
    tags = scoring.nest_tags(scoring.probabilities(t.logits(spark, sf)))
    return tags.withColumn("valid", scoring.tags_valid(F.col("tags"), {f"f{k}": ["m0", "m1", "m2"] for k in range(3)}))


@query("""SELECT row_id, filter, model, coalesce(rating, (length('Rate: ' || text || chr(10) || '0 to 10') + ascii('m') + ascii(right(model, 1))) % 11)::BIGINT AS rating FROM corpus CROSS JOIN layout LEFT JOIN ratings USING (row_id, filter, model)""")
def judge_stub_refill(spark, sf):
    """Missing ratings from a judge that needs no network, beside the ones that are there."""
    docs, long = t.corpus(spark, sf), t.ratings(spark, sf)
    todo = ratings.pending(docs, t.layout(spark), long).join(docs.select("row_id", "text"), "row_id")
    asked = judge.ask(todo.withColumn("prompt", S.prompt("Rate: {document}", F.col("text"), "0 to 10", "x")), t.judge)
    new = judge.parsed(asked).select("row_id", "filter", "model", F.col("rating").cast("long"))
    return ratings.merge_missing(long, new)


@query(f"SELECT row_id, n AS text FROM (SELECT doc_id AS row_id, {t._norm('text')} AS n FROM documents) WHERE n <> ''")
def normalized_texts(spark, sf):
    """Texts as they are read into a corpus: normalized, without empty ones."""
    return corpus.read_texts(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text"))


@query("SELECT row_id, CASE WHEN row_id % 10 = 3 THEN 'new' ELSE digest END AS digest FROM corpus")
def row_patch(spark, sf):
    """A tenth of the rows replaced by others, and a replacement without a row."""
    rows = t.keys(spark, sf).select("row_id", "digest")
    new = rows.where("row_id % 10 = 3").select("row_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("row_id")))
    return upkeep.patched(rows, new.withColumn("digest", F.lit("new")))


@query("SELECT count(*) FILTER (row_id % 3 > 0) AS saved, count(*) FILTER (row_id % 3 = 0) AS failed FROM (SELECT d.row_id, l.filter, l.model FROM corpus d CROSS JOIN layout l ANTI JOIN ratings USING (row_id, filter, model))")
def saved_and_failed(spark, sf):
    """Of the ratings asked for, those that came; a third never does."""
    asked = ratings.pending(t.corpus(spark, sf), t.layout(spark), t.ratings(spark, sf))
    return upkeep.outcome(asked, asked.where("row_id % 3 > 0"), ratings.KEY)


@query("SELECT count(*) AS cleared FROM (SELECT DISTINCT row_id FROM ratings)")
def hard_refresh(spark, sf):
    """Rows that lose their ratings when all are to be made anew."""
    rows = t.corpus(spark, sf).select("row_id").join(ratings.nest(t.ratings(spark, sf)), "row_id", "left")
    return upkeep.refreshed(rows).where("ratings is null").agg(F.count_if("cleared").alias("cleared"))


@query("SELECT 'hand' AS origin, 'hand:' || ann_id AS example_id, sha256(text) AS text_sha256 FROM hand UNION ALL SELECT 'rated', 'rated:' || row_id, sha256(text) FROM corpus WHERE row_id % 5 = 0")
def example_ids(spark, sf):
    """Two sets of texts in one bag, with ids that are unique across them."""
    rated = t.corpus(spark, sf).where("row_id % 5 = 0").select(F.col("row_id").alias("line"), "text")
    x = upkeep.examples(hand=t.hand(spark, sf).select(F.col("ann_id").alias("line"), "text"), rated=rated)
    return x.select("origin", "example_id", F.sha2("text", 256).alias("text_sha256"))


COMPLETE = "(SELECT row_id FROM ratings GROUP BY row_id HAVING count(*) = 9)"


@query(f"SELECT row_id FROM {COMPLETE} WHERE row_id NOT IN (SELECT row_id FROM matched WHERE row_id IS NOT NULL)")
def eligible_rows(spark, sf):
    """Complete rows that no hand text of two sets matches; the second set holds half of the first, again."""
    docs = t.corpus(spark, sf)
    hand = t.hand(spark, sf)
    both = upkeep.examples(a=hand.withColumnRenamed("ann_id", "line"), b=hand.where("ann_id % 2 = 0").withColumnRenamed("ann_id", "line"))
    found = matching.match(both.select(F.col("example_id").alias("ann_id"), "text"), docs).where("row_id is not null")
    complete = ratings.targets(docs, t.layout(spark), t.ratings(spark, sf)).where("targets is not null").select("row_id")
    return complete.join(found.select("row_id").distinct(), "row_id", "left_anti")


@query(f"""SELECT count(*) AS eligible, (SELECT count(*) FROM {COMPLETE} WHERE row_id IN (SELECT row_id FROM matched)) AS excluded_overlap, round_even(count(*) * 0.05, 0)::BIGINT AS validation, (count(*) - round_even(count(*) * 0.05, 0))::BIGINT AS train
  FROM {COMPLETE} WHERE row_id NOT IN (SELECT row_id FROM matched WHERE row_id IS NOT NULL)""")
def split_counts(spark, sf):
    """Complete rows, those of them that are hand texts too, and the sizes of the parts of the rest."""
    docs = t.corpus(spark, sf)
    complete = ratings.targets(docs, t.layout(spark), t.ratings(spark, sf)).where("targets is not null").select("row_id")
    found = matching.match(t.hand(spark, sf), docs).where("row_id is not null").select("row_id").distinct().withColumn("hand", F.lit(True))
    n = complete.join(found, "row_id", "left").agg(F.count_if(F.col("hand").isNull()).alias("eligible"), F.count("hand").alias("excluded_overlap"))
    return n.withColumn("validation", F.bround(F.col("eligible") * 0.05).cast("long")).withColumn("train", F.col("eligible") - F.col("validation"))


@query(f"SELECT row_id, filter, mean, {RANKED.format('mean')} FROM scores WHERE round(mean, 0) = 7")
def doc_ranking_of_bin(spark, sf):
    """The documents of one bar of the histogram, highest mean first."""
    x = agreement.scores(t.ratings(spark, sf)).where(F.round("mean") == 7).select("row_id", "filter", "mean")
    return agreement.ranked(x, "mean")


@query(f"SELECT count(*) AS documents FROM ({BATCHED}) WHERE batch % 3 = 0")
def documents_done(spark, sf):
    """Documents of the finished batches; every third is."""
    batched = scoring.length_batches(t.keys(spark, sf).select("row_id", "token_count"), 256)
    return upkeep.documents_done(batched, batched.where("batch % 3 = 0").select("batch").distinct())


@query(f"SELECT row_id, sha256(text) AS text_sha256 FROM corpus WHERE row_id IN (SELECT row_id FROM ({BATCHED}) WHERE batch = 0)")
def rows_of_batch(spark, sf):
    """The texts of the first batch."""
    docs = t.corpus(spark, sf).select("row_id", "text", "token_count")
    return upkeep.rows_of_batch(docs, scoring.length_batches(t.keys(spark, sf).select("row_id", "token_count"), 256), 0).select("row_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"SELECT row_id, sha256(text) AS text_sha256, token_count, digest FROM (SELECT e.*, c.text FROM eligible e JOIN corpus c USING (row_id)) WHERE cum - token_count < {t.TARGET}")
def early_stop_budget(spark, sf):
    """The budgeted corpus from ordered shards, of which those behind the target stay closed."""
    kept = progressive.build(spark, t.shards(spark, sf), runtime.new_path(spark), t.exclusions(spark, sf), t.LOW, t.HIGH, t.TARGET, require=False)
    return kept.select("row_id", F.sha2("text", 256).alias("text_sha256"), "token_count", "digest")


@query(f"""SELECT reason, count(*) AS documents FROM (SELECT *, sum(k) OVER (ORDER BY row_id) AS cum FROM (SELECT *, CASE WHEN reason = 'kept' THEN token_count ELSE 0 END AS k FROM (
  SELECT row_id, token_count, CASE WHEN token_count < {t.LOW} THEN 'short' WHEN token_count > {t.HIGH} THEN 'long' WHEN b THEN 'excluded'
  WHEN row_number() OVER (PARTITION BY digest, token_count BETWEEN {t.LOW} AND {t.HIGH} AND NOT b ORDER BY row_id) > 1 THEN 'duplicate' ELSE 'kept' END AS reason
  FROM (SELECT *, digest IN (SELECT digest FROM exclusions) AS b FROM corpus)))) WHERE cum - k < {2 * t.TARGET} GROUP BY reason""")
def resumed_build_counts(spark, sf):
    """Why rows stayed out of a build that stopped after one group of shards, was carried on, and then extended to twice its target."""
    shards, banned, out = t.shards(spark, sf), t.exclusions(spark, sf), runtime.new_path(spark)
    for target, most in ((t.TARGET, 1), (t.TARGET, None), (2 * t.TARGET, None)):
        progressive.build(spark, shards, out, banned, t.LOW, t.HIGH, target, resume=True, most_groups=most, require=False)
    state = versions.state(spark, out)
    read = versions.read(spark, out).limit(1).select(F.explode(F.create_map(*(F.lit(x) for k in progressive.COUNTS for x in (k, state[k])))).alias("reason", "documents"))
    return read.where("documents > 0").select("reason", F.col("documents").cast("long").alias("documents"))


@query("SELECT row_id, token_count, CASE WHEN row_id % 3 = 0 THEN 'new' ELSE digest END AS digest FROM corpus WHERE row_id % 7 <> 6")
def delta_patches(spark, sf):
    """A table of which a third of the rows is rewritten in batches and a seventh deleted, merged when it is read."""
    rows, path = t.keys(spark, sf).select("row_id", "token_count", "digest"), runtime.new_path(spark)
    versions.commit(rows, path)
    at = upkeep.by_batches(rows.where("row_id % 3 = 0"), path, max(1, rows.count() // 8), lambda b: b.withColumn("digest", F.lit("new")))
    versions.commit(rows.where("row_id % 7 = 6").select("row_id"), path, at, "delete")
    return versions.read(spark, path)


@query("SELECT row_id, sha256(text) AS text_sha256 FROM corpus WHERE row_id < (SELECT count(*) // 3 FROM corpus)")
def jsonl_prefix(spark, sf):
    """The first third of the documents as JSON lines; later files aren't read."""
    docs, path = t.corpus(spark, sf), runtime.new_path(spark)
    t.in_order(docs.select("row_id", "text")).drop("row_id").write.json(path)
    read = progressive.read_jsonl_prefix(spark, path, docs.count() // 3)
    return read.select("row_id", F.sha2(F.try_variant_get("value", "$.text", "string"), 256).alias("text_sha256"))


@query(f"""SELECT row_id, batch, pack, count(*) OVER (PARTITION BY batch, pack) AS pack_rows, count(*) OVER (PARTITION BY batch, pack) * max(length) OVER (PARTITION BY batch, pack) AS padded_tokens, list_sum(probs) AS p FROM (
  WITH RECURSIVE numbered AS (SELECT row_id, batch, greatest(1, token_count) AS length, row_number() OVER (PARTITION BY batch ORDER BY greatest(1, token_count), row_id) AS nth FROM ({BATCHED})),
  packed AS (SELECT row_id, batch, length, nth, 0 AS pack, 1 AS held FROM numbered WHERE nth = 1 UNION ALL
    SELECT n.row_id, n.batch, n.length, n.nth, CASE WHEN (held + 1) * n.length <= 8192 THEN pack ELSE pack + 1 END, CASE WHEN (held + 1) * n.length <= 8192 THEN held + 1 ELSE 1 END FROM packed p JOIN numbered n ON n.batch = p.batch AND n.nth = p.nth + 1)
  SELECT row_id, batch, pack, length, probs FROM packed JOIN (SELECT row_id, list(round(p, 6) ORDER BY filter, judge) AS probs FROM encoded GROUP BY row_id) USING (row_id))""")
def packed_scores(spark, sf):
    """Each document's pack in its length batch, and its scores by an encoder that runs pack by pack."""
    docs = t.corpus(spark, sf).select("row_id", "text")
    batched = scoring.length_batches(t.keys(spark, sf).select("row_id", "token_count"), 256)
    x = tagging.score_packed(docs.join(batched, "row_id"), t.encoder, len(t.TARGETS), 8192)
    p = F.aggregate(F.transform("probs", lambda v: F.round(v.cast("double"), 6)), F.lit(0.0), lambda a, b: a + b)
    return x.select("row_id", "batch", "pack", "pack_rows", "padded_tokens", p.alias("p"))


@query("SELECT row_id, filter, judge, p FROM encoded")
def resumed_tagging(spark, sf):
    """Tags of a run that stopped twice, written in source order and read back by line."""
    texts, home = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text"), runtime.new_path(spark)
    keys = t.keys(spark, sf).select("row_id", "token_count")
    for turn, most in enumerate((1, 1, None)):
        scores = tagging.run(texts.join(keys, "row_id"), f"{home}/run", t.encoder, "letters", t.TARGETS, 64, per_wave=4, resume=turn > 0, most_waves=most)
    tagging.write_tagged(texts, keys.join(scores, "row_id"), t.TARGETS, f"{home}/tagged")
    tags = F.variant_get("value", "$.tags", "map<string, map<string, double>>").alias("tags")
    rows = jsonl.with_row_id(jsonl.read_jsonl(spark, f"{home}/tagged").select("file", "line", tags))
    return rows.select("row_id", F.explode("tags").alias("filter", "m")).select("row_id", "filter", F.explode("m").alias("judge", "p"))


def _head_rows(spark, sf):
    """(row_id, vector, targets) of the vectors of complete rows, and whether a row is for validation."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    y = ratings.targets(e, t.layout(spark), t.ratings(spark, sf)).where("targets is not null")
    rows = runtime.stored(e.join(y, "row_id"))
    chosen = runtime.stored(split.hash_sample(rows.select("row_id"), 0.1, 7)).withColumn("held", F.lit(True))
    return rows.join(chosen, "row_id", "left")


@query()
def head_training(spark, sf):
    """The log of a head of nine soft labels trained on the embeddings, read back from its run folder."""
    rows = _head_rows(spark, sf)
    run = runlog.claim_run(spark, runtime.new_path(spark))
    s = training.Settings(batch=256, epochs=2, rate=0.05, log_every=1, val_every=2)
    head = training.fit_head(rows.where("held is null"), rows.where("held"), t.TARGETS, s, runlog.Log(spark, run))
    training.save_head(spark, head, f"{run}/best")
    events = runlog.read(spark, run, "event string, step long, epoch long, loss double, mae double, grad_norm double, learning_rate double")
    return events.select("event", "step", "epoch", *(F.round(c, 9).alias(c) for c in ("loss", "mae", "grad_norm", "learning_rate")))


@query()
def head_predictions(spark, sf):
    """Probabilities of every vector by a trained head that was stored and loaded."""
    rows, home = _head_rows(spark, sf), runtime.new_path(spark)
    s = training.Settings(batch=512, epochs=1, rate=0.05, log_every=1, val_every=2)
    training.save_head(spark, training.fit_head(rows.where("held is null"), rows.where("held"), t.TARGETS, s), home)
    every = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    p = training.predict(every, training.load_head(spark, home))
    return p.select("row_id", F.posexplode("probs").alias("idx", "p")).select("row_id", "idx", F.round(F.col("p").cast("double"), 6).alias("p"))


CHOSEN = f"(SELECT *, row_number() OVER (ORDER BY sha256('7:' || row_id)) AS nth, count(*) OVER () AS n FROM (SELECT row_id FROM {COMPLETE} WHERE row_id NOT IN (SELECT row_id FROM matched WHERE row_id IS NOT NULL)))"


@query(f"""SELECT name, n FROM (UNPIVOT (SELECT *, rated_rows - complete_rows AS incomplete_rows, training_rows - unique_training_rows AS duplicate_copies, validation_hand_rows + validation_sample_rows AS validation_rows, unmatched_annotations + hand_rows - validation_hand_rows AS unusable_hand_rows FROM (
  SELECT (SELECT count(*) FROM corpus) AS rated_rows, (SELECT count(*) FROM {COMPLETE}) AS complete_rows, (SELECT count(*) FROM hand) AS hand_rows, (SELECT count(*) FROM {COMPLETE} WHERE row_id IN (SELECT ann_id FROM hand)) AS validation_hand_rows,
  (SELECT count(*) FROM {CHOSEN} WHERE nth > round_even(n * 0.05, 0)) AS unique_training_rows, (SELECT sum(weight)::BIGINT FROM {CHOSEN} JOIN ({UPSAMPLED}) USING (row_id) WHERE nth > round_even(n * 0.05, 0)) AS training_rows,
  (SELECT count(*) FROM {CHOSEN} JOIN ({UPSAMPLED}) USING (row_id) WHERE nth > round_even(n * 0.05, 0) AND weight > 1) AS upsampled_rows, (SELECT count(*) FROM {COMPLETE} WHERE row_id IN (SELECT row_id FROM matched)) AS excluded_overlap_rows,
  (SELECT count(*) FROM {CHOSEN} WHERE nth <= round_even(n * 0.05, 0)) AS validation_sample_rows, 0::BIGINT AS unmatched_annotations, 9::BIGINT AS targets)) ON COLUMNS(*) INTO NAME name VALUE n)""")
def prepared_summary(spark, sf):
    """All counts of a split of rated rows and hand rows for training."""
    docs, hand, long = t.corpus(spark, sf).select("row_id", "text"), t.hand(spark, sf), t.ratings(spark, sf)
    hand_docs = hand.withColumnRenamed("ann_id", "row_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("ann_id"), "quality", "toxic")
    x = split.prepare(docs, long, hand_docs, long.join(hand_docs.select("row_id"), "row_id", "left_semi"), hand.join(labels, "ann_id"), t.layout(spark), WEIGHTS)
    return x.summary


@query("SELECT row_id, arg_min(quality, ann_id) AS quality, arg_min(toxic, ann_id) AS toxic FROM matched JOIN labels ON doc_id = ann_id WHERE row_id IS NOT NULL GROUP BY row_id")
def first_annotation_labels(spark, sf):
    """Labels of each matched row: those of its first annotation."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("ann_id"), "quality", "toxic")
    return matching.first_labels(matching.match(t.hand(spark, sf), t.corpus(spark, sf)), labels).select("row_id", "quality", "toxic")


@query("""SELECT a.ann_id, a.row_id, CASE WHEN long AND ann_id % 2 = 0 THEN 'prefix' ELSE 'exact' END AS how, sha256(c.text) AS text_sha256 FROM (
  SELECT ann_id, long, row_id FROM (SELECT ann_id, length(text) > 200 AS long, CASE WHEN length(text) > 200 AND ann_id % 2 = 0 THEN (SELECT min(row_id) FROM corpus c WHERE left(c.text, 200) = left(h.text, 200)) ELSE (SELECT min(row_id) FROM corpus c WHERE c.text = h.text) END AS row_id FROM hand h)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ann_id) = 1) a JOIN corpus c USING (row_id)""")
def annotation_sync(spark, sf):
    """Annotations, half of them changed behind their prefix, with the texts of a live file of JSON lines."""
    path = runtime.new_path(spark)
    tagging.write_in_order(t.corpus(spark, sf).select("row_id", "text"), path)
    live = runtime.stored(jsonl.read_live_rows(spark, path).select("row_id", "text"))
    changed = F.when((F.char_length("text") > 200) & (F.col("ann_id") % 2 == 0), F.concat(F.substring("text", 1, 200), F.lit("\0"))).otherwise(F.col("text"))
    hand = t.hand(spark, sf).withColumn("text", changed)
    first = matching.match(hand, live).groupBy("row_id").agg(F.min("ann_id").alias("ann_id"))
    x = matching.synced(hand.join(first.select("ann_id"), "ann_id", "left_semi"), live)
    return x.select("ann_id", "row_id", "how", F.sha2("text", 256).alias("text_sha256"))


CONTAINERS = ['{"ratings":{"f0":[]}}', '{"ratings":{"f0":[1],"g":5}}', "{}", '{"ratings":[]}', '{"ratings":{"f0":{}}}', '{"ratings":"x"}', '{"ratings":{"f1":null}}', '{"ratings":null}']


@query("SELECT row_id, row_id % 8 < 3 AS appendable FROM corpus")
def appendable_rows(spark, sf):
    """To which rows ratings can be added, for eight kinds of containers."""
    kind = F.get(F.array(*map(F.lit, CONTAINERS)), (F.col("row_id") % len(CONTAINERS)).cast("int"))
    return t.corpus(spark, sf).select("row_id", ratings.appendable(F.parse_json(kind), ["f0", "f1"]).alias("appendable"))


RAW_THRESHOLDS = [-3.0, 4.96, 5.04, 6.25, 12.3]


@query(f"""SELECT filter, threshold, {ACCURATE} FROM (SELECT filter, threshold, mean >= threshold AS p, label >= 1 AS y FROM scores JOIN human USING (row_id, filter), (SELECT DISTINCT round(least(10.0, greatest(0.0, x)), 1)::DOUBLE AS threshold FROM (SELECT unnest({RAW_THRESHOLDS})::DOUBLE AS x))) GROUP BY filter, threshold""")
def clamped_threshold_accuracy(spark, sf):
    """Accuracy at thresholds as a slider gives them, put in steps of a tenth from 0 to 10."""
    x = agreement.scores(t.ratings(spark, sf)).join(t.human(spark, sf), ["row_id", "filter"])
    at = spark.createDataFrame([(v,) for v in RAW_THRESHOLDS], "x double").select(X.threshold(F.col("x")).alias("threshold")).distinct()
    x = x.crossJoin(F.broadcast(at)).select("filter", "threshold", (F.col("mean") >= F.col("threshold")).alias("p"), (F.col("label") >= 1).alias("y"))  # a row for each threshold
    return x.groupBy("filter", "threshold").agg(*agreement.hits(F.col("p"), F.col("y")))
