"""Queries over posts: documents dated by their id stand for posts of an entity, their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import text as t
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS
from stratagrid.session import table

LEX = "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in t.POSITIVE) + ")", "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in t.NEGATIVE) + ")"
POSTS = f"""WITH posts AS (SELECT doc_id, source AS entity, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date, text, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id % 30) * 86400 + (doc_id * 7919) % 86400) AS ts,
  CASE WHEN {LEX[0]} + {LEX[1]} = 0 THEN 0 ELSE ({LEX[0]} - {LEX[1]}) / CAST({LEX[0]} + {LEX[1]} AS DOUBLE) END AS score, doc_id % 4 AS topic FROM documents)"""


def posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 30) * 86400 + (F.col("doc_id") * 7919) % 86400)
    return d.select("doc_id", F.col("source").alias("entity"), day.alias("date"), ts.alias("ts"), "text", t.lexicon_score("text").alias("score"), (F.col("doc_id") % 4).alias("topic"))


@query("sf06_lexicon_score", POSTS + " SELECT doc_id, round(score, 6) AS score FROM posts")
def lexicon(spark, sf_dir):
    return posts(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query("pf25_bipolar", POSTS + " SELECT doc_id, CASE WHEN score > 0.2 THEN 'bull' WHEN score < -0.2 THEN 'bear' ELSE 'neutral' END AS side FROM posts")
def bipolar(spark, sf_dir):
    return posts(spark, sf_dir).select("doc_id", t.bipolar("score").alias("side"))


@query("sf05_clean", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS digest FROM pages")
def clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.clean("html").cast("binary")).alias("digest"))


NOISE = "SELECT doc_id, length(text) < 5 OR regexp_full_match(text, '[^\\pL\\pN]*') AS noise FROM documents"


@query("sf05_noise", NOISE)
@query("sf05_noise_all", NOISE)
def noise_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.is_noise("text").alias("noise"))


@query("sf04_decay", POSTS + " SELECT doc_id, round(exp(-ln(2) / 7 * greatest(date_diff('day', date, (SELECT max(date) FROM posts)), 0)), 6) AS weight FROM posts")
def decay(spark, sf_dir):
    p = posts(spark, sf_dir)
    return p.select("doc_id", F.round(t.decay_weight(p), 6).alias("weight"))


@query("sf03_aligned", POSTS + """, cal AS (SELECT DATE '2024-01-01' + i AS date FROM (SELECT unnest(generate_series(0, 40))::INT AS i) WHERE isodow(DATE '2024-01-01' + i) < 6)
SELECT doc_id, CASE WHEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) > 54000 THEN coalesce((SELECT min(date) FROM cal WHERE cal.date > CAST(posts.ts AS DATE)), CAST(ts AS DATE)) ELSE CAST(ts AS DATE) END AS aligned_date FROM posts""")
def aligned(spark, sf_dir):
    cal = spark.range(41).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date")).where(F.weekday("date") < 5)
    return t.aligned(posts(spark, sf_dir), cal).select("doc_id", "aligned_date")


@query("ag09_daily_stats", POSTS + """, w AS (SELECT *, exp(-ln(2) / 7 * greatest(date_diff('day', date, (SELECT max(date) FROM posts)), 0)) AS weight FROM posts),
b AS (SELECT entity, date, count(score) AS n, count(*) FILTER (score > 0.2) AS bull, count(*) FILTER (score < -0.2) AS bear, avg(score) AS mean, coalesce(stddev_pop(score), 0) AS std, skewness(score) AS us, sum(score * weight) / sum(weight) AS dm FROM w GROUP BY 1, 2)
SELECT entity, date, n, bull, bear, n - bull - bear AS neutral, round((bull - bear) / (bull + bear + 1), 6) AS bipolar, round(greatest(0, 1 - std), 6) AS agreement, round(ln(1 + n), 6) AS attention, round(bull / n, 6) AS bull_ratio, round(mean, 6) AS mean, round(std, 6) AS std,
round(std / (abs(mean) + 0.05), 6) AS divergence, round(dm, 6) AS decayed_mean, round(CASE WHEN n >= 3 AND std >= 1e-10 THEN us * (n - 2) / sqrt(n * (n - 1.0)) ELSE 0 END, 6) AS skew FROM b""")
def daily_stats(spark, sf_dir):
    p = posts(spark, sf_dir)
    out = t.daily_stats(p.withColumn("weight", t.decay_weight(p)), "score", "weight")
    return out.select("entity", "date", "n", "bull", "bear", "neutral", *(F.round(c, 6).alias(c) for c in ("bipolar", "agreement", "attention", "bull_ratio", "mean", "std", "divergence", "decayed_mean", "skew")))


@query("ag10_topic_stats", POSTS + """, b AS (SELECT entity, date, topic, count(*) AS c, avg(score) AS m FROM posts GROUP BY 1, 2, 3), p AS (SELECT *, c / sum(c) OVER (PARTITION BY entity, date) AS p FROM b)
SELECT entity, date, count(*) AS topics, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-10)) ELSE 0 END, 6) AS entropy, first(topic ORDER BY c DESC, topic) AS dominant, round(coalesce(stddev_pop(m), 0), 6) AS spread FROM p GROUP BY 1, 2""")
def topic_stats(spark, sf_dir):
    return t.topic_stats(posts(spark, sf_dir), "topic", "score").withColumns({"entropy": F.round("entropy", 6), "spread": F.round("spread", 6)})


@query("ag11_gold_sentiment", POSTS + " SELECT entity, date, round(avg(score), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(score) END, 6) AS std, count(*) AS n, round(avg(CASE WHEN score > 0.2 THEN 1.0 ELSE 0 END), 6) AS up, round(avg(CASE WHEN score < -0.2 THEN 1.0 ELSE 0 END), 6) AS down FROM posts GROUP BY 1, 2")
def gold_sentiment(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return posts(spark, sf_dir).groupBy("entity", "date").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.when(F.count("*") == 1, 0.0).otherwise(F.stddev_samp("score")), 6).alias("std"), F.count("*").alias("n"), share(F.col("score") > 0.2).alias("up"), share(F.col("score") < -0.2).alias("down"))


@query("ag33_sc11_best_posts", POSTS + " SELECT entity, date, doc_id FROM posts QUALIFY row_number() OVER (PARTITION BY entity, date ORDER BY text IS NOT NULL AND length(text) > 0 DESC, coalesce(length(text), 0) DESC, doc_id) = 1")
def best_posts(spark, sf_dir):
    return t.best_posts(posts(spark, sf_dir), ["entity", "date"], "text", "doc_id").select("entity", "date", "doc_id")


#: Pairs of posts alike, and one post after another, those that stay by entity.
PAIRS = """p AS (SELECT entity, date AS d, doc_id AS k, lower(text) AS t, length(text) AS n FROM {posts} WHERE length(text) > 0),
c AS MATERIALIZED (SELECT a.k AS later, b.k AS earlier, a.t AS t, b.t AS t0, greatest(a.n, b.n) AS n FROM p a JOIN p b ON a.entity = b.entity AND b.d <= a.d AND a.d - b.d <= 3 AND (b.d < a.d OR b.k < a.k) AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)),
sim AS MATERIALIZED (SELECT later, earlier, round(1 - levenshtein(t, t0) / CAST(n AS DOUBLE), 6) AS similarity FROM c WHERE 1 - levenshtein(t, t0) / CAST(n AS DOUBLE) > 0.89)"""
KEPT = PAIRS + """, o AS MATERIALIZED (SELECT entity, k, row_number() OVER (PARTITION BY entity ORDER BY d, k) AS place FROM p WHERE k IN (SELECT later FROM sim WHERE similarity > 0.9 UNION SELECT earlier FROM sim WHERE similarity > 0.9)),
taken AS (SELECT DISTINCT entity, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM o
  UNION ALL SELECT o.entity, o.place, CASE WHEN EXISTS (SELECT 1 FROM sim WHERE sim.later = o.k AND similarity > 0.9 AND list_contains(taken.kept, sim.earlier)) THEN taken.kept ELSE list_append(taken.kept, o.k) END FROM taken JOIN o ON o.entity = taken.entity AND o.place = taken.place + 1),
fallen AS MATERIALIZED (SELECT k FROM o WHERE k NOT IN (SELECT unnest(kept) FROM (SELECT kept FROM taken QUALIFY place = max(place) OVER (PARTITION BY entity))))"""


@query("jn24_near_pairs", POSTS + ", " + PAIRS.format(posts="posts") + " SELECT * FROM sim WHERE similarity > 0.9")
def near_pairs(spark, sf_dir):
    return t.near_pairs(posts(spark, sf_dir), "text", "doc_id")


@query("jn24_without_near_copies", POSTS.replace("WITH", "WITH RECURSIVE", 1) + ", " + KEPT.format(posts="posts") + " SELECT doc_id, doc_id NOT IN (SELECT k FROM fallen) AS kept FROM posts")
def without_near_copies(spark, sf_dir):
    return t.without_near_copies(posts(spark, sf_dir), "text", "doc_id").select("doc_id", "kept")


@query("sf11_statutory_date", f"WITH bars AS ({BARS}) SELECT DISTINCT date, CASE WHEN month(date) <= 3 THEN make_date(year(date), 4, 30) WHEN month(date) <= 6 THEN make_date(year(date), 8, 31) WHEN month(date) <= 9 THEN make_date(year(date), 10, 31) ELSE make_date(year(date) + 1, 4, 30) END AS due FROM bars")
def statutory(spark, sf_dir):
    return daily(spark, sf_dir).select("date").distinct().select("date", t.statutory_date("date").alias("due"))


@query("sf02_calendar_parts", f"WITH bars AS ({BARS}) SELECT DISTINCT date, isodow(date) - 1 AS dow, day(date) AS day, month(date) AS month, quarter(date) AS quarter FROM bars")
def calendar_parts(spark, sf_dir):
    return daily(spark, sf_dir).select("date").distinct().withColumns({k: v.cast("long") for k, v in t.calendar_parts("date").items()})


@query("sf08_fingerprint", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("sf12_sanitised", f"WITH bars AS ({BARS}) SELECT entity, date, CASE WHEN volume % 7 = 0 THEN 0 ELSE greatest(-10, least(10, volume - 20)) END AS x FROM bars")
def sanitised(spark, sf_dir):
    d = daily(spark, sf_dir)
    odd = F.when(F.col("volume") % 21 == 0, F.lit(float("inf"))).when(F.col("volume") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("volume") - 20)
    return d.select("entity", "date", t.sanitised(odd).alias("x"))


@query("sf14_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("sf15_try_cast", "SELECT doc_id, try_cast(left(text, 2) AS DOUBLE) AS x, try_cast(doc_id::VARCHAR AS BIGINT) AS k FROM documents WHERE doc_id % 2 >= 0")
def try_casts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 2).try_cast("double").alias("x"), F.col("doc_id").cast("string").try_cast("long").alias("k"))


@query("sf09_sentiment_price", f"WITH bars AS ({BARS}), r AS (SELECT entity, date, close / lag(close, 5) OVER (PARTITION BY entity ORDER BY date) - 1 AS roc, volume FROM bars) SELECT entity, date, round((volume / 50 - 0.5) * sign(roc), 6) AS x_roc, round((volume / 50 - 0.5) * ln(1 + volume), 6) AS x_vol FROM r")
def sentiment_price(spark, sf_dir):
    from stratagrid.functions.windows import before

    d = daily(spark, sf_dir).withColumn("roc", F.try_divide(F.col("close"), before("close", 5)) - 1).withColumn("s", F.col("volume") / 50 - 0.5)
    return d.select("entity", "date", F.round(F.col("s") * F.signum("roc"), 6).alias("x_roc"), F.round(F.col("s") * F.log1p("volume"), 6).alias("x_vol"))


@query("sf10_seal_strength", "SELECT event_id, round(CASE WHEN event_type = 'click' THEN value * CASE WHEN hour(ts) < 11 THEN 1 WHEN hour(ts) < 14 THEN 0.8 ELSE 0.6 END * power(0.5, user_id % 3) ELSE 0 END, 6) AS seal FROM events")
def seal_strength(spark, sf_dir):
    h = F.hour("ts")
    s = F.col("value") * F.when(h < 11, 1.0).when(h < 14, 0.8).otherwise(0.6) * F.pow(F.lit(0.5), F.col("user_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(F.col("event_type") == "click", s).otherwise(0.0), 6).alias("seal"))
