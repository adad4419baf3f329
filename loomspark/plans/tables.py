"""Stand-ins for the pipeline's inputs, made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.functions.scalars import human_target
from loomspark.operators.corpus import text_keys, with_text_keys
from loomspark.operators.scoring import linear_head

FILTERS, JUDGES = 3, 3
LOW, HIGH, TARGET = 56, 1210, 100_000


def corpus(spark, sf: str) -> DataFrame:
    """row_id, text, token_count, digest of every document."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text", "source")
    return with_text_keys(d, F.col("text"))


def keys(spark, sf: str) -> DataFrame:
    """row_id, token_count, digest of every document; the texts are read once."""
    return text_keys(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text"))


def in_order(df: DataFrame, files: int = 16) -> DataFrame:
    """``df`` in ranges of row_id, each in order, so that the order of its files is that of its rows."""
    return df.repartitionByRange(files, "row_id").sortWithinPartitions("row_id")


def shards(spark, sf: str) -> str:
    """A folder with the documents' texts in ordered Parquet files."""
    path = runtime.new_path(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    in_order(docs).select("text").write.parquet(path)
    return path


def exclusions(spark, sf: str) -> DataFrame:
    """Two exclusion files: the documents of one source, and the benchmark."""
    a = spark.read.parquet(f"{sf}/documents.parquet").where("source = 'src3'").select(F.lit("src3").alias("file"), "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit("benchmark").alias("file"), "text")
    return text_keys(a.unionByName(b))


def layout(spark) -> DataFrame:
    return spark.createDataFrame([(f * JUDGES + j, f"f{f}", f"m{j}") for f in range(FILTERS) for j in range(JUDGES)], "idx int, filter string, model string")


def ratings(spark, sf: str) -> DataFrame:
    """Long ratings by a fixed recipe on the document id; some are absent."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"))
    x = d.crossJoin(F.broadcast(spark.range(FILTERS).select(F.col("id").alias("f")).crossJoin(spark.range(JUDGES).select(F.col("id").alias("j")))))  # nine rows
    r = F.least(F.lit(10), F.greatest(F.lit(0), (F.col("row_id") * 7 + F.col("f") * 3) % 11 + (F.col("j") - 1) * ((F.col("row_id") * 5 + F.col("f")) % 4)))
    x = x.where((F.col("row_id") + F.col("f") + F.col("j")) % 37 != 0)
    return x.select("row_id", F.concat(F.lit("f"), "f").alias("filter"), F.concat(F.lit("m"), "j").alias("model"), F.lit(0).cast("long").alias("pos"), r.cast("long").alias("rating"))


def human(spark, sf: str) -> DataFrame:
    """(row_id, filter, label, target) of every labelled document."""
    x = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("row_id"), "quality", "toxic", (F.floor(F.col("doc_id") / 4) % 2).cast("int").alias("third"))
    x = x.unpivot(["row_id"], ["quality", "toxic", "third"], "name", "label")
    x = x.withColumn("filter", F.when(F.col("name") == "quality", "f0").when(F.col("name") == "toxic", "f1").otherwise("f2")).drop("name")
    return x.withColumn("target", human_target(F.col("label")).cast("double"))


def hand(spark, sf: str) -> DataFrame:
    """(ann_id, text) of every labelled document."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").join(d, "doc_id").select(F.col("doc_id").alias("ann_id"), "text")


def logits(spark, sf: str) -> DataFrame:
    """(row_id, filter, judge, logit) of nine linear heads on the embeddings."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    heads = [(f"f{t // JUDGES}", f"m{t % JUDGES}", [((t * 31 + d * 17) % 13 - 6) / 8.0 for d in range(64)]) for t in range(FILTERS * JUDGES)]
    w = spark.createDataFrame(heads, "filter string, judge string, w array<double>")
    return e.crossJoin(F.broadcast(w)).select("row_id", "filter", "judge", linear_head(F.col("embedding"), F.col("w")).alias("logit"))  # nine rows


def training_log(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))


def judge(prompt: str, model: str) -> str:
    """A judge that needs no network: its rating follows from the prompt's length and the model's name."""
    rating = (len(prompt) + sum(map(ord, model))) % 11
    return f"<rating>{rating}</rating>\n<explanation>{model} read it.</explanation>\n<quote></quote>"


TARGETS = [f"f{f}::m{j}" for f in range(FILTERS) for j in range(JUDGES)]


def encoder():
    """An encoder that needs no weights: counts of characters by code modulo 16, and a head for each target."""
    import numpy as np

    heads = np.array([[(t * 31 + d * 17) % 13 - 6 for d in range(16)] for t in range(len(TARGETS))])

    def score(texts: list[str]) -> list:
        out = []
        for text in texts:
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            logit = heads @ np.bincount(codes % 16, minlength=16) / max(1, len(codes))
            out.append(1 / (1 + np.exp(-logit)))
        return out

    return score


_CLASS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_CLASS}', ' ', 'g'))"


def _keys(cols: str, source: str) -> str:
    return f"SELECT {cols}, text, sha256(n) AS digest, (CASE WHEN n = '' THEN 0 ELSE length(n) - length(replace(n, ' ', '')) + 1 END)::BIGINT AS token_count FROM (SELECT *, {_norm('text')} AS n FROM {source})"


#: The same tables as SQL, put before each query's SQL.
WITH = f"""WITH corpus AS ({_keys('doc_id AS row_id, source', 'documents')}),
exclusions AS ({_keys('file', "(SELECT 'src3' AS file, text FROM documents WHERE source = 'src3' UNION ALL SELECT 'benchmark', text FROM benchmark)")}),
pairs AS (SELECT f, j FROM range(3) a(f), range(3) b(j)),
layout AS (SELECT (f * 3 + j)::INT AS idx, 'f' || f AS filter, 'm' || j AS model FROM pairs),
ratings AS (SELECT doc_id AS row_id, 'f' || f AS filter, 'm' || j AS model, least(10, greatest(0, (doc_id * 7 + f * 3) % 11 + (j - 1) * ((doc_id * 5 + f) % 4)))::BIGINT AS rating
  FROM documents, pairs WHERE (doc_id + f + j) % 37 <> 0),
human AS (SELECT doc_id AS row_id, filter, label, (CASE WHEN label <= 1 THEN label * 10 ELSE label END)::DOUBLE AS target FROM (
  SELECT doc_id, 'f0' AS filter, quality AS label FROM labels UNION ALL SELECT doc_id, 'f1', toxic FROM labels UNION ALL SELECT doc_id, 'f2', ((doc_id // 4) % 2)::INT FROM labels)),
hand AS (SELECT doc_id AS ann_id, text FROM labels JOIN documents USING (doc_id)),
heads AS (SELECT f, j, [(((f * 3 + j) * 31 + d * 17) % 13 - 6) / 8.0::DOUBLE FOR d IN range(64)] AS w FROM pairs),
logits AS (SELECT vec_id AS row_id, 'f' || f AS filter, 'm' || j AS judge, list_sum([embedding[k + 1]::DOUBLE * w[k + 1] FOR k IN range(64)]) AS logit FROM embeddings, heads),
coded AS (SELECT row_id, greatest(1, length(text)) AS chars, [len(list_filter(codes, lambda c: c % 16 = d)) FOR d IN range(16)] AS counts FROM (SELECT row_id, text, [ord(c) FOR c IN string_split(text, '') IF c <> ''] AS codes FROM corpus)),
encoded AS (SELECT row_id, 'f' || f AS filter, 'm' || j AS judge, (1 / (1 + exp(-(list_sum([counts[k + 1] * (((f * 3 + j) * 31 + k * 17) % 13 - 6) FOR k IN range(16)])::BIGINT / chars::DOUBLE))))::FLOAT::DOUBLE AS p FROM coded, pairs),
log AS (SELECT event_id + 1 AS step, value AS loss FROM events),
scores AS (SELECT row_id, filter, count(*) AS n, round(sum(rating) / count(*), 9) AS mean, max(rating)::DOUBLE AS most,
  round((count(*) * sum(rating * rating) - sum(rating) * sum(rating))::DOUBLE / (count(*) * count(*)), 9) AS variance, (max(rating) - min(rating))::BIGINT AS spread FROM ratings GROUP BY ALL),
matched AS (SELECT ann_id, coalesce(e, s) AS row_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'prefix' END AS how FROM hand
  LEFT JOIN (SELECT text, min(row_id) AS e FROM corpus GROUP BY text) x USING (text)
  LEFT JOIN (SELECT left(text, 200) AS p, min(row_id) AS s FROM corpus GROUP BY 1) y ON y.p = left(hand.text, 200)),
eligible AS (SELECT row_id, token_count, digest, sum(token_count) OVER (ORDER BY row_id) AS cum FROM (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY row_id) AS nth FROM corpus WHERE token_count BETWEEN {LOW} AND {HIGH} AND digest NOT IN (SELECT digest FROM exclusions)) WHERE nth = 1)
"""
