"""The given tables as inputs of the text-line operators; each uses its whole table and whole texts.

Every input has its DuckDB form beside it, for the oracles.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = " " + "".join(map(chr, range(ord("a"), ord("z") + 1))) + "".join(map(chr, range(ord("A"), ord("Z") + 1))) + ".,"


#: Line ids of a document: more than a text has characters.
LINE_IDS = 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; without one in spark.checkpoint.dir only local mode goes on."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder or tempfile.gettempdir()}/glyphflow-{name}-{uuid.uuid4().hex}"


def pieces(spark: SparkSession, sf_dir: str, size: int, tasks: int = 0) -> DataFrame:
    """(line_id, doc_id, lang, source, text): every document cut into pieces of up to ``size`` characters of a line.

    The documents are dealt to ``tasks`` tasks first, if given: a few large files would leave most cores idle.
    """
    cut = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^\\n]{{1,{size}}}"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    docs = docs.repartition(tasks, "doc_id") if tasks else docs
    docs = docs.select("doc_id", "lang", "source", F.posexplode(cut).alias("pos", "text"))
    return docs.select((F.col("doc_id") * LINE_IDS + F.col("pos")).alias("line_id"), "doc_id", "lang", "source", "text")


def pieces_sql(size: int, name: str = "lines") -> str:
    return f"""{name} AS (SELECT doc_id * {LINE_IDS} + pos AS line_id, doc_id, lang, source, text FROM (
        SELECT doc_id, lang, source, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos
        FROM (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\\n]{{1,{size}}}') AS l FROM documents)))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir, 48)


LINES = pieces_sql(48)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, image, lang, gt, pred, error): ASCII lines, a corrupted prediction by row, and some missing images."""
    rows = lines(spark, sf_dir)
    gt = F.regexp_replace("text", "[^ -~]", "?")
    kind = F.col("line_id") % 3
    pred = F.when(kind == 0, F.col("gt")).when(kind == 1, F.translate("gt", "aeo", "oea")).otherwise(F.regexp_replace("gt", "t", ""))
    lost = F.col("line_id") % 97 == 13
    rows = rows.select(F.col("line_id").alias("task_id"), F.concat(F.lit("img_"), F.col("line_id").cast("string"), F.lit(".png")).alias("image"), "lang", gt.alias("gt"), "line_id")
    return rows.withColumn("pred", F.when(lost, "").otherwise(pred)).withColumn("error", F.when(lost, F.concat(F.lit("image_not_found: "), F.col("image"))).otherwise("")).drop("line_id")


PAIRS = f"""{LINES}, asc_lines AS (SELECT line_id, lang, regexp_replace(text, '[^ -~]', '?', 'g') AS gt FROM lines),
    pairs AS (SELECT line_id AS task_id, 'img_' || line_id || '.png' AS image, lang, gt,
        CASE WHEN line_id % 97 = 13 THEN '' WHEN line_id % 3 = 0 THEN gt WHEN line_id % 3 = 1 THEN translate(gt, 'aeo', 'oea') ELSE replace(gt, 't', '') END AS pred,
        CASE WHEN line_id % 97 = 13 THEN 'image_not_found: img_' || line_id || '.png' ELSE '' END AS error FROM asc_lines),
    measured AS (SELECT *, (gt = pred)::INT AS exact_match, levenshtein(gt, pred) AS levenshtein, length(gt) AS gt_len, length(pred) AS pred_len,
        CASE WHEN length(gt) = 0 THEN (length(pred) = 0)::INT::DOUBLE ELSE greatest(0.0, 1 - levenshtein(gt, pred)::DOUBLE / length(gt)) END AS char_accuracy FROM pairs)"""


def cut_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, cut_scores): the sigmoid of 4 x, to four digits, of every embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), F.transform("embedding", lambda x: F.round(1 / (1 + F.exp(-4 * x.cast("double"))), 4)).alias("cut_scores"))


CUT_SCORES = """sc AS (SELECT vec_id AS line_id, generate_subscripts(embedding, 1) - 1 AS i, round(1 / (1 + exp(-4 * unnest(embedding)::DOUBLE)), 4) AS s FROM embeddings)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, p): every embedding as 8 timesteps of 8 classes."""
    step = lambda t: F.transform(F.slice("embedding", t * 8 + 1, 8), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), step).alias("p"))


LOGITS = """lg AS (SELECT line_id, j // 8 AS t, j % 8 AS c, v FROM (SELECT vec_id AS line_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings))"""

#: Eight classes for the scores made from embeddings.
CLASSES = " ABCDEF"


def orders_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, train_loss, val_loss): event values per type and hour as losses of a training log."""
    ev = table(spark, sf_dir, "events")
    epoch = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))) / 86400)
    per = ev.select("event_type", epoch.alias("day"), "value").groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("val_loss"), F.round(F.min("value"), 6).alias("train_loss"))
    first = per.agg(F.min("day").alias("d0"))
    return per.crossJoin(F.broadcast(first)).select(F.col("event_type").alias("run"), (F.col("day") - F.col("d0")).cast("int").alias("epoch"), "train_loss", "val_loss")


TRAIN_LOG = """per AS (SELECT event_type, floor(epoch(ts) / 86400)::BIGINT AS day, round(avg(value), 6) AS val_loss, round(min(value), 6) AS train_loss FROM events GROUP BY ALL),
    train_log AS (SELECT event_type AS run, (day - (SELECT min(day) FROM per))::INT AS epoch, train_loss, val_loss FROM per)"""
