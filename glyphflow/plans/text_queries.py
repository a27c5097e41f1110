"""Queries on texts: evaluation, audits, sampling, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators import audit, dataset, evaluate, generate, sweep
from glyphflow.sources import labels as L

from . import inputs as I


def _alphabet():
    return F.array(*map(F.lit, I.ALPHABET))


def ocr_eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.report_rows(evaluate.measured(I.pairs(spark, sf)))
    return rows.select("task_id", "exact_match", "char_accuracy", "levenshtein", "gt_len", "pred_len", "error")


def ocr_metrics_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.ocr_metrics(evaluate.measured(I.pairs(spark, sf)), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("line_accuracy", "average_char_accuracy", "global_char_accuracy", "average_levenshtein")})


def prediction_join(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks without a prediction (every fifth) keep the empty text."""
    rows = I.pairs(spark, sf)
    preds = rows.where(F.col("task_id") % 5 != 0).select("task_id", "pred", "error")
    out = evaluate.evaluate(rows.select("task_id", "image", "lang", "gt"), preds, ["lang"])[1]
    return out.select("lang", "total", "recognized", "exact", "total_levenshtein")


def missing_images(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.pairs(spark, sf)
    # At most so many lines: a piece is full, or ends its line.
    most = F.floor(F.length("text") / 48) + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    many = I.table(spark, sf, "documents").agg(F.coalesce(F.sum(most), F.lit(0))).first()[0]
    found = evaluate.mark_missing_images(rows.select("task_id", "image"), rows.where("error = ''").select("image"), many)
    return found.select("task_id", "error")


def seg_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.pairs(spark, sf).select("lang", "error", F.char_length("gt").alias("gt_len"), F.char_length("pred").alias("pred_len"))
    out = evaluate.segmentation_metrics(evaluate.length_errors(rows), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("length_accuracy", "average_abs_length_error", "average_signed_length_error", "normalized_length_error")})


def label_json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a label export, read back from JSON."""
    turns = I.table(spark, sf, "conversations")
    row = F.struct(F.struct(F.when(F.length("text") > 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("text")).alias("value"))
    one = F.struct(F.array(row).alias("result"))
    tasks = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", one.alias("a")))), lambda x: x["a"]).alias("annotations"))
    export = tasks.select(F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(F.concat(F.lit("/up/"), F.col("conv_id").cast("string"), F.lit(".png")).alias("image")).alias("data"), "annotations")).alias("j"))
    return L.flatten_tasks(export.select(F.from_json("j", L.EXPORT).alias("t")).select("t.*"))


def alphabet_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = audit.alphabet_stats(I.lines(spark, sf), audit.alphabet_table(spark, I.ALPHABET))
    return audit.stats_order(stats).select("ch", T.display_char(F.col("ch")).alias("shown"), "n", "in_training_alphabet")


def alphabet_difference(spark: SparkSession, sf: str) -> DataFrame:
    return audit.alphabet_difference(I.lines(spark, sf), audit.alphabet_table(spark, I.ALPHABET))


def unknown_chars(spark: SparkSession, sf: str) -> DataFrame:
    odd = T.unknown_chars(F.col("text"), _alphabet())
    return I.lines(spark, sf).select("line_id", F.array_join(odd, "").alias("unknown"), F.size(odd).cast("long").alias("n_unknown"))


def space_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return I.lines(spark, sf).select("line_id", T.normalise_spaces(F.col("text")).alias("text"))


def char_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Known characters of every line as ids, padded to 48."""
    rows = I.lines(spark, sf).select("line_id", T.only_known("text", I.ALPHABET).alias("t"))
    return rows.select("line_id", F.array_join(T.encode_text(F.col("t"), I.ALPHABET, 48), " ").alias("ids"), F.char_length("t").cast("long").alias("length"))


def text_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.text_summary(I.lines(spark, sf))


def _coverage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    provided = docs.select("source", F.explode(F.array_distinct(T.chars(F.col("text")))).alias("ch"))
    required = I.table(spark, sf, "benchmark").select(F.explode(T.chars(F.lower("text"))).alias("ch")).distinct()
    return docs.select("source"), provided, required


def coverage_missing_top20(spark: SparkSession, sf: str) -> DataFrame:
    return audit.top_missing(audit.missing_required(*_coverage(spark, sf)))


def coverage_accept(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage_report(*_coverage(spark, sf)).select("source", "accepted", "n_missing")


def line_text_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampled line per document, by hash draws."""
    letters = F.array(*map(F.lit, I.ALPHABET.strip()))
    return I.table(spark, sf, "documents").select("doc_id", generate.line_text(F.col("doc_id"), letters, 42).alias("line"))


def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.chunk_manifest(dataset.with_chunks(I.lines(spark, sf), 10 * I.LINE_IDS))


def global_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk (ten documents) and place of each order key, modulo the number of lines, and of its negative."""
    manifest = dataset.chunk_manifest(dataset.with_chunks(I.lines(spark, sf), 10 * I.LINE_IDS))
    total = F.broadcast(manifest.agg(F.max("end").alias("total")))
    keys = I.table(spark, sf, "orders").crossJoin(total).select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % F.col("total")).otherwise(-(F.col("o_orderkey") % F.col("total")) - 1).alias("index"))
    return dataset.lookup(manifest, keys.distinct())


def chunk_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.with_chunks(I.lines(spark, sf).select("line_id"), 10 * I.LINE_IDS)
    return dataset.chunk_batches(rows, 256, 7, drop_last=True).groupBy("chunk_id", "batch").agg(F.count("*").alias("n"), F.min("line_id").alias("least"), F.max("line_id").alias("most"))


def sampled_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.with_chunks(I.lines(spark, sf).select("line_id"), 10 * I.LINE_IDS)
    chunks = dataset.sampled_chunks(spark, dataset.chunk_manifest(rows), 64, 11)
    return dataset.sampled_batches(rows, chunks, 128, 11)


def uniform_batches(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.uniform_batches(spark, I.lines(spark, sf), 64, 128, 5)


def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.exact_split(I.lines(spark, sf).select("line_id"), "line_id", 0.1, 3)


def background_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as crops that need a part of at least their size as background."""
    requests = I.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.col("l_quantity").cast("int").alias("w"), F.col("l_linenumber").cast("int").alias("h"))
    grounds = I.table(spark, sf, "part").select(F.col("p_partkey").alias("b"), F.col("p_size").alias("bw"), (F.col("p_size") % 10).alias("bh"))
    return generate.fitting_backgrounds(requests, grounds, 9).join(grounds, "b", "left").select("line_id", "w", "h", F.col("b").isNotNull().alias("found"), F.coalesce((F.col("bw") >= F.col("w")) & (F.col("bh") >= F.col("h")), F.lit(True)).alias("fits"), F.coalesce("largest", F.lit(0)).alias("largest"))


def epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    from glyphflow.operators.losses import epoch_loss as run

    items = I.table(spark, sf, "lineitem").select("l_returnflag", F.floor(F.col("l_orderkey") / 32).alias("batch"), F.col("l_discount").cast("double").alias("loss"))
    out = run(items, "batch", "loss", ["l_returnflag"])
    return out.select("l_returnflag", F.round("loss", 8).alias("loss"), "batches")


def best_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.plateau(I.orders_as_log(spark, sf), ["run"], 5).select("run", "epoch", "val_loss", "is_best", "best_before", "overfit", F.col("since_best").cast("int").alias("since_best"), "plateau")


def epoch_join(spark: SparkSession, sf: str) -> DataFrame:
    log = I.orders_as_log(spark, sf)
    summary = log.where(F.col("epoch") % 2 == 1).select("run", "epoch", F.col("val_loss").alias("line_accuracy"))
    return sweep.epoch_join(log, summary, ["run"]).select("run", "epoch", "train_loss", "line_accuracy")


def trial_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """A study per language: predictions cut to several lengths are the trials."""
    rows = I.pairs(spark, sf).select("lang", "gt", "pred", "error")
    dealt = sweep.with_trials(rows, sweep.trial_grid(spark, keep=[8, 16, 24, 32, None]), {"keep": 48}).withColumn("pred", F.expr("substr(pred, 1, keep)"))
    metrics = evaluate.ocr_metrics(evaluate.measured(dealt), ["lang", "trial"])
    return sweep.leaderboard(metrics, "average_levenshtein", ["lang"]).select("lang", "trial", F.round("average_levenshtein", 6).alias("average_levenshtein"), "place")


QUERIES = (
    ocr_eval_rows, ocr_metrics_by_lang, prediction_join, missing_images, seg_metrics, label_json_flatten, alphabet_stats, alphabet_difference, unknown_chars,
    space_normalise, char_encode, text_summary, coverage_missing_top20, coverage_accept, line_text_sample, chunk_manifest, global_index_lookup, chunk_batches,
    sampled_batches, uniform_batches, exact_split, background_fit, epoch_loss, best_epochs, epoch_join, trial_leaderboard,
)

_ABC = "alphabet AS (SELECT unnest(str_split('" + I.ALPHABET + "', '')) AS ch, generate_subscripts(str_split('" + I.ALPHABET + "', ''), 1) - 1 AS c)"
_CHARS = "chs AS (SELECT line_id, unnest(l) AS ch, generate_subscripts(l, 1) AS pos FROM (SELECT line_id, str_split(text, '') AS l FROM lines))"
_COVER = """docs AS (SELECT doc_id AS source, coalesce(text, '') AS text FROM documents),
    provided AS (SELECT DISTINCT source, ch FROM (SELECT source, unnest(str_split(text, '')) AS ch FROM docs WHERE text <> '')),
    required AS (SELECT DISTINCT unnest(str_split(lower(text), '')) AS ch FROM benchmark),
    missing AS (SELECT source, ch FROM (SELECT source FROM docs) CROSS JOIN required EXCEPT SELECT source, ch FROM provided)"""
_MANIFEST = f"""counts AS (SELECT line_id // {10 * I.LINE_IDS} AS chunk_id, count(*) AS n FROM lines GROUP BY ALL),
    manifest AS (SELECT chunk_id, n, (sum(n) OVER (ORDER BY chunk_id))::BIGINT AS "end" FROM counts)"""
_METRICS = """count(*) AS total, sum((error = '')::INT)::BIGINT AS recognized, sum(exact_match)::BIGINT AS exact"""


def _draw(seed: int, row: str, draw: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {row} || ':' || {draw}), 1, 8))::BIGINT"


ORACLES = {
    "ocr_eval_rows": f"WITH {I.PAIRS} SELECT task_id, exact_match, round(char_accuracy, 6) AS char_accuracy, levenshtein::INT AS levenshtein, gt_len::INT AS gt_len, pred_len::INT AS pred_len, error FROM measured",
    "ocr_metrics_by_lang": f"""WITH {I.PAIRS} SELECT lang, {_METRICS}, round(avg(exact_match), 6) AS line_accuracy, round(avg(char_accuracy), 6) AS average_char_accuracy,
        round(greatest(0.0, 1 - sum(levenshtein)::DOUBLE / sum(gt_len)), 6) AS global_char_accuracy, round(avg(levenshtein), 6) AS average_levenshtein, sum(levenshtein)::BIGINT AS total_levenshtein FROM measured GROUP BY lang""",
    "prediction_join": f"""WITH {I.PAIRS}, p AS (SELECT lang, gt, CASE WHEN task_id % 5 = 0 THEN '' ELSE pred END AS pred, CASE WHEN task_id % 5 = 0 THEN '' ELSE error END AS error FROM pairs)
        SELECT lang, count(*) AS total, sum((error = '')::INT)::BIGINT AS recognized, sum((gt = pred)::INT)::BIGINT AS exact, sum(levenshtein(gt, pred))::BIGINT AS total_levenshtein FROM p GROUP BY lang""",
    "missing_images": f"WITH {I.PAIRS} SELECT task_id, error FROM pairs",
    "seg_metrics": f"""WITH {I.PAIRS}, e AS (SELECT lang, error, gt_len, pred_len - gt_len AS d FROM measured) SELECT lang, count(*) AS total, count(*) FILTER (error = '') AS evaluated,
        count(*) FILTER (error = '' AND d = 0) AS exact_length, round(count(*) FILTER (error = '' AND d = 0) / count(*) FILTER (error = ''), 6) AS length_accuracy,
        round(avg(abs(d)) FILTER (error = ''), 6) AS average_abs_length_error, (sum(abs(d)) FILTER (error = ''))::BIGINT AS total_abs_length_error,
        round(avg(d) FILTER (error = ''), 6) AS average_signed_length_error, round((sum(abs(d)) FILTER (error = ''))::DOUBLE / (sum(gt_len) FILTER (error = '')), 6) AS normalized_length_error FROM e GROUP BY lang""",
    "label_json_flatten": """SELECT conv_id AS task_id, conv_id || '.png' AS image, coalesce(trim(first(text ORDER BY turn, role, text) FILTER (length(text) > 0), E' \\t\\n\\r'), '') AS gt FROM conversations GROUP BY conv_id""",
    "alphabet_stats": f"""WITH {I.LINES}, {_ABC}, {_CHARS}, n AS (SELECT ch, count(*) AS n FROM chs GROUP BY ch)
        SELECT coalesce(a.ch, n.ch) AS ch, CASE coalesce(a.ch, n.ch) WHEN ' ' THEN '<space>' WHEN chr(9) THEN '<tab>' WHEN chr(10) THEN '<newline>' ELSE coalesce(a.ch, n.ch) END AS shown,
        coalesce(n.n, 0) AS n, (a.ch IS NOT NULL)::INT AS in_training_alphabet FROM alphabet a FULL JOIN n ON a.ch = n.ch""",
    "alphabet_difference": f"""WITH {I.LINES}, {_ABC}, {_CHARS} SELECT ch, 'data_only' AS side FROM (SELECT DISTINCT ch FROM chs EXCEPT SELECT ch FROM alphabet)
        UNION ALL SELECT ch, 'alphabet_only' FROM (SELECT ch FROM alphabet EXCEPT SELECT ch FROM chs)""",
    "unknown_chars": f"""WITH {I.LINES}, {_ABC}, {_CHARS}, u AS (SELECT DISTINCT line_id, ch FROM chs WHERE ch NOT IN (SELECT ch FROM alphabet))
        SELECT l.line_id, coalesce(string_agg(u.ch, '' ORDER BY u.ch), '') AS unknown, count(u.ch) AS n_unknown FROM lines l LEFT JOIN u USING (line_id) GROUP BY l.line_id""",
    "space_normalise": f"WITH {I.LINES} SELECT line_id, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS text FROM lines",
    "char_encode": f"""WITH {I.LINES}, {_ABC}, {_CHARS}, e AS (SELECT line_id, string_agg(c::VARCHAR, ' ' ORDER BY pos) AS ids, count(*) AS n FROM chs JOIN alphabet USING (ch) GROUP BY line_id)
        SELECT l.line_id, CASE WHEN n IS NULL THEN '0' || repeat(' 0', 47) ELSE ids || repeat(' 0', (48 - n)::INT) END AS ids, coalesce(n, 0) AS length FROM lines l LEFT JOIN e USING (line_id)""",
    "text_summary": f"WITH {I.LINES} SELECT count(*) AS samples, max(length(text)) AS max_length FROM lines",
    "coverage_missing_top20": f"WITH {_COVER} SELECT ch, count(*) AS n FROM missing GROUP BY ch ORDER BY n DESC, ch LIMIT 20",
    "coverage_accept": f"WITH {_COVER} SELECT d.source, count(m.ch) = 0 AS accepted, count(m.ch) AS n_missing FROM docs d LEFT JOIN missing m USING (source) GROUP BY d.source",
    "line_text_sample": f"""WITH w AS (SELECT doc_id, unnest(generate_series(1, 6 + {_draw(42, "doc_id", "'0'")} % 13)) AS w FROM documents),
        c AS (SELECT doc_id, w, unnest(generate_series(1, 2 + {_draw(42, "doc_id", "'n.' || w")} % 7)) AS c FROM w),
        ch AS (SELECT doc_id, w, c, substr('{I.ALPHABET.strip()}', (1 + {_draw(42, "doc_id", "'c.' || w || '.' || c")} % {len(I.ALPHABET.strip())})::INT, 1) AS ch FROM c),
        words AS (SELECT doc_id, w, string_agg(ch, '' ORDER BY c) AS word FROM ch GROUP BY ALL) SELECT doc_id, string_agg(word, ' ' ORDER BY w) AS line FROM words GROUP BY doc_id""",
    "chunk_manifest": f"WITH {I.LINES}, {_MANIFEST} SELECT * FROM manifest",
    "global_index_lookup": f"""WITH {I.LINES}, {_MANIFEST}, k AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % t ELSE -(o_orderkey % t) - 1 END AS index FROM orders, (SELECT max("end") AS t FROM manifest)),
        r AS (SELECT index, CASE WHEN index < 0 THEN index + (SELECT max("end") FROM manifest) ELSE index END AS row FROM k)
        SELECT index, chunk_id, row - ("end" - n) AS local FROM r JOIN manifest ON row >= "end" - n AND row < "end\"""",
    "chunk_batches": f"""WITH {I.LINES}, r AS (SELECT line_id, line_id // {10 * I.LINE_IDS} AS chunk_id, row_number() OVER (PARTITION BY line_id // {10 * I.LINE_IDS} ORDER BY md5('7:' || line_id), line_id) - 1 AS rn FROM lines)
        SELECT chunk_id, rn // 256 AS batch, count(*) AS n, min(line_id) AS least, max(line_id) AS most FROM r GROUP BY ALL HAVING count(*) = 256""",
    "sampled_batches": f"""WITH {I.LINES}, {_MANIFEST}, d AS (SELECT b AS batch, floor({_draw(11, "b", "'0'")} / 4294967296.0 * (SELECT max("end") FROM manifest)) AS pt FROM range(64) t(b)),
        p AS (SELECT batch, chunk_id FROM d JOIN manifest ON pt >= "end" - n AND pt < "end"),
        r AS (SELECT batch, line_id, row_number() OVER (PARTITION BY batch ORDER BY md5('11:' || batch || ':' || line_id), line_id) - 1 AS rn, count(*) OVER (PARTITION BY batch) AS n FROM p JOIN lines ON line_id // {10 * I.LINE_IDS} = chunk_id)
        SELECT batch, unnest(generate_series(rn, 127, least(n, 128))) AS place, line_id FROM r WHERE rn < 128""",
    "uniform_batches": f"""WITH {I.LINES} SELECT id // 128 AS batch, id % 128 AS place, floor({_draw(5, "id", "'0'")} / 4294967296.0 * (SELECT count(*) FROM lines))::BIGINT AS index FROM range(8192) t(id)""",
    "exact_split": f"""WITH {I.LINES} SELECT line_id, CASE WHEN row_number() OVER (ORDER BY md5('3:' || line_id), line_id) <= greatest(1, floor((SELECT count(*) FROM lines) * 0.1)) THEN 'val' ELSE 'train' END AS split FROM lines""",
    "background_fit": """WITH g AS (SELECT p_partkey AS b, p_size AS bw, p_size % 10 AS bh FROM part), r AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_quantity::INT AS w, l_linenumber::INT AS h FROM lineitem),
        s AS (SELECT w, h, (SELECT count(*) FROM g WHERE bw >= w AND bh >= h) > 0 AS found FROM (SELECT DISTINCT w, h FROM r))
        SELECT line_id, w, h, found, true AS fits, CASE WHEN NOT found THEN (SELECT b FROM g ORDER BY bw DESC, bh DESC, b DESC LIMIT 1) ELSE 0 END AS largest FROM r JOIN s USING (w, h)""",
    "epoch_loss": """WITH m AS (SELECT l_returnflag, l_orderkey // 32 AS batch, avg(l_discount::DOUBLE) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(avg(m), 8) AS loss, count(*) AS batches FROM m GROUP BY ALL""",
    "best_epochs": f"""WITH {I.TRAIN_LOG}, b AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM train_log),
        f AS (SELECT run, epoch, val_loss, coalesce(val_loss < best_before, true)::INT AS is_best, best_before, (train_loss < 0.7 * val_loss)::INT AS overfit FROM b),
        s AS (SELECT *, epoch - max(CASE WHEN is_best = 1 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since_best FROM f) SELECT *, (since_best >= 5)::INT AS plateau FROM s""",
    "epoch_join": f"""WITH {I.TRAIN_LOG} SELECT a.run, a.epoch, a.train_loss, b.val_loss AS line_accuracy FROM train_log a LEFT JOIN (SELECT * FROM train_log WHERE epoch % 2 = 1) b ON a.run = b.run AND a.epoch = b.epoch - 1""",
    "trial_leaderboard": f"""WITH {I.PAIRS}, t AS (SELECT * FROM (VALUES (0, 8), (1, 16), (2, 24), (3, 32), (4, 48)) v(trial, keep)),
        m AS (SELECT lang, trial::BIGINT AS trial, sum(levenshtein(gt, substr(pred, 1, keep)))::DOUBLE / count(*) AS a FROM pairs, t GROUP BY ALL)
        SELECT lang, trial, round(a, 6) AS average_levenshtein, row_number() OVER (PARTITION BY lang ORDER BY a, trial) AS place FROM m""",
}
