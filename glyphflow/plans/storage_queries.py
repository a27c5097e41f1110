"""Queries on storing, listing, checking and drawing lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import cuts as C
from glyphflow.functions import labels as LB
from glyphflow.functions import scores as S
from glyphflow.functions import text as T
from glyphflow.operators import dataset, evaluate, generate, losses
from glyphflow.sources import labels as L
from glyphflow.sources import sinks

from . import inputs as I
from .score_queries import _PEAKS
from .text_queries import _ABC, _CHARS, _alphabet, _draw

SIZES = (24, 32, 48, 64)
_CHUNK = 100 * I.LINE_IDS


def central_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The scored part of the intervals between peaks."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), S.peaks(F.col("cut_scores"), 0.5), F.array(F.size("cut_scores")))))
    rows = I.cut_scores(spark, sf).select("line_id", F.explode(C.pairs(cuts)).alias("p"))
    rows = rows.withColumn("c", C.central_span(F.col("p.start"), F.col("p.end"), 0.6, 1))
    return rows.select("line_id", F.col("p.start").alias("start"), F.col("c.start").alias("first"), F.col("c.end").alias("last"))


def text_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Why lines can't be labels of at most 40 characters."""
    return I.lines(spark, sf).select("line_id", T.text_problem(F.col("text"), _alphabet(), 40).alias("problem"))


def row_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws keyed by seed and row."""
    row = F.col("line_id")
    return I.lines(spark, sf).select("line_id", T.hash_draw(42, row, 0).alias("draw"), F.round(T.hash_uniform(42, row, "s"), 9).alias("share"))


def line_styles(spark: SparkSession, sf: str) -> DataFrame:
    """D3."""
    drawn = I.lines(spark, sf).select("line_id", generate.style(F.col("line_id"), 42).alias("s"))
    return drawn.select("line_id", F.round("s.spacing", 6).alias("spacing"), F.round("s.word_factor", 6).alias("word_factor"))


def short_text_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A text per document; the first of four tries with at most six characters, or none."""
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", generate.short_text(F.col("doc_id"), _alphabet(), 42, (2, 9), lambda t: F.char_length(t) <= 6).alias("text"))


def layout_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a piece of text fits into 64 columns with a padding of four."""
    rows = I.pieces(spark, sf, 12)
    spans = LB.glyph_layout(T.chars(F.col("text")), generate.advances(F.col("text")), F.lit(0.0), F.lit(1.0), F.lit(4.0))
    return rows.withColumn("spans", spans).select("line_id", generate.fits(F.col("spans"), 64, 4).alias("fits"))


def font_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A drawn size that leaves a line room, else the smallest."""
    rows = I.lines(spark, sf)
    return rows.select("line_id", generate.font_choice(F.col("line_id"), list(SIZES), F.char_length("text") * 0.5, F.lit(600.0), 7).alias("size"))


def neighbour_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Where the lines above and below begin, -1000 without one."""
    laid = I.lines(spark, sf).select("line_id", generate.neighbour_layout(F.col("line_id"), 5, F.lit(48), F.lit(24)).alias("n"))
    return laid.select("line_id", F.coalesce(F.col("n.above").cast("long"), F.lit(-1000)).alias("above"), F.coalesce(F.col("n.below").cast("long"), F.lit(-1000)).alias("below"))


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Spans without leading, doubled and trailing spaces."""
    rows = I.pieces(spark, sf, 12)
    rows = rows.withColumn("spans", F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (i * 6.0 + 2).alias("x0"), (i * 6.0 + 8).alias("x1"))))
    return generate.cleaned(rows).select("line_id", "text", F.size("spans").alias("n"), F.get("spans", F.lit(0))["x0"].alias("x0"))


def chunk_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stored as their bytes, with targets that are sometimes one short or one long."""
    w, row = F.char_length("text"), F.col("line_id")
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    rows = I.lines(spark, sf).select(
        w.alias("w"), F.lit(1).alias("h"), F.lit(1).alias("c"), F.encode("text", "UTF-8").alias("pixels"), zeros(w - (row % 3 == 0).cast("int")).alias("dense"),
        zeros(w + (row % 7 == 0).cast("int")).alias("cut"), F.when(row % 2 == 0, zeros(2 * w + (row % 11 == 0).cast("int"))).alias("baseline"),
    )
    return dataset.chunk_faults(rows)


def chunk_specs(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.chunk_specs(spark, I.lines(spark, sf).count(), 1024)


def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata record of all lines, read back; a chunk is a hundred documents."""
    made = dataset.metadata(dataset.with_chunks(I.lines(spark, sf), _CHUNK), {"format": "lines", "space_char": " "})
    read = F.from_json("metadata", "format string, space_char string, samples long, chunk_count long, chunks array<struct<chunk_id:long, samples:long>>")
    rows = made.select(read.alias("m")).select("m.format", "m.space_char", F.col("m.samples").alias("total"), "m.chunk_count", F.explode("m.chunks").alias("c"))
    return rows.select("format", "space_char", "total", "chunk_count", "c.chunk_id", "c.samples")


def dataset_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stored by chunk and read back."""
    path = I.scratch(spark, "dataset")
    sinks.write_dataset(I.lines(spark, sf).select("line_id", "text"), path, _CHUNK)
    return spark.read.parquet(path).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def stored_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of a stored dataset, normalised; how often each occurs."""
    path = I.scratch(spark, "texts")
    sinks.write_dataset(I.lines(spark, sf).select("line_id", "text"), path, _CHUNK)
    return L.read_texts(spark, path).select(T.normalise_spaces(F.col("text")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The report of all lines, written and read back."""
    path = I.scratch(spark, "report")
    columns = ("task_id", "exact_match", "char_accuracy", "levenshtein", "gt_len", "pred_len", "error")
    sinks.write_csv(evaluate.report_rows(evaluate.measured(I.pairs(spark, sf))), columns, path)
    read = spark.read.option("header", True).schema("task_id long, exact_match int, char_accuracy double, levenshtein int, gt_len int, pred_len int, error string").csv(path)
    return read.withColumn("error", F.coalesce("error", F.lit("")))


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts of a log appended with fixed decimals, read back as text."""
    path, log = I.scratch(spark, "log"), I.orders_as_log(spark, sf)
    for part in (0, 1):
        sinks.append_log(log.where(F.col("epoch") % 2 == part), {"train_loss": "%.8f", "val_loss": "%.8f"}, path)
    return spark.read.option("header", True).option("sep", "\t").schema("run string, epoch int, train_loss string, val_loss string").csv(path)


def sample_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """S17."""
    return sinks.sample_json(I.table(spark, sf, "documents"), ["doc_id", "lang", "source", "n_chars"]).select("doc_id", "metadata")


def previews(spark: SparkSession, sf: str) -> DataFrame:
    """The first three lines of each part with their target."""
    rows = I.cut_scores(spark, sf).select((F.col("line_id") % 10).alias("part"), "line_id", F.col("cut_scores").alias("cut"), F.lit(None).cast("array<int>").alias("dense"), F.lit("").alias("text"))
    return dataset.preview(rows, 3, ["part"], [F.col("line_id")]).select("part", "line_id", "shown")


def path_union(spark: SparkSession, sf: str) -> DataFrame:
    """Listed paths and explicit ones, without repeats."""
    paths = I.table(spark, sf, "documents").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), "doc_id")
    return L.union_paths(paths.select("path").unionByName(paths.where("doc_id % 5 = 0").select("path")), paths.where("doc_id % 3 = 0").select("path"))


def baseline_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as maps of two channels of 4 x 8, against targets of 2 x 4 that are made larger."""
    rows = I.table(spark, sf, "embeddings").select(F.col("label").alias("part"), F.col("vec_id").alias("line_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.join(I.cut_scores(spark, sf), "line_id").withColumn("t", losses.resized_maps(F.slice("cut_scores", 1, 16), (2, 2, 4), (4, 8)))
    out = losses.mean_over_columns(rows.withColumn("l", losses.projection_loss(F.col("x"), F.col("t"), "mse", 3.0)), "l", ["part"])
    return out.select("part", F.round("loss", 6).alias("loss"), "n")


QUERIES = (
    central_spans, text_problems, row_draws, line_styles, short_text_sample, layout_fit, font_sizes, neighbour_lines, clean_lines, chunk_faults, chunk_specs,
    dataset_manifest, dataset_roundtrip, stored_texts, report_csv, training_log, sample_metadata, previews, path_union, baseline_loss,
)


def _share(seed: int, row: str, draw: str) -> str:
    return f"({_draw(seed, row, draw)} / 4294967296.0::DOUBLE)"


_SHOWN = "CASE ch WHEN ' ' THEN '<space>' WHEN chr(9) THEN '<tab>' WHEN chr(10) THEN '<newline>' ELSE ch END"
_SAFE = I.ALPHABET.replace("'", "''")
_P12 = I.pieces_sql(12)

ORACLES = {
    "central_spans": f"""WITH {_PEAKS}, b AS (SELECT line_id, i FROM pk UNION SELECT line_id, 0 FROM ids UNION SELECT line_id, 64 FROM ids),
        v AS (SELECT line_id, i AS a, lead(i) OVER (PARTITION BY line_id ORDER BY i) AS e FROM b), w AS (SELECT *, greatest(1, least(e - a, greatest(1, round_even((e - a) * 0.6::DOUBLE, 0)::INT))) AS p FROM v WHERE e IS NOT NULL),
        f AS (SELECT *, greatest(a, least(e - p, round_even((a + e) * 0.5::DOUBLE - p * 0.5::DOUBLE, 0)::INT)) AS s FROM w)
        SELECT line_id, a::INT AS start, (CASE WHEN e - a <= 1 THEN a ELSE s END)::INT AS first, (CASE WHEN e - a <= 1 THEN e ELSE s + p END)::INT AS last FROM f""",
    "text_problems": f"""WITH {I.LINES}, {_ABC}, {_CHARS}, u AS (SELECT DISTINCT line_id, ch FROM chs WHERE ch NOT IN (SELECT ch FROM alphabet)), o AS (SELECT line_id, list({_SHOWN} ORDER BY ch) AS l FROM u GROUP BY line_id)
        SELECT line_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN l IS NOT NULL THEN 'unknown: ' || array_to_string(l[1:24], ', ') || CASE WHEN len(l) > 24 THEN ' +' || (len(l) - 24) ELSE '' END
        WHEN length(text) > 40 THEN 'too long' ELSE '' END AS problem FROM lines LEFT JOIN o USING (line_id)""",
    "row_draws": f"""WITH {I.LINES} SELECT line_id, {_draw(42, "line_id", "'0'")} AS draw, round({_share(42, "line_id", "'s'")}, 9) AS share FROM lines""",
    "line_styles": f"""WITH {I.LINES} SELECT line_id, round({_share(42, "line_id", "'s'")} * 2.0 - 0.4, 6) AS spacing, round({_share(42, "line_id", "'w'")} * 0.95 + 0.75, 6) AS word_factor FROM lines""",
    "short_text_sample": f"""WITH k AS (SELECT doc_id, k, 2 + {_draw(42, "doc_id", "'l' || k")} % 8 AS n FROM documents, range(4) t(k)), c AS (SELECT doc_id, k, unnest(generate_series(1, n)) AS c FROM k),
        ch AS (SELECT doc_id, k, c, substr('{_SAFE}', (1 + {_draw(42, "doc_id", "'t' || k || '.' || c")} % {len(I.ALPHABET)})::INT, 1) AS ch FROM c),
        t AS (SELECT doc_id, k, trim(regexp_replace(string_agg(ch, '' ORDER BY c), ' +', ' ', 'g'), ' ') AS t FROM ch GROUP BY ALL),
        f AS (SELECT doc_id, arg_min(t, k) AS text FROM t WHERE length(t) BETWEEN 1 AND 6 GROUP BY doc_id) SELECT d.doc_id, f.text FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""",
    "layout_fit": f"""WITH {_P12}, c AS (SELECT line_id, unnest(str_split(text, '')) AS ch FROM lines) SELECT line_id, sum(CASE WHEN ch = ' ' OR instr('.,:;!|il''', ch) > 0 THEN 4.0 ELSE 6.0 END) <= 56 AS fits FROM c GROUP BY line_id""",
    "font_sizes": f"""WITH {I.LINES}, k AS (SELECT line_id, {" + ".join(f"({s} * length(text) * 0.5 <= 600)::INT" for s in SIZES)} AS k FROM lines)
        SELECT line_id, (CASE WHEN k = 0 THEN {SIZES[0]} ELSE [{", ".join(map(str, SIZES))}][(1 + {_draw(7, "line_id", "'font'")} % greatest(k, 1))::INT] END)::INT AS size FROM k""",
    "neighbour_lines": f"""WITH {I.LINES}, d AS (SELECT line_id, {", ".join(f"{_share(5, 'line_id', repr('p' + s))} < 0.7 AS on_{s}, greatest(1, floor(24 * (0.1::DOUBLE + {_share(5, 'line_id', repr('v' + s))} * (0.4::DOUBLE - 0.1::DOUBLE)))) AS seen_{s}, 1 + {_draw(5, 'line_id', repr('g' + s))} % 4 AS gap_{s}" for s in "ab")} FROM lines)
        SELECT line_id, (CASE WHEN on_a AND 12 - gap_a > 0 THEN least(seen_a, 12 - gap_a) - 24 ELSE -1000 END)::BIGINT AS above, (CASE WHEN on_b AND greatest(48 - seen_b, 36 + gap_b) < 48 THEN greatest(48 - seen_b, 36 + gap_b) ELSE -1000 END)::BIGINT AS below FROM d""",
    "clean_lines": f"""WITH {_P12}, t AS (SELECT line_id, text AS raw, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS text FROM lines)
        SELECT line_id, text, length(text)::INT AS n, CASE WHEN text <> '' THEN (length(raw) - length(ltrim(raw, ' '))) * 6.0::DOUBLE + 2 END AS x0 FROM t""",
    "chunk_faults": f"""WITH {I.LINES}, f AS (SELECT unnest(list_filter([CASE WHEN strlen(text) <> length(text) THEN 'pixels' END, CASE WHEN line_id % 3 = 0 THEN 'dense' END, CASE WHEN line_id % 7 = 0 THEN 'cut' END,
        CASE WHEN line_id % 22 = 0 THEN 'baseline' END], lambda x: x IS NOT NULL)) AS fault FROM lines) SELECT fault, count(*) AS n FROM f GROUP BY fault""",
    "chunk_specs": f"""WITH {I.LINES}, t AS (SELECT count(*) AS n FROM lines) SELECT k AS chunk_id, k * 1024 AS start, least((k + 1) * 1024, n) AS "end" FROM t, range(10000000) r(k) WHERE k * 1024 < n""",
    "dataset_manifest": f"""WITH {I.LINES}, c AS (SELECT line_id // {_CHUNK} AS chunk_id, count(*) AS samples FROM lines GROUP BY ALL)
        SELECT 'lines' AS format, ' ' AS space_char, (SELECT sum(samples) FROM c)::BIGINT AS total, (SELECT count(*) FROM c) AS chunk_count, chunk_id, samples FROM c""",
    "dataset_roundtrip": f"WITH {I.LINES} SELECT line_id // {_CHUNK} AS chunk_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM lines GROUP BY ALL",
    "stored_texts": f"WITH {I.LINES}, t AS (SELECT trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS text FROM lines) SELECT text, count(*) AS n FROM t GROUP BY text",
    "report_csv": f"WITH {I.PAIRS} SELECT task_id, exact_match, round(char_accuracy, 6) AS char_accuracy, levenshtein::INT AS levenshtein, gt_len::INT AS gt_len, pred_len::INT AS pred_len, error FROM measured",
    "training_log": f"WITH {I.TRAIN_LOG} SELECT run, epoch, printf('%.8f', train_loss) AS train_loss, printf('%.8f', val_loss) AS val_loss FROM train_log",
    "sample_metadata": """SELECT doc_id, '{"doc_id":' || doc_id || coalesce(',"lang":"' || lang || '"', '') || coalesce(',"source":"' || source || '"', '') || coalesce(',"n_chars":' || n_chars, '') || '}' AS metadata FROM documents""",
    "previews": f"""WITH {I.CUT_SCORES}, a AS (SELECT line_id, count(*) FILTER (s > 0.5) AS k, count(*) AS n, max(s) AS m FROM sc GROUP BY line_id), r AS (SELECT *, line_id % 10 AS part, row_number() OVER (PARTITION BY line_id % 10 ORDER BY line_id) AS rn FROM a)
        SELECT part, line_id, '<cut_projection peaks=' || k || '/' || n || ' max=' || round(m::DECIMAL(10, 4), 3)::DECIMAL(6, 3)::VARCHAR || '>' AS shown FROM r WHERE rn <= 3""",
    "path_union": "SELECT DISTINCT 'img_' || doc_id || '.png' AS path FROM documents",
    "baseline_loss": f"""WITH {I.CUT_SCORES}, e AS (SELECT vec_id AS line_id, label AS part, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
        p AS (SELECT *, k // 32 AS ch, greatest(0, least(1, ((k % 32) // 8 + 0.5::DOUBLE) * 2 / 4 - 0.5)) AS sy, greatest(0, least(3, (k % 8 + 0.5::DOUBLE) * 4 / 8 - 0.5)) AS sx FROM e),
        t AS (SELECT p.line_id, part, k, x, sum(s * greatest(0, 1 - abs(sy - (i % 8) // 4)) * greatest(0, 1 - abs(sx - i % 4))) AS t FROM p JOIN sc ON sc.line_id = p.line_id AND i // 8 = ch AND i < 16 GROUP BY ALL)
        SELECT part, round(avg((1 / (1 + exp(-x)) - t) * (1 / (1 + exp(-x)) - t) * (1 + 2 * t)), 6) AS loss, count(*) AS n FROM t GROUP BY part""",
}
