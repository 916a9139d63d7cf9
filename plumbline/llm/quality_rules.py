"""Quality rules with thresholds that adapt to each language and source.

Built-in functions only. Every text gives counts (words, symbols, repeated lines, words in repeated eight-word windows)
and four ratios as whole numbers. A quantile sketch holds how many documents lie in each bucket of a ratio; buckets are
exact below 32 and have five leading bits beyond, so a quantile is right to within 1/32. Sketches merge by adding their
counts: those of a language and source add up to that of the language and to that of all. A group's upper and lower
fences are its quartiles plus or minus three quartile ranges (at least a fixed slack); groups with few documents take
the fences of their language, or of all. Documents then meet the fences by a join on language and source.

Nulls and edge cases: a null or empty text has no words and fails the base rule. A null language or source is a group
like any other. Repeated rows each count. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.shared import SPACE_CLASS, SPACES, columns, stored

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Parts of a whole in which the ratios are counted, and the least distance of a fence from its quartile. Word length
#: is in hundredths of a character.
SCALE = 10_000
SLACK = {"symbols": 500, "dup_lines": 5_000, "repeats": 2_500, "word_length": 200}
#: Only these have a lower fence too.
TWO_SIDED = ("word_length",)
RANGES = 3
#: Documents that a group needs for fences of its own.
LEAST_DOCUMENTS = 100
#: Buckets below 2 ** LEAD are exact; beyond, LEAD bits lead.
LEAD = 5


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    rows = columns(docs, doc_id="long", text="string", lang="string", source="string")
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    no_words = F.array().cast("array<string>")
    split = rows.select(
        "doc_id",
        "lang",
        "source",
        F.when(trimmed == "", no_words).otherwise(F.split(trimmed, SPACE_CLASS)).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # A window's hash chains those of its words; an array position past the end never occurs.
    chained = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - WINDOW),
        lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(WINDOW))),
    )
    windows = counted.withColumn(
        "windows", F.when(F.size("hashes") >= WINDOW, chained).otherwise(F.array().cast("array<bigint>"))
    ).drop("hashes")
    # Sorting is only for texts that repeat a window at all.
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = windows.withColumn("ordered", F.when(repeats, numbered).otherwise(nothing)).drop("windows")

    def again(x: Column, k: Column) -> Column:
        near = [F.get("ordered", F.greatest(k - 1, F.lit(0))), F.get("ordered", k + 1)]
        before = (k > 0) & (near[0]["h"] == x["h"])
        return F.struct(x["i"].alias("i"), (before | F.coalesce(near[1]["h"] == x["h"], F.lit(False))).alias("again"))

    at = F.sort_array(
        F.transform(F.filter(F.transform("ordered", again), lambda x: x["again"]), lambda x: x["i"])
    )
    found = ordered.withColumn("at", at).drop("ordered")
    covered = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", total).drop("at")


def base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    return (F.col("n_words") < LEAST_WORDS) | repeated


def with_ratios(counts: DataFrame) -> DataFrame:
    def ratio(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{scale} * {part} div {whole}")).otherwise(F.lit(0).cast("long"))

    return counts.select(
        "*",
        ratio("n_symbols", "word_chars", SCALE).alias("symbols"),
        ratio("n_dup_lines", "n_lines", SCALE).alias("dup_lines"),
        ratio("n_repeat_words", "n_words", SCALE).alias("repeats"),
        ratio("word_chars", "n_words", 100).alias("word_length"),
    )


def sketches(ratios: DataFrame) -> DataFrame:
    """Documents in each bucket of each ratio, per language and source; texts under the least number of words don't
    count."""
    values = F.array(*(F.struct(F.lit(m).alias("ratio"), F.col(m).alias("v")) for m in SLACK))
    spread = (
        ratios.where(F.col("n_words") >= LEAST_WORDS)
        .select("lang", "source", F.explode(values).alias("x"))
        .select("lang", "source", "x.ratio", "x.v")
    )
    shift = F.expr(f"greatest(0, length(bin(v)) - {LEAD + 1})").cast("int")
    bucket = F.expr("cast(shiftleft(shiftright(v, s), s) as bigint)")
    cut = spread.withColumn("s", shift).select("lang", "source", "ratio", bucket.alias("bucket"))
    return cut.groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """Lower and upper fence of each ratio for each language and source that the sketches know.

    Merged sketches stand at three levels: language and source (2), language (1), all (0).
    """
    everything = F.lit(None).cast("string")

    def merged(level: int, lang: Column, source: Column) -> DataFrame:
        keys = [F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"), "ratio", "bucket"]
        return sketch.groupBy(*keys).agg(F.sum("n").alias("n"))

    levels = (
        merged(2, F.col("lang"), F.col("source"))
        .unionByName(merged(1, F.col("lang"), everything))
        .unionByName(merged(0, everything, everything))
    )
    group = W.partitionBy("level", "lang", "source", "ratio")
    running = levels.withColumns(
        {
            "so_far": F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)),
            "total": F.sum("n").over(group),
        }
    )

    def quartile(k: int) -> Column:
        return F.min(F.when(4 * F.col("so_far") >= k * F.col("total"), F.col("bucket")))

    quartiles = running.groupBy("level", "lang", "source", "ratio").agg(
        F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))[F.col("ratio")]
    reach = F.greatest(slack.cast("long"), RANGES * (F.col("q3") - F.col("q1")))
    low = F.when(F.col("ratio").isin(*TWO_SIDED), F.col("q1") - reach).otherwise(F.lit(0).cast("long"))
    per_group = quartiles.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("ratio") == m, low)).alias(f"low_{m}") for m in SLACK),
        *(F.max(F.when(F.col("ratio") == m, F.col("q3") + reach)).alias(f"high_{m}") for m in SLACK),
    )
    names = ["total", *(f"{side}_{m}" for m in SLACK for side in ("low", "high"))]

    def level(k: int, *keys: str) -> DataFrame:
        return per_group.where(F.col("level") == k).select(
            *(F.col(c).alias(f"{c}_{k}") for c in keys), F.struct(*names).alias(f"f{k}")
        )

    own, by_lang = level(2, "lang", "source"), level(1, "lang")
    joined = own.join(by_lang, own.lang_2.eqNullSafe(by_lang.lang_1))
    # One row; as a value it needs no join.
    whole = per_group.where(F.col("level") == 0).select(F.struct(*names)).scalar()
    chosen = (
        F.when(F.col("f2.total") >= LEAST_DOCUMENTS, F.col("f2"))
        .when(F.col("f1.total") >= LEAST_DOCUMENTS, F.col("f1"))
        .otherwise(whole)
    )
    return joined.select("lang_2", "source_2", chosen.alias("f")).select("lang_2", "source_2", "f.*").drop("total")


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    ratios = stored(with_ratios(text_counts(docs)), "text-counts")
    limits = fences(sketches(ratios))
    same = ratios.lang.eqNullSafe(limits.lang_2) & ratios.source.eqNullSafe(limits.source_2)
    inside = F.lit(True)
    for m in SLACK:
        inside &= F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    judged = ratios.join(limits, same, "left").withColumn("base_failed", base_failed())
    return judged.select(
        *ratios.columns, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")
    )


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle_sql() -> str:
    """The same result in DuckDB's SQL, from whole strings instead of hashes."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    slack = "CASE ratio " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in SLACK.items()) + " END"
    pick = ", ".join(
        f"max(CASE WHEN ratio = '{m}' THEN low END) AS low_{m}, max(CASE WHEN ratio = '{m}' THEN q3 + reach END) AS high_{m}"
        for m in SLACK
    )
    sides = [f"{side}_{m}" for m in SLACK for side in ("low", "high")]
    choose = ", ".join(
        f"CASE WHEN a.total >= {LEAST_DOCUMENTS} THEN a.{s} WHEN b.total >= {LEAST_DOCUMENTS} THEN b.{s} ELSE c.{s} END AS {s}"
        for s in sides
    )
    inside = " AND ".join(f"coalesce({m} BETWEEN low_{m} AND high_{m}, false)" for m in SLACK)
    spread = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS ratio, {m} AS v FROM ratios WHERE n_words >= {LEAST_WORDS}" for m in SLACK
    )
    shift = f"greatest(0, length(bin(v)) - {LEAD + 1})"
    return f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, CASE WHEN trim(text, {spaces}) = '' THEN CAST([] AS VARCHAR[])
                 ELSE regexp_split_to_array(trim(text, {spaces}), '[\\x20\\x09-\\x0D]+') END AS words,
         [l FOR l IN string_split(text, chr(10)) IF trim(l, {spaces}) <> ''] AS lines
  FROM rows
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM split, unnest(range(1, len(words) - {WINDOW - 2})) t(i)
), again AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), steps AS (
  SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS n FROM again
), repeated AS (
  SELECT rid, sum(n) AS n FROM steps GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeated r USING (rid)
), ratios AS (
  SELECT *, CASE WHEN word_chars > 0 THEN {SCALE} * n_symbols // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN {SCALE} * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN {SCALE} * n_repeat_words // n_words ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
         n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
  FROM counts
), spread AS (
  {spread}
), cut AS (
  SELECT lang, source, ratio, CAST((v >> {shift}) << {shift} AS BIGINT) AS bucket FROM spread
), levels AS (
  SELECT 2 AS level, lang, source, ratio, bucket, count(*) AS n FROM cut GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, ratio, bucket, count(*) FROM cut GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, ratio, bucket, count(*) FROM cut GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS so_far,
         sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total
  FROM levels
), quartiles AS (
  SELECT level, lang, source, ratio, max(total) AS total, min(bucket) FILTER (4 * so_far >= total) AS q1,
         min(bucket) FILTER (4 * so_far >= 3 * total) AS q3
  FROM running GROUP BY ALL
), reached AS (
  SELECT *, greatest({slack}, {RANGES} * (q3 - q1)) AS reach FROM quartiles
), sided AS (
  SELECT *, CASE WHEN ratio IN ({', '.join(f"'{m}'" for m in TWO_SIDED)}) THEN q1 - reach ELSE 0 END AS low FROM reached
), per_group AS (
  SELECT level, lang, source, max(total) AS total, {pick} FROM sided GROUP BY level, lang, source
), limits AS (
  SELECT a.lang, a.source, {choose}
  FROM per_group a JOIN per_group b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN per_group c ON c.level = 0
  WHERE a.level = 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {inside} AS kept
FROM ratios r LEFT JOIN limits l
  ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
"""
