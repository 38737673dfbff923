"""Registered queries of the training-data operators, with oracle SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import ann, langid, lexical, licenses, line_dedup, main_text, mixing, near_dup, packing, quality, runs, suffix_dedup, warc
from quireflow.llm.common import WORD, documents, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, langid.trained_on_folds(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select("doc_id", "license", "saved_bytes", "rank", "n_different")


LINES = """
    SELECT doc_id, g.pos, g.line, lower_az(trim(g.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS key
    FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) AS g
"""


@query(f"""
    WITH lines AS ({LINES.replace("lower_az(", "translate(").replace("chr(13))) AS key", f"chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOW}') AS key")}),
    firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    marked AS (SELECT doc_id, pos, line, first IS NOT NULL AND doc_id > first AS gone FROM lines LEFT JOIN firsts USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(documents(spark, sf_dir), k=3, per_cent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query()
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(rows, rows.where("vec_id % 50 = 0"), k=5)


@query()
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = warc.write_store(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return warc.read_all(spark, store).drop("payload")


@query()
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
RATES = "\n".join(
    f"""
    , rate_{r} AS (SELECT source, ({r}_fails + mean * strength) / (docs + strength) AS rate FROM (
        SELECT *, CASE WHEN between_hosts > 0 THEN greatest(spread / between_hosts - 1, 1.0) ELSE 1.0 END AS strength FROM (
            SELECT *, mean * (1 - mean) AS spread, greatest(variance - mean * (1 - mean) * per_doc, mean * (1 - mean) * 1e-4) AS between_hosts
            FROM hosts, (SELECT avg({r}_fails / docs) AS mean, coalesce(var_samp({r}_fails / docs), 0) AS variance, avg(1 / docs) AS per_doc FROM hosts))))"""
    for r in quality.RULES
)


@query(rf"""
    WITH words AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS i FROM documents),
    windows AS (SELECT doc_id, i, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i FROM windows WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, second, third) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
    counted AS (SELECT doc_id, source, len({WORDS}) AS n_words, length(regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g')) AS word_chars,
                       length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                       coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(coalesce(text, ''), chr(10))) AS n_lines
                FROM documents LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    ruled AS (SELECT *, {quality.RULES["base"]} AS base_failed FROM counted),
    hosts AS (SELECT source, count(*) AS docs, {", ".join(f"count(*) FILTER ({fail}) AS {r}_fails" for r, fail in quality.RULES.items())} FROM counted GROUP BY source)
    {RATES}
    , rejected AS (SELECT DISTINCT source FROM ({" UNION ALL ".join(f"SELECT * FROM rate_{r}" for r in quality.RULES)}) WHERE rate > {quality.LIMIT})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.hit IS NULL AS kept
    FROM ruled LEFT JOIN (SELECT source, 1 AS hit FROM rejected) AS r ON ruled.source IS NOT DISTINCT FROM r.source AND r.hit = 1
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Of every document with crc32(doc_id) % 10 = 0: its words from some word on repeat a stretch of them (the contract's rule)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    placed = listed.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_periods(documents(spark, sf_dir)), min_length=12)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.l")
    return out.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
                      F.expr("(-1000 * top.l) DIV top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_sql(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{line_dedup.UPPER}', '{line_dedup.LOW}'), '{TERM}')) AS term FROM {table}"


@query(f"""
    WITH terms AS ({terms_sql("documents", "doc_id")}),
    sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
    asked AS (SELECT DISTINCT item_id, term FROM ({terms_sql("benchmark", "item_id")})),
    held AS (SELECT doc_id, term, count(*) AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY doc_id, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, docs),
    impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms))) AS impact
                FROM held JOIN sizes USING (doc_id) JOIN weights USING (term), totals),
    scored AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


@query()
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
