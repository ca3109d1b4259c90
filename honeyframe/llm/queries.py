"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from honeyframe.llm import query
from honeyframe.llm.bpe import round_trip
from honeyframe.llm.common import documents
from honeyframe.llm.cover_tree import near_vectors
from honeyframe.llm.exact_dedup import exact_dedup
from honeyframe.llm.language import identify
from honeyframe.llm.licenses import scan_licenses
from honeyframe.llm.packing import pack_documents
from honeyframe.llm.parsing import remove_repeats
from honeyframe.llm.periodic import find_runs
from honeyframe.llm.planes import write_and_read
from honeyframe.llm.setsketch import near_duplicates
from honeyframe.llm.sharding import shard_documents
from honeyframe.llm.suffix_tree import score_texts
from honeyframe.llm.whitening import whiten


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_cover_tree",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE len(embedding) > 0 AND list_aggregate(embedding, 'count') = len(embedding)
    ), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE isfinite(list_dot_product(e, e))),
    links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
    ), reach AS (
        SELECT vec_id AS node, vec_id AS seen FROM embeddings
        UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
    ), named AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
    FROM embeddings e JOIN named m ON m.node = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


@query("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of shelves below ``source/lang``. In each shelf some
    stand for the licence files of the source, of the language and of the shelf."""
    d = documents(spark, sf_dir)
    place, shelf = F.col("doc_id") % 100, F.floor(F.col("doc_id") / 100)
    path = (
        F.when(place < 5, F.concat_ws("/", "source", F.lit("LICENSE")))
        .when(place < 15, F.concat_ws("/", "source", "lang", F.lit("LICENSE")))
        .when(place < 20, F.concat_ws("/", "source", "lang", shelf, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", "lang", shelf, F.concat("doc_id", F.lit(".txt"))))
    )
    return scan_licenses(d.withColumn("path", path))


@query("op3_genetic_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=4096)


@query("op4_minimax_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=8)


@query("op5_setsketch")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


@query("op8_suffix_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@query("op10_plane_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


#: White space between words, as a pattern of both Java and Python.
_SPACE = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every document whose crc32 of the id ends in 0 gets a run: from word ``a``
    on, its first ``p`` words are repeated. A null id is left alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), _SPACE), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, 1, a.cast("int")), copies), 1, n.cast("int")), " ")
    hit = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (h % 10 == 0) & F.exists(F.split(F.col("text"), _SPACE), lambda w: w != "")
    return docs.select("doc_id", F.when(hit, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.col("runs")
    best = F.try_element_at(F.array_sort(runs, lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] - x["length"]).cast("int"), F.lit(0)), F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)),
        F.signum(x["period"] - y["period"]).cast("int"),
    )), F.lit(1))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return find_runs(with_planted_runs(documents(spark, sf_dir))).withColumn("best", best).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


@query("op13_prefix_free_parsing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform("spans", lambda s: s["length"])
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
