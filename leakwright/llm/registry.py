"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwright.llm.chosen_path import near_duplicates
from leakwright.llm.dac import read_token_table, write_token_table
from leakwright.llm.decontaminate import find_leaks
from leakwright.llm.divergence import source_divergence
from leakwright.llm.exact_dedup import exact_duplicates
from leakwright.llm.line_dedup import drop_boilerplate, host_of, html_lines
from leakwright.llm.mixing import mix_report
from leakwright.llm.oracles import SQL
from leakwright.llm.periodic import planted_tail, run_report
from leakwright.llm.preference import last_turn_from, preference_records
from leakwright.llm.quality import quality_scores
from leakwright.llm.secret_scan import scan_report
from leakwright.llm.substring import drop_repeated_passages
from leakwright.llm.textcore import bound_batches
from leakwright.llm.url_rules import filter_urls
from leakwright.sources.shared_tables import new_path

#: The end id that the token file appends to each document.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: The fixed rules of the url query: verdict, host with its subdomains, beginning of the path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from labels that are not held out."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: of the longest fixed rule that fits, or else of the mined rules."""
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, sources weighing 5, 2 and 1 in turn."""
    return mix_report(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the largest id stays."""
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, with the item and its coverage."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the prompt and completions of every conversation, chosen as it is and rejected with the last answer of its neighbour."""
    turns = _table(spark, sf_dir, "conversations")
    known = turns.select("conv_id").where("conv_id IS NOT NULL").distinct()
    other = last_turn_from(turns, known.select("conv_id", (F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("partner")))
    sides = [known.select(F.col("conv_id").alias("pair_id"), F.lit(side).alias("side"), own.alias("conv_id")) for side, own in (("chosen", F.col("conv_id")), ("rejected", -1 - F.col("conv_id")))]
    records = preference_records(turns.select("conv_id", "turn", "role", "text").unionByName(other), sides[0].unionByName(sides[1]))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    trained = lambda c: F.aggregate(f"{c}_spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]).cast("long").alias(f"{c}_trained")
    return records.select("pair_id", "chosen_id", "rejected_id", "prefix_turns", digest("prompt"), digest("chosen"), digest("rejected"), trained("chosen"), trained("rejected"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the token file."""
    path = new_path(spark, "tokens")
    write_token_table(_table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return read_token_table(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page, and those dropped as boilerplate of its host."""
    pages = _table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text"))
    kept = drop_boilerplate(pages, site="host", max_ratio=0.2, min_pages=3)
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeated 50-word passages are removed."""
    return drop_repeated_passages(_table(spark, sf_dir, "documents"), window=50, digest=True)


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, ratio=(80, 100))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and by which terms."""
    return source_divergence(_table(spark, sf_dir, "documents"), min_df=30, top=50)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: those of the fixed patterns, and those that the field adds."""
    return scan_report(_table(spark, sf_dir, "documents"), whole=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in every text, some of which have a tail made periodic, and the text without repeats."""
    return run_report(_table(spark, sf_dir, "documents"), min_exponent=4, min_length=6, plant=planted_tail)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_chosen_path": op10_chosen_path,
        "op11_source_divergence": op11_source_divergence,
        "op12_secret_scan": op12_secret_scan,
        "op13_periodic_runs": op13_periodic_runs,
        "op1_quality_classifier": op1_quality_classifier,
        "op2_url_filters": op2_url_filters,
        "op3_mixing_weights": op3_mixing_weights,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_preference_formatting": op6_preference_formatting,
        "op7_token_file": op7_token_file,
        "op8_line_dedup": op8_line_dedup,
        "op9_substring_dedup": op9_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
