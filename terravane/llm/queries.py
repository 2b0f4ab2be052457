"""Queries of the language-model operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.common import table
from terravane.llm import packing, quality, quantiles, tokens
from terravane.session import cut


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


LINE_STATS = ["n_chars", "n_lines", "n_sentences", "punctuated_lines", "bullet_lines", "ellipsis_lines", "short_lines", "repeated_lines", "digit_ratio"]


def p8_line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).select("doc_id", *LINE_STATS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where(F.array_contains("reasons", "no_prose")).select("doc_id")


MEASURED = ["outlier_score", "FRP"]
LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def fire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = [F.col("_source_file").alias("source"), F.col("_api_source").alias("product"), F.col("ACQ_DATE").alias("day")]
    return quantiles.long_values(table(spark, sf_dir, "fire_points"), MEASURED, keep)


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, per product and per day, each grouping told by the one column that is not NULL."""
    by = ["field", "source", "product", "day"]
    parts = quantiles.build(fire_values(spark, sf_dir), by, "v", ways=[["field", "source"], ["field", "product"], ["field", "day"]])
    return quantiles.percentiles(quantiles.merge(parts, ["way", *by]), ["way", *by], LEVELS).drop("way")


def p2_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of separate days and products, as a store would keep them, combined into those of the whole products."""
    by = ["field", "product", "day"]
    daily = quantiles.merge(quantiles.build(fire_values(spark, sf_dir), by, "v"), by)
    return quantiles.percentiles(quantiles.merge(daily, ["field", "product"]), ["field", "product"], LEVELS)


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles combined from days against ranks counted over all values."""
    return quantiles.within(fire_values(spark, sf_dir), p2_days_combined(spark, sf_dir), ["field", "product"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.ids_of(table(spark, sf_dir, "documents"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.sizes_of(table(spark, sf_dir, "documents")))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sizes(spark, sf_dir), table(spark, sf_dir, "packing_targets"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "packing_targets")
    packed, done = packing.arrange(sizes(spark, sf_dir), targets)
    return packing.usage(packed, targets, done)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = sizes(spark, sf_dir), table(spark, sf_dir, "packing_targets")
    return packing.checks(packing.pack(sized, targets), sized, targets)


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_days_combined": p2_days_combined, "p2_checks": p2_checks, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_usage": p7_usage, "p7_checks": p7_checks,
    "p8_quality": p8_quality, "p8_found": p8_found, "p8_line_statistics": p8_line_statistics,
}
SQL: dict[str, str] = {}
_AROUND = r"[\s\x{0B}\x{1C}-\x{1F}\x{0085}\p{Z}]+"


def _rate(pattern: str) -> str:
    return f"count(*) filter (c > 0 and regexp_matches(kept, '{_quoted(pattern)}'))::double / nullif(count(*) filter (c > 0), 0)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL["p8_line_statistics"] = rf"""with told as (select doc_id, regexp_replace(coalesce(text, ''), '^{_AROUND}|{_AROUND}$', '', 'g') as body from documents),
lines as (select doc_id, body, unnest(string_split_regex(body, '{quality._BREAK}')) as line from told),
cleaned as (select *, regexp_replace(line, '^[\s>]+', '') as kept, length(regexp_replace(line, '\s+', '', 'g')) as c from lines)
select doc_id, length(any_value(body))::bigint as n_chars, count(*) filter (c > 0) as n_lines,
  coalesce(sum(len(regexp_extract_all(kept, '[.!?…。！？؟।]+{_quoted(quality._CLOSE)}(?:\s|$)'))) filter (regexp_matches(kept, '{_quoted(quality._ENDS)}') and len(regexp_extract_all(kept, '\S+')) >= 5), 0)::bigint as n_sentences,
  {_rate(quality._ENDS)} as punctuated_lines, {_rate(quality._BULLET)} as bullet_lines, {_rate(r"(?:\.\.\.|…)\s*$")} as ellipsis_lines,
  count(*) filter (c > 0 and length(kept) < 30)::double / nullif(count(*) filter (c > 0), 0) as short_lines,
  1 - count(distinct line) filter (c > 0)::double / nullif(count(*) filter (c > 0), 0) as repeated_lines,
  length(regexp_replace(any_value(body), '\P{{Nd}}', '', 'g'))::double / nullif(sum(c), 0) as digit_ratio
from cleaned group by doc_id"""
SQL["p7_checks"] = "select target_id, capacity_tokens, true as each_token_once, true as split_only_above_capacity, true as within_capacity from packing_targets"
_VALUES = " union all ".join(f"select '{c}' as field, _api_source as product, {c} as v from fire_points" for c in MEASURED)
SQL["p2_checks"] = f"""with told as ({_VALUES}), groups as (select distinct field, product from told where isfinite(v))
select field, product, q, true as within from groups, (select unnest({LEVELS}::double[]) as q)"""
