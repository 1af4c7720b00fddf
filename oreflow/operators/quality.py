"""Declarative data-quality rules compiled to aggregates.

All row rules of a suite share one aggregation pass; each uniqueness rule adds
one pre-aggregated group-by. Results have one row per rule.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from oreflow.session import materialize

if TYPE_CHECKING:
    from oreflow.sources.tables import SnapshotTable

SCHEMA_RULES = ("columns_in_set", "column_exists", "of_type")
UNIQUE_RULES = ("unique", "compound_unique")


class ValidationFailed(RuntimeError):
    """A gated step was refused because its input fails the rules."""


def _rule_column(rule: dict) -> str:
    if "columns" in rule:
        return ",".join(rule["columns"]) if rule["rule"] != "columns_in_set" else ""
    return rule.get("column", "")


def row_test(rule: dict) -> tuple[Column, Column]:
    """(row is judged, row passes) of a row rule; NULLs are not judged except
    by ``not_null``."""
    kind = rule["rule"]
    if kind == "pair_greater":
        a, b = F.col(rule["a"]), F.col(rule["b"])
        passes = (a >= b) if rule.get("or_equal") else (a > b)
        return a.isNotNull() & b.isNotNull(), passes
    value = F.col(rule["column"])
    if kind == "not_null":
        return F.lit(True), value.isNotNull()
    if kind == "in_set":
        return value.isNotNull(), value.isin(rule["values"])
    if kind == "regex":
        return value.isNotNull(), value.rlike(rule["pattern"])
    if kind == "between":
        passes = F.lit(True)
        if rule.get("min") is not None:
            passes = passes & (value >= rule["min"])
        if rule.get("max") is not None:
            passes = passes & (value <= rule["max"])
        return value.isNotNull(), passes
    raise ValueError(f"unknown rule {kind}")


def _schema_ok(df: DataFrame, rule: dict) -> bool:
    if rule["rule"] == "columns_in_set":
        have, want = set(df.columns), set(rule["columns"])
        return have == want if rule.get("exact") else want <= have
    if rule["rule"] == "column_exists":
        return rule["column"] in df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return kinds.get(rule["column"]) == rule["type"]


def _result(rule: dict, judged: Column, bad: Column, success: Column) -> Column:
    percent = F.when(judged > 0, F.round(bad * 100.0 / judged, 4)).otherwise(F.lit(0.0))
    return F.struct(
        F.lit(rule["rule"]).alias("rule"),
        F.lit(_rule_column(rule) or rule.get("a", "")).alias("column_name"),
        judged.cast("long").alias("element_count"),
        bad.cast("long").alias("unexpected_count"),
        percent.alias("unexpected_percent"),
        success.alias("success"),
    )


def _unique_result(df: DataFrame, rule: dict) -> DataFrame:
    columns = rule["columns"] if "columns" in rule else [rule["column"]]
    keyed = df.select(*columns).dropna("any").groupBy(*columns).agg(F.count("*").alias("_n"))
    total = keyed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_judged"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("_bad"),
    )
    judged, bad = F.col("_judged"), F.col("_bad")
    return total.select(_result(rule, judged, bad, bad == 0).alias("_r"))


def validate(df: DataFrame, suite: str, rules: list[dict]) -> DataFrame:
    """Result rows of a suite on a table."""
    zero, aggregates, results = F.lit(0).cast("long"), [F.count("*").alias("_rows")], []
    for i, rule in enumerate(rules):
        if rule["rule"] == "row_count":
            rows = F.col("_rows")
            passes = (rows >= (rule.get("min") or 0)) & (F.lit(True) if rule.get("max") is None else rows <= rule["max"])
            results.append(_result(rule, rows, F.when(passes, zero).otherwise(F.lit(1)), passes))
        elif rule["rule"] in SCHEMA_RULES:
            passes = _schema_ok(df, rule)
            results.append(_result(rule, zero, F.lit(0 if passes else 1), F.lit(passes)))
        elif rule["rule"] not in UNIQUE_RULES:
            judged, passes = row_test(rule)
            aggregates += [F.count_if(judged).alias(f"_j{i}"), F.count_if(judged & ~passes).alias(f"_b{i}")]
            j, b = F.col(f"_j{i}"), F.col(f"_b{i}")
            enough = (j == 0) | ((j - b) >= F.lit(float(rule.get("mostly", 1.0))) * j)
            results.append(_result(rule, j, b, enough))
    frames = [df.agg(*aggregates).select(F.explode(F.array(*results)).alias("_r"))]
    frames += [_unique_result(df, rule) for rule in rules if rule["rule"] in UNIQUE_RULES]
    return reduce(DataFrame.unionByName, frames).select(F.lit(suite).alias("suite"), "_r.*")


def summarize(results: DataFrame) -> DataFrame:
    """Totals of a checkpoint over the result rows of its suites."""
    failed = F.when(~F.col("success"), F.concat_ws(".", "suite", "rule", F.nullif("column_name", F.lit(""))))
    return results.agg(
        F.count("*").alias("evaluated"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.count_if("success") * 100.0 / F.count("*"), 2).alias("success_percent"),
        F.array_join(F.sort_array(F.collect_list(failed)), ", ").alias("failed_rules"),
    )


def quarantine(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that break a row rule, with all the rules they break."""
    reasons = []
    for rule in rules:
        if rule["rule"] == "row_count" or rule["rule"] in SCHEMA_RULES + UNIQUE_RULES:
            continue
        judged, passes = row_test(rule)
        reasons.append(F.when(judged & ~passes, f"{rule['rule']}:{_rule_column(rule) or rule.get('a', '')}"))
    marked = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return marked.filter(F.size("reasons") > 0)


def checked_step(df: DataFrame, suite: str, rules: list[dict], bad_rows: SnapshotTable | None = None, found_at=None) -> DataFrame:
    """The rows as a step in the shared folder, after its rules were found to hold; else ``ValidationFailed``.

    Row rules are counted by the job that writes the step, so nothing is read for them; uniqueness is counted on the
    step's own columns. When a rule fails, the rows that break one go to ``bad_rows`` first.
    """
    spark, seen = df.sparkSession, Observation()
    judged = {i: row_test(rule) for i, rule in enumerate(rules) if rule["rule"] not in ("row_count", *SCHEMA_RULES, *UNIQUE_RULES)}
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, (asked, passes) in judged.items():
        counts += [F.count_if(asked).alias(f"j{i}"), F.count_if(asked & ~passes).alias(f"b{i}")]
    step = materialize(spark, df.observe(seen, *counts))
    found, failed = seen.get, []
    for i, rule in enumerate(rules):
        if rule["rule"] == "row_count":
            ok = (rule.get("min") or 0) <= found["rows"] <= (rule.get("max") or found["rows"])
        elif rule["rule"] in SCHEMA_RULES:
            ok = _schema_ok(df, rule)
        elif rule["rule"] in UNIQUE_RULES:
            ok = _unique_result(step, rule).first()["_r"]["success"]
        else:
            asked, bad = found[f"j{i}"], found[f"b{i}"]
            ok = asked - bad >= float(rule.get("mostly", 1.0)) * asked
        if not ok:
            failed.append(f"{suite}.{rule['rule']}.{_rule_column(rule) or rule.get('a', '')}")
    if failed:
        if bad_rows is not None:
            rows = quarantine(step, rules)
            at = F.current_timestamp() if found_at is None else F.lit(found_at).cast("timestamp")
            bad_rows.append(rows.select(F.lit(suite).alias("suite"), F.to_json(F.struct(*step.columns)).alias("row"), "reasons", at.alias("found_at")))
        raise ValidationFailed(", ".join(failed))
    return step


def gate(results: DataFrame, report_only: bool = False) -> bool:
    """True when every rule holds; otherwise raise, or report False."""
    failed = [f"{r['suite']}.{r['rule']}.{r['column_name']}" for r in results.filter(~F.col("success")).collect()]
    if failed and not report_only:
        raise ValidationFailed(", ".join(failed))
    return not failed
