"""The layer jobs as programs: ``python -m oreflow.plans.jobs <layer> --root <folder> [...]``.

Each job is recorded in the lineage table, and its rows pass the layer's rules before they are published.
Exit codes: 0 done, 1 failed, 2 refused by the rules.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from oreflow.operators.lineage import recorded
from oreflow.operators.quality import ValidationFailed
from oreflow.plans import bronze, gold, layers, silver, suites
from oreflow.session import prepare
from oreflow.sources.topic import read_log

DONE, FAILED, REFUSED = 0, 1, 2

# Only successes become facts, and these rules hold for every one of them.
FACT_RULES = [rule for rule in suites.FACT if rule["rule"] != "row_count"]


def run_bronze(spark: SparkSession, root: str, topic: str, run_ts) -> None:
    records, table = read_log(spark, topic), layers.bronze(spark, root)
    with recorded(layers.lineage(spark, root), "bronze.ingest", [records], [table]):
        bronze.ingest(records, table, run_ts)


def run_silver(spark: SparkSession, root: str, start, end, run_ts, full_refresh: bool = False, rules=FACT_RULES) -> None:
    """Facts of the interval, then the users they touch."""
    log, bad = layers.lineage(spark, root), layers.quarantined(spark, root)
    raw, table = layers.bronze(spark, root).read(), layers.fact(spark, root)
    with recorded(log, "silver.facts", [raw], [table]):
        silver.run_facts(raw, table, start, end, run_ts, full_refresh, rules=rules, bad_rows=bad)
    facts, history = table.read(), layers.user_history(spark, root)
    with recorded(log, "silver.users", [facts], [history]):
        silver.run_user_history(facts, history, run_ts, None, full_refresh=full_refresh)


def run_gold(spark: SparkSession, root: str, start, end, run_ts) -> None:
    """Days and users touched in the interval (without one: all), and the ranking."""
    log, bad, facts = layers.lineage(spark, root), layers.quarantined(spark, root), layers.fact(spark, root).read()
    daily, popular = layers.daily(spark, root), layers.popular(spark, root)
    days, totals = layers.user_days(spark, root), layers.user_totals(spark, root)
    with recorded(log, "gold.daily", [facts], [daily]):
        gold.run_daily(facts, daily, start, end, run_ts, rules=suites.DAILY, bad_rows=bad)
    with recorded(log, "gold.users", [facts], [days, totals]):
        gold.run_user_totals(facts, days, totals, start, end, run_ts)
    with recorded(log, "gold.popular", [facts], [popular]):
        gold.run_popular(facts, popular, run_ts)


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="oreflow.plans.jobs", description=__doc__)
    parser.add_argument("layer", choices=["bronze", "silver", "gold"])
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--topic", help="folder of the topic log (bronze)")
    parser.add_argument("--start", help="begin of the interval, inclusive")
    parser.add_argument("--end", help="end of the interval, exclusive")
    parser.add_argument("--run-ts", help="moment of the run; now, if it is not given")
    parser.add_argument("--full-refresh", action="store_true", help="replace the table (silver)")
    found = parser.parse_args(argv)
    if found.layer == "bronze" and not found.topic:
        parser.error("bronze needs --topic")
    return found


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    given = _arguments(argv)
    spark = prepare(spark or SparkSession.builder.appName(f"oreflow-{given.layer}").getOrCreate())
    run_ts = given.run_ts or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    try:
        if given.layer == "bronze":
            run_bronze(spark, given.root, given.topic, run_ts)
        elif given.layer == "silver":
            run_silver(spark, given.root, given.start, given.end, run_ts, given.full_refresh)
        else:
            run_gold(spark, given.root, given.start, given.end, run_ts)
    except ValidationFailed as refused:
        print(f"refused: {refused}", file=sys.stderr)
        return REFUSED
    except Exception as error:  # noqa: BLE001
        print(f"failed: {error}", file=sys.stderr)
        return FAILED
    return DONE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
