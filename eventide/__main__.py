"""Stages from the command line, as for ``spark-submit``: ``python -m eventide STAGE --root FOLDER``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime

from eventide.config import STUDY_TICKERS, StudyConfig
from eventide.plans.pipeline import Pipeline
from eventide.session import build_session
from eventide.sources.landed import read_announcements, read_bars

STAGES = ("bronze", "silver", "event-days", "sessions", "cohorts", "all")


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="eventide", description=__doc__)
    own.add_argument("stage", choices=STAGES)
    own.add_argument("--root", required=True, help="folder of the layers")
    own.add_argument("--prices", help="landed daily bars, for bronze")
    own.add_argument("--announcements", help="landed announcement dates, for bronze")
    own.add_argument("--format", default="parquet", help="of the landed files")
    own.add_argument("--tickers", nargs="+", help="some tickers; by default all that landed")
    own.add_argument("--study-tickers", action="store_true", help="the tickers of the usual study")
    own.add_argument("--replace", choices=("all", "touched"), default="all")
    own.add_argument("--start", type=date.fromisoformat)
    own.add_argument("--end", type=date.fromisoformat)
    return own


def main(args: Sequence[str] | None = None) -> dict:
    own = parser()
    given = own.parse_args(args)
    loads = given.stage in ("bronze", "all")
    if loads and not (given.prices and given.announcements):
        own.error(f"{given.stage} needs --prices and --announcements")
    if given.tickers and given.study_tickers:
        own.error("--tickers and --study-tickers exclude each other")
    config = StudyConfig()
    dates = {k: v for k, v in (("start", given.start), ("end", given.end)) if v}
    spark = build_session(f"eventide {given.stage}")
    run = Pipeline(spark, given.root, replace(config, **dates), given.replace)
    tickers = list(STUDY_TICKERS) if given.study_tickers else given.tickers
    landed = [read(spark, path, given.format) for read, path in (
        (read_bars, given.prices), (read_announcements, given.announcements))] if loads else []
    counts = {
        "bronze": lambda: run.load_bronze(*landed, datetime.now(), tickers),
        "silver": run.build_silver,
        "event-days": run.build_event_days,
        "sessions": run.build_sessions,
        "cohorts": run.build_cohorts,
        "all": lambda: run.run(*landed, datetime.now(), tickers),
    }[given.stage]()
    print(json.dumps(counts))
    return counts


if __name__ == "__main__":
    main()
