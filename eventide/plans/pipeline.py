"""Bronze → silver → gold, each layer a Parquet table read back by the next stage.

The written tables cut lineage: a stage that is run again, or an executor lost late, never redoes
earlier stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import StudyConfig
from eventide.operators.clean import (
    labelled_announcements,
    labelled_bars,
    rejected_announcement,
    rejected_bar,
    usable_announcements,
    usable_bars,
)
from eventide.operators.cohorts import cohort_state
from eventide.operators.metrics import cohort_metrics, event_summary
from eventide.operators.quality import Gates, column_figures, null_report, with_last
from eventide.operators.sessions import bar_sessions
from eventide.operators.windows import event_day_metrics, event_days
from eventide.schemas import (
    ANNOUNCEMENTS,
    BARS,
    COHORT_STATE,
    EVENT_DAY_METRICS,
    EVENT_SUMMARY,
    LANDED,
    LANDED_ANNOUNCEMENTS,
    LANDED_BARS,
    STORED_ANNOUNCEMENTS,
    STORED_BARS,
    TRADE_SESSIONS,
    conform,
)
from eventide.sources.audit import Audit, read_figures
from eventide.sources.landed import in_range, only_tickers
from eventide.sources.layers import read_layer, write_observed
from eventide.sources.manifest import append_manifest, manifest_row
from eventide.sources.snapshots import Snapshot, current, partitions, restricted


class Pipeline:
    """The five stages over one root folder.

    ``replace="touched"`` makes a run over some tickers leave the other tickers' partitions alone;
    the default replaces whole tables. ``gates`` by table, such as ``silver/prices``, name what a
    write to bronze or silver has to hold to be published; without them its figures are only stored.
    """

    def __init__(self, spark: SparkSession, root: str, config: StudyConfig = StudyConfig(),
                 replace: str = "all", gates: Mapping[str, Gates] | None = None) -> None:
        self.spark, self.config, self.replace = spark, config, replace
        self.root, self.gates = root, dict(gates or {})
        self.bronze, self.silver, self.gold = (f"{root}/{x}" for x in ("bronze", "silver", "gold"))

    def _write(self, df: DataFrame, path: str, sort_by: Sequence[str], **how) -> int:
        return write_observed(df, path, "ticker", sort_by, **{"replace": self.replace, **how})["rows"]

    def _audited(self, df: DataFrame, table: str, sort_by: Sequence[str],
                 observe: Mapping[str, Column], **how) -> int:
        """`_write` to a table of bronze or silver, its figures taken in the same write."""
        how = {"replace": self.replace, **how}
        audit = Audit(self.spark, self._figures, table, how["replace"], self.gates.get(table, Gates()))
        return self._write(df, f"{self.root}/{table}", sort_by, observe=observe, audit=audit, **how)

    @property
    def _figures(self) -> str:
        return f"{self.root}/quality"

    def _land_bars(self, bars: DataFrame, **how) -> int:
        return self._audited(conform(bars, LANDED_BARS), "bronze/prices", ["trade_date"],
                             {"rejected:*": F.count_if(rejected_bar())}, skip_empty=True, **how)

    def _land_announcements(self, announcements: DataFrame, **how) -> int:
        return self._audited(conform(announcements, LANDED_ANNOUNCEMENTS), "bronze/announcements", ["event_date"],
                             {"rejected:*": F.count_if(rejected_announcement())}, skip_empty=True, **how)

    def load_bronze(self, bars: DataFrame, announcements: DataFrame, run_ts: datetime,
                    tickers: Sequence[str] | DataFrame | None = None) -> dict[str, int]:
        """Store raw rows of the study range, and one manifest line.

        ``tickers`` picks some, as a list or a table; by default every landed ticker is kept.
        The vendor's price range excludes its end date; the announcement range includes it.
        """
        c = self.config
        bars = in_range(bars, "trade_date", c.start, c.end, include_end=False)
        announcements = in_range(announcements, "event_date", c.start, c.end)
        if tickers is not None:
            bars, announcements = (only_tickers(x, tickers) for x in (bars, announcements))
        bars, announcements = (self._arrived(x, run_ts) for x in (bars, announcements))
        counts = {
            "prices": self._land_bars(bars),
            "announcements": self._land_announcements(announcements),
        }
        append_manifest(manifest_row(self.spark, run_ts, tickers, c, counts), f"{self.bronze}/_manifest")
        return counts

    @staticmethod
    def _arrived(df: DataFrame, run_ts: datetime) -> DataFrame:
        """Rows that do not say when they landed did so with this run."""
        return df if LANDED.name in df.columns else df.withColumn(LANDED.name, F.lit(run_ts))

    def build_silver(self) -> dict[str, int]:
        """Of the rows of one key the one that landed last counts."""
        raw_bars = read_layer(self.spark, f"{self.bronze}/prices", LANDED_BARS)
        raw_events = read_layer(self.spark, f"{self.bronze}/announcements", LANDED_ANNOUNCEMENTS)
        latest = [LANDED.name]
        bars = labelled_bars(usable_bars(raw_bars, latest), self.config, latest)
        events = labelled_announcements(usable_announcements(raw_events, latest), self.config, latest)
        return {
            "prices": self._audited(conform(bars, STORED_BARS), "silver/prices", ["trade_date"],
                                    column_figures(STORED_BARS), note=self._seen("prices")),
            "announcements": self._audited(
                conform(events, STORED_ANNOUNCEMENTS), "silver/announcements", ["event_date"],
                column_figures(STORED_ANNOUNCEMENTS), note=self._seen("announcements")),
        }

    def _seen(self, *names: str) -> dict:
        """Folders of bronze tables: each table made from them remembers which it has taken in."""
        found = {name: current(self.spark, f"{self.bronze}/{name}") for name in names}
        return {name: sorted(version.folders) if version else [] for name, version in found.items()}

    def _taken_in(self, *tables: str) -> dict:
        """What tables that are read have taken in, for the note of what is made of them."""
        found = [current(self.spark, table) for table in tables]
        return {name: folders for version in found if version for name, folders in version.note.items()}

    def silver_bars(self) -> DataFrame:
        return read_layer(self.spark, f"{self.silver}/prices", BARS)

    def silver_announcements(self) -> DataFrame:
        return read_layer(self.spark, f"{self.silver}/announcements", ANNOUNCEMENTS)

    def null_reports(self) -> DataFrame:
        """Nulls per column of both silver tables; a report, never a failure."""
        return null_report(self.silver_bars(), "silver/prices").unionByName(
            null_report(self.silver_announcements(), "silver/announcements"))

    def quality(self) -> DataFrame:
        """Figures of every write to bronze and silver, beside those of the last one of its kind.

        They were taken while writing: no table is read.
        """
        return with_last(read_figures(self.spark, self._figures))

    def build_event_days(self) -> dict[str, int]:
        days = event_day_metrics(self.silver_announcements(), self.silver_bars(), self.config)
        note = self._taken_in(f"{self.silver}/prices", f"{self.silver}/announcements")
        return {"event_day_metrics": self._write(days, f"{self.gold}/event_day_metrics",
                                                 ["event_id", "day"], note=note)}

    def build_sessions(self) -> dict[str, int]:
        return self._write_sessions(self.silver_bars(), note=self._taken_in(f"{self.silver}/prices"))

    def _write_sessions(self, bars: DataFrame, **how) -> dict[str, int]:
        sessions = bar_sessions(bars, self.config.session_gap_minutes, self.config.exchange_tz)
        # Every session has one first trade; trades without a ticker share one session.
        named = F.col("session_id").isNotNull()
        written = write_observed(
            conform(sessions, TRADE_SESSIONS), f"{self.gold}/trade_sessions", "ticker", ["trade_ts"],
            **{"replace": self.replace, **how}, observe={"started": F.count_if(named & (F.col("is_session_start") == 1)),
                     "unnamed": F.max((~named).cast("int"))})
        return {"trade_sessions": written["rows"],
                "distinct_sessions": (written["started"] or 0) + (written["unnamed"] or 0)}

    def build_cohorts(self) -> dict[str, int]:
        days = read_layer(self.spark, f"{self.gold}/event_day_metrics", EVENT_DAY_METRICS)
        summary = event_summary(days, self.config.days_before, self.config.days_after)
        note = self._taken_in(f"{self.gold}/event_day_metrics")
        return {
            "daily_cohort_metrics": self._write_cohorts(days, note),
            "event_summary": self._write(summary, f"{self.gold}/event_summary", ["event_date"], note=note),
            "cohort_state": self._write(conform(cohort_state(days), COHORT_STATE), f"{self.gold}/cohort_state",
                                        ["relative_day"], note=note),
        }

    def _write_cohorts(self, days: DataFrame, note: dict) -> int:
        return write_observed(cohort_metrics(days), f"{self.gold}/daily_cohort_metrics",
                              sort_by=["relative_day", "cap_bucket"], note=note)["rows"]

    def land(self, bars: DataFrame, announcements: DataFrame, run_ts: datetime) -> dict[str, int]:
        """Add newly landed raw rows of the study range to bronze, beside those that are there."""
        c = self.config
        bars = self._arrived(in_range(bars, "trade_date", c.start, c.end, include_end=False), run_ts)
        announcements = self._arrived(in_range(announcements, "event_date", c.start, c.end), run_ts)
        counts = {
            "prices": self._land_bars(bars, replace="none"),
            "announcements": self._land_announcements(announcements, replace="none"),
        }
        append_manifest(manifest_row(self.spark, run_ts, None, c, counts), f"{self.bronze}/_manifest")
        return counts

    def upsert(self, bars: DataFrame, announcements: DataFrame, run_ts: datetime) -> dict[str, dict[str, int]]:
        """Land new rows and bring all tables up to date, at the cost of what the rows touch.

        Silver partitions of their tickers take the new rows in; of the day rows and summaries those
        of affected events are worked out again; sessions are renumbered for tickers with new bars.
        All other partitions are neither read nor written. Cohorts are over everything and read the
        gold days. The tables are those that a run over all landed rows would make. What an earlier
        upsert landed but did not finish is taken in as well.
        """
        return {"bronze": self.land(bars, announcements, run_ts), **self.catch_up()}

    def catch_up(self) -> dict[str, dict[str, int]]:
        """Take in bronze rows that some table has not seen, and what follows from them."""
        return Merge(self).run()

    def run(self, bars: DataFrame, announcements: DataFrame, run_ts: datetime,
            tickers: Sequence[str] | DataFrame | None = None) -> dict[str, dict[str, int]]:
        """All stages; rows written per stage and table."""
        return {
            "bronze": self.load_bronze(bars, announcements, run_ts, tickers),
            "silver": self.build_silver(),
            "event_days": self.build_event_days(),
            "sessions": self.build_sessions(),
            "cohorts": self.build_cohorts(),
        }


class Merge:
    """Bronze rows that some table has not taken in, merged into all tables that follow from them.

    Works by partition folders, one per ticker: those of the new rows name what is read and replaced.
    Every table notes what it has taken in, and taking rows in twice changes nothing; so a merge that
    ended between two tables is done again by the next.
    """

    _ARRIVAL = [LANDED.name]
    # Tables by the bronze table whose rows they have to take in.
    _MADE_OF = {
        "prices": ("silver/prices", "gold/event_day_metrics", "gold/trade_sessions", "gold/event_summary",
                   "gold/cohort_state", "gold/daily_cohort_metrics"),
        "announcements": ("silver/announcements", "gold/event_day_metrics", "gold/event_summary",
                          "gold/cohort_state", "gold/daily_cohort_metrics"),
    }

    def __init__(self, pipeline: Pipeline) -> None:
        self.of, self.spark, self.config = pipeline, pipeline.spark, pipeline.config

    def _path(self, table: str) -> str:
        layer, name = table.split("/")
        return f"{getattr(self.of, layer)}/{name}"

    def _unseen(self, name: str) -> Snapshot | None:
        """The bronze folders that some table has not taken in; None where tables must be made anew."""
        bronze = current(self.spark, f"{self.of.bronze}/{name}")
        if bronze is None:
            return Snapshot(0, {})
        seen = set(bronze.folders)
        for table in self._MADE_OF[name]:
            version = current(self.spark, self._path(table))
            if version is None or not set(version.note.get(name, ["none"])) <= set(bronze.folders):
                return None
            seen &= set(version.note[name])
        return bronze._replace(folders={f: p for f, p in bronze.folders.items() if f not in seen})

    def _parts(self, path: str, version: Snapshot) -> set[str]:
        found: set[str] = set()
        for folder, parts in version.folders.items():
            found |= partitions(self.spark, path, folder) if parts is None else set(parts)
        return found

    def _some(self, table: str, schema: T.StructType, parts: set[str]) -> DataFrame:
        """Rows of some partitions of a table as it is now."""
        path = self._path(table)
        return read_layer(self.spark, path, schema, missing_ok=True,
                          version=restricted(self.spark, path, current(self.spark, path), parts))

    def _replace(self, df: DataFrame, table: str, sort_by: Sequence[str], parts: set[str], note: dict) -> int:
        return self.of._write(df, self._path(table), sort_by, replace="touched", touched=parts, note=note)

    def run(self) -> dict[str, dict[str, int]]:
        unseen = {name: self._unseen(name) for name in self._MADE_OF}
        if None in unseen.values():
            return {"silver": self.of.build_silver(), "event_days": self.of.build_event_days(),
                    "sessions": self.of.build_sessions(), "cohorts": self.of.build_cohorts()}
        bronze = {name: f"{self.of.bronze}/{name}" for name in unseen}
        parts = {name: self._parts(bronze[name], unseen[name]) for name in unseen}
        both = parts["prices"] | parts["announcements"]
        if not both:
            return {}
        bars = usable_bars(read_layer(
            self.spark, bronze["prices"], LANDED_BARS, version=unseen["prices"]), self._ARRIVAL)
        events = usable_announcements(read_layer(
            self.spark, bronze["announcements"], LANDED_ANNOUNCEMENTS, version=unseen["announcements"]), self._ARRIVAL)
        counts: dict[str, dict[str, int]] = {"silver": {}}
        for name, fresh, stored, label, sort_by in (
                ("prices", bars, STORED_BARS, labelled_bars, "trade_date"),
                ("announcements", events, STORED_ANNOUNCEMENTS, labelled_announcements, "event_date")):
            if parts[name]:
                old = self._some(f"silver/{name}", stored, parts[name]).select(*fresh.columns)
                merged = conform(label(old.unionByName(fresh), self.config, self._ARRIVAL), stored)
                counts["silver"][name] = self.of._audited(
                    merged, f"silver/{name}", [sort_by], column_figures(stored), replace="touched",
                    touched=parts[name], note=self.of._seen(name))

        note, key = self.of._seen(*self._MADE_OF), ["ticker", "event_id"]
        now = self._some("silver/announcements", ANNOUNCEMENTS, both)
        old_days = self._some("gold/event_day_metrics", EVENT_DAY_METRICS, both)
        old_summary = self._some("gold/event_summary", EVENT_SUMMARY, both)
        affected = self._affected(bars, events, now, old_days, old_summary)
        days = event_day_metrics(now.join(affected, key, "left_semi"),
                                 self._some("silver/prices", BARS, both), self.config)
        counts["event_days"] = {"event_day_metrics": self._replace(
            old_days.join(affected, key, "left_anti").select(*EVENT_DAY_METRICS.fieldNames()).unionByName(days),
            "gold/event_day_metrics", ["event_id", "day"], both, note)}
        if parts["prices"]:
            counts["sessions"] = self.of._write_sessions(
                self._some("silver/prices", BARS, parts["prices"]), replace="touched", touched=parts["prices"],
                note=self.of._seen("prices"))
        # Affected events as they are now, beside the summaries of the others.
        new_days = self._some("gold/event_day_metrics", EVENT_DAY_METRICS, both).join(affected, key, "left_semi")
        summary = event_summary(new_days, self.config.days_before, self.config.days_after)
        others = old_summary.join(affected, key, "left_anti").select(*summary.columns)
        state = cohort_state(self._some("gold/event_day_metrics", EVENT_DAY_METRICS, both))
        counts["cohorts"] = {
            "event_summary": self._replace(
                others.unionByName(summary), "gold/event_summary", ["event_date"], both, note),
            "cohort_state": self._replace(
                conform(state, COHORT_STATE), "gold/cohort_state", ["relative_day"], both, note),
            "daily_cohort_metrics": self.of._write_cohorts(
                read_layer(self.spark, self._path("gold/event_day_metrics"), EVENT_DAY_METRICS), note),
        }
        return counts

    def _affected(self, bars: DataFrame, events: DataFrame, now: DataFrame, *gold: DataFrame) -> DataFrame:
        """(ticker, event_id) whose rows may change: new and corrected announcements, the ids these have
        in gold, and events with a new bar inside their window."""
        dated = events.select("ticker", "event_date")
        announced = [x.join(dated, ["ticker", "event_date"], "left_semi").select("ticker", "event_id")
                     for x in (now, *gold)]
        grid = event_days(now, self.config.end, self.config.days_before, self.config.days_after)
        priced = bars.select("ticker", F.col("trade_date").alias("day"))
        found = grid.join(priced, ["ticker", "day"], "left_semi").select("ticker", "event_id")
        for more in announced:
            found = found.unionByName(more)
        return found.distinct()
