"""Incident lifecycle as a stream with keyed state.

Every fingerprint keeps its state, its episode and its passes, and the ids already processed, in the
state store; no earlier output is read. A source is spread over lanes by fingerprint, so that a busy source is no
single key; an outage of a source goes to all its lanes. Batches must arrive in time order per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.incidents import ACTIVE, is_critical
from tidemark.session import ship
from tidemark.streaming.tables import batch_writer, drain

LANES = 64
OUTAGE = "SOURCE_UNAVAILABLE"
EVENT = ["source", "category", "fingerprint", "observed_at", "observation_id", "status", "baseline"]
DECISIONS = (
    "source string, category string, fingerprint string, observed_at timestamp, observation_id string, status string, "
    "decision string, opens boolean, episode_number int")


def outage_events(outages: DataFrame) -> DataFrame:
    """Outages (source, at) as rows of the event stream."""
    return outages.select(
        "source", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("fingerprint"), F.col("at").alias("observed_at"),
        F.lit(None).cast("string").alias("observation_id"), F.lit(OUTAGE).alias("status"), F.lit(False).alias("baseline"))


class Incident:
    """State of a fingerprint and its transitions; ``outage`` is the source outage it last took note of."""

    def __init__(self, stored: tuple | None):
        self.open, self.episode, self.passes, self.outage = stored or (False, 0, 0, None)

    def stored(self) -> tuple:
        return self.open, self.episode, self.passes, self.outage

    def take(self, status: str, quiet: bool, outage: Any) -> tuple[str, bool]:
        """(decision, whether it opens an episode) of one observation."""
        if outage != self.outage:
            self.passes, self.outage = 0, outage
        if quiet:
            opens = status in ACTIVE and self.episode == 0
            self._open(opens)
            return "BASELINED", opens
        if status in ACTIVE:
            self.passes = 0
            if self.open:
                return "ONGOING", False
            self._open(True)
            return ("NEW" if self.episode == 1 else "RECURRING"), True
        if status != "PASS":
            return "INSUFFICIENT_EVIDENCE", False
        if not self.open:
            return "HEALTHY_NO_INCIDENT", False
        self.passes += 1
        self.open = self.passes < 2
        return ("PENDING_RESOLUTION" if self.open else "RESOLVED"), False

    def _open(self, opens: bool) -> None:
        if opens:
            self.open, self.episode, self.passes = True, self.episode + 1, 0


class Lifecycle(StatefulProcessor):
    """One lane of a source. ``keep_ids_ms`` may bound how long processed ids are remembered."""

    def __init__(self, keep_ids_ms: int | None = None):
        self.keep_ids_ms = keep_ids_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.incidents = handle.getMapState("incidents", "fingerprint string", "open boolean, episode int, passes int, outage bigint")
        self.seen = handle.getMapState("seen", "observation_id string", "known boolean", ttlDurationMs=self.keep_ids_ms)
        self.outage = handle.getValueState("outage", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        events = pd.concat(list(rows))
        events["observed"] = events["status"] != OUTAGE
        events = events.sort_values(["observed_at", "observed", "observation_id"], kind="stable", na_position="first")
        outage = self.outage.get()[0] if self.outage.exists() else None
        held: dict[str, Incident] = {}
        out = []
        for e in events.itertuples(index=False):
            if not e.observed:
                outage = e.observed_at.value // 1_000
                continue
            incident = held.get(e.fingerprint)
            if incident is None:
                known = self.incidents.getValue((e.fingerprint,)) if self.incidents.containsKey((e.fingerprint,)) else None
                incident = held[e.fingerprint] = Incident(known)
            if self.seen.containsKey((e.observation_id,)):
                decision, opens = "DUPLICATE", False
            else:
                self.seen.updateValue((e.observation_id,), (True,))
                decision, opens = incident.take(e.status, e.quiet, outage)
            out.append((e.source, e.category, e.fingerprint, e.observed_at, e.observation_id, e.status, decision, opens, incident.episode))
        for fingerprint, incident in held.items():
            self.incidents.updateValue((fingerprint,), incident.stored())
        if outage is not None:
            self.outage.update((outage,))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in DECISIONS.split(", ")]).astype({"episode_number": "int32"})

    def close(self) -> None:
        pass


def incident_decisions(events: DataFrame, path: str, checkpoint: str, lanes: int = LANES, keep_ids_ms: int | None = None) -> None:
    """Decisions of each micro-batch, with all state carried over, into a folder per batch.

    ``events`` has the columns of ``EVENT``; rows of status ``SOURCE_UNAVAILABLE`` are outages.
    """
    ship(events.sparkSession)
    lane = F.when(F.col("status") == OUTAGE, F.sequence(F.lit(0), F.lit(lanes - 1))).otherwise(
        F.array(F.pmod(F.hash("fingerprint"), F.lit(lanes))))
    quiet = F.col("baseline") & ~F.coalesce(is_critical(), F.lit(False))
    keyed = events.select(*EVENT, F.explode(lane).alias("lane"), F.coalesce(quiet, F.lit(False)).alias("quiet"))
    decided = keyed.groupBy("source", "lane").transformWithStateInPandas(
        statefulProcessor=Lifecycle(keep_ids_ms), outputStructType=DECISIONS, outputMode="Append", timeMode="None" if keep_ids_ms is None else "ProcessingTime")
    drain(decided, checkpoint, "append", sink=batch_writer(path))
