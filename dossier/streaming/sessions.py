"""Structured Streaming forms of the session log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dossier.functions.reports import URGENCY_RANK

WATERMARK = "1 hour"
TTL = "30 minutes"


def expire_sessions(events: DataFrame, key: str = "user_id", watermark: str = WATERMARK, ttl: str = TTL) -> DataFrame:
    """Closed activity sessions, appended once the watermark has passed their idle time.

    Events later than the watermark are dropped by the engine and show up in its dropped-row metric.
    The session end reported is the last activity, not the end of the idle time.
    """
    w = events.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", ttl).alias("w"))
    agg = w.agg(F.max("ts").alias("last_active"), F.count("*").alias("events"))
    return agg.select(key, F.col("w.start").alias("session_start"), "last_active", "events")


class RunningState(StatefulProcessor):
    """Per session: highest urgency so far, distinct flags, answered questions; one row per batch and session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "rank int, answered long")
        self.flags = handle.getMapState("flags", "flag string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank, answered = self.totals.get() if self.totals.exists() else (0, 0)
        for batch in rows:
            ranks = batch["urgency"].map(lambda u: URGENCY_RANK.get(u, 0))
            rank = max(int(rank), int(ranks.max()))
            answered = int(answered) + int(batch["answered"].sum())
            for flag in batch["flag"].dropna().unique():
                if not self.flags.containsKey((str(flag),)):
                    self.flags.updateValue((str(flag),), (True,))
        self.totals.update((rank, answered))
        seen = sorted(k[0] for k in self.flags.keys())
        name = next(w for w, r in URGENCY_RANK.items() if r == rank)
        yield pd.DataFrame({"session_id": [key[0]], "urgency": [name], "flags": [",".join(seen)], "answered": [answered]})

    def close(self) -> None:
        pass


def running_state(messages: DataFrame) -> DataFrame:
    """``messages``: session_id, urgency, flag, answered. Update mode; needs the RocksDB state store."""
    return messages.groupBy("session_id").transformWithStateInPandas(
        RunningState(), "session_id long, urgency string, flags string, answered long", "Update", "None"
    )


class PhaseState(StatefulProcessor):
    """Emits a row whenever the phase of a session differs from the last one seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("phase", "phase string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        ordered = pd.concat(list(rows)).sort_values("turn")
        for turn, phase in zip(ordered["turn"], ordered["phase"]):
            if phase != last:
                out.append((key[0], int(turn), last, phase))
                last = phase
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "turn", "from_phase", "phase"])

    def close(self) -> None:
        pass


def phase_changes(messages: DataFrame) -> DataFrame:
    """``messages``: session_id, turn, phase; arrival in turn order across batches."""
    return messages.groupBy("session_id").transformWithStateInPandas(
        PhaseState(), "session_id long, turn long, from_phase string, phase string", "Append", "None"
    )


class ProfileState(StatefulProcessor):
    """Folds session updates of a person: scalars fill only when empty, habits replace, counters grow."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", "age string, gender string, quit string, sessions long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        age, gender, quit_year, n = self.profile.get() if self.profile.exists() else (None, None, None, 0)
        for batch in rows:
            ordered = batch.sort_values("ord")
            for a, g, q in zip(ordered["age"], ordered["gender"], ordered["quit"]):
                age, gender, quit_year = age or a or None, gender or g or None, q or quit_year
            n = int(n) + len(batch)
        self.profile.update((age, gender, quit_year, n))
        yield pd.DataFrame({"patient": [key[0]], "age": [age], "gender": [gender], "quit": [quit_year], "sessions": [n]})

    def close(self) -> None:
        pass


def fold_profiles(updates: DataFrame) -> DataFrame:
    """``updates``: patient, ord, age, gender, quit; one updated row per person and batch."""
    return updates.groupBy("patient").transformWithStateInPandas(
        ProfileState(), "patient string, age string, gender string, quit string, sessions long", "Update", "None"
    )
