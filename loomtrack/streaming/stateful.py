"""Streams with a fold's state per key: the same folds as in batch jobs, fed micro-batch by micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtrack.functions.shared import written
from loomtrack.operators import handoffs
from loomtrack.operators.association import HYPOTHESES, Site, associate, forget
from loomtrack.operators.graph import connected_components
from loomtrack.operators.sessions import screened
from loomtrack.operators.identities import INPUT, OUTPUT, Epoch, Limits
from loomtrack.operators.parcels import EVENTS, LIFE_INPUT, LIFE_STATE, MATCH_INPUT, MATCHES, Life, Matching, life_flags

_STATE = "blob binary"


def _plain(row: tuple) -> tuple:
    return tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in row)


def _steps(pdfs: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(epoch, frame, rows) of a micro-batch's rows of one key, in order."""
    rows = pd.concat(list(pdfs))
    for (epoch, frame), part in rows.sort_values(["stream_epoch", "frame_index", *columns[:2]]).groupby(["stream_epoch", "frame_index"], sort=True):
        yield int(epoch), int(frame), [_plain(r) for r in part[columns].astype(object).itertuples(index=False, name=None)]


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def stream_identities(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """ST2 over a stream (SS6): ``identity_input`` rows with a watermarked ``event_time`` column.

    All boxes of a frame must arrive in one micro-batch, as they do from one line per frame.
    A new epoch ends the tracks of the one before; numbers go on. When event time has passed
    the occlusion limit by an hour without a frame of a source, its tracks end.
    """
    schema = f"session_id string, source_id string, stream_epoch int, frame_index long, {OUTPUT}"
    names = _names(schema)

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, shift, frame, fold = pickle.loads(state.get[0]) if state.exists else (None, 0, 0, None)
        out: list[tuple] = []

        def put(found: list[tuple]) -> None:
            for kind, at, event, number, backend, status, reason, numbers, *rest in found:
                out.append((*key, epoch, frame, kind, at, event, None if number is None else number + shift, backend, status, reason, None if numbers is None else [n + shift for n in numbers], *rest))

        if state.hasTimedOut:
            put(fold.end())
            state.remove()
        else:
            newest = 0
            for e, f, part in _steps(pdfs, [*INPUT, "event_time"]):
                if fold is None or e != epoch:
                    if fold is not None:
                        put(fold.end())
                        shift += fold.fresh - 1
                    epoch, fold = e, Epoch(limits)
                frame = f
                newest = max(newest, *(int(r[-1].timestamp() * 1000) for r in part))
                put(fold.frame([r[:-1] for r in part]))
            state.update((pickle.dumps((epoch, shift, frame, fold)),))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 3_600_000 + int(limits.occlusion * 1000))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("session_id", "source_id").applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Matches(StatefulProcessor):
    """ST3 of one source: an entry for each pair of the last seconds, one for each parcel's last operator, one for each parcel in the last frame."""

    columns = [*MATCH_INPUT, "event_time", "zone_id", "zone_kind", "speed"]

    def __init__(self, remember: float):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getMapState("pairs", "parcel long, person long", "touching double, apart double")
        self.operators = handle.getMapState("operators", "parcel long", "person long, seen double")
        self.visible = handle.getMapState("visible", "parcel long", "seen double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept_pairs = {tuple(k): [_number(v[0]), _number(v[1])] for k, v in self.pairs.iterator()}
        kept_operators = {k[0]: tuple(v) for k, v in self.operators.iterator()}
        visible = {k[0] for k, _ in self.visible.iterator()}
        was_visible = set(visible)
        matching = Matching(kept_pairs, {p: v[0] for p, v in kept_operators.items()})
        seen, out, now, match_names = {p: v[1] for p, v in kept_operators.items()}, [], None, _names(MATCHES)
        for epoch, frame, part in _steps(rows, self.columns):
            part = [(r[0], *(None if v is None else int(v) for v in r[1:3]), *r[3:]) for r in part]  # pandas makes floats of ids beside nulls
            now, at = part[0][0], part[0][len(MATCH_INPUT)]
            found = {m[0]: dict(zip(match_names, m)) for m in matching.frame([r[: len(MATCH_INPUT)] for r in part])}
            here = {r[1]: dict(zip(self.columns, r)) for r in part if r[1] is not None}
            seen.update(dict.fromkeys(here, now))
            for parcel in sorted({*here, *visible}):
                values = {**here.get(parcel, {}), **found.get(parcel, {}), "visible": parcel in here, "timestamp_global": now, "event_time": at, "parcel_id": parcel, "stream_epoch": epoch, "frame_index": frame}
                out.append((*key, *(values.get(c) for c in _LIFE_ROW)))
            visible = set(here)
        if now is not None:
            _write(self.pairs, kept_pairs, matching.open_pairs())
            _write(self.operators, kept_operators, {p: (q, seen.get(p, now)) for p, q in matching.operator.items() if now - seen.get(p, now) <= self.remember})
            _write(self.visible, {(p,): None for p in was_visible}, {(p,): (now,) for p in visible})
        yield pd.DataFrame(out, columns=["session_id", "source_id", *_LIFE_ROW])

    def close(self) -> None:
        pass


class _Lives(StatefulProcessor):
    """ST4 of one parcel: its state, until it has not been heard of for ``remember`` seconds of event time."""

    def __init__(self, remember: float):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life = Life(_plain(self.life.get()) if self.life.exists() else None)
        out, newest = [], 0
        for epoch, frame, part in _steps(rows, [*LIFE_INPUT, "event_time"]):
            out += [(*key, epoch, frame, *e) for e in life.frame([(*r[:3], None if r[3] is None else int(r[3]), *r[4:-1]) for r in part])]
            newest = max(newest, *(int(r[-1].timestamp() * 1000) for r in part))
        self.life.update(life.kept())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + int(self.remember * 1000))
        yield pd.DataFrame(out, columns=_names(_LIVES))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.life.clear()
        yield pd.DataFrame([], columns=_names(_LIVES))

    def close(self) -> None:
        pass


_LIFE_TYPES = "parcel_id long, stream_epoch int, frame_index long, timestamp_global double, event_time timestamp, visible boolean, zone_id string, zone_kind string, doubt boolean, speed double, person_id long, score double, reliable boolean, ambiguous boolean, distance double, contact boolean, separation_s double, motion double"
_LIFE_ROW = _names(_LIFE_TYPES)
_LIVES = f"session_id string, source_id string, parcel_id long, stream_epoch int, frame_index long, {EVENTS}"


def _number(value):
    return None if value is None or value != value else value


def _write(state, before: dict, after: dict) -> None:
    """Brings a map state from ``before`` to ``after``, touching only entries that differ."""
    as_key = lambda k: k if isinstance(k, tuple) else (k,)
    for k in before.keys() - after.keys():
        state.removeKey(as_key(k))
    for k, v in after.items():
        if k not in before or before[k] != v:
            state.updateValue(as_key(k), tuple(v))


#: Where map states live; without it ``stream_parcel_states`` cannot start.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_parcel_states(rows: DataFrame, remember: float = 3600.0) -> DataFrame:
    """ST3 and ST4 over a stream (SS7): ``match_input`` rows with a watermarked ``event_time``, and ``zone_id``, ``zone_kind`` and ``speed`` of the parcel.

    All pairs of a frame must arrive in one micro-batch. Two stateful steps: per source, one map entry for each pair
    of the last seconds, each parcel's operator and each parcel in view; per parcel, its life, which an event-time timer drops
    when nothing was heard of it for ``remember`` seconds. A batch rewrites only entries that change. The session needs the settings ``STORE``.
    """
    matched = rows.groupBy("session_id", "source_id").transformWithStateInPandas(_Matches(remember), f"session_id string, source_id string, {_LIFE_TYPES}", "append", "eventTime", eventTimeColumnName="event_time")
    flagged = life_flags(matched).select("session_id", "source_id", "parcel_id", "stream_epoch", "frame_index", "event_time", *LIFE_INPUT)
    return flagged.groupBy("session_id", "source_id", "parcel_id").transformWithStateInPandas(_Lives(remember), _LIVES, "append", "eventTime")


class _Admission(StatefulProcessor):
    """SS5 of one source: its highest epoch, and how often each verdict was given."""

    columns = ["arrival", "refusal", "stream_epoch", "received_at", "expires_at"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.given = handle.getMapState("given", "verdict string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        highest = int(self.epoch.get()[0]) if self.epoch.exists() else -1
        given = {k[0]: int(v[0]) for k, v in self.given.iterator()}
        before, out = dict(given), []
        for arrival, refusal, epoch, received, expires in map(_plain, pd.concat(list(rows)).sort_values("arrival")[self.columns].astype(object).itertuples(index=False, name=None)):
            verdict = refusal or ("OLD_EPOCH" if int(epoch or 0) < highest else "LATE" if received > (expires or 0.0) else "ACCEPTED")
            if refusal is None:
                highest = max(highest, int(epoch or 0))
            given[verdict] = given.get(verdict, 0) + 1
            out.append((*key, arrival, verdict, given[verdict]))
        self.epoch.update((highest,))
        _write(self.given, {(k,): (n,) for k, n in before.items()}, {(k,): (n,) for k, n in given.items()})
        yield pd.DataFrame(out, columns=["source_id", "arrival", "verdict", "so_far"])

    def close(self) -> None:
        pass


def stream_admissions(results: DataFrame, active: DataFrame) -> DataFrame:
    """(source_id, arrival, verdict, so_far): ``admit_screened`` over a stream; ``so_far`` counts the source's results of that verdict.

    Results of a source must come in the order of ``arrival`` from batch to batch. The state is an epoch and at most five
    counters for each source. The session needs the settings ``STORE``.
    """
    rows = screened(results, active)
    return rows.groupBy("source_id").transformWithStateInPandas(_Admission(), "source_id string, arrival long, verdict string, so_far long", "append", "none")


class Pending:
    """Tracklets of a session that wait for others of their link (topology component and role).

    A link is ready once the session's newest end is ``window`` seconds past its own newest, once its
    oldest has waited so long by the clock, once one has expired, or when more than ``most`` wait.
    """

    def __init__(self, window: float = 0.75, expiry: float = 30.0, most: int = 1000):
        self.window, self.expiry, self.most = window, max(window, expiry), most
        self.rows: dict[str, tuple[str, float, float]] = {}  # tracklet: link, end, received

    def add(self, tracklet: str, link: str, ended: float, received: float) -> list[str]:
        """Takes a tracklet (a known one is ignored); returns those that no longer fit, oldest first."""
        self.rows.setdefault(tracklet, (link, ended, received))
        over = sorted(self.rows, key=lambda t: (self.rows[t][2], self.rows[t][1], t))[: max(0, len(self.rows) - self.most)]
        for t in over:
            del self.rows[t]
        return over

    def ready(self, now: float, force: bool = False) -> list[str]:
        """Takes out and returns the tracklets of all ready links, by end and id."""
        if not self.rows:
            return []
        newest, links = max(end for _, end, _ in self.rows.values()), {}
        for t, (link, end, received) in self.rows.items():
            links.setdefault(link, []).append((end, received, t))
        out = []
        for rows in links.values():
            waited = now - min(r[1] for r in rows)
            if force or newest - max(r[0] for r in rows) >= self.window or waited >= min(self.window, self.expiry):
                out += rows
        for _, _, t in out:
            del self.rows[t]
        return [t for _, _, t in sorted(out, key=lambda r: (r[0], r[2]))]


def links_of(edges: DataFrame) -> DataFrame:
    """(camera_role, link): the role with the topology component it belongs to, the component named by its smallest role."""
    parts = connected_components(edges.select("from_role", "to_role"), "from_role", "to_role")
    return parts.select(F.col("id").alias("camera_role"), F.concat_ws(":", "component", "id").alias("link"))


def pending_handoffs(tracklets: DataFrame, window: float = 0.75, expiry: float = 30.0, most: int = 1000, clock: str | None = None) -> DataFrame:
    """(session_id, batch, position, tracklet_id, overflow): SS2 over a stream of (session_id, tracklet_id, link, ended_at_global).

    The state of a session is its waiting tracklets, at most ``most``; overflow is handed on at once, nothing is
    dropped. Links that are ready together form one batch in the order of end and id. Waiting by
    the clock uses the processing time, or the largest value of the column ``clock`` in tests.
    """
    schema = "session_id string, batch long, position int, tracklet_id string, overflow boolean"

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, batch = pickle.loads(state.get[0]) if state.exists else (Pending(window, expiry, most), 0)
        out, now = [], state.getCurrentProcessingTimeMs() / 1000
        for pdf in pdfs if not state.hasTimedOut else ():
            for r in pdf.sort_values([clock] if clock else ["ended_at_global", "tracklet_id"]).itertuples(index=False):
                now = getattr(r, clock) if clock else now
                out += [(*key, -1, k, t, True) for k, t in enumerate(pending.add(r.tracklet_id, r.link, r.ended_at_global, now))]
        found = pending.ready(now)
        out += [(*key, batch, k, t, False) for k, t in enumerate(found)]
        state.update((pickle.dumps((pending, batch + bool(found))),))
        if pending.rows:
            state.setTimeoutDuration(max(1, int(window * 1000)))
        yield pd.DataFrame(out, columns=_names(schema))

    return tracklets.groupBy("session_id").applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_handoffs(ready: DataFrame, tracklets: DataFrame, edges: DataFrame, zones: DataFrame, path: str, checkpoint: str, vectors: DataFrame | None = None, remember: float = 600.0, least: float = handoffs.MIN_SCORE, margin: float = handoffs.MARGIN):
    """Starts SS8: each micro-batch of ready tracklets is decided (GR6), and settles open hypotheses as later evidence (ST8).

    ``tracklets`` is the table of all finished tracklets, read by session and id. Of the past a batch reads one snapshot, that of the batch before
    it: recent tracklets with their parcels, and open hypotheses (``association.forget`` keeps it small), so its time does not grow with the number of batches. Under ``path``
    every batch writes ``decisions``, ``evidence``, ``known`` and ``hypotheses`` in a folder of its number; a repeated batch finds the
    same snapshot and overwrites what it wrote.
    """
    spark = tracklets.sparkSession
    columns = [*tracklets.columns, *(["camera_id"] if "camera_id" not in tracklets.columns else []), "parcel_id"]

    def decide(batch: DataFrame, batch_id: int) -> None:
        wanted = written(batch.select("session_id", "tracklet_id").distinct(), "handoff-wanted")
        new = tracklets.join(wanted.hint("merge"), ["session_id", "tracklet_id"])
        new = new if "camera_id" in tracklets.columns else new.withColumn("camera_id", F.col("camera_role"))
        new = written(new.withColumn("parcel_id", F.lit(None).cast("string")).select(*columns), "handoff-batch")
        if batch_id:
            before = Site(*(spark.read.parquet(f"{path}/{name}/batch={batch_id - 1}") for name in ("known", "hypotheses")))
        else:
            before = Site(new.limit(0), spark.createDataFrame([], HYPOTHESES))
        decided, said, after = associate(new, before, edges, zones, vectors, least, margin)
        kept = forget(after, remember)
        parts = {"decisions": decided, "known": kept.tracklets, "hypotheses": kept.hypotheses} | ({"evidence": said} if said is not None else {})
        for name, table in parts.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    return ready.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
