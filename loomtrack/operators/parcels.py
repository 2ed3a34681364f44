"""Who handles which parcel (ST3), and what happens to a parcel (ST4)."""

from __future__ import annotations

from math import hypot, inf

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, TRACK
from loomtrack.functions.shared import written
from loomtrack.operators.frames import person_motion, tag_zones, track_velocity, zone_kind
from loomtrack.operators.handoffs import _solve
from loomtrack.operators.interactions import parcel_person_pairs
from loomtrack.operators.keyed import SPREAD, Fold, fold_frames, parts_of

# Fixed values of the rules.
CONTACT, CANDIDATE, UNCLEAR, SWITCH, FORGET = 0.08, 0.28, 0.08, 0.18, 3.0
LEAST_PAIR, LEAST_SAME, LEAST_NEW = 0.25, 0.30, 0.42
WEIGHTS = {"proximity": 0.35, "overlap": 0.20, "contact": 0.15, "motion": 0.15, "pick": 0.05, "previous": 0.10}
FULL_CONTACT = 0.15
#: Frames after which pairs that are long out of sight are dropped.
SWEEP = 256
MOVING, TOGETHER, CARRY_DISTANCE, DROP_SCORE, RESTING = 0.005, 0.35, 0.14, 0.20, 0.03
SECONDS = {"pickup_candidate": 0.05, "picked": 0.15, "carried": 0.25, "drop_candidate": 0.05, "dropped": 0.20}


def best_pairs(gains: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The pairs of positive gain of largest total, by connected group: the best pair of a star (ties: the smaller ids), else the solver's."""
    near: dict[tuple[str, int], list] = {}
    for (p, q), g in gains.items():
        if g > 0:
            near.setdefault(("p", p), []).append(("q", q))
            near.setdefault(("q", q), []).append(("p", p))
    out, seen = [], set()
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        group = [start]
        for node in group:
            for other in near[node]:
                if other not in seen:
                    seen.add(other)
                    group.append(other)
        parcels, persons = (sorted(k for side, k in group if side == s) for s in "pq")
        if len(parcels) == 1 or len(persons) == 1:
            out.append(max(((p, q) for p in parcels for q in persons), key=lambda pair: (gains[pair], -pair[0], -pair[1])))
        else:
            gain = np.array([[max(0.0, gains.get((p, q), 0.0)) for q in persons] for p in parcels])
            out += [(parcels[i], persons[j]) for i, j in _solve(gain)]
    return sorted(out)


class Matching(Fold):
    """Parcels and persons of a source matched one to one, frame by frame; keeps contacts and each parcel's last operator."""

    def __init__(self, pairs: dict[tuple[int, int], list] | None = None, operators: dict[int, int] | None = None):
        """``pairs`` and ``operators``: what ``open_pairs`` and ``operator`` were after an earlier frame."""
        self.since = {pair: [*times, 0] for pair, times in (pairs or {}).items()}  # of a pair: contact since, separation since, the step it was last seen in
        self.operator: dict[int, int] = dict(operators or {})
        self.step, self.now, self.last = 0, 0.0, list(self.since)  # of the frame before: number, time and pairs

    def open_pairs(self) -> dict[tuple[int, int], list]:
        """Contact since and separation since of each pair that is not forgotten."""
        return {pair: times[:2] for pair, times in self.since.items() if not (times[2] < self.step and self.now - times[1] > FORGET)}

    def _forgotten(self, times: list) -> bool:
        """Whether the pair was out of sight in the frame before, apart for longer than ``FORGET``."""
        return times[2] < self.step - 1 and self.now - times[1] > FORGET

    def frame(self, rows: list[tuple]) -> list[tuple]:
        """``rows``: (time, parcel, person, distance, overlap, motion, pick, doubt); null parcel or person where there is none."""
        now, since = rows[0][0], self.since
        self.step += 1
        if now < self.now or self.step % SWEEP == 0:  # while time goes on, the frame before is enough to tell
            for pair in [pair for pair, times in since.items() if self._forgotten(times)]:
                del since[pair]
        near: dict[int, dict[int, tuple]] = {}
        here = []
        for _, parcel, person, distance, overlap, motion, pick, doubt in rows:
            if parcel is None or person is None:
                continue
            pair = parcel, person
            here.append(pair)
            times = since.get(pair)
            if times is None or self._forgotten(times):
                times = since[pair] = [None, None, self.step]
            touching = distance <= CONTACT
            times[:] = (now if times[0] is None else times[0], None, self.step) if touching else (None, now if times[1] is None else times[1], self.step)
            same = self.operator.get(parcel) == person
            if distance <= CANDIDATE or same or overlap:
                held, apart = (now - times[0], 0.0) if touching else (0.0, now - times[1])
                parts = (
                    WEIGHTS["proximity"] * max(0.0, 1 - distance / CANDIDATE), WEIGHTS["overlap"] * float(overlap), WEIGHTS["contact"] * min(held / FULL_CONTACT, 1.0),
                    WEIGHTS["motion"] * motion, WEIGHTS["pick"] * float(pick), WEIGHTS["previous"] * float(same),
                )
                near.setdefault(parcel, {})[person] = (min(1.0, sum(parts)), distance, overlap, touching, held, apart, motion, doubt, same)
        for pair in self.last:
            times = since[pair]
            if times[2] != self.step:
                times[:2] = None, now if times[1] is None else times[1]
        self.last, self.now = here, now
        out = []
        for parcel, person in best_pairs({(p, q): v[0] - LEAST_PAIR for p, of in near.items() for q, v in of.items()}):
            score, distance, overlap, touching, held, apart, motion, doubt, same = near[parcel][person]
            rival = max((v[0] for q, v in near[parcel].items() if q != person), default=None)
            close = rival is not None and score - rival < UNCLEAR
            before = self.operator.get(parcel)
            blocked = before not in (None, person) and before in near[parcel] and score < near[parcel][before][0] + SWITCH
            reliable = score >= (LEAST_SAME if same else LEAST_NEW) and not (close or doubt or blocked)
            if reliable and (touching or before in (None, person)):
                self.operator[parcel] = person
            reasons = [r for r, yes in (("PARCEL_IDENTITY_AMBIGUOUS", doubt), ("ASSOCIATION_MARGIN_TOO_SMALL", close), ("OPERATOR_SWITCH_BLOCKED_BY_HYSTERESIS", blocked)) if yes]
            out.append((parcel, person, score, reliable, bool(close or doubt), distance, bool(overlap), touching, held, apart, motion, reasons))
        return out


MATCHES = "parcel_id long, person_id long, score double, reliable boolean, ambiguous boolean, distance double, overlap boolean, contact boolean, contact_s double, separation_s double, motion double, reasons array<string>"
MATCH_INPUT = ["timestamp_global", "parcel_id", "person_id", "distance", "overlap", "motion", "pick", "doubt"]


def match_input(obs: DataFrame, wrists: DataFrame, zones: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """The pair table that ``interaction_matches`` folds: one row per parcel and person of a frame, and rows for lone ones.

    ``obs`` has parcels with ``identity_status`` and persons; velocities and zones are added here.
    """
    diagonal = float(np.hypot(width, height))
    parcels = zone_kind(tag_zones(track_velocity(obs.where("class_name = 'parcel'")), zones), zones)
    persons = person_motion(obs.where("class_name = 'person'"))
    w = Window.partitionBy(*TRACK).orderBy("frame_index")
    moving = persons.select(*FRAME, F.col("local_track_id").alias("person_id"), F.col("vx").alias("person_vx"), F.col("vy").alias("person_vy"), (F.col("timestamp_global") - F.lag("timestamp_global").over(w)).alias("step"))
    own = parcels.select(*FRAME, "timestamp_global", F.col("local_track_id").alias("parcel_id"), "vx", "vy", F.coalesce(F.col("zone_kind") == "pick", F.lit(False)).alias("pick"), (F.col("identity_status") == "AMBIGUOUS").alias("doubt"))
    pairs = parcel_person_pairs(obs.where("class_name = 'parcel'"), obs.where("class_name = 'person'"), wrists, diagonal)
    apart = F.hypot(F.col("vx") - F.col("person_vx"), F.col("vy") - F.col("person_vy")) / diagonal
    fresh = F.col("step").isNull() | (F.col("step") <= 1e-6) | (F.col("step") > 2.0)
    motion = F.when(fresh, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - apart / 0.35))
    full = own.join(pairs.hint("merge"), [*FRAME, "parcel_id"], "left").join(moving.hint("merge"), [*FRAME, "person_id"], "left")
    alone = obs.where("class_name = 'person'").select(*FRAME, "timestamp_global").distinct()
    rows = full.select(*FRAME, "timestamp_global", "parcel_id", "person_id", "distance", "overlap", motion.alias("motion"), "pick", "doubt")
    return rows.unionByName(alone, allowMissingColumns=True)


def interaction_matches(rows: DataFrame) -> DataFrame:
    """(frame, parcel_id, person_id, score, reliable, ...): ST3, one row per matched parcel of a frame.

    Each source is folded in the order of its frames; only the pairs of the last seconds are
    held. ``rows`` come from ``match_input``.
    """
    return fold_frames(rows, ["session_id", "source_id"], ["stream_epoch", "frame_index"], MATCH_INPUT, Matching, MATCHES, SPREAD)


PARCEL, PERSON, HAND = range(3)
SCENE_INPUT = ["kind", "number", "timestamp_global", "x1", "y1", "x2", "y2", "vx", "vy", "step", "pick", "doubt"]


def _beyond(low: float, v: float | None, high: float) -> float:
    """How far ``v`` lies outside of low to high; null is no distance."""
    if v is None or low <= v <= high:
        return 0.0
    return max(0.0, low - v, v - high)


class Scene(Matching):
    """As ``Matching``, over the boxes and wrists of a frame: their pairs are made here, by the rules of ``match_input``."""

    def __init__(self, diagonal: float):
        super().__init__()
        self.diagonal = diagonal

    def frame(self, rows: list[tuple]) -> list[tuple]:
        """``rows``: as ``SCENE_INPUT`` says; a wrist has its person's number and its place as x1 and y1."""
        parcels, persons, hands, now = [], [], {}, inf
        for kind, number, at, x1, y1, x2, y2, *more in rows:
            if kind == HAND:
                hands.setdefault(number, []).append((x1, y1))
                continue
            if at < now:
                now = at
            if number is not None:
                if x1 is None or y1 is None or x2 is None or y2 is None:  # a corner that is not known bounds nothing
                    area, x1, y1, x2, y2 = 1.0, -inf if x1 is None else x1, -inf if y1 is None else y1, inf if x2 is None else x2, inf if y2 is None else y2
                else:
                    area = max(1.0, (x2 - x1) * (y2 - y1))
                (parcels if kind == PARCEL else persons).append((number, x1, y1, x2, y2, area, *more))
        if now == inf:
            return []  # wrists alone are no frame
        pairs = []
        near = [(*p, hands.get(p[0], ())) for p in persons]
        for parcel, left, top, right, bottom, area, vx, vy, _, pick, doubt in parcels:
            for person, x1, y1, x2, y2, other, person_vx, person_vy, step, _, _, of_person in near:
                reach = min([hypot(_beyond(left, x, right), _beyond(top, y, bottom)) for x, y in of_person], default=None)
                w, h = (right if right < x2 else x2) - (left if left > x1 else x1), (bottom if bottom < y2 else y2) - (top if top > y1 else y1)
                overlap = 0 < w < inf and 0 < h < inf and area + other - w * h + 1e-6 > 0
                if step is None or step <= 1e-6 or step > 2.0:
                    motion = 0.5
                else:
                    motion = 0.0 if person_vx is None or person_vy is None else max(0.0, 1 - hypot(vx - person_vx, vy - person_vy) / self.diagonal / 0.35)
                pairs.append((now, parcel, person, 10.0 if reach is None else reach / self.diagonal, overlap, motion, pick, doubt))
        return super().frame(pairs or [(now, None, None, None, None, None, None, None)])


def scene_matches(obs: DataFrame, wrists: DataFrame, zones: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """``interaction_matches`` of ``match_input``, for tables: boxes and wrists are shuffled once each to their source, their pairs never.

    Zones are looked up before velocities, so that a shuffle carries no more than the fold reads.
    """
    box = [*FRAME, "timestamp_global", "local_track_id", "x1", "y1", "x2", "y2"]
    flags = {"pick": F.coalesce(F.col("zone_kind") == "pick", F.lit(False)), "doubt": F.col("identity_status") == "AMBIGUOUS"}
    parcels = track_velocity(zone_kind(tag_zones(obs.where("class_name = 'parcel'"), zones), zones).withColumns(flags).select(*box, *flags))
    persons = person_motion(obs.where("class_name = 'person'").select(*box)).withColumn("step", F.col("timestamp_global") - F.lag("timestamp_global").over(Window.partitionBy(*TRACK).orderBy("frame_index")))
    hands = wrists.select(*FRAME, F.col("person_id").alias("local_track_id"), F.col("wx").alias("x1"), F.col("wy").alias("y1"))
    kind = lambda rows, k: rows.withColumn("kind", F.lit(k))
    rows = kind(parcels, PARCEL).unionByName(kind(persons, PERSON), True).unionByName(kind(hands, HAND), True).dropna(subset=list(FRAME)).withColumnRenamed("local_track_id", "number")
    diagonal = float(np.hypot(width, height))
    return fold_frames(rows, ["session_id", "source_id"], ["stream_epoch", "frame_index"], SCENE_INPUT, lambda: Scene(diagonal), MATCHES, SPREAD)


#: Per clock, in the order in which a frame is judged: the state, whether the clock must run (for so many seconds) or stand still, the next state, and what is told.
RULES = (
    ("lift", (
        ("PICK_CANDIDATE", False, 0.0, "ON_CONVEYOR", ("pickup_cancelled",)),
        ("ON_CONVEYOR", True, SECONDS["pickup_candidate"], "PICK_CANDIDATE", ("pickup_candidate",)),
        ("PICK_CANDIDATE", True, SECONDS["picked"], "PICKED", ("parcel_picked",)),
    )),
    ("carry", (("PICKED", True, SECONDS["carried"], "CARRIED", ("parcel_carried",)),)),
    ("rest", (
        ("DROP_CANDIDATE", False, 0.0, "CARRIED", ("drop_cancelled",)),
        ("CARRIED", True, SECONDS["drop_candidate"], "DROP_CANDIDATE", ("destination_observed", "drop_candidate")),
        ("DROP_CANDIDATE", True, SECONDS["dropped"], "DROPPED", ("destination_confirmed", "parcel_dropped")),
    )),
)
#: States in which a clock can run, and the event that a step back makes possible anew.
RUNS_IN = {"lift": (), "carry": ("PICKED", "CARRIED"), "rest": ("CARRIED", "DROP_CANDIDATE")}
ANEW = {"pickup_cancelled": "pickup_candidate", "drop_cancelled": "drop_candidate"}

EVENTS = "at double, event_type string, state string, operator_id long, person_id long, score double, destination_zone string"
#: What a parcel's fold reads of a frame; ``life_flags`` makes the last four.
LIFE_INPUT = ["timestamp_global", "visible", "zone_id", "person_id", "score", "frozen", "sure", "lift", "carry", "rest"]
LIFE_STATE = "state string, candidate long, operator long, zone string, shadow boolean, lift double, carry double, rest double, told string"


def life_flags(rows: DataFrame) -> DataFrame:
    """Adds what a frame says of its parcel: ``frozen`` (in doubt), ``sure`` (reliably matched), and whether it looks like a lift, a carry or a rest.

    ``rows`` have visible, zone_id, zone_kind, doubt, speed and the match's person_id, score, reliable, ambiguous, distance, contact, separation_s and motion.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    matched = F.col("person_id").isNotNull()
    dynamic = matched & (F.col("speed") >= MOVING) & (F.col("motion") >= TOGETHER)
    sure = matched & F.col("reliable")
    return rows.withColumns({
        "frozen": yes(F.col("doubt")) | yes(matched & F.col("ambiguous")), "sure": yes(sure), "lift": yes(sure & dynamic & F.col("contact") & (F.col("zone_kind") == "pick")),
        "carry": yes(sure & dynamic & (F.col("contact") | (F.col("distance") <= CARRY_DISTANCE))),
        "rest": yes(matched & (F.col("zone_kind") == "destination") & (F.col("score") >= DROP_SCORE) & ~F.col("contact") & (F.col("separation_s") > 0) & (F.col("speed") <= RESTING)),
    })


class Life(Fold):
    """The state of one parcel, moved by ``RULES``; gives each event once."""

    def __init__(self, kept: tuple | None = None):
        self.state, self.candidate, self.operator, self.zone, self.shadow = kept[:5] if kept else ("ON_CONVEYOR", None, None, None, False)
        self.clocks: dict[str, float | None] = dict(zip(RUNS_IN, kept[5:8] if kept else (None,) * 3))
        self.told = set(filter(None, kept[8].split(","))) if kept else set()

    def kept(self) -> tuple:
        """All of the state, as the columns of ``LIFE_STATE``."""
        return self.state, self.candidate, self.operator, self.zone, self.shadow, *self.clocks.values(), ",".join(sorted(self.told))

    def _names(self, clock: str, person: int | None) -> bool:
        """Whether ``person`` is whom the clock's flag must be about."""
        return person == self.operator if clock != "lift" else self.candidate in (None, person)

    def frame(self, rows: list[tuple]) -> list[tuple]:
        now, visible, zone, person, score, frozen, sure, *flags = rows[0]
        out: list[tuple] = []

        def tell(*events: str, of: int | None = person, by: float = score or 0.0) -> None:
            for event in events:
                self.told.discard(ANEW.get(event, ""))
                if event not in self.told:
                    self.told.add(event)
                    out.append((now, event, self.state, self.operator if self.operator is not None else self.candidate, of, by, self.zone))

        if not visible:  # a carried parcel leaves its operator's name behind, nothing else changes
            if self.state == "CARRIED" and self.operator is not None and not self.shadow:
                self.shadow = True
                tell("parcel_carried_shadow", of=None, by=0.0)
            return out
        if frozen:
            self.clocks["lift"] = self.clocks["rest"] = None
            tell("interaction_ambiguous")
            return out
        for (clock, rules), flag in zip(RULES, flags):
            if clock == "rest" and self.shadow:
                if not (sure and person == self.operator):  # only its operator brings it back
                    self.clocks["rest"] = None
                    break
                self.shadow = False
                tell("parcel_reappeared")
            runs = flag and self._names(clock, person) and (not RUNS_IN[clock] or self.state in RUNS_IN[clock])
            if clock == "lift" and (runs or self.state in ("ON_CONVEYOR", "PICK_CANDIDATE")):
                self.candidate = person if runs else None
            since = self.clocks[clock] = (now if self.clocks[clock] is None else self.clocks[clock]) if runs else None
            for state, running, seconds, after, events in rules:
                if self.state == state and runs == running and (not running or now - since >= seconds):
                    self.state = after
                    if after == "PICKED":
                        self.operator = person
                    if clock == "rest":
                        self.zone = zone if running else None
                    tell(*events)
        return out


def parcel_state_machine(obs: DataFrame, matches: DataFrame, zones: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """(session, source, parcel, frame, at, event_type, state, operator_id, person_id, score, destination_zone): ST4.

    ON_CONVEYOR, PICK_CANDIDATE, PICKED, CARRIED, DROP_CANDIDATE, DROPPED, by durations of
    reliable contact; a lost condition cancels, doubt freezes, a carried parcel out of sight
    leaves a shadow until its operator is seen with it again. Each parcel is folded apart; out of sight only
    the first frame after a sighting counts, which the calendar of the source's frames supplies.

    A parcel that no frame shows lifted never leaves the conveyor: Spark finds its only event, the first frame in doubt. Of
    the others the fold gets each frame that says something, and the first of those in a row that say nothing, or only doubt.
    """
    source = ["session_id", "source_id"]
    calendar = obs.groupBy(*FRAME).agg(F.max("timestamp_global").alias("timestamp_global"))
    order = Window.partitionBy(*source).orderBy("stream_epoch", "frame_index")
    after = calendar.select(*FRAME, *(F.lead(c).over(order).alias(f"next_{c}") for c in ("stream_epoch", "frame_index", "timestamp_global")))
    tagged = zone_kind(tag_zones(obs.where("class_name = 'parcel'"), zones), zones).select(*FRAME, "timestamp_global", "local_track_id", "x1", "y1", "x2", "y2", "zone_id", "zone_kind", (F.col("identity_status") == "AMBIGUOUS").alias("doubt"), F.lit(True).alias("visible"))
    found = matches.select(*FRAME, F.col("parcel_id").alias("local_track_id"), F.struct("person_id", "score", "reliable", "ambiguous", "distance", "contact", "separation_s", "motion").alias("m"))
    near = tagged.unionByName(found, True).repartition(parts_of(obs.sparkSession, SPREAD), *source, "local_track_id")  # one shuffle by parcel serves the match, the velocity and the life
    met = near.withColumn("m", F.max("m").over(Window.partitionBy(*FRAME, "local_track_id"))).where("visible")
    seen = track_velocity(met).select(*FRAME, "timestamp_global", F.col("local_track_id").alias("parcel_id"), "visible", "zone_id", "zone_kind", "doubt", F.hypot(F.col("vx") / width, F.col("vy") / height).alias("speed"), "m.*")
    own = Window.partitionBy(*source, "parcel_id").orderBy("stream_epoch", "frame_index")
    life = life_flags(seen).select(*FRAME, "parcel_id", *LIFE_INPUT).withColumn("says", F.col("sure") | F.col("rest"))
    beside = {"own_epoch": F.lead("stream_epoch").over(own), "own_frame": F.lead("frame_index").over(own), "dull": ~F.col("says") & (F.lag("frozen").over(own) == F.col("frozen")) & ~F.lag("says").over(own)}
    life = written(life.withColumns({**beside, "lifted": F.max("lift").over(Window.partitionBy(*source, "parcel_id"))}), "parcels-life")
    lifted = life.where("lifted")
    places = lifted.select(*FRAME, "parcel_id", "own_epoch", "own_frame").join(written(after, "parcels-calendar").hint("merge"), list(FRAME))
    missed = places.where("next_frame_index IS NOT NULL AND NOT (own_epoch <=> next_stream_epoch AND own_frame <=> next_frame_index)")
    gone = missed.select(*source, F.col("next_stream_epoch").alias("stream_epoch"), F.col("next_frame_index").alias("frame_index"), F.col("next_timestamp_global").alias("timestamp_global"), "parcel_id", F.lit(False).alias("visible"))
    rows = lifted.where("NOT coalesce(dull, false)").select(*FRAME, "parcel_id", *LIFE_INPUT).unionByName(gone, allowMissingColumns=True)
    folded = fold_frames(rows, [*source, "parcel_id"], ["stream_epoch", "frame_index"], LIFE_INPUT, Life, EVENTS)
    first = F.min_by(F.struct("stream_epoch", "frame_index", F.col("timestamp_global").alias("at"), "person_id", F.coalesce("score", F.lit(0.0)).alias("score")), F.struct("stream_epoch", "frame_index"))
    still = life.where("NOT lifted AND frozen").groupBy(*source, "parcel_id").agg(first.alias("f")).select(*source, "parcel_id", "f.*")
    still = still.withColumns({"event_type": F.lit("interaction_ambiguous"), "state": F.lit("ON_CONVEYOR"), "operator_id": F.lit(None).cast("long"), "destination_zone": F.lit(None).cast("string")})
    return folded.unionByName(still.select(*folded.columns))
