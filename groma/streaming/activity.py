"""Machines on a camera: tracked and judged in one fold, frame by frame.

Tracking and evidence feed each other. A camera that moves clears what the tracks know of
their places and speed; a track that is only held, or found again, decides whether evidence
goes on; appearance tells whether it is the same machine. Idleness needs unbroken evidence:
every doubt (a gap, a hidden or cut-off machine, an unclear picture) starts its clock anew,
and time that no picture covers does not count. Motion of the machine or its mechanism is
work at once.

Pixels are not looked at here. An earlier step gives for each frame how it compares with the
one before: the camera's shift, and on a grid of cells the share of changed pixels, the mean
brightness and its spread; a machine's region is the mean of its cells.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass
from math import ceil, hypot, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groma.streaming.tracks import Box, Track, Tracker, at_once, clipped, correlation, foot, in_order, in_stretches, iou, numbered, published, stretches

#: Seconds, pixels and shares of the frame.
LONGEST_HOLD, LONGEST_MECHANISM, RECHECK_MOBILE, RECHECK_STATIONARY = 30.0, 20.0, 10.0, 30.0
LEAST_STEP, LEAST_GAP, GAP_STEPS, LONGEST_STEP, LEAST_STATIONARY_IDLE = 0.25, 0.6, 1.75, 2.0, 120.0
MOST_SHIFT, LEAST_RESPONSE, MOST_DRIFT, LEAST_SIDE, MARGIN = 3.0, 0.2, 12, 48, 0.12
FRAME_EDGE, HIDDEN_IOU, SAME_IOU, SAME_DISTANCE, SAME_SIDE, SAME_ALIKE = 0.005, 0.1, 0.45, 0.008, 0.15, 0.4
DARKEST, BRIGHTEST, LEAST_SPREAD, UNCERTAIN_SHARE, MOVED_SHARE = 12.0, 248.0, 4.0, 0.35, 0.008
MOST_MISSED_AT_WORK = 2
#: The reasons that an activity is given with.
NO_VIDEO, VIDEO_GAP, CAMERA_MOVED, CAMERA_UNSURE = "insufficient_video", "video_gap", "camera_motion", "camera_registration_uncertain"
STALE, DRIVING, CUT_OFF, TOO_SMALL, HIDDEN = "stale_detection", "vehicle_motion", "truncated_equipment", "roi_too_small", "equipment_occluded"
ELSEWHERE, UNCLEAR, UNCERTAIN = "roi_changed", "roi_unusable", "roi_motion_uncertain"
MOTION_PENDING, IDLE_PENDING, RECHECK = "motion_pending", "idle_pending", "idle_recheck"
HELD, HELD_IN_SIGHT, RECENT, MECHANISM, STILL, NOT_VISIBLE = "track_grace", "visual_track_grace", "recent_motion", "visible_mechanism_motion", "visible_inactivity", "activity_not_visually_observable"
#: Groups of machines, and classes whose activity can be seen.
MOBILE, STATIONARY = "mobile", "stationary_capable"
CHECKABLE = frozenset({"0", "1", "4", "8", "16", "17", "19", "21", "26"})

Region = tuple[int, int, int, int]
FRAME = ["run_id", "clock", "detects", "usable", "width", "height", "scene_shift", "response", "grid_width", "changed", "brightness", "spread"]
FOUND = ["row", "class_id", "score", "x1", "y1", "x2", "y2", "appearance"]
OUT = "run_id long, clock double, row long, track_id int, class_id string, score double, x1 double, y1 double, x2 double, y2 double, observed boolean, missed int, motion string, activity string, basis string"


@dataclass
class Picture:
    """What was measured of a frame against the one before. Grids are rows of cells, from the top left."""

    width: int
    height: int
    shift: float = 0.0
    response: float = 1.0
    grid_width: int = 1
    changed: np.ndarray | None = None
    brightness: np.ndarray | None = None
    spread: np.ndarray | None = None

    def mean(self, grid: np.ndarray, region: Region) -> float:
        """Of the cells that the region touches."""
        cells = np.asarray(grid, np.float64).reshape(-1, self.grid_width)
        across, down = self.grid_width / self.width, len(cells) / self.height
        x1, y1, x2, y2 = region
        part = cells[int(y1 * down) : max(int(y1 * down) + 1, ceil(y2 * down)), int(x1 * across) : max(int(x1 * across) + 1, ceil(x2 * across))]
        return float(np.add.reduce(part, axis=None) / part.size)

    def clear(self, region: Region) -> bool:
        return DARKEST <= self.mean(self.brightness, region) <= BRIGHTEST and self.mean(self.spread, region) >= LEAST_SPREAD

    def motion(self, region: Region, least: float) -> str:
        share = self.mean(self.changed, region)
        return "uncertain" if share > UNCERTAIN_SHARE else "motion" if share >= least else "quiet"

    def region(self, box: Box) -> Region:
        """The box and a margin around it, in pixels."""
        dx, dy = MARGIN * (box[2] - box[0]), MARGIN * (box[3] - box[1])
        return (
            max(0, round((box[0] - dx) * self.width)),
            max(0, round((box[1] - dy) * self.height)),
            min(self.width, round((box[2] + dx) * self.width)),
            min(self.height, round((box[3] + dy) * self.height)),
        )


@dataclass
class Evidence:
    """What is known of one track's activity."""

    reason: str = NO_VIDEO
    region: Region | None = None
    looked: float | None = None
    quiet_since: float | None = None
    unseen: float = 0.0
    hits: int = 0
    place: Box | None = None
    appearance: np.ndarray | None = None
    lost_since: float | None = None
    in_sight: bool = False
    recheck_since: float | None = None
    drove_at: float | None = None
    working_until: float = float("-inf")
    mechanism_until: float = float("-inf")

    @classmethod
    def anew(cls, reason: str) -> Evidence:
        """Evidence(reason); what is not known yet is read from the class, so that nothing is set for each of many tracks."""
        made = cls.__new__(cls)
        made.reason = reason
        return made

    def become(self, other: Evidence) -> None:
        self.__dict__.clear()
        self.__dict__.update(other.__dict__)

    def unlinked(self) -> None:
        """A held track's region was not seen to stay quiet: no evidence goes on from here, what it did before stays."""
        self.region = self.looked = self.quiet_since = None
        self.unseen, self.in_sight, self.reason = 0.0, False, HELD


class Analyzer:
    """Evidence of all tracks of one run."""

    def __init__(self, *, sample: float = 1.0, idle_after: float = 300.0, max_gap: int = 3, groups: Mapping[str, str] | None = None, checkable: Collection[str] = CHECKABLE, moved_share: float = MOVED_SHARE):
        self.sample, self.idle_after, self.groups, self.checkable, self.moved_share = sample, idle_after, groups or {}, frozenset(checkable), moved_share
        self.step = min(sample, LONGEST_STEP)
        self.frame_gap, self.roi_gap = max(LEAST_GAP, GAP_STEPS * self.step), max(LEAST_GAP, (max_gap + 0.5) * self.step)
        self.reconnect, self.hold = min(LONGEST_HOLD, max_gap * sample), min(LONGEST_HOLD, 2 * sample)
        self.known: dict[int, Evidence] = {}
        self.last: float | None = None
        self.compared = False

    def restart(self, reason: str) -> None:
        self.known = {number: Evidence.anew(reason) for number in self.known}

    def invalidate(self) -> None:
        """A frame that cannot be used: nothing goes on across it."""
        self.restart(NO_VIDEO)
        self.last, self.compared = None, False

    def group(self, track: Track) -> str:
        return self.groups.get(track.kind, MOBILE)

    def look(self, clock: float, picture: Picture, tracks: Collection[Track]) -> None:
        """Takes in a frame, whether or not the detector looked at it."""
        after_gap = False
        if self.last is not None:
            away = clock - self.last
            after_gap = away <= 0 or away > self.frame_gap
            if after_gap:
                self.restart(VIDEO_GAP)
                self.compared = False
            if 0 <= away < LEAST_STEP:
                return
        self.last = clock
        if not tracks:
            self.known, self.compared = {}, False
            return
        steady = isfinite(picture.response) and picture.response >= LEAST_RESPONSE and isfinite(picture.shift) and picture.shift <= MOST_SHIFT
        if self.compared and not steady:
            self.restart(CAMERA_MOVED if picture.response >= LEAST_RESPONSE else CAMERA_UNSURE)
            for track in tracks:
                track.shaken()
            return
        self.compared = True
        before, self.known = self.known, {}
        for track in tracks:
            self.known[track.number] = e = before.get(track.number) or Evidence.anew(NO_VIDEO)
            if not track.trusted or track.missed:
                self.look_for_lost(e, clock, picture)
            else:
                others = [t.box for t in tracks if t is not track]
                reason = self.look_at(e, track, others, clock, picture, VIDEO_GAP if after_gap else None)
                if reason:
                    self.known[track.number] = Evidence(reason) if reason != DRIVING else Evidence(DRIVING, drove_at=track.clock, working_until=clock + self.hold)

    def look_for_lost(self, e: Evidence, clock: float, picture: Picture) -> None:
        """A held track: its region, where it was last, must be seen to stay quiet."""
        e.lost_since = clock if e.lost_since is None else e.lost_since
        fresh = e.region is not None and e.looked is not None and clock - e.looked <= self.frame_gap
        if not fresh or not picture.clear(e.region) or picture.motion(e.region, self.moved_share) != "quiet":
            e.unlinked()
            return
        e.looked, e.in_sight, e.reason = clock, True, HELD_IN_SIGHT

    def look_at(self, e: Evidence, track: Track, others: list[Box], clock: float, picture: Picture, gap: str | None) -> str | None:
        """A track that was detected lately. The reason to start anew, or none."""
        if clock - track.clock > self.sample * GAP_STEPS:
            return STALE
        if track.motion() == "moving":
            return DRIVING if e.drove_at != track.clock else None
        if min(track.box[:2]) <= FRAME_EDGE or max(track.box[2:]) >= 1 - FRAME_EDGE:
            return CUT_OFF
        region = picture.region(track.box)
        if min(region[2] - region[0], region[3] - region[1]) < LEAST_SIDE:
            return TOO_SMALL
        if any(iou(track.box, other) > HIDDEN_IOU for other in others):
            return HIDDEN
        begin = e
        if e.lost_since is not None:
            if e.looked is not None and e.in_sight and clock - e.lost_since <= self.reconnect and self.same_machine(e, track):
                e.recheck_since = clock if e.recheck_since is None else e.recheck_since
                e.reason = RECHECK
            else:
                begin = Evidence(ELSEWHERE)
            e.lost_since, e.in_sight = None, False
        if begin.region is not None:
            if self.contained(begin.region, region, track.box, picture):
                region = begin.region  # detections waver; the picture is compared with itself only where the region stands still
            else:
                begin = Evidence(ELSEWHERE)
        if begin is not e:
            e.become(begin)
        if not picture.clear(region):
            return UNCLEAR
        if e.region is None or e.looked is None or clock - e.looked > self.roi_gap:
            if e.recheck_since is None:
                e.become(Evidence(gap or e.reason, quiet_since=clock))
            elif e.quiet_since is None:
                e.quiet_since, e.unseen = clock, 0.0
            e.hits = 0
            found = None
        else:
            e.unseen += max(0.0, clock - e.looked - self.step)
            found = picture.motion(region, self.moved_share)
        e.region, e.looked, e.place, e.appearance = region, clock, track.box, track.appearance
        return self.weigh(e, track, found, clock)

    def weigh(self, e: Evidence, track: Track, found: str | None, clock: float) -> str | None:
        if found == "uncertain":
            return UNCERTAIN
        if found == "motion":
            e.reason, e.quiet_since, e.unseen, e.recheck_since, e.hits = MOTION_PENDING, clock, 0.0, None, e.hits + 1
            if e.hits >= 2:
                e.mechanism_until = clock + min(LONGEST_MECHANISM, max(2.0, self.sample))
        elif found == "quiet":
            e.hits = 0
            wait = RECHECK_STATIONARY if self.group(track) == STATIONARY else RECHECK_MOBILE
            again = e.recheck_since is not None and clock - e.recheck_since < wait
            e.recheck_since, e.reason = (e.recheck_since, RECHECK) if again else (None, IDLE_PENDING)
        return None

    @staticmethod
    def contained(held: Region, region: Region, box: Box, picture: Picture) -> bool:
        """Whether the box still lies in the region that is held, and its own region has not drifted from it."""
        at = [v * n for v, n in zip(box, (picture.width, picture.height) * 2, strict=True)]
        inside = at[0] >= held[0] and at[1] >= held[1] and at[2] <= held[2] and at[3] <= held[3]
        return inside and max(abs(a - b) for a, b in zip(region, held, strict=True)) <= MOST_DRIFT

    @staticmethod
    def same_machine(e: Evidence, track: Track) -> bool:
        if e.place is None or iou(e.place, track.box) < SAME_IOU:
            return False
        side = min(b[i + 2] - b[i] for b in (e.place, track.box) for i in (0, 1))
        (x, y), (u, v) = foot(e.place), foot(track.box)
        if hypot(x - u, y - v) > max(SAME_DISTANCE, SAME_SIDE * side):
            return False
        return e.appearance is None or track.appearance is None or correlation(e.appearance, track.appearance) >= SAME_ALIKE

    def verdict(self, track: Track, observed: bool, clock: float) -> tuple[str, str]:
        """Activity and its basis, of a track that is published."""
        e = self.known.get(track.number)
        if not observed:
            if e and track.missed <= MOST_MISSED_AT_WORK and clock <= max(e.working_until, e.mechanism_until):
                return "working", RECENT
            return "unknown", HELD_IN_SIGHT if e and e.in_sight else HELD
        if track.motion() == "moving" or (e and clock <= e.mechanism_until):
            if e:
                e.working_until = clock + self.hold
            return "working", DRIVING if track.motion() == "moving" else MECHANISM
        if e is None:
            return "unknown", NO_VIDEO
        if clock <= e.working_until:
            return "working", RECENT
        if e.quiet_since is None:
            return "unknown", e.reason
        if self.group(track) != MOBILE and track.kind not in self.checkable:
            return "unknown", NOT_VISIBLE
        needed = max(LEAST_STATIONARY_IDLE, 2 * self.idle_after) if self.group(track) == STATIONARY else self.idle_after
        fresh = e.looked is not None and clock - e.looked <= self.frame_gap
        if fresh and e.recheck_since is None and e.looked - e.quiet_since - e.unseen >= needed:
            return "idle", STILL
        return "unknown", e.reason


class Camera:
    """The joint fold of one run: a tracker and the evidence of its tracks."""

    def __init__(self, tracker: Tracker, analyzer: Analyzer):
        self.tracker, self.analyzer = tracker, analyzer

    def frame(self, clock: float, picture: Picture | None, found: list[tuple] | None) -> list[tuple[int | None, Track, bool, str, str]]:
        """What is published of a frame: detection, track, whether observed, activity, basis. found: null where the detector did not look; picture: null where the frame is not usable."""
        if picture is None:
            self.analyzer.invalidate()
            return []
        shown = self.tracker.update(clock, found) if found is not None else []
        self.analyzer.look(clock, picture, self.tracker.tracks)
        return [(i, t, observed, *self.analyzer.verdict(t, observed, clock)) for i, t, observed in shown]


def activity(frames: DataFrame, *, sample: float, publish: float = 0.35, max_gap: int = 3, grace: int = 3, max_interframe: float | None = None, idle_after: float = 300.0, groups: Mapping[str, str] | None = None, checkable: Collection[str] = CHECKABLE, moved_share: float = MOVED_SHARE) -> DataFrame:
    """What is published of each frame that the detector looked at: track, box, motion, activity and basis.

    frames: the columns of ``FRAME`` and ``FOUND``, a row for each detection; a frame without
    any has one row with a null ``row``. Frames lie between those of the detector too (detects
    false): evidence is gathered on all of them. Where ``max_interframe`` is given, neither
    tracks nor evidence go on across it, and a long run's stretches are folded side by side.
    """
    columns = ["run_id", "stretch", *FRAME[1:], *FOUND]
    made = f"stretch long, {OUT}"
    groups, checkable = dict(groups or {}), frozenset(checkable)
    # evidence ends at the video's own gap, which must not be the longer one
    gap = None if max_interframe is None else max(max_interframe, Analyzer(sample=sample).frame_gap)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, at, held = None, None, []
        n = len(FRAME) - 2

        def closed() -> list[tuple]:
            first = held[0]
            picture = Picture(*first[2:n]) if first[1] else None
            found = [x[n:] for x in held if x[n] is not None]
            shown = camera.frame(at[2], picture, [(r[1], r[2], tuple(r[3:7]), r[7]) for r in found] if first[0] else None)
            out = []
            for i, t, observed, what, basis in shown:
                box = tuple(found[i][3:7]) if observed else clipped(t.ahead(at[2]))
                out.append((at[1], at[0], at[2], found[i][0] if observed else None, t.number, t.kind, found[i][2] if observed else t.score, *box, observed, t.missed, t.motion() if observed else "unknown", what, basis))
            return out

        for batch in batches:
            out: list[tuple] = []
            for now, values in zip(at_once(batch, columns[:3]), at_once(batch, columns[3:]), strict=True):
                if now != at:
                    if at is not None:
                        out += closed()
                    same = at is not None and at[:2] == now[:2]
                    if not same or (gap is not None and now[2] - at[2] > gap):
                        before = camera.tracker.next_number if same else 1
                        analyzer = Analyzer(sample=sample, idle_after=idle_after, max_gap=max_gap, groups=groups, checkable=checkable, moved_share=moved_share)
                        analyzer.last = None if now[1] == 0 and not same else float("-inf")
                        camera = Camera(Tracker(publish=publish, max_gap=max_gap, grace=grace, max_interframe=max_interframe), analyzer)
                        camera.tracker.next_number = before
                    at, held = now, []
                held.append(values)
            yield published(out, made)
        if at is not None:
            yield published(closed(), made)

    side_by_side = gap if in_stretches(frames, gap) else None
    rows = stretches(frames.select(*FRAME, *FOUND), side_by_side).select(*columns)
    found = in_order(rows).mapInArrow(fold, made)
    return numbered(found, side_by_side)
