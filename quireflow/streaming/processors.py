"""State processors: the fold steps of ``operators.folds`` over live streams.

Rows of a key arrive unordered within and across micro-batches. Spark's event-time operators drop what its watermark has passed
without a trace, so the processors here keep an event-time clock of their own (per key: the latest time seen) and hold rows until
the clock is ``delay`` ahead of them. Every row that comes in goes out: in its turn, or flagged as late. A row that ends the
input of a key (``ends``) closes what is open. Reassembly orders by sequence number instead and holds frames behind a gap until it
fills.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Generator, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quireflow.operators import folds
from quireflow.operators.scan import Fold

_TEXT = StructType([StructField("text", StringType())])
_NUMBER = StructType([StructField("number", LongType())])

def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list]:
    for batch in batches:
        for row in zip(*[batch[n].tolist() for n in columns]):
            yield [None if v is None or v != v else v for v in row]


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    columns = {}
    for f, values in zip(schema.fields, zip(*rows) if rows else [[] for _ in schema.fields]):
        kind = {"integer": "Int32", "long": "Int64", "boolean": "boolean"}.get(f.dataType.typeName())
        columns[f.name] = pd.array(list(values), kind) if kind else list(values)
    return pd.DataFrame(columns)


class _Held:
    """Rows of a key that wait, by slice of time: up to ``most`` of a slice beside the key's state (``near``), more in a map entry of their own."""

    def __init__(self, entries: Any, owner: tuple, near: dict[int, list], most: int) -> None:
        self.entries, self.owner, self.near, self.most = entries, owner, near, most

    def take(self, at: int) -> list[list]:
        if at in self.near:
            return self.near.pop(at)
        rows = json.loads(self.entries.getValue((*self.owner, at))[0])
        self.entries.removeKey((*self.owner, at))
        return rows

    def put(self, at: int, rows: list[list]) -> None:
        if len(rows) <= self.most:
            self.near[at] = rows
        else:
            self.entries.updateValue((*self.owner, at), (json.dumps(rows),))


class OrderedReplay(StatefulProcessor):
    """A fold in event-time order. Input rows carry ``at_ms`` and ``ends``; ``order``, which starts with the time, breaks ties. Rows
    behind what has been folded already, or without a time or place, come out with ``late`` set and null outputs.

    Held rows lie in a map by slice of time, ``SLICES`` to a delay, so a batch touches only the slices it has rows in and those
    that fall due. What a batch brings is packed by slice as it is read, and slices are unpacked and folded one after the other, so a task
    holds Python objects for a slice, not for a batch."""

    SLICES = 32
    OUT_ROWS = 50_000
    NEW = (None, None, None, ())  # state of the fold, place of the last row folded, clock, slices with rows that wait

    def __init__(self, fold: Fold, order: list[str], keep: list[str], schema: StructType, delay_ms: int) -> None:
        self.fold, self.order, self.keep, self.schema = fold, order, keep, schema
        self.delay_ms, self.width = delay_ms, max(1, delay_ms // self.SLICES)
        self.columns = list(dict.fromkeys(["at_ms", "ends", *order, *keep, *fold.inputs]))
        self.place = [self.columns.index(n) for n in order]
        self.inputs = [self.columns.index(n) for n in fold.inputs]
        self.kept = [self.columns.index(n) for n in keep]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)
        self.held = handle.getMapState("held", _NUMBER, _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved, out = self.state.get(), []
        held = _Held(self.held, (), {}, -1)
        after = yield from self._advanced(key, json.loads(saved[0]) if saved else self.NEW, (_rows([batch], self.columns) for batch in rows), held, out)
        self.state.update((json.dumps(after),))
        if out:
            yield _frame(out, self.schema)

    def _advanced(self, key: Any, saved: Any, batches: Iterable[Iterable[list]], rows_held: _Held, out: list[tuple]) -> Generator[pd.DataFrame, None, list]:
        """A key's state after ``batches``, whose rows go to ``out``, or as frames whenever there are many."""
        state, last, clock, slices = saved
        nothing, slices = [None] * len(self.schema.fields[len(key) + len(self.kept) : -1]), set(slices)
        done, new, ends = [], {}, False  # new: packed rows by slice; done: frames of late rows
        for batch in batches:
            came: dict[int, list] = {}
            for row in batch:
                if row[1]:
                    ends = True
                    continue
                place = [row[k] for k in self.place]
                if row[0] is None or None in place or last is not None and place <= last:
                    out.append((*key, *[row[k] for k in self.kept], *nothing, True))
                else:
                    came.setdefault(int(row[0]) // self.width, []).append(row)
                if row[0] is not None:
                    clock = max(clock if clock is not None else int(row[0]), int(row[0]))
            for at, some in came.items():
                new.setdefault(at, []).append(pickle.dumps(some))
            if len(out) >= self.OUT_ROWS:
                done.append(_frame(out, self.schema))
                out.clear()
        yield from done
        due = clock - self.delay_ms if clock is not None else None
        waiting = slices | set(new)
        for at in sorted(waiting):
            if not ends and at * self.width > due:
                break
            held = [row for packed in new.pop(at, []) for row in pickle.loads(packed)]
            if at in slices:
                held += rows_held.take(at)
            waiting.discard(at)
            stay = [] if ends else [r for r in held if r[0] > due]
            for row in sorted(held if ends else [r for r in held if r[0] <= due], key=lambda r: [r[k] for k in self.place]):
                state, values = self.fold.step(state, *[row[k] for k in self.inputs])
                last = [row[k] for k in self.place]
                out.append((*key, *[row[k] for k in self.kept], *values, False))
            if len(out) >= self.OUT_ROWS:
                yield _frame(out, self.schema)
                out.clear()
            if stay:
                rows_held.put(at, stay)
                waiting.add(at)
                break
        for at, packed in new.items():
            held = [row for some in packed for row in pickle.loads(some)]
            if at in slices:
                held = rows_held.take(at) + held
            rows_held.put(at, held)
        return [state, last, clock, sorted(waiting)]

    def close(self) -> None:
        pass


class SharedReplay(OrderedReplay):
    """The same for very many keys, dealt to shares: a call and a state row per share and batch, not per key. Input rows carry ``key``, the
    JSON of the key's columns (``names``; whole numbers, strings or booleans).

    A share's row carries the state of its keys and up to ``NEAR_ROWS`` rows of each slice that waits; larger slices have a map entry each, and what a
    batch brings is packed by key as it is read, so a hot key is not held as a whole."""

    NEAR_ROWS = 256
    PACK_ROWS = 100_000

    def __init__(self, names: list[str], fold: Fold, order: list[str], keep: list[str], schema: StructType, delay_ms: int) -> None:
        super().__init__(fold, order, keep, schema, delay_ms)
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)
        self.held = handle.getMapState("held", StructType([StructField("key", StringType()), StructField("slice", LongType())]), _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        keys = json.loads(saved[0]) if saved else {}
        came: dict[str, list] = {}
        packed: dict[str, list[bytes]] = {}
        many = 0
        for batch in rows:
            for name, row in zip(batch["key"].tolist(), _rows([batch], self.columns)):
                came.setdefault(name, []).append(row)
            many += len(batch)
            if many >= self.PACK_ROWS:
                for name, some in came.items():
                    packed.setdefault(name, []).append(pickle.dumps(some))
                came.clear()
                many = 0
        out: list[tuple] = []
        for name in [*packed, *(name for name in came if name not in packed)]:
            batches = itertools.chain(map(pickle.loads, packed.pop(name, ())), [came.pop(name, [])])
            *before, near = keys.get(name, (*self.NEW, {}))
            held = _Held(self.held, (name,), {int(at): some for at, some in near.items()}, self.NEAR_ROWS)
            told = json.loads(name)
            after = yield from self._advanced([told.get(n) for n in self.names], before, batches, held, out)
            keys[name] = [*after, held.near]
            if len(out) >= self.OUT_ROWS:
                yield _frame(out, self.schema)
                out.clear()
        self.state.update((json.dumps(keys),))
        if out:
            yield _frame(out, self.schema)


class LiveWindows(StatefulProcessor):
    """Tumbling windows of a model from pre-aggregated rows (``COUNTED``): each comes out once, as ``window``, when the clock is
    ``delay`` past its end; rows of a window that has gone come out as ``late`` with their counts.

    A window's latencies are kept as a count per slot, so its state is as large as the number of slots. Calls without a time
    (``NO_TIME``) are late, of no window."""

    NO_TIME = -(1 << 62)
    COUNTS = ["calls", "throttled", "timeouts", "server_errors", "latencies"]
    COUNTED = "model string, win bigint, slot double, calls bigint, throttled bigint, timeouts bigint, server_errors bigint, latencies bigint, at_us bigint"
    SCHEMA = StructType([
        StructField("model", StringType()), StructField("what", StringType()), StructField("win", LongType()), *[StructField(n, LongType()) for n in (
            "calls", "throttled", "timeouts", "server_errors", "latencies")], StructField("p95", DoubleType())])

    def __init__(self, width_us: int, delay_us: int, per_cent: int = 95) -> None:
        self.width_us, self.delay_us, self.per_cent = width_us, delay_us, per_cent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)
        self.open = handle.getMapState("open", _NUMBER, _TEXT)

    def _quantile(self, slots: list[list[float]], n: int) -> float:
        rank = -(-self.per_cent * n // 100)
        for value, many in slots:
            rank -= many
            if rank <= 0:
                return value
        return 0.0

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        clock, waiting = json.loads(saved[0]) if saved else (None, [])
        waiting, out, ends = set(waiting), [], False
        closed = (clock - self.delay_us) // self.width_us if clock is not None else None  # windows below have gone
        fresh: dict[int, tuple[list[int], dict[float, int]]] = {}
        late: dict[int, list[int]] = {}
        for win, slot, at_us, *counts in _rows(rows, ["win", "slot", "at_us", *self.COUNTS]):
            if win is None:
                ends = True
                continue
            win = int(win)
            if win == self.NO_TIME or closed is not None and win < closed:
                late[win] = [a + int(b) for a, b in zip(late.get(win, [0] * len(counts)), counts)]
                if win == self.NO_TIME:
                    continue
            else:
                sums, slots = fresh.setdefault(win, ([0] * len(counts), {}))
                sums[:] = [a + int(b) for a, b in zip(sums, counts)]
                if slot is not None:
                    slots[slot] = slots.get(slot, 0) + int(counts[-1])
            clock = max(clock if clock is not None else int(at_us), int(at_us))
        closed = (clock - self.delay_us) // self.width_us if clock is not None else None
        for win in sorted(waiting | set(fresh)):
            goes = ends or win < closed
            if win not in fresh and not goes:
                continue
            sums, slots = fresh.get(win, ([0] * len(self.COUNTS), {}))
            if win in waiting:
                old_sums, old_slots = json.loads(self.open.getValue((win,))[0])
                sums = [a + b for a, b in zip(sums, old_sums)]
                for value, many in old_slots:
                    slots[value] = slots.get(value, 0) + many
            listed = [[v, slots[v]] for v in sorted(slots)]
            if goes:
                out.append((*key, "window", win, *sums, self._quantile(listed, sums[-1])))
                if win in waiting:
                    self.open.removeKey((win,))
                    waiting.discard(win)
            else:
                self.open.updateValue((win,), (json.dumps([sums, listed]),))
                waiting.add(win)
        out += [(*key, "late", None if win == self.NO_TIME else win, *sums, None) for win, sums in sorted(late.items())]
        self.state.update((json.dumps([clock, sorted(waiting)]),))
        if out:
            yield _frame(out, self.SCHEMA)

    def close(self) -> None:
        pass


class UniqueFrames(StatefulProcessor):
    """Frames of a share of all blocks of sequence numbers: ``first`` for a seq not seen within ``delay``, ``repeat`` for one that was, and
    ``late`` for a frame older than that, of which nothing is known any more. Each block has its own clock; what is kept are the seqs
    of the delay."""

    def __init__(self, keep: list[str], schema: StructType, delay_ms: int) -> None:
        self.keep, self.schema, self.delay_ms = keep, schema, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        blocks = json.loads(saved[0]) if saved else {}
        gone = {name: clock - self.delay_ms for name, (clock, _) in blocks.items()}
        out = []
        everything = list(_rows(rows, ["at_ms", "seq", "job_id", "block", *self.keep]))
        out += [(job_id, seq, *kept, "late") for at, seq, job_id, _, *kept in everything if at is None or seq is None]  # nothing can be told
        for at, seq, job_id, block, *kept in sorted((r for r in everything if r[0] is not None and r[1] is not None), key=lambda r: r[:2]):
            at, name, place = int(at), f"{job_id}/{int(block)}", str(int(seq))
            if name in gone and at < gone[name]:
                what = "late"
            else:
                clock, seen = blocks.setdefault(name, [at, {}])
                what = "repeat" if place in seen else "first"
                seen[place] = max(at, seen.get(place, at))
                blocks[name][0] = max(clock, at)
            out.append((job_id, int(seq), *kept, what))
        for name, (clock, seen) in blocks.items():
            blocks[name][1] = {place: at for place, at in seen.items() if at >= clock - self.delay_ms}
        self.state.update((json.dumps(blocks),))
        if out:
            yield _frame(out, self.schema)

    def close(self) -> None:
        pass


class StatusCounts(StatefulProcessor):
    """How many things are in a status and since when the oldest, from changes (at_us, delta) of +1 and -1 in any order. Counts are
    kept per time, by hour: an hour that has come to nothing is dropped."""

    HOUR_US = 3_600_000_000
    SCHEMA = StructType([StructField("status", StringType()), StructField("turn", LongType()), StructField("n", LongType()), StructField("oldest_us", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)
        self.hours = handle.getMapState("hours", _NUMBER, _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        turn, n, open_ = json.loads(saved[0]) if saved else (0, 0, [])
        open_, changes = set(open_), {}
        for at, delta in _rows(rows, ["at_us", "delta"]):
            times = changes.setdefault(int(at) // self.HOUR_US, {})
            times[str(int(at))] = times.get(str(int(at)), 0) + int(delta)
            n += int(delta)
        for hour, times in changes.items():
            if hour in open_:
                for at, many in json.loads(self.hours.getValue((hour,))[0]).items():
                    times[at] = times.get(at, 0) + many
            times = {at: many for at, many in times.items() if many}
            if times:
                self.hours.updateValue((hour,), (json.dumps(times),))
                open_.add(hour)
            elif hour in open_:
                self.hours.removeKey((hour,))
                open_.discard(hour)
        oldest = None
        for hour in sorted(open_):  # an hour may hold nothing but changes that wait for their counterpart
            waiting = [int(at) for at, many in json.loads(self.hours.getValue((hour,))[0]).items() if many > 0]
            if waiting:
                oldest = min(waiting)
                break
        self.state.update((json.dumps([turn + 1, n, sorted(open_)]),))
        yield _frame([(*key, turn + 1, n, oldest)], self.SCHEMA)

    def close(self) -> None:
        pass


class LimitsReplay(StatefulProcessor):
    """Adaptive limits over closed windows, which arrive once each; windows without calls in
    between are idle and count as healthy."""

    COLUMNS = ["win", "verdict", "hard_rps", "start_rps", "start_concurrency", "max_concurrency"]

    def __init__(self, schema: StructType) -> None:
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        state, last = json.loads(saved[0]) if saved else (None, None)
        out = []
        for win, verdict, *limits in sorted(_rows(rows, self.COLUMNS)):
            if last is not None and win <= last:
                continue
            for idle in range(last + 1 if last is not None else win, win):
                state, values = folds.limits_step(state, "healthy", *limits)
                out.append((*key, idle, "healthy", *values))
            state, values = folds.limits_step(state, verdict, *limits)
            out.append((*key, win, verdict, *values))
            last = win
        self.state.update((json.dumps([state, last]),))
        if out:
            yield _frame(out, self.schema)

    def close(self) -> None:
        pass


REASSEMBLED = StructType([
    StructField("job_id", LongType()), StructField("what", StringType()), StructField("page_idx", LongType()),
    StructField("payload", StringType())])


class Reassembly(StatefulProcessor):
    """The jobs of a share, each with its frames back in document order: ``page`` rows for the contiguous prefix, one
    ``complete`` row when all pages have arrived or one ``failed`` row when the job is said to have failed, a ``late`` row for each
    frame whose seq came before or that comes after a failure, ``idle`` rows while nothing comes.

    Frames are applied in sequence; those behind a gap are held until it fills. A share is one state row with a short list per job, which
    carries up to ``INLINE`` held frames and as many waiting pages; what a job holds beyond that has a map entry each, so a hot job is not read as a whole.
    Of an ended job the short list stays, by which late frames are known; with ``keep_s`` that goes as well so many
    seconds after the end. ``idle_s`` and ``keep_s`` need processing-time timers; a share's timer is set to the first job that is due."""

    INLINE = 256
    NEW = (0, 0, 0, False, 0, 0, {}, {}, None)  # last seq, next page, pages done, ended, map entries held and waiting, those inline, due

    def __init__(self, idle_s: int | None = None, keep_s: int | None = None) -> None:
        self.idle_s, self.keep_s = idle_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place = lambda name: StructType([StructField("job", StringType()), StructField(name, LongType())])
        self.state = handle.getValueState("state", _TEXT)
        self.held = handle.getMapState("held", place("seq"), _TEXT)
        self.waiting = handle.getMapState("waiting", place("page_idx"), _TEXT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        jobs = json.loads(saved[0]) if saved else {}
        came: dict[str, list] = {}
        for job, *frame in _rows(rows, ["job", "seq", "kind", "page_idx", "payload", "total_pages"]):
            came.setdefault(job or "", []).append(frame)
        out, timers = [], self.idle_s is not None or self.keep_s is not None
        now = timerValues.getCurrentProcessingTimeInMs() if timers else None
        for job, frames in came.items():
            jobs[job] = self._advanced(job, jobs.get(job, self.NEW), frames, out, now)
        self.state.update((json.dumps(jobs),))
        if timers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self._set_timer(jobs)
        if out:
            yield _frame(out, REASSEMBLED)

    def _set_timer(self, jobs: dict[str, list]) -> None:
        due = [job[-1] for job in jobs.values() if job[-1] is not None]
        if due:
            self.handle.registerTimer(min(due))

    def _advanced(self, job: str, saved: list, came: list[list], out: list[tuple], now: int | None) -> list:
        """A job's state after ``came``, whose rows go to ``out``."""
        # The two counts tell whether the maps hold anything of the job, so one with few gaps never reads them.
        last, following, done, ended, held, waiting, near, pages, due = saved
        was_ended, name = ended, int(job) if job else None
        frames, pages = {int(k): v for k, v in near.items()}, {int(k): v for k, v in pages.items()}
        for seq, kind, *frame in came:
            if ended == "failed" or seq <= last or seq in frames or held and self.held.containsKey((job, int(seq))):
                out.append((name, "late", frame[0], frame[1]))
            else:
                frames[int(seq)] = [kind, *frame]

        while ended != "failed":
            if last + 1 in frames:
                kind, page_idx, payload, total = frames.pop(last + 1)
            elif held and self.held.containsKey((job, last + 1)):
                kind, page_idx, payload, total = json.loads(self.held.getValue((job, last + 1))[0])
                self.held.removeKey((job, last + 1))
                held -= 1
            else:
                break
            last += 1
            if kind == "job_failed":
                ended = "failed"
                out.append((name, "failed", None, payload))
                break
            if page_idx is not None and page_idx >= following and page_idx not in pages \
                    and not (waiting and self.waiting.containsKey((job, int(page_idx)))):
                pages[int(page_idx)] = payload
                done += 1
                while True:
                    if following in pages:
                        payload = pages.pop(following)
                    elif waiting and self.waiting.containsKey((job, following)):
                        payload = json.loads(self.waiting.getValue((job, following))[0])
                        self.waiting.removeKey((job, following))
                        waiting -= 1
                    else:
                        break
                    out.append((name, "page", following, payload))
                    following += 1
            if not ended and total and done >= total:
                ended = "complete"
                out.append((name, "complete", None, None))

        if ended == "failed":  # nothing held will ever be shown
            if held:
                frames |= {seq: json.loads(text) for seq, text in self._taken(self.held, job)}
            for _, page_idx, payload, _ in frames.values():
                out.append((name, "late", page_idx, payload))
            if waiting:
                self._taken(self.waiting, job)
            held, waiting, frames, pages = 0, 0, {}, {}
        else:
            held += self._moved(self.held, job, frames)
            waiting += self._moved(self.waiting, job, pages)
        if now is not None and not was_ended:
            wait_s = self.keep_s if ended else self.idle_s
            due = now + wait_s * 1000 if wait_s is not None else None
        return [last, following, done, ended, held, waiting, frames, pages, due]

    def _moved(self, entries: Any, job: str, inline: dict[int, Any]) -> int:
        """How many of ``inline`` became map entries: all, if there are more than a share's row should carry."""
        if len(inline) <= self.INLINE:
            return 0
        many = len(inline)
        for place, value in inline.items():
            entries.updateValue((job, place), (json.dumps(value),))
        inline.clear()
        return many

    @staticmethod
    def _taken(entries: Any, job: str) -> list[tuple[int, str]]:
        """A job's map entries, which go."""
        mine = [(place, text) for (owner, place), (text,) in entries.iterator() if owner == job]
        for place, _ in mine:
            entries.removeKey((job, place))
        return mine

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        saved, now, out = self.state.get(), timerValues.getCurrentProcessingTimeInMs(), []
        jobs = json.loads(saved[0]) if saved else {}
        for job, state in list(jobs.items()):
            if state[-1] is None or state[-1] > now:
                continue
            if state[3]:
                for entries, many in ((self.held, state[4]), (self.waiting, state[5])):
                    if many:
                        self._taken(entries, job)
                del jobs[job]
            else:
                out.append((int(job) if job else None, "idle", None, None))
                state[-1] = now + self.idle_s * 1000
        if jobs:
            self.state.update((json.dumps(jobs),))
        else:
            self.state.clear()
        self._set_timer(jobs)
        if out:
            yield _frame(out, REASSEMBLED)

    def close(self) -> None:
        pass
