"""State over streams: full showings with a cooldown, and blocking once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fire_key, rank
from ..operators import matching
from ..operators.activity import BLOCK_TTL, COOLDOWN, THROTTLE


class _Stands(StatefulProcessor):
    """Keeps the time of the last event that stood; an event stands if that is `seconds` ago, or more than that if again."""

    def __init__(self, seconds: int, again: bool, keys: list[str]):
        self.seconds, self.again, self.keys = seconds, again, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["t", "ord"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        stands = []
        for t in events["t"].tolist():
            late = last is None or (t - last > self.seconds if self.again else t - last >= self.seconds)
            last = t if late else last
            stands.append(late)
        self.last.update((int(last),))
        out = pd.DataFrame({k: [v] * len(stands) for k, v in zip(self.keys, key)})
        yield out.assign(ord=events["ord"].to_numpy(), t=events["t"].to_numpy(), stands=stands)

    def close(self) -> None:
        pass


def _run(events: DataFrame, keys: list[str], seconds: int, again: bool) -> DataFrame:
    types = dict(events.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ord long, t long, stands boolean"
    return events.select(*keys, "ord", "t").groupBy(*keys).transformWithStateInPandas(_Stands(seconds, again, keys), schema, "Append", "None")


def cooldown(events: DataFrame, keys: list[str], seconds: int = COOLDOWN) -> DataFrame:
    """A stream of events(keys, ord long, t seconds) with stands; within a batch events go in order of t, then ord.

    It needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider.
    """
    return _run(events, keys, seconds, again=True)


def block_once(events: DataFrame, keys: list[str], seconds: int = BLOCK_TTL) -> DataFrame:
    return _run(events, keys, seconds, again=False)


def first_of_session(events: DataFrame, session: str = "session", ts: str = "ts", watermark: str = "24 hours") -> DataFrame:
    """The first event of every session; a session is forgotten when the watermark has passed it."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([session])


def throttle(events: DataFrame, keys: list[str], seconds: int = THROTTLE) -> DataFrame:
    """A stream of events with stands: a check that runs, as none ran in the `seconds` before it."""
    return _run(events, keys, seconds, again=False)


class _Best:
    """What a group's signals give for each of its events: the k best records, as matching.ranked() and top_of_target() do."""

    def __init__(self, k: int):
        self.k = k

    def events(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[dict]]]:
        """((t, ord, path), its records, the best first) in order of t, then ord, then path."""
        every: dict[tuple, dict[tuple, dict]] = {}
        for part in rows:
            for row in part.to_dict("records"):
                t = None if pd.isna(row["t"]) else int(row["t"])
                event = every.setdefault((t, row["ord"], row["path"]), {})
                one = event.setdefault((row["id"], row["source"]), row | {"names": {}})
                one["rank"] = max(one["rank"], row["rank"])
                one["names"][row["name"]] = min(one["names"].get(row["name"], row["at"]), row["at"])
        for key in sorted(every, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2])):
            records = list(every[key].values())
            for one in records:
                one["matched_by"] = [n for _, n in sorted((at, n) for n, at in one["names"].items())]
                one["act_proof"] = any(n in matching.ACT_PROOF for n in one["matched_by"])
            yield key, sorted(records, key=lambda one: (not one["act_proof"], -one["rank"], one["source"]))[: self.k]


def _remembered(state) -> dict:
    return dict(zip(*state.get())) if state.exists() else {}


class _Showings(StatefulProcessor):
    """Keeps for a target when each record was last shown in full, as long as that counts."""

    def __init__(self, k: int, seconds: int, columns: list[str]):
        self.best, self.seconds, self.columns = _Best(k), seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("full", "ids array<string>, ts array<bigint>", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        full, out = _remembered(self.state), []
        for (t, ord_, path), records in self.best.events(rows):
            for pos, one in enumerate(records, 1):
                name = None if pd.isna(one["id"]) else str(int(one["id"]))
                lately = t is not None and name in full and t - full[name] <= self.seconds
                reason = "path-only match" if not one["act_proof"] else "shown in full lately" if lately else None
                if reason is None and t is not None and name is not None:
                    full[name] = t
                out.append((one["id"], ord_, path, one["rank"], pos, one["matched_by"], one["act_proof"], t, reason, reason is None))
        newest = max(full.values(), default=0)
        full = {n: t for n, t in full.items() if newest - t <= self.seconds}
        if full:
            self.state.update((list(full), list(full.values())))
        yield pd.DataFrame(out, columns=self.columns).astype({"t": "Int64"})

    def close(self) -> None:
        pass


#: What _signals() makes of an event, and so what waits for its time.
SIGNAL = "id long, source string, path string, name string, rank double, at int, ord long, t long"


class _InTime(_Showings):
    """_Showings that waits: an event is shown when the watermark has passed it, in order of time however events came, and
    what was shown in full is forgotten when it no longer counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle, self.waiting = handle, handle.getListState("waiting", SIGNAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, times = _names(SIGNAL), set()
        for part in rows:
            times |= set(part["t"].tolist())
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in row) for row in part[names].astype(object).itertuples(index=False)])
        for t in times:  # one that is late already runs out at once
            self.handle.registerTimer(int(t) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        names = _names(SIGNAL)
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        due = [row for row in held if row[-1] <= now]
        if due:
            later = [row for row in held if row[-1] > now]
            self.waiting.put(later) if later else self.waiting.clear()
            yield from super().handleInputRows(key, iter([pd.DataFrame(due, columns=names)]), timerValues)
            self.handle.registerTimer((now + self.seconds + 1) * 1000)
        elif self.state.exists() and all(now - t > self.seconds for t in _remembered(self.state).values()):
            self.state.clear()


class _Blocks(StatefulProcessor):
    """Keeps for an owner which keys have blocked, the newest `most` of those that have not run out."""

    def __init__(self, k: int, seconds: int, most: int, columns: list[str]):
        self.best, self.seconds, self.most, self.columns = _Best(k), seconds, most, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fired", "keys array<string>, ts array<bigint>", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fired, out = _remembered(self.state), []
        for (t, ord_, path), records in self.best.events(rows):
            came = []
            for one in records:
                block = one["act_proof"] and not (one["key"] in fired and t - fired[one["key"]] <= self.seconds)
                came += [one["key"]] if block else []
                out.append((one["id"], ord_, one["trajectory"], path, t, one["key"], block))
            fired |= dict.fromkeys(came, t)
            if came:
                fired = dict(sorted(((n, x) for n, x in fired.items() if t - x <= self.seconds), key=lambda e: (-e[1], e[0] not in came, e[0]))[: self.most])
        if fired:
            self.state.update((list(fired), list(fired.values())))
        yield pd.DataFrame(out, columns=self.columns).astype({"t": "Int64"})

    def close(self) -> None:
        pass


def _signals(events: DataFrame, anchors: DataFrame, *more: str) -> DataFrame:
    """The signals of events(ord, path, content, ...) as rows that carry t and the columns `more` of their event."""
    t = F.col("t").cast("long") if "t" in events.columns else F.lit(None).cast("long")
    packed = events.select(F.struct(F.col("ord").cast("long").alias("ord"), t.alias("t"), *more).alias("ord"), "path", "content")
    found = matching.signal_rows(anchors, packed).withColumn("rank", rank(F.col("strength"), F.col("severity"), F.col("confidence")))
    return found.select(F.col("id").cast("long").alias("id"), "source", "path", "name", "rank", "at", "ord.*")


SHOWN = "id long, ord long, path string, rank double, pos int, matched_by array<string>, act_proof boolean, t long, reason string, full boolean"
ANSWERED = "id long, ord long, trajectory string, path string, t long, key string, block boolean"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def showings(edits: DataFrame, anchors: DataFrame, k: int = 3, seconds: int = COOLDOWN, wait: str | None = None) -> DataFrame:
    """A stream of edits(ord, path, content[, t]) -> the k best records for each, and whether each is shown in full.

    full is false, and reason says why, if the edit itself proves nothing, or if the record was shown in full on that path at
    most `seconds` before; t in seconds, without it nothing is remembered. A path's last full showings are state, so how
    the edits fall into batches makes no difference as long as a path's edits come in order; inside a batch they are put
    in order. Records are joined as a static side. It needs the RocksDB state store, as cooldown() does.

    With wait, a time such as "10 minutes", edits may come in any order within it: each is shown when the watermark, that
    far behind the newest t, has passed it, by event-time timers, which also clear a path's state when nothing in it counts
    any longer. An edit that is later than that is shown at the next batch, after those of its time.
    """
    if wait:
        edits = edits.withColumn("_ts", F.timestamp_seconds(F.col("t"))).withWatermark("_ts", wait)
    processor = (_InTime if wait else _Showings)(k, seconds, _names(SHOWN))
    return _signals(edits, anchors).groupBy("path").transformWithStateInPandas(processor, SHOWN, "Append", "EventTime" if wait else "None")


def command_showings(commands: DataFrame, anchors: DataFrame, k: int = 3, seconds: int = COOLDOWN) -> DataFrame:
    """showings() of commands(ord, command[, t]): command patterns against commands, the command in path's place."""
    patterns = anchors.where("kind = 'command'").withColumn("kind", F.lit("pattern"))
    events = commands.select("ord", F.lit("").alias("path"), F.col("command").alias("content"), *[c for c in ("t",) if c in commands.columns])
    packed = events.withColumn("path", F.col("content"))
    hits = _signals(packed, patterns).where("name = 'content_pattern'")
    shown = hits.groupBy("path").transformWithStateInPandas(_Showings(k, seconds, _names(SHOWN)), SHOWN, "Append", "None")
    return shown.select("id", "ord", F.col("path").alias("command"), "rank", "pos", "t", "reason", "full")


def answers(actions: DataFrame, anchors: DataFrame, k: int = 3, seconds: int = BLOCK_TTL, most: int = 1000, owner: str = "trajectory") -> DataFrame:
    """A stream of actions(ord, trajectory, path, content, t) -> (id, ord, trajectory, path, t, key, block): a record with proof in
    the action blocks it once a trajectory and target, as long as that is among the owner's `most` newest blocks of the
    last `seconds`; all else is shown. What has blocked is state of the owner, by default the trajectory, and of bounded
    size. Of several actions at a time those with the smaller ord come first.
    """
    rows = _signals(actions, anchors, F.col("trajectory").cast("string").alias("trajectory"), F.col(owner).cast("string").alias("_owner"))
    keyed = rows.withColumn("key", fire_key(F.col("trajectory"), F.col("id").cast("string"), F.col("path")))
    return keyed.groupBy("_owner").transformWithStateInPandas(_Blocks(k, seconds, most, _names(ANSWERED)), ANSWERED, "Append", "None")


class _All:
    """Several queries that were started together."""

    def __init__(self, *queries):
        self.queries = queries

    def awaitTermination(self, timeout: int | None = None) -> bool:
        return all([q.awaitTermination(timeout) if timeout else q.awaitTermination() for q in self.queries])

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def _start(rows: DataFrame, sink: str, checkpoint: str):
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def on_edits(edits: DataFrame, anchors: DataFrame, sink: str, checkpoint: str, k: int = 3, seconds: int = COOLDOWN, rules: DataFrame | None = None, violations_sink: str | None = None, wait: str | None = None) -> _All:
    """Starts a query that logs showings() in the Parquet folder `sink`, and with rules(id, violation) one that logs in
    violations_sink what the edits violate, batch by batch: that has no state, and a batch run again replaces its folder."""
    started = [_start(showings(edits, anchors, k, seconds, wait), sink, checkpoint)]
    if rules is not None and violations_sink:

        def write(batch: DataFrame, number: int) -> None:
            matching.violations(anchors, rules, batch).write.mode("overwrite").parquet(f"{violations_sink}/batch={number}")

        started.append(edits.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}-violations").trigger(availableNow=True).start())
    return _All(*started)


def on_commands(commands: DataFrame, anchors: DataFrame, sink: str, checkpoint: str, k: int = 3, seconds: int = COOLDOWN):
    """Starts a query that logs command_showings()."""
    return _start(command_showings(commands, anchors, k, seconds), sink, checkpoint)


def block_actions(actions: DataFrame, anchors: DataFrame, sink: str, checkpoint: str, k: int = 3, seconds: int = BLOCK_TTL, most: int = 1000, owner: str = "trajectory"):
    """Starts a query that logs answers(). Commands are actions with the command as path and as content and with their patterns
    as anchors of kind pattern."""
    return _start(answers(actions, anchors, k, seconds, most, owner), sink, checkpoint)
