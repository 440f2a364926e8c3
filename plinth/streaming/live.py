"""Live changes: debounce, writers with a grace, marks that age, and replies that arrive in pieces.

Each works on a stream (Structured Streaming) or, where said, on the same events at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plinth.functions.staging import staged

EVENT = "at timestamp, path string, kind string, agent string"


def changes_from_hooks(payloads: DataFrame, root: str) -> DataFrame:
    """(at, path, kind, agent) from rows (at, json); files outside the project are refused."""
    p = payloads.select("at", F.from_json("json", "tool_name string, tool_input struct<file_path:string>, hook_event_name string, session_id string, agent string").alias("p"))
    inside = p.where(F.col("p.tool_input.file_path").startswith(root.rstrip("/") + "/"))
    path = F.expr(f"substring(p.tool_input.file_path, {len(root.rstrip('/')) + 2})")
    return inside.select("at", path.alias("path"), F.lit("changed").alias("kind"), attribution(F.col("p.agent"), F.col("p.hook_event_name"), F.col("p.session_id")).alias("agent"))


def attribution(name: Column, event: Column, session: Column) -> Column:
    """A declared name of at most 40 characters; else known only by both event and session; else nobody."""
    given = F.trim(name)
    return F.when((F.length(given) > 0) & (F.length(given) <= 40), given).when(event.isNotNull() & session.isNotNull(), "agent")


def debounced(events: DataFrame, gap: str = "80 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(path, start, end, kind, agent, n): one timer runs for all paths, so a burst ends when nothing comes for the gap.

    Of each path in a burst, the last kind and the last name given hold. Stream or at rest. A
    stream holds one burst; at rest, spans of the gap's length that have events are put into bursts by a tree of ranges.
    """
    last = [F.max_by("kind", "at").alias("kind"), F.max_by("agent", F.when(F.col("agent").isNotNull(), F.col("at"))).alias("agent"), F.count("*").alias("n")]
    if events.isStreaming:
        # one key for all paths, as a streaming session needs one
        burst = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), F.pmod(F.hash("path"), F.lit(1)).alias("all_paths")).agg(F.array_sort(F.collect_list(F.struct("at", "path", "kind", "agent"))).alias("all"))
        one = burst.select("w", "all", F.explode(F.array_distinct("all.path")).alias("path")).withColumn("mine", F.expr("filter(all, x -> x.path = path)"))
        named = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.expr("transform(filter(mine, x -> x.agent is not null), x -> x.agent)")), -1)
        return one.select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.element_at("mine", -1)["kind"].alias("kind"), named.alias("agent"), F.size("mine").cast("long").alias("n"))
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {gap}"))
    rows = events.withColumn("_span", F.floor(F.unix_micros("at") / width))
    spans = staged(rows.groupBy("_span").agg(F.min("at").alias("a"), F.max("at").alias("b")), "spans")
    # over a whole span without an event there is always a gap, so only the span before can go on
    before = spans.select((F.col("_span") + 1).alias("_span"), F.col("b").alias("_before"))
    begins = F.col("_before").isNull() | (F.unix_micros("a") - F.unix_micros("_before") >= width)
    spans = last_before(spans.join(before, "_span", "left").withColumn("burst", F.when(begins, F.col("_span"))), "_span", "burst")
    whole = spans.groupBy("burst").agg(F.min("a").alias("start"), (F.max("b") + F.expr(f"interval {gap}")).alias("end"))
    out = rows.join(spans.select("_span", "burst"), "_span").groupBy("burst", "path").agg(*last).join(whole, "burst")
    return out.select("path", "start", "end", "kind", "agent", "n")


#: Rows that one window orders in last_before().
FAN = 1024


def last_before(rows: DataFrame, key: str, value: str, fan: int | None = None) -> DataFrame:
    """rows (``key``: a distinct whole number) with ``value`` where it is null: that of the greatest key before which has one.

    A scan as a tree: ranges of ``fan`` keys are summed up by their last value, and these again, until few are left; then what comes before
    a range is handed down. No window holds more than ``fan`` rows.
    """
    fan = fan or FAN
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    levels = [rows.select(F.col(key).alias("k"), F.col(value).alias("v"))]
    while lo is not None and hi - lo >= fan:
        up = levels[-1].groupBy(F.floor(F.col("k") / fan).alias("k")).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("k"))).alias("v"))
        levels.append(staged(up, "ranges"))
        lo, hi = lo // fan, hi // fan
    carry = None
    for level in reversed(levels):
        of = F.floor(F.col("k") / fan) if carry is not None else F.lit(0)
        order = Window.partitionBy("of").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        now = level.withColumn("of", of).withColumn("c", F.last("v", ignorenulls=True).over(order))
        if carry is not None:
            now = now.join(carry.select(F.col("k").alias("of"), F.col("c").alias("above")), "of", "left").withColumn("c", F.coalesce("c", "above"))
        carry = now.select("k", "v", "c")
    held = carry.select(F.col("k").alias(key), F.coalesce("v", "c").alias(value))
    return rows.drop(value).join(held, key)


def writers(events: DataFrame, grace_ms: int = 1000) -> DataFrame:
    """events with ``writer``: the name given, or the last one given on the path if that was within the grace; at rest."""
    so_far = Window.partitionBy("path").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)  # one file's changes
    named = F.last(F.when(F.col("agent").isNotNull(), F.col("at")), ignorenulls=True).over(so_far)
    return events.withColumn("writer", F.when(F.unix_millis("at") - F.unix_millis(named) <= grace_ms, F.last("agent", ignorenulls=True).over(so_far)))


def _follow(grace_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, at = state.get if state.exists else (None, None)
        rows = pd.concat([*batches]).sort_values(["at", "id"])  # one file's changes of one batch
        out = []
        for r in rows.itertuples():
            now = r.at.value // 1_000_000
            given = r.agent if isinstance(r.agent, str) else None
            out.append((r.id, key[0], given or (name if at is not None and now - at <= grace_ms else None)))
            name, at = (given, now) if given else (name, at)
        yield pd.DataFrame(out, columns=["id", "path", "writer"])
        # a name is no use after its grace
        if at is None or at + grace_ms < state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            return
        state.update((name, at))
        state.setTimeoutTimestamp(max(at + grace_ms, state.getCurrentWatermarkMs()) + 1)

    return run


def writers_stream(events: DataFrame, grace_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """(id, path, writer) as writers(), for a stream; one name and one time are kept for each path until the grace is over by event time."""
    rows = events.withWatermark("at", late)
    return rows.groupBy("path").applyInPandasWithState(_follow(grace_ms), "id long, path string, writer string", "name string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def _age(lives: dict[str, tuple[int, int]]):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        how, at, born, band = state.get if state.exists else (None, None, None, None)
        out = []

        def ages(until: int) -> None:
            """The changes of the mark that lie before a time."""
            nonlocal band
            for name, s in zip(("cooled", "gone"), lives[how], strict=True):
                if band in ("fresh", "cooled") and (name == "gone" or band == "fresh") and at + s * 1000 <= until:
                    out.append((key[0], name, how, at + s * 1000, born))
                    band = name

        if not state.hasTimedOut:
            rows = pd.concat([*batches]).sort_values("at")  # one file's changes of one batch
            for r in rows.itertuples():
                now = r.at.value // 1_000_000
                if band is not None:
                    ages(now)
                if at is not None and now < at:
                    continue  # late: the mark is newer
                born = now if band in (None, "gone") else born
                how, at, band = r.how, now, "fresh"
                out.append((key[0], band, how, at, born))
        mark = state.getCurrentWatermarkMs()
        ages(mark)
        if band == "gone":
            if state.exists:
                state.remove()
        else:
            state.update((how, at, born, band))
            fresh, gone = lives[how]
            state.setTimeoutTimestamp(max(at + 1000 * (fresh if band == "fresh" else gone), mark + 1))
        yield pd.DataFrame(out, columns=["path", "band", "how", "at_ms", "born_ms"])

    return run


def marks_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(path, band: fresh, cooled or gone, how, at_ms, born_ms): every change of each file's mark, from a stream (at, path, how).

    Marks cool and go by themselves, by timers on event time; one that has gone leaves no state, and the next is born anew.
    """
    rows = events.withWatermark("at", late)
    return rows.groupBy("path").applyInPandasWithState(_age(LIVES), "path string, band string, how string, at_ms long, born_ms long", "how string, at long, born long, band string", "append", GroupStateTimeout.EventTimeTimeout)


#: Seconds after which a mark cools and goes, for files written and files asked about.
LIVES = {"written": (20, 120), "asked": (10, 60)}


def marks(events: DataFrame, now: Column) -> DataFrame:
    """(path, band, next_change): the latest mark of each file, as it stands at a time; gone ones have no row. born is the first time."""
    fresh = F.when(F.col("how") == "asked", LIVES["asked"][0]).otherwise(LIVES["written"][0])
    gone = F.when(F.col("how") == "asked", LIVES["asked"][1]).otherwise(LIVES["written"][1])
    rows = events.groupBy("path").agg(F.max_by("how", "at").alias("how"), F.max("at").alias("at"), F.min("at").alias("born"))
    age = F.unix_millis(now) - F.unix_millis("at")
    rows = rows.withColumn("band", F.when(age < fresh * 1000, "fresh").when(age < gone * 1000, "cooled")).withColumn("next_change", F.when(F.col("band") == "fresh", fresh * 1000 - age).when(F.col("band") == "cooled", gone * 1000 - age))
    return rows.where("band is not null").select("path", "how", "band", "next_change", "born")


def history(entries: DataFrame, most: int = 200) -> DataFrame:
    """The latest entries, newest first."""
    return entries.orderBy(F.desc("at"), F.desc("id")).limit(most)


def reply_deltas(lines: DataFrame) -> DataFrame:
    """(conv, nr, kind, text) of pieces in line-delimited JSON; other lines say nothing. Stream or at rest."""
    p = F.from_json("line", "type string, delta struct<type:string,text:string,thinking:string>, session_id string")
    kind = F.when(F.col("p.delta.type") == "text_delta", "text").when(F.col("p.delta.type") == "thinking_delta", "thinking")
    return lines.select("conv", "nr", p.alias("p")).select("conv", "nr", kind.alias("kind"), F.coalesce("p.delta.text", "p.delta.thinking").alias("text")).where("kind is not null")


def replies(deltas: DataFrame) -> DataFrame:
    """(conv, kind, text): the pieces in order; at rest."""
    return deltas.groupBy("conv", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "text"))), lambda x: x["text"]), "").alias("text"))


def publish(changes: DataFrame, view: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], every: str = "3 seconds"):
    """Starts a query that hands each batch's view to a sink."""
    return changes.writeStream.foreachBatch(lambda batch, n: sink(view(batch), n)).trigger(processingTime=every).start()
