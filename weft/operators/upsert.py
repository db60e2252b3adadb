"""Keyed writes as functions: upsert, insert if absent, cascades, revisions, lifecycle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators import aggregates, dedup, windows


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the last change for each key in place of its row."""
    last = aggregates.latest(changes, keys, order).select(*table.columns)
    return table.join(last, keys, "left_anti").select(*table.columns).unionByName(last)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table, and of rows with new keys the first by order."""
    kept = [c for c in table.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in kept if c not in order))).alias("__f")).select(*keys, *(F.col(f"__f.{c}").alias(c) for c in kept))
    return table.unionByName(first.join(table, keys, "left_anti").select(*table.columns))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows of `gone` (a column `key` of the first link's parent) and of all that hang on them.

    links: (parent, its key, child, the child's column), parents first.
    """
    out, dead = dict(tables), {links[0][0]: gone.select(F.col(key).alias("__k")).distinct()}
    for parent, parent_key, child, column in links:
        lost = out[child].join(dead[parent], out[child][column] == F.col("__k"), "left_semi")
        child_key = next((k for p, k, _, _ in links if p == child), None)
        if child_key:
            more = lost.select(F.col(child_key).alias("__k"))
            dead[child] = dead[child].unionByName(more).distinct() if child in dead else more.distinct()
        out[child] = out[child].join(dead[parent], out[child][column] == F.col("__k"), "left_anti")
        if parent == links[0][0] and out[parent] is tables[parent]:
            out[parent] = out[parent].join(dead[parent], out[parent][parent_key] == F.col("__k"), "left_anti")
    return out


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each event with the last state (key, at, value) at or before it: one shuffle, no pairs of rows."""
    from pyspark.sql import Window

    both = events.select("*", F.lit(None).cast(dict(states.dtypes)[value]).alias("__v"), F.lit(1).alias("__event")).unionByName(states.select(key, at, F.col(value).alias("__v"), F.lit(0).alias("__event")), allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "__event").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(value, last).where("__event = 1").select(*events.columns, value)


def applied(current: Column, proposed: Column, approved: Column) -> Column:
    """A field's value after a decision: the proposal if it is approved and not blank."""
    return F.when(approved & (F.coalesce(proposed.cast("string"), F.lit("")) != ""), proposed).otherwise(current)


def lifecycle(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Threads of bury, hint and resolve actions (action, what): key, what, status, opened, hints, closed, orphans.

    In order: bury opens a thread unless one of the same meaning is or was open, hint counts while it is open,
    resolve closes it; hints and resolves without an open thread are orphans, with those of their meaning. Meanings
    are compared with the first words of a thread, the latest opened first: equal letters and digits in any case, one
    inside the other, or alike (dedup.latest_alike). Keys must fit a task.
    """

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        threads: dict[str, dict] = {}
        known, pending = {}, {}  # names in the order of opening
        for row in frame.sort_values(order).itertuples():
            name = "".join(c for c in str(row.what).lower() if c.isalnum())
            of = dedup.latest_alike(name, reversed(known if row.action == "bury" else pending))
            if of is None:  # a closed thread or an orphan
                of = name if name in threads else dedup.latest_alike(name, reversed(threads)) or name
            t = threads.setdefault(of, {key: getattr(row, key), "what": row.what, "status": "none", "opened": None, "hints": 0, "closed": None, "orphans": 0})
            at = getattr(row, order[0])
            if row.action == "bury" and t["status"] == "none":
                t |= {"status": "pending", "opened": at}
                known[of] = pending[of] = True
            elif row.action == "hint" and t["status"] == "pending":
                t["hints"] += 1
            elif row.action == "resolve" and t["status"] == "pending":
                t |= {"status": "done", "closed": at}
                del pending[of]
            elif row.action in ("hint", "resolve"):
                t["orphans"] += 1
        return pd.DataFrame(list(threads.values())).astype({"opened": "Int64", "closed": "Int64"})

    kind = dict(actions.dtypes)
    return actions.groupBy(key).applyInPandas(step, f"{key} {kind[key]}, what string, status string, opened long, hints long, closed long, orphans long")


def replaced(chunks: DataFrame, new: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Chunks kept in step with their sources: those of a source in `new` give way to its new ones, and those of sources
    that are not in `sources` any more go."""
    live = chunks.join(sources.select(source).distinct(), source, "left_semi").join(new.select(source).distinct(), source, "left_anti")
    return live.select(*chunks.columns).unionByName(new.select(*chunks.columns).join(sources.select(source).distinct(), source, "left_semi").select(*chunks.columns))


def proposed(current: DataFrame, proposals: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Pending revisions: the current row with a proposal's values of the allowed fields, and which of them change.

    A proposal's nulls, and fields that are not allowed, change nothing; proposals that change nothing, or of unknown
    keys, are left out.
    """
    wanted = proposals.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    both = current.select(key, *fields).join(wanted, key)
    changed = F.array_compact(F.array(*(F.when(F.col(f"__{f}").isNotNull() & ~F.col(f"__{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields)))
    return both.select(key, *(F.coalesce(f"__{f}", f).alias(f) for f in fields), changed.alias("changed")).where(F.size("changed") > 0)


def restored(revisions: DataFrame, key: str, number: str, back: int, fields: list[str]) -> DataFrame:
    """Each key's state `back` revisions before its last one, as a new revision: key, number, restored_from, fields.

    Keys with fewer revisions are left out.
    """
    last = windows.top(revisions, [key], [F.col(number).desc()], back + 1)
    old = last.where(F.col("rank") == back + 1).select(key, F.col(number).alias("restored_from"), *fields)
    top = last.where("rank = 1").select(key, (F.col(number) + 1).alias(number))
    return old.join(top, key).select(key, number, "restored_from", *fields)


def next_number(keys: DataFrame, rows: DataFrame, key: str, number: str) -> DataFrame:
    """The number behind a key's largest one, 1 for keys without rows."""
    return keys.join(rows.groupBy(key).agg(F.max(number).alias("__last")), key, "left").select(*keys.columns, (F.coalesce("__last", F.lit(0)) + 1).alias("next"))


def allowed(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], known: DataFrame) -> DataFrame:
    """upsert() of those changes whose keys are in `known`."""
    return upsert(table, changes.join(known.select(*keys).distinct(), keys, "left_semi"), keys, order)


def ledger(sections: DataFrame, changes: DataFrame, keys: list[str], number: str, text: str, most: int) -> DataFrame:
    """Sections (keys, number, text) with changes in their places; of each key the newest numbers that have `most`
    characters together, so that the oldest go first. A section that is longer alone goes too, with all before it."""
    both = changes.select(*keys, number, text).unionByName(sections.join(changes, [*keys, number], "left_anti").select(*keys, number, text))
    by = Window.partitionBy(*keys).orderBy(F.col(number).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__used", F.sum(F.length(text)).over(by)).where(F.col("__used") <= most).drop("__used")


def fingerprint(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """key, digest: a SHA-256 of a key's rows in order, to see whether they changed. A key's rows are in one row."""
    line = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("all"))
    return by.select(key, F.sha2(F.array_join(F.transform("all", lambda x: x["line"]), ";"), 256).alias("digest"))


def transitioned(states: DataFrame, requests: DataFrame, key: str, order: list[str], allowed: dict[str, list[str]], first: str) -> DataFrame:
    """key, state, applied, rejected of every key: its requests (a state `to`) in order, each applied if it is allowed from the state
    that the ones before it led to, and else left out.

    Keys begin with their state (states: key, state), or with `first`; those with requests only are there too, and null
    states are `first`. A key's requests are folded within its row, so they must fit one: they are what was asked of one record.
    """
    table = F.create_map(*(x for a, b in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    asked = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "to"))), lambda x: x["to"]).alias("__to"))
    both = states.select(key, "state").join(asked, key, "full").withColumn("__to", F.coalesce("__to", F.array().cast("array<string>")))
    begin = F.struct(F.coalesce("state", F.lit(first)).alias("state"), F.lit(0).alias("applied"))

    def step(now: Column, to: Column) -> Column:
        good = F.coalesce(F.array_contains(F.try_element_at(table, now["state"]), to), F.lit(False))
        return F.struct(F.when(good, to).otherwise(now["state"]).alias("state"), (now["applied"] + good.cast("int")).alias("applied"))

    done = both.withColumn("__end", F.aggregate("__to", begin, step))
    return done.select(key, F.col("__end.state").alias("state"), F.col("__end.applied").alias("applied"), (F.size("__to") - F.col("__end.applied")).alias("rejected"))
