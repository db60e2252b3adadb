"""Templates of many sequences: groups are merged to one skeleton, its places have all members' ways of doing them."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import storage
from weft.operators import sequences

#: The four phases of a skeleton, fixed values.
PHASES = ("起", "承", "转", "合")


def phase(at: Column, n: Column) -> Column:
    """0 to 3: the phase of place `at` (from 0) of n: n // 4 places each, the last one has the rest."""
    return F.least(F.lit(3), F.when(n >= 4, F.floor(at / F.greatest(F.floor(n / 4), F.lit(1)))).otherwise(F.floor(at * 4 / n))).cast("int")


def members(rows: DataFrame, key: str, order: str, symbols: str, tags: str | None = None, cores: str | None = None) -> DataFrame:
    """key, order, cluster, attached, core (array), skeleton and repeats of the row's group, and beats: an array of (at, symbol,
    times, tags), the row's symbols without direct repeats and their places in the skeleton.

    tags: a column with an array of tags for each symbol; a run's beat has the first one's. Rows of a key are folded in one
    task (see sequences.agglomerated), keys by the batch; tags stay in the JVM. A row without symbols is a group of its own
    with an empty skeleton.
    """
    tag = F.col(tags) if tags else F.transform(symbols, lambda _: F.array().cast("array<string>"))
    row = F.struct(F.col(order).isNull(), F.col(order).alias("order"), F.col(symbols).alias("symbols"), tag.alias("tags"), (F.col(cores) if cores else F.array().cast("array<string>")).alias("core"))
    by = rows.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    groups = F.arrow_udf(_grouped, _GROUPED)(F.transform("__rows", lambda r: F.struct(r["symbols"].alias("symbols"), r["core"].alias("core"))))
    each = by.withColumn("__groups", groups).select(key, F.explode(F.arrays_zip("__rows", "__groups")).alias("x")).select(key, "x.__rows.*", "x.__groups.*")
    beats = F.transform("beats", lambda b: F.struct(b["at"].alias("at"), b["symbol"].alias("symbol"), b["times"].alias("times"), F.get("tags", b["first"]).alias("tags")))
    return each.select(key, F.col("order").alias(order), "cluster", "attached", "core", "skeleton", "repeats", beats.alias("beats"))


#: What _grouped() returns.
_GROUPED = "array<struct<cluster:int,attached:boolean,skeleton:array<string>,repeats:array<int>,beats:array<struct<at:int,first:int,symbol:string,times:int>>>>"


def _grouped(keys: pa.Array) -> pa.Array:
    """For each key's rows (symbols, core) in order: their groups, and their runs' places in these; first is where a run begins."""
    every = keys.flatten()
    symbols, cores = (_lists(every.field(c)) for c in ("symbols", "core"))
    cluster, attached, skeleton, repeats, beats, at, first, symbol, times = ([] for _ in range(9))
    begin, ends = 0, pc.cumulative_sum(pc.fill_null(pc.list_value_length(keys), 0)).to_pylist()
    for end in ends:
        runs = [_runs(x) for x in symbols[begin:end]]
        found = sequences.agglomerated([r[0] for r in runs], cores[begin:end], times=[r[2] for r in runs])
        of = {i: (n, g) for n, g in enumerate(found) for i in g.members}
        late = {i: (n, g) for n, g in enumerate(found) for i in g.attached}
        for i, (names, begins, counts) in enumerate(runs):
            n, g = late.get(i) or of[i]
            cluster.append(n)
            attached.append(i in late)
            skeleton.append(g.symbols)
            repeats.append(g.times)
            kept = [(p, *r) for p, *r in zip(sequences.positions(names, g.symbols), begins, names, counts, strict=True) if p is not None]
            beats.append(len(kept))
            for p, f, s, c in kept:
                at.append(p)
                first.append(f)
                symbol.append(s)
                times.append(c)
        begin = end
    ints = lambda x: pa.array(x, pa.int32())
    beat = pa.StructArray.from_arrays([ints(at), ints(first), pa.array(symbol, pa.string()), ints(times)], names=["at", "first", "symbol", "times"])
    row = pa.StructArray.from_arrays([ints(cluster), pa.array(attached, pa.bool_()), pa.array(skeleton, pa.list_(pa.string())), pa.array(repeats, pa.list_(pa.int32())), pa.ListArray.from_arrays(ints([0, *accumulate(beats)]), beat)], names=["cluster", "attached", "skeleton", "repeats", "beats"])
    return pa.ListArray.from_arrays(ints([0, *ends]), row)


def _lists(column: pa.Array) -> list[list]:
    """A column of arrays of strings, each string once in memory; a null array is empty."""
    code = column.flatten().dictionary_encode()
    names = code.dictionary.to_pylist()
    flat = [None if i is None else names[i] for i in code.indices.to_pylist()]
    ends = [*accumulate(n or 0 for n in pc.list_value_length(column).to_pylist())]
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _runs(symbols: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Symbols without direct repeats, where each begins, and how often it is there."""
    begins = [i for i, s in enumerate(symbols) if not i or s != symbols[i - 1]]
    return [symbols[i] for i in begins], begins, [b - a for a, b in zip(begins, [*begins[1:], len(symbols)])]


def _ways(v: Column) -> tuple[Column, Column]:
    """signature and variants of a place, of an array of its members' beats (src, times, tags, core).

    A place's signature are the tags that at least half of its variants have; likeness is the Jaccard similarity to it (0
    for no tags). The beats that are a core of their member come first, then by falling likeness, then by src.
    """
    tags = F.array_distinct(F.flatten(F.transform(v, lambda x: F.coalesce(x["tags"], F.array().cast("array<string>")))))
    least = F.greatest(F.floor((F.size(v) + 1) / 2), F.lit(1))
    signature = F.array_sort(F.filter(tags, lambda t: F.size(F.filter(v, lambda x: F.array_contains(x["tags"], t))) >= least))

    def ranked(own: Column) -> Column:
        likeness = lambda x: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(x["tags"], own)), F.size(F.array_union(x["tags"], own))), F.lit(0.0)), 6)
        return F.sort_array(F.transform(v, lambda x: F.struct(F.coalesce((~x["core"]).cast("int"), F.lit(2)), -likeness(x), x["src"], x.alias("x"))))

    # the signature is bound once by a lambda over an array of one
    return signature, F.transform(F.flatten(F.transform(F.array(signature), ranked)), lambda r: r["x"])


def templates(found: DataFrame, key: str, order: str) -> DataFrame:
    """key, cluster, members, skeleton, repeats, phases of every group of members(): phases are an array of (phase, beats), beats of
    (beat, signature, variants), variants of (src, times, tags, core), the core ones first, then by likeness (see _ways).

    A beat is named by its symbol, with its repeats where there are several (`a×3`). Templates hold their members' beats: as
    many as a key has that fits a task. The groups are stored, so that sequences are merged once; beats are shuffled once.
    """
    found = storage.stored(found, "template-members")
    group = [key, "cluster"]
    ordered = lambda order, *fields: F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("x")))), lambda r: r["x"])
    groups = found.groupBy(*group).agg(F.count("*").alias("members"), F.first("skeleton").alias("skeleton"), F.first("repeats").alias("repeats"))
    name = F.concat("s.skeleton", F.when(F.col("s.repeats") > 1, F.concat(F.lit("×"), "s.repeats")).otherwise(""))
    places = groups.select(*group, F.size("skeleton").alias("n"), F.posexplode(F.arrays_zip("skeleton", "repeats")).alias("at", "s")).select(*group, "at", F.struct("n", name.alias("beat")).alias("place"))
    beats = found.select(*group, F.col(order).alias("src"), "core", F.explode("beats").alias("b"))
    way = F.struct("src", "b.times", F.array_distinct("b.tags").alias("tags"), F.array_contains("core", F.col("b.symbol")).alias("core"))
    both = beats.select(*group, "b.at", way.alias("way")).unionByName(places, allowMissingColumns=True).repartition(*group)
    # a place may have no variants
    by_place = both.groupBy(*group, "at").agg(F.first("place", ignorenulls=True).alias("place"), F.collect_list("way").alias("ways"))
    signature, variants = _ways(F.col("ways"))
    named = by_place.select(*group, "at", phase(F.col("at"), F.col("place.n")).alias("__p"), "place.beat", signature.alias("signature"), variants.alias("variants"))
    phases = named.groupBy(*group, "__p").agg(ordered("at", "beat", "signature", "variants").alias("beats"))
    phases = phases.withColumn("phase", F.element_at(F.array(*map(F.lit, PHASES)), F.col("__p") + 1))
    nested = phases.groupBy(*group).agg(ordered("__p", "phase", "beats").alias("phases"))
    return groups.join(nested, group, "left")


def rendered(found: DataFrame, key: str) -> DataFrame:
    """key, cluster, report: a page of Markdown for each template of templates(), for somebody who has to judge it."""
    way = lambda v: F.concat(F.lit("**"), v["src"].cast("string"), F.lit("**"), F.when(v["core"], "*").otherwise(""), F.when(F.size(v["tags"]) > 0, F.concat(F.lit("："), F.array_join(v["tags"], "、"))).otherwise(""))
    beat = lambda b: F.concat(F.lit("- **"), b["beat"], F.lit("** → "), F.coalesce(F.nullif(F.array_join(F.transform(b["variants"], way), "；"), F.lit("")), F.lit("—")))
    part = lambda p: F.concat(F.lit("### "), p["phase"], F.lit("\n\n"), F.array_join(F.transform(p["beats"], beat), "\n"))
    head = F.concat(F.lit("## "), F.col(key).cast("string"), F.lit("-"), F.col("cluster") + 1, F.lit("\n\n"), F.col("members"), F.lit(" × "), F.coalesce(F.nullif(F.array_join("skeleton", " → "), F.lit("")), F.lit("—")))
    parts = F.transform(F.coalesce("phases", F.array().cast(dict(found.dtypes)["phases"])), part)
    return found.select(key, "cluster", F.array_join(F.concat(F.array(head), parts), "\n\n").alias("report"))
