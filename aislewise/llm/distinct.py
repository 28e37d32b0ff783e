"""Distinct counts per group from registers of minimum exponential hash values.

A sketch has m registers. Each item gives every register one exponential value, drawn from the item's hash, and a
register keeps the least it has seen; so a register of n distinct items is exponential with rate n, the sum of all is
gamma distributed with shape m, (m - 1) / sum is an unbiased count with relative error 1 / sqrt(m - 2), and gamma
quantiles over the sum bound the count. Registers of parts merge by elementwise minimum; repeated items change nothing.

An item's m values come in rising order, spread over the registers by a random affine permutation (m is prime, so any two
places fall on any two registers alike), and stop at the group's largest register: a few steps per item in a large group.
Groups of up to m // 2 items keep the hashes themselves, which are the same information and give the exact count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.staging import stage

#: A prime; relative error of the count 1 / sqrt(m - 2) = 6.3%.
REGISTERS = 251
#: Another, for what the first leave open: 1.6%, and exact up to 2,046 items.
FINE_REGISTERS = 4093
_BUFFER_ROWS = 400_000
_PLACE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fill(registers: np.ndarray, group: np.ndarray, item: np.ndarray) -> None:
    """Lower the registers (groups x m) by items, given as 64-bit hashes with the group of each."""
    m = registers.shape[1]
    group, h = group.astype(np.int64), item.astype(np.int64).view(np.uint64)
    step = 1 + (_mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m - 1)).astype(np.int64)
    place = (_mix(h ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % np.uint64(m)).astype(np.int64)
    value = np.zeros(len(h))
    limit = registers.max(axis=1, initial=0)
    for k in range(m):
        u = ((_mix(h + np.uint64((k + 1) * _PLACE & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        value = value - np.log(u) / (m - k)
        live = value < limit[group]
        group, h, step, place, value = group[live], h[live], step[live], place[live], value[live]
        if not len(h):
            return
        np.minimum.at(registers, (group, place), value.astype(np.float32))
        place = (place + step) % m
        if k < 32 or k % 32 == 0:  # a larger limit than need be only costs steps
            touched = np.unique(group)
            limit[touched] = registers[touched].max(axis=1)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def sketch_arrays(group: np.ndarray, groups: int, item: np.ndarray, registers: np.ndarray, dense: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Hash lists and registers per group, from distinct (group, item) rows sorted by group and the dense groups' registers so far."""
    m = registers.shape[1]
    size = np.bincount(group, minlength=groups)
    grown = dense | (size > m // 2)
    row = np.cumsum(grown) - 1
    table = np.full((int(grown.sum()), m), np.inf, np.float32)
    table[row[dense]] = registers
    inside = grown[group]
    fill(table, row[group[inside]], item[inside])
    return _lists(item[~inside], np.where(grown, 0, size), pa.int64()), _lists(table.ravel(), np.where(grown, m, 0), pa.float32())


def _distinct(group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((item, group))
    group, item = group[order], item[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (item[1:] != item[:-1])
    return group[new], item[new]


def partial_sketches(df: DataFrame, groupings: Sequence[Sequence[str]], items: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """(grouping, item, *keys, hashes, registers): mergeable partial results, several rows per group.

    `groupings` are grouping sets over columns of `df`; `keys` are all columns in them, NULL where a grouping leaves one
    out; `grouping` and `item` are names (columns joined by '+'). NULL in a column of a grouping is no group and a NULL
    item is no value. Repeated rows and ties change nothing, an empty table has no groups, other columns are not read. The
    rows may be written, and later united with those of other data and merged again.
    """
    return _named(_partials(df, groupings, items, registers), groupings, items)


def _partials(df: DataFrame, groupings: Sequence[Sequence[str]], items: Sequence[str], registers: int) -> DataFrame:
    """The same with numbers for the names, __k0, __k1, ... for the keys."""
    if registers < 3 or any(registers % d == 0 for d in range(2, int(registers**0.5) + 1)):
        raise ValueError("registers must be a prime of 3 or more")
    keys = list(dict.fromkeys(c for g in groupings for c in g))

    def held(columns: Sequence[str]) -> Column:
        ok = F.lit(True)
        for c in columns:
            ok = ok & F.col(c).isNotNull()
        return ok

    narrow = df.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)),
        *(F.when(held(g), F.xxhash64(F.lit(i), *g) if g else F.lit(0).cast("bigint")).alias(f"__g{i}") for i, g in enumerate(groupings)),
        *(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(f"__i{i}") for i, c in enumerate(items)),
    )
    kinds = [df.schema[c].dataType.simpleString() for c in keys]
    schema = "grouping int, item int, " + "".join(f"__k{i} {k}, " for i, k in enumerate(kinds)) + "hashes array<bigint>, registers array<float>"
    sets = [[keys.index(c) for c in g] for g in groupings]

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for g, columns in enumerate(sets):
            for i in range(len(items)):
                group, item = rows.column(f"__g{g}"), rows.column(f"__i{i}")
                ok = (group.is_valid().to_numpy() & item.is_valid().to_numpy()).nonzero()[0]
                if not len(ok):
                    continue
                _, first, code = np.unique(group.take(ok).to_numpy(), return_index=True, return_inverse=True)
                code, item_hash = _distinct(code, item.take(ok).to_numpy())
                n = len(first)
                hashes, values = sketch_arrays(code, n, item_hash, np.zeros((0, registers), np.float32), np.zeros(n, bool))
                of = rows.take(ok[first])
                own = [of.column(f"__k{k}").combine_chunks() if k in columns else pa.nulls(n, rows.schema.field(f"__k{k}").type) for k in range(len(keys))]
                names = ["grouping", "item", *(f"__k{k}" for k in range(len(keys))), "hashes", "registers"]
                yield from pa.Table.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, i, np.int32)), *own, hashes, values], names=names).to_batches(4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= _BUFFER_ROWS:
                yield from flush(pa.Table.from_batches(waiting))
                waiting, count = [], 0
        if count:
            yield from flush(pa.Table.from_batches(waiting))

    return narrow.mapInArrow(run, schema)


def _named(df: DataFrame, groupings: Sequence[Sequence[str]], items: Sequence[str]) -> DataFrame:
    keys = list(dict.fromkeys(c for g in groupings for c in g))

    def name(column: str, names: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), F.col(column) + 1).alias(column)

    return df.select(name("grouping", ["+".join(g) for g in groupings]), name("item", items), *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)), "hashes", "registers")


def merge_sketches(partials: DataFrame) -> DataFrame:
    """One row per grouping, item and key values: lists united, registers merged by minimum. Any number of parts may be merged, in any order.

    The shuffle moves sketches, not rows: a group that holds a third of all rows sends one sketch per task.
    """
    group = [c for c in partials.columns if c not in ("hashes", "registers")]
    ordered = partials.repartition(*group).sortWithinPartitions(*group)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in partials.schema]

    def merged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        new = _starts(rows.select(group))
        code, n = np.cumsum(new) - 1, int(new.sum())
        hashes, values = (rows.column(c).combine_chunks() for c in ("hashes", "registers"))
        sizes = np.diff(hashes.offsets.to_numpy())
        item_group, item = _distinct(np.repeat(code, sizes), hashes.flatten().to_numpy(zero_copy_only=False))
        full = np.diff(values.offsets.to_numpy()) > 0
        dense = np.zeros(n, bool)
        dense[code[full]] = True
        flat = values.flatten().to_numpy(zero_copy_only=False)
        m = len(flat) // int(full.sum()) if full.any() else m_of[0]
        m_of[0] = m
        if full.any():
            own = code[full]
            registers = np.minimum.reduceat(flat.reshape(-1, m), np.flatnonzero(np.append(True, own[1:] != own[:-1])), axis=0)
        else:
            registers = np.zeros((0, m), np.float32)
        of = rows.take(np.flatnonzero(new))
        lists, table = sketch_arrays(item_group, n, item, registers, dense)
        yield from pa.Table.from_arrays([*(of.column(c) for c in group), lists, table], names=[*group, "hashes", "registers"]).to_batches(4096)

    m_of = [_registers_of(partials)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            last = int(np.flatnonzero(_starts(rest.select(group)))[-1]) if len(rest) else 0
            if last:
                yield from merged(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and len(rest):
            yield from merged(rest)

    return ordered.mapInArrow(run, ", ".join(fields))


def _starts(rows: pa.Table) -> np.ndarray:
    """Which rows differ from the one before; NULL equals NULL and NaN equals NaN."""
    new = np.ones(len(rows), bool)
    if len(rows) < 2:
        return new
    differ = np.zeros(len(rows) - 1, bool)
    for column in rows.columns:
        a, b = column.slice(1), column.slice(0, len(rows) - 1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy()
        if pa.types.is_floating(column.type):
            other = other & ~(pc.fill_null(pc.is_nan(a), False).to_numpy() & pc.fill_null(pc.is_nan(b), False).to_numpy())
        differ |= other | (a.is_null().to_numpy() != b.is_null().to_numpy())
    new[1:] = differ
    return new


def _registers_of(partials: DataFrame) -> int:
    """Registers of the sketches, kept with the schema by `sketch`; the default otherwise."""
    return int(partials.schema["registers"].metadata.get("m", REGISTERS))


def sketch(df: DataFrame, groupings: Sequence[Sequence[str]], items: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """Merged sketches of the groups of `df`; see partial_sketches and merge_sketches."""
    parts = _partials(df, groupings, items, registers)
    return _named(merge_sketches(parts.withMetadata("registers", {"m": registers})), groupings, items)


def estimates(sketches: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(grouping, item, *keys, estimate, low, high) of merged sketches.

    The count lies in [low, high] with the given confidence, from quantiles of the gamma distribution (Wilson and
    Hilferty's cube approximation). Groups that still hold their hashes have low = estimate = high.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    m = F.size("registers").cast("double")
    total = F.aggregate("registers", F.lit(0.0), lambda s, x: s + x)
    exact = F.size("registers") == 0
    count = F.size("hashes").cast("double")

    def quantile(sign: float) -> Column:
        return m * F.pow(1 - 1 / (9 * m) + sign * z / (3 * F.sqrt(m)), F.lit(3.0)) / total

    return sketches.select(
        *(c for c in sketches.columns if c not in ("hashes", "registers")),
        F.when(exact, count).otherwise((m - 1) / total).alias("estimate"),
        F.when(exact, count).otherwise(quantile(-1.0)).alias("low"),
        F.when(exact, count).otherwise(quantile(1.0)).alias("high"),
    )


def sparse_groups(
    df: DataFrame, keys: Sequence[str], items: str, of: str, least: int, factor: int, sizes: Sequence[int] = (REGISTERS, FINE_REGISTERS)
) -> DataFrame:
    """(field, group_key): groups, by column and value, with at least `least` distinct `items` and fewer than a `factor`th of that many distinct `of`.

    NULL is neither a group nor a value; a group without any `of` has none of it and qualifies. Sketches decide: a group
    comes out, or is left out, by the intervals (six standard deviations) of its two counts. What they leave open is
    sketched again with more registers, and what is open after the last of `sizes` is counted exactly: by pairs of group
    and value, so that a large group spreads over all tasks.
    """
    decided, open_ = _decide(sketch(df, [[k] for k in keys], [items, of], sizes[0]), keys, items, of, least, factor)
    found = [decided]
    for registers in sizes[1:]:
        again = _of_groups(df, keys, open_)
        if not again:
            return reduce(DataFrame.unionByName, found)
        sketches = reduce(DataFrame.unionByName, (sketch(rows, [[k]], [items, of], registers).select("grouping", "item", *(k if c == k else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keys), "hashes", "registers") for k, rows in again))
        decided, open_ = _decide(sketches, keys, items, of, least, factor)
        found.append(decided)
    for key, rows in _of_groups(df, keys, open_):
        narrow = rows.select(F.col(key).alias("__key"), F.col(items).cast("string").alias("__x"), F.col(of).cast("string").alias("__y"))
        values = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("__x").alias("s")), F.struct(F.lit(1).alias("w"), F.col("__y").alias("s")))).alias("p")
        pairs = narrow.select("__key", values).select("__key", "p.w", "p.s").where("s IS NOT NULL").distinct()
        counts = (
            pairs.groupBy("__key").agg(F.sum(F.when(F.col("w") == 0, 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("w") == 1, 1)), F.lit(0)).alias("d"))
            .where((F.col("n") >= least) & (F.col("d") * factor < F.col("n")))
        )
        found.append(counts.select(F.lit(key).alias("field"), F.col("__key").cast("string").alias("group_key")))
    return reduce(DataFrame.unionByName, found)


def _decide(sketches: DataFrame, keys: Sequence[str], items: str, of: str, least: int, factor: int) -> tuple[DataFrame, DataFrame]:
    """(field, group_key) of the groups whose intervals say they qualify, and (grouping, *keys) of those that they leave open."""

    def end(item: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("item") == item, F.col(column))), F.lit(0.0))

    both = estimates(sketches, 1 - 2e-9).groupBy("grouping", *keys).agg(
        end(items, "low").alias("n_low"), end(items, "high").alias("n_high"), end(of, "low").alias("d_low"), end(of, "high").alias("d_high")
    )
    sure = (F.col("n_low") >= least) & (F.col("d_high") * factor < F.col("n_low"))
    able = (F.col("n_high") >= least) & (F.col("d_low") * factor < F.col("n_high"))
    chosen = stage(both.where(able).select("grouping", *keys, sure.alias("sure")), "groups")
    value = F.coalesce(*(F.when(F.col("grouping") == k, F.col(k).cast("string")) for k in keys))
    return chosen.where("sure").select(F.col("grouping").alias("field"), value.alias("group_key")), chosen.where("NOT sure").select("grouping", *keys)


def _of_groups(df: DataFrame, keys: Sequence[str], groups: DataFrame) -> list[tuple[str, DataFrame]]:
    """The rows of the given groups, by key column; columns without groups are left out."""
    some = [r[0] for r in groups.select("grouping").distinct().collect()]
    return [(k, df.join(groups.where(F.col("grouping") == k).select(k), k, "left_semi")) for k in keys if k in some]
