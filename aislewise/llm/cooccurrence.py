"""Pairs of items in the same basket, counted by heavy-light decomposition.

Baskets are the distinct items of each key. An item is heavy if it is in at least one basket in HEAVY_ONE_IN, so there
are at most HEAVY_ONE_IN times the mean basket size of them, whatever the data; of more than MOST_HEAVY the most frequent
ones are, and the rest count as light, which gives the same counts. Over blocks of baskets:

* heavy with heavy: a bit matrix (a row of bits per heavy item) and popcounts of ANDed rows;
* heavy with light: each light item's list of baskets probes the heavy rows;
* light with light: pairs of short baskets are counted by hashing; long baskets (more than LONG light items) get their
  own bit matrix of the light items in them, so that no basket's pairs are written out one by one.

Partial counts of all three are added up by pair.

With a least support there are two passes. A pair that reaches its share of all baskets reaches the same share of some
block, so the first pass sends only the pairs with a light item that do so in a block, and the second counts no others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.staging import stage

HEAVY_ONE_IN, LONG = 64, 24
#: Heavy items have a table of counts in each task: 8 bytes for each two of them, 134 MB.
MOST_HEAVY = 4096
_BLOCK = 32_768
#: Candidates up to this number (512 kB of ids) are sent along; more are joined.
SENT_ITEMS = 65_536
#: Pairs up to this number (16 MB) are sent to the second pass; of more, all pairs are counted.
SENT_PAIRS = 1_000_000
_ROWS_AT_ONCE = 64


class PairCounter:
    """Counts of one block of baskets."""

    def __init__(self, heavy: np.ndarray) -> None:
        self.heavy = heavy
        self.dense = np.zeros((len(heavy), len(heavy)), np.int64)

    def add(self, basket: np.ndarray, item: np.ndarray, baskets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Add a block of (basket, item) rows, all distinct; (a, b, count) of the pairs that hold a light item."""
        out = []
        at = np.minimum(np.searchsorted(self.heavy, item), max(0, len(self.heavy) - 1))
        is_heavy = self.heavy[at] == item if len(self.heavy) else np.zeros(len(item), bool)
        bits = bit_rows(at[is_heavy], basket[is_heavy], len(self.heavy), baskets)
        for i in range(len(self.heavy)):
            self.dense[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
        light_item, light_basket = item[~is_heavy], basket[~is_heavy]
        if not len(light_item):
            return out
        # a light item's list of baskets probes the rows of the heavy items
        ids, code = np.unique(light_item, return_inverse=True)
        order = np.argsort(code, kind="stable")
        lists, starts = light_basket[order], np.searchsorted(code[order], np.arange(len(ids)))
        word, shift = lists >> 6, (lists & 63).astype(np.uint64)
        for h in range(len(self.heavy)):
            together = np.add.reduceat(((bits[h][word] >> shift) & np.uint64(1)).astype(np.int64), starts)
            some = np.flatnonzero(together)
            if len(some):
                out.append((np.full(len(some), self.heavy[h]), ids[some], together[some]))
        # light with light
        size = np.bincount(light_basket, minlength=baskets)
        in_long = size[light_basket] > LONG
        out += self._hashed(light_basket[~in_long], code[~in_long], ids)
        if in_long.any():
            out += self._long(light_basket[in_long], code[in_long], ids)
        return out

    @staticmethod
    def _hashed(basket: np.ndarray, code: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.lexsort((code, basket))
        basket, code = basket[order], code[order]
        keys = []
        for step in range(1, min(LONG, len(code))):
            same = np.flatnonzero(basket[step:] == basket[:-step])
            if not len(same):
                break
            keys.append(code[same] * len(ids) + code[same + step])
        if not keys:
            return []
        pair, count = np.unique(np.concatenate(keys), return_counts=True)
        return [(ids[pair // len(ids)], ids[pair % len(ids)], count)]

    @staticmethod
    def _long(basket: np.ndarray, code: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        _, column = np.unique(basket, return_inverse=True)
        own, row = np.unique(code, return_inverse=True)
        bits = bit_rows(row, column, len(own), int(column.max()) + 1)
        for i in range(len(own) - 1):
            together = np.zeros(len(own) - i - 1, np.int64)
            for j in range(i + 1, len(own), 1 << 16):
                part = np.bitwise_count(bits[j : j + (1 << 16)] & bits[i]).sum(axis=1, dtype=np.int64)
                together[j - i - 1 : j - i - 1 + len(part)] = part
            some = np.flatnonzero(together)
            if len(some):
                out.append((np.full(len(some), ids[own[i]]), ids[own[i + 1 + some]], together[some]))
        return out

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, count) of heavy pairs over all blocks added."""
        i, j = np.nonzero(self.dense)
        return self.heavy[i], self.heavy[j], self.dense[i, j]


def bit_rows(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """A matrix of 64-bit words with the given bits set."""
    bits = np.zeros((rows, -(-columns // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits


def cooccurrence(df: DataFrame, basket: Sequence[str], item: str, min_baskets: int = 1, min_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, together, baskets_a, baskets_b, baskets, lift) of each pair with item_a < item_b in a basket.

    A basket is all rows of one value of the `basket` columns; each item counts once in it. Rows with NULL in one of
    them or in `item` belong to none (a basket of such rows only doesn't count). Pairs in fewer than `min_baskets`
    baskets, or in less than `min_share` of all baskets, are left out; an item below that is in no such pair, so its rows
    are dropped first, which loses nothing. lift is together * baskets / (baskets_a * baskets_b). An empty table has no
    pairs. Repeated rows change nothing, other columns are not read. `item` must be an integer column.
    """
    spark = df.sparkSession
    ok = F.col(item).isNotNull()
    for b in basket:
        ok &= F.col(b).isNotNull()
    kind = df.schema[item].dataType
    baskets = stage(
        df.where(ok)
        .select(*(F.col(b).alias(f"__b{i}") for i, b in enumerate(basket)), F.col(item).cast("bigint").alias("item"))
        .groupBy(*(f"__b{i}" for i in range(len(basket))))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("items"),
        "baskets",
    )
    held = stage(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("held")), "items")
    total = baskets.count()
    least = max(1, min_baskets, int(np.ceil(min_share * total - 1e-9)))
    wanted = held.where(F.col("held") >= least)
    often = wanted.where(F.col("held") * HEAVY_ONE_IN >= total).orderBy(F.col("held").desc(), "item").limit(MOST_HEAVY)
    heavy = np.array(sorted(r[0] for r in often.select("item").collect()), np.int64)
    chosen = wanted.count()
    sent = None
    if chosen <= SENT_ITEMS:
        sent = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in wanted.select("item").collect()), np.int64))
    else:
        keyed = baskets.withColumn("key", F.monotonically_increasing_id())
        baskets = (
            keyed.select("key", F.explode("items").alias("item")).join(wanted.select("item"), "item", "left_semi")
            .groupBy("key").agg(F.collect_list("item").alias("items")).select("items")
        )
    several = baskets.where(F.size("items") > 1)
    likely = None
    if least > 1:
        near = several.mapInArrow(_likely(heavy, sent, least / max(1, total)), "item_a bigint, item_b bigint").distinct()
        near = stage(near, "pairs")
        if near.count() <= SENT_PAIRS:
            rows = near.toPandas().sort_values(["item_a", "item_b"])
            likely = spark.sparkContext.broadcast(PairSet(rows["item_a"].to_numpy(np.int64), rows["item_b"].to_numpy(np.int64)))
    counted = (
        several.mapInArrow(_counts(heavy, sent, likely), "item_a bigint, item_b bigint, n bigint")
        .groupBy("item_a", "item_b")
        .agg(F.sum("n").alias("together"))
        .where(F.col("together") >= least)
    )
    small = wanted if chosen > SENT_ITEMS else F.broadcast(wanted)
    lift = F.col("together") * F.lit(float(total)) / (F.col("baskets_a") * F.col("baskets_b").cast("double"))
    return (
        counted.join(small.select(F.col("item").alias("item_a"), F.col("held").alias("baskets_a")), "item_a")
        .join(small.select(F.col("item").alias("item_b"), F.col("held").alias("baskets_b")), "item_b")
        .select(F.col("item_a").cast(kind).alias("item_a"), F.col("item_b").cast(kind).alias("item_b"), "together", "baskets_a", "baskets_b", F.lit(total).cast("bigint").alias("baskets"), lift.alias("lift"))
    )


class PairSet:
    """Pairs of items, a < b, sorted."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.items = np.unique(np.concatenate([a, b]))
        self.keys = np.searchsorted(self.items, a) * len(self.items) + np.searchsorted(self.items, b)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(a), bool)
        most = len(self.items) - 1
        i, j = (np.minimum(np.searchsorted(self.items, x), most) for x in (a, b))
        key = i * len(self.items) + j
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.items[i] == a) & (self.items[j] == b) & (self.keys[at] == key)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], counter: PairCounter, wanted: np.ndarray | None) -> Iterator[tuple[list[Pairs], int]]:
    """Counts of the pairs with a light item in each block, a < b, and the block's baskets."""
    for whole in batches:
        for at in range(0, whole.num_rows, _BLOCK):
            lists = whole.slice(at, _BLOCK).column(0)
            item = lists.flatten().to_numpy(zero_copy_only=False)
            basket = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            if wanted is not None:
                if not len(wanted):
                    continue
                known = wanted[np.minimum(np.searchsorted(wanted, item), len(wanted) - 1)] == item
                item, basket = item[known], basket[known]
            parts = counter.add(basket, item, len(lists))
            yield [(np.minimum(a, b), np.maximum(a, b), n.astype(np.int64)) for a, b, n in parts], len(lists)


def _likely(heavy: np.ndarray, sent, share: float):  # noqa: ANN001, ANN202
    """Pairs with a light item that are in at least `share` of the baskets of some block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, baskets in _blocks(batches, PairCounter(heavy), None if sent is None else sent.value):
            if not parts:
                continue
            a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            items, code = np.unique(np.concatenate([a, b]), return_inverse=True)
            key, back = np.unique(code[: len(a)] * len(items) + code[len(a) :], return_inverse=True)  # long and short baskets count a pair apart
            key = key[np.bincount(back, n) >= share * baskets * (1 - 1e-9)]
            yield pa.RecordBatch.from_arrays([pa.array(items[key // len(items)]), pa.array(items[key % len(items)])], names=["item_a", "item_b"])

    return run


def _counts(heavy: np.ndarray, sent, likely):  # noqa: ANN001, ANN202
    """Partial counts of a partition's baskets; `sent` holds the sorted items that count and `likely` the pairs with a light item, None if all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, wanted, pairs = PairCounter(heavy), *(None if x is None else x.value for x in (sent, likely))
        schema = pa.schema([("item_a", pa.int64()), ("item_b", pa.int64()), ("n", pa.int64())])
        for parts, _ in _blocks(batches, counter, wanted):
            for i in range(0, len(parts), _ROWS_AT_ONCE):
                a, b, n = (np.concatenate(x) for x in zip(*parts[i : i + _ROWS_AT_ONCE], strict=True))
                if pairs is not None:
                    some = pairs.holds(a, b)
                    a, b, n = a[some], b[some], n[some]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in counter.total()], schema=schema)

    return run
