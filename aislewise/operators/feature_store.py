"""Features per entity from partial aggregates that persist by entity, type and time bucket.

A store is a folder: one Parquet folder per bucket and version, and a JSON manifest that names the version of each bucket with
a fingerprint of the events it was made from. An update fingerprints the buckets of the events given, recomputes those
whose fingerprint has changed and writes a new manifest; the others stay as they are. Features merge the buckets that a
period covers wholly and aggregate the events themselves only in the buckets at its ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store, as many as 54 years of days; more would make the manifest more than a few MB.
MAX_BUCKETS = 20_000
#: Units of a bucket, and at least how many days after its first day the next one begins within.
UNITS = {"day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}


@dataclass(frozen=True)
class Events:
    """What a table's columns mean; its other columns are not read.

    Deliveries of one event (same `once`) agree in entity, time and types as far as these aren't NULL, and count once;
    rows without `once` are events of their own. Rows without an entity are no events, NULL types are a type, NULL
    amounts count as nothing. No type may be named like a column of the result.
    """

    entity: str
    time: str  # a date
    once: str
    types: Sequence[str] = ()
    amount: str | None = None  # an integer
    bucket: str = "month"  # day, week, month, quarter or year

    def __post_init__(self) -> None:
        if self.bucket not in UNITS:
            raise ValueError(f"a bucket must be one of {', '.join(UNITS)}")

    def bucket_of(self) -> Column:
        """The bucket's first day as text; events without a time have a bucket of their own."""
        return F.coalesce(F.date_format(F.date_trunc(self.bucket, F.col(self.time)), "yyyy-MM-dd"), F.lit("none"))


class FeatureStore:
    """Partial aggregates of one kind of events in one folder."""

    def __init__(self, spark: SparkSession, path: str, events: Events) -> None:
        if {"entity", "bucket", "n", "total", "first", "last"} & set(events.types):
            raise ValueError("a type has the name of a column of the result")
        self.spark, self.path, self.of = spark, path.rstrip("/"), events

    # ---- partial aggregates

    def _partials(self, rows: DataFrame) -> DataFrame:
        """(entity, *types, n, total, first, last): each event once; hot entities are spread by event, then combined map-side."""
        e = self.of
        amount = F.col(e.amount).cast("bigint") if e.amount else F.lit(None).cast("bigint")
        narrow = rows.where(F.col(e.entity).isNotNull()).select(
            F.col(e.entity).alias("entity"), *(F.col(t).alias(t) for t in e.types), F.col(e.once).alias("__once"), F.col(e.time).alias("__time"), amount.alias("__amount")
        )
        kept = ["entity", *e.types, "__time", "__amount"]
        single = narrow.where("__once IS NOT NULL").groupBy("entity", "__once").agg(*(F.max(t).alias(t) for t in e.types), F.max("__time").alias("__time"), F.max("__amount").alias("__amount"))
        single = single.select(*kept).unionByName(narrow.where("__once IS NULL").select(*kept))
        return single.groupBy("entity", *e.types).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__amount"), F.lit(0)).alias("total"), F.min("__time").alias("first"), F.max("__time").alias("last")
        )

    def fingerprints(self, rows: DataFrame) -> dict[str, tuple[int, int]]:
        """Rows with an entity and an order-free hash of each bucket; one row per bucket reaches the driver."""
        e = self.of
        columns = [e.entity, e.time, e.once, *e.types, *([e.amount] if e.amount else [])]
        hashed = F.xxhash64(*columns, F.lit(1)), F.xxhash64(*columns, F.lit(2))
        found = rows.where(F.col(e.entity).isNotNull()).groupBy(e.bucket_of().alias("b")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hashed[0]).alias("h"), F.sum(hashed[1] % 1000003).alias("s"))
        got = found.limit(MAX_BUCKETS + 1).collect()
        if len(got) > MAX_BUCKETS:
            raise ValueError("too many buckets; choose a longer one")
        return {r["b"]: (r["n"], r["h"] * 31 + r["s"]) for r in got}

    # ---- the folder

    def _files(self) -> tuple[JavaObject, JavaObject]:
        """Hadoop's file system of the folder, and the folder of manifests."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[str]:
        files, at = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")) if files.exists(at) else []

    def manifest(self) -> dict[str, tuple[int, int, str]]:
        """Rows, hash and folder of each bucket, from the newest manifest."""
        return {b: (n, h, folder) for b, (n, h, folder) in self._read_manifest().get("buckets", {}).items()}

    def version(self) -> str | None:
        """The version of the events that the last update was given."""
        return self._read_manifest().get("version")

    def _read_manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {}
        files, at = self._files()
        stream = files.open(self.spark._jvm.org.apache.hadoop.fs.Path(at, names[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _write_manifest(self, entries: dict[str, tuple[int, int, str]], version: str | None) -> None:
        """Write under another name, then rename: a reader sees a whole manifest or none."""
        files, at = self._files()
        names, path = self._manifests(), self.spark._jvm.org.apache.hadoop.fs.Path
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        part = path(at, f"{number:010d}.part")
        out = files.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "buckets": entries}).encode()))
        out.close()
        if not files.rename(part, path(at, f"{number:010d}.json")):
            raise OSError("another update wrote this store's manifest at the same time")

    def update(self, rows: DataFrame, version: str | None = None) -> list[str]:
        """Bring the store up to all events given; the buckets that were recomputed, in order.

        The manifest is written last, so an update that breaks off leaves the store as it was. Buckets without events
        any more are dropped. `version` is a text that names the state of the events, such as a table's snapshot: if the
        last update was given the same, nothing is read.
        """
        if version is not None and version == self.version():
            return []
        old, new = self.manifest(), self.fingerprints(rows)
        changed = sorted(b for b, (n, h) in new.items() if old.get(b, (None, None))[:2] != (n, h))
        if not changed and old.keys() == new.keys() and version is None:
            return []
        folder = f"data/{uuid.uuid4().hex}"
        if changed:
            bucket = self.of.bucket_of()
            inside = rows.where(bucket.isin(changed)) if len(changed) < len(new) else rows
            # types stay inside the bucket: partial aggregates are keyed by it
            keyed = FeatureStore(self.spark, self.path, Events(self.of.entity, self.of.time, self.of.once, [*self.of.types, "__bucket"], self.of.amount))
            partials = keyed._partials(inside.withColumn("__bucket", bucket)).withColumnRenamed("__bucket", "bucket")
            # a few files of even size per bucket, instead of one of each task
            partials.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        self._write_manifest({b: (n, h, f"{folder}/bucket={b}" if b in changed else old[b][2]) for b, (n, h) in sorted(new.items())}, version)
        return changed

    # ---- features

    def stored(self, rows: DataFrame) -> DataFrame:
        """The partial aggregates of all buckets, not merged; of an empty store, none with the columns that `rows` would give."""
        folders = [f"{self.path}/{folder}" for _, _, folder in self.manifest().values()]
        return self.spark.read.parquet(*folders) if folders else self._partials(rows.limit(0))

    def merged(self, rows: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """(entity, *types, n, total, first, last) over all events, or over the days from `since` to `until`.

        Buckets inside the period come from the store; of the buckets at its ends the events in `rows` are aggregated.
        Events without a time count only where no period is given.
        """
        held = self.manifest()
        edge: list[str] = []
        if since or until:
            lo, hi = since or "0000-00-00", until or "9999-12-31"
            ends = self._ends(list(held))
            edge = [b for b in held if b != "none" and (b < lo <= ends[b] or b <= hi < ends[b])]
            inside = [b for b in held if b != "none" and b >= lo and ends[b] <= hi and b not in edge]
        else:
            inside = list(held)
        empty = self._partials(rows.limit(0)) if rows is not None else None
        parts = []
        if inside:
            folders = [f"{self.path}/{held[b][2]}" for b in inside]
            parts.append(self.spark.read.parquet(*folders))
        if edge:
            if rows is None:
                raise ValueError("the period begins or ends inside a bucket: give the events")
            days = F.lit(True)
            if since:
                days &= F.col(self.of.time) >= F.lit(since).cast("date")
            if until:
                days &= F.col(self.of.time) <= F.lit(until).cast("date")
            first, last = min(edge), max(self._ends(edge).values())
            near = F.col(self.of.time).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
            parts.append(self._partials(rows.where(near & days & self.of.bucket_of().isin(edge))))
        if not parts:
            if empty is None:
                raise ValueError("the store is empty")
            return empty
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        return all_.groupBy("entity", *self.of.types).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))

    def _ends(self, buckets: Sequence[str]) -> dict[str, str]:
        """Last day of each bucket."""
        import datetime as dt

        step = UNITS[self.of.bucket]
        ends = {}
        for b in buckets:
            if b != "none":
                d = dt.date.fromisoformat(b)
                after = d + dt.timedelta(step)
                if self.of.bucket not in ("day", "week"):
                    after = after.replace(day=1)
                ends[b] = (after - dt.timedelta(1)).isoformat()
        return ends


def clean_number(column: str) -> Column:
    """The number in a loyalty number however written (case, width, blanks, hyphens, lost prefix or zeros); NULL if it holds none."""
    ascii_ = F.translate(F.col(column), "０１２３４５６７８９ＥＣｅｃ", "0123456789ECEC")
    bare = F.regexp_replace(F.upper(ascii_), "[^0-9A-Z]", "")
    return F.nullif(F.regexp_extract(bare, "^(?:EC)?0*([0-9]{1,10})$", 1), F.lit("")).cast("bigint")
