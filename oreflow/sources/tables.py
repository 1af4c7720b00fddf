"""Parquet tables published as snapshots.

Every publish writes new files and then adds rows to a small manifest, which is
what readers resolve: a job that dies in between leaves nothing visible, and a
retry writes under a new token. A merge rewrites only the partitions that hold
touched keys and keeps all other files. One writer per table is assumed.

Layout: ``<path>/data/part_key=<value>/token=<token>/*.parquet`` and
``<path>/manifest/*.parquet``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreflow.operators.keysets import bits_for, groups_met, key_bitmaps
from oreflow.operators.merge import new_rows, require_unique, upsert
from oreflow.operators.sizing import sized_side

MANIFEST = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("operation", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("part_key", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)


# Characters that Spark escapes in the folder names of partitions.
ESCAPED = set("\"#%'*/:=?\\{[]^\x7f") | {chr(i) for i in range(1, 32)}


def _folder(value: str) -> str:
    """The folder name of a partition value; ``*`` alone stands for every one."""
    return value if value == "*" else "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in value)


@dataclass
class SnapshotTable:
    """A table at ``path``.

    ``part`` names the column that partitions it (dates, hours or small
    integers), ``key`` the merge key. Set ``key_fixes_part`` where a key never
    moves to another partition, for instance when the event time of an event id
    never changes: merges then look for keys in the source's partitions only.
    Elsewhere ``key_summary`` keeps bitmaps of hashed keys beside the data: merges
    then read the partitions whose bitmap meets the source's, and no others.
    """

    spark: SparkSession
    path: str
    schema: T.StructType | str
    part: str | None = None
    key: tuple[str, ...] = ()
    key_fixes_part: bool = False
    key_summary: bool = False

    # ----------------------------------------------------------- manifest
    @property
    def _data(self) -> str:
        return f"{self.path}/data"

    @property
    def _keys(self) -> str:
        return f"{self.path}/keys"

    @property
    def _summarized(self) -> bool:
        return bool(self.key_summary and self.part and self.key and not self.key_fixes_part and list(self.key) != [self.part])

    def __post_init__(self) -> None:
        """Create the table if it is missing."""
        if isinstance(self.schema, str):
            self.schema = T.StructType.fromDDL(self.schema)
        empty = self.spark.createDataFrame([], MANIFEST)
        empty.write.mode("ignore").parquet(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def _entries(self) -> list:
        """Manifest rows in commit order: one per publish and touched partition."""
        rows = self.manifest().collect()
        return sorted(rows, key=lambda e: (e["snapshot_id"], e["action"] == "append"))

    @staticmethod
    def _apply(live: dict[str, dict[str, int]], entry) -> None:
        if entry["action"] == "reset":
            live.clear()
        elif entry["action"] == "drop":
            live.pop(entry["part_key"], None)
        elif entry["token"]:
            live.setdefault(entry["part_key"], {})[entry["token"]] = entry["rows"]

    def _live(self, snapshot_id: int | None = None) -> dict[str, dict[str, int]]:
        """Live files as {partition: {token: rows}}."""
        live: dict[str, dict[str, int]] = {}
        for entry in self._entries():
            if snapshot_id is None or entry["snapshot_id"] <= snapshot_id:
                self._apply(live, entry)
        return live

    def _commit(
        self, operation: str, committed_at: datetime | None, token: str | None = None, replace: bool = False,
        touched=(), reset: bool = False,
    ) -> int:
        """Add a publish to the manifest: what it drops, then what it adds.

        Row counts per partition come from the written files, in the same job
        that writes the manifest rows.
        """
        snapshot_id = max((e["snapshot_id"] for e in self._entries()), default=0) + 1
        moment = committed_at or datetime.now(timezone.utc)
        # A publish without rows still leaves its mark.
        marks = [("drop", value) for value in sorted(touched)] + [("reset" if reset else "mark", None)]
        marked = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(v).cast("string").alias("part_key")) for a, v in marks]))
        changes = self.spark.range(1).select(marked.alias("_m")).select(
            "_m.*", F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("rows")
        )
        if token:
            sizes = self._scan({"*": {token: 0}}).groupBy("part_key").agg(F.count("*").alias("rows"))
            actions = F.explode(F.array(*[F.lit(a) for a in (("drop", "append") if replace else ("append",))]))
            added = sizes.select(actions.alias("action"), "part_key", F.lit(token).alias("token"), "rows")
            changes = changes.unionByName(added)
        entries = changes.select(
            F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.lit(moment).alias("committed_at"),
            F.lit(operation).alias("operation"), "action", "part_key", "token", "rows",
        )
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return snapshot_id

    # -------------------------------------------------------------- write
    def _write(self, df: DataFrame) -> str | None:
        """Write rows under a new token, which is returned; None without rows.

        The rebalance hint lets adaptive execution split a partition with most
        of the rows over many writers and join small ones.
        """
        token = uuid.uuid4().hex
        part = F.coalesce(F.col(self.part).cast("string"), F.lit("none")) if self.part else F.lit("all")
        placed = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], part.alias("part_key"))
        seen = Observation()
        (
            placed.withColumn("token", F.lit(token))
            .hint("rebalance", "part_key")
            .observe(seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("part_key").alias("parts"))
            .write.mode("append")
            .partitionBy("part_key", "token")
            .parquet(self._data)
        )
        if not seen.get["rows"]:
            return None
        if self._summarized:
            written = self._scan({"*": {token: 0}}).withColumn("token", F.lit(token))
            bitmaps = key_bitmaps(written, list(self.key), ["part_key", "token"], bits_for(seen.get["rows"] // max(1, seen.get["parts"])))
            bitmaps.write.mode("append").partitionBy("part_key", "token").parquet(self._keys)
        return token

    def stage(self, df: DataFrame) -> tuple[str | None, DataFrame]:
        """Write rows without publishing them; returns (token, staged rows)."""
        token = self._write(df)
        return token, self._scan({"*": {token: 0}} if token else {}).drop("part_key")

    def publish(self, token: str | None, replace: bool = False, committed_at: datetime | None = None) -> int:
        """Make staged rows visible, beside or in place of their partitions."""
        return self._commit("swap" if replace else "append", committed_at, token, replace)

    def append(self, df: DataFrame, committed_at: datetime | None = None, operation: str = "append") -> int:
        return self._commit(operation, committed_at, self._write(df))

    def overwrite(self, df: DataFrame, committed_at: datetime | None = None, operation: str = "overwrite") -> int:
        """Replace all rows in one publish: readers never see an empty table."""
        return self._commit(operation, committed_at, self._write(df), reset=True)

    def overwrite_partitions(
        self, df: DataFrame, committed_at: datetime | None = None, operation: str = "overwrite", touched=()
    ) -> int:
        """Replace the partitions that ``df`` covers, and those ``touched``."""
        return self._commit(operation, committed_at, self._write(df), replace=True, touched=touched)

    def insert_new(self, source: DataFrame, committed_at: datetime | None = None) -> int:
        """Insert the rows whose key is not in the table yet."""
        return self.append(new_rows(source, self.read_holding(source), list(self.key)), committed_at, "insert")

    def merge(self, source: DataFrame, committed_at: datetime | None = None, check: bool = True) -> int:
        """Upsert by key; only partitions with touched keys are rewritten."""
        key = list(self.key)
        if check:
            require_unique(source, key)
        keys = sized_side(source.select(*key))
        live = self._live()
        touched = self._parts_of(source) | self._parts_holding(keys, source, live)
        kept = {value: tokens for value, tokens in live.items() if value in touched}
        result = upsert(self._scan(kept).drop("part_key"), source, key, keys) if kept else source
        return self.overwrite_partitions(result, committed_at, "merge", touched & set(live))

    def delete_keys(self, keys: DataFrame, committed_at: datetime | None = None) -> int:
        """Delete by key, rewriting only partitions that hold such keys."""
        key = list(self.key)
        listed = sized_side(keys.select(*key).distinct())
        live = self._live()
        touched = self._parts_holding(listed, keys, live)
        kept = {value: tokens for value, tokens in live.items() if value in touched}
        if not kept:
            return self._commit("delete", committed_at)
        rest = self._scan(kept).join(listed, key, "left_anti")
        return self.overwrite_partitions(rest, committed_at, "delete", touched)

    def compact(self, committed_at: datetime | None = None) -> int:
        """Rewrite partitions made of several publishes into one; same rows."""
        many = {value: tokens for value, tokens in self._live().items() if len(tokens) > 1}
        if not many:
            return self._commit("compact", committed_at)
        return self.overwrite_partitions(self._scan(many), committed_at, "compact", set(many))

    def _parts_of(self, source: DataFrame) -> set[str]:
        if not self.part:
            return {"all"}
        value = F.coalesce(F.col(self.part).cast("string"), F.lit("none"))
        return {row[0] for row in source.select(value).distinct().collect()}

    def _parts_holding(self, keys: DataFrame, source: DataFrame, live: dict[str, dict[str, int]]) -> set[str]:
        """Partition values with a row of these keys: reads key columns only."""
        if not self.part:
            return {"all"} & set(live)
        if (list(self.key) == [self.part] or self.key_fixes_part) and self.part in source.columns:
            return self._parts_of(source) & set(live)
        holders = self._scan(self._may_hold(keys, source, live)).join(keys, list(self.key), "left_semi")
        return {row[0] for row in holders.select("part_key").distinct().collect()}

    def _may_hold(self, keys: DataFrame, source: DataFrame, live: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
        """The live files that may hold one of these keys: those of the source's partitions where a key fixes its
        partition, those whose bitmap meets the keys' where bitmaps are kept, else all."""
        if self.key_fixes_part:
            sources = self._parts_of(source)
            return {value: tokens for value, tokens in live.items() if value in sources}
        if not self._summarized or not live:
            return live
        layout = "bits bigint, stretch bigint, bitmap binary, part_key string, token string"
        paths = self._paths(self._keys, live)
        kept = self.spark.read.schema(layout).option("basePath", self._keys).parquet(*paths)
        sizes = [row["bits"] for row in kept.select("bits").distinct().collect()]
        batch = reduce(DataFrame.unionByName, [key_bitmaps(keys, list(self.key), [], bits) for bits in sizes])
        met = groups_met(kept, batch, ["part_key", "token"]).collect()
        found: dict[str, dict[str, int]] = {}
        for row in met:
            found.setdefault(row["part_key"], {})[row["token"]] = live[row["part_key"]][row["token"]]
        return found

    @staticmethod
    def _paths(base: str, live: dict[str, dict[str, int]]) -> list[str]:
        return [f"{base}/part_key={_folder(value)}/token={token}" for value in sorted(live) for token in sorted(live[value])]

    # --------------------------------------------------------------- read
    def _scan(self, live: dict[str, dict[str, int]]) -> DataFrame:
        """Rows of the given files with their ``part_key``."""
        paths = self._paths(self._data, live)
        if not paths:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn("part_key", F.lit(None).cast("string"))
        full = T.StructType([*self.schema.fields, T.StructField("part_key", T.StringType()),
                             T.StructField("token", T.StringType())])
        reader = self.spark.read.schema(full).option("basePath", self._data)
        rows = reader.parquet(*paths).drop("token")
        if self.part:
            # Taken from the folder name, so filters on it prune folders.
            kind = self.schema[self.part].dataType.simpleString()
            rows = rows.withColumn(self.part, F.expr(f"try_cast(part_key AS {kind})"))
        return rows

    def read(self, snapshot_id: int | None = None, as_of: datetime | str | None = None) -> DataFrame:
        """Current rows, or those of a snapshot id or of a moment."""
        if as_of is not None:
            snapshot_id = self.snapshot_at(as_of)
        return self._scan(self._live(snapshot_id)).drop("part_key")

    def operations(self) -> list[str]:
        """What the publishes were called, each name once."""
        return [row[0] for row in self.manifest().select("operation").distinct().collect()]

    def parts_changed(self, since: int) -> list[str]:
        """Partitions that publishes after a snapshot have touched; all of both if one replaced everything."""
        later = self.manifest().filter(F.col("snapshot_id") > since).select("action", "part_key").distinct().collect()
        touched = {row["part_key"] for row in later if row["part_key"] is not None}
        if any(row["action"] == "reset" for row in later):
            touched |= set(self._live(since))
        return sorted(touched)

    def read_parts(self, values: list[str], snapshot_id: int | None = None) -> DataFrame:
        """Rows of some partitions only, now or as of a snapshot."""
        live = self._live(snapshot_id)
        return self._scan({v: live[v] for v in values if v in live}).drop("part_key")

    def read_holding(self, source: DataFrame) -> DataFrame:
        """Rows of the files that may hold a key of the source; those with one are all among them."""
        return self._scan(self._may_hold(source, source, self._live())).drop("part_key")

    def snapshot_at(self, moment: datetime | str) -> int:
        """Newest snapshot committed at or before the moment (0 if none)."""
        before = self.manifest().filter(F.col("committed_at") <= F.lit(moment).cast("timestamp"))
        return before.agg(F.max("snapshot_id")).first()[0] or 0

    # ----------------------------------------------------------- metadata
    def snapshots(self) -> DataFrame:
        """One row per publish with the table's row count after it."""
        live: dict[str, dict[str, int]] = {}
        log: dict[int, tuple] = {}
        for entry in self._entries():
            self._apply(live, entry)
            total = sum(n for tokens in live.values() for n in tokens.values())
            log[entry["snapshot_id"]] = (entry["snapshot_id"], entry["committed_at"], entry["operation"], total)
        layout = "snapshot_id long, committed_at timestamp, operation string, total_records long"
        return self.spark.createDataFrame(list(log.values()), layout)

    def history(self) -> DataFrame:
        """Publishes with their parent and whether they are the current one."""
        log = self.snapshots()
        newest = log.agg(F.max("snapshot_id")).first()[0]
        return log.select(
            F.col("committed_at").alias("made_current_at"),
            "snapshot_id",
            F.when(F.col("snapshot_id") > 1, F.col("snapshot_id") - 1).alias("parent_id"),
            (F.col("snapshot_id") == F.lit(newest)).alias("is_current"),
        )

    def files(self) -> DataFrame:
        """Live files with size and rows, from file metadata."""
        return (
            self._scan(self._live())
            .groupBy("part_key", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_size").alias("file_size"))
            .agg(F.count("*").alias("record_count"))
        )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One labelled row count per table, in one job."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
