"""Stage tables with contracts: named, checked, committed, clustered or bucketed.

A contract names a table's columns, types and keys and how it is laid out:

* ``partition_by``: one folder per value, so a read of one value opens no other;
* ``cluster_by``: rows range-partitioned and sorted by these columns; the
  manifest keeps each file's least and greatest value, so a read of some values
  opens only the files that can hold them;
* ``bucket_by``: rows dealt into a fixed number of buckets by a hash, sorted
  inside, so two tables with the same buckets are joined and grouped by these
  columns without a shuffle.

A stage writes into a folder of its own and ends with its manifest.  Readers go
by the manifest: a stage that broke off is an error by name, and a rerun
replaces the old table only when the new one is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.sources.sinks import exists, write_text

#: Rows of a file of a clustered table.
CLUSTER_ROWS = 1 << 20


class StageError(ValueError):
    """A stage table that isn't what its contract says, or isn't there."""


@dataclass(frozen=True)
class Contract:
    """What a stage table holds and how it is laid out."""

    name: str
    columns: dict[str, str]
    keys: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0

    def __post_init__(self) -> None:
        for c in (*self.keys, *self.partition_by, *self.cluster_by, *self.bucket_by):
            if c not in self.columns:
                raise StageError(f"stage {self.name}: layout column {c} isn't a column of the contract")
        if bool(self.bucket_by) != (self.buckets > 0) or (self.bucket_by and self.cluster_by):
            raise StageError(f"stage {self.name}: give bucket columns and their number, and no clustering beside them")

    @property
    def schema(self) -> T.StructType:
        """Partition columns last, as files are read."""
        order = [*(c for c in self.columns if c not in self.partition_by), *self.partition_by]
        return T._parse_datatype_string(", ".join(f"`{c}` {self.columns[c]}" for c in order))

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` with exactly the columns of the contract; a missing one or another type is an error before anything runs."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for want in self.schema.fields:
            if want.name not in kinds:
                raise StageError(f"stage {self.name}: column {want.name} is missing")
            if kinds[want.name] != want.dataType:
                raise StageError(f"stage {self.name}: column {want.name} is {kinds[want.name].simpleString()}, not {want.dataType.simpleString()}")
        return df.select(*[f.name for f in self.schema.fields])


@dataclass
class StageStore:
    """The stage tables below one folder, by name; a name means one contract."""

    spark: SparkSession
    root: str
    contracts: dict[str, Contract] = field(default_factory=dict)

    def declare(self, *contracts: Contract) -> "StageStore":
        for c in contracts:
            # names are compared as a case-blind store would, and none may be another's prefix in a file pattern
            for other in self.contracts.values():
                if other != c and other.name.lower() == c.name.lower():
                    raise StageError(f"stage {c.name}: the name is taken by another contract")
            self.contracts[c.name] = c
        return self

    def contract(self, name: str) -> Contract:
        if name not in self.contracts:
            raise StageError(f"stage {name}: no contract of this name")
        return self.contracts[name]

    def _manifest_path(self, name: str) -> str:
        return f"{self.root}/{name}/manifest.json"

    def manifest(self, name: str) -> dict:
        contract = self.contract(name)
        path = self._manifest_path(name)
        if not exists(self.spark, path):
            raise StageError(f"stage {name}: not finished, {path} is missing")
        found = json.loads(self.spark.read.text(path, wholetext=True).first()[0])
        if found["columns"] != contract.columns:
            changed = sorted(set(found["columns"].items()) ^ set(contract.columns.items()))
            raise StageError(f"stage {name}: written under another contract, differing in {changed}")
        return found

    def write(self, name: str, df: DataFrame, check_keys: bool = True) -> DataFrame:
        """Write and commit a stage; returns it as read back."""
        contract = self.contract(name)
        rows = contract.checked(df)
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        writer = rows.write
        if contract.cluster_by:
            n = -(-rows.count() // CLUSTER_ROWS) or 1
            # partition values are constant inside a file, so they come first in its order
            order = [*contract.partition_by, *contract.cluster_by]
            writer = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write
        if contract.partition_by:
            writer = writer.partitionBy(*contract.partition_by)
        if contract.bucket_by:
            # a task for each bucket, so a bucket is one file per partition value
            by = [F.col(c) for c in contract.bucket_by]
            table = self._table(name, version)
            dealt = rows.repartition(contract.buckets, *by).write
            dealt = dealt.partitionBy(*contract.partition_by) if contract.partition_by else dealt
            dealt.bucketBy(contract.buckets, *contract.bucket_by).sortBy(*contract.bucket_by).option("path", path).format("parquet").saveAsTable(table)
        else:
            writer.parquet(path)
        manifest = {"version": version, "columns": contract.columns, "files": self._files(contract, path), "values": self._values(contract, path)}
        if check_keys and contract.keys:
            # a bucketed table has all rows of a key in one bucket, so it is checked without a shuffle
            bucketed = contract.bucket_by and set(contract.bucket_by) <= set(contract.keys)
            self._check_keys(contract, self.spark.table(table) if bucketed else self.spark.read.schema(contract.schema).parquet(path))
        write_text(self.spark, self._manifest_path(name), json.dumps(manifest))
        return self.read(name)

    def _files(self, contract: Contract, path: str) -> list[dict]:
        """Least and greatest cluster values of each file: a row per file, and only for clustered tables."""
        if not contract.cluster_by:
            return []
        rows = self.spark.read.schema(contract.schema).parquet(path)
        bounds = [f(c).cast("string").alias(f"{s}_{i}") for i, c in enumerate(contract.cluster_by) for s, f in (("low", F.min), ("high", F.max))]
        found = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *bounds).collect()
        return [{"path": r["path"], "rows": r["rows"]} | {c: [r[f"low_{i}"], r[f"high_{i}"]] for i, c in enumerate(contract.cluster_by)} for r in found]

    def _values(self, contract: Contract, path: str) -> list:
        """Values of the first partition column: one per folder."""
        if not contract.partition_by:
            return []
        rows = self.spark.read.schema(contract.schema).parquet(path).select(contract.partition_by[0])
        return sorted(r[0] for r in rows.distinct().collect() if r[0] is not None)

    def values(self, name: str) -> list:
        """What ``family`` can be asked for."""
        return self.manifest(name)["values"]

    def _check_keys(self, contract: Contract, rows: DataFrame) -> None:
        twice = rows.groupBy(*contract.keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").first()
        if twice is not None:
            raise StageError(f"stage {contract.name}: {twice['__n']} rows for key {[twice[k] for k in contract.keys]}")

    def _table(self, name: str, version: str) -> str:
        return f"stage_{name}_{version[2:]}".lower()

    def read(self, name: str) -> DataFrame:
        """A finished stage; bucketed ones keep their buckets in the plan."""
        contract, manifest = self.contract(name), self.manifest(name)
        path = f"{self.root}/{name}/{manifest['version']}"
        if not contract.bucket_by:
            return self.spark.read.schema(contract.schema).parquet(path)
        table = self._table(name, manifest["version"])
        if not self.spark.catalog.tableExists(table):  # another session wrote it
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contract.schema.fields)
            by = ", ".join(f"`{c}`" for c in contract.bucket_by)
            parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in contract.partition_by)})" if contract.partition_by else ""
            self.spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet {parts} CLUSTERED BY ({by}) SORTED BY ({by}) INTO {contract.buckets} BUCKETS LOCATION '{path}'")
            if contract.partition_by:
                self.spark.sql(f"MSCK REPAIR TABLE {table}")
        return self.spark.table(table)

    def family(self, name: str, values: Iterable[str]) -> DataFrame:
        """The rows of some values of a partitioned table's first partition column; no other folder is opened."""
        contract = self.contract(name)
        if not contract.partition_by:
            raise StageError(f"stage {name}: not partitioned")
        return self.read(name).filter(F.col(contract.partition_by[0]).isin(*values))

    def read_where(self, name: str, **wanted) -> DataFrame:
        """The rows of a clustered table with these values; only files that can hold them are opened."""
        contract, manifest = self.contract(name), self.manifest(name)
        path = f"{self.root}/{name}/{manifest['version']}"
        condition: Column = F.lit(True)
        for c, value in wanted.items():
            condition = condition & (F.col(c) == F.lit(value))
        chosen = [f["path"] for f in manifest["files"] if all(self._may_hold(contract, f, c, v) for c, v in wanted.items())]
        if not chosen:
            return self.spark.createDataFrame([], contract.schema)
        return self.spark.read.schema(contract.schema).option("basePath", path).parquet(*chosen).filter(condition)

    @staticmethod
    def _may_hold(contract: Contract, file: dict, column: str, value) -> bool:
        if column in contract.partition_by:
            return f"/{column}={value}/" in file["path"] or any(x in str(value) for x in ' :/\\#%{}[]^"*?=\x7f')  # escaped names are left to Spark
        if column not in file or file[column][0] is None:
            return column not in file
        low, high = file[column]
        if isinstance(value, str):
            return low.encode() <= value.encode() <= high.encode()
        return float(low) <= float(value) <= float(high)
