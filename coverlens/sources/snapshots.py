"""Tables that change: versions of a whole store, of which a reader sees one or the other.

A store holds several tables, each cut into parts by a hash of its key. A change writes new folders for the parts it touches
and then one file: the parts of the new version, old ones by their old folders. That file comes last and whole, so a
reader sees either version, a run that stops before it has changed nothing, and the next run begins anew. Nothing is
overwritten, so any version can still be read, and a version names all tables at once: a delete that cascades is seen in all
of them or in none.

A change names the version its rows were derived from, and is refused if that is not the newest any more. Writers of one
store take turns, as Spark's writers know no write that fails if another one was first: of two changes that pass that test in
the same moment, readers see one, the same for all.
"""
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from coverlens.sources.sinks import stored

PARTS = 64
_LOG = "version long, writer string, name string, part int, path string, schema string"
#: Parts of a table without rows in a version have a row without a path.


class Conflict(Exception):
    """The rows were derived from a version that is not the newest any more."""


class Store:
    """A folder of versions. ``keys`` names the key columns of each table."""

    def __init__(self, spark: SparkSession, directory: str, keys: dict[str, list[str]], parts: int = PARTS):
        self.spark, self.directory, self.keys, self.parts = spark, directory.rstrip("/"), keys, parts

    def _log(self) -> DataFrame:
        found = stored(self.spark, _LOG, f"{self.directory}/versions")
        return self.spark.createDataFrame([], _LOG) if found is None else found

    def _manifest(self, version: int) -> dict:
        """{table: {part: path}} of a version, and {table: schema}. At most one row per table and part."""
        rows = self._log().where(F.col("version") == version).collect()
        if not rows:
            return {}, {}
        writer = min(r["writer"] for r in rows)
        paths, schemas = {}, {}
        for r in rows:
            if r["writer"] == writer:
                paths.setdefault(r["name"], {})[r["part"]] = r["path"]
                schemas[r["name"]] = r["schema"]
        return paths, schemas

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return self._log().agg(F.max("version")).first()[0] or 0

    def part_of(self, name: str):
        """The part of a row of a table, from its key columns."""
        return F.pmod(F.xxhash64(F.lit("part"), *[F.col(k).cast("string") for k in self.keys[name]]), F.lit(self.parts)).cast("int")

    def read(self, name: str, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest if None), or some of its parts."""
        paths, schemas = self._manifest(self.version() if version is None else version)
        if name not in schemas:
            raise ValueError(f"no table {name} in this version")
        wanted = [p for part, p in paths[name].items() if p and (parts is None or part in parts)]
        schema = T.StructType.fromJson(json.loads(schemas[name]))
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The parts that hold rows of these keys: at most all."""
        return sorted(r[0] for r in keys.select(self.part_of(name).alias("p")).distinct().collect())

    def commit(self, changes: dict, base: int | None = None) -> int:
        """Writes a new version and returns its number.

        changes: {table: rows} for whole tables, {table: (rows, parts)} where rows replace those parts only. base: the version
        that the rows were derived from (the newest if None).
        """
        base = self.version() if base is None else base
        paths, schemas = self._manifest(base)
        writer = uuid.uuid4().hex
        for name, change in changes.items():
            rows, parts = change if isinstance(change, tuple) else (change, range(self.parts))
            folder = f"{self.directory}/{name}/{writer}"
            placed = rows.withColumn("key_part", self.part_of(name))
            placed.hint("rebalance", "key_part").write.partitionBy("key_part").parquet(folder)
            written = stored(self.spark, "key_part int", folder)
            filled = {r[0] for r in written.select("key_part").distinct().collect()}
            if not filled <= set(parts):
                raise ValueError(f"rows of {name} belong to parts that are not replaced")
            paths.setdefault(name, {}).update({p: f"{folder}/key_part={p}" if p in filled else None for p in parts})
            schemas[name] = rows.schema.json()
        version = base + 1
        rows = [(version, writer, name, part, path, schemas[name]) for name, of in paths.items() for part, path in of.items()]
        if self.version() != base:
            raise Conflict(f"version {version} was written meanwhile")
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.directory}/versions")
        return version
