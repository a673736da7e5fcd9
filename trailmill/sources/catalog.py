"""Databases and tables: a table holds the events of one type of object.

A table is a folder with ``events`` (Parquet, one column per property),
``batches`` (the same, a folder per batch of a stream) and ``registry`` (one
small file per version, which also names the folder of events).  Nothing is
updated in place: appends add files, and a new registry version is written
beside the old one, where a second writer of the same version fails.  Writers
hold the table's lock, a file that only one can create.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.paths import Slicing, micros, plan_slices
from ..operators.state import path_lengths, state_at, transitions, with_state
from ..registry import Action, Property, Registry, RegistryError
from ..session import file_system, prepare
from ..types import DATA_TYPES
from .jsonimport import parse_lenient, parse_timestamp

BASE = "object_id long, ts long, seq long, action_id int"


class Database:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path.rstrip("/")
        self._open: dict[str, Table] = {}

    def table(self, name: str) -> Table:
        """Open or create a table; an open one is used again."""
        if not name or "/" in name:
            raise ValueError(f"bad table name: {name!r}")
        if name not in self._open:
            self._open[name] = Table(self.spark, f"{self.path}/{name}")
        return self._open[name]


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder, self._holds = "events", False
        self.registry, self._version = self._load()

    def _exists(self, path: str) -> bool:
        fs, p = file_system(self.spark, path)
        return fs.exists(p)

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Hold the lock that writers take; an error if another one has it."""
        if self._holds:
            yield
            return
        fs, p = file_system(self.spark, f"{self.path}/lock")
        try:
            fs.create(p, False).close()
        except Exception as e:
            raise RegistryError(f"the table is locked: {p}") from e
        self._holds = True
        try:
            yield
        finally:
            self._holds = False
            fs.delete(p, False)

    def unlock(self) -> None:
        """Remove a lock that a lost writer left."""
        fs, p = file_system(self.spark, f"{self.path}/lock")
        fs.delete(p, False)

    def _load(self) -> tuple[Registry, int]:
        fs, p = file_system(self.spark, f"{self.path}/registry")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        version = max((int(n[1:]) for n in names if n[1:].isdigit()), default=0)
        if not version:
            return Registry(), 0
        content = json.loads(self.spark.read.text(f"{self.path}/registry/v{version}", wholetext=True).first()[0])
        self.folder = content.get("folder", "events")
        return Registry.from_dict(content), version

    def _save(self) -> None:
        row = self.spark.createDataFrame([(json.dumps(self.registry.to_dict() | {"folder": self.folder}),)], "value string").coalesce(1)
        row.write.mode("errorifexists").text(f"{self.path}/registry/v{self._version + 1}")
        self._version += 1

    # Registry

    def add_action(self, name: str) -> Action:
        new = self.registry.add_action(name)
        self._save()
        return new

    def get_action(self, action_id: int) -> Action | None:
        return self.registry.action(action_id)

    def all_actions(self) -> DataFrame:
        return self.spark.createDataFrame([(a.id, a.name) for a in self.registry.all_actions()], "id int, name string")

    def add_property(self, kind: str, data_type: str, name: str) -> Property:
        new = self.registry.add_property(kind, data_type, name)
        self._save()
        return new

    def get_property(self, property_id: int) -> Property | None:
        return self.registry.property(property_id)

    def all_properties(self) -> DataFrame:
        return self.spark.createDataFrame([(p.id, p.kind, p.data_type, p.name) for p in self.registry.all_properties()], "id int, kind string, data_type string, name string")

    # Events

    def schema(self) -> T.StructType:
        schema = T._parse_datatype_string(BASE)
        for p in self.registry.all_properties():
            schema = schema.add(p.name, DATA_TYPES[p.data_type])
        return schema

    def events(self) -> DataFrame:
        """All events with every registered property; properties that a file lacks are null there."""
        return self._read(self._folders())

    def _folders(self) -> list[str]:
        fs, p = file_system(self.spark, f"{self.path}/batches")
        batches = [f"{self.path}/batches/{f.getPath().getName()}" for f in fs.listStatus(p)] if fs.exists(p) else []
        return [f for f in (f"{self.path}/{self.folder}", *sorted(batches)) if self._exists(f)]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema())

    def append(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append valid events; the rejected rows with a ``reason``.

        ``rows`` have ``object_id``, ``timestamp`` or ``ts`` (microseconds),
        optionally ``action_id`` or ``action`` (a registered name), ``seq``, and
        a column per property.  Values are cast to the registered type; a value
        that cannot be cast, an object not above 0, a missing time or an event
        with neither action nor data is rejected.  An id of an action need not
        be registered.  Columns that are no property are an error.  Without
        ``seq`` rows are numbered after those already stored.  A ``batch`` that
        is appended again takes the place of what it wrote before.
        """
        with self.locked():
            return self._append(rows, batch)

    def _append(self, rows: DataFrame, batch: str | None) -> DataFrame:
        given = set(rows.columns) - {"object_id", "timestamp", "ts", "seq", "action_id", "action"}
        known = {p.name: p for p in self.registry.all_properties()}
        if unknown := given - set(known):
            raise RegistryError(f"unknown properties: {sorted(unknown)}")
        out = rows
        if "ts" not in rows.columns:
            out = out.withColumn("ts", micros("timestamp"))
        if "action" in rows.columns:
            names = self.spark.createDataFrame([(a.name, a.id) for a in self.registry.all_actions()], "action string, _named int")
            out = out.join(F.broadcast(names), "action", "left")
        else:
            out = out.withColumns({"action": F.lit(None).cast("string"), "_named": F.lit(None).cast("int")})
        if "action_id" not in rows.columns:
            out = out.withColumn("action_id", F.lit(None).cast("int"))
        out = out.withColumn("_action", F.coalesce("_named", F.col("action_id").try_cast("int")))
        values = {c: F.col(c).try_cast(DATA_TYPES[known[c].data_type]) for c in sorted(given)}
        bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in values.items()), F.lit(None).cast("string")))
        has_data = F.lit(False)
        for c in given:
            has_data = has_data | F.col(c).isNotNull()
        reason = (
            F.when(F.col("object_id").isNull() | (F.col("object_id") <= 0), "object id must be above 0")
            .when(F.col("ts").isNull(), "missing time")
            .when(F.col("action").isNotNull() & F.col("_named").isNull(), "unknown action")
            .when(F.size(bad) > 0, F.concat(F.lit("wrong type: "), F.array_join(bad, ", ")))
            .when((F.coalesce("_action", F.lit(0)) == 0) & ~has_data, "neither action nor data")
        )
        out = out.withColumn("reason", reason)
        good = out.where(F.col("reason").isNull())
        if "seq" not in rows.columns:
            own = f"{self.path}/batches/{batch}"
            last = self._read([f for f in self._folders() if f != own]).agg(F.max("seq")).first()[0]
            good = good.withColumn("seq", F.monotonically_increasing_id() + F.lit((last if last is not None else -1) + 1))
        good = good.select(F.col("object_id").cast("long"), "ts", F.col("seq").cast("long"), F.coalesce("_action", F.lit(0)).alias("action_id"), *(v.alias(c) for c, v in values.items()))
        if batch is None:
            good.write.mode("append").parquet(f"{self.path}/{self.folder}")
        else:
            good.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return out.where(F.col("reason").isNotNull()).select(*rows.columns, "reason")

    def append_rows(self, rows: Iterable[dict]) -> DataFrame:
        """Append events given as dictionaries, in order of arrival."""
        rows = list(rows)
        props = [p for p in self.registry.all_properties() if any(p.name in r for r in rows)]
        fields = T._parse_datatype_string("object_id long, ts long, action_id int")
        for p in props:
            fields = fields.add(p.name, DATA_TYPES[p.data_type])
        extra = {k for r in rows for k in r} - {f.name for f in fields}
        if extra:
            raise RegistryError(f"unknown properties: {sorted(extra)}")
        data = [tuple(r.get(f.name) for f in fields) for r in rows]
        return self.append(self.spark.createDataFrame(data, fields).coalesce(1))

    def compact(self, files: int = 64) -> None:
        """Write the events anew, clustered by object and time, in files whose statistics skip by both.

        Ranges are found from a sample, so a hot object fills several files.
        Readers see the old folder until the registry names the new one; the
        old one and the batches taken over are removed then.
        """
        with self.locked():
            old = self._folders()
            folder = f"events-{self._version + 1}"
            self.events().repartitionByRange(files, "object_id", "ts").sortWithinPartitions("object_id", "ts", F.col("seq").desc()).write.parquet(f"{self.path}/{folder}")
            self.folder = folder
            self._save()
            for path in old:
                fs, p = file_system(self.spark, path)
                fs.delete(p, True)

    def import_json(self, text: str) -> DataFrame:
        """Import a document ``{table: {actions, properties, events}}``; the rejected events.

        Keys may be unquoted and commas missing.  Sections are taken in order,
        so actions and properties must come before the events that use them.
        An unknown key, action or property is an error; null stands for 0.
        """
        document = parse_lenient(text)
        if set(document) != {"table"}:
            raise ValueError("expected one key: table")
        rejected = None
        for section, content in document["table"].items():
            if section == "blockSize":
                continue  # files are sized by Parquet
            if section == "actions":
                for a in content:
                    self.registry.add_action(_only(a, "name")["name"])
                self._save()
            elif section == "properties":
                for p in content:
                    _only(p, "type", "dataType", "name")
                    self.registry.add_property(p["type"], p["dataType"], p["name"])
                self._save()
            elif section == "events":
                rejected = self.append_rows([self._event(e) for e in content])
            else:
                raise ValueError(f"unknown key: {section}")
        return rejected if rejected is not None else self.spark.createDataFrame([], "object_id long, reason string")

    def _event(self, e: dict) -> dict:
        _only(e, "timestamp", "objectId", "action", "data")
        action = None
        if e.get("action") is not None:
            action = self.registry.action_named(e["action"])
            if action is None:
                raise RegistryError(f"unknown action: {e['action']}")
        row = {"object_id": e.get("objectId"), "ts": parse_timestamp(e["timestamp"]), "action_id": action.id if action else None}
        for name, value in (e.get("data") or {}).items():
            p = self.registry.property_named(name)
            if p is None:
                raise RegistryError(f"unknown property: {name}")
            value = 0 if value is None else value
            row[name] = float(value) if p.data_type == "Float" and type(value) in (int, float) else value
        return row

    # Queries

    def kinds(self) -> tuple[dict[str, str], dict[str, str]]:
        """Object and action properties with their data types."""
        props = self.registry.all_properties()
        return {p.name: p.data_type for p in props if p.id > 0}, {p.name: p.data_type for p in props if p.id < 0}

    def with_state(self, properties: list[str] | None = None, slicing: Slicing | None = None) -> DataFrame:
        """Events with the properties named (all by default) as they stand."""
        sticky, transient = self.kinds()
        wanted = set(properties if properties is not None else [*sticky, *transient])
        if unknown := wanted - set(sticky) - set(transient):
            raise RegistryError(f"unknown properties: {sorted(unknown)}")
        sticky, transient = ({n: t for n, t in d.items() if n in wanted} for d in (sticky, transient))
        events = self.events().select("object_id", "ts", "seq", "action_id", *sorted(wanted))
        if slicing is None and sticky:
            slicing = plan_slices(events, time="ts")
        return with_state(events, sticky, transient, slicing=slicing)

    def state_at(self, at: int) -> DataFrame:
        return state_at(self.events(), at, self.kinds()[0])

    def events_of(self, object_id: int) -> DataFrame:
        return self.events().where(F.col("object_id") == object_id).orderBy("ts", F.col("seq").desc())

    def transitions(self) -> DataFrame:
        events = self.events()
        return transitions(events, slicing=plan_slices(events, time="ts"))

    def path_lengths(self) -> DataFrame:
        return path_lengths(self.events())

    def query(self, program: str) -> DataFrame:
        """Run a path program (see ``plans``) over all paths."""
        from ..plans import run

        sticky, transient = self.kinds()
        return run(program, self.events(), sticky, transient)


def _only(d: dict, *keys: str) -> dict:
    if unknown := set(d) - set(keys):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return d
