"""Parquet feature store: rows first, then their lines, a commit last.

Below ``group=<g>/scope=<s>/feature=<key>``, ``rows/run=<id>/grp=<n>`` holds
feature rows, ``manifest/lines=<id>/grp=<n>`` one line per stored case with its
row count, and ``log/<number>`` the commits: each lists the runs that are
visible from then on, with the number and names of their storage groups. A
case is known by entity and time, whatever its name, and stands in one visible
run only: a writer that finds its number taken takes out what was stored
meanwhile before it tries the next one. Readers pin a commit, so neither
interrupted nor later runs nor compactions change what they see. The key holds
a hash of the settings and of the vocabulary.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Feature
from ..constants import CASE_KEY
from ..functions.hashing import entity_group
from ..operators.vocab import Vocabulary, build_vocab
from ..plans.features import build_feature, settled_rows
from ..session import discard, materialize
from .commits import CommitLog
from .records import write_by_group

PAIR = ["pid", "pred_dt"]
# Stages that can be stored in between, in their order.
STAGES = ("observation", "records", "tokens")
# As many cases are looked up by name of folder and value; more are joined.
FEW = 1000
# Longer than any one write or read takes.
GRACE_HOURS = 24.0


@dataclass
class Pending:
    """A run whose rows are written and not visible yet: its id, its lines,
    and the lines of other runs that its cases are known not to be in."""

    run: str
    lines: DataFrame
    checked: set[str]


class FeatureStore:
    """Features of one case set: ``group`` names the entities, ``scope`` the
    cases (whole, filtered, ...); ``groups`` is the number of storage groups
    that new rows are written in."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        group: str = "all",
        scope: str = "whole",
        groups: int = 64,
    ):
        self.spark, self.groups = spark, groups
        self.path = f"{path.rstrip('/')}/group={group}/scope={scope}"

    def settled(self, feature: Feature) -> Feature:
        """The feature with its vocabulary built: stored ids belong to one."""
        tokens = feature.tokens
        if feature.compress is None or isinstance(tokens.vocab, Vocabulary):
            return feature
        return replace(feature, tokens=replace(tokens, vocab=build_vocab(tokens.vocab, (), tokens.unk)))

    def key(self, feature: Feature) -> str:
        """Name and settings of a feature, and what its records are read from."""
        text = "".join(c if c.isalnum() or c in "._-" else "_" for c in feature.name)
        return f"{text}_{self.settled(feature).config_hash}"

    def _folder(self, kind: str, feature: Feature) -> str:
        return f"{self.path}/feature={self.key(feature)}/{kind}"

    def _log(self, feature: Feature) -> CommitLog:
        return CommitLog(self.spark, self._folder("log", feature))

    def version(self, feature: Feature) -> int:
        """Number of the latest commit, 0 before the first."""
        return max(self._log(feature).times(), default=0)

    def _visible(self, feature: Feature, version: int | None = None) -> list[dict]:
        log = self._log(feature)
        return log.latest()[1] if version is None else log.entries(version)

    def _table(self, kind: str, feature: Feature, folders: Iterable[str]) -> DataFrame:
        base = self._folder(kind, feature)
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])

    def _lines(self, feature: Feature, runs: Sequence[dict]) -> DataFrame:
        lines = self._table("manifest", feature, [f"lines={r['lines']}" for r in runs])
        return lines.select(*PAIR, "run", "nrow", "groups")

    def _rows(self, feature: Feature, runs: Sequence[dict]) -> DataFrame | None:
        filled = [f"run={r['run']}" for r in runs if r["filled"]]
        return self._table("rows", feature, filled) if filled else None

    def manifest(self, feature: Feature, cases: DataFrame, version: int | None = None) -> DataFrame:
        """Stored cases: ``pid, pred_dt, run, nrow, groups``, one line each."""
        runs = self._visible(feature, version)
        if runs:
            return self._lines(feature, runs)
        fields = [cases.schema[c] for c in PAIR]
        extra = [("run", T.StringType()), ("nrow", T.LongType()), ("groups", T.IntegerType())]
        schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in extra]])
        return self.spark.createDataFrame([], schema)

    def size(self, feature: Feature, cases: DataFrame) -> DataFrame:
        """Stored cases and rows of a feature (one line)."""
        return self.manifest(feature, cases).agg(
            F.count("*").alias("n_cases"), F.coalesce(F.sum("nrow"), F.lit(0)).alias("n_rows")
        )

    def status(self, feature: Feature, cases: DataFrame) -> DataFrame:
        """Cases with ``status``: hit, empty (known to have no rows) or miss."""
        known = self.manifest(feature, cases).select(*PAIR, "nrow")
        status = (
            F.when(F.col("nrow").isNull(), "miss").when(F.col("nrow") == 0, "empty").otherwise("hit")
        )
        return cases.join(known, PAIR, "left").withColumn("status", status)

    def read(
        self, feature: Feature, cases: DataFrame, schema: T.StructType | None = None, version: int | None = None
    ) -> DataFrame:
        """Stored rows of the given cases, named as the cases are, as of
        commit ``version`` (the latest); none before the first run.
        ``schema`` is the rows' schema where no row is stored and it is not
        the feature's own."""
        if version is None:
            version = self.version(feature)
        stored = self._rows(feature, self._visible(feature, version))
        if stored is None:
            return self._none(feature, cases, schema)
        listed = self.manifest(feature, cases, version).where(F.col("nrow") > 0)
        wanted = cases.select(*CASE_KEY).join(listed, PAIR)
        wanted = wanted.withColumn("grp", _group(F.col("pid"), F.col("groups")))
        # The folders follow from run and entity: they prune the scan when
        # few entities are asked for.
        rows = stored.join(wanted.select("run", "grp").distinct(), ["run", "grp"], "left_semi")
        rows = rows.drop("case_id").join(wanted.select(*CASE_KEY, "run"), [*PAIR, "run"])
        return rows.select(*[c for c in stored.columns if c not in ("grp", "run")])

    def _none(self, feature: Feature, cases: DataFrame, schema: T.StructType | None = None) -> DataFrame:
        schema = schema or build_feature(cases.limit(0), self.settled(feature)).schema
        return self.spark.createDataFrame([], schema)

    def lookup(self, feature: Feature, cases: DataFrame, version: int | None = None) -> DataFrame:
        """As ``read``, for a few cases: only the folders of their groups are
        opened, first of lines, then of rows, and row groups are skipped by
        order and Bloom filter of the entity. More than ``FEW`` cases are
        read by ``read``."""
        if version is None:
            version = self.version(feature)
        runs = self._visible(feature, version)
        sizes = sorted({r["groups"] for r in runs})
        groups = F.array(*[entity_group(F.col("pid"), groups=g) for g in sizes]).alias("grps")
        few = materialize(cases.select(*CASE_KEY, groups).limit(FEW + 1))
        asked = few.where("pid IS NOT NULL").select("pid", "grps").collect()
        if len(asked) > FEW:
            return self.read(feature, cases, version=version)
        asked_groups = {g: {a.grps[k] for a in asked} for k, g in enumerate(sizes)}
        folders = [
            f"lines={r['lines']}/grp={g}" for r in runs for g in sorted(asked_groups[r["groups"]] & set(r["known"]))
        ]
        if not folders:
            return self._none(feature, cases)
        among = F.col("pid").isin(sorted({a.pid for a in asked}))
        lines = self._table("manifest", feature, folders).where(among & (F.col("nrow") > 0))
        found = materialize(lines.join(F.broadcast(few), PAIR).select(*CASE_KEY, "run", "grp"))
        places = found.select("run", "grp").distinct().orderBy("run", "grp").collect()
        if not places:
            return self._none(feature, cases)
        stored = self._table("rows", feature, [f"run={p.run}/grp={p.grp}" for p in places])
        rows = stored.where(among).drop("case_id").join(F.broadcast(found.drop("grp")), [*PAIR, "run"])
        return rows.select(*[c for c in stored.columns if c not in ("grp", "run")])

    def append(self, feature: Feature, cases: DataFrame, rows: DataFrame) -> str:
        """Store the rows of ``cases``; cases already stored are skipped."""
        new, checked = self._missing(feature, cases.select(*CASE_KEY))
        pending = self.prepare(feature, new, rows.join(new.select(*PAIR), PAIR, "left_semi"), checked)
        self.commit(feature, pending)
        return pending.run

    def _missing(self, feature: Feature, cases: DataFrame) -> tuple[DataFrame, set[str]]:
        """Cases not stored yet, each entity and time once, and the lines that
        were looked through."""
        version = self.version(feature)
        known = self.manifest(feature, cases, version).select(*PAIR)
        missing = cases.join(known, PAIR, "left_anti").dropDuplicates(PAIR)
        return materialize(missing.select(*cases.columns)), _line_names(self._visible(feature, version))

    def prepare(
        self, feature: Feature, cases: DataFrame, rows: DataFrame, checked: Iterable[str] = (), run: str = ""
    ) -> Pending:
        """Write the rows of ``cases``; nobody sees them before ``commit``."""
        run = run or f"r{uuid.uuid4().hex}"
        grp = entity_group(F.col("pid"), groups=self.groups)
        folder = f"{self._folder('rows', feature)}/run={run}"
        write_by_group(rows.withColumn("grp", grp), folder, PAIR, bloom=["pid"])
        # Counts are taken from what was written, not from a second run of
        # the plan.
        keys = T.StructType([cases.schema[c] for c in PAIR])
        counts = self.spark.read.schema(keys).parquet(folder).groupBy(*PAIR).agg(F.count("*").alias("nrow"))
        lines = cases.select(*PAIR).distinct().join(counts, PAIR, "left")
        extra = {"run": F.lit(run), "nrow": F.coalesce("nrow", F.lit(0)), "groups": F.lit(self.groups), "grp": grp}
        return Pending(run, lines.withColumns(extra), set(checked))

    def commit(self, feature: Feature, pending: Pending) -> int:
        """Make a run visible. Cases that other runs have stored since it was
        prepared are taken out of its lines; where none is left there is no
        commit. Returns the number of the commit that holds its cases."""
        log, lines, entry, tries = self._log(feature), pending.lines, None, 0
        while True:
            number, runs = log.latest()
            fresh = [r for r in runs if r["lines"] not in pending.checked]
            if fresh or entry is None:
                if fresh:
                    lines = lines.join(self._lines(feature, fresh).select(*PAIR), PAIR, "left_anti")
                name = f"{pending.run}-{tries}" if tries else pending.run
                entry = self._written_lines(feature, pending.run, name, lines)
                if entry is None:
                    return number
                lines = self._table("manifest", feature, [f"lines={name}"]).drop("lines")
                pending.checked |= _line_names(fresh)
                tries += 1
            if log.put(number + 1, [*runs, entry]):
                return number + 1

    def _written_lines(self, feature: Feature, run: str, name: str, lines: DataFrame) -> dict | None:
        """Write lines; the run's entry for a commit, nothing if it has none."""
        write_by_group(lines, f"{self._folder('manifest', feature)}/lines={name}", PAIR, bloom=["pid"])
        schema = T.StructType([f for f in lines.schema if f.name != "grp"] + [T.StructField("grp", T.LongType())])
        written = self.spark.read.schema(schema).parquet(f"{self._folder('manifest', feature)}/lines={name}")
        # One line per storage group.
        seen = written.groupBy("grp").agg(F.max("nrow").alias("nrow"), F.max("groups").alias("groups")).collect()
        if not seen:
            return None
        known, filled = sorted(s.grp for s in seen), sorted(s.grp for s in seen if s.nrow)
        return {"run": run, "lines": name, "groups": seen[0].groups, "known": known, "filled": filled}

    def compute_missing(
        self,
        feature: Feature,
        cases: DataFrame,
        compute: Callable[[DataFrame], DataFrame] | None = None,
        stage: Feature | None = None,
    ) -> DataFrame:
        """Read-through: compute and store the cases not yet known, then read
        all of them. ``stage`` is the feature cut off after its tokens: its
        rows are read (and stored where missing) instead of observed again."""
        feature = self.settled(feature)
        if compute is None:

            def compute(missing):
                stored = None if stage is None else self.compute_missing(stage, missing)
                return build_feature(missing, feature, stored)

        missing, checked = self._missing(feature, cases)
        if not missing.isEmpty():
            self.commit(feature, self.prepare(feature, missing, compute(missing), checked))
        version = self.version(feature)
        if any(r["filled"] for r in self._visible(feature, version)):
            return self.read(feature, cases, version=version)
        return self._none(feature, cases, compute(cases.limit(0)).schema)

    def through(self, feature: Feature, cases: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Rows of a feature, each case from the deepest stage that is stored
        for it, the feature's own rows stored where they were missing.

        ``keep`` names stages to store on the way (``observation``,
        ``records``, ``tokens``). Stages that some earlier run stored are
        read for the cases it knew; only the others are computed from the
        stage before. Features that begin alike share their stages, since a
        stage's key is a hash of its settings and of the key before it.
        """
        feature = self.settled(feature)
        chain = [*feature.prefixes, feature]
        names = [*STAGES[: len(chain) - 1], "feature"]
        unknown = set(keep) - set(STAGES)
        if unknown:
            raise ValueError(f"stages are {STAGES}, got {sorted(unknown)}")
        kept = [n in keep or n == "feature" for n in names]
        usable = [k or self.version(f) > 0 for k, f in zip(kept, chain, strict=True)]

        def rows(place: int, some: DataFrame) -> DataFrame:
            stage = chain[place]
            if kept[place]:
                missing, checked = self._missing(stage, some)
                if not missing.isEmpty():
                    self.commit(stage, self.prepare(stage, missing, build(place, missing), checked))
                return self.read(stage, some)
            # One commit settles what is read and what is computed.
            version = self.version(stage)
            known = self.manifest(stage, some, version).select(*PAIR)
            missing = materialize(some.join(known, PAIR, "left_anti"))
            found = self.read(stage, some, version=version)
            return found if missing.isEmpty() else found.unionByName(build(place, missing))

        def build(place: int, some: DataFrame) -> DataFrame:
            stage = chain[place]
            before = [k for k in range(place) if usable[k]]
            if not before:
                return build_feature(some, stage)
            found = rows(before[-1], some)
            if names[before[-1]] == "tokens":
                return build_feature(some, stage, stored=found)
            if names[before[-1]] == "observation":
                found = settled_rows(found, stage)
            return build_feature(some, stage, settled=found)

        return rows(len(chain) - 1, cases.select(*CASE_KEY))

    def compact(self, feature: Feature, cases: DataFrame, grace_hours: float = GRACE_HOURS) -> str | None:
        """Rewrite what readers see as one run, while others may write: runs
        they commit meanwhile stay beside it. Then ``vacuum``. Returns the new
        run; nothing if there is none, or if another compaction was first."""
        log = self._log(feature)
        number, runs = log.latest()
        if not runs:
            return None
        taken, lines = _line_names(runs), materialize(self._lines(feature, runs))
        stored = self._rows(feature, runs)
        if stored is None:
            rows = self._none(feature, cases)
        else:
            listed = lines.where(F.col("nrow") > 0).select(*PAIR, "run")
            rows = stored.join(listed, [*PAIR, "run"], "left_semi").drop("grp", "run")
        pending = self.prepare(feature, lines, rows, run=f"c{uuid.uuid4().hex}")
        entry = self._written_lines(feature, pending.run, pending.run, pending.lines)
        while True:
            number, runs = log.latest()
            if not taken <= _line_names(runs):
                return None
            if log.put(number + 1, [entry, *[r for r in runs if r["lines"] not in taken]]):
                break
        self.vacuum(feature, grace_hours)
        return pending.run

    def vacuum(self, feature: Feature, grace_hours: float = GRACE_HOURS) -> None:
        """Delete commits that were no longer the latest ``grace_hours`` ago,
        and runs, lost ones included, that are as old and in no commit left.
        No read or write may last longer."""
        log, before = self._log(feature), time.time() * 1000 - grace_hours * 3_600_000
        times = log.times()
        if not times:
            return
        first = max((n for n, at in times.items() if at <= before), default=min(times))
        kept = [entry for n in times if n >= first for entry in log.entries(n)]
        for kind, name in (("rows", "run"), ("manifest", "lines")):
            named = {entry[name] for entry in kept}
            for old, at in self._folders(kind, feature).items():
                if old not in named and at <= before:
                    discard(self.spark, f"{self._folder(kind, feature)}/{name}={old}")
        for number in times:
            if number < first:
                log.forget(number)

    def _folders(self, kind: str, feature: Feature) -> dict[str, int]:
        """Written runs, whether visible or not, with their times."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind, feature))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return {}
        listed = [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(path)]
        return {n.split("=", 1)[1]: at for n, at in listed if "=" in n}


def _line_names(runs: Iterable[dict]) -> set[str]:
    return {r["lines"] for r in runs}


def _group(pid, groups):
    return F.pmod(F.xxhash64(pid), groups).cast("bigint")


def lists_to_json(rows: DataFrame) -> DataFrame:
    """List columns as JSON text and timestamps as text, for interchange."""
    return rows.select(*[_to_text(f).alias(f.name) for f in rows.schema.fields])


def _to_text(field: T.StructField):
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        return F.to_json(col)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return col


def lists_from_json(rows: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The inverse of ``lists_to_json`` for rows of the given schema; the
    columns in ``keep`` stay as they are."""
    columns = []
    for field in schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            col = F.from_json(col, field.dataType)
        columns.append(col.cast(field.dataType).alias(field.name))
    return rows.select(*columns, *keep)
