"""Feature configuration: frozen values, checked before any plan is built."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import FILTER_SHARE, LEVELS, RECORD_THRESHOLDS, UNIT_MICROS, UNK

_PERIOD_NAME = re.compile(r"(Bf|Af)((?:\d+(?:min|[MWDH]))+)")
_PERIOD_PART = re.compile(r"(\d+)(min|[MWDH])")
# A month is four weeks, as in the relative-time columns.
_PART_MICROS = {**UNIT_MICROS, "W": 7 * UNIT_MICROS["D"], "M": 28 * UNIT_MICROS["D"]}


@dataclass(frozen=True)
class CheckPeriod:
    """Half-open window ``[pred_dt + start, pred_dt + end)``; distances are
    signed, may be fractional, and are given in ``unit``."""

    name: str
    start: float
    end: float
    unit: str = "H"
    start_exclusive: bool = False

    def __post_init__(self):
        if self.unit not in UNIT_MICROS:
            raise ValueError(f"unit must be one of {sorted(UNIT_MICROS)}, got {self.unit!r}")
        if self.end_us <= self.start_us:
            raise ValueError(f"period {self.name!r} is empty: end must come after start")

    @classmethod
    def parse(cls, name: str, start_exclusive: bool = False) -> CheckPeriod:
        """``Bf24H`` -> the 24 hours before; ``Af2M10D`` -> 2*28+10 days after."""
        match = _PERIOD_NAME.fullmatch(name)
        if not match:
            raise ValueError(f"not a period name: {name!r}")
        length = sum(int(n) * _PART_MICROS[u] for n, u in _PERIOD_PART.findall(match[2]))
        minutes = length / UNIT_MICROS["min"]
        start, end = (-minutes, 0) if match[1] == "Bf" else (0, minutes)
        return cls(name, start, end, "min", start_exclusive)

    @property
    def start_us(self) -> int:
        return round(self.start * UNIT_MICROS[self.unit])

    @property
    def end_us(self) -> int:
        return round(self.end * UNIT_MICROS[self.unit])

    @property
    def length_us(self) -> int:
        return self.end_us - self.start_us


@dataclass(frozen=True)
class RecordSource:
    """A record table and the columns that play pid, record id and time.

    ``dt=None`` takes the first column whose name contains ``DT``;
    ``columns`` is ``"ALL"`` or a list, where unknown names are ignored. Ids
    become text unless ``text_ids`` is off (all tables must then agree).
    """

    name: str
    df: DataFrame
    pid: str = "pid"
    rec_id: str = "rec_id"
    dt: str | None = None
    columns: str | Sequence[str] = "ALL"
    text_ids: bool = True


@dataclass(frozen=True)
class Filter:
    """Row predicate by name plus completeness thresholds ``{"DTInD": 3}``.

    ``thresholds=None`` takes the defaults of the record type, ``share=None``
    the share of the filter name. ``predicates`` adds named predicates for
    this feature only: a condition over the record's columns (``dt`` and
    those the source lists), or a function of the time column.
    """

    name: str = "Whl"
    share: float | None = None
    thresholds: Mapping[str, float] | None = None
    legacy_dayparts: bool = False
    predicates: Mapping[str, Column | Callable[[Column], Column]] = field(default_factory=dict)

    def rules_for(self, record_name: str) -> dict[str, float]:
        """Active rules in order with the share applied; zeros are left out."""
        rules = self.thresholds
        if rules is None:
            rules = RECORD_THRESHOLDS.get(record_name, {})
        share = self.share if self.share is not None else FILTER_SHARE.get(self.name, 1.0)
        active = {rule: need * share for rule, need in rules.items() if need * share != 0}
        for rule in active:
            for part in split_rule(rule):
                if part not in (*LEVELS, "DT", "R"):
                    raise ValueError(f"threshold {rule!r}: unknown column {part!r}")
        return active


@dataclass(frozen=True)
class GrainTable:
    """Token lists stored per record: ``pid, rec_id, {name}_key, {name}_wgt``."""

    name: str
    df: DataFrame


@dataclass(frozen=True)
class GrainColumn:
    """Tokens computed from the record itself. ``key`` builds either a list
    of text columns, one token each (null: no token), or one
    ``array<string>`` column; ``wgt`` the weights in the same form (default:
    all 1). Single columns are looked up fastest."""

    name: str
    key: Callable[[], Column | Sequence[Column]]
    wgt: Callable[[], Column | Sequence[Column]] | None = None

    @property
    def single(self) -> list[tuple[Column, Column]] | None:
        """(token, weight) columns, or ``None`` for the array form."""
        keys = self.key()
        if isinstance(keys, Column):
            return None
        weights = self.wgt() if self.wgt else [F.lit(1.0)] * len(keys)
        return [(k, w.cast("double")) for k, w in zip(keys, weights, strict=True)]


@dataclass(frozen=True)
class Tokens:
    """Which grains a record's token list is made of, in order; the calendar
    grain, when named, comes last. ``vocab`` is needed to
    compress: a ``Vocabulary``, or the grains' vocabulary tables in order."""

    name: str
    grains: Sequence[GrainTable | GrainColumn] = ()
    calendar: str | None = None
    vocab: object = None
    unk: str = UNK
    on_unknown: str = "fail"

    def __post_init__(self):
        if self.on_unknown not in ("drop", "unk", "fail"):
            raise ValueError(f"on_unknown must be drop, unk or fail, got {self.on_unknown!r}")
        if not self.grains and self.calendar is None:
            raise ValueError("at least one grain or the calendar is needed")


def split_rule(rule: str) -> tuple[str, str]:
    """``5MinInD`` -> (``5Min``, ``D``)."""
    parts = rule.split("In")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"not a rule of the form AInB: {rule!r}")
    return parts[0], parts[1]


@dataclass(frozen=True)
class Step:
    """One compress step: a rule ``AInB`` and its actions, run in order.

    Actions: ``("flatten",)``, ``("method", name)``, ``("convert",)``,
    ``("add_sfx", [names])``.
    """

    rule: str
    actions: Sequence[tuple]

    @property
    def target(self) -> str:
        return split_rule(self.rule)[1]

    @property
    def method(self) -> str | None:
        return next((a[1] for a in self.actions if a[0] == "method"), None)


def rolled(rule: str, method: str, sfx: Sequence[str] = ()) -> Step:
    """The usual step: flatten, roll up with ``method``, list again."""
    actions = [("flatten",), ("method", method), ("convert",)]
    if sfx:
        actions.append(("add_sfx", tuple(sfx)))
    return Step(rule, tuple(actions))


@dataclass(frozen=True)
class Compress:
    """The compress program and the layers of its output.

    Rows are keyed by ``prefix_layers + focal_layers``; with prefix layers
    the rows are nested into lists, outermost layer first. ``methods`` adds
    compress methods for this feature only.
    """

    steps: Sequence[Step]
    prefix_layers: Sequence[str] = ()
    focal_layers: Sequence[str] = ("CP",)
    methods: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if "CP" not in (*self.prefix_layers, *self.focal_layers):
            raise ValueError("CP must be among the layers")
        self._check_program()

    @property
    def rules(self) -> list[str]:
        return [s.rule for s in self.steps]

    def _check_program(self):
        prefix, flat, lists, counts = list(LEVELS), False, {"key", "wgt"}, set()
        for step in self.steps:
            for action, *args in step.actions:
                if action == "flatten":
                    if flat:
                        raise ValueError(f"{step.rule}: tokens are already flat")
                    flat, lists = True, {"key", "wgt"}
                elif action == "method":
                    source, target = split_rule(step.rule)
                    if source not in LEVELS and source not in ("DT", "R"):
                        raise ValueError(f"{step.rule}: unknown source {source!r}")
                    if target not in prefix:
                        raise ValueError(f"{step.rule}: {target!r} is no longer a column")
                    if not flat and args[0] != "cat":
                        raise ValueError(f"{step.rule}: {args[0]!r} needs flatten before it")
                    prefix = prefix[: prefix.index(target) + 1]
                    counts = set() if flat else {step.rule}
                elif action == "convert":
                    if not flat:
                        raise ValueError(f"{step.rule}: convert needs a flat state")
                    flat = False
                elif action == "add_sfx":
                    if flat:
                        raise ValueError(f"{step.rule}: add_sfx needs list tokens")
                    for sfx in args[0]:
                        self._check_suffix(step.rule, sfx, prefix, lists)
                        lists.add(sfx)
                else:
                    raise ValueError(f"{step.rule}: unknown action {action!r}")
        if flat:
            raise ValueError("the last step must convert back to lists")
        for layer in (*self.prefix_layers, *self.focal_layers):
            if layer not in prefix and layer not in counts:
                raise ValueError(f"layer {layer!r} does not survive the steps")

    @staticmethod
    def _check_suffix(rule, sfx, prefix, lists):
        if sfx == "rfg":
            return
        if sfx == "keyInrfg":
            if "rfg" not in lists:
                raise ValueError(f"{rule}: keyInrfg must come after rfg")
            return
        if sfx.replace("InCP", "") in prefix:
            return
        source, target = split_rule(sfx)
        if source not in prefix or target not in prefix:
            raise ValueError(f"{rule}: suffix {sfx!r} needs {source!r} and {target!r}")


@dataclass(frozen=True)
class Feature:
    """One feature: the chain stops at the first stage that is ``None``.
    ``version`` tells apart stored results when code or tables behind the
    same names have changed. A feature that ends with its filter shows ids and
    times only; ``wide`` keeps the records' columns and the time levels, so
    that later stages can start from its rows."""

    period: CheckPeriod
    source: RecordSource | None = None
    filter: Filter | None = None
    tokens: Tokens | None = None
    compress: Compress | None = None
    alias: str | None = None
    version: str = ""
    wide: bool = False

    def __post_init__(self):
        if self.wide and (self.filter is None or self.tokens is not None):
            raise ValueError("wide rows are those of a feature that ends with its filter")
        stages = [self.source, self.filter, self.tokens, self.compress]
        if self.compress is not None and self.tokens is not None and self.tokens.vocab is None:
            raise ValueError("compressing needs a vocabulary")
        seen_none = False
        for stage in stages:
            if stage is None:
                seen_none = True
            elif seen_none:
                raise ValueError("a stage is set after a missing one")

    @property
    def name(self) -> str:
        """``period.record.filter.tokens``; a compressed feature names its
        layers and its steps, last step first."""
        parts = [self.period.name]
        if self.source is not None:
            parts.append(self.source.name)
        if self.filter is not None:
            parts.append(self.filter.name)
        if self.tokens is not None:
            base = f"Rof{self.source.name}-{self.tokens.name}"
            if self.compress is not None:
                steps = [f"{s.target}:{s.method or 'none'}" for s in reversed(self.compress.steps)]
                base = "-".join([*self.compress.prefix_layers, *steps, base])
            parts.append(base)
        return ".".join(parts)

    @property
    def column(self) -> str:
        return self.alias or self.name

    @property
    def prefixes(self) -> list[Feature]:
        """The feature cut off after each stage whose rows a later stage can
        start from: observation, filtered records, tokens."""
        cut = []
        if self.filter is not None:
            cut.append(replace(self, filter=None, tokens=None, compress=None, alias=None, wide=False))
        if self.tokens is not None:
            cut.append(replace(self, tokens=None, compress=None, alias=None, wide=True))
        if self.compress is not None:
            cut.append(replace(self, compress=None, alias=None))
        return cut

    @property
    def config_hash(self) -> str:
        """Tells apart features that share a name but not their settings or
        their records: the key of its last stage."""
        return self.stage_keys[-1]

    @cached_property
    def stage_keys(self) -> list[str]:
        """One key per stage that is set: a hash of the stage's settings and
        of the key before it, so features that begin alike share the keys of
        their common stages. Columns enter by their expressions, a built
        vocabulary by a hash of its rows, tables by what is read and how (see
        :func:`described_table`). Code behind the same expressions (a Python
        function outside Spark) is told apart by ``version``."""
        source, flt, tokens, program = self.source, self.filter, self.tokens, self.compress
        stages = [[self.version, self.period.start_us, self.period.end_us, self.period.start_exclusive]]
        if source is not None:
            stages.append(
                [source.name, source.pid, source.rec_id, source.dt, _plain(source.columns), source.text_ids,
                 described_table(source.df, self.version)]
            )
        if flt is not None:
            predicates = [
                [k, _expression(p if isinstance(p, Column) else p(F.col("dt")))] for k, p in sorted(flt.predicates.items())
            ]
            stages.append([flt.name, flt.legacy_dayparts, flt.rules_for(source.name), predicates, self.wide])
        if tokens is not None:
            stages.append(
                [tokens.name, [_grain(g, self.version) for g in tokens.grains], tokens.calendar, tokens.unk, tokens.on_unknown,
                 getattr(tokens.vocab, "fingerprint", None) if program is not None else None]
            )
        if program is not None:
            stages.append(
                [[[s.rule, [_plain(a) for a in s.actions]] for s in program.steps], list(program.prefix_layers),
                 list(program.focal_layers), [[k, _method(m)] for k, m in sorted(program.methods.items())]]
            )
        keys, before = [], ""
        for stage in stages:
            before = hashlib.sha256(json.dumps([before, stage]).encode()).hexdigest()[:16]
            keys.append(before)
        return keys


def described_table(df: DataFrame, version: str = "") -> list:
    """What tells a table from another one: its columns, the folders or single
    files it is read from, and the plan over them with its names and numbers
    made plain. Files that are added to a folder later are the same table.

    Rows that come from memory or a checkpoint have no such name; they enter
    by a hash of all rows, which takes a pass over them, unless ``version``
    tells them apart."""
    plan = df._jdf.queryExecution().analyzed().toString()
    ids: dict[str, str] = {}
    plain = re.sub(r"#\d+", lambda m: ids.setdefault(m[0], f"#{len(ids)}"), plan)
    places = {re.sub(r"/(part-[^/]*|[^/]*=[^/]*)(/.*)?$", "", f) for f in df.inputFiles()}
    content = None
    if not version and re.search(r"\b(LocalRelation|LogicalRDD)\b", plan):
        row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
        content = [str(v) for v in df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()]
    return [df.schema.simpleString(), sorted(places), re.sub(r"\b[xyz]_#?\d+\b", "v", plain), content]


def _expression(column: Column) -> str:
    """A column as text; the names of lambda variables are numbered anew."""
    names: dict[str, str] = {}
    return re.sub(r"\b[xyz]_\d+\b", lambda m: names.setdefault(m[0], f"v{len(names)}"), str(column))


def _grain(grain: GrainTable | GrainColumn, version: str) -> list:
    if isinstance(grain, GrainTable):
        return [grain.name, described_table(grain.df, version)]
    parts = [grain.key(), grain.wgt() if grain.wgt else []]
    return [grain.name, *[[_expression(c) for c in ([p] if isinstance(p, Column) else p)] for p in parts]]


def _method(method) -> list:
    value, present, rows = F.col("value"), F.col("present"), F.col("rows")
    merge = method.merge and _expression(method.merge(value))
    return [_expression(method.agg(value)), _expression(method.finish(value, present, rows)), method.rounded, method.linear, merge]


def _plain(value):
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value
