"""Vocabularies: token -> id, grain group, group id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CALENDAR_GRAIN, CALENDAR_PREFIXES, DAYPART_HOURS, UNK
from ..session import materialize
from .ranking import with_rank

SCHEMA = "idx int, grn string, rfg string, rfg_idx int"
COLUMNS = ("idx", "grn", "rfg", "rfg_idx")

# Larger vocabularies are looked up with a salted shuffle join.
MAX_BROADCAST_TOKENS = 500_000
SALTS = 32


@dataclass(frozen=True)
class Vocabulary:
    """Rows ``(idx, grn, rfg, rfg_idx)`` with their number, the ids of the
    special tokens (unknown and step counts) and a hash of all rows, known on
    the driver."""

    df: DataFrame
    size: int
    special: dict[str, tuple[int, int]]
    unk: str = UNK
    fingerprint: str = ""

    @classmethod
    def of(cls, rows: DataFrame, rules: Sequence[str] = (), unk: str = UNK) -> Vocabulary:
        """Materialize the rows once; measure them and find the special ids."""
        return cls._measured(materialize(rows), rules, unk)

    @classmethod
    def _measured(cls, rows: DataFrame, rules: Sequence[str], unk: str) -> Vocabulary:
        named = F.when(F.col("grn").isin(unk, *rules), F.struct("grn", "idx", "rfg_idx"))
        hashed = F.sum(F.xxhash64(*COLUMNS).cast("decimal(38,0)"))
        seen = rows.agg(F.count("*").alias("n"), F.collect_list(named).alias("special"), hashed.alias("h")).first()
        special = {r.grn: (r.idx, r.rfg_idx) for r in seen.special}
        return cls(rows, seen.n, special, unk, f"{seen.n}-{seen.h}")

    def lookup(self, rows: DataFrame, key: str, how: str = "left", by: str = "grn") -> DataFrame:
        """Join ``rows.key`` with the vocabulary. Small vocabularies are
        broadcast; for larger ones a hot token is spread over salts."""
        side = self.df.withColumnRenamed(by, key)
        if self.size <= MAX_BROADCAST_TOKENS:
            return rows.join(F.broadcast(side), key, how)
        others = [F.col(f"`{c}`") for c in rows.columns if c != key]
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        return salted.join(side.withColumn("__salt", every), [key, "__salt"], how).drop("__salt")

    def extended(self, rules: Sequence[str]) -> Vocabulary:
        """With the count tokens of ``rules``; a short step on the stored rows."""
        return self._measured(extend_vocab(self.df, self.size, rules), rules, self.unk)

    def write(self, path: str, form: str = "parquet") -> None:
        self.df.write.mode("errorifexists").format(form).save(path)

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        path: str,
        rules: Sequence[str] = (),
        unk: str = UNK,
        form: str = "parquet",
    ) -> Vocabulary:
        rows = spark.read.format(form).schema(SCHEMA).load(path)
        return cls._measured(rows, rules, unk)


def vocab_rows(
    tables: Sequence[DataFrame], rules: Sequence[str] = (), unk: str = UNK
) -> DataFrame:
    """Combine grain vocabularies ``(grn, rfg, pos)``: id 0 is unknown, then
    each grain's tokens in order, then the count tokens of ``rules``. A token
    met twice keeps its first place and group; one named like a rule belongs
    to the rule's group. Only distinct tokens are ranked."""
    spark = tables[0].sparkSession
    union = _listed(spark, [unk], -1)
    for src, table in enumerate(tables):
        union = union.unionByName(
            table.select(F.lit(src).alias("src"), F.col("pos").cast("bigint"), "grn", "rfg")
        )
    if rules:
        union = union.unionByName(_listed(spark, rules, len(tables)))
    first = union.groupBy("grn").agg(F.min(F.struct("src", "pos", "rfg")).alias("f"))
    group = F.col("f.rfg")
    if rules:
        group = F.when(F.col("grn").isin(*rules), F.col("grn")).otherwise(group)
    placed = first.select("f.src", "f.pos", "grn", group.alias("rfg"))
    ranked = with_rank(placed, ["src", "pos", "grn"], "idx")
    return _with_rfg_idx(ranked.select(F.col("idx").cast("int").alias("idx"), "grn", "rfg")).select(*COLUMNS)


def _listed(spark: SparkSession, names: Sequence[str], src: int) -> DataFrame:
    """Tokens of their own group, in the given order."""
    listed = F.posexplode(F.array(*[F.lit(n) for n in names])).alias("pos", "grn")
    rows = spark.range(1).select(listed)
    return rows.select(
        F.lit(src).alias("src"), F.col("pos").cast("bigint"), "grn", F.col("grn").alias("rfg")
    )


def _with_rfg_idx(rows: DataFrame) -> DataFrame:
    """Group ids: rank of the group name among the distinct names. Only the
    few names are ranked, not the tokens."""
    names = rows.select("rfg").distinct()
    ranked = names.withColumn("rfg_idx", F.row_number().over(Window.orderBy("rfg")) - 1)
    return rows.join(F.broadcast(ranked), "rfg")


def build_vocab(
    tables: Sequence[DataFrame], rules: Sequence[str] = (), unk: str = UNK
) -> Vocabulary:
    return Vocabulary.of(vocab_rows(tables, rules, unk), rules, unk)


def extend_vocab(rows: DataFrame, size: int, rules: Sequence[str]) -> DataFrame:
    """Append the count token of each step under a group of its own name.
    A token that already exists keeps its id and changes group."""
    rules = list(dict.fromkeys(rules))
    spark = rows.sparkSession
    names = _listed(spark, rules, 0)
    missing = names.join(rows.select("grn"), "grn", "left_anti")
    order = Window.orderBy("pos")
    added = missing.select(
        (F.row_number().over(order) - 1 + F.lit(size)).alias("idx"), "grn", F.col("grn").alias("rfg")
    )
    kept = rows.select(
        "idx", "grn", F.when(F.col("grn").isin(rules), F.col("grn")).otherwise(F.col("rfg")).alias("rfg")
    )
    return _with_rfg_idx(kept.unionByName(added)).select(*COLUMNS)


def vocab_conflicts(tables: Sequence[DataFrame]) -> DataFrame:
    """Tokens that more than one grain group claims."""
    union = tables[0].select("grn", "rfg")
    for table in tables[1:]:
        union = union.unionByName(table.select("grn", "rfg"))
    groups = union.groupBy("grn").agg(F.sort_array(F.collect_set("rfg")).alias("rfgs"))
    return groups.where(F.size("rfgs") > 1)


def learn_vocab(rows: DataFrame, key: Column, rfg: str) -> DataFrame:
    """Grain vocabulary of the tokens seen in ``key`` (array of strings),
    in token order."""
    seen = rows.select(F.explode(key).alias("grn")).distinct()
    return with_rank(seen, ["grn"], "pos").select("grn", F.lit(rfg).alias("rfg"), "pos")


def calendar_years(rows: DataFrame, dt: str = "dt") -> tuple[int, int]:
    """First and last year among the rows' times: the years a calendar
    vocabulary must hold so that no token is lost."""
    first, last = rows.agg(F.min(F.year(dt)), F.max(F.year(dt))).first()
    if first is None:
        raise ValueError("no times to take calendar years from")
    return first, last


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v.cast("string")))


def calendar_vocab(
    spark: SparkSession, first_year: int, last_year: int, rfg: str = CALENDAR_GRAIN
) -> DataFrame:
    """All calendar tokens of a range of years, generated from their ranges."""
    dayparts = F.array(*[F.lit(n) for n in sorted(DAYPART_HOURS, key=DAYPART_HOURS.get)])
    ranges = [(first_year, last_year), (1, 12), (1, 31), None, (0, 23), (0, 59)]
    lists = []
    for prefix, span in zip(CALENDAR_PREFIXES, ranges):
        values = dayparts if span is None else F.sequence(F.lit(span[0]), F.lit(span[1]))
        lists.append(_prefixed(prefix, values))
    tokens = spark.range(1).select(F.posexplode(F.concat(*lists)).alias("pos", "grn"))
    return tokens.select("grn", F.lit(rfg).alias("rfg"), F.col("pos").cast("bigint").alias("pos"))
