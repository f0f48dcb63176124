"""Datasets, system schemas, the declared type lattice and the library's errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT, CHANGELOG = "event", "changelog"

RANGE = T.StructType([T.StructField("origin", T.StringType()), T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType())])
MANIFEST = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("partition", T.StringType()),
        T.StructField("window_id", T.LongType()),
        T.StructField("origin_coverage", T.ArrayType(RANGE)),
        T.StructField("rows", T.LongType()),
        T.StructField("event_time_min_ms", T.LongType()),
        T.StructField("event_time_max_ms", T.LongType()),
        T.StructField("dedup_removed", T.LongType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("part_kind", T.StringType()),
        T.StructField("discriminator", T.LongType()),
        T.StructField("expired", T.BooleanType()),
    ]
)
WATERMARK = T.StructType([T.StructField("partition", T.StringType()), T.StructField("complete_through_ms", T.LongType())])
APPLIED = T.StructType([T.StructField("partition", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("applied_seq", T.LongType())])
LOSS = T.StructType([T.StructField("partition", T.StringType()), *RANGE.fields, T.StructField("declared_at_ms", T.LongType())])

#: Names of the columns that the library itself adds to every row.
SYSTEM_COLUMNS = ("origin", "seq")
#: Types that a declared dataset may have; nested, decimal and interval types may not.
FLAT_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.TimestampNTZType, T.TimestampType)
#: Lossless promotions in place; a bigint does not become a double.
WIDENING = [T.ByteType, T.ShortType, T.IntegerType, T.LongType], [T.FloatType, T.DoubleType]


class TidewrightError(Exception):
    """Base of all errors. ``code`` is the transport status that a server would answer with, ``retryable`` whether a client may retry."""

    code, retryable = "INTERNAL", False


class InvalidInput(TidewrightError):
    code = "INVALID_ARGUMENT"


class ReservedColumn(InvalidInput):
    pass


class UnsupportedType(InvalidInput):
    pass


class SchemaConflict(InvalidInput):
    pass


class PayloadTooLarge(InvalidInput):
    code = "RESOURCE_EXHAUSTED"


class Overloaded(TidewrightError):
    code, retryable = "RESOURCE_EXHAUSTED", True


class ByteBudgetExceeded(TidewrightError):
    code = "RESOURCE_EXHAUSTED"


class DeadlineExceeded(TidewrightError):
    code = "DEADLINE_EXCEEDED"


class NotASelect(TidewrightError):
    code = "INVALID_ARGUMENT"


class UncoveredRange(TidewrightError):
    """A complete answer can't be proven."""

    code = "FAILED_PRECONDITION"

    def __init__(self, dataset: str, partition: str, wanted_ms: int, complete_through_ms: int | None):
        super().__init__(f"{dataset}, partition {partition}: wanted through {wanted_ms}, complete through {complete_through_ms}")
        self.dataset, self.partition, self.wanted_ms, self.complete_through_ms = dataset, partition, wanted_ms, complete_through_ms


class LedgerError(TidewrightError):
    code = "FAILED_PRECONDITION"


class UnknownPart(TidewrightError):
    code = "NOT_FOUND"


@dataclass(frozen=True)
class DatasetDecl:
    """A dataset: its kind, the key of its changelog rows, the order of its sealed files, the column of event time."""

    name: str
    kind: str = EVENT
    key_cols: tuple[str, ...] = ()
    sort_key: tuple[str, ...] = ()
    time_col: str = "ts"
    natural_key: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.kind not in (EVENT, CHANGELOG):
            raise InvalidInput(f"{self.name}: kind {self.kind!r}")
        if self.kind == CHANGELOG and not self.key_cols:
            raise InvalidInput(f"{self.name}: a changelog needs key columns")

    def seal_order(self, snapshot: bool = False) -> list[str]:
        """Sort columns of a sealed file: as declared, else by time (events) or key and order (changelogs, without order in snapshots)."""
        if self.sort_key:
            return list(self.sort_key)
        return [self.time_col] if self.kind == EVENT else [*self.key_cols, *([] if snapshot else SYSTEM_COLUMNS)]


def check_payload(schema: T.StructType) -> None:
    """Refuse payload columns with reserved names (in any case) or types outside the flat list."""
    for f in schema.fields:
        if f.name.lower() in SYSTEM_COLUMNS:
            raise ReservedColumn(f.name)
        if not isinstance(f.dataType, FLAT_TYPES):
            raise UnsupportedType(f"{f.name}: {f.dataType.simpleString()}")


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both losslessly, else SchemaConflict."""
    if a == b:
        return a
    for chain in WIDENING:
        if type(a) in chain and type(b) in chain:
            return max((a, b), key=lambda t: chain.index(type(t)))
    raise SchemaConflict(f"{a.simpleString()} and {b.simpleString()} need a new generation")


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Union of the columns, widened where both have one; the order of evolutions doesn't change the set of columns. Never drops."""
    fields = {f.name: f for f in old.fields}
    for f in new.fields:
        have = fields.get(f.name)
        fields[f.name] = T.StructField(f.name, f.dataType if have is None else widened(have.dataType, f.dataType), True)
    return T.StructType(list(fields.values()))
