"""Table scans by file suffix, column canonicalisation and feature/target projection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from cohortspark.roles import Cohort, Roles
from cohortspark.session import materialize
from cohortspark.sources.paths import arrow_store, require_path, suffix_of

# Cell texts read as missing.
NA_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
#: Bytes of a Feather file that a task reads at least, and tasks of one scan.
RANGE_BYTES = 64 * 2**20
MOST_RANGE_TASKS = 10_000
SUFFIXES = (".csv", ".tsv", ".parquet", ".feather")


def _unique_names(header: Sequence[str | None]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` ...; blank ones are named by position."""
    names: list[str] = []
    taken: set[str] = set()
    for i, raw in enumerate(header):
        base = raw if raw not in (None, "") else f"Unnamed: {i}"
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name)
        names.append(name)
    return names


def _reader(spark: SparkSession, sep: str, multiline: bool):
    return (
        spark.read.option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("multiLine", multiline)
        .option("emptyValue", "")
        .option("mode", "FAILFAST")
    )


# The grammar is matched first: a failing cast to a number costs an exception per cell.
INTEGRAL = r"^\s*[+-]?[0-9]+\s*$"
FLOATING = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?([iI]nf|[iI]nfinity|INF|INFINITY)\s*$"


def _integral(text: Column) -> Column:
    return text.rlike(INTEGRAL) & text.try_cast("bigint").isNotNull()


def _floating(text: Column) -> Column:
    return text.rlike(FLOATING)


def _boolean(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def infer_types(text: DataFrame) -> T.StructType:
    """The narrowest of bigint, double, boolean and string that fits each column: one aggregate."""
    aggs = []
    for i, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        kind = (
            F.when(c.isNull(), F.lit(None).cast("int"))
            .when(_integral(c), 0)
            .when(_floating(c), 1)
            .when(_boolean(c), 2)
            .otherwise(3)
        )
        aggs += [F.min(kind).alias(f"lo{i}"), F.max(kind).alias(f"hi{i}")]
    row = text.agg(*aggs).first()
    fields = []
    for i, name in enumerate(text.columns):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if high is None or (low, high) in ((0, 1), (1, 1)):
            dtype: T.DataType = T.DoubleType()
        elif high == 0:
            dtype = T.LongType()
        elif low == 2 and high == 2:
            dtype = T.BooleanType()
        else:
            dtype = T.StringType()
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def _fitting(field: T.StructField) -> Column:
    text = F.col(f"`{field.name}`")
    value = text.try_cast(field.dataType)
    told = F.concat(F.lit(f"column {field.name} is no {field.dataType.simpleString()}: "), text)
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(told)).alias(field.name)


def load_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    multiline: bool = False,
) -> DataFrame:
    """Delimited text with a header; missing-value texts become NULL.

    Pass ``schema`` to skip the inference pass; a cell that does not fit it is an
    error, and so is a file whose header differs from the first one's.  ``multiline``
    admits line breaks inside quotes, at the price of one task per file.
    """
    require_path(spark, path)
    head = _reader(spark, sep, multiline).option("header", False).csv(path).first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = _unique_names(list(head))
    places = [f"c{i}" for i in range(len(names))]
    read = _reader(spark, sep, multiline)
    if names == list(head):
        # The reader compares this schema with the header of every file it opens.
        plain = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = read.option("header", True).option("enforceSchema", False).schema(plain).csv(path).toDF(*places)
    else:
        plain = T.StructType([T.StructField(c, T.StringType()) for c in places])
        lines = read.option("header", False).schema(plain).csv(path).select("*", "_metadata.file_path")
        same = F.lit(True)
        for c, text in zip(places, head, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(text))
        other = lines.groupBy("file_path").agg(F.max(same).alias("same")).where("not same").first()
        if other is not None:
            raise ValueError(f"the header of {other['file_path']} differs from {list(head)}")
        raw = read.option("header", True).schema(plain).csv(path)
    text = raw.select(
        *[F.when(~F.col(f"c{i}").isin(*NA_TEXTS), F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]
    )
    if schema is None:
        schema = infer_types(text)
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return text.select(*[_fitting(f) for f in schema])


def _opened(path: str) -> pa.ipc.RecordBatchFileReader:
    store, name = arrow_store(path)
    return pa.ipc.open_file(store.open_input_file(name))


def _feather_ranges(batches: Iterator[pa.RecordBatch], range_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of every file, from its footer: runs of record batches of about ``range_bytes`` each."""
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            n = _opened(path).num_record_batches
            step = max(1, n * range_bytes // max(length, 1))
            starts = list(range(0, n, step))
            columns = {"path": [path] * len(starts), "start": starts, "stop": [min(s + step, n) for s in starts]}
            yield pa.RecordBatch.from_pydict(
                columns, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
            )


def _feather_batches(ranges: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ranges:
        for row in batch.to_pylist():
            reader = _opened(row["path"])
            for i in range(row["start"], row["stop"]):
                yield from pa.Table.from_batches([reader.get_batch(i)]).to_batches(max_chunksize=10_000)


def _feather_schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            yield pa.RecordBatch.from_pydict({"schema": [_opened(path).schema.serialize().to_pybytes()]})


def load_feather(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Feather files (version 2) of any size: a task reads a run of record batches of one file.

    Files are opened where they lie by Arrow's file systems, never whole; footers tell where their batches are. The
    schema is that of one file unless given.
    """
    require_path(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", "length")
    if schema is None:
        head = files.select("path").mapInArrow(_feather_schemas, "schema binary").first()
        if head is None:
            raise FileNotFoundError(path)
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(head["schema"]))))
    # Listing and footers are read once; a table as small as this has to be told to spread.
    footers = partial(_feather_ranges, range_bytes=range_bytes)
    ranges = materialize(files.mapInArrow(footers, "path string, start long, stop long"), "feather")
    tasks = max(1, min(MOST_RANGE_TASKS, ranges.count()))
    spread = ranges.repartitionByRange(tasks, "path", "start")
    return spread.mapInArrow(_feather_batches, schema)


def load_table(spark: SparkSession, path: str, *, sep: str | None = None, schema=None) -> DataFrame:
    """Scan by suffix; ``sep`` is honoured for ``.tsv`` only."""
    require_path(spark, path)
    kind = suffix_of(path)
    if kind not in SUFFIXES:
        raise ValueError(f"table format {kind!r} is not one of {SUFFIXES}")
    if kind == ".csv":
        return load_csv(spark, path, schema=schema)
    if kind == ".tsv":
        return load_csv(spark, path, schema=schema, sep=sep or "\t")
    if kind == ".parquet":
        return spark.read.parquet(path)
    return load_feather(spark, path, schema)


def feature_matrix(df: DataFrame, target: str, id_columns: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features without the target and id columns, and the target with the ids."""
    ids = list(id_columns)
    absent = [c for c in (target, *ids) if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    return df.drop(target, *ids), df.select(*ids, target)


def load_feature_matrix(
    spark: SparkSession, path: str, target: str, id_columns: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    return feature_matrix(load_table(spark, path), target, id_columns)


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Strip names, turn spaces into underscores, keep the first of equal names."""
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name.strip().replace(" ", "_"), i)
    return positional.select(*[F.col(f"c{i}").alias(name) for name, i in first.items()])


def load_cohort(spark: SparkSession, path: str, roles: Roles, **options) -> Cohort:
    """A table file as a cohort whose roles were checked: rows, target and group columns must be there."""
    table = load_table(spark, path, **options)
    if roles.id not in table.columns:
        raise KeyError(f"id column {roles.id!r} is not in the table")
    return Cohort(roles.annotate(table), roles)
