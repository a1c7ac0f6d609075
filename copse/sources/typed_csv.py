"""Text tables with a row of types and a row of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators.examples import ExampleSet, Feature

#: What counts as a number, after .5 and 5. are made whole.
NUMBER = r"^[+-]?([0-9]+|[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?)$"


def _header(types: list[str], names: list[str]) -> list[tuple[str, str]]:
    types = [t.strip().lower() for t in types]
    if bad := [t for t in types if t not in ("numeric", "categoric", "class", "id")]:
        raise ValueError(f"invalid type declaration: {bad[0]!r}")
    if len(types) != len(names) or types.count("class") > 1 or types.count("id") > 1:
        raise ValueError("invalid feature declaration: a name for each type, one class and one id at most")
    return list(zip(types, [n.strip() for n in names], strict=True))


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank with _line, their number from 1.

    A text file keeps its order within a partition; numbers are offsets of partitions plus places in them.
    """
    numbered = lines.withColumn("_m", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    numbered = numbered.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dict(sorted(map(tuple, numbered.groupBy("_part").agg(F.max("_at") + 1).collect())))  # a row a partition
    before, offsets = 0, []
    for part, n in counts.items():
        offsets += [F.lit(part), F.lit(before)]
        before += n
    if not offsets:
        return numbered.select("value", F.lit(0).cast("bigint").alias("_line"))
    return numbered.select("value", (F.element_at(F.create_map(*offsets), F.col("_part")) + F.col("_at") + 1).alias("_line"))


def _examples(rows: DataFrame, fields: list[tuple[str, str]]) -> ExampleSet:
    """rows: id and _c, an array of cells."""
    columns, features, ident, klass = [], [], F.col("id"), F.lit("?")
    for i, (kind, name) in enumerate(fields):
        raw = F.col("_c")[i]
        value = F.when(raw != "?", raw)
        if kind == "class":
            klass = raw
        elif kind == "id":
            ident = raw.cast("bigint")
        elif kind == "categoric":
            columns.append(value.alias(name))
            features.append(Feature(name, kind, len(features)))
        else:
            whole = F.regexp_replace(F.regexp_replace(value, r"^([+-]?)\.", r"$10."), r"\.$", ".0")
            number = F.when(whole.isNull(), None).when(whole.rlike(NUMBER), F.expr("0D")).otherwise(F.raise_error(F.concat(F.lit("invalid number format: "), raw)).cast("double"))
            columns.append((number + whole.cast("double")).alias(name))
            features.append(Feature(name, kind, len(features)))
    return ExampleSet(rows.select(ident.alias("id"), klass.alias("class"), F.lit(1.0).alias("weight"), *columns), tuple(features))


def _cells(value: str) -> Column:
    return F.transform(F.split(value, ",", -1), lambda x: F.trim(x))


def read(spark: SparkSession, path: str) -> ExampleSet:
    """Rows in the order of their line; ids count them from 1, unless a column has the type id.

    Blanks around tokens go; ? is missing; a value that is no number fails the job that reads it.
    """
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", ""))
    head = [r[0] for r in lines.limit(2).collect()]
    if len(head) < 2:
        raise ValueError("invalid type declaration: the file has no two header rows")
    fields = _header(head[0].split(","), head[1].split(","))
    rows = _numbered(lines).filter("_line > 2")
    return _examples(rows.select((F.col("_line") - 2).cast("bigint").alias("id"), _cells("value").alias("_c")), fields)


def inline(spark: SparkSession, text: str) -> DataFrame:
    """One example of comma-separated numbers, with the id 1 and columns x0, x1, ..."""
    values = [float(x) for x in text.split(",")]
    return spark.createDataFrame([(1, "?", 1.0, *values)], "id long, class string, weight double, " + ", ".join(f"x{i} double" for i in range(len(values))))


def lines_of(ex: ExampleSet, decimals: int | None = None) -> DataFrame:
    """The data rows as text, the class last."""
    cell = lambda f: F.coalesce((F.format_string(f"%.{decimals}f", f.name) if decimals is not None and f.kind == "numeric" else F.col(f.name).cast("string")), F.lit("?"))
    return ex.df.select("id", F.concat_ws(",", *map(cell, ex.features), F.col("class")).alias("value"))


def write(ex: ExampleSet, path: str, decimals: int | None = None) -> None:
    """A file of header and rows in the order of id: the rows are sorted by range, the header is first."""
    spark = ex.df.sparkSession
    head = [(-2, ",".join([*(f.kind for f in ex.features), "class"])), (-1, ",".join([*ex.names(), "class"]))]
    rows = spark.createDataFrame(head, "id long, value string").unionByName(lines_of(ex, decimals))
    rows.orderBy("id").select("value").write.mode("overwrite").text(path)


def read_keel(spark: SparkSession, path: str) -> ExampleSet:
    """A KEEL file: attributes with bracketed ranges are numeric, <null> is missing, the output (or last) is the class.

    The lines with @ reach the driver, one for each attribute or so; data are read as by read().
    """
    lines = spark.read.text(path).withColumn("value", F.trim(F.regexp_replace("value", "\r$", "")))
    fields = _keel_header([r[0] for r in lines.filter(F.col("value").startswith("@")).collect()])
    rows = _numbered(lines).filter(~F.col("value").startswith("@") & ~F.col("value").startswith("%"))
    first = rows.agg(F.min("_line")).first()[0] or 1
    cells = F.transform(_cells("value"), lambda x: F.when(x == "<null>", "?").otherwise(x))
    return _examples(rows.select((F.col("_line") - first + 1).cast("bigint").alias("id"), cells.alias("_c")), fields)


def _keel_header(lines: list[str]) -> list[tuple[str, str]]:
    types, names, output = [], [], None
    for line in lines:
        low = line.lower()
        if low.startswith("@attribute"):
            rest = line.split(None, 1)[1]
            names.append(rest.split("{")[0].split("[")[0].split()[0].strip("'\""))
            types.append("numeric" if rest.rstrip().endswith("]") else "categoric")
        elif low.startswith("@output"):
            output = line.split(None, 1)[1].strip()
    if not names:
        raise ValueError("invalid type declaration: the file has no attributes")
    types[names.index(output) if output in names else len(names) - 1] = "class"
    return list(zip(types, names, strict=True))
