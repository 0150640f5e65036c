"""Reading and writing tables: delimited text, fixed-width text, ``.npy`` and ``.xlsx``.

Readers take Spark's ``binaryFile`` rows, so paths are any that Spark reads. Writers give
the text as rows or a Spark writer's folder; only printing formats work on a bounded head."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for null in text by type name.
NULL_MARKERS = {"int": "-2147483648", "bigint": "-2147483648", "smallint": "-32768", "double": "nan", "float": "nan", "string": "None"}


def clean_name(name: str, char: str = "_") -> str:
    """Punctuation and spaces of a field name replaced."""
    return re.sub(r"[^\w]", char, name)


def unique_names(names: list[str]) -> list[str]:
    """Clean names; later ones of the same name get a number."""
    out: list[str] = []
    for n in map(clean_name, names):
        k, new = 1, n
        while new in out:
            k, new = k + 1, f"{n}_{k}"
        out.append(new)
    return out


def as_text(df: DataFrame, null_markers: dict[str, str] | None = None) -> DataFrame:
    """All columns as text with nulls marked by type."""
    marks = NULL_MARKERS if null_markers is None else null_markers
    return df.select([F.coalesce(F.col(f.name).cast("string"), F.lit(marks.get(f.dataType.simpleString(), ""))).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, separator: str = ", ", single_file: bool = False, null_markers: dict[str, str] | None = None) -> None:
    """Header and rows; nulls marked by type. One file only on request, since one task then writes it all."""
    text = as_text(df, null_markers)
    (text.coalesce(1) if single_file else text).write.mode("errorifexists").option("header", True).option("sep", separator).option("quote", "\u0000").csv(path)


def fixed_width_lines(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Right-aligned fixed-width lines, column widths over all rows: ``line`` text, in no order."""
    cells = {f.name: F.format_string(f"%.{decimals}f", F.col(f.name).cast("double")) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string") for f in df.schema}
    text = df.select([F.coalesce(F.when(F.col(n).isNotNull(), c), F.lit("None")).alias(n) for n, c in cells.items()])
    widths = text.agg(*[F.max(F.length(c)).alias(c) for c in text.columns]).first()
    wide = {c: max(len(c), widths[c] or 0) for c in text.columns}
    return text.select(F.concat_ws(" ", *[F.lpad(F.col(c), wide[c], " ") for c in text.columns]).alias("line"))


def print_table(df: DataFrame, order: list[str], rows: int = 50, decimals: int = 2) -> str:
    """The first rows as numbered fixed-width text."""
    head = df.orderBy(*order).limit(rows).toPandas()
    cells = [[n, *[f"{v:.{decimals}f}" if isinstance(v, float) else str(v) for v in head[n]]] for n in head.columns]
    cells = [["n", *map(str, range(len(head)))], *cells]
    widths = [max(map(len, c)) for c in cells]
    return "\n".join(" ".join(v.rjust(w) for v, w in zip(line, widths, strict=True)) for line in zip(*cells, strict=True))


def npy_bytes(df: DataFrame, max_rows: int = 1_000_000) -> bytes:
    """A structured array of at most ``max_rows`` rows as ``.npy``; a larger table raises."""
    pdf = df.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write Parquet or several files")
    columns = {}
    for f in df.schema:
        v = pdf[f.name]
        kind = f.dataType.typeName()
        columns[f.name] = v.fillna("None").astype(str).to_numpy(dtype=str) if kind == "string" else v.fillna(-2147483648).to_numpy(np.int64) if kind in ("integer", "long", "short") else v.to_numpy(np.float64)
    out = np.empty(len(pdf), dtype=[(n, c.dtype) for n, c in columns.items()])
    for n, c in columns.items():
        out[n] = c
    buffer = io.BytesIO()
    np.save(buffer, out, allow_pickle=False)
    return buffer.getvalue()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Structured or 2-D arrays of one dtype; names are cleaned, NaN becomes null. Each file is one task's."""
    files = spark.read.format("binaryFile").load(path)
    first = np.load(io.BytesIO(files.limit(1).first()["content"]), allow_pickle=False)
    names = unique_names(list(first.dtype.names or [f"f{i}" for i in range(first.shape[1] if first.ndim > 1 else 1)]))
    kinds = [first.dtype[i] for i in range(len(names))] if first.dtype.names else [first.dtype] * len(names)
    spark_types = [T.StringType() if k.kind in "US" else T.LongType() if k.kind in "iu" else T.BooleanType() if k.kind == "b" else T.DoubleType() for k in kinds]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, spark_types, strict=True)])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                data = [a[n] for n in a.dtype.names] if a.dtype.names else list(np.atleast_2d(a.T if a.ndim > 1 else a))
                yield pd.DataFrame({n: v.astype(str) if v.dtype.kind in "US" else v for n, v in zip(names, data, strict=True)})

    return files.select("content").mapInPandas(rows, schema)


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def parse_xlsx(content: bytes, sheet: int = 0) -> list[list[object]]:
    """Cells of a sheet, row by row: text, float or None. A sheet number out of range raises IndexError."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", NS):
            shared.append("".join(t.text or "" for t in item.iter(f"{{{NS['m']}}}t")))
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", NS)
    wanted = sheets[sheet].get(f"{{{NS['r']}}}id")
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[wanted]
    xml = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out: list[list[object]] = []
    for row in xml.findall("m:sheetData/m:row", NS):
        cells: dict[int, object] = {}
        for c in row.findall("m:c", NS):
            place = 0
            for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                place = place * 26 + ord(letter) - 64
            kind, v = c.get("t"), c.find("m:v", NS)
            if kind == "inlineStr":
                value: object = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif v is None or v.text is None:
                value = None
            elif kind == "s":
                value = shared[int(v.text)]
            else:
                value = v.text if kind in ("str", "e") else float(v.text)
            cells[place - 1] = value
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def xlsx_bytes(rows: list[list[object]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: text, numbers, and nothing where a value is None."""
    lines = []
    for i, row in enumerate(rows):
        cells = []
        for j, v in enumerate(row):
            if v is not None:
                at = f"{'' if j < 26 else chr(64 + j // 26)}{chr(65 + j % 26)}{i + 1}"
                cells.append(f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>')
        lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Type="{NS["r"]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS["m"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return buffer.getvalue()


def read_xlsx(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A sheet with a header row of each file matched; files have to have the same header, and each is one task's.

    A column of whole numbers in all files is long, one of numbers double, else text; blanks
    are null. Only the kinds of the columns come to the driver, a row a file."""
    content = spark.read.format("binaryFile").load(path).select("path", "content")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, *body = parse_xlsx(data, sheet) or [[]]
                found = []
                for i in range(len(head)):
                    known = [r[i] for r in body if i < len(r) and r[i] is not None]
                    numbers = all(isinstance(v, float) for v in known)
                    found.append("none" if not known else "string" if not numbers else "bigint" if all(v == int(v) for v in known) else "double")
                yield pa.RecordBatch.from_pydict({"path": [where], "names": [unique_names([str(h) for h in head])], "kinds": [found]})

    files = content.mapInArrow(kinds, "path string, names array<string>, kinds array<string>").collect()
    headers = {tuple(f.names) for f in files}
    if len(headers) != 1:
        raise ValueError(f"files with different headers: {sorted(headers)[:2]}")
    names = list(headers.pop())
    rank = ["none", "bigint", "double", "string"]
    types = [max((f.kinds[i] for f in files), key=rank.index) for i in range(len(names))]
    types = ["string" if t == "none" else t for t in types]
    convert = {"string": lambda v: v if isinstance(v, str) else f"{v:g}" if isinstance(v, float) else str(v), "bigint": int, "double": float}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
        for batch in batches:
            for data in batch.column(0).to_pylist():
                body = parse_xlsx(data, sheet)[1:]
                columns = [[convert[t](r[i]) if i < len(r) and r[i] is not None else None for r in body] for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, t in zip(columns, types, strict=True)], names)

    return content.select("content").mapInArrow(rows, T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types, strict=True)]))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One object on any store that Spark writes."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def check_output_name(path: str) -> str:
    """The path, if its last part has letters, digits and underscores only; else ValueError."""
    if not re.fullmatch(r"\w+(\.\w+)?", path.rstrip("/").rpartition("/")[2]):
        raise ValueError("the output's name has punctuation or spaces")
    return path


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing table stays unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(check_output_name(path))


def raster_cells(spark: SparkSession, values: np.ndarray, left: float, bottom: float, size: float, nodata: float | None = None) -> DataFrame:
    """A 2-D array as long form: ``row`` and ``col`` from the top, cell centres ``x``, ``y``, ``value`` (nodata null)."""
    n_rows, n_cols = values.shape
    r, c = np.indices(values.shape)
    v = values.astype(float).ravel()
    pdf = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "x": left + (c.ravel() + 0.5) * size, "y": bottom + (n_rows - r.ravel() - 0.5) * size, "value": v})
    out = spark.createDataFrame(pdf)
    return out if nodata is None else out.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def raster_info(cells: DataFrame) -> DataFrame:
    """One row: rows, columns, count of values, min, max, mean, population deviation, and the extent of the cell centres."""
    v = F.col("value")
    return cells.agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"),
    )
