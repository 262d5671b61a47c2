"""Spreadsheet sink and source: workbooks per region through Spark's Python data source.

Every task writes its own workbooks, one open at a time, so no region has to
fit in one task: a region is the set of its files, each of at most
``SHEET_ROWS`` rows. Tasks write under a staging folder; the commit moves the
files that successful tasks reported into place (and, for an overwrite, then
deletes the workbooks that were there), an abort deletes what was staged.
Copies by repeated or speculative tasks are never reported, hence never moved.

Defined results: the first row holds the column names; NULL is an empty cell
and comes back as NULL; numbers are numbers, dates and times ISO text, NaN and
infinities text; characters that XML lacks are written as _xHHHH_; a text over
32,767 characters is an error, as is an unsupported type. A NULL region's
files start with ``null``. A table without rows leaves no workbook.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a sheet below its header, and characters of a cell.
SHEET_ROWS, CELL_CHARS = 1_048_575, 32_767
FORMAT = "fleetcraft_workbooks"
_TYPES = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DateType, T.TimestampType)


def register(spark: SparkSession, sheet_rows: int = SHEET_ROWS) -> None:
    """Make the format known to a session. Classes are local, so tasks get them by value."""
    import datetime as dt
    import os
    import re
    import uuid
    import zipfile
    from dataclasses import dataclass
    from urllib.parse import quote
    from xml.etree import ElementTree
    from xml.sax.saxutils import escape

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

    most, longest = sheet_rows, CELL_CHARS
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relations = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fixed = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>'
            f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{relations}"><Relationship Id="r1" Type="{office}/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" '
            'r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{relations}"><Relationship Id="r1" Type="{office}/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>',
    }
    sheet_name = "xl/worksheets/sheet1.xml"

    def place(path):
        path = path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:") else path
        return fs.FileSystem.from_uri(path)

    def text(value):
        if len(value) > longest:
            raise ValueError(f"a text of {len(value)} characters does not fit a cell")
        value = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", value)
        return escape(re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", value))

    def cell(value):
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int) or isinstance(value, float) and value - value == 0:
            return f"<c><v>{value!r}</v></c>"
        value = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text(value)}</t></is></c>'

    def line(values):
        return ("<row>" + "".join(map(cell, values)) + "</row>").encode()

    @dataclass
    class Written(WriterCommitMessage):
        files: list

    class Writer(DataSourceWriter):
        def __init__(self, options, schema, overwrite):
            self.path, self.by, self.overwrite = options["path"], options["by"], overwrite
            self.names, self.run = [f.name for f in schema.fields], uuid.uuid4().hex[:12]

        def staging(self):
            return f"_staging-{self.run}"

        def write(self, rows):
            system, base = place(self.path)
            task, files, region, book, count = uuid.uuid4().hex[:12], [], (), None, 0
            system.create_dir(f"{base}/{self.staging()}", recursive=True)

            def close():
                if book:
                    book[2].write(b"</sheetData></worksheet>")
                    for part in (book[2], book[1], book[0]):
                        part.close()

            for row in rows:
                if (row[self.by],) != region or count == most:
                    close()
                    region, count = (row[self.by],), 0
                    label = "null" if row[self.by] is None else "is-" + quote(str(row[self.by]), safe="")
                    files.append(f"{label}-{self.run}-{task}-{len(files)}.xlsx")
                    out = system.open_output_stream(f"{base}/{self.staging()}/{files[-1]}")
                    packed = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    for name, content in fixed.items():
                        packed.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + content)
                    sheet = packed.open(sheet_name, "w", force_zip64=True)
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{space}"><sheetData>'.encode())
                    sheet.write(line(self.names))
                    book = (out, packed, sheet)
                book[2].write(line([row[n] for n in self.names]))
                count += 1
            close()
            return Written(files)

        def commit(self, messages):
            system, base = place(self.path)
            system.create_dir(base, recursive=True)
            old = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".xlsx")]
            for message in messages:
                for name in message.files if message else []:
                    system.move(f"{base}/{self.staging()}/{name}", f"{base}/{name}")
            for path in old if self.overwrite else []:
                system.delete_file(path)
            self.abort(messages)

        def abort(self, messages):
            system, base = place(self.path)
            if system.get_file_info(f"{base}/{self.staging()}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{self.staging()}")

    class Book(InputPartition):
        def __init__(self, path):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, options, schema):
            self.path, self.schema = options["path"], schema

        def partitions(self):
            system, base = place(self.path)
            found = system.get_file_info(fs.FileSelector(base))
            # an empty folder still needs a task
            return [Book(os.path.basename(f.path)) for f in found if f.base_name.endswith(".xlsx")] or [Book(None)]

        def read(self, partition):
            if partition.path is None:
                return
            system, base = place(self.path)
            types = {f.name: f.dataType.typeName() for f in self.schema.fields}

            def value(found, kind):
                kept = found.find(f".//{{{space}}}t" if found.get("t") == "inlineStr" else f"{{{space}}}v")
                if kept is None:
                    return None
                raw = re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), kept.text or "")
                if kind in ("byte", "short", "integer", "long"):
                    return int(raw)
                if kind in ("float", "double"):
                    return float(raw)
                if kind == "boolean":
                    return raw == "1"
                if kind == "date":
                    return dt.date.fromisoformat(raw)
                return dt.datetime.fromisoformat(raw) if kind == "timestamp" else raw

            with system.open_input_file(f"{base}/{partition.path}") as source, zipfile.ZipFile(source) as packed, \
                    packed.open(sheet_name) as sheet:
                names = None
                for _, found in ElementTree.iterparse(sheet):
                    if found.tag == f"{{{space}}}row":
                        if names is None:
                            names = [value(c, "string") for c in found]
                        else:
                            row = {n: value(c, types[n]) for n, c in zip(names, found) if n in types}
                            yield tuple(row.get(f.name) for f in self.schema.fields)
                        found.clear()

    class Workbooks(DataSource):
        @classmethod
        def name(cls):
            return "fleetcraft_workbooks"

        def reader(self, schema):
            return Reader(self.options, schema)

        def writer(self, schema, overwrite):
            return Writer(self.options, schema, overwrite)

    spark.dataSource.register(Workbooks)


def write_workbooks(df: DataFrame, path: str, by: str = "logistic_region", mode: str = "overwrite",
                    sheet_rows: int = SHEET_ROWS) -> None:
    """Workbooks of each region under a shared folder."""
    for f in df.schema.fields:
        if not isinstance(f.dataType, _TYPES):
            raise TypeError(f"column {f.name}: {f.dataType.simpleString()} has no cell form")
    register(df.sparkSession, sheet_rows)
    df.sortWithinPartitions(by).write.format(FORMAT).mode(mode).option("by", by).option("path", path).save()


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All workbooks of a folder with a declared schema, a task per file."""
    register(spark)
    return spark.read.format(FORMAT).schema(schema).option("path", path).load()
