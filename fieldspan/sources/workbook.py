"""A sink that writes tables as the sheets of one workbook (Office Open XML).

Tasks write their rows as pieces of sheets beside the workbook and tell how wide their columns are; the commit
streams the pieces, in order, into the package, in a bounded buffer, and moves it to its place. A task
that fails or runs twice leaves a piece that no commit names; pieces go with the commit or the abort. A sheet has
at most 1,048,576 rows, as its readers do; more raise an error and leave no file.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

MOST_ROWS = 1_048_576
NARROW, WIDE = 8, 45
BUFFER = 1 << 20
PLAIN, HEADER, LABEL = 0, 1, 2
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
START = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell formats by number: plain; bold white on blue, centred; bold on light blue.
STYLES = (
    f'{START}<styleSheet xmlns="{MAIN}"><fonts count="3"><font><sz val="11"/><name val="Calibri"/></font><font><b/><color rgb="FFFFFFFF"/><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F4E78"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E1F2"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf><xf fontId="2" fillId="3" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
)


def letters(n: int) -> str:
    """A column's name: 1 is A, 27 is AA."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell(value: str | None, number: bool, style: int = PLAIN) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if number:
        return f"<c{s}><v>{value}</v></c>"
    # Signs that XML has no place for are written by their numbers, as readers of workbooks expect.
    text = re.sub("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", value)
    return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def row(values: list, numbers: list[bool], styles: list[int]) -> str:
    return "<row>" + "".join(map(cell, values, numbers, styles)) + "</row>"


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Pieces(WriterCommitMessage):
    """What a task wrote: for each sheet its piece, rows, and the longest text of each column."""

    partition: int
    sheets: dict[int, tuple[str, int, list[int]]] = field(default_factory=dict)


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], single: list[bool]) -> None:
        self.path, self.names, self.single = path, names, single
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Pieces:
        files, inner = opened(self.parts)
        files.create_dir(inner, recursive=True)
        out, open_ = Pieces(TaskContext.get().partitionId()), {}
        try:
            for r in iterator:
                if r.sheet not in open_:
                    open_[r.sheet] = [f"{inner}/{uuid.uuid4().hex}", None, 0, []]
                    open_[r.sheet][1] = files.open_output_stream(open_[r.sheet][0])
                own = open_[r.sheet]
                own[1].write(row(r.cells, r.numbers, r.styles).encode())
                own[2] += 1
                sizes = [len(x or "") for x in r.cells]
                own[3] = [max(a, b) for a, b in zip(own[3] + [0] * (len(sizes) - len(own[3])), sizes + [0] * (len(own[3]) - len(sizes)), strict=True)]
        finally:
            for _, stream, *_ in open_.values():
                if stream:
                    stream.close()
        out.sheets = {k: (name, n, sizes) for k, (name, _, n, sizes) in open_.items()}
        return out

    def commit(self, messages: list[Pieces | None]) -> None:
        files, inner = opened(self.path)
        made = f"{opened(self.parts)[1]}/workbook"
        told = sorted((m for m in messages if m), key=lambda m: m.partition)
        try:
            files.create_dir(made.rpartition("/")[0], recursive=True)
            with files.open_output_stream(made) as stream, zipfile.ZipFile(_Counted(stream), "w", zipfile.ZIP_DEFLATED) as package:
                self._package(package, files, told)
            files.create_dir(inner.rpartition("/")[0], recursive=True)
            files.move(made, inner)
        finally:
            self._clear()

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, inner = opened(self.parts)
        if files.get_file_info(inner).type.name == "Directory":
            files.delete_dir(inner)

    def _package(self, package: zipfile.ZipFile, files, told: list[Pieces]) -> None:
        n = range(1, len(self.names) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KIND}.worksheet+xml"/>' for k in n)
        package.writestr("[Content_Types].xml", f'{START}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>{types}</Types>')
        package.writestr("_rels/.rels", f'{START}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, self.names, strict=True))
        package.writestr("xl/workbook.xml", f'{START}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        package.writestr("xl/_rels/workbook.xml.rels", f'{START}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="rId{len(n) + 1}" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        package.writestr("xl/styles.xml", STYLES)
        for k in n:
            own = [m.sheets[k - 1] for m in told if k - 1 in m.sheets]
            rows = sum(x[1] for x in own)
            if rows > MOST_ROWS:
                raise ValueError(f"sheet {self.names[k - 1]} has {rows} rows; a workbook holds {MOST_ROWS}")
            many = max((len(x[2]) for x in own), default=1)
            widths = [min(max(max((x[2][c] for x in own if c < len(x[2])), default=0) + 2, NARROW), WIDE) for c in range(many)]
            cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths))
            area = f"A1:{letters(many)}{max(rows, 1)}"
            pane = '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>' if self.single[k - 1] else ""
            with package.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                out.write(f'{START}<worksheet xmlns="{MAIN}"><dimension ref="{area}"/><sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews><cols>{cols}</cols><sheetData>'.encode())
                for name, *_ in own:
                    with files.open_input_stream(name) as piece:
                        while chunk := piece.read(BUFFER):
                            out.write(chunk)
                out.write(f"</sheetData>{f'<autoFilter ref={quoteattr(area)}/>' if self.single[k - 1] else ''}</worksheet>".encode())


class _Counted:
    """A stream that can only be written to, for a package that asks where it is."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def seekable(self) -> bool:
        return False

    def flush(self) -> None:
        self.stream.flush()


class WorkbookSink(DataSource):
    """Options path, names (a JSON list of the sheets' names) and single (whether each has one table alone)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], json.loads(self.options["names"]), json.loads(self.options["single"]))


ROW = "sheet int, cells array<string>, numbers array<boolean>, styles array<int>"


def _rows(table: DataFrame, sheet: int, label: str | None) -> DataFrame:
    numbers = [isinstance(f.dataType, T.NumericType) for f in table.schema]
    styles = [LABEL if f.name == label else PLAIN for f in table.schema]
    plain: list[Column] = []
    for f, number in zip(table.schema, numbers, strict=True):
        c = F.col(f"`{f.name}`")
        # What isn't a finite number has no number to write.
        c = F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c) if number else c
        plain.append(c.cast("string"))
    fixed = lambda xs, kind: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")
    return table.select(F.lit(sheet).alias("sheet"), F.array(*plain).alias("cells"), fixed(numbers, "boolean").alias("numbers"), fixed(styles, "int").alias("styles"))


def write(book: dict[str, list[DataFrame]], path: str, label: str | None = None) -> None:
    """Write a workbook: for each sheet its tables, one below the other, in the order of their rows. Columns
    called label are set off. A sheet of one table has its first row fixed and a filter."""
    spark = next(iter(book.values()))[0].sparkSession
    spark.dataSource.register(WorkbookSink)
    out = None
    for k, tables in enumerate(book.values()):
        for j, t in enumerate(tables):
            head = ([(k, [], [], [])] if j else []) + [(k, list(t.columns), [False] * len(t.columns), [HEADER] * len(t.columns))]
            for part in (spark.createDataFrame(head, ROW).coalesce(1), _rows(t, k, label)):
                out = part if out is None else out.unionByName(part)
    single = [len(tables) == 1 for tables in book.values()]
    out.write.format("workbook").mode("append").options(names=json.dumps(list(book)), single=json.dumps(single)).option("path", path).save()
