"""First sheets of spreadsheets as rows of text, with the header looked for in the first rows."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> list[list[str]]:
    """The cells of a workbook's first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out = []
        for row in ET.fromstring(z.read(name)).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_NS}c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                value = c.findtext(f"{_NS}v")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                cells[at or len(cells) + 1] = value or ""
            out.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        return out


def read(spark: SparkSession, path: str, columns: list[str], header_rows: int = 10) -> DataFrame:
    """``columns`` as text with __file__ and __row__; a sheet without them in its first rows is an error, blank rows go."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `__file__` string, `__row__` int"

    def each(frames):
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = sheet_rows(data)
                head = next((i for i, r in enumerate(rows[:header_rows]) if set(columns) <= {x.strip() for x in r}), None)
                if head is None:
                    raise ValueError(f"{name}: no header with {', '.join(columns)}")
                at = {x.strip(): i for i, x in enumerate(rows[head])}
                for n, r in enumerate(rows[head + 1 :], head + 2):
                    cells = [r[at[c]] if at[c] < len(r) else "" for c in columns]
                    if any(x.strip() for x in cells):
                        out.append((*cells, name.rpartition("/")[2], n))
            yield pd.DataFrame(out, columns=[*columns, "__file__", "__row__"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, schema)
