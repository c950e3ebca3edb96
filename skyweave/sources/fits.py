"""FITS binary tables and NUNIQ coverage maps as DataFrames, read by byte offset in many tasks.

The driver reads headers alone, whatever a table's size, and plans spans of rows; every task opens the file and reads its
own span. Folders of small files (coverage maps) come through Spark's binaryFile. Paths are local or any that Arrow's file
systems know (s3, hdfs, gs).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.functions import hpx
from skyweave.operators import ranges

#: FITS column codes as numpy types, the length of a card and of a block, the limit of map rows, rows of a window, and bytes of a span.
CODES = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
CARD, BLOCK, MOST_CELLS, MOST_WINDOW, SPAN = 80, 2880, 5_000_000, 200_000, 1 << 25


def open_file(path: str):
    """A random-access file of a local path or of a URI."""
    system, where = arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(where)


def files_of(path: str) -> list[str]:
    """The file at a path, or the files in a folder, in order of name."""
    uri = path if "://" in path else f"file://{path}"
    system, where = arrow_fs.FileSystem.from_uri(uri)
    info = system.get_file_info(where)
    scheme = uri.split("://")[0]
    found = [where] if info.is_file else sorted(i.path for i in system.get_file_info(arrow_fs.FileSelector(where)) if i.is_file and not i.base_name.startswith(("_", ".")))
    return [f"{scheme}://{f}" for f in found]


def _cards(block: bytes, cards: dict[str, str]) -> bool:
    """Add a block's cards; whether END was among them."""
    for at in range(0, len(block), CARD):
        card = block[at : at + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return True
        if card[8:10] == "= ":
            text = card[10:]
            quoted = re.match(r"\s*'((?:[^']|'')*)'", text)
            cards[key] = quoted[1].replace("''", "'").rstrip() if quoted else text.split("/")[0].strip()
    return False


def find_table(file, hdu: str | None = None) -> tuple[dict[str, str], int]:
    """Cards of the first binary table (of that EXTNAME, if given) and where its rows start. Only headers are read."""
    at, size = 0, file.size()
    while at < size:
        cards: dict[str, str] = {}
        file.seek(at)
        while True:
            block = file.read(BLOCK)
            at += BLOCK
            if len(block) < CARD:
                raise ValueError("FITS header without END")
            if _cards(block, cards):
                break
        axes = [int(cards[f"NAXIS{k + 1}"]) for k in range(int(cards.get("NAXIS", 0)))]
        body = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) + int(cards.get("PCOUNT", 0)) if axes else 0
        if cards.get("XTENSION") == "BINTABLE" and (hdu is None or cards.get("EXTNAME") == hdu):
            if at + axes[0] * axes[1] > size:
                raise ValueError("FITS table is truncated")
            return cards, at
        at += -(-body // BLOCK) * BLOCK
    raise ValueError(f"no binary table {hdu or ''}")


def row_type(cards: dict[str, str]) -> tuple[np.dtype, dict[str, str]]:
    """The numpy type of a table's rows, and the code of each column."""
    fields, codes = [], {}
    for k in range(1, int(cards["TFIELDS"]) + 1):
        repeat, code = re.fullmatch(r"(\d*)([ABDEIJKL])\S*", cards[f"TFORM{k}"]).groups()
        n = int(repeat or 1)
        fields.append((cards[f"TTYPE{k}"], f"S{n}" if code == "A" else CODES[code], () if code == "A" or n == 1 else (n,)))
        codes[cards[f"TTYPE{k}"]] = code
    kind = np.dtype(fields)
    if kind.itemsize != int(cards["NAXIS1"]):
        raise ValueError("FITS table's width differs from its columns")
    return kind, codes


def _column(values: np.ndarray, code: str):
    if code == "A":
        return [v.decode("ascii", "replace").rstrip() for v in values.tolist()]
    values = values == ord("T") if code == "L" else values.astype(values.dtype.newbyteorder("="))  # logicals are the letters T and F
    return list(values) if values.ndim > 1 else values


def read_bintable(data: bytes, hdu: str | None = None) -> tuple[dict[str, str], dict[str, np.ndarray | list]]:
    """Cards and columns of a whole small file."""
    cards, at = find_table(pa.BufferReader(data), hdu)
    kind, codes = row_type(cards)
    table = np.frombuffer(data, dtype=kind, count=int(cards["NAXIS2"]), offset=at)
    return cards, {n: _column(table[n], c) for n, c in codes.items()}


def fits_table(spark: SparkSession, path: str, schema: T.StructType, hdu: str | None = None, start: int = 0, count: int | None = None, digest: str | None = None) -> DataFrame:
    """Rows of the columns in `schema` of every file under `path`, or `count` rows from `start` on of each.

    A missing column is an error, and so is a window beyond a table's end. `digest` names a further column: the SHA-256 of
    the bytes of the span that a row was read with.
    """
    types = {f.name: f.dataType for f in schema}
    spans = []
    for name in files_of(path):
        with open_file(name) as file:
            cards, at = find_table(file, hdu)
        kind, codes = row_type(cards)
        if missing := types.keys() - codes.keys():
            raise ValueError(f"FITS table lacks {sorted(missing)}")
        n = int(cards["NAXIS2"])
        last = n if count is None else start + count
        if last > n or start < 0:
            raise ValueError(f"{name} has {n} rows")
        step = max(1, SPAN // max(1, kind.itemsize))
        spans += [(name, at + k * kind.itemsize, min(step, last - k), hdu) for k in range(start, last, step)]
    out = T.StructType([*schema.fields, *([T.StructField(digest, T.StringType())] if digest else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for name, at, rows, table in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with open_file(name) as file:
                    kind, codes = row_type(find_table(file, table)[0])
                    file.seek(at)
                    raw = file.read(rows * kind.itemsize)
                found = np.frombuffer(raw, dtype=kind, count=rows)
                columns = [pa.array(_column(found[n], codes[n])).cast(to_arrow_type(t)) for n, t in types.items()]
                if digest:
                    columns.append(pa.array([hashlib.sha256(raw).hexdigest()] * rows))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    plan = spark.createDataFrame(spans, "name string, at long, rows long, hdu string")
    return plan.repartition(max(1, min(len(spans), 10_000))).mapInArrow(run, out)


def row_window(spark: SparkSession, path: str, schema: T.StructType, start: int, count: int, hdu: str | None = None) -> DataFrame:
    """At most MOST_WINDOW consecutive rows of a table, however large it is, each with the digest of the bytes read."""
    if not 0 < count <= MOST_WINDOW:
        raise ValueError(f"a window has 1 to {MOST_WINDOW} rows")
    return fits_table(spark, path, schema, hdu, start, count, digest="bytes_sha256")


def fits_moc(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """(path, order, ipix) of NUNIQ coverage maps in ICRS. Other maps, maps of too many rows, and cells that repeat, lie
    inside one another or are finer than order 13 are errors. `legacy` asks for maps of a single PIXEL column, of the same codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                cards, found = read_bintable(raw.as_py())
                if cards.get("ORDERING") != "NUNIQ" or cards.get("COORDSYS", "C") not in ("C", "ICRS"):
                    raise ValueError(f"{where}: not an ICRS NUNIQ map")
                if legacy and (list(found) != ["PIXEL"] or cards.get("PIXTYPE") != "HEALPIX" or cards.get("MOCVERS", "1.0") not in ("1.0", "1.1")):
                    raise ValueError(f"{where}: not a legacy map")
                uniq = np.asarray(next(iter(found.values())), dtype=np.int64)
                if len(uniq) > MOST_CELLS or len(uniq) and not 4 <= uniq.min() <= uniq.max() < 16 * 4**hpx.MAX_ORDER:
                    raise ValueError(f"{where}: too many cells or not a cell")
                if legacy and not len(uniq):
                    raise ValueError(f"{where}: a legacy map without cells")
                # A cell is a range at the finest order; in order, ranges must not meet.
                order = (np.floor(np.log2(uniq.astype(np.float64) + 0.5)).astype(np.int64) - 2) // 2
                wide = np.left_shift(np.int64(1), 2 * (hpx.MAX_ORDER - order))
                lo = (uniq - np.left_shift(np.int64(4), 2 * order)) * wide
                turn = np.argsort(lo, kind="stable")
                if not legacy and np.any((lo + wide)[turn][:-1] > lo[turn][1:]):
                    raise ValueError(f"{where}: cells repeat or lie inside one another")
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(uniq)), pa.array(uniq)], names=["path", "uniq"])

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, uniq long")
    order, ipix = hpx.uniq_decode(F.col("uniq"))
    cells = read.select("path", order.alias("order"), ipix.alias("ipix"))
    return ranges.canonical(cells, "path", coarsest=0, finest=hpx.MAX_ORDER) if legacy else cells


def check_moc(cells: DataFrame) -> DataFrame:
    """`cells` (path, order, ipix), after an error if any is finer than the finest order, repeated, or inside another."""
    if not cells.where(F.col("order") > hpx.MAX_ORDER).isEmpty():
        raise ValueError(f"cells finer than order {hpx.MAX_ORDER}")
    if not ranges.overlapping_cells(cells, "path").isEmpty():
        raise ValueError("cells repeat or lie inside one another")
    return cells
