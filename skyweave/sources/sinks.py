"""Sinks for coverage: FITS maps with their projections, and evidence of files stored by cell. Written once, with digests.

A map is one file of at most MOST_CELLS cells, which is all that passes through the driver.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import hpx
from skyweave.operators import ranges, units
from skyweave.sources import text
from skyweave.sources.fits import BLOCK, CARD, MOST_CELLS


def put_once(folder: str, name: str, data: bytes) -> str:
    """Write a file where none is; equal bytes again are accepted, others an error. Returns the digest."""
    system, where = arrow_fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(where, recursive=True)
    path = f"{where}/{name}"
    if system.get_file_info(path).is_file:
        with system.open_input_file(path) as f:
            if f.read() != data:
                raise ValueError(f"{path} holds other bytes")
    else:
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)
    return hashlib.sha256(data).hexdigest()


def bintable(columns: list[tuple[str, str, np.ndarray]], cards: dict[str, str] | None = None) -> bytes:
    """A FITS file of one binary table: columns are (name, TFORM, big-endian values)."""
    table = np.rec.fromarrays([v for _, _, v in columns])
    head = {"XTENSION": "'BINTABLE'", "BITPIX": "8", "NAXIS": "2", "NAXIS1": str(table.dtype.itemsize), "NAXIS2": str(len(table)), "PCOUNT": "0", "GCOUNT": "1", "TFIELDS": str(len(columns))}
    for k, (name, form, _) in enumerate(columns, 1):
        head |= {f"TTYPE{k}": f"'{name}'", f"TFORM{k}": f"'{form}'"}

    def block(pairs: dict[str, str]) -> bytes:
        raw = ("".join(f"{k:<8}= {v}".ljust(CARD) for k, v in pairs.items()) + "END".ljust(CARD)).encode()
        return raw + b" " * (-len(raw) % BLOCK)

    body = table.tobytes()
    return block({"SIMPLE": "T", "BITPIX": "8", "NAXIS": "0", "EXTEND": "T"}) + block(head | (cards or {})) + body + b"\0" * (-len(body) % BLOCK)


def _compact(value) -> bytes:
    return json.dumps(value, separators=(",", ":")).encode()


def write_moc(cells: DataFrame, folder: str, max_order: int = hpx.MAX_ORDER, query_order: int = 8, preview_order: int = 4, source_sha256: str = "") -> dict[str, str]:
    """Canonical cells (order, ipix) as moc.fits, their projections as query-order and preview-order JSON, and statistics.json; the digest of each."""
    if not cells.where((F.col("ipix") < 0) | (F.col("ipix") >= 12 * F.pow(F.lit(4.0), F.col("order")))).isEmpty():
        raise ValueError("not cells of their order")
    own = ranges.canonical(cells.select("order", "ipix"), coarsest=0, finest=max_order)
    if (n := own.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells exceed the {MOST_CELLS} of a map")
    uniq = np.sort(own.select(hpx.uniq_encode(F.col("order"), F.col("ipix")).alias("u")).toPandas()["u"].to_numpy(np.int64))
    finest = max((int(u).bit_length() - 3) // 2 for u in (uniq[-1:] if len(uniq) else [4]))
    done = {"moc.fits": put_once(folder, "moc.fits", bintable([("UNIQ", "K", uniq.astype(">i8"))], {"ORDERING": "'NUNIQ'", "COORDSYS": "'C'", "MOCVERS": "'2.0'", "MOCORD_S": str(finest)}))}
    counts = {}
    for kind, order in (("query", query_order), ("preview", preview_order)):
        held = ranges.union(ranges.to_ranges(own, order).select("lo", "hi")).toPandas().sort_values("lo")  # ranges: at most half an order's cells
        counts[kind] = int((held["hi"] - held["lo"]).sum())
        pixels = ",".join(",".join(map(str, range(lo, hi))) for lo, hi in zip(held["lo"].tolist(), held["hi"].tolist(), strict=True))
        text_of = _compact({"schemaVersion": 1, "order": order, "ordering": "NESTED", "pixels": []})
        done[f"{kind}-order{order}.json"] = put_once(folder, f"{kind}-order{order}.json", text_of[:-2] + pixels.encode() + text_of[-2:])
    orders = sorted(r.order for r in own.select("order").distinct().collect())
    facts = {"schemaVersion": 1, "coordinateFrame": "ICRS", "ordering": "NESTED", "cellCount": int(n), "availableOrders": orders, "queryOrder": query_order, "queryPixelCount": counts["query"], "previewOrder": preview_order, "previewPixelCount": counts["preview"], "sourceSha256": source_sha256}
    done["statistics.json"] = put_once(folder, "statistics.json", _compact(facts))
    return done


def write_path_evidence(files: DataFrame, url: str, folder: str, order: int, roster: DataFrame | None = None) -> dict[str, str]:
    """Evidence of files stored by cell: their (url, order, ipix) rows, the map of the cells, and a manifest of digests.

    An error if a path contradicts its group, a cell repeats, or the cells differ from the roster (pixel).
    """
    found = units.path_cells(files, url)
    if not found.where("fault is not null").isEmpty():
        raise ValueError("paths contradict their group or repeat a cell")
    if roster is not None and not found.select("pixel").exceptAll(roster.select("pixel")).union(roster.select("pixel").exceptAll(found.select("pixel"))).isEmpty():
        raise ValueError("the cells differ from the roster")
    rows = found.select(url, F.lit(order).alias("order"), F.col("pixel").alias("ipix"))
    text.write_once(rows, f"{folder}/files.parquet")
    n, h = text.digest(rows)
    done = write_moc(rows.select("order", "ipix"), folder, max_order=order)
    done["manifest.json"] = put_once(folder, "manifest.json", _compact({"schemaVersion": 1, "mode": "path-healpix", "order": order, "files": n, "rowsHash": h, "outputs": done}))
    return done
