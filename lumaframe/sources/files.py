"""Files as tables: listing, binary reads, and parsers over them with errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from . import boxes, carriers, gainmap_tiff, images

#: Extensions read from folders; files named outright need none of them.
EXTENSIONS = ("tif", "tiff", "png", "jpg", "jpeg", "heic", "heif", "dng", "arw", "cr2", "cr3", "nef", "raf", "orf", "rw2")
#: Rows of a batch sent back to the JVM.
BATCH = 10_000
#: Pixels of one.
PIXELS = 1 << 18




def pattern_of(suffixes: tuple[str, ...]) -> str:
    """A pattern of file names with these suffixes, whatever the case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in suffixes) + "}"


PATTERN = pattern_of(EXTENSIONS)


def binary_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, modificationTime, length, content of files named outright, whatever their
    names, and of files with EXTENSIONS in folders, one level deep."""
    folders = [p for p in paths if _is_folder(spark, p)]
    named = [p for p in paths if p not in set(folders)]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    parts = [read.load(named)] if named else []
    if folders:
        parts.append(spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", "false").load(folders))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).dropDuplicates(["path"])


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The inputs of a batch in order; content is not read. Missing paths and folders
    without inputs are errors."""
    files = binary_files(spark, paths).select("path", "length").orderBy("path")
    if files.isEmpty():
        raise ValueError("no inputs")
    return files


def parsed(files: DataFrame, parse: Callable[[bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``parse`` for each file (path, content), with path first and ``error`` last.

    A file that cannot be read is one row with its error and nulls: it never fails the job.
    Works within each task, batch by batch; nothing is shuffled.
    """
    inner = _parse_datatype_string(schema)
    out = StructType([StructField("path", StringType()), *inner.fields, StructField("error", StringType())])
    arrow, width = to_arrow_schema(out), len(inner.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                try:
                    rows += [(path, *r, None) for r in parse(content or b"")]
                except Exception as e:  # what is wrong with a file is part of the result
                    rows.append((path, *[None] * width, f"{type(e).__name__}: {e}"))
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return files.select("path", "content").mapInArrow(run, out)


def parsed_columns(files: DataFrame, parse: Callable[[bytes], Iterable[tuple[np.ndarray, ...]]], schema: str) -> DataFrame:
    """``parsed``, for parsers that give blocks of whole columns."""
    inner = _parse_datatype_string(schema)
    out = StructType([StructField("path", StringType()), *inner.fields, StructField("error", StringType())])
    arrow = to_arrow_schema(out)

    def batch(path: str, block: tuple, n: int, error: str | None) -> pa.RecordBatch:
        cols = [pa.array(c, f.type) for c, f in zip(block, list(arrow)[1:-1])]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), *cols, pa.repeat(pa.scalar(error, pa.string()), n)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                try:
                    blocks = list(parse(content or b""))
                except Exception as e:  # what is wrong with a file is part of the result
                    yield batch(path, tuple([None] for _ in inner.fields), 1, f"{type(e).__name__}: {e}")
                    continue
                for block in blocks:
                    for at in range(0, len(block[0]), PIXELS):
                        part = tuple(c[at : at + PIXELS] for c in block)
                        yield batch(path, part, len(part[0]), None)

    return files.select("path", "content").mapInArrow(run, out)


def _table(name: str) -> Callable[[bytes], Iterable[tuple]]:
    return lambda d: getattr(boxes.parse(d), name)


#: name -> (parser, schema) of every table that a file's bytes give.
TABLES: dict[str, tuple[Callable[[bytes], Iterable[tuple]], str]] = {
    "boxes": (boxes.tree, "depth int, box_path string, type string, off long, len long"),
    "items": (_table("items"), "item_id long, item_type string, name string, content_type string, hidden boolean"),
    "item_refs": (_table("refs"), "ref_type string, from_id long, to_id long, ord int"),
    "item_props": (_table("props"), "prop_idx int, prop_type string, width long, height long, bits array<int>, urn string, value int"),
    "item_assoc": (_table("assoc"), "item_id long, prop_idx int, essential boolean, ord int"),
    "item_locs": (_table("locs"), "item_id long, method int, off long, len long, ord int"),
    "groups": (_table("groups"), "group_type string, group_id long, entity_id long, ord int"),
    "tiff_entries": (images.tiff_entries, "ifd string, tag int, typ int, count long, value binary"),
    "tiff_pixels": (images.tiff_pixels, "y int, x int, r double, g double, b double"),
    "jpeg_segments": (images.jpeg_segments, "ord int, marker int, body binary"),
    "gain_map_pixels": (gainmap_tiff.gain_map, "y int, x int, br int, bg int, bb int, gr int, gg int, gb int"),
    "gain_maps": (gainmap_tiff.gain_map_meta, "width int, height int, meta string"),
    "tiff_tiles": (images.tiff_tiles, "y0 int, height int, width int, r binary, g binary, b binary"),
    "sidecar": (carriers.sidecar, "kind string, label string, data binary"),
    "coded_images": (lambda d: [carriers.coded_image(d)], "width long, height long, chroma int, depth int, config binary, data binary"),
    "icc_tags": (images.icc_tags, "signature string, payload binary"),
}


#: Those whose parsers give whole columns.
COLUMNS = frozenset(("tiff_pixels", "gain_map_pixels"))


def table(files: DataFrame, name: str) -> DataFrame:
    return (parsed_columns if name in COLUMNS else parsed)(files, *TABLES[name])


_STRUCTURE = ("items", "refs", "props", "assoc", "locs", "groups")


def structure(files: DataFrame) -> DataFrame:
    """One row per file: path, each of its tables as an array of structs, and error.

    Parsed once; what refers to what within a file is then resolved in its row, without
    joins: ``refs``, ``props`` and so on are a file's own and small.
    """
    names = {"refs": "item_refs", "props": "item_props", "assoc": "item_assoc", "locs": "item_locs"}
    schema = ", ".join(f"{n} array<struct<" + ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in TABLES[names.get(n, n)][1].split(", ")) + ">>" for n in _STRUCTURE)

    def whole(d: bytes) -> list[tuple]:
        h = boxes.parse(d)
        cols = [[c.split()[0] for c in TABLES[names.get(n, n)][1].split(", ")] for n in _STRUCTURE]
        return [tuple([dict(zip(c, r)) for r in getattr(h, n)] for n, c in zip(_STRUCTURE, cols))]

    return parsed(files, whole, schema)


def resolved_items(structures: DataFrame) -> DataFrame:
    """path, item_id, item_type, name, hidden, width, height, describes: each item with the
    size its associated property states (1-based places; of several the last counts) and
    what it describes."""

    def of(item):
        own = F.filter("assoc", lambda a: a["item_id"] == item["item_id"])
        sizes = F.filter(F.transform(own, lambda a: F.get("props", a["prop_idx"] - 1)), lambda p: p["prop_type"] == "ispe")
        last = F.get(sizes, F.size(sizes) - 1)
        about = F.transform(F.filter("refs", lambda r: (r["from_id"] == item["item_id"]) & (r["ref_type"] == "cdsc")), lambda r: r["to_id"])
        return F.struct(item["item_id"].alias("item_id"), item["item_type"].alias("item_type"), item["name"].alias("name"), item["hidden"].alias("hidden"), last["width"].alias("width"), last["height"].alias("height"), about.alias("describes"))

    return structures.select("path", F.explode(F.transform("items", of)).alias("i")).select("path", "i.*")


def register(spark: SparkSession) -> None:
    """Every table as a function of SQL: ``SELECT t.* FROM files, LATERAL boxes(content) t``.
    Its last column is ``error``: a file that cannot be read is a row with one."""
    from pyspark.sql.functions import udtf

    for name, (parse, schema) in TABLES.items():
        width = len(_parse_datatype_string(schema).fields)

        def eval_(self, content: bytes, parse=parse, columns=name in COLUMNS, width=width):
            try:
                found = list(parse(bytes(content or b"")))
            except Exception as e:  # what is wrong with a file is part of the result
                yield (*[None] * width, f"{type(e).__name__}: {e}")
                return
            rows = (r for block in found for r in zip(*(c.tolist() for c in block))) if columns else found
            for r in rows:
                yield (*(x.tolist() if isinstance(x, np.ndarray) else x for x in r), None)

        spark.udtf.register(f"{name}", udtf(type(f"Table_{name}", (), {"eval": eval_}), returnType=schema + ", error string"))
