"""A Spark data source for cached GeoJSON files: spark.read.format("geojson").load(path).

The path is a folder, a file, or a pattern in its last part; it may carry the scheme of any store that pyarrow opens
(hdfs://, s3://, file://). A path without a scheme must be a folder that all executors see.
"""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class GeoJson(DataSource):
    @classmethod
    def name(cls):
        return "geojson"

    def schema(self):
        return "file string, kind string, properties string, coordinates array<array<array<array<double>>>>"

    def reader(self, schema):
        return GeoJsonReader(self.options["path"])


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class GeoJsonReader(DataSourceReader):
    """One partition a file; features are yielded one at a time."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, at = _store(self.path)
        folder, _, last = at.rstrip("/").rpartition("/")
        if "*" not in last and store.get_file_info(at).type == fs.FileType.Directory:
            folder, last = at, "*.geojson"
        found = store.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
        return [FilePartition(f) for f in sorted(x.path for x in found if x.is_file and fnmatch(x.base_name, last))]

    def read(self, partition):
        if partition is None:  # no file
            return
        with _store(self.path)[0].open_input_stream(partition.path) as fh:
            features = json.loads(fh.read()).get("features", [])
        wrap = {"Polygon": 1, "MultiPolygon": 0, "LineString": 2, "MultiLineString": 1}
        for f in features:
            g = f.get("geometry") or {}
            if g.get("type") not in wrap:
                continue
            c = g["coordinates"]
            for _ in range(wrap[g["type"]]):
                c = [c]
            yield partition.path.rpartition("/")[2], g["type"], json.dumps(f.get("properties") or {}, sort_keys=True), _floats(c)


def _floats(x):
    return [_floats(i) for i in x] if isinstance(x, list) else float(x)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoJson)
