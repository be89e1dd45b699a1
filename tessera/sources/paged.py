"""Features of a paged web service as a Spark data source.

The service says how many features it has, and gives them by offset in a stable order; each page
is a partition, fetched by the task that reads it. A page is asked for again when the service
fails, and one that is shorter than the count says is an error, not a smaller table.

    spark.dataSource.register(PagedFeatures)
    spark.read.format("features").schema("FHSZ long, geometry string").option("url", url).load()

The schema names the properties to ask for; ``geometry`` is the feature's geometry as GeoJSON.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

PAGE = 2000


@dataclass
class Page(InputPartition):
    offset: int
    size: int


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.url = schema, options["url"]
        self.page, self.tries = int(options.get("page", PAGE)), int(options.get("tries", 5))
        self.wait, self.timeout = float(options.get("wait", 1.0)), float(options.get("timeout", 240))
        self.order, self.where, self.system = options.get("order", "OBJECTID"), options.get("where", "1=1"), options.get("system", "4326")

    def _ask(self, **params) -> dict:
        """The service's answer; tried again, after twice the time each time, when it fails or says so itself."""
        address = f"{self.url}?{urllib.parse.urlencode({'where': self.where} | params)}"
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(address, timeout=self.timeout) as response:
                    found = json.load(response)
                if isinstance(found, dict) and "error" not in found:
                    return found
                trouble: Exception = ValueError(f"the service answers {str(found)[:200]}")
            except urllib.error.HTTPError as error:
                if error.code < 500 and error.code not in (408, 429):
                    raise
                trouble = error
            except (urllib.error.URLError, TimeoutError, ConnectionError, ValueError) as error:
                trouble = error
            if k + 1 < self.tries:
                time.sleep(self.wait * 2**k)
        raise RuntimeError(f"no answer after {self.tries} tries: {address}") from trouble

    def partitions(self) -> list[Page]:
        count = int(self._ask(returnCountOnly="true", f="json")["count"])
        return [Page(at, min(self.page, count - at)) for at in range(0, count, self.page)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks so of a table without partitions
            return
        names = [f.name for f in self.schema if f.name != "geometry"]
        shape = "geometry" in self.schema.names
        found = self._ask(outFields=",".join(names) or self.order, returnGeometry=str(shape).lower(), outSR=self.system, f="geojson", resultOffset=partition.offset, resultRecordCount=partition.size, orderByFields=self.order)
        features = found.get("features", [])
        if len(features) != partition.size:
            raise RuntimeError(f"{len(features)} features at {partition.offset}, where the count says {partition.size}")
        for feature in features:
            own = feature.get("properties") or {}
            yield tuple(_as(feature.get("geometry") if f.name == "geometry" else own.get(f.name), f.dataType) for f in self.schema)


def _as(value, kind):
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    return {LongType: int, DoubleType: float, BooleanType: bool}[type(kind)](value)


class PagedFeatures(DataSource):
    """``spark.read.format("features")`` with the options ``url``, ``page``, ``order``, ``where``, ``system``, ``tries``, ``wait`` and ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "geometry string"

    def reader(self, schema: StructType) -> Reader:
        odd = [f.name for f in schema if type(f.dataType) not in (StringType, LongType, DoubleType, BooleanType)]
        if odd:
            raise ValueError(f"columns are strings, longs, doubles or booleans, not {', '.join(odd)}")
        return Reader(schema, dict(self.options))
