"""Readers for XML tracks, nested JSON and HTML pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TRACK_SCHEMA = "_lat double, _lon double, ele double, time timestamp, hr int, track long"


def read_track_points(
    spark: SparkSession, path: str, schema: str = TRACK_SCHEMA, row_tag: str = "trkpt"
) -> DataFrame:
    """Track points from XML files; values come from attributes and children."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.withColumnsRenamed(
        {"_lat": "lat", "_lon": "lon", "ele": "alt", "time": "ts"}
    )


TCX_SCHEMA = """_Sport string, Id timestamp, Lap array<struct<_StartTime: timestamp, Track: array<struct<Trackpoint: array<struct<
  Time: timestamp, Position: struct<LatitudeDegrees: double, LongitudeDegrees: double>, AltitudeMeters: double, DistanceMeters: double,
  HeartRateBpm: struct<Value: int>>>>>>>"""


def read_tcx_points(spark: SparkSession, path: str) -> DataFrame:
    """Track points of TCX files: activity, sport, lap, track and point numbers from 0, ts, lat, lon, alt, dist, hr.

    Laps hold tracks and tracks hold points; what a point lacks is NULL.
    """
    activities = spark.read.format("xml").option("rowTag", "Activity").schema(TCX_SCHEMA).load(path)
    laps = activities.select(F.col("Id").alias("activity"), F.col("_Sport").alias("sport"), F.posexplode("Lap").alias("lap", "__l"))
    tracks = laps.select("activity", "sport", "lap", F.posexplode("__l.Track").alias("track", "__t"))
    points = tracks.select("activity", "sport", "lap", "track", F.posexplode("__t.Trackpoint").alias("point", "p"))
    return points.select(
        "activity", "sport", "lap", "track", "point", F.col("p.Time").alias("ts"), F.col("p.Position.LatitudeDegrees").alias("lat"),
        F.col("p.Position.LongitudeDegrees").alias("lon"), F.col("p.AltitudeMeters").alias("alt"), F.col("p.DistanceMeters").alias("dist"),
        F.col("p.HeartRateBpm.Value").alias("hr"),
    )


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns named ``outer.inner``."""

    def leaves(prefix: Column | None, name: str, field_type: T.DataType):
        if isinstance(field_type, T.StructType):
            for f in field_type.fields:
                yield from leaves(prefix[f.name], f"{name}{sep}{f.name}", f.dataType)
        else:
            yield prefix.alias(name)

    cols = []
    for f in df.schema.fields:
        cols.extend(leaves(F.col(f"`{f.name}`"), f.name, f.dataType))
    return df.select(*cols)


def json_rows(
    df: DataFrame, column: str, schema: str, array_field: str | None = None
) -> DataFrame:
    """Parse a JSON text column; an array field becomes one row per element.

    Text that is not valid JSON gives NULL fields and never stops the job.
    """
    parsed = df.withColumn("__j", F.from_json(column, schema)).drop(column)
    if array_field is None:
        return flatten_structs(parsed.select(*parsed.columns[:-1], "__j.*"))
    rest = [c for c in parsed.select("__j.*").columns if c != array_field]
    rows = parsed.select(
        *parsed.columns[:-1],
        *[F.col("__j")[c].alias(c) for c in rest],
        F.explode_outer(F.col("__j")[array_field]).alias(array_field),
    )
    return flatten_structs(rows)


# --- HTML -------------------------------------------------------------------

TAG = r"(?s)<[^>]*>"


def tag_text(html: str | Column, tag: str) -> Column:
    """Text of the first element with this tag, NULL when there is none."""
    html = F.col(html) if isinstance(html, str) else html
    pattern = rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"
    inner = F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))
    return F.trim(F.regexp_replace(inner, TAG, ""))


def tag_attribute(html: str | Column, tag: str, attribute: str) -> Column:
    """Attribute of the first such element, NULL when there is none."""
    html = F.col(html) if isinstance(html, str) else html
    pattern = rf'<{tag} [^>]*?{attribute}="([^"]*)"'
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def tag_attributes(html: str | Column, tag: str, attribute: str) -> Column:
    """That attribute of all such elements, as an array."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(html, F.lit(rf'<{tag} [^>]*?{attribute}="([^"]*)"'), 1)


def visible_text(html: str | Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    html = F.col(html) if isinstance(html, str) else html
    for hidden in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, hidden, " ")
    spaced = F.regexp_replace(F.regexp_replace(html, TAG, " "), r"[ \t\r\n]+", " ")
    return F.trim(spaced)


def labelled_value(text: str | Column, label: str) -> Column:
    """Value of a ``label: value`` line, final full stops removed."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = rf"(?m)^\s*{label}: *(.*?)\.*\s*$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def html_fields(df: DataFrame, html: str, fields: Mapping[str, Column]) -> DataFrame:
    """Replace the page by its extracted fields; missing fields are NULL."""
    return df.select(*[c for c in df.columns if c != html], *[v.alias(k) for k, v in fields.items()])


class _Page(HTMLParser):
    """Table cells and lines of one page, however its tags are written.

    Text belongs to the innermost open cell; a new cell, row or table end closes
    what HTML lets stay open. Lines end where block elements do. Entities are
    read, scripts, styles and comments are not.
    """

    # Elements that start a new line, and those without visible text.
    BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
    HIDDEN = frozenset(["script", "style", "template", "noscript"])

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, bool, str]] = []
        self.lines: list[str] = []
        self._text: list[str] = []
        self._tables: list[dict] = []
        self._n_tables, self._hidden = 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self._hidden += 1
        if tag in self.BLOCKS:
            self._end_line()
            if self._tables and self._tables[-1]["cell"] is not None:
                self._tables[-1]["cell"].append(" ")
        if tag == "table":
            self._tables.append({"no": self._n_tables, "row": -1, "col": -1, "cell": None, "header": False})
            self._n_tables += 1
        elif self._tables:
            t = self._tables[-1]
            if tag in ("tr", "td", "th"):
                self._end_cell(t)
            if tag == "tr":
                t["row"], t["col"] = t["row"] + 1, -1
            elif tag in ("td", "th"):
                t["row"], t["col"], t["cell"], t["header"] = max(t["row"], 0), t["col"] + 1, [], tag == "th"

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        if tag in self.BLOCKS:
            self._end_line()
        if self._tables and tag in ("td", "th", "tr", "table"):
            self._end_cell(self._tables[-1])
            if tag == "table":
                self._tables.pop()

    def handle_data(self, data):
        if self._hidden:
            return
        self._text.append(data)
        if self._tables and self._tables[-1]["cell"] is not None:
            self._tables[-1]["cell"].append(data)

    def _end_cell(self, t: dict) -> None:
        if t["cell"] is not None:
            self.cells.append((t["no"], t["row"], t["col"], t["header"], " ".join("".join(t["cell"]).split())))
            t["cell"] = None

    def _end_line(self) -> None:
        for line in "".join(self._text).split("\n"):
            if line := " ".join(line.split()):
                self.lines.append(line)
        self._text = []

    def read(self, html: str) -> _Page:
        self.feed(html)
        self.close()
        self._end_line()
        while self._tables:
            self._end_cell(self._tables.pop())
        return self


def _per_page(df: DataFrame, html: str, find: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """The other columns of each page, repeated for what ``find`` returns; NULL pages give no rows."""
    keep = [c for c in df.columns if c != html]
    fields = T._parse_datatype_string(schema)
    kinds = to_arrow_schema(fields)

    def per_batch(batches):
        for b in batches:
            found = [find(page) if page is not None else [] for page in b.column(html).to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [x for rows in found for x in rows]
            new = [pa.array([x[i] for x in flat], kinds.field(i).type) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *new], names=[*keep, *kinds.names])

    out = T.StructType([df.schema[c] for c in keep] + fields.fields)
    return df.select(*keep, html).mapInArrow(per_batch, out)


def table_cells(df: DataFrame, html: str) -> DataFrame:
    """Cells of every HTML table as rows (table_no, row_no, col_no from 0, header, cell), nested tables as tables of their own."""
    return _per_page(df, html, lambda page: _Page().read(page).cells, "table_no int, row_no int, col_no int, header boolean, cell string")


def labelled_lines(df: DataFrame, html: str) -> DataFrame:
    """The ``label: value`` lines of every page as rows (line_no among its lines, label, value), final full stops removed."""

    def find(page: str) -> list[tuple]:
        parts = [(i, line.partition(": ")) for i, line in enumerate(_Page().read(page).lines)]
        return [(i, label.strip(), value.strip().rstrip(".")) for i, (label, colon, value) in parts if colon and label.strip()]

    return _per_page(df, html, find, "line_no int, label string, value string")
