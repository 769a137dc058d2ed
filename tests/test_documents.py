"""HTML, JSON and layout readers on small inputs."""

from pyspark.sql import functions as F

from tallyloom.operators import ml
from tallyloom.sources import documents as docs
from tallyloom.sources import files

PAGE = """<html><body><div class="post"><h2><a href="/p/1?x=2">Brew - Ale</a></h2><img class="i" src="/a.png?w=1">
<p>País: Brasil
Tipo: Lager.
Nota: 4.</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table></div></body></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>nothing here</p>"), (3, None)], "id int, html string")
    out = docs.html_fields(
        df,
        "html",
        {
            "name": docs.tag_text("html", "h2"),
            "image": docs.tag_attribute("html", "img", "src"),
            "country": docs.labelled_value(docs.tag_text("html", "p"), "País"),
            "kind": docs.labelled_value(docs.tag_text("html", "p"), "Tipo"),
        },
    )
    rows = {r.id: tuple(r)[1:] for r in out.collect()}
    assert rows[1] == ("Brew - Ale", "/a.png?w=1", "Brasil", "Lager")
    assert rows[2] == rows[3] == (None, None, None, None)


def test_table_cells(spark):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    got = {(r.row_no, r.col_no): r.cell for r in docs.table_cells(df, "html").collect()}
    assert got == {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): "2"}


def test_bad_json_gives_nulls(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 2}}'), (2, "not json")], "id int, j string")
    out = docs.json_rows(df, "j", "a struct<b:int>")
    assert {r.id: r["a.b"] for r in out.collect()} == {1: 2, 2: None}


def test_layouts_are_stacked(spark):
    one = spark.createDataFrame([("x", 1)], "`Município` string, Lat int").withColumnRenamed("Município", "Munic Nome")
    two = spark.createDataFrame([(2, "y")], "latitude int, name string")
    out = files.stack_layouts([one, two], [{"munic_nome": "place", "lat": "latitude"}, {"name": "place"}], ["place", "latitude"])
    assert sorted(out.collect()) == [("x", 1), ("y", 2)]


def test_best_rows_keep_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "k int, accuracy double")
    assert sorted(r.k for r in ml.best_rows(df, "accuracy").collect()) == [2, 3]


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("a  de\n\n que \n")
    assert sorted(r.word for r in files.read_word_list(spark, str(path)).collect()) == ["a", "de", "que"]


def test_mapping_a_track_file(spark, tmp_path):
    path = tmp_path / "ride.gpx"
    path.write_text(
        '<gpx><trk><trkseg><trkpt lat="-22.1" lon="-43.5"><ele>10.5</ele><time>2018-01-01T10:00:00Z</time><hr>120</hr></trkpt>'
        '<trkpt lat="-22.2" lon="-43.6"><ele>11.0</ele><time>2018-01-01T10:00:05Z</time></trkpt></trkseg></trk></gpx>'
    )
    rows = docs.read_track_points(spark, str(path)).orderBy("lat").select("lat", "lon", "alt", F.unix_timestamp("ts"), "hr").collect()
    assert rows == [(-22.2, -43.6, 11.0, 1514800805, None), (-22.1, -43.5, 10.5, 1514800800, 120)]


UNTIDY = """<TABLE border=1><TR><TD>a &amp; b<td CLASS='x'>&eacute;<br>&#65;&nbsp;&lt;i&gt;</TD>
<tr><td><table><tr><td>inner</table> outer</td><th title="a>b">H</th></table><p>Pa&iacute;s: Brasil.<BR/>
Nota: <b>4</b>,5<p>no label<script>x: y</script><!-- c: d --> here:there : z<li>: empty<div>Last: one"""


def test_untidy_pages(spark):
    df = spark.createDataFrame([(1, "k", UNTIDY), (2, None, None), (3, "", "<td>no table</td>"), (4, "x", "")], "id int, cell string, html string")
    got = [tuple(r) for r in docs.table_cells(df.drop("cell"), "html").collect()]
    assert sorted(got) == [
        (1, 0, 0, 0, False, "a & b"), (1, 0, 0, 1, False, "é A <i>"), (1, 0, 1, 0, False, "outer"), (1, 0, 1, 1, True, "H"), (1, 1, 0, 0, False, "inner")
    ]
    lines = {(r.label, r.value) for r in docs.labelled_lines(df, "html").filter("id = 1").collect()}
    assert lines == {("País", "Brasil"), ("Nota", "4,5"), ("no label here:there", "z"), ("Last", "one")}
