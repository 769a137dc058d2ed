"""Small published puzzle examples with known answers (fixed values)."""

from pyspark.sql import functions as F

from tallyloom.functions import columns as fc
from tallyloom.operators import aggregate as ag
from tallyloom.operators import graph as gr
from tallyloom.operators import relational as rel
from tallyloom.operators import reshape as rs
from tallyloom.operators import window as wn
from tallyloom.sources import files

ENTRIES = [1721, 979, 366, 299, 675, 1456]
POLICIES = ["1-3 a: abcde", "1-3 b: cdefg", "2-9 c: ccccccccc"]
SEATS = {"FBFBBFFRLR": 357, "BFFFBBFRRR": 567, "FFFBBBFRRR": 119, "BBFFBBFRLL": 820}
ANSWERS = ["abc", "", "a", "b", "c", "", "ab", "ac", "", "a", "a", "a", "a", "", "b"]
STREAM = [35, 20, 15, 25, 47, 40, 62, 55, 65, 95, 102, 117, 150, 182, 127, 219, 299, 277, 309, 576]
ADAPTERS = {
    "short": ([16, 10, 15, 5, 1, 11, 7, 19, 6, 12, 4], (7, 5), 8),
    "long": (
        [28, 33, 18, 42, 31, 14, 46, 20, 48, 47, 24, 23, 49, 45, 19, 38, 39, 11, 1, 32, 25, 35, 8, 17, 7, 9, 4, 2, 34, 10, 3],
        (22, 10),
        19208,
    ),
}
RULES = [
    "light red bags contain 1 bright white bag, 2 muted yellow bags.",
    "dark orange bags contain 3 bright white bags, 4 muted yellow bags.",
    "bright white bags contain 1 shiny gold bag.",
    "muted yellow bags contain 2 shiny gold bags, 9 faded blue bags.",
    "shiny gold bags contain 1 dark olive bag, 2 vibrant plum bags.",
    "dark olive bags contain 3 faded blue bags, 4 dotted black bags.",
    "vibrant plum bags contain 5 faded blue bags, 6 dotted black bags.",
    "faded blue bags contain no other bags.",
    "dotted black bags contain no other bags.",
]
DEEP_RULES = [
    "shiny gold bags contain 2 dark red bags.",
    "dark red bags contain 2 dark orange bags.",
    "dark orange bags contain 2 dark yellow bags.",
    "dark yellow bags contain 2 dark green bags.",
    "dark green bags contain 2 dark blue bags.",
    "dark blue bags contain 2 dark violet bags.",
    "dark violet bags contain no other bags.",
]


def column(spark, values, name="v", kind="long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} {kind}")


def test_pairs_and_triples_with_a_sum(spark):
    df = column(spark, ENTRIES)
    assert [r.product for r in rel.sum_pairs(df, "v", 2020).collect()] == [514579]
    assert [r.product for r in rel.sum_triples(df, "v", 2020).collect()] == [241861950]


def test_repeated_values_count_as_pairs(spark):
    df = column(spark, [5, 5, 5, 3, 7])
    got = {(r.a, r.b): r.n_pairs for r in rel.sum_pairs(df, "v", 10).collect()}
    assert got == {(5, 5): 3, (3, 7): 1}
    got = {(r.a, r.b, r.c): r.n_triples for r in rel.sum_triples(df, "v", 15).collect()}
    assert got == {(5, 5, 5): 1, (3, 5, 7): 3}


def test_password_policies(spark):
    df = column(spark, POLICIES, "text", "string")
    into = {"lo": "int", "hi": "int", "letter": "string", "password": "string"}
    rows = rs.extract_columns(df, "text", into, r"^(\d+)-(\d+) (.): (.*)$")
    by_count = fc.char_count("password", "letter").between(F.col("lo"), F.col("hi"))
    by_place = fc.exactly_one(fc.char_at_is("password", "lo", "letter"), fc.char_at_is("password", "hi", "letter"))
    assert rows.agg(F.count_if(by_count), F.count_if(by_place)).first() == (2, 1)


def test_seat_codes(spark):
    df = spark.createDataFrame(list(SEATS.items()), "code string, want long")
    out = df.withColumn("got", fc.binary_code("code", zeros="FL", ones="BR"))
    assert out.filter("got <> want").count() == 0


def test_group_answers(spark):
    df = column(spark, ANSWERS, "line", "string").withColumn("one", F.lit(1))
    grouped = files.marker_groups(df, [], ["i"], F.col("line") == "", "grp").filter("line <> ''")
    letters = grouped.select("grp", "i", F.explode(F.split("line", "")).alias("letter")).filter("letter <> ''")
    any_yes = ag.distinct_per_group(letters, ["grp"], "letter", "n").agg(F.sum("n")).first()[0]
    all_yes = ag.held_by_all(letters, "grp", "i", "letter").count()
    assert (any_yes, all_yes) == (11, 6)


def test_passport_checks(spark):
    records = [
        "ecl:gry pid:860033327 eyr:2020 hcl:#fffffd byr:1937 iyr:2017 cid:147 hgt:183cm",
        "iyr:2013 ecl:amb cid:350 eyr:2023 pid:028048884 hcl:#cfa07d byr:1929",
        "hcl:#ae17e1 iyr:2013 eyr:2024 ecl:brn pid:760753108 byr:1931 hgt:179cm",
        "hcl:#cfa07d eyr:2025 pid:166559648 iyr:2011 ecl:brn hgt:59in",
    ]
    keys = ["byr", "iyr", "eyr", "hgt", "hcl", "ecl", "pid"]
    rows = rs.key_value_columns(column(spark, records, "r", "string"), "r", keys)
    present = [r.i for r in rows.na.drop(subset=keys).orderBy("i").collect()]
    assert present == [0, 2]
    ok = (
        fc.in_range("byr", 1920, 2002)
        & fc.range_by_unit("hgt", {"cm": (150, 193), "in": (59, 76)})
        & fc.has_format("hcl", "^#[0-9a-f]{6}$")
        & fc.one_of("ecl", ["amb", "blu", "brn", "gry", "grn", "hzl", "oth"])
        & fc.has_format("pid", "^[0-9]{9}$")
    )
    assert [r.i for r in rows.filter(ok).orderBy("i").collect()] == [0, 2]


def test_rule_graph(spark):
    edges = gr.rule_edges(column(spark, RULES, "text", "string"), "text")
    assert edges.count() == 13
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    gold = spark.createDataFrame([("shiny gold",)], "id string")
    assert gr.reachable(back, gold).count() == 4
    assert gr.contained_totals(edges, gold).first().total == 32
    deep = gr.rule_edges(column(spark, DEEP_RULES, "text", "string"), "text")
    assert gr.contained_totals(deep, gold).first().total == 126


def test_sliding_sums(spark):
    df = column(spark, STREAM).withColumn("s", F.lit("a"))
    bad = wn.not_sum_of_previous(df, ["s"], ["i"], "v", 5).collect()
    assert [r.v for r in bad] == [127]
    runs = wn.runs_with_sum(df, ["s"], ["i"], "v", 127).collect()
    assert [r.min_plus_max for r in runs] == [62]


def test_adapter_chains(spark):
    for values, (ones, threes), ways in ADAPTERS.values():
        chain = [0, *values, max(values) + 3]
        df = column(spark, chain).withColumn("s", F.lit("a"))
        steps = wn.differences(df, ["s"], ["v"], "v")
        got = steps.agg(F.count_if(F.col("diff") == 1), F.count_if(F.col("diff") == 3)).first()
        assert got == (ones, threes)
        for chunk in (10_000, 4):
            out = wn.chain_arrangements(df, ["s"], "v", chunk_rows=chunk).first()
            assert out.arrangements == ways


def test_missing_id_between_neighbours(spark):
    df = spark.createDataFrame([(i,) for i in (4, 5, 7, 8, 11)], "id long")
    assert sorted(r.id for r in rel.missing_ids(df, "id", chunk=3).collect()) == [6, 9, 10]


def test_degrees_and_numbers_in_text(spark):
    rows = [("3°30'0\"S", -3.5), ("10°0'36\"N", 10.01), ("-7.25", -7.25), ("??", None)]
    df = spark.createDataFrame(rows, "t string, want double")
    got = df.select("want", fc.dms_to_degrees("t").alias("got")).collect()
    assert all(r.got == r.want or abs(r.got - r.want) < 1e-9 for r in got)
    one = spark.createDataFrame([("6,5%", "$1,234.5", "8.5")], "p string, n string, i string")
    out = one.select(fc.parse_percent("p"), fc.parse_number("n"), fc.to_int_truncating("i")).first()
    assert abs(out[0] - 0.065) < 1e-12 and out[1] == 1234.5 and out[2] == 8
