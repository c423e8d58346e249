import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.operators import category_tree, voting
from rankdraft.operators import lookups as L
from rankdraft.operators import ordered as O


def pairs(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_numbers_equal_a_global_window(spark):
    rows = spark.range(0, 5000, 7).select(
        (F.col("id") * 13 % 5003).alias("seq"), (F.col("id") % 3 == 0).alias("wanted")
    )
    ordered = O.in_order(rows.repartition(11))
    got = O.number_rows(ordered, F.col("wanted"), "n").select("seq", "n")
    whole = rows.where("wanted").select("seq", F.row_number().over(Window.orderBy("seq")).alias("n"))
    assert pairs(got) == pairs(whole)
    assert O.number_rows(ordered, F.lit(False), "n").count() == 0


def test_stop_is_the_earliest_limit(spark):
    articles = spark.createDataFrame([(3, 1), (5, 2), (8, 3)], "seq bigint, n bigint")
    good = spark.createDataFrame([(5, 1, "a"), (8, 2, "ab")], "seq bigint, success_no bigint, title string")
    stop = lambda **kw: O.stop_after(articles, good, JobConfig(**kw))
    assert stop() is None
    assert stop(max_arts=2) == 5
    assert stop(max_arts=9) is None
    assert stop(max_stage=2, max_arts=3) == 8
    assert stop(partial=True, endpoint="b") == 8
    assert stop(partial=True, endpoint="") == 5


def test_startpoint(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bx"), (3, "a")], "seq bigint, title string")
    start = lambda point: O.from_startpoint(rows, F.col("title"), point).count()
    assert (start("x"), start(""), start("z")) == (2, 3, 0)


def test_join_back_spreads_hot_titles(spark):
    targets = spark.range(1000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("title"),
    )
    titles = L.distinct_titles(targets).withColumn("value", F.length("title"))
    joined = L.join_back(targets, titles.where("title <> 't1'"), hot_rows=100, salts=4)
    assert joined.count() == 1000
    assert joined.where("value IS NULL").count() == 1
    assert joined.where("title = 'hot' AND value = 3").count() == 334
    assert set(joined.columns) == {"seq", "title", "value"}


def test_taxonomy_lookup_is_the_same_both_ways(spark):
    pages = spark.range(500).select(
        F.concat(F.lit("p"), "id").alias("title"),
        F.when(F.col("id") % 2 == 0, "Template:Taxonomy/Hot")
        .when(F.col("id") % 5 == 0, None)
        .otherwise(F.concat(F.lit("Template:Taxonomy/T"), (F.col("id") % 9)))
        .alias("autobox_key"),
    )
    taxonomy = spark.createDataFrame(
        [
            ("Template:Taxonomy/Hot", "{{T|rank = genus|extinct = yes}}"),
            ("Template:Taxonomy/T1", "{{T|rank = ordo|x}}"),
            ("Template:Taxonomy/T3", "{{T|rank = odd|x}}"),
        ],
        "title string, text string",
    )
    columns = ["title", "rank_autobox", "autobox_extinct"]
    broadcast = pairs(L.lookup_taxonomy(pages, taxonomy).select(columns).fillna("-"))
    salted = pairs(L.lookup_taxonomy(pages, taxonomy, broadcast_bytes=0).select(columns).fillna("-"))
    assert broadcast == salted and len(salted) == 500
    assert ("p0", "Genus", True) in salted and ("p3", "-", False) in salted


def test_category_signals_ignore_hidden(spark):
    rows = [
        ("a", "Category:X Genera", False),
        ("a", "Category:Fossil x", True),
        ("b", "Category:Prehistoric x", False),
        ("c", "Category:Plain", False),
    ]
    table = spark.createDataFrame(rows, "title string, category string, hidden boolean")
    got = {r["title"]: (r["rank_category"], r["category_extinct"]) for r in L.category_signals(table).collect()}
    assert got == {"a": ("Genus", False), "b": (None, True)}


LINKS = [
    ("root", "a", 14),
    ("a", "b", 14),
    ("b", "root", 14),
    ("a", "a", 14),
    ("root", "p1", 0),
    ("b", "p2", 0),
    ("b", "p1", 0),
    ("other", "p3", 0),
    ("b", "talk", 1),
]


def test_category_tree(spark):
    links = spark.createDataFrame(LINKS, "parent string, child string, child_ns int")
    members = lambda *a, **kw: [r[0] for r in pairs(category_tree.category_members(links, *a, **kw))]
    assert members("root") == ["p1", "p2"]
    assert members("root", recurse=False) == ["p1"]
    assert members("root", broadcast_bytes=0) == ["p1", "p2"]
    assert members("none") == []
    targets = category_tree.targets_from_category(links, "root").orderBy("seq").collect()
    assert [r["raw_title"] for r in targets] == ["p1", "p2"]


def test_children_of_many_parents_is_the_same_both_ways(spark):
    links = spark.range(2000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 50) END AS parent",
        "concat('x', id) AS child",
    )
    parents = spark.createDataFrame([("hot",), ("c7",)], "category string")
    few = category_tree.children_of(links, parents)
    many = category_tree.children_of(links, parents, broadcast_bytes=1)
    assert pairs(few) == pairs(many) and few.count() > 600


def test_modes_by_rows(spark):
    rows = spark.createDataFrame(
        [("a", "x", "y", "x"), ("b", "x", "y", None), ("c", None, None, None)],
        "title string, r1 string, r2 string, r3 string",
    )
    assert pairs(voting.modes_by_rows(rows, ["r1", "r2", "r3"])) == [
        ("a", "x", 2),
        ("b", "x", 1),
        ("b", "y", 1),
    ]


def test_props_from_json(spark):
    body = [
        ('{"query":{"pages":{"5":{"title":"A","pageprops":{"wikibase-shortdesc":"d"}}}}}',),
        ('{"query":{"pages":{"-1":{"title":"B"}}}}',),
    ]
    got = L.page_props_from_json(spark.createDataFrame(body, "response string"))
    assert [tuple(r) for r in got.orderBy("title").collect()] == [("A", "d"), ("B", None)]


def test_categories_stay_rows(spark):
    table = spark.createDataFrame(
        [("a", f"Category:{i}", False) for i in range(300)] + [("b", "Category:x", True)],
        "title string, category string, hidden boolean",
    )
    titles = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "title string")
    got = L.lookup_categories(titles, table)
    assert got.where("title = 'a'").count() == 300
    assert sorted(r["title"] for r in got.where("category IS NULL").collect()) == ["b", "c"]


def test_broadcast_size_counts_strings(spark):
    from rankdraft.session import ROW_BYTES, fits_broadcast, table_bytes

    table = spark.createDataFrame([("abé", 1), (None, 2)], "a string, b int")
    assert table_bytes(table) == 4 + 2 * ROW_BYTES
    assert fits_broadcast(table) and not fits_broadcast(table, 100)
    assert table_bytes(table.where("b > 5")) == 0


def test_ranges_of_a_list_hold_what_is_made_of_its_rows(spark):
    rows = spark.createDataFrame([(i * 7 % 500, i) for i in range(500)], "seq long, x int")
    listed = O.ranged(rows.select("seq"))
    made = listed.join(rows.repartition(5), "seq").withColumn("y", F.col("x") + 1)
    ordered = O.in_ranges(made)
    parts = ordered.withColumn("part", F.spark_partition_id()).collect()
    assert [r.seq for r in parts] == list(range(500))
    assert [r.part for r in parts] == sorted(r.part for r in parts) and parts[-1].part > 0
    numbers = O.number_rows(ordered, F.col("seq") % 2 == 0, "n").collect()
    assert {r.seq: r.n for r in numbers} == {2 * i: i + 1 for i in range(250)}


def test_long_chains_and_cycles_of_categories(spark):
    draw = random.Random(4)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    edges += [(f"c{draw.randrange(21)}", f"c{draw.randrange(21)}") for _ in range(10)]
    edges += [("c0", "d0"), ("d0", "c0"), ("x0", "x1"), ("c20", None)]
    children = {}
    for parent, child in edges:
        children.setdefault(parent, set()).add(child)
    expected, open_ones = set(), {"c3"}
    while open_ones:
        expected |= open_ones
        open_ones = set().union(*(children.get(c, ()) for c in open_ones)) - expected
    links = spark.createDataFrame(
        [(*e, category_tree.CATEGORY) for e in edges], "parent string, child string, child_ns int"
    )
    found = [r[0] for r in category_tree.category_closure(links, "c3").collect()]
    assert len(found) == len(set(found)) and set(found) - {None} == expected - {None}


def test_levels_are_merged(spark):
    n = 20
    links = spark.createDataFrame(
        [(f"c{i}", f"c{i + 1}", category_tree.CATEGORY) for i in range(n)],
        "parent string, child string, child_ns int",
    )
    found = category_tree.category_closure(links, "c0")
    assert found.count() == n + 1
    # 21 levels are two tables of 8 levels and five of one.
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 7
