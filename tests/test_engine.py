import datetime

import pytest
from pyspark.sql import functions as F

import tessera.metagraph as G
from tessera import metrics as M
from tessera import operators as O
from tessera import sources as S
from tessera.answer import answer
from tessera.clarify import clarify, detect, grounding
from tessera.functions import measures as N
from tessera.functions import text as X
from tessera.history import EDGES, OPERATORS, History, executions, recent_accuracy
from tessera.planner import ABLATIONS, Planner, PlannerOptions
from tessera.plans.bind import Schema
from tessera.plans.compile import Run, compile_plan
from tessera.plans.tables import OPERATORS as OPS
from tessera.plans.tree import PlanNode
from tessera.provider import CallableProvider, OfflineProvider

MOVIES = [(1, "Dawn", 1999, 8.1, "Drama", "a good and happy tale"), (2, "Dusk", 2005, 6.0, "Drama", "an awful bore"), (3, "Noon", 2011, 9.0, "Comedy", "great, the best"), (4, "Night", 2015, None, "Horror", None), (5, "Eve", 2015, 7.5, "Comedy", "neither here nor there")]


@pytest.fixture(scope="module")
def movies(spark):
    return spark.createDataFrame(MOVIES, "id int, title string, year int, rating double, genre string, review string")


@pytest.fixture(scope="module")
def planner(spark, movies):
    shops = spark.createDataFrame([(1, 1, 3.5), (2, 1, 4.0), (3, 3, 1.0)], "sale int, movie int, price double")
    return Planner(S.Catalog(spark, {"movies": movies, "sales": shops}), links=[("sales", "movie", "movies", "id")], options=PlannerOptions(observe=True))


@pytest.mark.parametrize(
    ("question", "text"),
    [
        ("How many movies have rating above 7?", "Count: 3"),
        ("What is the average rating of movies with genre 'Drama'?", "Average rating: 7.05"),
        ("total price of sales", "Total price: 8.5"),
        ("maximum year of movies", "Maximum year: 2015"),
        ("count movies with rating between 6 and 8.1", "Count: 1"),
        ("count sales joined with movies where rating is above 8.5", "Count: 1"),
        ("Filter movies where rating is above 99", "No results found for: Filter movies where rating is above 99"),
    ],
)
def test_answers(planner, question, text):
    got = planner.ask(question)
    assert got.text == text and got.rows


def test_top_and_groups(planner):
    assert [r["title"] for r in planner.data("top 2 movies by rating").collect()] == ["Noon", "Dawn"]
    assert {(r["genre"], r["count"]) for r in planner.data("count movies per genre").collect()} == {("Drama", 2), ("Comedy", 2), ("Horror", 1)}
    text = planner.ask("List the distinct genre of movies").text
    assert text.startswith("Found 3 results:") and "genre=Horror" in text


@pytest.mark.parametrize("ablation", ABLATIONS)
def test_ablations(planner, ablation):
    p = Planner(planner.catalog, links=planner.schema.links, options=PlannerOptions(ablation=ablation))
    got = p.ask("How many movies have rating above 7?")
    if ablation != "no-grammar":
        assert got.text == "Count: 3"
    assert set(got.planned.seconds) == {"parse", "search", "uncertainty", "physical", "bind"}


def test_every_operator_compiles(spark, movies):
    run = Run(S.Catalog(spark, {"movies": movies, "vectors": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id int, v array<double>")}))
    m, v = PlanNode("SCAN", {"table": "movies"}), PlanNode("SCAN", {"table": "vectors"})
    trees = {
        "SCAN": m, "FILTER": PlanNode("FILTER", {"conditions": [("year", ">", 2000)], "semantic": "great"}, (m,)), "PROJECT": PlanNode("PROJECT", {"columns": ["title"]}, (m,)), "AGGREGATE": PlanNode("AGGREGATE", {}, (m,)),
        "SORT": PlanNode("SORT", {"keys": [("year", True)]}, (m,)), "LIMIT": PlanNode("LIMIT", {"n": 2}, (m,)), "DISTINCT": PlanNode("DISTINCT", {"columns": ["genre"]}, (m,)), "JOIN": PlanNode("JOIN", {}, (m, v)), "UNION": PlanNode("UNION", {}, (m, m)),
        "SEMANTIC_SEARCH": PlanNode("SEMANTIC_SEARCH", {"question": "a happy tale"}, (m,)), "CROSS_MODAL_MATCH": PlanNode("CROSS_MODAL_MATCH", {"words": 2}, (m, m)), "CONTENT_EXTRACT": PlanNode("CONTENT_EXTRACT", {}, (m,)),
        "SIMILARITY_JOIN": PlanNode("SIMILARITY_JOIN", {"threshold": 0.9}, (v, v)), "FEATURE_TRANSFORM": PlanNode("FEATURE_TRANSFORM", {}, (m,)), "VISUALIZE": PlanNode("VISUALIZE", {}, (m,)), "EXPORT": PlanNode("EXPORT", {"format": "csv"}, (m,)),
    }
    want = {"SCAN": 5, "FILTER": 1, "PROJECT": 5, "AGGREGATE": 1, "SORT": 5, "LIMIT": 2, "DISTINCT": 3, "JOIN": 3, "UNION": 10, "SEMANTIC_SEARCH": 1, "CROSS_MODAL_MATCH": 4, "CONTENT_EXTRACT": 5, "SIMILARITY_JOIN": 1, "FEATURE_TRANSFORM": 5, "VISUALIZE": 3, "EXPORT": 5}
    assert set(trees) == set(OPS)
    assert {k: compile_plan(t, run).count() for k, t in trees.items()} == want
    with pytest.raises(ValueError):
        compile_plan(PlanNode("NOPE"), run)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("t", F.lit("x")).write.parquet(str(tmp_path / "p"))
    df = O.project(O.keep(spark.read.parquet(str(tmp_path / "p")), [("id", ">", 50)]), ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k int, n string"), spark.createDataFrame([(1, "p"), (None, "q"), (2, "r")], "k int, n string")
    assert {(r["k"], r["n"]) for r in O.join(a, b, [("k", "k")]).collect()} == {(1, "p"), (None, "q")}
    assert O.join(a.select("k"), b.select("n")).count() == 6 and O.join(a, b.limit(0), [("k", "k")]).count() == 0
    assert O.join(a, b, [("k", "k")], hint="shuffle_hash").count() == 2
    with pytest.raises(ValueError):
        O.union(a)
    assert O.union(a, b.drop("n")).filter("n is null").count() == 3


def test_semantic(movies):
    assert [r["id"] for r in O.semantic_filter(movies, "review", "mentions great").collect()] == [3]
    assert {r["id"]: r["category"] for r in O.labelled(movies, "review", ("positive", "negative", "neutral"), keep_unknown=True).collect()} == {1: "positive", 2: "negative", 3: "positive", 4: None, 5: "neutral"}
    assert O.labelled(movies, "review", ("positive",)).count() == 2 and O.text_column(movies) == "review"
    assert O.text_search(movies, "review", "happy tale", 1, "id").first()["id"] == 1
    assert O.semantic_filter(movies, "review", "great", votes=3).count() == 1
    assert [r["review"] for r in O.rated(movies, "review", "happy").orderBy("id").collect()][0] == MOVIES[0][5]


def test_providers():
    p = CallableProvider(lambda prompt: "YES" if "good" in prompt else "no idea")
    assert p.holds(["good", "x", None], "c") == [True, False, None] and p.label(["a"], ["q", "idea"]) == ["idea"] and p.score(["x"], "q") == [None]
    calls = []

    def flaky(prompt):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "0.5"

    assert CallableProvider(flaky).score(["x"], "q") == [0.5]
    with pytest.raises(NotImplementedError):
        OfflineProvider().complete("x")
    assert OfflineProvider().holds(["anything"], "of the") == [False]


def test_providers_are_asked_about_whole_texts():
    late = "word " * 20_000 + "needle"
    p = CallableProvider(lambda prompt: ("YES" if "Answer YES" in prompt else "red" if "Choose" in prompt else "1") if "needle" in prompt else "NO blue 0")
    assert p.holds([late], "q") == [True] and p.label([late], ["blue", "red"]) == ["red"] and p.score([late], "q") == [1.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("One two. Three four five. Six.", "a 1,234.5 and -7"), (None, None), ("", "")], "t string, n string")
    got = df.select(X.word_windows(F.col("t"), 4).alias("w"), X.word_count(F.col("t")).alias("c"), X.numbers(F.col("n")).alias("n"), X.ngrams(X.tokens(F.col("t")), 2).alias("g")).collect()
    assert got[0]["w"] == ["One two. Three four five.", "Six."] and got[0]["c"] == 6 and got[0]["n"] == [1234.5, -7.0] and got[0]["g"][:2] == ["one two", "two three"]
    assert got[1]["c"] == 0 and got[2]["w"] == [] and got[2]["g"] == []


def test_measures(spark):
    t = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(t, t + datetime.timedelta(days=10), t + datetime.timedelta(days=5), t + datetime.timedelta(days=15), "in March", "Paris, France", "paris")], "a timestamp, b timestamp, c timestamp, d timestamp, e string, p string, q string")
    r = df.select(N.time_share(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s"), N.nearness(F.col("a"), F.col("c")).alias("n"), N.time_expression(F.col("e")).alias("e"), N.place_similarity(F.array("p"), F.array("q")).alias("p"), N.numeric_score(F.lit(11.0), F.lit(10.0)).alias("x"), N.numeric_score(F.lit(20.0), F.lit(10.0)).alias("y"), N.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"), N.kilometres(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("k")).first()
    assert r["s"] == pytest.approx(1 / 3) and r["n"] == 0.6 and r["e"] == "month_03" and r["p"] == 0.5 and r["x"] == pytest.approx(1 / 1.1) and r["y"] == 0 and r["j"] == 0.5 and r["k"] == pytest.approx(111.195, abs=0.01)


def test_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, a boolean")
    assert list(M.precision_recall(df, F.col("p"), F.col("a")).first()) == [0.5] * 4
    empty = df.filter("false")
    assert M.set_scores(spark.range(0), spark.range(0), "id", empty=1.0).first()["f1"] == 1.0 and M.set_scores(spark.range(0), spark.range(0), "id").first()["f1"] == 0.0
    assert M.pearson(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double"), "a", "b").first()[0] == 0.0 and empty.count() == 0
    assert M.t95(1) == 12.706 and M.t95(12) == 2.228 and M.t95(100) == 1.96 and M.diversity([{"a"}, {"b"}]) == 1.0
    assert M.answered("Count: 3", [], "3") and M.answered("x", [{"t": "Dawn"}], "dawn") and not M.answered("Count: 13", [], "3")


def test_sources(spark, movies, tmp_path):
    for fmt in ("parquet", "csv", "json", "orc"):
        S.write(movies, f"{tmp_path}/{fmt}", fmt)
    ddl = "id int, title string, year int, rating double, genre string, review string"
    for got in (S.parquet(spark, f"{tmp_path}/parquet"), S.csv(spark, f"{tmp_path}/csv", ddl), S.json(spark, f"{tmp_path}/json", ddl), spark.read.orc(f"{tmp_path}/orc")):
        assert sorted(map(tuple, got.select(*movies.columns).collect())) == sorted(map(tuple, movies.collect()))
    assert S.parquet(spark, f"{tmp_path}/parquet", ["id"], 2).count() == 2
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "cat_1.png").write_bytes(b"\1\2")
    r = S.images(spark, f"{tmp_path}/img/*.png", r"/(\w+)_\d").first()
    assert r["label"] == "cat" and bytes(r["content"]) == b"\1\2"
    S.write(movies.withColumn("image", F.lit("x")), f"{tmp_path}/gold", "csv")
    assert "image" not in S.gold(spark, f"{tmp_path}/gold").columns
    assert [r["id"] for r in S.seeded_sample(movies, "id", 3, 1).collect()] == [r["id"] for r in S.seeded_sample(movies.repartition(3), "id", 3, 1).collect()]


def test_relational(spark, movies):
    assert O.numeric_columns(movies.withColumn("b", F.lit(True))) == ["id", "year", "rating"]
    got = {(r["column"], r["value"], r["rank"]) for r in O.frequent_values(movies, ["genre", "id"]).collect()}
    assert ("genre", "Comedy", 1) in got and ("genre", "Drama", 2) in got
    assert O.compact(movies.withColumn("poster", F.lit("x")).withColumn("bytes", F.lit(b"1"))).columns == movies.columns
    assert O.distinct(spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},)], "m map<string,int>")).count() == 1
    pts = spark.createDataFrame([(x, (x * 7919) % 101) for x in range(100)], "x int, y int")
    rows = [(r["x"], r["y"]) for r in pts.collect()]
    want = {p for p in rows if not any(q[0] <= p[0] and q[1] >= p[1] and q != p for q in rows)}
    assert {tuple(r) for r in O.pareto_2d(pts, "x", "y").collect()} == want
    assert O.manifest(movies, "json").first()["rows"] == 5 and O.column_stats(movies.select("title")).first()["column"] is None


def test_similarity_join_recall(spark):
    import math
    import random

    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(base + [[x + rng.gauss(0, 0.15) for x in v] for v in base])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and cos(a, b) >= 0.9}
    got = {(r["left_id"], r["right_id"]) for r in O.similarity_join(df, df, "id", "id", "v", 0.9, same=True).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) >= 60
    assert {(r["left_id"], r["right_id"]) for r in O.similarity_join(df, df, "id", "id", "v", 0.9, same=True, miss=0).collect()} == want


def test_graph(spark, movies):
    p = {r["column"]: r for r in G.profile({"movies": movies}, exact=True).collect()}
    assert p["id"]["is_key"] and not p["genre"]["is_key"] and p["rating"]["nulls"] == 1
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "source string, target string")
    assert {(r["node"], r["distance"]) for r in G.within_hops(e, "a", 2).collect()} == {("b", 1), ("c", 1)}
    assert sorted(tuple(r["path"]) for r in G.simple_paths(e, "a", "c").collect()) == [("a", "b", "c"), ("a", "c")]
    assert [r["table"] for r in G.match_tables(G.profile({"movies": movies, "shops": spark.range(3)}), ["movies", "genre"]).orderBy("rank").collect()] == ["movies", "shops"]
    shown = G.schema_context(G.profile({"movies": movies}), G.concepts({"movies": movies}))
    assert "genre string (such as Comedy" in shown
    with pytest.raises(ValueError):
        G.cooccurrence(spark.createDataFrame([], "entity_id string, modality_id string, f double"), 0)
    mod = spark.createDataFrame([("m", "TABLE", datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1), ["Oslo"])], "modality_id string, modality_type string, start_time timestamp, end_time timestamp, locations array<string>")
    assert G.in_time(mod, datetime.datetime(2020, 6, 1), datetime.datetime(2022, 1, 1)).count() == 1 and G.at_place(mod, "oslo").count() == 1 and G.by_type(mod, "modality_type", "TEXT").count() == 0


def test_history(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    h.record([("FILTER", "", 100, 50, 1.0, 1.0, True, "q1", 1), ("FILTER", "", 100, 100, 1.0, 1.0, True, "q2", 2)], [("FILTER", "SCAN", 0.5, "q1", 1)])
    h.record([("FILTER", "", 100, 100, 1.0, 1.0, False, "q3", 3)])
    assert recent_accuracy(h.operators()).first()["accuracy"] == pytest.approx(0.5)
    assert recent_accuracy(h.operators(without="q3")).first()["accuracy"] == pytest.approx(0.75)
    assert [e.query_id for e in executions(h.operators())["FILTER"]] == ["q1", "q2", "q3"] and h.edges().count() == 1
    assert OPERATORS.count(",") == 8 and EDGES.count(",") == 4


def test_clarify():
    schema = Schema({"movies": {"title": "string", "rating": "double"}, "shops": {"name": "string", "rating": "double"}}, values={"gold": [("movies", "title"), ("shops", "name")]})
    assert [a.kind for a in detect("the highest rating", schema)] == ["schema_structure"]
    got = clarify("average rating of gold", schema)
    assert [t["kind"] for t in got.trace] == ["value_content"] and detect(got.question, schema)[0].kind == "value_content" and "movies" in got.question
    assert clarify("average rating", schema, rounds=0).question == "average rating" and clarify("average rating", schema, ask=lambda a, o: None).trace == []
    assert detect("the recent colour", schema, {"images": ["colour"]})[0].kind == "cross_modal_referential"
    assert "movies: title [gold]" in grounding(schema)


def test_answer(spark, movies):
    assert answer("q", movies.filter("id = 1").select("id", "rating")) == "id: 1; rating: 8.10".replace("8.10", "8.1")
    assert answer("q", spark.range(30)).endswith("... and 20 more rows") and answer("q", movies.limit(0)) == "No results found for: q"


def test_stream(spark, movies, tmp_path):
    movies.write.parquet(f"{tmp_path}/in")
    run = Run(S.Catalog(spark, {"movies": spark.readStream.schema(movies.schema).parquet(f"{tmp_path}/in")}))
    df = compile_plan(PlanNode("PROJECT", {"columns": ["id"]}, (PlanNode("FILTER", {"conditions": [("year", ">", 2010)]}, (PlanNode("SCAN", {"table": "movies"}),)),)), run)
    q = df.writeStream.format("memory").queryName("got").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"] for r in spark.sql("select * from got").collect()} == {3, 4, 5}


def test_history_of_runs(planner, spark, tmp_path):
    got = planner.ask("How many movies have rating above 7?")
    ops, edges = planner.records(got, "q")
    assert [(o[0], o[3]) for o in ops] == [("SCAN", 5), ("FILTER", 3), ("AGGREGATE", 1)] and {e[:2] for e in edges} == {("AGGREGATE", "FILTER"), ("FILTER", "SCAN")}
    h = History(spark, f"file://{tmp_path}/runs")
    h.record(ops, edges)
    again = Planner(planner.catalog, history=executions(h.operators()))
    assert again.ask("How many movies have rating above 7?").text == "Count: 3" and any(e.source == "historical" for e in again.plan("How many movies have rating above 7?").estimates.values())


def test_vision(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    df = spark.createDataFrame([(1, png), (2, b"GIF89a\1\0\2\0"), (3, None), (4, b"x")], "id int, image binary")
    assert [r["id"] for r in O.image_filter(df, "image", "a png file").collect()] == [1]
    assert [r["category"] for r in O.image_labels(df, "image", ("png", "gif")).orderBy("id").collect()] == ["png", "gif", None, None]
    assert [r["embedding"] for r in O.image_vectors(df, "image").orderBy("id").collect()] == [[3.0, 2.0], [1.0, 2.0], None, None]
    assert [r["objects"] for r in O.image_objects(df, "image").orderBy("id").collect()] == [[], [], None, []]
    boxed = df.select("id", F.struct(F.col("image").alias("bytes"), F.lit("p").alias("path")).alias("image"))
    assert O.image_filter(boxed, "image", "gif").count() == 1 and isinstance(O.available()["torch"], bool)


def test_parse_and_answer_by_provider(movies):
    from tessera.plans.parse import parse_with
    from tessera.provider import read_json

    ask = CallableProvider(lambda p: 'Sure: ```json\n{"required": ["FILTER", "NOPE"], "root": "FILTER"}\n```')
    assert parse_with(ask, "x").required == {"SCAN", "FILTER"} and parse_with(OfflineProvider(), "count rows").root == "AGGREGATE"
    assert answer("q", movies, provider=CallableProvider(lambda p: "five")) == "five" and answer("q", movies, provider=OfflineProvider()).startswith("Found 5")
    with pytest.raises(ValueError):
        read_json("nothing")


def test_more_metrics(spark):
    c = lambda n, *v: spark.createDataFrame([(x,) for x in v], f"{n} string")
    r = M.grounding_score(c("column", "a", "zz"), c("value", "Rock", "pop"), c("column", "A", "b"), c("value", "rock", "pop music")).first()
    assert list(r) == [0.5, 0.5, 1.0]
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    assert M.resolution(ids(1, 2), ids(1, 2), ids(3), "id") == 1.0 and M.resolution(ids(3), ids(1), ids(3), "id") == 0.0 and M.resolution(ids(1), ids(1), ids(1), "id") is None
    assert M.judge_score("<rating>7</rating>") == 0.7 and M.judge_score("none") is None
    assert M.plan_metrics([{"a"}, {"a"}], [0.5, 0.5], [(1, 1, 0.5)])["quality_cv"] == 0.0
    runs = spark.createDataFrame([("m", "d", True, 1.0, 5), ("m", "e", False, 3.0, 5)], "method string, data string, validated boolean, seconds double, tokens int")
    assert M.method_summary(runs, ["method", "data"]).filter("method is null").first()["per_minute"] == 30.0
    assert spark.range(1).select(M.failure_class(F.lit(True), F.lit(False), F.lit(True), F.lit(True))).first()[0] == "plan"


# -- plans do what they say ---

SF = "/root/testdata/sf0.001"


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chosen_join_is_in_the_plan(spark):
    from tessera.plans.compile import Run, compile_plan
    from tessera.plans.tree import PlanNode
    from tessera.sources import Catalog

    catalog = Catalog.of_folder(spark, SF, ["orders", "customer"])
    plan = PlanNode("JOIN", {"keys": [("o_custkey", "c_custkey")]}, (PlanNode("SCAN", {"table": "orders"}), PlanNode("SCAN", {"table": "customer"})))
    assert "ShuffledHashJoin" in _physical(compile_plan(plan, Run(catalog, choice={"JOIN": "HASH_JOIN"})))
    nested = compile_plan(plan, Run(catalog, choice={"JOIN": "NESTED_LOOP_JOIN"}))
    assert "CartesianProduct" in _physical(nested) or "NestedLoop" in _physical(nested)
    assert nested.count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_export_writes_and_has_a_manifest(spark, tmp_path):
    from tessera.plans.compile import Run, compile_plan
    from tessera.plans.tree import PlanNode
    from tessera.sources import Catalog

    path = f"file://{tmp_path}/out"
    run = Run(Catalog.of_folder(spark, SF, ["region"]), choice={"EXPORT": "JSON_EXPORT"})
    compile_plan(PlanNode("EXPORT", {"path": path}, (PlanNode("SCAN", {"table": "region"}),)), run)
    (where, manifest), = run.exports
    n = spark.read.parquet(f"{SF}/region.parquet").count()
    assert where == path and spark.read.json(path).count() == n
    assert manifest.first()["format"] == "json" and manifest.first()["rows"] == n


def test_a_model_aggregates_in_rounds(spark):
    import json

    from tessera.operators import aggregate, model_aggregate
    from tessera.provider import CallableProvider

    def count(prompt):
        rows = json.loads(prompt[prompt.index("\n[") + 1 :])
        flat = [x for r in rows for x in (r if isinstance(r, list) else [r])]
        total = {}
        for r in flat:
            total[r["c_mktsegment"]] = total.get(r["c_mktsegment"], 0) + r.get("n", 1)
        return "Sure: " + json.dumps([{"c_mktsegment": k, "n": v} for k, v in total.items()])

    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_mktsegment")
    big = c.crossJoin(spark.range(100)).drop("id").repartition(3)
    plain = aggregate(big, [("count", None)])
    got = {r["c_mktsegment"]: r["n"] for r in model_aggregate(big, "how many of each", CallableProvider(count), plain).collect()}
    assert got == {r["c_mktsegment"]: r["count"] for r in big.groupBy("c_mktsegment").count().collect()}
    for bad in (lambda p: "no", lambda p: 1 / 0, lambda p: "[1]"):
        assert model_aggregate(big, "q", CallableProvider(bad, tries=1), plain).collect() == plain.collect()
    assert model_aggregate(big.limit(0), "q", CallableProvider(count), plain.limit(0)).collect() == []


def test_plans_of_vector_and_text_operators(spark):
    from pyspark.sql import functions as F

    from tessera import operators as O

    e, d = spark.read.parquet(f"{SF}/embeddings.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    for df in (O.nearest(e, "vec_id", "embedding", 3, F.col("vec_id") % 50 == 0), O.similarity_join(e, e, "vec_id", "vec_id", "embedding", 0.5, same=True)):
        assert "NestedLoop" not in _physical(df) and "CartesianProduct" not in _physical(df)
    assert "Exchange" not in _physical(O.key_phrases(d, "doc_id", "text"))
    filtered = _physical(O.semantic_filter(d, "text", "mentions a license").select("doc_id"))
    assert "Python" not in filtered


def test_similarity_join_modes_agree(spark):
    import numpy as np

    from tessera import operators as O

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[100:150] = x[:50] + 0.01 * rng.standard_normal((50, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 0.98 * np.linalg.norm(x[i]) * np.linalg.norm(x[j])}
    for miss in (0.0, 1e-6):
        assert {tuple(r)[:2] for r in O.similarity_join(df, df, "id", "id", "v", 0.98, same=True, miss=miss).collect()} == want
    both = {tuple(r)[:2] for r in O.similarity_join(df, df, "id", "id", "v", 0.98).collect()}
    assert both == want | {(j, i) for i, j in want} | {(i, i) for i in (*range(300), 302)}


def test_graph_of_texts_images_and_values(spark):
    from tessera import metagraph as G

    docs = spark.createDataFrame([(1, "It is a great day 2020-01-02.\nGreat joy", "a"), (2, "mail x@y.org about 12", "a"), (3, None, "b"), (4, "", "b"), (5, "  ", None)], "id long, body string, kind string")
    found = spark.createDataFrame([("Cat", 0.5, 0.9), ("cat", 2.0, 0.7), ("!", 0.1, 0.5)], "label string, area double, score double")
    g = G.build({"notes": docs}, texts={"notes": ["body"]}, detections={"notes": found}, rows={"notes": "id"})
    text = g["modalities"].filter("modality_type = 'TEXT'").first()
    assert (text["words"], text["n_docs"], text["n_paragraphs"], text["top_topics"][0]) == (12, 2, 3, "01")
    names = {(r["entity_id"], r["entity_type"]) for r in g["entities"].collect()}
    assert {("notes:text:20200102", "TIME"), ("notes:text:xyorg", "OBJECT"), ("notes:text:12", "QUANTITY"), ("notes:image:cat", "OBJECT"), ("notes:kind:a", "CONCEPT")} <= names
    image = {(r["area"], r["saliency"]) for r in g["mentions"].filter("modality_type = 'IMAGE'").collect()}
    assert image == {(0.5, 1.0), (1.0, 1.0)}
    relations = G.build_relations(g)
    assert relations.columns == ["relation_id", "relation_type", "source", "target", "confidence", "weight"] and relations.count() > 0
    assert G.build({"notes": docs.limit(0)}, texts={"notes": ["body"]})["entities"].collect() == []


def test_http_provider_counts_tokens_and_keeps_its_time():
    import http.server
    import json
    import threading
    import time

    from tessera.provider import HttpProvider

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            if "slow" in asked:
                time.sleep(3)
            body = json.dumps({"choices": [{"message": {"content": "YES" if "good" in asked else "NO"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 1}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        p = HttpProvider(f"http://127.0.0.1:{server.server_port}/", "m", seconds=1)
        assert p.holds(["good one", "bad", None], "x") == [True, False, None] and p.used == {"prompt_tokens": 14, "completion_tokens": 2}
        begin = time.time()
        assert p.holds(["slow good"], "x") == [None] and time.time() - begin < 2.5
    finally:
        server.shutdown()


def test_paragraphs_keep_their_digits(spark):
    d = spark.createDataFrame([("0997 a\n1 b 1\n  \n3\n 44 c ",), ("",), (None,)], "text string")
    assert [r["p"] for r in d.select(X.paragraphs(F.col("text")).alias("p")).collect()] == [["0997 a", "1 b 1", "3", "44 c"], [], None]


def test_text_modality_deals_rows_out_and_keeps_long_texts_whole(spark, tmp_path):
    lines = [f"good Wort {i} wort" for i in range(300)] + ["bad"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n"), (3, "bad bad\n\n good\n"), (4, " "), (5, None)], "id long, text string").coalesce(1)
    d.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))  # one row group, so one task reads it
    m = G.text_modality("d", one, ["text"])
    got = m.first()
    # white space that isn't spaces is a text without paragraphs: between its ends split() sees two empty words
    assert (got["words"], got["n_docs"], got["n_paragraphs"], got["sentiment"]) == (1201 + 2 + 4, 3, 303, "positive")
    assert got["top_topics"] == ["wort", "bad", "0", "0 wort", "1"]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "posexplode" not in plan


def test_top_phrases_order_and_nulls(spark):
    from tessera.operators.semantic import rule_matches, top_phrases

    d = spark.createDataFrame([(["b", "a", "b", "a", "c"],), (["z"],), ([],), (None,)], "w array<string>")
    got = [[(x["less"], x["phrase"]) for x in r["t"]] for r in d.select(top_phrases(F.col("w"), 4, [1, 2]).alias("t")).collect()]
    assert got == [[(-2, "a"), (-2, "b"), (-2, "b a"), (-1, "a b")], [(-1, "z")], [], []]
    e = spark.createDataFrame([("x@y.org z",), ("none",), (None,)], "t string").select(rule_matches(F.col("t"), "EMAIL").alias("m"))
    assert [r["m"] for r in e.collect()] == [["x@y.org"], [], None]


def test_value_mentions_make_no_cells_of_keys(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], None) for i in range(6)], "id long, kind string, none string")
    reps = spark.createDataFrame([("kind", "a", 3), ("kind", "b", 3)], "column string, value string, n long")
    m = G.value_mentions("d", d, reps, "id")
    assert sorted((r["entity_id"], r["row"]) for r in m.collect()) == sorted((f"d:kind:{'ab'[i % 2]}", i) for i in range(6))
    assert "struct(column, id" not in m._jdf.queryExecution().executedPlan().toString()
    assert G.value_mentions("d", d, reps.limit(0)).collect() == []
