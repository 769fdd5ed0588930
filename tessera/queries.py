"""Queries of the engine's own operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metagraph as G
from . import metrics as M
from . import operators as O
from . import sources as S
from .functions import measures as N
from .functions import text as X
from .history import calibrated_confidence
from .planner import Planner
from .provider import OfflineProvider, label

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as query, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return S.work_path(spark, "query")


LINKS = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def ask(spark: SparkSession, sf: str, question: str, tables: str = "region nation customer supplier part orders lineitem events documents labels") -> DataFrame:
    return Planner(S.Catalog.of_folder(spark, sf, tables.split()), links=LINKS).data(question)


# -- questions ----------------------------------------------------------------


@query("SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem WHERE l_quantity > 30")
def question_total(spark, sf):
    df = ask(spark, sf, "Compute the total extendedprice of lineitem where quantity is greater than 30")
    return df.select(F.round("sum_l_extendedprice", 2).alias("sum_l_extendedprice"))


@query("SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def question_group_count(spark, sf):
    return ask(spark, sf, "How many documents are there per lang?")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def question_top(spark, sf):
    return ask(spark, sf, "Show the top 7 orders by totalprice")


@query("SELECT DISTINCT event_type FROM events")
def question_distinct(spark, sf):
    return ask(spark, sf, "List the distinct event_type of events")


@query("SELECT count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000.5 AND c_acctbal < 1000")
def question_join_count(spark, sf):
    return ask(spark, sf, "Count orders joined with customer where totalprice is above 250000.5 and acctbal is below 1000")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 400000 GROUP BY 1")
def question_between_group(spark, sf):
    df = ask(spark, sf, "What is the average totalprice of orders with totalprice between 1000 and 400000 per orderstatus?")
    return df.select("o_orderstatus", F.round("avg_o_totalprice", 4).alias("avg_o_totalprice"))


@query("SELECT * FROM part WHERE contains(lower(p_name), 'ring') AND p_size <= 10")
def question_contains(spark, sf):
    return ask(spark, sf, "Filter part where name contains 'ring' and size is at most 10")


@query("SELECT * FROM part ORDER BY p_retailprice, p_partkey LIMIT 5")
def question_cheapest(spark, sf):
    return ask(spark, sf, "Find the top cheapest part")


@query("SELECT 'c_custkey' AS \"column\", count(*) AS rows, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, round(avg(c_custkey), 4) AS avg FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'c_nationkey', count(*), min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE, round(avg(c_nationkey), 4) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'c_acctbal', count(*), min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4) FROM customer WHERE c_acctbal > 5000")
def question_visualize(spark, sf):
    return ask(spark, sf, "Plot customer where acctbal is over 5000").withColumn("avg", F.round("avg", 4))


# -- sources ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(spark, sf):
    return O.project(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "absent"])


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, 'b', NULL), (3, NULL, 2.5)) v(id, name, score)")
def memory_table(spark, sf):
    return S.rows(spark, [{"id": 1, "name": "a", "score": 1.5}, {"id": 2, "name": "b"}, {"id": 3, "score": 2.5}], "id int, name string, score double")


@query("SELECT r_regionkey, r_name FROM region")
def csv_round_trip(spark, sf):
    path = scratch(spark)
    S.write(t(spark, sf, "region"), path, "csv")
    return S.csv(spark, path, "r_regionkey int, r_name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf):
    path = scratch(spark)
    S.write(t(spark, sf, "nation"), path, "json")
    return S.json(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7:' || c_custkey::VARCHAR), c_custkey LIMIT 40")
def seeded_sample(spark, sf):
    return S.seeded_sample(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 7)


@query("SELECT r_regionkey, r_name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS r_name FROM region, (SELECT unnest(range(0, 3)) AS k)")
def replicated_rows(spark, sf):
    return S.replicated(t(spark, sf, "region"), 3, ["r_name"])


# -- filters and projections ----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def filter_threshold(spark, sf):
    return O.keep(t(spark, sf, "lineitem"), [("l_quantity", ">", 45)]).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500.5 AND p_brand = 'Brand#2'")
def filter_conjunct(spark, sf):
    return O.keep(t(spark, sf, "part"), [("p_size", ">", 10), ("p_retailprice", "<", 1500.5), ("p_brand", "=", "Brand#2")]).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.05")
def filter_between(spark, sf):
    return O.keep(t(spark, sf, "lineitem"), [("l_discount", "between", (0.02, 0.05))]).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS n FROM part WHERE contains(lower(p_name), 'ring') AND CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) BETWEEN 5 AND 12")
def filter_regex_number(spark, sf):
    df = O.keep(t(spark, sf, "part"), [("p_name", "contains", "RING")]).withColumn("n", X.first_integer(F.col("p_brand")))
    return df.filter(F.col("n").between(5, 12)).select("p_partkey", "n")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') OR p_brand = 'Brand#1'")
def filter_any_of(spark, sf):
    return t(spark, sf, "part").filter(O.predicate("p_type", "in", ["ECONOMY", "STANDARD"]) | O.predicate("p_brand", "=", "Brand#1")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9])version([^a-z0-9]|$)')")
def semantic_filter_words(spark, sf):
    return O.semantic_filter(t(spark, sf, "documents"), "text", "mentions the License and its Version").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)')")
def semantic_filter_votes(spark, sf):
    return O.semantic_filter(t(spark, sf, "documents"), "text", "about a license", votes=3).select("doc_id")


@query("SELECT doc_id, substring(text, 1, 200) AS text, substring(lang, 1, 200) AS lang, substring(source, 1, 200) AS source, n_chars FROM documents")
def compact_rows(spark, sf):
    return O.compact(t(spark, sf, "documents"))


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def entity_restriction(spark, sf):
    return O.keep(t(spark, sf, "customer"), [("c_name", "=", "Customer#000000042")])


# -- joins ----------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON nullif(o_custkey, 7) IS NOT DISTINCT FROM nullif(c_custkey, 7)")
def join_nullsafe(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k"))
    c = t(spark, sf, "customer").select("c_name", F.nullif("c_custkey", F.lit(7)).alias("k"))
    return O.join(o, c).select("o_orderkey", "c_name")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_star(spark, sf):
    oc = O.join(t(spark, sf, "orders"), t(spark, sf, "customer"), [("o_custkey", "c_custkey")])
    return O.join(oc, t(spark, sf, "nation"), [("c_nationkey", "n_nationkey")]).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(spark, sf):
    return O.join(t(spark, sf, "region").select("r_name"), t(spark, sf, "nation").select("n_name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf):
    return O.join(t(spark, sf, "customer"), t(spark, sf, "orders"), [("c_custkey", "o_custkey")], how="left_anti").select("c_custkey")


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) JOIN embeddings e ON e.vec_id = l.doc_id WHERE l.quality = 1 AND contains(lower(d.text), 'license') AND e.label > 3")
def join_modalities(spark, sf):
    text = t(spark, sf, "documents").filter(F.lower("text").contains("license"))
    image = t(spark, sf, "embeddings").filter("label > 3")
    return t(spark, sf, "labels").filter("quality = 1").join(text, "doc_id", "left_semi").join(image, F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.45")
def similarity_join(spark, sf):
    e = t(spark, sf, "embeddings")
    return O.similarity_join(e, e, "vec_id", "vec_id", "embedding", 0.45, same=True).select("left_id", "right_id")


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), v AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
a AS (SELECT DISTINCT id, array_to_string(w[i:i+7], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM w)), b AS (SELECT DISTINCT id, array_to_string(w[i:i+7], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM v))
SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM a JOIN b USING (r) GROUP BY 1, 2""")
def text_match_join(spark, sf):
    return O.shared_shingles(t(spark, sf, "documents"), t(spark, sf, "benchmark"), "doc_id", "item_id", "text", "text")


SENTIMENT_SQL = """(SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('good','great','excellent','love','best','happy','positive','wonderful','enjoy'))) - len(list_filter(w, lambda x: x IN ('bad','terrible','awful','hate','worst','sad','negative','poor','stupid','loser','pathetic','scum'))) AS s FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM conversations))"""


@query(f"SELECT conv_id, turn, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM {SENTIMENT_SQL}")
def sentiment_words(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", O.sentiment(F.col("text")).alias("sentiment"))


@query(f"SELECT conv_id, turn, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM {SENTIMENT_SQL}")
def label_provider(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", label(OfflineProvider(), F.col("text"), ("positive", "negative", "neutral")).alias("sentiment"))


def _turns(spark, sf):
    r = F.length("text") % 3
    return t(spark, sf, "conversations").withColumn("l", F.when(r == 0, "positive").when(r == 1, "negative").otherwise("neutral"))


@query("SELECT doc_id FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('good','great','excellent','love','best','happy','positive','wonderful','enjoy'))) - len(list_filter(w, lambda x: x IN ('bad','terrible','awful','hate','worst','sad','negative','poor','stupid','loser','pathetic','scum'))) AS s FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents)) WHERE s < 0")
def sentiment_retrieval(spark, sf):
    return t(spark, sf, "documents").filter(O.sentiment(F.col("text")) == "negative").select("doc_id")


TURN_PAIRS = "WITH p AS (SELECT conv_id AS g, turn, CASE WHEN length(text) % 3 = 0 THEN 'positive' WHEN length(text) % 3 = 1 THEN 'negative' ELSE 'neutral' END AS l FROM conversations) SELECT a.g AS \"group\", a.turn AS a, b.turn AS b FROM p a JOIN p b ON a.g = b.g AND a.turn < b.turn AND a.l {} b.l AND a.l <> 'neutral' AND b.l <> 'neutral'"


@query(TURN_PAIRS.format("="))
def sentiment_pairs_same(spark, sf):
    return O.sentiment_pairs(_turns(spark, sf), "conv_id", "turn", "l", same=True)


@query(TURN_PAIRS.format("<>"))
def sentiment_pairs_opposite(spark, sf):
    return O.sentiment_pairs(_turns(spark, sf), "conv_id", "turn", "l", same=False)


# -- aggregation ------------------------------------------------------------------


@query("SELECT count(*) AS count, round(avg(l_quantity), 6) AS avg, round(sum(l_extendedprice), 2) AS sum, min(l_discount) AS min, max(l_tax) AS max FROM lineitem")
def aggregate_all(spark, sf):
    df = O.aggregate(t(spark, sf, "lineitem"), [("count", None), ("avg", "l_quantity"), ("sum", "l_extendedprice"), ("min", "l_discount"), ("max", "l_tax")])
    return df.select("count", F.round("avg_l_quantity", 6).alias("avg"), F.round("sum_l_extendedprice", 2).alias("sum"), F.col("min_l_discount").alias("min"), F.col("max_l_tax").alias("max"))


@query("SELECT 0::BIGINT AS count, 0::DOUBLE AS avg, 0::DOUBLE AS sum")
def aggregate_empty(spark, sf):
    df = O.aggregate(t(spark, sf, "lineitem").filter("l_quantity < 0"), [("count", None), ("avg", "l_tax"), ("sum", "l_tax")])
    return df.select("count", F.col("avg_l_tax").alias("avg"), F.col("sum_l_tax").alias("sum"))


@query("SELECT event_type, count(*) AS count, round(avg(value), 6) AS avg_value, count(DISTINCT user_id) AS count_distinct_user_id FROM events GROUP BY 1")
def aggregate_groups(spark, sf):
    return O.aggregate(t(spark, sf, "events"), [("count", None), ("avg", "value"), ("count_distinct", "user_id")], ["event_type"]).withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def value_maps(spark, sf):
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return O.value_counts(t(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority").select("o_orderstatus", F.array_join(pairs, ",").alias("counts"))


@query("SELECT o_custkey, round(avg(CAST(substring(o_orderpriority, 1, 1) AS INTEGER)), 6) AS score FROM orders GROUP BY 1")
def mean_rating(spark, sf):
    return O.mean_rating(t(spark, sf, "orders"), ["o_custkey"], F.substring("o_orderpriority", 1, 1)).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), c AS (SELECT "column", value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY "column") AS d, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS "rank" FROM c) SELECT "column", value, n, "rank" FROM r WHERE d BETWEEN 2 AND 40 AND "rank" <= 6""")
def representative_values(spark, sf):
    return O.frequent_values(t(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def mode_per_group(spark, sf):
    return O.most_frequent(t(spark, sf, "events"), ["user_id"], "event_type")


def _judged(spark, sf):
    return t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", (F.col("n_chars") > 1500).alias("said"), ((F.col("n_chars") % 97) / 97.0).alias("c"))


JUDGED = "(SELECT l.doc_id, quality, n_chars > 1500 AS said, (n_chars % 97) / 97.0::DOUBLE AS c FROM labels l JOIN documents d USING (doc_id))"


@query(f"""SELECT round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM (SELECT sum((said AND quality = 1)::INT)::DOUBLE AS tp, sum((said AND quality = 0)::INT)::DOUBLE AS fp, sum((NOT said AND quality = 1)::INT)::DOUBLE AS fn, sum((NOT said AND quality = 0)::INT)::DOUBLE AS tn FROM {JUDGED})""")
def precision_recall(spark, sf):
    df = M.precision_recall(_judged(spark, sf), F.col("said"), F.col("quality") == 1)
    return df.select(*(F.round(c, 9).alias(c) for c in df.columns))


@query("WITH g AS (SELECT doc_id FROM documents WHERE n_chars > 1500), w AS (SELECT doc_id FROM labels WHERE quality = 1), c AS (SELECT (SELECT count(*) FROM g JOIN w USING (doc_id))::DOUBLE AS tp, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM w) AS nw) SELECT round(tp / ng, 9) AS \"precision\", round(tp / nw, 9) AS recall, round(2 * tp / (ng + nw), 9) AS f1 FROM c")
def set_scores(spark, sf):
    df = M.set_scores(t(spark, sf, "documents").filter("n_chars > 1500"), t(spark, sf, "labels").filter("quality = 1"), "doc_id")
    return df.select(*(F.round(c, 9).alias(c) for c in df.columns))


@query(f"SELECT round(sum(abs(c - k)) / sum(n), 9) AS ece, round(sum(sq) / sum(n), 9) AS brier FROM (SELECT greatest(ceil(c * 10) - 1, 0)::INT AS b, count(*) AS n, sum(c) AS c, sum(quality) AS k, sum((c - quality) * (c - quality)) AS sq FROM {JUDGED} GROUP BY 1)")
def ece_brier(spark, sf):
    df = M.calibration(_judged(spark, sf), F.col("c"), F.col("quality"))
    return df.select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query(f"SELECT greatest(ceil(c * 10) - 1, 0)::INT AS bin, count(*) AS n, round(avg(c), 9) AS confidence, round(avg(quality), 9) AS accuracy FROM {JUDGED} GROUP BY 1")
def reliability_bins(spark, sf):
    return M.reliability(_judged(spark, sf), F.col("c"), F.col("quality")).select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"SELECT round(coalesce(corr(c, quality), 0), 6) AS pearson FROM {JUDGED}")
def pearson(spark, sf):
    return M.pearson(_judged(spark, sf), "c", "quality").select(F.round("pearson", 6).alias("pearson"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci95 FROM events GROUP BY 1")
def summary_statistics(spark, sf):
    df = M.summary(t(spark, sf, "events"), "value", ["event_type"])
    return df.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", "max", F.round("ci95", 6).alias("ci95"))


@query("SELECT count(*) AS n, round(avg(l_tax - l_discount), 9) AS mean_difference, round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 4) AS t FROM lineitem")
def paired_t(spark, sf):
    return M.paired_t(t(spark, sf, "lineitem"), "l_tax", "l_discount").select("n", F.round("mean_difference", 9).alias("mean_difference"), F.round("t", 4).alias("t"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def rollup_summary(spark, sf):
    return t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT CASE WHEN p_size <= 2 THEN 'simple' WHEN p_size = 3 THEN 'medium' WHEN p_size = 4 THEN 'complex' ELSE 'very complex' END AS bin, count(*) AS n FROM part GROUP BY 1")
def complexity_bins(spark, sf):
    return t(spark, sf, "part").groupBy(M.complexity_bin(F.col("p_size")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, round(n_chars / 1e6 * 2.0 + 100 / 1e6 * 6.0, 9) AS cost FROM documents")
def token_costs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(M.token_cost(F.col("n_chars"), F.lit(100), 2.0, 6.0), 9).alias("cost"))


# -- order, sets, windows -------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(spark, sf):
    return O.limit(O.order(t(spark, sf, "orders"), [("o_totalprice", True)], ["o_orderkey"]), 25).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf):
    return O.distinct(t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


@query("SELECT c_nationkey AS k, c_acctbal AS a, NULL::VARCHAR AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_name FROM supplier")
def union_all(spark, sf):
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("a"))
    return O.union(a, t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("s")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_rows(spark, sf):
    return O.intersect(t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_rows(spark, sf):
    return O.difference(t(spark, sf, "part").select(F.col("p_partkey").alias("k")), t(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k")))


@query("SELECT DISTINCT p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice > p.p_retailprice))")
def pareto_front(spark, sf):
    return O.pareto_2d(t(spark, sf, "part"), "p_size", "p_retailprice").select("p_size", "p_retailprice").distinct()


@query("SELECT c_nationkey, c_custkey, \"rank\" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS \"rank\" FROM customer) WHERE \"rank\" <= 3")
def top_per_group(spark, sf):
    return O.top_per_group(t(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


# -- vectors and text -------------------------------------------------------------------


@query("WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3) SELECT vec_id FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e) DESC, vec_id LIMIT 12")
def vector_search(spark, sf):
    e = t(spark, sf, "embeddings")
    asked = e.filter("vec_id = 3").first()["embedding"]  # the question's one vector
    return O.vector_search(e, "embedding", asked, 12, "vec_id").select("vec_id")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS INTEGER) AS \"rank\" FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, \"rank\", id FROM r WHERE \"rank\" <= 4")
def knn_join(spark, sf):
    return O.nearest(t(spark, sf, "embeddings"), "vec_id", "embedding", 4, F.col("vec_id") % 50 == 0)


@query("SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['license', 'creative'])")
def text_search(spark, sf):
    return O.text_search(t(spark, sf, "documents"), "text", "license creative").select("doc_id")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / greatest(abs(l_quantity), 1), 4) AS l_quantity_normalized, round(l_tax / greatest(abs(l_tax), 1), 4) AS l_tax_normalized FROM lineitem")
def feature_normalize(spark, sf):
    return O.normalize(t(spark, sf, "lineitem"), ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "l_quantity_normalized", "l_tax_normalized")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def extract_json(spark, sf):
    return O.extract(t(spark, sf, "events"), {"k": ("props", "$.k")}).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(html, '<title>([^<]*)</title>')")
def extract_title(spark, sf):
    return O.extract(t(spark, sf, "pages"), {"title": ("html", "<title>([^<]*)</title>"), "host": ("url", "^https?://([^/]+)")}).filter("title is not null").select("page_id", "title", "host")


@query("SELECT id, kind, entity, count(*) AS n FROM (SELECT doc_id AS id, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS entity FROM documents UNION ALL SELECT doc_id, 'QUANTITY', unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) FROM documents) GROUP BY 1, 2, 3")
def named_entities(spark, sf):
    return O.entities(t(spark, sf, "documents"), "doc_id", "text", ["EMAIL", "QUANTITY"])


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)), c AS (SELECT id, phrase, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, phrase) AS INTEGER) AS "rank" FROM c) SELECT id, phrase, n, "rank" FROM r WHERE "rank" <= 3""")
def key_phrases(spark, sf):
    return O.key_phrases(t(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) > 0)) AS n FROM documents")
def paragraph_split(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INTEGER) AS words FROM documents WHERE length(trim(text)) > 0")
def word_counts(spark, sf):
    return t(spark, sf, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", X.word_count(F.trim("text")).alias("words"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm FROM part")
def normal_forms(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.normalized(F.col("p_name")).alias("norm"))


@query("SELECT doc_id, score FROM (SELECT doc_id, (list_contains(w, 'license')::INT + list_contains(w, 'version')::INT) / 2.0::DOUBLE AS score FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents))")
def relevance_scores(spark, sf):
    return O.rated(t(spark, sf, "documents"), "text", "license version").select("doc_id", "score")


# -- output ---------------------------------------------------------------------------


@query("SELECT 'l_quantity' AS \"column\", count(*) AS rows, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg FROM lineitem UNION ALL SELECT 'l_tax', count(*), min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem")
def visualize_stats(spark, sf):
    return O.column_stats(t(spark, sf, "lineitem"), ["l_quantity", "l_tax"]).withColumn("avg", F.round("avg", 6))


@query("SELECT 'csv' AS format, count(*) AS rows, 'r_regionkey,r_name' AS columns FROM region")
def export_manifest(spark, sf):
    return O.manifest(t(spark, sf, "region"), "csv")


# -- measures ----------------------------------------------------------------------------


@query("SELECT a.event_id AS a, b.event_id AS b, CASE WHEN abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600e6 THEN 1.0 WHEN abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400e6 THEN 0.8 WHEN abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 604800e6 THEN 0.6 WHEN abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 2592000e6 THEN 0.4 WHEN abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 31536000e6 THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM events a JOIN events b ON a.event_id + 200 = b.event_id")
def time_nearness(spark, sf):
    e = t(spark, sf, "events")
    a, b = e.select(F.col("event_id").alias("a"), F.col("ts").alias("ta")), e.select(F.col("event_id").alias("b"), F.col("ts").alias("tb"))
    return a.join(b, F.col("a") + 200 == F.col("b")).select("a", "b", N.nearness(F.col("ta"), F.col("tb")).alias("score"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS km FROM (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 5.0 AS lon FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 5.0 AS lon FROM nation) b ON a.n_nationkey + 1 = b.n_nationkey")
def great_circle(spark, sf):
    n = t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 30).alias("lat"), (F.col("n_nationkey") * 5.0).alias("lon"))
    a, b = n.toDF("a", "alat", "alon"), n.toDF("b", "blat", "blon")
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(N.kilometres(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")), 3).alias("km"))


@query("SELECT o_orderkey, 'year_' || year(o_orderdate) AS y FROM orders")
def time_expressions(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", N.time_expression(F.concat(F.lit("Ordered in "), F.year("o_orderdate").cast("string"))).alias("y"))


@query("SELECT p_partkey, round(1 - least(0.3, log10(p_size + 1) / 20), 9) AS phi, round(least(p_size / 25.0::DOUBLE, 25.0::DOUBLE / p_size), 9) AS acc FROM part WHERE p_size > 0")
def scale_and_accuracy(spark, sf):
    return t(spark, sf, "part").filter("p_size > 0").select("p_partkey", F.round(N.scale_factor(F.col("p_size") + 1), 9).alias("phi"), F.round(N.row_accuracy(F.col("p_size").cast("double"), F.lit(25.0)), 9).alias("acc"))


# -- metadata graph ------------------------------------------------------------------------


@query("""SELECT 'nation' AS "table", 'n_nationkey' AS "column", 'int' AS type, count(*) AS rows, 0::BIGINT AS nulls, count(DISTINCT n_nationkey) AS distinct_values, min(n_nationkey)::VARCHAR AS least, max(n_nationkey)::VARCHAR AS most, true AS is_key FROM nation
UNION ALL SELECT 'nation', 'n_name', 'string', count(*), 0, count(DISTINCT n_name), min(n_name), max(n_name), true FROM nation
UNION ALL SELECT 'nation', 'n_regionkey', 'int', count(*), 0, count(DISTINCT n_regionkey), min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR, false FROM nation""")
def profile_tables(spark, sf):
    return G.profile({"nation": t(spark, sf, "nation")}, exact=True)


#: Columns of all tables that are named as keys or numbers of something.
FK_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id"],
}
FK_SQL = "WITH v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS t, '{c}' AS c, {c}::VARCHAR AS v FROM {n} WHERE {c} IS NOT NULL" for n, cs in FK_COLUMNS.items() for c in cs) + """),
s AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2), h AS (SELECT v.t, v.c, k.t AS rt, k.c AS rc, count(*) AS h FROM v JOIN v k ON v.v = k.v AND v.t <> k.t GROUP BY 1, 2, 3, 4)
SELECT h.t AS "table", h.c AS "column", rt AS ref_table, rc AS ref_column, round(h.h / s.n::DOUBLE, 3) AS coverage FROM h JOIN s ON h.t = s.t AND h.c = s.c WHERE h.h / s.n::DOUBLE >= 0.8"""


@query(FK_SQL)
def fk_discovery(spark, sf):
    return G.foreign_keys({n: t(spark, sf, n) for n in FK_COLUMNS}, FK_COLUMNS)


def _value_entities(spark, sf):
    """Entities from three tables: market segments, part types, event types, first words of names."""
    a = t(spark, sf, "customer").select(F.concat(F.lit("c:"), F.lower(F.substring("c_mktsegment", 1, 4))).alias("entity_id"), F.substring("c_mktsegment", 1, 4).alias("canonical_name"), F.lit("TABLE").alias("modality_type"), F.lit("customer").alias("modality_id"))
    b = t(spark, sf, "part").select(F.concat(F.lit("p:"), F.substring_index("p_name", " ", 1)).alias("entity_id"), F.substring_index("p_name", " ", 1).alias("canonical_name"), F.lit("TEXT").alias("modality_type"), F.lit("part").alias("modality_id"))
    c = t(spark, sf, "part").select(F.concat(F.lit("q:"), F.substring_index("p_name", " ", 1)).alias("entity_id"), F.upper(F.substring_index("p_name", " ", 1)).alias("canonical_name"), F.lit("TABLE").alias("modality_type"), F.lit("part_table").alias("modality_id"))
    return a.unionByName(b).unionByName(c)


VALUE_ENTITIES = "(SELECT 'c:' || lower(substring(c_mktsegment, 1, 4)) AS entity_id, substring(c_mktsegment, 1, 4) AS canonical_name, 'TABLE' AS modality_type, 'customer' AS modality_id FROM customer UNION ALL SELECT 'p:' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 1), 'TEXT', 'part' FROM part UNION ALL SELECT 'q:' || split_part(p_name, ' ', 1), upper(split_part(p_name, ' ', 1)), 'TABLE', 'part_table' FROM part)"


@query(f"SELECT norm, min(entity_id) AS entity_id, count(DISTINCT entity_id) AS members, array_to_string(list_sort(list(DISTINCT modality_type)), ',') AS modality_types FROM (SELECT *, regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g') AS norm FROM {VALUE_ENTITIES}) WHERE norm <> '' GROUP BY 1 HAVING count(DISTINCT entity_id) >= 2 AND count(DISTINCT modality_type) >= 2")
def cross_modal_merge(spark, sf):
    return G.merge_entities(_value_entities(spark, sf)).withColumn("modality_types", F.array_join("modality_types", ","))


def _mentions(spark, sf):
    """Sources as entities, languages and length classes as modalities."""
    d = t(spark, sf, "documents")
    return d.select(
        F.col("source").alias("entity_id"), F.concat(F.lit("m"), (F.col("n_chars") % 7).cast("string")).alias("modality_id"), F.when(F.col("n_chars") % 7 < 3, "TEXT").when(F.col("n_chars") % 7 < 5, "IMAGE").otherwise("TABLE").alias("modality_type"),
        F.col("source").alias("mention_text"), F.col("doc_id").alias("row"), F.when(F.col("n_chars") % 2 == 0, "key").otherwise("other").alias("column"), F.lit(0.01).alias("area"), F.lit(0.5).alias("saliency"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("context"),
    )


def _modalities(spark):
    return spark.createDataFrame([(f"m{i}", 5000 if i < 3 else None, 100 if i > 4 else None, ["key"] if i > 4 else None) for i in range(7)], "modality_id string, words long, n_rows long, key_columns array<string>")


FREQ = """(SELECT source AS entity_id, 'm' || (n_chars % 7) AS modality_id, CASE WHEN n_chars % 7 < 3 THEN least(1.0, ln(1 + count(*)) / ln(1 + 5000 / 100.0)) * 0.8 WHEN n_chars % 7 < 5 THEN least(1.0, 0.5 * 0.5 + 0.4 * least(1.0, count(*) * 0.01) + 0.1 * 0.8) ELSE least(1.0, 0.6 * (count(DISTINCT doc_id) / 100.0) + 0.4 * (CASE WHEN count(DISTINCT n_chars % 2) = 2 THEN 0.75 WHEN max(n_chars % 2) = 0 THEN 1.0 ELSE 0.5 END)) END::DOUBLE AS f FROM documents GROUP BY source, n_chars % 7)"""


@query(f"SELECT entity_id, modality_id, round(f, 9) AS f FROM {FREQ}")
def mention_frequency(spark, sf):
    return G.frequencies(_mentions(spark, sf), _modalities(spark)).withColumn("f", F.round("f", 9))


JW = f"""WITH f AS (SELECT * FROM {FREQ}), s AS (SELECT entity_id, sum(f) AS t FROM f GROUP BY 1), p AS (SELECT a.entity_id AS a, b.entity_id AS b, sum(sqrt(a.f * b.f)) AS num, sum(least(a.f, b.f)) AS low FROM f a JOIN f b ON a.modality_id = b.modality_id AND a.entity_id < b.entity_id GROUP BY 1, 2), j AS (SELECT p.a, p.b, num / (x.t + y.t - low) AS jw FROM p JOIN s x ON x.entity_id = a JOIN s y ON y.entity_id = b)"""


@query(JW + " SELECT a, b, round(jw, 6) AS jw FROM j WHERE jw >= 0.6")
def cooccurrence(spark, sf):
    return G.cooccurrence(G.frequencies(_mentions(spark, sf), _modalities(spark)), 0.6).withColumn("jw", F.round("jw", 6))


@query(JW + " SELECT a, b, 'associated_with' AS relation_type, round(least(1.0, jw), 6) AS confidence, round(jw * least(1.0, jw), 4) AS weight FROM j WHERE least(1.0, jw) >= 0.5")
def relation_typing(spark, sf):
    return G.relation_types(G.cooccurrence(G.frequencies(_mentions(spark, sf), _modalities(spark)), 0.1), most=None).withColumn("confidence", F.round("confidence", 6))


@query("""WITH m AS (SELECT 'orders' AS id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders UNION ALL SELECT 'lineitem', min(l_shipdate), max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', min(ts), max(ts) FROM events)
SELECT * FROM (SELECT a.id AS source, b.id AS target, round((epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s)))::DOUBLE / (epoch_us(greatest(a.e, b.e)) - epoch_us(least(a.s, b.s))), 9) AS score FROM m a JOIN m b ON a.id < b.id AND a.s < b.e AND b.s < a.e) WHERE score >= 0.3""")
def temporal_relations(spark, sf):
    ranges = None
    for name, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        part = t(spark, sf, name).agg(F.min(c).alias("start_time"), F.max(c).alias("end_time")).select(F.lit(name).alias("modality_id"), "start_time", "end_time")
        ranges = part if ranges is None else ranges.unionByName(part)
    return G.temporal_relations(ranges).withColumn("score", F.round("score", 9))


@query("SELECT * FROM (VALUES ('a', 'c', 1.0::DOUBLE), ('d', 'e', 0.5::DOUBLE)) v(source, target, score)")
def spatial_relations(spark, sf):
    rows = [("a", 10.0, 20.0, None), ("b", 40.0, 20.0, None), ("c", 10.0, 20.0, ["x"]), ("d", None, None, ["New York"]), ("e", None, None, ["York"])]
    return G.spatial_relations(spark.createDataFrame(rows, "modality_id string, lat double, lon double, locations array<string>"))


def _edges(spark, sf):
    n = t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("target"))
    s = t(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("source"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("target"))
    return n.unionByName(s)


EDGES = "e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(f"WITH RECURSIVE {EDGES}, b AS (SELECT source, target FROM e UNION SELECT target, source FROM e), w AS (SELECT 's0' AS node, 0 AS distance UNION SELECT b.target, w.distance + 1 FROM w JOIN b ON w.node = b.source WHERE w.distance < 3) SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY 1 HAVING min(distance) > 0")
def graph_hops(spark, sf):
    return G.within_hops(_edges(spark, sf), "s0", 3)


@query(f"WITH {EDGES} SELECT a.source || '>' || a.target || '>' || b.target AS path FROM e a JOIN e b ON a.target = b.source WHERE a.source LIKE 's%' AND a.source = 's1'")
def graph_paths(spark, sf):
    return G.simple_paths(_edges(spark, sf), "s1", F.col("target").startswith("r"), 2).select(F.array_join("path", ">").alias("path"))


@query("SELECT DISTINCT source AS entity_id FROM documents WHERE n_chars % 7 = 1 INTERSECT SELECT source FROM documents WHERE n_chars % 7 = 4")
def common_entities(spark, sf):
    return G.common_entities(_mentions(spark, sf), "m1", "m4")


@query("WITH m AS (SELECT DISTINCT 'm' || (n_chars % 7) AS m, doc_id % 50 AS e FROM documents), n AS (SELECT m, count(*) AS n FROM m GROUP BY 1) SELECT a.m AS source, b.m AS target, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 9) AS similarity FROM m a JOIN m b ON a.e = b.e AND a.m < b.m JOIN n x ON x.m = a.m JOIN n y ON y.m = b.m GROUP BY a.m, b.m, x.n, y.n")
def modality_similarity(spark, sf):
    m = t(spark, sf, "documents").select(F.concat(F.lit("m"), (F.col("n_chars") % 7).cast("string")).alias("modality_id"), (F.col("doc_id") % 50).alias("entity_id"))
    return G.modality_similarity(m).withColumn("similarity", F.round("similarity", 9))


@query("SELECT 'orders' AS \"table\", 'o_orderstatus' AS \"column\", o_orderstatus AS canonical_name, count(*) AS n FROM orders GROUP BY 3 UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 3")
def graph_build(spark, sf):
    return G.concepts({"orders": t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")}).select("table", "column", "canonical_name", "n")


@query("SELECT 'entities' AS part, 'CONCEPT' AS kind, count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS n FROM orders UNION ALL SELECT 'modalities', 'TABLE', 2 UNION ALL SELECT 'relations', 'references', 1")
def graph_statistics(spark, sf):
    e = G.concepts({"orders": t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")})
    path = scratch(spark)
    G.save({"modalities": spark.createDataFrame([("a", "TABLE"), ("b", "TABLE")], "modality_id string, modality_type string"), "entities": e, "relations": spark.createDataFrame([("r", "references")], "relation_id string, relation_type string")}, path)
    g = G.load(spark, path, ["modalities", "entities", "relations"])
    return G.statistics(g["modalities"], g["entities"], g["relations"])


@query("WITH h AS (SELECT event_type AS o, event_id AS seq, 40 AS e, CAST(floor(value) AS INTEGER) AS a FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY seq DESC) AS k FROM h), g AS (SELECT o, count(*) AS n, avg(CASE WHEN a > 0 THEN least(a / 40.0::DOUBLE, 40.0::DOUBLE / a) ELSE 0.5 END) AS acc FROM r WHERE k <= 20 GROUP BY 1) SELECT o AS operator_type, round((0.9 * 2 + acc * least(n, 10)) / (2 + least(n, 10)), 9) AS confidence FROM g")
def history_calibration(spark, sf):
    h = t(spark, sf, "events").select(F.col("event_type").alias("operator_type"), F.lit(40).alias("estimated_cardinality"), F.floor("value").cast("int").alias("actual_cardinality"), F.lit(True).alias("success"), F.col("event_id").alias("seq"))
    priors = h.select("operator_type").distinct().withColumn("prior", F.lit(0.9))
    return calibrated_confidence(h, priors).withColumn("confidence", F.round("confidence", 9))


# -- building the graph ---------------------------------------------------------------------

PRAISED = "('good','great','excellent','love','best','happy','positive','wonderful','enjoy')"
BLAMED = "('bad','terrible','awful','hate','worst','sad','negative','poor','stupid','loser','pathetic','scum')"
PARAGRAPHS = "SELECT doc_id, unnest(list_filter(list_transform(string_split(trim(text, ' '), chr(10)), lambda p: trim(p, ' ')), lambda p: p <> '')) AS p FROM documents WHERE trim(text, ' ') <> ''"


@query(f"""WITH p AS ({PARAGRAPHS}), w AS (SELECT regexp_split_to_array(lower(p), '[^\\p{{L}}\\p{{N}}]+') AS w FROM p), s AS (SELECT len(list_filter(w, lambda x: x IN {PRAISED})) - len(list_filter(w, lambda x: x IN {BLAMED})) AS s FROM w),
c AS (SELECT sum((s > 0)::INT) AS pos, sum((s = 0)::INT) AS neu, sum((s < 0)::INT) AS neg, count(*) AS n FROM s)
SELECT (SELECT sum(len(regexp_split_to_array(trim(text, ' '), '\\s+'))) FROM documents WHERE trim(text, ' ') <> '')::BIGINT AS words, (SELECT count(*) FROM documents WHERE trim(text, ' ') <> '') AS n_docs, n AS n_paragraphs, CASE WHEN pos >= neu AND pos >= neg THEN 'positive' WHEN neu >= neg THEN 'neutral' ELSE 'negative' END AS sentiment FROM c""")
def text_modality(spark, sf):
    return G.text_modality("documents", t(spark, sf, "documents"), ["text"]).select("words", "n_docs", "n_paragraphs", "sentiment")


@query(f"""WITH p AS ({PARAGRAPHS}), e AS (SELECT 'OBJECT' AS entity_type, unnest(regexp_extract_all(p, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS e FROM p UNION ALL SELECT 'TIME', unnest(regexp_extract_all(p, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) FROM p UNION ALL SELECT 'QUANTITY', unnest(regexp_extract_all(p, '[0-9]+(?:\\.[0-9]+)?')) FROM p)
SELECT 'documents:text:' || norm AS entity_id, entity_type, count(*) AS n, min(e) AS canonical_name FROM (SELECT *, regexp_replace(lower(e), '[^a-z0-9]', '', 'g') AS norm FROM e) WHERE norm <> '' GROUP BY 1, 2""")
def text_mentions(spark, sf):
    m = G.text_mentions("documents", t(spark, sf, "documents"), ["text"], ["EMAIL", "DATE", "QUANTITY"])
    return m.groupBy("entity_id", "entity_type").agg(F.count("*").alias("n"), F.min("mention_text").alias("canonical_name"))


def _built(spark, sf):
    return G.build({"orders": t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "events": t(spark, sf, "events").select("event_id", "event_type", "ts"), "documents": t(spark, sf, "documents").select("doc_id", "lang", "text")}, texts={"documents": ["text"]}, rows={"orders": "o_orderkey", "events": "event_id", "documents": "doc_id"})


VALUE_MENTIONS = " UNION ALL ".join(f"SELECT '{t_}:{c}:' || {c} AS entity_id, '{t_}_table' AS modality_id, {k} AS r FROM {t_} WHERE {c} IS NOT NULL" for t_, c, k in (("orders", "o_orderstatus", "o_orderkey"), ("orders", "o_orderpriority", "o_orderkey"), ("events", "event_type", "event_id"), ("documents", "lang", "doc_id")))


@query(f"SELECT entity_id, modality_id, count(*) AS n, count(DISTINCT r) AS rows FROM ({VALUE_MENTIONS}) GROUP BY 1, 2")
def graph_mentions(spark, sf):
    m = _built(spark, sf)["mentions"].filter("modality_type = 'TABLE'")
    return m.groupBy("entity_id", "modality_id").agg(F.count("*").alias("n"), F.count_distinct("row").alias("rows"))


@query("SELECT 'orders_table' AS modality_id, count(*) AS n_rows, 'o_orderkey' AS key_columns, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time FROM orders UNION ALL SELECT 'events_table', count(*), 'event_id', min(ts), max(ts) FROM events UNION ALL SELECT 'documents_table', count(*), 'doc_id', NULL, NULL FROM documents")
def graph_modalities(spark, sf):
    m = _built(spark, sf)["modalities"].filter("modality_type = 'TABLE'")
    return m.select("modality_id", "n_rows", F.array_join(F.filter("key_columns", lambda c: c != "text"), ",").alias("key_columns"), "start_time", "end_time")


@query(f"""WITH v AS ({VALUE_MENTIONS}), n AS (SELECT 'orders_table' AS m, count(*) AS r FROM orders UNION ALL SELECT 'events_table', count(*) FROM events UNION ALL SELECT 'documents_table', count(*) FROM documents),
f AS (SELECT entity_id, modality_id, least(1.0, 0.6 * (count(DISTINCT v.r) / max(n.r)::DOUBLE) + 0.4 * 0.5)::DOUBLE AS f FROM v JOIN n ON n.m = modality_id GROUP BY 1, 2), s AS (SELECT entity_id, sum(f) AS t FROM f GROUP BY 1),
j AS (SELECT a.entity_id AS a, b.entity_id AS b, sum(sqrt(a.f * b.f)) / (max(x.t) + max(y.t) - sum(least(a.f, b.f))) AS jw FROM f a JOIN f b ON a.modality_id = b.modality_id AND a.entity_id < b.entity_id JOIN s x ON x.entity_id = a.entity_id JOIN s y ON y.entity_id = b.entity_id GROUP BY 1, 2)
SELECT 'associated_with' AS relation_type, a AS source, b AS target, round(least(1.0, jw), 6) AS confidence FROM j WHERE least(1.0, jw) >= 0.5""")
def graph_relations(spark, sf):
    g = _built(spark, sf)
    g["mentions"] = g["mentions"].filter("modality_type = 'TABLE'")
    return G.build_relations(g).filter("relation_type = 'associated_with'").select("relation_type", "source", "target", F.round("confidence", 6).alias("confidence"))


# -- more measures -------------------------------------------------------------------------


@query("SELECT round(2 / 3.0::DOUBLE, 9) AS column_validity, round((SELECT count(*) FROM (VALUES ('FRANCE'), ('germany'), ('land'), ('nowhere')) v(x) WHERE lower(x) IN (SELECT lower(n_name) FROM nation)) / 4.0::DOUBLE, 9) AS value_exact, round((SELECT count(*) FROM (VALUES ('france'), ('germany'), ('land'), ('nowhere')) v(x) WHERE EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), x))) / 4.0::DOUBLE, 9) AS value_partial")
def plan_grounding(spark, sf):
    columns = spark.createDataFrame([("n_name",), ("N_REGIONKEY",), ("absent",)], "column string")
    literals = spark.createDataFrame([("FRANCE",), ("germany",), ("land",), ("nowhere",)], "value string")
    n = t(spark, sf, "nation")
    got = M.grounding_score(columns, literals, spark.createDataFrame([(c,) for c in n.columns], "column string"), n.select(F.col("n_name").alias("value")))
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


@query("SELECT 1.0::DOUBLE AS score")
def plan_resolution(spark, sf):
    c = t(spark, sf, "customer")
    got = c.filter("c_acctbal > 0")
    return spark.createDataFrame([(M.resolution(got, c.filter("c_acctbal > 1"), c.filter("c_acctbal < 0"), "c_custkey"),)], "score double")


@query(f"SELECT conv_id, turn, round(s / sqrt(s * s + 15), 9) AS compound FROM {SENTIMENT_SQL}")
def sentiment_compound(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", F.round(O.compound(F.col("text")), 9).alias("compound"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND NOT list_contains(string_split('a an and are as at be by for from has have in is it its mention mentions about of on or rows row text texts that the their them to was were which with where who find show keep all', ' '), x)) AS w FROM conversations),
g AS (SELECT conv_id, turn, len(w) AS a, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS topic FROM w), c AS (SELECT conv_id, turn, topic, count(*) AS n, max(a) AS a FROM g GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, topic) AS INTEGER) AS "rank" FROM c) SELECT conv_id * 100 + turn AS id, topic, round(n / a::DOUBLE, 4) AS score, "rank" FROM r WHERE "rank" <= 3""")
def topics(spark, sf):
    return O.topics(t(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn")), "id", "text")


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000042'")
def entity_question(spark, sf):
    c = t(spark, sf, "customer")
    got = Planner(S.Catalog(spark, {"customer": c.withColumnRenamed("c_name", "id")})).data("customer 'Customer#000000042'")
    return got.withColumnRenamed("id", "c_name")


@query("SELECT r_regionkey, r_name FROM region")
def question_export(spark, sf):
    planner = Planner(S.Catalog(spark, {"region": t(spark, sf, "region").select("r_regionkey", "r_name")}))
    asked = planner.ask("Export region as json")
    return S.json(spark, asked.exports[0][0], "r_regionkey int, r_name string")
