"""The metadata graph as tables: profiles, values, foreign keys, entities, relations, and queries over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.measures import place_nearness, place_similarity, time_share
from ..functions.text import normalized, paragraphs, word_count
from ..operators.relational import frequent_values
from ..operators.semantic import ENTITY_RULES, rule_matches, sentiment, top_phrases, topic_words
from ..sources import spread, written

MENTIONS = "entity_id string, modality_id string, modality_type string, mention_text string, row long, column string, area double, saliency double, confidence double, context string"
#: The words of a text at which its mentions count in full.
WORDS_UNIT = 100.0


def profile(tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """(table, column, type, rows, nulls, distinct_values, least, most, is_key): one aggregation for each table."""
    out = None
    for name, df in tables.items():
        count = F.count_distinct if exact else F.approx_count_distinct
        fields = [f for f in df.schema if not isinstance(f.dataType, (T.MapType, T.BinaryType, T.VariantType))]
        simple = [isinstance(f.dataType, T.AtomicType) for f in fields]
        one = df.agg(F.count("*").alias("rows"), *(x for i, (f, s) in enumerate(zip(fields, simple)) for x in (
            F.sum(F.col(f"`{f.name}`").isNull().cast("long")).alias(f"n{i}"), count(F.col(f"`{f.name}`")).alias(f"d{i}"),
            (F.min(F.col(f"`{f.name}`")).cast("string") if s else F.lit(None).cast("string")).alias(f"a{i}"), (F.max(F.col(f"`{f.name}`")).cast("string") if s else F.lit(None).cast("string")).alias(f"z{i}"))))
        rows = F.array(*(F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"a{i}").alias("least"), F.col(f"z{i}").alias("most")) for i, f in enumerate(fields)))
        part = one.select(F.explode(rows).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("is_key", (F.col("rows") > 0) & (F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows")))


def values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table, column, value): the distinct normal forms in the given columns."""
    out = None
    for name, cols in columns.items():
        part = tables[name].select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), normalized(F.col(c).cast("string")).alias("value")) for c in cols))).alias("p")).select(F.lit(name).alias("table"), "p.*")
        out = part if out is None else out.unionByName(part)
    return out.filter(F.coalesce(F.length("value"), F.lit(0)) > 0).distinct()


def foreign_keys(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], keys: Mapping[str, Sequence[str]] | None = None, least: float = 0.8) -> DataFrame:
    """(table, column, ref_table, ref_column, coverage): columns of which that share of the distinct values occurs in another table's column.

    ``columns`` may refer, ``keys`` may be referred to (all columns without it). Each value is reduced to the set of columns that have it, of which there are few
    different ones; only these are taken apart into pairs of columns.
    """
    side = lambda df, name: df.select("value", F.struct(F.lit(name).alias("side"), "table", "column").alias("c"))
    v = side(values(tables, columns), "from")
    both = v.unionByName(side(values(tables, keys if keys is not None else columns), "to"))
    sets = both.groupBy("value").agg(F.array_sort(F.collect_set("c")).alias("set")).groupBy("set").agg(F.count("*").alias("n"))
    of = lambda name: F.filter("set", lambda c: c["side"] == name)
    sets = written(sets.select("n", of("from").alias("from"), of("to").alias("to")), "column-sets")
    size = sets.select("n", F.explode("from").alias("c")).groupBy("c.table", "c.column").agg(F.sum("n").alias("size"))
    pairs = sets.select("n", F.explode("from").alias("c"), "to").select("n", "c", F.explode("to").alias("r")).filter(F.col("c.table") != F.col("r.table"))
    hits = pairs.groupBy("c.table", "c.column", F.col("r.table").alias("ref_table"), F.col("r.column").alias("ref_column")).agg(F.sum("n").alias("hits"))
    return hits.join(F.broadcast(size), ["table", "column"]).withColumn("coverage", F.round(F.col("hits") / F.col("size"), 3)).filter(F.col("hits") / F.col("size") >= least).select("table", "column", "ref_table", "ref_column", "coverage")  # a row for each column


def concepts(tables: Mapping[str, DataFrame], most: int = 6) -> DataFrame:
    """One entity for each representative value of each table: (entity_id, entity_type, canonical_name, table, column, n)."""
    out = None
    for name, df in tables.items():
        simple = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType))]
        if not simple:
            continue
        part = frequent_values(df, simple, most).select(F.concat_ws(":", F.lit(name), "column", "value").alias("entity_id"), F.lit("CONCEPT").alias("entity_type"), F.col("value").alias("canonical_name"), F.lit(name).alias("table"), "column", "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Entity types of what the patterns find.
RULE_TYPES = {"EMAIL": "OBJECT", "URL": "OBJECT", "MONEY": "QUANTITY", "QUANTITY": "QUANTITY", "DATE": "TIME"}
#: How sure a pattern in a text is, and a stored value.
TEXT_CONFIDENCE, VALUE_CONFIDENCE = 0.85, 1.0
#: Characters of context on either side of a mention.
CONTEXT = 40

MODALITIES = "modality_id string, modality_type string, source_path string, columns array<string>, n_rows long, key_columns array<string>, words long, n_docs long, n_paragraphs long, top_topics array<string>, sentiment string, start_time timestamp, end_time timestamp, lat double, lon double, locations array<string>"
ENTITIES = "entity_id string, entity_type string, canonical_name string, modality_id string, modality_type string, column string"


def _as(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, null where ``df`` lacks them."""
    fields = T.StructType.fromDDL(ddl).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(text): the joined texts of each row that has some, dealt out to all cores."""
    text = F.trim(F.concat_ws(" ", *(F.col(f"`{c}`") for c in columns)))
    return spread(df.select(text.alias("text")).filter("text <> ''"))


def text_modality(name: str, df: DataFrame, columns: Sequence[str], topics: int = 5) -> DataFrame:
    """One row of MODALITIES for a table's texts: words, rows with text, paragraphs, the most frequent topics of the paragraphs and their most frequent sentiment. All texts count.

    Paragraphs are judged inside their row, so that a long text isn't copied for each of them.
    """
    rows, parts = _texts(df, columns), paragraphs(F.col("text"))
    each = rows.select(word_count(F.col("text")).alias("words"), F.transform(parts, lambda p: sentiment(p)).alias("kinds"))
    one = each.agg(F.sum("words").alias("words"), F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("kinds").cast("long")), F.lit(0)).alias("n_paragraphs"), *(F.sum(F.size(F.filter("kinds", lambda k: k == s)).cast("long")).alias(s) for s in ("negative", "neutral", "positive")))
    found = rows.select(F.explode(parts).alias("paragraph")).select(F.explode(top_phrases(topic_words(F.col("paragraph")), 3, [1, 2])).alias("t"))
    top = found.groupBy(F.col("t.phrase").alias("phrase")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(topics)
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "phrase"))).alias("t"))  # ``topics`` rows
    most = F.greatest("negative", "neutral", "positive")
    kind = F.when(most == F.col("positive"), "positive").when(most == F.col("neutral"), "neutral").otherwise("negative")
    return _as(one.crossJoin(top).select(F.lit(f"{name}_text").alias("modality_id"), F.lit("TEXT").alias("modality_type"), F.lit(name).alias("source_path"), F.lit(list(columns)).alias("columns"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_paragraphs", F.col("t.phrase").alias("top_topics"), F.when(F.col("n_paragraphs") > 0, kind).alias("sentiment")), MODALITIES)  # two single rows


def text_mentions(name: str, df: DataFrame, columns: Sequence[str], kinds: Sequence[str] = tuple(ENTITY_RULES)) -> DataFrame:
    """MENTIONS of what the patterns find in the paragraphs of a table's texts, with ``entity_type``. An entity is a normal form."""
    part = F.col("paragraph")

    def of(kind: str) -> Column:
        return F.transform(rule_matches(part, kind), lambda e: F.struct(F.lit(RULE_TYPES[kind]).alias("entity_type"), e.alias("mention_text"), F.substr(part, F.greatest(F.lit(1), F.call_function("instr", part, e) - CONTEXT), F.length(e) + 2 * CONTEXT).alias("context")))

    rows = _texts(df, columns).select(F.explode(paragraphs(F.col("text"))).alias("paragraph"))
    rows = rows.select(F.explode(F.flatten(F.array(*map(of, kinds)))).alias("e")).select("e.*").withColumn("norm", normalized(F.col("mention_text"))).filter("norm <> ''")
    out = rows.select(F.concat(F.lit(f"{name}:text:"), "norm").alias("entity_id"), F.lit(f"{name}_text").alias("modality_id"), F.lit("TEXT").alias("modality_type"), "mention_text", F.lit(TEXT_CONFIDENCE).alias("confidence"), "context", "entity_type")
    return _as(out, MENTIONS + ", entity_type string")


def value_mentions(name: str, df: DataFrame, representatives: DataFrame, row: str | None = None) -> DataFrame:
    """MENTIONS of a table's representative values (column, value), one for each row that has one; ``row``: the column that numbers rows.

    Cells are made of columns that have such values only, not of keys.
    """
    simple = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType))]
    have = {r["column"] for r in representatives.select("column").distinct().collect()}  # names of columns
    simple = [c for c in simple if c in have] or simple[:1]
    number = F.col(f"`{row}`").cast("long") if row else F.lit(None).cast("long")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in simple)))
    rows = df.select(number.alias("row"), cells.alias("c")).select("row", "c.*").join(F.broadcast(representatives.select("column", "value")), ["column", "value"])  # six values of a column at most
    out = rows.select(F.concat_ws(":", F.lit(name), "column", "value").alias("entity_id"), F.lit(f"{name}_table").alias("modality_id"), F.lit("TABLE").alias("modality_type"), F.col("value").alias("mention_text"), "row", "column", F.lit(VALUE_CONFIDENCE).alias("confidence"), F.col("column").alias("context"), F.lit("CONCEPT").alias("entity_type"))
    return _as(out, MENTIONS + ", entity_type string")


def image_mentions(name: str, detections: DataFrame) -> DataFrame:
    """MENTIONS of detected objects (label, area, score): an area is a share of the image, saliency four times that, both at most 1."""
    area = F.least(F.lit(1.0), F.col("area"))
    rows = detections.withColumn("norm", normalized(F.col("label"))).filter("norm <> ''")
    out = rows.select(F.concat(F.lit(f"{name}:image:"), "norm").alias("entity_id"), F.lit(f"{name}_image").alias("modality_id"), F.lit("IMAGE").alias("modality_type"), F.col("label").alias("mention_text"), area.alias("area"), F.least(F.lit(1.0), 4 * area).alias("saliency"), F.col("score").alias("confidence"), F.lit("OBJECT").alias("entity_type"))
    return _as(out, MENTIONS + ", entity_type string")


def table_modality(name: str, df: DataFrame) -> DataFrame:
    """One row of MODALITIES for a table: columns, rows, keys and the range of its times, in one aggregation."""
    fields = [f for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    times = [f.name for f in fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    keys = [f.name for f in fields if isinstance(f.dataType, (T.IntegralType, T.StringType))]
    one = df.agg(F.count("*").alias("n_rows"), *(F.struct(F.approx_count_distinct(f"`{c}`", 0.01).alias("d"), F.count(f"`{c}`").alias("n")).alias(f"k{i}") for i, c in enumerate(keys)), *(f(F.col(f"`{c}`").cast("timestamp")).alias(f"{w}{i}") for i, c in enumerate(times) for w, f in (("a", F.min), ("z", F.max))))
    # a candidate key has about as many values as rows
    is_key = F.filter(F.array(*(F.when((F.col(f"k{i}.n") == F.col("n_rows")) & (F.col(f"k{i}.d") >= 0.97 * F.col("n_rows")), F.lit(c)) for i, c in enumerate(keys))), lambda c: c.isNotNull()) if keys else F.array().cast("array<string>")
    ends = [F.least(*x) if len(x) > 1 else x[0] if x else F.lit(None) for x in ([F.col(f"a{i}") for i in range(len(times))],)] + [F.greatest(*x) if len(x) > 1 else x[0] if x else F.lit(None) for x in ([F.col(f"z{i}") for i in range(len(times))],)]
    return _as(one.select(F.lit(f"{name}_table").alias("modality_id"), F.lit("TABLE").alias("modality_type"), F.lit(name).alias("source_path"), F.lit(df.columns).alias("columns"), "n_rows", is_key.alias("key_columns"), ends[0].alias("start_time"), ends[1].alias("end_time")), MODALITIES)


def build(tables: Mapping[str, DataFrame], texts: Mapping[str, Sequence[str]] | None = None, detections: Mapping[str, DataFrame] | None = None, rows: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The graph's tables (modalities, entities, mentions) of a catalog; with ``relations`` of ``build_relations`` they are all four.

    ``texts``: the text columns of tables; ``detections``: objects found in a table's images; ``rows``: the column that numbers a table's rows.
    Every row counts, none is sampled.
    """
    texts, detections, rows = texts or {}, detections or {}, rows or {}
    modalities, mentions = [], []
    for name, df in tables.items():
        structured = df.select(*(f"`{c}`" for c in df.columns if c not in texts.get(name, ())))
        modalities.append(table_modality(name, df))
        simple = [f.name for f in structured.schema if isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType))]
        if simple:
            mentions.append(value_mentions(name, structured, written(frequent_values(structured, simple), "representatives"), rows.get(name)))
        if texts.get(name):
            modalities.append(text_modality(name, df, texts[name]))
            mentions.append(text_mentions(name, df, texts[name]))
        if name in detections:
            modalities.append(_as(df.sparkSession.createDataFrame([(f"{name}_image", "IMAGE", name)], "modality_id string, modality_type string, source_path string"), MODALITIES))
            mentions.append(image_mentions(name, detections[name]))
    union = lambda parts: reduce(lambda x, y: x.unionByName(y), parts)
    found = written(union(mentions), "mentions")
    one = found.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"), F.min("mention_text").alias("canonical_name"), F.min("modality_id").alias("modality_id"), F.min("modality_type").alias("modality_type"), F.min("column").alias("column"))
    return {"modalities": written(union(modalities), "modalities"), "entities": _as(one, ENTITIES), "mentions": found.drop("entity_type")}


RELATIONS = "relation_id string, relation_type string, source string, target string, confidence double, weight double"


def build_relations(graph: Mapping[str, DataFrame], least: float = 0.3, least_jw: float = 0.1, most: int | None = None) -> DataFrame:
    """RELATIONS of a graph: modalities that overlap in time or lie near each other, entities that occur together."""
    m = graph["modalities"]
    between = temporal_relations(m, least).withColumn("relation_type", F.lit("temporal_overlap")).unionByName(spatial_relations(m, least).withColumn("relation_type", F.lit("spatial_proximity")))
    f = written(frequencies(graph["mentions"], m.select("modality_id", "words", "n_rows", "key_columns")), "frequencies")
    typed = relation_types(cooccurrence(f, least_jw), most=most)
    rows = between.select("relation_type", "source", "target", F.col("score").alias("confidence"), F.col("score").alias("weight")).unionByName(typed.select("relation_type", F.col("a").alias("source"), F.col("b").alias("target"), "confidence", "weight"))
    return _as(rows.withColumn("relation_id", F.concat_ws("|", "relation_type", "source", "target")), RELATIONS)


def merge_entities(entities: DataFrame) -> DataFrame:
    """(norm, entity_id, members, modality_types): entities with one normal name in at least two kinds of modality; the smallest id stands for all."""
    e = entities.withColumn("norm", normalized(F.col("canonical_name"))).filter("norm <> ''")
    g = e.groupBy("norm").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("members"), F.array_sort(F.collect_set("modality_type")).alias("modality_types"))
    return g.filter((F.col("members") >= 2) & (F.size("modality_types") >= 2))


def frequencies(mentions: DataFrame, modalities: DataFrame) -> DataFrame:
    """(entity_id, modality_id, f): how strongly an entity shows in a modality.

    ``modalities``: modality_id, words (of texts), n_rows and key_columns (of tables).
    """
    m = mentions.join(modalities, "modality_id", "left")
    is_key = F.when(F.array_contains("key_columns", F.coalesce("column", "context")), 1.0).otherwise(0.5)
    columns = m.select("entity_id", "modality_id", F.coalesce("column", "context").alias("c"), is_key.alias("w")).distinct().groupBy("entity_id", "modality_id").agg(F.avg("w").alias("w"))
    length = F.size(F.split(F.trim(F.coalesce("context", "mention_text")), r"\s+"))
    g = m.groupBy("entity_id", "modality_id", "modality_type").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("c"), F.max("words").alias("words"), F.sum(length).alias("own_words"), F.max("n_rows").alias("r_all"), F.count_distinct("row").alias("r"),
        F.avg(F.coalesce("saliency", F.lit(0.5))).alias("s"), F.least(F.lit(1.0), F.sum(F.coalesce("area", F.lit(0.0)))).alias("a"),
    )
    g = g.join(columns, ["entity_id", "modality_id"], "left")
    total = F.when(F.col("words") > 0, F.col("words")).otherwise(F.greatest(F.col("own_words"), F.col("n")))
    text = F.least(F.lit(1.0), F.log1p("n") / F.log1p(F.greatest(total, F.lit(1)) / WORDS_UNIT)) * F.col("c")
    image = F.least(F.lit(1.0), 0.5 * F.col("s") + 0.4 * F.col("a") + 0.1 * F.col("c"))
    rows = F.when(F.col("r") > 0, F.col("r")).otherwise(F.col("n"))
    share = F.when(F.col("r_all") > 0, rows / F.col("r_all")).otherwise(F.least(F.lit(1.0), rows / F.greatest(F.col("n"), F.lit(1))))
    table = F.least(F.lit(1.0), 0.6 * share + 0.4 * F.coalesce("w", F.lit(0.5)))
    return g.select("entity_id", "modality_id", F.when(F.col("modality_type") == "TEXT", text).when(F.col("modality_type") == "IMAGE", image).otherwise(table).alias("f"))


def cooccurrence(f: DataFrame, least: float) -> DataFrame:
    """(a, b, jw): pairs of entities, a before b, with a weighted co-occurrence of at least ``least`` (above 0).

    Only pairs that share a modality meet: the maxima over the union are both sums less the shared minima.
    """
    if least <= 0:
        raise ValueError("the threshold must be above 0")
    total = f.groupBy("entity_id").agg(F.sum("f").alias("t"))
    l, r = (f.select(F.col("entity_id").alias(n), "modality_id", F.col("f").alias(f"f{n}")) for n in ("a", "b"))
    shared = l.join(r, "modality_id").filter("a < b").groupBy("a", "b").agg(F.sum(F.sqrt(F.col("fa") * F.col("fb"))).alias("num"), F.sum(F.least("fa", "fb")).alias("low"))
    t = shared.join(total.select(F.col("entity_id").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("entity_id").alias("b"), F.col("t").alias("tb")), "b")
    den = F.col("ta") + F.col("tb") - F.col("low")
    return t.select("a", "b", F.when(den > 1e-9, F.col("num") / den).otherwise(0.0).alias("jw")).filter(F.col("jw") >= least)


def relation_types(pairs: DataFrame, most: int | None = 200, least_confidence: float = 0.5) -> DataFrame:
    """Typed relations of the strongest pairs without a model: associated_with, its confidence jw, its weight jw * jw."""
    top = pairs.orderBy(F.desc("jw"), "a", "b").limit(most) if most is not None else pairs
    conf = F.least(F.lit(1.0), F.col("jw"))
    return top.select("a", "b", F.lit("associated_with").alias("relation_type"), conf.alias("confidence"), F.round(F.col("jw") * conf, 4).alias("weight")).filter(F.col("confidence") >= least_confidence)


def temporal_relations(modalities: DataFrame, least: float = 0.3) -> DataFrame:
    """(source, target, score): pairs of modalities whose time ranges (start_time, end_time) share at least that part.

    Ranges meet by their overlap; there is a row for each modality, that is, for each table, text collection or image set.
    """
    a, b = (modalities.filter("start_time is not null and end_time is not null").select(F.col("modality_id").alias(i), F.col("start_time").alias(f"s{i}"), F.col("end_time").alias(f"e{i}")) for i in ("source", "target"))
    met = a.join(b, (F.col("source") < F.col("target")) & (F.col("ssource") < F.col("etarget")) & (F.col("starget") < F.col("esource")))
    return met.select("source", "target", time_share(F.col("ssource"), F.col("esource"), F.col("starget"), F.col("etarget")).alias("score")).filter(F.col("score") >= least)


def spatial_relations(modalities: DataFrame, least: float = 0.3) -> DataFrame:
    """(source, target, score): pairs of modalities by coordinates (lat, lon) where both have them, else by place names (locations)."""
    a, b = (modalities.select(*(F.col(c).alias(f"{i}_{c}") for c in ("modality_id", "lat", "lon", "locations"))) for i in ("a", "b"))
    near = place_nearness(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    has = F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull()
    score = F.when(has, near).otherwise(F.coalesce(place_similarity(F.col("a_locations"), F.col("b_locations")), F.lit(0.0)))
    met = a.join(b, F.col("a_modality_id") < F.col("b_modality_id"))
    return met.select(F.col("a_modality_id").alias("source"), F.col("b_modality_id").alias("target"), score.alias("score")).filter(F.col("score") >= least)


def within_hops(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, distance): nodes at most ``hops`` undirected steps from ``start``, without it. Each step is written to the shared folder, so that the next reads only what is new."""
    spark = edges.sparkSession
    both = written(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "hops")
    front = seen = spark.createDataFrame([(start, 0)], "node string, distance int")
    for d in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.lit(d).alias("distance")).distinct()
        front = written(step.join(seen.select("node"), "node", "left_anti"), "hops")
        seen = seen.unionByName(front)
    return seen.filter("distance > 0")


def simple_paths(edges: DataFrame, start: str, end: str | Column, most: int = 3) -> DataFrame:
    """(path): directed paths without a repeated node, of at most ``most`` edges, to ``end``: a node, or a condition on an edge's target."""
    e = edges.select("source", "target").distinct().withColumn("ends", F.col("target") == end if isinstance(end, str) else end)
    path = e.filter(F.col("source") == start).select(F.array("source", "target").alias("path"), "ends")
    out = path.filter("ends").select("path")
    for _ in range(most - 1):
        path = path.filter(~F.col("ends")).select("path").join(e, F.element_at("path", -1) == F.col("source")).filter(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"), "ends")
        out = out.unionByName(path.filter("ends").select("path"))
    return out


def common_entities(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """(entity_id): entities that both modalities mention."""
    of = lambda m: mentions.filter(F.col("modality_id") == m).select("entity_id")
    return of(a).intersect(of(b))


def modality_similarity(mentions: DataFrame) -> DataFrame:
    """(source, target, similarity): Jaccard of the entities of modalities that share one."""
    m = mentions.select("modality_id", "entity_id").distinct()
    n = m.groupBy("modality_id").agg(F.count("*").alias("n"))
    met = m.select(F.col("modality_id").alias("source"), "entity_id").join(m.select(F.col("modality_id").alias("target"), "entity_id"), "entity_id").filter("source < target").groupBy("source", "target").agg(F.count("*").alias("both"))
    t = met.join(n.select(F.col("modality_id").alias("source"), F.col("n").alias("ns")), "source").join(n.select(F.col("modality_id").alias("target"), F.col("n").alias("nt")), "target")
    return t.select("source", "target", (F.col("both") / (F.col("ns") + F.col("nt") - F.col("both"))).alias("similarity"))


def by_type(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.filter(F.col(column) == value)


def by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.lower("canonical_name") == name.lower())


def in_time(modalities: DataFrame, start, end) -> DataFrame:
    """Modalities of which either end of the time range lies inside."""
    return modalities.filter(F.col("start_time").between(F.lit(start), F.lit(end)) | F.col("end_time").between(F.lit(start), F.lit(end)))


def at_place(modalities: DataFrame, place: str) -> DataFrame:
    return modalities.filter(F.exists("locations", lambda p: F.lower(p).contains(place.lower())))


def statistics(modalities: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, kind, n): rows of each table of the graph by type."""
    count = lambda df, part, c: df.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(modalities, "modalities", "modality_type").unionByName(count(entities, "entities", "entity_type")).unionByName(count(relations, "relations", "relation_type"))


def save(tables: Mapping[str, DataFrame], path: str, format: str = "parquet") -> None:
    """The graph's tables, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).save(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: Sequence[str], format: str = "parquet", schemas: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    return {n: (spark.read.schema(schemas[n]) if schemas and n in schemas else spark.read).format(format).load(f"{path}/{n}") for n in names}


def match_tables(columns: DataFrame, question_words: Sequence[str], most: int = 20) -> DataFrame:
    """(table, score, rank): tables by the share of the question's words that their names and columns have. One row for each table."""
    words = F.array(*(F.lit(w) for w in question_words)) if question_words else F.array().cast("array<string>")
    parts = F.flatten(F.collect_set(F.split(F.lower(F.concat_ws("_", "table", "column")), "[^a-z0-9]+")))
    g = columns.groupBy("table").agg(F.array_distinct(parts).alias("w"))
    s = g.withColumn("score", F.when(F.size(words) > 0, F.size(F.array_intersect("w", words)) / F.size(words)).otherwise(0.0))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "table"))).filter(F.col("rank") <= most).select("table", "score", "rank")


def schema_context(columns: DataFrame, representatives: DataFrame | None = None, most_columns: int = 200) -> str:
    """A text that names tables, columns and their frequent values, for prompts."""
    rows = columns.select("table", "column", "type").orderBy("table", "column").limit(most_columns).collect()
    examples: dict[tuple[str, str], list[str]] = {}
    if representatives is not None:
        for r in representatives.orderBy("table", "column", F.desc("n"), "canonical_name").limit(most_columns * 6).collect():
            examples.setdefault((r["table"], r["column"]), []).append(r["canonical_name"])
    lines, table = [], None
    for r in rows:
        if r["table"] != table:
            table = r["table"]
            lines.append(f"{table}:")
        shown = examples.get((table, r["column"]))
        lines.append(f"  {r['column']} {r['type']}" + (f" (such as {', '.join(shown)})" if shown else ""))
    return "\n".join(lines)
