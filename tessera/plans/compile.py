"""From a bound plan to one lazy DataFrame, which Catalyst then optimizes as a whole."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import operators as O
from ..provider import OfflineProvider, Provider
from ..sources import Catalog, work_path, write
from .physical import JOIN_HINTS
from .tree import PlanNode


@dataclass
class Run:
    """What a compilation needs and leaves behind."""

    catalog: Catalog
    provider: Provider = field(default_factory=OfflineProvider)
    choice: Mapping[str, str] = field(default_factory=dict)
    observe: bool = False
    observations: list[tuple[PlanNode, Observation]] = field(default_factory=list)
    #: Of each EXPORT, where it was written, and its manifest.
    exports: list[tuple[str, DataFrame]] = field(default_factory=list)


def _vector(df: DataFrame) -> str | None:
    return next((c for c, t in df.dtypes if t in ("array<float>", "array<double>")), None)


def _id(df: DataFrame) -> str:
    return next((c for c in df.columns if c.lower() == "id" or c.lower().endswith(("_id", "key"))), df.columns[0])


def _filter(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    df = O.keep(ins[0], node.params.get("conditions", ()))  # plain comparisons first: they reach the scan
    if "semantic" in node.params and (c := node.params.get("column") or O.text_column(df)):
        return O.semantic_filter(df, c, node.params["semantic"], run.provider, node.params.get("votes", 1))
    return df


def _search(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    df = ins[0]
    if "vector" in node.params:
        return O.vector_search(df, node.params.get("column") or _vector(df), node.params["vector"], node.params.get("n", 10), _id(df))
    c = node.params.get("column") or O.text_column(df)
    if c is None:
        raise ValueError("there is no text to search in")
    return O.text_search(df, c, node.params["question"], node.params.get("n"), _id(df))


def _extract(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    df = ins[0]
    if "rules" in node.params:
        return O.extract(df, node.params["rules"])
    c = node.params.get("column") or O.text_column(df)
    labels = node.params.get("labels", ("positive", "negative", "neutral"))
    return df if c is None else O.labelled(df, c, labels, provider=run.provider, keep_unknown=True)


def _match(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    a, b = ins
    x, y = O.text_column(a), O.text_column(b)
    if node.params.get("keys") or x is None or y is None:
        return O.join(a, b, node.params.get("keys"), JOIN_HINTS.get(run.choice.get(node.op, "")))
    return O.shared_shingles(a, b, _id(a), _id(b), x, y, node.params.get("words", 8))


def _similar(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    a, b = ins
    v = node.params.get("column") or _vector(a)
    if v is None:
        return O.join(a, b)
    return O.similarity_join(a, b, _id(a), _id(b), v, node.params.get("threshold", 0.9), same=node.children[0] == node.children[1])


def _scan(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    """The table; where the question quotes one of its ids, that entity's rows."""
    df = run.catalog[node.params["table"]]
    quoted = node.params.get("entities")
    if not quoted or "id" not in df.columns:
        return df
    key = F.col("id").cast("string")
    known = {r[0] for r in df.filter(key.isin(*quoted)).select(key.alias("id")).distinct().collect()}  # no more than are quoted
    named = next((q for q in quoted if q in known), None)
    return df if named is None else df.filter(key == named)


def _aggregate(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    measures = node.params.get("measures", (("count", None),))
    plain = O.aggregate(ins[0], measures, node.params.get("by", ()))
    if node.params.get("question") and type(run.provider) is not OfflineProvider:
        return O.model_aggregate(ins[0], node.params["question"], run.provider, plain)
    return plain


def _export(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    """Written where the plan says, or to the shared folder; the result is what was written."""
    kind = node.params.get("format") or {"CSV_EXPORT": "csv", "JSON_EXPORT": "json"}[run.choice.get(node.op, "CSV_EXPORT")]
    df = ins[0]
    path = node.params.get("path") or work_path(df.sparkSession, "export")
    write(df, path, kind)
    run.exports.append((path, O.manifest(df, kind)))
    return df


def _distinct(node: PlanNode, ins: list[DataFrame], run: Run) -> DataFrame:
    return O.distinct(O.project(ins[0], node.params.get("columns")))


COMPILERS: dict[str, Callable[[PlanNode, list[DataFrame], Run], DataFrame]] = {
    "SCAN": _scan,
    "FILTER": _filter,
    "PROJECT": lambda n, i, _: O.project(i[0], n.params.get("columns")),
    "AGGREGATE": _aggregate,
    "SORT": lambda n, i, _: O.order(i[0], n.params["keys"], [c for c, t in i[0].dtypes if not t.startswith(("map", "variant")) and c not in [k for k, _ in n.params["keys"]]][:1]),
    "LIMIT": lambda n, i, _: i[0].limit(n.params.get("n", 5)),
    "DISTINCT": _distinct,
    "JOIN": lambda n, i, r: O.join(i[0], i[1], n.params.get("keys"), JOIN_HINTS.get(n.params.get("impl") or r.choice.get(n.op, ""))),
    "UNION": lambda n, i, _: O.union(*i),
    "SEMANTIC_SEARCH": _search,
    "CROSS_MODAL_MATCH": _match,
    "CONTENT_EXTRACT": _extract,
    "SIMILARITY_JOIN": _similar,
    "FEATURE_TRANSFORM": lambda n, i, _: O.normalize(i[0], n.params.get("columns")),
    "VISUALIZE": lambda n, i, _: O.column_stats(i[0], n.params.get("columns")),
    "EXPORT": _export,
}


def compile_plan(plan: PlanNode, run: Run) -> DataFrame:
    """The DataFrame of a bound plan. With ``observe`` each operator's rows are counted while the result is computed."""
    if plan.op not in COMPILERS:
        raise ValueError(f"unknown operator {plan.op}")
    df = COMPILERS[plan.op](plan, [compile_plan(c, run) for c in plan.children], run)
    if run.observe:
        seen = Observation()
        run.observations.append((plan, seen))
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    return df
