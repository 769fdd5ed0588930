"""Fixed values of the plan algebra: operators, grammar edges, implementations, uncertainty profiles."""

from __future__ import annotations

from typing import NamedTuple

SCAN, FILTER, PROJECT, AGGREGATE, SORT, LIMIT, DISTINCT, JOIN, UNION = "SCAN FILTER PROJECT AGGREGATE SORT LIMIT DISTINCT JOIN UNION".split()
SEMANTIC_SEARCH, CROSS_MODAL_MATCH, CONTENT_EXTRACT, SIMILARITY_JOIN, FEATURE_TRANSFORM = "SEMANTIC_SEARCH CROSS_MODAL_MATCH CONTENT_EXTRACT SIMILARITY_JOIN FEATURE_TRANSFORM".split()
VISUALIZE, EXPORT = "VISUALIZE EXPORT".split()


class Spec(NamedTuple):
    """What an operator takes and gives."""

    least: int
    most: int
    takes: tuple[str, ...]
    gives: str
    category: str


#: Arity, input modalities, output modality and category of each operator.
OPERATORS: dict[str, Spec] = {
    SCAN: Spec(0, 0, (), "ANY", "access"),
    FILTER: Spec(1, 1, ("ANY",), "ANY", "transform"),
    PROJECT: Spec(1, 1, ("ANY",), "ANY", "transform"),
    AGGREGATE: Spec(1, 1, ("ANY",), "TABULAR", "transform"),
    SORT: Spec(1, 1, ("TABULAR", "MIXED", "ANY"), "ANY", "transform"),
    LIMIT: Spec(1, 1, ("ANY",), "ANY", "transform"),
    DISTINCT: Spec(1, 1, ("ANY",), "ANY", "transform"),
    JOIN: Spec(2, 2, ("ANY",), "MIXED", "transform"),
    UNION: Spec(2, 4, ("ANY",), "ANY", "transform"),
    SEMANTIC_SEARCH: Spec(1, 1, ("TEXT", "IMAGE", "ANY"), "EMBEDDING", "cross_modal"),
    CROSS_MODAL_MATCH: Spec(2, 2, ("IMAGE", "TEXT", "EMBEDDING", "ANY"), "MIXED", "cross_modal"),
    CONTENT_EXTRACT: Spec(1, 1, ("IMAGE", "TEXT", "ANY"), "TABULAR", "cross_modal"),
    SIMILARITY_JOIN: Spec(2, 2, ("EMBEDDING", "ANY"), "MIXED", "cross_modal"),
    FEATURE_TRANSFORM: Spec(1, 1, ("IMAGE", "TEXT", "TABULAR", "ANY"), "EMBEDDING", "cross_modal"),
    VISUALIZE: Spec(1, 1, ("ANY",), "MIXED", "output"),
    EXPORT: Spec(1, 1, ("ANY",), "TABULAR", "output"),
}

#: Children of each operator with their scores.
PUBLISHED_EDGES: dict[str, dict[str, float]] = {
    FILTER: {SCAN: 1.0, SEMANTIC_SEARCH: 0.9, CONTENT_EXTRACT: 0.85, JOIN: 0.85, FEATURE_TRANSFORM: 0.8, PROJECT: 0.8},
    PROJECT: {FILTER: 1.0, SCAN: 1.0, JOIN: 0.9, AGGREGATE: 0.85, SEMANTIC_SEARCH: 0.8},
    AGGREGATE: {FILTER: 1.0, SCAN: 0.9, SEMANTIC_SEARCH: 0.85, JOIN: 0.8, CONTENT_EXTRACT: 0.75, CROSS_MODAL_MATCH: 0.7, PROJECT: 0.85},
    SORT: {FILTER: 1.0, AGGREGATE: 0.9, PROJECT: 0.85, SCAN: 0.85, JOIN: 0.85, SEMANTIC_SEARCH: 0.8},
    LIMIT: {SORT: 1.0, FILTER: 0.8, SCAN: 0.7},
    DISTINCT: {FILTER: 1.0, SCAN: 0.9, PROJECT: 0.85, JOIN: 0.8},
    JOIN: {SCAN: 1.0, FILTER: 0.9, SEMANTIC_SEARCH: 0.85, PROJECT: 0.8},
    UNION: {SCAN: 0.9, FILTER: 0.85, PROJECT: 0.8},
    SEMANTIC_SEARCH: {SCAN: 1.0, FILTER: 0.7},
    CROSS_MODAL_MATCH: {CONTENT_EXTRACT: 1.0, SEMANTIC_SEARCH: 0.9, FEATURE_TRANSFORM: 0.9, SCAN: 0.85},
    CONTENT_EXTRACT: {SCAN: 1.0, FILTER: 0.8},
    SIMILARITY_JOIN: {SEMANTIC_SEARCH: 1.0, SCAN: 0.9, FEATURE_TRANSFORM: 0.9, FILTER: 0.85},
    FEATURE_TRANSFORM: {SCAN: 1.0, FILTER: 0.85, CONTENT_EXTRACT: 0.8},
    VISUALIZE: {AGGREGATE: 1.0, SORT: 0.9, PROJECT: 0.85, FILTER: 0.8, DISTINCT: 0.8, CONTENT_EXTRACT: 0.75, FEATURE_TRANSFORM: 0.7},
    EXPORT: {AGGREGATE: 1.0, PROJECT: 0.9, SORT: 0.9, FILTER: 0.85, DISTINCT: 0.85},
}

#: Edges added so that every operator can stand below an output, and limits below projections.
ADDED_EDGES: dict[str, dict[str, float]] = {
    VISUALIZE: {LIMIT: 0.9, SCAN: 0.6, JOIN: 0.7, UNION: 0.7, SEMANTIC_SEARCH: 0.7, SIMILARITY_JOIN: 0.7, CROSS_MODAL_MATCH: 0.7},
    EXPORT: {LIMIT: 0.9, SCAN: 0.7, JOIN: 0.75, UNION: 0.75, SEMANTIC_SEARCH: 0.75, SIMILARITY_JOIN: 0.75, CROSS_MODAL_MATCH: 0.75, CONTENT_EXTRACT: 0.75, FEATURE_TRANSFORM: 0.75},
    PROJECT: {LIMIT: 0.85, SORT: 0.85, DISTINCT: 0.85, UNION: 0.8, SIMILARITY_JOIN: 0.8, CROSS_MODAL_MATCH: 0.8, CONTENT_EXTRACT: 0.8, FEATURE_TRANSFORM: 0.8},
    FILTER: {UNION: 0.8, SIMILARITY_JOIN: 0.8, CROSS_MODAL_MATCH: 0.8, AGGREGATE: 0.7},
    AGGREGATE: {UNION: 0.75, SIMILARITY_JOIN: 0.7, FEATURE_TRANSFORM: 0.7, DISTINCT: 0.8},
    SORT: {UNION: 0.8, SIMILARITY_JOIN: 0.8, CROSS_MODAL_MATCH: 0.75, CONTENT_EXTRACT: 0.75, FEATURE_TRANSFORM: 0.75, DISTINCT: 0.8},
    LIMIT: {UNION: 0.7, SIMILARITY_JOIN: 0.75, CROSS_MODAL_MATCH: 0.7, CONTENT_EXTRACT: 0.7, FEATURE_TRANSFORM: 0.7, SEMANTIC_SEARCH: 0.8, JOIN: 0.7, AGGREGATE: 0.75, DISTINCT: 0.75, PROJECT: 0.75},
    DISTINCT: {UNION: 0.8, SEMANTIC_SEARCH: 0.75, CONTENT_EXTRACT: 0.75, CROSS_MODAL_MATCH: 0.7, SIMILARITY_JOIN: 0.7, FEATURE_TRANSFORM: 0.7},
    JOIN: {CONTENT_EXTRACT: 0.75, JOIN: 0.75, FEATURE_TRANSFORM: 0.7},
    UNION: {JOIN: 0.75, SEMANTIC_SEARCH: 0.75, CONTENT_EXTRACT: 0.7, FEATURE_TRANSFORM: 0.7},
    SEMANTIC_SEARCH: {JOIN: 0.65, CONTENT_EXTRACT: 0.65, UNION: 0.6, FEATURE_TRANSFORM: 0.6},
    CONTENT_EXTRACT: {JOIN: 0.7, SEMANTIC_SEARCH: 0.7, UNION: 0.65, FEATURE_TRANSFORM: 0.6},
    CROSS_MODAL_MATCH: {FILTER: 0.7, JOIN: 0.65},
    SIMILARITY_JOIN: {CONTENT_EXTRACT: 0.7, JOIN: 0.65},
    FEATURE_TRANSFORM: {JOIN: 0.7, UNION: 0.7},
}


class Impl(NamedTuple):
    """A physical implementation and what it needs."""

    name: str
    cost: float
    confidence: float
    gpu_mb: int
    cores: int
    mb: int


#: Implementations of each operator.
IMPLEMENTATIONS: dict[str, tuple[Impl, ...]] = {
    SCAN: (Impl("TABLE_SCAN", 1, 0.99, 0, 1, 256), Impl("INDEX_SCAN", 0.5, 0.99, 0, 1, 128)),
    FILTER: (Impl("PREDICATE_FILTER", 0.3, 0.96, 0, 1, 128), Impl("THRESHOLD_FILTER", 0.5, 0.8, 0, 1, 128)),
    PROJECT: (Impl("COLUMN_PROJECT", 0.2, 0.99, 0, 1, 64),),
    AGGREGATE: (Impl("HASH_AGGREGATE", 2, 0.93, 0, 2, 512), Impl("STREAM_AGGREGATE", 1.5, 0.91, 0, 1, 256)),
    SORT: (Impl("MEMORY_SORT", 1, 0.95, 0, 1, 512), Impl("EXTERNAL_SORT", 2, 0.93, 0, 2, 1024)),
    LIMIT: (Impl("STREAMING_LIMIT", 0.1, 0.99, 0, 1, 32),),
    DISTINCT: (Impl("HASH_DISTINCT", 1.5, 0.93, 0, 1, 512), Impl("STREAM_DISTINCT", 1.2, 0.91, 0, 1, 256)),
    JOIN: (Impl("HASH_JOIN", 3, 0.92, 0, 2, 1024), Impl("NESTED_LOOP_JOIN", 5, 0.9, 0, 1, 512)),
    UNION: (Impl("UNION_ALL", 1, 0.95, 0, 1, 256),),
    SEMANTIC_SEARCH: (Impl("VECTOR_SEARCH", 3, 0.7, 512, 2, 1024), Impl("VECTOR_SCAN", 5, 0.7, 0, 4, 2048)),
    CROSS_MODAL_MATCH: (Impl("CROSS_MODAL_MATCH", 6, 0.52, 2048, 4, 4096), Impl("CROSS_MODAL_JOIN", 8, 0.55, 1024, 2, 2048)),
    CONTENT_EXTRACT: (Impl("YOLO_OBJECT_DETECTOR", 6, 0.72, 2048, 2, 2048), Impl("DETR_OBJECT_DETECTOR", 8, 0.75, 4096, 4, 4096), Impl("IMAGE_ANALYSIS", 10, 0.68, 2048, 2, 2048)),
    SIMILARITY_JOIN: (Impl("INTRA_MODAL_JOIN", 5, 0.62, 1024, 2, 2048), Impl("SEMANTIC_JOIN", 7, 0.6, 1024, 4, 4096)),
    FEATURE_TRANSFORM: (Impl("CLIP_IMAGE_ENCODER", 4, 0.72, 2048, 2, 2048), Impl("CLIP_TEXT_ENCODER", 3, 0.73, 1024, 2, 1024)),
    VISUALIZE: (Impl("MATERIALIZE", 1, 0.97, 0, 1, 256),),
    EXPORT: (Impl("CSV_EXPORT", 0.5, 0.98, 0, 1, 128), Impl("JSON_EXPORT", 0.5, 0.98, 0, 1, 128)),
}

#: Cost and confidence of an operator where no implementation is registered.
COST_PRIOR = {SCAN: 1, FILTER: 0.5, PROJECT: 0.2, AGGREGATE: 2, SORT: 1.5, LIMIT: 0.1, DISTINCT: 1.5, JOIN: 4, UNION: 1, SEMANTIC_SEARCH: 5, CROSS_MODAL_MATCH: 6, CONTENT_EXTRACT: 8, SIMILARITY_JOIN: 6, FEATURE_TRANSFORM: 4, VISUALIZE: 1, EXPORT: 0.5}
CONFIDENCE_PRIOR = {SCAN: 0.98, FILTER: 0.93, PROJECT: 0.99, AGGREGATE: 0.91, SORT: 0.94, LIMIT: 0.98, DISTINCT: 0.92, JOIN: 0.88, UNION: 0.94, SEMANTIC_SEARCH: 0.68, CROSS_MODAL_MATCH: 0.53, CONTENT_EXTRACT: 0.72, SIMILARITY_JOIN: 0.62, FEATURE_TRANSFORM: 0.7, VISUALIZE: 0.97, EXPORT: 0.98}
UNKNOWN_COST, UNKNOWN_CONFIDENCE = 2.0, 0.70

#: Fixed values: (confidence, decay, sensitivity, risk) of implementations.
PROFILES: dict[str, tuple[float, float, float, float]] = {
    "TABLE_SCAN": (0.99, 0.001, 0, 0), "INDEX_SCAN": (0.99, 0.001, 0, 0), "LINEAR_SCAN": (0.98, 0.002, 0, 0), "FILE_SCAN": (0.97, 0.003, 0, 0),
    "PREDICATE_FILTER": (0.96, 0.002, 0, 0.02), "COLUMN_PROJECT": (0.99, 0.001, 0, 0), "STREAMING_LIMIT": (0.99, 0.001, 0, 0), "TOP_N": (0.98, 0.001, 0, 0),
    "HASH_JOIN": (0.92, 0.005, 0.05, 0.05), "NESTED_LOOP_JOIN": (0.9, 0.008, 0.05, 0.05), "HASH_AGGREGATE": (0.93, 0.004, 0.03, 0.03), "STREAM_AGGREGATE": (0.91, 0.005, 0.03, 0.03),
    "MEMORY_SORT": (0.95, 0.003, 0, 0.01), "EXTERNAL_SORT": (0.93, 0.005, 0, 0.02), "HASH_DISTINCT": (0.93, 0.004, 0, 0.02), "STREAM_DISTINCT": (0.91, 0.005, 0, 0.02),
    "UNION_ALL": (0.95, 0.002, 0, 0.01), "HASH_INTERSECT": (0.93, 0.004, 0, 0.02), "SORT_INTERSECT": (0.92, 0.004, 0, 0.02), "HASH_EXCEPT": (0.93, 0.004, 0, 0.02),
    "MATERIALIZE": (0.97, 0.002, 0, 0.01), "CSV_EXPORT": (0.98, 0.001, 0, 0), "JSON_EXPORT": (0.98, 0.001, 0, 0), "TEXT_ANALYSIS": (0.75, 0.015, 0.3, 0.25),
    "YOLO_OBJECT_DETECTOR": (0.72, 0.018, 0.35, 0.3), "DETR_OBJECT_DETECTOR": (0.75, 0.015, 0.3, 0.28), "IMAGE_ANALYSIS": (0.68, 0.02, 0.35, 0.32),
    "CLIP_TEXT_ENCODER": (0.73, 0.012, 0.25, 0.22), "CLIP_IMAGE_ENCODER": (0.72, 0.014, 0.28, 0.25), "VECTOR_SEARCH": (0.7, 0.015, 0.25, 0.22), "VECTOR_SCAN": (0.7, 0.015, 0.25, 0.22),
    "CROSS_MODAL_JOIN": (0.55, 0.025, 0.5, 0.48), "CROSS_MODAL_MATCH": (0.52, 0.028, 0.55, 0.5), "IMAGE_TO_TEXT_CAPTIONER": (0.58, 0.022, 0.45, 0.42), "SIMILARITY_FILTER": (0.65, 0.018, 0.3, 0.28),
    "THRESHOLD_FILTER": (0.8, 0.01, 0.15, 0.12), "INTRA_MODAL_JOIN": (0.62, 0.02, 0.35, 0.3), "SEMANTIC_JOIN": (0.6, 0.022, 0.4, 0.35), "RELEVANCE_RANK": (0.65, 0.018, 0.3, 0.28),
}
DEFAULT_PROFILE = (0.7, 0.015, 0.2, 0.2)

#: What coupling modalities costs in confidence.
COUPLING = {"CROSS_MODAL_MATCH": 0.20, "CROSS_MODAL_JOIN": 0.18, "IMAGE_TO_TEXT_CAPTIONER": 0.15, "SEMANTIC_JOIN": 0.12, "SIMILARITY_JOIN": 0.10, "INTRA_MODAL_JOIN": 0.08}

#: Benchmark verbs and the operators they stand for.
VERBS = {
    "filter": FILTER, "map": CONTENT_EXTRACT, "reduce": AGGREGATE, "rank": SORT, "join": JOIN,
    "sem_filter": FILTER, "sem_map": CONTENT_EXTRACT, "sem_agg": AGGREGATE, "sem_topk": SORT, "sem_join": CROSS_MODAL_MATCH, "sem_search": SEMANTIC_SEARCH,
}
