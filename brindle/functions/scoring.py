"""Column expressions for confidence, ranking and text scores (whole-stage code, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Weight and path floor of each resolver.
WEIGHTS = {"Compiler": 1.0, "Lsp": 0.85, "Ast": 0.60, "Textual": 0.30}
FLOORS = {"Compiler": 0.5, "Lsp": 0.4, "Ast": 0.25, "Textual": 0.1}
#: Words that say nothing about a body.
STOP_TOKENS = ["def", "async", "return", "pass", "none", "true", "false", "self", "cls", "class"]
MASK = "__brindle_nm__"


def _pick(col: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(col == name, F.lit(value)).otherwise(out)
    return out


def source_weight(resolver: Column) -> Column:
    return _pick(resolver, WEIGHTS)


def path_floor(resolver: Column) -> Column:
    return _pick(resolver, FLOORS)


def freshness(ts_ms: Column, now_ms: int, half_life_days: int) -> Column:
    """max(0.5, exp(-age / tau)); 1 for a time of 0 or less, or tau 0. The half-life is used as tau."""
    tau = float(half_life_days * DAY_MS)
    if tau == 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(now_ms) - ts_ms, F.lit(0))
    return F.when(ts_ms.isNull() | (ts_ms <= 0), 1.0).otherwise(F.greatest(F.lit(0.5), F.exp(-age / F.lit(tau))))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def edge_confidence(resolver: Column, ts_ms: Column, now_ms: int, half_life_days: int) -> Column:
    return clamp01(source_weight(resolver) * freshness(ts_ms, now_ms, half_life_days))


def path_confidence(product: Column, least_resolver: Column) -> Column:
    return F.greatest(path_floor(least_resolver), product)


def structural_score(needle: Column, qualified_name: Column) -> Column:
    """Occurrences of the needle, not overlapping, plus 1 / bytes of the name; 0 if either is empty or none occurs."""
    n, q = F.lower(needle), F.lower(qualified_name)
    times = (F.length(q) - F.length(F.replace(q, n, F.lit("")))) / F.length(n)
    return F.when((F.length(n) == 0) | (F.length(q) == 0) | ~F.contains(q, n), 0.0).otherwise(F.floor(times) + 1.0 / F.octet_length(q))


def name_leaf(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def name_proximity(a: Column, b: Column) -> Column:
    """1 for equal leaves, else 1 - Levenshtein distance / bytes of the longer leaf."""
    x, y = name_leaf(a), name_leaf(b)
    return F.when(x == y, 1.0).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.octet_length(x), F.octet_length(y), F.lit(1)))


def tokens(text: Column) -> Column:
    """Distinct lower-case identifiers of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda x: x != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def meaningful(toks: Column) -> Column:
    return F.array_except(toks, F.array(*[F.lit(x) for x in STOP_TOKENS]))


def mask_identifier(text: Column, name: Column) -> Column:
    """Whole identifiers equal to name replaced by a mark."""
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when(F.length(name) == 0, text).otherwise(F.regexp_replace(text, pattern, F.lit(MASK)))


def token_count(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors: the dot product within [-1, 1]; 0 for empty arrays or different lengths."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) <= 0) | (F.size(a) != F.size(b)), 0.0).otherwise(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)))


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length; as it is if that is 0."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(v)


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """Value at index round((n - 1) * p), half away from zero, of a sorted array."""
    return F.element_at(sorted_values, (F.floor((F.size(sorted_values) - 1) * F.lit(p) + 0.5) + 1).cast("int"))


def symbol_rank(qualified_name: Column, file_path: Column, needle: str, prefer_hub: bool = False) -> Column:
    hub = qualified_name == file_path
    if prefer_hub:
        return F.when(hub, 0).when(F.endswith(qualified_name, F.lit(needle)), 1).otherwise(2)
    leaf = F.substring_index(qualified_name, "::", -1)
    return F.when(hub, 3).when(leaf == needle, 0).when(F.endswith(leaf, F.lit(needle)), 1).otherwise(2)


def stable_id(*parts: Column) -> Column:
    """A hex id of the parts: equal parts, equal id."""
    return F.md5(F.concat_ws("\x1f", *parts))
