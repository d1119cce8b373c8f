"""Matching names: TF-IDF vectors in long form, scores, and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the scores and their bounds.
WORD_WEIGHT, GRAM_WEIGHT = 1.0, 0.5
TABLE_WEIGHTS = (0.5, 0.4, 0.1)
COLUMN_WEIGHTS = {"name": 0.45, "type": 0.20, "structure": 0.15, "profile": 0.20}
AUTO_ACCEPT, CANDIDATE, FUZZY_NAME, LEAST_NAME, LEAST_SHOWN, TOP_K = 0.85, 0.50, 0.8, 0.3, 0.2, 3


def features(tokens: DataFrame) -> DataFrame:
    """(doc, feature, tf) from (doc, tokens): whole words, and trigrams of the words between marks."""
    joined = F.concat(F.lit("#"), F.concat_ws("#", "tokens"), F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(joined) - 2), lambda i: F.concat(F.lit("g:"), F.substring(joined, i, 3)))
    words = F.transform("tokens", lambda w: F.concat(F.lit("w:"), w))
    named = tokens.where(F.size("tokens") > 0).select("doc", F.explode(F.concat(words, grams)).alias("feature"))
    return named.groupBy("doc", "feature").agg(F.count("*").alias("tf"))


def tfidf(tokens: DataFrame) -> DataFrame:
    """(doc, feature, weight), weights of a document of length one; idf = ln((1 + N) / (1 + df)) + 1."""
    counts = features(tokens)
    total = tokens.agg(F.count("*").alias("docs"))
    idf = counts.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("feature", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counts.join(idf, "feature").select("doc", "feature", (F.col("tf") * F.col("idf") * F.when(F.col("feature").startswith("w:"), WORD_WEIGHT).otherwise(GRAM_WEIGHT)).alias("raw"))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, "doc").select("doc", "feature", (F.col("raw") / F.col("length")).alias("weight"))


def cosine_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) of the documents that share a feature: an equi-join on features, summed by pair."""
    a = left.select(F.col("doc").alias("a"), "feature", F.col("weight").alias("wa"))
    b = right.select(F.col("doc").alias("b"), "feature", F.col("weight").alias("wb"))
    return a.join(b, "feature").groupBy("a", "b").agg(F.least(F.lit(1.0), F.sum(F.col("wa") * F.col("wb"))).alias("score"))


def top_k(scores: DataFrame, by: str, other: str, k: int = TOP_K, least: float = LEAST_SHOWN) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), other))
    return scores.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def degrees(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(table_key, degree): foreign keys out and in."""
    ends = edges.select(F.col(child).alias("table_key")).unionAll(edges.select(F.col(parent).alias("table_key")))
    return ends.groupBy("table_key").agg(F.count("*").alias("degree"))


def degree_similarity(a: int, b: int) -> float:
    return 1.0 if a == b == 0 else 1 - abs(a - b) / max(a, b)


def table_score(name: float, best_columns: list[float], degree_a: int, degree_b: int) -> float:
    x, y, z = TABLE_WEIGHTS
    mean = sum(best_columns) / len(best_columns) if best_columns else 0.0
    return round(x * name + y * mean + z * degree_similarity(degree_a, degree_b), 3)


def column_score(name: float, kind: float, structure: float, profile: float | None) -> float:
    """The weight of a profile that is not there goes to the name."""
    w = COLUMN_WEIGHTS
    if profile is None:
        return round((w["name"] + w["profile"]) * name + w["type"] * kind + w["structure"] * structure, 3)
    return round(w["name"] * name + w["type"] * kind + w["structure"] * structure + w["profile"] * profile, 3)


def structure_score(same_pk_role: bool, fk_role: float, same_identity: bool, source_nullable: bool, target_nullable: bool) -> float:
    nulls = 1.0 if source_nullable == target_nullable else 0.75 if target_nullable else 0.0
    return (same_pk_role + fk_role + same_identity + nulls) / 4


#: Words of a column's name that a class of values calls for, and how far a class suits a family of types.
CLASS_WORDS = {
    "email": ("email", "mail"), "phone": ("phone", "telephone", "mobile", "fax"), "url": ("url", "website", "link", "uri"),
    "postal_code": ("postal", "zip", "postcode"), "country_code": ("country",),
}
CLASS_FAMILIES = {
    "guid": {"guid": 1.0}, "date": {"date": 1.0, "datetime": 1.0}, "datetime": {"date": 1.0, "datetime": 1.0}, "flag": {"bit": 1.0}, "text": {"string": 1.0},
    "integer": {"integer": 1.0, "decimal": 1.0, "float": 1.0, "string": 0.5, "": 0.2}, "decimal": {"decimal": 1.0, "float": 1.0, "integer": 0.5, "": 0.2},
}
POOR_FIT = 0.3


def class_fit(name: str, family: str, length: int, tokens: list[str]) -> float:
    """How far a class of values suits a column by its name or its type."""
    if name in CLASS_WORDS:
        return 1.0 if set(CLASS_WORDS[name]) & {t.lower() for t in tokens} else POOR_FIT
    if name == "flag" and family == "string" and length == 1:
        return 1.0
    known = CLASS_FAMILIES.get(name, CLASS_FAMILIES["text"])
    return known.get(family, known.get("", POOR_FIT))


def profile_score(source: dict | None, target: dict | None, family: str, length: int, required: bool, unique: bool, tokens: list[str]) -> float | None:
    """How like the values of two columns are: the mean of what can be compared; None without a profile of the source.

    Where the target has no profile, its type, name, length and keys stand in for one.
    """
    if not source or not source.get("sampled_rows"):
        return None
    seen = target if target and target.get("sampled_rows") else {}
    parts = []
    kind, other = source.get("semantic_class"), seen.get("semantic_class")
    if kind:
        parts.append(float(kind == other) if other else class_fit(kind, family, length, tokens))
    parts.append(1 - abs(source["null_ratio"] - seen["null_ratio"]) if seen else float(not (required and source["nulls"])))
    many, others = source.get("distinct_ratio"), seen.get("distinct_ratio")
    if many is not None and (others is not None or unique):
        parts.append(1 - abs(many - others) if others is not None else many)
    longest, room = source.get("max_len") or 0, seen.get("max_len") or 0
    if longest > 0 and family == "string":
        bound = room or length
        parts.append(min(longest, room) / max(longest, room) if room else 1.0 if bound <= 0 else min(1.0, bound / longest))
    return sum(parts) / len(parts)


def method_of(name_similarity: float, exact: bool) -> str:
    return "exact" if exact else "fuzzy" if name_similarity >= FUZZY_NAME else "vector"


def greedy_assignment(pairs: list[tuple[str, str, float, float]], least: float = CANDIDATE) -> dict[str, tuple[str, float]]:
    """target -> (source, score) one to one, from (target, source, score, name similarity) in ordinal order: best scores first."""
    order = sorted(range(len(pairs)), key=lambda k: (-pairs[k][2], k))
    out: dict[str, tuple[str, float]] = {}
    used: set[str] = set()
    for k in order:
        target, source, score, name = pairs[k]
        if score < least:
            break
        if name >= LEAST_NAME and target not in out and source not in used:
            out[target] = (source, score)
            used.add(source)
    return out


def greedy_by_group(pairs: DataFrame, group: str) -> DataFrame:
    """greedy_assignment for each group of (group, target, source, score, name): groups are tables' columns, so they are small."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values(["target", "source"])
        found = greedy_assignment(list(frame[["target", "source", "score", "name"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(key[0], t, s, x) for t, (s, x) in found.items()], columns=[group, "target", "source", "score"])

    kind = dict(pairs.dtypes)
    return pairs.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, target {kind['target']}, source {kind['source']}, score double")
