"""Concepts and taxonomies: what a keyword means, and what speaks for or against it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that are no evidence by themselves (a start; a dictionary folder can bring more).
NON_EVIDENCE = ("sri", "shri", "sree", "om", "jai", "new", "the", "sai", "store", "stores", "shop", "centre", "center", "mart", "house", "and", "of")


@dataclass(frozen=True)
class Concept:
    """One concept: terms are lower-case words or phrases, categories as sources write them."""

    concept_id: str
    version: int = 1
    labels: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    medium: tuple[str, ...] = ()
    defining: tuple[str, ...] = ()
    host: tuple[str, ...] = ()
    incompatible: tuple[str, ...] = ()
    veto: tuple[str, ...] = ()
    incompatible_brands: tuple[str, ...] = ()
    require_defining: bool = True
    tau_hi: float = 0.75
    tau_lo: float = 0.35
    synthesized: bool = False

    def evidence_terms(self) -> tuple[str, ...]:
        """Strong terms that are evidence; where none is, the concept's own name."""
        return tuple(x for x in self.strong if x not in NON_EVIDENCE) or (self.concept_id.replace("_", " "),)

    def veto_terms(self) -> tuple[str, ...]:
        """Phrases, and each of their words."""
        return tuple(dict.fromkeys(w for v in self.veto for w in (v, *v.split())))


def load_concepts(folder: str) -> list[Concept]:
    """Concept files (YAML) of a folder; needs PyYAML."""
    import yaml

    out = []
    for path in sorted(Path(folder).glob("*.yaml")):
        d = yaml.safe_load(path.read_text()) or {}
        signals, categories = d.get("signals") or {}, d.get("categories") or {}
        words = lambda tree, *keys: tuple(str(x).lower() for k in keys for x in (tree.get(k) or ()))
        rules, taus = d.get("rules") or {}, d.get("thresholds") or {}
        out.append(Concept(d.get("concept_id", path.stem), int(d.get("version", 1)), words(d, "labels"), words(signals.get("defining_terms") or {}, "strong"), words(signals.get("supporting_terms") or {}, "medium"), words(categories, "defining"), words(categories, "host"), words(categories, "incompatible"), words(d, "veto_terms") or words(signals, "veto_terms"), words(d.get("brands") or {}, "incompatible"), bool(rules.get("require_defining", True)), float(taus.get("tau_hi", 0.75)), float(taus.get("tau_lo", 0.35))))
    return out


def concept_table(spark: SparkSession, concepts: list[Concept]) -> DataFrame:
    """The dictionary as rows, small enough to broadcast."""
    kinds = "concept_id string, version int, labels array<string>, strong array<string>, medium array<string>, defining array<string>, host array<string>, incompatible array<string>, veto array<string>, incompatible_brands array<string>, require_defining boolean, tau_hi double, tau_lo double, synthesized boolean"
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(c, x.split()[0]) for x in kinds.split(", "))) for c in concepts]
    return spark.createDataFrame(rows, kinds)


def alias_index(table: DataFrame) -> DataFrame:
    """(alias, concept_id): labels over terms; of equal ones the later concept."""
    rows = table.select("concept_id", F.explode(F.concat(F.transform("labels", lambda x: F.struct(F.lit(1).alias("p"), x.alias("a"))), F.transform("strong", lambda x: F.struct(F.lit(0).alias("p"), x.alias("a"))))).alias("x"))
    return rows.groupBy(F.lower("x.a").alias("alias")).agg(F.max_by("concept_id", F.struct("x.p", "concept_id")).alias("concept_id"))


def resolve(keyword: str, concepts: list[Concept]) -> tuple[str | None, float, str]:
    """A keyword's concept, how sure, and by which of six ways; none is an answer too."""
    import difflib

    text = re.sub(r"\s+", " ", keyword.strip().lower())
    stemmed = re.sub(r"ies$", "y", text) if text.endswith("ies") else re.sub(r"(?<!s)s$", "", text)
    ids = {c.concept_id: c for c in concepts}
    for x in (text, stemmed):
        if x.replace(" ", "_") in ids:
            return x.replace(" ", "_"), 1.0, "exact"
    aliases = {a.lower(): c.concept_id for c in concepts for a in (*c.strong, *c.labels)}
    for x in (text, stemmed):
        if x in aliases:
            return aliases[x], 0.95, "alias"
    close = [(difflib.SequenceMatcher(None, text, a).ratio(), a) for a in aliases if abs(len(a) - len(text)) <= 4]
    if close and max(close)[0] >= 0.78:
        return aliases[max(close)[1]], max(close)[0], "fuzzy"
    tokens = set(text.split())
    overlap = [(len(tokens & set(a.split())) / len(tokens | set(a.split())), a) for a in aliases] if tokens else []
    if overlap and max(overlap)[0] >= 0.75:
        return aliases[max(overlap)[1]], max(overlap)[0], "tokens"
    for c in concepts:
        if tokens & {w for d in c.defining for w in re.split(r"[_\W]+", d)}:
            return c.concept_id, 0.6, "taxonomy"
    return None, 0.5, "unresolved"


def plan(keyword: str, concepts: list[Concept]) -> dict:
    """What to look for: synonyms, categories and name patterns of the keyword's concept, in order, each once."""
    found, confidence, way = resolve(keyword, concepts)
    c = next((c for c in concepts if c.concept_id == found), Concept(keyword.replace(" ", "_"), strong=(keyword.lower(),), synthesized=True))
    return {"keyword": keyword, "concept_id": found, "confidence": confidence, "way": way, "synonyms": list(dict.fromkeys((*c.labels, *c.strong))), "categories": list(dict.fromkeys(c.defining)), "patterns": [rf"\b{re.escape(x)}\b" for x in dict.fromkeys(c.strong)]}


def planned(keywords: DataFrame, concepts: tuple[Concept, ...] | list[Concept]) -> DataFrame:
    """The plan of each of a table of distinct keywords: (keyword, concept_id, confidence, way, synonyms, categories, patterns).

    The dictionary is bounded and goes to the workers; keywords are looked up where they are, batch by batch.
    """
    cards = list(concepts)

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            found = [plan(k, cards) if k is not None else {"keyword": None, "way": "unresolved", "confidence": 0.5} for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("keyword", pa.string()), ("concept_id", pa.string()), ("confidence", pa.float64()), ("way", pa.string()), ("synonyms", pa.list_(pa.string())), ("categories", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))

    return keywords.select("keyword").mapInArrow(each, "keyword string, concept_id string, confidence double, way string, synonyms array<string>, categories array<string>, patterns array<string>")


def resolved(keywords: DataFrame, concepts: tuple[Concept, ...] | list[Concept]) -> DataFrame:
    """(keyword, concept_id, confidence, way) of a table of distinct keywords."""
    return planned(keywords, concepts).select("keyword", "concept_id", "confidence", "way")


def taxonomy_nodes(rows: DataFrame) -> DataFrame:
    """Tree nodes from ``primary_hierarchy`` (``a > b > c``): parent path, depth, tokens of three letters and more."""
    parts = F.split("primary_hierarchy", r"\s*>\s*")
    return rows.withColumns({"parent_path": F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " > "), "depth": F.size(parts), "tokens": F.array_distinct(F.filter(F.split(F.lower(F.element_at(parts, -1)), r"[\s_]+"), lambda x: F.length(x) > 2))})


def taxonomy_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best node of each query text (query): 1.0 by id, .98 by name, else by shared tokens; .70 and over."""
    q = queries.select("query", F.lower(F.trim("query")).alias("_q")).withColumn("_t", F.array_distinct(F.split("_q", r"[\s_]+")))
    n = nodes.select("category", F.lower("display_name").alias("_name"), F.array_distinct(F.split(F.lower("display_name"), r"[\s_]+")).alias("_n"))
    pairs = q.select("query", "_q", "_t", F.explode("_t").alias("_k")).join(n.select("category", "_name", "_n", F.explode("_n").alias("_k")), "_k").dropDuplicates(["query", "category"])
    both, union = F.size(F.array_intersect("_t", "_n")), F.size(F.array_union("_t", "_n"))
    score = F.when(F.regexp_replace("_q", " ", "_") == F.col("category"), 1.0).when(F.col("_q") == F.col("_name"), 0.98).when(F.size(F.array_except("_t", "_n")) == 0, 0.95).when(F.size(F.array_except("_n", "_t")) == 0, 0.90).otherwise(both / union * 0.75)
    return pairs.withColumn("score", score).where("score >= 0.7").groupBy("query").agg(F.max_by("category", F.struct("score", "category")).alias("category"), F.max("score").alias("score"))


def next_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("concept_id").agg((F.max("version") + 1).alias("version"))


def search(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Concepts whose id, a label or definition has the text."""
    text = text.lower()
    hit = F.lower(F.col("concept_id").cast("string")).contains(text) | F.exists("labels", lambda x: F.lower(x).contains(text)) | F.lower("definition").contains(text)
    return rows.where(hit).orderBy("concept_id").limit(limit)
