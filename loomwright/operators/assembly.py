"""Knowledge-graph assembly: validation, dedupe, upserts and projections.

"First wins" is a ``min_by`` over an explicit position, an aggregate with partial results before the shuffle, so a name
or triple that makes up a third of the input costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import text as T
from loomwright.operators.grams import occurrences
from loomwright.operators.ranking import first_n, range_positions
from loomwright.session import computed_once, cut_lineage, dealt, kept

c = F.col


def classify_entities(entities: DataFrame) -> DataFrame:
    """One row per (unit, normal name) that is not empty: validity, first occurrence, number of occurrences."""
    named = computed_once(entities, name=T.normalize_name(c("name"))).filter("name <> ''")
    first = F.min(F.struct("pos", "type", "description"))
    grouped = named.groupBy("unit_id", "name").agg(first.alias("_f"), F.count("*").alias("n"))
    return grouped.select(
        "unit_id", "name", T.resolve_entity_type(c("_f.type")).alias("type"),
        F.coalesce(F.nullif(T.strip(c("_f.description")), F.lit("")), c("name")).alias("description"),
        c("_f.pos").alias("pos"), "n", T.is_valid_name(c("name")).alias("valid"),
    )


def valid_entities(classified: DataFrame) -> DataFrame:
    return classified.filter("valid").select("unit_id", "pos", "name", "type", "description")


#: Rows of a unit up to which its names travel as one map; larger units are looked up by name.
UNIT_ROWS = 4096


def _ends_by_map(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Types of both ends from one map of names per unit: relations move once, to their unit."""
    names = entities.groupBy("unit_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "type"))).alias("_names"))
    joined = rows.join(names.hint("merge"), "unit_id", "left")  # about as large as the rows, and dealt as they are
    return joined.withColumns({f"{end}_type": F.try_element_at("_names", c(end)) for end in ("subject", "object")}).drop("_names")


def _ends_by_name(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Types of both ends by (unit, name): a unit of any size is spread over its names."""
    subjects = entities.select("unit_id", c("name").alias("subject"), c("type").alias("subject_type"))
    objects = entities.select("unit_id", c("name").alias("object"), c("type").alias("object_type"))
    return rows.join(subjects, ["unit_id", "subject"], "left").join(objects, ["unit_id", "object"], "left")


def large_units(*rows: DataFrame) -> DataFrame:
    """The units with more than ``UNIT_ROWS`` rows in one of the tables ``(unit_id, ...)``; each table is counted where it lies."""
    counted = [df.groupBy("unit_id").agg(F.count("*").alias("_n")).filter(c("_n") > UNIT_ROWS).select("unit_id") for df in rows]
    return reduce(DataFrame.union, counted).distinct()


def classify_relations(relations: DataFrame, entities: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """Every relation with its first reason for rejection, or null; ``entities`` are the valid ones.

    ``large(unit_id)`` lists the units that are not looked up by a map; they are counted here when it is not given.
    """
    rows = computed_once(
        relations.select("unit_id", "pos", "subject", "predicate", "object"), subject=T.normalize_name(c("subject")),
        predicate=T.resolve_relation_type(c("predicate")), object=T.normalize_name(c("object")),
    )
    large = cut_lineage(large_units(entities, relations) if large is None else large)
    if large.isEmpty():
        joined = _ends_by_map(rows, entities)
    else:
        few = _ends_by_map(rows.join(large, "unit_id", "left_anti"), entities.join(large, "unit_id", "left_anti"))
        joined = few.unionByName(_ends_by_name(rows.join(large, "unit_id", "left_semi"), entities.join(large, "unit_id", "left_semi")))
    reason = (
        F.when((c("subject") == "") | (c("object") == ""), "empty").when(c("subject_type").isNull(), "subject_missing")
        .when(c("object_type").isNull(), "object_missing").when(c("subject") == c("object"), "self_loop")
    )
    return joined.withColumn("reason", reason)


def _types_allowed(side: int, actual: Column) -> Column:
    table = F.create_map(*[x for p, rule in V.RELATION_RULES.items() for x in (F.lit(p), T.literals(rule[side]))])
    allowed = F.element_at(table, c("predicate"))
    return allowed.isNull() | F.array_contains(allowed, actual)


def valid_relations(classified: DataFrame) -> DataFrame:
    """Distinct triples per unit; ``mismatch`` marks types outside the domain or range of the predicate."""
    kept = classified.filter("reason is null").groupBy("unit_id", "subject", "predicate", "object").agg(
        F.min("pos").alias("pos"), F.count("*").alias("n"), F.first("subject_type").alias("subject_type"),
        F.first("object_type").alias("object_type"),
    )
    mismatch = ~(_types_allowed(0, c("subject_type")) & _types_allowed(1, c("object_type")))
    return kept.withColumn("mismatch", mismatch)


def validate(entities: DataFrame, relations: DataFrame, written: bool = False, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classified entities, valid entities, classified relations, valid triples. Sizes of units come from the raw rows.

    ``written`` writes the classified entities first, for callers that read them beside the triples. Rows that are dealt by
    unit to so many ``tasks`` already stay dealt, so that no step moves them.
    """
    classified = classify_entities(entities)
    if written:
        classified = dealt(classified, ["unit_id"], tasks) if tasks else kept(classified)
    valid = valid_entities(classified)
    found = classify_relations(relations, valid, large_units(entities, relations))
    return classified, valid, found, valid_relations(found)


STAT_NAMES = [
    "entities_skipped_invalid", "entities_skipped_duplicate", "relations_skipped_subject_missing",
    "relations_skipped_object_missing", "relations_skipped_self_loop", "relations_skipped_duplicate",
    "relations_type_mapped", "relations_semantic_warn",
]


def validation_stats(entities: DataFrame, relations: DataFrame, triples: DataFrame) -> DataFrame:
    """The eight counters per unit from classified entities, classified relations and valid triples.

    Unknown predicates are resolved to the default before the check, so ``relations_type_mapped`` stays 0.
    """
    zero = F.lit(0).cast("bigint")

    def long_form(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("unit_id", *[values.get(n, zero).cast("bigint").alias(n) for n in STAT_NAMES])

    parts = [
        long_form(entities, entities_skipped_invalid=F.when(~c("valid"), c("n")).otherwise(0),
                  entities_skipped_duplicate=F.when(c("valid"), c("n") - 1).otherwise(0)),
        long_form(relations, **{f"relations_skipped_{r}": F.when(c("reason") == r, 1).otherwise(0)
                                for r in ("subject_missing", "object_missing", "self_loop")}),
        long_form(triples, relations_skipped_duplicate=c("n") - 1, relations_semantic_warn=c("mismatch").cast("int")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("unit_id").agg(*[F.sum(n).alias(n) for n in STAT_NAMES])


def merge_entities(entities: DataFrame) -> DataFrame:
    """Across units, the first entity per (name, type) by (unit, position)."""
    first = F.min(F.struct("unit_id", "pos", "description")).alias("_f")
    return entities.groupBy("name", "type").agg(first).select("name", "type", "_f.unit_id", "_f.pos", "_f.description")


def merge_relations(relations: DataFrame) -> DataFrame:
    first = F.min(F.struct("unit_id", "pos")).alias("_f")
    return relations.groupBy("subject", "predicate", "object").agg(first).select("subject", "predicate", "object", "_f.unit_id", "_f.pos")


def build_counts(key: str, **tables: DataFrame) -> DataFrame:
    """Sum of ``n`` per key in each named table ``(key, n)``, in one aggregation."""
    tagged = [t.select(key, *[(c("n") if name == own else F.lit(0)).cast("bigint").alias(name) for name in tables]) for own, t in tables.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*[F.sum(name).alias(name) for name in tables])


def batch_totals(documents: DataFrame) -> DataFrame:
    """Totals over documents with ``ok``, ``entities`` and ``relations``."""
    return documents.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~c("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(c("ok"), c("entities"))), F.lit(0)).alias("entities"),
        F.coalesce(F.sum(F.when(c("ok"), c("relations"))), F.lit(0)).alias("relations"),
    )


def label_of(raw: Column, default: str = "Entity") -> Column:
    """A label of letters, digits and underscores only."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^a-zA-Z0-9_]", ""), F.lit("")), F.lit(default))


def upsert_nodes(nodes: DataFrame, incoming: DataFrame, stamp: str, types: list[str] | None = V.ENTITY_TYPES) -> DataFrame:
    """Merge ``incoming(name, type, description, pos)`` into ``nodes(label, name, type, description, created_at, updated_at)``.

    Names, types and descriptions are trimmed; a type outside ``types`` becomes Disease before the label is made (``None``
    keeps every type). Of several incoming rows for one node the last gives the type and the last non-null description.
    """
    rows = incoming.withColumns({n: T.strip(c(n)) for n in ("name", "type", "description")}).filter("name <> '' and type <> ''")
    if types is not None:
        rows = rows.withColumn("type", F.when(c("type").isin(types), c("type")).otherwise("Disease"))
    rows = rows.withColumn("label", label_of(c("type")))
    latest = rows.groupBy("label", "name").agg(
        F.max_by("type", "pos").alias("_type"),
        F.max_by("description", F.when(c("description").isNotNull(), c("pos"))).alias("_description"),
    )
    now = F.lit(stamp).cast("timestamp")
    joined = nodes.join(latest, ["label", "name"], "full")
    touched = c("_type").isNotNull()
    return joined.select(
        "label", "name", F.coalesce("_type", "type").alias("type"), F.coalesce("_description", "description").alias("description"),
        F.when(c("type").isNull(), now).otherwise(c("created_at")).alias("created_at"),
        F.when(touched & c("type").isNotNull(), now).otherwise(c("updated_at")).alias("updated_at"),
    )


def upsert_edges(edges: DataFrame, incoming: DataFrame, nodes: DataFrame, stamp: str) -> DataFrame:
    """Add ``incoming(subject, predicate, object)`` whose ends exist and differ, once per triple."""
    names = nodes.select("name").distinct()
    keys = ["subject", "predicate", "object"]
    differ = computed_once(incoming.select(*keys), **{n: c(n) for n in keys}).filter("subject <> object and predicate <> ''")
    # known triples go where the triples are made distinct; what is left is written, so that two moves at most are on disk at once
    unknown = kept(differ.withColumn("predicate", T.resolve_relation_type(c("predicate"))).distinct().join(edges, keys, "left_anti"))
    fresh = (
        unknown.join(names.withColumnRenamed("name", "subject"), "subject", "left_semi")
        .join(names.withColumnRenamed("name", "object"), "object", "left_semi").select(*keys)
    )
    return edges.unionByName(fresh.withColumn("created_at", F.lit(stamp).cast("timestamp")))


def merge_properties(nodes: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two property maps per key; the incoming value wins."""
    right = incoming.withColumnRenamed("properties", "_new")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("properties", empty), F.coalesce("_new", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return nodes.join(right, keys, "full").select(*keys, F.map_concat(kept, new).alias("properties"))


def snapshot_nodes(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of a snapshot: distinct by name within ``keys``, the name is the id."""
    kind = F.coalesce(T.strip(c("type")), F.lit("entity"))
    rows = entities.withColumn("name", T.strip(c("name"))).filter("name <> ''")
    first = F.min(F.struct("pos", kind.alias("type"), T.strip(F.coalesce("description", F.lit(""))).alias("description"))).alias("_f")
    grouped = rows.groupBy(*keys, "name").agg(first)
    return grouped.select(
        *keys, c("name").alias("id"), "name", "_f.type", F.lower("_f.type").alias("category"), "_f.description"
    )


def snapshot_edges(relations: DataFrame, keys: list[str]) -> DataFrame:
    rows = relations.select(*keys, *[T.strip(c(n)).alias(n) for n in ("subject", "predicate", "object")])
    rows = rows.filter("subject <> '' and predicate <> '' and object <> ''").distinct()
    return rows.select(
        *keys, F.concat_ws("_", "subject", "predicate", "object").alias("id"), c("subject").alias("source"),
        c("object").alias("target"), c("predicate").alias("relation"),
    )


# --- tagged triples ------------------------------------------------------------------------------------------------


def symptom_pairs(triples: DataFrame) -> DataFrame:
    """Distinct (direction, disease, symptom) pairs of ``name[tag]`` triples.

    ``disease_symptom`` comes from 症状 rows with a disease head, ``symptom_disease`` from 可能疾病 rows.
    """
    head, tail = T.entity_tag_name(c("header")), T.entity_tag_name(c("tail"))
    head_type, tail_type = T.entity_tag_type(c("header")), T.entity_tag_type(c("tail"))
    relation = T.strip(c("relation"))
    forward = triples.filter((relation == "症状") & (head_type == "DISEASE") & (tail != "")).select(
        F.lit("disease_symptom").alias("direction"), head.alias("disease"), tail.alias("symptom"))
    backward = triples.filter((relation == "可能疾病") & (head_type == "SYMPTOM") & (tail_type == "DISEASE")).select(
        F.lit("symptom_disease").alias("direction"), tail.alias("disease"), head.alias("symptom"))
    return forward.union(backward).distinct()


def gold_samples(pairs: DataFrame, limit: int = 100, shown: int = 5, prefix: str = "sample_") -> tuple[DataFrame, DataFrame]:
    """Evaluation samples, one per symptom in name order: (samples, relations).

    ``samples(sample_id, symptom, text, n_diseases)``; ``relations(sample_id, disease, symptom, place)`` holds all of
    the diseases in name order as rows.
    """
    rows = pairs.filter("direction = 'symptom_disease'").select("symptom", "disease")
    counts = rows.groupBy("symptom").agg(F.count("*").alias("n_diseases")).orderBy("symptom").limit(limit)
    numbered = range_positions(counts, [], [c("symptom")]).withColumn(
        "sample_id", F.concat(F.lit(prefix), F.lpad(c("position").cast("string"), 3, "0")))
    chosen = numbered.select("sample_id", "symptom", "n_diseases")
    top = first_n(rows, ["symptom"], [c("disease")], shown)
    listed = top.groupBy("symptom").agg(F.array_join(F.array_sort(F.collect_list("disease")), "、").alias("_list"))
    samples = chosen.join(listed, "symptom").select(
        "sample_id", "symptom", F.concat("symptom", F.lit("这一症状常见相关疾病包括"), "_list", F.lit("等。")).alias("text"), "n_diseases")
    members = rows.join(chosen.select("sample_id", "symptom"), "symptom")
    placed = range_positions(members, ["sample_id"], [c("disease")])
    return samples, placed.select("sample_id", "disease", "symptom", c("position").alias("place"))


def tiered_lookup(matches: DataFrame, triples: DataFrame, relation: str, key: str, n: int = 2) -> DataFrame:
    """For each sentence the first ``n`` tails of its first matched name.

    ``matches(key, name)`` as from dictionary matching; ``triples(header, relation, tail, pos)`` with plain headers.
    """
    chosen = matches.groupBy(key).agg(F.min("name").alias("name"))
    tails = first_n(triples.filter(c("relation") == relation), ["header"], [c("pos")], n)
    return chosen.join(tails.select(c("header").alias("name"), "tail", "rank"), "name").select(key, "name", "rank", "tail")


# Per step its tiers, the kind of entity that opens a tier, and the relation that is followed (none: the entity itself).
CASCADE = [
    ("symptom", 1, "disease", "症状"),
    ("symptom", 2, "symptom", None),
    ("check", 1, "record", "check"),
    ("recommand_drug", 1, "record", "recommand_drug"),
]


def tiered_cascade(texts: DataFrame, words: DataFrame, triples: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """What to ask or advise next for each sentence: per step the first ``n`` items of its first tier that has any.

    ``words(kind, name, word)``: a name by itself or by a synonym; synonyms count only where no name of the kind occurs.
    ``triples(header, relation, tail, pos)``. Symptoms come from the sentence's first disease, else from the sentence; checks
    and drugs from its first record. All words are searched at once and all tiers ranked at once. Result: ``key, step, tier,
    name`` (the entity followed), ``by_synonym, rank, item``. The first entity is the least name.
    """
    hits = occurrences(texts, words, key, text, "word").join(words, "word")
    found = hits.groupBy(key, "kind", "name").agg(F.min(c("word") != c("name")).alias("by_synonym"))
    ranked = first_n(found, [key, "kind"], [c("by_synonym"), c("name")], n)
    direct = F.min("by_synonym").over(Window.partitionBy(key, "kind"))
    entities = cut_lineage(ranked.withColumn("_d", direct).filter(c("by_synonym") == c("_d")).drop("_d"))
    tails = first_n(triples, ["header", "relation"], [c("pos")], n).select(c("header").alias("name"), "relation", c("tail").alias("item"), c("rank").alias("_place"))
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(t).alias("tier"), F.lit(r).cast("string").alias("relation"), F.lit(k).alias("_kind")) for s, t, k, r in CASCADE])
    opened = entities.withColumn("_s", F.explode(steps)).select(key, "kind", "name", "by_synonym", "rank", "_s.*").filter("kind = _kind")
    followed = opened.filter("relation is not null and rank = 1").join(tails, ["name", "relation"]).withColumn("rank", c("_place"))
    itself = opened.filter("relation is null").withColumn("item", c("name"))
    columns = [key, "step", "tier", "name", "by_synonym", "rank", "item"]
    tiers = followed.select(*columns).union(itself.select(*columns))
    least = F.min("tier").over(Window.partitionBy(key, "step"))
    return tiers.withColumn("_t", least).filter(c("tier") == c("_t")).drop("_t")
