"""Evaluation of extraction (precision, recall, F1) and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright import vocab as V
from loomwright.functions import text as T
from loomwright.session import computed_once

c = F.col


def gold_entities(samples: DataFrame) -> DataFrame:
    """Distinct (sample_id, name, type) of nested samples ``{id, entities, relations}``."""
    rows = samples.select(c("id").alias("sample_id"), F.explode("entities").alias("e"))
    named = rows.select("sample_id", T.normalize_name(c("e.text")).alias("name"), F.upper("e.type").alias("type"))
    return named.filter("name <> '' and type <> ''").distinct()


def gold_relations(samples: DataFrame) -> DataFrame:
    """Distinct (sample_id, subject, type, object); ends are looked up inside the sample, without a join.

    A sample normalises each of its texts once, and both ends of a relation are read once: the tests on them run on
    the read values, not on the expressions.
    """
    named = F.transform("entities", lambda e: F.struct(e["id"].alias("id"), T.normalize_name(e["text"]).alias("name"), e["type"].alias("type")))
    read = samples.select(c("id").alias("sample_id"), "relations", F.inline(F.array(F.struct(named.alias("_named")))))
    usable = F.filter("_named", lambda e: (e["name"] != "") & (F.coalesce(e["type"], F.lit("")) != ""))
    names = F.map_from_entries(F.transform(usable, lambda e: F.struct(e["id"], e["name"])))
    known = read.select("sample_id", "relations", F.inline(F.array(F.struct(names.alias("_n")))))
    ends = F.transform("relations", lambda r: F.struct(
        F.element_at("_n", r["subject"]).alias("subject"), F.upper(r["type"]).alias("type"), F.element_at("_n", r["object"]).alias("object")))
    return known.select("sample_id", F.inline(ends)).filter("subject is not null and object is not null and type <> ''").distinct()


def predicted_entities(entities: DataFrame) -> DataFrame:
    named = computed_once(entities.select("sample_id", "name", "type"), name=T.normalize_name(c("name")), type=F.upper(F.coalesce("type", F.lit(""))))
    return named.filter("name <> '' and type <> ''").distinct()


def predicted_relations(relations: DataFrame) -> DataFrame:
    named = computed_once(
        relations.select("sample_id", "subject", "predicate", "object"), subject=T.normalize_name(c("subject")),
        predicate=F.upper(F.coalesce("predicate", F.lit(""))), object=T.normalize_name(c("object"))).withColumnRenamed("predicate", "type")
    return named.filter("subject <> '' and object <> '' and type <> ''").distinct()


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where undefined."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def score_sets(gold: DataFrame, predicted: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Micro scores in total (``type`` null) and per type, over sets keyed by all columns.

    Both sides are marked and counted in one aggregation by key, so no join is needed; ``types`` keeps core types only.
    """
    keys = gold.columns
    sides = gold.withColumns({"_g": F.lit(1), "_p": F.lit(0)}).unionByName(predicted.withColumns({"_g": F.lit(0), "_p": F.lit(1)}))
    if types is not None:
        sides = sides.filter(c("type").isin(types))
    cells = sides.groupBy(*keys).agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    counted = cells.rollup("type").agg(
        F.count_if((c("_g") == 1) & (c("_p") == 1)).alias("tp"), F.count_if((c("_g") == 0) & (c("_p") == 1)).alias("fp"),
        F.count_if((c("_g") == 1) & (c("_p") == 0)).alias("fn"))
    return counted.select("type", "tp", "fp", "fn", *prf(c("tp"), c("fp"), c("fn")))


def answer_score(answer: Column, category: Column) -> Column:
    """0 for a blank or refusing answer, else 0 / 0.5 / 1 for no, one or more keywords of the category."""
    words = F.array().cast("array<string>")
    table = F.create_map(*[x for name, keys in V.QA_KEYWORDS.items() for x in (F.lit(name), T.literals(keys))])
    hits = F.size(F.filter(F.coalesce(F.element_at(table, category), words), lambda k: F.instr(answer, k) > 0))
    refused = T.any_in(answer, V.REFUSAL_PHRASES) | (T.strip(answer) == "")
    return F.when(refused | (hits == 0), 0.0).when(hits == 1, 0.5).otherwise(1.0)


def score_means(results: DataFrame, field: str = "score") -> DataFrame:
    """Mean and number by system (``category`` null) and by category and system, 0 where nothing was scored."""
    rows = results.withColumn("_s", c(field).try_cast("double"))
    mean = F.coalesce(F.avg("_s"), F.lit(0.0)).alias("avg")
    by_system = rows.groupBy("system").agg(mean, F.count("_s").alias("n")).select(F.lit(None).cast("string").alias("category"), "system", "avg", "n")
    cells = rows.groupBy("category", "system").agg(mean, F.count("_s").alias("n"))
    systems = rows.select(F.array_sort(F.collect_set("system"))).scalar()
    skeleton = rows.select("category").distinct().withColumn("system", F.explode(systems))
    filled = skeleton.join(cells, ["category", "system"], "left").na.fill(0, ["avg", "n"])
    return by_system.unionByName(filled)
