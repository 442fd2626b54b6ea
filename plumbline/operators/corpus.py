"""Question corpora from templates and entities: deduplicated, capped and checked, by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fill
from .ranks import running
from .sampling import round_robin, uniform

#: Draws of a template for each question it may have.
ATTEMPTS = 4


def generate(templates: DataFrame, entities: DataFrame, per_template: int, reuse_cap: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """``template, entity, question``: each template with entities of its kind.

    A template makes ``ATTEMPTS`` draws for each question it may have, by hash: a
    draw is a place in the order of the kind's entities, so that templates and
    entities meet on places and never pair by pair. Draws that come again are
    dropped, and an entity is used at most ``reuse_cap`` times; questions in
    ``exclude`` are left out. templates: kind, template; entities: kind, entity.
    """
    pool = running(entities.distinct().withColumn("_u", uniform(seed, F.col("entity"))).withColumn("_1", F.lit(1)), [F.col("_u").asc(), F.col("entity").asc()], {"_n": "_1"}, "kind")
    pool = pool.select("kind", "entity", (F.col("_n") - 1).alias("place"))
    sizes = pool.groupBy("kind").agg(F.count("*").alias("size"))
    t = templates.distinct().join(F.broadcast(sizes), "kind").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS * per_template - 1))))
    drawn = t.withColumn("place", F.floor(uniform(seed, F.col("template"), F.col("i")) * F.col("size"))).groupBy("kind", "template", "place").agg(F.min("i").alias("i"))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("kind", "template").orderBy("i"))).where(F.col("r") <= per_template)
    d = drawn.join(pool, ["kind", "place"]).withColumn("u", uniform(seed, F.col("template"), F.col("entity")))
    q = d.withColumn("question", fill(F.col("template"), F.create_map(F.lit("entity"), F.col("entity"))))
    if exclude is not None:
        q = q.join(exclude.select("question").distinct(), "question", "left_anti")
    q = q.withColumn("c", F.row_number().over(Window.partitionBy("entity").orderBy("u", "template"))).where(F.col("c") <= reuse_cap)
    return q.groupBy("question").agg(F.min(F.struct("template", "entity")).alias("x")).select("x.template", "x.entity", "question")


def round_robin_prompts(entities: DataFrame, templates: DataFrame, n: int) -> DataFrame:
    """``kind, entity, template, question``: ``n`` prompts, entity kinds taken in turn, each with the next template of its kind.

    entities: kind, entity; templates: kind, template. Kinds are few, and of each
    at most ``n`` entities are looked at.
    """
    e = round_robin(entities.distinct(), "kind", "entity", n)
    t = templates.distinct().withColumn("_i", F.row_number().over(Window.partitionBy("kind").orderBy("template")) - 1)
    size = t.groupBy("kind").agg(F.count("*").alias("_n"))
    j = e.join(F.broadcast(size), "kind").withColumn("_i", F.pmod(F.col("depth") - 1, F.col("_n"))).join(t, ["kind", "_i"])
    return j.select("kind", "entity", "template", fill(F.col("template"), F.create_map(F.lit("entity"), F.col("entity"))).alias("question"))


#: A variable of a template, written {name}, { NAME } or [name].
VARIABLE = r"[{\[]\s*(\w+)\s*[}\]]"


def capacity(templates: DataFrame, pools: DataFrame) -> DataFrame:
    """Questions each template can give: the product of its pools' sizes, a pool used again counting one less.

    Case of names is ignored. A variable without a pool counts as one value, so
    does a pool that is used up; a template without variables gives one question.
    templates: template with {pool} variables; pools: pool, size.
    """
    sizes = pools.groupBy(F.lower("pool").alias("pool")).agg(F.max("size").alias("size"))
    v = templates.select("template", F.posexplode_outer(F.regexp_extract_all("template", F.lit(VARIABLE), F.lit(1))).alias("at", "pool")).withColumn("pool", F.lower("pool"))
    n = v.withColumn("again", F.row_number().over(Window.partitionBy("template", "pool").orderBy("at")) - 1).join(F.broadcast(sizes), "pool", "left")
    g = n.groupBy("template").agg(F.collect_list(F.greatest(F.coalesce("size", F.lit(0)) - F.col("again"), F.lit(1)).cast("long")).alias("s"))
    return g.select("template", F.aggregate("s", F.lit(1).cast("long"), lambda a, x: a * x).alias("capacity"))


def validation(generated: DataFrame, other: DataFrame) -> DataFrame:
    """Questions, repeated questions, open placeholders and questions shared with another set."""
    shared = generated.join(other.select("question").distinct(), "question", "left_semi").agg(F.count("*").alias("overlap"))
    own = generated.agg(F.count("*").alias("questions"), (F.count("*") - F.countDistinct("question")).alias("repeated"), F.count_if(F.col("question").rlike(r"\[[a-z_0-9]+\]|\{")).alias("placeholders"))
    return own.crossJoin(shared)
