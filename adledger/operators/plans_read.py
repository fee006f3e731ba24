"""Floorplan texts: the best candidate per ad, and what it may fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions import extract
from adledger.functions.blanks import blank_number, blank_text, flags_of, is_true


def slice_candidates(df: DataFrame, images: str = "images") -> DataFrame:
    """The first candidates of an ad, with their position."""
    first = F.slice(images, 1, fixed.PLAN_CANDIDATES)
    return df.select("url", F.posexplode(first).alias("pos", "image"))


def slice_rows(candidates: DataFrame) -> DataFrame:
    """The same cut where each candidate is a row with its ``pos``: nothing is gathered."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return candidates.withColumn("_rn", rank).where(F.col("_rn") <= fixed.PLAN_CANDIDATES).drop("_rn")


def best_candidate(plan_texts: DataFrame) -> DataFrame:
    """Per ad: of its best-scored texts, the first stating an area, else the first plan.

    ``plan_texts`` has ``url``, ``pos``, ``image``, ``score``, ``ocr_text``. Only
    the texts that win the ranking are parsed.
    """
    c = F.col
    w = Window.partitionBy("url").orderBy(c("score").desc(), "pos")
    top = (plan_texts.where(c("pos") < fixed.PLAN_CANDIDATES)
           .withColumn("rn", F.row_number().over(w)).where(c("rn") <= fixed.PLAN_READS))
    # behind a generator, so that the filter below reads what was parsed instead of parsing again
    parsed = F.struct(extract.parse_area(c("ocr_text")).alias("a"), extract.plan_floors(c("ocr_text")).alias("floors"),
                      extract.is_plan_text(c("ocr_text")).alias("is_plan"))
    read = top.select("url", "image", "score", "rn", F.inline(F.array(parsed)))
    useful = read.where(c("a.sqft").isNotNull() | c("is_plan"))
    best = useful.groupBy("url").agg(F.min_by(
        F.struct("a.sqft", "a.basis", "a.evidence", "a.confident", "floors", "image",
                 F.round("score", 3).alias("score")),
        F.struct(c("a.sqft").isNull(), c("rn"))).alias("p"))
    return best.select("url", "p.*").where(c("sqft").isNotNull() | (F.size("floors") > 0))


def enrich_gate(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Fills plan size and plan floor where the ad and its prose state none.

    ``rows`` has the ad's columns and ``prose`` (amenities of its page). A plan's
    size goes to ``size_sqft_plan`` only, never to ``size_sqft``. ``plan_lines`` says what
    was taken and from which image, in lines for the page's text; it is empty otherwise.
    """
    c = F.col
    knows_size = ~blank_number(c("size_sqft"))
    knows_floor = ~(blank_text(c("floor_level")) & blank_number(c("floor_number"))
                    & blank_text(c("prose.floor_level")) & blank_number(c("prose.floor_number")))
    wanted = rows.withColumn("_size", knows_size).withColumn("_floor", knows_floor)
    plan = plans.select("url", F.struct("sqft", "basis", "confident", "floors", "evidence", "image").alias("_p"))
    out = wanted.join(plan, "url", "left")
    floor = extract.floor_from_plan(c("_p.floors"))
    size_ok = ~c("_size") & c("_p.sqft").isNotNull()
    area, words, storeys, source = fixed.PLAN_EVIDENCE
    image = F.concat(F.lit(source), F.coalesce("_p.image", F.lit("")))
    sure = F.when(is_true(c("_p.confident")), fixed.PLAN_CLEAR).otherwise(fixed.PLAN_DOUBTFUL)
    lines = flags_of(
        F.when(size_ok, F.concat(F.lit(area), c("_p.sqft").cast("string"), F.lit(" sq ft ("), c("_p.basis"), F.lit(", "), sure, F.lit(")"), image)),
        F.when(size_ok, F.concat(F.lit(words), F.coalesce("_p.evidence", F.lit("")))),
        F.when(~c("_floor") & (F.size("_p.floors") > 0), F.concat(F.lit(storeys), F.array_join("_p.floors", ", "), image)))
    return out.withColumns({
        "plan_lines": lines,
        "size_sqft_plan": F.when(size_ok, c("_p.sqft")).otherwise(c("size_sqft_plan")),
        "size_plan_basis": F.when(size_ok, c("_p.basis")).otherwise(c("size_plan_basis")),
        "size_plan_confident": F.when(size_ok, c("_p.confident"))
        .otherwise(c("size_plan_confident")),
        "floor_level": F.when(~c("_floor"), F.coalesce(floor["floor_level"], c("floor_level")))
        .otherwise(c("floor_level")),
        "floor_number": F.when(~c("_floor"), F.coalesce(floor["floor_number"], c("floor_number")))
        .otherwise(c("floor_number")),
    }).drop("_p", "_size", "_floor")
