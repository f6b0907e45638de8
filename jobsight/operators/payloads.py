"""Search-API payloads -> one row per hit (Tech in Asia raw record, D4).

The payload is parsed once into a VARIANT; ``results[0].hits`` is taken as
an array of VARIANT values and exploded, so no hit is re-serialised or parsed
twice. VARIANT keeps missing keys apart from explicit nulls (F13) and objects
apart from strings (F14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsight.functions import dict_or_string, first_truthy, get_or_default
from jobsight.functions.payload import names_of
from jobsight.schemas import NOT_STATED


def flatten_search_hits(payloads: DataFrame, payload: str = "payload",
                        keep=("payload_id",), platform: str = "Tech In Asia") -> DataFrame:
    doc = F.try_parse_json(F.col(payload))                 # malformed -> null, no error
    hits = F.try_variant_get(doc, "$.results[0].hits", "array<variant>")
    v = payloads.select(*keep, F.posexplode(hits).alias("hit_no", "v"))
    # each hit is cast once to a map of its top-level keys; the fields then look up the map
    m = v.select(*keep, "hit_no", F.try_variant_get("v", "$", "map<string,variant>").alias("m"))
    node = lambda key: F.try_element_at(F.col("m"), F.lit(key))
    s = lambda key: node(key).try_cast("string")
    skills = F.coalesce(*[F.when(F.size(a) > 0, a) for a in (
        F.try_variant_get(node(k), "$", "array<variant>") for k in ("job_skills", "skills"))])
    return m.select(
        *keep, "hit_no",
        first_truthy(s("title"), s("name"), default=NOT_STATED).alias("job_title"),
        get_or_default(node("company"), "$.name", NOT_STATED).alias("company_name"),     # {} / null / missing -> default
        first_truthy(F.try_variant_get(node("city"), "$.country_name", "string"), s("work_country_name"),
                     default=NOT_STATED).alias("location"),
        names_of(skills, NOT_STATED).alias("skills_required"),
        F.when(node("experience_min").isNull(), F.lit("0")).otherwise(s("experience_min")).alias("experience_years_min"),
        dict_or_string(node("job_type"), "$", "name", NOT_STATED).alias("job_type"),
        first_truthy(s("published_at"), default=NOT_STATED).alias("published_at"),
        F.lit(platform).alias("source_platform"),
    )
