"""Reading model replies, checking their shape, and keeping only what the sources bear out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.constants import CONFIDENCES, LEGAL_FLAGS, NOT_AVAILABLE, OPTIONAL_FIELDS, REQUIRED_FIELDS
from webloom.functions.text import strip
from webloom.functions.urls import grounding_key, http_sources
from webloom.sources.tables import cut_table

SOURCED = T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType()))])
LEGAL = T.StructType([*(T.StructField(f, T.BooleanType()) for f in LEGAL_FLAGS), T.StructField("sources", T.ArrayType(T.StringType()))])
INTELLIGENCE = T.StructType(
    [*(T.StructField(f, SOURCED) for f in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)), T.StructField("legal_pages", LEGAL), T.StructField("missing_information", T.ArrayType(T.StringType()))]
)


def reply_object(raw: Column) -> Column:
    """The JSON object in a model's reply as a variant, null if there is none.

    Code fences are taken off; else the span from the first { to the last } is tried.
    """
    text = strip(F.coalesce(raw, F.lit("")))
    fenced = F.when(text.startswith("```"), strip(F.regexp_replace(F.regexp_replace(text, f"(?i)^```(?:json)?[\\s]*", ""), r"\s*```$", ""))).otherwise(text)
    whole = F.try_parse_json(fenced)
    span = F.try_parse_json(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(span), span)


def _kind(variant: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(variant, path, "variant")), F.lit("VOID"))


def _sources(variant: Column, path: str) -> Column:
    """The web addresses of a field's sources; one string counts as a list of one."""
    single = F.when(_kind(variant, path) == "STRING", F.array(F.try_variant_get(variant, path, "string")))
    mixed = F.transform(F.try_variant_get(variant, path, "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return http_sources(F.coalesce(single, mixed))


def _valid_field(variant: Column, name: str) -> Column:
    path, confidence = f"$.{name}", F.try_variant_get(variant, f"$.{name}.confidence", "string")
    shape = _kind(variant, path).startswith("OBJECT") & (_kind(variant, f"{path}.value") == "STRING")
    sure = (_kind(variant, f"{path}.confidence") == "VOID") | ((_kind(variant, f"{path}.confidence") == "STRING") & F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)))
    return shape & sure


def is_valid(variant: Column) -> Column:
    """Whether a reply has the required fields and every field the right shape; one wrong field rejects all."""
    required = F.lit(True)
    for name in REQUIRED_FIELDS:
        required = required & _valid_field(variant, name)
    for name in OPTIONAL_FIELDS:
        required = required & ((_kind(variant, f"$.{name}") == "VOID") | _valid_field(variant, name))
    missing = _kind(variant, "$.missing_information")
    legal = _kind(variant, "$.legal_pages")
    return F.coalesce(required & ((missing == "VOID") | missing.startswith("ARRAY<STRING") | (missing == "ARRAY<VOID>")) & ((legal == "VOID") | legal.startswith("OBJECT")), F.lit(False))


def _field(variant: Column, name: str) -> Column:
    value = F.try_variant_get(variant, f"$.{name}.value", "string")
    confidence = F.coalesce(F.try_variant_get(variant, f"$.{name}.confidence", "string"), F.lit("low"))
    return F.when(_kind(variant, f"$.{name}").startswith("OBJECT"), F.struct(value.alias("value"), confidence.alias("confidence"), _sources(variant, f"$.{name}.sources").alias("sources")))


def typed(variant: Column) -> Column:
    """A valid reply as a struct of INTELLIGENCE; keys it doesn't know are ignored."""
    flag = lambda f: F.coalesce(F.try_variant_get(variant, f"$.legal_pages.{f}", "boolean"), F.lit(False)).alias(f)
    legal = F.struct(*[flag(f) for f in LEGAL_FLAGS], _sources(variant, "$.legal_pages.sources").alias("sources"))
    missing = F.coalesce(F.try_variant_get(variant, "$.missing_information", "array<string>"), F.array().cast("array<string>"))
    return F.struct(*[_field(variant, n).alias(n) for n in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS)], legal.alias("legal_pages"), missing.alias("missing_information"))


def is_available(field: Column) -> Column:
    return F.coalesce((field["value"] != "") & (F.lower(strip(field["value"])) != NOT_AVAILABLE), F.lit(False))


def has_value(field: Column) -> Column:
    return F.coalesce(is_available(field) & (F.size(field["sources"]) > 0), F.lit(False))


def grounded(intelligence: Column, allowed: Column) -> Column:
    """Intelligence with only sources of the context; fields left without any are emptied and named as missing."""
    keep = lambda sources: F.filter(sources, lambda s: F.array_contains(allowed, grounding_key(s)))
    fields, missing = [], [intelligence["missing_information"]]
    for name in (*REQUIRED_FIELDS, *OPTIONAL_FIELDS):
        field = intelligence[name]
        kept = F.when(field.isNotNull(), F.struct(field["value"].alias("value"), field["confidence"].alias("confidence"), keep(field["sources"]).alias("sources")))
        sound = has_value(kept)
        label = F.lit(name.replace("_", " "))
        if name in REQUIRED_FIELDS:
            empty = F.struct(F.lit(NOT_AVAILABLE).alias("value"), F.lit("low").alias("confidence"), F.array().cast("array<string>").alias("sources"))
            fields.append(F.when(sound, kept).otherwise(empty).alias(name))
            missing.append(F.when(sound, F.array().cast("array<string>")).otherwise(F.array(label)))
        else:
            fields.append(F.when(sound, kept).alias(name))
            missing.append(F.when(sound | field.isNull(), F.array().cast("array<string>")).otherwise(F.array(label)))
    legal = intelligence["legal_pages"]
    legal = F.struct(*[legal[f].alias(f) for f in LEGAL_FLAGS], keep(legal["sources"]).alias("sources"))
    return F.struct(*fields, legal.alias("legal_pages"), F.array_distinct(F.concat(*missing)).alias("missing_information"))


def extracted_summary(intelligence: Column) -> Column:
    """Five flags of what a company's intelligence has; all false where there is none."""
    legal = intelligence["legal_pages"]
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        has_value(intelligence["pricing"]).alias("hasPricing"),
        has_value(intelligence["blog_topics"]).alias("hasBlog"),
        (yes(legal["terms_available"]) | has_value(intelligence["terms_summary"])).alias("hasTerms"),
        (yes(legal["privacy_policy_available"]) | has_value(intelligence["privacy_summary"])).alias("hasPrivacyPolicy"),
        has_value(intelligence["case_studies"]).alias("hasCaseStudies"),
    )


def first_valid(replies: DataFrame, contexts: DataFrame, group: str) -> DataFrame:
    """Grounded intelligence of each group: ``group, intelligence`` from the first valid of its replies.

    ``replies``: group, attempt, raw; ``contexts``: group, sources.  Groups without a valid
    reply have null intelligence.
    """
    # a generator keeps the parsed object from being repeated in every expression that reads it
    read = replies.select(group, "attempt", F.explode(F.array(reply_object(F.col("raw")))).alias("object"))
    valid = read.where(F.col("object").isNotNull()).where(is_valid(F.col("object"))).select(group, "attempt", typed(F.col("object")).alias("i"))
    best = valid.groupBy(group).agg(F.min_by("i", "attempt").alias("i"))
    return contexts.select(group, "sources").join(best, group, "left").select(group, F.when(F.col("i").isNotNull(), grounded(F.col("i"), F.col("sources"))).alias("intelligence"))


SYSTEM_PROMPT = (
    "You read pages of one company's website. Answer with one JSON object. Each field has value, confidence (high, medium or low) and sources, the addresses of the pages that state it. "
    "Use only what the pages say. Where they don't say it, use not_available for company_overview and products_and_services, leave out any other field, and name it in missing_information."
)


def user_prompt_parts() -> tuple[str, str, str]:
    """What stands before and after the context, and what a repeated attempt adds."""
    fields = ", ".join((*REQUIRED_FIELDS, *OPTIONAL_FIELDS))
    return "Pages:\n<<<\n", f"\n>>>\nThe JSON object has the fields {fields}, legal_pages and missing_information.", "\nReturn the JSON object alone, without any other text."


def user_prompt(context: Column, strict: Column) -> Column:
    """The request for one context; a repeated attempt asks for bare JSON."""
    before, after, alone = user_prompt_parts()
    return F.concat(F.lit(before), context, F.lit(after), F.when(strict, F.lit(alone)).otherwise(""))


def complete(prompts: DataFrame, group: str, client: Callable, options: dict | None = None) -> DataFrame:
    """Replies ``group, attempt, raw`` of an injected model client, called once a prompt on the workers; failed calls give null.

    A client of three parameters is given ``options`` (temperature, max_output_tokens) as well.
    """
    import inspect

    kind = prompts.schema[group].dataType.simpleString()
    extra = ({"temperature": 0.0, **(options or {})},) if len(inspect.signature(client).parameters) > 2 else ()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for prompt in batch["prompt"]:
                try:
                    raw.append(client(SYSTEM_PROMPT, prompt, *extra))
                except Exception:  # a failed call is a null reply
                    raw.append(None)
            yield pd.DataFrame({"g": batch["g"], "attempt": batch["attempt"], "raw": raw})

    return prompts.select(F.col(group).alias("g"), "attempt", "prompt").mapInPandas(run, f"g {kind}, attempt int, raw string").withColumnRenamed("g", group)


def ask(contexts: DataFrame, group: str, client: Callable, attempts: int = 2, options: dict | None = None) -> DataFrame:
    """Replies ``group, attempt, raw``: each context is asked again only while it has no valid reply, ``attempts`` times at most.

    Every round is written before it is read, so that no reply is asked for twice.
    """
    open_ones, replies = contexts.select(group, "context"), None
    for attempt in range(1, attempts + 1):
        prompts = open_ones.select(group, F.lit(attempt).alias("attempt"), user_prompt(F.col("context"), F.lit(attempt > 1)).alias("prompt"))
        round_ = cut_table(complete(prompts, group, client, options))
        replies = round_ if replies is None else replies.unionByName(round_)
        if attempt < attempts:
            read = round_.select(group, F.explode(F.array(reply_object(F.col("raw")))).alias("object"))
            answered = read.where(F.col("object").isNotNull()).where(is_valid(F.col("object"))).select(group)
            open_ones = open_ones.join(answered, group, "left_anti")
    return replies


def stored(records: DataFrame) -> DataFrame:
    """Stored intelligence (a column ``data`` of JSON) with ``intelligence`` as a struct, null where it isn't valid any more."""
    read = records.select(*records.columns, F.explode(F.array(reply_object(F.col("data")))).alias("object"))
    return read.withColumn("intelligence", F.when(F.col("object").isNotNull() & is_valid(F.col("object")), typed(F.col("object")))).drop("object")
