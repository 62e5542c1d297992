"""Choosing caption models and devices, provider versions, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages that prompts name, and the prompt.
LANGUAGES = {"en": "English", "tr": "Turkish", "de": "German", "fr": "French", "es": "Spanish", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "ru": "Russian", "pt": "Portuguese", "it": "Italian"}
PROMPT = "You are analyzing a figure from a technical/academic document. Describe what this figure shows in 2-3 sentences. Include: the type of figure (graph, circuit diagram, table, photo, etc.), key elements visible, and what it illustrates. If there is text or labels, mention them. Respond in {language}."
HINT = "\n\nExisting caption hint: "


def fitting_models(models: DataFrame, vram_mb: int) -> DataFrame:
    """Models (model_id, min_vram_mb, quality_rank, languages) that fit, the best first."""
    return models.where(F.col("min_vram_mb") <= vram_mb).orderBy("quality_rank", "model_id")


def first_of(models: DataFrame, by: str) -> DataFrame:
    """`by`, model_id: the model that stands first (by seq) in the manifest for each tier, or other column."""
    return models.groupBy(by).agg(F.min_by("model_id", "seq").alias("model_id"))


def speaks(languages: Column, language: str) -> Column:
    """Whether a model knows a language; many languages, or 'multilingual', mean all."""
    known = F.transform(languages, F.lower)
    return F.array_contains(known, language.lower()) | F.array_contains(known, "multilingual") | (F.size(known) > 5)


def choose_model(models: DataFrame, vram_mb: int, language: str) -> DataFrame:
    """The one model for a language: of those that fit the best that speaks it, else the best."""
    fit = models.where(F.col("min_vram_mb") <= vram_mb)
    return fit.orderBy(speaks(F.col("languages"), language).desc(), "quality_rank", "model_id").limit(1)


def version_at_least(version: Column, least: Column) -> Column:
    """Dotted versions compared part by part; a part that isn't a number is 0."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999")).cast("int"), F.lit(0)))
    filled = lambda v: F.slice(F.concat(parts(v), F.array_repeat(F.lit(0), 6)), 1, 6)
    order = F.aggregate(F.zip_with(filled(version), filled(least), lambda a, b: F.signum(a - b).cast("int")), F.lit(0), lambda acc, x: F.when(acc != 0, acc).otherwise(x))
    return order >= 0


def memory_decision(mode: Column, vram_mb: Column, ram_mb: Column, vram_least: int, ram_least: int) -> Column:
    """use_gpu and batch: by the wish (cpu_only, gpu_preferred: whenever there is one, auto) and what is free (null: unknown)."""
    gpu = F.when(mode == "cpu_only", False).when(mode == "gpu_preferred", vram_mb.isNotNull()).otherwise(F.coalesce(vram_mb >= vram_least, F.lit(False)))
    return F.struct(gpu.alias("use_gpu"), F.when(F.coalesce(ram_mb < ram_least, F.lit(False)), 1).otherwise(4).alias("batch"))


def caption_prompt(language: Column, hint: Column) -> Column:
    """The prompt in a language (English for unknown ones), with 200 characters of a caption that there is."""
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    spoken = F.coalesce(F.try_element_at(named, language), F.lit("English"))
    before, after = PROMPT.split("{language}")
    told = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit(HINT), F.substring(hint, 1, 200))).otherwise("")
    return F.concat(F.lit(before), spoken, F.lit(after), told)
