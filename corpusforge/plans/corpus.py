"""The whole flow from documents to priced prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.prompts import build_prompt, prompt_length
from corpusforge.functions.text import clean_text, remove_header_lines
from corpusforge.operators.catalog import cost_report
from corpusforge.operators.chunking import drop_blank_docs, explode_chunks, fan_out
from corpusforge.operators.quality import min_text_length, quality_gate
from corpusforge.settings import Settings


def templates_of(settings: Settings = Settings()) -> dict[str, str]:
    """Template of each text generator: the custom ones, or else those of the style, each
    followed by the chunk. A style without a prompt for a generator takes the default one."""
    if settings.custom_prompts:
        return {g: settings.custom_prompts[g] for g in settings.text_generators if g in settings.custom_prompts}
    style = {**fixed.DEFAULT_PROMPTS, **fixed.STYLE_PROMPTS.get(settings.prompt_style, {})}
    return {g: style[g] + "\n\nContent:\n{chunk}" for g in settings.text_generators if g in style}


TEMPLATES = templates_of()


def clean_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Short texts blanked, header lines removed, the rest cleaned, low quality dropped."""
    text = remove_header_lines(min_text_length(F.col("text"), settings.min_text_length), settings.header_regex)
    cleaned = docs.withColumn("text", clean_text(text))
    return quality_gate(cleaned, min_length=settings.min_text_length, threshold=settings.quality_threshold)


def document_chunks(docs: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    good = drop_blank_docs(clean_documents(docs, settings))
    return explode_chunks(good, keep=keep or ["doc_id"], size=settings.chunk_size, overlap=settings.overlap)


def prompts_of(chunks: DataFrame, templates: dict[str, str]) -> DataFrame:
    """A prompt for each chunk and generator."""
    pairs = fan_out(chunks, templates)
    prompt = build_prompt(F.col("template"), F.col("chunk"))
    return pairs.withColumn("prompt", prompt).drop("template", "chunk")


def corpus_cost(docs: DataFrame, catalog: DataFrame, routes: dict[str, tuple[str, str]], settings: Settings = Settings()) -> DataFrame:
    """Calls, tokens and price of generating training data for a corpus, per generator.

    `routes` names the provider and model of each generator. Prompts are measured, not built.
    """
    chunks = document_chunks(docs, settings).select(F.length("chunk").alias("_chars"))
    prompts = fan_out(chunks, templates_of(settings))
    pairs = [x for g, (p, m) in routes.items() for x in (F.lit(g), F.struct(F.lit(p).alias("p"), F.lit(m).alias("m")))]
    route = F.try_element_at(F.create_map(*pairs), F.col("generator"))
    calls = prompts.select(
        "generator", route["p"].alias("provider"), route["m"].alias("model"), F.floor(prompt_length(F.col("template"), F.col("_chars")) / fixed.CHARS_PER_TOKEN).alias("tokens"),
    )
    return cost_report(calls, catalog, ["generator"])
