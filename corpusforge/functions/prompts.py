"""Prompt text, request bodies and response bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed


def build_prompt(template: Column, chunk: Column) -> Column:
    """Put the chunk in place of `{chunk}`, else of `{text}`, else leave the template alone."""
    return F.when(template.contains("{chunk}"), F.replace(template, F.lit("{chunk}"), chunk)).otherwise(
        F.replace(template, F.lit("{text}"), chunk)
    )


def prompt_length(template: Column, chunk_length: Column) -> Column:
    """Length of what `build_prompt` makes, from the length of the chunk."""

    def filled(mark: str) -> Column:
        places = (F.length(template) - F.length(F.replace(template, F.lit(mark), F.lit("")))) / len(mark)
        return F.length(template) + places * (chunk_length - len(mark))

    return F.when(template.contains("{chunk}"), filled("{chunk}")).otherwise(filled("{text}")).cast("long")


def prompt_for(style: Column, generator: Column, custom: dict[str, str] | None = None) -> Column:
    """Template of a style and generator, the default where the style has none; custom prompts replace the style as a whole."""
    if custom:
        return _lookup(custom, generator)
    default = _lookup(fixed.DEFAULT_PROMPTS, generator)
    chosen = default
    for name, prompts in fixed.STYLE_PROMPTS.items():
        chosen = F.when(style == name, F.coalesce(_lookup(prompts, generator), default)).otherwise(chosen)
    return chosen


def system_prompt(generator: Column) -> Column:
    return _lookup(fixed.SYSTEM_PROMPTS, generator)


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def retry_prompt(schema: Column, previous: Column, template: str = fixed.RETRY_PROMPT) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{schema}"), schema), F.lit("{previous}"), previous)


def image_data_url(content: Column, path: Column) -> Column:
    kind = F.when(F.lower(path).endswith(".png"), "png").otherwise("jpeg")
    # Spark may break base64 into lines; a URL has none.
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), encoded)


def completion_request(model: Column, prompt: Column, shape: str = "messages", max_tokens: int = 2000, temperature: float = 0.7) -> Column:
    """Request body of one prompt, for a batch-inference input file."""
    if shape == "messages":
        message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
        body = F.struct(
            model.alias("model"),
            F.array(message).alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
            F.lit(temperature).alias("temperature"),
        )
    elif shape == "contents":
        parts = F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))
        body = F.struct(
            F.array(parts).alias("contents"),
            F.struct(F.lit(max_tokens).alias("maxOutputTokens"), F.lit(temperature).alias("temperature")).alias(
                "generationConfig"
            ),
        )
    else:
        raise ValueError(f"unknown request shape: {shape}")
    return F.to_json(body)


def response_text(body: Column, shape: Column) -> Column:
    """The answer inside a response body; missing parts give an empty string."""
    return F.coalesce(
        F.when(shape == "choices", F.get_json_object(body, "$.choices[0].message.content"))
        .when(shape == "content", F.get_json_object(body, "$.content[0].text"))
        .when(shape == "candidates", F.get_json_object(body, "$.candidates[0].content.parts[0].text")),
        F.lit(""),
    )


def estimate_cost(input_tokens: Column, input_per_1k: Column, output_per_1k: Column, output_tokens: Column | None = None,
                  images: Column | None = None, image_price: Column | None = None) -> Column:
    """Price of a call; output tokens default to the input's, unknown prices to 0."""
    out = input_tokens if output_tokens is None else F.coalesce(output_tokens, input_tokens)
    cost = input_tokens / 1000 * F.coalesce(input_per_1k, F.lit(0.0)) + out / 1000 * F.coalesce(output_per_1k, F.lit(0.0))
    if images is not None and image_price is not None:
        cost = cost + images * F.coalesce(image_price, F.lit(0.0))
    return cost
