"""Training items as readable documents: plain text, Markdown, XML, JSON, JSON Lines and CSV.

A document is never built as one string. It is a set of blocks - a heading, one block per item, and
for some formats an ending - as rows with a `block_no`; the blocks in that order, joined by line
breaks, are the document. That keeps every row small however many items a document has.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import excerpt
from corpusforge.operators.running import number_rows

# --- Fixed values: titles, labels and rule lengths of rendered documents -----------------
KINDS = {
    "conversations": ("Conversation", "conversations", "conversation"),
    "qa_pairs": ("Q&A", "Q&A pairs", "qa_pair"),
    "embeddings": ("Embedding", "embedding pairs", "embedding_pair"),
    "summaries": ("Summary", "summaries", "summary"),
}
ITEM_TITLE = {
    "conversations": "Conversation",
    "qa_pairs": "Q&A Pair",
    "embeddings": "Embedding Pair",
    "summaries": "Summary",
}
TEXT_TITLE = {
    "conversations": "CONVERSATION TRAINING DATA",
    "qa_pairs": "QUESTION & ANSWER TRAINING DATA",
    "embeddings": "EMBEDDING TRAINING DATA",
    "summaries": "SUMMARY TRAINING DATA",
}
TEXT_RULE = {"conversations": 30, "qa_pairs": 20, "embeddings": 25, "summaries": 15}
TEXT_WIDTH = 50
TEXT_EXCERPT = 200
MARKDOWN_EXCERPT = 500


def number_items(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the items of each document from 1; a document may be of any size."""
    return number_rows(items, keys, order, "item_no")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _role(message: Column) -> Column:
    return F.coalesce(message["role"], F.lit("unknown"))


def _join(*parts: Column | str | None) -> Column:
    """Lines of a block; a null part is left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts if p is not None])


def _optional(columns: list[str], name: str, make) -> Column | None:
    return F.when(F.col(name).isNotNull(), make(F.col(name))) if name in columns else None


def _number() -> Column:
    return F.col("item_no").cast("string")


def _text_block(kind: str, columns: list[str]) -> Column:
    def labelled(label: str, field: str, end: str = "\n", missing: str = "") -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(field).cast("string"), F.lit(missing)), F.lit(end))

    title = F.concat(F.lit(ITEM_TITLE[kind].upper() + " "), _number(), F.lit("\n" + "-" * TEXT_RULE[kind]))
    if kind == "conversations":
        said = F.transform("messages", lambda m: F.concat(F.upper(_role(m)), F.lit(": "), _text(m["content"]), F.lit("\n")))
        body = [F.when(F.size("messages") > 0, F.array_join(said, "\n"))]
    elif kind == "qa_pairs":
        body = [labelled("QUESTION", "question"), labelled("ANSWER", "answer")]
    elif kind == "embeddings":
        body = [labelled("Sentence 1", "sentence1", ""), labelled("Sentence 2", "sentence2", ""), labelled("Similarity", "similarity", missing="N/A")]
    else:
        quote = lambda t: F.concat(F.lit("ORIGINAL (excerpt): "), excerpt(t, TEXT_EXCERPT), F.lit("\n"))
        body = [labelled("SUMMARY", "summary"), _optional(columns, "original_text", quote)]
    source = _optional(columns, "source_file", lambda s: F.concat(F.lit("Source: "), s))
    return _join(title, *body, source, "=" * TEXT_WIDTH + "\n")


def _markdown_block(kind: str, columns: list[str]) -> Column:
    def labelled(label: str, field: str, missing: str = "") -> Column:
        return F.concat(F.lit(f"**{label}:** "), F.coalesce(F.col(field).cast("string"), F.lit(missing)), F.lit("\n"))

    title = F.concat(F.lit(f"## {ITEM_TITLE[kind]} "), _number(), F.lit("\n"))
    if kind == "conversations":
        said = F.transform("messages", lambda m: F.concat(F.lit("**"), F.initcap(_role(m)), F.lit(":** "), _text(m["content"]), F.lit("\n")))
        body = [F.when(F.size("messages") > 0, F.array_join(said, "\n"))]
    elif kind == "qa_pairs":
        body = [labelled("Q", "question"), labelled("A", "answer")]
    elif kind == "embeddings":
        body = [labelled("Sentence 1", "sentence1"), labelled("Sentence 2", "sentence2"), labelled("Similarity", "similarity", missing="N/A")]
    else:
        quote = lambda t: F.concat(F.lit("**Original Text:**\n```\n"), excerpt(t, MARKDOWN_EXCERPT), F.lit("\n```\n"))
        body = [labelled("Summary", "summary"), _optional(columns, "original_text", quote)]
    source = _optional(columns, "source_file", lambda s: F.concat(F.lit("*Source: "), s, F.lit("*\n")))
    return _join(title, *body, source, "---\n")


def _escape(value: Column, attribute: bool = False) -> Column:
    out = _text(value)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _element(name: str, value: Column, attributes: Column | str = "", indent: str = "    ") -> Column:
    """`<name attributes>value</name>`, or the short form when the value is empty."""
    start = F.concat(F.lit(f"{indent}<{name}"), F.lit(attributes) if isinstance(attributes, str) else attributes)
    return F.when(_text(value) == "", F.concat(start, F.lit("/>"))).otherwise(
        F.concat(start, F.lit(">"), _escape(value), F.lit(f"</{name}>"))
    )


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), _escape(value, attribute=True), F.lit('"'))


def _xml_block(kind: str, columns: list[str]) -> Column:
    element = KINDS[kind][2]
    attributes = _attribute("id", F.col("item_no"))
    if kind == "embeddings":
        attributes = F.concat(attributes, _attribute("similarity", F.col("similarity")))
    if "source_file" in columns:
        source = F.when(F.col("source_file").isNotNull(), _attribute("source", F.col("source_file"))).otherwise("")
        attributes = F.concat(attributes, source)
    if kind == "conversations":
        lines = F.transform(
            "messages",
            lambda m, i: _element("message", m["content"], F.concat(_attribute("index", i), _attribute("role", m["role"])), " " * 6),
        )
        filled = F.concat(F.lit("    <messages>\n"), F.array_join(lines, "\n"), F.lit("\n    </messages>"))
        body = [F.when(F.size("messages") > 0, filled).otherwise("    <messages/>")]
    elif kind == "qa_pairs":
        body = [_element("question", F.col("question")), _element("answer", F.col("answer"))]
    elif kind == "embeddings":
        body = [_element("sentence1", F.col("sentence1")), _element("sentence2", F.col("sentence2"))]
    else:
        body = [_element("summary_text", F.col("summary")), _optional(columns, "original_text", lambda t: _element("original_text", t))]
    return _join(F.concat(F.lit(f"  <{element}"), attributes, F.lit(">")), *body, f"  </{element}>")


def _json_block(kind: str, columns: list[str]) -> Column:
    """An element of a JSON array; all but the first begin with the comma."""
    comma = F.when(F.col("item_no") == 1, "").otherwise(",")
    return F.concat(comma, F.to_json(F.struct(*columns)))


def _total() -> Column:
    return F.col("n_items").cast("string")


@dataclass(frozen=True)
class DocumentFormat:
    """How a document is laid out: heading, item block and ending of a kind of item.

    The heading and ending may use `n_items`; a block may use `item_no` and the item's columns,
    whose names it is given. Add an entry to `FORMATS` for a format of your own.
    """

    heading: Callable[[str], Column]
    block: Callable[[str, list[str]], Column]
    ending: Callable[[str], Column] | None = None


FORMATS = {
    "txt": DocumentFormat(
        lambda kind: F.concat(F.lit(f"{TEXT_TITLE[kind]}\n{'=' * TEXT_WIDTH}\nTotal {KINDS[kind][1]}: "), _total(), F.lit("\n")),
        _text_block,
    ),
    "markdown": DocumentFormat(
        lambda kind: F.concat(F.lit(f"# {KINDS[kind][0]} Training Data\n\n**Total {KINDS[kind][1]}:** "), _total(), F.lit("\n")),
        _markdown_block,
    ),
    "xml": DocumentFormat(
        lambda kind: F.concat(F.lit(f'<?xml version="1.0" ?>\n<{kind}'), _attribute("count", F.col("n_items")), F.lit(">")),
        _xml_block,
        lambda kind: F.lit(f"</{kind}>\n"),
    ),
    "json": DocumentFormat(lambda kind: F.lit("["), _json_block, lambda kind: F.lit("]")),
}


def render_blocks(items: DataFrame, keys: list[str], kind: str, fmt: str) -> DataFrame:
    """Blocks of the documents of numbered items, one document per value of `keys`.

    `items` has `item_no` (see `number_items`) and the fields of its kind, and may have
    `source_file` and, for summaries, `original_text`.
    """
    own = [c for c in items.columns if c not in (*keys, "item_no")]
    if fmt == "jsonl":
        return items.select(*keys, F.col("item_no").alias("block_no"), F.to_json(F.struct(*own)).alias("block"))
    if fmt not in FORMATS:
        raise ValueError(f"unknown document format: {fmt}")
    layout = FORMATS[fmt]
    body = items.select(*keys, F.col("item_no").alias("block_no"), layout.block(kind, own).alias("block"))
    frame = [F.struct(F.lit(0).cast("long").alias("block_no"), layout.heading(kind).alias("block"))]
    if layout.ending:
        frame.append(F.struct((F.col("n_items") + 1).alias("block_no"), layout.ending(kind).alias("block")))
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    return body.unionByName(counts.select(*keys, F.inline(F.array(*frame))))


def generic_document(kind: str, data: Column) -> Column:
    """Any other kind of item: its JSON with a type header."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data")))


def csv_columns(items: DataFrame) -> DataFrame:
    """Columns in name order, with lists and structures as JSON text."""
    nested = ("array", "struct", "map", "variant")
    columns = []
    for field in sorted(items.schema, key=lambda f: f.name):
        value = F.col("`" + field.name.replace("`", "``") + "`")
        columns.append(F.to_json(value).alias(field.name) if field.dataType.typeName() in nested else value)
    return items.select(*columns)
