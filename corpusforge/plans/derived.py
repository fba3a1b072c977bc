"""Tables that Spark derives from the corpus tables, standing in for inputs they do not hold.

Each derivation keeps every row of its source table. Names say what the result stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import let
from corpusforge.operators.chunking import chunk_lines

EPOCH = "2024-01-01 00:00:00"
OWN_TIMESTAMP = "2024-02-02T00:00:00Z"
EXTENSIONS = ["pdf", "txt", "srt", "vtt", "epub", "png", "docx", "TXT"]


def pick(key: Column, values: list[str]) -> Column:
    """One of `values` by the key, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def minutes_after(key: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(EPOCH).cast("timestamp")) + key * 60_000_000)


def files_of(documents: DataFrame) -> DataFrame:
    """Every document as a file: path, length, mtime and content."""
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), pick(F.col("doc_id"), EXTENSIONS)))
    return documents.select(
        path.alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        minutes_after(F.col("doc_id")).alias("mtime"),
        F.col("text").alias("content"),
        "doc_id",
    )


def page_files(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("long").alias("length"),
        minutes_after(F.col("page_id")).alias("mtime"),
    )


def later_files(documents: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """A later listing: low-quality documents are gone, toxic ones rewritten, web pages added."""
    marked = files_of(documents).join(labels, "doc_id", "left")
    kept = marked.filter(F.coalesce(F.col("quality"), F.lit(1)) != 0)
    moved = F.when(F.col("toxic") == 1, F.col("mtime") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("mtime"))
    return kept.select("path", "length", moved.alias("mtime")).unionByName(page_files(pages))


def run_log_of(documents: DataFrame) -> DataFrame:
    """A run over the documents: some fail, one run of failures in a row each 17 files."""
    key = F.col("doc_id")
    failed = (key % 17).isin(3, 4, 5)
    return documents.select(
        key.alias("seq"),
        F.concat_ws("/", "source", key.cast("string")).alias("path"),
        F.col("source").alias("processor"),
        (~failed).alias("success"),
        F.when(failed, 0).otherwise(F.col("n_chars")).cast("long").alias("text_chars"),
        F.when(failed, 0).otherwise(key % 4).cast("long").alias("image_count"),
        # Multiples of 1/64: their sums are exact in any order.
        (F.col("n_chars") % 997 / 64 + 0.5).alias("seconds"),
        F.when(failed & (key % 5 == 0), "HTTP 429: quota exceeded").when(failed, "Content quality below threshold").alias("error"),
    )


def store_of(documents: DataFrame, labels: DataFrame, key: Column) -> DataFrame:
    """Stored extractions: every labelled document has an entry, some of them stale."""
    files = files_of(documents).join(labels, "doc_id")
    return files.select(
        key.alias("cache_key"),
        F.concat("path", F.when(F.col("toxic") == 1, "").otherwise(".gz")).alias("path"),
        F.when(F.col("quality") == 0, "1.0").otherwise("2.0").alias("version"),
        "length",
        F.when(F.col("toxic") == 1, F.col("mtime") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("mtime")).alias("mtime"),
        (F.col("mtime") + F.expr("INTERVAL 2 HOURS")).alias("cached_at"),
        (F.timestamp_micros(F.unix_micros("mtime") + F.col("length") * 1_000_000)).alias("accessed_at"),
        F.col("length").alias("size"),
        F.col("content").alias("text"),
    )


def page_texts(documents: DataFrame) -> DataFrame:
    """Documents cut into pages of 20 lines, some with images (areas by page and position)."""
    pages = documents.select("doc_id", F.posexplode(chunk_lines(F.col("text"))).alias("pos", "text"))
    page = F.col("pos") + 1
    count = (F.col("doc_id") * page % 4).cast("int")
    slots = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    area = lambda i: (F.col("doc_id") * 7919 + page * 104729 + i * 1299709) % 1_200_000
    return pages.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        page.alias("page_num"),
        "text",
        count.alias("image_count"),
        F.transform(slots, lambda i: area(i).cast("double")).alias("image_areas"),
    )


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def page_layouts(documents: DataFrame) -> DataFrame:
    """Page rows that carry their own text blocks (one per line) and images, with boxes."""
    pages = page_texts(documents)
    seed = F.col("doc_id") + F.col("page_num") * 31
    blocks = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            i.alias("block_no"),
            _box((seed * 13 + i * 57) % 300, i * 40, F.lit(200.0), F.lit(20.0)).alias("bbox"),
            line.alias("text"),
        ),
    )
    images = F.transform(
        F.arrays_zip(F.col("image_areas").alias("area")),
        lambda z, i: F.struct(
            _box((seed * 29 + i * 83) % 400, (seed * 17 + i * 211) % 700, F.lit(150.0), F.lit(90.0)).alias("bbox"),
            z["area"].cast("long").alias("area"),
            ((seed * 101 + i * 37) % 400_000).alias("size_bytes"),
            pick(seed + i, ["RGB", "RGBA", "L"]).alias("mode"),
            F.when((seed + i) % 5 == 0, F.lit(None).cast("long")).otherwise((seed * 53 + i * 19) % 20_000).alias("n_colors"),
            F.transform(
                F.sequence(F.lit(1), ((seed + i) % 6 + 1).cast("int")),
                # The first colour covers 10 to 21 parts of 22, the others little.
                lambda c: F.struct((z["area"] * F.when(c == 1, (seed + i) % 12 + 10).otherwise(1) / 22).alias("n")),
            ).alias("color_counts"),
            F.when((seed + i) % 3 == 0, F.lit(None).cast("double")).otherwise((seed * 7 + i) % 100 / 100).alias("quality_score"),
        ),
    )
    return pages.select("doc_id", "path", "page_num", "text", blocks.alias("blocks"), images.alias("images"))


GENERATOR_ORDER = ["conversations", "qa_pairs", "embeddings", "summaries"]


def _escaped(text: Column) -> Column:
    """The inside of the text as a JSON string; null text is null."""
    listed = let(F.to_json(F.array(text)), lambda t: F.substring(t, F.lit(3), F.length(t) - 4))
    return F.when(text.isNotNull(), listed)


def completions_of(chunks: DataFrame) -> DataFrame:
    """An answer for every (doc, chunk, generator) row, in the shapes models really return.

    Answers quote the whole text of their `chunk`; those of one item (shape 5) bring a timestamp of their own.
    """
    key = F.col("doc_id") + F.col("chunk_id")
    shape = (key % 8).cast("int")
    generator = F.col("generator")
    end = F.when(shape == 5, f',"timestamp":"{OWN_TIMESTAMP}"}}').otherwise("}")

    def item_of(body: Column) -> Column:
        q, a = (F.coalesce(F.concat(F.lit(f'"{mark} '), body, F.lit('"')), F.lit("null")) for mark in "qa")
        return (
            F.when(generator == "conversations", F.concat(F.lit('{"messages":[{"content":'), q, F.lit(',"role":"user"},{"content":'), a, F.lit(',"role":"assistant"}]'), end))
            .when(generator == "qa_pairs", F.concat(F.lit('{"answer":'), a, F.lit(',"question":'), q, end))
            .when(generator == "embeddings", F.concat(F.lit('{"sentence1":'), q, F.lit(',"sentence2":'), a, F.lit(',"similarity":0.5'), end))
            .otherwise(F.concat(F.lit('{"summary":'), a, end))
        )

    other_key = F.when(generator == "embeddings", "pairs").otherwise(generator)

    def shaped(item: Column) -> Column:
        own = F.concat(F.lit('{"'), generator, F.lit('":['), item, F.lit(","), item, F.lit("]}"))
        return (
            F.when(shape == 0, own)
            .when(shape == 1, F.concat(F.lit("```json\n"), own, F.lit("\n```")))
            .when(shape == 2, F.concat(F.lit("["), item, F.lit("]")))
            .when(shape == 3, F.concat(F.lit('{"items":['), item, F.lit(","), item, F.lit(","), item, F.lit("]}")))
            .when(shape == 4, F.concat(F.lit('{"'), other_key, F.lit('":['), item, F.lit("]}")))
            .when(shape == 5, item)
        )

    # The chunk is quoted once and the item made once, however often the answer holds them.
    quoting = let(let(_escaped(F.col("chunk")), item_of), shaped)
    raw = F.when(shape == 6, F.lit("42")).when((shape >= 0) & (shape < 6), quoting).otherwise(F.concat(F.lit("Sorry, here is "), "chunk"))
    return chunks.select("doc_id", "chunk_id", "generator", (key % 3 + 1).cast("int").alias("attempt"), raw.alias("raw"))


def _clock(second: Column, mark: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}000", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)


def subtitles_of(conversations: DataFrame) -> DataFrame:
    """Each turn as a subtitle file of two cues, with a number line, tags and a line of digits."""
    start = F.col("turn") * 7
    words = F.regexp_replace("text", r"[\r\n]+", " ")

    def cues(mark: str, numbered: bool) -> Column:
        def cue(n: int, at: Column, body: Column) -> Column:
            head = F.lit(f"{n}\n" if numbered else "")
            return F.concat(head, _clock(at, mark), F.lit(" --> "), _clock(at + 3, mark), F.lit("\n"), body)

        second = F.concat(F.lit("<i>"), F.col("role"), F.lit("</i>\n12345"))
        return F.concat(cue(1, start, words), F.lit("\n\n"), cue(2, start + 3, second), F.lit("\n"))

    return conversations.select(
        "conv_id", "turn", cues(",", True).alias("srt"), F.concat(F.lit("WEBVTT\n\n"), cues(".", False)).alias("vtt")
    )


def responses_of(conversations: DataFrame) -> DataFrame:
    """Each turn as the response body of a completion service, in three shapes and an empty one."""
    text = F.col("text")
    shape = F.col("conv_id") + F.col("turn")
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    content = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content")))
    parts = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    candidates = F.to_json(F.struct(F.array(F.struct(parts.alias("content"))).alias("candidates")))
    kind = pick(shape, ["choices", "content", "candidates", "choices"])
    body = F.when(shape % 4 == 0, choices).when(shape % 4 == 1, content).when(shape % 4 == 2, candidates).otherwise("{}")
    return conversations.select("conv_id", "turn", kind.alias("shape"), body.alias("body"))


def write_books(pages: DataFrame, folder: str, size: int) -> None:
    """Pages, `size` at a time by page_id, as the chapters of EPUB files `book-<n>.epub`."""
    import io
    import zipfile

    import pandas as pd

    from corpusforge.sinks.committed import open_folder, put_whole

    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)

    def bind(key, chapters: pd.DataFrame) -> pd.DataFrame:
        chapters = chapters.sort_values("page_id")
        names = [f"text/c{i}.xhtml" for i in range(len(chapters))]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/book.opf"/></rootfiles></container>')
            listed = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
            book.writestr("O/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="p" href="p.png" media-type="image/png"/>{listed}</manifest></package>')
            book.writestr("O/p.png", b"image")
            for name, html in zip(names, chapters["html"]):
                book.writestr(f"O/{name}", html)
        system, root = open_folder(folder)
        put_whole(system, f"{root}/book-{key[0]}.epub", out.getvalue())
        return pd.DataFrame({"book": [key[0]]})

    number = F.floor(F.col("page_id") / size).cast("long")
    pages.select(number.alias("book"), "page_id", "html").groupBy("book").applyInPandas(bind, "book long").write.format("noop").mode("overwrite").save()
