"""Pages of recognised text: rows and tables from boxes, the kind of a scanned document, and what is known of its images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The confidence that a token must exceed, how near a row's mean a token's middle is, and by how many columns neighbouring rows of a table differ.
LEAST_CONFIDENCE, ROW_DISTANCE, COLUMNS_APART = 0.3, 15, 2
#: The least width and height of an image that counts.
LEAST_SIDE = 100
#: How a document of each kind is best handled.
STRATEGIES = {"pure_image": "ocr_first", "scanned_document": "ocr_enhanced", "image_dominant": "image_first", "hybrid_document": "balanced", "text_dominant": "text_first", "mixed_content": "adaptive"}


def _rows(tokens: list[tuple[float, float, str]]) -> Iterator[list[str]]:
    """The rows of (y, x, text) tokens in order of y: one joins a row while it is near the row's mean so far."""
    row: list[tuple[float, str]] = []
    total = 0.0
    for y, x, text in tokens:
        if row and abs(y - total / len(row)) >= ROW_DISTANCE:
            yield [t for _, t in sorted(row, key=lambda r: r[0])]
            row, total = [], 0.0
        row.append((x, text))
        total += y
    if row:
        yield [t for _, t in sorted(row, key=lambda r: r[0])]


def _table(rows: list[list[str]]) -> list[str]:
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return [line(rows[0]), "|" + "---|" * width, *map(line, rows[1:])]


def _page(tokens: list[tuple[float, float, str]]) -> tuple[str, int]:
    lines: list[str] = []
    held: list[list[str]] = []
    tables = 0

    def close(last: bool) -> None:
        nonlocal tables
        if len(held) > 1:
            lines.extend(_table(held) + [""] * (not last))
            tables += 1
        else:
            lines.extend(" ".join(r) for r in held)
        held.clear()

    for row in _rows(tokens):
        if len(row) > 1 and (not held or abs(len(row) - sum(map(len, held)) / len(held)) <= COLUMNS_APART):
            held.append(row)
        else:
            close(False)
            lines.append(" ".join(row))
    close(True)
    return "\n".join(lines), tables


def ocr_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, text, tables) of each page's tokens (doc_id, page, i, text, confidence, x_min, x_max, y_min, y_max).

    Tokens go from top to bottom by their middle, equal ones by `i`; one is in the row before it while its middle is within 15 of the row's mean. Two or
    more successive rows of two or more cells, each within two columns of their mean, become a Markdown table, headed by the first; the others
    are lines of words. A single row of cells is a line (it is not lost). Tokens of confidence 0.3 or less, or without one, are left out; a page
    without others has no row. A page is a task's group, of a page's size.
    """

    def pages(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("y", "ascending"), ("i", "ascending")]).to_pydict()
        text, n = _page(list(zip(rows["y"], rows["x"], rows["text"], strict=True)))
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "page": table["page"].slice(0, 1), "text": pa.array([text], pa.string()), "tables": pa.array([n], pa.int32())})

    kinds = dict(tokens.dtypes)
    middle = lambda a, b: ((F.col(a) + F.col(b)) / 2).cast("double")
    sure = tokens.filter(F.col("confidence") > LEAST_CONFIDENCE).select("doc_id", "page", "i", F.coalesce("text", F.lit("")).alias("text"), middle("x_min", "x_max").alias("x"), middle("y_min", "y_max").alias("y"))
    return sure.groupBy("doc_id", "page").applyInArrow(pages, f"doc_id {kinds['doc_id']}, page {kinds['page']}, text string, tables int")


def document_type(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages, text_density, image_ratio, pages_with_text, total_images, document_type, strategy) from pages (doc_id, chars, images).

    The kind goes by characters a page and the share of pages with images; a page has text from 51 characters on.
    """
    found = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.avg("chars").alias("text_density"), F.avg((F.col("images") > 0).cast("double")).alias("image_ratio"), F.count_if(F.col("chars") > 50).alias("pages_with_text"), F.sum("images").alias("total_images"))
    text, ratio = F.col("text_density"), F.col("image_ratio")
    #: Bounds of the kinds, in the order in which they are tried.
    kind = (
        F.when((text < 10) & (F.col("pages_with_text") == 0), "pure_image").when((text < 100) & (ratio > 0.7), "scanned_document").when((text < 300) & (ratio > 0.5), "image_dominant")
        .when((text > 300) & (ratio > 0.3), "hybrid_document").when((text > 300) & (ratio < 0.3), "text_dominant").otherwise("mixed_content")
    )
    advice = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    typed = found.withColumn("document_type", kind).withColumn("strategy", F.element_at(advice, F.col("document_type")))
    return typed.withColumn("text_density", F.round("text_density", 6)).withColumn("image_ratio", F.round("image_ratio", 6))


def image_filter(images: DataFrame, least: int = LEAST_SIDE, once: bool = False) -> DataFrame:
    """Images (doc_id, idx, width, height, ...) of at least this width and height; `once`: the first of each size in a document."""
    large = images.filter((F.col("width") >= least) & (F.col("height") >= least))
    if not once:
        return large
    first = Window.partitionBy("doc_id", "width", "height").orderBy("idx")
    return large.withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
