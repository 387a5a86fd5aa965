"""What an image is, by its size, and the text that stands for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_type(width: Column, height: Column) -> Column:
    """diagram, screenshot, chart, photo or unknown; the order of the rules matters."""
    aspect = width / F.when(height != 0, height)
    near_square = aspect.between(0.8, 1.2)
    return (
        F.when(height.isNull() | width.isNull() | (height == 0), "unknown")
        .when((aspect > 2) | (aspect < 0.5), "diagram")
        .when(near_square & (width < 500), "screenshot")
        .when(near_square, "chart")
        .when(width.between(500, 2000) & height.between(500, 2000), "chart")
        .when((width > 2000) | (height > 2000), "photo")
        .when((width < 500) & (height < 500), "screenshot")
        .otherwise("unknown")
    )


#: Kinds of pictures that show data, and what is said of one without a text.
DATA_KINDS = ("chart", "graph", "diagram")
DATA_PHRASE = "Chart or graph showing data visualization"


def chunk_text(text: Column, kind: Column) -> Column:
    """Recognised text or caption, else a stock phrase."""
    stock = F.when(F.lower(kind).isin(*DATA_KINDS), F.lit(DATA_PHRASE)).otherwise(F.concat(F.lit("Image: "), F.coalesce(kind, F.lit("unknown"))))
    return F.coalesce(F.when(F.trim(text) != "", text), stock)


def with_caption(text: Column, caption: Column) -> Column:
    """Recognised text with the caption below it, or either alone."""
    has_text, has_caption = F.coalesce(F.trim(text) != "", F.lit(False)), F.coalesce(F.trim(caption) != "", F.lit(False))
    return F.when(has_text & has_caption, F.concat(text, F.lit("\n\nCaption: "), caption)).when(has_caption, caption).otherwise(text)
