"""Pictures of figures, written by a renderer that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def crop(figures: DataFrame, render: Callable[[dict], bytes], write: Callable[[str, bytes], None], exists: Callable[[str], bool]) -> DataFrame:
    """doc_id, page, preview (name of the page's picture), images of figures (doc_id, page, image_id): a name for each figure and
    one for the page with all of them, rendered and written unless they exist. If anything fails on a page, its images are none.

    `render` gets a dict of doc_id, page and image_ids (several for the page's picture); the rest are the store's functions."""
    pages = figures.groupBy("doc_id", "page").agg(F.sort_array(F.collect_set("image_id")).alias("ids")).withColumn("preview", T.preview_name(F.col("ids")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    for name, ids in [*((x, [x]) for x in r.ids), (r.preview, list(r.ids))]:
                        if not exists(name):
                            write(name, render({"doc_id": r.doc_id, "page": r.page, "image_ids": ids}))
                    out.append((r.doc_id, r.page, r.preview, list(r.ids)))
                except Exception:  # as any failure leaves an answer without pictures
                    out.append((r.doc_id, r.page, None, []))
            yield pd.DataFrame(out, columns=["doc_id", "page", "preview", "images"])

    return pages.mapInPandas(run, "doc_id string, page int, preview string, images array<string>")
