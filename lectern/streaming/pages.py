"""Near-duplicate pages over a stream (an extension): the last accepted word sets of each deck are the state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.settings import Settings


def words_of(markdown: str) -> set[str]:
    return set("".join(c if c.isascii() and c.isalnum() else " " for c in (markdown or "").lower()).split())


def drop_near_duplicates_stream(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Accepted pages of a stream of (doc_id, page_number, raw_markdown); pages of a deck must arrive in order."""

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [set(x) for x in json.loads(state.get[0])] if state.exists else []
        for frame in frames:
            good = []
            for markdown in frame.sort_values("page_number")["raw_markdown"]:
                w = words_of(markdown)
                clash = len(w) >= settings.near_dup_min_words and any(k and len(w & k) / len(w | k) >= settings.near_dup_jaccard for k in kept)
                good.append(not clash)
                if not clash:
                    kept = [*kept, w][-settings.near_dup_window :]
            yield frame.sort_values("page_number")[good]
        state.update((json.dumps([sorted(k) for k in kept]),))

    columns = pages.select("doc_id", "page_number", "raw_markdown")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema.fields)
    return columns.groupBy("doc_id").applyInPandasWithState(accept, schema, "kept string", "append", GroupStateTimeout.NoTimeout)
