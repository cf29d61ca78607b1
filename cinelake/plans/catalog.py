"""All registered queries of the media engine with their SQL counterparts."""

from __future__ import annotations

from . import audio_queries, catalog_queries, color_queries, control_queries, detail_queries, frame_queries, media_queries, scalar_queries, text_queries, video_queries  # noqa: F401  they register themselves
from .registration import QUERIES, SQL, Query

FLAGSHIP = "silence_islands"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
