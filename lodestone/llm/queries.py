"""The operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, decontam, langid, media, mixing, quality, records, simhash, substring, urls
from lodestone.session import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": lambda s, d: langid.identify(read(s, d, "documents")),
    "op2_token_records": lambda s, d: records.publish(read(s, d, "documents")),
    "op3_media_hashes": lambda s, d: media.hash_pictures(media.paint(read(s, d, "embeddings"))),
    "op4_simhash_near_dedup": lambda s, d: simhash.near_duplicates(read(s, d, "documents")),
    "op5_substring_dedup": lambda s, d: substring.remove_repeats(read(s, d, "documents")),
    "op6_quality": lambda s, d: quality.classify(read(s, d, "documents"), read(s, d, "labels")),
    "op7_url_filters": lambda s, d: urls.filter_urls(*urls.with_links(read(s, d, "pages"))),
    "op8_mixing": lambda s, d: mixing.select_blocks(read(s, d, "documents")),
    "op9_decontamination": lambda s, d: decontam.leaks(read(s, d, "documents"), read(s, d, "benchmark")),
    "op10_chat_rotation": lambda s, d: chat.rotate(read(s, d, "conversations")),
}

ORACLE: dict[str, str] = {
    "op5_substring_dedup": substring.ORACLE,
    "op7_url_filters": urls.oracle(),
    "op8_mixing": mixing.oracle(),
    "op10_chat_rotation": chat.ORACLE,
}
