"""Language identification by compression: one zstandard raw-content dictionary per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.tables import small_batches, tidied

UNKNOWN = "und"
#: Bytes compressed at a time: each piece meets the dictionary anew, so the share it saves does not fall with a text's length.
PIECE = 1 << 14


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 256, piece: int = 384) -> dict[str, bytes]:
    """A dictionary per language: ``rows`` passages of ``piece`` characters, lower-cased, in the order of a hash of the text.

    Languages come in the order of their training rows, most first.

    This bounded sample (``rows`` x ``piece`` per language) is all that reaches the driver.  Rows without a language
    or without text teach nothing.  Passages from the middle of long texts are used, as openings are often alike.
    """
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("h"), text.alias("t"))
    middle = F.greatest(F.lit(1), F.floor((F.length("t") - piece) / 2)).cast("int")
    passages = known.select("lang", "h", F.lower(F.substring(F.col("t"), middle, F.lit(piece))).alias("p"))
    first = passages.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "p"))).where(F.col("k") <= rows)
    found: dict[str, list[str]] = {}
    for row in first.orderBy("lang", F.desc("k")).select("lang", "p").collect():
        found.setdefault(row.lang, []).append(row.p)
    rows_of = dict(known.groupBy("lang").count().collect())
    return {lang: "\n".join(found[lang]).encode() for lang in sorted(found, key=lambda x: (-rows_of[x], x))}


def _compressors(dictionaries: dict[str, bytes], level: int):
    made = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def _classify(batches, dictionaries, level, margin):
    langs = list(dictionaries)
    compressors = _compressors(dictionaries, level)
    for batch in batches:
        pred, score = [], []
        for text, lettered in zip(batch.column(1), batch.column(2)):
            raw = text.as_py()
            if not lettered.as_py() or not langs:
                pred.append(UNKNOWN)
                score.append(0.0)
                continue
            raw = raw.lower().encode()
            pieces = [raw[k:k + PIECE] for k in range(0, len(raw), PIECE)]
            size = np.array([sum(len(c.compress(x)) for x in pieces) for c in compressors], float)
            best = int(size.argmin())
            second = np.delete(size, best).min() if len(size) > 1 else 2 * size[best]
            pred.append(langs[best])
            score.append(min(1.0, (second - size[best]) / second))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([s < margin for s in score])],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = 6, margin: float = 0.002, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row (and the columns in ``keep``, of any name but these).

    The whole text, lower-cased, is compressed with each dictionary in pieces of ``PIECE`` bytes; the smallest sum wins, equal
    ones go to the language with the most training rows.  ``score`` is by how much the second best is larger, as a share of it.
    Below ``margin`` the language is rejected.  Null texts and texts without a letter are ``und`` with score 0 and
    rejected; so is everything if nothing was learned.  Rows are classified one by one, repeated ones alike; no rows
    give no rows.  Columns not in ``keep`` are ignored, whatever their names.
    The dictionaries travel with the task: their size is bounded by ``train``.
    """
    text = F.col(text_col).cast("string")
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.expr(f"rlike(cast(`{text_col}` as string), '\\\\p{{L}}')"), F.lit(False)).alias("lettered"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    if not keep:
        kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
        return narrow.mapInArrow(tidied(lambda b: _classify(b, dictionaries, level, margin)), f"doc_id {kind}, lang_pred string, score double, rejected boolean")

    def with_rest(batches):
        for batch in batches:
            for out in _classify([batch], dictionaries, level, margin):
                yield pa.RecordBatch.from_arrays([*out.columns, *[batch.column(f"keep_{c}") for c in keep]], names=[*out.schema.names, *keep])

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = f"doc_id {kinds['doc_id']}, lang_pred string, score double, rejected boolean" + "".join(f", `{c}` {kinds[f'keep_{c}']}" for c in keep)
    return narrow.mapInArrow(tidied(with_rest), schema)
