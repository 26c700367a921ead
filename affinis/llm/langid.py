"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkernel import begin
from .workspace import with_id

UNKNOWN = "und"
#: Bytes of a text that are encoded at a time, and bytes that are encoded at least: a shorter text goes to several dictionaries.
BLOCK, LEAST = 4096, 1024
LEVEL = 7
#: ASCII letters and all bytes of other characters stay, everything else separates words.
KEPT = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The words of a text, lower-cased, each between single spaces."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(KEPT).split()) + b" "


@dataclass(frozen=True)
class LanguageModel:
    """Raw contents of the dictionaries of each language; of languages that encode a text alike the first in order is chosen."""

    languages: tuple[str, ...]
    contents: tuple[tuple[bytes, ...], ...]

    @classmethod
    def fit(cls, labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = 64, samples: int = 512, piece: int = 400, dictionaries: int = 4) -> LanguageModel:
        """Dictionaries from a bounded sample of labelled rows.

        Of the ``most`` languages with the most rows (ties: in order of their names), ``samples`` rows each, those of the
        least hashes of id and text, give ``piece`` characters from a place that a hash of the text chooses; equal pieces
        count once. They are dealt over ``dictionaries`` for each language, so a model holds at most
        ``most * samples * piece`` characters, 13 million, however many rows there are. Rows without a language, a text or
        a letter are left out. Languages are in order of their rows, which decides between equal sizes.
        """
        rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
        counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
        names = [r["lang"] for r in counts]
        if not names:
            return cls((), ())
        at = F.pmod(F.xxhash64(F.lit(2), "text"), F.greatest(F.length("text") - piece, F.lit(0)) + 1).cast("int")
        pieces = rows.where(F.col("lang").isin(names)).select("lang", F.xxhash64("id", "text").alias("h"), F.substring("text", at + 1, F.lit(piece)).alias("piece"))
        chosen = pieces.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= samples).collect()
        contents = []
        for name in names:
            own = [plain(x) for x in sorted({(r["h"], r["piece"]) for r in chosen if r["lang"] == name}) for x in x[1:]]
            own = list(dict.fromkeys(x for x in own if x.strip())) or [b" "]
            contents.append(tuple(b"".join(own[k::dictionaries] or own) for k in range(dictionaries)))
        return cls(tuple(names), tuple(contents))

    def compressors(self) -> list[list]:
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters(compression_level=LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        return [[zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(x, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for x in own] for own in self.contents]


def sizes(text: str, compressors: list[list]) -> list[int]:
    """Bytes that a whole text takes with each language's dictionaries, block by block; a short text with several of them."""
    data = plain(text)
    again = -(-LEAST // len(data))
    out = []
    for own in compressors:
        out.append(sum(len(own[(i // BLOCK + k) % len(own)].compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK) for k in range(min(again, len(own)))))
    return out


def predict_batches(model: LanguageModel, narrow: float):
    """mapInArrow function: (id, text) to (id, lang_pred, score, sure)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        compressors = model.compressors()
        for batch in batches:
            found: list[tuple[str, float, bool]] = []
            for x in batch.column(1):
                text = x.as_py()
                if text is None or not compressors or not any(map(str.isalpha, text)):
                    found.append((UNKNOWN, 0.0, False))
                    continue
                each = sizes(text, compressors)
                best = min(range(len(each)), key=lambda k: (each[k], k))
                second = min((n for k, n in enumerate(each) if k != best), default=None)
                margin = 1.0 if second is None else 1 - each[best] / second
                found.append((model.languages[best], margin, margin >= narrow))
            lang, score, sure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["id", "lang_pred", "score", "sure"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02) -> DataFrame:
    """The language of every whole text.

    Returns a row for each input row: the id, lang_pred, score (by how much of itself the second best language's size
    is larger than the best one's, 0 to 1; 1 if only one language is known) and sure (false: rejected, as the margin is
    under ``narrow``). A text that is null or has no letter is ``und`` with a score of 0, as is every text if no
    language was learned. Only the text decides; other columns are ignored, whatever their names, and ids may be null or
    repeat. Words are compared in lower case, without what stands between them; a long text is encoded in blocks of
    4,096 bytes, which take turns among a language's dictionaries.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict_batches(model, narrow), with_id(rows, "lang_pred string, score double, sure boolean")).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is held out: the CRC-32 of its id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out (a null id is neither)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = LanguageModel.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "sure")
