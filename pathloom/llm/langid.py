"""Language by compression: the language whose dictionary packs a text smallest.

Method. For each language a raw-content zstandard dictionary is made of labelled texts. A text, as its letters
in lower case, is compressed in pieces of ``PIECE`` bytes against every dictionary, so that a piece can lean
on the dictionary and not on what came before it. The smallest total wins. ``margin`` is how much larger
the second is, relative to its size; a text with a margin below ``least`` is rejected.

Fit. At most ``snippets`` rows per language, those with the smallest hash of their text, ``SNIPPET`` characters
of each at a place chosen by the hash: a dictionary is at most ``snippets * SNIPPET`` characters. Prediction
has no bound: whole texts count.

Cases. A text that is null or has no letter is ``und`` with score 0 and is rejected; so is every text if
nothing was learned. Equal sizes go to the first language by name, with a margin of 0. Repeated rows get
equal results. Null languages teach nothing. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.scratch import frugal

SNIPPET = 500
PIECE = 512
LEVEL = 9
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """Letters of a text in lower case, words apart by one space."""
    return " ".join(LETTERS.findall(text.lower())).encode()


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", snippets: int = 220) -> dict[str, bytes]:
    """Dictionary of each language."""
    source = F.col(text).cast("string")
    df = labelled.where(F.col(lang).isNotNull() & source.isNotNull()).select(F.col(lang).cast("string").alias("lang"), source.alias("text"))
    df = df.select("lang", F.xxhash64("text").alias("h"), "text")
    room = F.greatest(F.length("text") - SNIPPET, F.lit(1))
    df = df.select("lang", "h", F.substr("text", (F.pmod("h", room) + 1).cast("int"), F.lit(SNIPPET)).alias("snippet")).where(F.regexp_like("snippet", F.lit(r"\p{L}")))
    per = Window.partitionBy("lang").orderBy("h", "snippet")
    rows = df.distinct().withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= snippets).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        out.setdefault(r["lang"], []).append(plain(r["snippet"]))
    return {k: b" ".join(v) for k, v in out.items()}


def _packers(model: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in model.values():
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _predict(model: dict[str, bytes], least: float):
    names = sorted(model)

    def one(text: str | None, packers) -> tuple[str, float, float, bool]:
        data = plain(text or "")
        if not packers or not any(map(str.isalpha, data.decode())):
            return UNKNOWN, 0.0, 0.0, True
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(p.compress(x)) for x in pieces) for p in packers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        score = 1 / sum(2.0 ** max(-60, best - s) for s in sizes)
        return names[order[0]], score, margin, margin < least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers({n: model[n] for n in names})
        for batch in batches:
            found = [one(t, packers) for t in batch["text"].to_pylist()]
            lang, score, margin, rejected = zip(*found) if found else ((), (), (), ())
            columns = {c: batch[c] for c in batch.schema.names}
            columns |= {
                "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                "margin": pa.array(margin, pa.float64()), "rejected": pa.array(rejected, pa.bool_()),
            }
            yield pa.record_batch(columns)

    return run


def predict(docs: DataFrame, model: dict[str, bytes], keep: list[str], text: str | Column = "text", least: float = 0.002) -> DataFrame:
    """Columns ``keep`` of ``docs``, ``text``, and ``lang_pred``, ``score``, ``margin``, ``rejected``."""
    clash = {"text", "lang_pred", "score", "margin", "rejected"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    names = [f"k{i}" for i in range(len(keep))]
    source = F.col(text) if isinstance(text, str) else text
    df = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), source.cast("string").alias("text"))
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{schema}, text string, lang_pred string, score double, margin double, rejected boolean"
    return df.mapInArrow(frugal(_predict(model, least)), schema).withColumnsRenamed(dict(zip(names, keep)))
