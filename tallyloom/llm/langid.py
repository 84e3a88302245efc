"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled text.
A text is encoded, block by block, with each dictionary; the language whose
dictionary yields the fewest bytes wins, and a narrow margin to the second marks
the prediction as rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drawn, remainder, table, texts

LETTER = regex.compile(r"\p{L}")
OTHER, NEWER = re.compile(r"[\W\d_]+"), regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """Lower case, everything between letters and their marks as one blank: capitals and junk signs tell no languages apart."""
    lower = text.lower()
    found = OTHER.sub(" ", lower).strip() or NEWER.sub(" ", lower).strip()  # letters may be newer than the faster tables
    return found.encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: language to some raw-content dictionaries (several give sizes finer than a byte).

    Texts of at most short_bytes are encoded at short_level, which finds shorter matches.
    Ties go to the language first in dictionaries, the one with most labelled rows.
    """

    dictionaries: dict[str, tuple[bytes, ...]]
    level: int = 6
    short_level: int = 19
    short_bytes: int = 512
    block_bytes: int = 8192
    margin: float = 0.01


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 400,
    stretch_chars: int = 4096,
    dictionary_bytes: int = 32768,
    dictionaries: int = 2,
    max_languages: int = 500,
    **settings,
) -> LanguageModel:
    """Dictionaries from at most `sample_rows` labelled texts a language, those with the smallest hashes.

    Of each text a stretch at a hashed place is taken, as long as fills the dictionaries evenly, of at most
    `stretch_chars` characters. Rows with a null text or label teach nothing; with no labelled rows the
    model knows no language. More than `max_languages` labels are an error rather than some being dropped.
    """
    sizes = {r[lang]: r.n for r in docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} values of {lang}")
    if not sizes:
        return LanguageModel({}, **settings)
    found: dict[str, list] = {g: [] for g in sizes}
    for r in drawn(docs, text, sample_rows, by=lang, chars=stretch_chars):
        found[r.g].append((r.h, letters(r.t)))
    made = {}
    for g, own in found.items():
        parts = [bytearray() for _ in range(dictionaries)]
        share = max(256, -(-5 * dictionary_bytes * dictionaries // (4 * max(1, len(own)))))
        for i, (h, t) in enumerate(own):
            # each text gives a share, so that one long text doesn't fill a dictionary
            at = h % max(1, len(t) - share + 1)
            if len(part := parts[i % dictionaries]) < dictionary_bytes:
                part += t[at : at + share] + b" "
        made[g] = tuple(bytes(p[:dictionary_bytes]) for p in parts if p)
    return LanguageModel({g: d for g, d in made.items() if d}, **settings)


class Encoder:
    """The encoders of a model; made once a task."""

    def __init__(self, model: LanguageModel):
        self.model, self.languages = model, list(model.dictionaries)
        self.encoders, self.short = ([[self.encoder(d, level) for d in model.dictionaries[g]] for g in self.languages] for level in (model.level, model.short_level))

    @staticmethod
    def encoder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str) -> list[float]:
        data, step = letters(text), self.model.block_bytes
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        encoders = self.short if len(data) <= self.model.short_bytes else self.encoders
        return [sum(len(e.compress(b)) for e in own for b in blocks) / len(own) for own in encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected. The score falls with the margin, from 1 towards 1 / languages."""
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if not (most := max(sizes)):  # nothing was encoded: no language is nearer than another
            return self.languages[0], 1 / len(sizes), True
        rest = sorted(s for i, s in enumerate(sizes) if i != best)
        margin = (rest[0] - sizes[best]) / most if rest else 1.0
        score = 1 / sum(math.exp(-60 * (s - sizes[best]) / most) for s in sizes)
        return self.languages[best], score, margin < self.model.margin


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to every row.

    A null text, or one without a letter (so an empty one too), gives `und`, 0
    and rejected. Ties go to the language with
    most labelled rows. Other columns stay;
    columns of the new names are replaced. Whole texts count, however long.
    """

    def make():
        encoder = Encoder(model)

        def work(batch):
            found = [encoder.predict(t) for t in texts(batch, text)]
            return [[f[i] for f in found] for i in range(3)]

        return work

    return arrow_map(docs, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")], make)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id", 5) != 0))
    held = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    return identify(held, model).drop("text")
