"""Language identification, words first: known words count with their log frequency in each language, unseen words
back off to the longest known character n-grams, from four characters down to one.

The model is fitted on a sample of labelled documents that is bounded in documents, in characters and in languages. It
holds every word and every n-gram of that sample, so its size has the same bound and follows from no other cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import held_out, public_id, texts
from thermocline.session import durable

#: The labelled sample: documents and characters of each language, characters of all, about, and the most languages.
PER_LANGUAGE, LANGUAGE_CHARS, ALL_CHARS, MOST_LANGUAGES = 2_000, 8_000_000, 32_000_000, 1_000
LONGEST = 4
UNKNOWN = "und"
#: Unseen words whose scores a worker remembers.
MEMORY = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters. Digits of other kinds than 0-9 count as ends of words."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language, a matrix row for each word and each n-gram."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the word's characters of the longest known n-gram that ends there."""
        marked, rows = f"^{word}$", []
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - LONGEST), end):
                if (row := self.grams.get(marked[start:end])) is not None:
                    rows.append(row)
                    break
        return self.gram_logs[rows].mean(axis=0) if rows else np.zeros(len(self.languages), np.float32)

    def predict(self, text: str, memory: dict) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        total = self.word_logs[at[at >= 0]].sum(axis=0, dtype=np.float64)
        for i in np.flatnonzero(at < 0).tolist():
            if (seen := memory.get(words[i])) is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                seen = memory[words[i]] = self.unseen(words[i])
            total = total + seen
        # Words of a text depend on each other; the square root keeps a few words from giving certainty.
        scaled = (total - total.max()) / np.sqrt(len(words))
        p = np.exp(scaled)
        best = int(total.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _tally(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                make(counts, *row)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return run


def _counted(counts):
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
         pa.array(list(counts.values()), pa.int64())], names=["lang", "item", "n"])


def _count_words(counts, lang, text):
    counts.update((lang, w) for w in words_of(text))


def _count_grams(counts, lang, word, n):
    for g in grams(word):
        counts[lang, g] += n


def _matrix(table: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """A row for each item and its smoothed log frequencies by language."""
    got = table.toArrow().to_pydict()
    row = {w: i for i, w in enumerate(sorted(set(got["item"])))}
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(row), len(languages)))
    np.add.at(counts, ([row[w] for w in got["item"]], [place[x] for x in got["lang"]]), got["n"])
    smooth = 0.5
    return row, np.log((counts + smooth) / (counts.sum(axis=0) + smooth * max(len(row), 1))).astype(np.float32)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, language_chars: int = LANGUAGE_CHARS, all_chars: int = ALL_CHARS,
          most_languages: int = MOST_LANGUAGES) -> Model:
    """Count all words and n-grams of a sample of the labelled documents, chosen by a hash of doc_id.

    Of each language about `per_language` documents are taken, or as many as hold about `language_chars` characters or its
    part of `all_chars`, if those are fewer; whole texts are counted. Of more than `most_languages` values of lang the most
    frequent are learned. Rows that are held out or have a null lang or no id are not used.
    """
    usable = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"].cast("long")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = (usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
             .orderBy(F.desc("n"), "lang").limit(most_languages).collect())
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    room = min(language_chars, all_chars // len(languages))
    shares = {r.lang: max(1, min(1 << 20, (per_language << 20) // r.n, (room << 20) // max(r.chars, 1))) for r in sizes}
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, shares[lang])])
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit[F.col("lang")])
    schema = "lang string, item string, n long"
    words = durable(chosen.select("lang", "text").mapInArrow(_tally(_count_words), schema).groupBy("lang", "item").agg(F.sum("n").alias("n")))
    pieces = words.mapInArrow(_tally(_count_grams), schema).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    known, word_logs = _matrix(words, languages)
    parts, gram_logs = _matrix(pieces, languages)
    return Model(languages, known, word_logs, parts, gram_logs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text, a row for each input row.

    A null text or one without a letter is `und` with score 0, and so is every text if the model knows no language.
    Letters that the model has never seen leave all languages equal; the first by name is given then. A null doc_id is
    not held out. Repeated rows get equal results. A text of any length is scored whole, each word once it is met. An
    empty table gives no rows; columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = shared.value, {}
        for batch in batches:
            found = [own.predict(t, memory) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    named = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select(public_id().alias("doc_id"), held_out(public_id()).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose text is in some language, neither null nor without letters, with `lang` as predicted.

    All other columns stay as they are. A model of no language rejects nothing and leaves lang alone, as it cannot tell.
    """
    if not model.languages:
        return docs
    shared, at, to = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = shared.value, {}
        for batch in batches:
            named = [own.predict(t or "", memory)[0] for t in batch.column(at).to_pylist()]
            whole = batch.set_column(to, batch.schema.field(to), pa.array(named, batch.schema.field(to).type))
            yield whole.filter(pa.array([x != UNKNOWN for x in named], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
