"""Repetition inside single documents, measured by rolling hashes of word n-grams and by equal lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import spread, stash

#: Lengths in words of the runs that are measured; the run of eight decides about phrases.
RUNS = (4, 8, 16)
PHRASE = 8

#: Bodies of fewer words never count.
LEAST_WORDS = 30

#: Stands where a sentence ends while a text is brought to its norm; it is no letter.
_CUT = "\x01"
_OTHER = regex.compile(rf"[^\p{{L}}\n{_CUT}]+")
_OTHER_ASCII = re.compile(rf"[^a-z\n{_CUT}]+")
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s)")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def norms(text: str) -> tuple[list[str], list[str], list[str]]:
    """The norms of the lines and of the sentences of a text, and its words.

    A norm has lower-case letters, each run of other signs one blank, ends trimmed. The
    signs are read once; lines and sentences are cut from what is left.
    """
    lower = _SENTENCE.sub(_CUT, text.replace(_CUT, " ")).lower()
    bare = (_OTHER_ASCII if lower.isascii() else _OTHER).sub(" ", lower)
    flat = bare.replace(_CUT, " ")
    sentences = bare.replace("\n", " ").split(_CUT)
    return [" ".join(x.split()) for x in flat.split("\n")], [" ".join(x.split()) for x in sentences], flat.split()


def norm(text: str) -> str:
    """Lower-case letters, each run of other signs one blank, ends trimmed."""
    return " ".join(norms(text)[2])


def _recurring(codes: np.ndarray, rolling: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some places in order: those whose run equals that of an earlier one, and all whose run is there more than once."""
    none = np.zeros(0, dtype=np.int64)
    if len(places) < 2:
        return none, none
    hashes = rolling[places]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return none, none
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    later, earlier = places[order[1:][same]], places[order[first[1:][same]]]
    windows = np.lib.stride_tricks.sliding_window_view(codes, length)
    if not (windows[later] == windows[earlier]).all():
        # runs of one hash that differ: told apart by what they are
        seen: dict[bytes, int] = {}
        pairs = [(i, seen.setdefault(windows[i].tobytes(), i)) for i in places.tolist()]
        later, earlier = (np.array(x, dtype=np.int64) for x in zip(*[(i, e) for i, e in pairs if i != e] or [((), ())])) if any(i != e for i, e in pairs) else (none, none)
    return np.sort(later), np.union1d(later, earlier)


def repeated_starts(codes: np.ndarray, lengths: tuple[int, ...] = RUNS) -> dict[int, np.ndarray]:
    """For each length, the positions of which the run of so many codes equals a run that began earlier.

    Lengths are doublings of the first. A hash of a run of 2n is made from those of its
    halves, and only places of which both halves are there more than once can be there
    more than once themselves, so longer runs are looked at in few places.
    """
    found, length = {}, lengths[0]
    n = max(0, len(codes) - length + 1)
    rolling, power = np.zeros(n, dtype=np.uint64), _BASE
    for j in range(length):
        rolling = rolling * _BASE + codes[j : j + n].astype(np.uint64)
    for _ in range(length - 1):
        power = power * _BASE
    places = np.arange(n)
    while True:
        found[length], twice = _recurring(codes, rolling, places, length)
        if length >= lengths[-1]:
            return {k: found[k] for k in lengths}
        n = max(0, len(codes) - 2 * length + 1)
        rolling = rolling[:n] * power + rolling[length : length + n] if n else np.zeros(0, dtype=np.uint64)
        power = power * power
        places = np.intersect1d(twice, twice - length, assume_unique=True)
        length *= 2


def covered(codes: np.ndarray, starts: np.ndarray, length: int) -> int:
    """How many positions lie in a run of ``length`` codes that begins at one of ``starts``."""
    if not len(starts):
        return 0
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + length, 1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_length(parts: list[str]) -> tuple[int, int]:
    """The characters of norms that an earlier one equals, and of all norms."""
    total, once = sum(map(len, parts)), sum(map(len, set(parts)))
    return total - once, total


MEASURES = "n_words bigint, line_repeated bigint, line_total bigint, sentence_repeated bigint, sentence_total bigint, " + ", ".join(f"covered_{n} bigint" for n in RUNS)


def measure(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text; covered_n counts words."""
    lines, sentences, words = norms(text)
    coded = pa.array(words, type=pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = repeated_starts(coded)
    return (len(words), *repeated_length(lines), *repeated_length(sentences), *(covered(coded, starts[n], n) for n in RUNS))


def measure_bodies(bodies: DataFrame, key: str = "body_id", text: str = "body") -> DataFrame:
    """``key`` and ``MEASURES`` of each row, in one pass without a shuffle.

    Null texts count as empty ones, rows without a key are left out. Repeated rows give
    repeated results. Texts are taken whole; memory is in proportion to the longest text.
    A word is what stands between signs that are no letters, so in scripts written
    without blanks a sentence is one word: there lines and sentences tell, not phrases.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *[m.split()[0] for m in MEASURES.split(", ")]]
        for frame in frames:
            yield pd.DataFrame([(k, *measure(t or "")) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1])], columns=names)

    kind = dict(bodies.dtypes)[key]
    return spread(bodies.where(F.col(key).isNotNull()).select(F.col(key), F.col(text))).mapInPandas(run, f"`{key}` {kind}, {MEASURES}")


def repetition_shares(bodies: DataFrame) -> DataFrame:
    """The shares of repeated content of each body, between 0 and 1; 0 for empty ones."""

    def share(part: str, whole: str):
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    shares = [share("line_repeated", "line_total").alias("line_share"), share("sentence_repeated", "sentence_total").alias("sentence_share")]
    shares += [share(f"covered_{n}", "n_words").alias(f"phrase_share_{n}") for n in RUNS]
    return measure_bodies(bodies).select("body_id", "n_words", *shares).distinct()


def repetition_cases(bodies: DataFrame, sections: DataFrame) -> DataFrame:
    """``body_id, repeat_unit``: what each body repeats: line, sentence, phrase or title.

    A line or sentence case repeats a quarter of the characters, a phrase case has three
    tenths of its words in repeated runs of eight, a title case at least three sections
    of which a quarter has the title of an earlier one. Titles that are null equal none.
    Sections are counted per title first, so a body with very many isn't one task's work.
    Bodies are measured once; the measures, a few numbers per body, are written and read
    by both halves.
    """
    measured = stash(measure_bodies(bodies).where(F.col("n_words") >= LEAST_WORDS))
    unit = F.array_compact(
        F.array(
            F.when((F.col("line_total") > 0) & (4 * F.col("line_repeated") >= F.col("line_total")), "line"),
            F.when((F.col("sentence_total") > 0) & (4 * F.col("sentence_repeated") >= F.col("sentence_total")), "sentence"),
            F.when(10 * F.col(f"covered_{PHRASE}") >= 3 * F.col("n_words"), "phrase"),
        )
    )
    own = measured.select("body_id", F.explode(unit).alias("repeat_unit")).distinct()
    said = F.trim(F.regexp_replace(F.lower("title"), r"\P{L}+", " "))
    titles = (
        sections.where("body_id is not null")
        .select("body_id", "ord", said.alias("said"))
        .distinct()
        .groupBy("body_id", "said")
        .agg(F.count("*").alias("n"))
        .groupBy("body_id")
        .agg(F.sum("n").alias("sections"), F.sum(F.when(F.col("said").isNotNull(), F.col("n") - 1).otherwise(0)).alias("again"))
        .where("sections >= 3 and 4 * again >= sections")
    )
    title = titles.join(measured.select("body_id").distinct(), "body_id", "left_semi").select("body_id", F.lit("title").alias("repeat_unit"))
    return own.unionByName(title)
