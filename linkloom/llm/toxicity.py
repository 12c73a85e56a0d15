"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed and of a learned lexicon, how near second-person words
stand to insults, capitals, punctuation and obfuscation rates. The learned lexicon holds words and stems
(prefixes) that labelled toxic texts use far more than others, so languages that the fixed list
does not know are covered. Lexicon and trees are fitted on at most ``sample`` labelled rows; scores
are computed for all rows, batch by batch on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from linkloom.llm.words import slices, tidied
from linkloom.session import Scratch

# insults in four languages: a list of our own, of common words
INSULTS = frozenset(
    """
    idiot idiots moron morons stupid dumb dumbass imbecile loser losers scum trash garbage pathetic worthless disgusting clown clowns
    ugly fool jerk creep freak vermin filth filthy retard retarded bastard bitch asshole bullshit fuck fucking shit crap damn
    hate hateful kill die pig swine rat parasite coward liar
    imbécile crétin connard connasse salaud salope merde débile abruti ordure minable dégoûtant pourriture
    idiotin trottel dummkopf arschloch scheisse scheiße abschaum wertlos ekelhaft widerlich versager miststück
    idiota estúpido estúpida imbécil basura escoria patético asqueroso inútil cabrón gilipollas mierda perdedor
    """.split()
)
# second-person words of the four languages
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer usted ustedes tú ti tuyo".split())

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "+": "t"})
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’…"
_STEMS = range(4, 8)
_LEXICON, _LEARNED, _PERSON, _CAPS, _MASKED, _HIDDEN, _LONG, _MARK = (1 << i for i in range(8))
FEATURES = ["words", "lexicon_density", "lexicon_count", "learned_density", "learned_count", "near_person", "person_density", "capitals", "caps_words", "exclamations", "questions", "punctuation", "masked_density", "hidden_density", "hidden_count", "long_density", "marks_density", "hits_in_50"]


def units(word: str) -> list[str]:
    """What of a word may enter the learned lexicon: itself, and its stems (marked by a hyphen)."""
    return [word, *(word[:i] + "-" for i in _STEMS if len(word) > i)]


def bare(word: bytes) -> str:
    return word.decode().strip(_EDGE).lower()


class _WordFlags(dict):
    """What a word is, as bits; remembered for words met lately."""

    def __init__(self, learned: frozenset[str]):
        super().__init__()
        self.learned = learned

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        text = raw.decode()
        core = text.strip(_EDGE)
        word = core.lower()
        bits = 0
        if word in INSULTS:
            bits |= _LEXICON
        if word and not self.learned.isdisjoint(units(word)):
            bits |= _LEARNED
        if word in SECOND_PERSON:
            bits |= _PERSON
        if len(core) > 2 and core.isupper():
            bits |= _CAPS
        if not core.isalpha() and any(c.isalpha() for c in core) and re.search(r"[^\W\d_][\d@$!*#+.\-_]+[^\W\d_]", core):
            bits |= _MASKED
        if not bits & _LEXICON and word:
            plain = text.lower().strip(".,;:?\"'()").translate(_LEET)
            spelt = re.sub(r"[.\-_ ]", "", plain)
            once = re.sub(r"(.)\1+", r"\1", spelt)
            if spelt in INSULTS or once in INSULTS:
                bits |= _HIDDEN
        if re.search(r"(\w)\1{2,}", word):
            bits |= _LONG
        if len(text) > len(core) + 1:
            bits |= _MARK
        self[raw] = bits
        return bits


def features(text: str | None, flags: _WordFlags) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    bits = np.fromiter(map(flags.__getitem__, words), np.int64, n)
    count = lambda b: int(np.count_nonzero(bits & b))
    hits = np.flatnonzero(bits & (_LEXICON | _LEARNED | _HIDDEN))
    people = np.flatnonzero(bits & _PERSON)
    near = most = 0
    if len(hits):
        most = int((np.searchsorted(hits, hits + 50) - np.arange(len(hits))).max())
        if len(people):
            at = np.searchsorted(people, hits)
            gap = np.minimum(abs(people[np.minimum(at, len(people) - 1)] - hits), abs(people[np.maximum(at - 1, 0)] - hits))
            near = int((gap <= 5).sum())
    chars, per = max(1, len(data)), max(1, n)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b".,;:!?*&%$#@|-_()\"'"))
    return [
        np.log1p(n), count(_LEXICON) / per, np.log1p(count(_LEXICON)), count(_LEARNED) / per, np.log1p(count(_LEARNED)), near / per, len(people) / per,
        upper / chars, count(_CAPS) / per, data.count(b"!") / per, data.count(b"?") / per, marks / chars,
        count(_MASKED) / per, count(_HIDDEN) / per, np.log1p(count(_HIDDEN)), count(_LONG) / per, count(_MARK) / per, float(most),
    ]


@dataclass(frozen=True)
class Model:
    learned: frozenset[str]
    trees: Trees
    curve: Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.curve(self.trees.margin(x)), 0.0, 1.0)


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> partial document counts of units, in toxic texts and in others."""
    counts: dict[str, list[int]] = {}

    def flush():
        columns = counts.keys(), [c[1] for c in counts.values()], [c[0] for c in counts.values()]
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["unit", "yes", "no"])
        counts.clear()
        return out

    for batch in slices(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for u in {u for w in {bare(w) for w in (text or "").encode().split()} if w for u in units(w)}:
                if (c := counts.get(u)) is None:
                    c = counts[u] = [0, 0]
                c[toxic] += 1
            if len(counts) > 200_000:
                yield flush()
    yield flush()


def _features(learned: frozenset[str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _WordFlags(learned)
        for batch in slices(batches, "text"):
            x = [features(t, flags) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return run


def learn_lexicon(docs: DataFrame, positives: int, negatives: int, least: int = 6, z: float = 6.0, most: int = 2000) -> frozenset[str]:
    """Units of ``docs(text, toxic)`` whose share among toxic texts is ``z`` standard errors above that among the others, and three times it.

    All units of all texts are counted and compared; ``most`` is the lexicon's size, the strongest ones (ties by unit).
    """
    if not positives or not negatives:
        return frozenset()
    counted = docs.select("text", "toxic").mapInArrow(tidied(_unit_counts), "unit string, yes long, no long").groupBy("unit").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    share = (F.col("yes") + F.col("no")) / F.lit(positives + negatives)
    error = F.sqrt(share * (1 - share) * F.lit(1 / positives + 1 / negatives)) + F.lit(1e-9)
    strength = F.round((F.col("yes") / F.lit(positives) - F.col("no") / F.lit(negatives)) / error, 9)
    strong = counted.where((F.col("yes") >= least) & (strength >= z) & (F.col("yes") * negatives > F.col("no") * (3 * positives)))
    return frozenset(r["unit"] for r in strong.orderBy(F.desc(strength), "unit").select("unit").limit(most).collect())


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` of the labelled rows, chosen by a hash of the id.

    A fourth of them only calibrates: neither lexicon nor trees see it (with fewer than 40 rows all learn, and all
    calibrate). Rows with a null label or id, and ids with both labels, are not used; repeated labels count once, and
    each text of an id that several have is learnt from. Null and empty texts are texts without words. Without both classes, or
    with no rows, every text gets the same score. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("toxic"), F.max(label_col).alias("high"))
    one = one.where("toxic = high").select("id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("id", F.lit("toxicity")).alias("h"))
    chosen = scratch.table("labels", one.orderBy("h", "id").limit(sample))
    # at most ``sample`` short rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = scratch.table("texts", texts)
    total = texts.count()
    held = F.pmod("h", F.lit(4)) == 0 if total >= 40 else F.lit(False)
    # what calibrates has no part in the lexicon, nor in the trees
    learning = texts.where(~held)
    counts = {r["toxic"]: r["n"] for r in learning.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    learned = learn_lexicon(learning, counts.get(1, 0), counts.get(0, 0))
    rows = texts.select("text", "h", F.col("id").cast("string").alias("id"), "toxic").mapInArrow(tidied(_features(learned, ["h", "id", "toxic"])), "h long, id string, toxic int, x array<double>").toArrow()
    scratch.close()
    rows = rows.sort_by([("h", "ascending"), ("id", "ascending")])  # at most ``sample`` rows
    h, y = np.array(rows.column("h").to_pylist(), np.int64), np.array(rows.column("toxic").to_pylist(), np.float64)
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    held = (h % 4 == 0) if len(h) >= 40 else np.zeros(len(h), bool)
    trees = fit_trees(x[~held], y[~held])
    on = held if held.any() and 0 < y[held].sum() < held.sum() else np.ones(len(h), bool)
    return Model(learned, trees, fit_isotonic(trees.margin(x[on]), y[on]))


def _scores(model: Model, columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _WordFlags(model.learned)
        for batch in slices(batches, text):
            x = np.array([features(t, flags) for t in batch.column(text).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(model.scores(x))], [*columns, "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """-> the columns of ``docs`` (or those in ``keep``) and ``score`` (double, 0 to 1, higher: toxic likelier), for every row.

    A null or empty text is scored as a text without words; a very long one as a whole. A column ``score`` of ``docs`` is
    replaced; other columns, null ids and repeated rows come through as they are. An empty table has no scores.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    if text_col in columns:
        return docs.select(*columns).mapInArrow(tidied(_scores(model, columns, text_col)), f"{kinds}, score double")
    return docs.select(*columns, text_col).mapInArrow(tidied(_scores(model, columns, text_col)), f"{kinds}, score double")
