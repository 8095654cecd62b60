"""Toxicity by a weighted lexicon and Aho-Corasick matching (operator 3).

Texts are folded (compatibility forms, look-alike letters of other scripts, digit
and sign substitutions next to letters, ``l`` and ``i`` as one, marks as spaces) and
searched in one pass for all lexicon entries: whole words or word beginnings; texts
with accents in a second pass without them.  A word counts with the heaviest entry that it matches; a match inside an exception
phrase doesn't count.  The score is a logistic function of the summed weight, the
summed weight per word (length normalisation) and the heaviest single weight.

The lexicon is learned: entries of toxic training texts, weighted by the log of
the ratio of their document frequencies in toxic and in other texts; the logistic
function is fitted on training texts that the weights have not seen.  Fitting uses
at most ``MAX_FIT`` labelled rows, taken by a hash of the id (a bound of the fit, not of the scored
texts), and every entry that enough of their toxic texts hold.  Rows whose
crc32(id as text) is a multiple of 5 are never learned from.

Defined cases: null text counts as empty; an empty text has the score of no match;
rows with a null id are scored, not learned from; of several labels of one id the
largest counts, null labels are left out; without labels of both kinds the score
is the (smoothed) share of toxic rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm.common import map_batches, staged, text_or_empty

MAX_FIT = 20_000
SHORTEST, LONGEST_BEGINNING, LEAST_WEIGHT = 3, 8, 2.0
MIN_SUPPORT, SUPPORT_SHARE = 3, 0.003
#: Harmless phrases that hold words used as insults elsewhere.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "circus clown", "rodeo clown", "pond scum", "soap scum",
              "stupid question", "idiot proof", "sore loser", "loser bracket")
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("авеёикмнорстухѕіјԁԛԝһӏɑɡıοαβεικνρτυχωϲϳ", "abeeukmhopctyxsijdqwhlagioabeikvptuxwcj"))
#: Digits and signs written for letters.
SUBSTITUTES = str.maketrans("013457890@$!|", "oieastbgoasii")
_NEXT_TO_LETTER = re.compile(r"(?<=[^\W\d_])[01345789@$!|]+(?=[^\W\d_])|(?<![^\W_])[01345789@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[01345789]+(?![^\W_])")
_SIGNS = re.compile(r"[01345789@$!|]")
_MODELS: dict[int, tuple] = {}


class _Fold(dict):
    """Code point -> folded text, worked out at first use."""

    def __missing__(self, code):
        c = chr(code)
        if unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        else:
            out = "".join(LOOK_ALIKES.get(x, x) if x.isalnum() else " " for x in unicodedata.normalize("NFKC", c).lower())
            out = out.replace("l", "i")
        self[code] = out
        return out


class _Plain(dict):
    """Code point of a folded text -> its letter without accents (one letter for one), worked out at first use."""

    def __missing__(self, code):
        out = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(x) != "Mn")
        self[code] = LOOK_ALIKES.get(out, out).replace("l", "i") if len(out) == 1 else chr(code)
        return self[code]


_FOLD, _PLAIN = _Fold(), _Plain()


def fold(text: str) -> str:
    """Folded words with one space before and after each."""
    if not text.isascii():
        # mathematical and full-width forms first, so that substitutions see letters
        text = unicodedata.normalize("NFKC", text)
    if _SIGNS.search(text):
        text = _NEXT_TO_LETTER.sub(lambda m: m.group().translate(SUBSTITUTES), text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def _forms(folded: str) -> tuple[str, ...]:
    """The folded text and, where it has accents, the same without them (all places stay)."""
    plain = folded if folded.isascii() else folded.translate(_PLAIN)
    return (folded, plain) if plain != folded else (folded,)


def _entries(folded: str) -> set[str]:
    """Lexicon candidates of all forms: ``" word "`` and ``" beginning"``."""
    out = set()
    for w in {w for form in _forms(folded) for w in form.split()}:
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(" " + w[:k] for k in range(SHORTEST, min(LONGEST_BEGINNING + 1, len(w) + 1)))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict
    coef: tuple
    exceptions: tuple = EXCEPTIONS

    def automaton(self):
        import ahocorasick
        if id(self) not in _MODELS:
            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                a.add_word(e, (len(e), w))
            for e in self.exceptions:
                a.add_word(fold(e), (len(fold(e)), None))
            a.make_automaton()
            _MODELS.clear()
            _MODELS[id(self)] = (self, a)
        return _MODELS[id(self)][1]

    def features(self, folded: str) -> tuple[float, float, float]:
        heaviest, spared = {}, []
        for form in _forms(folded):
            for end, (n, w) in self.automaton().iter(form):
                start = end - n + 1
                if w is None:
                    spared.append((start, end))
                elif w > heaviest.get(start, 0.0):
                    heaviest[start] = w
        for a, b in spared:
            for s in [s for s in heaviest if a <= s < b]:
                del heaviest[s]
        total = sum(heaviest.values())
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(1000 * total / (words + 50)), max(heaviest.values(), default=0.0)

    def score(self, text: str) -> float:
        z = self.coef[-1] + sum(c * x for c, x in zip(self.coef, self.features(fold(text))))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: list, y: list, ridge: float = 0.1) -> tuple:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    import numpy as np
    x = np.column_stack([np.array(x, float).reshape(len(y), 3), np.ones(len(y))])
    y, w, penalty = np.array(y, float), np.zeros(4), np.diag([ridge] * 3 + [1e-6])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if 0 < y.sum() < len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            w += np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
    return tuple(map(float, w))


def _counted(rows: DataFrame, of) -> DataFrame:
    """``entry, n``: in how many texts each entry that ``of`` gives occurs."""
    def run(batches):
        import pyarrow as pa
        n: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                n.update(of(fold(x.as_py())))
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(n.values(), pa.int64())], names=["entry", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["entry", "n"])
    return map_batches(rows.select("text"), run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from the labelled rows outside the held-out fifth."""
    remainder = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
             .groupBy("id").agg(F.max("y").alias("y")).withColumn("fold", remainder).filter("fold <> 0"))
    n = known.count()
    if n > MAX_FIT:
        # 0.9: the sample's size varies a little around its mean
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(900_000 * MAX_FIT / n))
    sample = F.broadcast(known)                      # at most about MAX_FIT rows of three numbers
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
                  .join(sample, "id"), "toxicity-fit")
    toxic, other = (rows.filter(f"fold <> 4 and y {op} 0") for op in ("<>", "="))
    n_toxic, n_other = toxic.count(), other.count()
    least = max(MIN_SUPPORT, math.ceil(SUPPORT_SHARE * n_toxic))
    # texts of the sample times their entries over ``least`` bound this
    found = _counted(toxic, _entries).filter(F.col("n") >= least).collect()
    wanted = frozenset(r.entry for r in found)
    clean = {r.entry: r.n for r in _counted(other, lambda f: _entries(f) & wanted).collect()} if wanted else {}
    weights = {}
    for r in found:
        w = math.log((r.n + 0.5) / (n_toxic + 1)) - math.log((clean.get(r.entry, 0) + 0.5) / (n_other + 1))
        if w >= LEAST_WEIGHT:
            weights[r.entry] = w
    model = Model(weights, (0.0, 0.0, 0.0, 0.0))
    unseen = [(r.x, r.y) for r in _features(rows.filter("fold = 4"), model).collect()]
    if not any(y for _, y in unseen):
        unseen = [(r.x, r.y) for r in _features(rows, model).collect()]
    return Model(weights, _logistic([x for x, _ in unseen], [int(y != 0) for _, y in unseen]))


def _features(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = [list(model.features(fold(t.as_py()))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])
    return map_batches(rows.select("text", F.col("y").cast("int").alias("y")), run, "x array<double>, y int")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=["doc_id", "score"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return (map_batches(rows, run, "doc_id long, score double")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
