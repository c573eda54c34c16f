"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, accents and look-alike letters to plain ones, digits and signs that stand for
letters likewise (1 ! | and l all become i), other signs to blanks. The lexicon holds words and
word stems, learned from labelled documents: a term's weight is its smoothed log odds. How many toxic
documents must hold a term follows from the share of toxic ones among the labelled: as many as chance
would seldom bring together (``telling``). A stem stands for every word that begins with it. A hit inside an exception phrase (the word with the one
before or after it, seen in clean documents but not in toxic ones) does not count. The hits' weight
is divided by a slow function of length and mapped to 0..1 by a logistic curve fitted on the same
rows.

Learning takes at most ``fit_rows`` labelled documents, those of least id hash: a documented bound on
a classifier's sample, which also bounds the terms and phrases that reach the driver (words of
these documents). Everything else runs on all documents in one pass without a shuffle.

Special cases: null and empty texts have no hits. Without labels of both kinds nothing can be
learned and every score is 0. A document labelled twice counts as toxic if either label says so; one
whose id comes with several texts teaches once, by the least. Repeated rows are scored alike. Of
equally supported terms none is left out. Long texts are matched whole, in time linear in
their length. Columns of the input that are named like the result's give way to them; an empty table
has no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .base import crc_of_id, cut, lean_batches

#: Characters that are drawn like a plain letter, by that letter.
LOOKALIKES = {
    "a": "àáâãäåāăąαа@4ａ", "b": "вьｂ8", "c": "çćĉċčсｃ", "d": "ďđԁｄ", "e": "èéêëēĕėęěеєε3ｅ", "f": "ｆ", "g": "ĝğġģɡｇ", "h": "ĥħнһｈ",
    "i": "ìíîïĩīĭįıіιlł1!|ｉｌ", "j": "ĵјｊ", "k": "ķкκｋ", "m": "мｍ", "n": "ñńņňηｎ", "o": "òóôõöøōŏőоο0ｏ", "p": "рρｐ", "q": "ԛｑ",
    "r": "ŕŗřг", "s": "śŝşšѕ$5ｓ", "t": "ţťтτ7ｔ", "u": "ùúûüũūŭůűųυｕ", "v": "νѵｖ", "w": "ŵωｗ", "x": "хχｘ", "y": "ýÿŷуγｙ", "z": "źżžｚ2",
}
STEMS = (4, 5, 6, 7)


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = c if c.isalnum() else " "
        return out


def _table() -> _Fold:
    t = _Fold()
    for plain, many in LOOKALIKES.items():
        t.update({ord(c): plain for c in many})
    t[ord("ß")] = "ss"
    return t


_FOLD = _table()
#: Zero-width characters vanish rather than part a word.
_FOLD.update({c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})


def fold(text: str) -> list[str]:
    """Folded words; letters spelled out one by one are put together again."""
    words = text.lower().translate(_FOLD).split()
    if sum(1 for w in words if len(w) == 1) < 4:
        return words
    out: list[str] = []
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) >= 4 else run
        run = []
        if w:
            out.append(w)
    return out


class Lexicon:
    """Terms (words end with a blank, stems do not), exception phrases and the curve."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[tuple[str, str]] = frozenset(), curve: tuple[float, float] = (0.0, 0.0)):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve
        self._build()

    def __getstate__(self) -> tuple:
        return self.terms, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.exceptions, self.curve = state
        self._build()  # an automaton does not travel; each worker builds its own

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for t, w in self.terms.items():
            self.machine.add_word(f" {t}", (len(t) + 1, w))
        if self.terms:
            self.machine.make_automaton()

    def hits(self, words: list[str]):
        """(weight, word before, word, word after) of each hit word, its heaviest term counting."""
        if not self.terms or not words:
            return
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        for end, (n, w) in self.machine.iter(line):
            at = end - n + 1
            best[at] = max(w, best.get(at, 0.0))
        for at, w in best.items():
            a = line.rfind(" ", 0, at) + 1 if at else 0
            stop = line.index(" ", at + 1)
            after = line.find(" ", stop + 1)
            yield w, line[a:at].strip(), line[at + 1 : stop], line[stop + 1 : after] if after > 0 else ""

    def weight(self, text: str) -> float:
        """Weight of the hits outside exception phrases, by length."""
        words = fold(text)
        total = sum(w for w, a, word, b in self.hits(words) if (a, word) not in self.exceptions and (word, b) not in self.exceptions)
        return total / (1.0 + math.log1p(len(words) / 200)) if total else 0.0

    def score(self, text: str) -> float:
        a, b = self.curve
        if not self.terms:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * self.weight(text)))))


def _terms_of(batches):
    """Rows ``term, kin, clean``: each toxic document's words and stems with its kin, and how many clean ones of the batch hold a term.

    Near copies share their kin, the least hash of their words, most of the time; counting kin keeps
    words that only come along in many copies of one toxic document out of the lexicon.
    """
    for t in batches:
        clean: Counter = Counter()
        terms: list[str] = []
        kin: list[int] = []
        for text, toxic in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist(), strict=True):
            words = set(fold(text or ""))
            own = {f"{w} " for w in words if len(w) > 2} | {w[:s] for w in words for s in STEMS if len(w) > s}
            if toxic and words:
                terms += own
                kin += [min(xxhash.xxh64_intdigest(w) for w in words) >> 1] * len(own)
            elif not toxic:
                clean.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([*terms, *clean]), pa.array([*kin, *[None] * len(clean)], pa.int64()), pa.array([*[0] * len(terms), *clean.values()], pa.int64())], ["term", "kin", "clean"])


def telling(counts: dict[tuple[int, int], int], share: float, most_false: float = 0.1) -> set[tuple[int, int]]:
    """Pairs (documents, toxic ones) whose terms are met by chance in one case of ten at most.

    ``counts``: the number of terms by their documents and toxic documents. If labels fell on
    documents by chance, each toxic with probability ``share``, a binomial tail of the terms in n
    documents would be in t toxic ones or more; that many are set against those that are. Two toxic
    documents can be copies, so three are the least.
    """
    out = set()
    for n, t in counts:
        if t >= 3:
            tail = sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(t, n + 1))
            same = [(u, c) for (m, u), c in counts.items() if m == n]
            if tail * sum(c for _, c in same) <= most_false * sum(c for u, c in same if u >= t):
                out.add((n, t))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_rows: int = 8192, least_docs: int = 8, least_odds: float = 3.0) -> Lexicon:
    """A lexicon from labelled rows (default: crc32 of the id's text, modulo 5, is not 0).

    ``least_docs`` toxic documents are enough for a term in any sample; fewer where they are telling.
    """
    learn = crc_of_id() % 5 != 0 if learn is None else learn
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded: small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("toxic").alias("toxic"))
    rows = cut(rows.select("text", "toxic"))  # read four times; fit_rows texts at most
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    counted = rows.mapInArrow(lean_batches(_terms_of), "term string, kin long, clean long").groupBy("term").agg(F.count_distinct("kin").alias("t"), F.sum("clean").alias("c"))
    counted = cut(counted)  # read twice; a row a term of fit_rows texts
    few = counted.filter((F.col("t") < least_docs) & (F.col("t") + F.col("c") < 2 * least_docs)).groupBy((F.col("t") + F.col("c")).alias("n"), "t").count().collect()  # 2 * least_docs squared rows at most
    enough = F.col("t") >= least_docs
    for n, t in telling({(r["n"], r["t"]): r["count"] for r in few}, n1 / (n1 + n0)):
        enough |= (F.col("t") == t) & (F.col("c") == n - t)
    best = counted.withColumn("odds", odds).filter(enough & (F.col("odds") >= least_odds) & (F.col("t") > 2 * F.col("c"))).collect()
    held = {r["term"]: (r["odds"], r["t"]) for r in best}
    # A stem that stands for one longer term in nearly all its documents says no more than that term;
    # of the others, a longer term adds nothing where a stem of it is at least nearly as telling.
    single = {k[:n] for k, (_, t) in held.items() for n in STEMS if n < len(k) and t >= 0.9 * held.get(k[:n], (0, 1 << 60))[1]}
    kept = {k: w for k, (w, _) in held.items() if k not in single}
    terms = {k: w for k, w in kept.items() if not any(kept.get(k[:n], 0.0) >= 0.9 * w for n in STEMS if n < len(k))}
    lexicon = Lexicon(terms)

    def contexts(batches):
        for t in batches:
            n: Counter = Counter()
            for text, toxic in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist(), strict=True):
                for _, a, word, b in lexicon.hits(fold(text or "")):
                    n.update({(p, q, toxic): 1 for p, q in ((a, word), (word, b)) if p and q})
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(n.values()), pa.int64())], ["a", "b", "toxic", "n"])

    phrases = rows.mapInArrow(contexts, "a string, b string, toxic int, n long").groupBy("a", "b").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("toxic"))
    phrases = phrases.filter("clean >= 3 AND toxic IS NULL").collect()
    lexicon = Lexicon(terms, frozenset((r["a"], r["b"]) for r in phrases))

    def weigh(batches):
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.weight(x or "") for x in t.column("text").to_pylist()], pa.float64()), t.column("toxic")], ["x", "toxic"])

    points = rows.mapInArrow(weigh, "x double, toxic int").collect()  # fit_rows pairs at most
    return Lexicon(terms, lexicon.exceptions, _logistic(np.array([p["x"] for p in points]), np.array([p["toxic"] for p in points], float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a light penalty, so that separable rows settle."""
    hit = x[x > 0]
    scale = float(np.quantile(hit, 0.1)) if len(hit) else 1.0  # light hits must count too
    z = np.stack([np.ones(len(x)), x / scale], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-3]), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]) / scale, 0.0)


def score(docs: DataFrame, lexicon: Lexicon, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from 0.5 on); one pass, no shuffle.

    Columns of ``docs`` that have one of ``names`` are replaced.
    """
    taken = {n.lower() for n in names}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])

    def run(batches):
        for t in batches:
            s = [lexicon.score(x or "") for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*t.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return docs.mapInArrow(lean_batches(run), schema)
