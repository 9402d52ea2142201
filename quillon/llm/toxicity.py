"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded texts, normalised by length."""

from __future__ import annotations

import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import lean, stash, table

# Terms that count before anything is learned, phrases that excuse a term, look-alikes.
SEED = "idiot moron stupid worthless pathetic scum loser trash clown disgusting imbecile cretin filth vermin".split()
SEED_WEIGHT = 3.0
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "class clown", "pathetic fallacy", "pond scum", "sore loser rule", "not stupid", "not an idiot"]
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝвмнткαεικνορτυχßıł", "aeopcyxijsdhlqwbmhtkaeiknoptuxsil"))
DIGITS = dict(zip("013457@$!", "oieastasi"))
MAX_POSITIVE, MAX_NEGATIVE = 5_000, 10_000  # documented bounds of the labelled rows that are learned from
MIN_DOCS, MIN_SUPPORT, MIN_WEIGHT, LENGTHS = 5, 22.0, 2.5, range(4, 9)
MAX_TERMS = 100_000  # terms by which a task narrows its contexts; with more of them it hands on those of all words


class Fold(dict):
    """Table for str.translate: look-alikes, diacritics and digit substitutions become plain letters, all but
    letters and digits a space."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = LOOKALIKES.get(c) or DIGITS.get(c)
        if out is None:
            out = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(DIGITS.get(x, x) if x.isalnum() else " " for x in out) or (" " if not unicodedata.combining(c) else "")
        self[point] = out
        return out


FOLD = Fold()


def fold(text: str) -> str:
    return f" {text.lower().translate(FOLD)} "


def features(text: str) -> set[str]:
    """Whole words, and beginnings of words, with their leading space."""
    out: set[str] = set()
    for w in set(fold(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in LENGTHS if n <= len(w))
    return out


def contexts(text: str, wanted: set[str] | None) -> set[tuple[str, str]]:
    """(term, word before it) for the terms in a text; all terms where none are named."""
    out, last = set(), ""
    for w in fold(text).split():
        for f in (f" {w} ", *(f" {w[:n]}" for n in LENGTHS if n <= len(w))):
            if wanted is None or f in wanted:
                out.add((f, last))
        last = w
    return out


class Model:
    def __init__(self, terms: dict[str, float], coef=(-4.0, 2.0, 1.0)):
        self.terms, self.coef = terms, np.asarray(coef, float)

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (0, len(t), w))
        for t in EXCEPTIONS:
            key = f" {fold(t).strip()} "
            a.add_word(key, (1, len(key), 0.0))
        a.make_automaton()
        return a

    @staticmethod
    def measures(folded: str, automaton) -> tuple[float, float]:
        """Weight of the matches outside exception phrases; the longest term at a place counts. And the weight
        normalised by length."""
        free, hits = [], {}
        for end, (kind, n, w) in automaton.iter(folded):
            if kind:
                free.append((end - n + 1, end))
            else:
                hits[end - n + 1] = max(w, hits.get(end - n + 1, 0.0))
        total, k, covered = 0.0, 0, -1
        free.sort()
        for s in sorted(hits):  # one sweep: `covered` is where the exceptions that begin up to here end
            while k < len(free) and free[k][0] <= s:
                covered = max(covered, free[k][1])
                k += 1
            if s >= covered:
                total += hits[s]
        return total, total / np.log2(16 + folded.count(" ")) if total else 0.0

    def probability(self, measured: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(measured)), np.log1p(measured[:, 0]), np.log1p(measured[:, 1])]
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -35, 35)))


def _logistic(measured: np.ndarray, y: np.ndarray, ridge=0.05, steps=30) -> np.ndarray:
    x = np.c_[np.ones(len(measured)), np.log1p(measured[:, 0]), np.log1p(measured[:, 1])]
    c = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        c += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * c), -5, 5)
    return c


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Learns the lexicon's weights and the length-normalised logistic curve from labelled rows.

    At most about MAX_POSITIVE and MAX_NEGATIVE rows, drawn by a hash of their ids; their ids are few enough
    to be broadcast. Terms are words and word beginnings that stand in toxic documents far more often than in
    others (log-likelihood ratio), behind different words (at least MIN_DOCS and the root of the number of toxic texts
    with the term, so that near copies of one text teach little); of nested ones the best supported stays. Equal texts of
    one label count once. Terms are weighed and sifted in tables; what comes to the driver is what passed. A seed that
    was not learned keeps its weight, unless MIN_DOCS other texts have it and it is no more frequent in toxic ones than
    MIN_WEIGHT says. Without labelled rows of both kinds the seed lexicon is used as it is. Rows with a null id, label
    or text teach nothing.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model({f" {t} ": SEED_WEIGHT for t in SEED})
    share = F.when(F.col("y") == 1, F.lit(min(1.0, MAX_POSITIVE / n[1]))).otherwise(F.lit(min(1.0, MAX_NEGATIVE / n[0])))
    drawn = known.where(F.expr(f"pmod(xxhash64(`{id_col}`), {1 << 20})") < share * (1 << 20))
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(drawn), id_col).select(text_col, "y").distinct()
    rows = stash(rows, "toxicity-rows")

    def count(batches):
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                got.update(features(t))
                got[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["term", "n"])

    by_label = [rows.where(F.col("y") == y).select(text_col).mapInArrow(lean(count), "term string, n long").groupBy("term").agg(F.sum("n").alias(f"n{y}")) for y in (0, 1)]
    both = stash(by_label[1].join(by_label[0], "term", "full").select("term", F.coalesce("n1", F.lit(0)).alias("a"), F.coalesce("n0", F.lit(0)).alias("b")), "toxicity-terms")
    t_all, c_all = both.where("term = ''").select("a", "b").first()
    weight = F.ln((F.col("a") + 0.5) / (t_all + 1)) - F.ln((F.col("b") + 0.5) / (c_all + 1))

    def part(k, n, x):
        return F.when(k > 0, k * F.ln(x)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - x)).otherwise(0.0)

    p, q, r = F.col("a") / t_all, F.col("b") / c_all, (F.col("a") + F.col("b")) / (t_all + c_all)
    ratio = 2 * (part(F.col("a"), F.lit(t_all), p) + part(F.col("b"), F.lit(c_all), q) - part(F.col("a"), F.lit(t_all), r) - part(F.col("b"), F.lit(c_all), r))
    scored = both.where((F.col("term") != "") & (F.col("a") >= MIN_DOCS) & (p > q)).select("term", "a", weight.alias("w"), ratio.alias("r"))
    scored = stash(scored.where((F.col("w") >= MIN_WEIGHT) & (F.col("r") >= MIN_SUPPORT)), "toxicity-scored")
    # near copies of one toxic document share all their words; a term must stand behind different words
    wanted = {x["term"] for x in scored.collect()} if scored.count() <= MAX_TERMS else None

    def pairs(batches):
        got = {x for b in batches for t in b.column(0).to_pylist() for x in contexts(t, wanted)}
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in got], pa.string()), pa.array([w for _, w in got], pa.string())], names=["term", "before"])

    places = rows.where("y = 1").select(text_col).mapInArrow(lean(pairs), "term string, before string").groupBy("term").agg(F.countDistinct("before").alias("places"))
    passed = scored.join(places, "term").where(F.col("places") >= F.greatest(F.lit(float(MIN_DOCS)), F.sqrt("a"))).collect()
    scored = [(-x["r"], -len(x["term"]), x["term"], x["w"]) for x in passed]
    seeds = {f" {t} " for t in SEED}
    harmless = {x["term"] for x in both.where(F.col("term").isin(sorted(seeds)) & (F.col("b") >= MIN_DOCS) & (weight < MIN_WEIGHT)).collect()}
    terms: dict[str, float] = {}
    taken: set[str] = set()
    for _, _, f, w in sorted(scored):
        stem = f.strip()
        if not any(stem[:n] in taken for n in range(1, len(stem) + 1)) and not any(x.startswith(stem) for x in taken):
            taken.add(stem)
            terms[f] = w
    for s in seeds - harmless:
        terms.setdefault(s, SEED_WEIGHT)
    model = Model(terms)

    def measure(batches):
        automaton = model.automaton()
        for b in batches:
            got = np.array([Model.measures(fold(t), automaton) for t in b.column(0).to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), b.column(1).cast(pa.int32())], names=["total", "dense", "y"])

    got = rows.mapInArrow(lean(measure), "total double, dense double, y int").toArrow()  # 15,000 rows of three numbers
    model.coef = _logistic(np.c_[got["total"].to_numpy(), got["dense"].to_numpy()], got["y"].to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Score of every whole text: id, score (0 to 1), weight (of the lexicon's matches).

    A null or empty text has the score of a text without matches. Rows are scored one by one, so null and
    repeated ids do not matter; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = shared.value.automaton()
        for b in batches:
            for a in range(0, b.num_rows, 256):
                texts = b.column(1).slice(a, 256).to_pylist()
                got = np.array([Model.measures(fold(t or ""), automaton) for t in texts], float).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 256), pa.array(shared.value.probability(got)), pa.array(got[:, 0])], names=[id_col, "score", "weight"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, score double, weight double")


def held_out(id_col="doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
