"""Quality and toxicity scores by co-training on two views of a document.

One view is the text (how it is written, and which telling words it has), the other the
metadata (language, source, length).  Each view has a logistic classifier.  In every
round each classifier labels all unlabelled documents, and those it is
sure of go to the *other* view's training rows.  A view may only teach while its
confident guesses are right on held-out labels.  At the end each view's logit is
calibrated and both are combined by a small logistic model fitted on the held-out rows,
and every document is scored.

Labelled documents are a bounded sample: ``LABELLED`` of them, chosen by a hash of the id, whole texts each.  Everything else covers all
documents: their features are written once, about a hundred bytes each, and in every round executors sum what the confident ones add to the gradient and
the curvature of the other view's classifier, so that the driver takes one step of Newton's from sums, however many they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Workspace, partitions

#: Labelled documents that classifiers are fitted on, at most.
LABELLED = 8000
ROUNDS = 4
#: Probability from which a guess is handed to the other view.
SURE = 0.97
#: Telling words of a head, at most, and the z-score that they need.
WORDS, TELLING = 128, 6.0
SOURCES = 32
HEADS = ("quality", "toxic")
_APART = re.compile(r"[\W\d_]+")
#: Marks of ordinary prose, numbers and addresses; other printable ASCII marks count as noise.
_PLAIN = b" \t\r\n.,;:'\"-()+@=/_"
_NOT_NOISE = bytes(c for c in range(256) if not 32 < c < 127 or chr(c).isalnum() or c in _PLAIN)
N_STYLE = 10


def text_words(text: str) -> list[str]:
    return _APART.sub(" ", text.lower()).split()


def style(text: str, words: list[str]) -> list[float]:
    """How a text is written, whatever its language."""
    chars, tokens = max(1, len(text)), text.split()
    n = max(1, len(tokens))
    noise, distinct = len(text.encode().translate(None, _NOT_NOISE)), len(set(words))
    upper = sum(map(str.isupper, tokens))
    repeats = sum(map(str.__eq__, tokens, tokens[1:]))
    lines = text.split("\n")
    return [
        noise / chars, upper / n, repeats / n, distinct / max(1, len(words)), distinct / max(1.0, len(words)) ** 0.7,
        sum(map(len, tokens)) / n / 10, np.log1p(n) / 10, 1 - len(set(lines)) / len(lines), text.count("|") / n, text.count("!") / n,
    ]


@dataclass
class Logistic:
    """Ridge logistic regression, by Newton's steps on standardised columns."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of the columns, and the bias
    penalty: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
        scale = x.std(0)
        self.mean, self.scale = x.mean(0), np.where(scale < 1e-6, np.inf, scale)
        self.w, self.penalty = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-3)
        for _ in range(steps):
            if self.step([(1.0, *self.sums(x, y))]) < 1e-4:
                break
        return self

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """What rows add to the gradient and the curvature; sums over parts of the rows add up."""
        a = self.standard(x)
        p = sigmoid(a @ self.w)
        return a.T @ (p - y), (a * (p * (1 - p) + 1e-6)[:, None]).T @ a

    def step(self, parts: list[tuple[float, np.ndarray, np.ndarray]]) -> float:
        """One of Newton's steps from weighted sums; returns how far it went."""
        g = sum(k * g for k, g, _ in parts) + self.penalty * self.w
        h = sum(k * h for k, _, h in parts) + np.diag(self.penalty)
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        self.w = self.w - step
        return float(np.abs(step).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    words: dict[str, int]
    heads: dict[str, dict]  # by head: a prior, or the views and how they combine
    report: dict = field(default_factory=dict)

    def packed(self, texts: list[str | None], langs: list, sources: list, lengths: list) -> list[bytes]:
        """Both views of documents in few bytes: style, a bit for each telling word, and the metadata's buckets and size."""
        x = self.text_view(texts)
        m = self.metadata_view(langs, sources, lengths)
        style_, words = x[:, :N_STYLE].astype("<f4"), np.packbits(x[:, N_STYLE:] > 0, axis=1)
        buckets = np.stack([m[:, :16].argmax(1), m[:, 16 : 16 + SOURCES].argmax(1)], 1).astype(np.uint8)
        size = m[:, -2].astype("<f4")
        return [a.tobytes() + b.tobytes() + c.tobytes() + d.tobytes() for a, b, c, d in zip(style_, words, buckets, size, strict=True)]

    def views(self, packed: list[bytes]) -> dict[str, np.ndarray]:
        """The views of packed documents."""
        n, bits = len(self.words), -(-len(self.words) // 8)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), N_STYLE * 4 + bits + 6)
        style_ = np.ascontiguousarray(raw[:, : N_STYLE * 4]).view("<f4")
        words = np.unpackbits(np.ascontiguousarray(raw[:, N_STYLE * 4 : N_STYLE * 4 + bits]), axis=1)[:, :n]
        size = np.ascontiguousarray(raw[:, -4:]).view("<f4")[:, 0].astype(float)
        m = np.zeros((len(packed), 16 + SOURCES + 2))
        rows = np.arange(len(packed))
        m[rows, raw[:, -6]] = 1
        m[rows, 16 + raw[:, -5].astype(int)] = 1
        m[:, -2], m[:, -1] = size, size**2 / 10
        return {"text": np.hstack([style_, words]).astype(float), "metadata": m}

    def text_view(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), N_STYLE + len(self.words)))
        for row, text in zip(x, texts, strict=True):
            words = text_words(text or "")
            row[:N_STYLE] = style(text or "", words)
            for w in self.words.keys() & set(words):
                row[N_STYLE + self.words[w]] = 1
        return x

    @staticmethod
    def metadata_view(langs: list, sources: list, lengths: list) -> np.ndarray:
        x = np.zeros((len(langs), 16 + SOURCES + 2))
        for row, lang, source, n in zip(x, langs, sources, lengths, strict=True):
            row[_bucket(str(lang), 16)] = 1
            row[16 + _bucket(str(source), SOURCES)] = 1
            size = float(n) if n is not None and n == n else 0.0
            row[-2:] = np.log1p(max(0.0, size)), np.log1p(max(0.0, size)) ** 2 / 10
        return x

    def probability(self, head: str, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        parts = self.heads[head]
        if "prior" in parts:
            return np.full(len(text), parts["prior"])
        return sigmoid(parts["both"].logit(np.column_stack([parts["text"].logit(text), parts["metadata"].logit(metadata)])))


def _bucket(value: str, n: int) -> int:
    out = 0
    for c in value.encode():
        out = (out * 131 + c) % 1_000_003
    return out % n


@dataclass
class Teacher:
    """A view that labels documents for the other one: its classifier, how its logit is calibrated, and which labels it may teach."""

    model: Logistic
    calibration: Logistic
    labels: tuple[int, ...]

    def sure(self, x: np.ndarray) -> dict[int, np.ndarray]:
        p = sigmoid(self.calibration.logit(self.model.logit(x)[:, None]))
        return {label: (p if label else 1 - p) >= SURE for label in self.labels}


#: (view taught, label) to the number of documents, and what they add to the view's gradient and curvature.
Sums = dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]]
VIEWS = ("text", "metadata")


def taught(views: dict[str, np.ndarray], teachers: dict[str, Teacher]) -> Sums:
    """What rows that the views are sure of add to each other."""
    out: Sums = {}
    for k, other in (VIEWS, VIEWS[::-1]):
        for label, sure in teachers[k].sure(views[k]).items():
            if sure.any():
                out[other, label] = (int(sure.sum()), *teachers[other].model.sums(views[other][sure], float(label)))
    return out


def co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, held: np.ndarray, pool: Callable[[dict[str, Teacher]], Sums], rounds: int = ROUNDS) -> dict:
    """One head.  y is 0 or 1; held marks rows kept for calibration; pool sums over the unlabelled documents what each view teaches the other."""
    views = dict(zip(VIEWS, (text, metadata), strict=True))
    own = ~held
    fitted = {k: Logistic().fit(x[own], y[own]) for k, x in views.items()}
    counts = []
    for _ in range(rounds):
        teachers = {}
        for k, x in views.items():
            calibration = Logistic().fit(fitted[k].logit(x[held])[:, None], y[held], ridge=0.1)
            teacher = Teacher(fitted[k], calibration, (1, 0))
            right = {label: y[held][sure] == label for label, sure in teacher.sure(x[held]).items()}
            # Others would teach mistakes.
            teachers[k] = Teacher(fitted[k], calibration, tuple(v for v, r in right.items() if len(r) >= 20 and r.mean() >= SURE))
        sums = pool(teachers) if any(t.labels for t in teachers.values()) else {}
        counts.append(sum(n for n, *_ in sums.values()))
        for k, x in views.items():
            parts = [(1.0, *fitted[k].sums(x[own], y[own]))]
            for label in (0, 1):
                if (k, label) in sums:
                    n, g, h = sums[k, label]
                    # Guesses together weigh no more than the labels of their class that are known.
                    parts.append((min(1.0, max(1, (y[own] == label).sum()) / n), g, h))
            fitted[k].step(parts)
    both = np.column_stack([fitted[k].logit(x[held]) for k, x in views.items()])
    return fitted | {"both": Logistic().fit(both, y[held], ridge=0.1), "exchanged": counts}


def _telling(work: Workspace, sample: DataFrame) -> list[str]:
    """Words whose presence tells a head's classes apart, by z-score over the sampled labelled documents."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def distinct(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(set(text_words(t or ""))))

    rows = sample.where("quality is not null or toxic is not null")
    counts = rows.select(F.explode(distinct("text")).alias("word"), *HEADS).groupBy("word").agg(
        *[F.sum((F.col(h) == v).cast("long")).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]
    )
    counts = work.table(counts, "words")
    totals = rows.agg(*[F.sum((F.col(h) == v).cast("long")).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]).first()
    found: list[str] = []
    for h in HEADS:
        n0, n1 = totals[f"{h}0"] or 0, totals[f"{h}1"] or 0
        if not n0 or not n1:
            continue
        a, b = F.coalesce(F.col(f"{h}0"), F.lit(0)), F.coalesce(F.col(f"{h}1"), F.lit(0))
        mean = (a + b) / (n0 + n1)
        z = F.abs(b / n1 - a / n0) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-9)) * (1 / n0 + 1 / n1))
        top = counts.select("word", z.alias("z")).where(F.col("z") >= TELLING).orderBy(F.desc("z"), "word").limit(WORDS)
        found += [r["word"] for r in top.collect()]  # at most WORDS rows
    return list(dict.fromkeys(found))


def _views(batch: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    return model.views(batch.column(0).to_pylist())


_SUMS = "view string, label int, n long, data binary"


def _sum_batch(sums: Sums) -> pa.RecordBatch:
    rows = [(v, label, n, np.concatenate([g, h.ravel()]).tobytes()) for (v, label), (n, g, h) in sums.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["view", "label", "n", "data"])


def _read_sums(rows: Iterator[tuple]) -> Sums:
    out: Sums = {}
    for view, label, n, data in rows:
        flat = np.frombuffer(data)
        d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)  # d + d * d numbers
        g, h = flat[:d], flat[d:].reshape(d, d)
        before = out.get((view, label))
        out[view, label] = (n, g.copy(), h.copy()) if before is None else (before[0] + n, before[1] + g, before[2] + h)
    return out


def _pool_sums(pool: DataFrame, model: Model) -> Callable[[dict[str, Teacher]], Sums]:
    """Sums over the packed rows of a table, in a tree of two levels: each task adds up what it holds."""

    def run(teachers: dict[str, Teacher]) -> Sums:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((v, label, n, np.concatenate([g, h.ravel()]).tobytes()) for b in batches for at in range(0, b.num_rows, 4096) for (v, label), (n, g, h) in taught(_views(b.slice(at, 4096), model), teachers).items())
            yield _sum_batch(_read_sums(rows))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _sum_batch(_read_sums(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))

        parts = pool.mapInArrow(part, _SUMS)
        wide = max(1, int(partitions(pool.sparkSession) ** 0.5))
        top = parts.repartition(wide).mapInArrow(add, _SUMS).repartition(1).mapInArrow(add, _SUMS)
        return _read_sums(map(tuple, top.collect()))  # four rows

    return run


def _fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str, text: str, metadata: tuple[str, str, str], labelled: int, rounds: int
) -> tuple[Model, DataFrame]:
    """The model, and every document's packed views (doc_id, x)."""
    work = Workspace(spark, "quality")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(metadata, ("lang", "source", "n"), strict=True)])
    known = work.table(labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(*[F.max(h).cast("int").alias(h) for h in HEADS]), "known")
    chosen = work.table(known.orderBy(F.xxhash64("doc_id", F.lit("co-training")), "doc_id").limit(labelled), "chosen")
    # Broadcast: at most ``labelled`` rows of a few bytes.  Of rows that share an id, the least is taken, whatever their order.
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *HEADS).agg(F.min("text").alias("text"))
    model = Model({w: k for k, w in enumerate(_telling(work, work.table(texts, "sample")))}, {})

    @F.pandas_udf(T.BinaryType())
    def packed(t: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(t), 1000):
            cut = slice(at, at + 1000)
            out += model.packed(list(t[cut]), list(lang[cut]), list(source[cut]), list(n[cut]))
        return pd.Series(out, dtype=object)

    features = work.table(rows.select("doc_id", packed("text", "lang", "source", "n").alias("x")), "features")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(10)) < 3
    got = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *HEADS).agg(F.min("x").alias("x")).withColumn("held", held).toPandas().sort_values("doc_id", kind="stable")
    views, kept = model.views(list(got["x"])), got["held"].to_numpy().astype(bool)
    pool = work.table(features.where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti").select("x"), "pool")
    for h in HEADS:
        y = got[h].fillna(-1).to_numpy().astype(int)
        if min([((y == v) & m).sum() for m in (kept, ~kept) for v in (0, 1)], default=0) < 8:
            model.heads[h] = {"prior": float(y[y >= 0].mean()) if (y >= 0).any() else 0.5}
            continue
        of = y >= 0
        model.heads[h] = co_train(*(views[k][of] for k in VIEWS), y[of], kept[of], _pool_sums(pool, model), rounds)
        right = (model.probability(h, *(views[k][of & kept] for k in VIEWS)) >= 0.5) == (y[of & kept] == 1)
        model.report[h] = {"calibration_accuracy": float(right.mean()), "exchanged": model.heads[h].pop("exchanged")}
    work.drop("pool")
    return model, features


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, str, str] = ("lang", "source", "n_chars"),
    labelled: int = LABELLED, rounds: int = ROUNDS,
) -> Model:
    """The model.  A head with fewer than 8 sampled labels (for fitting or for calibration) of either class is its share of ones (one half without labels)."""
    return _fit(spark, docs, labels, doc_id, text, metadata, labelled, rounds)[0]


_SCORE = T.StructType([T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])


def scorer(model: Model):
    """A function of columns (text, lang, source, length) to a struct of p_quality and p_toxic."""

    @F.pandas_udf(_SCORE)
    def score(t: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(t), 1000):
            cut = slice(at, at + 1000)
            out.append(_scored(model, model.packed(list(t[cut]), list(lang[cut]), list(source[cut]), list(n[cut]))))
        return pd.concat(out) if out else pd.DataFrame({f"p_{h}": [] for h in HEADS}, dtype=float)

    return score


def _scored(model: Model, packed: list[bytes]) -> pd.DataFrame:
    views = model.views(packed)
    return pd.DataFrame({f"p_{h}": model.probability(h, *(views[k] for k in VIEWS)) for h in HEADS})


def accepted(score: Column) -> Column:
    """Whether a scored document stays: of good quality, and not toxic; one without words is judged like any other."""
    return (score["p_quality"] >= 0.5) & (score["p_toxic"] < 0.5)


def score_documents(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, str, str] = ("lang", "source", "n_chars")
) -> DataFrame:
    """One row per document: doc_id, p_quality, p_toxic, accepted.

    Null texts count as empty, null metadata as a value of its own; rows with a null id are scored too
    but never used to fit, and repeated rows get equal scores.  Repeated labels of a document count once, the
    largest wins.  Other columns are left out; an empty table gives no rows.
    """
    model, features = _fit(spark, docs, labels, doc_id, text, metadata, LABELLED, ROUNDS)

    @F.pandas_udf(_SCORE)
    def score(x: pd.Series) -> pd.DataFrame:
        return _scored(model, list(x))

    rows = features.select("doc_id", score("x").alias("s"))
    return rows.select("doc_id", "s.p_quality", "s.p_toxic", accepted(F.col("s")).alias("accepted"))
