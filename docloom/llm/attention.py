"""Quality scores by attention-based multiple-instance learning.

A label says something of a document, while what earns it may stand in a few lines of many. So a document is a
bag of passages of ``PASSAGE_WORDS`` words. Each passage is encoded: how often which kinds of characters follow
each other, its words by hash, and how many of them repeat, through one learned layer. Gated attention gives
every passage a weight, the weights of a document sum to one, and a logistic model judges the weighted mean of
its passages. Encoder, attention and judgement are learned together from document labels, by gradient steps
over bags (Ilse, Tomczak and Welling 2018).

Only fitting is bounded: about ``TRAIN_ROWS`` labelled documents, chosen by a hash of their ids, of at most
``BAG_PASSAGES`` passages each and ``TRAIN_PASSAGES`` in all; these go to the driver as counts of one byte.
Scoring is one narrow pass over all texts, whole: a long text is read in parts of ``PART_BYTES`` cut at blanks,
and its passages' weights are summed as they come, so a task holds one part's passages at a time.

Null texts and texts without words have no passages; their mean is zero, and what labels say of such texts is
the bias. Null labels teach nothing, of repeated labels for one id the largest counts, of several texts under one
id one is learned from. Without labels the score is 0.5, with labels of one kind their share. Ids may be null or
repeated when scored; other columns are carried along, but for one of the result's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shingles import mix, word_hashes
from docloom.llm.tables import stored

PASSAGE_WORDS = 40
TRAIN_ROWS, TRAIN_PASSAGES, BAG_PASSAGES = 8_000, 60_000, 2_000
THRESHOLD = 0.5
PART_BYTES = 1 << 20
#: Widths of the encoding and of the attention.
HIDDEN, GATES = 32, 16
EPOCHS, BAGS_AT_ONCE, RATE, DECAY = 12, 32, 3e-3, 1e-4
#: Of few bags there are more epochs, to come to as many steps.
LEAST_STEPS = 1500

KINDS, BUCKETS = 16, 256
#: Counts of a passage: pairs of kinds, words by bucket, words equal to the one before, words of repeated triples.
COUNTS = KINDS * KINDS + BUCKETS + 2


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, 12, "i4")  # other signs
    for number, members in enumerate(
        ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\x0b\x0c\r", ".", ",", ";:?", "!", "|", "#$%&*", "\"'()[]{}-_")
    ):
        kind[[ord(c) for c in members]] = number
    kind[[c for c in range(32) if chr(c) not in "\t\n\x0b\x0c\r"]] = 13
    kind[127] = 13
    kind[128:192] = 14  # within a character
    kind[192:] = 15
    return kind


_KIND = _kinds()
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _parts(text: str | None) -> Iterator[bytes]:
    data, begin = (text or "").encode("utf-8", "surrogatepass"), 0
    while len(data) - begin > PART_BYTES:
        end = data.find(b" ", begin + PART_BYTES)
        if end < 0:
            break
        yield data[begin:end]
        begin = end
    yield data[begin:]


def passage_counts(text: str | None) -> Iterator[np.ndarray]:
    """Counts of the passages of each part of a text, up to 255: a row for each passage."""
    for part in _parts(text):
        data = np.frombuffer(part, "u1")
        words = word_hashes(part.decode("utf-8", "surrogatepass"))
        if not len(words):
            continue
        inside = ~_BLANK[data]
        begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        n = -(-len(words) // PASSAGE_WORDS)
        of_word = np.arange(len(words)) // PASSAGE_WORDS
        of_byte = np.zeros(len(data), "i8")
        of_byte[begins[PASSAGE_WORDS::PASSAGE_WORDS]] = 1
        of_byte = np.cumsum(of_byte)
        kind = _KIND[data]
        pairs = of_byte[1:] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        again = np.concatenate(([False], words[1:] == words[:-1]))
        repeated = np.zeros(len(words), bool)
        if len(words) > 2:
            with np.errstate(over="ignore"):
                triples = mix(words[:-2] * np.uint64(3) + mix(words[1:-1] * np.uint64(5) + words[2:]))
            order = np.argsort(triples)
            same = triples[order[1:]] == triples[order[:-1]]
            repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        counts = np.concatenate(
            [
                np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(n, -1),
                np.bincount(of_word * BUCKETS + (words % np.uint64(BUCKETS)).astype("i8"), minlength=n * BUCKETS).reshape(n, -1),
                np.bincount(of_word[again], minlength=n)[:, None],
                np.bincount(of_word[repeated], minlength=n)[:, None],
            ],
            axis=1,
        )
        yield np.minimum(counts, 255).astype("u1")


def inputs(counts: np.ndarray) -> np.ndarray:
    """Counts as roots of shares."""
    x = counts.astype("f4")
    pairs, words = x[:, : KINDS * KINDS], x[:, KINDS * KINDS :]
    pairs /= np.maximum(pairs.sum(1, keepdims=True), 1)
    words /= np.maximum(words[:, :BUCKETS].sum(1, keepdims=True), 1)
    return np.sqrt(x)


#: Names and shapes of what is learned: encoder, attention with its gate, judgement.
SHAPES = {
    "encode": (COUNTS, HIDDEN),
    "shift": (HIDDEN,),
    "look": (HIDDEN, GATES),
    "gate": (HIDDEN, GATES),
    "attend": (GATES,),
    "judge": (HIDDEN,),
    "bias": (1,),
}


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def attention(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages as encoded, and what their attention weights are the exponentials of."""
        w = self.weights
        h = np.maximum(inputs(counts) @ w["encode"] + w["shift"], 0)
        return h, (np.tanh(h @ w["look"]) * _sigmoid(h @ w["gate"])) @ w["attend"]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        total, mean, top = 0.0, np.zeros(HIDDEN), -np.inf
        for counts in passage_counts(text):
            h, e = self.attention(counts)
            above = max(top, float(e.max()))
            scale, a = float(np.exp(top - above)), np.exp((e - above).astype("f8"))
            total, mean, top = total * scale + a.sum(), mean * scale + a @ h, above
        z = mean / total if total else mean
        return float(_sigmoid(z @ self.weights["judge"] + self.weights["bias"][0]))


def gradients(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of some bags and its gradients; ``bags`` says for each passage which bag it is of, rising."""
    before = x @ w["encode"] + w["shift"]
    h = np.maximum(before, 0)
    look, gate = np.tanh(h @ w["look"]), _sigmoid(h @ w["gate"])
    e = (look * gate) @ w["attend"]
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, bags, e)
    a = np.exp(e - top[bags])
    a /= np.bincount(bags, a, len(y))[bags]
    z = np.zeros((len(y), HIDDEN))
    np.add.at(z, bags, a[:, None] * h)
    out = z @ w["judge"] + w["bias"][0]
    loss = float(np.mean(np.logaddexp(0, out) - y * out))
    d_out = (_sigmoid(out) - y) / len(y)
    d_z = d_out[:, None] * w["judge"]
    d_h = a[:, None] * d_z[bags]
    d_a = np.einsum("ij,ij->i", d_z[bags], h)
    d_e = a * (d_a - np.bincount(bags, a * d_a, len(y))[bags])
    d_product = d_e[:, None] * w["attend"]
    d_look, d_gate = d_product * gate * (1 - look**2), d_product * look * gate * (1 - gate)
    d_h += d_look @ w["look"].T + d_gate @ w["gate"].T
    d_h = np.where(before > 0, d_h, 0).astype("f4")
    return loss, {
        "encode": x.T @ d_h,
        "shift": d_h.sum(0),
        "look": h.T @ d_look,
        "gate": h.T @ d_gate,
        "attend": (look * gate).T @ d_e,
        "judge": z.T @ d_out,
        "bias": np.array([d_out.sum()]),
    }


def learn(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights from bags of passage counts and their labels, by Adam steps over a few bags each."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype("f4") if len(s) == 2 else np.zeros(s, "f4") for k, s in SHAPES.items()}
    w["encode"] *= 4  # inputs are shares of many
    w["attend"], w["judge"] = (rng.normal(size=SHAPES[k]).astype("f4") * 0.2 for k in ("attend", "judge"))
    first, second = ({k: np.zeros(s) for k, s in SHAPES.items()} for _ in range(2))
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS * BAGS_AT_ONCE // len(bags)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BAGS_AT_ONCE):
            some = order[k : k + BAGS_AT_ONCE]
            sizes = [len(bags[i]) for i in some]
            x = inputs(np.concatenate([bags[i] for i in some]))
            step += 1
            _, grads = gradients(w, x, np.repeat(np.arange(len(some)), sizes), y[some])
            for name, g in grads.items():
                g = g + DECAY * w[name] * (name not in ("bias", "shift"))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                m, v = first[name] / (1 - 0.9**step), second[name] / (1 - 0.999**step)
                w[name] = (w[name] - rate * m / (np.sqrt(v) + 1e-8)).astype("f4")
    return w


def labelled_bags(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``doc_id, label, n, counts`` of the labelled documents that are learned from: a written table.

    Labels are cut to about ``train_rows`` by a hash of the id before they meet the texts, so they fit into a
    broadcast; of several texts under one id the one with the least hash stays.
    """
    known = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("label"))
        .filter(learn_from & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("label") >= 1).cast("int").alias("label"))
    )
    share = train_rows / max(1, known.count())
    dice = F.pmod(F.xxhash64("doc_id", F.lit("rows")), F.lit(1 << 20))
    some = F.broadcast(known.filter(dice < int(share * (1 << 20)) + 1))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    one = texts.join(some, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                counts = [b"".join(c.tobytes() for c in passage_counts(t.as_py())) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(c) // COUNTS for c in counts], pa.int64()), pa.array(counts, pa.binary())],
                    ["doc_id", "label", "n", "counts"],
                )

    schema = T.StructType(
        [one.schema["doc_id"], one.schema["label"], T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())]
    )
    return stored(one.mapInArrow(encode, schema), "labelled-bags")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    train_rows: int = TRAIN_ROWS,
    train_passages: int = TRAIN_PASSAGES,
    bag_passages: int = BAG_PASSAGES,
    epochs: int = EPOCHS,
) -> Model:
    """Learn from the labels for which ``learn_from`` holds; it is asked of ``doc_id``."""
    bags = labelled_bags(docs, labels, learn_from, id_column, text_column, label_column, train_rows)
    bags = bags.filter(F.col("n") <= bag_passages)
    total = bags.agg(F.sum("n")).first()[0] or 0
    if total > train_passages:
        dice = F.pmod(F.xxhash64("doc_id", F.lit("passages")), F.lit(1 << 20))
        bags = bags.filter(dice < int(train_passages / total * (1 << 20)))
    rows = sorted(bags.collect(), key=lambda r: (r.doc_id, r.label))
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    return Model(learn([np.frombuffer(r.counts, "u1").reshape(-1, COUNTS) for r in rows], y, epochs))


def score(docs: DataFrame, model: Model, text_column: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def of(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(column, of(F.col(text_column)))
