"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is encoded (square roots of the frequencies of its
byte pairs, hashed to PAIRS cells, with a few shape features, then a tanh layer); gated attention gives each passage
a weight, a = softmax(w . (tanh(hV) * sigmoid(hU))); the weighted sum of the encodings is scored. Only labels of whole
documents are needed to learn all of it.

Training runs on the driver over a sample of labelled rows bounded by `sample` (per class, chosen by the hash of the
id). Both training and scoring read whole texts; the gradient is summed block of passages by block of passages, and
passages of long texts are encoded anew for every block, so that a text of any length takes little more than itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

PASSAGE, PAIRS, SHAPES, HIDDEN = 512, 1024, 8, 24
SAMPLE = 1200
#: Passages encoded at a time in training.
BLOCK = 1024
EPOCHS, BATCH, RATE = 30, 32, 0.004
THRESHOLD = 0.3


def encode(raw, offsets):
    """(features, bag starts) of the passages of all texts; an empty text is a bag of one empty passage."""
    import numpy as np

    sizes = np.diff(offsets)
    bags = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[doc] + (np.arange(len(raw)) - offsets[doc]) // PASSAGE
    lengths = np.bincount(passage, minlength=total).astype(np.float32)
    x = np.zeros((total, PAIRS + SHAPES), np.float32)
    if len(raw) > 1:
        a, b = raw[:-1].astype(np.int64), raw[1:].astype(np.int64)
        inside = passage[1:] == passage[:-1]
        cell = (passage[:-1] * PAIRS + ((a * 37) ^ (b * 101)) % PAIRS)[inside]
        counts = np.bincount(cell, minlength=total * PAIRS).reshape(total, PAIRS).astype(np.float32)
        n = np.maximum(lengths, 1)
        x[:, :PAIRS] = np.sqrt(counts / n[:, None])
        share = lambda mask: np.bincount(passage, weights=mask, minlength=total) / n
        x[:, PAIRS] = share((raw >= 65) & (raw <= 90))
        x[:, PAIRS + 1] = share((raw >= 48) & (raw <= 57))
        x[:, PAIRS + 2] = share(raw == 32)
        x[:, PAIRS + 3] = share(raw == 10) * 8
        x[:, PAIRS + 4] = share((raw < 128) & ~(((raw | 32) >= 97) & ((raw | 32) <= 122)) & (raw != 32))
        x[:, PAIRS + 5] = share(raw >= 128)
        x[:, PAIRS + 6] = (counts > 0).sum(1) / n
        x[:, PAIRS + 7] = counts.max(1) / n
    return x, first


def forward(p: dict, x, first):
    import numpy as np

    return forward_hidden(p, np.tanh(x @ p["W"] + p["b"]), first)


class LongBag:
    """The passages of one text, encoded a block at a time."""

    def __init__(self, raw):
        self.raw = raw

    def __len__(self) -> int:
        return max(1, -(-len(self.raw) // PASSAGE))

    def blocks(self):
        import numpy as np

        for at in range(0, max(1, len(self.raw)), BLOCK * PASSAGE):
            part = self.raw[at : at + BLOCK * PASSAGE]
            yield encode(part, np.array([0, len(part)]))[0]


def blocks(bags: list):
    """The feature rows of bags, in order."""
    for bag in bags:
        if isinstance(bag, LongBag):
            yield from bag.blocks()
        else:
            yield bag


def forward_hidden(p: dict, h, first):
    import numpy as np

    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    starts, sizes = first[:-1], np.diff(first)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return h, t, g, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))


def fit(bags: list, labels, weights, seed: int = 7) -> dict:
    """Parameters of the model; bags are feature matrices or LongBags, trained by Adam on the weighted log loss."""
    import numpy as np

    rng = np.random.default_rng(seed)
    dim = PAIRS + SHAPES
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": init(dim, HIDDEN) * 4, "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, HIDDEN), "U": init(HIDDEN, HIDDEN), "w": init(HIDDEN), "c": init(HIDDEN), "d": np.zeros((), np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            take = order[i : i + BATCH]
            batch, first = [bags[j] for j in take], np.concatenate([[0], np.cumsum([len(bags[j]) for j in take])])
            h, t, g, a, z, s = forward_hidden(p, np.concatenate([np.tanh(x @ p["W"] + p["b"]) for x in blocks(batch)]), first)
            ds = (s - labels[take]) * weights[take] / len(take)
            sizes = np.diff(first)
            dz = np.repeat(ds[:, None] * p["c"], sizes, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), sizes))
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            dw, at = 1e-5 * p["W"], 0
            for x in blocks(batch):
                dw += x.T @ dh[at : at + len(x)]
                at += len(x)
            grad = {"W": dw, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum()}
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = (p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model learnt from at most 2 * sample labelled rows that are not held out.

    Null labels, and labels of ids that docs lacks, are passed over. With labels of one class, or none, the model is a
    constant: that class's share (0.5 without labels).
    """
    import numpy as np

    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    usable = usable.filter(common.crc_mod5() != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = common.materialise(usable, "quality-labels")
    counts = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    n = [counts.get(0, 0), counts.get(1, 0)]
    if not all(n):
        return {"constant": n[1] / sum(n) if sum(n) else 0.5}
    chosen = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * sample ids, so it can be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    if not len(rows):
        return {"constant": n[1] / sum(n)}
    y = rows["quality"].to_numpy().astype(np.float32)
    bags = []
    for _, part in common.text_slices(rows["doc_id"].combine_chunks(), rows["text"].combine_chunks()):
        raw, offsets = common.utf8_buffer(part)
        if len(raw) > BLOCK * PASSAGE and len(part) == 1:  # slices of several texts are of 1 MB at most
            bags.append(LongBag(raw))
            continue
        x, first = encode(raw, offsets)
        bags += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    # weighted to the share that either class has among all usable labels
    share = np.array([max(1, (y == q).sum()) / n[q] for q in (0, 1)])
    weight = (1 / share)[y.astype(int)]
    return fit(bags, y, (weight / weight.mean()).astype(np.float32))


def scores(model: dict, texts):
    """Scores of texts, rounded to 6 places; equal texts get equal scores, whatever they stand beside.

    Features follow from a passage alone. Sums of products differ by batch in their last bits, which in double precision
    are far below the rounding.
    """
    import numpy as np

    if "constant" in model:
        return np.full(len(texts), model["constant"])
    wide = {k: np.asarray(v, np.float64) for k, v in model.items()}
    x, first = encode(*common.utf8_buffer(texts))
    return np.round(forward(wide, x.astype(np.float64), first)[-1], 6)


def _scored(model: dict):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, texts in common.text_slices(batch.column("doc_id"), batch.column("text")):
                yield pa.RecordBatch.from_arrays([ids, pa.array(scores(model, texts), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row per row of docs; nulls count as empty texts, whose score is the model's as well.

    Equal texts have equal scores. Repeated rows are scored each, other columns are ignored, an empty table
    gives no rows; a text of any length is scored whole, in passages.
    """
    return common.source(docs, id_col, text_col).mapInArrow(_scored(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches threshold.

    Null and empty texts have the model's score of an empty text and stay or go by it. Ids decide nothing and may be
    null; repeated rows stay or go together; an empty table gives none.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for rows, texts in common.text_slices(pa.array(np.arange(len(batch))), batch.column(text_col)):
                yield batch.slice(rows[0].as_py(), len(rows)).filter(pa.array(scores(model, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
