"""Quality from the passages of a text: multiple-instance learning with gated attention."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import column, portions
from colonnade.llm.samples import held_out, labelled_sample

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 768
#: Bytes, and hashed pairs and triples of bytes, that describe a passage; and sizes of the layers.
KINDS = ((1, 256), (2, 512), (3, 256))
#: Beside them, how much of a passage is new: its distinct runs of bytes among all, for two lengths.
FRESH, FRESH_SLOTS = (4, 8), 2048
FEATURES = 1024 + len(FRESH)
HIDDEN, GATE = 32, 16
SAMPLE_ROWS = 2_400
SAMPLE_TEXT_BYTES = 1 << 14
CUT = 0.3
ROUNDS, BATCH = 14, 32


def passages(texts: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, one text after the other, and where each text's begin.

    A text has one passage at least, an empty one if need be.  A passage's features are the square roots of the
    shares of its bytes, byte pairs and triples: few large ones where it repeats itself, many small ones in prose.
    """
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = starts[text_of] + within // size
    out = np.zeros(starts[-1] * FEATURES, np.float32)
    blocks, shift = [], 0
    for n, buckets in KINDS:
        if len(data) >= n:
            code = data[: len(data) - n + 1].copy()
            for k in range(1, n):
                code = code << np.uint32(8) | data[k : len(data) - n + 1 + k]
            if n > 1:
                with np.errstate(over="ignore"):
                    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())
            same = passage[: len(code)] == passage[n - 1 :]
            place = passage[: len(code)][same] * FEATURES + shift + code[same]
            out += np.bincount(place, minlength=len(out)).astype(np.float32)
        blocks.append(slice(shift, shift + buckets))
        shift += buckets
    out = out.reshape(-1, FEATURES)
    for block in blocks:
        part = out[:, block]
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    np.sqrt(out, out)
    for k, n in enumerate(FRESH):
        if len(data) >= n:
            code = np.zeros(len(data) - n + 1, np.uint64)
            for j in range(n):
                code = code << np.uint64(8) | data[j : len(data) - n + 1 + j].astype(np.uint64)
            with np.errstate(over="ignore"):
                code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - FRESH_SLOTS.bit_length())
            same = passage[: len(code)] == passage[n - 1 :]
            seen = np.zeros(starts[-1] * FRESH_SLOTS, bool)
            seen[passage[: len(code)][same] * FRESH_SLOTS + code[same].astype(np.int64)] = True
            all_runs = np.bincount(passage[: len(code)][same], minlength=starts[-1])
            out[:, shift + k] = 2 * seen.reshape(-1, FRESH_SLOTS).sum(1) / np.maximum(all_runs, 1)
    return out, starts


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Passage h = tanh(x A + a); weight softmax(w . (tanh(h V) * logistic(h U))); score logistic(sum(weight h) c + d)."""

    values: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int) -> Attention:
        rng = np.random.default_rng(seed)
        shapes = {"A": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
        values = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        values["A"] *= np.sqrt(FEATURES) / 2
        values |= {"a": np.zeros(HIDDEN), "d": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in values.items()})

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Every passage's representation h and attention e before the softmax."""
        v = self.values
        h = np.tanh(x @ v["A"] + v["a"])
        p, q = np.tanh(h @ v["V"]), _logistic(h @ v["U"])
        return {"h": h, "p": p, "q": q, "e": (p * q) @ v["w"]}

    def pool(self, h: np.ndarray, e: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        first, lengths = starts[:-1], np.diff(starts)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), lengths))
        weight = e / np.repeat(np.add.reduceat(e, first), lengths)
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        return {"weight": weight, "z": z, "score": _logistic(z @ self.values["c"] + self.values["d"])}

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Scores and attention weights of whole texts; features exist for about a megabyte at a time."""
        block = PASSAGE * 1024
        pieces = [t[at : at + block] for t in texts for at in range(0, max(1, len(t)), block)]
        found, group, size = [], [], 0
        for k, piece in enumerate(pieces):
            group.append(piece)
            size += len(piece) + PASSAGE // 2
            if size >= block or k == len(pieces) - 1:
                done = self.encode(passages(group)[0])
                found.append((done["h"], done["e"]))
                group, size = [], 0
        starts = np.concatenate([[0], np.cumsum([max(1, -(-len(t) // PASSAGE)) for t in texts])])
        h, e = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return self.pool(h, e, starts) | {"starts": starts}

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy, by the chain rule through pooling, attention, gate and encoder."""
        v, f = self.values, self.encode(x)
        f |= self.pool(f["h"], f["e"], starts)
        lengths = np.diff(starts)
        error = (f["score"] - labels) * share
        dz = np.repeat(error[:, None] * v["c"], lengths, axis=0)
        dh = dz * f["weight"][:, None]
        along = (dz * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(along * f["weight"], starts[:-1]), lengths)
        de = f["weight"] * (along - mean)
        dp = de[:, None] * v["w"] * f["q"] * (1 - f["p"] ** 2)
        dq = de[:, None] * v["w"] * f["p"] * f["q"] * (1 - f["q"])
        dh += dp @ v["V"].T + dq @ v["U"].T
        da = dh * (1 - f["h"] ** 2)
        return {
            "A": x.T @ da, "a": da.sum(0), "V": f["h"].T @ dp, "U": f["h"].T @ dq, "w": (f["p"] * f["q"]).T @ de,
            "c": f["z"].T @ error, "d": error.sum(keepdims=True),
        }


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 11, rounds: int = ROUNDS) -> Attention:
    """Trained by Adam on small batches of documents; a constant score where there is only one label."""
    model = Attention.fresh(seed)
    if len(set(labels.tolist())) < 2:
        model.values["c"][:] = 0
        model.values["d"][:] = 4.0 if not len(labels) or labels[0] == 1 else -4.0
        return model
    rng = np.random.default_rng(seed)
    labels, weights = labels.astype(np.float32), (weights / weights.mean()).astype(np.float32)
    ready = [passages([t])[0] for t in texts]
    first = {k: np.zeros_like(v) for k, v in model.values.items()}
    second = {k: np.zeros_like(v) for k, v in model.values.items()}
    step = 0
    for epoch in range(rounds):
        rate = 0.01 * (1 - epoch / rounds) + 0.001
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            x = np.concatenate([ready[k] for k in chosen])
            starts = np.concatenate([[0], np.cumsum([len(ready[k]) for k in chosen])])
            found = model.gradients(x, starts, labels[chosen], weights[chosen] / len(chosen))
            step += 1
            for k, g in found.items():
                g = g + 1e-4 * model.values[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", folds: int = 5, id_column: str = "doc_id",
          text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> Attention:
    """The model, learnt from at most `sample_rows` labelled documents that `held_out` doesn't keep back."""
    usable = F.coalesce(F.crc32(F.col("id").cast("string")) % folds != 0, F.lit(False))
    chosen = labelled_sample(docs, labels, label_column, sample_rows, SAMPLE_TEXT_BYTES, id_column, text_column, usable)
    rows = chosen.withColumn("id", F.col("id").cast("string")).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    return fit(texts, rows.column("label").to_numpy().astype(float), rows.column("weight").to_numpy())


def score(docs: DataFrame, model: Attention, cut: float = CUT, folds: int = 5, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """For every row the id, `held_out` (its label was not for learning), `score` (0 to 1) of the whole text,
    `predicted` (1 from `cut` on) and `top_passage` (number, from 0, of the passage with the most weight).

    A null or empty text is one empty passage and gets that one's score.  Equal texts score alike; null ids are not
    held out; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        column(id_column).alias("id"), held_out(id_column, folds).alias("held_out"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"),
    )
    schema = (
        f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int, "
        "top_passage int"
    )

    def run(batches):
        scorer = shared.value
        for whole in batches:
            for part in portions(whole):
                f = scorer.score([t.encode() for t in part.column(2).to_pylist()])
                top = [int(np.argmax(f["weight"][a:b])) for a, b in zip(f["starts"][:-1], f["starts"][1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(f["score"].astype(np.float64)),
                     pa.array((f["score"] >= cut).astype(np.int32)), pa.array(top, pa.int32())],
                    [id_column, "held_out", "score", "predicted", "top_passage"],
                )

    return rows.mapInArrow(run, schema)
