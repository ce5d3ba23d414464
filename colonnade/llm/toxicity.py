"""Toxicity of whole texts: a convolutional classifier over hashed words, with a threshold for every language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.common import column, portions, word_hashes
from colonnade.llm.samples import held_out, labelled_rows

#: A word is the sum of DRAWS rows of one table, so that words sharing a row still differ.
SLOT_BITS, DRAWS, SIZE = 18, 3, 12
SLOTS = 1 << SLOT_BITS
#: Filters over so many neighbouring words, and how many of each.
WIDTHS, FILTERS = (1, 2, 3), 8
POOLED = len(WIDTHS) * FILTERS
#: Words a window may reach beyond the last one of its text: empty ones stand between texts.
GAP = max(WIDTHS) - 1
#: Words of labelled texts that a task learns from, and bytes of text to a word; there are as many tasks as all the
#: labelled texts need.
SHARE_WORDS, WORD_BYTES = 4_000_000, 6
#: Words scored together; a longer text is pooled from several stretches.
STRETCH = 1 << 16
BATCH, FORGET = 32, 0.5
#: Every round goes through all texts: at least and at most so many, between them until a task has seen VISITS texts.
LEAST_ROUNDS, ROUNDS, VISITS = 4, 12, 36_000
CUT, LEAST_ROWS = 0.3, 40
#: One labelled text in so many is for calibration and thresholds, the others are learnt from.
CHECKED = 5
#: Rows of the learnt state that are averaged as one group.
BLOCK = 1024
#: Parts in which scores are ranked side by side.
RANKED = 200
FOLDS, FOLD = 4, 2

#: Letters and digits of ASCII in lower case, and every other byte beyond ASCII, belong to words.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_WORD).split()


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """The table rows of each word, one column for each draw."""
    shifts = np.arange(DRAWS, dtype=np.uint64) * np.uint64(SLOT_BITS)
    return ((hashes[:, None] >> shifts) & np.uint64(SLOTS - 1)).astype(np.int32)


def joined(texts: list[np.ndarray], counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all texts with empty words between them, where each text begins, and the places that begin none of its
    windows: those beyond `counts`, or beyond the first empty word after it."""
    empty = np.full((GAP + 1, DRAWS), SLOTS, np.int32)
    parts, starts, idle, at = [], [], [], 0
    for k, slots in enumerate(texts):
        starts.append(at)
        parts += [slots, empty]
        end = at + len(slots) + GAP + 1
        idle.append(np.arange(at + (counts[k] if counts else len(slots) + 1), end))
        at = end
    return np.concatenate(parts), np.array(starts, np.int64), np.concatenate(idle)


@dataclass
class Convolution:
    """score = logistic(slope * (sum of c * max(0, m + b)) + shift), m the greatest response of each filter in a text."""

    table: np.ndarray
    filters: np.ndarray
    b: np.ndarray
    c: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = CUT

    @classmethod
    def fresh(cls, seed: int) -> Convolution:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (SLOTS + 1, SIZE)).astype(np.float32)
        table[SLOTS] = 0
        filters = rng.normal(0, 0.3, (SIZE, sum(WIDTHS) * FILTERS)).astype(np.float32)
        return cls(table, filters, np.zeros(POOLED, np.float32), rng.normal(0, 0.3, POOLED).astype(np.float32))

    def responses(self, slots: np.ndarray, idle: np.ndarray) -> np.ndarray:
        """What every filter says of the window at every word; nothing at the `idle` places."""
        x = self.table[slots[:, 0]]
        for k in range(1, DRAWS):
            x += self.table[slots[:, k]]
        y, out, at = x @ self.filters, [], 0
        for width in WIDTHS:
            total = y[:, at : at + FILTERS].copy()
            for j in range(1, width):
                piece = y[:, at + j * FILTERS : at + (j + 1) * FILTERS]
                total[: len(total) - j] += piece[j:]
            out.append(total)
            at += width * FILTERS
        found = np.concatenate(out, axis=1)
        found[idle] = -np.inf
        return found

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The greatest responses of whole texts, a stretch of words at a time; stretches overlap by a window."""
        out = np.full((len(texts), POOLED), -np.inf, np.float32)
        group, counts, owner, size = [], [], [], 0

        def settle():
            slots, starts, idle = joined(group, counts)
            np.maximum.at(out, owner, np.maximum.reduceat(self.responses(slots, idle), starts, axis=0))

        for k, slots in enumerate(texts):
            for at in range(0, max(1, len(slots)), STRETCH):
                group.append(slots[at : at + STRETCH + GAP])
                counts.append(STRETCH if at + STRETCH < len(slots) else len(slots) - at + 1)
                owner.append(k)
                size += len(group[-1])
                if size >= STRETCH:
                    settle()
                    group, counts, owner, size = [], [], [], 0
        if group:
            settle()
        return out

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(texts) + self.b, 0).astype(np.float64) @ self.c

    def score(self, raw: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * raw + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _start(model: Convolution, seen: np.ndarray, total: np.ndarray) -> None:
    """Set the table's first coordinate to how much more often a slot stands in texts of label 1 (smoothed log-odds),
    and one filter of each width to read it, so that training begins from words and not from noise.  Slots met in one
    text or none start at zero: names and slips are no evidence.  `seen` has the texts of each label that hold a slot,
    `total` all of them."""
    rate = np.log((seen + 0.5) / (total[:, None] + 1))
    model.table[:SLOTS, 0] = np.clip((rate[1] - rate[0]) / 4, -0.5, 1.5)
    model.table[:SLOTS][seen.sum(0) < 2] = 0
    at = 0
    for width in WIDTHS:
        model.filters[:, at] = 0
        model.filters[0, at] = 1
        for j in range(1, width):
            model.filters[:, at + j * FILTERS] = 0
        at += width * FILTERS
    model.c[::FILTERS] = 1.0


def gradients(model: Convolution, texts: list[np.ndarray], labels: np.ndarray, share: np.ndarray, bias: float) -> dict:
    """Of the weighted cross-entropy.  Only the words that won a filter in their text carry any: `slots` and `rows` are
    the touched rows of the table, each as often as touched."""
    slots, starts, idle = joined(texts)
    y = model.responses(slots, idle)
    ends = np.append(starts[1:], len(slots))
    place = np.stack([a + y[a:b].argmax(0) for a, b in zip(starts, ends)])
    best = np.take_along_axis(y, place, axis=0)
    open_ = np.maximum(best + model.b, 0)
    error = (_logistic(open_ @ model.c + bias) - labels) * share
    found = {"c": open_.T @ error, "bias": error.sum()}
    delta = error[:, None] * model.c * (open_ > 0)
    found["b"] = delta.sum(0)
    grad = np.zeros_like(model.filters)
    touched, rows, at = [], [], 0
    for k, width in enumerate(WIDTHS):
        mine = slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(width):
            part = slice(at + j * FILTERS, at + (j + 1) * FILTERS)
            where = np.minimum(place[:, mine] + j, len(slots) - 1)
            inside = (place[:, mine] + j < len(slots))[..., None]
            words = slots[where]
            x = model.table[words].sum(2) * inside
            d = delta[:, mine]
            grad[:, part] = np.einsum("nf,nfs->sf", d, x)
            touched.append(words.reshape(-1, DRAWS))
            rows.append((d[..., None] * model.filters[:, part].T * inside).reshape(-1, SIZE))
        at += width * FILTERS
    return found | {"filters": grad, "slots": np.concatenate(touched), "rows": np.concatenate(rows)}


@dataclass
class Learner:
    """A model in training: its parameters, the bias of its raw scores, and the sums of squares that slow each down."""

    model: Convolution
    bias: np.ndarray
    slow: dict[str, np.ndarray]

    @classmethod
    def of(cls, model: Convolution) -> Learner:
        small = {"filters": model.filters, "b": model.b, "c": model.c, "bias": np.zeros(1, np.float32)}
        slow = {name: np.full_like(values, 1e-6) for name, values in small.items()}
        return cls(model, small["bias"], slow | {"table": np.full((SLOTS + 1, 1), 1e-6, np.float32)})

    @property
    def small(self) -> dict[str, np.ndarray]:
        return {"filters": self.model.filters, "b": self.model.b, "c": self.model.c, "bias": self.bias}

    def state(self) -> np.ndarray:
        """All of it as rows of one width: first the table's, each with its sum of squares, then the others."""
        others = np.concatenate([x.ravel() for n, v in self.small.items() for x in (v, self.slow[n])])
        others = np.pad(others, (0, -len(others) % (SIZE + 1))).reshape(-1, SIZE + 1)
        return np.concatenate([np.hstack([self.model.table[:SLOTS], self.slow["table"][:SLOTS]]), others]).astype(np.float32)

    @classmethod
    def from_state(cls, state: np.ndarray) -> Learner:
        one = cls.of(Convolution(
            np.zeros((SLOTS + 1, SIZE), np.float32), np.zeros((SIZE, sum(WIDTHS) * FILTERS), np.float32),
            np.zeros(POOLED, np.float32), np.zeros(POOLED, np.float32),
        ))
        one.model.table[:SLOTS], one.slow["table"][:SLOTS] = state[:SLOTS, :SIZE], state[:SLOTS, SIZE:]
        others, at = state[SLOTS:].ravel(), 0
        for name, values in one.small.items():
            for into in (values, one.slow[name]):
                into[...] = others[at : at + into.size].reshape(into.shape)
                at += into.size
        return one

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One round through the texts, with part of the words left out anew."""
        model, order = self.model, rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            kept = [texts[k][rng.random(len(texts[k])) >= FORGET] for k in part]
            g = gradients(model, kept, labels[part], np.full(len(part), 1 / len(part)), float(self.bias[0]))
            for name, values in self.small.items():
                step = g[name] + 1e-4 * values
                self.slow[name] += step * step
                values -= rate * step / np.sqrt(self.slow[name])
            slots, where = np.unique(g["slots"], return_inverse=True)
            rows = np.zeros((len(slots), SIZE))
            for k in range(DRAWS):
                np.add.at(rows, where.reshape(-1, DRAWS)[:, k], g["rows"])
            self.slow["table"][slots] += (rows * rows).mean(1, keepdims=True)
            model.table[slots] -= (rate * rows / np.sqrt(self.slow["table"][slots])).astype(np.float32)
            model.table[SLOTS] = 0


def calibrated(sums) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed targets (Platt), by damped Newton steps.  `sums` adds up
    what a function gives for the raw scores and labels of each share."""
    count, positive, total = sums(lambda raw, y: np.array([len(y), y.sum(), raw.sum()]))
    centre, negative = total / count, count - positive
    spread = float(np.sqrt(sums(lambda raw, y: np.array([((raw - centre) ** 2).sum()]))[0] / count)) or 1.0
    high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)
    beta = np.array([1.0, -1.0])
    for _ in range(100):
        def slopes(raw, y, beta=beta):
            x = np.stack([(raw - centre) / spread, np.ones(len(raw))], 1)
            p = _logistic(x @ beta)
            return np.concatenate([x.T @ (p - np.where(y == 1, high, low)), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        found = sums(slopes) / count
        slope, curve = found[:2] + 1e-4 * beta * [1, 0], found[2:].reshape(2, 2) + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3) / spread, float(beta[1]) - max(float(beta[0]), 1e-3) * centre / spread


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Where precision and recall balance best (greatest F1, in the middle of the gap between the two scores)."""
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    hit, all_ = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (all_ + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float((s[k] + below) / 2)


def best_thresholds(scored: DataFrame) -> dict[str | None, float]:
    """`best_threshold` of all rows of `lang, label, score` (under None), and of every language with enough rows and
    both labels.  Scores are ranked in parts whose bounds only deal the work: what is above a part is added to it."""
    each = F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))))
    bounds = scored.approxQuantile("score", [k / RANKED for k in range(1, RANKED)], 1 / RANKED / 4)
    if not bounds:
        return {}
    counted = scored.select(each.alias("scope"), "score", "label").groupBy("scope", "score").agg(
        F.count("*").alias("n"), F.sum("label").alias("hits")
    ).withColumn("part", F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b > F.col("score"))))
    whole = Window.partitionBy("scope")
    above = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("scope", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("score").alias("top")).select(
        "scope", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"),
        F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("above_hits"),
        F.lead("top").over(whole.orderBy("part")).alias("next"),
        F.sum("n").over(whole).alias("rows"), F.sum("hits").over(whole).alias("positive"),
    )
    own = Window.partitionBy("scope", "part").orderBy(F.desc("score"))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(parts, ["scope", "part"]).select(
        "scope", "score", "rows", "positive", F.coalesce(F.lead("score").over(own), "next", F.lit(0.0)).alias("below"),
        (F.col("above") + F.sum("n").over(so_far)).alias("n"), (F.col("above_hits") + F.sum("hits").over(so_far)).alias("hits"),
    )
    f1 = 2 * F.col("hits") / (F.col("n") + F.col("positive"))
    best = ranked.groupBy("scope", "rows", "positive").agg(F.max(F.struct(f1.alias("f1"), "score", "below")).alias("best"))
    usable = (F.col("scope") == "") | ((F.col("rows") >= LEAST_ROWS) & (F.col("positive") > 0) & (F.col("positive") < F.col("rows")))
    return {
        r["scope"][1:] if r["scope"] else None: (r["best"]["score"] + r["best"]["below"]) / 2
        for r in best.filter(usable).collect()
    }


def _blocks(share: int, weight: int, state: np.ndarray, which: np.ndarray):
    """The chosen rows of a state, in blocks, as `_gathered` takes them."""
    for block in np.unique(which // BLOCK).tolist():
        mine = which[which // BLOCK == block]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int32()), "share": pa.array([share], pa.int32()),
            "weight": pa.array([weight], pa.int64()), "rows": pa.array([mine.astype(np.int32).tobytes()], pa.binary()),
            "state": pa.array([state[mine].astype(np.float32).tobytes()], pa.binary()),
        })


#: Tells Spark to drop the shuffle files of a query at its end; else those of all rounds pile up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BLOCK = "block int, share int, weight long, rows binary, state binary"


def _gathered(shares: DataFrame, work, into: np.ndarray, mean: bool) -> None:
    """Puts into each row of a state the sum or weighted mean over the shares that gave one; other rows stay.  Blocks of
    rows are added up in parallel, in the order of shares; what comes to the driver is one state, however many shares."""
    width = into.shape[1]

    def added(table: pa.Table) -> pa.Table:
        parts = table.sort_by("share").to_pylist()
        base = parts[0]["block"] * BLOCK
        total, weights = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for part in parts:
            rows = np.frombuffer(part["rows"], np.int32) - base
            total[rows] += np.frombuffer(part["state"], np.float32).reshape(-1, width).astype(float) * part["weight"]
            weights[rows] += part["weight"]
        met = np.flatnonzero(weights)
        found = total[met] / weights[met, None] if mean else total[met]
        return pa.table({"rows": [(met + base).astype(np.int32).tobytes()], "state": [found.astype(np.float32).tobytes()]})

    gathered = shares.mapInArrow(work, _BLOCK).groupBy("block").applyInArrow(added, "rows binary, state binary")
    conf, old = shares.sparkSession.conf, shares.sparkSession.conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        for row in gathered.collect():
            into[np.frombuffer(row["rows"], np.int32)] = np.frombuffer(row["state"], np.float32).reshape(-1, width)
    finally:
        conf.set(_CLEANUP, old)


def _texts(batches, checked: bool | None):
    """Share, slots, label and language of the texts that are for checking, or for learning, or of all (None)."""
    for batch in batches:
        for k, check in enumerate(batch.column("checked").to_pylist()):
            if checked is None or check == checked:
                n, words = batch.column("n")[k].as_py(), batch.column("words")[k].as_buffer()
                hashes = np.frombuffer(pa.decompress(words, decompressed_size=8 * n, codec="zstd"), np.uint64)
                yield batch.column("share")[k].as_py(), slots_of(hashes), batch.column("label")[k].as_py(), batch.column("lang")[k].as_py()


def _seen(shares: DataFrame, checked: bool | None) -> np.ndarray:
    """How many texts of each label hold a slot."""
    def count(batches):
        found, share = np.zeros((SLOTS, 2), np.float32), 0
        for share, slots, label, _ in _texts(batches, checked):
            found[np.unique(slots), label] += 1
        yield from _blocks(share, 1, found, np.flatnonzero(found.any(1)))

    seen = np.zeros((SLOTS, 2), np.float32)
    _gathered(shares, count, seen, mean=False)
    return seen.T


def _learn(shares: DataFrame, state: np.ndarray, checked: bool | None, rounds: list[int], of: int, seed: int) -> None:
    """Puts every share's texts through `rounds` from the same state of a learner, and the mean of what each share made
    of it, by their numbers of texts, into `state`.  A slot's row is the mean over the shares that changed it."""
    shared = shares.sparkSession.sparkContext.broadcast(state)

    def learn(batches):
        texts, labels, share = [], [], 0
        for share, slots, label, _ in _texts(batches, checked):
            texts.append(slots)
            labels.append(label)
        if not texts:
            return
        own = Learner.from_state(shared.value)
        for number in rounds:
            rate = 0.05 * (1 - number / of) + 0.005
            own.learn(texts, np.array(labels, float), np.random.default_rng([seed, number, share]), rate)
        made = own.state()
        changed = (made != shared.value).any(1)
        changed[SLOTS:] = True
        yield from _blocks(share, len(texts), made, np.flatnonzero(changed))

    _gathered(shares, learn, state, mean=True)
    shared.destroy()


def train(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id",
          text_column: str = "text", lang_column: str | None = "lang", sample_words: int = SHARE_WORDS,
          seed: int = 5) -> Convolution:
    """The model, learnt from all labelled documents that aren't held out, whole: four of five are learnt from, the fifth
    is for calibration and the thresholds of the languages.  A constant score where there is only one label.

    The documents are dealt by their ids into shares of about `sample_words` words.  In every round each share trains on
    its own texts from the same state, and the states are averaged; a single share does all rounds at once.  Null ids,
    texts and labels are not learnt from; a null language has the threshold of all.
    """
    mine = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS != FOLD, F.lit(False))
    others = {"lang": column(lang_column) if lang_column else F.lit(None)}
    rows = labelled_rows(docs, labels, label_column, sample_words * WORD_BYTES, id_column, text_column, mine, others)

    def hashed(batches):
        for whole in batches:
            for part in portions(whole):
                hashes = [word_hashes(words_of(t)) for t in part.column("text").to_pylist()]
                words = [pa.compress(h.tobytes(), codec="zstd", asbytes=True) for h in hashes]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), part.column("order"), part.column("label"), part.column("lang"),
                     pa.array([len(h) for h in hashes], pa.int64()), pa.array(words, pa.binary())],
                    ["id", "order", "label", "lang", "n", "words"],
                )

    # Dealt by the ids and sorted by their hash, so that a share's texts and their order don't depend on the cluster.
    shares = rows.withColumn("lang", F.col("lang").cast("string")).mapInArrow(
        hashed, "id string, order long, label int, lang string, n long, words binary"
    ).sortWithinPartitions("order", "id", "label").select(
        F.spark_partition_id().alias("share"), (F.pmod("order", F.lit(CHECKED)) == 0).alias("checked"), "label", "lang", "n", "words"
    ).persist(StorageLevel.DISK_ONLY)
    counted = shares.groupBy("share", "checked", "label").count().collect()
    texts = lambda checked: np.array([
        sum(r["count"] for r in counted if r["label"] == label and checked in (r["checked"], None)) for label in (0, 1)
    ])
    parts = len({r["share"] for r in counted})
    model = Convolution.fresh(seed)
    if not texts(None).all():
        shares.unpersist()
        model.c[:] = 0
        model.shift = 4.0 if texts(None)[1] else -4.0
        return model
    learn, check = (False, True) if texts(False).all() and texts(True).all() else (None, None)
    _start(model, _seen(shares, learn), texts(learn))
    state = Learner.of(model).state()
    del model
    rounds = int(np.clip(np.ceil(VISITS * parts / texts(learn).sum()), LEAST_ROUNDS, ROUNDS))
    for numbers in [list(range(rounds))] if parts == 1 else [[k] for k in range(rounds)]:
        _learn(shares, state, learn, numbers, rounds, seed)
    model = Learner.from_state(state).model
    del state

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        size, group = 0, []
        for one in _texts(batches, check):
            group.append(one)
            size += len(one[1])
            if size >= STRETCH:
                yield raws(group)
                size, group = 0, []
        if group:
            yield raws(group)

    def raws(group):
        return pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in group], pa.int32()), pa.array([g[2] for g in group], pa.int32()),
             pa.array([g[3] for g in group], pa.string()), pa.array(shared.value.raw([g[1] for g in group]))],
            ["share", "label", "lang", "raw"],
        )

    raw = shares.mapInArrow(scored, "share int, label int, lang string, raw double").persist(StorageLevel.DISK_ONLY)

    def sums(work):
        def of_share(batches):
            found, share = None, 0
            for batch in (b for b in batches if b.num_rows):
                share = batch.column("share")[0].as_py()
                values = work(batch.column("raw").to_numpy(), batch.column("label").to_numpy())
                found = values if found is None else found + values
            if found is not None:
                yield pa.RecordBatch.from_pydict({"share": pa.array([share], pa.int32()), "sums": [found.tolist()]})

        parts = raw.mapInArrow(of_share, "share int, sums array<double>").collect()
        return np.sum([r["sums"] for r in sorted(parts, key=lambda r: r["share"])], axis=0)

    model.slope, model.shift = calibrated(sums)
    slope, shift = model.slope, model.shift

    def judged(batches):
        for batch in batches:
            values = _logistic(slope * batch.column("raw").to_numpy() + shift)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(values)], ["lang", "label", "score"])

    model.thresholds = best_thresholds(raw.mapInArrow(judged, "lang string, label int, score double"))
    model.threshold = model.thresholds.pop(None)
    raw.unpersist()
    shares.unpersist()
    shared.destroy()
    return model


def score(docs: DataFrame, model: Convolution, cut: float = CUT, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str | None = "lang") -> DataFrame:
    """For every row the id, `held_out` (its label was not for learning), `score` (0 to 1) of the whole text,
    `predicted` (1 from `cut` on), `threshold` (that of the row's language) and `flagged` (score at least that).

    Scores come from the text alone; the language only chooses the threshold.  A null or empty text is one without
    words and gets that one's score; equal texts score alike; null ids are not held out, null or rare languages have
    the threshold of all; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = column(lang_column).cast("string") if lang_column else F.lit(None).cast("string")
    rows = docs.select(
        column(id_column).alias("id"), held_out(id_column, FOLDS, FOLD).alias("held_out"), lang.alias("lang"),
        F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"),
    )
    names = [id_column, "held_out", "score", "predicted", "threshold", "flagged"]
    schema = (
        f"`{id_column}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int, "
        "threshold double, flagged boolean"
    )

    def run(batches):
        scorer = shared.value
        for whole in batches:
            for part in portions(whole):
                split = [words_of(t) for t in part.column(3).to_pylist()]
                slots = slots_of(word_hashes([w for s in split for w in s]))
                ends = np.cumsum([len(s) for s in split])
                s = scorer.score(scorer.raw(np.split(slots, ends[:-1])))
                limits = np.array([scorer.thresholds.get(k, scorer.threshold) for k in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32)),
                     pa.array(limits), pa.array(s >= limits)],
                    names,
                )

    return rows.mapInArrow(run, schema)
