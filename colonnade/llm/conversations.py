"""Repair of conversation structure: the cheapest edits that make roles alternate, by block tables (Four Russians)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.common import column
from colonnade.session import stage

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: What may have been said before: nothing, the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each of them, what an initial leads to, and where the one role that may be inserted or given leads.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GIVEN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Symbols of rows: initial (s, u, a, other) and whether truncated; a row that must go; none (fills up the last block).
INITIALS = "sua"
MUST_GO, NONE, SYMBOLS = 8, 9, 10
#: Symbols of a block, and rows of a segment of a long conversation.
BLOCK = 4
SEGMENT_ROWS = 4096


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs-to-go where a missing turn may be inserted first."""
    for _ in range(4):
        costs = [min(c, INSERT + costs[KEEP[q, GIVEN[q]]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _options(q: int, symbol: int) -> list[tuple[str, int, int]]:
    """Edits of a row said after state `q`, by their letter: its letter, its cost, the state it leads to."""
    found = [("D", DELETE, q)]
    if symbol < MUST_GO:
        extra, initial = TRUNCATED * (symbol >= 4), "sua?"[symbol % 4]
        if (q, initial) in KEEP:
            found.append(("K", extra, KEEP[q, initial]))
        found.append(("R", REROLE + extra, KEEP[q, GIVEN[q]]))
    return found


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs-to-go before a row, from those behind it."""
    if symbol == NONE:
        return costs
    return _inserted([min(c + costs[to] for _, c, to in _options(q, symbol)) for q in range(4)])


@dataclass
class Tables:
    """Cost vectors to go, less their least entry, by number; `step` leads from the one behind a row to the one before it,
    `blocks` does so for every block of symbols.  `letters`, `cost` and `to` say, for the vector behind a row, its symbol
    and the state before it, what the ASCII-least cheapest edits do: insertions and one edit of the row."""

    vectors: list[tuple[int, ...]]
    step: np.ndarray
    blocks: np.ndarray
    letters: list[str]
    letter: np.ndarray
    cost: np.ndarray
    to: np.ndarray


#: After the last row: nothing is missing after an assistant's turn or at the very start.
END = _inserted([0, 99, 99, 0])
LAST = 0


@lru_cache(1)
def tables() -> Tables:
    norm = lambda v: tuple(c - min(v) for c in v)
    vectors, number, steps = [norm(END)], {norm(END): LAST}, []
    for v in vectors:  # grows while new ones are met
        steps.append([])
        for symbol in range(SYMBOLS):
            new = norm(_before(v, symbol))
            if new not in number:
                number[new] = len(vectors)
                vectors.append(new)
            steps[-1].append(number[new])
    step = np.array(steps, np.int16)
    # A block is read backward: its last symbol leads first.
    blocks = np.arange(len(vectors), dtype=np.int16)[:, None]
    for _ in range(BLOCK):
        blocks = np.stack([blocks[step[:, s]] for s in range(SYMBOLS)], axis=2).reshape(len(vectors), -1)
    letters, code = [""], {"": 0}
    shape = (len(vectors), SYMBOLS, 4)
    letter, cost, to = np.zeros(shape, np.int16), np.zeros(shape, np.int64), np.zeros(shape, np.int8)
    for v, symbol, q in product(range(len(vectors)), range(SYMBOLS), range(4)):
        done, paid, at = "", 0, q
        while symbol != NONE:
            here = _before(vectors[v], symbol)
            moves = [(x, c, n, vectors[v][n]) for x, c, n in _options(at, symbol)]
            moves.append(("I", INSERT, KEEP[at, GIVEN[at]], here[KEEP[at, GIVEN[at]]]))
            x, c, n = min((x, c, n) for x, c, n, rest in moves if c + rest == here[at])
            done, paid, at = done + x, paid + c, n
            if x != "I":
                break
        letter[v, symbol, q] = code.setdefault(done, len(code))
        if len(code) > len(letters):
            letters.append(done)
        cost[v, symbol, q], to[v, symbol, q] = paid, at
    return Tables(vectors, step, blocks, letters, letter, cost, to)


def closing(q: int) -> str:
    """Initials of the turns inserted after the last row."""
    out = ""
    while q in (SYSTEM, USER):
        out += GIVEN[q]
        q = KEEP[q, GIVEN[q]]
    return out


@dataclass
class Blocks:
    """Symbols of many segments, filled up to whole blocks: place of each row, blocks of each segment, their codes."""

    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    symbols: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, lengths: np.ndarray) -> Blocks:
        count = -(-lengths // BLOCK)
        first = np.cumsum(count) - count
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.repeat(first, lengths) * BLOCK + within
        padded = np.full(int(count.sum()) * BLOCK, NONE, np.int64)
        padded[place] = symbols
        padded = padded.reshape(-1, BLOCK)
        return cls(place, first, count, padded, padded @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def rounds(self):
        """Segments that have an r-th block, for each r, with its place."""
        order = np.argsort(-self.count, kind="stable")
        for r in range(int(self.count.max(initial=0))):
            mine = order[: np.searchsorted(-self.count[order], -r)]
            yield mine, self.first[mine] + r


def backward(found: Blocks, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector behind every block, and the one before every segment, by one lookup a block from the last one on."""
    t, vector = tables(), behind.astype(np.int16).copy()
    after = np.zeros(len(found.codes), np.int16)
    for mine, block in reversed(list(found.rounds())):
        after[block] = vector[mine]
        vector[mine] = t.blocks[vector[mine], found.codes[block]]
    return after, vector


def traced(found: Blocks, after: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks expanded in the order opposite to that of the lookups, from the first row on, with costs to go known
    behind every row: of equally cheap edits the least letter is right, whatever follows.  Letters and costs of all
    rows, the states they lead to, and the state after each segment."""
    t, state = tables(), state.astype(np.int8).copy()
    letter, to = np.zeros(found.symbols.shape, np.int16), np.zeros(found.symbols.shape, np.int8)
    cost = np.zeros(found.symbols.shape, np.int64)
    for mine, block in found.rounds():
        behind = [after[block]]
        for j in range(BLOCK - 1, 0, -1):
            behind.append(t.step[behind[-1], found.symbols[block, j]])
        for j, vector in enumerate(reversed(behind)):
            at = vector, found.symbols[block, j], state[mine]
            letter[block, j], cost[block, j] = t.letter[at], t.cost[at]
            to[block, j] = state[mine] = t.to[at]
    flat = lambda x: x.reshape(-1)[found.place]
    return flat(letter), flat(cost), flat(to), state


def conversation_key(conv_column: str) -> Column:
    """A text for every conversation, also for null."""
    return F.coalesce(F.concat(F.lit("="), column(conv_column).cast("string")), F.lit(""))


def _last_sign(text: Column) -> Column:
    """The last character that is no white space."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


@dataclass
class Repair:
    """`report`: one row a conversation.  `edits`: one row a segment of a conversation.  `texts`: the rows as given."""

    report: DataFrame
    edits: DataFrame
    texts: DataFrame

    def rows(self) -> DataFrame:
        """The repaired conversations: `key`, `conv`, `place` and `part` (together their order), `role`, `text`."""
        found = self._rows()
        copied = self.edits.filter(F.exists("rows", lambda r: r["copies"] > 1)).limit(1).count()
        return found.dropDuplicates(["place", "part"]) if copied else found

    def _rows(self) -> DataFrame:
        """Edits meet the texts by content, which splits a conversation of any length; rows equal in conversation, turn,
        role and text are one place and may stand here as often as they were given."""
        each = self.edits.select("key", "conv", F.inline(F.arrays_zip("rows", "letters", "given", "before")))
        each = each.select("key", "conv", "rows.*", "letters", "given", "before")
        kept = each.filter(F.right("letters", F.lit(1)).isin("K", "R"))
        keys = [F.col("e." + c).eqNullSafe(F.col("t." + c)) for c in ("key", "turn", "role", "one", "two")]
        met = self.texts.alias("t").join(kept.alias("e"), keys[0] & keys[1] & keys[2] & keys[3] & keys[4])
        met = met.select("e.key", "e.conv", F.col("e.pos").alias("place"), F.lit(0).alias("part"),
                         F.coalesce("e.given", "e.role").alias("role"), "t.text")
        name = F.when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role")
        made = each.filter("before <> ''").select("key", "conv", "pos", F.posexplode(F.split("before", "")).alias("n", "initial"))
        ends = self.edits.filter("closing <> ''").select(
            "key", "conv", F.element_at("rows", -1)["pos"].alias("pos"), F.posexplode(F.split("closing", "")).alias("n", "initial")
        )
        rows = made.select("key", "conv", F.col("pos").alias("place"), (F.col("n") - 100).alias("part"), name, F.lit("").alias("text"))
        rows = rows.union(ends.select("key", "conv", F.col("pos").alias("place"), (F.col("n") + 1).alias("part"), name, F.lit("").alias("text")))
        return met.union(rows)

    def digests(self) -> DataFrame:
        """`key` and `sha256` of each conversation's repaired `role:text` lines.

        A conversation's rows pass one hasher in order, for a hash can't be split; they stream, nothing is gathered."""
        ordered = self._rows().repartition("key").sortWithinPartitions("key", "place", "part")
        lines = ordered.select("key", F.concat("role", F.lit(":"), "text").alias("line"), "place", "part")

        def run(batches):
            key = state = at = None
            for batch in batches:
                done = []
                for k, line, *here in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                    if here == at:
                        continue
                    at = here
                    if k != key:
                        if state:
                            done.append((key, state.hexdigest()))
                        key, state = k, hashlib.sha256(line.encode())
                    else:
                        state.update(b"\n" + line.encode())
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "sha256"])
            if state:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "sha256"])

        return lines.mapInArrow(run, "key string, sha256 string")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, conv_column: str = "conv_id", turn_column: str = "turn",
           role_column: str = "role", text_column: str = "text") -> Repair:
    """The cheapest repair of every conversation, so that roles begin by `s?(ua)+` or nothing is left.

    Rows go by turn, nulls first, equal turns by role and a hash of the text.  A row without a character other than
    white space is blank; one whose role and text stood before is a duplicate; both must go.  One that doesn't end in
    `.`, `!` or `?` is truncated.  Edits: keep (0), give another role (1), delete (2), insert an empty turn (5); a
    truncated row that stays costs 5.  Of equally cheap edits the ASCII-least letters K, R, D, I are taken.

    Null roles and texts count as one space; null conversations are one conversation; a null turn is before the
    others.  Equal rows are one place and its copies, counted before they are shuffled.  An empty table gives empty
    results; other columns are not read.  `report` has `key` and `conv` (the conversation), `gaps`, `blank`,
    `duplicate`, `truncated`, `illegal`, `cost` and `audit`; conversations without rows are not in it.

    All rows are ordered by a range shuffle, so that a conversation of any length is dealt over many tasks, and cut into
    segments of `segment_rows` rows.  A segment is a map from the vector behind it to the one before it; only these maps
    and then one state a segment are chained in order of the conversation: for a billion rows, a quarter of a million.
    """
    texts = rows.select(
        conversation_key(conv_column).alias("key"), column(conv_column).alias("conv"), column(turn_column).alias("turn"),
        F.coalesce(column(role_column).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(column(text_column).cast("string"), F.lit(" ")).alias("text"),
    )
    texts = texts.select("*", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"))
    sign = _last_sign(F.col("text"))
    light = texts.select(
        "key", "conv", "turn", "role", "one", "two", (sign == "").alias("blank"), (~sign.isin(".", "!", "?")).alias("cut")
    )
    place = ["key", "turn", "role", "one", "two"]
    light = light.groupBy(*place, "conv").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    ordered = light.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered = stage(ordered.withColumn("pos", F.monotonically_increasing_id()))

    again = ordered.filter("NOT blank").groupBy("key", "role", "one", "two").agg(F.min("pos").alias("least"), F.count("*").alias("n"))
    again = again.filter("n > 1").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    dealt = ordered.withColumn("salt", F.pmod("pos", F.lit(8)).cast("int"))
    seen = dealt.join(again, ["key", "role", "one", "two", "salt"], "left").withColumn("first", F.coalesce(F.col("pos") <= F.col("least"), F.lit(True)))
    initial = F.left("role", F.lit(1))
    symbol = F.when(F.col("blank") | ~F.col("first"), MUST_GO).otherwise(
        F.coalesce(*[F.when(initial == c, k) for k, c in enumerate(INITIALS)], F.lit(3)) + F.when(F.col("cut"), 4).otherwise(0)
    )
    long_ones = ordered.groupBy("key").count().filter(F.col("count") > segment_rows).select("key")
    is_long = long_ones.limit(1).count() > 0
    segment = F.lit(0).cast("long")
    if is_long:
        seen = seen.join(long_ones.withColumn("long", F.lit(True)), "key", "left")
        segment = F.when(F.col("long"), F.floor(F.col("pos") / segment_rows)).otherwise(segment)
    fields = F.struct("pos", "turn", "role", "one", "two", "copies", "blank", "first", symbol.alias("symbol"))
    segments = seen.groupBy("key", "conv", segment.alias("segment")).agg(F.sort_array(F.collect_list(fields)).alias("rows"))
    if is_long:
        segments = stage(segments)
        segments = _chained(segments, long_ones)
    else:
        segments = segments.withColumn("behind", F.lit(LAST)).withColumn("state", F.lit(START)).withColumn("last", F.lit(True))
    edits = stage(_edited(segments))
    return Repair(_report(edits), edits, texts)


def _lists(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray]:
    rows = batch.column("rows")
    return rows.flatten(), np.diff(rows.offsets.to_numpy())


def _field(values: pa.StructArray, name: str) -> pa.Array:
    return values.field(values.type.get_field_index(name))


def _symbols(batch: pa.RecordBatch) -> Blocks:
    values, lengths = _lists(batch)
    return Blocks.of(_field(values, "symbol").to_numpy().astype(np.int64), lengths)


def _chained(segments: DataFrame, long_ones: DataFrame) -> DataFrame:
    """Segments with the vector behind them and the state before them."""
    mine = segments.join(long_ones, "key", "left_semi")

    def maps(batches):
        v = len(tables().vectors)
        for batch in batches:
            found = _symbols(batch)
            ids = np.stack([backward(found, np.full(batch.num_rows, k))[1] for k in range(v)], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("segment"), pa.array([r.tobytes() for r in ids], pa.binary())], ["key", "segment", "map"]
            )

    def behind(batches):
        for batch in batches:
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, vector = [], LAST
                for part in reversed(parts):
                    out.append(vector)
                    vector = int(np.frombuffer(part["map"], np.int16)[vector])
                yield _rows(key, [p["segment"] for p in parts], out[::-1], "behind")

    def ends(batches):
        for batch in batches:
            found = _symbols(batch)
            after, _ = backward(found, batch.column("behind").to_numpy())
            to = np.stack([traced(found, after, np.full(batch.num_rows, q))[3] for q in range(4)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("segment"), pa.array([r.tobytes() for r in to], pa.binary())], ["key", "segment", "map"]
            )

    def states(batches):
        for batch in batches:
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, state = [], START
                for part in parts:
                    out.append(state)
                    state = int(np.frombuffer(part["map"], np.int8)[state])
                yield _rows(key, [p["segment"] for p in parts], out, "state")

    def chain(found: DataFrame, step, name: str) -> DataFrame:
        parts = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("segment", "map"))).alias("parts"))
        return parts.mapInArrow(step, f"key string, segment long, {name} int, last boolean")

    kind = "key string, segment long, map binary"
    right = stage(chain(mine.select("key", "segment", "rows").mapInArrow(maps, kind), behind, "behind"))
    known = mine.join(right, ["key", "segment"])
    left = stage(chain(known.select("key", "segment", "rows", "behind").mapInArrow(ends, kind), states, "state"))
    return segments.join(right, ["key", "segment"], "left").join(left.drop("last"), ["key", "segment"], "left").select(
        *segments.columns, F.coalesce("behind", F.lit(LAST)).alias("behind"), F.coalesce("state", F.lit(START)).alias("state"),
        F.coalesce("last", F.lit(True)).alias("last"),
    )


def _rows(key: str, segments: list[int], values: list[int], name: str) -> pa.RecordBatch:
    n = len(segments)
    return pa.RecordBatch.from_arrays(
        [pa.array([key] * n), pa.array(segments, pa.int64()), pa.array(values, pa.int32()), pa.array([k == n - 1 for k in range(n)])],
        ["key", "segment", name, "last"],
    )


def _edited(segments: DataFrame) -> DataFrame:
    """Every segment with the edits of its rows, in letters, and what the report sums up."""
    conv, rows = segments.schema["conv"].dataType.simpleString(), segments.schema["rows"].dataType.simpleString()
    sums = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]

    def run(batches):
        t = tables()
        letters = np.array(t.letters, dtype=object)
        before = np.array(["".join(_roles_before(w, q)) for w in t.letters for q in range(4)], dtype=object).reshape(-1, 4)
        given = np.array([None, None, ROLES["u"], ROLES["a"]], dtype=object)
        rerole = np.array([w.endswith("R") for w in t.letters])
        for batch in batches:
            values, lengths = _lists(batch)
            symbol, copies = (_field(values, n).to_numpy().astype(np.int64) for n in ("symbol", "copies"))
            blank, first = (_field(values, n).to_numpy(zero_copy_only=False) for n in ("blank", "first"))
            found = Blocks.of(symbol, lengths)
            after, _ = backward(found, batch.column("behind").to_numpy())
            start = batch.column("state").to_numpy()
            code, cost, to, state = traced(found, after, start)
            starts = np.cumsum(lengths) - lengths
            came = np.concatenate([[START], to[:-1]])
            came[starts] = start
            cost = cost + DELETE * (copies - 1)
            edit, told = letters[code], before[code, came]
            roles = np.where(rerole[code], given[to], None)
            last = batch.column("last").to_numpy(zero_copy_only=False)
            closes = [closing(q) if end else "" for q, end in zip(state, last)]
            whole = edit.copy()
            for k in np.flatnonzero(copies > 1):
                whole[k] = edit[k] + "D" * int(copies[k] - 1)
            pairs, turns = _neighbours(values, starts)
            counts = {
                "blank": np.where(blank, copies, 0), "duplicate": np.where(blank, 0, copies - first),
                "truncated": (symbol >= 4) & (symbol < MUST_GO), "illegal": pairs + copies - 1, "cost": cost, "turns": turns,
            }
            totals = {n: np.add.reduceat(c.astype(np.int64), starts) for n, c in counts.items()}
            totals["cost"] = totals["cost"] + np.array([INSERT * len(c) for c in closes])
            audit = ["".join(whole[a : a + n]) + "I" * len(c) for a, n, c in zip(starts, lengths, closes)]
            offsets = pa.array(np.append(starts, len(symbol)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.string())) for x in (edit, roles, told)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in ("key", "conv", "segment", "rows")], *lists, pa.array(closes), pa.array(audit),
                 *[pa.array(totals[n]) for n in sums]],
                ["key", "conv", "segment", "rows", "letters", "given", "before", "closing", "audit", *sums],
            )

    return segments.mapInArrow(
        run, f"key string, conv {conv}, segment long, rows {rows}, letters array<string>, given array<string>, "
        f"before array<string>, closing string, audit string, {', '.join(n + ' long' for n in sums)}"
    )


def _roles_before(letters: str, q: int) -> list[str]:
    out = []
    for _ in range(letters.count("I")):
        out.append(GIVEN[q])
        q = KEEP[q, GIVEN[q]]
    return out


def _neighbours(values: pa.StructArray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, whether its role can't follow the one before it in its segment, and whether its turn is another one
    and not null."""
    roles = np.array([r[:1] for r in _field(values, "role").to_pylist()], dtype=object)
    joined = np.concatenate([[""], roles[:-1] + roles[1:]])
    illegal = ~np.isin(joined, ["su", "ua", "au"])
    illegal[starts] = False
    turn = _field(values, "turn")
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    number = np.array(turn.to_pylist(), dtype=object)
    new = np.concatenate([[True], number[1:] != number[:-1]]) & known
    new[starts] = known[starts]
    return illegal, new


def _report(edits: DataFrame) -> DataFrame:
    """One row a conversation: sums over its segments, and what happens where two segments meet."""
    head, tail = F.element_at("rows", 1), F.element_at("rows", -1)
    ends = edits.select(
        "key", "conv", "segment", "blank", "duplicate", "truncated", "illegal", "cost", "turns", "audit",
        head.alias("head"), tail.alias("tail"), F.array_min(F.col("rows")["turn"]).alias("low"), F.array_max(F.col("rows")["turn"]).alias("high"),
    )
    previous = F.lag("tail").over(Window.partitionBy("key").orderBy("segment"))
    ends = ends.withColumn("previous", previous)
    pair = F.concat(F.left(F.col("previous")["role"], F.lit(1)), F.left(F.col("head")["role"], F.lit(1)))
    met = F.col("previous").isNotNull() & ~pair.isin("su", "ua", "au")
    same = F.coalesce(F.col("previous")["turn"] == F.col("head")["turn"], F.lit(False))
    total = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "cost")]
    parts = F.sort_array(F.collect_list(F.struct("segment", "audit")))
    found = ends.groupBy("key", "conv").agg(
        *total, F.sum(F.col("illegal") + met.cast("long")).alias("illegal"), F.sum(F.col("turns") - same.cast("long")).alias("turns"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"),
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return found.select("key", "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
