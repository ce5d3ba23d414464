import hashlib
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest

from colonnade.llm import conversations, queries

GOOD = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Rows of one conversation in order, with their first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, letters) and the repaired rows, by trying every edit at every place."""
    n = len(rows)

    @lru_cache(None)
    def best(i, q):
        # q: what the last kept initial was ('' at the start)
        tries = []
        if i == n:
            if q in ("", "a"):
                return 0, "", ()
        else:
            cost, letters, rest = best(i + 1, q)
            tries.append((2 + cost, "D" + letters, rest))
            if found[i] not in ("blank", "duplicate"):
                extra = 5 * (found[i] == "truncated")
                role, text = rows[i][1:]
                for letter, paid, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (q, new[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        cost, letters, rest = best(i + 1, new[:1])
                        tries.append((paid + extra + cost, letter + letters, ((new, text), *rest)))
        new = "assistant" if q == "u" else "user"
        if inserted[0] < 3:
            inserted[0] += 1
            cost, letters, rest = best.__wrapped__(i, new[:1])
            inserted[0] -= 1
            tries.append((5 + cost, "I" + letters, ((new, ""), *rest)))
        return min(tries) if tries else (10**6, "", ())

    inserted = [0]
    return best(0, "")


def brute(rows):
    """The contract, row by row, over (conv, turn, role, text) as given; turns are unique in a conversation."""
    groups, names = defaultdict(list), {}
    for conv, turn, role, text in rows:
        key = " " if conv is None else str(conv)
        names[key] = conv
        groups[key] += []
        fault = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        groups[key] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return [(names[key], *judged(found)) for key, found in groups.items()]


def judged(found):
    found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))
    said = faults(found)
    turns = {r[0] for r in found if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    cost, audit, rest = cheapest(found, said)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rest).encode()).hexdigest()
    assert GOOD.match("".join(r[:1] for r, _ in rest))
    return (gaps, *(said.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.table(spark, sf, "conversations").collect()
    assert listed(queries.op13_conversation_repair(spark, sf)) == sorted(brute(rows), key=str)


@pytest.fixture
def odd():
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a", "ü"]
    texts = [None, "", " \t", "Hm.", "Hm. ", "no end", "?", "! ", "é.", "x" * 100_000 + ".", "line\nline.", "..", "Hm.", "a b"]
    rows = []
    for conv in [None, *range(150)]:
        for turn in rng.choice([None, *range(-3, 30)], rng.integers(1, 14), replace=False):
            rows.append((conv, turn, roles[rng.choice(9, p=[.3, .3, .1, .1, .04, .04, .04, .04, .04])], texts[rng.integers(len(texts))]))
    return rows


@pytest.mark.parametrize("segment_rows", [1, 2, 5, 4096])
def test_odd_rows_and_segments(spark, odd, segment_rows):
    rows = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS rows", "3 AS pos", "4 AS one")
    found = conversations.repair(queries.damaged(rows), segment_rows)
    got = {(r.conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.report.collect()}
    want = brute(odd)
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {r[:8] for r in want if r[1:] != (0, 0, 0, 0, 0, 0, "", empty)}
    digests = dict(map(tuple, found.digests().collect()))
    assert digests == {"" if r[0] is None else f"={r[0]}": r[8] for r in want if r[8] != empty}
    texts = defaultdict(list)
    for r in sorted(found.rows().collect(), key=lambda r: (r.place, r.part)):
        texts[r.key].append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()} == digests


def test_repeated_rows_are_places_once(spark):
    rows = [(1, 0, "user", "Hm."), (1, 1, "assistant", "So.")] * 50 + [(1, 2, "user", "Hm.")] * 3
    found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    one = found.report.first()
    assert one.audit == "K" + "D" * 49 + "K" + "D" * 49 + "DDD" and one.cost == 2 * 101 and one.duplicate == 101 and one.illegal == 100
    assert [tuple(r) for r in found.rows().orderBy("place").select("role", "text").collect()] == [("user", "Hm."), ("assistant", "So.")]


def test_a_long_conversation_is_chained(spark):
    rng = np.random.default_rng(5)
    rows = [(7, k, ["user", "assistant", "system", "tool"][rng.choice(4, p=[.45, .45, .05, .05])], f"{rng.integers(400)}{'.' * (rng.random() < .9)}") for k in range(240)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (conversations.repair(frame, n) for n in (4096, 16))
    assert listed(whole.report) == listed(cut.report) and listed(whole.digests()) == listed(cut.digests())
    assert cut.edits.count() > 12
    r = whole.report.first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, whole.digests().first().sha256) == judged([r[1:] for r in rows])


def test_blocks_agree_with_single_steps():
    t = conversations.tables()
    assert len(t.vectors) < 100 and all(min(v) == 0 for v in t.vectors)
    rng = np.random.default_rng(6)
    for _ in range(200):
        symbols, v = rng.integers(0, 10, 4), int(rng.integers(len(t.vectors)))
        code = int(symbols @ [1000, 100, 10, 1])
        at = v
        for s in symbols[::-1]:
            at = t.step[at, s]
        assert t.blocks[v, code] == at


def test_every_short_conversation():
    """All symbols of up to three rows: letters and cost of the tables against trying everything."""
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    cases = [c for n in range(1, 4) for c in product(range(8), repeat=n)]
    lengths = np.array([len(c) for c in cases])
    found = conversations.Blocks.of(np.array([s for c in cases for s in c]), lengths)
    after, _ = conversations.backward(found, np.full(len(cases), conversations.LAST))
    letter, cost, _, state = conversations.traced(found, after, np.zeros(len(cases), int))
    at = 0
    for k, case in enumerate(cases):
        rows = [(i, roles["suao"[s % 4]], f"{i}") for i, s in enumerate(case)]
        want = cheapest(rows, ["truncated" if s >= 4 else "" for s in case])
        end = conversations.closing(int(state[k]))
        letters = "".join(conversations.tables().letters[c] for c in letter[at : at + len(case)]) + "I" * len(end)
        assert (cost[at : at + len(case)].sum() + 5 * len(end), letters) == want[:2], case
        at += len(case)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = conversations.repair(rows)
    assert found.report.count() == found.digests().count() == found.rows().count() == 0
