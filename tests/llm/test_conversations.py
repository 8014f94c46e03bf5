"""The prefix trie and the repair of conversations beside brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T
from samples import SF

from riskweave.llm import queries, repair, trie

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows, none):
    """Conversations as lists of (turn, role, text), ordered by turn, role and text."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, none if role is None else role, none if text is None else text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in found.items()}


def some_conversations(seed, n=60):
    """Conversations that share beginnings, break off, repeat, lack roles, texts and turns."""
    rng = random.Random(seed)
    said = ["Yes.", "no", "", "  \t", "What is it?", "A long answer.", "A long answer", "Ünïcode 🙂!", "w " * 300 + ".", None]
    rows = []
    for c in rng.sample(range(-50, 120), n):
        for turn in range(rng.randrange(9)):
            role = rng.choices(["system", "user", "assistant", "tool", None, ""], [1, 5, 5, 1, 1, 1])[0]
            if turn < 3 and rng.random() < 0.7:
                role, text = ("user", "assistant")[turn % 2], said[turn + c % 2]
            else:
                text = rng.choice(said)
            rows.append((c, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    rows += [r for r in rows if rng.random() < 0.05]
    return rows + [(2**62 + 5, 0, "user", "Yes."), (7, 3, "user", "x" * 50_000 + ".")]


def long_conversations():
    """Two long ones that part late, one of them with faults everywhere."""
    rng = random.Random(3)
    turn = lambda t: (("user", "assistant")[t % 2], f"{t} {'word ' * (t % 4)}{rng.choice(['.', ''])}")
    one = [(40, t, *turn(t)) for t in range(300)]
    two = [(41, t, r, x if t < 250 else x + "!") for _, t, r, x in one]
    odd = [(60, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["a.", f"{t}.", f"{t}", " "])) for t in range(400)]
    return one + two + odd


def brute_trie(rows):
    convs = in_order([r for r in rows if r[0] is not None], "")
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = [r[1:] for r in convs.get(leader, [])[:h] + own[h:]]
    members = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def sums(node):
        below = [sums(x) for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        return max(1, sum(leaves for leaves, _ in below)), own + sum(saved for _, saved in below)

    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *sums(node),
                   sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node)))))) for node, m in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("size", [trie.TrieSize(), trie.TrieSize(7, 2), trie.TrieSize(1, 1)])
def test_trie(spark, size):
    for seed in (1, 2):
        rows = some_conversations(seed) + [(None, 1, "user", "nobody")]
        given = spark.createDataFrame(rows, CONVERSATIONS)
        found = trie.with_end_digests(*trie.prefix_trie(trie.rebuilt(given), size)).select(NODE).collect()
        assert sorted(map(tuple, found)) == brute_trie(rows)


def test_trie_of_long_conversations(spark):
    import sys

    sys.setrecursionlimit(5000)
    rows = long_conversations()
    found = trie.with_end_digests(*trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, CONVERSATIONS))))
    assert sorted(map(tuple, found.select(NODE).collect())) == brute_trie(rows)


def table_rows(spark, name="conversations"):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_trie_query(spark):
    found = queries.op11_prefix_trie(spark, SF).select(NODE).collect()
    assert sorted(map(tuple, found)) == brute_trie(table_rows(spark))


def brute_damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if f == 1:
            text = ""
        elif f == 2:
            text = re.sub("[.!?]", "", text)
        elif f == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def brute_repair(rows, ids):
    """For each id the counts, the cheapest edits by trying all, and the repaired lines."""
    convs, found = in_order(rows, " "), []
    for c in ids:
        said = convs.get(c, [])
        seen, faults = set(), []
        for _, role, text in said:
            words = WORD.findall(text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen
                          else "truncated" if words[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @lru_cache(None)
        def best(i, state, depth=0):
            """(cost, initials, lines) of the rest, all being tried."""
            ways = [(0, "", ())] if i == len(said) and state in ("", "a") else []
            step = lambda cost, letter, line, rest: (cost + rest[0], letter + rest[1], line + rest[2])
            for role in ("user", "assistant"):
                to = grammar.get((state, role[0]))
                if to and depth < 3:
                    ways.append(step(5, "I", (role + ":",), best(i, to, depth + 1)))
                if to and i < len(said) and faults[i] not in ("blank", "duplicate"):
                    ways.append(step(1 + 5 * (faults[i] == "truncated"), "R", (f"{role}:{said[i][2]}",), best(i + 1, to)))
            if i < len(said):
                ways.append(step(2, "D", (), best(i + 1, state)))
                to = grammar.get((state, said[i][1][:1]))
                if to and faults[i] not in ("blank", "duplicate"):
                    ways.append(step(5 * (faults[i] == "truncated"), "K", (f"{said[i][1]}:{said[i][2]}",), best(i + 1, to)))
            return min(ways, default=(10**9, "", ()))

        for i in range(len(said), 0, -1):  # so that the recursion stays shallow
            for state in ("", "s", "u", "a"):
                best(i, state)
        cost, audit, lines = best(0, "")
        numbers = [t for t, *_ in said if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        first = [role[:1] for _, role, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
        found.append((c, gaps, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows):
    """What the query does, for rows as they are."""
    from pyspark.sql import functions as F

    found, plan, _ = repair.repair_conversations(rows)
    found = found.join(repair.digests(repair.repaired_rows(rows, plan, whole=True)), "conv", "left")
    found = found.withColumn("conv_id", F.col("conv").try_cast("bigint")).fillna(sha(""), ["repaired_sha256"])
    return sorted(map(tuple, found.select(REPAIR).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("least_block", [1, 3, 64])
def test_repair(spark, monkeypatch, least_block):
    monkeypatch.setattr(repair, "LEAST_BLOCK", least_block)
    for rows in (some_conversations(4) + [(None, 1, "user", "nobody."), (None, None, "assistant", None)], long_conversations()):
        given = spark.createDataFrame(rows, CONVERSATIONS)
        assert repaired(given) == brute_repair(rows, {r[0] for r in rows})


def test_repaired_rows_in_ranges(spark):
    rows = long_conversations()
    given = spark.createDataFrame(rows, CONVERSATIONS)
    _, plan, _ = repair.repair_conversations(given)
    whole = [tuple(r) for r in repair.repaired_rows(given, plan, whole=True).collect()]
    ranges = [tuple(r) for r in repair.repaired_rows(given, plan).collect()]
    by = lambda found: {c: [r for r in found if r[0] == c] for c in {r[0] for r in found}}
    assert by(whole) == by(ranges) and set(by(whole)) == {"40", "41", "60"}


def test_repair_query(spark):
    rows = table_rows(spark)
    found = sorted(map(tuple, queries.op12_repair(spark, SF).select(REPAIR).collect()))
    assert found == brute_repair(brute_damage(rows), {r[0] for r in rows})


def test_damage(spark):
    rows = some_conversations(6) + [(None, 1, "user", "nobody."), (None, None, None, None)]
    found = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)).collect()]
    assert sorted(found, key=repr) == sorted(brute_damage(rows), key=repr)


def test_empty_and_clashing(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], CONVERSATIONS)
    assert trie.with_end_digests(*trie.prefix_trie(trie.rebuilt(none))).count() == 0 and repaired(none) == []
    rows = some_conversations(8, 20)
    given = spark.createDataFrame(rows, CONVERSATIONS)
    for name in ("conv", "pos", "words", "key", "block", "tie1", "_at", "content", "turns", "leader", "edits", "fault"):
        given = given.withColumn(name, F.lit("own"))
    assert repaired(given) == brute_repair(rows, {r[0] for r in rows})
    found = trie.with_end_digests(*trie.prefix_trie(trie.rebuilt(given))).select(NODE).collect()
    assert sorted(map(tuple, found)) == brute_trie(rows)
