import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from spark_explore.llm import conversation_trie as trie
from spark_explore.llm.conversation_trie import Parens

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner string"


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)

    order = sorted(members, key=len, reverse=True)
    leaves, saved = {}, {}
    for s in order:
        below = children.get(s, [])
        leaves[s] = sum(leaves[b] for b in below) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", s[-1][1])) if s else 0
        saved[s] = sum(saved[b] for b in below) + (len(members[s]) - 1) * words
    out = []
    for s in order:
        ends = sorted(c for c in members[s] if len(convs[c]) == len(s))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(children.get(s, [])), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def answer(spark, rows, **how):
    return sorted((tuple(r) for r in trie.nodes(*trie.rebuilt(table(spark, rows).repartition(3)), **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "LEVELS", 2)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 200), 70):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["u", "a", None]), rng.choice(["", "one two", "a b c", None, "é　x\ty"])))
    rows += [(7, None, "s", "null turn"), (7, 1, "u", "tie"), (7, 1, "u", "tie"), (None, 0, "u", "nobody")]
    rows += [(1000 + c, t, "u", f"same {t}") for c in range(60) for t in range(4)]  # a third of all conversations are copies
    assert answer(spark, rows, shard=[3, 7, 1000][seed]) == brute(rebuild(rows))


def test_trie_with_one_conversation_of_most_turns(spark):
    rows = [(40, t, "u", f"w{t}") for t in range(3000)] + [(41 + c, t, "u", f"w{t}") for c in range(5) for t in range(100 * c)]
    rows += [(300, 0, "u", "alone")]
    assert answer(spark, rows, shard=64) == brute(rebuild(rows))


def test_trie_without_rows_and_with_turnless_conversations(spark):
    assert answer(spark, []) == []
    rows = [(c, 0, "u", "gone") for c in range(1, 30) if c % 20]
    assert answer(spark, rows) == brute(rebuild(rows))


def test_long_texts_count_their_words(spark):
    rows = [(20, 0, "u", "word " * 200_000), (1, 0, "u", "x"), (21, 0, "u", "y"), (22, 0, "u", "z"), (23, 0, "u", "y")]
    assert answer(spark, rows) == brute(rebuild(rows))


def test_findclose_is_the_end_of_each_subtree():
    rng = np.random.default_rng(3)
    for size in (1, 2, 63, 64, 65, 5000):
        depth = np.empty(size, np.int64)
        depth[0] = 40
        for i in range(1, size):
            depth[i] = max(0, depth[i - 1] + 1 - rng.geometric(0.45) + 1 if rng.random() < 0.9 else depth[i - 1] + 1)
            depth[i] = min(depth[i], depth[i - 1] + 1)
        parens = Parens(depth)
        close = parens.findclose()
        for i in range(size):
            later = np.nonzero(depth[i + 1:] <= depth[i])[0]
            if len(later):
                assert parens.rank[close[i]] == i + 1 + later[0]
            else:
                assert close[i] == -1
