import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spark_explore.llm import decontamination
from spark_explore.llm.decontamination import decontaminate, report

DOCS = "doc_id long, text string, start string, n string, k1 string, row string"
ITEMS = "item_id string, text string, words string"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def hits(text, windows):
    words = WORD.findall(lowered(text))
    marked, held = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            own = windows.get(tuple(words[i:i + n]))
            if own:
                marked |= set(range(i, i + n))
                held |= own
    return len(words), marked, held


def item_windows(items):
    out = {}
    for item, text, *_ in items:
        words = WORD.findall(lowered(text))
        n = min(len(words), 10)
        for i in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[i:i + n]), set()).add(item or "")
    return out


def tables(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "gamma", "straße", "İx", "東京", "9", "d-e"]

    def draw(n):
        return rng.choice([" ", ". ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(str(i), draw(rng.choice([2, 9, 10, 11, 30])), "x") for i in range(12)]
    items += [("9", "  "), ("3", None), (None, draw(12)), ("12", items[4][1]), ("12", items[4][1]), ("short", "Zeta ETA")]
    items = [(*i, "x")[:3] for i in items]
    docs = []
    for i in range(60):
        parts = [draw(rng.choice([0, 3, 40]))]
        for _ in range(rng.choice([0, 1, 3])):
            source = WORD.findall(rng.choice(items)[1] or "")
            a = rng.randrange(len(source) + 1)
            parts += [" ".join(source[a:]).upper(), draw(rng.choice([0, 5]))]
        docs.append((i, "; ".join(parts)))
    docs += [(100, None), (101, ""), (102, "--"), (None, docs[0][1]), (5, docs[0][1]), (5, docs[0][1])] + [(200 + i, docs[1][1]) for i in range(40)]
    return docs, items, spark.createDataFrame([(*d, "p", "q", "r", "s") for d in docs], DOCS).repartition(3), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("seed,set_rows", [(0, 10**6), (1, 17)])
def test_report_equals_brute_force(spark, seed, set_rows, monkeypatch):
    monkeypatch.setattr(decontamination.occurrences, "__defaults__", ("text", set_rows))
    docs, items, docs_df, items_df = tables(spark, seed)
    windows = item_windows(items)
    want = []
    for doc, text in docs:
        n, marked, held = hits(text, windows)
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        want.append((doc, n, len(marked), len(held), digest, bool(marked)))
    assert sum(w[5] for w in want) > 10
    assert sorted(map(tuple, report(docs_df, items_df).collect()), key=str) == sorted(want, key=str)


def test_removal_of_spans_and_documents(spark):
    docs, items, docs_df, items_df = tables(spark, 2)
    windows = item_windows(items)
    want, kept = [], []
    for doc, text in docs:
        _, marked, _ = hits(text, windows)
        if not marked:
            want.append((doc, text))
            kept.append((doc, text))
        else:
            places = [m.start() for m in WORD.finditer(text)] + [len(text)]
            pieces = [text[a:b] for i, (a, b) in enumerate(zip(places, places[1:])) if i not in marked]
            want.append((doc, text[:places[0]] + "".join(pieces)))
    cleaned = decontaminate(docs_df, items_df)
    assert cleaned.columns == docs_df.columns
    assert sorted(map(tuple, cleaned.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    gone = decontaminate(docs_df, items_df, "documents")
    assert sorted(map(tuple, gone.select("doc_id", "text").collect()), key=str) == sorted(kept, key=str)
    with pytest.raises(ValueError):
        decontaminate(docs_df, items_df, "words")


def test_empty_tables_and_long_texts(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert report(none, no_items).count() == 0
    text = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text, "", "", "", "")], DOCS)
    assert [tuple(r)[1:4] for r in report(docs, no_items).collect()] == [(200_000, 0, 0)]
    assert decontaminate(docs, no_items).first()["text"] == text
    items = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(150_000, 150_025)), "")], ITEMS)
    assert [tuple(r)[1:4] for r in report(docs, items).collect()] == [(200_000, 25, 1)]
    assert report(none, items).count() == 0


def test_windows_are_never_shuffled_and_stay_in_the_jvm(spark, capsys):
    rows = spark.createDataFrame([(1, "a b c")], "k1 long, text string").select("k1", decontamination.words(F.col("text")).alias("words"))
    found = decontamination._windows(rows, [2]).join(F.broadcast(spark.range(3).toDF("h")), "h", "left_semi").select("k1", "start", "n")
    found.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan and "InArrow" not in plan
