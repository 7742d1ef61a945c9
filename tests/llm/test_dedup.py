import random

import numpy as np
import pyarrow as pa
import pytest

from spark_explore.llm import line_dedup, minhash
from spark_explore.llm.components import components
from spark_explore.llm.shingles import byte_hashes, shingle_sets

SCHEMA = "doc_id long, text string, kept string, component_id string, line int"


def near_texts(seed):
    """Base texts with copies, light and heavy edits, and short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 12):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own).upper() if rng.random() < 0.1 else "\n".join([" ".join(own[:9]), " ".join(own[9:])]))
    return out + ["", None, " \t\n", "one", "one", "One two", "a b c d e", "a b c d e f", "é É", "é é"]


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked(sets, percent):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("seed,block,percent", [(0, 512, 85), (1, 3, 85), (2, 2, 80)])
def test_near_duplicates_equal_brute_force(spark, seed, block, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    own = near_texts(seed)
    sets = [shingles(t) for t in own]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(own)] + [(None, own[0], "x", "y", 1)], SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs, percent).collect()}
    want = linked(sets, percent)
    for i in range(len(own)):
        assert got[i] == (len(sets[i]), want[i], want[i] == i), own[i]
    assert got[None] == (len(sets[0]), None, True)


def test_an_id_with_several_texts_keeps_the_links_of_all(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (3, a), (9, c), (9, c), (8, c + " more"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(4)
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in minhash.near_duplicates(docs, 85).collect())
    assert got == sorted([(i, 3, i == 3) for i in (3, 5, 5, 6, 7)] + [(i, 8, i == 8) for i in (8, 9, 9)] + [(4, 4, True)] * 2)


def test_long_texts(spark):
    text = " ".join(f"w{i % 5000}x{i // 7}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text, "x", "y", 1), (2, text + " end", "x", "y", 1), (3, "w1 w2", "x", "y", 1)], SCHEMA)
    assert [r["component_id"] for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3]


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs).count() == 0
    assert line_dedup.removed_lines(docs).count() == 0


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(0)
    same = rng.random((400, minhash.HASHES)) < 0.7
    one = rng.integers(0, 2**32, same.shape, dtype=np.uint32)
    other = np.where(same, one, rng.integers(0, 2**32, same.shape, dtype=np.uint32))
    got = minhash.similarity(minhash.pack_bits(one), minhash.pack_bits(other))
    assert abs(got.mean() - 0.7) < 0.01 and minhash.similarity(minhash.pack_bits(one), minhash.pack_bits(one)).min() == 1


def test_hashes_do_not_depend_on_the_company():
    own = [b"a" * k for k in range(200)] + [b"word", "é".encode()]
    whole = byte_hashes(pa.array(own, pa.large_binary()))
    alone = [byte_hashes(pa.array([w], pa.large_binary()))[0] for w in own]
    assert whole.tolist() == alone and len(set(alone)) == len(own)
    sets, bounds = shingle_sets(pa.array(["x y " + "z" * 500 + " a b c", "q"]))
    again, _ = shingle_sets(pa.array(["x y " + "z" * 500 + " a b c"]))
    assert sets[:bounds[1]].tolist() == again.tolist()


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 25)] + [(99, 98), (98, 99), (5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(chain, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 10 for i in range(10, 26)}, 98: 98, 99: 98}


def removed_by_brute_force(rows, percent):
    lines = sorted((d, i, frozenset(line.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - {""})
                   for d, t in rows for i, line in enumerate((t or "").split("\n")))
    out = set()
    for k, (d, i, s) in enumerate(lines):
        if s and any(100 * len(s & o) >= percent * len(s | o) for *_, o in lines[:k]):
            out.add((d, i))
    return out


@pytest.mark.parametrize("seed,long_list,hot_list", [(0, 64, 8192), (1, 2, 3), (2, 3, 5), (3, 10**6, 8192)])
def test_lines_equal_brute_force(spark, seed, long_list, hot_list, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", long_list)
    monkeypatch.setattr(line_dedup, "HOT_LIST", hot_list)
    rng = random.Random(seed)
    pool = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 25))] for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            own = list(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 60)}"
            lines.append(" ".join(own))
        rows.append((d, "\n".join(lines)))
    rows += [(50, ""), (51, None), (52, "\n\n"), (53, "w1\nw1\n \nw1 w1"), (54, "w1")]
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows] + [(None, rows[0][1], "x", "y", 1)], SCHEMA).repartition(4)
    got = line_dedup.removed_lines(docs)
    want = removed_by_brute_force(rows, 80)
    assert {(r["doc_id"], r["line"]) for r in got.where("removed").collect()} == want
    assert got.count() == sum(len((t or "").split("\n")) for _, t in rows)
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in want)
        assert kept[d]["text"] == left and kept[d]["kept"] == "x"
    assert kept[None]["text"] == rows[0][1]


def test_a_large_group_of_variants_gives_no_row_per_pair(spark, monkeypatch):
    """Variants around the threshold: all partners look alike, so links are found in the blocks, not listed as pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    own = []
    for i in range(160):  # one word replaced; 0.84 similar, or more at the same place
        words = list(base)
        words[50 if i % 4 == 0 else rng.randrange(10, 110, 5)] = f"x{rng.randrange(10**6)}"
        own.append(" ".join(words))
    given = []
    real = minhash.cut_lineage

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            given.append(out.count())
        return out

    monkeypatch.setattr(minhash, "cut_lineage", counted)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(own)], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 85).collect()}
    want = linked([shingles(t) for t in own], 85)
    assert [got[i] for i in range(len(own))] == want
    assert len(set(want)) > 1 and max(map(want.count, want)) > 20
    assert max(given) < len(own) ** 2 // 8


def test_components_of_long_chains_keep_small_size_estimates(spark):
    """Each round starts from a table, so the plan's size does not grow from round to round."""
    rng = random.Random(3)
    names = rng.sample(range(10**6), 40)
    chain = spark.createDataFrame(list(zip(names[:-1], names[1:])), "a long, b long")
    labels = components(chain)
    assert {r[1] for r in labels.collect()} == {min(names)}
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_variants_of_a_line_give_no_row_per_pair(spark, monkeypatch):
    """Of many similar earlier lines only the likeliest comes out of the postings at first."""
    given = []
    real = line_dedup.cut_lineage

    def counted(df):
        out = real(df)
        if out.columns[:2] == ["a", "b"]:
            given.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    base = [f"w{i}" for i in range(30)]
    own = [" ".join([*base, f"x{k}"]) for k in range(120)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(own)], SCHEMA)
    gone = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(docs).collect()}
    assert [gone[i] for i in range(120)] == [False] + [True] * 119
    assert max(given) <= 120


def test_steps_of_line_dedup_leave_no_shuffle_files(spark):
    """Files of steps that are done don't wait for the driver's garbage collector; the session's setting stays."""
    import time
    from pathlib import Path

    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for f in folders for p in Path(f).rglob("shuffle_*.data")}
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g h i j\nx{i % 7} y z") for i in range(200)], "doc_id long, text string")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = files(), spark.conf.get(setting)
    found = line_dedup.removed_lines(docs)
    until = time.time() + 20
    while files() - held and time.time() < until:
        time.sleep(0.2)
    assert not files() - held
    assert spark.conf.get(setting) == before
    assert found.where("removed").count() == 199 + 193


def test_removed_lines_are_written_before_the_texts_are_joined(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "d e f\ng h i"), (3, None), (None, "a b c")], "doc_id long, text string")
    kept = line_dedup.dedup_lines(docs)
    assert "collect_list" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, (r["text"] for r in kept.collect()))) == sorted(map(repr, ["a b c\nd e f", "g h i", None, "a b c"]))


def test_a_posting_keeps_a_bounded_number_of_partners(spark, monkeypatch):
    """Undecided lines are not met a second time unless a posting had more partners; pairs are bounded by the postings."""
    met, given = [], []
    real, cut = line_dedup._meet, line_dedup.cut_lineage

    def meet(posted, lengths, percent, most=None):
        met.append(most)
        return real(posted, lengths, percent, most)

    def counted(df):
        out = cut(df)
        if {"a", "b"} <= set(out.columns):
            given.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_meet", meet)
    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    monkeypatch.setattr(line_dedup, "PAIRS", 64)
    base = [f"w{i:02}" for i in range(30)]
    # Below the threshold: 24 of 36 words in common, though they share postings.
    few = [" ".join([*base[:26], f"x{k}a", f"x{k}b", f"x{k}c", f"x{k}d"]) for k in range(2)]
    rows = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")
    assert line_dedup.removed_lines(rows).where("removed").count() == 0
    assert met == [line_dedup.NEAREST]
    given.clear()
    own = [" ".join([*base, f"x{k}"]) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    assert line_dedup.removed_lines(rows).where("removed").count() == 199
    assert max(given) <= 200 * 8 * line_dedup.NEAREST  # of 19 900


def test_lines_of_which_more_partners_are_cut_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    test_lines_equal_brute_force(spark, 1, 10**6, 8192, monkeypatch)


def test_sets_are_made_of_bounded_texts(monkeypatch):
    """Chunks of 6 MB took some 20 bytes a byte of text in every worker."""
    sizes = []
    real = minhash.shingle_sets
    monkeypatch.setattr(minhash, "shingle_sets", lambda column, width: sizes.append(column.nbytes) or real(column, width))

    class Docs:
        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [f"{i} a b c d e " * 60 for i in range(3000)]})
            return list(run(iter([batch])))

    assert sum(b.num_rows for b in minhash.features(Docs())) == 3000
    assert max(sizes) <= 1.1 * (1 << 20)


def test_postings_of_lines_travel_in_lists(spark, monkeypatch):
    """No row per posting, and no join of the postings with frequent words, which grew faster than the input."""
    met = []
    real = line_dedup._meet

    def meet(*given):
        met.append(real(*given))
        return met[-1]

    monkeypatch.setattr(line_dedup, "_meet", meet)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 % 50 + k}" for k in range(9))) for i in range(300)], "doc_id long, text string")
    line_dedup.removed_lines(docs)
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("names,values", [(("DEALT", "LONG_LIST", "HOT_LIST"), (16, 4, 3)), (("SPAN",), (1,))])
def test_lines_dealt_in_small_pieces_equal_brute_force(spark, names, values, monkeypatch):
    for name, value in zip(names, values):
        monkeypatch.setattr(line_dedup, name, value)
    test_lines_equal_brute_force(spark, 4, line_dedup.LONG_LIST, line_dedup.HOT_LIST, monkeypatch)


def test_lines_of_repeated_and_far_ids(spark):
    """Lines at equal places of texts that share an id are kept or removed together; ids may span all longs."""
    far = 2**63 - 1
    rows = [(-far, "a b c\nd e f"), (-far, "a b c\nd e f"), (-far, "x y z\nq"), (far, "a b c\nq\nnew one"), (far, None), (0, "d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {(r["doc_id"], r["line"]) for r in line_dedup.removed_lines(docs).where("removed").collect()}
    assert gone == {(far, 0), (far, 1), (0, 0)}
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect() if r["text"] is not None) == sorted(
        [(-far, "a b c\nd e f"), (-far, "a b c\nd e f"), (-far, "x y z\nq"), (far, "new one"), (0, "")])
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in line_dedup.summary(docs).collect()}
    assert got[0] == (1, 1, "0") and got[-far] == (6, 0, "") and got[far][0] == 4


def test_words_hashed_from_running_sums():
    from spark_explore.llm.shingles import hashed_words, word_sets, words

    rng = random.Random(2)
    texts = [None, "", " ", "a", "a", " x\ty\x0bz\r\n", "é ü é", "w" * 64, "w" * 65 + " " + "v" * 200_000 + " q"]
    texts += ["".join(rng.choice("ab \n\t\x1cé") for _ in range(rng.choice([20, 40, 150_000]))) for _ in range(60)]
    column = pa.array(texts)
    hashes, bounds = hashed_words(column)
    known, at = words(column, lower=False)
    assert bounds.tolist() == at.tolist()
    assert len(set(zip(hashes.tolist(), known.tolist()))) == len(set(hashes.tolist())) == len(set(known.tolist()))
    often = lambda h: (h >> np.uint64(61)).astype(np.int64)
    sets, ends = word_sets(column, often)
    for i in range(len(texts)):
        own = sorted(set(hashes[bounds[i]:bounds[i + 1]].tolist()), key=lambda h: (h >> 61, h))
        assert sets[ends[i]:ends[i + 1]].tolist() == own
