import corpus_pipeline
from spark_explore.llm import minhash
from test_dedup import removed_by_brute_force, shingles
from test_tokens import check_packed

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "personal_data", "packing"]
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, results[-1], SF).write.parquet(str(tmp_path / name))
        results.append(spark.read.parquet(str(tmp_path / name)))
    for kept in results[:-1]:
        assert kept.columns == columns
    first, named, lines, unique, masked, packed = ({r["doc_id"]: r for r in x.collect()} for x in results)
    assert named.keys() <= first.keys() and len(named) >= 0.95 * len(first)
    gone = removed_by_brute_force([(d, r["text"]) for d, r in named.items()], 80)
    for d, r in named.items():
        if d not in lines:
            assert not shingles("\n".join(x for i, x in enumerate(r["text"].split("\n")) if (d, i) not in gone))
            continue
        assert lines[d]["text"] == "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (d, i) not in gone)
        assert lines[d]["n_chars"] == len(lines[d]["text"])
    sets = {d: shingles(r["text"]) for d, r in lines.items()}
    kept = {r["doc_id"] for r in minhash.near_duplicates(results[2]).where("kept").collect()}
    assert set(unique) == kept
    for d in kept:  # no two that stay are alike
        assert not any(e < d and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in kept)
    assert masked.keys() == unique.keys()
    assert not any("@mail" in r["text"] for r in masked.values())
    rows = results[-1].collect()
    check_packed(rows, 4096)
    assert {r["doc_id"] for r in rows} == set(masked)


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, row string, id string, x string, line string"
    own = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'g' AS gone", "'r' AS row", "'i' AS id", "'x' AS x", "'l' AS line")
    text = docs.where("length(text) > 400").orderBy("doc_id").first()["text"]
    odd = [(None, None, None, None, None), (9000, None, None, "s", 0), (9001, "", None, "s", 0), (9002, text, None, None, None), (9002, text, None, None, None),
           (None, text, "en", None, None)]
    rows = own.unionByName(spark.createDataFrame([(*o, "g", "r", "i", "x", "l") for o in odd], schema))
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        if name == "language_id":
            kept = stage(spark, rows, SF)
            assert {9000, 9001}.isdisjoint(r["doc_id"] for r in kept.select("doc_id").collect())
        out = stage(spark, rows if name in ("language_id", "packing") else rows.where("text IS NOT NULL"), SF)
        assert out.count() > 0 and stage(spark, empty, SF).count() == 0
        if name != "packing":
            assert out.columns == own.columns and out.select("gone", "row", "id", "x", "line").distinct().collect() == [("g", "r", "i", "x", "l")]
