import pytest
from pyspark.sql import functions as F

from spark_explore.functions.display import display_text
from spark_explore.functions.encode import embed_text
from spark_explore.functions.vectors import dot, l2_normalize
from spark_explore.operators import catalogue, items, mapping
from spark_explore.sources import collections as sources
from conftest import rows


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "collection string, media_id long")


def test_write_and_read(spark, small, tmp_path):
    folder = str(tmp_path / "media")
    sources.write_collection(small, folder)
    back = sources.read_collection(spark, folder)
    for name in sources.SCHEMAS:
        assert getattr(back, name).count() == getattr(small, name).count()
    one = back.where("a")
    assert rows(mapping.build_index_map(one)) == [("a", 10 + i, i) for i in range(8)]
    plan = one.taggings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan
    with pytest.raises(Exception):
        sources.read_collection(spark, str(tmp_path / "nothing"))
    vectors = sources.read_embeddings(spark, f"{folder}/embeddings", "z", "index_id", "embedding")
    assert vectors.count() == 16 and rows(vectors.select("collection").distinct()) == [("z",)]


def test_registry(small):
    assert rows(sources.list_collections(small)) == [("a",)]
    assert rows(sources.enabled_collections(small), "collection", "needs_index") == [("a", False)]
    odd = small.collections.withColumn("index_type", F.lit("ecp"))
    with pytest.raises(Exception):
        sources.enabled_collections(sources.replace(small, collections=odd)).collect()


def test_mapping(spark, small):
    mapped = mapping.build_index_map(small)
    assert rows(mapping.total_items(mapped)) == [("a", 8), ("b", 8)]
    found = spark.createDataFrame([("a", 3, 1), ("a", -1, 2)], "collection string, index_id long, rank int")
    assert rows(mapping.to_media_ids(found, mapped), "media_id", "rank") == [(13, 1)]
    assert rows(mapping.to_index_ids(ids(spark, ("a", 13), ("a", 1)), mapped), "index_id") == [(3,)]
    with pytest.raises(ValueError):
        mapping.to_index_ids(ids(spark, ("a", 1)), mapped, strict=True)


def test_validation_finds_each_fault(spark, small):
    mapped = mapping.build_index_map(small)
    report = mapping.validate_collection(small, mapped)
    assert rows(report, "collection", "mapped", "ready") == [("a", 8, True), ("b", 8, True)]
    bad = sources.replace(
        small,
        taggings=small.taggings.unionByName(spark.createDataFrame([("a", 99, 100), ("a", 10, 777)], small.taggings.schema)),
        medias=small.medias.where("media_id != 2"),
        embeddings=small.embeddings.where("index_id != 4"),
    )
    extra = spark.createDataFrame([("b", 50, 3), ("b", 10, 20)], "collection string, media_id long, index_id long")
    row = {r["collection"]: r for r in mapping.validate_collection(bad, mapped.unionByName(extra)).collect()}
    assert row["a"]["taggings_without_media"] == 1 and row["a"]["taggings_without_value"] == 1
    assert row["a"]["items_without_group"] == 4 and row["a"]["mapped_without_vector"] == 1
    assert row["b"]["duplicate_index_ids"] == 1 and row["b"]["gaps"] == 12 and row["b"]["duplicate_media_ids"] == 1
    assert not row["a"]["ready"] and not row["b"]["ready"]
    empty = mapping.validate_collection(small, mapped.where("collection = 'a'"))
    assert rows(empty, "collection", "ready") == [("a", True), ("b", False)]


def test_catalogue(small):
    assert len(rows(catalogue.facets(small))) == 12
    a = catalogue.facet_values(small, 2, "categorical").where("collection = 'a'")
    assert rows(a, "value") == [("kind_0",), ("kind_1",), ("kind_2",)]
    assert rows(catalogue.facet_values(small, 2, "numerical_int")) == []
    assert ("2024-01-04 00:00:00.000000",) in rows(catalogue.facet_values(small, 4), "value")
    with pytest.raises(ValueError):
        catalogue.facet_values(small, 2, "colour")


def test_base_info_keeps_missing_uris_visible(spark, small):
    got = items.item_base_info(small, ids(spark, ("a", 17), ("a", 10), ("a", 555)))
    assert rows(got, "id", "thumb_path", "src_path", "group_id") == [
        (10, "http://t/t0", "http://m/i0", 1), (17, "http://t/None", "http://m/i7", 2)]


def test_metadata(spark, small):
    got = items.item_metadata(small, ids(spark, ("a", 13)))
    assert rows(got, "tagset_id", "facet", "values") == [
        (1, "Vector Index ID", ["3"]), (2, "kind", ["kind_0", "kind_1"]), (3, "size", ["1.5"]),
        (4, "day", ["2024-01-04 00:00:00.000000"]), (5, "kind", ["twin"])]
    assert items.item_details(small, ids(spark, ("a", 13)), []).count() == 0
    # The map form has one entry per name: the later facet wins, as in a dictionary.
    info = items.item_info(small, ids(spark, ("b", 13), ("b", 2))).collect()
    maps = {r["item_id"]: r["metadata"] for r in info}
    assert maps == {2: {}, 13: {"Vector Index ID": ["3"], "kind": ["twin"]}}
    shown = items.display_metadata(items.item_details(small, ids(spark, ("b", 12)), [2]))
    assert rows(shown, "facet", "values") == [("Kind", ["Kind 2"])]


def test_related(spark, small):
    assert rows(items.related_items(small, ids(spark, ("a", 2), ("b", 10))), "related_id") == [
        (11,), (13,), (15,), (17,)]
    # Related metadata groups by facet name: both facets called "kind" meet.
    got = items.related_metadata(small, ids(spark, ("a", 2)), [2, 5])
    assert rows(got, "related_id", "facet", "values") == [
        (11, "kind", ["kind_1"]), (13, "kind", ["kind_0", "kind_1", "twin"]), (17, "kind", ["kind_1"])]
    assert items.related_metadata(small, ids(spark, ("a", 2)), []).columns == ["collection", "media_id", "related_id"]
    assert rows(items.siblings(small, ids(spark, ("a", 10), ("a", 1))), "media_id", "group_id") == [(10, 1)]


def test_excluded_means_child_of_an_excluded_id(spark, small):
    asked = spark.createDataFrame(
        [(1, "a", 10, [1]), (2, "a", 10, [12]), (3, "a", 10, [2, 1]), (4, "a", 10, []), (5, "a", 1, [1])],
        "req_id long, collection string, media_id long, excluded_ids array<long>")
    assert rows(items.is_excluded(small, asked), "req_id", "excluded") == [
        (1, True), (2, False), (3, True), (4, False), (5, False)]


def test_display_text(spark):
    df = spark.createDataFrame([("first_SEEN_at",), ("",), ("éCOLE x",)], "t string")
    assert [r[0] for r in df.select(display_text(F.col("t"))).collect()] == ["First seen at", "", "École x"]


def test_vectors_and_encoder(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], None, None]
    assert df.select(dot(F.col("v"), F.col("v"))).first()[0] == 25.0
    texts = spark.createDataFrame([("Red red BLUE",), ("¿¿",), (None,)], "text string")
    got = [r["query_vec"] for r in embed_text(texts, "text").collect()]
    assert len(got[0]) == 64 and sorted(x for x in got[0] if x)[-1] == pytest.approx(2 / 5**0.5)
    assert got[1] is None and got[2] is None
    other = embed_text(texts, "text", encoder=lambda t: F.array(F.length(t).cast("double"), F.lit(0.0)))
    assert [r["query_vec"] for r in other.collect()][:2] == [[1.0, 0.0], [1.0, 0.0]]


def test_encoder_counts_as_the_definition(spark, monkeypatch):
    """Token by token against md5, on odd texts, also where a text is longer than a slice."""
    import hashlib
    import re

    import numpy as np
    import pyarrow as pa

    from spark_explore.functions import encode

    texts = ["a b a", "Kelvin İstanbul", "", None, "x1-y2\nx1", "été", "end", "end of " * 40, "?!", "z"]
    monkeypatch.setattr(encode, "CHUNK_BYTES", 8)
    lower = [None if t is None else t.lower() for t in texts]
    want = np.zeros((len(texts), encode.DIM), int)
    for row, text in zip(want, lower):
        for token in re.findall("[a-z0-9]+", text or ""):
            row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % encode.DIM] += 1
    for shift in (0, 3):  # slices of an array that begins elsewhere
        column = pa.array(["zz"] * shift + lower).slice(shift)
        got = np.concatenate([encode._counts(part) for part in encode._slices(column)])
        assert (got == want).all()
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vectors = [r["query_vec"] for r in embed_text(table, "text").orderBy("id").collect()]
    for vector, row in zip(vectors, want):
        size = np.sqrt((row * row).sum())
        assert vector is None if size == 0 else vector == (row / size).tolist()


def test_searches_of_documents_read_written_vectors(spark):
    """The texts are encoded once, however often a search reads the vectors."""
    from registry import fixtures as fx

    index = fx.documents_index(spark, "/root/testdata/sf0.001")
    assert index.embeddings.count() > 0
    assert not [f for f in index.embeddings.inputFiles() if "documents.parquet" in f]
