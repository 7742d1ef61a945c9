import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Two collections with overlapping ids, groups, solos and untagged items."""
    from spark_explore.sources.collections import SCHEMAS, Tables

    def table(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    medias, values, taggings = [], {}, []
    for c in ("a", "b"):
        medias += [(c, 1, "v1", 2, None, None), (c, 2, "v2", 2, None, None), (c, 3, "solo", 1, None, None)]
        for i in range(8):
            medias.append((c, 10 + i, f"i{i}", 1, None if i == 7 else f"t{i}", 1 + i % 2))
            tags = [(100 + i, 1, "numerical_int", i)]
            if i != 5:
                tags.append((200 + i % 3, 2, "categorical", f"kind_{i % 3}"))
            if i in (0, 3):
                tags.append((201, 2, "categorical", "kind_1"))
                tags.append((500 + i, 5, "categorical", "twin"))
            if c == "a":
                tags.append((300 + i, 3, "numerical_double", i / 2))
                tags.append((400 + i, 4, "timestamp", i))
            for tag, facet, kind, value in tags:
                taggings.append((c, 10 + i, tag))
                values[c, tag] = (facet, kind, value)
        taggings.append((c, 1, 900))
        values[c, 900] = (6, "categorical", "group_tag")
    from datetime import datetime

    rows = [
        (c, tag, facet, kind,
         v if kind == "categorical" else None, v if kind == "numerical_int" else None,
         v if kind == "numerical_double" else None,
         datetime(2024, 1, 1 + v) if kind == "timestamp" else None)
        for (c, tag), (facet, kind, v) in values.items()
    ]
    kinds = ["categorical", "numerical_int", "numerical_double", "timestamp"]
    facets = [(1, "Vector Index ID", 2), (2, "kind", 1), (3, "size", 3), (4, "day", 4), (5, "kind", 1), (6, "group", 1)]
    return Tables(
        table("collections", [("a", True, "exact", "http://t", "http://m"), ("b", False, "ivf", "x", "y")]),
        table("medias", medias),
        table("tag_types", [(c, i + 1, k) for c in "ab" for i, k in enumerate(kinds)]),
        table("tagsets", [(c, i, n, t) for c in "ab" for i, n, t in facets]),
        table("tag_values", rows),
        table("taggings", taggings),
        spark.createDataFrame([(c, i, [float(i), 1.0 if c == "a" else -1.0]) for c in "ab" for i in range(8)],
                              "collection string, index_id long, embedding array<float>"),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or [F.col(f"`{c}`") for c in df.columns])).collect())
