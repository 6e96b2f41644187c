import pytest
from pyspark.sql import functions as F

from thermocline.operators import rerank as R
from thermocline.plans import retrieval as P

CAND = "query_id int, chunk_id string, score double, rank int, timestamp string, latitude double, longitude double, basin int"


def _similarity(a, b):
    s = 0.4 if a[4] == b[4] else 0.0
    s += 0.3 * max(0, 1 - ((a[5] - b[5]) ** 2 + (a[6] - b[6]) ** 2) ** 0.5 / 10.0)
    return min(s + (0.3 if a[7] == b[7] else 0.0), 1.0)


def _greedy(rows, k, weight):
    if len(rows) <= k:
        return rows
    chosen, rest = [rows[0]], rows[1:]
    while len(chosen) < k:
        value = [weight * r[2] - (1 - weight) * max(_similarity(r, c) for c in chosen) for r in rest]
        chosen.append(rest.pop(value.index(max(value))))
    return chosen


ROWS = [(q, f"c{q}{i}", 0.9 - i * 0.05, i + 1, f"2024-01-0{1 + (i * q) % 3}", float((i * 7) % 11), float((i * q * 5) % 13), 1 + (i + q) % 3)
        for q in (1, 2, 3) for i in range(10)]


@pytest.mark.parametrize("weight", [0.0, 0.7, 1.0])
@pytest.mark.parametrize("k", [1, 4, 10, 12])
def test_mmr_matches_the_greedy_rule(spark, weight, k):
    df = spark.createDataFrame(ROWS, CAND).repartition(3)
    got = {(r.query_id, r.mmr_rank): r.chunk_id for r in R.mmr(df, k, weight).collect()}
    want = {}
    for q in (1, 2, 3):
        for i, r in enumerate(_greedy([r for r in ROWS if r[0] == q], k, weight), 1):
            want[(q, i)] = r[1]
    assert got == want


def test_mmr_with_unknown_place_and_basin(spark):
    rows = [(1, "a", 0.9, 1, "t", None, 1.0, None), (1, "b", 0.8, 2, "t", 2.0, 1.0, None), (1, "c", 0.7, 3, "u", 1.0, 1.0, 3)]
    assert R.mmr(spark.createDataFrame(rows, CAND), 2).count() == 2


def test_pairwise_similarity(spark):
    df = spark.createDataFrame(ROWS[:4], CAND)
    for r in R.pairwise_similarity(df).collect():
        a, b = (next(x for x in ROWS if x[1] == c) for c in (r.chunk_a, r.chunk_b))
        assert r.similarity == pytest.approx(_similarity(a, b))
    assert R.pairwise_similarity(df).count() == 6


META = "id int, metadata struct<basin int, latitude double, scheme string>"


@pytest.mark.parametrize("filters, ids", [
    ({}, [1, 2, 3]),
    ({"basin": 1}, [1]),
    ({"basin": [1, 2]}, [1, 2]),
    ({"latitude": {"min": -5, "max": 5}}, [1]),
    ({"latitude": {"min": 10.0}}, [2]),
    ({"basin": [1, 2], "scheme": "p"}, [1]),
    ({"platform": 3}, []),
    ({"basin": "1"}, []),
    ({"latitude": {"min": "a"}}, []),
    ({"basin": None}, [3]),
    ({"basin": [None, 2]}, [2, 3]),
])
def test_metadata_filters(spark, filters, ids):
    df = spark.createDataFrame([(1, (1, 5.0, "p")), (2, (2, 10.0, "s")), (3, (None, None, None))], META)
    assert [r.id for r in df.filter(R.metadata_predicate(df, filters)).orderBy("id").collect()] == ids


def test_hybrid_boost_cap_and_stability(spark):
    schema = ("query_id int, query string, chunk_id string, text string, score double, rank int, "
              "measurements array<struct<temperature_degc: double>>")
    rows = [(1, "Temperature and DEPTH", "a", "temperature depth", 0.5, 1, [(25.0,)]),
            (1, "Temperature and DEPTH", "b", "temperature", 0.5, 2, [(5.0,)]),
            (1, "Temperature and DEPTH", "c", "Depth, Temperature", 0.95, 3, []),
            (1, "Temperature and DEPTH", "d", "nothing", 1.0, 4, None)]
    got = R.hybrid(spark.createDataFrame(rows, schema), 4).orderBy("hybrid_rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("c", 1.0), ("d", 1.0), ("a", 0.75), ("b", 0.6)]


def test_threshold_range(spark):
    df = spark.createDataFrame([(0.2,), (0.5,)], "score double")
    assert R.apply_threshold(df, 0.5).count() == 1
    with pytest.raises(ValueError):
        R.apply_threshold(df, 1.1)


@pytest.fixture(scope="module")
def index(spark):
    from pyspark.sql import functions as F
    rows = [(f"2024-01-{d:02d} 00:00:00", d, float(p)) for d in range(1, 13) for p in range(1, 4)]
    df = spark.createDataFrame(rows, "timestamp string, d int, pressure_decibar double").select(
        (F.col("d") % 3 + 1).cast("int").alias("basin"), F.to_timestamp("timestamp").alias("timestamp"),
        F.col("d").alias("cycle_number"), F.lit("Primary sampling").alias("vertical_sampling_scheme"),
        (F.col("d") * 3.0).alias("longitude"), (F.col("d") - 6.0).alias("latitude"), "pressure_decibar",
        F.lit(35.0).alias("salinity_psu"), (F.col("d") * 2.0).alias("temperature_degc"))
    return P.build_index(df).cache()


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_text_search(spark, index, strategy):
    queries = P.text_queries(spark, ["Cycle: 7 temperature", "Basin 2 salinity"])
    found = P.retrieve(index, queries, 4, strategy=strategy).collect()
    assert {r.query_id for r in found} == {0, 1}
    assert P.retrieve(index, queries, k=55).groupBy("query_id").count().first()["count"] == min(55, index.count())
    with pytest.raises(ValueError):
        P.text_queries(spark, ["Cycle: 7 temperature", "  "])
    for q in (0, 1):
        rows = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4] and all(r.strategy == strategy for r in rows)
        assert rows[0].text.startswith("ARGO Float Profile") and rows[0].search_rank >= 1
        if strategy != "mmr":
            assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_filter_before_and_after_search(spark, index):
    queries = P.text_queries(spark, ["Cycle: 7"])
    post = P.retrieve(index, queries, 4, metadata_filters={"basin": 1}).count()
    pre = P.retrieve(index, queries, 4, metadata_filters={"basin": 1}, filter_mode="pre")
    assert pre.count() == 4 and post <= 4 and {r.metadata.basin for r in pre.collect()} == {1}


def test_similar_profile_finds_itself_first(spark, index):
    wanted = index.filter("metadata.cycle_number = 5").select(F.lit(1).alias("query_id"), "measurements")
    queries = P.profile_queries(wanted)
    assert queries.first().query.startswith("Oceanographic profile with measurements: Depth 1.0m: temperature 10.00°C, salinity 35.00; ")
    best = P.retrieve(index, queries, 12).orderBy("rank").collect()
    assert len(best) == 12 and best[0].score >= best[-1].score


def test_queries_are_made_once(spark, index):
    """Queries are read several times; what made them, here a function of each text, runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(text):
        made.add(1)
        return text

    texts = spark.createDataFrame([(0, "Cycle: 7 temperature"), (1, "Basin 2 salinity")], "query_id int, query string")
    texts = texts.withColumn("query", F.udf(counted, "string").asNondeterministic()("query"))
    found = P.retrieve(index, P.text_queries(spark, texts), 4).collect()
    assert len(found) == 8 and made.value == 2


def test_k_is_capped_and_checked(spark, index):
    queries = P.text_queries(spark, ["profile"])
    assert P.retrieve(index, queries, 500).count() == 12
    with pytest.raises(ValueError):
        P.retrieve(index, queries, 0)
    with pytest.raises(ValueError):
        P.retrieve(index, queries, 3, strategy="best")


def test_plot_source(spark, index):
    from thermocline.operators.sqlguard import register_views
    flat = P.plot_source(spark, "warm profile", index)
    assert flat.count() == 36 and "temperature_degc" in flat.columns
    register_views(spark, flat)
    assert P.plot_source(spark, "SELECT basin FROM profiles").count() == 36
