"""Requests that are wrong in every way the schemas know, and rows written as JSON."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import outcomes, requests, serialized

JSON = "application/json; charset=utf-8"


def judged(spark, name, bodies):
    df = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate(bodies)], "i int, b string, t string")
    got = df.select("i", requests.checked(F.col("b"), F.col("t"), requests.SCHEMAS[name]).alias("r")).orderBy("i").collect()
    return [(r.r.error, r.r.issues, r.r.value and r.r.value.asDict()) for r in got]


def test_requests(spark):
    ok = {"source_id": "s", "interval_seconds": 60, "next_run_at": None}
    got = judged(spark, "monitor", [
        ('{"source_id": "s", "interval_seconds": 60, "more": [1]}', JSON), ('{"source_id": "s", "interval_seconds": 60, "next_run_at": null}', "Application/JSON"), ('{"source_id": "", "interval_seconds": 0}', JSON),
        ('{"source_id": 7, "interval_seconds": 1.5}', JSON), ('{"source_id": null, "next_run_at": 5}', JSON), ("{source_id: 1}", JSON), ('{"source_id": "s"', JSON), ("{}", "text/plain"), ("{}", None), (" \n", None), (None, None), ("[1]", JSON), ("null", JSON), ('"x"', JSON),
    ])
    missing = ["source_id: missing", "interval_seconds: missing"]
    assert got[0] == got[1] == (None, [], ok)
    assert [g[:2] for g in got[2:]] == [
        ("validation_error", ["source_id: too small", "interval_seconds: too small"]), ("validation_error", ["source_id: type", "interval_seconds: type"]), ("validation_error", ["source_id: type", "interval_seconds: missing", "next_run_at: type"]),
        ("invalid_json", []), ("invalid_json", []), ("invalid_content_type", []), ("invalid_content_type", []), ("validation_error", missing), ("validation_error", missing), *[("validation_error", ["(root): type"])] * 3,
    ]
    assert all(g[2] is None for g in got[2:])


@pytest.mark.parametrize(
    ("name", "body", "issues"),
    [
        ("site_name", {"name": "  "}, ["name: too small"]), ("site_name", {"name": "x" * 201}, ["name: too big"]), ("site", {"name": "n", "primary_origin": "no url", "canonical_origins": ["https://e.org", "no"]}, ["primary_origin: form", "canonical_origins: form"]),
        ("site", {"name": "n", "primary_origin": None, "canonical_origins": []}, []), ("site", {"name": "n", "canonical_origins": [1]}, ["canonical_origins: type"]), ("source", {"site_id": "s", "type": "html", "url": "u"}, ["type: choice"]),
        ("subscription", {"destination_id": "d", "site_id": "", "kind": "gone"}, ["site_id: too small", "kind: choice"]), ("subscription", {"destination_id": "d", "site_id": None, "kind": None, "tag": ""}, []),
        ("sitemap_config", {"lastmod_max_age_days": 31, "max_depth": 5, "child_include_patterns": []}, ["lastmod_max_age_days: too big", "child_include_patterns: too small"]), ("robots_override", {"canonical_origin": "https://e.org", "mode": "ignore"}, []),
        ("destination", {"name": "n"}, ["webhook_url: missing"]),
    ],
)
def test_schemas(spark, name, body, issues):
    assert judged(spark, name, [(json.dumps(body), JSON)])[0][:2] == ("validation_error" if issues else None, issues)


def test_rows_as_json(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 6000)
    df = spark.createDataFrame([("a", "k", None, "https://u:p@Hooks.example.org/x/abcd", "ignore", at, 1), ("b", None, "d", "", "enforce", None, 2)], "id string, body_key string, diff_key string, webhook_url string, mode string, created_at timestamp, inside int")
    for name, fields in serialized.FIELDS.items():
        rows = [json.loads(r.json) for r in serialized.serialized(df, name).collect()]
        assert all(list(r) == fields.split() for r in rows)
    one = lambda name: [json.loads(r.json) for r in serialized.serialized(df, name).orderBy("id").collect()]
    assert [(r["has_body"], r["has_normalized_body"], r["created_at"]) for r in one("snapshot")] == [(True, False, "2024-01-02T03:04:05.006Z"), (False, False, None)]
    assert [r["has_diff"] for r in one("change")] == [False, True] and [r["warning"] for r in one("robots_policy")] == [True, False]
    assert [r["webhook_url_masked"] for r in one("destination")] == ["hooks.example.org/***abcd", None]
    sealed = df.limit(1).select("id", outcomes.sealed(F.lit("https://hooks.example.org/secret"), F.lit(b"0" * 32), F.lit(b"1" * 12)).alias("webhook_url"))
    kept = [sealed, sealed.withColumn("webhook_url", F.lit("enc:v1:!")), sealed.withColumn("webhook_url", F.lit("nothing"))]
    assert [json.loads(serialized.serialized(d, "destination").first().json)["webhook_url_masked"] for d in kept] == ["hooks.example.org/***cret", None, "invalid-url/***hing"]
    nested = df.select("id", F.array(F.lit("x")).alias("allow_list"), F.array(F.struct(F.lit("f").alias("fetcher_id"), F.lit(None).cast("array<string>").alias("proceed_on"))).alias("order_list"))
    assert json.loads(serialized.serialized(nested, "fetcher_policy").first().json) == {"allow_list": ["x"], "order_list": [{"fetcher_id": "f", "proceed_on": None}]}
