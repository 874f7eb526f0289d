"""Stored chunk tables, JSON pointers, embedding providers and guards that raise."""

import pytest
from pyspark.sql import functions as F

from proofloom.functions import json_paths
from proofloom.operators import experiments, rebuild, rules
from proofloom.sources import json_files


def test_replacement_on_disk(spark, tmp_path):
    old = spark.createDataFrame([(v, k, f"{v}-{k}") for v in range(30) for k in range(3)], "version_id long, chunk_index int, content string")
    path = str(tmp_path / "chunks")
    rebuild.store(old, path)
    versions = spark.createDataFrame([(3,), (7,), (8,)], "version_id long")
    fresh = spark.createDataFrame([(3, 0, "anew"), (7, 0, "anew"), (99, 0, "not asked for")], "version_id long, chunk_index int, content string")
    rebuild.replace_stored(path, fresh, versions)
    got = sorted(map(tuple, spark.read.parquet(path).select("version_id", "chunk_index", "content").collect()))
    want = sorted([(v, k, f"{v}-{k}") for v in range(30) for k in range(3) if v not in (3, 7, 8)] + [(3, 0, "anew"), (7, 0, "anew")])
    assert got == want


def test_json_strings_and_forbidden_data(spark):
    body = '{"a/b": ["x", {"~k": "mail a@b.example now"}], "n": 1, "deep": %s"end"%s}' % ("[" * 40, "]" * 40)
    rows = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, '"/home/user/ and http://evil.example/x http://ok.example/y"')], "id long, body string")
    found = {(r["id"], r["pointer"]): r["value"] for r in json_paths.json_strings(rows, "id", "body").collect()}
    assert found[1, "/a~1b/0"] == "x" and found[1, "/a~1b/1/~0k"] == "mail a@b.example now" and found[1, "/deep" + "/0" * 40] == "end"
    bad = {(r["id"], r["pointer"], r["rule"]) for r in json_files.forbidden_in_json(rows, "id", "body", allowed_host="ok.example").collect()}
    assert bad == {(1, "/a~1b/1/~0k", "email_address"), (4, "/", "unix_path"), (4, "/", "url_outside_allowlist")}


@pytest.mark.parametrize("text, rule", [
    (r"see C:\data here", "windows_path"), (r"on \\server\share now", "windows_unc_path"), ("in /Users/me", "macos_path"), ("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ("ghp_" + "a" * 24, "api_key_or_token"),
    ("ftp://me:secret@host/x", "credentials_in_url"), ("id 123e4567-e89b-12d3-a456-426614174000", "uuid"), ("0" * 40, "hex_digest"), ("at 10.0.0.255 ok", "ip_address"), ("AKIA" + "B" * 16, "api_key_or_token"),
])
def test_forbidden_families(spark, text, rule):
    rows = spark.createDataFrame([(1, text), (2, "a plain sentence, 3/4 of it, https://x.example and 1.2.3")], "id long, text string")
    assert {(r["id"], r["rule"]) for r in json_files.forbidden_data(rows, "id", "text").collect()} == {(1, rule)}


@pytest.mark.parametrize("text, rule, n", [
    ("/etc//var/", "unix_path", 2), ("x/etc/ and 1/usr/ are within words", "unix_path", 0), ("(/srv/)/opt/_/tmp/", "unix_path", 3), ("C:/a D:\\b xC:/d", "windows_path", 2), (r"\\\\a\\ \\\\b\\", "windows_unc_path", 2),
    ("1.2.3.4 255.255.255.255 256.1.1.1 1.2.3.4.5 v1.2.3.4 9.9.9.9.", "ip_address", 3), ("a" * 64 + " " + "b" * 40 + " " + "c" * 41, "hex_digest", 2), ("a@b.org,c.d+e@f.co.uk @x.y a@b", "email_address", 2),
    ("eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "jwt", 1), ("s3://k:p@h ftp://u@h http://h:80/@", "credentials_in_url", 1), ("sk-" + "x" * 15 + " sk-" + "x" * 16 + " sk_live_" + "9" * 20, "api_key_or_token", 2),
    ("-----BEGIN PRIVATE KEY----------BEGIN EC PRIVATE KEY-----", "private_key", 2), (None, "uuid", 0), ("", "uuid", 0),
])
def test_forbidden_counts_and_their_twin(spark, text, rule, n):
    """Adjacent matches, words they stand within, and edges of the formats; the SQL twin has expressions of its own."""
    import duckdb

    from proofloom.plans.corpus_queries import _forbidden_sql

    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = sorted(map(tuple, json_files.forbidden_data(rows, "id", "text").collect()))
    assert sum(r[2] for r in got if r[1] == rule) == n
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO t VALUES (1, ?)", [text])
    assert sorted(con.execute(_forbidden_sql("t", "id", "text")).fetchall()) == got


def test_hosts_outside(spark):
    text = "HTTP://Evil.example:80/x https://u:p@ok.example:8/y, http://a.ok.example http://notok.example?q http://ok.example.evil.test"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    found = {r["rule"]: r["n_matches"] for r in json_files.forbidden_data(rows, "id", "text", allowed_host="ok.example").collect()}
    assert found["url_outside_allowlist"] == 3


def test_providers_are_checked(spark):
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(300)], "id long, text string")
    got = experiments.embed(texts, "id", "text", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert got.count() == 300 and got.filter(F.size("embedding") != 2).count() == 0
    for wrong in (lambda ts: [[1.0, 2.0]], lambda ts: [[1.0]] * len(ts), lambda ts: [[float("nan"), 1.0]] * len(ts)):
        with pytest.raises(Exception, match="vector"):
            experiments.embed(texts, "id", "text", wrong, 2).count()


def test_unbound_items_raise(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item long, key string")
    docs = spark.createDataFrame([(10, "a")], "document_id long, key string")
    bound, unbound = rules.bindings(items, docs, "key")
    assert bound.count() == 1
    with pytest.raises(ValueError, match="b"):
        rules.require_bound(unbound)
