from __future__ import annotations

import fnmatch
import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.functions import patterns as pt
from wardenry.operators import conformance, tenancy


def test_long_lists_equal_plain_tests(spark):
    """Names and prefixes found by binary search, for lists of no, one and many entries, and starts of other starts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab/é") for _ in range(rng.randint(0, 6)))
    lists = {"none": [], "one": ["ab*"], "all": ["*"], "many": [word() + rng.choice(["", "*"]) for _ in range(300)], "nested": ["a*", "ab*", "abb", "b/", "é*"]}
    tenants = spark.createDataFrame([(t, "x", True, p, None) for t, p in lists.items()], S.TENANTS)
    asked = [(t, word()) for t in lists for _ in range(80)]
    got = tenancy.decide(spark.createDataFrame(asked, "tenant_id string, resource string"), tenants).collect()
    for r in got:
        patterns = lists[r.tenant_id]
        fits = not patterns or any(r.resource == p or (p.endswith("*") and r.resource.startswith(p[:-1])) for p in patterns)
        assert (r.decision == "allow") == fits, (r, fits)


def test_long_lists_are_rows(spark, monkeypatch):
    """Lists over the bound, or given as rows, decide as lists on the tenant's row do, also for repeated and null requests."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab/é*") for _ in range(rng.randint(0, 5)))
    lists = {
        "none": [], "null": [None], "one": ["ab*"], "all": ["*"], "many": [word() + rng.choice(["", "*"]) for _ in range(60)] + [None],
        "mixed": ["a*", "ab*", "abb", "é*", "b?/", "[a]é", "regex:/+b", "regex:x"], "off": ["a*"],
    }
    tenants = spark.createDataFrame([(t, "x", t != "off", p, None) for t, p in lists.items()], S.TENANTS)
    asked = [(t, word()) for t in [*lists, "ghost", "a/b", ""] for _ in range(40)]
    asked += asked[:50] + [(t, r) for t in [*lists, None] for r in (None, "[a]é", "regex:x", "b*", "")]
    requests = spark.createDataFrame(asked, "tenant_id string, resource string")
    answers = lambda df: sorted(map(str, df.collect()))
    want = answers(tenancy.decide(requests, tenants))
    assert len(want) == len(asked)
    rows = spark.createDataFrame([(t, p) for t, listed in lists.items() for p in listed], "tenant_id string, pattern string")
    bare = tenants.withColumn("allowed_resources", F.array().cast("array<string>"))
    assert answers(tenancy.decide(requests, bare, patterns=rows)) == want
    for bound in (0, 1, 20):
        monkeypatch.setattr(tenancy, "LISTED", bound)
        assert answers(tenancy.decide(requests, tenants)) == want


def test_requests_carry_no_long_list(spark, monkeypatch):
    """The work is in proportion to the requests: no row that is joined with them holds a list of thousands."""
    requests = spark.range(3000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("r"), "id").alias("resource"))
    tenants = spark.createDataFrame([("t", "x", True, [f"r{n}" for n in range(0, 3000, 2)], None)], S.TENANTS)
    sizes = []
    compiled = tenancy.compile_policies
    monkeypatch.setattr(tenancy, "compile_policies", lambda df: sizes.append(compiled(df).agg(F.max(F.size("_exact"))).first()[0]) or compiled(df))
    assert tenancy.decide(requests, tenants).where("decision = 'allow'").count() == 1500
    assert sizes == [0]


@pytest.mark.parametrize("value, reason", [
    ("", "empty_tenant_id"), (None, "empty_tenant_id"), ("../admin", "invalid_characters"), ("tenant/admin", "invalid_characters"),
    ("tenant\\admin", "invalid_characters"), ("a\0b", "invalid_characters"), ("t" * 256, "tenant_id_too_long"), ("t" * 255, None),
    ("/" * 256, "tenant_id_too_long"), ("tenant-123_valid", None), ("a.b", None),
])
def test_tenant_ids(spark, value, reason):
    df = spark.createDataFrame([(value,)], "tenant_id string")
    assert tenancy.check_ids(df).first().denial_reason == reason


def test_tenant_id_of_another_type(spark):
    df = spark.createDataFrame([(5,), (None,)], "tenant_id int")
    assert sorted(r.denial_reason for r in tenancy.check_ids(df).collect()) == ["empty_tenant_id", "invalid_type"]


def test_globs_equal_the_shell_rules(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "/", "*", "?", "[ab]", "[!a]", "[a-c]", "[", "]", ".", "+", "(", "$", "^", "\\", "-", "{", "|", "[]a]", "[!]]", "\n", "é"]
    patterns = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(400)}
    patterns |= {"*", "**", "", "s3://bucket1/*", "[^a]", "[a\\]", "[&&b]", "[[a]"}
    texts = ["", "a", "b", "c", "ab", "a/b", "abc", "[", "]", ".", "+", "a\n", "\n", "^", "-", "\\", "s3://bucket1/x/y", "&", "é", "(a", "a$"]
    df = spark.createDataFrame(list(itertools.product(sorted(patterns), texts)), "p string, t string")
    got = df.withColumn("m", F.call_function("rlike", "t", pt.glob_regex(F.col("p")))).collect()
    wrong = [(r.p, r.t, r.m) for r in got if r.m != fnmatch.fnmatchcase(r.t, r.p)]
    assert not wrong


def python_matches(pattern: str, resource: str) -> bool:
    if pattern == resource or fnmatch.fnmatchcase(resource, pattern):
        return True
    return pattern.startswith("regex:") and re.match(pattern[6:], resource) is not None


POLICIES = [
    ("exact", "E", True, ["s3://bucket1/file", "a[b"], None), ("glob", "G", True, ["s3://bucket1/*", "postgresql:table_*", "x?z*"], []),
    ("regex", "R", True, ["regex:s3://bucket[0-9]+/.*", "regex:a|b"], ["s3"]), ("off", "O", False, ["*"], []), ("free", "F", True, [], ["kafka"]),
    ("none", "N", None, None, None),
]
RESOURCES = ["s3://bucket1/file", "s3://bucket1/file2", "s3://bucket12/a/b", "postgresql:table_x", "postgresql:tab", "xyz", "xyz\n", "xz",
             "a", "bcd", "cb", "a[b", "regex:a|b", "regex:s3://bucket5/.z*", "s3://bucket5/"]


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.createDataFrame(POLICIES, S.TENANTS).cache()


def test_decisions_equal_the_rules(spark, tenants):
    asked = list(itertools.product([p[0] for p in POLICIES] + ["ghost", "bad/id", ""], RESOURCES))
    got = tenancy.decide(spark.createDataFrame(asked, "tenant_id string, resource string"), tenants)
    policies = {p[0]: p for p in POLICIES}
    for row in got.collect():
        policy = policies.get(row.tenant_id)
        if row.tenant_id in ("bad/id", ""):
            want = "deny"
        elif policy is None:
            want = "allow"
        elif policy[2] is False:
            want = "deny"
        elif not policy[3]:
            want = "allow"
        else:
            want = "allow" if any(python_matches(p, row.resource) for p in policy[3]) else "deny"
        assert row.decision == want, row
    matched = tenancy.matching_patterns(spark.createDataFrame(asked, "tenant_id string, resource string"), tenants)
    for row in matched.where("matched IS NOT NULL").collect():
        assert row.matched == [p for p in policies[row.tenant_id][3] if python_matches(p, row.resource)]


def test_large_policy_tables_are_not_broadcast(spark, tenants, monkeypatch):
    monkeypatch.setattr(tenancy, "broadcast_if_small", lambda df: df)
    df = spark.createDataFrame([("glob", "xyz"), ("ghost", "x")], "tenant_id string, resource string")
    assert {r.reason for r in tenancy.decide(df, tenants).collect()} == {"matched", "unregistered"}


def test_connector_types_only_when_asked(spark, tenants):
    df = spark.createDataFrame([("free", "r", "s3"), ("free", "r", "kafka"), ("none", "r", "s3")], "tenant_id string, resource string, kind string")
    assert {r.decision for r in tenancy.decide(df, tenants).collect()} == {"allow"}
    got = {(r.tenant_id, r.kind): r.reason for r in tenancy.decide(df, tenants, connector_type="kind").collect()}
    assert got == {("free", "s3"): "connector_type_not_allowed", ("free", "kafka"): "unrestricted", ("none", "s3"): "unrestricted"}


def test_denials_become_audit_rows(spark, tenants):
    df = spark.createDataFrame([("off", "r"), ("", "r"), ("free", "r")], "tenant_id string, resource string")
    events = tenancy.denial_events(tenancy.decide(df, tenants), datetime(2024, 1, 1))
    assert sorted((r.tenant_id, r.details["reason"]) for r in events.collect()) == [("UNKNOWN", "empty_tenant_id"), ("off", "tenant_disabled")]
    assert conformance.audit_violations(events).count() == 0


@pytest.mark.parametrize("path, listing, reason", [
    ("a/b.txt", False, None), ("a/../b", False, "parent_reference"), ("/a", False, "absolute_path"), ("", False, "empty_path"), ("", True, None),
    (None, True, "not_a_string"), ("a..b", True, "parent_reference"),
])
def test_paths(spark, path, listing, reason):
    df = spark.createDataFrame([(path,)], "path string")
    assert tenancy.check_paths(df, listing=listing).first().denial_reason == reason


def test_registration(spark):
    rows = [("t", "T", True, ["x"], ["s3", "ftp"]), ("", "T", True, None, None), ("u", None, True, [], ["snowflake"]), ("ok", "", False, None, [])]
    found = sorted((r.tenant_id, r.rule) for r in conformance.tenant_violations(spark.createDataFrame(rows, S.TENANTS)).collect())
    assert found == [("", "tenant_id_empty"), ("t", "connector_type_unknown"), ("u", "name_missing")]


def test_names(spark):
    row = spark.range(1).select(tenancy.object_key(F.lit("t"), F.lit("a/b")).alias("k"), tenancy.topic_name(F.lit("t"), F.lit("x")).alias("n")).first()
    assert tuple(row) == ("t/a/b", "t_x")


def test_last_registration_counts(spark):
    rows = [("t", True, ["*"], 1), ("t", True, ["b"], 2), ("s", True, ["*"], 1), ("s", False, ["*"], 1)]
    tenants = spark.createDataFrame(
        [(t, None, on, allowed, None, at) for t, on, allowed, at in rows],
        "tenant_id string, name string, enabled boolean, allowed_resources array<string>, allowed_connector_types array<string>, registered_at int",
    )
    requests = spark.createDataFrame([("t", "a"), ("t", "b"), ("s", "a")], "tenant_id string, resource string")
    decided = {(r.tenant_id, r.resource): r.decision for r in tenancy.decide(requests, tenants).collect()}
    assert decided == {("t", "a"): "deny", ("t", "b"): "allow", ("s", "a"): "deny"}
    assert tenancy.decide(requests, tenants).count() == 3 and tenancy.matching_patterns(requests, tenants).count() == 3
