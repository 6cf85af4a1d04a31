import random

import numpy as np
import pytest

from strandline.llm import mixing as X

TARGETS = [("web", 0.5, 1), ("app", 0.3, 3), ("forum", 0.15, 4), ("none", 0.05, 2), ("bad", None, 2), ("zero", 0.1, 0)]


def sizes(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["web"] * 6 + ["app"] * 3 + ["forum", "bad", "other", None]), rng.randint(0, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), rows


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_pivotal_step_keeps_sum_and_expectation():
    for p, q in ((0.2, 0.3), (0.7, 0.6), (0.5, 0.5), (0.9, 0.1)):
        total = first = 0.0
        n = 4000
        for i in range(n):
            a, b = X.pivotal_step(p, q, (i + 0.5) / n)
            assert a + b == pytest.approx(p + q) and (a in (0, 1) or b in (0, 1) or min(a, b) < 1e-12 or max(a, b) > 1 - 1e-12)
            first += a
        assert first / n == pytest.approx(p, abs=2e-3)


@pytest.mark.parametrize("bucket", [50_000, 40, 7])
def test_shares_are_met_within_the_caps(spark, monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(X, "FAN_IN", 4)
    df, rows = sizes(spark)
    uses = X.mixed_uses(df, targets(spark)).collect()
    assert len(uses) == sum(r[1] in ("web", "app", "forum", "bad") for r in rows)
    caps = {s: m for s, _, m in TARGETS}
    assert all(0 <= u.uses <= caps[u.source] for u in uses)
    assert all(u.uses == 0 for u in uses if u.n_tokens == 0 or u.source == "bad")
    used = {s: sum(u.uses * u.n_tokens for u in uses if u.source == s) for s in ("web", "app", "forum")}
    whole = sum(used.values())
    for s, share in (("web", 0.5 / 0.95), ("app", 0.3 / 0.95), ("forum", 0.15 / 0.95)):
        assert used[s] / whole == pytest.approx(share, abs=0.002)
    again = X.mixed_uses(df, targets(spark)).collect()
    assert sorted(map(tuple, uses)) == sorted(map(tuple, again))


def test_total_beyond_what_the_caps_allow(spark):
    df, rows = sizes(spark)
    uses = X.mixed_uses(df, targets(spark), total=10**9).collect()
    assert all(u.uses == {"web": 1, "app": 3, "forum": 4, "bad": 0}[u.source] for u in uses if u.n_tokens)


def test_report_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "web", 1.0), (2, None, "web", 1.0), (3, "x", None, 1.0), (4, "d e", "app", 1.0)], "doc_id bigint, text string, source string, target_share double")
    got = {r.source: r for r in X.mix_shares(docs, targets(spark)).collect()}
    assert set(got) == {s for s, *_ in TARGETS} and got["none"].used_tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1.0)
    rows = X.mix(docs, targets(spark)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 4]
    empty = X.mix_shares(docs.limit(0), targets(spark)).collect()
    assert len(empty) == len(TARGETS) and all(r.actual_share == 0 for r in empty)
    assert X.mix(docs.limit(0), targets(spark)).count() == 0


def test_rounding_keeps_the_sum_and_leaves_one_fractional():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 1000, 4097):
        p = rng.random(n)
        got = X.pivotal(p.copy(), np.arange(n), 8)
        assert ((got > 0) & (got < 1)).sum() <= 1 and got.sum() == pytest.approx(p.sum())
    many = [X.pivotal(np.full(9, 0.3), np.arange(9), seed) for seed in range(3000)]
    assert np.mean(many, axis=0) == pytest.approx(np.full(9, 0.3), abs=0.03)


def test_hot_source_is_settled_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_DOCS", 64)
    monkeypatch.setattr(X, "FAN_IN", 2)
    rows = [(i, "web" if i % 20 else "app", 10 + i % 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    uses = X.mixed_uses(df, spark.createDataFrame([("web", 0.5, 3), ("app", 0.5, 3)], "source string, target_share double, max_repeats int")).collect()
    used = {s: sum(u.uses * u.n_tokens for u in uses if u.source == s) for s in ("web", "app")}
    assert used["web"] == pytest.approx(used["app"], rel=0.01) and len(uses) == 4000
