"""Weights, budgets and the copies that realise them."""

import math

import pytest

from tramline.llm.mixing import TOKENIZER, bisect, blended, entropy, exponent_for_entropy, mix, plan, temper, token_sizes

DOCS, TARGETS = "doc_id long, text string, source string", "source string, target_share double, max_repeats int"


def test_temper_and_entropy():
    s = [0.7, 0.2, 0.1]
    for want in (0.3, 0.6, 1.0):
        a = exponent_for_entropy(s, want)
        assert entropy(temper(s, a)) == pytest.approx(want, abs=1e-6)
    assert temper(s, 0) == pytest.approx([1 / 3] * 3) and exponent_for_entropy(s, math.log(3) + 1) == 0
    assert bisect(lambda x: x < 0.25, 0, 1) == pytest.approx(0.25)
    assert blended(s, [0.2, 0.3, 0.5], 0) == pytest.approx([0.2, 0.3, 0.5]) and blended(s, [0.2, 0.3, 0.5], 1) == pytest.approx(s)


def test_entropy_has_no_bound_but_the_greatest_shares():
    near = [0.34, 0.33, 0.33]
    a = exponent_for_entropy(near, 0.1)  # far beyond 8
    assert a > 100 and entropy(temper(near, a)) == pytest.approx(0.1, abs=1e-6)
    assert exponent_for_entropy([0.4, 0.4, 0.2], 0.5) == math.inf and temper([0.4, 0.4, 0.2], math.inf) == [0.5, 0.5, 0]


def test_plan_keeps_every_limit():
    tokens, targets, repeats = [1000.0, 100.0, 0.0], [0.5, 0.4, 0.1], [1.0, 3.0, 5.0]
    p = plan(tokens, targets, repeats, tolerance=0.0)
    assert p.exponent < 1e-9 and p.quotas[0] / sum(p.quotas) == pytest.approx(5 / 9) and p.quotas[1] == pytest.approx(300)
    for budget in (100.0, 1000.0, 1250.0, 1e6):
        q = plan(tokens, targets, repeats, budget)
        assert all(x <= r * t + 1e-6 for x, r, t in zip(q.quotas, repeats, tokens)) and sum(q.quotas) == pytest.approx(min(budget, 1300))
    assert 0 < plan(tokens, targets, repeats, 1250.0).exponent < 1  # as near to the targets as the limit lets it
    assert plan([0.0], [1.0], [2.0]).quotas == [0.0]


def test_source_that_may_not_be_used(spark):
    """Its target alone can't be met; the others are as if it had no tokens."""
    p, q = (plan([1000.0, 100.0, x], [0.5, 0.4, 0.1], [1.0, 3.0, r], tolerance=0.0) for x, r in ((50.0, 0.0), (0.0, 5.0)))
    assert p == q and p.quotas[1] == pytest.approx(300) and p.quotas[2] == 0
    assert plan([1000.0, 100.0, 50.0], [0.5, 0.4, 0.1], [1.0, 3.0, 0.0], 1000.0).exponent < 1
    docs = [(k, f"text number {k}", "abc"[k % 3]) for k in range(600)]
    m = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, None)], TARGETS))
    assert {r.source for r in m.rows.collect()} == {"a", "b"}


def test_registered_budget_is_tempered(spark):
    from tramline.llm.queries import QUERIES

    rows = QUERIES["p7_tempered"](spark, "/root/testdata/sf0.01").collect()
    have = {r.source: r.tokens for r in rows}
    assert 0.01 < rows[0].exponent < 0.99 and sum(r.used_tokens for r in rows) == pytest.approx(0.9 * sum(have.values()), rel=0.01)
    assert all(r.used_tokens <= r.max_repeats * r.tokens for r in rows)
    assert any(r.weight * 0.9 * sum(have.values()) == pytest.approx(r.max_repeats * r.tokens, rel=1e-6) for r in rows)  # one limit binds


def test_largest_mix_within_tolerance(spark):
    """The exponent of the registered mix lies inside (0, 1), every target that can be met is, and none is further off than the tolerance."""
    from tramline.llm.queries import QUERIES

    rows = QUERIES["p7_shares"](spark, "/root/testdata/sf0.01").collect()
    some = [r for r in rows if r.tokens and r.target_share]
    reach = sum(r.target_share for r in some)
    off = [abs(r.weight * reach / r.target_share - 1) for r in some]
    assert 0.001 < rows[0].exponent < 0.999 and max(off) == pytest.approx(0.02, rel=1e-3)
    assert all(r.met for r in some) and not any(r.met for r in rows if not r.tokens)
    exact = plan([float(r.tokens) for r in rows], [r.target_share for r in rows], [float(r.max_repeats) for r in rows], tolerance=0.0)
    assert sum(r.used_tokens for r in rows) > 1.01 * exact.budget


def test_registered_entropy_is_met(spark):
    from tramline.llm.queries import QUERIES

    rows = QUERIES["p7_entropy"](spark, "/root/testdata/sf0.01").collect()
    can = [r.target_share for r in rows if r.tokens]
    assert 0.01 < rows[0].exponent < 0.99 and entropy([r.weight for r in rows]) == pytest.approx(entropy(temper(can, 1.0)), abs=1e-6)
    assert all(r.reached_share == pytest.approx(r.weight, rel=0.05) for r in rows if r.tokens)


def test_shares_are_reached(spark):
    docs = [(k, f"text number {k} " * (1 + k % 7), ["big", " BIG", "small_one", "small-one", None, "other"][k % 6]) for k in range(3000)]
    docs += [(9000, None, "big"), (9001, "", "small-one")]
    targets = [("big", 0.5, 1), ("small-one", 0.45, 3), ("ghost", 0.05, 2)]
    m = mix(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as tokens", "2 as copies"), spark.createDataFrame(targets, TARGETS))
    rows = m.rows.collect()
    shares = {r.source: r for r in m.shares.collect()}
    used = {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.tokens * r.copies
        assert 1 <= r.copies <= {"big": 1, "small-one": 3}[r.source]
    assert len({r.doc_id for r in rows}) == len(rows) and not {9000, 9001} & {r.doc_id for r in rows}
    total = sum(used.values())
    for s in ("big", "small-one"):
        assert shares[s].used_tokens == used[s] and shares[s].reached_share == pytest.approx(used[s] / total)
        assert used[s] / total == pytest.approx({"big": 0.5, "small-one": 0.45}[s] / 0.95, abs=0.01)
    assert not shares["ghost"].met and shares["ghost"].reached_share == 0


def test_token_sizes_are_the_tokenizers(spark):
    import base64

    import tiktoken

    from tramline.llm.mixing import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    e = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a", "Grüße 你好 สวัสดี", "<|endoftext|>", "x" * 5000]
    got = {r.doc_id: r.tokens for r in token_sizes(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS)).collect()}
    for k, t in enumerate(texts):
        ids = e.encode_ordinary(t)
        assert got[k] == len(ids) and e.decode(ids) == t


def test_empty(spark):
    m = mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert m.rows.count() == 0 and m.shares.first().reached_share == 0
    assert mix(spark.createDataFrame([(1, "x", "a")], DOCS), spark.createDataFrame([], TARGETS)).rows.count() == 0
