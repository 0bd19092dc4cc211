import random

from stratagraph.llm import mix as M

DOC = "doc_id long, source string, text string, tokens string"
TGT = "mix_id string, source string, target_share double, max_repeats int, size_ratio double"


def run(spark, docs, targets):
    chosen, report = M.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TGT))
    return chosen.collect(), {(r.mix_id, r.source): r for r in report.collect()}


def test_shares_and_caps(spark):
    r = random.Random(2)
    docs = [(i, r.choice([" Big", "BIG", "small "]) if i % 5 else "small", "word " * r.randint(1, 60), "!") for i in range(900)]
    targets = [("m", "big", 0.6, 2, 0.5), ("m", "small", 0.4, 3, 0.5), ("n", "small", 0.9, 1, 1.0), ("n", "none", 0.1, 2, 1.0)]
    chosen, rep = run(spark, docs, targets)
    sizes: dict = {}
    for c in chosen:
        assert 1 <= c.copies <= {("m", "big"): 2, ("m", "small"): 3, ("n", "small"): 1}[(c.mix_id, c.source)]
        sizes[(c.mix_id, c.source)] = sizes.get((c.mix_id, c.source), 0) + c.tokens * c.copies
    assert len({(c.mix_id, c.doc_id) for c in chosen}) == len(chosen)
    for k, v in sizes.items():
        assert rep[k].actual_tokens == v
        if rep[k].reached:
            assert abs(v - rep[k].target_tokens) <= 130
    assert abs(rep[("m", "big")].actual_share - 0.6) < 0.02
    assert not rep[("n", "small")].reached and rep[("n", "small")].actual_tokens == rep[("n", "small")].available_tokens
    assert rep[("n", "none")].actual_tokens == 0


def test_odd_rows(spark):
    docs = [(1, None, "a b", "!"), (2, "s", None, "!"), (3, "s", "", "!"), (4, "s", "x y z", "!"), (4, "s", "x y z", "!"), (5, "s", "w " * 100000, "!")]
    chosen, rep = run(spark, docs, [("m", "s", 1.0, 4, 3.0), ("m", "t", 0.0, 1, 3.0)])
    assert {c.doc_id for c in chosen} <= {4, 5} and rep[("m", "t")].actual_tokens == 0
    chosen, rep = run(spark, [*docs, (None, "s", "q q", "!")], [("m", "s", None, None, 1.0), ("m", None, 0.5, 1, 1.0), ("n", "s", 1.0, None, 0.5)])
    assert set(rep) == {("m", "s"), ("n", "s")} and rep[("m", "s")].actual_tokens == 0 and all(c.copies == 1 and c.doc_id for c in chosen)
    chosen, rep = run(spark, [], [("m", "s", 1.0, 4, 3.0)])
    assert chosen == [] and rep[("m", "s")].actual_tokens == 0
    assert run(spark, docs, []) == ([], {})


def test_newton_meets_the_constraint(spark):
    import math

    h = spark.createDataFrame([("s", t, n) for t, n in ((1, 500), (10, 90), (300, 7), (0, 4))], "source string, tokens long, n long")
    for share in (0.1, 0.8, 1.7, 2.9):
        full = 500 + 900 + 2100
        t = spark.createDataFrame([("m", "s", 1.0, 3, share * full)], "mix_id string, source string, target_share double, max_repeats int, target double")
        (_, _, want, cap, _, mean, lam, *_), = M._solve(h, t)
        got = sum(n * t_ * min(cap, math.exp(lam * t_ / mean)) for t_, n in ((1, 500), (10, 90), (300, 7)))
        assert abs(got - want) < 1e-3 * want
