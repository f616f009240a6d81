from fotolake.llm import mixture as m

TARGETS = [(" A ", 0.5, 1), ("b", 0.3, 2), ("C", 0.2, 4), ("none", 0.0, 1)]


def frames(spark, docs, targets=TARGETS):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string, share string")
    return d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def corpus():
    docs = [(k, f"word {k} and some more text " * (1 + k % 5), "a", "", "") for k in range(400)]
    docs += [(1000 + k, f"another {k} line of text", " B", "", "") for k in range(300)]
    docs += [(2000 + k, f"small {k} source", "c ", "", "") for k in range(60)]
    return docs + [(9001, None, "a", "", ""), (9002, "", "a", "", ""), (9003, "x", None, "", ""), (9004, "x", "other", "", ""), (9005, "x", "  ", "", "")]


def test_shares_caps_and_order(spark):
    d, t = frames(spark, corpus())
    mix = m.mixture(d, t).cache()
    rows = mix.collect()
    pos = [r.position for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    got = {r.source: r for r in m.shares(mix, t).collect()}
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    for s, cap in (("a", 1), ("b", 2), ("c", 4)):
        assert abs(got[s].actual_share - got[s].target_share) < 0.02 and got[s].most_uses <= cap
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    assert not {r.doc_id for r in rows} & {9001, 9002, 9003, 9004, 9005}
    # the source that may repeat most gains weight over time, and nothing is lost: tokens before are exact sums
    late = lambda s: sum(r.tokens for r in rows if r.source == s and r.position > 0.5) / sum(r.tokens for r in rows if r.source == s)
    assert late("c") > 0.55 > 0.5 > late("a") - 0.02
    for s in "abc":
        own = sorted((r for r in rows if r.source == s), key=lambda r: r.source_tokens_before)
        assert all(x.source_tokens_before + x.tokens <= y.source_tokens_before for x, y in zip(own, own[1:]))


def test_budget_beyond_the_caps_shows_in_the_shares(spark):
    d, t = frames(spark, corpus())
    mix = m.mixture(d, t, total_tokens=10**7).cache()
    uses = {r.source: r.most_uses for r in m.shares(mix, t).collect()}
    assert uses == {"a": 1, "b": 2, "c": 4}
    assert mix.where("source = 'c'").count() == 240
    small = m.mixture(d, t, total_tokens=500)
    assert 300 < sum(r.tokens for r in small.collect()) <= 500


def test_running_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_DOCS", 7)
    sized = spark.createDataFrame([(k, "s", 1 + k % 3) for k in range(200)], "doc_id long, source string, tokens long")
    rows = sorted(m.running_tokens(sized, 0).collect(), key=lambda r: r.before)
    total = 0
    for r in rows:
        assert r.before == total
        total += r.tokens


def test_empty(spark):
    d, t = frames(spark, [])
    assert m.mixture(d, t).count() == 0
    assert [r.actual_share for r in m.shares(m.mixture(d, t), t).collect()] == [0.0, 0.0, 0.0]
    d, t = frames(spark, corpus()[:3], [("zzz", 1.0, 1)])
    assert m.mixture(d, t).count() == 0


def test_token_counts(spark):
    d, _ = frames(spark, [(1, "Hello world", "x", "", ""), (2, None, "x", "", ""), (3, "<|endoftext|>", "x", "", ""), (None, "x", "x", "", "")])
    got = {r.doc_id: r.tokens for r in m.token_counts(d).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] > 1 and len(got) == 3


def test_schedules_with_knots(spark):
    d, t = frames(spark, corpus())
    knots = [("A", 0.0, 3.0), ("a", 0.5, 3.0), ("a", 0.5, 1.0), (" b", 0.25, 0.0), ("b", 0.75, 2.0), ("c", 0.8, 0.0), ("c", 1.0, 5.0), ("c", 2.0, 9.0), ("c", None, 9.0), ("zzz", 0.1, 1.0), (None, 0.1, 1.0)]
    sched = spark.createDataFrame(knots, "source string, at double, weight double")
    plan = {r.source: r for r in m.curriculum(m.targets_of(t), sched).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        last = plan[s].pieces[-1]
        assert abs(last.y0 + (last.t1 - last.t0) * (last.w0 + last.w1) / 2 - share) < 1e-12
    assert [(p.t0, p.t1) for p in plan["b"].pieces] == [(0, 0.25), (0.25, 0.75), (0.75, 1)]
    rows = m.mixture(d, t, schedule=sched).collect()
    pos = [r.position for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    by = {s: [r for r in rows if r.source == s] for s in "abc"}
    # b has no weight before 0.25, c none before 0.8; a runs evenly
    assert min(r.position for r in by["b"]) >= 0.25 and min(r.position for r in by["c"]) >= 0.8
    total = sum(r.tokens for r in by["a"])
    for q in (0.2, 0.5, 0.9):
        assert abs(sum(r.tokens for r in by["a"] if r.position < q) / total - q) < 0.03
    # the weight of b rises to 0.75: (0.5 x 2 / 2) of (0.5 + 0.25 x 2) stands before
    total = sum(r.tokens for r in by["b"])
    assert abs(sum(r.tokens for r in by["b"] if r.position < 0.75) / total - 0.5) < 0.03
    got = {r.source: r for r in m.shares(m.mixture(d, t, schedule=sched), t).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in got.values())
    even = m.mixture(d, t, schedule=sched.where("false")).where("source = 'c'").collect()
    assert abs(sum(r.tokens for r in even if r.position < 0.5) / sum(r.tokens for r in even) - 0.5) < 0.05
