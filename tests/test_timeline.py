import itertools
import random
from datetime import datetime, timezone

import pytest

from fotolake.functions.instants import interpretations
from fotolake.operators import timeline as t


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def one(text, zone=None, **kw):
    got = {u for _, u in interpretations(text, zone, **kw)}
    return got.pop() if len(got) == 1 else sorted(got)


@pytest.mark.parametrize(
    "text,zone,want",
    [
        ("2020:02:14 09:17:30", "UTC", us(2020, 2, 14, 9, 17, 30)),
        (" 2020:02:14 09:17:30\t", "+05:30", us(2020, 2, 14, 3, 47, 30)),
        ("2020:02:14 09:17:30", None, []),
        ("2020:02:14 09:17:30", "Mars/Base", []),
        ("2020:02:14 09:17:30.1239999", "UTC", us(2020, 2, 14, 9, 17, 30) + 123_999),
        ("2021-03-01T19:24:16-08:00[America/Los_Angeles]", "Asia/Tokyo", us(2021, 3, 2, 3, 24, 16)),
        ("2013-01-10T15:49:16.323414283-0500", None, us(2013, 1, 10, 20, 49, 16) + 323_414),
        ("20181015T002451Z", None, us(2018, 10, 15, 0, 24, 51)),
        ("2022-04-15 13:35:22 GMT", "Asia/Tokyo", us(2022, 4, 15, 13, 35, 22)),
        ("03.04.2021 06:45:37", "UTC", us(2021, 4, 3, 6, 45, 37)),
        ("03/04/2021 12:05 AM", "UTC", us(2021, 3, 4, 0, 5)),
        ("03/04/2021 12:05 PM", "UTC", us(2021, 3, 4, 12, 5)),
        ("2015/04/26 12:14", "UTC", us(2015, 4, 26, 12, 14)),
        ("7 Apr 2020 18:37", "UTC", us(2020, 4, 7, 18, 37)),
        ("Oct 30, 2022 2:52:09 AM", "UTC", us(2022, 10, 30, 2, 52, 9)),
        ("Sun, 29 Mar 2020 00:40:39 +0100", None, us(2020, 3, 28, 23, 40, 39)),
        ("2020-05-06", "UTC", us(2020, 5, 6)),
        ("1519545463", None, 1_519_545_463_000_000),
        ("1519545463.25", None, 1_519_545_463_250_000),
        ("1519545463123", None, 1_519_545_463_123_000),
        ("1519545463123456", None, 1_519_545_463_123_456),
        ("151954546", None, []), ("0", None, []), ("", "UTC", []), (None, "UTC", []), ("n/a", "UTC", []), ("    :  :     :  :  ", "UTC", []),
        ("0000:00:00 00:00:00", "UTC", []), ("2021:13:45 99:99:99", "UTC", []), ("2021-02-30T10:00:00Z", None, []), ("31.11.2017 10:30:00", "UTC", []), ("13/13/2020 1:00 PM", "UTC", []),
        ("2021-03-28T02:30:00", "Europe/Berlin", []),  # skipped
        ("2021-10-31T02:30:00", "Europe/Berlin", [us(2021, 10, 31, 0, 30), us(2021, 10, 31, 1, 30)]),  # twice
        ("2021-04-04T01:45:00", "Australia/Lord_Howe", [us(2021, 4, 3, 14, 45), us(2021, 4, 3, 15, 15)]),  # half an hour
        ("2021-10-31T02:30:00+01:00", "Europe/Berlin", us(2021, 10, 31, 1, 30)),
        ("x" * 100_000, "UTC", []),
    ],
)
def test_readings(text, zone, want):
    assert one(text, zone) == want


def test_undeclared_orders_give_both_readings():
    assert one("03/04/2021", "UTC", conventions=frozenset()) == [us(2021, 3, 4), us(2021, 4, 3)]
    assert one("13/04/2021", "UTC", conventions=frozenset()) == us(2021, 4, 13)


def cost(values, picks):
    c = t.LATER * picks[0]
    for (f, u), (g, v), a, b in zip(values, values[1:], picks, picks[1:]):
        c += (t.SWITCH if f[a] != g[b] else 0) + (t.BACKWARD if v[b] < u[a] else 0) + t.LATER * b
    return c


def random_values(rng, n):
    out = []
    for _ in range(n):
        k = rng.choice([1, 2, 2, 3])
        out.append(([rng.randrange(3) for _ in range(k)], [rng.randrange(9) for _ in range(k)]))
    return out


def test_viterbi_equals_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        v = random_values(rng, rng.randrange(1, 7))
        best = min(cost(v, p) for p in itertools.product(*[range(len(x[0])) for x in v]))
        assert abs(cost(v, t.choose(v)) - best) < 1e-9


def test_pieces_settled_at_borders_equal_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        v = random_values(rng, rng.randrange(2, 12))
        cuts = sorted({0, len(v), *rng.choices(range(1, len(v)), k=2)})
        parts = [v[a:b] for a, b in zip(cuts, cuts[1:])]
        fixed = t.settle([{"key": i, "first": p[0], "last": p[-1], "cost": t.summary(p)} for i, p in enumerate(parts)])
        picks = [x for i, p in enumerate(parts) for x in t.choose(p, *fixed[i])]
        assert abs(cost(v, picks) - cost(v, t.choose(v))) < 1e-9


def test_a_long_source_spread_over_partitions(spark):
    # a device that writes days first; only the 13th and later tell so
    rows = [("dev", "f", k, f"{1 + k % 28:02d}/{1 + k // 28:02d}/2021", "UTC", "clash") for k in range(300)]
    rows += [("dev", "g", 1, None, "UTC", ""), (None, "f", 1, "junk", None, ""), ("dev", "f", 5, "06/01/2021", "UTC", "")]
    df = spark.createDataFrame(rows, "source string, field_name string, ord long, text string, tz_name string, formats string")
    got = t.resolve_instants(df, conventions=frozenset())
    out = got.collect()
    assert len(out) == len(rows)
    right = [r for r in out if r.field_name == "f" and r.source]
    assert {r.format_name for r in right} == {"slashed_dmy"}
    assert all(r.utc_us == us(2021, 1 + r.ord // 28, 1 + r.ord % 28) for r in right)
    assert [r.n_instants for r in out if r.source == "" or r.field_name == "g"] == [0, 0]
    assert t.resolve_instants(df.where("false")).count() == 0


def test_field_values(spark):
    rows = [(1, "UTC", "A", "1519545463", None, "x")] * 2 + [(2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "meta_id long, tz_name string, camera_model string, date_taken string, date_created string, mtime string")
    assert t.field_values(df).count() == 6


@pytest.mark.parametrize(
    "text,us",
    [
        ("1600000000." + "1234567" + "8" * 190, 1_600_000_000_123_456),
        ("2021-05-05T10:00:00." + "5" * 300 + "Z", 1_620_208_800_555_555),
        ("2021-05-05" + " " * 300 + "10:00:00Z", 1_620_208_800_000_000),
    ],
)
def test_long_texts_mean_what_short_ones_do(text, us):
    assert {u for _, u in interpretations(text, None)} == {us}


def test_long_junk_is_left_at_once():
    for junk in ("2021-05-05" + " " * 20_000 + "x", "1" * 20_000, "monday, " + "may " * 5_000, "2021-05-05 10:00:00." + "1" * 20_000 + "x", "5 may" + " " * 20_000):
        assert interpretations(junk, "UTC") == []
