import itertools

import pytest

from paperloom.operators.timestamps import BACK, SWITCH, interpretations, normalise_timestamps, reading_counts, resolve, viterbi

CASES = [
    ("28.11.2022 14:02", "Europe/Berlin", "de-DE", "2022-11-28T13:02:00.000000Z"),
    ("2022-03-27 02:30", "Europe/Berlin", "de-DE", "2022-03-27T01:30:00.000000Z"),  # skipped hour moves forward
    ("2022-10-30 02:30", "Europe/Berlin", "de-DE", "2022-10-30T00:30:00.000000Z"),  # doubled hour is the earlier
    ("2023-10-15T09:29:12.139226284", "Europe/Berlin", "de-DE", "2023-10-15T07:29:12.139226Z"),
    ("03/04/2024", "America/Chicago", "en-US", "2024-03-04"),
    ("03/04/2024", "Europe/London", "en-GB", "2024-04-03"),
    ("31/04/2025", "America/Chicago", "en-US", None),
    ("l4.O2.2023", "Europe/Berlin", "de-DE", "2023-02-14"),
    ("28.02.202l", "Europe/Berlin", "de-DE", "2021-02-28"),
    ("22 . 07 . 2025", "Europe/Berlin", "de-DE", "2025-07-22"),
    ("16.1.22", "Europe/Berlin", "de-DE", "2022-01-16"),
    ("2025-W07-1", "Europe/Berlin", "de-DE", "2025-02-10"),
    ("2025-258", "Europe/Berlin", "de-DE", "2025-09-15"),
    ("11/2022", "Europe/Berlin", "de-DE", "2022-11"),
    ("November 2021", "Europe/Berlin", "de-DE", "2021-11"),
    ("1748973451", "Europe/Berlin", "de-DE", "2025-06-03T17:57:31.000000Z"),
    ("1729349408848", "Asia/Tokyo", "en-GB", "2024-10-19T14:50:08.848000Z"),
    ("20230326043433", "Europe/Berlin", "de-DE", "2023-03-26T02:34:33.000000Z"),
    ("9 de junio de 2021, 22:18", "Europe/Madrid", "es-ES", "2021-06-09T20:18:00.000000Z"),
    ("16 septembre 2022 à 21h09", "Europe/Paris", "fr-FR", "2022-09-16T19:09:00.000000Z"),
    ("Nov 8, 2021 9:24 p.m.", "America/New_York", "en-US", "2021-11-09T02:24:00.000000Z"),
    ("10.08.2023 15:27:35 MESZ", "Europe/Berlin", "de-DE", "2023-08-10T13:27:35.000000Z"),
    ("2022-03-27T01:29:16+01:00[Europe/Berlin]", "Asia/Tokyo", "en-GB", "2022-03-27T00:29:16.000000Z"),
    ("Thu, 28 Apr 2022 22:24:13 +0530\n", "Asia/Kolkata", "en-GB", "2022-04-28T16:54:13.000000Z"),
    ("", "Europe/Berlin", "de-DE", None), ("KW ??", "Europe/Berlin", "de-DE", None), ("25:61 Uhr", "Europe/Berlin", "de-DE", None),
    ("04.2O2?", "Europe/Berlin", "de-DE", None), ("29.02.2023", "Europe/Berlin", "de-DE", None), ("x" * 50_000, "Europe/Berlin", "de-DE", None),
]


@pytest.mark.parametrize("value,zone,locale,want", CASES)
def test_values(value, zone, locale, want):
    # a chain of one record takes its cheapest reading
    assert viterbi([resolve(interpretations(value), zone, locale)]) == [want]


def cost(chain, pick):
    total = sum(c[k][3] for c, k in zip(chain, pick))
    for (a, i), (b, j) in itertools.pairwise(zip(chain, pick)):
        total += SWITCH * (a[i][0] != b[j][0]) + BACK * (b[j][2] < a[i][2])
    return total


def test_viterbi_against_all_choices():
    import random

    r = random.Random(5)
    for _ in range(200):
        chain = [[(r.choice("ab"), f"{i}{k}", r.random(), r.choice([0.0, 0.1])) for k in range(r.randint(1, 3))] for i in range(6)]
        picks = [*itertools.product(*[range(len(c)) for c in chain])]
        best = min(cost(chain, p) for p in picks)
        got = viterbi(chain)
        mine = [next(k for k, c in enumerate(row) if c[1] == g) for row, g in zip(chain, got)]
        assert abs(cost(chain, mine) - best) < 1e-9


def test_unknown_locale_is_read_by_its_neighbours(spark):
    rows = [("t", 1, "s", "13/25/2024"), ("t", 2, "s", "02/25/2024"), ("t", 3, "s", "03/04/2024"), ("t", 4, "s", "03/28/2024")]
    recs = spark.createDataFrame(rows, "rec_table string, rec_id long, owner_scope string, val string")
    sites = spark.createDataFrame([("s", "UTC", None)], "owner_scope string, zone_name string, locale string")
    got = {r.rec_id: r.normal_form for r in normalise_timestamps(recs, sites).collect()}
    assert got == {2: "2024-02-25", 3: "2024-03-04", 4: "2024-03-28"}


def test_nulls_repeats_unknown_sites_and_extra_columns(spark):
    rows = [("t", 1, None, "2024-01-02 03:04", "x"), ("t", 1, None, "2024-01-02 03:04", "x"), ("t", 2, "s", None, "x"), ("t", None, "s", "2024-01-02", "x"), ("u", 1, "s", "2024-01-02", "x")]
    recs = spark.createDataFrame(rows, "rec_table string, rec_id long, owner_scope string, val string, block string")
    sites = spark.createDataFrame([("s", "Europe/Berlin", "de-DE"), (None, "Asia/Tokyo", "en-GB")], "owner_scope string, zone_name string, locale string")
    got = sorted((r.rec_table, r.rec_id, r.normal_form) for r in normalise_timestamps(recs, sites).collect())
    assert got == [("t", 1, "2024-01-02T03:04:00.000000Z"), ("u", 1, "2024-01-02")]
    assert normalise_timestamps(recs.limit(0), sites.limit(0)).count() == 0


def test_blocks_change_nothing(spark):
    import random

    r = random.Random(11)
    fit = {"none": None, "us": "en-US", "de": "de-DE"}
    rows = []
    for i in range(900):
        d, m = r.randint(1, 12), r.randint(1, 12)
        val = r.choice([f"{d:02d}/{m:02d}/2024"] * 6 + [f"{r.randint(13, 28)}/{m:02d}/2024", f"{m:02d}/{r.randint(13, 28)}/2024", f"2024-{m:02d}-{d:02d}", "no date"])
        rows.append(("t", i, r.choice([*fit, None]), val))
    recs = spark.createDataFrame(rows, "rec_table string, rec_id long, owner_scope string, val string")
    sites = spark.createDataFrame([(k, "UTC", v) for k, v in fit.items()], "owner_scope string, zone_name string, locale string")
    whole = sorted(map(tuple, normalise_timestamps(recs, sites, 10**9).collect()))
    chain = {s: [(i, resolve(interpretations(v), "UTC" if s else None, fit.get(s))) for _, i, o, v in rows if o == s] for s in [*fit, None]}
    want = sorted(("t", i, f) for c in chain.values() for (i, _), f in zip(c, viterbi([x for _, x in c])) if f)
    assert whole == want
    for block in (1, 3, 40):
        assert sorted(map(tuple, normalise_timestamps(recs, sites, block).collect())) == want
    counts = {(x.readings, x.settled): x.n for x in reading_counts(recs, sites).collect()}
    assert counts[2, True] > 0 and counts[2, False] > 0
