from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkledger.llm.names import CROWD, distance, keys, near, resolve_names, same, snap, spelling, typos


def test_words_and_distance():
    assert snap("ENGRG") == "ENGINEERING" and snap("MANAGEENT") == "MANAGEMENT" and snap("ZZZZZZZ") == "ZZZZZZZ"
    assert distance("abcd", "abdc", 2) == 1 and distance("abcd", "xycd", 2) == 2 and distance("abcdef", "ghijkl", 2) == 3


def test_spellings():
    s = spelling
    assert s("Harlowmere Technologies Engineering, L.L.C.") == s("ENGRG TECH., HARLOWMERE LLC") == s("The Harlowmere Engineering & Technologies Co (Registered)")
    assert s("Pemberton, Bill R.") == s("WILLIAM R PEMBERTON") and s("HarlowmereTech Co") == s("Harlowmere Technologies")
    assert same(s("Harl0wmere Tech"), s("Harlowmree Technologies Inc")) and not same(s("Harlowmere Foods Inc"), s("Harlowmere Optics Inc"))
    assert not same(s("William R. Pemberton"), s("Robert R. Pemberton")) and not same(s("William R. Pemberton"), s("William S. Pemberton"))
    assert s("") and s("---") and s("Ltd")


def test_two_replaced_letters():
    assert typos("SAMARADEFE", "SAMASADEGE", 2) == 3 and typos("SAMARADEFE", "SAMATADEGE", 2) == 2  # R and T, F and G lie side by side
    assert typos("SAMARADEFE", "SAMARDAEFE", 2) == 1 and typos("SAMARADEFE", "SAMRADEFEE", 2) == 2 and typos("SAMARADEFE", "SAMASADEFE", 2) == 1
    assert typos("SAMARADEFEKOLUN", "SAMASADEGEKOLUN", 2) == 2  # long enough to tell


def groups_of(spark, names):
    df = spark.createDataFrame(names, "uei string, name string").repartition(3)
    groups = {}
    for r in resolve_names(df, F.col("uei"), F.col("name")).collect():
        groups.setdefault(r["entity"], set()).add(r["id"])
    return {frozenset(g) for g in groups.values()}


def test_contradictions_stay_apart(spark):
    """However many spellings lie between them, in whatever blocks."""
    five = ["William A. Pembertonlongx", "William A. Pembrtonlongx", "Will Pembertonlongx", "William B. Pembertnlongx", "William B. Pembertonlonx"]
    given = ["Alfred Quenstallis", "Fred Quenstalis", "Frederick Quenstallis", "Frederick Quenstalllis"]
    got = groups_of(spark, [(f"p{i}", n) for i, n in enumerate(five)] + [(f"g{i}", n) for i, n in enumerate(given)])
    of = {x: g for g in got for x in g}
    assert of["p0"] == of["p1"] != of["p3"] == of["p4"] and of["p2"] in (of["p0"], of["p3"])
    assert of["g0"] != of["g2"] == of["g3"] and of["g1"] in (of["g0"], of["g2"])


def test_richer_profiles_match_again(spark):
    """A spelling with both initials brings those with one of them together, which alone contradict each other."""
    assert groups_of(spark, [("a", "William A. Trevanion"), ("b", "William B. Trevanion"), ("c", "William A. B. Trevanion")]) == {frozenset("abc")}


def test_a_crowded_block_is_searched_alike():
    rng = random.Random(2)
    core = "QUENTALLISVORM"
    many = sorted({f"O|{edits(core, rng.randint(0, 3), rng)}" for _ in range(3 * CROWD)} | {"OFOODS|QUENTALLISVORM"})
    brute = {(a, b) for i, a in enumerate(many) for b in many[i + 1 :] if a.split("|")[0] == b.split("|")[0] and 0 < typos(a.split("|")[1], b.split("|")[1], 2) <= 2}
    assert len(many) > CROWD and {(a, b) for a, b, _ in near(many)} == brute


def test_merge_and_rematch(spark):
    names = [
        ("u1", "Harlowmere Engineering Partners"), ("u2", "HARLOWMERE ENGRG PTNRS"), ("u3", "Engineering, Harlowmeer LP"), ("u4", "Harlowmere Optics Partners"), ("u1", "Quentallis Foods Ltd"), ("u5", "Quentalis Foods"),
        ("u6", "Margaret K. Trevanion"), ("u7", "Trevanion, Peggy"), ("u8", "M. Trevanion"), ("u9", "John Trevanion"), ("u10", None), (None, "Harlowmere Engineering Partners"), ("u2", "HARLOWMERE ENGRG PTNRS"), ("u11", "x" * 3000), ("u12", "***"), ("u13", "***"),
    ]
    df = spark.createDataFrame([(*n, "a", "b") for n in names], "uei string, name string, entity string, pid string").repartition(3)
    groups = {}
    for r in resolve_names(df, F.col("uei"), F.col("name")).collect():
        groups.setdefault(r["entity"], set()).add(r["id"])
    got = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert got == {frozenset({"u1", "u2", "u3"}), frozenset({"u1", "u5"}), frozenset({"u6", "u7"}), frozenset({"u12", "u13"})}
    assert resolve_names(df.where("false"), F.col("uei"), F.col("name")).count() == 0


def edits(w: str, n: int, rng: random.Random) -> str:
    for _ in range(n):
        at = rng.randrange(len(w) - 1)
        w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("KQXZ") + w[at:], w[:at] + rng.choice("KQXZ") + w[at + 1 :], w[:at] + w[at + 1] + w[at] + w[at + 2 :]])
    return w


def full_distance(a: str, b: str) -> int:
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_distance_in_a_band():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choices("ABC", k=rng.randint(0, 9)))
        b = edits(a, rng.randint(0, 4), rng) if len(a) > 5 else "".join(rng.choices("ABC", k=rng.randint(0, 9)))
        for limit in (0, 1, 2):
            assert distance(a, b, limit) == min(full_distance(a, b), limit + 1), (a, b, limit)


def test_two_edits_share_a_block_at_every_length():
    rng = random.Random(7)
    form = lambda core: f"O|{core}|||"
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    node = lambda core: f"O|{core}"
    for n in (8, 9, 10, 11, 12, 13, 20, 22, 23, 24, 25, 26, 27, 28, 33, 40, 64, 65, 66, 79, 200, 1000):
        core = "".join(rng.choices("ABCDEFGHIJLMNOPRSTUVWY", k=n))
        others = [x for x in (edits(core, 2, rng) for _ in range(40)) if typos(core, x, 2) <= 2 and len(x) >= 8]  # shorter ones allow one edit
        if n < 80:
            others += [swap(swap(core, i), j) for i in range(0, n - 1) for j in range(i + 2, n - 1)]
        mine = keys(node(core))
        assert len(mine) <= 90
        for other in others:
            assert same(form(core), form(other)) and mine & keys(node(other)), (core, other)


def test_two_typos_in_long_cores(spark):
    core30, core80 = "QUENTALLISVORMANDREWICKHOLMSTA", "QUENTALLISVORMANDREWICKHOLMSTABRUNDERFELTGARLOWINSKOTHEPVARRIMOLDANESTRUWYKBELTO"
    assert (len(core30), len(core80)) == (30, 80)
    two = lambda w, i, j: w[:i] + "X" + w[i + 1 : j] + "X" + w[j + 1 :]
    inserted = lambda w, i, j: w[:i] + "X" + w[i + 1 : j] + "X" + w[j:]
    names = [("a1", core30), ("a2", two(core30, 4, 22)), ("a3", inserted(core30, 12, 27)), ("b1", core80), ("b2", two(core80, 10, 60)), ("b3", inserted(core80, 2, 40)), ("c1", two(two(core30, 2, 9), 16, 25)), ("d1", "Smithsonian Astrophysical Observatory"), ("d2", "Smithsonian Astrophyzical Obzervatory")]
    df = spark.createDataFrame(names, "uei string, name string").repartition(3)
    groups = {}
    for r in resolve_names(df, F.col("uei"), F.col("name")).collect():
        groups.setdefault(r["entity"], set()).add(r["id"])
    got = {frozenset(g) for g in groups.values() if len(g) > 1}
    # a2 and a3 stand apart from each other but both match a1; c1 is four replacements away
    assert got == {frozenset({"a1", "a2", "a3"}), frozenset({"b1", "b2", "b3"}), frozenset({"d1", "d2"})}
