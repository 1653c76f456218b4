import random
from collections import defaultdict

from millrace.operators import areas as A
from millrace.operators import baseline as B

FINDING = "key string, family string, file string, line int, title string"


def brute(files, budget):
    """The split as a recursion over one repository: path to the first path of its area."""

    def pack(items):
        out, now, size = [], [], 0
        for first, paths, n in items:
            if now and size + n > budget:
                out.append((now, size))
                now, size = [], 0
            now, size = now + paths, size + n
        return out + ([(now, size)] if now else [])

    def folder(name, own):
        if sum(own.values()) <= budget:
            return [(sorted(own), sum(own.values()), None)]
        at = len(name) + 1 if name else 0
        loose = sorted(p for p in own if "/" not in p[at:])
        subs = defaultdict(dict)
        for p in own:
            if "/" in p[at:]:
                subs[p[: at + p[at:].index("/")]][p] = own[p]
        parts = [(paths, n, name) for paths, n in pack([(p, [p], own[p]) for p in loose])]
        for sub, of in subs.items():
            parts += [(paths, n, name if parent is None else parent) for paths, n, parent in folder(sub, of)]
        parts.sort(key=lambda x: x[0][0])
        merged = []
        for paths, n, parent in parts:
            if merged and merged[-1][2] == parent == name and merged[-1][1] + n <= budget:
                merged[-1] = (merged[-1][0] + paths, merged[-1][1] + n, parent)
            else:
                merged.append((paths, n, parent))
        return merged

    return {p: min(paths) for paths, _, _ in folder("", files) for p in paths}


def test_areas_are_those_of_the_recursion(spark):
    r, repos = random.Random(2), {}
    for repo in range(12):
        files = {}
        for _ in range(r.randrange(1, 60)):
            depth = r.choice((0, 1, 1, 2, 3, 5))
            path = "/".join([r.choice(("a", "b", "b-c", "b.d", "e")) for _ in range(depth)] + [f"f{r.randrange(40)}.py"])
            files[path] = r.choice((0, 5, 20, 30, 45, 60, 130))
        repos[repo] = files
    rows = [(k, p, n) for k, files in repos.items() for p, n in files.items()]
    got = A.areas(spark.createDataFrame(rows, "repo int, path string, lines int").repartition(7), 100).collect()
    assert len(got) == len(rows)
    for k, files in repos.items():
        assert {r["path"]: r["area"] for r in got if r["repo"] == k} == brute(files, 100), files


def test_areas_of_a_deep_tree_and_odd_rows(spark):
    deep = {"/".join(f"d{k}" for k in range(n)) + f"/f{n}.py": 30 for n in range(1, 30)}
    rows = [(1, p, n) for p, n in deep.items()] + [(2, None, 3), (3, "x", None), (None, "y", 4)]
    got = {(r["repo"], r["path"]): r["area"] for r in A.areas(spark.createDataFrame(rows, "repo int, path string, lines int"), 100).collect()}
    assert {p: got[1, p] for p in deep} == brute(deep, 100) and got[3, "x"] == "x"


def pairs_by_hand(candidates):
    used, out = set(), set()
    for distance, old, new in sorted((d, o, n) for n, o, d in candidates):
        if ("o", old) not in used and ("n", new) not in used:
            used |= {("o", old), ("n", new)}
            out.add((new, old))
    return out


def test_contested_matches_are_one_to_one(spark):
    r = random.Random(8)
    for size in (1, 30, 200):
        candidates = list({(f"n{a}", f"o{b}"): (f"n{a}", f"o{b}", r.randrange(5)) for a, b in ((r.randrange(size), r.randrange(size)) for _ in range(3 * size))}.values())
        got = {tuple(x) for x in B.one_to_one(spark.createDataFrame(candidates, "new string, old string, distance int")).collect()}
        assert got == pairs_by_hand(candidates)
    chain = [(f"n{k:03}", f"o{k + j:03}", 100 - 2 * k - j) for k in range(12) for j in (0, 1)]
    assert {tuple(x) for x in B.one_to_one(spark.createDataFrame(chain, "new string, old string, distance int")).collect()} == pairs_by_hand(chain)
    assert B.one_to_one(spark.createDataFrame([], "new string, old string, distance int")).collect() == []


def test_states_and_the_baseline_after_them(spark):
    base = [
        ("same", "f", "a.py", 10, "Empty catch", "pending", None), ("moved", "f", "a.py", 20, "x", "rejected", None), ("old1", "f", "b.py", 30, "Empty catch swallows write failure", "accepted", "2026-01-01"),
        ("old2", "f", "b.py", 34, "Empty catch swallows write failure", "accepted", "soon"), ("gone", "f", "c.py", 1, "t", "pending", None), ("kept", "f", "c.py", 2, "t", "rejected", None), ("nofile", "g", None, None, "t", "pending", None),
    ]
    now = [("same", "f", "a.py", 10, "Empty catch"), ("moved", "f", "a.py", 21, "x"), ("new1", "f", "b.py", 31, "Empty catch hides failure"), ("new2", "f", "b.py", 32, "empty CATCH write"), ("new3", "f", "b.py", 33, "empty catch failure"), ("new4", "g", "b.py", 30, "Empty catch swallows"), ("new5", "f", "b.py", None, "Empty catch swallows write failure")]
    findings, baseline = spark.createDataFrame(now, FINDING), spark.createDataFrame(base, FINDING + ", status string, until string")
    gone = spark.createDataFrame([("gone",), ("gone",)], "key string")
    got = B.compared(findings, baseline, gone, "2025-06-01")
    assert {r["key"]: (r["state"], r["matched"], r["note"]) for r in got.collect()} == {
        "same": ("UNCHANGED", "same", None), "moved": ("SUPPRESSED", "moved", None), "new1": ("SUPPRESSED", "old1", "suppressed by edited match"), "new3": ("EDITED", "old2", "until is not a date"),
        "new2": ("NEW", None, None), "new4": ("NEW", None, None), "new5": ("NEW", None, None), "gone": ("RESOLVED", None, None), "nofile": ("RESOLVED", None, "file unknown"),
    }
    after = {r["key"]: (r["line"], r["status"], r["until"]) for r in B.recorded(findings, baseline, got).collect()}
    assert after == {"same": (10, "pending", None), "moved": (21, "rejected", None), "new1": (31, "accepted", "2026-01-01"), "new3": (33, "accepted", "soon"), "new2": (32, "pending", None), "new4": (30, "pending", None), "new5": (None, "pending", None), "kept": (2, "rejected", None)}


def test_edits_are_paired_without_a_row_for_each_candidate(spark, monkeypatch):
    r = random.Random(5)
    title = lambda: " ".join(r.sample(("catch", "Empty", "write", "all", "x1"), r.randrange(0, 4)))
    side = lambda name, n: [(f"{name}{k}", r.choice(("f", "g")), r.choice(("a.py", "b.py", None)), r.choice((None, *range(60))), title()) for k in range(n)]
    now, old = (spark.createDataFrame(side(name, 150), FINDING) for name in "no")
    want = pairs_by_hand([tuple(x) for x in B.edit_candidates(now, old).collect()])
    assert want and {tuple(x) for x in B.edit_pairs(now, old).collect()} == want
    # as many findings as entries at one place: one row each, where candidates are their square
    monkeypatch.setattr(B, "edit_candidates", None)
    many = spark.range(3000).selectExpr("'k' || id AS key", "'f' AS family", "'a.py' AS file", "7 AS line", "'t' AS title")
    entries = many.selectExpr("'o' || key AS key", "family", "file", "line", "title", "'pending' AS status", "cast(null AS string) AS until")
    got = B.compared(many, entries, spark.createDataFrame([], "key string"), "2025-01-01").collect()
    assert len(got) == 3000 and {(x["state"], x["matched"]) for x in got} == {("EDITED", "o" + x["key"]) for x in got}
