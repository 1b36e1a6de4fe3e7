import random

from conftest import rows
from poolscope.operators import catalogue as c
from poolscope.operators.detectors.libraries import dependency_closure

REPOS = [
    {"name": f"{a}-{comp}/{b}", "architecture": a, "component": comp, "testing": t, "branch": b, "path": f"{b}/{comp}"}
    for a in ("all", "amd64", "arm64") for comp in ("main", "opt") for t, b in enumerate(("stable", "testing"))
]


def test_compatible_repos_by_definition(make):
    repos = make("repos", REPOS)

    def ok(rule, u, p):
        if p["testing"] > u["testing"]:
            return False
        ua, pa, uc, pc = u["architecture"], p["architecture"], u["component"], p["component"]
        return {
            "dependency": (uc != "main" or pc == "main") and (ua == "all" or pa in (ua, "all")),
            "collision": pa in (ua, "all") and pc == uc,
            "soname": ua in (pa, "all") and pc in (uc, "main"),
        }[rule]

    for rule in ("dependency", "collision", "soname"):
        want = sorted((u["name"], p["name"]) for u in REPOS for p in REPOS if ok(rule, u, p))
        assert rows(c.compatible_repos(repos, rule), "repo", "provider") == want


def test_latest_skips_corrupt_and_orders_by_version(make):
    packages = make("packages", [
        {"package": "a", "version": "1.9", "repo": "r", "debtime": 1, "vk": "00!1010h1091!1"},
        {"package": "a", "version": "1.10", "repo": "r", "debtime": 1, "vk": "00!1010h1210!1"},
        {"package": "a", "version": "2", "repo": "r", "debtime": None, "vk": "00!1021!1"},
        {"package": "a", "version": "1", "repo": "s", "debtime": 1, "vk": None},
    ])
    assert rows(c.latest_packages(packages), "repo", "version") == [("r", "1.10"), ("s", "1")]


def test_atoms(make):
    key = {"package": "p", "version": "1", "repo": "r"}
    deps = make("dependencies", [
        dict(key, relationship="Depends", value="aa (>= 1.0) | bb:any [!arm64] <!x>, , cc,c"),
        dict(key, version="0", relationship="Depends", value="old"),
        dict(key, relationship="Suggests", value=""),
    ])
    latest = make("packages", [key])
    got = rows(c.dependency_atoms(deps, latest), "nr", "deppkg", "deparch", "relop", "depver")
    assert got == [
        (1, "aa", None, ">=", "1.0"), (1, "bb", "any", None, None), (2, None, None, None, None),
        (3, "cc", None, None, None), (4, None, None, None, None),
    ]


def test_closure_brute_force(spark):
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(25)]
    edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(60)}
    edges |= {("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n3", "n3")}
    flags = {(rnd.choice(names), rnd.choice(names)) for _ in range(25)} | {("n2", "n0")}
    breaks = spark.createDataFrame([(d, p) for p, d in flags], "package string, dep_package string")
    users = {p for p, _ in flags}
    want, todo = set(), [(p, d) for p, d in edges if p != d and p in users]
    while todo:
        pair = todo.pop()
        if pair in want:
            continue
        want.add(pair)
        if pair not in flags:
            todo += [(pair[0], d) for p, d in edges if p == pair[1]]
    df = spark.createDataFrame(sorted(edges), "package string, dependency string")
    got = rows(dependency_closure(df, breaks))
    assert got == sorted((p, d, (p, d) in flags) for p, d in want)


def test_break_order(spark, make):
    breaks = spark.createDataFrame(
        [("lib", "a"), ("lib", "b"), ("lib", "c"), ("a", "b")], "package string, dep_package string"
    )
    deps = make("source_deps", [
        {"package": "c", "dependency": "a", "relationship": "BUILDDEP"},
        {"package": "b", "dependency": "c", "relationship": "TESTDEP"},
    ])
    got = dict(((p, d), l) for p, d, l in rows(c.soname_break_order(breaks, deps)))
    assert got == {("lib", "a"): ["b", "c"], ("lib", "b"): [], ("lib", "c"): [], ("a", "b"): []}


def test_atoms_are_parsed_once(spark, make):
    dep = spark.createDataFrame([("a", "1", "r", "Depends", "b (>= 1) | c")], "package string, version string, repo string, relationship string, value string")
    atoms = c.dependency_atoms(dep, make("packages", [{"package": "a", "version": "1", "repo": "r"}]))
    plan = atoms.filter("deppkg IS NOT NULL").select("deppkg", "deparch")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(_atom") == 1
