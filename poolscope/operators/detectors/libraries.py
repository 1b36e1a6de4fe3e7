"""Detectors 431 and 432 on shared libraries, and the dependency closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.functions.sonames import dotted_prefixes
from poolscope.functions.versions import version_key, version_matches
from poolscope.operators.catalogue import (
    REPO_FACTS, break_pairs, compatible_repos, repo_rule, reverse_use_count, tagged_sonames,
    with_repo_facts,
)
from poolscope.operators.detectors.common import fields, findings
from poolscope.plans.storage import stored
from poolscope.schemas import PACKAGE_KEY


def detect_431(
    sodep: DataFrame, latest: DataFrame, repos: DataFrame, source_deps: DataFrame,
    strict_compat: bool = False,
) -> DataFrame:
    """Needed sonames that no compatible repository provides in a fitting version.

    Provisions shrink to one row per soname, wanted version and kind of
    repository before they meet the needs. The suggestion is the most used
    provider of the soname in any compatible repository.

    ``strict_compat`` stays silent when every compatible repository has only
    superseded providers.
    """
    # Provisions of superseded packages count for the usage and the strict rule.
    sodep = tagged_sonames(sodep, latest)
    current = sodep.filter("current")
    facts = repos.select("name", *REPO_FACTS).distinct()
    needs = with_repo_facts(current.filter("depends = 1"), facts, "u_").select(
        *PACKAGE_KEY, "name", "ver", *["u_" + c for c in REPO_FACTS]
    )
    provided = with_repo_facts(current.filter("depends = 0"), repos, "p_")
    p_facts = ["p_" + c for c in REPO_FACTS]
    offers = provided.select(
        F.col("name").alias("_name"), F.explode(dotted_prefixes(F.col("ver"))).alias("_want"),
        *p_facts,
    ).distinct()
    rule = repo_rule("soname", "u_", "p_")
    unmet = needs.join(
        offers, (F.col("name") == F.col("_name")) & (F.col("ver") == F.col("_want")) & rule,
        "left_anti",
    )
    usage = reverse_use_count(sodep, source_deps)
    best_per_repo = (
        provided.join(usage, ["name", "package"], "left")
        .groupBy(F.col("name").alias("_name"), F.col("repo").alias("_repo"), *p_facts)
        .agg(
            F.min(
                F.struct(
                    (-F.coalesce("cnt", F.lit(-1))).alias("rank"),
                    "repo", "package", "version", "ver",
                )
            ).alias("_best")
        )
    )
    if strict_compat:
        unmet = stored(unmet, "unmet-sonames")
        pairs = compatible_repos(repos, "soname").select("repo", "provider")
        any_provider = sodep.filter("depends = 0").select("name", F.col("repo").alias("provider")).distinct()
        usable = pairs.groupBy("repo").agg(F.count("*").alias("_usable"))
        holding = (
            pairs.join(any_provider, "provider").groupBy("repo", "name").agg(F.count("*").alias("_held"))
        )
        offered = best_per_repo.select("_name", *p_facts)
        covered = unmet.join(usable, "repo").join(holding, ["repo", "name"]).filter(
            "_usable = _held"
        )
        silent = covered.join(offered, (F.col("name") == F.col("_name")) & rule, "left_anti")
        unmet = unmet.join(
            silent.select(*PACKAGE_KEY, "name", "ver"), [*PACKAGE_KEY, "name", "ver"], "left_anti"
        )
    suggested = (
        unmet.join(best_per_repo, (F.col("name") == F.col("_name")) & rule, "left")
        .groupBy(*PACKAGE_KEY, "name", "ver")
        .agg(F.min("_best").alias("_best"))
    )
    detail = F.when(
        F.col("_best").isNotNull(),
        fields(
            repo="_best.repo", package="_best.package", version="_best.version",
            sover_provide="_best.ver",
        ),
    )
    return findings(suggested, 431, F.concat("name", "ver"), detail)


def satisfied_edges(source_deps: DataFrame, source_packages: DataFrame) -> DataFrame:
    """Run-time dependency edges whose dependency has a satisfying version."""
    have = source_packages.select(
        F.col("name").alias("dependency"), version_key(F.col("full_version")).alias("_vk")
    )
    op = F.when(F.col("relop") == "==", F.lit("=")).otherwise(F.col("relop"))
    return (
        source_deps.filter("relationship = 'PKGDEP'")
        .join(have, "dependency")
        .filter(version_matches(F.col("_vk"), op, version_key(F.col("version"))))
        .select("package", "dependency")
        .distinct()
    )


def dependency_closure(
    edges: DataFrame, breaks: DataFrame, max_rounds: int | None = None, users: DataFrame | None = None
) -> DataFrame:
    """All (package, dependency) reached from the users in ``breaks``.

    With ``users`` (package) only from those of them; the other users are not followed.
    ``sodep`` marks pairs that are themselves soname breaks; nothing is followed
    beyond those. Each round joins only the newly found pairs, keeps those not
    seen before, and is written to the shared folder, so a lost executor costs at
    most one round.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("package", "dependency").distinct(), "closure-edges")
    flags = break_pairs(breaks).select(
        F.col("dep_package").alias("package"), F.col("package").alias("dependency"),
        F.lit(True).alias("sodep"),
    )
    if users is not None:
        flags = flags.join(users.select("package").distinct(), "package", "left_semi")
    flags = stored(flags, "closure-flags")
    users = flags.select("package").distinct()

    def flagged(pairs: DataFrame) -> DataFrame:
        return pairs.join(flags, ["package", "dependency"], "left").withColumn(
            "sodep", F.coalesce("sodep", F.lit(False))
        )

    start = edges.filter("package <> dependency").join(users, "package", "left_semi")
    frontier = stored(flagged(start), "closure-0")
    rounds = [frontier]
    step = edges.select(F.col("package").alias("_via"), F.col("dependency").alias("_next"))
    while not frontier.isEmpty():
        if max_rounds is not None and len(rounds) > max_rounds:
            raise RuntimeError(f"dependency closure not complete after {max_rounds} rounds")
        reached = (
            frontier.filter("NOT sodep")
            .join(step, F.col("dependency") == F.col("_via"))
            .select("package", F.col("_next").alias("dependency"))
            .distinct()
        )
        seen = spark.createDataFrame([], "package string, dependency string")
        for found in rounds:
            seen = seen.unionByName(found.select("package", "dependency"))
        fresh = reached.join(seen, ["package", "dependency"], "left_anti")
        frontier = stored(flagged(fresh), f"closure-{len(rounds)}")
        rounds.append(frontier)
    out = rounds[0]
    for found in rounds[1:]:
        out = out.unionByName(found)
    return out


def detect_432(
    breaks: DataFrame, closure: DataFrame, latest: DataFrame, changed: DataFrame,
    repos: DataFrame, sources: DataFrame, sodep: DataFrame, source_deps: DataFrame,
    core_tree: str,
) -> DataFrame:
    """Soname users that declare no dependency on any provider.

    Users and providers in the core tree are exempt.
    """
    tree = sources.select(F.col("name"), "tree")
    uses = (
        breaks.join(
            latest.select("package", "repo", F.col("version").alias("lib_version")),
            ["package", "repo"],
        )
        .join(
            changed.select(F.col("package").alias("dep_package"), F.col("repo").alias("dep_repo")),
            ["dep_package", "dep_repo"], "left_semi",
        )
        .join(repos.select(F.col("name").alias("repo"), "testing"), "repo")
        .join(
            tree.filter(F.col("tree") != core_tree).select(F.col("name").alias("dep_package")),
            "dep_package", "left_semi",
        )
        .join(tree.withColumnsRenamed({"name": "package", "tree": "lib_tree"}), "package")
        .join(
            closure.filter("sodep").select(
                F.col("package").alias("dep_package"), F.col("dependency").alias("package"),
                F.lit(1).alias("declared"),
            ),
            ["dep_package", "package"], "left",
        )
        .join(
            reverse_use_count(sodep, source_deps).withColumnRenamed("name", "soname"),
            ["soname", "package"], "left",
        )
    )
    best = F.struct(
        (-F.coalesce("cnt", F.lit(-1))).alias("rank"),
        (-F.col("testing")).alias("level"),
        "package", "lib_version", "repo", "sover",
    )
    need = ["dep_package", "dep_version", "dep_repo", "soname", "sodepver"]
    undeclared = (
        uses.groupBy(*need)
        .agg(
            F.count("declared").alias("declared"),
            F.bool_and(F.col("lib_tree") != core_tree).alias("outside_core"),
            F.min(best).alias("_best"),
        )
        .filter("declared = 0 AND outside_core")
    )
    return findings(
        undeclared, 432, F.concat("soname", "sodepver"),
        fields(package="_best.package", version="_best.lib_version", repo="_best.repo"),
        package="dep_package", version="dep_version", repo="dep_repo",
    )
