"""Derived views of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.relations import atom_fields
from poolscope.functions.sonames import dotted_prefixes
from poolscope.functions.versions import full_version, version_key
from poolscope.plans.storage import stored
from poolscope.schemas import PACKAGE_KEY

REPO_FACTS = ("architecture", "component", "testing")


def latest_packages(packages: DataFrame) -> DataFrame:
    """The valid row with the greatest version key per repo and package.

    The rank filter is applied before the shuffle too (group limit), so a
    package with very many versions costs one row per input task.
    """
    best = Window.partitionBy("repo", "package").orderBy(
        F.col("vk").desc_nulls_last(), F.col("version")
    )
    return (
        packages.filter(F.col("debtime").isNotNull())
        .withColumn("_rank", F.row_number().over(best))
        .filter("_rank = 1")
        .drop("_rank")
    )


def with_repo_facts(df: DataFrame, repos: DataFrame, prefix: str, repo: str = "repo") -> DataFrame:
    """Add architecture, component and testing level of the row's repository."""
    facts = repos.select(
        F.col("name").alias("_name"), *[F.col(c).alias(prefix + c) for c in REPO_FACTS]
    )
    return df.join(facts, F.col(repo) == F.col("_name")).drop("_name")


def repo_rule(rule: str, user: str, provider: str) -> Column:
    """May a package of the user repository use one of the provider repository?

    ``user`` and ``provider`` are the prefixes of the repository facts.
    """
    ua, uc, ut = (F.col(user + c) for c in REPO_FACTS)
    pa, pc, pt = (F.col(provider + c) for c in REPO_FACTS)
    if rule == "dependency":
        usable = ((uc != "main") | (pc == "main")) & (
            (ua == "all") | (pa == ua) | (pa == "all")
        )
    elif rule == "collision":
        usable = (pc == uc) & ((pa == ua) | (pa == "all"))
    elif rule == "soname":
        usable = ((ua == pa) | (ua == "all")) & ((pc == uc) | (pc == "main"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return usable & (pt <= ut)


def compatible_repos(repos: DataFrame, rule: str) -> DataFrame:
    """Repository pairs (repo, provider) under a rule, with the provider's level.

    The architecture part of the rule becomes an equality key, with "*" for
    "any", so the pairs come from a hash join.
    """
    arch = F.col("architecture")
    exact_or_all = F.array_distinct(F.array(arch, F.lit("all")))
    any_arch = F.array(F.lit("*"))
    accepts = {
        "dependency": F.when(arch == "all", any_arch).otherwise(exact_or_all),
        "collision": exact_or_all,
        "soname": F.when(arch == "all", any_arch).otherwise(F.array(arch)),
    }[rule]
    offers = F.array(arch) if rule == "collision" else F.array(arch, F.lit("*"))
    users = repos.select(
        F.col("name").alias("repo"),
        *[F.col(c).alias("u_" + c) for c in REPO_FACTS],
        F.explode(accepts).alias("_key"),
    )
    providers = repos.select(
        F.col("name").alias("provider"),
        *[F.col(c).alias("p_" + c) for c in REPO_FACTS],
        F.explode(offers).alias("_key"),
    )
    return (
        users.join(providers, "_key")
        .filter(repo_rule(rule, "u_", "p_"))
        .select("repo", "provider", F.col("p_testing").alias("provider_testing"))
    )


def dependency_atoms(dependencies: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per alternative of each dependency of the latest packages.

    An alternative that cannot be parsed stays as a row without a name.
    """
    wanted = dependencies.join(latest.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi")
    parts = wanted.select(
        *PACKAGE_KEY, "relationship", F.posexplode(F.split("value", ",", -1)).alias("_pos", "_part")
    ).filter("_part <> ''")
    atoms = parts.select(
        *PACKAGE_KEY,
        "relationship",
        (F.col("_pos") + 1).alias("nr"),
        F.explode(F.split("_part", r"\|", -1)).alias("_atom"),
    )
    # Out of a generator, so that filters on the parts do not parse the text again.
    return atoms.withColumn("_cut", F.explode(F.array(atom_fields(F.col("_atom"))))).select(
        *PACKAGE_KEY,
        "relationship",
        "nr",
        F.col("_cut.name").alias("deppkg"),
        F.col("_cut.archqual").alias("deparch"),
        F.col("_cut.relop").alias("relop"),
        F.col("_cut.version").alias("depver"),
    ).withColumn("depvk", version_key(F.col("depver")))


def tagged_sonames(sodep: DataFrame, latest: DataFrame) -> DataFrame:
    """Distinct provisions and needs with ``current``: their package is among the latest.

    Found in one join and written once; rows that come more than once go where the join put them.
    """
    keys = latest.select(*PACKAGE_KEY).distinct().withColumn("current", F.lit(True))
    rows = sodep.filter("depends IN (0, 1)").select(*PACKAGE_KEY, "depends", "name", "ver")
    tagged = rows.join(keys, PACKAGE_KEY, "left").withColumn("current", F.coalesce("current", F.lit(False)))
    return stored(tagged.distinct(), "tagged-sonames")


def current_sonames(sodep: DataFrame, latest: DataFrame) -> DataFrame:
    """Provisions and needs of the latest packages, found in one join and written once."""
    rows = sodep.filter("depends IN (0, 1)").select(*PACKAGE_KEY, "depends", "name", "ver")
    return stored(rows.join(latest.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi"), "current-sonames")


def soname_breaks(
    sodep: DataFrame, latest: DataFrame, repos: DataFrame, issues: DataFrame | None = None
) -> DataFrame:
    """Packages affected when a provider changes a soname.

    Users are the packages that need it now, plus (from the previous issues)
    those already reported as broken against an older version of the provider.
    Version compatibility is an equality on the provider's dotted prefixes.
    """
    current = current_sonames(sodep, latest)
    providers = with_repo_facts(current.filter("depends = 0"), repos, "p_").select(
        "package",
        "repo",
        F.col("name").alias("soname"),
        F.col("ver").alias("sover"),
        *["p_" + c for c in REPO_FACTS],
        F.explode(dotted_prefixes(F.col("ver"))).alias("_want"),
    )

    users = current.filter("depends = 1").select(
        F.col("name").alias("soname"),
        F.col("ver").alias("_want"),
        F.col("ver").alias("sodepver"),
        F.col("package").alias("dep_package"),
        F.col("repo").alias("dep_repo"),
        F.col("version").alias("dep_version"),
    )
    if issues is not None:
        users = users.unionByName(_reported_users(issues))
    # Both kinds of users meet the providers in one join.
    return (
        providers.join(with_repo_facts(users, repos, "u_", "dep_repo"), ["soname", "_want"])
        .filter(repo_rule("soname", "u_", "p_") & (F.col("package") != F.col("dep_package")))
        .select(
            "package", "repo", "soname", "sover", "sodepver",
            "dep_package", "dep_repo", "dep_version",
        )
    )


def _reported_users(issues: DataFrame) -> DataFrame:
    """Users of a soname that issues report, with the version they lost."""
    at = F.instr("filename", ".so")
    return issues.filter("errno = 431 AND detail IS NOT NULL").select(
        F.col("filename").substr(F.lit(1), at + 2).alias("soname"),
        F.get_json_object("detail", "$.sover_provide").alias("_want"),
        F.col("filename").substr(at + 3, F.length("filename")).alias("sodepver"),
        F.col("package").alias("dep_package"),
        F.col("repo").alias("dep_repo"),
        F.col("version").alias("dep_version"),
    )


def break_pairs(breaks: DataFrame) -> DataFrame:
    return breaks.select("package", "dep_package").distinct()


def break_order_edges(breaks: DataFrame, source_deps: DataFrame) -> DataFrame:
    """(provider, dependent, other): other dependents that need this dependent.

    Starts from the dependency edges, so dependents of one provider are never
    paired with each other.
    """
    pairs = break_pairs(breaks)
    edges = (
        source_deps.filter(F.col("relationship").isin("PKGDEP", "BUILDDEP"))
        .select(F.col("package").alias("other"), F.col("dependency").alias("dep_package"))
        .union(pairs.select(F.col("dep_package").alias("other"), F.col("package")))
        .filter(F.col("other") != F.col("dep_package"))
        .distinct()
    )
    siblings = pairs.select("package", F.col("dep_package").alias("other"))
    return pairs.join(edges, "dep_package").join(siblings, ["package", "other"], "left_semi")


def soname_break_order(breaks: DataFrame, source_deps: DataFrame) -> DataFrame:
    """Per (provider, dependent): the sorted other dependents to rebuild after it."""
    after = (
        break_order_edges(breaks, source_deps)
        .groupBy("package", "dep_package")
        .agg(F.sort_array(F.collect_list("other")).alias("deplist"))
    )
    return (
        break_pairs(breaks)
        .join(after, ["package", "dep_package"], "left")
        .withColumn("deplist", F.coalesce("deplist", F.array().cast("array<string>")))
    )


def source_packages(sources: DataFrame, trees: DataFrame, versions: DataFrame) -> DataFrame:
    """Source packages with their tree's category and main-branch version."""
    tree = trees.select(
        F.col("name").alias("tree"), F.col("category").alias("tree_category"), "mainbranch"
    )
    current = versions.select(
        F.col("package").alias("name"),
        F.col("branch").alias("mainbranch"),
        F.col("branch"),
        "version",
        full_version(F.col("epoch"), F.col("version"), F.col("release")).alias("full_version"),
        "commit_time",
        "committer",
    )
    return (
        sources.join(tree, "tree")
        .join(current, ["name", "mainbranch"], "left")
        .select(
            "name", "tree", "tree_category", "branch", "category", "section", "pkg_section",
            "directory", "description", "version", "full_version", "commit_time", "committer",
        )
    )


def upstream_versions(
    upstream: DataFrame, links: DataFrame, projects: DataFrame, project_url: str
) -> DataFrame:
    """Best known upstream version per package; ``project_url`` has one ``{id}``."""
    before, after = project_url.split("{id}")
    own = upstream.select(
        "package",
        F.col("version").alias("_v"), F.col("time").alias("_t"), F.col("url").alias("_u"), "tarball",
    )
    tracked = links.join(projects, F.col("projectid") == F.col("id"), "left").select(
        "package", "id", "latest_version", "updated_on"
    )
    return (
        upstream.select("package").union(links.select("package")).distinct()
        .join(own, "package", "left")
        .join(tracked, "package", "left")
        .select(
            "package",
            F.coalesce("_v", "latest_version").alias("version"),
            F.coalesce("_t", "updated_on").alias("updated"),
            F.coalesce(
                "_u", F.concat(F.lit(before), F.col("id").cast("string"), F.lit(after))
            ).alias("url"),
            "tarball",
        )
    )


def repo_modified(repos: DataFrame, packages: DataFrame) -> DataFrame:
    """Fill a missing repository time with its newest package time."""
    newest = packages.groupBy(F.col("repo").alias("name")).agg(F.max("mtime").alias("_newest"))
    kind = repos.schema["mtime"].dataType
    filled = F.col("_newest")
    if packages.schema["mtime"].dataType.typeName() in ("long", "integer"):
        filled = F.timestamp_seconds("_newest")
    return (
        repos.join(newest, "name", "left")
        .withColumn("mtime", F.coalesce("mtime", filled.cast(kind)))
        .drop("_newest")
    )


def _newest_seconds(repos: DataFrame) -> Column:
    """Newest ``mtime`` in epoch seconds, read as UTC where it has no zone."""
    newest = F.max("mtime")
    if repos.schema["mtime"].dataType.typeName() == "timestamp_ntz":
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.coalesce(F.timestamp_diff("SECOND", zero, newest), F.lit(0))
    return F.coalesce(F.unix_seconds(newest), F.lit(0))


def max_modified(repos: DataFrame, branch: str | None = None) -> DataFrame:
    """Newest repository time in epoch seconds, 0 when there is none."""
    if branch is not None:
        repos = repos.filter(F.col("branch") == branch)
    return repos.agg(_newest_seconds(repos).alias("modified"))


def branch_modified(repos: DataFrame) -> DataFrame:
    """``max_modified`` of every branch at once."""
    return repos.groupBy("branch").agg(_newest_seconds(repos).alias("modified"))


def seen_paths(repos: DataFrame) -> DataFrame:
    return repos.select("path").distinct()


def reverse_use_count(sodep: DataFrame, source_deps: DataFrame) -> DataFrame:
    """Run-time users per (soname name, provider package)."""
    users = (
        source_deps.filter("relationship = 'PKGDEP'")
        .groupBy(F.col("dependency").alias("package"))
        .agg(F.count("package").alias("cnt"))
    )
    return (
        sodep.filter("depends = 0").select("name", "package").distinct().join(users, "package")
    ).select("name", "package", "cnt")


