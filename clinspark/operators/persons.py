"""Entity resolution of person names: which spellings may be one person, and merging them.

Two names are linked if their surnames are equal and their given names agree token by token over the
shorter list, an initial agreeing with every name of that letter. A person is a connected component
of that relation. The relation is never enumerated pair by pair: a frequent surname would square it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.functions.names import initial_letter, is_initial, split_name
from clinspark.functions.text import split_words
from clinspark.session import cut_lineage, shuffled


def _blurred(one: str, two: str) -> Column:
    """The places where one of two names has an initial, as a string of 0 and 1."""
    either = F.zip_with(F.split(one, ""), F.split(two, ""), lambda a, b: F.greatest(a, b))
    return F.array_join(either, "")


def namesake_links(persons: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Links (``left``, ``right`` = ``seq`` values) whose connected components are those of "same
    surname and compatible given names". With ``strict`` a bare surname is compatible with bare
    surnames only.

    Every name walks its prefixes. Compatible names share the letters of the shorter one's tokens, so at
    each prefix it can only meet names of its class (surname, letters), and only if a name ends there.
    Two names that meet compare letters where one of them has an initial, and whole tokens elsewhere.
    Which places those are follows from the two masks of initials, and the masks that a class has are
    few; so a name is read once per mask of its class, not once per way to blur it. At one such
    meeting point names with the same initials are alike: a class links to the smallest member of each
    class it is compatible with, never name by name.
    """
    named = persons.select(*keys, "seq", split_name("entity").alias("name")).filter(
        F.col("name.surname") != ""
    )
    tokens = F.transform(
        F.col("name.given"),
        lambda token: F.struct(
            initial_letter(token).alias("letter"),
            F.lower(token).alias("full"),
            F.when(is_initial(token), "1").otherwise("0").alias("mark"),
        ),
    )
    block = [*keys, "surname"]
    base = named.select(*keys, "seq", F.lower(F.col("name.surname")).alias("surname"), tokens.alias("tokens"))
    here = F.slice("tokens", F.lit(1), F.col("length"))
    walked = (
        base.withColumn("length", F.explode(F.sequence(F.lit(0), F.size("tokens"))))
        .withColumn("whole", F.col("length") == F.size("tokens"))
        .withColumn("letters", F.array_join(F.transform(here, lambda token: token["letter"]), "\x02"))
        .withColumn("initials", F.array_join(F.transform(here, lambda token: token["mark"]), ""))
        .withColumn("fulls", F.transform(here, lambda token: token["full"]))
        .drop("tokens")
    )
    if strict:
        walked = walked.filter("whole OR length > 0")
    walked = cut_lineage(walked)
    family = [*block, "length", "letters"]
    ends, passes = (
        walked.filter(kind).select(*family, F.col("initials").alias("others")).distinct() for kind in ("whole", "NOT whole")
    )
    met = walked.join(shuffled(ends), family).unionByName(walked.filter("whole").join(shuffled(passes), family))
    sharp = F.zip_with("fulls", F.split("mask", ""), lambda full, mark: F.when(mark == "0", full).otherwise(""))
    readings = (
        met.withColumn("mask", _blurred("initials", "others"))
        .withColumn("pattern", F.when(F.col("length") == 0, "").otherwise(F.array_join(sharp, "\x02")))
        .select(*family, "seq", "whole", "initials", "mask", "pattern")
        .distinct()
    )
    point = [*family, "mask", "pattern"]
    classes = (
        readings.groupBy(*point, "initials", "whole")
        .agg(F.min("seq").alias("head"))
        .groupBy(*point)
        .agg(F.collect_list(F.struct("initials", "whole", "head")).alias("classes"))
    )
    # Names reading a point join its (few) classes; a compatible pair of classes needs one name that
    # ends here and an initial at every letter-only place.
    linked = readings.join(shuffled(classes), point).withColumn("other", F.explode("classes"))
    either = linked.withColumn("theirs", F.col("other.initials"))
    compatible = (F.col("whole") | F.col("other.whole")) & (_blurred("initials", "theirs") == F.col("mask"))
    return (
        either.filter(compatible & (F.col("seq") != F.col("other.head")))
        .select(*keys, F.col("seq").alias("left"), F.col("other.head").alias("right"))
        .distinct()
    )


def connected_components(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``node``, ``component``) of the nodes that have links; the component is its least node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014), which need a logarithmic number of rounds and never gather a component in one
    place. Every round is stored so that the plan does not grow and lost executors do not
    replay earlier rounds.
    """

    def neighbours_minimum(edges: DataFrame, node: str, other: str) -> DataFrame:
        return edges.groupBy(*keys, node).agg(F.least(F.min(other), F.col(node)).alias("_least"))

    def large_star(edges: DataFrame) -> DataFrame:
        both = edges.select(*keys, "u", "v").union(
            edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        )
        least = neighbours_minimum(both, "u", "v")
        moved = both.join(shuffled(least), [*keys, "u"]).filter("v > u")
        return moved.select(*keys, F.col("v").alias("u"), F.col("_least").alias("v")).distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        down = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy(*keys, "u").agg(F.min("v").alias("_least"))
        moved = down.join(shuffled(least), [*keys, "u"])
        rest = moved.filter("v <> _least").select(
            *keys, F.col("v").alias("u"), F.col("_least").alias("v")
        )
        heads = least.select(*keys, "u", F.col("_least").alias("v"))
        return rest.union(heads).filter("u <> v").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(
            edges.agg(
                F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
            ).first()
        )

    edges = cut_lineage(
        links.select(*keys, F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    before = state(edges)
    while True:
        edges = cut_lineage(small_star(large_star(edges)))
        after = state(edges)
        if after == before:
            break
        before = after
    members = edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(heads)


def resolve_persons(
    mapping: DataFrame, keys: list[str], strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(mapping, merged)``: PERSON entries of one component take the replacement of its fullest
    name (most tokens, then longest, then first); ``merged`` counts the names given up per scope.

    ``seq`` must be unique within a scope. With ``strict`` a bare surname joins only its like, so it cannot
    tie different persons of one family together. Components that already share a replacement stay as they
    are and count nothing.
    """
    persons = mapping.filter("type = 'PERSON'")
    components = connected_components(namesake_links(persons, keys, strict), keys)
    members = persons.join(
        shuffled(components.withColumnRenamed("node", "seq")), [*keys, "seq"]
    ).withColumn(
        "_rank",
        F.struct(-F.size(split_words("entity")), -F.length("entity"), F.col("seq")),
    )
    groups = (
        members.groupBy(*keys, "component")
        .agg(
            F.count("*").alias("_members"),
            F.min_by("replacement", "_rank").alias("_anchor"),
            (F.min("replacement") != F.max("replacement")).alias("_open"),
        )
        .filter("_open")
    )
    changes = components.join(shuffled(groups), [*keys, "component"]).select(
        *keys, F.col("node").alias("seq"), "_anchor"
    )
    person_tag = (F.col("type") == "PERSON") & F.col("_anchor").isNotNull()
    resolved = (
        mapping.join(shuffled(changes), [*keys, "seq"], "left")
        .withColumn(
            "replacement", F.when(person_tag, F.col("_anchor")).otherwise(F.col("replacement"))
        )
        .select(*mapping.columns)
    )
    merged = groups.groupBy(*keys).agg(F.sum(F.col("_members") - 1).alias("merged"))
    return resolved, merged
