"""Symbol graphs: vertices and edges to a forest of definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborql.model import ACLS, EDGES, GRAPH_KINDS, SWIFT
from arborql.operators.ordered import last_wins, multiset_minus


def vertices(symbols: DataFrame) -> DataFrame:
    """GR1: a row per usr, the last wins."""
    return last_wins(symbols, ["usr"], ["ord"])


def constraint_text(c: Column) -> Column:
    """One constraint struct<kind,lhs,rhs> in source form."""
    op = F.when(c["kind"] == "sameType", " == ").otherwise(" : ")
    return F.concat(c["lhs"], op, c["rhs"])


def normalized_constraints(*sources: Column, drop_self: Column | None = None) -> Column:
    """GR6: constraints of several places, known kinds only, sorted, each once; Self : Protocol is dropped."""
    none = F.array().cast("array<struct<kind:string,lhs:string,rhs:string>>")
    every = F.concat(*[F.coalesce(s, none) for s in sources])
    every = F.filter(every, lambda c: c["kind"].isin("conformance", "superclass", "sameType"))
    if drop_self is not None:
        every = F.filter(every, lambda c: ~((c["kind"] == "conformance") & (c["lhs"] == "Self") & (c["rhs"] == drop_self)))
    return F.array_sort(F.array_distinct(F.transform(every, constraint_text)))


def availability_text(a: Column) -> Column:
    """GR6: one availability struct rebuilt as the attribute that it came from."""
    version = lambda v: F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))
    part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), version(v)))
    quoted = lambda name, s: F.when(s.isNotNull(), F.concat(F.lit(f'{name}: "'), s, F.lit('"')))
    parts = F.concat_ws(
        ", ", F.coalesce(a["domain"], F.lit("*")), F.when(a["isUnconditionallyDeprecated"], "deprecated"), F.when(a["isUnconditionallyUnavailable"], "unavailable"),
        part("introduced", a["introduced"]), part("deprecated", a["deprecated"]), part("obsoleted", a["obsoleted"]), quoted("message", a["message"]), quoted("renamed", a["renamed"]))
    return F.concat(F.lit("@available("), parts, F.lit(")"))


def symbols(graphs: DataFrame) -> DataFrame:
    """SRC4, GR6: usr, name, kind, acl, docs, constraints, availability, ... of graphs(file_ord, module_name, and
    the fixed schema). Unknown kinds and access levels become rows with a warning."""
    kinds = F.create_map(*[x for k, v in GRAPH_KINDS.items() for x in (F.lit(k), F.lit(SWIFT + v))])
    s = graphs.select("file_ord", "module_name", F.posexplode("symbols").alias("pos", "s"))
    frags = F.array_join(F.transform("s.declarationFragments", lambda f: f["spelling"]), "")
    return s.select(
        F.struct("file_ord", "pos").alias("ord"), "module_name", F.col("s.identifier.precise").alias("usr"), F.element_at("s.pathComponents", -1).alias("name"),
        F.try_element_at(kinds, F.col("s.kind.identifier")).alias("kind"), F.when(F.col("s.accessLevel").isin(ACLS), F.col("s.accessLevel")).alias("acl"),
        frags.alias("declaration"), F.array_join(F.transform("s.docComment.lines", lambda x: x["text"]), "\n").alias("docs"),
        normalized_constraints(F.col("s.swiftGenerics.constraints"), F.col("s.swiftExtension.constraints"), drop_self=F.element_at("s.pathComponents", 1)).alias("constraints"),
        F.transform("s.swiftGenerics.parameters", lambda p: p["name"]).alias("generic_params"),
        F.transform("s.availability", availability_text).alias("availability"), F.col("s.swiftExtension.extendedModule").alias("extended_module"),
        F.coalesce("s.spi", F.lit(False)).alias("is_spi"), F.col("s.location.uri").alias("file_pathname"), F.col("s.location.position.line").alias("line"), F.col("s.location.position.character").alias("character"),
        F.when(F.try_element_at(kinds, F.col("s.kind.identifier")).isNull(), "unknown kind").when(~F.col("s.accessLevel").isin(ACLS), "unknown access level").alias("warning"),
    )


def edges(graphs: DataFrame) -> DataFrame:
    e = graphs.select("file_ord", "module_name", F.posexplode("relationships").alias("pos", "r"))
    return e.select(F.struct("file_ord", "pos").alias("ord"), "module_name", F.col("r.kind").alias("kind"), F.col("r.source").alias("source"), F.col("r.target").alias("target"),
                    F.col("r.targetFallback").alias("fallback"), normalized_constraints(F.col("r.swiftConstraints")).alias("constraints"),
                    F.when(~F.col("r.kind").isin(EDGES), "unknown relationship").alias("warning"))


def resolved(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """JN2: edges with both ends looked up. A missing source is a warning, a missing target has a name still."""
    src = vertex.select(F.col("usr").alias("source"), F.struct("name", "kind", "module_name", "constraints", "declaration").alias("src"))
    tgt = vertex.select(F.col("usr").alias("target"), F.struct("name", "kind", "module_name", "constraints", "generic_params", "declaration").alias("tgt"))
    j = edge.join(src, "source", "left").join(tgt, "target", "left")
    return j.withColumns({
        "target_name": F.coalesce("tgt.name", "fallback", "target"),
        "warning": F.coalesce("warning", F.when(F.col("src").isNull(), "missing source")),
    })


def placed(e: DataFrame) -> DataFrame:
    """GR2: members go into their target, unless the edge's context adds constraints to it or the target is a
    protocol that does not require them; those make an extension, keyed by type and constraints (AGG11)."""
    m = e.where(F.col("warning").isNull() & F.col("kind").isin("memberOf", "requirementOf", "optionalRequirementOf"))
    fresh = multiset_minus(F.col("src.constraints"), F.coalesce("tgt.constraints", F.array().cast("array<string>")))
    own = F.coalesce("tgt.generic_params", F.array().cast("array<string>"))
    context = F.filter(fresh, lambda c: F.exists(own, lambda p: F.startswith(c, p)) | F.startswith(c, F.lit("Self")))
    needed = F.col("kind") != "memberOf"
    into = F.col("tgt").isNotNull() & (F.size(context) == 0) & (needed | ~F.coalesce(F.col("tgt.kind").endswith(".protocol"), F.lit(False)))
    return m.withColumns({"context": context, "into_target": into, "constraint_key": F.array_join(context, ", ")})


def default_targets(e: DataFrame, members: DataFrame) -> DataFrame:
    """JN3: default implementations with the parent of what they implement."""
    d = e.where((F.col("kind") == "defaultImplementationOf") & F.col("warning").isNull())
    parent = members.select(F.col("source").alias("target"), F.col("target").alias("protocol_usr"))
    return d.join(parent, "target", "left")


def conformances(e: DataFrame) -> DataFrame:
    """GR4: conformances that the type's declaration doesn't state already without condition."""
    c = e.where((F.col("kind") == "conformsTo") & F.col("warning").isNull())
    stated = F.coalesce(F.regexp_like(F.col("src.declaration"), F.concat(F.lit("\\b"), F.col("target_name"), F.lit("\\b"))), F.lit(False))
    return c.where((F.size("constraints") > 0) | ~stated)


def extension_map(members: DataFrame, conforms: DataFrame) -> DataFrame:
    """AGG11: a row per type and constraints: the members in order and the sorted conformances."""
    m = members.where(~F.col("into_target")).select(F.col("target").alias("type_usr"), "constraint_key", F.struct("ord", F.col("source").alias("usr")).alias("m"), F.lit(None).cast("string").alias("c"))
    c = conforms.select(F.col("source").alias("type_usr"), F.array_join("constraints", ", ").alias("constraint_key"), F.lit(None).cast(m.schema["m"].dataType).alias("m"), F.col("target_name").alias("c"))
    g = m.unionByName(c).groupBy("type_usr", "constraint_key").agg(F.array_sort(F.collect_list("m")).alias("m"), F.array_sort(F.collect_set("c")).alias("conforms_to"))
    return g.select("type_usr", "constraint_key", F.transform("m", lambda x: x["usr"]).alias("members"), "conforms_to")


def flags(e: DataFrame) -> DataFrame:
    """GR3: is_override and the superclass of each symbol."""
    ok = e.where("warning is null")
    return ok.groupBy(F.col("source").alias("usr")).agg(F.bool_or(F.col("kind") == "overrides").alias("is_override"), F.min(F.when(F.col("kind") == "inheritsFrom", F.col("target_name"))).alias("superclass"))


def context_constraints(constraints: Column, params: Column, of_context: Column, context_params: Column) -> Column:
    """GR2: the constraints that a member has beyond its context's and that do not name a type parameter of its own."""
    own = F.array_except(params, context_params)
    first = lambda side: F.substring_index(side, ".", 1)
    names = lambda c: F.transform(F.split(c, " (?::|==) "), first)
    return F.filter(multiset_minus(constraints, of_context), lambda c: ~F.arrays_overlap(names(c), own))


def second_pass(edge: DataFrame, vertex: DataFrame, first: DataFrame) -> DataFrame:
    """JN3: the default implementations that the first pass deferred, tried against the members that it placed.

    edge(ord, kind, source, target, ..), vertex(usr, constraints, generic_params, ..), first: ``placed`` rows. A row an
    edge: one whose target has a parent becomes a member of an extension of that parent (target: the parent,
    ``requirement``: what it implements), keyed by its constraints like any other member (AGG11). A missing source, and a
    target that is unknown or has no parent, are warnings; the source of the latter is ``bad``: no tree has it."""
    d = edge.where("kind = 'defaultImplementationOf'").select("ord", "kind", "source", F.col("target").alias("requirement"))
    none = F.array().cast("array<string>")
    lists = lambda name: F.struct(F.coalesce("constraints", none).alias("constraints"), F.coalesce("generic_params", none).alias("generic_params")).alias(name)
    parent = first.where("into_target").groupBy(F.col("source").alias("requirement")).agg(F.min_by("target", "ord").alias("target"))
    v = vertex.select(F.col("usr"), lists("v"))
    j = d.join(v.select(F.col("usr").alias("source"), F.col("v").alias("src")), "source", "left").join(parent, "requirement", "left")
    j = j.join(v.select(F.col("usr").alias("target"), F.col("v").alias("tgt")), "target", "left")
    warning = F.when(F.col("src").isNull(), "missing source").when(F.col("tgt").isNull(), "default implementation of an unplaced requirement")
    context = context_constraints(F.col("src.constraints"), F.col("src.generic_params"), F.col("tgt.constraints"), F.col("tgt.generic_params"))
    j = j.withColumns({"warning": warning, "context": F.when(warning.isNull(), context)})
    return j.select("ord", "kind", "source", "requirement", "target", "context", F.array_join("context", ", ").alias("constraint_key"), F.lit(False).alias("into_target"),
                    "warning", (F.col("src").isNotNull() & F.col("warning").isNotNull()).alias("bad"))


def rebuild(vertex: DataFrame, members: DataFrame, tables, bad: DataFrame | None = None) -> DataFrame:
    """GR5: every vertex with parent_usr, root_usr, depth and state, by pointer doubling: each round a vertex takes over
    its pointer's pointer, so a chain of n takes log2(n) rounds.

    members(source, target, ord, into_target): the first target of a source that goes into one is its parent; a source
    that only extensions hold is on top of its tree but no root. bad(usr): vertices that are no roots.
    state: root; placed (below one); extension, bad, orphan (its parent is no vertex): these have no parent vertex, and
    are the root_usr of what is below them; ring (an ancestor of itself) and below ring, whose root_usr is the ring's least
    usr and whose depth is null. Vertices of one usr are one."""
    v = vertex.select("usr").distinct()
    up = members.groupBy(F.col("source").alias("usr")).agg(F.min_by(F.when(F.col("into_target"), F.col("target")), F.when(F.col("into_target"), F.col("ord"))).alias("parent_usr"))
    known = v.select(F.col("usr").alias("parent_usr"), F.lit(True).alias("known"))
    links = v.join(up.withColumn("held", F.lit(True)), "usr", "left").join(known, "parent_usr", "left")
    links = links.join((bad.select("usr").distinct() if bad is not None else v.limit(0)).withColumn("bad", F.lit(True)), "usr", "left")
    top = F.when(F.col("parent_usr").isNotNull() & F.col("known").isNull(), "orphan").when(F.col("parent_usr").isNull() & F.col("bad"), "bad").when(F.col("parent_usr").isNull() & F.col("held"), "extension").when(F.col("parent_usr").isNull(), "root")
    links = tables.write(links.select("usr", "parent_usr", top.alias("top")))
    is_open = F.col("top").isNull()
    closed = [links.select("usr", F.col("usr").alias("root_usr"), F.lit(0).cast("long").alias("depth"), F.coalesce("top", F.lit("placed")).alias("state")).where("state <> 'placed'")]
    jumps = links.where(is_open).select("usr", F.col("parent_usr").alias("up"), F.lit(1).cast("long").alias("steps"), F.least("usr", "parent_usr").alias("low"))
    n_up = n_low = None
    while not jumps.isEmpty():
        ends = reduce(DataFrame.unionByName, closed).select(F.col("usr").alias("up"), F.col("root_usr").alias("root"), F.col("depth").alias("more"))
        on = jumps.select(F.col("usr").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("low").alias("far"))
        to = ends.unionByName(on, allowMissingColumns=True)
        new = tables.write(jumps.join(to, "up").select("usr", "root", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "far").alias("low")))
        found = new.where("root is not null")
        jumps = new.where("root is null").drop("root")
        if not found.isEmpty():
            closed.append(found.select("usr", F.col("root").alias("root_usr"), F.col("steps").alias("depth"), F.lit("placed").alias("state")))
            continue
        # what is open and finds no end goes round: pointers are on rings once a round leaves as many places pointed at,
        # and all of a ring has been seen once no least changes
        now = jumps.agg(F.count_distinct("up").alias("a"), F.sum(F.xxhash64("usr", "low").cast("decimal(38,0)")).alias("b")).first()
        if (now["a"], now["b"]) == (n_up, n_low):
            ring = jumps.select(F.col("up").alias("usr")).distinct().withColumn("state", F.lit("ring"))
            rest = jumps.join(jumps.select(F.col("usr").alias("up"), F.col("low").alias("least")), "up").join(ring, "usr", "left")
            closed.append(rest.select("usr", F.col("least").alias("root_usr"), F.lit(None).cast("long").alias("depth"), F.coalesce("state", F.lit("below ring")).alias("state")))
            break
        n_up, n_low = now["a"], now["b"]
    out = reduce(DataFrame.unionByName, closed).withColumn("depth", F.col("depth").cast("int"))
    return vertex.join(out.join(links.select("usr", "parent_usr"), "usr"), "usr")


def symbol_order() -> list[Column]:
    """OR4: by file, line and character, located rows first, then name and usr."""
    return [F.col("file_pathname").asc_nulls_last(), F.col("line").asc_nulls_last(), F.col("character").asc_nulls_last(), F.col("name"), F.col("usr")]
