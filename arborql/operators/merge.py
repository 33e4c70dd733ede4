"""Merging definitions: duplicates by key, extensions into types, default implementations.

Groups by key combine before the shuffle where the result is bounded (head, first value, ordered union of
availabilities); children never gather in a row: they are re-parented rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborql.operators.ordered import first_wins, numbered, values_in_order


def duplicates(defs: DataFrame, key: str | list[str] = "usr", order: str = "path") -> DataFrame:
    """AGG4, AGG5: every row with head_<order> (its key's first row) and is_head, and for heads the merged
    availabilities, the number of copies and of copies of another kind. Counts combine by kind before the shuffle, and
    values by value, so a key's copies never meet in a row."""
    keys = [key] if isinstance(key, str) else key
    kinds = defs.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    g = kinds.groupBy(*keys).agg(F.min("o").alias("head"), F.min_by("kind", "o").alias("head_kind"), F.sum("n").alias("copies"))
    off = kinds.join(g.select(*keys, "head_kind"), keys).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("kind") != F.col("head_kind"), F.col("n"))), F.lit(0)).alias("mismatches"))
    same = defs.join(g.select(*keys, F.col("head_kind").alias("__k")), keys).where(F.col("kind").eqNullSafe(F.col("__k")))
    values = values_in_order(same, keys, "availability", order, "merged")
    g = g.drop("head_kind").join(off, keys).join(values, keys, "left")
    merged = F.coalesce("merged", F.array().cast("array<string>"))
    return defs.join(g, keys).withColumn("is_head", F.col(order) == F.col("head")).withColumn("availability", F.when(F.col("is_head"), merged).otherwise(F.col("availability"))).drop("merged")


def merged_forest(defs: DataFrame, tables) -> DataFrame:
    """AGG5 for whole trees: defs(path, usr, kind, availability, ..) of forests, paths being arrays of ordinals. Copies of
    a usr below one head are merged, their children become the head's, and are merged in turn, a level a round. Heads
    come back with head_parent (the head of their parent), availability, copies and mismatches."""
    d = tables.write(defs.withColumn("__depth", F.size("path")))
    top = d.agg(F.max("__depth")).first()[0] or 0
    out, up = None, None
    for depth in range(1, top + 1):
        own = d.where(F.col("__depth") == depth)
        if up is None:
            own = own.withColumn("head_parent", F.lit(None).cast(d.schema["path"].dataType))
        else:
            own = own.withColumn("__up", F.slice("path", F.lit(1), F.size("path") - 1)).join(up, "__up").drop("__up")
        m = tables.write(duplicates(own.withColumn("__top", F.coalesce("head_parent", F.array().cast(d.schema["path"].dataType))), ["__top", "usr"]).drop("__top"))
        up = m.select(F.col("path").alias("__up"), F.col("head").alias("head_parent"))
        heads = m.where("is_head").drop("__depth", "head", "is_head")
        out = heads if out is None else out.unionByName(heads)
    return out if out is not None else defs.withColumns({"head_parent": F.lit(None).cast(defs.schema["path"].dataType), "copies": F.lit(0).cast("long"), "mismatches": F.lit(0).cast("long")})


def claim_extensions(types: DataFrame, extensions: DataFrame) -> DataFrame:
    """JN1: each extension with the type that claims its key: types inside other extensions first, then by path.
    Leftovers have a null claimant, and the first of a key is the head of the rest (leftover_head)."""
    t = types.select(F.col("usr").alias("type_usr"), F.col("path").alias("claimant"), F.struct(F.when(F.col("in_extension"), 0).otherwise(1).alias("phase"), F.col("path").alias("at")).alias("__o"))
    t = first_wins(t, ["type_usr"], ["__o"]).drop("__o")
    out = extensions.join(t, "type_usr", "left")
    head = F.min(F.when(F.col("claimant").isNull(), F.col("path"))).over(W.partitionBy("type_usr"))
    return out.withColumn("leftover_head", F.when(F.col("claimant").isNull(), head))


def backfill_docs(types: DataFrame, claimed: DataFrame) -> DataFrame:
    """AGG6: a type without docs takes the first extension's that has some."""
    d = claimed.where("docs is not null and docs <> ''").groupBy(F.col("claimant").alias("path")).agg(F.min_by("docs", "path").alias("__d"))
    return types.join(d, "path", "left").withColumn("docs", F.when(F.coalesce("docs", F.lit("")) == "", F.col("__d")).otherwise(F.col("docs"))).drop("__d")


def folded_members(own: DataFrame, of_duplicates: DataFrame, of_extensions: DataFrame) -> DataFrame:
    """AGG7: a type's members: its own, its copies', its extensions', those of constrained extensions last.
    Each frame has parent_path, ext_path, ord and is_constrained; fold_order sorts a type's members."""
    out = None
    for k, f in enumerate((own, of_duplicates, of_extensions)):
        f = f.withColumn("fold_order", F.struct(F.when(F.coalesce("is_constrained", F.lit(False)), 9).otherwise(k).alias("source"), F.col("ext_path").alias("ext"), F.col("ord").alias("at")))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def merged_declarations(base: Column, others: Column) -> Column:
    """AGG8: others is array<struct<decl, conforms, constrained>>: what differs from the base and adds a
    conformance or a constraint, sorted, each once, after the base with blank lines between."""
    add = F.array_sort(F.array_distinct(F.transform(F.filter(others, lambda o: (o["conforms"] | o["constrained"]) & (o["decl"] != base)), lambda o: o["decl"])))
    return F.array_join(F.concat(F.array(base), add), "\n\n")


def default_implementations(requirements: DataFrame, members: DataFrame) -> DataFrame:
    """JN4, AGG9: protocol requirements with the extension members that implement them, by protocol, name and
    kind. The last unconstrained member's docs become the default text; constrained ones only mark both sides."""
    m = members.groupBy("protocol", "name", "kind").agg(
        F.max_by(F.when(~F.col("is_constrained"), F.col("docs")), F.when(~F.col("is_constrained"), F.col("path"))).alias("default_docs"),
        F.max_by(F.when(~F.col("is_constrained"), F.col("module_name")), F.when(~F.col("is_constrained"), F.col("path"))).alias("default_module"),
        F.count_if("is_constrained").alias("n_conditional"), F.count_if(~F.col("is_constrained")).alias("n_default"),
    )
    out = requirements.join(m, ["protocol", "name", "kind"], "left")
    note = F.when(F.col("n_default") > 0, F.when(F.col("default_module") != F.col("module_name"), F.lit("importedDefaultImplementation")).otherwise(F.lit("defaultImplementation")))
    return out.withColumns({"note": note, "conditional_note": F.when(F.col("n_conditional") > 0, F.lit("conditionalDefaultImplementationExists"))})


def extension_only(requirements: DataFrame, members: DataFrame) -> DataFrame:
    """JN4: members of protocol extensions that no requirement asks for."""
    return members.join(requirements, ["protocol", "name", "kind"], "left_anti")


def moved(rows: DataFrame, moves: DataFrame, tables, path: str = "path") -> DataFrame:
    """Rows at or below a move's ``src`` get its ``dst`` in place of that prefix, and ``moved``; the others stay. A row asks
    for its own prefixes, so that it is one equi-join; of several the deepest counts. A ``dst`` that lies below another
    move's ``src`` is moved itself first, all at once in each round, so that a chain of n takes log2(n) rounds; a move
    into itself is an error."""
    at = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(c)), lambda k: F.slice(c, F.lit(1), k))).alias("src")
    moves = tables.write(moves.select("src", "dst"))

    def deepest(paths: DataFrame, own: str) -> DataFrame:
        """(own, to): each path below a move with its new prefix in place."""
        hit = paths.select(own, at(F.col(own))).join(moves.select("src", F.col("dst").alias("__dst")), "src").groupBy(own).agg(F.max_by(F.struct("src", "__dst"), F.size("src")).alias("m"))
        rest = F.slice(own, F.size("m.src") + 1, F.size(own))
        return hit.select(own, F.concat("m.__dst", rest).alias("to"))

    while True:
        if not moves.where(F.slice("dst", F.lit(1), F.size("src")) == F.col("src")).isEmpty():
            raise ValueError("an extension lies within a type that it extends")
        again = tables.write(deepest(moves.select("dst").distinct(), "dst"))
        if again.isEmpty():
            break
        moves = tables.write(moves.join(again, "dst", "left").select("src", F.coalesce("to", "dst").alias("dst")))
    of = deepest(rows.select(path), path)
    return rows.join(of, path, "left").withColumn("moved", F.col("to").isNotNull()).withColumn(path, F.coalesce("to", path)).drop("to")


def folded_extensions(rows: DataFrame, claims: DataFrame, tables) -> DataFrame:
    """JN4, AGG7, AGG9, AGG10: extensions folded into the types that claim them, whole subtrees at a time.

    rows(path array of ordinals, name, kind, module_name, docs); claims(ext_path, type_path, is_constrained). The members
    of an extension follow those of its type, in the order of extensions, constrained ones last: their new ordinals come
    from numbering all of them in order, so that no type's members need meet in a task. In a protocol (a kind that ends in
    .protocol) a member with the name and kind of a requirement (the first of such) is its default implementation:
    unconstrained, it goes with all below it and leaves its docs, of several the last's; constrained, it stays with its
    docs demoted. Other members stay. Members of an extension of another module are marked, with all below them. A claimed
    extension's own row goes. The result is rows with new paths, and default_docs and notes, an array of struct<tag, arg>
    by tag and arg. Claims whose type is no row are not followed."""
    order = F.col("path")
    up = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    none = F.array().cast("array<struct<tag:string,arg:string>>")
    note = lambda tag, arg=None: F.struct(F.lit(tag).alias("tag"), (F.lit(None).cast("string") if arg is None else arg).alias("arg"))
    rows = tables.write(rows)
    types = rows.select(order.alias("type_path"), F.coalesce(F.col("kind").endswith(".protocol"), F.lit(False)).alias("is_protocol"), F.col("module_name").alias("type_module"))
    c = claims.join(types, "type_path").join(rows.select(order.alias("ext_path"), F.col("module_name").alias("ext_module")), "ext_path")
    c = tables.write(c.select("ext_path", "type_path", F.coalesce("is_constrained", F.lit(False)).alias("is_constrained"), "is_protocol", "ext_module", (~F.col("ext_module").eqNullSafe(F.col("type_module"))).alias("imported")))
    kids = rows.select(order.alias("src"), up(order).alias("ext_path"), "name", "kind", "docs", "module_name").join(c, "ext_path")
    needed = rows.select(order.alias("needed"), up(order).alias("type_path"), "name", "kind", F.col("module_name").alias("needed_module")).join(c.where("is_protocol").select("type_path").distinct(), "type_path")
    needed = needed.groupBy("type_path", "name", "kind").agg(F.min_by(F.struct("needed", "needed_module"), "needed").alias("r"))
    kids = kids.join(needed.select("type_path", "name", "kind", "r.*"), ["type_path", "name", "kind"], "left")
    what = F.when(~F.col("is_protocol"), "member").when(F.col("needed").isNull(), "only").when(F.col("is_constrained"), "conditional").otherwise("default")
    kids = tables.write(kids.withColumn("what", what))
    # requirements: docs of the last default implementation, and a note for each kind of implementation and module
    imported = ~F.col("module_name").eqNullSafe(F.col("needed_module"))
    said = F.when(F.col("what") == "conditional", note("conditionalDefaultImplementationExists")).when(imported, note("importedDefaultImplementation", F.col("module_name"))).otherwise(note("defaultImplementation"))
    is_default = F.col("what") == "default"
    # extensions are taken in order, the members of each in theirs
    last = F.struct("ext_path", "src")
    given = kids.where("needed is not null").groupBy(F.col("needed").alias("path")).agg(F.collect_set(said).alias("given_notes"), F.max_by(F.when(is_default, F.col("docs")), F.when(is_default, last)).alias("given_docs"))
    # members that stay move below their type, after what is there
    stay = kids.where("what <> 'default'").select("src", "type_path", "is_constrained", "ext_path")
    base = rows.agg(F.max(F.array_max("path")).alias("base"))
    numbered_ = numbered(stay, ["type_path", "is_constrained", "ext_path", "src"], "n", tables)
    moves = numbered_.withColumn("base", F.lit(base.first()["base"] or 0)).select("src", F.array_append("type_path", F.col("base") + F.col("n")).cast(rows.schema["path"].dataType).alias("dst"))
    # rows of merged members and claimed extensions go; marks are for members of another module's extensions and below
    asks = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("src"))
    marks = kids.select("src", F.when(is_default, True).alias("gone"), F.when(F.col("imported"), F.col("ext_module")).alias("from_module"), F.struct("what").alias("own"))
    marked = asks.join(marks, "src").groupBy("path").agg(F.bool_or("gone").alias("gone"), F.max_by("from_module", F.size("src")).alias("from_module"), F.max(F.when(F.col("src") == F.col("path"), F.col("own.what"))).alias("what"))
    out = rows.join(c.select(F.col("ext_path").alias("path")), "path", "left_anti").join(marked, "path", "left").where(~F.coalesce("gone", F.lit(False))).join(given, "path", "left")
    own = F.when(F.col("what") == "only", F.array(note("protocolExtensionMember"))).when(F.col("what") == "conditional", F.array(note("conditionalDefaultImplementation"))).otherwise(none)
    from_other = F.when(F.col("from_module").isNotNull(), F.array(note("imported", F.col("from_module")))).otherwise(none)
    demoted = F.col("what").eqNullSafe("conditional")
    out = out.withColumns({
        "notes": F.array_sort(F.concat(own, from_other, F.coalesce("given_notes", none))),
        "default_docs": F.when(demoted, F.col("docs")).otherwise(F.col("given_docs")),
        "docs": F.when(~demoted, F.col("docs")),
    }).drop("gone", "from_module", "what", "given_notes", "given_docs")
    return moved(out, moves, tables).drop("moved")


def imported_notes(extensions: DataFrame, rows: DataFrame) -> DataFrame:
    """AGG10: rows at or below an extension of another module's type get its module's name as imported_from."""
    bad = extensions.where(F.col("module_name") != F.col("type_module_name")).select(F.col("path").alias("__e"), F.col("module_name").alias("__m"))
    asks = rows.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("__e"))
    hit = asks.join(bad, "__e").groupBy("path").agg(F.min_by("__m", F.size("__e")).alias("imported_from"))
    return rows.join(hit, "path", "left")


def topic_cascade(children: DataFrame) -> DataFrame:
    """WIN7: an extension's first child is given its category, else its constraint, else its own topic."""
    first = F.row_number().over(W.partitionBy("ext_path").orderBy("ord")) == 1
    topic = F.coalesce(F.col("category_name"), F.col("constraint"), F.col("ext_topic"))
    return children.withColumn("topic", F.when(first, topic).otherwise(F.col("topic")))


def notes_joined(notes: Column, order: list[str]) -> Column:
    """AGG14: a set of struct<tag, arg> by rank of tag, as one text."""
    at = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    ranked = F.array_sort(F.array_distinct(F.transform(notes, lambda n: F.struct(F.try_element_at(at, n["tag"]).alias("r"), n["tag"].alias("tag"), n["arg"].alias("arg")))))
    return F.array_join(F.transform(ranked, lambda n: F.concat_ws(": ", n["tag"], n["arg"])), "; ")


def last_pass(passes: DataFrame) -> DataFrame:
    """AGG16: a row per module, of its last pass, by name."""
    return first_wins(passes, ["module_name"], ["pass_index"], last=True).orderBy("module_name")


def with_other_language(defs: DataFrame, info: DataFrame) -> DataFrame:
    """JN5, PRJ18: Swift definitions with the Objective-C name and declaration of their usr, where there are both."""
    i = info.where("name is not null and declaration is not null").select("usr", F.struct("name", "declaration").alias("other"))
    return defs.join(i, "usr", "left")


def generic_parameters(rows: DataFrame) -> DataFrame:
    """PRJ9: generic parameters leave the children and become a sorted set on their parent; children of Objective-C
    typedefs go. rows(path, parent_path, kind, parent_kind, name)."""
    is_param = F.col("kind").endswith("generic_type_param")
    g = rows.where(is_param).groupBy(F.col("parent_path").alias("path")).agg(F.array_sort(F.collect_set("name")).alias("generic_params"))
    kept = rows.where(~is_param & ~F.coalesce(F.col("parent_kind").endswith("objc.decl.typedef"), F.lit(False)))
    return kept.join(g, "path", "left").withColumn("generic_params", F.coalesce("generic_params", F.array().cast("array<string>")))
