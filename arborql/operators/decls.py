"""Declarations and documentation comments, as expressions: bracket depths, blocks, items and open elements are folds over
arrays of tokens and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborql.model import CALLOUTS, DOCC_CALLOUTS, KINDS, OBJC, SWIFT


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once and not copied: lambdas and branches share no common parts, each
    mention of x would be evaluated."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda acc, _: acc, f)


def adjusted_kind(kind: Column, name: Column, declaration: Column, attributes: Column) -> Column:
    """PRJ2: kinds that the name or declaration makes more exact."""
    is_method = kind.startswith(SWIFT + "function.method")
    return (
        F.when(is_method & name.rlike(r"^init[?!]?\("), SWIFT + "function.constructor")
        .when(is_method & (name == "deinit"), SWIFT + "function.destructor")
        .when((is_method | kind.startswith(SWIFT + "function.operator") | (kind == SWIFT + "function.free")) & declaration.rlike(r"\bfunc\s+[-/=+!*%<>&|^~?]"), SWIFT + "function.operator")
        .when((kind == SWIFT + "function.subscript") & declaration.rlike(r"\bstatic\s+subscript\b"), SWIFT + "function.subscript.static")
        .when((kind == SWIFT + "function.subscript") & declaration.rlike(r"\bclass\s+subscript\b"), SWIFT + "function.subscript.class")
        .when((kind == SWIFT + "class") & declaration.rlike(r"\bactor\s+\w"), SWIFT + "actor")
        .when((kind == OBJC + "method.instance") & name.rlike(r"^-?\s*init"), OBJC + "initializer")
        .when((kind == OBJC + "property") & declaration.rlike(r"@property\s*\([^)]*\bclass\b"), OBJC + "property.class")
        .otherwise(kind)
    )


def operator_name(name: Column, declaration: Column) -> Column:
    """PRJ3: an operator's name with the types of its arguments: '+(_:_:)' of (Int, String) is '+(Int:String:)'."""
    types = F.regexp_extract_all(F.regexp_extract(declaration, r"\(([^()]*)\)", 1), F.lit(r":\s*(?:inout\s+)?([\w.<>\[\]?]+)"), F.lit(1))
    made = F.concat(F.regexp_extract(name, r"^([^(]*)", 1), F.lit("("), F.array_join(F.transform(types, lambda t: F.concat(t, F.lit(":"))), ""), F.lit(")"))
    return F.when(name.rlike(r"^[-/=+!*%<>&|^~?]+\(") & (F.size(types) > 0), made).otherwise(name)


def repaired_name(name: Column, kind: Column) -> Column:
    """PRJ3: a category as the extension that it is in the other language."""
    return F.when((kind == OBJC + "category") & name.rlike(r"^\w+\(\w*\)$"), F.regexp_extract(name, r"^(\w+)\(", 1)).otherwise(name)


def type_usr(usr: Column) -> Column:
    """PRJ12: a category's key as its class's."""
    return F.when(usr.rlike(r"^c:objc\(cy\)[^@]+@"), F.concat(F.lit("c:objc(cs)"), F.regexp_extract(usr, r"^c:objc\(cy\)([^@]+)@", 1))).otherwise(usr)


def generic_requirements(declaration: Column) -> Column:
    """PRJ13: what follows 'where', white space collapsed; null without."""
    return F.when(declaration.rlike(r"\bwhere\s"), F.trim(F.regexp_replace(F.regexp_extract(declaration, r"(?s)\bwhere\s+(.*)$", 1), r"\s+", " ")))


def qualified_name(ancestors: Column, name: Column, kind: Column, declaration: Column) -> Column:
    """PRJ11: the dotted name; Objective-C methods as '+[Class method:]'."""
    objc = kind.isin(OBJC + "method.class", OBJC + "method.instance", OBJC + "initializer") & (F.size(ancestors) > 0)
    sign = F.when(kind == OBJC + "method.class", "+").otherwise("-")
    return F.when(objc, F.concat(sign, F.lit("["), F.element_at(ancestors, -1), F.lit(" "), name, F.lit("]"))).otherwise(F.array_join(F.concat(ancestors, F.array(name)), "."))


def shown_language(primary: Column, secondary: Column, hide: str | None) -> Column:
    """PRJ7: struct<primary, secondary> of declarations struct<language, name, ..>: a hidden primary gives way to
    the secondary, or the row goes (null primary)."""
    if hide is None:
        return F.struct(primary.alias("primary"), secondary.alias("secondary"))
    none = F.when(F.lit(False), secondary)
    keep = primary["language"] != hide
    return F.struct(F.when(keep, primary).otherwise(F.when(secondary["language"] != hide, secondary)).alias("primary"),
                    F.when(keep & (secondary["language"] != hide), secondary).otherwise(none).alias("secondary"))


def location(base_file: Column, file: Column, scope_start: Column, scope_end: Column, doc_line: Column) -> Column:
    """PRJ8"""
    return F.struct(F.coalesce(base_file, file).alias("file_pathname"), F.coalesce(scope_start, doc_line).alias("first_line"), F.coalesce(scope_end, doc_line).alias("last_line"))


def language_personality(swift_name: Column, swift_decl: Column, objc_name: Column, objc_decl: Column, is_objc: Column, acl: Column) -> Column:
    """PRJ6: Objective-C rows are open; the other language's side holds only with a name and a declaration."""
    side = lambda n, d: F.when(n.isNotNull() & d.isNotNull(), F.struct(n.alias("name"), d.alias("declaration")))
    return F.struct(F.when(is_objc, F.lit("open")).otherwise(acl).alias("acl"),
                    F.when(is_objc, F.struct(objc_name.alias("name"), objc_decl.alias("declaration"))).otherwise(F.struct(swift_name.alias("name"), swift_decl.alias("declaration"))).alias("primary"),
                    F.when(is_objc, side(swift_name, swift_decl)).otherwise(side(objc_name, objc_decl)).alias("secondary"))


def default_moved(docs: Column) -> Column:
    """PRJ25: a default implementation's abstract and discussion move to the default fields."""
    none = F.lit(None).cast("string")
    return docs.withField("default_abstract", docs["abstract"]).withField("default_discussion", docs["discussion"]).withField("abstract", none).withField("discussion", none)


_NAMES = "|".join(sorted({*CALLOUTS, *DOCC_CALLOUTS}, key=len, reverse=True))


def callout(s: Column) -> Column:
    """PRJ21: struct<kind, title, body> of a list item or quote: custom 'Callout(Title): ..', then 'Parameter x: ..',
    then a known 'Term: ..', else null; case does not matter."""
    custom, param, term = r"(?is)^\s*callout\(([^)]*)\)\s*:\s*(.*)$", r"(?is)^\s*parameter\s+([^:]+?)\s*:\s*(.*)$", rf"(?is)^\s*({_NAMES}|returns|parameters|throws)\s*:\s*(.*)$"
    make = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(s, p, 1).alias("title"), F.regexp_extract(s, p, 2).alias("body"))
    return F.when(s.rlike(custom), make("custom", custom)).when(s.rlike(param), make("parameter", param)).when(s.rlike(term), make("term", term))


def xml_text(s: Column) -> Column:
    """PRJ14: the text of annotated XML."""
    out = F.regexp_replace(s, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def swift_declaration(annotated: Column, parsed: Column, attributes: Column, own_module: Column) -> Column:
    """PRJ14: the parsed text where the compiler's has lost a body's detail (no annotated text), attributes taken off
    and stacked on lines of their own, the own module's prefix dropped."""
    text = F.coalesce(F.when(annotated != "", xml_text(annotated)), parsed)
    text = F.regexp_replace(text, r"^(?:\s*@\w+(?:\([^)]*\))?\s+)+", "")
    text = F.regexp_replace(text, F.concat(F.lit(r"\b"), own_module, F.lit(r"\.")), F.lit(""))
    return F.array_join(F.concat(F.coalesce(attributes, F.array().cast("array<string>")), F.array(F.trim(text))), "\n")


#: An attribute with its arguments, which may hold quoted texts; ``name`` is a pattern.
def attribute_pattern(name: str) -> str:
    return rf"""@{name}(?:\s*\((?:[^")]|"(?:[^"\\]|\\.)*+")*+\))?"""


def compiler_text(annotated: Column, names: Column) -> Column:
    """PRJ14: the compiler's declaration out of its annotated XML: attributes go, and a nested type's full name is its own
    name. names: those of the items around and the own one, outermost first."""
    spi = F.regexp_replace(annotated, r"<syntaxtype\.attribute\.name>@_spi</syntaxtype\.attribute\.name>.*?(?=\s|<)", "")
    flat = F.btrim(xml_text(F.regexp_replace(spi, r"(?s)<syntaxtype\.attribute\.builtin>.*?</syntaxtype\.attribute\.builtin>", "")), F.lit(" \t"))
    plain = lambda n: F.regexp_replace(n, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    own = F.array_join(F.transform(names, plain), r"(?:<.*?>)?\.")
    short = F.when(F.size(names) > 1, F.regexp_replace(flat, own, F.regexp_replace(F.element_at(names, -1), r"([\\$])", r"\\$1"))).otherwise(flat)
    return F.regexp_replace(F.replace(short, F.lit(" {\n  get\n  }"), F.lit("")), r"mutating\s+mutating", "mutating")


def neat_parsed(parsed: Column) -> Column:
    """PRJ14: the parser's text without attributes before it; lines below are moved left by as much."""
    attrs = F.regexp_extract(parsed, rf"(?s)^((?:{attribute_pattern(chr(92) + 'w+')}\s*)*+)", 1)
    rest = F.substring(parsed, F.char_length(attrs) + 1, F.char_length(parsed))
    return F.when(attrs == "", parsed).otherwise(F.regexp_replace(rest, F.concat(F.lit("(?m)^ {"), F.char_length(attrs).cast("string"), F.lit("}")), F.lit("")))


def source_attributes(ranges: Column, source: Column) -> Column:
    """PRJ14: attributes by byte ranges (array<struct<offset, length>>) of a source text, each range once, in order."""
    raw = F.encode(source, "UTF-8")
    one = F.array_sort(F.array_distinct(F.transform(F.filter(ranges, lambda r: r["offset"].isNotNull() & r["length"].isNotNull()), lambda r: F.struct(r["offset"].alias("o"), r["length"].alias("n")))))
    return F.filter(F.transform(one, lambda r: F.decode(F.substring(raw, r["o"].cast("int") + 1, r["n"].cast("int")), "UTF-8")), lambda a: a.startswith("@"))


def written_attributes(annotated: Column, doc_declaration: Column) -> Column:
    """PRJ14: attributes as the annotated text and the documentation's declaration spell them, where there is no source."""
    of = lambda t, name: F.coalesce(F.regexp_extract_all(t, F.lit("(?s)" + attribute_pattern(name)), F.lit(0)), F.array().cast("array<string>"))
    return F.concat(of(xml_text(annotated), r"\w+"), of(doc_declaration, "available"))


def assembled_declaration(annotated: Column, parsed: Column, attributes: Column, names: Column, kind: Column, strip_objc: Column | None = None) -> Column:
    """PRJ14: struct<declaration, name_source, available, deprecated, unavailable, is_spi>, null without an annotated text.

    The compiler's text, or the parser's for extensions, for what the compiler lacks, and for what is written over several
    lines, other than properties. Attributes stand before it, a line each; those of availability become what they say
    instead, of several with an empty line between, and @objc goes where the Objective-C form is shown (strip_objc)."""
    compiler, none = compiler_text(annotated, names), F.array().cast("array<string>")
    is_property = kind.isin(SWIFT + "var.instance", SWIFT + "var.class", SWIFT + "var.static", SWIFT + "var.global")
    use_parsed = parsed.isNotNull() & (kind.startswith(SWIFT + "extension") | (compiler == "") | F.contains(parsed, F.lit("\n")) & ~is_property)
    best = F.when(use_parsed, neat_parsed(parsed)).otherwise(compiler)
    hide = F.lit(False) if strip_objc is None else strip_objc
    every = F.filter(F.coalesce(attributes, none), lambda a: ~(hide & a.startswith("@objc")))
    others = F.filter(every, lambda a: ~a.startswith("@available"))
    facts = F.filter(F.transform(F.filter(every, lambda a: a.startswith("@available")), availability), lambda f: f.isNotNull())
    said = lambda k: F.nullif(F.array_join(F.transform(facts, lambda f: f[k]), "\n\n"), F.lit(""))
    return F.when(annotated.isNotNull(), F.struct(
        F.array_join(F.concat(others, F.array(best)), "\n").alias("declaration"), F.when(use_parsed, "parsed").otherwise("compiler").alias("name_source"),
        F.flatten(F.transform(facts, lambda f: f["available"])).alias("available"), said("deprecated").alias("deprecated"), said("unavailable").alias("unavailable"),
        F.exists(others, lambda a: F.contains(a, F.lit("@_spi"))).alias("is_spi")))


def objc_declaration(text: Column) -> Column:
    """PRJ17: struct<text, deprecated>: attributes and macros off, white space collapsed, deprecation message kept."""
    message = F.regexp_extract(text, r'(?:deprecated|API_DEPRECATED|DEPRECATED_MSG_ATTRIBUTE)\s*\(\s*@?"([^"]*)"', 1)
    bare = F.regexp_replace(text, r"\s*(?:__attribute__\s*\(\((?:[^()]|\([^()]*\))*\)\)|(?:API|NS|DEPRECATED|SWIFT)_[A-Z_]+(?:\([^)]*\))?)", "")
    return F.struct(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"\s+;", ";").alias("text"), F.when(message != "", message).alias("deprecated"))


#: Property attributes that are the default, and notes on nullability.
DEFAULT_ATTRIBUTES = ["atomic", "readwrite", "assign", "unsafe_unretained"]
NULLABILITY = [r"(?i)\s*(?:_?_Nullable|_?_Nonnull|_?_Null_unspecified)\b", r"\b(?:nullable|nonnull|null_unspecified)\s+"]


def objc_neat(text: Column, kind: Column) -> Column:
    """PRJ17: an Objective-C declaration without what stands elsewhere: deprecations and Swift names, bodies of structures,
    default property attributes, semicolons at the end."""
    is_ = lambda *k: kind.isin(*[OBJC + x for x in k])
    s = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\n\r")), r"\s+__(?:deprecated|unavailable)", ""), r"\s+NS_SWIFT_NAME\(.*\)", "")

    def whole(s: Column) -> Column:
        return F.when(is_("category", "class", "protocol", "struct", "enum"), F.regexp_replace(s, r"(?s)\s*[{\n].*\z", "")).when(
            is_("typedef") & s.rlike(r"^typedef\s+NS_\w*\(") & ~s.endswith(")"), F.concat(s, F.lit(")"))).otherwise(s)

    def listed(s: Column) -> Column:
        attributes = F.filter(F.transform(F.split(F.regexp_extract(s, r"@property\s+\((.*?)\)", 1), ","), lambda x: F.trim(x)), lambda x: ~x.isin(DEFAULT_ATTRIBUTES) & (x != ""))
        start = bound(attributes, lambda a: F.when(F.size(a) > 0, F.concat(F.lit("@property ("), F.array_join(a, ", "), F.lit(")"))).otherwise(F.lit("@property")))
        made = F.regexp_replace(F.concat(start, F.regexp_replace(s, r"^(?s).*?@property\s+\(.*?\)", "")), r"\s+", " ")
        return F.when(is_("property", "property.class") & s.rlike(r"@property\s+\("), made).otherwise(s)

    return F.regexp_replace(bound(bound(s, whole), listed), r"[;\s]*$", "")


def _parts(*parts: tuple[bool, Column]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("is_name"), text.alias("text")) for name, text in parts])


#: A method's text before a word that a colon follows, and the word, or the rest and nothing.
SELECTOR = r"(?U)((?:\W++|\w++(?![ \t\n\x0B\f\r]*:))*+)(\w++|\z)"


def _method_pieces(decl: Column) -> Column:
    """A method's pieces, null if nothing in it is a name. It is read from word to word before a colon; bracket depths are
    running sums over what stands between them."""
    piece = lambda is_name, text: F.struct(F.lit(is_name).alias("is_name"), text.alias("text"))
    add = lambda out, text: F.when(text == "", out).otherwise(F.array_append(out, piece(False, text)))
    none = F.array().cast("array<struct<is_name:boolean,text:string>>")
    state = lambda d, text, out: F.struct(d.alias("d"), text.alias("text"), out.alias("out"))
    step = lambda x: F.char_length(F.translate(x, ")]>}", "")) - F.char_length(F.translate(x, "([<{", ""))
    part = lambda g: F.regexp_extract_all(decl, F.lit(SELECTOR), F.lit(g))
    chunks = F.zip_with(part(1), part(2), lambda x, w: F.struct(x.alias("x"), w.alias("w"), step(x).alias("s")))

    def fold(acc: Column, c: Column) -> Column:
        d = acc["d"] + c["s"]
        name = bound(F.concat(acc["text"], c["x"]), lambda text: F.array_append(add(acc["out"], text), piece(True, c["w"])))
        return F.when((d == 0) & (c["w"] != ""), state(d, F.lit(""), name)).otherwise(state(d, F.concat(acc["text"], c["x"], c["w"]), acc["out"]))

    def last(tail: Column) -> Column:
        """No word has a colon: the last one is the name."""
        word = F.regexp_extract(tail, r"(?U)^\w+", 0)
        before, behind = F.left(decl, F.char_length(decl) - F.char_length(tail)), F.substring(tail, F.char_length(word) + 1, F.char_length(tail))
        return F.when(tail != "", add(F.array_append(add(none, before), piece(True, word)), behind))

    end = F.regexp_extract(decl, r"(?U)\w++[ \t\n\x0B\f\r]*\z", 0)
    done = lambda acc: F.when(F.size(acc["out"]) > 0, add(acc["out"], acc["text"])).when(acc["d"] == 0, bound(end, last))
    return F.aggregate(chunks, state(F.lit(0), F.lit(""), none), fold, done)


def objc_pieces(neat: Column, name: Column, kind: Column) -> Column:
    """PRJ17: a neat declaration as array<struct<is_name, text>>. Types: their prefix and the name. Methods: each word before
    a colon is a name, the last word where there is none, at bracket depth 0 of (), [], <> and {}, so colons within blocks
    and generics name nothing. Variables: the type, without extern and property attributes, and the name. Functions: what
    is around the name."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for k in KINDS if k[3] is not None and k[0].startswith(OBJC) for x in (k[0], k[3])]), kind)
    is_ = lambda *k: kind.isin(*[OBJC + x for x in k])

    def read(flat: Column) -> Column:
        decl = F.regexp_replace(F.regexp_replace(flat, r"(?i)\s+OBJC_DESIGNATED_INITIALIZER\b", ""), r"(?i)\s+SWIFT_.*\b", "")
        method = F.coalesce(bound(decl, _method_pieces), _parts((True, flat)))
        # variables and functions: around the last place of the name
        behind = F.call_function("substring_index", flat, name, F.lit(-1))
        before = F.left(flat, F.char_length(flat) - F.char_length(behind) - F.char_length(name))
        kind_of = F.regexp_replace(F.regexp_replace(before, r"^(?:extern|@property\s*(?:\(.*?\))?)", ""), r"^\s+", "")
        has = (name != "") & F.contains(flat, name)
        return (F.when(is_("initializer", "method.class", "method.instance"), method)
                .when(is_("constant", "property", "property.class", "field", "ivar") & has, _parts((False, kind_of), (True, name)))
                .when(is_("function") & has, _parts((False, before), (True, name), (False, behind))).otherwise(_parts((True, flat))))

    flat = F.regexp_replace(neat, r"\s+", " ")
    for p in NULLABILITY:
        flat = F.regexp_replace(flat, p, "")
    return F.when(name.isNull(), _parts((True, neat))).when(prefix.isNotNull(), _parts((False, F.concat(prefix, F.lit(" "))), (True, name))).otherwise(bound(flat, read))


def piece_text(p: Column) -> Column:
    """Pieces as one text, names between square brackets."""
    return F.array_join(F.transform(p, lambda x: F.when(x["is_name"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"])), "")


def with_objc_declaration(defs: DataFrame, info: DataFrame) -> DataFrame:
    """PRJ18: Swift definitions(usr, kind, ..) with objc struct<name, kind, declaration, pieces>, built like any Objective-C
    declaration's from info(usr, name, declaration); null without info, for extensions, and for kinds that Objective-C
    has no partner of."""
    i = info.where("name is not null and declaration is not null").select("usr", F.col("name").alias("__name"), F.col("declaration").alias("__text"))
    partner = F.try_element_at(_partners(SWIFT), F.col("kind"))
    d = defs.join(i, "usr", "left").withColumn("__kind", F.when(~F.col("kind").startswith(SWIFT + "extension"), partner))
    d = d.withColumn("__neat", objc_neat(F.col("__text"), F.col("__kind")))
    built = F.struct(F.col("__name").alias("name"), F.col("__kind").alias("kind"), F.col("__neat").alias("declaration"), objc_pieces(F.col("__neat"), F.col("__name"), F.col("__kind")).alias("pieces"))
    return d.withColumn("objc", F.when(F.col("__text").isNotNull() & F.col("__kind").isNotNull(), built)).drop("__name", "__text", "__kind", "__neat")


def swift_of_objc(kind: Column, swift_name: Column, swift_declaration: Column) -> Column:
    """PRJ18: struct<name, kind, declaration> of an Objective-C definition in Swift, null without a Swift declaration. An
    enumeration that is imported as a structure is one."""
    partner = F.when(swift_declaration.startswith("struct"), F.lit(SWIFT + "struct")).otherwise(F.try_element_at(_partners(OBJC), kind))
    return F.when(swift_declaration.isNotNull(), F.struct(swift_name.alias("name"), partner.alias("kind"), swift_declaration.alias("declaration")))


def _partners(language: str) -> Column:
    return F.create_map(*[F.lit(x) for k in KINDS if k[1] and k[0].startswith(language) for x in (k[0], k[1])])


def availability(attribute: Column | str) -> Column:
    """PRJ15: struct<available, deprecated, unavailable> of '@available(..)' in its three forms: shorthand list, one platform
    with versions, and '*' or swift; null for anything else. Commas within quotes and brackets part nothing."""
    attribute = F.col(attribute) if isinstance(attribute, str) else attribute
    form = r"(?s)^\s*@available\s*\((.*)\)\s*$"
    inner = F.regexp_extract(attribute, form, 1)
    parts = F.transform(F.regexp_extract_all(inner, F.lit(r"(?s)(?:\"[^\"]*+(?:\"|$)|\([^()]*+\)|[^,\"])++"), F.lit(0)), lambda p: F.btrim(p, F.lit(" \t\n\r")))
    bare = lambda v: F.regexp_replace(F.btrim(v, F.lit(" \t\n\r")), r'^"+|"+$', "")
    pair = lambda p: F.struct(F.btrim(F.substring_index(p, ":", 1), F.lit(" \t\n\r")).alias("k"), bare(F.regexp_replace(p, r"(?s)^[^:]*:", "")).alias("v"))

    def read(parts: Column) -> Column:
        words = F.filter(parts, lambda p: ~F.contains(p, F.lit(":")))
        pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(":"))), pair)
        value = lambda k: F.try_element_at(F.filter(pairs, lambda x: x["k"] == k), F.lit(-1))["v"]
        word = lambda w: F.array_contains(words, w)
        short = (F.size(pairs) == 0) & F.forall(words, lambda w: w.rlike(r"(?U)^(?:\w+\s+[\d.]+|\*)$"))
        listed = F.transform(F.filter(words, lambda w: w != "*"), lambda w: F.concat(F.concat_ws(" ", F.slice(F.split(w, r"\s+"), 1, 2)), F.lit("+")))
        platform = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("*"))
        prefix = F.when(platform == "*", "").otherwise(F.concat(platform, F.lit(" ")))
        first, last = F.nullif(value("introduced"), F.lit("")), F.nullif(value("obsoleted"), F.lit(""))
        span = F.when(last.isNotNull(), F.concat(platform, F.lit(" "), F.coalesce(first, F.lit("?")), F.lit("-"), last)).otherwise(F.concat(platform, F.lit(" "), first, F.lit("+")))
        none = F.array().cast("array<string>")
        renamed = F.when(value("renamed").isNotNull(), F.concat(F.lit(" Renamed: `"), value("renamed"), F.lit("`."))).otherwise("")
        message = F.trim(F.concat(F.coalesce(value("message"), F.lit("")), renamed))

        def said(what: str, since: Column) -> Column:
            since = F.when(F.coalesce(since, F.lit("")) != "", F.concat(F.lit(" since "), since)).otherwise("")
            return F.trim(F.concat(prefix, F.lit(what), since, F.when(message != "", F.concat(F.lit(": "), message)).otherwise(".")))

        return F.struct(
            F.when(short, listed).when((platform != "*") & (first.isNotNull() | last.isNotNull()), F.array(span)).otherwise(none).alias("available"),
            F.when(~short & (word("deprecated") | value("deprecated").isNotNull()), said("deprecated", value("deprecated"))).alias("deprecated"),
            F.when(~short & (word("unavailable") | last.isNotNull()), said("unavailable", last)).alias("unavailable"))

    return F.when(attribute.rlike(form), F.transform(F.array(parts), read)[0])


#: A list item's mark at a line's beginning.
ITEM = r"[-*+]\s+"


def doc_comment(text: Column | str) -> Column:
    """PRJ20: struct of abstract (first paragraph), discussion, returns, throws, localization_key and parameters. An empty
    comment keeps its ''. List items that are callouts of the known kinds leave the text; others stay. Lines are folded
    into blocks (parted by blank lines outside of code), blocks into items, and items into what they say."""
    text = F.col(text) if isinstance(text, str) else text
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    strings, joined = F.array().cast("array<string>"), lambda x: F.array_join(x, "\n")
    begin = F.struct(F.lit(False).alias("fence"), strings.alias("now"), F.array().cast("array<array<string>>").alias("done"))

    def block(acc: Column, line: Column) -> Column:
        fence = F.when(line.rlike(r"^\s*```"), ~acc["fence"]).otherwise(acc["fence"])
        blank = (strip(line) == "") & ~fence
        shut = F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.struct(fence.alias("fence"), F.when(blank, strings).otherwise(F.array_append(acc["now"], line)).alias("now"), F.when(blank, shut).otherwise(acc["done"]).alias("done"))

    def items(lines: Column) -> Column:
        def add(acc: Column, line: Column) -> Column:
            more = F.array_append(F.element_at(acc, -1), line)
            return F.when(line.rlike(rf"^\s?{ITEM}") | (F.size(acc) == 0), F.array_append(acc, F.array(line))).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), more))

        return F.aggregate(lines, F.array().cast("array<array<string>>"), add)

    def said(item: Column) -> Column:
        """struct<kind, name, text, lines> of an item: a parameter, parameters, another callout, or text."""
        first = F.regexp_replace(F.get(item, F.lit(0)), rf"^\s*{ITEM}", "")
        below = F.slice(item, F.lit(2), F.size(item))
        param, term = r"(?i)^parameter\s+([^:]+?)\s*:\s*(.*)", r"(?i)^(parameters|returns|throws|localizationkey)\s*:\s*(.*)"
        whole = lambda p: strip(joined(F.concat(F.array(F.regexp_extract(first, p, 2)), F.transform(below, lambda x: F.regexp_replace(x, r"^\s{1,4}", "")))))
        make = lambda kind, name, t: F.struct(kind.alias("kind"), name.alias("name"), t.alias("text"), below.alias("below"))
        return F.when(first.rlike(param), make(F.lit("parameter"), F.regexp_extract(first, param, 1), whole(param))).when(
            first.rlike(term), make(F.lower(F.regexp_extract(first, term, 1)), F.lit(""), whole(term))).otherwise(make(F.lit("text"), F.lit(""), joined(item)))

    is_list = lambda b: F.get(b, F.lit(0)).rlike(rf"^\s*{ITEM}")
    parsed = lambda b: F.struct(is_list(b).alias("is_list"), joined(b).alias("text"), F.when(is_list(b), F.transform(items(b), said)).alias("items"))

    def parts(blocks: Column) -> Column:
        every = F.flatten(F.transform(F.filter(blocks, lambda b: b["is_list"]), lambda b: b["items"]))
        stay = lambda b: F.filter(b["items"], lambda i: i["kind"] == "text")
        rest = F.filter(F.transform(blocks, lambda b: F.when(~b["is_list"], b["text"]).when(F.size(stay(b)) > 0, joined(F.transform(stay(b), lambda i: i["text"])))), lambda t: t.isNotNull())
        one = rf"^\s*{ITEM}([^:]+?)\s*:\s*(.*)"
        line = lambda x: F.struct(F.when(x.rlike(one), F.regexp_extract(x, one, 1)).alias("name"), F.when(x.rlike(one), strip(F.regexp_extract(x, one, 2))).otherwise(strip(x)).alias("description"))
        listed = F.flatten(F.transform(F.filter(every, lambda i: i["kind"].isin("parameter", "parameters")), lambda i: F.when(
            i["kind"] == "parameter", F.array(F.struct(i["name"].alias("name"), i["text"].alias("description")))).otherwise(F.transform(i["below"], line))))
        none = F.array().cast("array<struct<name:string,description:string>>")

        def param(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            on = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["name"].alias("name"), strip(F.concat(last["description"], F.lit("\n"), x["description"])).alias("description")))
            return F.when(x["name"].isNotNull(), F.array_append(acc, x)).when(F.size(acc) > 0, on).otherwise(acc)

        key = lambda k: F.try_element_at(F.filter(every, lambda i: i["kind"] == k), F.lit(-1))["text"]
        lead = (F.size(rest) > 0) & ~F.get(rest, F.lit(0)).rlike(r"^\s*(?:[-*+]|#|```|>)")
        return F.struct(
            F.when(lead, F.get(rest, F.lit(0))).otherwise("").alias("abstract"), F.array_join(F.when(lead, F.slice(rest, F.lit(2), F.size(rest))).otherwise(rest), "\n\n").alias("discussion"),
            key("returns").alias("returns"), key("throws").alias("throws"), key("localizationkey").alias("localization_key"), F.aggregate(listed, none, param).alias("parameters"))

    def through(x: Column, f) -> Column:
        return F.transform(F.array(x), f)[0]

    folded = F.aggregate(F.array_append(F.split(text, "\n"), F.lit("")), begin, block, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return F.when(text.isNotNull(), through(F.transform(folded, parsed), parts))


#: The words that declare something.
KEYWORDS = "func|var|let|class|struct|enum|protocol|extension|typealias|associatedtype|actor|case|init|deinit|subscript|precedencegroup"


def pieces(declaration: Column | str) -> Column:
    """PRJ16: a Swift declaration as array<struct<is_name, text>>: its name (what follows the keyword, or init, deinit and
    subscript themselves) and its argument labels are names, in the outermost brackets and where a colon follows. Bracket
    depths and the places of labels are carried along the declaration's tokens."""
    declaration = F.col(declaration) if isinstance(declaration, str) else declaration
    keyword = F.regexp_extract(declaration, rf"\b({KEYWORDS})\b", 1)
    upto = F.regexp_extract(declaration, rf"(?s)^.*?\b(?:{KEYWORDS})\b", 0)
    intro = F.when(keyword.isin("init", "deinit", "subscript"), F.left(upto, F.char_length(upto) - F.char_length(keyword))).otherwise(F.regexp_extract(declaration, rf"(?s)^.*?\b(?:{KEYWORDS})\b\s*", 0))
    rest = F.substring(declaration, F.char_length(intro) + 1, F.char_length(declaration))
    name = F.regexp_extract(rest, r"(?U)^(?:[\w.`]+|[-/=+!*%<>&|^~?]+)", 0)
    tail = F.substring(rest, F.char_length(name) + 1, F.char_length(rest))
    none = F.array().cast("array<struct<is_name:boolean,text:string>>")

    def joined(out: Column, is_name: Column, text: Column) -> Column:
        """A piece more: one that is like the last goes on with it."""
        last = F.try_element_at(out, F.lit(-1))
        more = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(is_name.alias("is_name"), F.concat(last["text"], text).alias("text"))))
        return F.when(text == "", out).when(last["is_name"] == is_name, more).otherwise(F.array_append(out, F.struct(is_name.alias("is_name"), text.alias("text"))))

    def labelled(tokens: Column) -> Column:
        at = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.array_join(F.slice(tokens, i + 2, F.lit(4)), "").rlike(r"(?U)^\s*\w*\s*:").alias("colon")))
        start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("label"), joined(joined(none, F.lit(False), intro), F.lit(True), name).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            opens, shuts = x["t"].isin("(", "[", "<", "{"), x["t"].isin(")", "]", ">", "}")
            depth = acc["depth"] + F.when(opens, 1).when(shuts, -1).otherwise(0)
            here = acc["label"] & (acc["depth"] == 1) & x["t"].rlike(r"(?U)^\w")
            label = F.when(opens, (x["t"] == "(") & (depth == 1)).when((x["t"] == ",") & (acc["depth"] == 1), True).when(here, False).otherwise(acc["label"])
            return F.struct(depth.alias("depth"), label.alias("label"), joined(acc["out"], here & x["colon"], x["t"]).alias("out"))

        return F.aggregate(at, start, step, lambda acc: acc["out"])

    tokens = F.regexp_extract_all(tail, F.lit(r"(?U)\w+|\s+|->|[^\w\s]"), F.lit(0))
    found = F.transform(F.array(tokens), labelled)[0]
    return F.when(F.coalesce(declaration, F.lit("")) == "", none).when(keyword == "", _parts((True, declaration))).otherwise(found)


# ---- parsers ---------------------------------------------------------------------------------------------------


#: Tokens of XML: comments, character data, instructions, tags, text; and tags that are well-formed.
XML_TOKEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>|[^<]+|<"
XML_OPEN, XML_CLOSE = r"""(?s)^<([A-Za-z_:][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*+)\s*(/?)>$""", r"^</([A-Za-z_:][\w:.-]*)\s*>$"
#: What inline elements become, and elements that become callouts.
INLINE = {"codeVoice": "`", "emphasis": "*", "bold": "**"}
CALLOUT_TAGS = ["Note", "Warning", "Important", "SeeAlso", "Remark", "Attention", "Bug", "Todo", "Complexity", "Since", "Version"]
_TOKEN = "struct<kind:string,tag:string,text:string>"
#: Of an open element what few have: list items and lines of code below it, and a parameter's name and description.
_REST = "struct<items:array<string>,code:array<string>,name:string,about:string>"
#: An open element: its tag, its text as markdown and as it stands, its children as blocks, and the rest.
_FRAME = f"struct<token:{_TOKEN},md:string,raw:string,blocks:array<string>,rest:{_REST}>"
_DOC = "struct<abstract:string,discussion:string,returns:string,throws:string,localization_key:string,parameters:array<struct<name:string,description:string>>>"
#: Elements whose children are looked at as blocks.
BLOCKS_OF = ["Abstract", "Discussion", "ResultDiscussion", "ThrowsDiscussion", "Item", *CALLOUT_TAGS]


def xml_token(t: Column) -> Column:
    """A token as struct<kind, tag, text>: open, close, alone (both), text or data with its characters, note (a comment or an
    instruction) or bad. A tag's text is the tag."""
    make = lambda kind, tag, text: F.struct(F.lit(kind).alias("kind"), tag.alias("tag"), text.alias("text"))
    nothing = F.lit("")

    def plain(t: Column) -> Column:
        for x, y in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(x), F.lit(y))
        return t

    odd = t.rlike(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)")
    text = F.when(~F.contains(t, F.lit("&")), make("text", nothing, t)).when(odd, make("bad", nothing, t)).otherwise(make("text", nothing, plain(t)))
    shut = bound(F.regexp_extract(t, XML_CLOSE, 1), lambda tag: F.when(tag == "", make("bad", nothing, t)).otherwise(make("close", tag, t)))
    opens = bound(F.regexp_extract(t, XML_OPEN, 1), lambda tag: F.when(tag == "", make("bad", nothing, t)).when(t.endswith("/>"), make("alone", tag, t)).otherwise(make("open", tag, t)))
    return (F.when(~t.startswith("<"), text).when(t.startswith("</"), shut).when(t.startswith("<!--") | t.startswith("<?"), make("note", nothing, t))
            .when(t.startswith("<![CDATA["), make("data", nothing, F.substring(t, F.lit(10), F.length(t) - 12))).otherwise(opens))


def xml_docs(xml: Column | str, brief: bool = False) -> Column:
    """PRJ22: an XML documentation comment as the parts that ``doc_comment`` gives; null if it is not well-formed. brief drops
    the discussion. Tokens are folded over a stack of open elements: one that closes becomes markdown and goes into the
    element around it. A step evaluates each value once and builds anew only what it changes."""
    xml = F.col(xml) if isinstance(xml, str) else xml
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lit, null, strings = F.lit, F.lit(None).cast("string"), F.array().cast("array<string>")
    struct = lambda **f: F.struct(*[c.alias(n) for n, c in f.items()])
    changed = lambda x, names, **f: F.struct(*[f.get(n, x[n]).alias(n) for n in names])
    frame = lambda x, **f: changed(x, ["token", "md", "raw", "blocks", "rest"], **f)
    state = lambda acc, **f: changed(acc, ["stack", "ok", "roots", "said"], **f)
    new = lambda t: struct(token=t, md=lit(""), raw=lit(""), blocks=strings, rest=struct(items=strings, code=strings, name=null, about=null))
    upto = lambda stack, n: F.slice(stack, lit(1), n)
    depth = lambda acc: F.size(acc["stack"])

    def opened(acc: Column, t: Column) -> Column:
        return state(acc, stack=F.array_append(acc["stack"], new(t)), roots=acc["roots"] + (depth(acc) == 0).cast("int"))

    def text(acc: Column, t: Column) -> Column:
        more = lambda e: F.array_append(upto(acc["stack"], depth(acc) - 1), frame(e, md=F.concat(e["md"], t["text"]), raw=F.concat(e["raw"], t["text"])))
        blank = (t["kind"] == "text") & (strip(t["text"]) == "")
        return F.when(depth(acc) == 0, state(acc, ok=blank)).otherwise(state(acc, stack=bound(F.try_element_at(acc["stack"], lit(-1)), more)))

    def around(up: Column, e: Column) -> Column:
        """The element around with the one that closes in it."""
        tag, up_tag, own, its = e["token"]["tag"], up["token"]["tag"], e["rest"], up["rest"]
        attr = lambda n: F.regexp_extract(e["token"]["text"], rf"""\s{n}\s*=\s*["']([^"']*)""", 1)
        inline = F.when(tag == "Link", F.concat(lit("["), e["md"], lit("]("), attr("href"), lit(")")))
        for name, mark in INLINE.items():
            inline = inline.when(tag == name, F.concat(lit(mark), e["md"], lit(mark)))
        mark = F.when(up_tag == "List-Bullet", "- ").otherwise(F.concat((F.size(its["items"]) + 1).cast("string"), lit(". ")))
        lines = tag == "zCodeLineNumbered"
        of = up_tag == "Parameter"
        rest = struct(items=F.when(tag == "Item", F.array_append(its["items"], F.concat(mark, F.array_join(e["blocks"], "\n")))).otherwise(its["items"]),
                      code=F.concat(its["code"], F.when(lines, F.array(e["raw"])).otherwise(own["code"])),
                      name=F.when(of & (tag == "Name"), F.coalesce(its["name"], e["raw"])).otherwise(its["name"]), about=F.when(of & (tag == "Discussion"), F.coalesce(its["about"], F.array_join(e["blocks"], "\n\n"))).otherwise(its["about"]))

        def put(inline: Column) -> Column:
            block = (F.when(tag == "CodeListing", F.concat(lit("```"), attr("language"), lit("\n"), F.array_join(own["code"], "\n"), lit("\n```")))
                     .when(tag.isin("List-Bullet", "List-Number"), F.array_join(own["items"], "\n")).when(tag.isin(CALLOUT_TAGS), F.concat(lit("- "), tag, lit(": "), F.array_join(e["blocks"], " "))).otherwise(strip(inline)))
            return frame(up, md=F.concat(up["md"], inline), raw=F.concat(up["raw"], e["raw"]), blocks=F.when(up_tag.isin(BLOCKS_OF), F.array_append(up["blocks"], block)).otherwise(up["blocks"]),
                         rest=F.when(of | lines | (tag == "Item") | (F.size(own["code"]) > 0), rest).otherwise(its))

        return bound(inline.otherwise(e["md"]), put)

    def closed(acc: Column, e: Column, n: Column, tag: Column) -> Column:
        """n: how many elements are around the one that closes."""
        own, said = e["token"]["tag"], acc["said"]
        first = lambda c, when: F.when(when & said[c].isNull(), F.array_join(e["blocks"], "\n\n")).otherwise(said[c])
        main = (own == "Discussion") & (n == 2) & (F.try_element_at(acc["stack"], lit(2))["token"]["tag"] == "CommentParts")
        param = struct(name=F.coalesce(e["rest"]["name"], lit("")), description=F.coalesce(e["rest"]["about"], lit("")))
        more = struct(abstract=first("abstract", own == "Abstract"), discussion=first("discussion", main), returns=first("returns", own == "ResultDiscussion"), throws=first("throws", own == "ThrowsDiscussion"),
                      parameters=F.when(own == "Parameter", F.array_append(said["parameters"], param)).otherwise(said["parameters"]))
        out = bound(F.try_element_at(acc["stack"], n), lambda up: F.array_append(upto(acc["stack"], n - 1), around(up, e)))
        return state(acc, stack=F.when(n > 0, out).otherwise(upto(acc["stack"], lit(0))), ok=own == tag, said=F.when(own.isin("Abstract", "Discussion", "ResultDiscussion", "ThrowsDiscussion", "Parameter"), more).otherwise(said))

    def step(acc: Column, t: Column) -> Column:
        alone = t["kind"] == "alone"
        own = struct(e=F.when(alone, new(t)).otherwise(F.try_element_at(acc["stack"], lit(-1))), n=depth(acc) - F.when(alone, 0).otherwise(1))
        # an element alone that is outside is a root too
        shut = bound(own, lambda x: closed(state(acc, roots=acc["roots"] + (alone & (depth(acc) == 0)).cast("int")), x["e"], x["n"], t["tag"]))
        return (F.when(t["kind"] == "note", acc).when(t["kind"] == "open", opened(acc, t)).when(t["kind"].isin("text", "data"), text(acc, t))
                .when((t["kind"] == "bad") | ~alone & (depth(acc) == 0), state(acc, ok=lit(False))).otherwise(shut))

    none, parameters = lit(None).cast(_DOC), F.array().cast("array<struct<name:string,description:string>>")
    start = struct(stack=F.array().cast(f"array<{_FRAME}>"), ok=lit(True), roots=lit(0), said=struct(abstract=null, discussion=null, returns=null, throws=null, parameters=parameters))

    def done(acc: Column) -> Column:
        said = acc["said"]
        discussion = lit("") if brief else F.coalesce(said["discussion"], lit(""))
        return F.when(acc["ok"] & (acc["roots"] == 1) & (depth(acc) == 0), struct(
            abstract=F.coalesce(said["abstract"], lit("")), discussion=discussion, returns=said["returns"], throws=said["throws"], localization_key=null, parameters=said["parameters"])).otherwise(none)

    return F.aggregate(F.regexp_extract_all(xml, F.lit(XML_TOKEN), F.lit(0)), start, lambda acc, t: F.when(~acc["ok"], acc).otherwise(bound(xml_token(t), lambda x: step(acc, x))), done)


def escaped(s: Column, quotes: bool = True) -> Column:
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        s = F.replace(s, F.lit(x), F.lit(y))
    return s


#: Code, an image (with a width), a link; and what stands for one while the text around is marked up.
SPAN, MARK = r"`[^`]+`|!\[[^\]|]*(?:\|\d+%)?\]\([^)\s]*\)|\[[^\]]*\]\([^)\s]*\)", "\u0001"


def inline_html(text: Column) -> Column:
    """LNK7: code, images, links and emphasis of a text. Spans are taken out, the text between is escaped and marked up as
    one, and the spans go back in their order."""
    text = F.replace(text, F.lit(MARK), F.lit(""))
    coded = lambda x: F.regexp_replace(escaped(x), r"`([^`]+)`", "<code>$1</code>")
    address = lambda x: F.regexp_extract(x, r"(?s)\]\(([^)\s]*)\)$", 1)

    def span(x: Column) -> Column:
        width = F.regexp_extract(x, r"\|(\d+)%\]\([^)\s]*\)$", 1)
        image = F.concat(F.lit('<img src="'), address(x), F.lit('" alt="'), escaped(F.regexp_extract(x, r"(?s)^!\[([^\]|]*)", 1)), F.lit('"'),
                         F.when(width != "", F.concat(F.lit(' style="width: '), width, F.lit('%"'))).otherwise(""), F.lit("/>"))
        link = F.concat(F.lit('<a href="'), address(x), F.lit('">'), coded(F.regexp_extract(x, r"(?s)^\[([^\]]*)", 1)), F.lit("</a>"))
        return F.when(x.startswith("`"), coded(x)).when(x.startswith("!"), image).otherwise(link)

    spans = F.transform(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)), span)
    around = escaped(F.array_join(F.split(text, SPAN, -1), MARK), quotes=False)
    around = F.regexp_replace(F.regexp_replace(around, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"(?U)(?<!\w)[*_](.+?)[*_](?!\w)", "<em>$1</em>")
    return F.array_join(F.zip_with(F.split(around, MARK, -1), spans, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def to_html(text: Column | str, code_language: str = "swift") -> Column:
    """LNK7: the extraction subset of markdown to HTML: headings with anchors, paragraphs, lists, code with a default
    language (to the end if it is left open), quotes, links, images with a width, emphasis, mathematics left as it is.
    Lines are folded into blocks; what a block is decides how its lines are rendered."""
    text = F.col(text) if isinstance(text, str) else text
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    make = lambda kind, lines, arg="": F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), lines.alias("lines"), (F.lit(arg) if isinstance(arg, str) else arg).alias("arg"))
    strings = F.array().cast("array<string>")
    nothing = make("", strings)
    heading, item = r"^(#{1,6})\s+(.*?)\s*#*$", r"^\s*[-*+]\s+(.*)"

    def fold(acc: Column, line: Column) -> Column:
        now, kind = acc["now"], acc["now"]["kind"]
        shut = F.when(kind != "", F.array_append(acc["out"], now)).otherwise(acc["out"])
        state = lambda now, out: F.struct(now.alias("now"), out.alias("out"))
        whole = lambda block: state(nothing, F.array_append(shut, block))
        more = lambda x: make(kind, F.array_append(now["lines"], x), now["arg"])
        fence = line.rlike(r"^\s*```")
        language = F.coalesce(F.nullif(strip(F.substring(strip(line), F.lit(4), F.length(line))), F.lit("")), F.lit(code_language))
        longer = make(kind, F.array_append(F.slice(now["lines"], F.lit(1), F.size(now["lines"]) - 1), F.concat(F.try_element_at(now["lines"], F.lit(-1)), F.lit(" "), strip(line))), now["arg"])
        entry = F.regexp_extract(line, item, 1)
        return (
            F.when((kind == "code") & fence, state(nothing, shut)).when(kind == "code", state(more(line), acc["out"]))
            .when(fence, state(make("code", strings, language), shut))
            .when(line.rlike(heading), whole(make("heading", F.array(F.regexp_extract(line, heading, 2)), F.length(F.regexp_extract(line, heading, 1)).cast("string"))))
            .when(line.rlike(item), F.when(kind == "items", state(more(entry), acc["out"])).otherwise(state(make("items", F.array(entry)), shut)))
            .when(line.startswith(">"), whole(make("quote", F.array(strip(F.substring(line, F.lit(2), F.length(line)))))))
            .when(strip(line) == "", state(nothing, shut))
            .when(kind == "items", state(longer, acc["out"]))
            .when(kind == "para", state(more(strip(line)), acc["out"])).otherwise(state(make("para", F.array(strip(line))), shut)))

    def rendered(b: Column) -> Column:
        first = F.get(b["lines"], F.lit(0))
        slug = F.lower(F.regexp_replace(F.regexp_replace(first, r"(?U)[^\w\s]", ""), r"(?U)\s+", "-"))
        tag = F.concat(F.lit("h"), b["arg"])
        titled = F.concat(F.lit("<"), tag, F.lit(' id="'), F.when(slug == "", "e").otherwise(slug), F.lit('">'), inline_html(first), F.lit("</"), tag, F.lit(">"))
        code = F.concat(F.lit('<pre><code class="language-'), b["arg"], F.lit('">'), escaped(F.array_join(b["lines"], "\n")), F.lit("</code></pre>"))
        listed = F.concat(F.lit("<ul>"), F.array_join(F.transform(b["lines"], lambda x: F.concat(F.lit("<li>"), inline_html(x), F.lit("</li>"))), ""), F.lit("</ul>"))
        return (F.when(b["kind"] == "heading", titled).when(b["kind"] == "code", code).when(b["kind"] == "items", listed)
                .when(b["kind"] == "quote", F.concat(F.lit("<blockquote><p>"), inline_html(first), F.lit("</p></blockquote>"))).otherwise(F.concat(F.lit("<p>"), inline_html(F.array_join(b["lines"], " ")), F.lit("</p>"))))

    start = F.struct(nothing.alias("now"), F.array().cast("array<struct<kind:string,lines:array<string>,arg:string>>").alias("out"))
    blocks = F.aggregate(F.split(text, "\n"), start, fold, lambda acc: F.when(acc["now"]["kind"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]))
    return F.when(text.isNotNull(), F.array_join(F.transform(blocks, rendered), "\n"))
