"""Fixed values of the data model: ordered enumerations, the kind catalogue, counters, callouts, and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Enumerations in rank order.
ACLS = ["private", "fileprivate", "internal", "public", "open"]
TOPICS = ["associatedType", "type", "initializer", "deinitializer", "enumElement", "method", "operator", "property", "field",
          "subscript", "staticMethod", "staticProperty", "staticSubscript", "classMethod", "classProperty", "classSubscript", "other"]
NOTES = ["imported", "protocolExtensionMember", "defaultImplementation", "conditionalDefaultImplementationExists",
         "conditionalDefaultImplementation", "importedDefaultImplementation", "unavailable"]
ITEM_KINDS = ["guide", "type", "variable", "function", "operator", "extension", "group", "other"]
ITEM_KIND_NAMES = {"guide": "Guides", "type": "Types", "variable": "Variables", "function": "Functions", "operator": "Operators",
                   "extension": "Extensions", "group": "Others", "other": "Others"}

#: Prefixes of kind keys and access levels on the wire.
SWIFT, OBJC, ACCESS = "source.lang.swift.decl.", "sourcekitten.source.lang.objc.decl.", "source.lang.swift.accessibility."

#: Key, partner key in the other language, index name, declaration prefix, item kind, topic.
KINDS = [
    (OBJC + "unexposed", None, "Type", None, "other", "other"),
    (OBJC + "category", SWIFT + "extension", "Extension", "@interface", "extension", "other"),
    (OBJC + "class", SWIFT + "class", "Class", "@interface", "type", "other"),
    (OBJC + "constant", SWIFT + "var.global", "Constant", None, "variable", "other"),
    (OBJC + "enum", SWIFT + "enum", "Enum", "enum", "type", "other"),
    (OBJC + "enumcase", SWIFT + "enumelement", "Case", "", "other", "enumElement"),
    (OBJC + "initializer", SWIFT + "function.constructor", "Initializer", None, "other", "initializer"),
    (OBJC + "method.class", SWIFT + "function.method.class", "Method", None, "other", "classMethod"),
    (OBJC + "method.instance", SWIFT + "function.method.instance", "Method", None, "other", "method"),
    (OBJC + "property", SWIFT + "var.instance", "Property", None, "other", "property"),
    (OBJC + "property.class", SWIFT + "var.class", "Property", None, "other", "classProperty"),
    (OBJC + "protocol", SWIFT + "protocol", "Protocol", "@protocol", "type", "other"),
    (OBJC + "typedef", SWIFT + "typealias", "Type", "typedef", "type", "other"),
    (OBJC + "function", SWIFT + "function.free", "Function", None, "function", "other"),
    (OBJC + "struct", SWIFT + "struct", "Struct", "struct", "type", "other"),
    (OBJC + "field", SWIFT + "var.instance", "Field", None, "other", "field"),
    (OBJC + "ivar", None, "Variable", None, "other", "field"),
    ("sourcekitten.source.lang.objc.mark", None, "", None, "other", "other"),
    ("sourcekitten.source.lang.objc.module.import", None, "", None, "other", "other"),
    (SWIFT + "function.accessor.address", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.didset", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.getter", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.mutableaddress", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.setter", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.willset", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.read", None, "Function", None, "other", "other"),
    (SWIFT + "function.accessor.modify", None, "Function", None, "other", "other"),
    (SWIFT + "function.operator", None, "Function", "static func", "operator", "operator"),
    (SWIFT + "function.operator.infix", None, "Function", None, "other", "other"),
    (SWIFT + "function.operator.postfix", None, "Function", None, "other", "other"),
    (SWIFT + "function.operator.prefix", None, "Function", None, "other", "other"),
    (SWIFT + "function.method.class", OBJC + "method.class", "Method", "class func", "other", "classMethod"),
    (SWIFT + "var.class", OBJC + "property.class", "Property", "class var", "other", "classProperty"),
    (SWIFT + "class", OBJC + "class", "Class", "class", "type", "type"),
    (SWIFT + "function.constructor", OBJC + "initializer", "Constructor", None, "other", "initializer"),
    (SWIFT + "function.destructor", None, "Method", None, "other", "deinitializer"),
    (SWIFT + "var.global", OBJC + "constant", "Global", "var", "variable", "other"),
    (SWIFT + "enumcase", None, "Case", "case", "other", "enumElement"),
    (SWIFT + "enumelement", OBJC + "enumcase", "Case", "case", "other", "enumElement"),
    (SWIFT + "enum", OBJC + "enum", "enum", "enum", "type", "type"),
    (SWIFT + "extension", OBJC + "category", "Extension", "extension", "extension", "other"),
    (SWIFT + "extension.class", None, "Extension", "extension", "extension", "other"),
    (SWIFT + "extension.enum", None, "Extension", "extension", "extension", "other"),
    (SWIFT + "extension.protocol", None, "Extension", "extension", "extension", "other"),
    (SWIFT + "extension.struct", None, "Extension", "extension", "extension", "other"),
    (SWIFT + "function.free", OBJC + "function", "Global", "func", "function", "other"),
    (SWIFT + "function.method.instance", OBJC + "method.instance", "Method", "func", "other", "method"),
    (SWIFT + "var.instance", OBJC + "property", "Property", "var", "other", "property"),
    (SWIFT + "var.local", None, "Variable", "var", "other", "other"),
    (SWIFT + "var.parameter", None, "Parameter", None, "other", "other"),
    (SWIFT + "protocol", OBJC + "protocol", "Protocol", "protocol", "type", "type"),
    (SWIFT + "function.method.static", OBJC + "method.class", "Method", "static func", "other", "staticMethod"),
    (SWIFT + "var.static", OBJC + "property.class", "Variable", "static var", "other", "staticProperty"),
    (SWIFT + "struct", OBJC + "struct", "Struct", "struct", "type", "type"),
    (SWIFT + "function.subscript", None, "Method", None, "other", "subscript"),
    (SWIFT + "function.subscript.class", None, "Method", "class", "other", "classSubscript"),
    (SWIFT + "function.subscript.static", None, "Method", "static", "other", "staticSubscript"),
    (SWIFT + "typealias", OBJC + "typedef", "Alias", "typealias", "type", "type"),
    (SWIFT + "generic_type_param", None, "Parameter", None, "other", "other"),
    (SWIFT + "associatedtype", None, "Type", "associatedtype", "other", "associatedType"),
    (SWIFT + "opaquetype", None, "Type", None, "other", "other"),
    (SWIFT + "module", None, "Module", None, "other", "other"),
    (SWIFT + "precedencegroup", None, "Type", "precedencegroup", "other", "other"),
    ("source.lang.swift.syntaxtype.comment.mark", None, "", None, "other", "other"),
    (SWIFT + "actor", None, "Actor", "actor", "type", "type"),
]

#: The counters of a run.
COUNTERS = """
gatherDef gatherDefImport gatherFailure gatherLocalizationKey gatherLocalizationSuccess gatherLocalizationFailure gatherSwiftToObjC
gatherXMLDocCommentsParsed gatherXMLDocCommentsFailed importFailureNoRoot importFailureNoType importFailureNoUsr importFailureIncomplete
importExcluded importGuessedAcl importFailureLanguage importFailureLanguageKind mergeDupUsr mergeDupUsrMismatch
mergeDefaultImplementation mergeDemoteDefaultImplementation filterFilename filterSymbolName filterNoDoc filterSpi
filterMinAclExcluded filterMinAclIncluded filterUselessExtension missingDocumentation documentedDef filterSkipUndocumented
filterSkipUndocOverride formatMarkdown formatRewrittenMediaLinks formatRewrittenGuideLinks formatRewrittenReadmeLinks
formatUnrewrittenLinks formatMathExpression autolinkLocalLocalScope autolinkLocalNestedScope autolinkLocalGlobalScope
autolinkSelfLink autolinkNotAutolinked autolinkCacheHitHit autolinkCacheHitMiss autolinkAppleSuccess autolinkAppleFailure
autolinkRemoteSuccess autolinkRemoteSuccessModule autolinkRemoteFailure autolinkUnresolved customAbstractDef customAbstractGroup
groupExcludedGuidesByKind groupIncludedGuidesByKind groupIncludedDefsByKind groupsByKind groupCustomDecoded groupCustomDefDecoded
""".split()

#: Callout names.
CALLOUTS = """
attention author authors bug complexity copyright date experiment important invariant localizationkey mutatingvariant
nonmutatingvariant note postcondition precondition remark remarks throws requires seealso since tag todo version warning keyword
recommended recommendedover example see
""".split()
DOCC_CALLOUTS = ["experiment", "important", "note", "tip", "warning"]

#: Symbol-graph kinds of edges, and its kinds of symbols as kind keys.
EDGES = ["memberOf", "conformsTo", "defaultImplementationOf", "overrides", "inheritsFrom", "requirementOf", "optionalRequirementOf"]
GRAPH_KINDS = {
    "swift.class": "class", "swift.struct": "struct", "swift.enum": "enum", "swift.enum.case": "enumelement", "swift.protocol": "protocol",
    "swift.init": "function.constructor", "swift.deinit": "function.destructor", "swift.func.op": "function.operator",
    "swift.type.method": "function.method.static", "swift.static.method": "function.method.static", "swift.method": "function.method.instance",
    "swift.func": "function.free", "swift.type.property": "var.static", "swift.static.property": "var.static", "swift.property": "var.instance",
    "swift.var": "var.global", "swift.subscript": "function.subscript", "swift.type.subscript": "function.subscript.static",
    "swift.static.subscript": "function.subscript.static", "swift.typealias": "typealias", "swift.associatedtype": "associatedtype",
    "swift.extension": "extension", "swift.actor": "actor",
}

#: Schemas of inputs whose shape is fixed.
_CONSTRAINTS = "array<struct<kind:string,lhs:string,rhs:string>>"
_VERSION = "struct<major:int,minor:int,patch:int>"
SYMBOL_GRAPH = (
    "metadata struct<generator:string>, symbols array<struct<kind:struct<identifier:string>, identifier:struct<precise:string>, "
    "pathComponents:array<string>, docComment:struct<lines:array<struct<text:string>>>, "
    f"swiftGenerics:struct<parameters:array<struct<name:string,depth:int>>, constraints:{_CONSTRAINTS}>, "
    f"swiftExtension:struct<extendedModule:string, constraints:{_CONSTRAINTS}>, "
    "declarationFragments:array<struct<spelling:string,kind:string>>, accessLevel:string, "
    f"availability:array<struct<domain:string,introduced:{_VERSION},deprecated:{_VERSION},obsoleted:{_VERSION},message:string,renamed:string,"
    "isUnconditionallyDeprecated:boolean,isUnconditionallyUnavailable:boolean>>, spi:boolean, "
    "location:struct<uri:string,position:struct<line:int,character:int>>>>, "
    f"relationships array<struct<kind:string,source:string,target:string,targetFallback:string,swiftConstraints:{_CONSTRAINTS}>>"
)


def rank(value: Column, order: list[str], unknown: int | None = None) -> Column:
    """The place of a value in an ordered enumeration, as a literal map (no join); unknown values: ``unknown``."""
    pairs = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(unknown).cast("int"))


def acl_of(name: Column, accessibility: Column, has_attributes: Column) -> Column:
    """PRJ10: struct<acl, guessed>. A bare deinit is internal; missing and unknown levels are internal, a missing
    one counted as guessed."""
    known = F.create_map(*[x for a in ACLS for x in (F.lit(ACCESS + a), F.lit(a))])
    bare = (name == "deinit") & ~has_attributes
    return F.struct(
        F.when(bare, F.lit("internal")).otherwise(F.coalesce(F.try_element_at(known, accessibility), F.lit("internal"))).alias("acl"),
        (~bare & accessibility.isNull()).alias("guessed"),
    )


def kind_predicates(key: Column) -> dict[str, Column]:
    """FLT12: what a kind is, by its key."""
    is_one = lambda *names: key.isin(*[p + n for n in names for p in (SWIFT, OBJC)])
    swift, objc = key.startswith(SWIFT), key.startswith("sourcekitten.source.lang.objc.")
    extension = key.startswith(SWIFT + "extension") | (key == OBJC + "category")
    return {
        "is_swift": swift, "is_objc": objc, "is_mark": key.endswith(".mark"), "is_extension": extension,
        "is_swift_extension": key.startswith(SWIFT + "extension"), "is_protocol": is_one("protocol"), "is_class": is_one("class"),
        "is_struct": is_one("struct"), "is_enum": is_one("enum"), "is_actor": is_one("actor"),
        "is_enum_case": key == SWIFT + "enumcase", "is_enum_element": is_one("enumelement") | (key == OBJC + "enumcase"),
        "is_initializer": key.isin(SWIFT + "function.constructor", OBJC + "initializer"), "is_deinitializer": key == SWIFT + "function.destructor",
        "is_subscript": key.startswith(SWIFT + "function.subscript"), "is_operator": key.startswith(SWIFT + "function.operator"),
        "is_typealias": key.isin(SWIFT + "typealias", OBJC + "typedef"), "is_generic_parameter": key == SWIFT + "generic_type_param",
        "is_method": key.startswith(SWIFT + "function.method") | key.startswith(OBJC + "method"),
        "is_property": key.isin(SWIFT + "var.instance", SWIFT + "var.class", SWIFT + "var.static", OBJC + "property", OBJC + "property.class"),
        "is_variable": key.isin(SWIFT + "var.global", OBJC + "constant"),
    }


def dim_kind(spark: SparkSession) -> DataFrame:
    rows = [(*k, ITEM_KINDS.index(k[4]), TOPICS.index(k[5])) for k in KINDS]
    d = spark.createDataFrame(rows, "kind string, other_kind string, dash_name string, decl_prefix string, meta_kind string, def_topic string, meta_rank int, topic_rank int")
    return d.withColumns(kind_predicates(F.col("kind")))


def dim(spark: SparkSession, names: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), f"rank int, {name} string")
